"""Links and components of vectors against every cosine."""

import math

import numpy as np
import pytest

from pagegauge.llm import sign_hash

SCHEMA = "vec_id bigint, embedding array<float>, label int, unit string, row string, space string, n string, v string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, *["x"] * 5) for i, v, label in rows], SCHEMA).repartition(3)


def plain(rows, cosine=0.93):
    vectors = []
    for _, v, label in rows:
        good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.array(v, dtype=np.float32).astype(np.float64) if good else None
        vectors.append(x / np.linalg.norm(x) if good else None)
    n = len(rows)
    links = [
        [j for j in range(n) if j != i and vectors[i] is not None and vectors[j] is not None and rows[i][2] == rows[j][2]
         and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] >= cosine] for i in range(n)
    ]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return out


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def around(rng, middle, spread, n):
    """Vectors at about an angle of ``spread`` degrees from ``middle``."""
    noise = rng.normal(size=(n, len(middle)))
    noise -= np.outer(noise @ middle, middle) / (middle @ middle)
    noise *= np.linalg.norm(middle) * math.tan(math.radians(spread)) / np.linalg.norm(noise, axis=1, keepdims=True)
    return (middle + noise).astype(np.float32).tolist()


def cloud(spreads, n=40, length=64, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for k, spread in enumerate(spreads):
        rows += [(None, v, k % 3) for v in around(rng, rng.normal(size=length), spread, n)]
    rows += [(None, v, int(rng.integers(3))) for v in rng.normal(size=(150, length)).astype(np.float32).tolist()]
    return [(int(i), v, label) for i, (_, v, label) in zip(rng.permutation(len(rows)), rows)]


@pytest.mark.parametrize("crowd, block", [(32, 1024), (4, 16), (1_000_000, 8)])
def test_links_against_every_cosine(spark, monkeypatch, crowd, block):
    """Tight and loose groups, in balls and without, in one block and in many."""
    monkeypatch.setattr(sign_hash, "CROWD", crowd)
    monkeypatch.setattr(sign_hash, "BLOCK", block)
    # Groups whose pairs lie at 1, 5, 12, 18 degrees, on both sides of 21.6 degrees, and far apart.
    rows = cloud([0.7, 3.5, 8.5, 12.5, 14.8, 30])
    # A chain: neighbours are linked, ends are not.
    flat = np.zeros(64)
    for k in range(12):
        turned = flat.copy()
        turned[0], turned[1] = math.cos(math.radians(15 * k)), math.sin(math.radians(15 * k))
        rows.append((1000 + k, turned.tolist(), 5))
    got = sign_hash.near_duplicates(table(spark, rows), recall=0.99999).collect()
    same(got, plain(rows))


def test_edge_cases(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (5, one, 1), (3, one, 1), (9, one, 1), (9, one, 1), (None, one, 1), (2, one, 2), (4, one, None), (6, None, 1), (7, [], 1), (8, [0.0] * 4, 1),
        (10, [1.0, None, 3.0, 4.0], 1), (11, [1.0, float("nan"), 3.0, 4.0], 1), (12, [float("inf"), 2.0, 3.0, 4.0], 1), (13, [1.0, 2.0, 3.0], 1),
        (None, [0.0] * 4, 1), (None, None, None), (14, [x * 1e-30 for x in one], 1), (15, [x * 1e30 for x in one], 1), (None, [9.0, -1.0], 7), (16, [-x for x in one], 1),
    ]
    got = sign_hash.near_duplicates(table(spark, rows)).collect()
    want = plain(rows)
    # A row without an id that reaches no id is its own component.
    want = [(i, n, least, True if i is None and least is None else kept) for i, n, least, kept in want]
    # Vectors that are never compared keep their own id.
    same(got, want)
    assert sign_hash.near_duplicates(table(spark, [])).count() == 0


def test_a_third_of_all_rows_in_one_group_forms_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    made = []
    kept = sign_hash.stored

    def count(df, name):
        out = kept(df, name)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(sign_hash, "stored", count)
    middle = rng.normal(size=64)
    rows = [(i, v, 1) for i, v in enumerate(around(rng, middle, 4, 2000))]
    rows += [(5000 + i, rows[0][1], 1) for i in range(1000)]
    rows += [(10_000 + i, v, 1) for i, v in enumerate(rng.normal(size=(3000, 64)).astype(np.float32).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in sign_hash.near_duplicates(table(spark, rows)).collect()}
    assert all(got[i] == (2999, 0) for i in [*range(2000), *range(5000, 6000)])
    assert all(got[10_000 + i] == (0, 10_000 + i) for i in range(3000))
    # 3000 vectors in one group would be 4.5 million pairs.
    assert dict(made)["unit-links"] < 20_000 and dict(made)["member-links"] < 20_000


def test_recall_at_the_threshold():
    """Pairs at exactly the threshold's angle share a bucket as often as promised."""
    rng = np.random.default_rng(6)
    for n in (100, 10_000, 1_000_000):
        bits, tables = sign_hash.tables_for(n)
        first = rng.normal(size=(1500, 64))
        noise = rng.normal(size=(1500, 64))
        first /= np.linalg.norm(first, axis=1, keepdims=True)
        noise -= (noise * first).sum(axis=1, keepdims=True) * first
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        second = 0.93 * first + math.sqrt(1 - 0.93**2) * noise
        signs = sign_hash.Signs(bits, tables)
        assert (signs(first) == signs(second)).any(axis=1).mean() > 0.985


def test_other_thresholds_and_double_vectors(spark):
    rows = cloud([8, 20], n=20, length=16)
    double = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    same(sign_hash.near_duplicates(double, cosine=0.8, recall=0.99999).collect(), plain(rows, 0.8))
    with pytest.raises(ValueError):
        sign_hash.near_duplicates(double, cosine=0.0)
