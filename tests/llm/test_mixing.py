import collections
import re

import pytest

from pagegauge.llm import mixing
from tests.llm.conftest import documents


def plain_targets(sizes):
    """(source, size) pairs in order of source, null last."""
    weights = {s: i % 3 + 1 for i, (s, _) in enumerate(sizes)}
    left, total, out = dict(sizes), sum(n for _, n in sizes), {}
    while left:
        level = total / sum(weights[s] for s in left)
        full = [s for s, n in left.items() if 3 * n < level * weights[s]]
        if not full:
            return out | {s: level * weights[s] for s in left}
        for s in full:
            out[s] = 3.0 * left.pop(s)
            total -= out[s]
    return out


def test_small_table(spark, small):
    docs = small("documents")
    rows = mixing.mix(docs).collect()
    words = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()}
    assert {r.doc_id: r.size for r in rows} == {d: n for d, (_, n) in words.items()}
    by, taken = collections.Counter(), collections.Counter()
    for r in rows:
        by[words[r.doc_id][0]] += r.size
        taken[words[r.doc_id][0]] += r.taken
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
    want = plain_targets(sorted(by.items()))
    for r in rows:
        source = words[r.doc_id][0]
        assert r.source_size == by[source] and r.target == pytest.approx(want[source])
    assert all(abs(taken[s] - want[s]) <= 0.1 * want[s] for s in want)
    again = {r.doc_id: r.copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in rows}


def test_rates_are_exponential_tilts(spark):
    """Without rounding: rates are min(3, exp(lam * size)) and meet the target."""
    docs = documents(spark, [(i, "w " * (i % 40 + 1), "ab"[i % 5 == 0]) for i in range(400)])
    rows = mixing.sized(docs)
    sources = rows.groupBy("source").agg({"size": "sum", "*": "count"}).toDF("source", "a", "b").selectExpr("source", "greatest(a, b) source_size", "least(a, b) n_docs")
    goals = mixing.targets(sources).persist()
    sids = {r.source: r for r in goals.collect()}
    classes = rows.join(goals, "source").groupBy("sid", "size", "source_size", "n_docs").count().selectExpr("sid", "size", "count n", "size / (source_size / n_docs) x")
    lam = {r.sid: r for r in mixing.tilts(classes, goals).collect()}
    import math

    for r in sids.values():
        if not lam[r.sid].full:
            got = sum(c.n * c["size"] * min(3, math.exp(lam[r.sid].lam * c.x)) for c in classes.where(f"sid = {r.sid}").collect())
            assert got == pytest.approx(r.target, rel=1e-5)


def test_edges(spark, edge_rows):
    docs = documents(spark, edge_rows)
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(edge_rows) and all(r.taken <= 3 * r.size for r in rows)
    assert [r["size"] for r in rows if r.doc_id in (3, 4, 5)] == [0, 0, 0]
    mixed = mixing.mixture(docs)
    assert mixed.columns == [*docs.columns, "mix_target", "mix_copies", "mix_copy"]
    assert mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0
    nothing = mixing.mix(documents(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0), (0.0, 0)]


def test_hot_size(spark):
    """A source whose documents all have one size: whole copies come as near as they can."""
    docs = documents(spark, [(i, "a b c", "hot") for i in range(2000)] + [(9000 + i, "x " * (i + 1), "cold") for i in range(20)])
    rows = mixing.mix(docs).collect()
    hot = [r for r in rows if r.source_size == 6000]
    assert len(hot) == 2000 and abs(sum(r.taken for r in hot) - hot[0].target) <= 3
