"""Runs against a search of every period, word by word and all at once."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from pagegauge.llm import periodic_runs
from pagegauge.llm.periodic_runs import Catchers, runs_of
from tests.llm.conftest import documents


def plain_runs(words, least_length=6, least_periods=4):
    out, n = [], len(words)
    for q in range(1, n):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            run, length = words[i : j + q], j - i + q
            if length >= max(least_length, least_periods * q) and not any(run[p:] == run[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    size, n = rng.choice([1, 2, 3, 5]), rng.randint(0, 120)
    words = [rng.randrange(size) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 4 else 0):
        a, p = rng.randrange(n), rng.randint(1, 12)
        for i in range(a + p, min(n, a + rng.randint(1, 7 * p))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("limits", [(6, 4), (1, 4), (6, 2), (5, 3), (10, 2)])
def test_runs_against_every_period(limits):
    rng = random.Random(str(limits))
    for _ in range(300):
        words = repetitive(rng)
        want = plain_runs(words, *limits)
        assert runs_of([words, words[::-1], [], words], *limits) == [want, plain_runs(words[::-1], *limits), [], want]
        online, at = Catchers(*limits), 0
        while at < len(words):
            step = rng.choice([1, 1, 1, 2, 5, 20])
            online.append(np.array(words[at : at + step]))
            at += step
        assert not words or online.runs() == want


def test_a_run_is_known_as_soon_as_it_is_long_enough():
    online = Catchers()
    seen = []
    for word in [7, 8, 9] * 5 + [1]:
        online.append(np.array([word]))
        seen.append(online.runs())
    assert seen[10] == [] and seen[11] == [(0, 12, 3)] and seen[14] == seen[15] == [(0, 15, 3)]


def test_long_texts_take_linear_time():
    start = time.time()
    assert runs_of([[1] * 400_000, ([1] * 6 + [2]) * 20_000, list(range(20_000)) * 5])[0] == [(0, 400_000, 1)]
    assert time.time() - start < 30


def test_limits_without_three_blocks_are_refused():
    with pytest.raises(ValueError):
        Catchers(1, 2)


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_documents_with_tails_and_edge_cases(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{w}" for w in repetitive(rng)), "a") for i in range(150)]
    rows += [(150, None, None), (151, "", "a"), (152, " \x0b\n\t ", "a"), (None, "x " * 9, "b"), (7, "ü ü ü ü ü ü", "b"), (7, "ü ü ü ü ü ü", "b")]
    got = periodic_runs.periodic_runs(documents(spark, rows), tail=True)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(expected(i, t)) for i, t, _ in rows)
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0


def test_streams_are_cut_between_texts(spark, monkeypatch):
    rows = [(i, "a b " * 20 + str(i), "a") for i in range(40)]
    whole = periodic_runs.periodic_runs(documents(spark, rows)).collect()
    monkeypatch.setattr(periodic_runs, "_STREAM", 50)
    assert sorted(whole) == sorted(periodic_runs.periodic_runs(documents(spark, rows)).collect())
    assert {tuple(r)[1:6] for r in whole} == {(1, 0, 40, 2, 20000)}


def test_given_documents(spark, small):
    rows = small("documents").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in rows if len((r.text or "").split()) <= 300}
    got = {r.doc_id: tuple(r) for r in periodic_runs.periodic_runs(small("documents"), tail=True).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == expected(i, t) for i, t in short.items())
