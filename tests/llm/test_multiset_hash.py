import hashlib
import itertools
import re
import time

import xxhash
from pyspark.sql import functions as F

from pagegauge.llm import multiset_hash
from tests.llm.conftest import documents


def edited(rows):
    """doc_id, text, edited text in the order of ids, null last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    texts = [t or "" for _, t in rows]
    out = []
    for i, (d, _) in enumerate(rows):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        out.append((d, text, text[: len(text) - cut] + following[:cut]))
    return out


def test_small_table(spark, small):
    docs = small("documents")
    want = {d: (len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e in edited([(r.doc_id, r.text) for r in docs.collect()])}
    for rows_per_range in (20_000, 7):
        got = multiset_hash.edit_report(docs, rows_per_range).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want and len(got) == len(want)
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_text = {}
    for r in got:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(f) == 1 for f in by_text.values()) and len({f for fs in by_text.values() for f in fs}) == len(by_text)
    assert sum(r.near_edited for r in got) / len(got) > 0.6 > 0.2 > sum(r.near_next for r in got) / len(got)
    # The edited fingerprint is that of the edited text.
    texts = spark.createDataFrame([(d, e) for d, _, e in edited(list(texts.items()))], "doc_id bigint, text string")
    direct = {r.doc_id: r.fingerprint for r in multiset_hash.fingerprints(texts, "doc_id", "text").collect()}
    assert direct == {r.doc_id: r.edited_fingerprint for r in got}


def test_order_insertion_deletion(spark):
    texts = {"ab": "one. two\nthree, four", "ba": "three, four\none. two", "a": "one. two", "b": "three, four", "aab": "one. two\none. two\nthree, four", "none": ""}
    frame = spark.createDataFrame(list(texts.items()), "k string, t string")
    fp = {r.k: r.fingerprint for r in multiset_hash.fingerprints(frame, "k", "t").collect()}
    assert fp["ab"] == fp["ba"] and len({fp["ab"], fp["a"], fp["b"], fp["aab"], fp["none"]}) == 5
    row = spark.createDataFrame([(fp["a"], fp["b"], fp["ab"], fp["aab"])], "a string, b string, ab string, aab string")
    sums = row.select(
        multiset_hash.add(F.col("a"), F.col("b")), multiset_hash.take(F.col("ab"), F.col("a")), multiset_hash.take(F.col("aab"), F.col("ab"))
    ).first()
    assert tuple(sums) == (fp["ab"], fp["b"], fp["a"])


def test_edges(spark, edge_rows):
    docs = documents(spark, edge_rows)
    got = multiset_hash.edit_report(docs, 3).collect()
    assert len(got) == len(edge_rows)
    known = [(d, t) for d, t, _ in edge_rows if d is not None]
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d, text, new in edited(known):
        if d not in (6, 10):  # repeated, and the last before the rows without id
            assert by[d][0].n_chars == len(text) and by[d][0].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
    assert by[1][0].fingerprint == by[2][0].fingerprint and by[1][0].near_next == 1.0 and by[3][0].fingerprint == by[4][0].fingerprint
    assert by[3][0].near_edited == 1.0 and len(by[6]) == 2 and len(by[None]) == 2
    assert multiset_hash.edit_report(docs.limit(0)).count() == 0
    one = multiset_hash.edit_report(documents(spark, [(5, "abcdefgh", "s")])).collect()
    assert [r.edited_sha256 for r in one] == [hashlib.sha256(b"abcdefab").hexdigest()]


def test_no_python_on_executors(spark, small):
    plan = multiset_hash.edit_report(small("documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # The text crosses the network once.
    assert plan.count("Exchange hashpartitioning") == 1


def plain_fingerprint(text):
    """The lanes in whole numbers, paragraph by paragraph."""
    low, lanes, count, sketch = 0xFFFFFFFF, [0] * 16, 0, [0] * 64
    unspaced = re.compile("[\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
    mark = lambda w: w + "\x01" if xxhash.xxh64_intdigest(w.encode(), 42) % 8 == 0 else w
    for paragraph in text.split("\n"):
        digest = hashlib.sha256(paragraph.encode()).hexdigest().encode()
        for j in range(8):
            h = xxhash.xxh64_intdigest(digest, xxhash.xxh64_intdigest(j.to_bytes(4, "little"), 42))
            lanes[2 * j], lanes[2 * j + 1] = lanes[2 * j] + (h >> 32), lanes[2 * j + 1] + (h & low)
        if unspaced.search(paragraph):
            paragraph = "".join(mark(c) if unspaced.match(c) else c for c in paragraph)
        else:
            paragraph = re.sub("([^ ]{64})", "\\1\x01", paragraph)
        for clause in " ".join(map(mark, paragraph.split(" "))).split("\x01"):
            clause = clause.strip(" ")
            if clause:
                count += 1
                h = xxhash.xxh64_intdigest(clause.encode(), 42)
                for j in range(64):
                    sketch[j] += h >> j & 1
    tail = "".join(f"{sketch[j + 32] & 0xFFFF:04x}{sketch[j] & 0xFFFF:04x}" for j in range(32))
    return "".join(f"{x & low:08x}" for x in lanes) + f"{count & low:08x}" + tail, [2 * s - count for s in sketch]


def plain_likeness(a, b):
    (fp, x), (other, y) = a, b
    norm = (sum(i * i for i in x) * sum(i * i for i in y)) ** 0.5
    return 1.0 if fp == other else max(0.0, min(1.0, sum(i * j for i, j in zip(x, y)) / norm)) if norm else 0.0


def test_fingerprints_and_likeness_against_whole_numbers(spark):
    rows = [
        (1, "one. two, three\nfour five six", "a"), (2, " ".join(f"word{i}" for i in range(300)), "a"), (3, "漢字かな交じり文。もう一つの文、終わり", "a"),
        (4, "x" * 300 + " " * 50 + "tail", "a"), (5, "", "a"), (6, "...,,;\n\n\t", "a"), (7, "one. two, three\nfour five six", "a"), (8, "ไทยภาษา abc é ü", "b"),
    ]
    got = {r.doc_id: r for r in multiset_hash.edit_report(documents(spark, rows)).collect()}
    for (d, text, new), (_, following, _) in zip(edited([(d, t) for d, t, _ in rows]), [*rows[1:], rows[0]]):
        own, after, beside = plain_fingerprint(text), plain_fingerprint(new), plain_fingerprint(following)
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (own[0], after[0])
        assert abs(got[d].near_edited - plain_likeness(own, after)) < 1e-9 and abs(got[d].near_next - plain_likeness(own, beside)) < 1e-9


def test_lanes_do_not_follow_from_each_other(spark):
    """Texts that agree in one pair of lanes are no likelier to agree in another."""
    frame = spark.range(20_000).select("id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("t"))
    fps = [r.fingerprint for r in multiset_hash.fingerprints(frame, "id", "t").collect()]
    lanes = [[int(f[8 * j : 8 * j + 8], 16) for f in fps] for j in range(16)]
    for a, b in itertools.combinations(range(16), 2):
        same = sum((x ^ y) & 255 == 0 for x, y in zip(lanes[a], lanes[b]))
        assert 20 < same < 160
    # Equal low bits in one lane, and how often those in the next are equal too.
    first = {}
    pairs = equal = 0
    for x, y in zip(lanes[0], lanes[2]):
        for z in first.get(x & 4095, []):
            pairs, equal = pairs + 1, equal + (z == y & 4095)
        first.setdefault(x & 4095, []).append(y & 4095)
    assert pairs > 10_000 and equal < pairs / 500


def test_texts_without_marks_and_texts_of_spaces(spark):
    words = [f"word{i}x{i * 7919 % 101}" for i in range(400)]
    texts = [" ".join(words), "".join(chr(0x4E00 + i * 37 % 5000) for i in range(2000)), "".join(chr(33 + i * i % 90) for i in range(4000)).replace("\n", "")]
    rows = [(2 * i, t, "a") for i, t in enumerate(texts)] + [(2 * i + 1, "beside " * 9, "a") for i in range(3)]
    got = {r.doc_id: r.near_edited for r in multiset_hash.edit_report(documents(spark, rows)).collect()}
    assert got[0] >= 0.6 and got[2] >= 0.6
    start = time.time()
    assert multiset_hash.fingerprints(documents(spark, [(1, " " * 1_000_000, "a"), (2, " ." * 200_000, "a")]), "doc_id", "text").count() == 2
    multiset_hash.fingerprints(documents(spark, [(1, " " * 1_000_000 + "x", "a")]), "doc_id", "text").collect()
    assert time.time() - start < 10


def test_the_plan_does_not_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(multiset_hash, "MOST_RANGES", 16)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert len(multiset_hash._ranges(docs.select(F.col("doc_id").alias("key")), 1)) <= 16
    assert multiset_hash.edit_report(docs, 1).count() == 2000
