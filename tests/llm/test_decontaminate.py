import random

import numpy as np

from pagegauge.llm import decontaminate
from tests.llm.conftest import documents


def plain_alignment(a, b):
    """Smith-Waterman over all cells: the best score."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            step = decontaminate.MATCH if x == y else decontaminate.MISMATCH
            table[i + 1][j + 1] = max(0, table[i][j] + step, table[i][j + 1] + decontaminate.GAP, table[i + 1][j] + decontaminate.GAP)
    return max(max(r) for r in table)


def test_alignment_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(1, 15))
        assert decontaminate.align(a, b)[0] == plain_alignment(a, b)


def test_given_tables(spark, small):
    """Every item that stands in a document word for word is found; what is found aligns as well as all cells say."""
    docs, bench = small("documents"), small("benchmark")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    words = {d: decontaminate.passage_words(t) for d, t in texts.items()}
    want = {}
    for i, t in items.items():
        b = decontaminate.passage_words(t)
        for d in texts:
            score = plain_alignment(words[d], b) / (2 * len(b)) if len(set(b) & set(words[d])) > len(set(b)) // 3 else 0
            if score >= 0.5:
                want[d, i] = score
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, bench).collect()}
    assert {k: round(r.score, 9) for k, r in got.items()} == {k: round(v, 9) for k, v in want.items()} and want
    for (d, i), r in got.items():
        assert set(words[d][r.start_word : r.end_word]) & set(decontaminate.passage_words(items[i]))
    assert set(got) >= {(d, i) for d, t in texts.items() for i, x in items.items() if x in t}


def edit(words, rng, every):
    out = []
    for n, w in enumerate(words, 1):
        if n % every:
            out.append(w)
        else:
            out += rng.choice([[], ["other"], [w, "more"]])
    return out


def test_edited_copies_and_clean_texts(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 400
    items = [(i, " ".join(rng.sample(words, 40))) for i in range(20)]
    rows = []
    for i, (item, text) in enumerate(items):
        noise = lambda n: " ".join(rng.choices(words, k=n))
        rows.append((item, f"{noise(200)} {' '.join(edit(text.split(), rng, 5)).upper()} {noise(300)}", "s"))
        rows.append((100 + i, noise(500), "s"))
        rows.append((200 + i, noise(100) + " " + " ".join(text.split()[:8]) + " " + noise(100), "s"))
    bench = spark.createDataFrame([(*x, "q") for x in items], "item_id bigint, text string, h string")
    docs = documents(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(i, i) for i, _ in items}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, _ in rows if d >= 100}


def test_frequent_passage_is_found(spark):
    """A passage that a third of the documents share makes its own n-grams frequent, not its words common."""
    passage = " ".join(f"q{i}" for i in range(40))
    rows = [(i, f"lead {i} " + (passage if i % 3 == 0 else " ".join(f"z{i}_{j}" for j in range(60))), "s") for i in range(90)]
    bench = spark.createDataFrame([(1, passage), (2, passage)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.score) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert got == {(i, item, 1.0) for i in range(0, 90, 3) for item in (1, 2)}


def test_edges(spark, edge_rows):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (None, "alpha beta gamma delta"), (4, "beta gamma delta epsilon zeta eta"), (4, "beta gamma delta epsilon zeta eta")], "item_id bigint, text string")
    docs = documents(spark, edge_rows)
    got = decontaminate.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.score, r.start_word, r.end_word) for r in got) == [(1, 4, 1.0, 1, 7), (2, 4, 1.0, 1, 7)]
    assert decontaminate.clean(docs, bench).count() == len(edge_rows) - 2
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    bench = spark.createDataFrame([
        (1, "One day, sun"), (2, "two words"), (3, "single"), (4, "第一次世界大战爆发于一九一四年。"), (5, "กรุงเทพมหานครเป็นเมืองหลวง"), (6, "four plain short words"),
        (7, "大战"), (8, "日本語の文です"),
    ], "item_id bigint, text string")
    rows = [
        (1, "there was one day SUN and one day sun again", "s"), (2, "one day the sun, single", "s"), (3, "in two words: done", "s"),
        (4, "文章开头，第一次世界大战爆发于一九一四年，后来结束。", "s"), (5, "x กรุงเทพมหานครเป็นเมืองหลวง y", "s"), (6, "say four plain short words now", "s"), (7, "one one day sun", "s"),
        (8, "これは日本語の文でした", "s"),
    ]
    got = sorted((r.doc_id, r.item_id, r.start_word, r.end_word) for r in decontaminate.leaks(documents(spark, rows), bench).collect() if r.score == 1.0)
    assert got == [(1, 1, 2, 5), (3, 2, 1, 3), (4, 4, 4, 19), (4, 7, 9, 11), (5, 5, 1, 27), (6, 6, 1, 5), (7, 1, 1, 4)]
    near = {(r.doc_id, r.item_id): r.score for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert near[8, 8] == 6 / 7


def test_edited_copies_of_frequent_words(spark):
    """Items of words that every document holds: copies with a fifth of the words changed are found."""
    rng = random.Random(9)
    words = [f"common{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=45))) for i in range(10)]
    noise = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(i, f"{noise(300)} {' '.join(edit(t.split(), rng, 5))} {noise(300)}", "s") for i, t in items] + [(100 + i, noise(800), "s") for i in range(30)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    want = set()
    for d, t, _ in rows:
        for i, x in items:
            a, b = decontaminate.passage_words(t), decontaminate.passage_words(x)
            if plain_alignment(a, b) / (2 * len(b)) >= 0.5:
                want.add((d, i))
    assert want >= {(i, i) for i in range(10)} and len(got & want) >= 0.95 * len(want) and got <= want
