import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagegauge.llm import quality
from tests.llm.conftest import documents


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_accuracy(spark):
    """Labels of held-out documents, which training never saw, against the prediction."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    test = [(truth[r.doc_id], r.predicted, r.score) for r in rows if r.held_out and r.doc_id in truth]
    assert len(test) > 500 and sum(t == p for t, p, _ in test) / len(test) >= 0.98
    good, bad = ([s for t, _, s in test if t == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    # Clean documents stay.
    assert sum(p for t, p, _ in test if t == 1) == len(good)


def test_held_out_labels_do_not_matter(spark, small):
    docs, labels = small("documents"), small("labels")
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in quality.scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in quality.scores(docs, flipped).collect()}
    # Nor does it matter that they are there.
    c = {r.doc_id: r.score for r in quality.scores(docs, labels.where(~quality.held_out(F.col("doc_id")))).collect()}
    assert a == b == c


def test_counts_are_the_whole_training_set(spark, small):
    docs, labels = small("documents"), small("labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    cells = dict(zip(texts, quality.cells(pd.Series(texts.values())), strict=True))
    want = {}
    for d in texts:
        side = False if d not in truth or held(d) else True if truth[d] == 1 else None
        if side is not None:
            want[cells[d], side] = want.get((cells[d], side), 0) + 1
    table = quality.counts(docs, labels).groupby(["cell", "positive"])["n"].sum()
    assert dict(table) == want


def test_risk_and_prior():
    """A known mixture: the prior is found, and cells only the unlabelled have score low."""
    rng = np.random.default_rng(2)
    rows = []
    for half in (0, 1):
        for cell, p, n in ((0, 0.9, 0.0), (1, 0.1, 0.1), (4, 0.0, 0.9)):
            rows.append((cell, half, True, int(5000 * p)))
            rows.append((cell, half, False, int(20_000 * (0.7 * p + 0.3 * n)) + int(rng.integers(0, 5))))
    table = pd.DataFrame([r for r in rows if r[3]], columns=["cell", "half", "positive", "n"])
    model = quality.fit(table)
    assert model.prior == pytest.approx(0.7, abs=0.03)
    z = {c: model.offset + sum(w[s] for w, s in zip(model.weights, quality.steps_of(np.array([c]))[0], strict=True)) for c in (0, 4)}
    assert z[0] > 1 and z[4] < -1


def test_edges(spark, edge_rows):
    docs = documents(spark, edge_rows + [(30, "JUNK!! " * 50, "s"), (31, "x$$$ y%%% " * 30, "s")])
    labels = spark.createDataFrame([(1, 1, None), (2, 1, 0), (2, 0, 0), (None, 1, 0), (6, None, 1), (77, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == len(edge_rows) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out is False for r in rows if r.doc_id is None)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.predicted for r in rows)
    none = labels.limit(0)
    assert quality.scores(docs, none).count() == len(edge_rows) + 2 and quality.scores(docs.limit(0), labels).count() == 0


def prose(rng, words, n):
    return " ".join(" ".join(rng.choice(words, 8)).capitalize() + "." for _ in range(n))


def test_junk_of_unseen_kinds(spark):
    """Boilerplate and keyword stuffing without any mark of the five shares go; prose from the same words as the trusted stays."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in ("ba", "lo", "mi", "tur", "sen") for b in ("ne", "ra", "vi", "ko") for c in ("l", "n", "st", "r")]
    spam = ["cookie", "policy", "accept", "subscribe", "newsletter", "cheap", "offer", "click", "login", "terms"]
    rows = [(i, prose(rng, words, 12), "s") for i in range(600)] + [(i, prose(rng, spam, 12), "s") for i in range(1000, 1100)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(250)], "doc_id bigint, quality int, toxic int")
    docs = documents(spark, rows)
    assert len(set(quality.cells(pd.Series([t for _, t, _ in rows])))) == 1
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == set(range(600))
    assert {r.doc_id for r in quality.scores(docs, labels).collect() if r.predicted} == kept


def test_one_side_empty_keeps_all(spark, small):
    docs, labels = small("documents"), small("labels")
    everything = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    for some in (labels.limit(0), everything):
        assert quality.keep_good(docs, some).count() == docs.count()
