"""The pipeline's stages, each on its own input, against plain Python."""

import collections
import re

import pytest

import corpus_pipeline
from pagegauge.llm import decontaminate, quality
from tests.llm.test_line_dedup import brute_force
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import classes, plain_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents before the first and after each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights"]
    assert all(t.columns == tables[0].columns for t in tables[:-1]) and corpus_pipeline.ORACLE_SQL is None


def test_quality_keeps_what_scores(spark, tables):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    predicted = {r.doc_id for r in quality.scores(tables[0], labels).collect() if r.predicted}
    assert set(rows(tables[1])) == predicted
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert good <= predicted


def test_lines(tables):
    before, after = rows(tables[1]), rows(tables[2])
    ids = sorted(before)
    short = [(i, before[i].text) for i in ids if before[i].text.count("\n") < 40]
    assert len(short) == len(ids) or len(short) > 50
    if len(short) == len(ids):
        assert [after[i].text for i in ids] == brute_force(short, 8)
    assert set(after) == set(before) and all(after[i].n_chars == len(after[i].text) for i in ids)


def test_near_duplicates(tables):
    before, after = rows(tables[2]), rows(tables[3])
    ids = sorted(before)
    root = classes([plain_fingerprint(before[i].text) for i in ids], 2)
    assert set(after) == {ids[i] for i in root}


def test_leaks(spark, tables):
    before, after = rows(tables[3]), rows(tables[4])
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verbatim = {i for i, r in before.items() if any(x in r.text for x in items)}
    assert not verbatim & set(after)
    flagged = {r.doc_id for r in decontaminate.leaks(tables[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(before) - set(after) == flagged


def test_mixture(tables):
    before, out = rows(tables[4]), tables[5].collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = collections.Counter(), collections.Counter()
    for r in before.values():
        sizes[r.source] += count(r.text)
    for r in out:
        taken[r.source] += count(r.text)
    want = plain_targets(sorted(sizes.items()))
    assert all(abs(taken[s] - want[s]) <= 0.15 * want[s] + 20 for s in want)
    assert max(collections.Counter(r.doc_id for r in out).values()) <= 3


def test_run(spark, tables):
    got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect())
    assert got == collections.Counter(r.doc_id for r in tables[5].select("doc_id").collect())
