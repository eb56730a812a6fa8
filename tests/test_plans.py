"""Shape of the physical plans, and the streaming forms against their batch twins."""

import re

from pyspark.sql import functions as F

from pagegauge.operators import structure, timelines
from pagegauge.plans import grading
from workload.inputs import Tables
from workload.q_streams import collect_alerts, progress_of


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_cross_the_network_once(spark, sf_dir):
    text = plan(structure.page_documents(Tables(spark, sf_dir).captures()))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "Exchange SinglePartition" not in text


def test_only_trees_of_bucketed_captures_are_shuffled(spark, sf_dir):
    captures = Tables(spark, sf_dir).captures().withColumn("rendered_html", F.col("raw_html"))
    captures.write.bucketBy(4, "page_id").mode("overwrite").saveAsTable("bucketed_captures")
    try:
        text = plan(structure.page_documents(spark.table("bucketed_captures"), partitioned=True))
        assert len(re.findall(r"Exchange", text)) == 1
        assert not re.search(r"Exchange.*\n[^\n]*html#\d+, (?:raw|rendered)_html", text)
    finally:
        spark.sql("drop table bucketed_captures")


def test_sorts_of_the_grading_plan(spark, sf_dir):
    """Two orders (text position, shared keys) and the page; no sort compares text of the page."""
    text = plan(structure.page_documents(Tables(spark, sf_dir).captures()))
    sorts = re.findall(r"Sort \[([^\]]*)\]", text)
    assert len(sorts) <= 3
    assert not any(re.search(r"\b(txt|tok|node|core)#", s) for s in sorts)


def test_no_pair_joins(spark, sf_dir):
    t = Tables(spark, sf_dir)
    text = plan(grading.graded_pages(t.captures(), t.site_files()))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_only_needed_columns_are_read(spark, sf_dir):
    t = Tables(spark, sf_dir)
    text = plan(grading.signal_features(t.captures(), t.site_files()))
    assert not re.search(r"ReadSchema: struct<[^>]*html", text)


def test_tokens_lose_nothing(spark, sf_dir):
    captures = Tables(spark, sf_dir).captures()
    sizes = structure.tokens(captures).groupBy("page_id").agg(F.concat_ws("", F.array_sort(F.collect_list(F.struct("pos", "tok")))["tok"]).alias("back"))
    joined = sizes.join(captures.select("page_id", "rendered_html"), "page_id")
    assert joined.where("back != rendered_html").count() == 0 and joined.count() == captures.count()


def test_stalls_on_a_stream_equal_the_batch(spark, sf_dir):
    from pagegauge.streaming import deadlines

    t = Tables(spark, sf_dir)
    streamed = {(r["job_id"], r["value"], r["since_us"]) for r in collect_alerts(t, deadlines.stalled).collect()}
    progress = progress_of(t.jobs())
    clock = t.jobs().agg((F.max("created_at") + F.expr("interval 50 minutes"))).scalar()
    batch = timelines.stalls(progress, F.date_trunc("millisecond", clock))
    assert streamed == {(r["job_id"], r["value"], r["us"]) for r in batch.select("job_id", "value", F.unix_micros("since").alias("us")).collect()}


def test_overruns_on_a_stream_equal_the_batch(spark, sf_dir):
    from pagegauge.streaming import deadlines

    t = Tables(spark, sf_dir)
    streamed = {r["job_id"] for r in collect_alerts(t, deadlines.overrun).collect()}
    progress = progress_of(t.jobs())
    jobs = progress.groupBy("job_id").agg(F.min("at").alias("started_at"), F.max(F.when(F.col("done"), F.col("at"))).alias("completed_at"))
    clock = t.jobs().agg((F.max("created_at") + F.expr("interval 50 minutes"))).scalar()
    assert streamed == {r["job_id"] for r in timelines.overruns(jobs, clock).collect()}


def test_a_partition_of_pages_does_not_grow_with_the_table(spark, monkeypatch):
    """The sorts over tokens of a partition take many times its html, so more pages make more partitions, not larger ones."""
    monkeypatch.setattr(structure, "PARTITION_PAGES", 50)
    html = F.concat(F.lit("<html><title>t</title><p>page "), F.col("page_id").cast("string"), F.lit("</p></html>"))
    for pages in (1000, 3000):
        captures = spark.range(pages).select(F.col("id").alias("page_id"), html.alias("raw_html"), html.alias("rendered_html"))
        done = structure.page_documents(captures).select("page_id", "els").groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), F.min(F.size("els")).alias("els"))
        rows = done.collect()
        assert sum(r["n"] for r in rows) == pages and all(r["els"] >= 2 for r in rows)
        assert max(r["n"] for r in rows) <= 2 * 50


def test_pages_are_dealt_by_number_however_many_cores_there_are(spark, monkeypatch):
    """With fewer parts than cores, pages were put together by their bytes, all of a small table in one task."""
    monkeypatch.setattr(structure, "PARTITION_PAGES", 100)
    html = F.concat(F.lit("<p>page "), F.col("page_id").cast("string"), F.lit("</p>"))
    captures = spark.range(spark.sparkContext.defaultParallelism * 90).select(F.col("id").alias("page_id"), html.alias("raw_html"), html.alias("rendered_html"))
    rows = structure.page_documents(captures).groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) == captures.count() and max(r["n"] for r in rows) <= 2 * 100


def test_a_task_that_works_out_trees_does_not_hold_a_whole_scan(spark, monkeypatch):
    """The shuffle behind the trees keeps its task's pages in memory above 200 parts, so what one task scans is dealt out before."""
    monkeypatch.setattr(structure, "PARTITION_PAGES", 20)
    pages = spark.range(0, 6000, 1, 1).select(F.col("id").alias("page_id"), F.lit("<p>x</p>").alias("html"))
    rows = structure._clustered(pages, {"task": F.spark_partition_id()}, False).groupBy("task").agg(F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in rows) == 6000 and max(r["n"] for r in rows) <= 3 * 6000 // 200


def test_dimensions_share_their_stages(spark, sf_dir):
    """A stage copies the texts of its page, so all dimensions take as many as the longest of them, not the sum."""
    captures = Tables(spark, sf_dir).captures()
    stages = lambda *prefixes: grading.page_features(captures, *prefixes)._jdf.queryExecution().analyzed().toString().count("Project [")
    assert stages() == max(stages(d.prefix) for d in grading.PAGE_DIMENSIONS)
