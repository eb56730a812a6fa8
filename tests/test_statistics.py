"""Day partials: what is read, what is merged, and equal results to grading everything at once."""

from pyspark.sql import functions as F

from pagegauge.plans import grading, reports, statistics
from pagegauge.session import shared_dir
from workload.inputs import Tables


def test_facts_are_what_graded_pages_say(spark, sf_dir):
    t = Tables(spark, sf_dir)
    facts = {r["page_id"]: r for r in statistics.page_facts(t.captures(), t.site_files()).collect()}
    graded = reports.with_findings(grading.graded_pages(t.captures(), t.site_files())).collect()
    assert len(facts) == len(graded)
    for row in graded:
        fact = facts[row["page_id"]]
        assert (fact["overall_score"], fact["grade"], fact["origin"]) == (row["overall_score"], row["grade"], row["origin"])
        assert [tuple(f) for f in fact["findings"]] == [(f["dimension"], f["id"], f["severity"]) for f in row["findings"]]


SCHEMA = "page_id bigint, origin string, created_date date, overall_score int, grade string, findings array<struct<dimension:string,id:string,severity:string>>"


def pages(spark, first, n, day):
    import datetime

    rows = [
        (i, f"o{i % 3}", datetime.date(2024, 1, day), i % 101, "ABCDF"[i % 5], [("d", f"R{k}", "low") for k in range(i % 4)])
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_only_changed_days_are_worked_out(spark):
    facts, partials = shared_dir(spark, "facts"), shared_dir(spark, "partials")

    def check(all_pages):
        want = all_pages.select(F.inline("findings")).groupBy("dimension", "id", "severity").agg(F.count("*").alias("pages"))
        assert sorted(statistics.finding_frequency(spark, partials).collect()) == sorted(want.collect())
        got = {(r["origin"], r["is_total"]): (r["pages"], r["mean_score"], r["grade_a"]) for r in statistics.score_summary(spark, partials).collect()}
        mean = all_pages.rollup("origin").agg(F.count("*").alias("n"), F.avg("overall_score").alias("m"), F.count_if(F.col("grade") == "A").alias("a")).collect()
        assert got == {(r["origin"], int(r["origin"] is None)): (r["n"], r["m"], r["a"]) for r in mean}

    first = pages(spark, 0, 60, 1).unionByName(pages(spark, 60, 50, 2))
    statistics.write_facts(first, facts)
    assert [d.day for d in statistics.update(spark, facts, partials)] == [1, 2]
    check(first)
    assert statistics.update(spark, facts, partials) == []
    # A new day, and late rows of an old one.
    more = pages(spark, 200, 30, 3).unionByName(pages(spark, 300, 5, 1))
    statistics.write_facts(more, facts)
    assert [d.day for d in statistics.update(spark, facts, partials)] == [1, 3]
    check(first.unionByName(more))
    assert sum(r["pages"] for r in statistics.score_summary(spark, partials, since="2024-01-02").where("is_total = 1").collect()) == 80


def test_reading_parses_no_page_and_few_columns(spark, sf_dir):
    facts, partials = shared_dir(spark, "facts"), shared_dir(spark, "partials")
    t = Tables(spark, sf_dir)
    statistics.write_facts(statistics.page_facts(t.captures(), t.site_files()), facts)
    statistics.update(spark, facts, partials)
    for df in (statistics.finding_frequency(spark, partials), statistics.score_summary(spark, partials)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "html" not in plan and "facts" not in plan and "Python" not in plan
