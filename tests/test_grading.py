"""Whole pages with known verdicts."""

import datetime

import pytest

import pages as P
from pagegauge.plans import grading, reports
from pagegauge.plans.dimensions import REGISTRY

PERF = "struct<ttfb:double,page_size:bigint,num_requests:int,dom_content_loaded:double,network_idle:double>"


def frames(spark, cases=P.CASES):
    stamp = datetime.datetime(2024, 2, 1)
    captures = spark.createDataFrame(
        [(i, c[1], c[1], c[2], c[3], c[7], stamp) for i, c in enumerate(cases)],
        f"page_id bigint, url string, final_url string, raw_html string, rendered_html string, perf {PERF}, captured_at timestamp",
    )
    files = []
    for c in cases:
        origin = "/".join(c[1].split("/")[:3])
        files += [(origin, kind, body) for kind, body in zip(("robots", "llms", "sitemap"), c[4:7])]
    return captures, spark.createDataFrame(files, "origin string, kind string, body string")


@pytest.fixture(scope="module")
def verdicts(spark):
    captures, files = frames(spark)
    rows = grading.graded_pages(captures, files).collect()
    return {P.CASES[r["page_id"]][0]: r for r in rows}


def scores(row):
    return {d.prefix: row[d.score] for d in REGISTRY}


def ids(row, prefix):
    return [f["id"] for f in row[f"{prefix}_findings"]]


def test_page_that_meets_the_rules(verdicts):
    row = verdicts["timetable"]
    assert scores(row) == {"mr": 100, "sd": 100, "as": 100, "ac": 98, "pf": 100, "cc": 93}
    assert all(ids(row, p) == [] for p in scores(row))
    assert (row["overall_score"], row["grade"]) == (99, "A")


def test_page_of_containers(verdicts):
    row = verdicts["panel"]
    got = scores(row)
    assert got["mr"] < 40 and got["sd"] < 20 and got["ac"] < 35 and got["pf"] < 25 and row["grade"] == "F"
    assert ids(row, "mr") == ["MR_NO_SEMANTIC_TAGS", "MR_CLICKABLE_DIVS", "MR_MISSING_H1", "MR_NO_LANDMARKS", "MR_CONTENT_IN_IFRAME"]
    assert {"AC_INPUTS_MISSING_LABEL", "AC_INPUTS_MISSING_NAME", "AC_IMAGES_MISSING_ALT", "AC_NON_READABLE_URL"} <= set(ids(row, "ac"))
    assert ids(row, "as") == ["AS_ROBOTS_BLOCKS_AI", "AS_ROBOTS_NO_SITEMAP", "AS_LLMS_TXT_INVALID", "AS_NO_LLMS_FULL", "AS_INVALID_SITEMAP", "AS_NOT_HTTPS"]
    assert {f["id"]: f["severity"] for f in row["pf_findings"]} == {
        "PF_SLOW_TTFB": "high", "PF_HEAVY_PAGE": "high", "PF_TOO_MANY_REQUESTS": "medium", "PF_SLOW_DCL": "medium", "PF_SLOW_NETWORK_IDLE": "low",
    }
    assert {"CC_TITLE_MISSING", "CC_META_DESC_MISSING", "CC_H1_MISSING", "CC_THIN_CONTENT"} <= set(ids(row, "cc"))


def test_script_rendered_page(verdicts):
    row = verdicts["app"]
    high = [f for f in row["mr_findings"] if f["id"] == "MR_HIGH_JS_DEPENDENCE"]
    assert high and high[0]["evidence"].startswith("Stock by shelf | Shelf nine | Forty boxes")
    assert "MR_HEADING_SKIP" in ids(row, "mr") and "MR_MISSING_H1" not in ids(row, "mr")
    assert ids(row, "ac") == ["AC_UNSTABLE_SELECTORS", "AC_NO_SKIP_LINK", "AC_NON_READABLE_URL"]
    partial = [f for f in row["as_findings"] if f["id"] == "AS_ROBOTS_PARTIAL_AI"]
    assert partial[0]["description"] == "Barred: PerplexityBot, Bytespider."


def test_consent_layer(verdicts):
    row = verdicts["consent"]
    assert [f["severity"] for f in row["pf_findings"] if f["id"] == "PF_COOKIE_BANNER_BLOCKING"] == ["medium"]
    assert {"AS_NO_ROBOTS_TXT", "AS_NO_LLMS_TXT", "AS_NO_SITEMAP"} <= set(ids(row, "as"))
    assert ids(verdicts["timetable"], "pf") == []


def test_empty_document_is_graded(verdicts):
    row = verdicts["empty"]
    assert scores(row)["mr"] == 25 + 0 + 15 + 5 + 0 + 15
    assert "CC_TITLE_MISSING" in ids(row, "cc")


def test_slower_never_scores_better(spark):
    slow = [1.0, 1.5, 2.0, 4.0, 8.0, 30.0]
    cases = [("x", "https://x.example/", "", "", None, None, None, (200.0 * f, int(400_000 * f), int(30 * f), 1500.0 * f, 3000.0 * f)) for f in slow]
    captures, files = frames(spark, cases)
    rows = {r["page_id"]: r["pf_score"] for r in grading.graded_pages(captures, files).collect()}
    got = [rows[i] for i in range(len(slow))]
    assert got == sorted(got, reverse=True) and got[0] > got[-1]


def test_section_is_the_main_content(spark):
    captures, _ = frames(spark)
    row = grading.page_features(captures, "cc").where("page_id = 4").first()
    assert row["cc_main_source"] == "section"
    assert row["cc_main_text"] == ("words of the big section. " * 12).strip()
    assert row["cc_title"] == "Odd &  ends"


def test_text_nodes_and_nesting(spark):
    from pagegauge.operators import structure

    captures, _ = frames(spark)
    nodes = [r["node"] for r in structure.text_nodes(captures).where("page_id = 4").orderBy("pos").collect()]
    assert nodes[0] == "Odd &  ends" and "kept back" not in nodes and not any("skipped" in n for n in nodes)
    assert nodes[-4:] == ["first", "second", "slanted", "1 < 2 > 0"]
    rows = structure.elements(captures).where("page_id = 4 and tag = 'p'").orderBy("pos").collect()
    # A second p ends the first.
    assert rows[1]["close_pos"] == rows[2]["pos"]


def test_flat_findings_explode_to_the_long_form(spark):
    graded = grading.graded_pages(*frames(spark))
    long = {(r["page_id"], r["dimension"], r["ord"], r["id"]) for r in reports.findings_long(graded).collect()}
    flat = {
        (r["page_id"], f["dimension"], f["ord"], f["id"]) for r in reports.with_findings(graded).collect() for f in r["findings"]
    }
    assert long == flat and long


def test_partitioning_changes_nothing(spark):
    captures, files = frames(spark)
    pick = lambda c: sorted(map(str, grading.graded_pages(c, files).select("page_id", "overall_score", "grade").collect()))
    assert pick(captures.repartition(1)) == pick(captures.repartition(7))


def test_reports_validate(spark):
    from pagegauge.sources import reports as store

    checked = store.validate_reports(store.stored_form(reports.build_reports(*frames(spark))))
    assert checked.where("size(violations) > 0").count() == 0
    good, bad = store.quarantine(checked.selectExpr("* except (violations)", "array('grade') as violations"))
    assert good.count() == 0 and bad.count() == len(P.CASES)
    with pytest.raises(Exception, match="drifted"):
        store.strict(bad).select("id").collect()


def test_sub_scores_add_up(verdicts):
    for row in verdicts.values():
        for d in REGISTRY:
            assert row[d.score] == max(0, min(100, sum(row[d.metrics].asDict().values()))), (d.name, row[d.metrics])


def test_views(spark, tmp_path):
    from pagegauge.views import create_views

    captures, files = frames(spark)
    captures.write.parquet(str(tmp_path / "captures"))
    files.write.parquet(str(tmp_path / "site_files"))
    create_views(spark, str(tmp_path))
    count = lambda table: spark.sql(f"select count(*) from {table}").first()[0]
    assert count("reports") == count("jobs") == len(P.CASES)
    assert spark.sql("select count(distinct job_id) from jobs join reports using (job_id)").first()[0] == len(P.CASES)
    assert count("tokens") > count("elements") > 0 and spark.sql("select count(*) from findings where id = 'CC_H1_MISSING'").first()[0] > 0
