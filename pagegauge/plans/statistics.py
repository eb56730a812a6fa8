"""Corpus statistics kept as one partial per day, merged when they are read.

``page_facts`` are what the statistics need of a graded page: score, grade and which rules fired, without the wording of findings.
They, or stored reports with the same columns, lie in folders by day. ``update`` works out the partials of days that are new or
have other rows than at the last call, told by row counts that Parquet footers answer; reading adds up a few rows a day.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.operators import agent_signals
from pagegauge.plans import grading
from pagegauge.plans.dimensions import REGISTRY, Dimension

DAY = "created_date"
_GRADES = [f"grade_{g.lower()}" for g in C.GRADES]


def _fired(dimension: Dimension) -> Column:
    """(dimension, id, severity) of the rules that fire, tested in one filter."""
    rules = [
        F.struct(F.lit(dimension.name).alias("dimension"), F.lit(r.id).alias("id"), F.expr(r.severity).alias("severity"), F.expr(r.when).alias("fires"))
        for r in dimension.rules
    ]
    hits = F.filter(F.array(*rules), lambda r: r["fires"])
    return F.transform(hits, lambda r: F.struct(r["dimension"].alias("dimension"), r["id"].alias("id"), r["severity"].alias("severity")))


def page_facts(captures: DataFrame, site_files: DataFrame, partitioned: bool = False) -> DataFrame:
    """(page_id, origin, created_date, overall_score, grade, findings): findings are structs (dimension, id, severity).

    Captures without a time count for the first day of 1970.
    """
    pages = grading.page_features(captures, partitioned=partitioned).withColumns({d.findings: _fired(d) for d in grading.PAGE_DIMENSIONS})
    kept = [c for d in grading.PAGE_DIMENSIONS for c in (d.score, d.findings)]
    slim = pages.select("page_id", "final_url", "captured_at", *kept)
    joined = agent_signals.features(grading.with_site(slim, captures, agent_signals.site_features(site_files)))
    scored = joined.withColumns({
        **{d.findings: _fired(d) for d in grading.SITE_DIMENSIONS}, "overall_score": grading.S.overall_score({d.name: F.col(d.score) for d in REGISTRY}),
    })
    return scored.select(
        "page_id", "origin", F.coalesce(F.to_date("captured_at"), F.to_date(F.lit("1970-01-01"))).alias(DAY), "overall_score", grading.S.grade(F.col("overall_score")).alias("grade"),
        F.concat(*[F.col(d.findings) for d in REGISTRY]).alias("findings"),
    )


def write_facts(facts: DataFrame, path: str) -> None:
    """Write facts by day; days that are there get further files."""
    facts.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def _rows_by_day(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy(DAY).agg(F.count("*").alias("rows"))


def _partials(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{table}")
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def update(spark: SparkSession, facts_path: str, path: str) -> list:
    """Bring the partials in ``path`` up to date with the facts; returns the days that were worked out.

    A day's partials are replaced as a whole, the row count last, so a call that was cut short is finished by the next one.
    """
    there = _rows_by_day(spark, facts_path)
    done = _partials(spark, path, "days")
    if done is not None:
        known = done.select(DAY, F.col("rows").alias("known"))
        there = there.join(known, DAY, "left").where("known is null or known <> rows").drop("known")
    # One row per day that changed: the calendar bounds it.
    days = sorted(row[DAY] for row in there.select(DAY).collect() if row[DAY] is not None)
    if not days:
        return []
    facts = spark.read.parquet(facts_path).where(F.col(DAY).isin(days))
    scores = facts.groupBy(DAY, "origin").agg(
        F.count("*").alias("pages"), F.sum(F.col("overall_score").cast("bigint")).alias("score_sum"),
        *[F.count_if(F.col("grade") == g).alias(c) for g, c in zip(C.GRADES, _GRADES, strict=True)],
    )
    findings = facts.select(DAY, F.inline("findings")).groupBy(DAY, "dimension", "id", "severity").agg(F.count("*").alias("pages"))
    tables = {"scores": scores, "findings": findings, "days": facts.groupBy(DAY).agg(F.count("*").alias("rows"))}
    for table, rows in tables.items():
        rows.coalesce(8).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{path}/{table}")
    return days


def finding_frequency(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Pages per rule, over all days or those from ``since`` (yyyy-MM-dd) on."""
    rows = spark.read.parquet(f"{path}/findings")
    rows = rows if since is None else rows.where(F.col(DAY) >= F.lit(since).cast("date"))
    return rows.groupBy("dimension", "id", "severity").agg(F.sum("pages").alias("pages"))


def score_summary(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Pages, mean score and pages per grade, per origin and (origin NULL, ``is_total`` 1) overall."""
    rows = spark.read.parquet(f"{path}/scores")
    rows = rows if since is None else rows.where(F.col(DAY) >= F.lit(since).cast("date"))
    sums = [F.sum(c).alias(c) for c in ("pages", "score_sum", *_GRADES)]
    merged = rows.rollup("origin").agg(*sums, F.grouping("origin").alias("is_total"))
    return merged.select("origin", "pages", (F.col("score_sum") / F.col("pages")).alias("mean_score"), *_GRADES, "is_total")

