"""Report table: writing, JSON documents, validated reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import urls as U
from pagegauge.plans.reports import SCORE_COLUMNS

# The nested columns are stored as JSON text, as in the contract, and read with these fixed types.
RECOMMENDATION = "struct<priority:string,category:string,title:string,description:string,exampleCode:string>"
FINDINGS = f"array<struct<id:string,severity:string,title:string,description:string,evidence:string,recommendation:{RECOMMENDATION}>>"
RECOMMENDATIONS = f"array<{RECOMMENDATION}>"
EVIDENCE = (
    "array<struct<id:string,type:string,url:string,inline:string,contentType:string,capturedAt:string,"
    "description:string,metadata:map<string,string>>>"
)


def write_reports(reports: DataFrame, path: str, batch: str = "all") -> None:
    """Write the reports of one batch, by creation date and batch; the same batch written again replaces itself.

    Rows are brought together by date, and a date that is large is split over several files.
    """
    dated = reports.withColumns({"created_date": F.to_date("created_at"), "batch": F.lit(batch)}).hint("rebalance", "created_date")
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("created_date", "batch").parquet(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def escape_for_html(json: Column) -> Column:
    """Escape a JSON text so that it can stand inside an HTML script element."""
    out = json
    for char, escape in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(char), F.lit(escape))
    return out


def iso(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def api_findings(findings: Column) -> Column:
    return F.transform(
        findings,
        lambda f: F.struct(*[f[n].alias(n) for n in ("id", "severity", "title", "description", "evidence", "recommendation")]),
    )


def api_evidence(evidence: Column) -> Column:
    fields = ("id", "type", "url", "inline", "contentType")
    return F.transform(
        evidence,
        lambda e: F.struct(
            *[e[n].alias(n) for n in fields], iso(e["capturedAt"]).alias("capturedAt"), e["description"].alias("description")
        ),
    )


def report_json(html_safe: bool = False) -> Column:
    """The report as the JSON document that readers receive; absent optional fields are left out."""
    camel = {c: n + "Score" for n, c in SCORE_COLUMNS.items()}
    document = F.to_json(
        F.struct(
            F.col("id"), F.col("job_id").alias("jobId"), F.col("overall_score").alias("overallScore"), F.col("grade"),
            *[F.col(c).alias(n) for c, n in camel.items()],
            api_findings(F.col("findings")).alias("findings"),
            F.col("recommendations"),
            api_evidence(F.col("evidence")).alias("evidence"),
            F.col("page_title").alias("pageTitle"), F.col("final_url").alias("finalUrl"),
            iso(F.col("created_at")).alias("createdAt"),
        )
    )
    return escape_for_html(document) if html_safe else document


def stored_form(reports: DataFrame) -> DataFrame:
    """Reports with the three nested columns as JSON text."""
    return reports.withColumns(
        {
            "findings": F.to_json(api_findings(F.col("findings"))),
            "recommendations": F.to_json("recommendations"),
            "evidence": F.to_json(api_evidence(F.col("evidence"))),
        }
    )


def _bad_recommendation(r: Column) -> Column:
    return ~(
        r["priority"].isin(*C.PRIORITIES) & r["category"].isin(*C.DIMENSIONS)
        & F.coalesce(r["title"] != "", F.lit(False)) & r["description"].isNotNull()
    )


def _bad_finding(f: Column) -> Column:
    fine = (
        F.coalesce(f["id"] != "", F.lit(False)) & f["severity"].isin(*C.SEVERITIES)
        & F.coalesce(f["title"] != "", F.lit(False)) & f["description"].isNotNull()
    )
    return ~fine | (f["recommendation"].isNotNull() & _bad_recommendation(f["recommendation"]))


def _bad_evidence(e: Column) -> Column:
    stamp = e["capturedAt"].rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z$")
    return ~(
        F.coalesce(e["id"] != "", F.lit(False)) & e["type"].isin(*C.EVIDENCE_TYPES) & stamp
        & (e["url"].isNull() | U.parts(e["url"]).isNotNull())
    )


def validate_reports(stored: DataFrame) -> DataFrame:
    """Parse the JSON columns of stored reports and add ``violations`` (names of columns that drifted)."""
    parsed = stored.withColumns(
        {
            "p_findings": F.from_json("findings", FINDINGS),
            "p_recommendations": F.from_json("recommendations", RECOMMENDATIONS),
            "p_evidence": F.from_json("evidence", EVIDENCE),
        }
    )

    def drifted(column, bad):
        broken = F.coalesce(F.exists(column, lambda x: x.isNull() | F.coalesce(bad(x), F.lit(True))), F.lit(True))
        return F.when(F.col(column).isNull() | broken, F.lit(column[2:]))

    score_names = ["overall_score", *SCORE_COLUMNS.values()]
    checks = [
        drifted("p_findings", _bad_finding),
        drifted("p_recommendations", _bad_recommendation),
        drifted("p_evidence", _bad_evidence),
        F.when(~F.col("grade").isin(*C.GRADES), F.lit("grade")),
        *[F.when(~F.col(c).between(0, 100), F.lit(c)) for c in score_names],
    ]
    return parsed.withColumn("violations", F.array_compact(F.array(*checks)))


def strict(validated: DataFrame) -> DataFrame:
    """Fail the job on the first drifted row."""
    message = F.concat(F.lit("report "), F.col("id"), F.lit(" drifted: "), F.array_join("violations", ", "))
    checked = F.when(F.size("violations") > 0, F.raise_error(message).cast("string")).otherwise(F.col("id"))
    return validated.withColumn("id", checked)


def quarantine(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, drifted) rows."""
    return validated.where(F.size("violations") == 0), validated.where(F.size("violations") > 0)
