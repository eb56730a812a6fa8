"""Temp views over a folder of captures and site files, for use from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegauge.operators import structure
from pagegauge.plans import reports
from pagegauge.plans.grading import graded_pages


def create_views(spark: SparkSession, path: str, partitioned: bool = False) -> dict[str, DataFrame]:
    """Registers ``tokens``, ``elements``, ``findings``, ``reports`` and ``jobs`` over the tables in ``path``.

    ``path`` holds ``captures`` and ``site_files`` as Parquet and may hold ``jobs``; without it the jobs are those of the
    reports, one per capture. Nothing is computed before a view is read.
    """
    captures, site_files = spark.read.parquet(f"{path}/captures"), spark.read.parquet(f"{path}/site_files")
    graded = graded_pages(captures, site_files, partitioned)
    built = reports.build_reports(captures, site_files, partitioned=partitioned)
    views = {
        "tokens": structure.tokens(captures),
        "elements": structure.elements(captures, partitioned=partitioned),
        "findings": reports.findings_long(graded),
        "reports": built,
        "jobs": _jobs(spark, path, built),
    }
    for name, view in views.items():
        view.createOrReplaceTempView(name)
    return views


def _jobs(spark: SparkSession, path: str, built: DataFrame) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/jobs")
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.parquet(f"{path}/jobs")
    return built.select("job_id", F.col("final_url").alias("url"), F.lit("COMPLETED").alias("status"), "created_at")
