"""Windowed counts on streams: rate limits and rolling job metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagegauge import constants as C

LATENESS = "10 minutes"


def request_counts(requests: DataFrame, key: str, at: str, window: str) -> DataFrame:
    """Streaming count per key and aligned window; rows later than the watermark are dropped."""
    return (
        requests.withWatermark(at, LATENESS)
        .groupBy(F.col(key).alias("key"), F.window(at, window).alias("w"))
        .agg(F.count("*").alias("n"))
        .select("key", F.col("w.start").alias("window_start"), "n")
    )


def with_limit(counts: DataFrame, limit: int) -> DataFrame:
    return counts.withColumn("over_limit", F.col("n") > limit)


def rolling_hours(jobs: DataFrame, at: str) -> DataFrame:
    """Streaming (minute, one count per status): jobs created in the hour that ends with each minute that has new jobs.

    Two chained aggregates: jobs are counted in panes of a minute, and panes, not jobs, are summed in sliding hours, so sixty
    copies are made of one row a minute only. Rows are appended once the watermark has passed the hour.
    """
    panes = jobs.withWatermark(at, LATENESS).groupBy(F.window(at, "1 minute").alias("pane")).agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in C.JOB_STATUSES]
    )
    named = panes.withColumn("time", F.window_time("pane"))
    hours = named.groupBy(F.window("time", "1 hour", "1 minute").alias("hour")).agg(
        *[F.sum(s.lower()).alias(s.lower()) for s in C.JOB_STATUSES], F.max("pane.start").alias("minute")
    )
    # The pane's own time is its last microsecond, so a pane lies in the hours that end with its minute or later.
    return hours.where(F.col("minute") + F.expr("interval 1 minute") == F.col("hour.end")).select("minute", *[s.lower() for s in C.JOB_STATUSES])


def append_rows(rows: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append finished rows to the table in ``out``; the default trigger reads what is there and stops."""
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def keep_updates(counts: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write each micro-batch's changed counts to its own folder; the default trigger reads what is there and stops."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def latest_counts(updates: DataFrame, *keys: str) -> DataFrame:
    """The last written count per key from the folders of :func:`keep_updates`."""
    return updates.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
