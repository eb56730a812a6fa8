"""Batch forms of the time rules: rate windows, rolling counts, stalls, overruns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge import constants as C


def over_limit(requests: DataFrame, key: str, at: Column, row_id: str, limit: int, window: str) -> DataFrame:
    """Requests beyond the first ``limit`` of their key in each aligned window, with their ``rank``.

    The rank is exact but never numbers a whole window in one task: requests are numbered inside a minute
    and the counts of the earlier minutes of the window are added.
    """
    timed = requests.withColumns({"_at": at, "_minute": F.date_trunc("minute", at), "window_start": F.window(at, window)["start"]})
    minute = [key, "window_start", "_minute"]
    earlier = Window.partitionBy(key, "window_start").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    offsets = timed.groupBy(*minute).agg(F.count("*").alias("_n")).select(
        *minute, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*minute).orderBy("_at", row_id)
    ranked = timed.withColumn("_rank", F.row_number().over(inside)).join(offsets, minute)
    return ranked.withColumn("rank", F.col("_rank") + F.col("_before")).where(F.col("rank") > limit).drop(
        "_at", "_minute", "_rank", "_before"
    )


def minute_counts(jobs: DataFrame, at: Column) -> DataFrame:
    """(minute, status, n): the small table that rolling metrics are read from."""
    return jobs.groupBy(F.window(at, "1 minute")["start"].alias("minute"), "status").agg(F.count("*").alias("n"))


def rolling_hour(minutes: DataFrame) -> DataFrame:
    """Per minute with new jobs: jobs per status created in the hour that ends with that minute."""
    per_minute = minutes.groupBy("minute").agg(
        *[F.sum(F.when(F.col("status") == s, F.col("n")).otherwise(0)).alias(s.lower()) for s in C.JOB_STATUSES]
    )
    # One row per minute; hours are laid out by day so that no task holds the whole calendar.
    spread = per_minute.withColumn("_day", F.explode(F.array(F.to_date("minute"), F.date_add(F.to_date("minute"), 1))))
    seconds = F.unix_seconds("minute")
    hour = Window.partitionBy("_day").orderBy(seconds).rangeBetween(-(C.METRICS_SECONDS - 60), 0)
    sums = spread.select("minute", "_day", *[F.sum(s.lower()).over(hour).alias(s.lower()) for s in C.JOB_STATUSES])
    return sums.where(F.col("_day") == F.to_date("minute")).drop("_day")


def stalls(progress: DataFrame, until: Column, seconds: int = C.STALL_SECONDS) -> DataFrame:
    """(job_id, value, since): progress values (job_id, at, value, done) that stood still for too long.

    A value stands from its first report to the next different one, or to ``until`` if the job is open.
    """
    order = Window.partitionBy("job_id").orderBy("at")
    changes = progress.withColumn("_prev", F.lag("value").over(order)).where(
        F.col("_prev").isNull() | (F.col("_prev") != F.col("value")) | F.col("done")
    )
    ends = F.coalesce(F.lead("at").over(order), until)
    return (
        changes.withColumn("_end", ends)
        .where(~F.col("done") & (F.unix_micros("_end") - F.unix_micros("at") > seconds * 1_000_000))
        .select("job_id", "value", F.col("at").alias("since"))
    )


def overruns(jobs: DataFrame, until: Column, seconds: int = C.JOB_TIMEOUT_SECONDS) -> DataFrame:
    """(job_id, failed_at): jobs that ran longer than allowed, with the time at which they fail."""
    ran = F.unix_micros(F.coalesce("completed_at", until)) - F.unix_micros("started_at")
    return jobs.where(F.col("started_at").isNotNull() & (ran > seconds * 1_000_000)).select(
        "job_id", (F.col("started_at") + F.expr(f"interval {seconds} seconds")).alias("failed_at")
    )
