"""Job and report tables: deduplication, life cycle, metrics, retention, deletion.

``now`` is always a column or literal given by the caller, never the wall clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import scoring as S
from pagegauge.functions import urls as U
from pagegauge.operators.skew import latest_before, salted_left_join
from pagegauge.plans.reports import row_id
from pagegauge.session import shared_dir


def _within(latest: Column, at: Column, seconds: int) -> Column:
    age = F.unix_micros(at) - F.unix_micros(latest["at"])
    return F.when(age <= seconds * 1_000_000, latest["value"])


def inflight_lookup(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add ``inflight_job_id``: the newest open job of the key created in the 60 s up to the request.

    ``requests`` has normalized_url and requested_at.
    """
    open_jobs = jobs.where(F.col("status").isin("PENDING", "RUNNING"))
    found = latest_before(
        requests, open_jobs, "normalized_url", F.col("requested_at"), F.col("created_at"), F.col("job_id")
    )
    return found.withColumn(
        "inflight_job_id", _within(F.col("latest"), F.col("requested_at"), C.INFLIGHT_SECONDS)
    ).drop("latest")


def cache_lookup(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add ``cached_job_id``: the job of the key that completed last, if within the past 24 h."""
    done = jobs.where((F.col("status") == "COMPLETED") & F.col("completed_at").isNotNull())
    found = latest_before(
        requests, done, "normalized_url", F.col("requested_at"), F.col("completed_at"), F.col("job_id")
    )
    return found.withColumn(
        "cached_job_id", _within(F.col("latest"), F.col("requested_at"), C.CACHE_SECONDS)
    ).drop("latest")


def dedupe_decision(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Add ``decision`` (in-flight, cached, new), ``reused_job_id`` and ``cached``."""
    both = cache_lookup(inflight_lookup(requests, jobs), jobs)
    inflight, cached = F.col("inflight_job_id"), F.col("cached_job_id")
    decision = F.when(inflight.isNotNull(), "in-flight").when(cached.isNotNull(), "cached").otherwise("new")
    return both.withColumns(
        {"decision": decision, "reused_job_id": F.coalesce(inflight, cached), "cached": decision == "cached"}
    ).drop("inflight_job_id", "cached_job_id")


def create_jobs(requests: DataFrame) -> DataFrame:
    """PENDING rows for (request_id, url, token, requested_at): masked URL, real key, token hash."""
    return requests.select(
        row_id("c", "job", F.col("request_id")).alias("job_id"),
        U.mask(F.col("url")).alias("url"),
        U.normalize(F.col("url")).alias("normalized_url"),
        F.lit("PENDING").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        F.sha2("token", 256).alias("delete_token_hash"),
        F.col("requested_at").alias("created_at"),
        F.lit(None).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )


def life_cycle(events: DataFrame) -> DataFrame:
    """Fold (job_id, at, status, message) events into job rows; later events win."""
    ended = F.col("status").isin("COMPLETED", "FAILED")
    return events.groupBy("job_id").agg(
        F.max_by("status", "at").alias("status"),
        F.min("at").alias("created_at"),
        F.max(F.when(F.col("status") == "RUNNING", F.col("at"))).alias("started_at"),
        F.max(F.when(ended, F.col("at"))).alias("completed_at"),
        F.left(F.max_by("message", F.when(F.col("status") == "FAILED", F.col("at"))), F.lit(C.ERROR_MESSAGE_CHARS)).alias(
            "error_message"
        ),
    )


def status_view(jobs: DataFrame, reports: DataFrame, progress: DataFrame) -> DataFrame:
    """What a poller sees: status, report id, error and, while running, the clamped progress."""
    shown = F.when(
        (F.col("status") == "RUNNING") & F.col("progress").isNotNull() & ~F.isnan("progress"),
        S.clamp_score(F.col("progress")),
    )
    return (
        jobs.where(F.col("job_id").rlike(C.JOB_ID_PATTERN))
        .join(reports.select("job_id", F.col("id").alias("report_id")), "job_id", "left")
        .join(progress.select("job_id", "progress"), "job_id", "left")
        .select("job_id", "status", "report_id", F.nullif("error_message", F.lit("")).alias("error_message"), shown.alias("progress"))
    )


def stage_percent(stage: Column) -> Column:
    """Percentage of a pipeline stage."""
    pairs = [F.lit(x) for pair in C.STAGE_PROGRESS for x in pair]
    return F.try_element_at(F.create_map(*pairs), stage)


def step_states(status: Column, percent: Column) -> Column:
    """State (done, active, pending) of the five visible steps."""
    n = len(C.STEP_THRESHOLDS)
    passed = sum(((percent >= bound).cast("int") for _, bound in C.STEP_THRESHOLDS), F.lit(0))
    active = F.greatest(F.lit(0), F.coalesce(passed, F.lit(0)) - 1)
    running = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.when(i < active, F.lit("done")).when(i == active, F.lit("active")).otherwise(F.lit("pending")),
    )
    return (
        F.when(status == "COMPLETED", F.array_repeat(F.lit("done"), n))
        .when(status == "PENDING", F.concat(F.array(F.lit("active")), F.array_repeat(F.lit("pending"), n - 1)))
        .otherwise(running)
    )


def retry_plan(failures: DataFrame) -> DataFrame:
    """Number the failed attempts (job_id, at, permanent) of each job and say what follows.

    A permanent failure or the third attempt ends the job; otherwise the next try waits 5 s, 10 s, ...
    """
    order = Window.partitionBy("job_id").orderBy("at")
    attempt = F.row_number().over(order)
    ended = F.col("permanent") | (F.col("attempt") >= C.MAX_ATTEMPTS)
    delay = F.lit(C.BACKOFF_SECONDS) * F.pow(F.lit(2.0), F.col("attempt") - 1)
    return failures.withColumn("attempt", attempt).withColumns(
        {
            "exhausted": F.col("attempt") >= C.MAX_ATTEMPTS,
            "retry": ~ended,
            "backoff_seconds": F.when(~ended, delay.cast("int")),
        }
    )


# -- metrics --------------------------------------------------------------------------------------


def status_counts(jobs: DataFrame, now: Column) -> DataFrame:
    """One row: jobs created in the last hour per status (zero-filled), total and error rate."""
    recent = F.col("created_at") >= now - F.expr(f"interval {C.METRICS_SECONDS} seconds")
    counts = {s: F.count_if(recent & (F.col("status") == s)) for s in C.JOB_STATUSES}
    row = jobs.agg(*[c.alias(s.lower()) for s, c in counts.items()])
    finished = F.col("completed") + F.col("failed")
    rate = F.coalesce(F.col("failed").cast("double") / F.nullif(finished.cast("double"), F.lit(0.0)), F.lit(0.0))
    return row.withColumns(
        {
            "total": sum((F.col(s.lower()) for s in C.JOB_STATUSES), F.lit(0)),
            "error_rate": F.floor(rate * 10_000 + F.lit(0.5)) / F.lit(10_000.0),
        }
    )


# Percentiles look at this many slices of about equal numbers of values.
SLICES = 256


def exact_percentiles(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """Continuous percentiles of a whole column as one row, with ``n``.

    Equal values are counted before anything is ordered. Approximate quantiles cut the values into ``SLICES`` slices; ranks
    come from the slices' counts (so many rows at most, whatever the range of values), and only the slices that hold a
    wanted rank are ordered value by value, so no task sees the whole column.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    cuts = values.agg(F.percentile_approx(F.col(column).cast("double"), [i / SLICES for i in range(1, SLICES)], 10 * SLICES).alias("cuts")).scalar()
    counted = counted.withColumn("cuts", cuts).withColumn("b", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts")
    buckets = counted.groupBy("b").agg(F.sum("c").alias("c"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = buckets.select(
        "b", "c", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("before"), F.sum("c").over(whole).alias("n")
    )
    position = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    hit = F.lit(False)
    for p in shares.values():
        low, high = F.floor(position(p)), F.ceil(position(p))
        hit = hit | ((low < F.col("before") + F.col("c")) & (high >= F.col("before")))
    wanted = ranked.where(hit).select("b", "before", "n")
    inside = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    lines = counted.join(F.broadcast(wanted), "b").withColumn(
        "first", F.col("before") + F.coalesce(F.sum("c").over(inside), F.lit(0))
    )

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("c")), F.col("v")))

    picked = lines.agg(
        F.max("n").alias("n"),
        *[value_at(F.floor(position(p))).alias(f"{name}_low") for name, p in shares.items()],
        *[value_at(F.ceil(position(p))).alias(f"{name}_high") for name, p in shares.items()],
    )

    def between(name: str, p: float) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        return low + (position(p) - F.floor(position(p))) * (high - low)

    return picked.select(F.coalesce("n", F.lit(0)).alias("n"), *[between(k, p).alias(k) for k, p in shares.items()])


def duration_percentiles(jobs: DataFrame, now: Column) -> DataFrame:
    """One row: sample size and rounded p50, p95, p99 (ms) of jobs completed in the last hour."""
    done = (
        (F.col("status") == "COMPLETED") & F.col("started_at").isNotNull()
        & (F.col("completed_at") >= now - F.expr(f"interval {C.METRICS_SECONDS} seconds"))
    )
    took = (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1000.0)
    exact = exact_percentiles(jobs.where(done).select(took.alias("ms")), "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return exact.select(
        F.col("n").alias("sample_size"), *[F.floor(F.col(p) + F.lit(0.5)).cast("bigint").alias(p) for p in ("p50", "p95", "p99")]
    )


# -- reports, deletion, retention -----------------------------------------------------------------


def report_by_id(reports: DataFrame, report_id: str | Column) -> DataFrame:
    """Point look-up; a malformed id finds nothing. The equality reaches the file scan."""
    wanted = F.lit(report_id) if isinstance(report_id, str) else report_id
    return reports.where((F.col("id") == wanted) & F.col("id").rlike(C.REPORT_ID_PATTERN))


def delete_outcomes(requests: DataFrame, reports: DataFrame, jobs: DataFrame) -> DataFrame:
    """Judge (request_id, report_id, token) deletions: invalid, token-required, not-found, forbidden, ok."""
    owned = reports.select(F.col("id").alias("report_id"), "job_id").join(
        jobs.select("job_id", "delete_token_hash"), "job_id"
    )
    given = F.coalesce("token", F.lit(""))
    outcome = (
        F.when(~F.col("report_id").rlike(C.REPORT_ID_PATTERN), "invalid")
        .when(given == "", "token-required")
        .when(F.col("job_id").isNull(), "not-found")
        .when(F.sha2(given, 256).eqNullSafe(F.nullif("delete_token_hash", F.lit(""))), "ok")
        .otherwise("forbidden")
    )
    # One report may draw a large share of the requests.
    judged = salted_left_join(requests, owned, "report_id", "request_id", requests)
    return judged.select("request_id", "report_id", "job_id", outcome.alias("outcome"))


def without_jobs(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose job stays (used for jobs and, by cascade, for reports)."""
    return table.join(gone.select("job_id"), "job_id", "left_anti")


def _cutoff(now: Column, days: float) -> Column:
    return F.timestamp_micros(F.unix_micros(now) - F.lit(int(days * 86_400_000_000)))


def expired(jobs: DataFrame, now: Column, days: float = C.RETENTION_DAYS) -> DataFrame:
    """Jobs created more than ``days`` ago."""
    if not (0 < days < float("inf")):
        raise ValueError(f"invalid retention period: {days}")
    return jobs.where(F.col("created_at") < _cutoff(now, days))


def apply_retention(spark: SparkSession, path: str, now: Column, days: float = C.RETENTION_DAYS) -> None:
    """Delete expired rows in place from a table stored at ``path`` by ``created_date``, with a ``created_at`` column.

    Reports carry their job's ``created_at``, so the same call on their table is the cascade. The cut-off day's folder is
    replaced by its survivors, if there are none by an empty file; earlier days lose their folders (as many as days have gone
    by since the last call); newer days are not touched. A call that was cut short is finished by the next one, as both steps give the same again.
    """
    cut = F.to_date(_cutoff(now, days))
    stored = spark.read.parquet(path)
    row = stored.agg(F.max(cut).alias("cut")).first()
    if row["cut"] is None:
        return
    day = f"{path}/created_date={row['cut']}"
    survivors = stored.where((F.col("created_date") == F.lit(row["cut"])) & (F.col("created_at") >= _cutoff(now, days)))
    # Spark reads a folder before it replaces it, so the survivors are set aside first.
    aside = shared_dir(spark, "retention")
    survivors.drop("created_date").write.parquet(aside)
    spark.read.schema(stored.drop("created_date").schema).parquet(aside).write.mode("overwrite").parquet(day)
    expired_days = stored.select("created_date").where(F.col("created_date") < F.lit(row["cut"])).distinct()
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for gone in expired_days.toLocalIterator():
        files.delete(hadoop.Path(f"{path}/created_date={gone['created_date']}"), True)
