"""Streaming operators, each driven to the end of the given tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.operators import timelines
from pagegauge.session import shared_dir
from pagegauge.streaming import deadlines, dedupe, grading as stream_grading, windows
from workload import q_jobs, q_reports  # noqa: F401  (both fill the CTE table)
from workload.ctes import CTES
from workload.inputs import Tables
from workload.registry import query


BATCHES = 3
FILES = 2


class StreamTables(Tables):
    """The same recipes over a stream of the table's rows, arriving in three batches of several files in the order of their time or id.

    With ``closing`` a last batch holds nothing but a row an hour later, which moves the watermark past all others.
    """

    def __init__(self, spark, sf_dir, closing: bool = False):
        super().__init__(spark, sf_dir)
        self.closing = closing

    def read(self, name):
        table = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        order = {"events": F.unix_micros(F.col("ts").cast("timestamp")), "pages": F.col("page_id")}[name]
        cuts = table.agg(F.percentile_approx(order, [i / BATCHES for i in range(1, BATCHES)]).alias("c")).first()["c"] or []
        part = sum(((order > c).cast("int") for c in cuts), F.lit(0))
        folder = shared_dir(self.spark, f"arriving-{name}")
        for i in range(BATCHES):
            # Rows are dealt over the files by their content, so each batch is read by as many tasks as it has files.
            table.where(part == i).repartition(FILES, order).write.mode("append").parquet(folder)
        if self.closing:
            last = table.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("interval 1 hour")).alias("ts"))
            others = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != "ts"]
            clock = last.select("ts", *others).select(*table.columns)
            for _ in range(FILES):
                clock.write.mode("append").parquet(folder)
        return self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def finish(stream):
    stream.awaitTermination()


def streamed(t, closing=False):
    return StreamTables(t.spark, t.dir, closing)


@query("st_analyze", f"select {q_reports._REPORT} from rep")
def st_analyze(t):
    out = shared_dir(t.spark, "graded")
    finish(stream_grading.grade_stream(streamed(t).captures(), t.site_files(), out, shared_dir(t.spark, "ckpt")))
    return q_reports.flattened(t.spark.read.parquet(out))


CTES["points"] = "select normalized_url, cast(floor(epoch_us(created_at) / 1000) as bigint) as ms, min(event_id) as event_id from jobs group by 1, 2"


@query(
    "st_inflight_dedupe",
    """with recursive chain(normalized_url, ms) as (
         select normalized_url, min(ms) from (select normalized_url, cast(floor(epoch_us(created_at) / 1000) as bigint) as ms from (
             select concat('https://s', user_id % 2, '.example.com/') as normalized_url, cast(ts as timestamp) as created_at from events)) group by 1
         union all select c.normalized_url, (select min(p.ms) from (select concat('https://s', user_id % 2, '.example.com/') as k, cast(floor(epoch_us(cast(ts as timestamp)) / 1000) as bigint) as ms from events) p
             where p.k = c.normalized_url and p.ms > c.ms + 60000) from chain c where c.ms is not null)
       select e.event_id, e.normalized_url, c.ms is not null and e.event_id = min(e.event_id) over (partition by e.normalized_url, e.ms) as accepted
       from (select event_id, concat('https://s', user_id % 2, '.example.com/') as normalized_url, cast(floor(epoch_us(cast(ts as timestamp)) / 1000) as bigint) as ms from events) e
         left join chain c on c.normalized_url = e.normalized_url and c.ms = e.ms""",
)
def st_inflight_dedupe(t):
    out = shared_dir(t.spark, "dedupe")
    asked = streamed(t, closing=True).jobs().select("event_id", F.when(F.col("event_id").isNotNull(), F.col("normalized_url")).alias("normalized_url"), "created_at")
    finish(dedupe.dedupe_stream(asked, "normalized_url", "created_at", "event_id", out, shared_dir(t.spark, "ckpt")))
    return t.spark.read.parquet(out).select("event_id", "normalized_url", "accepted")


# (limit name, key divisor, limit, window): every limit, each with clients of its own; the global one has a single client.
_CLIENTS = {"global": 1, "analyze-minute": 2, "analyze-day": 10, "report-read": 3, "report-delete": 5}
_RATES = tuple((name, _CLIENTS[name], limit, window) for name, limit, window in C.RATE_LIMITS)


@query(
    "st_rate_window",
    " union all ".join(
        f"""select '{name}' as rule, cast(user_id % {div} as int) as client, epoch_us(date_trunc('{w.split()[1]}', cast(ts as timestamp))) as window_us, count(*) as n, count(*) > {limit} as over_limit
            from events group by 1, 2, 3"""
        for name, div, limit, w in _RATES
    ),
)
def st_rate_window(t):
    parts = []
    events = streamed(t).read("events")
    for name, div, limit, width in _RATES:
        asked = events.select((F.col("user_id") % div).cast("int").alias("client"), F.col("ts").cast("timestamp").alias("at"))
        out = shared_dir(t.spark, "rates")
        finish(windows.keep_updates(windows.request_counts(asked, "client", "at", width), out, shared_dir(t.spark, "ckpt")))
        counts = windows.with_limit(windows.latest_counts(t.spark.read.parquet(out), "key", "window_start"), limit)
        parts.append(
            counts.select(F.lit(name).alias("rule"), F.col("key").alias("client"), F.unix_micros("window_start").alias("window_us"), "n", "over_limit")
        )
    return functools.reduce(DataFrame.unionByName, parts)


@query(
    "st_rate_excess",
    " union all ".join(
        f"""select '{name}' as rule, event_id, rank from (select event_id, row_number() over (partition by user_id % {div}, date_trunc('{w.split()[1]}', cast(ts as timestamp)) order by ts, event_id) as rank
            from events) where rank > {limit}"""
        for name, div, limit, w in _RATES
    ),
)
def st_rate_excess(t):
    parts = []
    for name, div, limit, width in _RATES:
        asked = t.read("events").select("event_id", (F.col("user_id") % div).alias("client"), F.col("ts").cast("timestamp").alias("at"))
        rows = timelines.over_limit(asked, "client", F.col("at"), "event_id", limit, width)
        parts.append(rows.select(F.lit(name).alias("rule"), "event_id", "rank"))
    return functools.reduce(DataFrame.unionByName, parts)


@query(
    "st_job_metrics",
    "select epoch_us(minute) as minute_us, "
    + ", ".join(
        f"cast(coalesce((select sum(case when status = '{s}' then 1 else 0 end) from jobs j where j.created_at < m.minute + interval 1 minute and j.created_at >= m.minute - interval 59 minute), 0) as bigint) as {s.lower()}"
        for s in C.JOB_STATUSES
    )
    + " from (select distinct date_trunc('minute', created_at) as minute from jobs) m",
)
def st_job_metrics(t):
    out = shared_dir(t.spark, "hours")
    created = streamed(t, closing=True).jobs().select("created_at", "status")
    finish(windows.append_rows(windows.rolling_hours(created, "created_at"), out, shared_dir(t.spark, "ckpt")))
    return t.spark.read.parquet(out).select(F.unix_micros("minute").alias("minute_us"), *[s.lower() for s in C.JOB_STATUSES])


def progress_of(jobs):
    """Progress reports of each job: two changes, one repeat, and the end for finished jobs.

    The gaps come from the event's value, so some lie on either side of the limits.
    """
    step = F.round(F.col("value") * 2_000_000).cast("bigint")
    at = lambda n: F.timestamp_micros(F.unix_micros("created_at") + n)
    zero = F.lit(0).cast("bigint")
    row = lambda when, value, done: F.struct(when.alias("at"), F.lit(value).alias("value"), F.lit(done).alias("done"))
    open_rows = F.array(row(at(zero), 10, False), row(at(step), 10, False), row(at(step * 2), 30, False))
    closed = F.array(row(at(step * 3), 100, True))
    return jobs.select(
        "job_id", F.inline(F.when(F.col("status").isin("COMPLETED", "FAILED"), F.concat(open_rows, closed)).otherwise(open_rows))
    )


_STEP = "cast(round(value * 2000000) as bigint)"
CTES["prog"] = f"""select job_id, epoch_us(created_at) as t0, {_STEP} as step, status in ('COMPLETED', 'FAILED') as done from jobs"""
# The clock of an event-time query is its watermark: the closing row, an hour after the newest event, less the allowed lateness.
CTES["wm"] = "select (epoch_us(max(cast(ts as timestamp))) + 3600000000) // 1000 * 1000 - 600000000 as wm from events"


@query(
    "st_stalled_jobs",
    """select job_id, 10 as value, t0 as since_us from prog where step * 2 > 60000000
       union all select job_id, 30, t0 + step * 2 from prog cross join wm where (done and step > 60000000) or (not done and t0 + step * 2 + 60000000 < wm)""",
)
def st_stalled_jobs(t):
    return collect_alerts(t, deadlines.stalled)


@query(
    "st_job_timeout",
    "select job_id, t0 as since_us from prog cross join wm where (done and step * 3 > 90000000) or (not done and t0 + 90000000 < wm)",
)
def st_job_timeout(t):
    return collect_alerts(t, deadlines.overrun).drop("value")


def collect_alerts(t, rule):
    out = shared_dir(t.spark, "alerts")
    finish(deadlines.alert_stream(rule(progress_of(streamed(t, closing=True).jobs())), out, shared_dir(t.spark, "ckpt")))
    return t.spark.read.parquet(out)
