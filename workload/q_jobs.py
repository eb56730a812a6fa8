"""Job table, metrics, deletion, retention, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.operators import jobs as J, redaction
from pagegauge.session import shared_dir
from workload.ctes import CTES
from workload.registry import query

# Each event is also a request for its key at its own time; it must not find its own job, so it comes
# one millisecond before.
CTES["reqs"] = "select event_id as request_id, normalized_url, created_at - interval 1 millisecond as requested_at from jobs"


def requests(t):
    return t.jobs().select(
        F.col("event_id").alias("request_id"), "normalized_url",
        (F.col("created_at") - F.expr("interval 1 millisecond")).alias("requested_at"),
    )


CTES["inflight"] = """select r.request_id, max_by(j.job_id, j.created_at) as job from reqs r join jobs j on j.normalized_url = r.normalized_url
  and j.status in ('PENDING', 'RUNNING') and j.created_at <= r.requested_at and j.created_at >= r.requested_at - interval 60 second group by r.request_id"""
CTES["cachehit"] = """select r.request_id, max_by(j.job_id, j.completed_at) as job from reqs r join jobs j on j.normalized_url = r.normalized_url
  and j.status = 'COMPLETED' and j.completed_at <= r.requested_at and j.completed_at >= r.requested_at - interval 24 hour group by r.request_id"""


@query("job_inflight_lookup", "select r.request_id, coalesce(i.job, '') as inflight_job_id from reqs r left join inflight i using (request_id)")
def job_inflight_lookup(t):
    found = J.inflight_lookup(requests(t), t.jobs())
    return found.select("request_id", F.coalesce("inflight_job_id", F.lit("")).alias("inflight_job_id"))


@query("job_cache_lookup", "select r.request_id, coalesce(c.job, '') as cached_job_id from reqs r left join cachehit c using (request_id)")
def job_cache_lookup(t):
    found = J.cache_lookup(requests(t), t.jobs())
    return found.select("request_id", F.coalesce("cached_job_id", F.lit("")).alias("cached_job_id"))


@query(
    "job_dedupe_decision",
    """select r.request_id, case when i.job is not null then 'in-flight' when c.job is not null then 'cached' else 'new' end as decision,
        coalesce(i.job, c.job, '') as reused_job_id, i.job is null and c.job is not null as cached
       from reqs r left join inflight i using (request_id) left join cachehit c using (request_id)""",
)
def job_dedupe_decision(t):
    rows = J.dedupe_decision(requests(t), t.jobs())
    return rows.select("request_id", "decision", F.coalesce("reused_job_id", F.lit("")).alias("reused_job_id"), "cached")


@query(
    "job_create",
    """select job_id, concat('https://s', user_id % 2, '.example.com/?token=%5Bredacted%5D') as url, url as normalized_url, 'PENDING' as status,
        sha256(concat('token-', event_id)) as delete_token_hash, epoch_us(created_at) as created_us from jobs""",
)
def job_create(t):
    asked = t.jobs().select(
        F.col("event_id").alias("request_id"), "url", F.concat(F.lit("token-"), F.col("event_id").cast("string")).alias("token"),
        F.col("created_at").alias("requested_at"),
    )
    rows = J.create_jobs(asked)
    return rows.select("job_id", "url", "normalized_url", "status", "delete_token_hash", F.unix_micros("created_at").alias("created_us"))


def job_events(t):
    """Status changes of every job, as rows."""
    jobs = t.jobs()
    change = lambda at, status, message=None: F.struct(
        F.col(at).alias("at"), (status if not isinstance(status, str) else F.lit(status)).alias("status"),
        (message if message is not None else F.lit(None)).cast("string").alias("message"),
    )
    long_message = F.repeat(F.col("error_message"), 60)
    return jobs.select(
        "job_id",
        F.inline(
            F.filter(
                F.array(
                    change("created_at", "PENDING"), change("started_at", "RUNNING"),
                    change("completed_at", F.col("status"), long_message),
                ),
                lambda e: e["at"].isNotNull(),
            )
        ),
    )


@query(
    "job_lifecycle",
    """select job_id, status, epoch_us(created_at) as created_us, coalesce(epoch_us(started_at), 0) as started_us, coalesce(epoch_us(completed_at), 0) as completed_us,
        coalesce(left(repeat(error_message, 60), 1000), '') as error_message from jobs""",
)
def job_lifecycle(t):
    rows = J.life_cycle(job_events(t))
    stamp = lambda c: F.coalesce(F.unix_micros(c), F.lit(0).cast("bigint"))
    return rows.select(
        "job_id", "status", stamp("created_at").alias("created_us"), stamp("started_at").alias("started_us"),
        stamp("completed_at").alias("completed_us"), F.coalesce("error_message", F.lit("")).alias("error_message"),
    )


def reports_of(jobs):
    """Report keys of the completed jobs."""
    return jobs.where("status = 'COMPLETED'").select(
        "job_id", F.concat(F.lit("r"), F.left(F.sha2(F.concat(F.lit("report-"), "job_id"), 256), F.lit(24))).alias("id"),
        "event_id", "created_at",
    )


CTES["jreps"] = "select job_id, concat('r', left(sha256(concat('report-', job_id)), 24)) as id, event_id, created_at from jobs where status = 'COMPLETED'"


@query(
    "job_status_view",
    """select j.job_id, j.status, coalesce(r.id, '') as report_id, coalesce(j.error_message, '') as error_message,
        case when j.status = 'RUNNING' then cast(least(100, greatest(0, floor(j.value * 4 - 10 + 5e-1))) as int) else -1 end as progress
       from jobs j left join jreps r on r.job_id = j.job_id""",
)
def job_status_view(t):
    jobs = t.jobs()
    progress = jobs.select("job_id", (F.col("value") * 4 - 10).alias("progress"))
    view = J.status_view(jobs, reports_of(jobs), progress)
    return view.select(
        "job_id", "status", F.coalesce("report_id", F.lit("")).alias("report_id"),
        F.coalesce("error_message", F.lit("")).alias("error_message"), F.coalesce("progress", F.lit(-1)).alias("progress"),
    )


_STAGES = [s for s, _ in C.STAGE_PROGRESS] + ["unknown"]
_STAGE_SQL = "case event_id % 8 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_STAGES)) + " end"
_PERCENT_SQL = "case event_id % 8 " + " ".join(f"when {i} then {p}" for i, (_, p) in enumerate(C.STAGE_PROGRESS)) + " else 0 end"
_PASSED = " + ".join(f"(case when percent >= {b} then 1 else 0 end)" for _, b in C.STEP_THRESHOLDS)


@query(
    "job_progress_map",
    f"""select event_id, percent, case when status = 'COMPLETED' then 'done|done|done|done|done' when status = 'PENDING' then 'active|pending|pending|pending|pending'
        else array_to_string(list_transform(range(5), lambda i: case when i < a then 'done' when i = a then 'active' else 'pending' end), '|') end as steps
       from (select *, greatest(0, {_PASSED} - 1) as a from (select event_id, status, cast({_PERCENT_SQL} as int) as percent from jobs))""",
)
def job_progress_map(t):
    rows = t.jobs().select("event_id", "status", F.coalesce(J.stage_percent(F.expr(_STAGE_SQL)), F.lit(0)).alias("percent"))
    return rows.select("event_id", "percent", F.array_join(J.step_states(F.col("status"), F.col("percent")), "|").alias("steps"))


CTES["fails"] = f"""select concat('c', left(sha256(concat('job-', event_id - event_id % 4)), 24)) as job_id, event_id, created_at as failed_at, event_id % 11 = 0 as permanent from jobs"""


@query(
    "job_retry_class",
    """select event_id, cast(attempt as int) as attempt, attempt >= 3 as exhausted, not (permanent or attempt >= 3) as retry,
        cast(case when permanent or attempt >= 3 then 0 else 5 * pow(2, attempt - 1) end as int) as backoff_seconds
       from (select *, row_number() over (partition by job_id order by failed_at) as attempt from fails)""",
)
def job_retry_class(t):
    group = F.col("event_id") - F.col("event_id") % 4
    failures = t.jobs().select(
        F.concat(F.lit("c"), F.left(F.sha2(F.concat(F.lit("job-"), group.cast("string")), 256), F.lit(24))).alias("job_id"),
        "event_id", F.col("created_at").alias("at"), (F.col("event_id") % 11 == 0).alias("permanent"),
    )
    plan = J.retry_plan(failures)
    return plan.select("event_id", "attempt", "exhausted", "retry", F.coalesce("backoff_seconds", F.lit(0)).alias("backoff_seconds"))


def newest(jobs):
    """The newest creation time as a scalar subquery."""
    return jobs.agg(F.max("created_at")).scalar()


CTES["nowt"] = "select max(created_at) as now from jobs"
CTES["counts"] = "select " + ", ".join(
    f"count(*) filter (status = '{s}') as {s.lower()}" for s in C.JOB_STATUSES
) + " from jobs cross join nowt where created_at >= now - interval 1 hour"


@query("metrics_by_status", "select pending, running, completed, failed, pending + running + completed + failed as total from counts")
def metrics_by_status(t):
    jobs = t.jobs()
    return J.status_counts(jobs, newest(jobs)).drop("error_rate")


@query("metrics_error_rate", "select round(case when completed + failed = 0 then 0e0 else cast(failed as double) / (completed + failed) end, 4) as error_rate from counts")
def metrics_error_rate(t):
    jobs = t.jobs()
    return J.status_counts(jobs, newest(jobs)).select("error_rate")


@query(
    "metrics_duration_pct",
    """select count(*) as sample_size, cast(floor(quantile_cont(ms, 0.5) + 5e-1) as bigint) as p50, cast(floor(quantile_cont(ms, 0.95) + 5e-1) as bigint) as p95,
        cast(floor(quantile_cont(ms, 0.99) + 5e-1) as bigint) as p99
       from (select (epoch_us(completed_at) - epoch_us(started_at)) / 1000e0 as ms from jobs cross join nowt
             where status = 'COMPLETED' and started_at is not null and completed_at >= now - interval 1 hour)""",
)
def metrics_duration_pct(t):
    jobs = t.jobs()
    return J.duration_percentiles(jobs, newest(jobs))


@query("report_by_id", "select job_id, id, event_id from jreps where id = (select min(id) from jreps)")
def report_by_id(t):
    reports = reports_of(t.jobs())
    return J.report_by_id(reports, reports.agg(F.min("id")).scalar()).select("job_id", "id", "event_id")


CTES["delreq"] = """select event_id as request_id, case when event_id % 17 = 0 then 'BAD ID' when event_id % 13 = 0 then 'rmissing0000000000000000000' else id end as report_id,
    case when event_id % 5 = 0 then null when event_id % 3 = 0 then 'guess' else concat('token-', event_id) end as token from jreps"""
CTES["deljudged"] = """select q.request_id, q.report_id, case when not regexp_matches(q.report_id, '^[a-z][a-z0-9]{20,32}$') then 'invalid' when coalesce(q.token, '') = '' then 'token-required'
    when r.id is null then 'not-found' when j.delete_token_hash = sha256(q.token) then 'ok' else 'forbidden' end as outcome, j.job_id
  from delreq q left join jreps r on r.id = q.report_id left join jobs j on j.job_id = r.job_id"""


def delete_requests(reports):
    e = F.col("event_id")
    return reports.select(
        e.alias("request_id"),
        F.when(e % 17 == 0, "BAD ID").when(e % 13 == 0, "rmissing0000000000000000000").otherwise(F.col("id")).alias("report_id"),
        F.when(e % 5 == 0, F.lit(None)).when(e % 3 == 0, "guess").otherwise(F.concat(F.lit("token-"), e.cast("string"))).alias("token"),
    )


@query(
    "report_delete_authorised",
    """select 'request' as kind, cast(request_id as varchar) as ref, outcome from deljudged
       union all select 'job', job_id, 'kept' from jobs where job_id not in (select job_id from deljudged where outcome = 'ok')
       union all select 'report', id, 'kept' from jreps where job_id not in (select job_id from deljudged where outcome = 'ok')""",
)
def report_delete_authorised(t):
    jobs = t.jobs()
    reports = reports_of(jobs)
    judged = J.delete_outcomes(delete_requests(reports), reports, jobs)
    gone = judged.where("outcome = 'ok'")
    kept = F.lit("kept").alias("outcome")
    return (
        judged.select(F.lit("request").alias("kind"), F.col("request_id").cast("string").alias("ref"), "outcome")
        .unionByName(J.without_jobs(jobs, gone).select(F.lit("job").alias("kind"), F.col("job_id").alias("ref"), kept))
        .unionByName(J.without_jobs(reports, gone).select(F.lit("report").alias("kind"), F.col("id").alias("ref"), kept))
    )


KEEP_DAYS = 7


@query("retention_expired", f"select job_id from jobs cross join nowt where created_at < now - interval {KEEP_DAYS} day")
def retention_expired(t):
    jobs = t.jobs()
    return J.expired(jobs, newest(jobs), KEEP_DAYS).select("job_id")


CTES["kept"] = f"select job_id, status from jobs cross join nowt where created_at >= now - interval {KEEP_DAYS} day"


@query(
    "retention_apply",
    f"""select 'job' as kind, job_id from kept union all select 'report', job_id from kept where status = 'COMPLETED'
        union all select 'deleted', cast(count(*) as varchar) from jobs cross join nowt where created_at < now - interval {KEEP_DAYS} day""",
)
def retention_apply(t):
    """Write the job table by day, apply retention in place, read back; reports follow by cascade."""
    jobs = t.jobs()
    path = shared_dir(t.spark, "jobs")
    now = newest(jobs)
    jobs.withColumn("created_date", F.to_date("created_at")).write.partitionBy("created_date").parquet(path)
    gone = J.expired(jobs, now, KEEP_DAYS)
    J.apply_retention(t.spark, path, now, KEEP_DAYS)
    left = t.spark.read.parquet(path)
    reports = J.without_jobs(reports_of(jobs), gone)
    return (
        left.select(F.lit("job").alias("kind"), "job_id")
        .unionByName(reports.select(F.lit("report").alias("kind"), "job_id"))
        .unionByName(gone.agg(F.count("*").cast("string").alias("job_id")).select(F.lit("deleted").alias("kind"), "job_id"))
    )


_HEADERS = ("Authorization", "COOKIE", "X-Api-Key", "accept", "set-cookie")


@query(
    "redact_event",
    """select event_id, concat('{"user":{"id":"', user_id, '","segment":', user_id % 7, '},"request":{"headers":{"Authorization":"[REDACTED]","COOKIE":"[REDACTED]",',
        '"X-Api-Key":"[REDACTED]","accept":"text/', event_type, '","set-cookie":"[REDACTED]"},"method":"GET"', case when event_id % 2 = 0 then ',"query_string":"[REDACTED]"' else '' end,
        ',"url":"https://x.example/', event_id, '"},"message":"', event_type, '","level":"error","tags":["', event_type, '"]}') as event_json from events""",
)
def redact_event(t):
    events = t.read("events")
    user = F.struct(
        F.col("user_id").cast("string").alias("id"), F.lit("10.0.0.1").alias("ip_address"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"), F.lit("name").alias("username"),
        (F.col("user_id") % 7).alias("segment"),
    )
    headers = [x for h in _HEADERS for x in (F.lit(h), F.concat(F.lit("text/"), "event_type"))]
    request = F.struct(
        F.concat(F.lit("https://x.example/"), F.col("event_id").cast("string")).alias("url"), F.lit("a=b").alias("cookies"),
        F.col("props").alias("data"), F.lit("GET").alias("method"), F.create_map(*headers).alias("headers"),
        F.when(F.col("event_id") % 2 == 0, F.lit("q=1")).alias("query_string"),
    )
    raw = F.to_json(F.struct(user.alias("user"), request.alias("request"), F.col("event_type").alias("message"), F.lit("error").alias("level"), F.array("event_type").alias("tags")))
    return events.select("event_id", redaction.redact_event(raw).alias("event_json"))


@query(
    "redact_fields",
    """select event_id, concat('{"req.headers":{"authorization":"[REDACTED]","cookie":"[REDACTED]","accept":"', event_type, '"},"res.headers":{"set-cookie":"[REDACTED]","cookie":"', event_type,
        '"},"user":{"password":"[REDACTED]","token":"[REDACTED]","apiKey":"[REDACTED]","name":"', event_type, '"}}') as record from events""",
)
def redact_fields(t):
    member = lambda *names: F.create_map(*[x for n in names for x in (F.lit(n), F.col("event_type"))])
    record = F.create_map(
        F.lit("req.headers"), member("authorization", "cookie", "accept"),
        F.lit("res.headers"), member("set-cookie", "cookie"),
        F.lit("user"), member("password", "token", "apiKey", "name"),
    )
    return t.read("events").select("event_id", F.to_json(redaction.redact_record(record)).alias("record"))
