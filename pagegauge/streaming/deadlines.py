"""Per-job deadlines on a progress stream: stalled and overrun jobs, by event-time timers on keyed state.

Reports wait until the watermark has passed them, so they count in the order of time whatever order they arrive in. The state
of a job is what still waits and the value it stands at; a job's reports are few, so no state grows with the stream. State and
timers are those of a group of jobs, told by a hash of the job, and all jobs of a group are worked out together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagegauge import constants as C
from pagegauge.streaming.state import on_rocksdb, packed, unpacked
from pagegauge.streaming.windows import LATENESS

ALERT = "job_id string, value int, since_us long"
_NONE = pd.DataFrame({"job_id": pd.Series([], dtype=object), "value": pd.Series([], dtype="int32"), "since_us": pd.Series([], dtype="int64")})
# What a job reports within this time of its end does not open it again; then its state is gone.
CLOSED_MS = 3_600_000


# Jobs are dealt over this many groups, so the calls to the state store grow with the groups of a batch, not with its jobs.
BUCKETS = 512

_WAITING = pa.schema([("job_id", pa.string()), ("at_us", pa.int64()), ("done", pa.bool_()), ("value", pa.int32())])
_STANDING = pa.schema([("job_id", pa.string()), ("since_us", pa.int64()), ("value", pa.int32()), ("raised", pa.bool_()), ("ended", pa.bool_())])


def decided(standing: pd.DataFrame, due: pd.DataFrame, passed: int, limit: int, by_value: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(alerts, standing) of many jobs once the watermark, ``passed``, has passed the reports that are ``due``.

    A job's stretches of equal value are told in the order of time; without ``by_value`` all its reports are one stretch. The
    first done report ends the last stretch and what comes after it does not count. A stretch that nothing has ended yet has
    lasted until the watermark. ``standing`` has the last stretch of each job, or the end of those that have ended.
    """
    ended = standing["ended"].to_numpy(bool)
    kept = standing[ended & (standing["since_us"].to_numpy() // 1000 + CLOSED_MS >= passed // 1000)]
    due = due[~due["job_id"].isin(standing["job_id"][ended])]
    before = standing[~ended]
    job, jobs = pd.factorize(np.concatenate([before["job_id"].to_numpy(object), due["job_id"].to_numpy(object)]))
    at = np.concatenate([before["since_us"].to_numpy("int64"), due["at_us"].to_numpy("int64")])
    value = np.concatenate([before["value"].to_numpy("int32"), due["value"].to_numpy("int32")])
    done = np.concatenate([np.zeros(len(before), bool), due["done"].to_numpy(bool)])
    raised = np.concatenate([before["raised"].to_numpy(bool), np.zeros(len(due), bool)])
    order = np.lexsort((value, done, at, np.arange(len(at)) >= len(before), job))
    job, at, value, done, raised = (column[order] for column in (job, at, value, done, raised))

    first = np.flatnonzero(np.diff(job, prepend=-1))
    count = np.cumsum(done)
    seen = count - np.repeat(count[first] - done[first], np.diff(np.append(first, len(job))))
    end, has_end = np.zeros(len(jobs), "int64"), np.zeros(len(jobs), bool)
    last = done & (seen == 1)
    end[job[last]], has_end[job[last]] = at[last], True

    live = seen == 0
    job, at, value, raised = (column[live] for column in (job, at, value, raised))
    changes = np.diff(job, prepend=-1) != 0
    if by_value:
        changes[1:] |= value[1:] != value[:-1]
    job, starts, value, raised = (column[changes] for column in (job, at, value, raised))
    final = np.diff(job, append=len(jobs)) != 0
    ends = np.where(final, np.where(has_end[job], end[job], passed), np.append(starts[1:], 0)[: len(starts)])
    too_long = ends - starts > limit

    fresh = too_long & ~raised
    alerts = pd.DataFrame({"job_id": pd.Series(jobs[job[fresh]], dtype=object), "value": value[fresh].astype("int32"), "since_us": starts[fresh]})
    on = final & ~has_end[job]
    now = [
        kept,
        pd.DataFrame({"job_id": jobs[job[on]], "since_us": starts[on], "value": value[on], "raised": too_long[on], "ended": False}),
        pd.DataFrame({"job_id": jobs[has_end], "since_us": end[has_end], "value": np.int32(0), "raised": False, "ended": True}),
    ]
    return alerts, pd.concat([part for part in now if len(part)] or [kept], ignore_index=True)


class _Deadline(StatefulProcessor):
    """The jobs of one group: reports that wait, and the stretch or end each job stands at."""

    def __init__(self, seconds: int, by_value: bool):
        self.limit, self.by_value = seconds * 1_000_000, by_value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "reports binary")
        self.standing = handle.getListState("standing", "jobs binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for pdf in rows:
            # Rows without a job only move the clock.
            pdf = pdf[pdf["at_us"].notna() & pdf["job_id"].notna()]
            if len(pdf):
                at = pdf["at_us"].astype("int64")
                reports = pd.DataFrame({
                    "job_id": pdf["job_id"], "at_us": at, "done": pdf["done"].fillna(False).astype(bool), "value": pdf["value"].fillna(0).astype("int32"),
                })
                self.waiting.appendList(packed(pa.Table.from_pandas(reports, _WAITING, preserve_index=False)))
                first = -(-int(at.min()) // 1000)
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(earliest)
        yield _NONE

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = unpacked(self.waiting.get(), _WAITING)
        late = pc.greater(waiting["at_us"], passed)
        due, rest = waiting.filter(pc.invert(late)), waiting.filter(late)
        alerts, standing = decided(unpacked(self.standing.get(), _STANDING).to_pandas(), due.to_pandas(), passed, self.limit, self.by_value)
        if due.num_rows:
            self._keep(self.waiting, rest)
        self._keep(self.standing, pa.Table.from_pandas(standing, _STANDING, preserve_index=False))
        since, ended = standing["since_us"].to_numpy("int64"), standing["ended"].to_numpy(bool)
        following = np.concatenate([
            -(-rest["at_us"].to_numpy() // 1000), (since[~ended & ~standing["raised"].to_numpy(bool)] + self.limit) // 1000 + 1, since[ended] // 1000 + CLOSED_MS + 1,
        ])
        if len(following):
            self.handle.registerTimer(int(following.min()))
        yield alerts

    def _keep(self, state, rows: pa.Table) -> None:
        if rows.num_rows:
            state.put(packed(rows))
        else:
            state.clear()


def _watched(progress: DataFrame, seconds: int, by_value: bool) -> DataFrame:
    """``progress`` has job_id, at (event time), value and done."""
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = progress.withWatermark("at", LATENESS).select(bucket, "job_id", "at", F.unix_micros("at").alias("at_us"), "value", "done")
    return rows.groupBy("bucket").transformWithStateInPandas(_Deadline(seconds, by_value), ALERT, "append", "eventTime")


def stalled(progress: DataFrame) -> DataFrame:
    """One row per progress value that stood still for more than 60 s."""
    return _watched(progress, C.STALL_SECONDS, by_value=True)


def overrun(progress: DataFrame) -> DataFrame:
    """One row per job that ran for more than 90 s from its first report."""
    return _watched(progress, C.JOB_TIMEOUT_SECONDS, by_value=False)


def alert_stream(alerts: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append alerts to the table in ``out``; the default trigger reads what is there and stops."""
    with on_rocksdb(alerts.sparkSession):
        return (
            alerts.writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )
