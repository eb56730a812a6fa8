"""In-flight de-duplication of a request stream: keyed state, decided in the order of time.

Two keyed states follow each other, so a busy key is not one task's work. Requests wait in lanes, told by the bucket of their key and
the stretch of time they lie in; what the watermark has passed leaves its lane sorted and packed, thousands of requests a row. Then the
buckets decide the packs in the order of time and pass them on packed; all tasks unpack the decisions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import NumericType

from pagegauge import constants as C
from pagegauge.streaming.state import on_rocksdb, packed, unpacked

# Requests may arrive this much later than the newest one seen.
LATENESS_SECONDS = 600

# Keys are dealt over so many buckets, and the stretches of time in turn over so many lanes of a bucket, so the calls to the state
# store grow with the lanes of a batch, and the requests of one key are taken in by many tasks.
BUCKETS, LANES = 64, 64
STRETCH_MS = 10 * 60 * 1000

# A pack that leaves a lane holds whole stretches of so many requests together, or a part of one; so many requests are decided at once.
PIECE_ROWS, POOL_ROWS = 2_000, 100_000

# State lies in no more partitions than twice the cores, or these.
LEAST_PARTITIONS = 32

NEVER = -(2**62)


def accepted_of(times: np.ndarray, last: int, window: int) -> np.ndarray:
    """Which of the sorted times are accepted after the acceptance ``last``."""
    accepted = np.zeros(len(times), dtype=bool)
    at = int(np.searchsorted(times, last + window, side="right"))
    while at < len(times):
        accepted[at] = True
        at = int(np.searchsorted(times, times[at] + window, side="right"))
    return accepted


def _accepted(due: pa.Table, last: dict, window: int) -> pa.Table:
    """The requests by key and time, with ``accepted``; ``last``, the acceptance of each key before them, becomes that after them."""
    keys = pa.concat_arrays(due["key"].chunks).dictionary_encode()
    due = due.append_column("of", keys.indices).sort_by([("of", "ascending"), ("ms", "ascending"), ("id", "ascending")])
    of, times, names = due["of"].to_numpy(), due["ms"].to_numpy(), keys.dictionary.to_pylist()
    before = np.array([last.get(name, NEVER) for name in names], dtype="int64")
    first = np.flatnonzero(np.diff(of, prepend=-1))
    ends = np.append(first[1:], len(of))
    # Keys with one request are decided at once, the others by a walk over their acceptances.
    accepted = np.zeros(len(of), dtype=bool)
    accepted[first] = times[first] > before + window
    for k in np.flatnonzero(ends - first > 1):
        accepted[first[k] : ends[k]] = accepted_of(times[first[k] : ends[k]], int(before[k]), window)
    last.update((names[k], ms) for k, ms in zip(of[accepted].tolist(), times[accepted].tolist(), strict=True))
    return due.drop_columns(["of"]).append_column("accepted", pa.array(accepted))


def decided(packs: Iterable[tuple[int, bytes]], last: dict, window: int, schema: pa.Schema, pool_rows: int = POOL_ROWS) -> Iterator[pa.Table]:
    """The requests of packs, (first time, packed requests), with ``accepted``, stretch by stretch in the order of time.

    Packs are opened in the order of their first times and what lies before the next one is decided, so few are open at once.
    ``last`` has the last acceptance of each key and is brought up to date.
    """
    packs = sorted(packs, key=lambda pack: pack[0])
    opened, rows, enough = [], 0, pool_rows
    for i, (_, pack) in enumerate(packs, 1):
        opened.append(unpacked([(pack,)], schema))
        rows += opened[-1].num_rows
        if rows < enough and i < len(packs):
            continue
        due = pa.concat_tables(opened)
        opened = []
        if i < len(packs):
            early = pc.less(due["ms"], packs[i][0])
            opened, due = [due.filter(pc.invert(early))], due.filter(early)
        rows = sum(table.num_rows for table in opened)
        enough = max(pool_rows, 2 * rows)
        if due.num_rows:
            yield _accepted(due, last, window)


class _Lane(StatefulProcessor):
    """Requests of one lane wait until the watermark has passed them; then they leave in packs, sorted by time.

    The state is what still waits, bounded by the lateness, in packed values that are added in one call a batch: each call reads what is there.
    """

    def __init__(self, schema: pa.Schema, lanes: int, stretch_ms: int, piece_rows: int):
        self.schema, self.lanes, self.stretch_ms, self.piece_rows = schema, lanes, stretch_ms, piece_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "requests binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows without a key, a time or an id only move the clock; a filter would be pushed below the watermark and hide them from it.
        if key[0] >= 0:
            come = pa.concat_tables([pa.Table.from_pandas(pdf[self.schema.names], self.schema, preserve_index=False) for pdf in rows])
            self.waiting.appendList(packed(come))
            self.handle.registerTimer(pc.min(come["ms"]).as_py())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = unpacked(self.waiting.get(), self.schema)
        late = pc.greater(waiting["ms"], passed)
        due, rest = waiting.filter(pc.invert(late)), waiting.filter(late)
        if not due.num_rows:
            return
        if rest.num_rows:
            self.waiting.put(packed(rest))
            self.handle.registerTimer(pc.min(rest["ms"]).as_py())
        else:
            self.waiting.clear()
        due = due.sort_by("ms")
        times = due["ms"].to_numpy()
        # A pack is passed on as of the watermark: what it holds is older.
        at, start, packs = pd.Timestamp(passed + 1, unit="ms", tz="UTC"), 0, []
        for end in np.append(np.flatnonzero(np.diff(times // self.stretch_ms)) + 1, len(times)).tolist():
            if end - start >= self.piece_rows or end == len(times):
                packs += packed(due.slice(start, end - start))
                start = end
        firsts = [unpacked([pack], self.schema)["ms"][0].as_py() for pack in packs]
        yield pd.DataFrame({"bucket": np.int32(key[0] // self.lanes), "first": firsts, "requests": [pack for (pack,) in packs], "at": at})


class _Acceptance(StatefulProcessor):
    """Decides the packs of one bucket of keys, which come in the order of time from batch to batch.

    The state is the last acceptance of each key; a timer clears it when it can decide nothing any more.
    """

    def __init__(self, schema: pa.Schema, window_ms: int, pool_rows: int):
        self.schema, self.window_ms, self.pool_rows = schema, window_ms, pool_rows
        self.kept = pa.schema([schema.field("key"), schema.field("ms")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", "acceptances binary")

    def _read(self) -> dict:
        kept = unpacked(self.last.get(), self.kept)
        return dict(zip(kept["key"].to_pylist(), kept["ms"].to_pylist(), strict=True))

    def _keep(self, last: dict, passed: int) -> None:
        last = {key: ms for key, ms in last.items() if ms + self.window_ms >= passed}
        if last:
            self.last.put(packed(pa.table([list(last), list(last.values())], schema=self.kept)))
            self.handle.registerTimer(min(last.values()) + self.window_ms + 1)
        else:
            self.last.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        packs = [pack for pdf in rows for pack in zip(pdf["first"].tolist(), pdf["requests"], strict=True)]
        last = self._read()
        for n, table in enumerate(decided(packs, last, self.window_ms, self.schema, self.pool_rows)):
            out = [pack for (pack,) in packed(table)]
            yield pd.DataFrame({"bucket": np.int32(key[0]), "pool": np.int32(n), "part": np.arange(len(out), dtype="int32"), "decisions": out})
        self._keep(last, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._read(), timerValues.getCurrentWatermarkInMs())
        yield from ()


def _unpack(schema: pa.Schema):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.column("decisions"):
                yield from unpacked([(pack.as_py(),)], schema).to_batches()

    return unpack


def decisions(requests: DataFrame, key: str, at: str, row_id: str, seconds: int = C.INFLIGHT_SECONDS, lateness_seconds: int = LATENESS_SECONDS) -> DataFrame:
    """Streaming (key, row_id, ms, accepted): the same decisions as operators.greedy, whatever order requests arrive in.

    A request is decided once the watermark, the newest time less the lateness, has passed it; later ones than that are
    dropped. Of requests of one key and millisecond the smallest ``row_id`` can be accepted. Requests without a key, a time or an id are not decided.
    """
    types = {c: requests.schema[c].dataType for c in (key, row_id)}
    if types[row_id].simpleString() not in ("bigint", "string"):
        raise ValueError(f"{row_id} must be bigint or string")

    def given(name: str) -> Column:
        # Whole numbers next to a missing one would arrive as doubles; rows that miss one are in a lane of their own.
        return F.coalesce(name, F.lit(0).cast(types[name])) if isinstance(types[name], NumericType) else F.col(name)

    ms = F.coalesce(F.unix_millis(at), F.lit(0))
    known = F.col(key).isNotNull() & F.col(row_id).isNotNull() & F.col(at).isNotNull()
    lane = F.pmod(F.xxhash64(key), F.lit(BUCKETS)) * LANES + F.pmod(F.floor(ms / STRETCH_MS), F.lit(LANES))
    timed = requests.withWatermark(at, f"{lateness_seconds} seconds")
    rows = timed.select(
        F.when(known, lane).otherwise(-1 - F.pmod(F.xxhash64(row_id, ms), F.lit(LANES))).cast("int").alias("lane"),
        given(key).alias("key"), given(row_id).alias("id"), ms.alias("ms"), at,
    )
    schema = pa.schema([("key", to_arrow_type(types[key])), ("ms", pa.int64()), ("id", to_arrow_type(types[row_id]))])
    passed = rows.groupBy("lane").transformWithStateInPandas(
        _Lane(schema, LANES, STRETCH_MS, PIECE_ROWS), "bucket int, first bigint, requests binary, at timestamp", "append", "eventTime", eventTimeColumnName="at"
    )
    packs = passed.groupBy("bucket").transformWithStateInPandas(
        _Acceptance(schema, seconds * 1000, POOL_ROWS), "bucket int, pool int, part int, decisions binary", "append", "eventTime"
    )
    out = f"key {types[key].simpleString()}, ms bigint, id {types[row_id].simpleString()}, accepted boolean"
    rows = packs.repartition("bucket", "pool", "part").mapInArrow(_unpack(schema.append(pa.field("accepted", pa.bool_()))), out)
    return rows.select(F.col("key").alias(key), F.col("id").alias(row_id), "ms", "accepted")


def dedupe_stream(
    requests: DataFrame, key: str, at: str, row_id: str, out: str, checkpoint: str, seconds: int = C.INFLIGHT_SECONDS, trigger: dict | None = None
) -> StreamingQuery:
    """Append the decisions to the table in ``out``; each is written once, also over restarts from the checkpoint.

    ``trigger`` are the arguments of the stream's trigger; the default reads what is there and stops.
    """
    spark = requests.sparkSession
    with on_rocksdb(spark, max(LEAST_PARTITIONS, 2 * spark.sparkContext.defaultParallelism)):
        return (
            decisions(requests, key, at, row_id, seconds).writeStream.outputMode("append").format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )
