"""Keyed state and chained windows on streams against their batch twins, over reordered batches and restarts."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.operators import greedy, timelines
from pagegauge.session import shared_dir
from pagegauge.streaming import deadlines, dedupe, state, windows

T0 = 1_700_000_000_000


def arrive(spark, folder, rows, schema, files=1):
    frame = spark.createDataFrame(rows, f"{schema}, ms bigint").withColumn("at", F.timestamp_millis("ms")).drop("ms")
    frame.coalesce(1).write.mode("append").parquet(folder) if files == 1 else frame.repartition(files).write.mode("append").parquet(folder)


def reading(spark, folder, schema, per_batch=1):
    return spark.readStream.schema(f"{schema}, at timestamp").option("maxFilesPerTrigger", per_batch).parquet(folder)


def shuffled(rows, rng, by_ms):
    """Rows in an order in which none comes after one that is later by more than ``by_ms``."""
    return sorted(rows, key=lambda r: r[-1] + rng.random() * by_ms)


def test_dedupe_over_reordered_batches_and_restarts(spark):
    rng = random.Random(1)
    schema = "id bigint, key string"
    rows = [(i, f"k{rng.choice([0, 0, 0, 1, 2])}", T0 + int(rng.random() * 3_600_000)) for i in range(600)]
    rows += [(600 + i, key, ms) for i, (_, key, ms) in enumerate(rows[:30])]
    batch = spark.createDataFrame(rows, f"{schema}, ms bigint").withColumn("at", F.timestamp_millis("ms"))
    want = {(r["id"], r["accepted"]) for r in greedy.accept_requests(batch.drop("ms"), "key", F.col("at"), "id").collect()}
    order = shuffled(rows, rng, 400_000)
    order.append((None, None, T0 + 10_000_000))
    source, out, checkpoint = (shared_dir(spark, n) for n in ("source", "out", "ckpt"))
    third = len(order) // 3
    for part in (order[:third], order[third : 2 * third], order[2 * third :]):
        # Each call starts the query anew from its checkpoint.
        arrive(spark, source, part, schema)
        dedupe.dedupe_stream(reading(spark, source, schema), "key", "at", "id", out, checkpoint).awaitTermination()
    got = [(r["id"], r["accepted"]) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(want) and set(got) == want


def walk(times, window, last):
    out = []
    for t in sorted(times):
        if last is None or t > last + window:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("fan, chunk_ms, window", [(2, 1000, 700), (3, 50, 700), (32, 1000, 5000), (32, 10_000_000, 10)])
def test_hot_key_in_many_chunks(spark, fan, chunk_ms, window):
    """Chunks shorter and longer than the window, composed two by two and many by many."""
    rng = random.Random(fan)
    times = {"a": sorted({rng.randrange(400_000) for _ in range(3000)}), "b": [5, 6, 399_999], None: [1, 2, 300_000]}
    points = spark.createDataFrame([(k, T0 + t) for k, v in times.items() for t in v], "key string, ms bigint")
    seeds = spark.createDataFrame([("a", T0 - 20), ("c", T0)], "key string, ms bigint")
    got = greedy.accepted_times(points, "key", window, seeds, fan=fan, chunk_ms=chunk_ms).collect()
    last = {"a": -20}
    assert sorted((str(r["key"]), r["ms"] - T0) for r in got) == sorted((str(k), t) for k, v in times.items() for t in walk(v, window, last.get(k)))
    assert greedy.accepted_times(points.where("false"), "key", window).count() == 0


def test_no_group_is_larger_than_the_fan(spark, monkeypatch):
    sizes = []
    kept = greedy.written

    def measure(df, name):
        out = kept(df, name)
        if name == "chunk-groups":
            sizes.append(out.agg(F.max(F.size("children"))).first()[0])
        return out

    monkeypatch.setattr(greedy, "written", measure)
    points = spark.range(20_000).select(F.lit("hot").alias("key"), (F.col("id") * 997 + T0).alias("ms"))
    got = [r["ms"] for r in greedy.accepted_times(points, "key", 60_000, fan=2, chunk_ms=4000).collect()]
    assert sorted(got) == walk([997 * i + T0 for i in range(20_000)], 60_000, None)
    assert len(sizes) >= 12 and max(sizes) == 2


def test_composed_step_functions():
    rng = np.random.default_rng(1)
    for _ in range(200):
        first, second = np.sort(rng.choice(500, 12, replace=False)), 500 + np.sort(rng.choice(500, 12, replace=False))
        f, g = greedy._steps(first, 0, 120), greedy._steps(second, 500, 120)
        whole = greedy._composed(f, g)
        lasts = np.arange(-400, 0)
        assert (greedy._after(*whole, lasts) == greedy._after(*g, greedy._after(*f, lasts))).all()


def deadline_rows(rng):
    """Reports of jobs that stall, go on, end and stay open; and one report that is too late to count."""
    rows = []
    for job in range(40):
        at, value = T0 + rng.randrange(1_800_000), 0
        for _ in range(rng.randint(1, 6)):
            rows.append((f"j{job}", value, False, at))
            at += rng.choice([5_000, 20_000, 59_999, 60_000, 60_001, 61_000, 95_000, 200_000])
            value += rng.choice([0, 10])
        if rng.random() < 0.5:
            rows.append((f"j{job}", 100, True, at))
            rows.append((f"j{job}", 100, False, at + 70_000))
    return rows


@pytest.mark.parametrize("rule, by_value, limit", [(deadlines.stalled, True, C.STALL_SECONDS), (deadlines.overrun, False, C.JOB_TIMEOUT_SECONDS)])
def test_deadlines_over_reordered_batches_late_rows_and_a_restart(spark, rule, by_value, limit):
    rng = random.Random(limit)
    schema = "job_id string, value int, done boolean"
    rows = deadline_rows(rng)
    order = shuffled(rows, rng, 400_000)
    third = len(order) // 3
    parts = [order[:third], order[third : 2 * third], order[2 * third :], [("late", 1, False, T0), (None, None, None, T0 + 20_000_000)]]
    source, out, checkpoint = (shared_dir(spark, n) for n in ("source", "out", "ckpt"))
    for part in parts:
        arrive(spark, source, part, schema)
        deadlines.alert_stream(rule(reading(spark, source, schema)), out, checkpoint).awaitTermination()
    want = set()
    for job in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == job), key=lambda r: r[3])
        ends = next((r[3] for r in own if r[2]), None)
        own = [r for r in own if not r[2] and (ends is None or r[3] < ends)]
        value, since = None, None
        for _, v, _, at in [*own, (None, object(), None, ends or T0 + 19_400_000)]:
            last = not isinstance(v, int)
            if since is None:
                value, since = v, at
            elif last or (by_value and v != value):
                if at - since > limit * 1000:
                    want.add((job, value, since * 1000))
                value, since = v, at
    got = [(r["job_id"], r["value"], r["since_us"]) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_rolling_hours_over_reordered_batches_and_a_restart(spark):
    rng = random.Random(8)
    schema = "status string"
    rows = [(rng.choice(C.JOB_STATUSES), T0 + rng.randrange(4 * 3_600_000)) for _ in range(300)]
    order = shuffled(rows, rng, 500_000) + [("PENDING", T0 + 30_000_000)]
    source, out, checkpoint = (shared_dir(spark, n) for n in ("source", "out", "ckpt"))
    for part in (order[:100], order[100:200], order[200:]):
        arrive(spark, source, part, schema)
        windows.append_rows(windows.rolling_hours(reading(spark, source, schema), "at"), out, checkpoint).awaitTermination()
    jobs = spark.createDataFrame(rows, "status string, ms bigint").withColumn("at", F.timestamp_millis("ms"))
    want = timelines.rolling_hour(timelines.minute_counts(jobs, F.col("at")))
    got = spark.read.parquet(out)
    names = ["minute", *[s.lower() for s in C.JOB_STATUSES]]
    assert sorted(got.select(names).collect()) == sorted(want.select(names).collect())


def test_state_of_finished_keys_is_gone(spark):
    """After the watermark has passed everything, no request waits and no acceptance is kept."""
    schema = "id bigint, key string"
    source, out, checkpoint = (shared_dir(spark, n) for n in ("source", "out", "ckpt"))
    arrive(spark, source, [(i, f"k{i % 50}", T0 + 1000 * i) for i in range(200)], schema)
    arrive(spark, source, [(None, None, T0 + 5_000_000)], schema)
    arrive(spark, source, [(None, None, T0 + 9_000_000)], schema)
    stream = dedupe.dedupe_stream(reading(spark, source, schema), "key", "at", "id", out, checkpoint)
    stream.awaitTermination()
    assert spark.read.parquet(out).count() == 200
    assert stream.lastProgress["stateOperators"][0]["numRowsTotal"] == 0


@pytest.mark.parametrize("rule", [deadlines.stalled, deadlines.overrun])
def test_state_of_deadlines_is_kept_by_group_not_by_job(spark, monkeypatch, rule):
    """Values in the state store, as calls to it, are bounded by the groups, however many jobs stand or wait."""
    monkeypatch.setattr(deadlines, "BUCKETS", 8)
    schema = "job_id string, value int, done boolean"
    source, out, checkpoint = (shared_dir(spark, n) for n in ("source", "out", "ckpt"))
    arrive(spark, source, [(f"j{i}", 1, False, T0 + i) for i in range(3000)], schema)
    arrive(spark, source, [(None, None, None, T0 + 5_000_000)], schema)
    arrive(spark, source, [(f"w{i}", 1, False, T0 + 5_000_000 + i) for i in range(3000)], schema)
    stream = deadlines.alert_stream(rule(reading(spark, source, schema)), out, checkpoint)
    stream.awaitTermination()
    got = [(r["job_id"], r["value"], r["since_us"]) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted((f"j{i}", 1, (T0 + i) * 1000) for i in range(3000))
    # Jobs and reports of a group are one packed value each, next to the timers.
    assert 0 < stream.lastProgress["stateOperators"][0]["numRowsTotal"] <= 100


def test_deadlines_of_many_jobs_at_once_are_those_of_each_job():
    """Stretches, ends, raised alerts and what stands afterwards, for jobs worked out together and one by one."""
    rng = random.Random(5)
    limit, passed = 60, 500
    empty = {"job_id": [], "at_us": [], "done": [], "value": []}
    for by_value in (True, False):
        stood = pd.DataFrame([(f"j{i}", -rng.randrange(90), rng.randrange(2), rng.random() < 0.5, i % 5 == 0) for i in range(0, 60, 2)], columns=["job_id", "since_us", "value", "raised", "ended"])
        due = pd.DataFrame([(f"j{rng.randrange(70)}", rng.randrange(400), rng.random() < 0.1, rng.randrange(2)) for _ in range(400)], columns=list(empty))
        alerts, now = deadlines.decided(stood, due, passed, limit, by_value)
        one_alerts, one_now = [], []
        for job in {*stood["job_id"], *due["job_id"]}:
            since, value, raised, ended = next(iter(stood[stood["job_id"] == job].drop(columns="job_id").itertuples(index=False)), (None, None, False, False))
            reports = [] if ended else sorted(due[due["job_id"] == job][["at_us", "done", "value"]].itertuples(index=False, name=None))
            for at, done, v in [*reports, (passed, None, None)]:
                if since is not None and not ended and (done is not False or (by_value and v != value)):
                    if at - since > limit and not raised:
                        one_alerts.append((job, value, since))
                        raised = done is None
                    since, value, raised = (since, value, raised or at - since > limit) if done is None else (at, v, False)
                elif since is None and done is not None:
                    since, value = at, v
                if done:
                    since, value, raised, ended = at, 0, False, True
                    break
            one_now.append((job, since, value, raised, ended))
        assert sorted(alerts.itertuples(index=False, name=None)) == sorted(one_alerts) and one_alerts
        assert sorted(now.itertuples(index=False, name=None)) == sorted(one_now)
        assert len(deadlines.decided(now.iloc[:0], due.iloc[:0], passed, limit, by_value)[1]) == 0


def test_waiting_requests_of_a_busy_key_are_few_values(spark):
    schema = "id bigint, key string"
    source, out, checkpoint = (shared_dir(spark, n) for n in ("source", "out", "ckpt"))
    arrive(spark, source, [(20_000 - i, "hot", T0 + i // 2 * 20) for i in range(20_000)], schema)
    stream = dedupe.dedupe_stream(reading(spark, source, schema), "key", "at", "id", out, checkpoint)
    stream.awaitTermination()
    assert stream.lastProgress["stateOperators"][0]["numRowsTotal"] <= 20
    arrive(spark, source, [(None, None, T0 + 5_000_000)], schema)
    dedupe.dedupe_stream(reading(spark, source, schema), "key", "at", "id", out, checkpoint).awaitTermination()
    got = spark.read.parquet(out).collect()
    # Of two requests of one time the smaller id is accepted, a window and a step after the last.
    assert len(got) == 20_000
    assert sorted(r["id"] for r in got if r["accepted"]) == sorted(20_000 - (2 * i + 1) for i in range(0, 10_000, 3001))


def test_a_busy_key_is_taken_in_by_many_groups(spark):
    """Requests of one key wait in as many groups as there are lanes, in one value each, and are decided as by the batch twin."""
    schema = "id bigint, key string"
    source, out, checkpoint = (shared_dir(spark, n) for n in ("source", "out", "ckpt"))
    rows = [(i, "hot", T0 + i * 7_000) for i in range(6000)]
    arrive(spark, source, rows, schema)
    arrive(spark, source, [(None, None, T0 + 90_000_000)], schema)
    arrive(spark, source, [(None, None, T0 + 95_000_000)], schema)
    stream = dedupe.dedupe_stream(reading(spark, source, schema), "key", "at", "id", out, checkpoint)
    stream.awaitTermination()
    waiting = max(op["numRowsTotal"] for op in stream.recentProgress[0]["stateOperators"])
    assert dedupe.LANES <= waiting <= 2 * dedupe.LANES
    assert all(op["numRowsTotal"] == 0 for op in stream.lastProgress["stateOperators"])
    got = [(r["id"], r["accepted"]) for r in spark.read.parquet(out).collect()]
    accepted = set(walk([ms for *_, ms in rows], 60_000, None))
    assert sorted(got) == [(i, ms in accepted) for i, _, ms in rows]


@pytest.mark.parametrize("pool_rows", [1, 30, 400, 10**6])
@pytest.mark.parametrize("id_type", [pa.int64(), pa.string()])
def test_decisions_do_not_hang_on_the_packs(pool_rows, id_type):
    """Packs that overlap, come in any order and over two batches, of many keys and one hot one, against a walk over each key."""
    rng = random.Random(pool_rows)
    schema = pa.schema([("key", pa.string()), ("ms", pa.int64()), ("id", id_type)])
    rows = [(rng.choice(["hot", "hot", f"k{rng.randrange(60)}"]), rng.randrange(40_000), i if id_type == pa.int64() else f"{i * 7919 % 3001:x}") for i in range(3000)]
    rows += [(key, ms, f"x{i}" if isinstance(i, str) else i + 3000) for key, ms, i in rows[:200]]
    got, last = [], {}
    for low, high in ((0, 17_000), (17_000, 40_000)):
        part = [r for r in rows if low <= r[1] < high]
        packs = []
        for lane in range(5):
            own = sorted((r for r in part if r[1] // 500 % 5 == lane), key=lambda r: r[1])
            for start in range(0, len(own), 37):
                piece = own[start : start + 37]
                table = pa.table([list(column) for column in zip(*piece, strict=True)], schema=schema)
                packs += [(piece[0][1], pack) for (pack,) in state.packed(table)]
        rng.shuffle(packs)
        for table in dedupe.decided(packs, last, 700, schema, pool_rows):
            got += [(r["key"], r["ms"], r["id"], r["accepted"]) for r in table.to_pylist()]
    want, ends = [], {}
    for key in {r[0] for r in rows}:
        own = [(ms, i) for k, ms, i in rows if k == key]
        times = walk({ms for ms, _ in own}, 700, None)
        ends[key] = times[-1]
        firsts = {(ms, min(i for at, i in own if at == ms)) for ms in times}
        want += [(key, ms, i, (ms, i) in firsts) for ms, i in own]
    assert sorted(got) == sorted(want) and last == ends


def test_late_requests_are_dropped_and_long_ids_kept(spark):
    """A request at the watermark of the batches before is late, one after it is not; a missing id leaves the others as they are."""
    schema = "id bigint, key string"
    big = 2**53
    source, out, checkpoint = (shared_dir(spark, n) for n in ("source", "out", "ckpt"))
    parts = [
        [(big + 1, "a", T0), (None, "a", T0 + 1), (big + 3, None, T0 + 2), (big + 5, "b", T0 + 3)],
        [(1, "a", T0 + 1_000_000)],
        [(2, "a", T0 + 400_000), (3, "a", T0 + 400_001), (4, "c", T0 + 400_000), (5, "c", T0 + 400_002), (6, "a", T0 + 1)],
        [(None, None, T0 + 5_000_000)],
    ]
    for part in parts:
        arrive(spark, source, part, schema)
        dedupe.dedupe_stream(reading(spark, source, schema), "key", "at", "id", out, checkpoint).awaitTermination()
    got = {(r["id"], r["key"], r["accepted"]) for r in spark.read.parquet(out).collect()}
    assert got == {(big + 1, "a", True), (big + 5, "b", True), (1, "a", True), (3, "a", True), (5, "c", True)}


def test_keys_may_be_numbers(spark):
    schema = "id string, key bigint"
    source, out, checkpoint = (shared_dir(spark, n) for n in ("source", "out", "ckpt"))
    arrive(spark, source, [("p", 2**53 + 1, T0), ("q", 2**53 + 1, T0 + 60_000), ("r", 2**53, T0 + 60_000), ("s", None, T0), (None, 1, T0 + 5_000_000)], schema)
    dedupe.dedupe_stream(reading(spark, source, schema), "key", "at", "id", out, checkpoint).awaitTermination()
    got = spark.read.parquet(out)
    assert got.dtypes == [("key", "bigint"), ("id", "string"), ("ms", "bigint"), ("accepted", "boolean")]
    assert {tuple(r) for r in got.drop("ms").collect()} == {(2**53 + 1, "p", True), (2**53 + 1, "q", False), (2**53, "r", True)}


def test_partitions_of_state_are_bounded_while_a_stream_starts(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with state.on_rocksdb(spark, 3):
        assert spark.conf.get(name) == str(min(3, int(before)))
    with state.on_rocksdb(spark, 10_000):
        assert spark.conf.get(name) == before
    assert spark.conf.get(name) == before
