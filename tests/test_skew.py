"""Hot keys: the split forms must equal brute force."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from pagegauge.operators import greedy, jobs, skew, timelines

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def requests(seed, n, span_seconds):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["warm", "cold", "rare"]
    rows = [(i, rng.choice(keys), START + timedelta(milliseconds=rng.randrange(span_seconds * 1000))) for i in range(n)]
    # Equal times, and a dense burst without any pause.
    rows += [(n + i, "hot", START + timedelta(seconds=100, milliseconds=i // 2 * 7)) for i in range(300)]
    return rows


def brute_accept(rows, seconds):
    last, accepted = {}, set()
    for i, key, at in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if key not in last or at - last[key] > timedelta(seconds=seconds):
            last[key] = at
            accepted.add(i)
    return accepted


def test_greedy_acceptance(spark):
    for seed, n, span in ((1, 500, 3600), (2, 2000, 7200), (3, 50, 40000)):
        rows = requests(seed, n, span)
        df = spark.createDataFrame(rows, "id long, key string, at timestamp").repartition(5)
        got = {r["id"] for r in greedy.accept_requests(df, "key", F.col("at"), "id").where("accepted").collect()}
        assert got == brute_accept(rows, 60)


def test_greedy_acceptance_continues_from_seeds(spark):
    rows = requests(4, 400, 3000)
    cut = START + timedelta(seconds=1200)
    early, late = [r for r in rows if r[2] < cut], [r for r in rows if r[2] >= cut]
    frame = lambda part: spark.createDataFrame(part, "id long, key string, at timestamp")
    first = greedy.accept_requests(frame(early), "key", F.col("at"), "id").where("accepted")
    seeds = first.groupBy("key").agg(F.max(F.unix_millis("at")).alias("ms"))
    second = greedy.accept_requests(frame(late), "key", F.col("at"), "id", seeds=seeds).where("accepted")
    assert {r["id"] for r in first.collect()} | {r["id"] for r in second.collect()} == brute_accept(rows, 60)


def test_steps_of_a_chunk():
    times = np.array([0, 10, 65, 130, 131]) * 1000
    below, after = greedy._steps(times, 0, 60_000)
    for last in range(-120_000, 0, 500):
        at, end = last, last
        for t in times:
            if t - at > 60_000:
                at = end = t
        step = np.searchsorted(below, last, side="right")
        assert (after[step] if step < len(after) else last) == end


def test_latest_before(spark):
    rng = random.Random(5)
    probes = [(i, rng.choice(["hot", "hot", "b", "none"]), START + timedelta(seconds=rng.randrange(4000))) for i in range(300)]
    facts = [(i, rng.choice(["hot", "hot", "b", "c"]), START + timedelta(seconds=rng.randrange(4000))) for i in range(120)]
    p = spark.createDataFrame(probes, "id long, key string, at timestamp")
    f = spark.createDataFrame(facts, "job long, key string, made timestamp")
    found = skew.latest_before(p, f, "key", F.col("at"), F.col("made"), F.col("job"))
    got = {r["id"]: (r["latest"]["value"] if r["latest"] else None) for r in found.collect()}
    for i, key, at in probes:
        best = max(((m, str(j)) for j, k, m in facts if k == key and m <= at), default=None)
        assert got[i] == (best[1] if best else None)


def test_salted_join_keeps_every_row(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") * 2).alias("v")).union(spark.sql("select 'hot', -1L"))
    got = skew.salted_left_join(left, right, "k", "id", left)
    assert got.count() == 5000
    assert got.where("k = 'hot' and v != -1").count() == 0 and got.where("k is null and v is not null").count() == 0
    assert got.where("k is not null and k != 'hot' and v != 2 * id").count() == 0


def test_hot_keys_are_counted_once(spark):
    """Counting works out the join key of every row, so it must not be done for either side, nor again to leave out rows without one."""
    worked_out = spark.sparkContext.accumulator(0)

    def key(i):
        worked_out.add(1)
        return None if i % 5 == 0 else "hot" if i % 2 else str(i)

    ids = spark.range(300)
    left = ids.select("id", F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 2 == 1, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    source = ids.select(F.udf(key, "string")("id").alias("k"))
    right = ids.select(F.col("id").cast("string").alias("k"), "id").withColumnRenamed("id", "v").union(spark.sql("select 'hot', -1L"))
    rows = skew.salted_left_join(left, right, "k", "id", source).collect()
    assert worked_out.value == 300
    assert {r["id"]: r["v"] for r in rows} == {i: None if i % 5 == 0 else -1 if i % 2 else i for i in range(300)} and len(rows) == 300


def test_exact_percentiles(spark):
    rng = random.Random(6)
    data = [rng.choice([rng.random() * 9000, 1500.0, 1500.0]) for _ in range(777)]
    df = spark.createDataFrame([(x,) for x in data], "v double")
    row = jobs.exact_percentiles(df, "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    want = np.percentile(data, [50, 95, 99])
    assert row["n"] == 777 and np.allclose([row["p50"], row["p95"], row["p99"]], want, rtol=1e-12)
    none = jobs.exact_percentiles(df.where("v < 0"), "v", {"p50": 0.5}).first()
    assert none["n"] == 0 and none["p50"] is None


def test_requests_over_the_limit(spark):
    rows = requests(7, 800, 5000)
    df = spark.createDataFrame(rows, "id long, key string, at timestamp")
    got = {(r["id"], r["rank"]) for r in timelines.over_limit(df, "key", F.col("at"), "id", 20, "1 day").collect()}
    want = set()
    for key in {r[1] for r in rows}:
        ranked = sorted((r[2], r[0]) for r in rows if r[1] == key)
        want |= {(i, n + 1) for n, (_, i) in enumerate(ranked) if n >= 20}
    assert got == want
