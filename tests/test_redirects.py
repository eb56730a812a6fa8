"""Redirect walks by doubling against following each chain hop by hop."""

import random

from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.operators import fetching, skew


def refused(url):
    return "invalid-url" if url == "nowhere" else "blocked-host" if url.startswith("http://192.168.") else None


def follow(url, edges):
    reason, hops = refused(url), 0
    while reason is None and url in edges:
        hops += 1
        if hops > C.MAX_REDIRECTS:
            return url, hops, "too-many-redirects"
        url = edges[url]
        reason = refused(url)
    return url, hops, reason


def test_against_following_hop_by_hop(spark):
    rng = random.Random(3)
    urls = [f"http://h{i}.example/" for i in range(120)] + ["nowhere", "http://192.168.0.7/"]
    pairs = [(u, rng.choice(urls)) for u in urls[:100] for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    pairs += [(f"http://c{i}.example/", f"http://c{i + 1}.example/") for i in range(9)] + [("http://h0.example/", None)]
    edges = {}
    for a, b in pairs:
        if b is not None:
            edges[a] = min(b, edges.get(a, b))
    starts = [*urls, *(f"http://c{i}.example/" for i in range(11)), *urls[:40]]
    got = fetching.resolve_redirects(
        spark.createDataFrame(list(enumerate(starts)), "id bigint, url string"), spark.createDataFrame(pairs, "from_url string, to_url string")
    ).collect()
    assert sorted((r["id"], r["final_url"], r["hops"], r["reason"]) for r in got) == [(i, *follow(u, edges)) for i, u in enumerate(starts)]
    assert {r["hops"] for r in got} == set(range(7))
    none = fetching.resolve_redirects(spark.createDataFrame([(1, "http://a.example/")], "id bigint, url string"), spark.createDataFrame([], "from_url string, to_url string"))
    assert [tuple(r) for r in none.collect()] == [(1, "http://a.example/", "http://a.example/", 0, None)]


def test_chains_that_meet_leave_no_hot_task(spark):
    """Every start leads to one address; its rows are dealt over all parts before they are joined."""
    starts = spark.range(200_000).select(F.col("id"), F.lit("http://meet.example/").alias("url"))
    edges = spark.createDataFrame([("http://meet.example/", "http://on.example/"), ("http://on.example/", "http://end.example/")], "from_url string, to_url string")
    done = fetching.resolve_redirects(starts, edges)
    assert done.groupBy("final_url", "hops").count().collect() == [("http://end.example/", 2, 200_000)]
    spread = skew.spread_join(starts, edges.withColumnRenamed("from_url", "url"), ["url"], ["id"])
    assert spread.count() == 200_000
    sizes = starts.groupBy(F.pmod(F.xxhash64("id"), F.lit(1024))).count().agg(F.max("count")).first()[0]
    assert sizes < 400
