"""Joins and look-ups that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The list of hot keys is a top-k, so its size is fixed and it may be broadcast.
HOT_KEYS = 64
SALTS = 32


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner", parts: int = 1024) -> DataFrame:
    """``rows`` joined with ``one``, which has at most one row per key; the rows of a key are dealt over up to ``parts`` parts by ``by``.

    The row of ``one`` is repeated only for the parts that are there, so a hot key is split whatever its share and others cost
    little; nothing is broadcast. ``rows`` is read twice, its keys and ``by`` only the first time.
    """
    salted = rows.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)))
    there = salted.select(*keys, "_part").distinct().join(one, keys)
    return salted.join(there, [*keys, "_part"], how).drop("_part")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, row_id: str, key_source: DataFrame) -> DataFrame:
    """Left join of many rows to one row per key; rows of the most frequent keys spread over salts.

    ``key_source`` is a frame with the join key column, from which the hot keys are counted: once and at once, as both sides need them.
    """
    counts = key_source.groupBy(key).agg(F.count("*").alias("_n"))
    # One row more than needed, as rows without a key may be among the most frequent; they are not left out before, since that
    # would work out the key a second time.
    top = counts.orderBy(F.desc("_n"), key).limit(HOT_KEYS + 1).collect()
    hot = F.col(key).isin(*[row[key] for row in top if row[key] is not None][:HOT_KEYS])
    # Rows without a key match nothing, but would otherwise meet in one task.
    salt = F.when(hot | F.col(key).isNull(), F.pmod(F.xxhash64(row_id), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    many, one = left.withColumn("_salt", salt), right.withColumn("_salt", F.explode(copies))
    return many.join(one, [key, "_salt"], "left").drop("_salt")


def latest_before(
    probes: DataFrame, facts: DataFrame, key: str, at: Column, fact_at: Column, value: Column, bucket_seconds: int = 60
) -> DataFrame:
    """For each probe the latest fact of its key at or before the probe's time, as ``latest`` (struct at, value).

    The time line is cut into buckets. A bucket needs only its own facts plus the newest fact of any
    earlier bucket, so facts shrink to one row per key and bucket before they are carried forward, and a
    key with a third of all rows is spread over as many groups as it has buckets. No pair of rows is formed.
    """
    width = F.lit(bucket_seconds)
    bucket = lambda t: F.floor(F.unix_micros(t) / F.lit(1_000_000) / width).cast("bigint")
    probe_rows = probes.withColumns({"_at": at, "_bucket": bucket(at), "_fact": F.lit(None).cast("struct<at:timestamp,value:string>")})
    fact_rows = facts.select(
        key, fact_at.alias("_at"), bucket(fact_at).alias("_bucket"),
        F.struct(fact_at.alias("at"), value.cast("string").alias("value")).alias("_fact"),
    )
    newest = fact_rows.groupBy(key, "_bucket").agg(F.max("_fact").alias("_fact"))
    touched = probe_rows.select(key, "_bucket").distinct().withColumn("_fact", F.lit(None).cast("struct<at:timestamp,value:string>"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        newest.unionByName(touched).groupBy(key, "_bucket").agg(F.max("_fact").alias("_fact"))
        .withColumn("_fact", F.max("_fact").over(earlier))
        .where(F.col("_fact").isNotNull())
    )
    line = (
        probe_rows.withColumn("_kind", F.lit(1))
        .unionByName(fact_rows.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
        .unionByName(carried.withColumn("_kind", F.lit(-1)), allowMissingColumns=True)
    )
    sofar = (
        Window.partitionBy(key, "_bucket")
        .orderBy(F.when(F.col("_kind") < 0, 0).otherwise(1), "_at", "_kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        line.withColumn("latest", F.max("_fact").over(sofar))
        .where(F.col("_kind") == 1)
        .drop("_at", "_bucket", "_fact", "_kind")
    )
