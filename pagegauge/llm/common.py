"""Tables in the shared folder, row numbers without a single task, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of the contracts: space and the five ASCII control characters.
WORD = r"[^\x20\x09-\x0D]+"
# Lower-cases A-Z and turns every other ASCII character but 0-9 and a-z into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CACHE = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares; a temporary one only for a local master without it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return f"{configured.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{tempfile.mkdtemp(prefix='pagegauge-')}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read from there: work is not repeated, lineage ends."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], out: str, name: str) -> DataFrame:
    """Adds ``out``, 0-based row numbers in the given order.

    Rows are range-partitioned and numbered inside their partition; only one count per partition meets in one place.
    ``df`` should hold few equal keys, so aggregate first.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_part").agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One row per partition, so the size of the broadcast side is bounded by the partition count.
    return (
        ranged.withColumn("_at", inside).join(F.broadcast(starts), "_part")
        .withColumn(out, (F.col("_at") + F.col("_start") - 1).cast("bigint")).drop("_part", "_at", "_start")
    )


def spread_join(rows: DataFrame, one: DataFrame, keys: list[str], by: list[str], salts: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one``, which has at most one row per key; the rows of a key are dealt over ``salts`` parts by ``by``.

    The row of ``one`` is repeated only for the parts that are there, so a hot key is split and other keys cost little.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)))
    parts = salted.select(*keys, "_salt").distinct().join(one, keys)
    return salted.join(parts, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: bigint): one row (node, root) per node, root its smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Each step is one aggregate and one join on the
    node; edges only ever shrink towards stars, and each round is written to the shared folder.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stored(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        edges = stored(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct(),
            name,
        )
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == known:
            break
        known = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def folded_words(text: str | None) -> list[bytes]:
    """Words of a text: runs of ASCII letters and digits and of all other characters, lower case in ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WordHashes(dict):
    """Hashes of words, kept for the next time; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, from the hashes of the words."""
    n = max(0, len(ids) - k + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        mixed = (mixed ^ ids[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed
