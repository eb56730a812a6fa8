"""Greedy de-duplication in time: accept a request, ignore its key for a while, accept the next.

The window is anchored on the accepted request, so each decision depends on the one before, back to the
first request of the key. To keep a busy key from becoming one long task, time is cut into chunks and scanned as prefixes:

1. every (key, chunk) works out, for each possible last acceptance before it, the last acceptance after it
   (a step function; chains merge quickly, so it has few steps);
2. neighbouring chunks' functions are composed, ``fan`` of them to one, in rounds, until a key has one function;
3. from there the true last acceptance goes down the same rounds to every chunk;
4. every (key, chunk) lists its accepted times.

Times are whole milliseconds and equal times are merged first, so a chunk's input is bounded by its length, not by the
number of requests, and no group of a round is larger than ``fan``, however many chunks a key has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.session import written

CHUNK_MS = 10 * 60 * 1000
FAN = 32
NEVER = -(2**62)


def _next_index(times: np.ndarray, window: int) -> np.ndarray:
    """Index of the first time beyond the window of each time (len(times) if none)."""
    return np.searchsorted(times, times + window, side="right")


def _steps(times: np.ndarray, chunk_start: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function of a chunk: ``below`` (exclusive bound on the last acceptance) -> last acceptance after."""
    n = len(times)
    following = _next_index(times, window)
    last = np.where(following < n, following, np.arange(n))
    while True:
        jumped = last[last]
        if np.array_equal(jumped, last):
            break
        last = jumped
    # An acceptance before the chunk cannot reach beyond chunk_start + window.
    reachable = np.concatenate(([True], times[:-1] < chunk_start + window))
    below, after = times[reachable] - window, times[last[reachable]]
    keep = np.append(after[1:] != after[:-1], True)
    return below[keep], after[keep]


def _after(below: np.ndarray, after: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The step function's values; beyond its last bound nothing is accepted and the last acceptance stays."""
    step = np.searchsorted(below, last, side="right")
    return np.where(step < len(below), after[np.minimum(step, len(below) - 1)], last)


def _composed(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The step function of two spans of time, one after the other."""
    more = second[0] > first[0][-1]
    below = np.concatenate([first[0], second[0][more]])
    after = np.concatenate([_after(*second, first[1]), second[1][more]])
    keep = np.append(after[1:] != after[:-1], True)
    return below[keep], after[keep]


def _children(row) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return sorted(((c["node"], np.asarray(c["below"]), np.asarray(c["after"])) for c in row), key=lambda c: c[0])


def accepted_times(points: DataFrame, key: str, window_ms: int, seeds: DataFrame | None = None, fan: int = FAN, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """(key, ms) accepted among distinct (key, ms). ``seeds`` (key, ms) are acceptances before the data; NULL keys accept like any other."""
    key_type = points.schema[key].dataType.simpleString()
    chunk = F.floor(F.col("ms") / F.lit(chunk_ms))
    span = points.agg(F.min(chunk).alias("low"), F.max(chunk).alias("high")).first()
    low, chunks = (span["low"], span["high"] - span["low"] + 1) if span["low"] is not None else (0, 0)
    keyed = points.withColumnRenamed(key, "key").withColumn("node", chunk - F.lit(low))
    timed = written(keyed.groupBy("key", "node").agg(F.array_sort(F.collect_list("ms")).alias("times")), "chunk-times")

    def steps(batches):
        for pdf in batches:
            made = [_steps(np.asarray(t), (low + n) * chunk_ms, window_ms) for n, t in zip(pdf["node"], pdf["times"], strict=True)]
            yield pdf[["key", "node"]].assign(below=[b for b, _ in made], after=[a for _, a in made])

    functions = f"key {key_type}, node bigint, below array<bigint>, after array<bigint>"
    level = timed.mapInPandas(steps, functions)
    rounds: list[DataFrame] = []
    while chunks > 1:
        parent = F.floor(F.col("node") / F.lit(fan))
        groups = level.groupBy("key", parent.alias("parent")).agg(F.collect_list(F.struct("node", "below", "after")).alias("children"))
        rounds.append(written(groups.withColumnRenamed("parent", "node"), "chunk-groups"))

        def compose(batches):
            for pdf in batches:
                made = []
                for row in pdf["children"]:
                    (_, *whole), *others = _children(row)
                    for _, *other in others:
                        whole = _composed(whole, other)
                    made.append(whole)
                yield pdf[["key", "node"]].assign(below=[b for b, _ in made], after=[a for _, a in made])

        level, chunks = rounds[-1].mapInPandas(compose, functions), -(-chunks // fan)
    entries = level.select("key", "node")
    if seeds is None:
        entries = entries.withColumn("entry", F.lit(NEVER))
    else:
        given = seeds.groupBy(F.col(key).alias("given")).agg(F.max("ms").alias("entry"))
        entries = entries.join(given, F.col("key").eqNullSafe(F.col("given")), "left").select("key", "node", F.coalesce("entry", F.lit(NEVER)).alias("entry"))

    def descend(batches):
        for pdf in batches:
            keys, nodes, lasts = [], [], []
            for k, row, last in zip(pdf["key"], pdf["children"], pdf["entry"], strict=True):
                for node, below, after in _children(row):
                    keys.append(k), nodes.append(node), lasts.append(last)
                    last = int(_after(below, after, np.int64(last)))
            yield pd.DataFrame({"key": np.array(keys, dtype=object), "node": np.array(nodes, dtype="int64"), "entry": np.array(lasts, dtype="int64")})

    same = lambda a, b: (a["node"] == b["node"]) & a["key"].eqNullSafe(b["key"])
    for groups in reversed(rounds):
        met = groups.join(entries, same(groups, entries)).select(groups["key"], "children", "entry")
        entries = written(met.mapInPandas(descend, f"key {key_type}, node bigint, entry bigint"), "chunk-entries")

    def walk(batches):
        for pdf in batches:
            keys, out = [], []
            for k, times, last in zip(pdf["key"], pdf["times"], pdf["entry"], strict=True):
                at = int(np.searchsorted(times, last + window_ms, side="right"))
                while at < len(times):
                    keys.append(k), out.append(times[at])
                    at = int(np.searchsorted(times, times[at] + window_ms, side="right"))
            yield pd.DataFrame({"key": np.array(keys, dtype=object), "ms": np.array(out, dtype="int64")})

    met = timed.join(entries, same(timed, entries)).select(timed["key"], "times", "entry")
    return met.mapInPandas(walk, f"key {key_type}, ms bigint").withColumnRenamed("key", key)


def accept_requests(
    requests: DataFrame, key: str, at: Column, row_id: str, seconds: int = C.INFLIGHT_SECONDS, seeds: DataFrame | None = None
) -> DataFrame:
    """Requests plus ``accepted``: no accepted request of the key in the ``seconds`` before (inclusive)."""
    timed = requests.withColumn("ms", F.unix_millis(at))
    points = timed.groupBy(key, "ms").agg(F.min(row_id).alias("_first"))
    chosen = accepted_times(points.select(key, "ms"), key, seconds * 1000, seeds)
    firsts = points.join(chosen, [key, "ms"]).select(key, "ms", F.col("_first").alias(row_id), F.lit(True).alias("accepted"))
    joined = timed.join(firsts, [key, "ms", row_id], "left")
    return joined.withColumn("accepted", F.coalesce("accepted", F.lit(False))).drop("ms")
