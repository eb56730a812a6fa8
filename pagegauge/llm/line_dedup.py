"""Repeated runs of lines, found by a suffix array over line ids that grows by prefix doubling; later copies are deleted.

Documents are sequences of line ids. A run *qualifies* if it has at least ``min_words`` words; a line counts as many words as white
space separates in it, or one for every ten code points if that is more, as in scripts without spaces. A line is deleted if it lies
in a qualifying run that also starts at an earlier place of the corpus (by doc_id, then line). The union over all repeated
runs equals the union over the shortest qualifying runs: those that start at a line and reach ``min_words``, and those that
end at one. How long such a window is depends on its own lines only, so equal windows are exactly the suffixes in one
interval of the suffix array whose common prefix is at least the window, and an interval needs its first place only.

Ranks start with the order of the line ids and double: the rank of 2k lines is the order of (rank of k lines here, rank of k
lines k further on). Lines and prefixes that occur once can't be in a repeated run and leave at once, and doubling stops
at the longest window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.common import numbered, stored

MIN_WORDS = 8
CODE_POINTS = 10
_SCHEMA = "k bigint, tag bigint, pos bigint, d1 bigint, d2 bigint, spans array<int>"
_PLACE = ["k", "tag", "pos"]


def windows(words: list[int], min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths, in lines, of the shortest windows of ``min_words`` words that start or end at each line."""
    n = len(words)
    upto = np.cumsum(np.asarray(words, dtype=np.int64))
    before = upto - words
    at = np.arange(n)
    ends = np.searchsorted(upto, before + min_words, "left")
    starts = np.searchsorted(before, upto - min_words, "right") - 1
    fits, reaches = ends < n, starts >= 0
    first = np.concatenate([at[fits], starts[reaches]])
    last = np.concatenate([ends[fits], at[reaches]])
    packed = np.unique(first * (n + 1) + (last - first + 1))
    return packed // (n + 1), packed % (n + 1)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds the place of a document in the corpus: k (doc_id, null ids last) and tag (a hash of its text)."""
    return docs.withColumns({
        "_k": F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)),
        "_tag": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))),
    })


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            keys, tags, places, digests, counts, spans = [], [], [], [], [], []
            for k, tag, text in zip(*(batch[c].to_pylist() for c in ("_k", "_tag", "text")), strict=True):
                points = [len(line) // CODE_POINTS for line in (text or "").split("\n")]
                lines = [line.encode("utf-8", "surrogatepass") for line in (text or "").split("\n")]
                first, length = windows([max(len(line.split()), n) for line, n in zip(lines, points, strict=True)], min_words)
                keys.append(np.full(len(lines), k)), tags.append(np.full(len(lines), tag)), places.append(np.arange(len(lines)))
                digests += [hashlib.md5(line).digest() for line in lines]
                counts.append(np.bincount(first, minlength=len(lines)))
                spans.append(length)
            if digests:
                pair = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(spans).astype(np.int32)))
                columns = [np.concatenate(keys), np.concatenate(tags), np.concatenate(places), pair[:, 0], pair[:, 1]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], ["k", "tag", "pos", "d1", "d2", "spans"])

    return _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("_k", "_tag", "text").mapInArrow(run, _SCHEMA)


def _named(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, name, first: the values of ``by`` that occur more than once, named by their order, with their first place."""
    groups = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*_PLACE)).alias("first")).where("n > 1").drop("n")
    return stored(numbered(groups, [F.col(c) for c in by], "name", "line-order"), "line-names")


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """k, tag, pos, span: the qualifying windows that have an earlier copy."""
    lines = stored(_lines(docs, min_words), "lines")
    names = _named(lines, ["d1", "d2"])
    # Rows that repeat id and text are one document.
    active = lines.join(names, ["d1", "d2"]).select(*_PLACE, F.col("name").alias("rank"), "first", "spans").dropDuplicates(_PLACE)
    active = stored(active, "line-ranks")
    spans = stored(active.select(*_PLACE, F.explode("spans").alias("span")), "line-windows")
    longest = spans.agg(F.max("span")).first()[0] or 0
    place = F.struct(*_PLACE)
    # Windows of one line are equal if the line is, and its first place is known.
    found = active.where(F.array_contains("spans", 1) & (place != F.col("first"))).select(*_PLACE, F.lit(1).alias("span"))
    ranks, reach = active.select(*_PLACE, "rank"), 1
    while longest > 1:
        # Windows of reach to 2 * reach - 1 lines are equal if their first and their last ``reach`` lines are.
        mine = spans.where(f"span > 1 and span >= {reach} and span < {2 * reach}")
        tails = ranks.select("k", "tag", F.col("pos").alias("last"), F.col("rank").alias("tail"))
        ends = mine.join(ranks, _PLACE).withColumn("last", F.col("pos") + F.col("span") - reach).join(tails, ["k", "tag", "last"])
        firsts = ends.groupBy("span", "rank", "tail").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
        found = found.unionByName(ends.join(firsts, ["span", "rank", "tail"]).where(place != F.col("first")).select(*_PLACE, "span"))
        if 2 * reach > longest:
            break
        ahead = Window.partitionBy("k", "tag").orderBy("pos").rangeBetween(reach, reach)
        pairs = stored(ranks.withColumn("further", F.max("rank").over(ahead)).where("further is not null"), "line-pairs")
        if pairs.isEmpty():
            break
        doubled = _named(pairs, ["rank", "further"])
        ranks = stored(pairs.join(doubled, ["rank", "further"]).select(*_PLACE, F.col("name").alias("rank")), "line-ranks")
        reach *= 2
    return found


def _without(texts: pd.Series, marks: pd.Series) -> pd.Series:
    """The lines of each text that no (start, end) of its marks covers."""

    def cut(text, pairs):
        if text is None or pairs is None:
            return None
        lines = text.split("\n")
        gone = np.zeros(len(lines) + 1, dtype=np.int64)
        for pair in pairs:
            gone[pair["start"]] += 1
            gone[pair["end"]] -= 1
        covered = np.cumsum(gone)[:-1] > 0
        return "\n".join(line for line, out in zip(lines, covered, strict=True) if not out)

    return pd.Series([cut(t, m) for t, m in zip(texts, marks, strict=True)], dtype=object)


def _marks(docs: DataFrame, min_words: int) -> DataFrame:
    """k, tag, runs: per document the maximal runs of lines to delete, as structs (start, end), ends exclusive, in order."""
    found = repeated_windows(docs, min_words).select("k", "tag", F.col("pos").alias("start"), (F.col("pos") + F.col("span")).alias("end"))
    sofar = Window.partitionBy("k", "tag").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("k", "tag").orderBy("start", "end")
    opens = F.coalesce(F.col("start") > F.max("end").over(sofar), F.lit(True))
    return (
        found.withColumn("open", opens.cast("int")).withColumn("run", F.sum("open").over(order))
        .groupBy("k", "tag", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("k", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs"))
    )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, runs: str = "runs") -> DataFrame:
    """All rows and columns of ``docs`` with the later copies of repeated line runs deleted from ``text``, plus ``runs``.

    ``runs`` (or the column of the name given) lists the deleted runs of lines, numbered from 0, as structs (start, end), end exclusive; null if there are none.
    Texts split at line feeds only. Null texts stay null and empty ones empty; a null doc_id comes after all others; rows
    that repeat doc_id and text are one document and get the same text; within a document the later copy goes, and copies
    that overlap leave the first. The first place of a line is never deleted, so no content is lost. A text whose lines all
    go becomes empty; its row stays.
    """
    marks = _marks(docs, min_words).withColumnsRenamed({"k": "_mk", "tag": "_mt", "runs": "_runs"})
    keyed = _keyed(docs)
    joined = keyed.join(marks, (F.col("_k") == F.col("_mk")) & (F.col("_tag") == F.col("_mt")), "left")
    hit = F.col("_runs").isNotNull()
    without = F.pandas_udf(_without, "string")
    cut = F.when(hit, without(F.when(hit, F.col("text")), F.col("_runs"))).otherwise(F.col("text"))
    return joined.withColumn("text", cut).withColumn(runs, F.col("_runs")).drop("_k", "_tag", "_mk", "_mt", "_runs")


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the columns it had; ``n_chars``, where there is one, counts the code points that are left."""
    out = dedup_lines(docs, min_words, runs="_deleted")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_deleted").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
