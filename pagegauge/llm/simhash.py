"""Near-duplicate documents by SimHash, found through an inverted index over byte positions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.common import components, stored

WORDS = 3
MAX_BITS = 2
SEED = 42
BYTES = 8
# Two fingerprints that differ in at most k bits differ in at most k bytes, so they share at least BYTES - k positions.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_POP16 = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles of one text; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, SEED)]
    else:
        starts = [0, *ends[: len(tokens) - words]]
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]
    values = np.array(hashes, dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 65536):
        part = values[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(values)).tobytes(), "big")


def _tag():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, tag (hash of the text), fp (the fingerprint as a signed long). Null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch["text"]], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tag"], pa.array(fps)], ["doc_id", "tag", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _tag().alias("tag"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, tag bigint, fp bigint")


def _bucket_edges(members: list[np.ndarray], free: list[tuple[int, ...]], max_bits: int) -> list[list[tuple[int, int]]]:
    """For each posting list a spanning forest of the pairs that differ in at most ``max_bits`` bits.

    Members of a list agree in all positions but the free ones, so the shared-byte tally of every pair of the list has
    reached the minimum; what is left to verify are the bits of the free bytes.
    """
    found = []
    for values, positions in zip(members, free, strict=True):
        values = np.sort(values.astype(np.uint64))
        small = np.zeros(len(values), dtype=np.uint64)
        for p in positions:
            small = (small << np.uint64(8)) | ((values >> np.uint64(8 * p)) & np.uint64(255))
        edges = []
        if len(positions) == 2 and len(values) > 64:
            # At most 65,536 different members: look the neighbours of each up in a table of what is there.
            where = np.full(1 << 16, -1, dtype=np.int64)
            where[small.astype(np.int64)] = np.arange(len(values))
            parent = np.arange(len(values))
            flips = np.flatnonzero((_POP16 >= 1) & (_POP16 <= max_bits))
            reached = np.zeros(len(values), dtype=bool)
            for start in range(len(values)):
                if reached[start]:
                    continue
                reached[start] = True
                wave = np.array([start])
                while len(wave):
                    near = where[(small[wave].astype(np.int64)[:, None] ^ flips[None, :]).ravel()]
                    source = np.repeat(wave, len(flips))
                    keep = near >= 0
                    near, source = near[keep], source[keep]
                    keep = ~reached[near]
                    near, source = near[keep], source[keep]
                    near, first = np.unique(near, return_index=True)
                    reached[near] = True
                    parent[near] = source[first]
                    wave = near
            own = np.flatnonzero(parent != np.arange(len(values)))
            edges = list(zip(values[own].astype(np.int64).tolist(), values[parent[own]].astype(np.int64).tolist(), strict=True))
        else:
            for i in range(1, len(values)):
                differ = small[i] ^ small[:i]
                bits = np.zeros(i, dtype=np.int64)
                for shift in range(0, 8 * len(positions), 16):
                    bits += _POP16[((differ >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)]
                for j in np.flatnonzero(bits <= max_bits):
                    edges.append((int(values[i].astype(np.int64)), int(values[j].astype(np.int64))))
        found.append(edges)
    return found


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a, b: pairs of different fingerprints (bigint) that differ in at most ``max_bits`` bits, enough to connect all such.

    The inverted index lists fingerprints by their bytes at the guaranteed minimum of positions at once (six of eight for
    two bits), so a pair's tally of shared positional bytes reaches the minimum exactly if the pair meets in a list. With
    two free bytes a list holds at most 65,536 different fingerprints however many documents there are.
    """
    frees = list(combinations(range(BYTES), max_bits))
    keys = []
    for i, free in enumerate(frees):
        mask = 0
        for p in range(BYTES):
            if p not in free:
                mask |= 0xFF << (8 * p)
        keys.append(F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint")).alias("k")))
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.g", "x.k")
    lists = postings.groupBy("g", "k").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches):
        for batch in batches:
            found = _bucket_edges([np.asarray(v, dtype=np.int64).view(np.uint64) for v in batch["fps"]], [frees[g] for g in batch["g"]], max_bits)
            flat = [e for edges in found for e in edges]
            yield pd.DataFrame({"a": pd.Series([a for a, _ in flat], dtype="int64"), "b": pd.Series([b for _, b in flat], dtype="int64")})

    return lists.select("g", "fps").mapInPandas(run, "a bigint, b bigint")


def _classes(docs: DataFrame, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all documents; for each different fingerprint (fp) its root and first row (no_id, doc_id, tag)."""
    fps = stored(fingerprints(docs, words), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("first")
    distinct = stored(fps.groupBy("fp").agg(first), "simhash-distinct")
    roots = components(links(distinct.select("fp"), max_bits), "simhash-links")
    # Fingerprints without a link are their own component and need no row in the link table.
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return fps, stored(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "first"), "simhash-roots")


def near_duplicates(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) per document.

    ``fingerprint`` is 16 lowercase hex digits. Documents are linked if their fingerprints differ in at most ``max_bits``
    bits; ``component_id`` is the smallest doc_id that links reach, the document itself included. Only different
    fingerprints are indexed, so copies form no pairs. Null texts count as empty (fingerprint 0); a null doc_id keeps its
    row and is its component's id only if no other id is there; repeated rows stay; other columns are ignored; an empty
    table gives no rows.
    """
    fps, rooted = _classes(docs, words, max_bits)
    # A root may have many fingerprints: their minimum is aggregated first, then joined.
    smallest = rooted.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id"))
    ids = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One document (all columns) per component of ``near_duplicates``: the one with the smallest doc_id.

    Null ids come last, rows that share the id go by the hash of their text, and of rows equal in both one stays.
    """
    _, rooted = _classes(docs, words, max_bits)
    last = F.lit((1 << 63) - 1)
    winners = rooted.groupBy("root").agg(F.min("first").alias("w")).select(F.coalesce("w.doc_id", last).alias("_k"), F.col("w.tag").alias("_tag")).distinct()
    keyed = docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("bigint"), last), "_tag": _tag()})
    # The join and the removal of equal rows go by the same two columns, so texts cross the network once.
    return keyed.join(winners, ["_k", "_tag"], "left_semi").select(*docs.columns, "_k", "_tag").dropDuplicates(["_k", "_tag"]).drop("_k", "_tag")
