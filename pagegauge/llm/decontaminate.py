"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

One pass over the documents keeps the word n-grams that pass a bitmap of the benchmark's n-grams (its size is fixed, whatever
the benchmark's) and have another such n-gram nearby, with the words around them. The n-grams that are really seeds are
found by a join, and each document passage that shares at least ``MIN_SEEDS`` rare seeds with a test item is aligned to it
word by word, so substituted, added and dropped words lower the score but do not hide the copy. Items of two words up to one n-gram
have too few seeds for that; they are found where they stand word for word, by a join of their whole hash. One word alone is no
evidence. In scripts without spaces every character is a word.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.common import WordHashes, folded_words, gram_hashes, stored

N = 3
MIN_SEEDS = 2
# A seed is rare if chance, by its words' frequencies in all documents, meets it less than once in so many words.
RARE = 1e-6
# Items whose words are all frequent keep this many of their rarest seeds, or this share of them if that is more.
LEAST_RARE = 8
RARE_SHARE = 1 / 3
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.5
BITS = 1 << 24
SALTS = 32
_BUCKET = 32768  # bits per bitmap bucket of Spark's bitmap functions
_MAX = (1 << 63) - 1


# Scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han. And the punctuation of East Asia.
_UNSPACED = re.compile("([\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
_MARKS = re.compile("[\u3000-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def passage_words(text: str | None) -> list[bytes]:
    """Words that are compared: lower case in all scripts, without punctuation, single characters in scripts without spaces."""
    text = (text or "").lower()
    if not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \1 ", _MARKS.sub(" ", text))
    return folded_words(text)


def _item_words(bench: DataFrame, n: int) -> DataFrame:
    """item_id, words, and arrays of n-gram and word hashes per item; items of up to n words have one hash, of the whole, in ``whole``."""

    def run(batches):
        cache = WordHashes()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = passage_words(text)
                ids = cache.of(words)
                if len(words) > n:
                    grams = gram_hashes(ids, n).view(np.int64)
                    rows.append((item, b" ".join(words), len(words), grams.tolist(), [ids[i : i + n].view(np.int64).tolist() for i in range(len(grams))], None))
                elif len(words) > 1:
                    rows.append((item, b" ".join(words), len(words), [], [], int(gram_hashes(ids, len(words)).view(np.int64)[0])))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "words", "n_words", "grams", "ids", "whole"])

    rows = bench.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    return rows.mapInArrow(run, "item_id bigint, words binary, n_words int, grams array<bigint>, ids array<array<bigint>>, whole bigint")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Which of ``BITS`` buckets of hash values (column h) occur: a bit each, so at most BITS / 8 bytes reach the driver."""
    # Spark's bitmap buckets are numbered from 1, for bits from 1.
    bit = F.pmod("h", F.lit(BITS)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in parts:
        at = (row["b"] - 1) * _BUCKET // 8
        out[at : at + _BUCKET // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


def _passages(docs: DataFrame, gram_map: np.ndarray, word_map: np.ndarray, n: int, around: int, short_map: np.ndarray, lengths: list[int]) -> DataFrame:
    """Rows of four kinds: w (h, count) word counts; s passages with their words; h n-grams (h) at word pos of a passage;
    x runs (h) of as many words as a short item has, with their words, once a document and run."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["kind", "doc_id", "k", "tag", "seg", "h", "pos", "words"]

    def run(batches):
        cache = WordHashes()
        grams_in, words_in, short_in = (np.unpackbits(m, bitorder="little").view(bool) for m in (gram_map, word_map, short_map))
        for batch in batches:
            counts: Counter = Counter()
            rows: list[tuple] = []
            for doc_id, k, tag, text in zip(*(batch[c].to_pylist() for c in ("doc_id", "k", "tag", "text")), strict=True):
                words = passage_words(text)
                counts.update(words)
                ids = cache.of(words)
                for length in lengths:
                    short = gram_hashes(ids, length).view(np.int64)
                    at = np.flatnonzero(short_in[short % BITS])
                    for p in at[np.unique(short[at], return_index=True)[1]]:
                        rows.append(("x", doc_id, k, tag, length, int(short[p]), int(p), b" ".join(words[p : p + length])))
                if len(words) < n:
                    continue
                grams = gram_hashes(ids, n)
                hits = np.flatnonzero(grams_in[(grams.view(np.int64) % BITS)])
                if len(hits) < MIN_SEEDS:
                    continue
                near = np.diff(hits) <= around
                hits = hits[np.concatenate([near, [False]]) | np.concatenate([[False], near])]
                if not len(hits):
                    continue
                for seg, group in enumerate(np.split(hits, np.flatnonzero(np.diff(hits) > 2 * around) + 1)):
                    first, last = max(0, int(group[0]) - around), int(group[-1]) + n + around
                    rows.append(("s", doc_id, k, tag, seg, None, first, b" ".join(words[first:last])))
                    rows += [("h", None, k, tag, seg, int(grams[p].view(np.int64)), int(p), None) for p in group]
            total = sum(counts.values())
            vocabulary = list(counts)
            ids = cache.of(vocabulary).view(np.int64)
            known = np.flatnonzero(words_in[ids % BITS])
            rows += [("w", None, None, None, None, int(ids[i]), counts[vocabulary[i]], None) for i in known]
            rows.append(("w", None, None, None, None, None, total, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_MAX)).alias("k"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tag"), F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(run, "kind string, doc_id bigint, k bigint, tag bigint, seg int, h bigint, pos bigint, words binary")


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two sequences of word numbers: score, last passage word + 1, last item word + 1."""
    steps = -GAP * np.arange(len(passage))
    above = np.zeros(len(passage) + 1, dtype=np.int64)
    best, best_at, best_item = 0, 0, 0
    for i, word in enumerate(item):
        diagonal = above[:-1] + np.where(passage == word, MATCH, MISMATCH)
        row = np.maximum(np.maximum(diagonal, above[1:] + GAP), 0)
        # Gaps along the passage: the best earlier cell less one gap a word.
        row = np.maximum.accumulate(row + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, best_at, best_item = int(row[top]), top + 1, i + 1
        above[1:] = row
    return best, best_at, best_item


def _aligned(pairs: DataFrame) -> DataFrame:
    """Scores of (doc_id, k, tag, first, passage, item_id, item): one row per pair, spans in words of the document."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, k, tag, first, passage, item_id, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                numbers: dict[bytes, int] = {}
                b = np.array([numbers.setdefault(w, len(numbers)) for w in item.split(b" ")])
                a = np.array([numbers.get(w, -1) for w in passage.split(b" ")])
                score, end, item_end = align(a, b)
                # The same alignment from its end backwards tells where it starts.
                _, back, _ = align(a[:end][::-1], b[:item_end][::-1])
                rows.append((doc_id, k, tag, item_id, score / (MATCH * len(b)), first + end - back, first + end))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "k", "tag", "item_id", "score", "start_word", "end_word"])

    ordered = pairs.select("doc_id", "k", "tag", "first", "passage", "item_id", "item")
    return ordered.mapInArrow(run, "doc_id bigint, k bigint, tag bigint, item_id bigint, score double, start_word bigint, end_word bigint")


def _leaks(docs: DataFrame, bench: DataFrame, n: int, min_score: float) -> DataFrame:
    """doc_id, k, tag, item_id, score, start_word, end_word of the best alignment of each document and item."""
    items = stored(_item_words(bench, n), "leak-items")
    seeds = items.select("item_id", F.posexplode("grams").alias("q", "h"))
    longest = items.agg(F.max("n_words")).first()[0] or 0
    short = items.where("whole is not null").select(F.col("whole").alias("h"), "item_id", F.col("words").alias("item"), F.col("n_words").alias("seg"))
    # At most n - 1 different lengths.
    lengths = sorted(r["seg"] for r in short.select("seg").distinct().collect())
    words = items.select(F.explode(F.flatten("ids")).alias("h"))
    found = stored(_passages(docs, _bitmap(seeds), _bitmap(words), n, longest + longest // 4 + 8, _bitmap(short), lengths), "leak-passages")
    # How often chance would put the words of a seed next to each other.
    counts = found.where("kind = 'w'").groupBy("h").agg(F.sum("pos").alias("n"))
    total = float((counts.where("h is null").select("n").first() or [1])[0] or 1)
    # Frequent words stand in many seeds, so each word's count is dealt to several tasks.
    salt, salts = F.pmod("item_id", F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")
    parts = items.select("item_id", salt, F.posexplode("ids").alias("q", "ids")).select("item_id", "salt", "q", F.explode("ids").alias("h"))
    rates = (
        parts.join(counts.select("h", "n", salts), ["h", "salt"], "left")
        .groupBy("item_id", "q").agg(F.sum(F.log(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)) / F.lit(total))).alias("log_rate"))
    )
    order = Window.partitionBy("item_id").orderBy("log_rate", "q")
    least = F.greatest(F.lit(float(LEAST_RARE)), F.count("*").over(Window.partitionBy("item_id")) * RARE_SHARE)
    rare = rates.withColumns({"nth": F.row_number().over(order), "least": least}).where((F.col("log_rate") <= F.log(F.lit(RARE))) | (F.col("nth") <= F.col("least")))
    seeds = stored(seeds.join(rare.select("item_id", "q"), ["item_id", "q"]).select("h", "item_id").distinct(), "leak-seeds")
    # A passage that many documents share makes its seeds frequent among the hits, so each seed is dealt to several tasks.
    hits = found.where("kind = 'h'").select("k", "tag", "seg", "h", "pos", F.pmod(F.xxhash64("k", "tag"), F.lit(SALTS)).cast("int").alias("salt"))
    shared = hits.join(seeds.select("h", "item_id", salts), ["h", "salt"])
    pairs = shared.groupBy("k", "tag", "seg", "item_id").agg(F.count_distinct("pos").alias("n")).where(F.col("n") >= MIN_SEEDS)
    passages = found.where("kind = 's'").select("doc_id", "k", "tag", "seg", F.col("pos").alias("first"), F.col("words").alias("passage")).dropDuplicates(["k", "tag", "seg"])
    ready = pairs.join(passages, ["k", "tag", "seg"]).join(items.select("item_id", F.col("words").alias("item")), "item_id")
    scored = _aligned(ready).where(F.col("score") >= min_score)
    if lengths:
        runs = found.where("kind = 'x'").select("doc_id", "k", "tag", "seg", "h", "pos", "words", F.pmod(F.xxhash64("k", "tag"), F.lit(SALTS)).cast("int").alias("salt"))
        stand = runs.join(short.select("h", "item_id", "item", "seg", salts), ["h", "seg", "salt"]).where(F.col("words") == F.col("item"))
        scored = scored.unionByName(
            stand.select("doc_id", "k", "tag", "item_id", F.lit(1.0).alias("score"), F.col("pos").alias("start_word"), (F.col("pos") + F.col("seg")).alias("end_word"))
        )
    best = F.max(F.struct("score", (-F.col("start_word")).alias("_at"), "start_word", "end_word")).alias("b")
    return scored.groupBy("doc_id", "k", "tag", "item_id").agg(best).select("doc_id", "k", "tag", "item_id", "b.score", "b.start_word", "b.end_word")


def leaks(docs: DataFrame, bench: DataFrame, n: int = N, min_score: float = MIN_SCORE) -> DataFrame:
    """One row (doc_id, item_id, score, start_word, end_word) per document and test item it holds a copy of.

    ``score`` is the best local alignment of the item in the document over that of a verbatim copy (0 to 1), the words are
    those of ``passage_words``, end exclusive. Null and empty texts hold nothing; items of two to ``n`` words
    count only where they stand word for word (score 1, their first place), items of one word and items without an id not at all; items with equal texts are all reported; rows that repeat id and text are one document; a
    null doc_id is reported as null; other columns are ignored; empty tables give no rows.
    """
    return _leaks(docs, bench, n, min_score).select("doc_id", "item_id", "score", "start_word", "end_word")


def clean(docs: DataFrame, bench: DataFrame, n: int = N, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no copy of a test item."""
    bad = stored(_leaks(docs, bench, n, min_score).select(F.col("k").alias("_bk"), F.col("tag").alias("_bt")).distinct(), "leak-documents")
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_MAX)) == F.col("_bk")
    return docs.join(bad, key & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("_bt")), "left_anti")
