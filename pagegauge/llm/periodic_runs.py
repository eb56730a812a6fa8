"""Periodic runs of words, found online by catchers over completed blocks of power-of-two lengths.

A stretch is a set of consecutive places whose word equals the one q places further on; its q + length words have period q.
At level b (1, 2, 4, ...) every completed aligned block of b words is a catcher for the periods whose shortest stretch is at
least 4b - 1 and below 8b - 1: each appended word ends a new suffix of b words, which is compared by hash with the one or two
catchers at such a distance. A stretch long enough to matter holds three whole neighbouring blocks, so three catchers in a
row that catch at the same distance report a repetition (three periods or so, a square and more). What is reported is
extended word by word, grows with the words to come, and further reports inside it merge with it; those whose period is a
multiple of its own are not primitive and are passed over unextended. Work is linear in the words of a text at each level.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH = 6
LEAST_PERIODS = 4
# Texts are joined into one stream of about so many words, with a word of its own between two texts.
_STREAM = 1 << 18
_SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    out = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


class _Level:
    """Catchers of one block length: the hashes of the last suffixes, from place ``base`` on."""

    def __init__(self, block: int, low: int, high: int):
        self.block, self.low, self.high = block, low, high
        self.base, self.hashes = 0, np.zeros(0, dtype=np.uint64)

    def upto(self) -> int:
        return self.base + len(self.hashes)

    def grow(self, more: np.ndarray) -> None:
        self.hashes = np.concatenate([self.hashes, more])

    def forget(self) -> None:
        keep = self.high + 4 * self.block
        if len(self.hashes) > 2 * keep:
            self.base += len(self.hashes) - keep
            self.hashes = self.hashes[-keep:].copy()

    def caught(self, since: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and periods of the repetitions that the suffixes from place ``since`` on complete."""
        block, h, base = self.block, self.hashes, self.base
        starts, periods = [], []
        at = np.arange(since, self.upto())
        back = self.low + (at - self.low) % block
        for _ in range(-(-(self.high - self.low + 1) // block)):
            far = at - back
            fit = np.flatnonzero((far >= 2 * block) & (back <= self.high))
            fit = fit[h[far[fit] - base] == h[at[fit] - base]]
            for earlier in (block, 2 * block):
                fit = fit[h[far[fit] - earlier - base] == h[at[fit] - earlier - base]]
            starts.append(far[fit] - 2 * block), periods.append(back[fit])
            back = back + block
        return np.concatenate(starts), np.concatenate(periods)


class Catchers:
    """Online runs of a sequence of word numbers: ``append`` any number of words at a time, ``runs`` at any time.

    ``longest`` bounds the length of a run where the caller knows one (the longest of several joined texts).
    """

    def __init__(self, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS, longest: int | None = None):
        self.least_length, self.least_periods, self.longest = least_length, least_periods, longest
        # The shortest stretch of any period: blocks grow with the period from there on.
        self.shortest = min(self._least(q) for q in range(1, max(2, least_length) + 1))
        if least_periods < 2 or self.shortest < 3:
            raise ValueError("three catchers in a row need runs of two periods and five words, or of four periods")
        self.words, self.n = np.zeros(16, dtype=np.int64), 0
        self.levels: list[_Level] = []
        self.found: list[list[int]] = []  # [start, end, period] of every stretch that was reported
        self.open: list[list[int]] = []  # those that reach the last word

    def _least(self, period: int) -> int:
        return max(self.least_length - period, (self.least_periods - 1) * period)

    def _next_level(self) -> _Level:
        block = 1 << len(self.levels)
        low = self.levels[-1].high + 1 if self.levels else 1
        # Periods whose shortest stretch holds three blocks of this length, but not of the next.
        high = low - 1
        while max(self.shortest, (self.least_periods - 1) * (high + 1)) < 8 * block - 1:
            high += 1
        return _Level(block, low, high)

    def append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            grown = np.zeros(max(self.n, 2 * len(self.words)), dtype=np.int64)
            grown[:before] = self.words[:before]
            self.words = grown
        self.words[before : self.n] = words
        for stretch in self.open:
            stretch[1] = self._right(stretch[1] - stretch[2], stretch[2])
        reach = self.n if self.longest is None else min(self.n, self.longest)
        while not self.levels or (self.levels[-1].high + 1) * self.least_periods <= reach:
            self.levels.append(self._next_level())
        below: _Level | None = None
        for level in self.levels:
            since = level.upto()
            if below is None:
                fresh = self.words[since : self.n].astype(np.uint64)
                level.grow(_mixed(fresh, fresh))
            elif below.upto() - below.block > since:
                half, end = below.block, below.upto() - below.block
                h = below.hashes[since - below.base :]
                level.grow(_mixed(h[: end - since], h[half : half + end - since]))
            if below is not None:
                below.forget()
            if level.low <= level.high and level.upto() > since:
                self._report(level, *level.caught(since))
            below = level
        below.forget()
        self.open = [s for s in self.found if s[1] == self.n]

    def _right(self, at: int, period: int) -> int:
        """The end of the words that keep the period from place ``at`` on."""
        step = 64
        while at + period < self.n:
            end = min(at + step, self.n - period)
            differ = self.words[at:end] != self.words[at + period : end + period]
            if differ.any():
                return at + int(differ.argmax()) + period
            at, step = end, 2 * step
        return self.n

    def _left(self, at: int, period: int) -> int:
        """The first word that keeps the period up to place ``at``."""
        step = 64
        while at > 0:
            begin = max(0, at - step)
            differ = self.words[begin:at] != self.words[begin + period : at + period]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, step = begin, 2 * step
        return 0

    def _report(self, level: _Level, starts: np.ndarray, periods: np.ndarray) -> None:
        if not len(starts):
            return
        order = np.lexsort((periods, starts))
        starts, periods = starts[order], periods[order]
        span = 3 * level.block
        if self.found:
            # Inside a known stretch whose period divides theirs.
            known = np.array(self.found)
            known = known[known[:, 1] - known[:, 0] >= level.low + span]
            first, last = np.searchsorted(starts, known[:, 0]), np.searchsorted(starts, known[:, 1])
            fresh = np.ones(len(starts), dtype=bool)
            for k in np.flatnonzero(first < last):
                _, end, period = known[k]
                part = slice(first[k], last[k])
                fresh[part] &= ~((periods[part] % period == 0) & (starts[part] + periods[part] + span <= end))
            starts, periods = starts[fresh], periods[fresh]
        order = np.lexsort((starts, periods))
        starts, periods = starts[order], periods[order]
        k = 0
        while k < len(starts):
            start, period = int(starts[k]), int(periods[k])
            begin, end = self._left(start, period), self._right(start, period)
            # A shorter one can still grow if it reaches the last word.
            if end - begin - period >= self._least(period) or end == self.n:
                self.found.append([begin, end, period])
            k += 1
            while k < len(starts) and periods[k] == period and starts[k] + period < end:
                k += int(np.searchsorted(starts[k : np.searchsorted(periods, period, "right")], end - period))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs so far, by start, then period."""
        out: list[tuple[int, int, int]] = []
        kept: dict[int, list[tuple[int, int]]] = {}  # by end: a run that is no power ends where its root's run ends
        for start, end, period in sorted(self.found, key=lambda s: (s[2], s[0])):
            if end - start - period < self._least(period):
                continue
            roots = kept.setdefault(end, [])
            if any(period % p == 0 and s <= start for p, s in roots):
                continue
            roots.append((period, start))
            out.append((start, end - start, period))
        return sorted(out, key=lambda r: (r[0], r[2]))


def with_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's edit: the words of every tenth id (by crc32) end in a repetition. A null id leaves them alone."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    body = words[a : a + p]
    return words[:a] + (body * ((n - a) // p + 1))[: n - a]


def runs_of(texts: list[list], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each sequence of words, by start, then period; all texts in one stream."""
    numbers: dict = {}
    catchers = Catchers(least_length, least_periods, max(map(len, texts), default=0))
    begins, at = [], 0
    stream = []
    for i, words in enumerate(texts):
        begins.append(at)
        at += len(words) + 1
        # The word between two texts occurs once, so no run reaches over it.
        stream.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)))
        stream.append(np.array([-1 - i]))
    if stream:
        catchers.append(np.concatenate(stream))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    edges = np.array(begins)
    for start, length, period in catchers.runs():
        i = int(np.searchsorted(edges, start, "right")) - 1
        out[i].append((start - begins[i], length, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone), strict=False) if not g]


def _summary(doc_id, words, runs):
    best = None
    for run in runs:
        # length / period, compared exactly; runs come by start, then period.
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    start, length, period = best or (None, None, None)
    return (
        doc_id, len(runs), start, length, period, 1000 * length // period if best else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def periodic_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS, tail: bool = False) -> DataFrame:
    """One row per document: how many runs, its run of greatest exponent, digests of all runs and of the text without repeats.

    A run is a maximal stretch of words of smallest period q with at least ``least_length`` words and ``least_periods * q``
    words. Words are what ASCII white space separates. ``start``, ``length``, ``period`` and ``exponent_milli`` are null
    without a run; of equal exponents the smallest start, then period, counts. Null and empty texts have no words and no
    runs; a null doc_id keeps its row; rows that repeat an id are worked out each by itself; other columns are ignored; an
    empty table gives no rows. Nothing is shuffled, and a task holds one stream of texts at a time: about 2**18 words, or
    the one text that is longer. ``tail`` applies the contract's edit (``with_tail``) first.
    """

    def run(batches):
        def done():
            found = runs_of([w for _, w in waiting], least_length, least_periods)
            return _batch([_summary(i, w, r) for (i, w), r in zip(waiting, found, strict=True)])

        waiting, held = [], 0
        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if held and held + len(words) > _STREAM:
                    yield done()
                    waiting, held = [], 0
                waiting.append((i, with_tail(words, i) if tail else words))
                held += len(words) + 1
        if waiting:
            yield done()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)
