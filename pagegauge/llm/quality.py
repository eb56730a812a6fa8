"""Text quality by positive-unlabelled learning: trusted good documents against web text of unknown quality.

A text is described by shares that do not depend on its language (symbols, capitals, repetition and so on), each cut into
steps; the steps together are its *cell*. Beside the cell stands its *content*: hashed words, word pairs and byte 4-grams of
the whole text and statistics of length and vocabulary on even grids. The score is a logistic sum over both, fitted to the
non-negative unbiased risk (Kiryo et al., 2017) of the trusted positives and all unlabelled documents.

Rows of one cell have equal terms in that risk, so the cells' weights come from counts, at most 4 * ``CELLS`` of them. The
weights of the content come next, on top of the cells' logits, by full-batch gradients that the executors sum. Sums are in
whole numbers, so they do not depend on the order of rows. The share of good text among the unlabelled (the class prior) is
the smaller of two estimates: by cells, and by scores of documents that the scoring weights have not seen.
"""

from __future__ import annotations

from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.common import WordHashes, gram_hashes, stored

HELD_OUT = 2  # remainder of crc32(doc_id) mod 4
KEEP = 0.7
SYMBOLS = "#$%&*^~<>\\{}[]"
LISTS = "|•·»►"
# Upper ends of the steps of each share; a further step lies beyond the last.
STEPS = {
    "symbols": (0.05, 0.3, 1.0, 2.0),
    "lists": (0.05, 0.15, 0.3, 0.45),
    "shouts": (0.1, 0.3, 0.7, 1.2),
    "capitals": (0.15, 0.3, 0.5, 0.8),
    "repeats": (0.2, 0.3, 0.45, 0.7),
}
WIDTH = 5
CELLS = WIDTH ** len(STEPS)
_EDGES = np.array(list(STEPS.values()))
_PLACE = WIDTH ** np.arange(len(STEPS))
ROUNDS, RATE, DECAY = 2000, 0.05, 1e-4
LEAST_MASS = 0.2
# Content: buckets of words and word pairs, of byte 4-grams, and grid points of each statistic.
WORDS, GRAMS, STATISTICS, GRID = 2048, 832, 12, 16
CONTENT = WORDS + GRAMS + STATISTICS * GRID
CONTENT_ROUNDS, PRIOR_ROUNDS = 14, 6
RIDGE, LEAST_RIDGE = 0.5, 0.002
SMOOTHNESS = 0.75  # of the risk along the content: a quarter of its largest squared length
_UNIT = 1 << 20  # of whole-number weights, scores and losses
_CHUNK = 64  # documents whose contents fit a core's cache
_PACK = pa.Codec("zstd", 1)
_HASHES = WordHashes()
_LETTERS = np.array([chr(c).isalpha() and c < 128 for c in range(256)])
_SPACES = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


class Model(NamedTuple):
    prior: float
    weights: tuple[tuple[float, ...], ...]  # per share and step
    offset: float
    content: tuple[int, ...] = ()  # in parts of 1 / (255 * _UNIT) per unit of content


def shares(text: str | None) -> tuple[float, ...]:
    """The shares of ``STEPS`` for one whole text; all 0 without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0, 0.0, 0.0, 0.0, 0.0)
    count = text.count
    return (
        sum(map(count, SYMBOLS)) / n,
        sum(map(count, LISTS)) / n,
        (count("!") + count("?")) / n,
        sum(map(str.isupper, words)) / n,
        sum(map(eq, words, words[1:])) / n,
    )


def cells(texts: pd.Series) -> pd.Series:
    if not len(texts):
        return pd.Series([], dtype="int32")
    values = np.array([shares(t) for t in texts])
    steps = (values[:, :, None] > _EDGES[None, :, :]).sum(axis=2)
    return pd.Series((steps * _PLACE).sum(axis=1).astype("int32"))


def _cell(text: Column) -> Column:
    return F.pandas_udf(cells, "int")(text.cast("string"))


def _entropy(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def _statistics(text: str, raw: np.ndarray, ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Length and vocabulary of a text, each brought to 0..1."""
    n, size = len(ids), max(1, len(raw))
    lines = text.split("\n")
    places = np.bincount(raw, minlength=256)
    _, uses = np.unique(ids, return_counts=True)
    longest = max(map(len, text.split()), default=0)
    mean = len(raw) / max(1, n)
    return np.array([
        np.log1p(n) / 14, mean / (mean + 8), len(uses) / max(1, n), len(np.unique(pairs)) / max(1, len(pairs)), np.log1p(longest) / 14,
        np.log1p(len(text) / len(lines)) / 14, len(set(lines)) / len(lines), places[_LETTERS].sum() / size, places[48:58].sum() / size,
        places[_SPACES].sum() / size, places[128:].sum() / size, _entropy(places) / 8 if n < 2 else (_entropy(places) / 8 + _entropy(uses) / np.log2(n)) / 2,
    ])


def _rooted(buckets: np.ndarray, size: int) -> np.ndarray:
    """Roots of the buckets' shares of all hits, a vector of length 1, in steps of 1/255; no hit vanishes."""
    return np.ceil(255 * np.sqrt(np.bincount(buckets, minlength=size) / max(1, len(buckets))))


def content(text: str | None) -> bytes:
    """The content of one whole text: ``CONTENT`` numbers from 0 to 255."""
    low = (text or "").lower()
    data = low.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, dtype=np.uint8)
    ids = _HASHES.of(data.split())
    pairs = gram_hashes(ids, 2)
    words = (np.concatenate([gram_hashes(ids, 1), pairs]) >> np.uint64(40)).astype(np.int64) % WORDS
    wide = raw.astype(np.uint32)
    grams = wide[:-3] | wide[1:-2] << np.uint32(8) | wide[2:-1] << np.uint32(16) | wide[3:] << np.uint32(24) if len(raw) > 3 else wide[:0]
    grams = ((grams * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.int64) % GRAMS
    # A statistic lies between two points of an even grid and counts for each by its nearness.
    at = np.clip(_statistics(low, raw, ids, pairs), 0, 1) * (GRID - 1)
    near = np.maximum(0, 1 - np.abs(at[:, None] - np.arange(GRID))) / np.sqrt(STATISTICS)
    return np.concatenate([_rooted(words, WORDS), _rooted(grams, GRAMS), np.rint(255 * near).ravel()]).astype(np.uint8).tobytes()


def _packed(text: str | None) -> bytes:
    return _PACK.compress(content(text), asbytes=True)


def _described(text: Column) -> Column:
    """struct(cell, x) of a text, the content compressed."""

    def describe(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"cell": cells(texts), "x": pd.Series([_packed(t) for t in texts], dtype=object)})

    return F.pandas_udf(describe, "cell int, x binary")(text.cast("string"))


def steps_of(cell: np.ndarray) -> np.ndarray:
    return (cell[:, None] // _PLACE) % WIDTH


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def _sides(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``positive`` to rows with a document's id ``d``: trusted, unlabelled (false) or on neither side (null).

    Positives are documents that ``labels`` marks 1 and never 0, outside the held-out part; other rows labelled there are on
    neither side. Held-out documents are all unlabelled: not even that a label exists is learned from.
    """
    marks = (
        labels.select(F.col("doc_id").cast("bigint").alias("_l"), F.col("quality").cast("int").alias("q")).where("_l is not null and q is not null")
        .where(~held_out(F.col("_l"))).groupBy("_l").agg(F.min("q").alias("q"))
    )
    joined = rows.join(marks.hint("merge"), F.col("d") == F.col("_l"), "left")
    return joined.withColumn("positive", F.when(F.col("q") == 1, True).when(F.col("q").isNull(), False)).drop("_l", "q")


def _counted(sides: DataFrame) -> pd.DataFrame:
    return sides.where("positive is not null").groupBy("cell", "half", "positive").agg(F.count("*").alias("n")).toPandas()


def _half(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


def counts(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """cell, half, positive, n: trusted positives and unlabelled documents by cell; at most 4 * CELLS rows.

    The half of a document comes from a hash of its text.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("d"), _cell(text).alias("cell"), _half(text).alias("half"))
    return _counted(_sides(rows, labels))


def class_prior(table: pd.DataFrame) -> float:
    """The share of positives among the unlabelled, from the best bin (Garg et al., 2021).

    In no set of cells can the unlabelled hold less than the prior times the share of positives. Cells are ordered by one
    half of the documents and their leading sets measured on the other, with a confidence margin.
    """
    wide = table.pivot_table(index="cell", columns=["half", "positive"], values="n", aggfunc="sum", fill_value=0)
    column = lambda half, positive: wide[(half, positive)].to_numpy(float) if (half, positive) in wide.columns else np.zeros(len(wide))
    found = []
    for one in (0, 1):
        p, u = column(one, True), column(one, False)
        order = np.argsort(-(p + 0.5) / (u + 1.0) * (u.sum() + 1) / (p.sum() + 1), kind="stable")
        p, u = column(1 - one, True)[order], column(1 - one, False)[order]
        if not p.sum() or not u.sum():
            continue
        share_p, share_u = np.cumsum(p) / p.sum(), np.cumsum(u) / u.sum()
        margin = np.sqrt(np.log(40) / (2 * u.sum())) + np.sqrt(np.log(40) / (2 * p.sum()))
        enough = share_p >= LEAST_MASS
        best = np.argmin(np.where(enough, (share_u + margin) / np.maximum(share_p, 1e-9), np.inf))
        found.append(share_u[best] / share_p[best])
    return float(np.clip(np.mean(found), 0.05, 0.98)) if found else 0.5


def _two_sided(table: pd.DataFrame) -> bool:
    positive = table["positive"].astype(bool)
    return bool(positive.any() and (~positive).any())


def fit(table: pd.DataFrame, prior: float | None = None) -> Model:
    """Weights that minimise the non-negative risk over all counted documents, by full-batch gradient steps (Adam).

    Without documents on either side there is nothing to tell good from bad, and every text scores 1.
    """
    if not _two_sided(table):
        return Model(1.0, tuple((0.0,) * WIDTH for _ in STEPS), float("inf"))
    prior = class_prior(table) if prior is None else prior
    grouped = table.groupby(["cell", "positive"])["n"].sum().unstack(fill_value=0)
    p, u = grouped[True].to_numpy(float), grouped[False].to_numpy(float)
    p, u = p / p.sum(), u / u.sum()
    steps = steps_of(grouped.index.to_numpy())
    x = np.zeros((len(steps), len(STEPS) * WIDTH + 1))
    x[np.arange(len(steps))[:, None], steps + np.arange(len(STEPS)) * WIDTH] = 1
    x[:, -1] = 1
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, ROUNDS + 1):
        s = 1 / (1 + np.exp(-(x @ w)))
        # Logistic loss: -log s as a positive, -log(1 - s) as a negative.
        negative = float(-(u - prior * p) @ np.log(np.maximum(1 - s, 1e-12)))
        down = (u - prior * p) * s
        gradient = x.T @ (down - prior * p * (1 - s)) if negative >= 0 else -(x.T @ down)
        gradient[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(prior, tuple(tuple(map(float, w[i * WIDTH : (i + 1) * WIDTH])) for i in range(len(STEPS))), float(w[-1]))


def _logits(model: Model) -> np.ndarray:
    """The logit of every cell."""
    steps = steps_of(np.arange(CELLS))
    return model.offset + sum(np.array(w)[steps[:, i]] for i, w in enumerate(model.weights))


def _matrix(xs: pa.Array) -> np.ndarray:
    """Stored contents as rows of a matrix."""
    data = b"".join([_PACK.decompress(x.as_buffer(), CONTENT, asbytes=True) for x in xs])
    return np.frombuffer(data, dtype=np.uint8).reshape(len(xs), CONTENT)


def _of_batch(logits: np.ndarray, weights: np.ndarray, cell: np.ndarray, xs: pa.Array) -> np.ndarray:
    z = [_z(logits, weights, cell[i : i + _CHUNK], _matrix(xs[i : i + _CHUNK])) for i in range(0, len(cell), _CHUNK)]
    return np.concatenate(z or [np.zeros(0)])


def _z(logits: np.ndarray, content_weights: np.ndarray, cell: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Logits of documents. Products are whole numbers below 2**53, so sums are exact in any order."""
    return logits[cell] + (x.astype(float) @ content_weights) / (255 * _UNIT)


def _sums(rows: DataFrame, model: Model, weights: np.ndarray) -> np.ndarray:
    """Over unlabelled, then positive documents: s * x, x, the loss as a negative and the count; one partial sum a task."""
    logits, width = _logits(model), 2 * CONTENT + 2

    def partial(batches):
        total = np.zeros((2, width), dtype=np.int64)
        for batch in batches:
            cell, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i in range(0, len(cell), _CHUNK):
                x = _matrix(batch.column(2)[i : i + _CHUNK]).astype(float)
                z = _z(logits, weights, cell[i : i + _CHUNK], x)
                s = np.rint(_UNIT / (1 + np.exp(-z)))
                loss = np.rint(_UNIT * np.minimum(np.logaddexp(0, z), 30))
                mine = np.stack([side[i : i + _CHUNK] == k for k in (0, 1)]).astype(float)
                total += np.hstack([(mine * s) @ x, mine @ x, (mine @ loss)[:, None], mine.sum(axis=1)[:, None]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * width), pa.int32()), pa.array(total.ravel())], names=["j", "v"])

    parts = rows.select("cell", F.col("positive").cast("int").alias("side"), "x").mapInArrow(partial, "j int, v bigint")
    found = parts.where("v <> 0").groupBy("j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(2 * width)
    out[found["j"].to_numpy()] = found["v"].to_numpy(float)
    return out.reshape(2, width)


def _with_content(model: Model, rows: DataFrame, rounds: int) -> Model:
    """The model with content weights that lower the same risk, by accelerated full-batch steps; the ridge falls with the rows."""
    w = last = np.zeros(CONTENT)
    for t in range(rounds):
        ahead = np.rint((w + t / (t + 3) * (w - last)) * _UNIT)
        u, p = _sums(rows, model, ahead)
        if not (u[-1] and p[-1]):
            return model
        su, sp, xp = u[:CONTENT] / _UNIT / u[-1], p[:CONTENT] / _UNIT / p[-1], p[CONTENT:-2] / p[-1]
        down = (su - model.prior * sp) / 255
        up = model.prior * (xp - sp) / 255
        negative = u[-2] / u[-1] - model.prior * p[-2] / p[-1]
        ridge = max(LEAST_RIDGE, RIDGE / np.sqrt(min(u[-1], p[-1])))
        gradient = (down - up if negative >= 0 else -down) + ridge * ahead / _UNIT
        w, last = ahead / _UNIT - gradient / (SMOOTHNESS + ridge), w
    return model._replace(content=tuple(int(x) for x in np.rint(w * _UNIT)))


def _scored(model: Model, rows: DataFrame) -> DataFrame:
    """doc_id and score of stored rows."""
    logits, weights = _logits(model), np.array(model.content or (0,) * CONTENT, dtype=float)

    def scored(batches):
        for batch in batches:
            z = _of_batch(logits, weights, batch.column(1).to_numpy(zero_copy_only=False), batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], names=["doc_id", "score"])

    return rows.select(F.col("d").alias("doc_id"), "cell", "x").mapInArrow(scored, "doc_id bigint, score double")


def _content_prior(model: Model, rows: DataFrame) -> float:
    """The prior by scores: weights from one half of the documents, score bins counted over the other half."""
    part = _with_content(model, rows.where("half = 0 and positive is not null"), PRIOR_ROUNDS)
    logits, weights = _logits(part), np.array(part.content or (0,) * CONTENT, dtype=float)

    def binned(batches):
        for batch in batches:
            z = _of_batch(logits, weights, batch.column(0).to_numpy(zero_copy_only=False), batch.column(1))
            bins = np.clip(np.floor(8 * z), -80, 80).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(2), batch.column(3)], names=["cell", "half", "positive"])

    other = rows.where("half = 1 and positive is not null").select("cell", "x", F.col("quarter").alias("half"), "positive")
    table = other.mapInArrow(binned, "cell int, half int, positive boolean").groupBy("cell", "half", "positive").agg(F.count("*").alias("n")).toPandas()
    return class_prior(table) if _two_sided(table) else model.prior


def learn(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the stored rows (d, cell, half, quarter, positive, x), one per document."""
    text = F.col("text").cast("string")
    quarter = F.pmod(F.shiftright(F.xxhash64(text), 1), F.lit(2)).cast("int").alias("quarter")
    described = docs.select(F.col("doc_id").cast("bigint").alias("d"), _half(text).alias("half"), quarter, _described(text).alias("c"))
    rows = stored(_sides(described.select("d", "half", "quarter", "c.cell", "c.x"), labels), "quality-content")
    table = _counted(rows)
    model = fit(table)
    if not _two_sided(table):
        return model, rows
    prior = min(model.prior, _content_prior(model, rows))
    return _with_content(fit(table, prior), rows.where("positive is not null"), CONTENT_ROUNDS), rows


def score(model: Model, text: Column) -> Column:
    """0 to 1, likelier good the higher."""
    logits, weights = _logits(model), np.array(model.content or (0,) * CONTENT, dtype=float)

    def scored(texts: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(texts), _CHUNK):
            some = texts.iloc[i : i + _CHUNK]
            x = np.frombuffer(b"".join(map(content, some)), dtype=np.uint8).reshape(len(some), CONTENT)
            out.append(_z(logits, weights, cells(some).to_numpy(), x))
        return pd.Series(1 / (1 + np.exp(-np.concatenate(out or [np.zeros(0)]))))

    return F.pandas_udf(scored, "double")(text.cast("string"))


def scores(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """One row (doc_id, held_out, score, predicted) per document.

    Null and empty texts have a score like any other; null ids are never labelled and not held out; repeated rows keep
    their rows; labels without id or quality are ignored, and documents labelled both ways are not trusted; without trusted or
    without unlabelled documents every score is 1; other columns are ignored; an empty table gives no rows.
    """
    model, rows = learn(docs, labels)
    return _scored(model, rows).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= keep).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``keep``; all of them where a side of the learning is empty."""
    return docs.where(score(learn(docs, labels)[0], F.col("text")) >= keep)
