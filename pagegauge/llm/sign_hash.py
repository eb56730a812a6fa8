"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosines, connected components.

Each table cuts the space by ``bits`` random hyperplanes; vectors on the same side of all of them share a bucket and their
cosine is measured. Bits follow from the number of vectors (a bucket holds about one stranger per two vectors) and tables
from the bits and the wanted recall at the threshold itself; closer pairs are found more surely.

Nothing is formed in the square of a group of copies. Equal vectors are one vector with a weight. In crowded buckets of the
first tables the vector with the smallest number is a pivot; vectors within half the threshold's angle of a pivot are a ball,
and by the triangle inequality all its pairs are links that are counted without being formed. What is hashed against each
other are units: balls and single vectors. Two balls are linked or strangers as a whole where the angle of their pivots and
their radii decide it; else their members are measured block by block. Buckets are split into blocks as well, and a block
gives sums and spanning edges, not pairs. A pair that shares several buckets counts in the first.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegauge.llm.common import components, spread_join, stored
from pagegauge.llm.vectors import finite_rows

COSINE = 0.93
RECALL = 0.995
SEED = 11
PIVOT_TABLES = 4
CROWD = 32
BLOCK = 1024
# Far above the rounding of angles, far below any difference of angles that matters.
_MARGIN = 1e-6
_TILE = 1 << 20
_COUNT, _EDGE, _WHOLE, _OPEN = range(4)
_LINKS = "kind int, a bigint, b bigint, w bigint"


def tables_for(vectors: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for so many vectors that may be compared: two vectors at the threshold share a bucket with probability ``recall``."""
    bits = min(31, max(4, math.ceil(math.log2(max(2, vectors))) + 1))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(PIVOT_TABLES, math.ceil(math.log(1 - recall) / math.log(1 - together)))


class Signs:
    """Bucket numbers of unit vectors in every table; the planes of each length of vector follow from the seed."""

    def __init__(self, bits: int, tables: int, seed: int = SEED):
        self.bits, self.tables, self.seed, self.planes = bits, tables, seed, {}

    def __call__(self, units: np.ndarray) -> np.ndarray:
        length = units.shape[1]
        if length not in self.planes:
            self.planes[length] = np.random.default_rng([self.seed, length]).normal(size=(length, self.tables * self.bits))
        signs = (units @ self.planes[length] > 0).reshape(len(units), self.tables, self.bits)
        return (signs << np.arange(self.bits)).sum(axis=2).astype(np.int32)


def _unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision whatever their size."""
    scaled = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _units(values: list[bytes], kind) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(values), dtype=kind).reshape(len(values), -1).astype(np.float64))


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the smallest node that the pairs (a, b) reach: as connected as the pairs, one per node at most."""
    least = np.arange(n)
    while True:
        now = least.copy()
        np.minimum.at(now, a, least[b])
        np.minimum.at(now, b, least[a])
        now = now[now]
        if (now == least).all():
            own = np.flatnonzero(least != np.arange(n))
            return own, least[own]
        least = now


def _rows(vectors: DataFrame) -> tuple[DataFrame, type]:
    """row, vec_id and, for vectors that may be compared, space (length and label), d1, d2 (digest of the values), v (their bytes)."""
    double = dict(vectors.dtypes)["embedding"] == "array<double>"
    kind = np.float64 if double else np.float32

    def run(batches):
        for batch in batches:
            labels, n = batch["label"].to_pylist(), batch.num_rows
            space, digests, values = [None] * n, np.zeros((n, 2), dtype=np.int64), [None] * n
            for rows, matrix in finite_rows(batch["embedding"]):
                some = (matrix != 0).any(axis=1)
                for i, row in zip(rows[some].tolist(), matrix[some].astype(kind), strict=True):
                    if labels[i] is not None:
                        values[i] = row.tobytes()
                        space[i] = f"{len(row)}/{labels[i]}"
                        digests[i] = np.frombuffer(hashlib.blake2b(values[i], digest_size=16).digest(), dtype=np.int64)
            arrays = [batch["vec_id"], pa.array(space, pa.string()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "space", "d1", "d2", "v"])

    chosen = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    rows = chosen.mapInArrow(run, "vec_id bigint, space string, d1 bigint, d2 bigint, v binary")
    # Numbers are fixed once the table is written.
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors"), kind


def _hashed(rows: DataFrame, kind: type, cosine: float, recall: float, seed: int, salts: int) -> tuple[DataFrame, int]:
    """uid, space, d1, d2, v, n (rows that hold it), least (smallest vec_id), signs: one row per different vector; the number of tables."""
    key = ["space", "d1", "d2"]
    some = rows.where("v is not null").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    # Copies meet salt by salt before they meet at all.
    parts = some.groupBy(*key, "salt").agg(F.min("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    different = parts.groupBy(*key).agg(F.min("v").alias("v"), F.sum("n").alias("n"), F.min("least").alias("least"))
    different = stored(different.withColumn("uid", F.monotonically_increasing_id()), "different-vectors")
    crowd = different.groupBy("space").count().agg(F.max("count")).first()[0] or 0
    signs = Signs(*tables_for(crowd, cosine, recall), seed)

    def run(batches):
        for batch in batches:
            values = batch["v"].to_pylist()
            lengths = np.array([len(v) for v in values])
            out = np.zeros((len(values), signs.tables), dtype=np.int32)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                out[at] = signs(_units([values[i] for i in at], kind))
            offsets = np.arange(0, out.size + 1, signs.tables, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch["uid"], pa.ListArray.from_arrays(offsets, out.ravel())], ["uid", "signs"])

    found = different.select("uid", "v").mapInArrow(run, "uid bigint, signs array<int>")
    return stored(different.join(found, "uid"), "signs"), signs.tables


def _balls(hashed: DataFrame, kind: type, cosine: float, salts: int) -> DataFrame:
    """uid, pivot, angle: the vectors that lie within half the threshold's angle of a pivot of one of their crowded buckets."""
    half = math.acos(cosine) / 2 - _MARGIN
    first = F.posexplode(F.slice("signs", 1, PIVOT_TABLES)).alias("t", "s")
    posts = hashed.select("uid", "space", first).withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)))
    bucket = ["space", "t", "s"]
    parts = posts.groupBy(*bucket, "salt").agg(F.min("uid").alias("pivot"), F.count("*").alias("n"))
    pivots = parts.groupBy(*bucket).agg(F.min("pivot").alias("pivot"), F.sum("n").alias("n")).where(F.col("n") >= CROWD)
    pivots = pivots.join(hashed.select(F.col("uid").alias("pivot"), F.col("v").alias("pv")), "pivot")
    near = posts.join(parts.select(*bucket, "salt").join(pivots, bucket), [*bucket, "salt"]).select("uid", "pivot", "n", "pv")
    near = near.join(hashed.select("uid", "v"), "uid")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                mine, theirs = batch["v"].to_pylist(), batch["pv"].to_pylist()
                lengths = np.array([len(v) for v in mine])
                angle = np.zeros(len(mine))
                for n in np.unique(lengths):
                    at = np.flatnonzero(lengths == n)
                    cosines = (_units([mine[i] for i in at], kind) * _units([theirs[i] for i in at], kind)).sum(axis=1)
                    angle[at] = np.arccos(np.clip(cosines, -1, 1))
                inside = pa.array(np.flatnonzero(angle <= half))
                yield pa.RecordBatch.from_arrays([batch["uid"].take(inside), batch["pivot"].take(inside), batch["n"].take(inside), pa.array(angle).take(inside)], ["uid", "pivot", "n", "angle"])

    # The most crowded bucket's pivot, so that balls are few and large.
    found = near.mapInArrow(run, "uid bigint, pivot bigint, n bigint, angle double")
    best = found.groupBy("uid").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"), "angle")).alias("best"))
    return best.select("uid", (-F.col("best.p")).alias("pivot"), F.col("best.angle").alias("angle"))


def _tiles(sizes: list[tuple[int, int, int]]):
    """Pairs (i, j) of rows of groups (begin, middle, end): inside the group if middle is end, else across the middle; bounded pieces."""
    held_i, held_j, held = [], [], 0
    for begin, middle, end in sizes:
        inside = middle == end
        width = end - begin if inside else end - middle
        step = max(1, _TILE // max(1, width))
        for at in range(begin, end if inside else middle, step):
            upto = min(at + step, end if inside else middle)
            i, j = np.meshgrid(np.arange(at, upto), np.arange(begin if inside else middle, end), indexing="ij")
            i, j = i.ravel(), j.ravel()
            if inside:
                i, j = i[i < j], j[i < j]
            held_i.append(i), held_j.append(j)
            held += len(i)
            if held >= _TILE:
                yield np.concatenate(held_i), np.concatenate(held_j)
                held_i, held_j, held = [], [], 0
    if held:
        yield np.concatenate(held_i), np.concatenate(held_j)


def _grouped(batch: pa.RecordBatch):
    """Groups of a batch: their rows as one struct array, ordered by side, and (begin, middle, end) of each."""
    lists = batch["members"]
    rows = lists.flatten()
    ends = np.cumsum(np.array([len(x) for x in lists]))
    side = rows.field("side").to_numpy(zero_copy_only=False)
    group = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    order = np.lexsort((side, group))
    sizes = []
    for k, end in enumerate(ends.tolist()):
        begin = ends[k - 1].item() if k else 0
        zeros = int((side[begin:end] == 0).sum())
        sizes.append((begin, begin + zeros, end))
    return rows.take(pa.array(order)), sizes


def _by_length(sizes, lengths):
    """Groups by the length of their vectors, which is one for a group."""
    for n in sorted({int(lengths[begin]) for begin, _, end in sizes if end > begin}):
        yield [s for s in sizes if s[2] > s[0] and lengths[s[0]] == n]


def _dots(units: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        piece = slice(at, at + (1 << 16))
        out[piece] = np.einsum("ij,ij->i", units[i[piece]], units[j[piece]])
    return out


def _emit(pieces: list[tuple]) -> pa.RecordBatch:
    """(kind, a, b, w) arrays as one batch."""
    kinds = [np.full(len(a), kind, dtype=np.int32) for kind, a, _, _ in pieces]
    columns = [np.concatenate(c) if pieces else np.zeros(0, dtype=np.int64) for c in zip(*(p[1:] for p in pieces), strict=True)] or [np.zeros(0, dtype=np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds) if pieces else np.zeros(0, dtype=np.int32)), *map(pa.array, columns)], ["kind", "a", "b", "w"])


def _compared(groups: DataFrame, kind: type, cosine: float) -> DataFrame:
    """What the units of each block of a bucket have in common, as (kind, a, b, w).

    _COUNT: unit a, a single vector, has w links more. _EDGE: a and b are connected. _WHOLE: a is linked with all w vectors of b.
    _OPEN: a and b have to be measured member by member.
    """
    theta = math.acos(cosine)

    def run(batches):
        for batch in batches:
            rows, sizes = _grouped(batch)
            values = rows.field("v").to_pylist()
            unit, weight = rows.field("unit").to_numpy(), rows.field("weight").to_numpy()
            radius, single = rows.field("radius").to_numpy(), rows.field("single").to_numpy(zero_copy_only=False)
            lengths = np.array([len(v) for v in values])
            table = np.zeros(len(values), dtype=np.int64)
            for (begin, _, end), t in zip(sizes, batch["t"].to_pylist(), strict=True):
                table[begin:end] = t
            # Balls carry no signs; theirs are never looked at.
            signs = np.zeros((len(values), 0), dtype=np.int32)
            own = np.flatnonzero(single)
            if len(own):
                flat = rows.field("signs").take(pa.array(own)).flatten().to_numpy()
                signs = np.zeros((len(values), len(flat) // len(own)), dtype=np.int32)
                signs[own] = flat.reshape(len(own), -1)
            pieces = []
            for some in _by_length(sizes, lengths):
                low, high = min(s[0] for s in some), max(s[2] for s in some)
                at = low + np.flatnonzero(lengths[low:high] == lengths[some[0][0]])
                units = np.zeros((high, lengths[some[0][0]] // np.dtype(kind).itemsize))
                units[at] = _units([values[k] for k in at], kind)
                for i, j in _tiles(some):
                    cosines = _dots(units, i, j)
                    plain = single[i] & single[j]
                    hit = np.flatnonzero(plain & (cosines >= cosine))
                    if len(hit):
                        a, b = i[hit], j[hit]
                        # The first table that a pair shares counts it.
                        before = np.arange(signs.shape[1]) < table[a][:, None]
                        first = ~((signs[a] == signs[b]) & before).any(axis=1)
                        a, b = a[first], b[first]
                        more = np.zeros(len(values), dtype=np.int64)
                        np.add.at(more, a, weight[b])
                        np.add.at(more, b, weight[a])
                        some_more = np.flatnonzero(more)
                        pieces.append((_COUNT, unit[some_more], unit[some_more], more[some_more]))
                        near, far = _stars(len(values), a, b)
                        pieces.append((_EDGE, unit[near], unit[far], np.zeros(len(near), dtype=np.int64)))
                    mixed = np.flatnonzero(~plain)
                    if len(mixed):
                        a, b = i[mixed], j[mixed]
                        angle = np.arccos(np.clip(cosines[mixed], -1, 1))
                        slack = radius[a] + radius[b] + _MARGIN
                        whole = angle + slack <= theta
                        for x, y in ((a, b), (b, a)):
                            pieces.append((_WHOLE, unit[x[whole]], unit[y[whole]], weight[y[whole]]))
                        unsure = ~whole & (angle - slack <= theta)
                        x, y = unit[a[unsure]], unit[b[unsure]]
                        pieces.append((_OPEN, np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), dtype=np.int64)))
            yield _emit(pieces)

    return groups.mapInArrow(run, _LINKS)


def _measured(groups: DataFrame, kind: type, cosine: float) -> DataFrame:
    """Links between the members of two units, block against block: _COUNT per member and one _EDGE per pair of units."""

    def run(batches):
        for batch in batches:
            rows, sizes = _grouped(batch)
            values = rows.field("v").to_pylist()
            uid, n = rows.field("uid").to_numpy(), rows.field("n").to_numpy()
            pieces = []
            for (begin, middle, end), a, b in zip(sizes, batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
                if begin == middle or middle == end:
                    continue
                units = _units(values[begin:end], kind)
                linked = units[: middle - begin] @ units[middle - begin :].T >= cosine
                if linked.any():
                    more = np.concatenate([linked @ n[middle:end], n[begin:middle] @ linked])
                    some = np.flatnonzero(more)
                    pieces.append((_COUNT, uid[begin + some], uid[begin + some], more[some]))
                    pieces.append((_EDGE, np.array([a]), np.array([b]), np.array([0])))
            yield _emit(pieces)

    return groups.mapInArrow(run, _LINKS)


def _between(members: DataFrame, units: DataFrame, kind: type, cosine: float, salts: int) -> DataFrame:
    """What units that share a bucket have in common (see ``_compared``)."""
    key = ["space", "t", "s"]
    posts = members.select("unit", "space", F.posexplode("signs").alias("t", "s")).distinct()
    posts = stored(posts, "postings")
    shared = posts.withColumn("salt", F.pmod(F.xxhash64("unit"), F.lit(salts))).groupBy(*key, "salt").agg(F.count("*").alias("n"))
    shared = shared.groupBy(*key).agg(F.sum("n").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    posts = stored(spread_join(posts, shared, key, ["unit"], salts), "shared-postings")
    posts = spread_join(posts, units, ["unit"], ["t", "s"], salts)
    # Every two blocks of a bucket meet once.
    mine = F.pmod(F.xxhash64("unit", F.lit(1)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    posts = posts.withColumn("mine", mine).withColumn("other", other)
    member = F.struct((F.col("mine") > F.col("other")).cast("int").alias("side"), "unit", "v", "radius", "weight", "single", "signs")
    groups = (
        posts.withColumn("lo", F.least("mine", "other")).withColumn("hi", F.greatest("mine", "other"))
        .groupBy(*key, "lo", "hi").agg(F.collect_list(member).alias("members")).where(F.size("members") > 1)
    )
    return stored(_compared(groups.select("t", "members"), kind, cosine), "unit-links")


def _open(pairs: DataFrame, members: DataFrame, units: DataFrame, kind: type, cosine: float, salts: int) -> DataFrame:
    """Links between the members of the open ``pairs`` (a, b) of units."""
    blocks = units.select("unit", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    of = lambda c, name: blocks.withColumnsRenamed({"unit": c, "blocks": name})
    every = pairs.join(of("a", "na"), "a").join(of("b", "nb"), "b").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    every = every.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    sides = every.select("a", "b", "i", "j", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("a").alias("unit"), F.col("i").alias("block")),
        F.struct(F.lit(1).alias("side"), F.col("b").alias("unit"), F.col("j").alias("block")),
    )).alias("x")).select("a", "b", "i", "j", "x.*")
    wanted = pairs.select(F.col("a").alias("unit")).union(pairs.select("b")).distinct().join(blocks, "unit")
    own = spread_join(members, wanted, ["unit"], ["uid"], salts).withColumn("block", F.pmod(F.xxhash64("uid", F.lit(1)), F.col("blocks")).cast("int"))
    met = sides.join(own.select("unit", "block", "uid", "n", "v"), ["unit", "block"])
    groups = met.groupBy("a", "b", "i", "j").agg(F.collect_list(F.struct("side", "uid", "n", "v")).alias("members"))
    return stored(_measured(groups.select("a", "b", "members"), kind, cosine), "member-links")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """One row (vec_id, n_links, component_id, kept) per vector.

    Vectors are compared if their labels are equal and not null and their lengths are equal; they are linked if a table has
    them in one bucket and their cosine, in double precision, is at least ``cosine`` (above zero). ``n_links`` counts the
    other rows linked directly, copies and rows that repeat an id included; ``component_id`` is the smallest vec_id that
    links reach, ``kept`` whether that is the row's own. Null and empty vectors, zero vectors and those with null or
    non-finite components have no links and are their own component. A null vec_id keeps its row and is its component's id
    only if no other id is there. Other columns are ignored; an empty table gives no rows.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    rows, kind = _rows(vectors)
    # A key with a third of all rows is dealt over so many parts that each is small.
    salts = max(16, rows.count() // 500_000)
    hashed, _ = _hashed(rows, kind, cosine, recall, seed, salts)
    balls = stored(_balls(hashed, kind, cosine, salts), "balls")
    members = hashed.join(balls, "uid", "left").select(
        "uid", "space", "n", "v", "signs", "least", F.coalesce("pivot", "uid").alias("unit"), F.coalesce("angle", F.lit(0.0)).alias("angle"),
        F.col("pivot").isNull().alias("single"),
    )
    members = stored(members, "members")
    sizes = members.groupBy("unit").agg(
        F.sum("n").alias("weight"), F.count("*").alias("members"), F.max("angle").alias("radius"), F.min("least").alias("least"), F.max("single").alias("single")
    )
    # A ball has its pivot's place, a single vector its own and its signs.
    place = hashed.select(F.col("uid").alias("unit"), "v", "signs")
    units = stored(sizes.join(place, "unit").withColumn("signs", F.when(F.col("single"), F.col("signs"))), "units")
    found = _between(members, units.select("unit", "v", "radius", "weight", "single", "signs"), kind, cosine, salts)
    whole = found.where(F.col("kind") == _WHOLE).distinct()
    pairs = stored(found.where(F.col("kind") == _OPEN).select("a", "b").distinct(), "open-pairs")
    opened = _open(pairs, members, units, kind, cosine, salts)
    more = found.where(F.col("kind") == _COUNT).unionByName(whole).groupBy(F.col("a").alias("unit")).agg(F.sum("w").alias("more"))
    edges = found.where(F.col("kind") == _EDGE).unionByName(whole).unionByName(opened.where(F.col("kind") == _EDGE)).select("a", "b")
    roots = components(edges, "vector-links").withColumnRenamed("node", "unit")
    rooted = stored(
        units.select("unit", "weight", "least").join(more, "unit", "left").join(roots, "unit", "left")
        .select("unit", "least", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("links"), F.coalesce("root", "unit").alias("root")),
        "unit-roots",
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    results = rooted.join(least, "root").select("unit", "links", "component_id")
    beside = opened.where(F.col("kind") == _COUNT).groupBy(F.col("a").alias("uid")).agg(F.sum("w").alias("beside"))
    of_vector = spread_join(members.select("uid", "unit"), results, ["unit"], ["uid"], salts).join(beside, "uid", "left")
    of_vector = of_vector.select("uid", (F.col("links") + F.coalesce("beside", F.lit(0))).alias("n_links"), "component_id")
    of_value = stored(hashed.select("uid", "space", "d1", "d2").join(of_vector, "uid").drop("uid"), "vector-results")
    slim = rows.select("row", "vec_id", "space", "d1", "d2")
    compared = spread_join(slim.where("space is not null"), of_value, ["space", "d1", "d2"], ["row"], salts).select("vec_id", "n_links", "component_id")
    alone = slim.where("space is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return compared.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
