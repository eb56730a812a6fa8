"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.common import WORD, numbered, stored

CYCLE = 3
MOST = 3
STEPS = 60
TOLERANCE = 1e-6
BUCKETS = 1024


def _mark() -> Column:
    """A fixed random number of a document."""
    return F.xxhash64("doc_id", F.col("text").cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; 0 for null), u (a fixed random number of the document), row (a row number)."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        _mark().alias("u"),
        F.monotonically_increasing_id().alias("row"),
    )
    return stored(rows, "mix-sizes")


def targets(sources: DataFrame, cycle: int = CYCLE, most: int = MOST) -> DataFrame:
    """Adds sid, weight and target to (source, source_size, n_docs), one row per source.

    Sources by code point, null last, weigh 1 to ``cycle``, repeating. A target is ``min(most * source_size, level *
    weight)`` where the level makes the targets add up to all sizes: raising the level over the uncapped sources until
    no source newly reaches its cap reshares the excess by weight.
    """
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "sid", "mix-sources")
    ranked = stored(
        ranked.withColumn("weight", (F.col("sid") % cycle + 1).cast("double")).withColumn("cap", (F.col("source_size") * most).cast("double")),
        "mix-weights",
    )
    total, weights = ranked.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level = total / weights if weights else 0.0
    while True:
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        fixed, free = ranked.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        higher = (total - (fixed or 0.0)) / free if free else level
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return ranked.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).drop("cap")


def _rate(most: int) -> Column:
    """Copies per document: the exponential tilt of its size, stopped at ``most``."""
    tilt = F.exp(F.least(F.col("lam") * F.col("x"), F.lit(50.0)))
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(tilt, F.lit(float(most))))


def tilts(classes: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """sid, lam, full: the multiplier of each source, by Newton's method on the dual of the entropy problem.

    Minimising the sum of r ln r - r over the documents of a source, subject to sum(r * size) = target and r <= most,
    gives r = min(most, exp(lam * size)); the dual is convex with gradient sum(r * size) - target. ``classes`` holds one
    row per source and size (n documents), so a step is one join and one partial aggregate however many documents there
    are. Steps are taken on the logarithm of the tokens and kept inside a bracket that halves if Newton leaves it.
    Sources whose target is their cap take ``most`` copies throughout (``full``).
    """
    state = goals.select(
        "sid", "target", (F.col("target") >= F.col("source_size") * most * (1 - 1e-12)).alias("full"),
        F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(False).alias("done"),
    )
    state = stored(state.withColumn("done", F.col("full") | (F.col("target") <= 0)), "mix-dual")
    for _ in range(STEPS):
        r, tokens = _rate(most), F.col("n") * F.col("size")
        sums = (
            classes.join(state.where("not done"), "sid")
            .select("sid", (tokens * r).alias("f"), F.when(r < most, tokens * r * F.col("x")).otherwise(0.0).alias("g"))
            .groupBy("sid").agg(F.sum("f").alias("f"), F.sum("g").alias("g"))
        )
        gap = F.log("target") - F.log("f")
        newton = F.col("lam") + F.when(F.col("g") > 0, gap * F.col("f") / F.col("g"))
        lo = F.when(gap > 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("hi"))
        inside = newton.isNotNull() & (lo.isNull() | (newton > lo)) & (hi.isNull() | (newton < hi))
        away = F.when(hi.isNull(), lo * 2 + 1).when(lo.isNull(), hi * 2 - 1).otherwise((lo + hi) / 2)
        stepped = state.join(sums, "sid", "left").select(
            "sid", "target", "full",
            F.when(F.col("f").isNull() | (F.abs(gap) < TOLERANCE), F.col("lam")).when(inside, newton).otherwise(away).alias("lam"),
            F.when(F.col("f").isNull(), F.col("lo")).otherwise(lo).alias("lo"),
            F.when(F.col("f").isNull(), F.col("hi")).otherwise(hi).alias("hi"),
            (F.col("done") | F.coalesce(F.abs(gap) < TOLERANCE, F.lit(True))).alias("done"),
        )
        state = stored(stepped, "mix-dual")
        if state.where("not done").isEmpty():
            break
    return state.select("sid", "lam", "full")


def quotas(classes: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """sid, size, n, base, extra: ``extra`` of the n documents of a size take base + 1 copies, the others base.

    Rates are rounded along the sizes of a source, largest first, so that the running number of copies is never more than
    one off; what is left of the target is then made up from the largest size that fits, round by round. A source has as
    many rows here as it has different sizes, which the length of a document bounds, not the number of documents.
    """
    along = Window.partitionBy("sid").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0)
    r = _rate(most)
    rounded = (
        classes.join(tilts(classes, goals, most), "sid")
        .withColumn("base", F.floor(r)).withColumn("part", r - F.floor(r))
        .withColumn("upto", F.sum(F.col("n") * F.col("part")).over(along))
        .withColumn("extra", F.floor(F.col("upto") + 0.5) - F.floor(F.greatest(F.col("upto") - F.col("n") * F.col("part"), F.lit(0.0)) + 0.5))
        .withColumn("extra", F.greatest(F.lit(0), F.least("n", "extra")).cast("bigint"))
        .select("sid", "size", "n", F.col("base").cast("bigint").alias("base"), "extra")
    )
    table = stored(rounded, "mix-quota")
    for _ in range(STEPS):
        taken = table.groupBy("sid").agg(F.sum(F.col("size") * (F.col("n") * F.col("base") + F.col("extra"))).alias("taken"))
        left = goals.select("sid", "target").join(taken, "sid").select("sid", (F.col("target") - F.col("taken")).alias("left"))
        room = F.when(F.col("left") > 0, F.when(F.col("base") < most, F.col("n") - F.col("extra")).otherwise(0)).otherwise(F.col("extra"))
        change = (
            table.join(left, "sid")
            .withColumn("k", F.least(room, F.floor(F.abs("left") / F.col("size")).cast("bigint")))
            .where((F.col("size") > 0) & (F.col("k") > 0))
            .groupBy("sid").agg(F.max(F.struct("size", (F.col("k") * F.signum("left")).cast("bigint").alias("k"))).alias("c"))
            .select("sid", F.col("c.size").alias("size"), F.col("c.k").alias("k"))
        )
        change = stored(change, "mix-change")
        if change.isEmpty():
            break
        table = stored(
            table.join(change, ["sid", "size"], "left").withColumn("extra", F.col("extra") + F.coalesce("k", F.lit(0))).drop("k"), "mix-quota"
        )
    return table


def _mixed(docs: DataFrame, cycle: int, most: int) -> DataFrame:
    rows = sized(docs)
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goals = stored(targets(sources, cycle, most), "mix-targets")
    rows = rows.join(goals.select(F.col("source").alias("_s"), "sid"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    mean = F.col("source_size") / F.col("n_docs")
    classes = rows.groupBy("sid", "size").agg(F.count("*").alias("n"))
    classes = stored(classes.join(goals, "sid").select("sid", "size", "n", F.coalesce(F.try_divide("size", mean), F.lit(0.0)).alias("x")), "mix-classes")
    table = quotas(classes, goals, most)
    # A size may hold a large share of all rows; hash buckets keep the ranked groups small.
    rows = rows.withColumn("b", F.pmod("u", F.lit(BUCKETS)))
    group = ["sid", "size", "b"]
    counts = rows.groupBy(*group).agg(F.count("*").alias("n_b"))
    before = Window.partitionBy("sid", "size").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    shares = (
        counts.withColumn("before", F.coalesce(F.sum("n_b").over(before), F.lit(0)))
        .join(table.select("sid", "size", "base", "extra"), ["sid", "size"])
        .select(*group, "base", F.greatest(F.lit(0), F.least("n_b", F.col("extra") - F.col("before"))).alias("more"))
    )
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy(*group).orderBy("u", "doc_id", "row")))
    copies = F.col("base") + F.when(F.col("at") <= F.col("more"), 1).otherwise(0)
    chosen = ranked.join(shares, group).withColumn("copies", copies.cast("bigint"))
    return chosen.join(goals.select("sid", "source_size", "target"), "sid").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "u"
    )


def mix(docs: DataFrame, cycle: int = CYCLE, most: int = MOST) -> DataFrame:
    """One row (doc_id, size, source_size, target, taken, copies) per document; ``taken`` = size * copies.

    A null text has size 0 and takes nothing; null sources are one source, the last; a null doc_id keeps its row; repeated
    rows are documents of their own; other columns are ignored; an empty table gives no rows. No document has more than
    ``most`` copies. Choices hang on hashes of doc_id and text only, so reruns agree.
    """
    return _mixed(docs, cycle, most).drop("u")


def mixture(docs: DataFrame, cycle: int = CYCLE, most: int = MOST) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it has copies, with all its columns and mix_target, mix_copies, mix_copy.

    ``mix_copy`` counts the copies of a row from 1. Columns of these names in ``docs`` are replaced.
    """
    added = ("mix_target", "mix_copies", "mix_copy")
    last = F.lit((1 << 63) - 1)
    chosen = _mixed(docs, cycle, most).select(F.coalesce("doc_id", last).alias("_k"), F.col("u").alias("_u"), "copies", "target")
    # Rows that repeat id and text are alike: it matters only how many of them have how many copies.
    shares = chosen.groupBy("_k", "_u", "target", "copies").agg(F.count("*").alias("n"))
    plan = shares.groupBy("_k", "_u").agg(F.sort_array(F.collect_list(F.struct("copies", "n", "target")), asc=False).alias("_plan"))
    keyed = docs.drop(*added).withColumns({"_k": F.coalesce(F.col("doc_id").cast("bigint"), last), "_u": _mark()})
    # The window goes by the columns of the join, so texts cross the network once.
    joined = keyed.join(stored(plan, "mix-plan"), ["_k", "_u"]).withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_u").orderBy("_u")))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("bigint").alias("copies"), F.lit(None).cast("double").alias("target"))

    def step(done: Column, part: Column) -> Column:
        mine = done["copies"].isNull() & (F.col("_n") <= done["seen"] + part["n"])
        return F.struct(
            (done["seen"] + part["n"]).alias("seen"), F.when(mine, part["copies"]).otherwise(done["copies"]).alias("copies"),
            F.when(mine, part["target"]).otherwise(done["target"]).alias("target"),
        )

    mine = joined.withColumn("_mine", F.aggregate("_plan", start, step)).where("_mine.copies > 0")
    return mine.select(
        *[c for c in docs.columns if c not in added], F.col("_mine.target").alias("mix_target"), F.col("_mine.copies").alias("mix_copies"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_mine.copies"))).alias("mix_copy"),
    )
