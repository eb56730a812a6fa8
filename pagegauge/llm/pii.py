"""Personal data: overlapping candidate spans, judged by gradient-boosted trees; DataFrame operations only.

Generators propose spans. Four of them are the base patterns, whose valid matches always count. The base patterns are greedy
and never retry, so a number that stands next to another one is lost in a failed match; the other generators propose the
pieces. Boosted trees learn from the base matches (valid: yes, failed or cut differently: no) what the format and the
surroundings of personal data look like, and pieces that score above a calibrated threshold are added where no base
span is.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
# At most so many different candidates train the trees, an equal share of each kind and class (those with the smallest hashes),
# weighted by how often they occur. The thresholds are calibrated on all candidates of the other half.
TRAIN_ROWS = 50_000
TREES, DEPTH = 12, 3
PRECISION = 0.99
LEAST_THRESHOLD = 0.8
BINS = 100
CONTEXT = 16


class Generator(NamedTuple):
    kind: int
    base: bool
    needs: str  # a text without a match of this has no candidate
    start: str  # what must hold where a candidate starts, unless it follows the last one at once
    pattern: str


# Possessive quantifiers keep Java's matcher off the stack; nothing that follows them could use what they hold.
GENERATORS = (
    Generator(0, True, "@", r"(?<![A-Za-z0-9._%+-])", r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Generator(1, True, r"[0-9]\.[0-9]", r"(?<![0-9])", r"[0-9]++(?:\.[0-9]++){3}"),
    Generator(2, True, r"[0-9][ -]?[0-9]", "", r"[0-9](?:[\x20-]?[0-9])++"),
    Generator(3, True, r"\+[0-9]", "", r"\+[0-9][\x20().0-9-]+[0-9]"),
    Generator(
        0, False, r"(?i)@|[(\[]at[)\]]", r"(?<![A-Za-z0-9._%+-])",
        r"[A-Za-z0-9._%+-]++(?:\x20{1,2}@\x20{0,2}|@\x20{1,2}|\x20?[(\[](?i:at)[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?)[A-Za-z0-9-]++)*"
        r"(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?)[A-Za-z]{2,}+(?![A-Za-z0-9-])",
    ),
    Generator(1, False, r"[0-9]\.[0-9]", r"(?<![0-9.])", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    Generator(2, False, r"[0-9]{13}", r"(?<![0-9])", r"[0-9]{13,19}(?![0-9])"),
    Generator(2, False, r"[0-9]{4}[ -][0-9]{4,6}[ -][0-9]", r"(?<![0-9])", r"(?:[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"),
    Generator(3, False, r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9])", r"(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    Generator(3, False, r"\+[0-9]", "", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,5}\)?(?:[ .-]?[0-9]{2,5}){1,3}(?![0-9])"),
)
_CANDIDATE = "struct<gen:int,i:int,before:int,left:string,span:string,right:string>"


def _found(text: Column, gen: int) -> Column:
    """Leftmost, non-overlapping matches of a generator, each with what lies between it and the last one.

    Each step consumes the gap lazily from the end of the last match, so the whole text is walked once.
    """
    g = GENERATORS[gen]
    start = rf"(?:\G|{g.start})" if g.start else ""
    whole = F.lit(rf"(?s)\G(.*?){start}({g.pattern})(?=(.?))")
    gaps, spans, rights = (F.regexp_extract_all(text, whole, F.lit(n)) for n in (1, 2, 3))
    rows = F.transform(
        F.arrays_zip(gaps.alias("gap"), spans.alias("span"), rights.alias("right")),
        lambda x, i: F.struct(
            F.lit(gen).alias("gen"), i.alias("i"), F.length(x["gap"]).alias("before"), F.right(x["gap"], F.lit(CONTEXT)).alias("left"),
            x["span"].alias("span"), x["right"].alias("right"),
        ),
    )
    return F.when(F.regexp_like(text, F.lit(g.needs)), rows).otherwise(F.array().cast(f"array<{_CANDIDATE}>"))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; for at most 19 digits, else false."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return total + doubled

    return F.when(n.between(12, 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def candidates(docs: DataFrame) -> DataFrame:
    """uid, doc_id, and per candidate kind, base, valid, start, end, span, left, right (stored); one row of nulls without any.

    ``start`` and ``end`` are code points, end exclusive; ``valid`` is the check of the kind; ``base`` marks base patterns.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("t"))
    found = F.explode_outer(F.flatten(F.array(*[_found(F.col("t"), g) for g in range(len(GENERATORS))])))
    raw = stored(rows.select("uid", "doc_id", found.alias("c")).select("uid", "doc_id", "c.*"), "pii-raw")
    along = Window.partitionBy("uid", "gen").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = raw.withColumn("size", F.length("span")).withColumn("end", F.sum(F.col("before") + F.col("size")).over(along).cast("bigint"))
    kind = F.get(F.array(*[F.lit(g.kind) for g in GENERATORS]), F.col("gen"))
    base = F.get(F.array(*[F.lit(g.base) for g in GENERATORS]), F.col("gen"))
    digits = F.regexp_replace("span", "[^0-9]", "")
    n = F.length(digits)
    octets = F.forall(F.split("span", r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(x, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    # Base cards have 16 digits at least; those that are added may have 13.
    least = F.when(F.col("base"), 16).otherwise(13)
    valid = (
        F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, octets)
        .when(F.col("kind") == 2, n.between(least, 19) & F.col("luhn")).when(F.col("kind") == 3, n.between(8, 15))
    )
    checked = (
        placed.withColumn("kind", kind).withColumn("base", base).withColumn("digits", digits).withColumn("luhn", (F.col("kind") == 2) & _luhn(F.col("digits")))
        .withColumn("valid", valid).withColumn("start", F.col("end") - F.col("size"))
    )
    return stored(checked.select("uid", "doc_id", "kind", "base", "valid", "luhn", "start", "end", "span", "left", "right"), "pii-candidates")


_WORDS = r"(?i)\b(?:tel|phone|call|mobile|fax|card|visa|credit|mail|contact|ip|host|server|address|ssn|account)\b"
FEATURES = (
    "is_email", "is_ip", "is_card", "is_phone", "n_digits", "n_chars", "n_marks", "n_groups", "longest_group", "shortest_group", "first_digit", "last_group",
    "luhn", "plus", "paren", "left_word", "left_plus", "right_word", "named",
)


def _features(rows: DataFrame) -> DataFrame:
    """Adds the numbers that describe the format and the surroundings of a candidate, as vector ``x``."""
    digits = F.regexp_replace("span", "[^0-9]", "")
    groups = F.transform(F.filter(F.split("span", "[^0-9]+"), lambda x: x != ""), lambda x: F.length(x))
    word = lambda c: F.regexp_like(c, F.lit(r"[\p{L}\p{N}_]"))
    numbers = {
        "is_email": F.col("kind") == 0, "is_ip": F.col("kind") == 1, "is_card": F.col("kind") == 2, "is_phone": F.col("kind") == 3,
        "n_digits": F.length(digits), "n_chars": F.length("span"), "n_marks": F.length(F.regexp_replace("span", "[0-9A-Za-z]", "")),
        "n_groups": F.size(groups), "longest_group": F.array_max(groups), "shortest_group": F.array_min(groups),
        "first_digit": F.left(digits, F.lit(1)).try_cast("int"), "last_group": F.try_element_at(groups, F.lit(-1)), "luhn": F.col("luhn"),
        "plus": F.startswith("span", F.lit("+")), "paren": F.contains("span", F.lit("(")),
        "left_word": word(F.right("left", F.lit(1))), "left_plus": F.endswith("left", F.lit("+")), "right_word": word(F.col("right")),
        "named": F.regexp_like("left", F.lit(_WORDS)),
    }
    columns = rows.withColumns({f"f_{k}": F.coalesce(v.cast("double"), F.lit(-1.0)) for k, v in numbers.items()})
    made = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="x").transform(columns)
    return made.drop(*[f"f_{k}" for k in FEATURES])


def _labelled(found: DataFrame) -> DataFrame:
    """Candidates with y: 1 if they are a valid base span, 0 if they fail or cut one differently, null if nobody knows.

    A piece of a longer base match that failed is what the trees are to judge, so it teaches them nothing; nor does a number
    of 13 to 15 digits that passes the Luhn check, which the base pattern is too strict for. Overlaps are found along the text: the furthest end of the base matches of the kind that start no later.
    """
    along = Window.partitionBy("uid", "kind").orderBy("start", F.desc("end"), F.desc("base")).rowsBetween(Window.unboundedPreceding, 0)
    cover = lambda ok: F.max(F.when(F.col("base") & (F.col("valid") == F.lit(ok)), F.struct("end", "start"))).over(along)
    whole, failed = F.col("whole"), F.col("failed")
    inside = lambda c: c.isNotNull() & (c["end"] > F.col("start"))
    equal = inside(whole) & (whole["start"] == F.col("start")) & (whole["end"] == F.col("end"))
    short_card = (F.col("kind") == 2) & F.col("luhn") & F.length(F.regexp_replace("span", "[^0-9]", "")).between(13, 15)
    y = (
        F.when(short_card, F.lit(None)).when(F.col("base"), F.col("valid").cast("double")).when(equal, 1.0).when(inside(whole), 0.0)
        .when(inside(failed) & F.col("valid"), F.lit(None)).when(~F.col("valid"), 0.0)
    )
    return found.where("kind is not null").withColumn("whole", cover(True)).withColumn("failed", cover(False)).withColumn("y", y).drop("whole", "failed")


def fit(found: DataFrame) -> tuple[GBTClassificationModel, list[float]] | None:
    """Trees and a threshold per kind from labelled candidates; None if there is only one class to learn from."""
    known = _labelled(found).where("y is not null").withColumn("u", F.xxhash64("span", "left", "right"))
    half = lambda n: known.where(F.pmod("u", F.lit(2)) == n)
    different = half(0).groupBy("kind", "y", "u", "span", "left", "right", "luhn").agg(F.count("*").cast("double").alias("weight"))
    nth = F.row_number().over(Window.partitionBy("kind", "y").orderBy("u", "span", "left", "right"))
    chosen = different.withColumn("nth", nth).where(F.col("nth") <= max(1, TRAIN_ROWS // (2 * len(KINDS))))
    train = stored(_features(chosen).select("kind", "x", "y", "weight"), "pii-train").coalesce(8)
    classes = {r["y"] for r in train.select("y").distinct().collect()}
    if len(classes) < 2:
        return None
    model = GBTClassifier(
        featuresCol="x", labelCol="y", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=7, minInstancesPerNode=2
    ).fit(train)
    # Four kinds and a hundred bins reach the driver, whatever the number of candidates.
    scored = _scored(model, _features(half(1))).select("kind", "y", F.floor(F.col("p") * BINS).alias("bin"))
    binned = scored.groupBy("kind", "bin").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).collect()
    limits = []
    for kind in range(len(KINDS)):
        ones = n = 0
        limit = 1.0
        for row in sorted((r for r in binned if r["kind"] == kind), key=lambda r: -r["bin"]):
            ones, n = ones + row["ones"], n + row["n"]
            if ones >= PRECISION * n:
                limit = min(limit, row["bin"] / BINS)
        limits.append(max(limit, LEAST_THRESHOLD))
    return model, limits


def _scored(model: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


def _added(found: DataFrame, model: GBTClassificationModel, limits: list[float]) -> DataFrame:
    """uid, doc_id, kind, start, end of the spans that the trees add: none overlaps a base span or another one."""
    taken = found.where("base and valid").select("uid", F.col("start").alias("s"), F.col("end").alias("e"))
    wanted = found.where("kind is not null and not base and valid")
    limit = F.get(F.array(*[F.lit(x) for x in limits]), F.col("kind"))
    passed = _scored(model, _features(wanted)).where(F.col("p") >= limit).select("uid", "doc_id", "kind", "start", "end", "p")
    lines = passed.select("uid", "doc_id", "kind", "start", "end", "p", F.lit(False).alias("old")).unionByName(
        taken.select("uid", F.lit(None).cast("bigint").alias("doc_id"), F.lit(-1).alias("kind"), F.col("s").alias("start"), F.col("e").alias("end"), F.lit(2.0).alias("p"), F.lit(True).alias("old"))
    )
    # Base spans first: a new one must end before the next base span and start after the last one.
    before = Window.partitionBy("uid").orderBy("start", F.desc("old"), "end", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("uid").orderBy("start", F.desc("old"), "end", "kind").rowsBetween(0, Window.unboundedFollowing)
    free = (
        lines.withColumn("last", F.max(F.when(F.col("old"), F.col("end"))).over(before)).withColumn("next", F.min(F.when(F.col("old"), F.col("start"))).over(after))
        .where(~F.col("old") & (F.coalesce("last", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end")))
    )
    # Of spans that overlap in a row the best one stays.
    order = Window.partitionBy("uid").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("uid").orderBy("start", "end", "kind")
    chained = free.withColumn("new", F.coalesce(F.col("start") >= F.max("end").over(order), F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(run))
    best = Window.partitionBy("uid", "run").orderBy(F.desc("p"), F.desc(F.col("end") - F.col("start")), "start", "kind")
    return chained.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("uid", "doc_id", "kind", "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """One row (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per document.

    Counts and ``base_sha256`` are of the base spans; ``spans`` lists base and added spans as kind:start:end, by kind in the
    order of ``KINDS``, then start. Null texts are empty; null ids and repeated rows keep their rows; other columns are
    ignored; an empty table gives no rows. Without both valid and failed candidates there is nothing to learn, and only the
    base spans are listed.
    """
    found = candidates(docs)
    learned = fit(found)
    base = found.select("uid", "doc_id", "kind", "start", "end", (F.col("base") & F.col("valid")).alias("old"))
    rows = base.select("uid", "doc_id", *[F.when(F.col("old"), F.col(c)).alias(c) for c in ("kind", "start", "end")], F.lit(True).alias("old"))
    # Candidates that are no base span shrink to the bare row that keeps the document.
    if learned is not None:
        rows = rows.unionByName(_added(found, *learned).select("uid", "doc_id", "kind", "start", "end", F.lit(False).alias("old")))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(
        F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    span = F.struct("kind", "start", "end")
    return (
        rows.groupBy("uid", "doc_id")
        .agg(
            *[F.count(F.when(F.col("old") & (F.col("kind") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)],
            F.sha2(listed(F.collect_list(F.when(F.col("old") & F.col("kind").isNotNull(), span))), 256).alias("base_sha256"),
            listed(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("spans"),
        )
        .drop("uid")
    )


def redact(text: Column, spans: Column) -> Column:
    """A text with the spans of ``find`` replaced by their kinds in brackets, overlapping ones by the first."""
    parts = F.transform(F.filter(F.split(spans, ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    cuts = F.array_sort(F.transform(parts, lambda p: F.struct(p[1].cast("int").alias("a"), p[2].cast("int").alias("b"), p[0].alias("k"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(done: Column, cut: Column) -> Column:
        more = F.concat(done["out"], F.substring(text, done["at"] + 1, cut["a"] - done["at"]), F.lit("["), cut["k"], F.lit("]"))
        return F.when(cut["a"] >= done["at"], F.struct(more.alias("out"), cut["b"].alias("at"))).otherwise(done)

    return F.aggregate(cuts, start, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
