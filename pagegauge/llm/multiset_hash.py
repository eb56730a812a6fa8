"""Document fingerprints: homomorphic multiset hashes of paragraphs, in DataFrame operations only.

A fingerprint is a vector of sums. Every paragraph is hashed into a wide vector and the vectors of a text are added lane by
lane, modulo a power of two, so the order of paragraphs does not matter and paragraphs can be put in or taken out without
reading the rest (``add``, ``take``). Three blocks of lanes:

* ``DIGEST`` lanes modulo 2**32: the paragraph's SHA-256, hashed with a seed of its own for every two lanes, which decide equality;
* one lane modulo 2**32: the number of clauses;
* ``SKETCH`` lanes modulo 2**16: the bits of a hash of each clause of the paragraph, counted. Over the count they are sums of
  plus and minus one, whose cosine estimates what two texts share.

Clauses end after every word whose hash ends in three zero bits, so a text has clauses in proportion to its length in any
script and whatever its marks, and a change moves the ends next to it only. Words are what single spaces separate; in scripts
without spaces each character is a word, and other runs of 64 characters without a space are cut there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGEST = 16
SKETCH = 64
ROWS_PER_RANGE = 20_000
# A plan holds this many ids at most; beyond that ranges grow, and their tasks sort them on disk.
MOST_RANGES = 8192
_END = "\x01"
# Thai, Lao, Myanmar, Khmer, kana and Han.
_UNSPACED = r"[\u0E01-\u0EFF\u1000-\u109F\u1780-\u17FF\u3041-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]"
_LONGEST_WORD = 64
_LOW = 0xFFFFFFFF


def _sums() -> list[Column]:
    """Lane sums of clause rows: columns first (is it the paragraph's first clause), digest, clause."""
    lanes = []
    for j in range(DIGEST // 2):
        # The number comes first, so it seeds the hash of the digest.
        h = F.xxhash64(F.lit(j), "digest")
        for part in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(_LOW))):
            lanes.append(F.sum(F.when(F.col("first"), part).otherwise(0)))
    h = F.xxhash64("clause")
    real = F.col("clause") != ""
    lanes.append(F.sum(F.when(real, 1).otherwise(0)))
    # Two lanes to a long: bits j and j + 32 of the clause hash, counted in its lower and upper half.
    for j in range(SKETCH // 2):
        lanes.append(F.sum(F.when(real, F.shiftrightunsigned(h, j).bitwiseAND(F.lit(1 << 32 | 1))).otherwise(0)))
    return [lane.cast("bigint").alias(f"lane{i}") for i, lane in enumerate(lanes)]


def _hex8(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 8, "0")


def _text(lanes: list[Column]) -> Column:
    """Lanes as a string: 8 digits a digest lane and the count, 4 digits a sketch lane."""
    low16 = lambda x: x.bitwiseAND(F.lit(0xFFFF))
    head = [_hex8(x.bitwiseAND(F.lit(_LOW))) for x in lanes[: DIGEST + 1]]
    tail = [_hex8(F.shiftleft(low16(F.shiftrightunsigned(x, 32)), 16) + low16(x)) for x in lanes[DIGEST + 1 :]]
    return F.concat(*head, *tail)


def _signed(lanes: list[Column]) -> Column:
    """The sketch as sums of plus and minus one."""
    n = lanes[DIGEST]
    packed = F.array(*lanes[DIGEST + 1 :])
    return F.concat(
        F.transform(packed, lambda x: x.bitwiseAND(F.lit(_LOW)) * 2 - n), F.transform(packed, lambda x: F.shiftrightunsigned(x, 32) * 2 - n)
    )


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two structs (fp, signed): 1 for equal fingerprints, else the cosine of the sketches, at least 0."""
    norm = F.sqrt(_dot(a["signed"], a["signed"]) * _dot(b["signed"], b["signed"]))
    cosine = F.coalesce(F.try_divide(_dot(a["signed"], b["signed"]), norm), F.lit(0.0))
    return F.when(a["fp"] == b["fp"], F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(cosine, F.lit(1.0))))


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    """Adds or subtracts two fingerprint strings lane by lane."""
    parts = []
    for i in range(DIGEST + 1 + SKETCH):
        at, width = (1 + 8 * i, 8) if i <= DIGEST else (1 + 8 * (DIGEST + 1) + 4 * (i - DIGEST - 1), 4)
        x, y = (F.conv(F.substring(c, at, width), 16, 10).cast("bigint") for c in (a, b))
        parts.append(F.lpad(F.lower(F.hex(F.pmod(x + y * sign, F.lit(1 << (4 * width))))), width, "0"))
    return F.concat(*parts)


def add(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint after paragraphs with the fingerprint ``paragraphs`` were inserted."""
    return _lanewise(fingerprint, paragraphs, 1)


def take(fingerprint: Column, paragraphs: Column) -> Column:
    """The fingerprint after paragraphs with the fingerprint ``paragraphs`` were deleted."""
    return _lanewise(fingerprint, paragraphs, -1)


def _marked(w: Column) -> Column:
    """The word, with the mark that ends a clause if its hash says so."""
    return F.when(F.xxhash64(w).bitwiseAND(F.lit(7)) == 0, F.concat(w, F.lit(_END))).otherwise(w)


def _clauses(paragraph: Column) -> Column:
    """The clauses of a paragraph, at least one; some may be empty."""
    unbroken = f"([^ ]{{{_LONGEST_WORD}}})"
    # Characters of scripts without spaces are marked one by one, first of all and only where there are any.
    apart = F.array_join(F.transform(F.regexp_extract_all(paragraph, F.lit(r"(?s)."), F.lit(0)), lambda c: F.when(c.rlike(_UNSPACED), _marked(c)).otherwise(c)), "")
    odd = F.when(paragraph.rlike(_UNSPACED), apart).otherwise(F.regexp_replace(paragraph, unbroken, f"$1{_END}"))
    by_word = lambda text: F.array_join(F.transform(F.split(text, " "), _marked), " ")
    marked = F.when(paragraph.rlike(f"{unbroken}|{_UNSPACED}"), by_word(odd)).otherwise(by_word(paragraph))
    return F.transform(F.split(marked, _END), lambda c: F.btrim(c))


def _vectors(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, v: struct(fp, signed) of column t. Rows of equal keys are one text."""
    paragraphs = texts.select(*keys, F.explode(F.split("t", "\n")).alias("paragraph"))
    clauses = paragraphs.select(*keys, F.sha2("paragraph", 256).alias("digest"), _clauses(F.col("paragraph")).alias("clauses")).select(
        *keys, "digest", F.posexplode("clauses").alias("_i", "clause")
    )
    sums = clauses.select(*keys, "digest", "clause", (F.col("_i") == 0).alias("first")).groupBy(*keys).agg(*_sums())
    lanes = [F.col(f"lane{i}") for i in range(DIGEST + 1 + SKETCH // 2)]
    return sums.select(*keys, F.struct(_text(lanes).alias("fp"), _signed(lanes).alias("signed")).alias("v"))


def fingerprints(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, fingerprint of every row's text (null: empty). Keys must be unique; rows with equal keys add up."""
    rows = texts.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    return _vectors(rows, [key]).select(key, F.col("v.fp").alias("fingerprint"))


def _ranges(docs: DataFrame, rows_per_range: int) -> list[int]:
    """Existing keys that cut the rows into ranges of about equal numbers of rows; the first is the smallest key."""
    n, least = docs.agg(F.count("*"), F.min("key")).first()
    if not n:
        return []
    wanted = min(MOST_RANGES, max(1, n // rows_per_range, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = docs.agg(F.percentile_approx("key", shares, max(10_000, 4 * wanted))).first()[0] if shares else []
    return sorted({least, *(cuts or [])})


def _range_of(key: Column, cuts: list[int]) -> tuple[Column, Column]:
    """Number of cuts up to the key (from 1), and whether the key is a cut; a look-up in two steps of the square root."""
    step = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads = F.array(*[F.lit(r[0]).cast("bigint") for r in rows])
    lists = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in r]) for r in rows])
    row = F.size(F.filter(heads, lambda x: x <= key))
    inner = F.size(F.filter(F.element_at(lists, row), lambda x: x <= key))
    return (row - 1) * step + inner, F.element_at(F.element_at(lists, row), inner) == key


def edit_report(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document.

    The edited text has its last n_chars // 4 code points replaced by the first as many of the next document by doc_id, the
    first document's after the last. Documents are cut into ranges of ids, each a task's worth; the first document of a
    range is also sent to the range before, so each text crosses the network once. Null texts are empty; null ids come
    last; rows that share an id go by a hash of the text; other columns are ignored; an empty table gives no rows.
    """
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit((1 << 63) - 1)).alias("key"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
    )
    cuts = _ranges(keyed.select("key"), rows_per_range) or [0]
    number, is_cut = _range_of(F.col("key"), cuts)
    here = F.struct(F.col("r"), F.lit(False).alias("guest"))
    before = F.struct(F.when(F.col("r") == 1, F.lit(len(cuts))).otherwise(F.col("r") - 1).alias("r"), F.lit(True).alias("guest"))
    dealt = (
        keyed.withColumn("r", number.cast("int")).withColumn("cut", is_cut)
        .withColumn("to", F.explode(F.when(F.col("cut"), F.array(here, before)).otherwise(F.array(here))))
        .select(F.col("to.r").alias("r"), F.col("to.guest").alias("guest"), "doc_id", "key", "t")
    )
    order = Window.partitionBy("r").orderBy("guest", "key", F.xxhash64("t"), F.length("t"))
    n = F.length("t")
    quarter = F.floor(n / 4).cast("int")
    paired = dealt.withColumn("at", F.row_number().over(order)).withColumn("following", F.lead("t").over(order))
    both = paired.select(
        "r", "at", "guest", "doc_id", n.cast("bigint").alias("n_chars"), "t",
        F.concat(F.substring("t", F.lit(1), n - quarter), F.substring("following", F.lit(1), quarter)).alias("edited"),
    ).withColumn("edited_sha256", F.sha2("edited", 256))
    versions = F.when(F.col("guest"), F.array(F.struct(F.lit(0).alias("which"), "t"))).otherwise(
        F.array(F.struct(F.lit(0).alias("which"), "t"), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))
    )
    keys = ["r", "at", "guest", "doc_id", "n_chars", "edited_sha256", "which"]
    texts = both.select(*keys[:-1], F.explode(versions).alias("v")).select(*keys[:-1], "v.which", "v.t")
    lines = Window.partitionBy("r").orderBy("at", "which")
    return (
        _vectors(texts, keys)
        .withColumn("edited", F.lead("v", 1).over(lines)).withColumn("following", F.lead("v", 2).over(lines))
        .where("not guest and which = 0")
        .select(
            "doc_id", "n_chars", "edited_sha256", F.col("v.fp").alias("fingerprint"), F.col("edited.fp").alias("edited_fingerprint"),
            likeness(F.col("v"), F.col("edited")).alias("near_edited"), likeness(F.col("v"), F.col("following")).alias("near_next"),
        )
    )
