"""Page structure: captures -> tokens -> element tree and text nodes -> one nested row per page.

Plan shape. The element tree is worked out first, from the names of the tags, while a page is one row. Then captures are
hash-partitioned by ``page_id``, with the tree as arrays of numbers. Everything after that (token explode, windows over a
page, the per-page aggregate) is clustered by ``page_id`` and reuses that partitioning, so the html crosses the network once (twice
above 200 partitions, see ``_clustered``) and no token ever does. Of a capture table bucketed by ``page_id`` only the trees cross it (``partitioned=True``).
Groups are single pages, so no window or aggregate group grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import html as H
from pagegauge.functions import text as T
from pagegauge.functions import tree as X
from pagegauge.functions.binding import Stages, staged

# Elements the checks look at; the rest are only counted, unless an attribute below makes them matter.
CHECKED_TAGS = (
    "html", "title", "meta", "link", "script", "iframe", "button", "a", "input", "textarea", "select",
    "label", "img", *C.SEMANTIC_TAGS, *C.HEADING_TAGS,
)
# The sorts over a page's tokens take many times its html, so a partition holds about so many pages, however many there are.
# Fewer make more tasks, each of which sets up the plan's long projections anew.
PARTITION_PAGES = 500
# A shuffle to more parts than this keeps what a task writes in memory until the task ends; to as many, it goes straight to disk.
BYPASS = ("spark.shuffle.sort.bypassMergeThreshold", "200")
CHECKED_ATTRIBUTES = r"(?i)[\s\"'/](?:style|role|aria-modal|onclick|itemscope)"


_ELEMENT_KINDS = ("open", "script", "style", "rawtext")
_NODE_COLUMNS = ("tok", "tag", "kind")
_GRADED_PLACES = ("close_pos", "inside")


def _parsed(html: Column) -> Column:
    """Ordered tokens of a document with tag and kind."""
    named = F.transform(H.tokens(html), lambda t: F.struct(t.alias("tok"), H.tag_name(t).alias("tag")))
    return F.transform(named, lambda x: F.struct(x["tok"].alias("tok"), x["tag"].alias("tag"), H.token_kind(x["tok"], x["tag"]).alias("kind")))


def _tree_of(html: Column) -> Column:
    return X.trees(F.transform(_parsed(html), lambda x: X.mark(x["tok"], x["tag"], x["kind"])))


def _clustered(pages: DataFrame, trees: dict[str, Column], partitioned: bool) -> DataFrame:
    """Pages clustered by ``page_id``, with the trees that Python works out.

    Pages are shuffled behind that step, as Spark forgets there how rows lie; the trees cross as arrays of numbers. Pages that
    lie right already stay where they are, and only the trees are shuffled to them.

    That shuffle keeps what its task has read in memory where there are many parts, so a large table is dealt over a few before
    (``BYPASS``): a task then holds a small share of the table, not what a file's row group or a split happens to hold.
    """
    if partitioned:
        return pages.join(pages.withColumns(trees).select("page_id", *trees), "page_id")
    # Counted without reading html. A number is kept as it is given; without one, partitions are put together up to a size in bytes. A table
    # that has too few pages to keep every core busy is dealt over more parts, as long as these are worth a task.
    parts = -(-pages.count() // PARTITION_PAGES)
    cores = pages.sparkSession.sparkContext.defaultParallelism
    many = (max(parts, min(cores, 8 * parts)),) if parts > 1 else ()
    unsorted = int(pages.sparkSession.conf.get(*BYPASS))
    if 1 < unsorted < parts:
        pages = pages.repartition(unsorted, "page_id")
    return pages.withColumns(trees).repartition(*many, "page_id")


def _exploded(documents: DataFrame, places: tuple[str, ...], *carried: str) -> DataFrame:
    """The carried columns, pos, tok, tag, kind and the chosen places in the tree; a document without tokens keeps one row."""
    each = documents.select(*carried, _parsed(F.col("html")).alias("parsed"), *(F.col("tree")[c].alias(c) for c in places))
    rows = each.select(*carried, F.posexplode_outer(F.arrays_zip("parsed", *places)).alias("pos", "x"))
    return rows.select(*carried, "pos", *(F.col(f"x.parsed.{c}").alias(c) for c in _NODE_COLUMNS), *(F.col(f"x.{c}").alias(c) for c in places))


def _tokens_in_tree(captures: DataFrame, html: str, places: tuple[str, ...], partitioned: bool = False) -> DataFrame:
    pages = captures.select("page_id", F.col(html).alias("html"))
    return _exploded(_clustered(pages, {"tree": _tree_of(F.col("html"))}, partitioned), places, "page_id").where("pos is not null")


def tokens(captures: DataFrame, html: str = "rendered_html") -> DataFrame:
    """(page_id, pos, kind, tag, tok): ordered tokens of one document column."""
    exploded = captures.select("page_id", F.posexplode(H.tokens(F.col(html))).alias("pos", "tok"))
    return exploded.withColumn("tag", H.tag_name(F.col("tok"))).withColumn("kind", H.token_kind(F.col("tok"), F.col("tag")))


def _document_tokens(captures: DataFrame, partitioned: bool, carried: tuple[str, ...]) -> DataFrame:
    """Tokens of the rendered document and, where it differs, of the raw one (``raw`` = true).

    ``meta`` holds the carried columns of the capture on one row of its page and is NULL on the others. A raw document that is the
    rendered one crosses the network as NULL.
    """
    meta = F.struct(*carried) if carried else F.struct(F.lit(0).alias("none"))
    equal = F.col("raw_html").eqNullSafe(F.col("rendered_html"))
    pages = captures.select("page_id", F.when(~equal, F.col("raw_html")).alias("raw_html"), "rendered_html", equal.alias("same"), meta.alias("meta"))
    same = F.col("same")
    slim = lambda tree: F.struct(*(tree[c].alias(c) for c in _GRADED_PLACES))
    trees = {"rendered_tree": slim(_tree_of(F.col("rendered_html"))), "raw_tree": slim(_tree_of(F.col("raw_html")))}
    pages = _clustered(pages, trees, partitioned)
    empty = F.lit("")
    rendered = F.struct(F.lit(False).alias("raw"), F.coalesce("rendered_html", empty).alias("html"), F.col("rendered_tree").alias("tree"))
    raw = F.struct(F.lit(True).alias("raw"), F.coalesce("raw_html", empty).alias("html"), F.col("raw_tree").alias("tree"))
    documents = pages.select("page_id", "meta", F.inline(F.when(same, F.array(rendered)).otherwise(F.array(rendered, raw))))
    exploded = _exploded(documents, _GRADED_PLACES, "page_id", "meta", "raw")
    first = ~F.col("raw") & (F.coalesce("pos", F.lit(0)) == 0)
    return exploded.withColumn("meta", F.when(first, F.col("meta")))


def elements(captures: DataFrame, html: str = "rendered_html", partitioned: bool = False) -> DataFrame:
    """(page_id, pos, tag, attrs, close_pos, parent, level): one row per element.

    ``pos`` and ``close_pos`` number the tokens that begin and end it, so an element is below another if its ``pos`` lies
    between the other's; ``parent`` is the ``pos`` of the element around it (NULL at the top), ``level`` the number of elements
    around it. An element without content ends where it begins; one that nothing ends, ends behind the last token.
    """
    rows = _tokens_in_tree(captures, html, ("close_pos", "parent", "level"), partitioned).where(F.col("kind").isin(*_ELEMENT_KINDS))
    return rows.select("page_id", "pos", "tag", H.attributes(F.col("tok")).alias("attrs"), "close_pos", F.expr("nullif(parent, -1)").alias("parent"), "level")


def attributes(captures: DataFrame, html: str = "rendered_html") -> DataFrame:
    """(page_id, pos, tag, name, value): attributes of every element, the first of equal names."""
    rows = elements(captures, html).select("page_id", "pos", "tag", F.posexplode("attrs").alias("ord", "attr"))
    return rows.groupBy("page_id", "pos", "tag", F.col("attr.name").alias("name")).agg(
        F.min_by("attr.value", "ord").alias("value")
    )


def _text() -> Column:
    """Decoded text of a token."""
    tok, kind, tag = F.col("tok"), F.col("kind"), F.col("tag")
    body = H.raw_body(tok)
    return (
        F.when(kind == "text", T.decode_entities(tok))
        .when(tag.isin(*C.ESCAPABLE_RAW_TAGS) & (kind == "rawtext"), T.decode_entities(body))
        .when(kind.isin("script", "style", "rawtext"), body)
    )


def _hidden() -> Column:
    """Whether a token's text is not shown, by its own tag or by a template around it."""
    return X.in_template(F.col("inside")) | F.coalesce(F.col("tag").isin(*C.HIDDEN_TAGS), F.lit(False))


def _with_text(captures: DataFrame, html: str) -> DataFrame:
    """Tokens with ``txt`` (decoded text of the token) and ``node`` (trimmed visible text node or NULL)."""
    rows = _tokens_in_tree(captures, html, ("inside",))
    out = rows.withColumn("txt", _text()).withColumn("hidden", _hidden())
    return out.withColumn("node", F.when(~F.col("hidden"), F.nullif(T.trim(F.col("txt")), F.lit(""))))


def text_nodes(captures: DataFrame, html: str = "rendered_html") -> DataFrame:
    """(page_id, pos, node): non-empty visible text nodes in document order."""
    return _with_text(captures, html).where(F.col("node").isNotNull()).select(
        "page_id", "pos", "node"
    )


def visible_text(captures: DataFrame, html: str = "rendered_html") -> DataFrame:
    """(page_id, visible_text): text nodes joined by one space, white space collapsed."""
    rows = _with_text(captures, html)
    nodes = F.array_sort(F.collect_list(F.when(F.col("node").isNotNull(), F.struct("pos", "node"))))
    return rows.groupBy("page_id").agg(nodes.alias("nodes")).select(
        "page_id", T.collapse(F.array_join("nodes.node", " ")).alias("visible_text")
    )


def tag_counts(captures: DataFrame, tags: tuple[str, ...], html: str = "rendered_html") -> DataFrame:
    """(page_id, n_<tag> ...): element count per listed tag."""
    rows = tokens(captures, html)
    is_element = F.col("kind").isin("open", "script", "style", "rawtext")
    return rows.groupBy("page_id").agg(
        *[F.count_if(is_element & (F.col("tag") == t)).cast("int").alias(f"n_{t}") for t in tags]
    )


_DOC = ("page_id", "raw")


@staged
def _facts() -> Stages:
    """What a token tells by itself. Only ``txt`` and the attributes of checked elements stay as text; everything the windows
    below work with is a number, a flag or a hash, so the sorts move no second copy of the page."""
    tag, kind, txt = F.col("tag"), F.col("kind"), F.col("txt")
    starts = kind.isin("open", "script", "style", "rawtext")
    return [
        {
            "txt": _text(),
            "size": F.length("tok"),
            "checked": starts & ~F.col("raw") & (tag.isin(*CHECKED_TAGS) | F.col("tok").rlike(CHECKED_ATTRIBUTES)),
        },
        {
            "attrs": F.when(F.col("checked"), H.attributes(F.col("tok"))),
            "chars_all": F.coalesce(F.length(txt), F.lit(0)),
            "core_chars": F.length(T.trim(txt)),
            "core_hash": F.xxhash64(T.trim(txt)),
            "lead": F.length(txt) - F.length(F.ltrim(txt, F.lit(C.WHITESPACE_CHARS))),
            "is_text": txt.isNotNull(),
            "mentions": F.coalesce(txt.rlike(C.COOKIE_PATTERN), F.lit(False)),
        },
        {"is_solid": F.coalesce(F.col("core_chars") > 0, F.lit(False))},
    ]


@staged
def _counts_and_marks() -> Stages:
    """Running counts before each token and what the tree says of it."""
    tag, kind, inside = F.col("tag"), F.col("kind"), F.coalesce("inside", F.lit(0))
    running = Window.partitionBy(*_DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)

    def before(flag):
        one = F.when(flag, 1).otherwise(0)
        return F.sum(one).over(running) - one

    mark = F.when((kind == "open") & (tag == "body"), 2).when((kind == "close") & (tag == "head"), 1).otherwise(0)
    core = F.col("core_chars")
    return [
        {
            "hidden": X.in_template(inside) | F.coalesce(tag.isin(*C.HIDDEN_TAGS), F.lit(False)),
            "t": before(F.col("is_text")),
            "n": before(F.col("is_solid")),
            "k": before(F.col("mentions")),
            "chars": F.sum("chars_all").over(running) - F.col("chars_all"),
            "in_label": X.in_label(inside),
            "in_boiler": X.in_boilerplate(inside),
            "in_template": X.in_template(inside),
            "body_mark": F.max(mark).over(running),
        },
        {
            "first": F.when(F.col("is_solid"), F.col("chars") + F.col("lead")),
            "last": F.when(F.col("is_solid"), F.col("chars") + F.col("lead") + core),
            "shown": F.col("is_solid") & ~F.col("hidden"),
        },
    ]


@staged
def _shared_keys() -> Stages:
    """One window answers both set-membership questions of a page: is this rendered text node also in the raw document, and
    does some label point at this input's id. Keys are 64-bit hashes, so the sort compares numbers; within one page two
    texts share a hash only by a chance of one in 10**13 for a million nodes."""
    tag = F.col("tag")
    same_key = Window.partitionBy("page_id", "key")
    target = F.when(tag == "label", H.attr(F.col("attrs"), "for")).otherwise(H.attr(F.col("attrs"), "id"))
    asks = F.col("checked") & tag.isin("label", "input", "textarea", "select") & target.isNotNull()
    key = F.when(F.col("shown"), F.col("core_hash")).when(asks, F.xxhash64(F.lit("id"), target))
    is_label = F.coalesce((tag == "label") & F.col("checked"), F.lit(False))
    return [
        {"key": key},
        {"in_raw": F.max("raw").over(same_key), "labelled": F.max(is_label).over(same_key) & F.col("key").isNotNull()},
    ]


def _closed(e: Column) -> Column:
    """An element of ``els`` with the running counts where it ends, read from the page's list of them; NULL at the end of the page."""
    at_end = F.get("counts", e["ends"])
    own = {"t": e["is_text"], "n": e["is_solid"], "k": e["mentions"]}
    closed = [
        F.when(e["ends"] > e["pos"], at_end[c].cast(kind)).otherwise((e[f"{c}0"] + flag.cast("int")).cast(kind)).alias(f"{c}1")
        for (c, flag), kind in zip(own.items(), ("int", "int", "bigint"), strict=True)
    ]
    return F.struct(
        e["pos"].alias("pos"), e["tag"].alias("tag"), e["attrs"].alias("attrs"), e["t0"].alias("t0"), closed[0], e["n0"].alias("n0"), closed[1],
        e["k0"].alias("k0"), closed[2], e["in_label"].alias("in_label"), e["labelled"].alias("labelled"), e["size"].alias("size"),
    )


def page_documents(captures: DataFrame, partitioned: bool = False, carried: tuple[str, ...] = ()) -> DataFrame:
    """One nested row per page, the input of every check.

    ``els``   checked elements in document order, with half-open index ranges into ``txts``
              (t0..t1), into its non-blank entries (n0..n1) and keyword-bearing entries (k0..k1)
    ``txts``  text pieces in document order
    ``meta``  the ``carried`` columns of the capture
    Index ranges come from running counts, so the text below an element is a slice or a difference of
    two counts, never a join of elements with text.
    """
    rows = _shared_keys(_counts_and_marks(_facts(_document_tokens(captures, partitioned, carried))))
    tag, kind, rendered = F.col("tag"), F.col("kind"), ~F.col("raw")
    index = lambda c, name: F.col(c).cast("int").alias(name)
    element = F.struct(
        "pos", "tag", "attrs", F.col("close_pos").alias("ends"), index("t", "t0"), index("n", "n0"), F.col("k").alias("k0"),
        "is_text", "is_solid", "mentions", "in_label", "labelled", "size",
    )
    core = T.trim(F.col("txt"))
    piece = F.struct(
        "pos", F.col("txt").alias("s"), F.when(F.col("shown"), core).alias("node"), "in_raw", "tag", "in_boiler", "in_template", "body_mark", "first", "last"
    )
    starts = kind.isin("open", "rawtext") & rendered
    is_title = (tag == "title") & (kind == "rawtext")
    grouped = rows.groupBy("page_id").agg(
        F.max("meta").alias("meta"),
        F.sum(F.when(rendered, F.coalesce("size", F.lit(0))).otherwise(0)).alias("html_chars"),
        F.sum(F.when(F.col("raw") & F.col("shown"), F.col("core_chars"))).alias("raw_node_chars"),
        F.max("raw").alias("has_raw"),
        F.min_by(F.when(is_title, core), F.when(is_title & F.col("raw"), F.col("pos"))).alias("raw_title"),
        F.min_by(F.when(is_title, core), F.when(is_title & rendered, F.col("pos"))).alias("rendered_title"),
        F.max(F.when(rendered, F.col("body_mark"))).alias("body_kind"),
        F.count_if(F.col("mentions") & rendered).alias("k_total"),
        *[F.count_if((tag == t) & starts).cast("int").alias(f"n_{t}") for t in ("div", *C.SEMANTIC_TAGS)],
        F.array_sort(F.collect_list(F.when(F.col("checked"), element))).alias("els"),
        F.array_sort(F.collect_list(F.when(rendered & F.col("pos").isNotNull(), F.struct("pos", "t", "n", "k")))).alias("counts"),
        F.array_sort(F.collect_list(F.when(F.col("is_text") & rendered, piece))).alias("txts"),
    )
    return grouped.withColumn("els", F.transform("els", _closed)).withColumn("solid", F.filter("txts", lambda p: p["first"].isNotNull())).drop("counts")
