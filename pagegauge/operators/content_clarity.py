"""Content clarity: titles, main text, reading ease, boilerplate (weight .10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import html as H
from pagegauge.functions import scoring as S
from pagegauge.functions import text as T
from pagegauge.functions.binding import Stages, in_order, staged
from pagegauge.operators import elements as E
from pagegauge.operators.rules import Rule, text

SCORES = (
    "cc_title_score", "cc_meta_score", "cc_h1_score",
    "cc_readability_score", "cc_boilerplate_score", "cc_word_score",
)
_UNREAD = ("script", "style", "noscript")
_LONG_SECTION = 200


def _readable(piece: Column) -> Column:
    return ~F.coalesce(piece["tag"].isin(*_UNREAD), F.lit(False)) & ~piece["in_template"]


def _join(items: Column) -> Column:
    return T.collapse(F.array_join(F.transform(items, lambda p: p["s"]), ""))


@staged
def main_content() -> Stages:
    """Add ``cc_main_text`` and ``cc_main_source``: main, else article, else longest section, else the body."""
    sections = F.array_sort(
        F.transform(
            E.where(E.tag_in("section")),
            lambda e: F.struct(
                (-E.trimmed_length(e)).alias("rank"), e["pos"].alias("pos"), e["t0"].alias("t0"), e["t1"].alias("t1")
            ),
        )
    )
    best = F.try_element_at(sections, F.lit(1))
    source = (
        F.when(F.col("n_main") > 0, F.lit("main"))
        .when(F.col("n_article") > 0, F.lit("article"))
        .when(-best["rank"] > _LONG_SECTION, F.lit("section"))
        .otherwise(F.lit("body-minus-boilerplate"))
    )
    stages: Stages = [{"cc_main_source": source}]
    # Without body or head tags only the title lies outside the body.
    body = F.filter(
        "txts",
        lambda p: (p["body_mark"] == F.col("body_kind"))
        & ~p["in_boiler"]
        & ~((F.col("body_kind") == 0) & F.coalesce(p["tag"] == "title", F.lit(False)))
        & _readable(p),
    )

    def below(e):
        return F.filter(E.pieces(e), _readable)

    chosen = (
        F.when(F.col("cc_main_source") == "main", below(E.first("main")))
        .when(F.col("cc_main_source") == "article", below(E.first("article")))
        .when(F.col("cc_main_source") == "section", below(best))
        .otherwise(body)
    )
    stages.append({"cc_main_text": _join(chosen)})
    return stages


@staged
def _features() -> Stages:
    stages: Stages = []
    description = H.attr(E.first("meta", lambda e: H.attr_is(e["attrs"], "name", "description"))["attrs"], "content")
    nodes = F.transform(F.filter("txts", lambda p: p["node"].isNotNull()), lambda p: p["node"])
    stages.append(
        {
            "cc_title": F.coalesce(T.trim(E.text_of(E.first("title"))), F.lit("")),
            "cc_meta": F.coalesce(T.trim(description), F.lit("")),
            "cc_h1": F.coalesce(T.trim(E.text_of(E.first("h1"))), F.lit("")),
            "cc_words": T.words(F.col("cc_main_text")),
            "cc_boilerplate_chars": E.total(E.where(E.tag_in(*C.BOILERPLATE_TAGS)), E.trimmed_length),
            "cc_visible_chars": F.length(T.collapse(F.array_join(nodes, " "))).cast("bigint"),
            "cc_word_count": F.size(
                F.filter(F.split("cc_main_text", " "), lambda w: w != "")
            ).cast("int"),
        }
    )
    stages.append(
        {
            "cc_title_length": F.length("cc_title").cast("int"),
            "cc_meta_length": F.length("cc_meta").cast("int"),
            "cc_h1_overlap": T.jaccard_clarity(F.col("cc_h1"), F.col("cc_title")),
            "cc_flesch_words": F.size("cc_words").cast("int"),
            "cc_sentences": T.sentence_total(F.col("cc_main_text")).cast("int"),
            "cc_syllables": T.syllable_total(F.col("cc_words")).cast("int"),
            "cc_boilerplate_ratio": F.coalesce(
                F.col("cc_boilerplate_chars").cast("double")
                / F.nullif(F.col("cc_visible_chars").cast("double"), F.lit(0.0)),
                F.lit(0.0),
            ),
            "cc_title_80": T.snippet(F.col("cc_title"), 80),
            "cc_title_100": T.snippet(F.col("cc_title"), 100),
            "cc_title_60": T.snippet(F.col("cc_title"), 60),
            "cc_h1_60": T.snippet(F.col("cc_h1"), 60),
            "cc_meta_200": T.snippet(F.col("cc_meta"), 200),
        }
    )
    stages.append({"cc_flesch": T.flesch_from_counts(F.col("cc_flesch_words"), F.col("cc_sentences"), F.col("cc_syllables"))})
    title, meta, ease = F.col("cc_title_length"), F.col("cc_meta_length"), F.col("cc_flesch")
    ratio, words = F.col("cc_boilerplate_ratio"), F.col("cc_word_count")
    stages.append(
        {
            "cc_title_score": F.when(title == 0, 0).when(title < 10, 8).when(title > 70, 12).otherwise(20),
            "cc_meta_score": F.when(meta == 0, 0).when(meta < 50, 10).when(meta > 160, 14).otherwise(20),
            "cc_h1_score": F.when(F.col("cc_h1") == "", 0)
            .when((title > 0) & (F.col("cc_h1_overlap") < 0.2), 8)
            .otherwise(15),
            "cc_readability_score": F.when(ease == 0, 8).when(ease < 30, 5).when(ease < 50, 10).otherwise(15),
            "cc_boilerplate_score": F.when(ratio < 0.3, 15).when(ratio < 0.6, 8).otherwise(0),
            "cc_word_score": F.when(words >= 300, 15).when(words >= 100, 8).otherwise(0),
        }
    )
    stages.append({"cc_score": S.clamp_score(sum((F.col(c) for c in SCORES), F.lit(0)))})
    return stages


features = in_order(main_content, _features)


def _chars(column: str, name: str, bound: str) -> str:
    return f"concat({text(name + ' has ')}, cast({column} as string), {text(' characters (' + bound + ')')})"


RULES = [
    Rule("CC_TITLE_MISSING", "'high'", "cc_title_length = 0", text("No title"), text("The title is the first thing any reader uses.")),
    Rule(
        "CC_TITLE_TOO_SHORT", "'medium'", "cc_title_length between 1 and 9",
        _chars("cc_title_length", "The title", "fewer than 10"), text("Say what the page is about."), "cc_title_80",
    ),
    Rule(
        "CC_TITLE_TOO_LONG", "'low'", "cc_title_length > 70",
        _chars("cc_title_length", "The title", "more than 70"), text("Long titles are cut off in listings."), "cc_title_100",
    ),
    Rule(
        "CC_META_DESC_MISSING", "'medium'", "cc_meta_length = 0",
        text("No meta description"), text("A short description is shown in result lists."),
    ),
    Rule(
        "CC_META_DESC_TOO_SHORT", "'low'", "cc_meta_length between 1 and 49",
        _chars("cc_meta_length", "The description", "fewer than 50"), text("There is room to say more."), "cc_meta_200",
    ),
    Rule(
        "CC_META_DESC_TOO_LONG", "'low'", "cc_meta_length > 160",
        _chars("cc_meta_length", "The description", "more than 160"), text("Long descriptions are cut off."), "cc_meta_200",
    ),
    Rule("CC_H1_MISSING", "'medium'", "cc_h1 = ''", text("No h1 text"), text("The main heading should state the topic.")),
    Rule(
        "CC_H1_TITLE_MISMATCH", "'low'", "cc_h1 <> '' and cc_title_length > 0 and cc_h1_overlap < 2e-1",
        text("Title and h1 differ"),
        "concat('Title \"', cc_title_60, '\" and h1 \"', cc_h1_60, '\" name different topics.')",
    ),
    Rule(
        "CC_LOW_READABILITY", "'low'", "cc_flesch > 0 and cc_flesch < 30",
        "concat('Hard to read (reading ease ', cast(cast(floor(cc_flesch + 5e-1) as bigint) as string), ')')",
        text("Shorter sentences and words are easier to summarise."),
    ),
    Rule(
        "CC_HIGH_BOILERPLATE", "'medium'", "cc_boilerplate_ratio >= 6e-1",
        "concat(cast(cast(floor(cc_boilerplate_ratio * 100 + 5e-1) as bigint) as string), '% of the visible text is boilerplate')",
        text("Headers, footers and menus outweigh the content."),
    ),
    Rule(
        "CC_THIN_CONTENT", "case when cc_word_count < 30 then 'medium' else 'low' end", "cc_word_count < 100",
        "concat('Little main content (', cast(cc_word_count as string), ' words)')",
        text("There is too little text to answer questions from."),
    ),
]
