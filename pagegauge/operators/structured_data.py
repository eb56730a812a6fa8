"""Structured data: JSON-LD, OpenGraph, cards, microdata, canonical, language (weight .20)."""

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
    "sd_json_ld_score", "sd_og_score", "sd_twitter_score", "sd_microdata_score",
    "sd_canonical_score", "sd_hreflang_score", "sd_alignment_score",
)
_STRING = r'"(?:[^"\\]++|\\.)*+"'
# Quotes inside the strings of valid JSON are escaped, so only real keys match; a list ends at its own bracket.
# Any character of the key may be written as its escape.
_TYPE_NAME = "".join(rf"(?:{c}|\\u{ord(c):04x})" for c in "@type")
_TYPE_KEY = rf'[{{,]\s*"{_TYPE_NAME}"\s*:\s*({_STRING}|\[(?:{_STRING}|[^\]"])*+\])'


def json_ld_types(raw: Column) -> Column:
    """Every ``@type`` string of a JSON text, at any depth."""
    values = F.regexp_extract_all(raw, F.lit(_TYPE_KEY), F.lit(1))
    quoted = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(_STRING), F.lit(0))))
    return F.transform(quoted, lambda q: F.coalesce(F.try_variant_get(F.try_parse_json(q), "$", "string"), q))


def _context_is_text(node: Column) -> Column:
    context = F.try_variant_get(node, '$["@context"]', "variant")
    kind = F.schema_of_variant(context)
    in_list = F.exists(
        F.coalesce(F.try_variant_get(context, "$", "array<variant>"), F.array().cast("array<variant>")),
        lambda item: F.schema_of_variant(item) == "STRING",
    )
    return F.coalesce((kind == "STRING") | (F.startswith(kind, F.lit("ARRAY")) & in_list), F.lit(False))


def json_ld_has_context(raw: Column) -> Column:
    """A string ``@context`` on the top-level object, or on an object of top-level arrays nested to any depth."""
    none = F.array().cast("array<variant>")

    def opened(nodes: Column) -> Column:
        return F.flatten(F.transform(nodes, lambda n: F.coalesce(F.try_variant_get(n, "$", "array<variant>"), F.array(n))))

    top = F.try_parse_json(raw)
    # Arrays nest no deeper than there are opening brackets.
    depth = F.length(raw) - F.length(F.replace(raw, F.lit("["), F.lit("")))
    nodes = F.when(F.startswith(T.trim(raw), F.lit("[")), F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.array(top), lambda n, _: opened(n))).otherwise(
        F.array(top)
    )
    # A variant cannot hold repeated keys; such objects are read as plain text columns instead.
    plain = F.from_json(raw, "struct<`@context`:string>")["@context"]
    plain_text = plain.isNotNull() & ~F.startswith(plain, F.lit("{")) & (
        ~F.startswith(plain, F.lit("[")) | F.contains(plain, F.lit('"'))
    )
    return F.when(top.isNull(), F.coalesce(plain_text, F.lit(False))).otherwise(F.exists(F.coalesce(nodes, none), _context_is_text))


_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}


def is_json(raw: Column) -> Column:
    """Whether the whole text is one JSON value.

    The parsers stop after the first value, so the text is tried as the only member of an object and as the
    only item of an array: anything trailing breaks one of the two. Repeated keys are fine.
    """
    wrapped_object = F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "map<string,string>", _STRICT_JSON)
    wrapped_array = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>", _STRICT_JSON)
    return wrapped_object.isNotNull() & (F.size(wrapped_object) == 1) & wrapped_array.isNotNull() & (F.size(wrapped_array) == 1)


@staged
def json_ld_blocks() -> Stages:
    """Add ``sd_blocks``: array of (raw, valid, types, has_context) per non-blank JSON-LD script."""
    scripts = E.where(E.tag_in("script"), lambda e: H.attr_is_ci(e["attrs"], "type", "application/ld+json"))
    raws = F.filter(F.transform(scripts, E.text_of), lambda s: T.trim(s) != "")

    def block(raw: Column) -> Column:
        valid = F.coalesce(is_json(raw), F.lit(False))
        return F.struct(
            raw.alias("raw"),
            valid.alias("valid"),
            F.when(valid, json_ld_types(raw)).otherwise(F.array().cast("array<string>")).alias("types"),
            (valid & json_ld_has_context(raw)).alias("has_context"),
        )

    return [{"sd_raws": raws}, {"sd_blocks": F.transform("sd_raws", block)}]


@staged
def _features() -> Stages:
    stages: Stages = []
    meta = E.tag_in("meta")
    og = E.where(
        meta,
        lambda e: F.coalesce(F.startswith(H.attr(e["attrs"], "property"), F.lit("og:")), F.lit(False)),
        lambda e: H.present(H.attr(e["attrs"], "content")),
    )
    stages.append(
        {
            "sd_block_count": F.size("sd_blocks").cast("int"),
            "sd_valid_count": F.size(F.filter("sd_blocks", lambda b: b["valid"])).cast("int"),
            "sd_context_count": F.size(F.filter("sd_blocks", lambda b: b["has_context"])).cast("int"),
            "sd_types": F.flatten(F.transform("sd_blocks", lambda b: b["types"])),
            "sd_first_invalid": T.snippet(
                F.try_element_at(F.filter("sd_blocks", lambda b: ~b["valid"]), F.lit(1))["raw"]
            ),
            "sd_og": F.transform(
                og,
                lambda e: F.struct(
                    H.attr(e["attrs"], "property").alias("property"), H.attr(e["attrs"], "content").alias("content")
                ),
            ),
            "sd_twitter_card": H.attr(
                E.first("meta", lambda e: H.attr_is(e["attrs"], "name", "twitter:card"))["attrs"], "content"
            ),
            "sd_microdata_count": E.count(E.where(lambda e: H.has_attr(e["attrs"], "itemscope"))),
            "sd_canonical": H.attr(
                E.first("link", lambda e: H.attr_is_ci(e["attrs"], "rel", "canonical"))["attrs"], "href"
            ),
            "sd_hreflang_count": E.count(
                E.where(
                    E.tag_in("link"),
                    lambda e: H.attr_is_ci(e["attrs"], "rel", "alternate") & H.has_attr(e["attrs"], "hreflang"),
                )
            ),
            "sd_html_lang": H.attr(E.first("html")["attrs"], "lang"),
            "sd_title": F.coalesce(T.trim(E.text_of(E.first("title"))), F.lit("")),
        }
    )

    def og_value(name):
        # Later duplicates overwrite earlier ones.
        return F.try_element_at(F.filter("sd_og", lambda o: o["property"] == name), F.lit(-1))["content"]

    missing = F.array_compact(F.array(*[F.when(og_value(n).isNull(), F.lit(n)) for n in C.REQUIRED_OG]))
    known = F.array(*[F.lit(t) for t in C.KNOWN_SCHEMA_TYPES])
    stages.append(
        {
            "sd_og_missing": missing,
            "sd_og_title": F.coalesce(og_value("og:title"), F.lit("")),
            "sd_type_count": F.size("sd_types").cast("int"),
            "sd_known_type": F.arrays_overlap("sd_types", known),
            "sd_type_list": F.array_join("sd_types", ", "),
        }
    )
    both = (F.col("sd_og_title") != "") & (F.col("sd_title") != "")
    stages.append(
        {
            "sd_og_count": (F.lit(len(C.REQUIRED_OG)) - F.size("sd_og_missing")).cast("int"),
            "sd_og_missing_list": F.array_join("sd_og_missing", ", "),
            "sd_title_overlap": F.when(both, T.jaccard_schema(F.col("sd_og_title"), F.col("sd_title"))),
            "sd_og_title_short": T.snippet(F.col("sd_og_title"), 60),
            "sd_title_short": T.snippet(F.col("sd_title"), 60),
        }
    )
    valid, types = F.col("sd_valid_count") > 0, F.col("sd_type_count") > 0
    one_title = (F.col("sd_og_title") != "") | (F.col("sd_title") != "")
    stages.append(
        {
            "sd_json_ld_score": F.when(
                valid,
                F.lit(10)
                + F.when(F.col("sd_context_count") > 0, 5).otherwise(0)
                + F.when(types, 5).otherwise(0)
                + F.when(types & F.col("sd_known_type"), 10).otherwise(0),
            ).otherwise(0),
            "sd_og_score": F.col("sd_og_count") * 4,
            "sd_twitter_score": F.when(H.present(F.col("sd_twitter_card")), 5).otherwise(0),
            "sd_microdata_score": F.when(F.col("sd_microdata_count") > 0, 5).otherwise(0),
            "sd_canonical_score": F.when(H.present(F.col("sd_canonical")), 10).otherwise(0),
            "sd_hreflang_score": F.when(F.col("sd_hreflang_count") > 0, 10)
            .when(H.present(F.col("sd_html_lang")), 8)
            .otherwise(5),
            "sd_alignment_score": F.when(types & both, F.when(F.col("sd_title_overlap") >= 0.4, 20).otherwise(10))
            .when(types & one_title, 10)
            .otherwise(0),
        }
    )
    stages.append({"sd_score": S.clamp_score(sum((F.col(c) for c in SCORES), F.lit(0)))})
    return stages


features = in_order(json_ld_blocks, _features)


RULES = [
    Rule(
        "SD_MISSING_JSON_LD", "'medium'", "sd_block_count = 0",
        text("No JSON-LD"), text("The page states no entities in schema.org form."),
    ),
    Rule(
        "SD_INVALID_JSON_LD", "'high'", "sd_block_count > sd_valid_count",
        "concat(cast(sd_block_count - sd_valid_count as string), ' JSON-LD block(s) are not valid JSON')",
        text("Readers skip blocks that do not parse."), "sd_first_invalid",
    ),
    Rule(
        "SD_JSON_LD_NO_CONTEXT", "'medium'", "sd_valid_count > 0 and sd_context_count = 0",
        text("JSON-LD has no @context"), text("Types cannot be resolved without a context."),
    ),
    Rule(
        "SD_JSON_LD_NO_TYPE", "'medium'", "sd_valid_count > 0 and sd_type_count = 0",
        text("JSON-LD has no @type"), text("Entities cannot be classified without a type."),
    ),
    Rule(
        "SD_UNKNOWN_SCHEMA_TYPE", "'low'", "sd_valid_count > 0 and sd_type_count > 0 and not sd_known_type",
        "concat('Unrecognised JSON-LD types: ', sd_type_list)", text("Common readers only use well-known schema.org types."),
    ),
    Rule(
        "SD_MISSING_OG_TAGS", "'medium'", "sd_og_count = 0",
        text("No OpenGraph tags"), text("Shared links will have no preview."),
    ),
    Rule(
        "SD_PARTIAL_OG_TAGS", "'low'", "sd_og_count between 1 and 4",
        "concat('OpenGraph is incomplete (', cast(sd_og_count as string), ' of 5)')",
        "concat('Missing: ', sd_og_missing_list, '.')",
    ),
    Rule(
        "SD_MISSING_TWITTER_CARD", "'info'", "sd_twitter_score = 0",
        text("No twitter:card"), text("The card type decides how a link preview is drawn."),
    ),
    Rule(
        "SD_NO_MICRODATA", "'info'", "sd_microdata_count = 0",
        text("No microdata"), text("Microdata helps readers that ignore JSON-LD."),
    ),
    Rule(
        "SD_MISSING_CANONICAL", "'medium'", "sd_canonical_score = 0",
        text("No canonical link"), text("Copies of the page under other addresses count as separate documents."),
    ),
    Rule(
        "SD_NO_HREFLANG", "'low'", "sd_hreflang_score = 5",
        text("No language declared"), text("Neither hreflang links nor a lang attribute on html were found."),
    ),
    Rule(
        "SD_CONTENT_SCHEMA_MISMATCH", "'low'",
        "sd_type_count > 0 and sd_og_title <> '' and sd_title <> '' and sd_title_overlap < 2e-1",
        text("og:title and title differ"),
        "concat('og:title \"', sd_og_title_short, '\" and title \"', sd_title_short, '\" share few words.')",
    ),
]
