"""Column helpers over single HTML tokens and element structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import text as T

RAW_TAG_LIST = "|".join(C.RAW_TEXT_TAGS)


def tokens(html: Column) -> Column:
    """Ordered, lossless token array of a document."""
    return F.regexp_extract_all(html, F.lit(C.TOKEN_PATTERN), F.lit(0))


def tag_name(token: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(token, C.TAG_NAME_PATTERN, 1)), F.lit(""))


def token_kind(token: Column, tag: Column) -> Column:
    closing = F.startswith(token, F.lit("</"))
    return (
        F.when(F.startswith(token, F.lit("<!--")), "comment")
        .when(token.rlike("^<!(?i:doctype)"), "doctype")
        .when(token.rlike("^<[!?]") | token.rlike("^</[^a-zA-Z]"), "comment")
        # A tag that the page ends in is no tag.
        .when(tag.isNotNull() & ~F.endswith(token, F.lit(">")) & ~(tag.isin(*C.RAW_TEXT_TAGS) & token.rlike("^<[a-zA-Z][^>]*>")), "comment")
        .when(tag.isNotNull() & closing, "close")
        .when(tag.isin("script", "style"), tag)
        .when(tag.isin(*C.RAW_TEXT_TAGS), "rawtext")
        .when(tag.isNotNull(), "open")
        .otherwise("text")
    )


def raw_body(token: Column) -> Column:
    """Content between the start and end tag of a raw-text element token."""
    body = F.regexp_replace(token, r"^<[^>]*>", "")
    tail = F.substring_index(body, "</", -1)
    closed = tail.rlike(rf"^(?i:{RAW_TAG_LIST})[^>]*>?\z") & (F.length(tail) < F.length(body))
    return F.when(closed, F.left(body, F.length(body) - F.length(tail) - 2)).otherwise(body)


def attributes(token: Column) -> Column:
    """``array<struct<name,value>>`` of a start tag, names lower-cased, values decoded, source order."""
    start = F.when(
        tag_name(token).isin(*C.RAW_TEXT_TAGS), F.regexp_extract(token, r"^<[^>]*>", 0)
    ).otherwise(token)
    inner = F.regexp_replace(start, r"^<[a-zA-Z][^\s/>]*", "")
    parts = F.regexp_extract_all(inner, F.lit(C.ATTRIBUTE_PATTERN), F.lit(0))

    def pair(part: Column) -> Column:
        value = F.regexp_replace(part, r"^[^=]*=\s*", "")
        bare = F.when(value.rlike("(?s)^(?:\".*\"|'.*')$") & (F.length(value) > 1), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(
            F.lower(F.regexp_extract(part, r"^[^\s=]+", 0)).alias("name"),
            F.when(F.contains(part, F.lit("=")), T.decode_entities(bare)).otherwise("").alias("value"),
        )

    return F.transform(parts, pair)


def attr(attrs: Column, name: str) -> Column:
    """Value of the first attribute with that name, NULL if absent."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == F.lit(name)), F.lit(1))["value"]


def has_attr(attrs: Column, name: str) -> Column:
    return F.exists(attrs, lambda a: a["name"] == F.lit(name))


def attr_is(attrs: Column, name: str, value: str) -> Column:
    return F.coalesce(attr(attrs, name) == F.lit(value), F.lit(False))


def attr_is_ci(attrs: Column, name: str, *values: str) -> Column:
    """Value comparison without regard to case (type, rel)."""
    return F.coalesce(F.lower(attr(attrs, name)).isin(*values), F.lit(False))


def present(value: Column) -> Column:
    """Neither NULL nor empty."""
    return F.coalesce(value != "", F.lit(False))
