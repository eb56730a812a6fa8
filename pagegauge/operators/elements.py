"""Shared expressions over the nested page row (``els``, ``txts``, ``solid``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge.functions import html as H


def where(*conditions) -> Column:
    """Elements meeting every condition, in document order."""
    return F.filter("els", lambda e: reduce(lambda a, b: a & b, [c(e) for c in conditions]))


def tag_in(*tags):
    return lambda e: e["tag"].isin(*tags)


def first(tag: str, *conditions) -> Column:
    return F.try_element_at(where(tag_in(tag), *conditions), F.lit(1))


def count(array: Column) -> Column:
    return F.size(array).cast("int")


def pieces(e: Column) -> Column:
    """Text pieces below an element."""
    until = F.coalesce(e["t1"], F.size("txts"))
    return F.slice("txts", e["t0"] + 1, F.greatest(F.lit(0), until - e["t0"]))


def text_of(e: Column) -> Column:
    return F.array_join(F.transform(pieces(e), lambda p: p["s"]), "")


def trimmed_length(e: Column) -> Column:
    """Length of the element's trimmed text, from character offsets."""
    until = F.coalesce(e["n1"], F.size("solid"))
    end = F.get("solid", until - 1)["last"]
    start = F.get("solid", e["n0"])["first"]
    return F.when(until > e["n0"], end - start).otherwise(F.lit(0).cast("bigint"))


def is_real_button(e: Column) -> Column:
    return (
        (e["tag"] == "button")
        | ((e["tag"] == "a") & H.has_attr(e["attrs"], "href"))
        | ((e["tag"] == "input") & H.attr_is_ci(e["attrs"], "type", "submit", "button"))
    )


def is_fake_button(e: Column) -> Column:
    return e["tag"].isin("div", "span") & (
        H.has_attr(e["attrs"], "onclick") | H.attr_is(e["attrs"], "role", "button")
    )


def total(array: Column, value) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda acc, x: acc + value(x))
