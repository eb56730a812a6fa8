"""Host names in ASCII: the Bootstring encoding of labels (RFC 3492) as a column expression.

The encoding walks the label once for each of its different characters beyond ASCII. Those walks are laid out as one array of
(character searched, character met) and folded with the state of the encoder; a label has 63 characters at most, so the array
is small, and hosts that are ASCII already skip it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge.functions.binding import let

_BASE, _LOW, _HIGH, _SKEW, _DAMP, _BIAS, _FIRST = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
# A delta below 2**31 has no more digits than this, and is divided down in no more steps.
_PLACES = 8


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("bigint")


def _digit(value: Column) -> Column:
    return F.substring(F.lit(_DIGITS), value + 1, F.lit(1))


def _number(delta: Column, bias: Column) -> Column:
    """A delta in generalised variable-length digits."""

    def place(state: Column, i: Column) -> Column:
        threshold = F.greatest(F.lit(_LOW), F.least(F.lit(_HIGH), i * _BASE - bias)).cast("bigint")
        rest = state["rest"] - threshold
        more = F.struct(
            _div(rest, F.lit(_BASE) - threshold).alias("rest"),
            F.concat(state["out"], _digit(threshold + F.pmod(rest, F.lit(_BASE) - threshold))).alias("out"), F.lit(False).alias("done"),
        )
        last = F.struct(F.lit(0).cast("bigint").alias("rest"), F.concat(state["out"], _digit(state["rest"])).alias("out"), F.lit(True).alias("done"))
        return F.when(state["done"], state).when(state["rest"] < threshold, last).otherwise(more)

    start = F.struct(delta.cast("bigint").alias("rest"), F.lit("").alias("out"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_PLACES)), start, place, lambda s: s["out"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a delta."""
    damped = _div(delta, F.when(first, _DAMP).otherwise(2))
    limit = (_BASE - _LOW) * _HIGH // 2

    def shrink(state: Column, _: Column) -> Column:
        smaller = F.struct(_div(state["d"], _BASE - _LOW).alias("d"), (state["k"] + _BASE).alias("k"))
        return F.when(state["d"] > limit, smaller).otherwise(state)

    start = F.struct((damped + _div(damped, points)).alias("d"), F.lit(0).cast("bigint").alias("k"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(_PLACES)), start, shrink, lambda s: s["k"] + _div(s["d"] * (_BASE - _LOW + 1), s["d"] + _SKEW))


def encoded(label: Column) -> Column:
    """The label in Bootstring form, without a prefix."""

    def fold(points: Column) -> Column:
        basic = F.filter(points, lambda c: c < _FIRST)
        others = F.array_sort(F.array_distinct(F.filter(points, lambda c: c >= _FIRST)))
        size = F.size(points)
        steps = F.flatten(
            F.transform(others, lambda m: F.transform(points, lambda c, i: F.struct(m.alias("m"), c.alias("c"), (i == 0).alias("opens"), (i == size - 1).alias("closes"))))
        )

        def step(state: Column, x: Column) -> Column:
            jump = F.when(x["opens"], (x["m"] - state["n"]) * (state["h"] + 1)).otherwise(0)
            delta = state["delta"] + jump + F.when(x["c"] < x["m"], 1).otherwise(0)
            hit = x["c"] == x["m"]
            after = F.when(hit, 0).otherwise(delta) + F.when(x["closes"], 1).otherwise(0)
            return F.struct(
                F.when(x["closes"], x["m"] + 1).otherwise(x["m"]).cast("bigint").alias("n"), after.cast("bigint").alias("delta"),
                F.when(hit, _adapted(delta, state["h"] + 1, state["h"] == F.size(basic))).otherwise(state["bias"]).cast("bigint").alias("bias"),
                (state["h"] + F.when(hit, 1).otherwise(0)).cast("bigint").alias("h"),
                F.when(hit, F.concat(state["out"], _number(delta, state["bias"]))).otherwise(state["out"]).alias("out"),
            )

        plain = F.array_join(F.transform(basic, lambda c: F.char(c)), "")
        start = F.struct(
            F.lit(_FIRST).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("delta"), F.lit(_BIAS).cast("bigint").alias("bias"),
            F.size(basic).cast("bigint").alias("h"), F.when(F.size(basic) > 0, F.concat(plain, F.lit("-"))).otherwise("").alias("out"),
        )
        return F.aggregate(steps, start, step, lambda s: s["out"])

    return let(F.transform(F.regexp_extract_all(label, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("bigint")), fold)


def ascii_host(host: Column) -> Column:
    """Every label that is not ASCII as ``xn--`` and its Bootstring form."""
    beyond = r"[^\x00-\x7F]"
    labels = F.transform(F.split(host, r"\."), lambda x: F.when(x.rlike(beyond), F.concat(F.lit("xn--"), encoded(x))).otherwise(x))
    return F.when(host.rlike(beyond), F.array_join(labels, ".")).otherwise(host)
