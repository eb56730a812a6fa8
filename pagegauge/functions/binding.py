"""Naming intermediate values: inside one column expression, and as successive column stages."""

from __future__ import annotations

import functools
from collections.abc import Callable
from itertools import zip_longest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Stages = list[dict[str, Column]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def staged(build: Callable[[], Stages]) -> Callable[[DataFrame], DataFrame]:
    """Make a ``DataFrame -> DataFrame`` function out of successive groups of named expressions.

    The expressions name columns but no frame, so they are built once per Spark connection and reused:
    building them takes thousands of calls into the JVM.
    """
    kept: dict[str, object] = {}

    @functools.wraps(build)
    def apply(df: DataFrame) -> DataFrame:
        connection = df.sparkSession.sparkContext._gateway
        if kept.get("connection") is not connection:
            kept.update(connection=connection, stages=build())
        for stage in kept["stages"]:
            df = df.withColumns(stage)
        return df

    apply.build = build
    return apply


def in_order(*parts: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One staged function of several, each of which may use the columns of those before."""
    return staged(lambda: [stage for part in parts for stage in part.build()])


def side_by_side(*parts: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """One staged function of several that don't use each other's columns: their first stages are one stage, and so on.

    Every stage copies the row, the texts of a page included, and is compiled on its own, so few wide ones cost less than many.
    """
    return staged(lambda: [{n: c for stage in stages for n, c in stage.items()} for stages in zip_longest(*(part.build() for part in parts), fillvalue={})])
