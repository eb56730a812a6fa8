"""Score arithmetic: half-up rounding, clamping, linear interpolation, grades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge import constants as C


def half_up(col: Column) -> Column:
    """Round half towards plus infinity, as an INT."""
    return F.floor(col.cast("double") + F.lit(0.5)).cast("int")


def clamp_score(col: Column) -> Column:
    value = col.cast("double")
    finite = ~(value.isNull() | F.isnan(value) | F.abs(value).eqNullSafe(F.lit(float("inf"))))
    bounded = half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))
    return F.when(finite, bounded).otherwise(F.lit(0))


def linear_score(value: Column, good_at: float, bad_at: float, points: int) -> Column:
    """Full points at or beyond ``good_at``, none at or beyond ``bad_at``, linear between."""
    v = value.cast("double")
    good, bad = F.lit(float(good_at)), F.lit(float(bad_at))
    if good_at == bad_at:
        return F.when(v <= good, points).otherwise(0).cast("int")
    if bad_at > good_at:
        inner = half_up((bad - v) / (bad - good) * F.lit(float(points)))
        return F.when(v <= good, points).when(v >= bad, 0).otherwise(inner).cast("int")
    inner = half_up((v - bad) / (good - bad) * F.lit(float(points)))
    return F.when(v >= good, points).when(v <= bad, 0).otherwise(inner).cast("int")


def share_score(part: Column, whole: Column, points: int) -> Column:
    """Rounded share of the points; all points where there is nothing to check."""
    ratio = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return F.when(whole == 0, points).otherwise(half_up(ratio * F.lit(float(points)))).cast("int")


def overall_score(scores: dict[str, Column]) -> Column:
    """Weighted sum in the fixed dimension order, rounded half up."""
    terms = [scores[d].cast("double") * F.lit(C.WEIGHTS[d]) for d in C.DIMENSIONS]
    return half_up(reduce(lambda a, b: a + b, terms))


def grade(score: Column) -> Column:
    out = F.when(score >= C.GRADE_BOUNDS[0][1], C.GRADE_BOUNDS[0][0])
    for name, bound in C.GRADE_BOUNDS[1:]:
        out = out.when(score >= bound, name)
    return out.otherwise("F")
