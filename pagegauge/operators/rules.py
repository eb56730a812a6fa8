"""Finding rules as data.

A rule is a stable ID, a severity and a handful of SQL expressions over one page's feature columns, so a
rule table can be read, extended or exported without touching any operator.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FINDING_TYPE = (
    "struct<ord:int,id:string,severity:string,title:string,description:string,evidence:string,"
    "recommendation:struct<priority:string,category:string,title:string,description:string,exampleCode:string>>"
)


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str  # SQL expression
    when: str  # SQL predicate
    title: str  # SQL expression
    description: str  # SQL expression
    evidence: str | None = None  # SQL expression


def text(value: str) -> str:
    """SQL literal."""
    return "'" + value.replace("'", "''") + "'"


def finding_columns(rules: list[Rule]) -> Column:
    """Ordered ``array<struct<...>>`` of the findings that fire on a row."""
    items = [
        F.when(
            F.expr(rule.when),
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(rule.id).alias("id"),
                F.expr(rule.severity).alias("severity"),
                F.expr(rule.title).alias("title"),
                F.expr(rule.description).alias("description"),
                (F.expr(rule.evidence) if rule.evidence else F.lit(None)).cast("string").alias("evidence"),
                # The checks themselves never attach a recommendation; stored reports may carry one.
                F.lit(None).cast(FINDING_TYPE.split("recommendation:")[1][:-1]).alias("recommendation"),
            ),
        )
        for i, rule in enumerate(rules)
    ]
    return F.array_compact(F.array(*items))
