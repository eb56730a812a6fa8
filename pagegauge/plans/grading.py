"""From captures and site files to graded pages, findings and report rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge.functions.binding import Stages, side_by_side, staged
from pagegauge.functions import html as H
from pagegauge.functions import scoring as S
from pagegauge.functions import text as T
from pagegauge.functions import urls as U
from pagegauge.operators import agent_signals, structure
from pagegauge.operators.rules import finding_columns
from pagegauge.operators.skew import salted_left_join
from pagegauge.plans.dimensions import REGISTRY

PAGE_DIMENSIONS = tuple(d for d in REGISTRY if not d.per_site)
SITE_DIMENSIONS = tuple(d for d in REGISTRY if d.per_site)


CARRIED = ("url", "final_url", "perf", "captured_at")


def page_rows(captures: DataFrame, partitioned: bool = False) -> DataFrame:
    """Nested page rows plus the capture's scalar columns, which travel with the page."""
    raw_title = F.when(F.col("has_raw"), F.col("raw_title")).otherwise(F.col("rendered_title"))
    docs = structure.page_documents(captures, partitioned, CARRIED)
    return docs.withColumns({"page_title": F.nullif(raw_title, F.lit("")), **{c: F.col(f"meta.{c}") for c in CARRIED}}).drop("meta")


@functools.cache
def _together(prefixes: tuple[str, ...]) -> Callable[[DataFrame], DataFrame]:
    return side_by_side(*[d.features for d in PAGE_DIMENSIONS if not prefixes or d.prefix in prefixes])


def page_features(captures: DataFrame, *prefixes: str, partitioned: bool = False) -> DataFrame:
    """Feature columns of the page-level dimensions (all of them, or those with the given prefixes)."""
    return _together(prefixes)(page_rows(captures, partitioned))


def with_site(pages: DataFrame, captures: DataFrame, site: DataFrame) -> DataFrame:
    """Attach the origin's row to each page; origins with very many pages are salted."""
    origins = captures.select(U.origin(F.col("final_url")).alias("origin"))
    keyed = pages.withColumn("origin", U.origin(F.col("final_url")))
    return salted_left_join(keyed, site, "origin", "page_id", origins)


def signal_features(captures: DataFrame, site_files: DataFrame) -> DataFrame:
    """Agent-signal features of every page, without touching html."""
    pages = captures.select("page_id", "final_url")
    return agent_signals.features(with_site(pages, captures, agent_signals.site_features(site_files)))


def raw_titles(captures: DataFrame) -> DataFrame:
    """(page_id, page_title): first title of the raw document, NULL if missing or blank."""
    titles = F.filter(H.tokens(F.col("raw_html")), lambda t: t.rlike(r"^<(?i:title)[\s/>]"))
    text = T.trim(T.decode_entities(H.raw_body(F.try_element_at(titles, F.lit(1)))))
    return captures.select("page_id", F.nullif(text, F.lit("")).alias("page_title"))


@staged
def _page_findings() -> Stages:
    return [{d.findings: finding_columns(d.rules) for d in PAGE_DIMENSIONS}]


@staged
def _verdict() -> Stages:
    overall = S.overall_score({d.name: F.col(d.score) for d in REGISTRY})
    findings = {d.findings: finding_columns(d.rules) for d in SITE_DIMENSIONS}
    return [{**findings, "overall_score": overall}, {"grade": S.grade(F.col("overall_score"))}]


def metrics_of(dimension) -> Column:
    """The dimension's sub-scores as one struct, the columns named as its parts are."""
    return F.struct(*dimension.scores).alias(dimension.metrics)


def graded_pages(captures: DataFrame, site_files: DataFrame, partitioned: bool = False) -> DataFrame:
    """One row per page: six scores, overall score, grade, six structs of sub-scores, six finding arrays and the site bodies.

    ``partitioned`` tells that captures are already dealt by ``page_id`` (a bucketed table), which saves the only exchange of
    the html.
    """
    pages = page_features(captures, partitioned=partitioned)
    pages = _page_findings(pages)
    keep = [F.col(d.score) for d in PAGE_DIMENSIONS] + [F.col(d.findings) for d in PAGE_DIMENSIONS] + [metrics_of(d) for d in PAGE_DIMENSIONS]
    slim = pages.select("page_id", "url", "final_url", "captured_at", "page_title", *keep)
    site = agent_signals.site_features(site_files)
    joined = agent_signals.features(with_site(slim, captures, site))
    verdict = _verdict(joined).select("*", *[metrics_of(d) for d in SITE_DIMENSIONS])
    return verdict.select(
        "page_id", "url", "final_url", "origin", "captured_at", "page_title", "robots", "llms", "sitemap", "overall_score", "grade",
        *[d.score for d in REGISTRY], *[d.metrics for d in REGISTRY], *[d.findings for d in REGISTRY],
    )
