"""Performance: timings, weight and blocking consent dialogs (weight .10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import html as H
from pagegauge.functions import scoring as S
from pagegauge.functions.binding import Stages, in_order, staged
from pagegauge.operators import elements as E
from pagegauge.operators.rules import Rule, text

SCORES = ("pf_ttfb_score", "pf_page_score", "pf_request_score", "pf_dcl_score", "pf_banner_score")


def is_blocking_banner(e: Column) -> Column:
    """Element that mentions consent and is stacked high, pinned or a dialog."""
    lower = lambda name: F.lower(F.coalesce(H.attr(e["attrs"], name), F.lit("")))
    below = F.coalesce(e["k1"], F.col("k_total")) > e["k0"]
    mentions = below | F.concat_ws(" ", lower("id"), lower("class")).rlike(C.COOKIE_PATTERN)
    z_index = F.regexp_extract(lower("style"), r"z-index\s*:\s*([0-9]+)", 1)
    high = (F.length(F.ltrim(z_index, F.lit("0"))) > 9) | F.coalesce(z_index.try_cast("int") > 1000, F.lit(False))
    pinned = lower("style").rlike(r"position\s*:\s*(?:fixed|sticky)")
    dialog = (lower("role") == "dialog") | H.attr_is(e["attrs"], "aria-modal", "true")
    return mentions & (high | pinned | dialog)


@staged
def timing_features() -> Stages:
    """Scores that need only the ``perf`` struct."""
    perf = lambda name: F.col(f"perf.{name}")
    return [
        {
            "pf_ttfb": perf("ttfb"),
            "pf_page_size": perf("page_size"),
            "pf_requests": perf("num_requests"),
            "pf_dcl": perf("dom_content_loaded"),
            "pf_network_idle": perf("network_idle"),
            "pf_ttfb_score": S.linear_score(perf("ttfb"), 200, 1500, 30),
            "pf_page_score": S.linear_score(perf("page_size"), 500_000, 5_000_000, 25),
            "pf_request_score": S.linear_score(perf("num_requests"), 30, 150, 20),
            "pf_dcl_score": S.linear_score(perf("dom_content_loaded"), 1500, 6000, 15),
        }
    ]


@staged
def _banner_features() -> Stages:
    banners = F.col("pf_banners")
    return [
        {"pf_banners": E.count(E.where(is_blocking_banner))},
        {"pf_banner_score": F.when(banners == 0, 10).when(banners == 1, 5).otherwise(0)},
        {"pf_score": S.clamp_score(sum((F.col(c) for c in SCORES), F.lit(0)))},
    ]


# Needs the ``perf`` struct next to the nested page row.
features = in_order(timing_features, _banner_features)


_MS = "concat({}, cast(cast({} as bigint) as string), ' ms')"
_CENTI_MB = "cast(floor(cast(pf_page_size as double) / 10000 + 5e-1) as bigint)"

RULES = [
    Rule(
        "PF_SLOW_TTFB", "case when pf_ttfb > 1200 then 'high' else 'medium' end", "pf_ttfb > 600",
        _MS.format("'The first byte takes '", "pf_ttfb"), text("The server answers late; waiting readers may give up."),
    ),
    Rule(
        "PF_HEAVY_PAGE", "case when pf_page_size > 4000000 then 'high' else 'medium' end", "pf_page_size > 2000000",
        f"concat('Heavy page (', cast(cast(floor({_CENTI_MB} / 100) as bigint) as string), '.', "
        f"lpad(cast({_CENTI_MB} % 100 as string), 2, '0'), ' MB)')",
        text("Large pages cost time and tokens."),
    ),
    Rule(
        "PF_TOO_MANY_REQUESTS", "case when pf_requests > 120 then 'medium' else 'low' end", "pf_requests > 80",
        "concat(cast(pf_requests as string), ' requests')", text("Many requests delay the moment the page settles."),
    ),
    Rule(
        "PF_SLOW_DCL", "case when pf_dcl > 5000 then 'medium' else 'low' end", "pf_dcl > 3000",
        _MS.format("'DOMContentLoaded after '", "pf_dcl"), text("Scripts or styles in the head block the page."),
    ),
    Rule(
        "PF_SLOW_NETWORK_IDLE", "'low'", "pf_network_idle > 10000",
        _MS.format("'The network is busy for '", "pf_network_idle"), text("Late requests hide when the page is ready."),
    ),
    Rule(
        "PF_COOKIE_BANNER_BLOCKING", "case when pf_banners = 1 then 'medium' else 'high' end", "pf_banners >= 1",
        "concat(cast(pf_banners as string), case when pf_banners = 1 then ' blocking consent dialog' else ' blocking dialogs' end)",
        text("Dialogs over the page stop agents until dismissed."),
    ),
]
