"""Machine readability: can a non-rendering reader see and structure the page (weight .25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import scoring as S
from pagegauge.functions import text as T
from pagegauge.functions.binding import Stages, staged
from pagegauge.operators import elements as E
from pagegauge.operators.rules import Rule, text

SCORES = (
    "mr_raw_score", "mr_semantic_score", "mr_button_score",
    "mr_heading_score", "mr_landmark_score", "mr_iframe_score",
)


@staged
def features() -> Stages:
    stages: Stages = []
    nodes = F.filter("txts", lambda p: p["node"].isNotNull())
    length = lambda p: F.length(p["node"]).cast("bigint")
    stages.append(
        {
            "mr_rendered_chars": E.total(nodes, length),
            "mr_covered_chars": E.total(F.filter(nodes, lambda p: p["in_raw"] | ~F.col("has_raw")), length),
            "mr_js_only": F.when(
                F.col("has_raw"),
                F.slice(
                    F.transform(F.filter(nodes, lambda p: ~p["in_raw"]), lambda p: p["node"]), 1, C.JS_ONLY_SAMPLE
                ),
            ).otherwise(F.array().cast("array<string>")),
            "mr_headings": F.transform(
                E.where(E.tag_in(*C.HEADING_TAGS)), lambda e: F.substring(e["tag"], 2, 1).cast("int")
            ),
            "mr_iframe_chars": E.total(E.where(E.tag_in("iframe")), lambda e: e["size"].cast("bigint")),
            "mr_iframe_count": E.count(E.where(E.tag_in("iframe"))),
            "mr_real_buttons": E.count(E.where(E.is_real_button)),
            "mr_clickable_divs": E.count(E.where(E.is_fake_button)),
            "mr_semantic_total": sum((F.col(f"n_{t}") for t in C.SEMANTIC_TAGS), F.lit(0)),
            "mr_landmarks": sum(((F.col(f"n_{t}") > 0).cast("int") for t in C.LANDMARK_TAGS), F.lit(0)),
        }
    )
    semantic, div = F.col("mr_semantic_total"), F.col("n_div")
    stages.append(
        {
            "mr_raw_chars": F.when(F.col("has_raw"), F.coalesce("raw_node_chars", F.lit(0))).otherwise(
                F.col("mr_rendered_chars")
            ).cast("bigint"),
            "mr_raw_coverage": F.when(F.col("mr_rendered_chars") == 0, F.lit(1.0)).otherwise(
                F.col("mr_covered_chars").cast("double")
                / F.nullif(F.col("mr_rendered_chars").cast("double"), F.lit(0.0))
            ),
            "mr_js_only_sample": T.snippet(F.array_join(F.slice("mr_js_only", 1, 3), " | ")),
            "mr_semantic_ratio": F.when(semantic == 0, F.lit(0.0)).otherwise(
                semantic.cast("double") / F.greatest(F.lit(1.0), (semantic + div).cast("double"))
            ),
            "mr_h1_count": F.size(F.filter("mr_headings", lambda x: x == 1)).cast("int"),
            "mr_heading_skip": F.exists(
                F.transform("mr_headings", lambda x, i: x - F.get("mr_headings", i - 1)),
                lambda step: F.coalesce(step > 1, F.lit(False)),
            ),
            "mr_heading_path": F.array_join(F.transform("mr_headings", lambda x: x.cast("string")), "→"),
            "mr_iframe_ratio": F.col("mr_iframe_chars").cast("double")
            / F.greatest(F.lit(1.0), F.col("html_chars").cast("double")),
        }
    )
    coverage, ratio, iframe = F.col("mr_raw_coverage"), F.col("mr_semantic_ratio"), F.col("mr_iframe_ratio")
    fake, real = F.col("mr_clickable_divs"), F.col("mr_real_buttons").cast("double")
    heading = (
        F.lit(15)
        - F.when(F.col("mr_h1_count") == 0, 10).when(F.col("mr_h1_count") > 1, 5).otherwise(0)
        - F.when(F.col("mr_heading_skip"), 5).otherwise(0)
    )
    stages.append(
        {
            "mr_raw_score": F.when(coverage >= 0.9, 25).when(coverage >= 0.6, 18).when(coverage >= 0.3, 10).otherwise(0),
            "mr_semantic_score": F.when(F.col("mr_semantic_total") == 0, 0)
            .when(ratio < 0.05, 8)
            .when(ratio < 0.15, 14)
            .otherwise(20),
            "mr_button_score": F.when(fake == 0, 15).when(fake <= real / 4, 10).otherwise(0),
            "mr_heading_score": F.greatest(F.lit(0), heading),
            "mr_landmark_score": F.when(F.col("mr_landmarks") == 0, 0).when(F.col("mr_landmarks") == 1, 5).otherwise(10),
            "mr_iframe_score": F.when(iframe < 0.05, 15).when(iframe < 0.2, 8).otherwise(0),
        }
    )
    stages.append({"mr_score": S.clamp_score(sum((F.col(c) for c in SCORES), F.lit(0)))})
    return stages


_PERCENT = "cast(cast(floor({} * 100 + 5e-1) as bigint) as string)"

RULES = [
    Rule(
        "MR_MODERATE_JS_DEPENDENCE", "'medium'", "mr_raw_coverage >= 3e-1 and mr_raw_coverage < 6e-1",
        text("Much of the text needs JavaScript"),
        f"concat('Only ', {_PERCENT.format('mr_raw_coverage')}, '% of the visible text is in the raw HTML.')",
        "mr_js_only_sample",
    ),
    Rule(
        "MR_HIGH_JS_DEPENDENCE", "'high'", "mr_raw_coverage < 3e-1",
        text("Nearly all text needs JavaScript"),
        f"concat('The raw HTML holds ', {_PERCENT.format('mr_raw_coverage')}, '% of the visible text.')",
        "mr_js_only_sample",
    ),
    Rule(
        "MR_NO_SEMANTIC_TAGS", "'high'", "mr_semantic_total = 0",
        text("No semantic tags"), text("Readers cannot tell content from decoration without main, article, nav and the like."),
    ),
    Rule(
        "MR_LOW_SEMANTIC_RATIO", "'medium'", "mr_semantic_total > 0 and mr_semantic_ratio < 5e-2",
        text("Few semantic tags"),
        "concat(cast(mr_semantic_total as string), ' semantic tags stand against ', cast(n_div as string), ' divs.')",
    ),
    Rule(
        "MR_CLICKABLE_DIVS", "'medium'",
        "mr_clickable_divs > 0 and mr_clickable_divs > cast(mr_real_buttons as double) / 4",
        text("Click handlers on generic elements"),
        "concat(cast(mr_clickable_divs as string), ' clickable div or span elements next to ', "
        "cast(mr_real_buttons as string), ' real buttons and links.')",
    ),
    Rule("MR_MISSING_H1", "'medium'", "mr_h1_count = 0", text("No h1"), text("A page needs one main heading.")),
    Rule(
        "MR_MULTIPLE_H1", "'low'", "mr_h1_count > 1",
        "concat('Several h1 headings (', cast(mr_h1_count as string), ')')", text("More than one main heading blurs the topic."),
    ),
    Rule(
        "MR_HEADING_SKIP", "'low'", "mr_heading_skip",
        text("Heading levels are skipped"), "concat('Heading order: ', mr_heading_path, '.')",
    ),
    Rule(
        "MR_NO_LANDMARKS", "'medium'", "mr_landmarks = 0",
        text("No landmark elements"), text("main, nav, header and footer let readers jump to a part of the page."),
    ),
    Rule(
        "MR_CONTENT_IN_IFRAME", "'medium'", "mr_iframe_ratio >= 2e-1",
        text("Much of the page sits in iframes"),
        f"concat('About ', {_PERCENT.format('mr_iframe_ratio')}, '% of the HTML is iframe markup.')",
    ),
]
