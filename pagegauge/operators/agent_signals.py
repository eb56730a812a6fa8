"""Agent signals: robots rules, llms.txt, sitemap and https (weight .15).

Everything but https belongs to the origin, so it is worked out once per origin and joined to pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import scoring as S
from pagegauge.functions import text as T
from pagegauge.functions import urls as U
from pagegauge.functions.binding import Stages, staged
from pagegauge.operators.rules import Rule, text

SCORES = (
    "as_robots_score", "as_bot_score", "as_directive_score", "as_llms_score",
    "as_llms_valid_score", "as_sitemap_score", "as_https_score",
)
_NOT_WS = C.WHITESPACE_PATTERN.replace("[", "[^", 1)
_H1 = f"^#{C.WHITESPACE_PATTERN}+{_NOT_WS}"
_SECTION = f"^##{C.WHITESPACE_PATTERN}+{_NOT_WS}"
_LINK = r"\[[^\]]+\]\([^)]+\)"
_LINES = "\r?\n"


def site_table(site_files: DataFrame) -> DataFrame:
    """(origin, robots, llms, sitemap): the long file table with one row per origin."""
    return site_files.groupBy("origin").agg(
        *[F.max(F.when(F.col("kind") == k, F.col("body"))).alias(k) for k in ("robots", "llms", "sitemap")]
    )


def robots_lines(sites: DataFrame) -> DataFrame:
    """(origin, line, block, directive, value) of the meaningful robots lines.

    Consecutive user-agent lines open one block; block 0 holds what precedes the first of them.
    """
    lines = sites.select("origin", F.posexplode(F.split("robots", _LINES)).alias("line", "raw"))
    clean = lines.withColumn("raw", T.trim(F.regexp_replace("raw", "#.*", "")))
    directive = F.lower(T.trim(F.regexp_extract("raw", "^([^:]*):", 1)))
    parsed = clean.where(F.contains("raw", F.lit(":"))).select(
        "origin", "line", directive.alias("directive"), T.trim(F.regexp_replace("raw", "^[^:]*:", "")).alias("value")
    )
    order = Window.partitionBy("origin").orderBy("line")
    agent = F.col("directive") == "user-agent"
    first = agent & ~F.lag(agent, 1, False).over(order)
    return parsed.withColumn("_first", F.when(first, 1).otherwise(0)).select(
        "origin", "line", F.sum("_first").over(order).cast("int").alias("block"), "directive", "value"
    )


def robots_rules(sites: DataFrame) -> DataFrame:
    """Allow, disallow and sitemap lines with the user agents of their block."""
    rows = robots_lines(sites)
    block = Window.partitionBy("origin", "block")
    agents = F.array_sort(
        F.collect_list(F.when(F.col("directive") == "user-agent", F.struct("line", "value"))).over(block)
    )
    listed = F.when(F.col("directive") != "sitemap", F.array_join(F.transform(agents, lambda a: a["value"]), "|"))
    kept = (F.col("directive") == "sitemap") | (F.col("directive").isin("allow", "disallow") & (F.col("block") > 0))
    return rows.withColumn("user_agents", listed).where(kept)


def _bot_column(bot: str) -> str:
    return "blocks_" + ("any" if bot == "*" else bot.lower().replace("-", "_"))


def bot_access(sites: DataFrame) -> DataFrame:
    """One row per origin with robots lines: sitemap count and, per bot, whether its block bars the root."""
    rows = robots_lines(sites)
    block = Window.partitionBy("origin", "block")
    bars_root = F.max((F.col("directive") == "disallow") & (F.col("value") == "/")).over(block)
    rows = rows.withColumn("bars", bars_root)

    def first_block(condition):
        named = (F.col("directive") == "user-agent") & condition
        return F.min(F.when(named, F.struct("line", "bars")))["bars"]

    value = F.col("value")
    return rows.groupBy("origin").agg(
        F.count_if(F.col("directive") == "sitemap").cast("int").alias("sitemap_lines"),
        first_block(value == "*").alias("any"),
        *[first_block(F.lower(value) == b.lower()).alias(_bot_column(b)) for b in C.AI_BOTS],
    ).select(
        "origin",
        "sitemap_lines",
        *[F.coalesce(_bot_column(b), "any", F.lit(False)).alias(_bot_column(b)) for b in C.AI_BOTS],
    )


def has_text(body: Column) -> Column:
    return F.coalesce(T.trim(body) != "", F.lit(False))


def sitemap_valid(body: Column) -> Column:
    root = body.rlike(r"<urlset[\s>]") | body.rlike(r"<sitemapindex[\s>]")
    return F.coalesce(F.contains(body, F.lit("<?xml")) & root, F.lit(False))


def llms_columns(body: Column) -> dict[str, Column]:
    lines = F.split(body, _LINES)
    links = F.flatten(F.transform(lines, lambda s: F.regexp_extract_all(s, F.lit(_LINK), F.lit(0))))
    return {
        "llms_has_h1": F.coalesce(F.exists(lines, lambda s: s.rlike(_H1)), F.lit(False)),
        "llms_sections": F.coalesce(F.size(F.filter(lines, lambda s: s.rlike(_SECTION))), F.lit(0)).cast("int"),
        "llms_links": F.coalesce(F.size(links), F.lit(0)).cast("int"),
        "llms_full_link": F.coalesce(F.exists(links, lambda s: s.rlike(r"(?i)llms-full\.txt")), F.lit(False)),
    }


def site_features(site_files: DataFrame) -> DataFrame:
    """One row per origin: the three bodies and every origin-level signal and score."""
    sites = site_table(site_files)
    out = sites.join(bot_access(sites), "origin", "left")
    robots, llms = has_text(F.col("robots")), has_text(F.col("llms"))
    names = {b: _bot_column(b) for b in C.AI_BOTS}

    def bots(blocked: bool) -> Column:
        hit = {b: F.coalesce(F.col(c), F.lit(False)) for b, c in names.items()}
        return F.array_compact(
            F.array(*[F.when(robots & (hit[b] if blocked else ~hit[b]), F.lit(b)) for b in C.AI_BOTS])
        )

    out = out.withColumns(
        {
            "as_has_robots": robots,
            "as_allowed": bots(False),
            "as_blocked": bots(True),
            "as_sitemap_lines": F.when(robots, F.coalesce("sitemap_lines", F.lit(0))).otherwise(0).cast("int"),
            "as_has_llms": llms,
            **{f"as_{k}": v for k, v in llms_columns(F.when(llms, F.col("llms"))).items()},
            "as_has_sitemap": has_text(F.col("sitemap")),
            "as_sitemap_valid": sitemap_valid(F.col("sitemap")),
            "as_llms_snippet": T.snippet(F.col("llms")),
            "as_sitemap_snippet": T.snippet(F.col("sitemap")),
        }
    ).drop("sitemap_lines", *names.values())
    return _site_scores(
        out.withColumns(
            {
                "as_allowed_count": F.size("as_allowed").cast("int"),
                "as_blocked_list": F.array_join("as_blocked", ", "),
            }
        )
    )


def _site_scores(sites: DataFrame) -> DataFrame:
    valid = F.col("as_llms_has_h1") & (F.col("as_llms_sections") >= 1)
    return sites.withColumns(
        {
            "as_robots_score": F.when(F.col("as_has_robots"), 10).otherwise(0),
            "as_bot_score": S.half_up(F.col("as_allowed_count").cast("double") / F.lit(float(len(C.AI_BOTS))) * F.lit(30.0)),
            "as_directive_score": F.when(F.col("as_sitemap_lines") > 0, 10).otherwise(0),
            "as_llms_score": F.when(F.col("as_has_llms"), 20).otherwise(0),
            "as_llms_valid_score": F.when(F.col("as_has_llms") & valid, 10).otherwise(0),
            "as_sitemap_score": F.when(F.col("as_has_sitemap") & F.col("as_sitemap_valid"), 10).otherwise(0),
        }
    )


@staged
def features() -> Stages:
    """Page-level signals after the site row was joined; pages of unprobed origins have none."""
    flags = ("as_has_robots", "as_has_llms", "as_has_sitemap", "as_sitemap_valid", "as_llms_has_h1", "as_llms_full_link")
    numbers = ("as_allowed_count", "as_sitemap_lines", "as_llms_sections", "as_llms_links", *SCORES[:-1])
    stages: Stages = [
        {
            **{c: F.coalesce(c, F.lit(False)) for c in flags},
            **{c: F.coalesce(c, F.lit(0)) for c in numbers},
            "as_blocked_list": F.coalesce("as_blocked_list", F.lit("")),
            "as_https": U.is_https(F.col("final_url")),
        },
        {"as_https_score": F.when(F.col("as_https"), 10).otherwise(0)},
        {"as_score": S.clamp_score(sum((F.col(c) for c in SCORES), F.lit(0)))},
    ]
    return stages


_ALL = ", ".join(C.AI_BOTS)
RULES = [
    Rule(
        "AS_ROBOTS_BLOCKS_AI", "'high'", "as_has_robots and as_allowed_count = 0",
        text("robots.txt bars every AI reader"), text(f"Barred: {_ALL}."),
    ),
    Rule(
        "AS_ROBOTS_PARTIAL_AI", "'medium'", "as_has_robots and as_allowed_count between 1 and 7",
        "concat('robots.txt bars ', cast(8 - as_allowed_count as string), ' of 8 AI readers')",
        "concat('Barred: ', as_blocked_list, '.')",
    ),
    Rule(
        "AS_ROBOTS_NO_SITEMAP", "'low'", "as_has_robots and as_sitemap_lines = 0",
        text("robots.txt names no sitemap"), text("A Sitemap line leads readers to all pages."),
    ),
    Rule(
        "AS_NO_ROBOTS_TXT", "'medium'", "not as_has_robots",
        text("No robots.txt"), text("Readers fall back to their own defaults."),
    ),
    Rule(
        "AS_LLMS_TXT_INVALID", "'low'", "as_has_llms and not (as_llms_has_h1 and as_llms_sections >= 1)",
        text("llms.txt lacks the expected structure"), text("It should hold a main heading and at least one section."),
        "as_llms_snippet",
    ),
    Rule(
        "AS_NO_LLMS_FULL", "'info'", "as_has_llms and not as_llms_full_link",
        text("llms.txt does not link the full text"), text("A link to llms-full.txt gives access to the whole content."),
    ),
    Rule("AS_NO_LLMS_TXT", "'medium'", "not as_has_llms", text("No llms.txt"), text("The file points readers to curated content.")),
    Rule(
        "AS_INVALID_SITEMAP", "'medium'", "as_has_sitemap and not as_sitemap_valid",
        text("The sitemap is not valid"), text("It needs an XML declaration and a urlset or sitemapindex root."),
        "as_sitemap_snippet",
    ),
    Rule("AS_NO_SITEMAP", "'low'", "not as_has_sitemap", text("No sitemap"), text("A sitemap lists every page of the site.")),
    Rule("AS_NOT_HTTPS", "'high'", "not as_https", text("No https"), text("Many readers refuse plain http.")),
]
