"""The six dimensions: one query per check plus the dimension score."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.operators import agent_signals, performance, structured_data
from pagegauge.operators import structure
from pagegauge.plans import grading
from workload import feature_ctes  # noqa: F401  (fills the CTE table)
from workload.feature_ctes import flesch_ctes
from workload.registry import query

ROUNDED = {
    "mr_raw_coverage", "mr_semantic_ratio", "mr_iframe_ratio", "sd_title_overlap", "ac_label_ratio", "ac_name_ratio",
    "ac_autocomplete_ratio", "ac_alt_ratio", "ac_stability_ratio", "cc_h1_overlap", "cc_boilerplate_ratio", "cc_flesch",
}
LISTS = {"mr_js_only", "sd_types"}
LONG = {"mr_rendered_chars", "mr_covered_chars", "mr_raw_chars", "mr_iframe_chars", "cc_boilerplate_chars", "cc_visible_chars", "pf_page_size"}
TEXT = {
    "mr_js_only_sample", "mr_heading_path", "sd_type_list", "sd_first_invalid", "sd_og_title", "sd_og_missing_list", "sd_twitter_card",
    "sd_canonical", "sd_html_lang", "sd_title", "as_blocked_list", "cc_title", "cc_meta", "cc_h1", "cc_main_text", "cc_main_source",
}
FLAGS = {
    "mr_heading_skip", "sd_known_type", "ac_has_skip_link", "ac_url_readable", "as_https", "as_has_robots", "as_has_llms",
    "as_has_sitemap", "as_sitemap_valid", "as_llms_has_h1", "as_llms_full_link",
}
DOUBLES = {"pf_ttfb", "pf_dcl", "pf_network_idle"}


def _spark_column(name):
    if name in LISTS:
        return F.array_join(name, "|").alias(name)
    if name in ROUNDED:
        return F.round(F.coalesce(name, F.lit(-1.0)), 9).alias(name)
    if name in TEXT:
        return F.coalesce(name, F.lit("")).alias(name)
    if name in FLAGS or name in DOUBLES:
        return F.col(name)
    return F.col(name).cast("bigint" if name in LONG else "int").alias(name)


def _sql_column(name):
    if name in LISTS:
        return f"array_to_string({name}, '|') as {name}"
    if name in ROUNDED:
        return f"round(coalesce({name}, -1e0), 9) as {name}"
    if name in TEXT:
        return f"coalesce({name}, '') as {name}"
    if name in FLAGS or name in DOUBLES:
        return name
    return f"cast({name} as {'bigint' if name in LONG else 'int'}) as {name}"


def dimension_query(name: str, prefix: str, *columns: str):
    """Query over one dimension's features; Catalyst prunes what the columns do not need."""
    expected = f"select page_id, {', '.join(map(_sql_column, columns))} from {prefix}f"

    @query(name, expected)
    def run(t):
        if prefix == "as":
            features = grading.signal_features(t.captures(), t.site_files())
        else:
            features = grading.page_features(t.captures(), prefix)
        return features.select("page_id", *map(_spark_column, columns))


dimension_query("mr_raw_coverage", "mr", "mr_raw_chars", "mr_rendered_chars", "mr_raw_coverage", "mr_js_only", "mr_raw_score")
dimension_query("mr_semantic_density", "mr", "mr_semantic_total", "mr_semantic_ratio", "mr_semantic_score")
dimension_query("mr_real_buttons", "mr", "mr_real_buttons", "mr_clickable_divs", "mr_button_score")
dimension_query("mr_heading_hierarchy", "mr", "mr_h1_count", "mr_heading_skip", "mr_heading_path", "mr_heading_score")
dimension_query("mr_landmarks", "mr", "mr_landmarks", "mr_landmark_score")
dimension_query("mr_iframe_share", "mr", "mr_iframe_count", "mr_iframe_chars", "mr_iframe_ratio", "mr_iframe_score")
dimension_query(
    "mr_score", "mr", "mr_raw_score", "mr_semantic_score", "mr_button_score", "mr_heading_score",
    "mr_landmark_score", "mr_iframe_score", "mr_score",
)

dimension_query(
    "sd_json_ld_score", "sd", "sd_block_count", "sd_valid_count", "sd_context_count", "sd_type_count",
    "sd_known_type", "sd_first_invalid", "sd_json_ld_score",
)
dimension_query("sd_open_graph", "sd", "sd_og_count", "sd_og_title", "sd_og_missing_list", "sd_og_score")
dimension_query("sd_twitter_card", "sd", "sd_twitter_card", "sd_twitter_score")
dimension_query("sd_microdata", "sd", "sd_microdata_count", "sd_microdata_score")
dimension_query("sd_canonical", "sd", "sd_canonical", "sd_canonical_score")
dimension_query("sd_hreflang", "sd", "sd_hreflang_count", "sd_html_lang", "sd_hreflang_score")
dimension_query("sd_title_alignment", "sd", "sd_og_title", "sd_title", "sd_title_overlap", "sd_alignment_score")
dimension_query(
    "sd_score", "sd", "sd_json_ld_score", "sd_og_score", "sd_twitter_score", "sd_microdata_score",
    "sd_canonical_score", "sd_hreflang_score", "sd_alignment_score", "sd_score",
)

dimension_query("as_bot_score", "as", "as_has_robots", "as_allowed_count", "as_blocked_list", "as_robots_score", "as_bot_score")
dimension_query("as_sitemap_directive", "as", "as_sitemap_lines", "as_directive_score")
dimension_query(
    "as_llms_txt", "as", "as_has_llms", "as_llms_has_h1", "as_llms_sections", "as_llms_links", "as_llms_full_link",
    "as_llms_score", "as_llms_valid_score",
)
dimension_query("as_sitemap_valid", "as", "as_has_sitemap", "as_sitemap_valid", "as_sitemap_score")
dimension_query("as_https", "as", "as_https", "as_https_score")
dimension_query(
    "as_score", "as", "as_robots_score", "as_bot_score", "as_directive_score", "as_llms_score", "as_llms_valid_score",
    "as_sitemap_score", "as_https_score", "as_blocked_list", "as_score",
)

dimension_query("ac_input_labels", "ac", "ac_inputs", "ac_labeled", "ac_label_ratio", "ac_label_score")
dimension_query("ac_input_names", "ac", "ac_inputs", "ac_with_name", "ac_name_ratio", "ac_name_score")
dimension_query("ac_autocomplete", "ac", "ac_inputs", "ac_with_autocomplete", "ac_autocomplete_ratio", "ac_autocomplete_score")
dimension_query("ac_submit_text", "ac", "ac_submits", "ac_good_submits", "ac_submit_score")
dimension_query("ac_clickable", "ac", "ac_real_buttons", "ac_clickable_divs", "ac_button_score")
dimension_query("ac_link_text", "ac", "ac_text_count", "ac_weak_texts", "ac_text_score")
dimension_query("ac_stable_selectors", "ac", "ac_sample", "ac_stability_ratio", "ac_stability_score")
dimension_query("ac_image_alt", "ac", "ac_images", "ac_with_alt", "ac_alt_ratio", "ac_alt_score")
dimension_query("ac_skip_link", "ac", "ac_has_skip_link", "ac_skip_score")
dimension_query("ac_readable_url", "ac", "ac_url_readable", "ac_url_score")
dimension_query(
    "ac_score", "ac", "ac_label_score", "ac_name_score", "ac_autocomplete_score", "ac_submit_score", "ac_button_score",
    "ac_text_score", "ac_stability_score", "ac_alt_score", "ac_skip_score", "ac_url_score", "ac_score",
)

dimension_query("pf_cookie_banner", "pf", "pf_banners", "pf_banner_score")
dimension_query(
    "pf_score", "pf", "pf_ttfb_score", "pf_page_score", "pf_request_score", "pf_dcl_score", "pf_banner_score", "pf_score"
)

dimension_query("cc_title", "cc", "cc_title", "cc_title_length", "cc_title_score")
dimension_query("cc_meta_description", "cc", "cc_meta", "cc_meta_length", "cc_meta_score")
dimension_query("cc_h1_alignment", "cc", "cc_h1", "cc_h1_overlap", "cc_h1_score")
dimension_query("cc_main_content", "cc", "cc_main_source", "cc_main_text")
dimension_query("cc_readability", "cc", "cc_flesch_words", "cc_sentences", "cc_flesch", "cc_readability_score")
dimension_query("cc_boilerplate", "cc", "cc_boilerplate_chars", "cc_visible_chars", "cc_boilerplate_ratio", "cc_boilerplate_score")
dimension_query("cc_word_count", "cc", "cc_word_count", "cc_word_score")
dimension_query(
    "cc_score", "cc", "cc_title_score", "cc_meta_score", "cc_h1_score", "cc_readability_score",
    "cc_boilerplate_score", "cc_word_score", "cc_score",
)


def timing_query(name: str, *columns: str):
    @query(name, f"select page_id, {', '.join(map(_sql_column, columns))} from pff")
    def run(t):
        return performance.timing_features(t.captures().select("page_id", "perf")).select("page_id", *map(_spark_column, columns))


timing_query("pf_ttfb", "pf_ttfb", "pf_ttfb_score")
timing_query("pf_page_weight", "pf_page_size", "pf_page_score")
timing_query("pf_requests", "pf_requests", "pf_request_score")
timing_query("pf_dcl", "pf_dcl", "pf_dcl_score")


@query("pf_network_idle", "select page_id, network_idle as pf_network_idle, network_idle > 10000 as slow from caps")
def pf_network_idle(t):
    rows = performance.timing_features(t.captures().select("page_id", "perf"))
    return rows.select("page_id", "pf_network_idle", (F.col("pf_network_idle") > 10_000).alias("slow"))


@query(
    "sd_json_ld_blocks",
    """select l.page_id, l.raw, l.valid, array_to_string(list_sort(l.types), '|') as types, coalesce(c.has_context, false) as has_context
       from ld l left join ldctx c on c.page_id = l.page_id and c.pos = l.pos""",
)
def sd_json_ld_blocks(t):
    blocks = structured_data.json_ld_blocks(structure.page_documents(t.captures()))
    rows = blocks.select("page_id", F.inline("sd_blocks"))
    return rows.withColumn("types", F.array_join(F.array_sort("types"), "|"))


@query("sd_json_ld_types", "select page_id, type_name, count(*) as n from (select page_id, unnest(types) as type_name from ld) group by page_id, type_name")
def sd_json_ld_types(t):
    blocks = structured_data.json_ld_blocks(structure.page_documents(t.captures()))
    types = F.flatten(F.transform("sd_blocks", lambda b: b["types"]))
    return blocks.select("page_id", F.explode(types).alias("type_name")).groupBy("page_id", "type_name").agg(F.count("*").alias("n"))


@query(
    "sd_json_ld_context",
    """select l.page_id, count(*) filter (valid) as valid_blocks, count(*) filter (coalesce(c.has_context, false)) as with_context
       from ld l left join ldctx c on c.page_id = l.page_id and c.pos = l.pos group by l.page_id""",
)
def sd_json_ld_context(t):
    blocks = structured_data.json_ld_blocks(structure.page_documents(t.captures())).where(F.size("sd_blocks") > 0)
    count = lambda f: F.size(F.filter("sd_blocks", lambda b: b[f])).cast("bigint")
    return blocks.select("page_id", count("valid").alias("valid_blocks"), count("has_context").alias("with_context"))


@query(
    "as_robots_rules",
    """select r.origin, cast(r.line as int) as line, cast(r.block as int) as block, r.directive, r.value,
        case when r.directive = 'sitemap' then '' else a.agents end as user_agents
       from rob r left join (select origin, block, string_agg(value, '|' order by line) as agents from rob where directive = 'user-agent' group by origin, block) a
         on a.origin = r.origin and a.block = r.block
       where r.directive = 'sitemap' or (r.directive in ('allow', 'disallow') and r.block > 0)""",
)
def as_robots_rules(t):
    rules = agent_signals.robots_rules(agent_signals.site_table(t.site_files()))
    return rules.withColumn("user_agents", F.coalesce("user_agents", F.lit("")))


@query("as_bot_access", "select origin, bot, allowed from botacc")
def as_bot_access(t):
    sites = agent_signals.site_features(t.site_files()).where("as_has_robots")
    bots = F.array(*[F.lit(b) for b in C.AI_BOTS])
    return sites.select("origin", "as_allowed", F.explode(bots).alias("bot")).select(
        "origin", "bot", F.array_contains("as_allowed", F.col("bot")).alias("allowed")
    )


@query(
    "ac_inputs",
    "select i.page_id, cast(i.pos as int) as pos, e.tag, labelled, named, auto as autocompletes from inp i join els e on e.page_id = i.page_id and e.pos = i.pos",
)
def ac_inputs(t):
    from pagegauge.functions import html as H
    from pagegauge.operators import actionability as A

    rows = grading.page_features(t.captures(), "ac").select("page_id", F.explode("ac_input_els").alias("e"))
    attrs = F.col("e.attrs")
    return rows.select(
        "page_id", "e.pos", "e.tag", A.is_labelled(F.col("e")).alias("labelled"),
        (H.present(H.attr(attrs, "name")) & H.present(H.attr(attrs, "id"))).alias("named"),
        H.present(H.attr(attrs, "autocomplete")).alias("autocompletes"),
    )


flesch_ctes("documents", "doc_id", "text", "doc")


@query(
    "cc_flesch",
    "select doc_id, cast(words as int) as words, cast(sentences as int) as sentences, cast(syl as int) as syllables, round(flesch, 9) as flesch from docflesch",
)
def cc_flesch(t):
    from pagegauge.functions import text as T

    counted = t.read("documents").withColumn("w", T.words(F.col("text"))).select(
        "doc_id", F.size("w").alias("words"), T.sentence_total(F.col("text")).alias("sentences"),
        T.syllable_total(F.col("w")).alias("syllables"),
    )
    ease = T.flesch_from_counts(F.col("words"), F.col("sentences"), F.col("syllables"))
    return counted.withColumn("flesch", F.round(ease, 9))
