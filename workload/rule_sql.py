"""When each finding fires and how severe it is, written down once more for the expected results."""

from __future__ import annotations

# id: (severity, condition) over the feature blocks. Severities that depend on a value are SQL.
RULES: dict[str, tuple[str, str]] = {
    "MR_MODERATE_JS_DEPENDENCE": ("medium", "0.3e0 <= mr_raw_coverage and mr_raw_coverage < 0.6e0"),
    "MR_HIGH_JS_DEPENDENCE": ("high", "not (mr_raw_coverage >= 0.3e0)"),
    "MR_NO_SEMANTIC_TAGS": ("high", "not (mr_semantic_total > 0)"),
    "MR_LOW_SEMANTIC_RATIO": ("medium", "0 < mr_semantic_total and mr_semantic_ratio < 0.05e0"),
    "MR_CLICKABLE_DIVS": ("medium", "mr_clickable_divs >= 1 and 4 * mr_clickable_divs > mr_real_buttons"),
    "MR_MISSING_H1": ("medium", "mr_h1_count < 1"),
    "MR_MULTIPLE_H1": ("low", "mr_h1_count >= 2"),
    "MR_HEADING_SKIP": ("low", "coalesce(mr_heading_skip, false)"),
    "MR_NO_LANDMARKS": ("medium", "mr_landmarks < 1"),
    "MR_CONTENT_IN_IFRAME": ("medium", "not (mr_iframe_ratio < 0.2e0)"),
    "SD_MISSING_JSON_LD": ("medium", "sd_block_count < 1"),
    "SD_INVALID_JSON_LD": ("high", "sd_block_count - sd_valid_count >= 1"),
    "SD_JSON_LD_NO_CONTEXT": ("medium", "sd_valid_count >= 1 and sd_context_count < 1"),
    "SD_JSON_LD_NO_TYPE": ("medium", "sd_valid_count >= 1 and sd_type_count < 1"),
    "SD_UNKNOWN_SCHEMA_TYPE": ("low", "sd_valid_count >= 1 and sd_type_count >= 1 and sd_known_type is distinct from true"),
    "SD_MISSING_OG_TAGS": ("medium", "sd_og_count < 1"),
    "SD_PARTIAL_OG_TAGS": ("low", "sd_og_count in (1, 2, 3, 4)"),
    "SD_MISSING_TWITTER_CARD": ("info", "sd_twitter_score < 1"),
    "SD_NO_MICRODATA": ("info", "sd_microdata_count < 1"),
    "SD_MISSING_CANONICAL": ("medium", "sd_canonical_score < 1"),
    "SD_NO_HREFLANG": ("low", "sd_hreflang_score in (5)"),
    "SD_CONTENT_SCHEMA_MISMATCH": ("low", "sd_type_count >= 1 and length(sd_og_title) > 0 and length(sd_title) > 0 and sd_title_overlap < 0.2e0"),
    "AS_ROBOTS_BLOCKS_AI": ("high", "as_has_robots and as_allowed_count < 1"),
    "AS_ROBOTS_PARTIAL_AI": ("medium", "as_has_robots and as_allowed_count > 0 and as_allowed_count < 8"),
    "AS_ROBOTS_NO_SITEMAP": ("low", "as_has_robots and as_sitemap_lines < 1"),
    "AS_NO_ROBOTS_TXT": ("medium", "as_has_robots = false"),
    "AS_LLMS_TXT_INVALID": ("low", "as_has_llms and (as_llms_has_h1 = false or as_llms_sections < 1)"),
    "AS_NO_LLMS_FULL": ("info", "as_has_llms and as_llms_full_link = false"),
    "AS_NO_LLMS_TXT": ("medium", "as_has_llms = false"),
    "AS_INVALID_SITEMAP": ("medium", "as_has_sitemap and as_sitemap_valid = false"),
    "AS_NO_SITEMAP": ("low", "as_has_sitemap = false"),
    "AS_NOT_HTTPS": ("high", "as_https = false"),
    "AC_INPUTS_MISSING_LABEL": ("if(ac_label_ratio < 0.5e0, 'high', 'medium')", "ac_inputs >= 1 and ac_label_ratio < 0.9e0"),
    "AC_INPUTS_MISSING_NAME": ("medium", "ac_inputs >= 1 and ac_name_ratio < 0.9e0"),
    "AC_INPUTS_NO_AUTOCOMPLETE": ("low", "ac_inputs > 2 and ac_autocomplete_ratio < 0.3e0"),
    "AC_WEAK_SUBMIT_TEXT": ("low", "ac_submits - ac_good_submits >= 1"),
    "AC_CLICKABLE_DIV_INSTEAD_OF_BUTTON": ("medium", "ac_clickable_divs >= 2 and 5 * ac_clickable_divs > ac_real_buttons"),
    "AC_WEAK_LINK_TEXT": ("low", "ac_weak_texts >= 3"),
    "AC_UNSTABLE_SELECTORS": ("medium", "ac_sample > 4 and ac_stability_ratio < 0.4e0"),
    "AC_IMAGES_MISSING_ALT": ("medium", "ac_images >= 1 and ac_alt_ratio < 0.9e0"),
    "AC_NO_SKIP_LINK": ("info", "ac_has_skip_link = false"),
    "AC_NON_READABLE_URL": ("low", "ac_url_readable = false"),
    "PF_SLOW_TTFB": ("if(pf_ttfb > 1200, 'high', 'medium')", "not (pf_ttfb <= 600)"),
    "PF_HEAVY_PAGE": ("if(pf_page_size > 4000000, 'high', 'medium')", "not (pf_page_size <= 2000000)"),
    "PF_TOO_MANY_REQUESTS": ("if(pf_requests > 120, 'medium', 'low')", "pf_requests >= 81"),
    "PF_SLOW_DCL": ("if(pf_dcl > 5000, 'medium', 'low')", "not (pf_dcl <= 3000)"),
    "PF_SLOW_NETWORK_IDLE": ("low", "not (pf_network_idle <= 10000)"),
    "PF_COOKIE_BANNER_BLOCKING": ("if(pf_banners >= 2, 'high', 'medium')", "pf_banners > 0"),
    "CC_TITLE_MISSING": ("high", "cc_title_length < 1"),
    "CC_TITLE_TOO_SHORT": ("medium", "cc_title_length > 0 and cc_title_length < 10"),
    "CC_TITLE_TOO_LONG": ("low", "cc_title_length >= 71"),
    "CC_META_DESC_MISSING": ("medium", "cc_meta_length < 1"),
    "CC_META_DESC_TOO_SHORT": ("low", "cc_meta_length > 0 and cc_meta_length < 50"),
    "CC_META_DESC_TOO_LONG": ("low", "cc_meta_length >= 161"),
    "CC_H1_MISSING": ("medium", "length(cc_h1) < 1"),
    "CC_H1_TITLE_MISMATCH": ("low", "length(cc_h1) > 0 and cc_title_length > 0 and cc_h1_overlap < 0.2e0"),
    "CC_LOW_READABILITY": ("low", "cc_flesch > 0 and cc_flesch < 30"),
    "CC_HIGH_BOILERPLATE": ("medium", "not (cc_boilerplate_ratio < 0.6e0)"),
    "CC_THIN_CONTENT": ("if(cc_word_count < 30, 'medium', 'low')", "cc_word_count <= 99"),
}


def severity(rule: str) -> str:
    given = RULES[rule][0]
    return given if given.startswith("if(") else f"'{given}'"
