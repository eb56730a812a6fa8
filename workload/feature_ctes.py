"""DuckDB feature tables of the six dimensions, one row per page, named as in the library."""

from __future__ import annotations

from pagegauge import constants as C
from workload.rule_sql import RULES, severity
from workload.ctes import CTES, WS, collapse, inlist, jaccard, linear_sql, lit, round_half, snip, trim, url_columns

_SEM = inlist(C.SEMANTIC_TAGS)
_REAL = "(tag = 'button' or (tag = 'a' and a_href is not null) or (tag = 'input' and lower(a_type) in ('submit', 'button')))"
_FAKE = "(tag in ('div', 'span') and (a_onclick is not null or a_role = 'button'))"


def score(name: str, total: str) -> str:
    return f"least(100, greatest(0, {total})) as {name}"


# -- machine readability ------------------------------------------------------------------------
CTES["cover"] = """select t.page_id, sum(length(t.node)) as rendered_chars,
    coalesce(sum(length(t.node)) filter (r.node is not null), 0) as covered_chars,
    list(t.node order by t.pos) filter (r.node is null) as js_only
  from txt t left join (select distinct page_id, node from raw_txt where node is not null) r
    on r.page_id = t.page_id and r.node = t.node
  where t.node is not null group by t.page_id"""
CTES["rawchars"] = "select page_id, sum(length(node)) as raw_chars from raw_txt where node is not null group by page_id"
CTES["headings"] = """select page_id, string_agg(lvl, '→' order by pos) as path, bool_or(lvl::int - prev > 1) as skip,
    count(*) filter (lvl = '1') as h1 from (select page_id, pos, substr(tag, 2, 1) as lvl,
      lag(cast(substr(tag, 2, 1) as int)) over (partition by page_id order by pos) as prev
      from els where tag in ('h1', 'h2', 'h3', 'h4', 'h5', 'h6')) group by page_id"""
CTES["elcount"] = (
    "select page_id, count(*) filter (tag = 'div') as n_div, "
    + ", ".join(f"count(*) filter (tag = '{t}') as n_{t}" for t in C.SEMANTIC_TAGS)
    + f""", count(*) filter ({_REAL}) as real_buttons, count(*) filter ({_FAKE}) as fake_buttons,
    count(*) filter (tag = 'iframe') as n_iframe, coalesce(sum(length(tok)) filter (tag = 'iframe'), 0) as iframe_chars
    from el group by page_id"""
)
_N = " + ".join(f"coalesce(n_{t}, 0)" for t in C.SEMANTIC_TAGS)
_L = " + ".join(f"(case when n_{t} > 0 then 1 else 0 end)" for t in C.LANDMARK_TAGS)
CTES["mrf0"] = f"""select p.page_id, coalesce(c.rendered_chars, 0) as mr_rendered_chars, coalesce(c.covered_chars, 0) as mr_covered_chars,
    coalesce(r.raw_chars, 0) as mr_raw_chars,
    case when coalesce(c.rendered_chars, 0) = 0 then 1e0 else cast(c.covered_chars as double) / c.rendered_chars end as mr_raw_coverage,
    coalesce(c.js_only, [])[1:20] as mr_js_only, {snip("array_to_string(coalesce(c.js_only, [])[1:3], ' | ')")} as mr_js_only_sample,
    {_N} as mr_semantic_total, n_div, {_L} as mr_landmarks, real_buttons as mr_real_buttons, fake_buttons as mr_clickable_divs,
    coalesce(h.h1, 0) as mr_h1_count, coalesce(h.skip, false) as mr_heading_skip, coalesce(h.path, '') as mr_heading_path,
    n_iframe as mr_iframe_count, iframe_chars as mr_iframe_chars,
    cast(iframe_chars as double) / greatest(1, length(p.rendered_html)) as mr_iframe_ratio
  from caps p left join cover c using (page_id) left join rawchars r using (page_id)
    left join elcount using (page_id) left join headings h using (page_id)"""
CTES["mrf"] = f"""select *, {score('mr_score', 'mr_raw_score + mr_semantic_score + mr_button_score + mr_heading_score + mr_landmark_score + mr_iframe_score')} from (
  select *, case when mr_semantic_total = 0 then 0e0 else cast(mr_semantic_total as double) / (mr_semantic_total + n_div) end as mr_semantic_ratio,
    case when mr_raw_coverage >= 9e-1 then 25 when mr_raw_coverage >= 6e-1 then 18 when mr_raw_coverage >= 3e-1 then 10 else 0 end as mr_raw_score,
    case when mr_semantic_total = 0 then 0 when cast(mr_semantic_total as double) / (mr_semantic_total + n_div) < 5e-2 then 8
         when cast(mr_semantic_total as double) / (mr_semantic_total + n_div) < 15e-2 then 14 else 20 end as mr_semantic_score,
    case when mr_clickable_divs = 0 then 15 when mr_clickable_divs <= mr_real_buttons / 4e0 then 10 else 0 end as mr_button_score,
    greatest(0, 15 - (case when mr_h1_count = 0 then 10 when mr_h1_count > 1 then 5 else 0 end) - (case when mr_heading_skip then 5 else 0 end)) as mr_heading_score,
    case when mr_landmarks = 0 then 0 when mr_landmarks < 2 then 5 else 10 end as mr_landmark_score,
    case when mr_iframe_ratio < 5e-2 then 15 when mr_iframe_ratio < 2e-1 then 8 else 0 end as mr_iframe_score
  from mrf0)"""

# -- structured data ----------------------------------------------------------------------------
# The parser here tolerates a comma before a closing bracket, which JSON does not allow.
_VALID = "(json_valid(t.txt) and not regexp_matches(t.txt, ',\\s*[}\\]]'))"
CTES["ld"] = f"""select e.page_id, e.pos, t.txt as raw, {_VALID} as valid,
    coalesce((select list(json_extract_string(value, '$') order by id) from json_tree(case when {_VALID} then t.txt else 'null' end)
      where type = 'VARCHAR' and (key = '@type' or ends_with(path, '"@type"'))), []) as types
  from el e join txt t on t.page_id = e.page_id and t.pos = e.pos
  where e.tag = 'script' and lower(e.a_type) = 'application/ld+json' and {trim('t.txt')} <> ''"""
CTES["ldctx"] = """select page_id, pos, coalesce((select bool_or(type = 'VARCHAR') from json_tree(case when valid then raw else 'null' end)
    where regexp_matches(fullkey, '^\\$(\\[[0-9]+\\])*[.]"@context"(\\[[0-9]+\\])?$')), false) as has_context from ld"""
CTES["ldpage"] = """select l.page_id, count(*) as blocks, count(*) filter (valid) as valid_blocks,
    count(*) filter (coalesce(c.has_context, false)) as ctx, flatten(list(types order by l.pos)) as types,
    min_by(raw, l.pos) filter (not valid) as first_invalid
  from ld l left join ldctx c on c.page_id = l.page_id and c.pos = l.pos group by l.page_id"""
CTES["og"] = """select page_id, a_property as property, max_by(a_content, pos) as content from el
  where tag = 'meta' and starts_with(a_property, 'og:') and a_content <> '' group by page_id, a_property"""
_OGREQ = inlist(C.REQUIRED_OG)
CTES["ogpage"] = f"select page_id, count(*) filter (property in {_OGREQ}) as n, max(content) filter (property = 'og:title') as og_title, list(property) as props from og group by page_id"
CTES["head1"] = f"""select page_id, min_by(coalesce(a_content, chr(1)), pos) filter (tag = 'meta' and a_name = 'twitter:card') as tw,
    min_by(coalesce(a_href, ''), pos) filter (tag = 'link' and lower(a_rel) = 'canonical') as canonical,
    count(*) filter (tag = 'link' and lower(a_rel) = 'alternate' and a_hreflang is not null) as hreflang,
    count(*) filter (a_itemscope is not null) as micro,
    min_by(coalesce(a_lang, ''), pos) filter (tag = 'html') as lang,
    min_by(coalesce(a_content, ''), pos) filter (tag = 'meta' and a_name = 'description') as description from el group by page_id"""
CTES["titles"] = f"""select page_id, {trim("min_by(txt, pos) filter (tag = 'title')")} as title, {trim("min_by(txt, pos) filter (tag = 'h1')")} as h1 from eltext group by page_id"""
CTES["sdf0"] = f"""select p.page_id, coalesce(l.blocks, 0) as sd_block_count, coalesce(l.valid_blocks, 0) as sd_valid_count, coalesce(l.ctx, 0) as sd_context_count,
    coalesce(l.types, []) as sd_types, coalesce(len(l.types), 0) as sd_type_count, coalesce(list_has_any(l.types, [{", ".join(lit(t) for t in C.KNOWN_SCHEMA_TYPES)}]), false) as sd_known_type,
    coalesce(array_to_string(l.types, ', '), '') as sd_type_list, {snip('l.first_invalid')} as sd_first_invalid,
    coalesce(o.n, 0) as sd_og_count, coalesce(o.og_title, '') as sd_og_title,
    array_to_string(list_filter([{", ".join(lit(t) for t in C.REQUIRED_OG)}], lambda x: not list_contains(coalesce(o.props, []), x)), ', ') as sd_og_missing_list,
    nullif(h.tw, chr(1)) as sd_twitter_card, h.micro as sd_microdata_count, h.canonical as sd_canonical, h.hreflang as sd_hreflang_count, h.lang as sd_html_lang,
    coalesce(t.title, '') as sd_title
  from caps p left join ldpage l using (page_id) left join ogpage o using (page_id) left join head1 h using (page_id) left join titles t using (page_id)"""
_ALIGNED = "sd_type_count > 0 and sd_og_title <> '' and sd_title <> ''"
CTES["sdf1"] = f"""select *, case when sd_og_title <> '' and sd_title <> '' then {jaccard('sd_og_title', 'sd_title', '1e0', '0e0')} end as sd_title_overlap,
    {snip('sd_og_title', 60)} as sd_og_title_short, {snip('sd_title', 60)} as sd_title_short from sdf0"""
CTES["sdf"] = f"""select *, {score('sd_score', 'sd_json_ld_score + sd_og_score + sd_twitter_score + sd_microdata_score + sd_canonical_score + sd_hreflang_score + sd_alignment_score')} from (
  select *, case when sd_valid_count = 0 then 0 else 10 + (case when sd_context_count > 0 then 5 else 0 end)
      + (case when sd_type_count > 0 then 5 else 0 end) + (case when sd_known_type then 10 else 0 end) end as sd_json_ld_score,
    4 * sd_og_count as sd_og_score, case when sd_twitter_card <> '' then 5 else 0 end as sd_twitter_score,
    case when sd_microdata_count > 0 then 5 else 0 end as sd_microdata_score, case when sd_canonical <> '' then 10 else 0 end as sd_canonical_score,
    case when sd_hreflang_count > 0 then 10 when sd_html_lang <> '' then 8 else 5 end as sd_hreflang_score,
    case when sd_type_count = 0 then 0 when {_ALIGNED} then (case when sd_title_overlap >= 4e-1 then 20 else 10 end)
         when sd_og_title <> '' or sd_title <> '' then 10 else 0 end as sd_alignment_score
  from sdf1)"""

# -- URL readability ------------------------------------------------------------------------------
CTES["capurl"] = f"select page_id, final_url, {url_columns('final_url')} from caps"
READABLE = """case when u_scheme = '' then false when length(u_path) <= 1 then true
    when regexp_matches(u_path, '[A-Z]') then false
    when regexp_matches(u_query, '(?i)[?&](sid|sessionid|jsessionid|phpsessid)=') then false
    else len(list_filter(string_split(u_path, '/'), lambda s: length(s) > 40 or regexp_matches(s, '^[a-fA-F0-9]{16,}$')
      or (regexp_matches(s, '^[A-Za-z0-9+/=_-]{32,}$') and not regexp_matches(s, '[a-z]-[a-z]')))) = 0 end"""

# -- actionability --------------------------------------------------------------------------------
_WEAK = inlist(C.WEAK_TEXTS)
_HASH = lit("^(?:[-_0-9a-z]*[a-zA-Z]+_[0-9a-zA-Z]{4,}|css-[0-9a-z]{5,}|[a-z]{2,4}-[0-9a-z]{6,})$")
CTES["inp"] = f"""select e.page_id, e.pos,
    (e.a_id <> '' and exists (select 1 from el l where l.page_id = e.page_id and l.tag = 'label' and l.a_for = e.a_id))
     or coalesce({trim('e.a_aria_label')} <> '', false) or coalesce({trim('e.a_aria_labelledby')} <> '', false)
     or exists (select 1 from el l where l.page_id = e.page_id and l.tag = 'label' and l.pos < e.pos and e.pos < l.upto) as labelled,
    coalesce(e.a_name <> '' and e.a_id <> '', false) as named, coalesce(e.a_autocomplete <> '', false) as auto
  from el e where e.tag in ('textarea', 'select') or (e.tag = 'input' and coalesce(lower(e.a_type), '') not in ('hidden', 'submit', 'button'))"""
CTES["inppage"] = "select page_id, count(*) as n, count(*) filter (labelled) as lab, count(*) filter (named) as nam, count(*) filter (auto) as aut from inp group by page_id"
CTES["btn"] = f"""select e.page_id, e.pos, e.tag, e.a_type, e.a_href, lower({trim('t.txt')}) as txt,
    lower({trim("case when t.txt = '' then coalesce(e.a_aria_label, '') else t.txt end")}) as shown, lower({trim("coalesce(e.a_value, '')")}) as val
  from el e join eltext t on t.page_id = e.page_id and t.pos = e.pos where e.tag in ('button', 'a', 'input')"""
CTES["btnpage"] = f"""select page_id,
    count(*) filter ((tag = 'button' and (a_type is null or lower(a_type) = 'submit')) or (tag = 'input' and lower(a_type) = 'submit')) as submits,
    count(*) filter ((tag = 'button' and (a_type is null or lower(a_type) = 'submit') and length(txt) >= 4 and txt not in {_WEAK})
      or (tag = 'input' and lower(a_type) = 'submit' and length(val) >= 4 and val not in {_WEAK})) as good,
    count(*) filter ((tag = 'button' or (tag = 'a' and a_href is not null)) and shown <> '') as texts,
    count(*) filter ((tag = 'button' or (tag = 'a' and a_href is not null)) and shown <> '' and (shown in {_WEAK} or length(shown) < 3)) as weak,
    coalesce(bool_or(tag = 'a' and starts_with(a_href, '#') and contains(txt, 'skip') and regexp_matches(txt, 'content|main|nav')), false) as skip
  from btn group by page_id"""
CTES["inter"] = f"""select page_id, row_number() over (partition by page_id order by pos) - 1 as i, count(*) over (partition by page_id) as n,
    case when (a_id <> '' and not regexp_matches(a_id, {_HASH})) or has_data then 1e0
         when a_class <> '' and len(list_filter(regexp_split_to_array(a_class, '{WS}+'), lambda c: not regexp_matches(c, {_HASH}))) > 0 then 5e-1 else 0e0 end as points
  from el where tag in ('button', 'input', 'select', 'textarea') or (tag = 'a' and a_href is not null) or a_role = 'button'"""
CTES["stab"] = """select page_id, least(20, max(n)) as s, sum(points * hits) as points from (
      select x.*, (select count(*) from range(0, 20) r(j) where j < least(20, x.n) and floor(j * (cast(x.n as double) / least(20, x.n))) = x.i) as hits from inter x) group by page_id"""
CTES["acf0"] = f"""select p.page_id, p.final_url, coalesce(i.n, 0) as ac_inputs, coalesce(i.lab, 0) as ac_labeled, coalesce(i.nam, 0) as ac_with_name, coalesce(i.aut, 0) as ac_with_autocomplete,
    coalesce(b.submits, 0) as ac_submits, coalesce(b.good, 0) as ac_good_submits, coalesce(b.texts, 0) as ac_text_count, coalesce(b.weak, 0) as ac_weak_texts, coalesce(b.skip, false) as ac_has_skip_link,
    c.real_buttons as ac_real_buttons, c.fake_buttons as ac_clickable_divs, coalesce(s.s, 0) as ac_sample, coalesce(s.points, 0e0) as ac_stable_points,
    coalesce(m.n, 0) as ac_images, coalesce(m.alt, 0) as ac_with_alt, u.ok as ac_url_readable, {snip('p.final_url', 120)} as ac_url_short
  from caps p left join inppage i using (page_id) left join btnpage b using (page_id) left join elcount c using (page_id) left join stab s using (page_id)
    left join (select page_id, count(*) as n, count(a_alt) as alt from el where tag = 'img' group by page_id) m using (page_id)
    left join (select page_id, {READABLE} as ok from capurl) u using (page_id)"""


def _share(ratio: str, points: int) -> str:
    return f"coalesce(cast(floor(({ratio}) * {points} + 5e-1) as int), {points})"


def _ratio(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif({b}, 0))"


CTES["acf"] = f"""select *, {score('ac_score', 'ac_label_score + ac_name_score + ac_autocomplete_score + ac_submit_score + ac_button_score + ac_text_score + ac_stability_score + ac_alt_score + ac_skip_score + ac_url_score')} from (
  select *, {_ratio('ac_labeled', 'ac_inputs')} as ac_label_ratio, {_ratio('ac_with_name', 'ac_inputs')} as ac_name_ratio,
    {_ratio('ac_with_autocomplete', 'ac_inputs')} as ac_autocomplete_ratio, coalesce({_ratio('ac_with_alt', 'ac_images')}, 1e0) as ac_alt_ratio,
    coalesce({_ratio('ac_stable_points', 'ac_sample')}, 1e0) as ac_stability_ratio,
    {_share(_ratio('ac_labeled', 'ac_inputs'), 20)} as ac_label_score, {_share(_ratio('ac_with_name', 'ac_inputs'), 10)} as ac_name_score,
    {_share(_ratio('ac_with_autocomplete', 'ac_inputs'), 5)} as ac_autocomplete_score, {_share(_ratio('ac_good_submits', 'ac_submits'), 10)} as ac_submit_score,
    case when ac_clickable_divs = 0 then 15 when ac_clickable_divs <= greatest(1e0, ac_real_buttons / 5e0) then 10 else 0 end as ac_button_score,
    {_share(_ratio('ac_text_count - ac_weak_texts', 'ac_text_count'), 10)} as ac_text_score, {_share(_ratio('ac_stable_points', 'ac_sample'), 10)} as ac_stability_score,
    {_share(_ratio('ac_with_alt', 'ac_images'), 10)} as ac_alt_score, case when ac_has_skip_link then 5 else 0 end as ac_skip_score,
    case when ac_url_readable then 5 else 0 end as ac_url_score from acf0)"""

# -- performance ------------------------------------------------------------------------------------


CTES["banner"] = r"""select e.page_id, count(*) as n from el e join eltext t on t.page_id = e.page_id and t.pos = e.pos
  where (t.kw or regexp_matches(concat(lower(coalesce(a_id, '')), ' ', lower(coalesce(a_class, ''))), 'cookie|consent|gdpr|privacy'))
    and (try_cast(regexp_extract(lower(a_style), 'z-index\s*:\s*([0-9]+)', 1) as hugeint) > 1000
      or regexp_matches(lower(coalesce(a_style, '')), 'position\s*:\s*(fixed|sticky)') or lower(coalesce(a_role, '')) = 'dialog' or a_aria_modal = 'true')
  group by e.page_id"""
CTES["pff"] = f"""select *, {score('pf_score', 'pf_ttfb_score + pf_page_score + pf_request_score + pf_dcl_score + pf_banner_score')} from (
  select p.page_id, ttfb as pf_ttfb, page_size as pf_page_size, num_requests as pf_requests, dom_content_loaded as pf_dcl, network_idle as pf_network_idle, coalesce(b.n, 0) as pf_banners,
    {linear_sql('ttfb', 200, 1500, 30)} as pf_ttfb_score, {linear_sql('page_size', 500000, 5000000, 25)} as pf_page_score, {linear_sql('num_requests', 30, 150, 20)} as pf_request_score,
    {linear_sql('dom_content_loaded', 1500, 6000, 15)} as pf_dcl_score, case when coalesce(b.n, 0) = 0 then 10 when b.n = 1 then 5 else 0 end as pf_banner_score
  from caps p left join banner b using (page_id))"""

# -- content clarity --------------------------------------------------------------------------------
CTES["mark"] = """select k.page_id, k.pos, max(case when k.kind = 'open' and k.tag = 'body' then 2 when k.kind = 'close' and k.tag = 'head' then 1 else 0 end) over (partition by k.page_id order by k.pos) as mark,
    w.under_boiler as boiler from tok k join tree w on w.page_id = k.page_id and w.pos = k.pos"""
CTES["bodytext"] = """select t.page_id, coalesce(string_agg(t.txt, '' order by t.pos) filter (m.mark = k.top and not m.boiler and t.kind not in ('script', 'style')
      and coalesce(t.tag, '') <> 'noscript' and not t.in_template and not (k.top = 0 and coalesce(t.tag, '') = 'title')), '') as txt
  from txt t join mark m on m.page_id = t.page_id and m.pos = t.pos join (select page_id, max(mark) as top from mark group by page_id) k on k.page_id = t.page_id group by t.page_id"""
CTES["mainsec"] = f"""select page_id, min_by(main_txt, pos) filter (tag = 'main') as m, min_by(main_txt, pos) filter (tag = 'article') as a,
    first(main_txt order by length({trim('txt')}) desc, pos) filter (tag = 'section') as s, max(length({trim('txt')})) filter (tag = 'section') as slen,
    coalesce(sum(length({trim('txt')})) filter (tag in {inlist(C.BOILERPLATE_TAGS)}), 0) as boiler from eltext group by page_id"""
CTES["main"] = f"""select page_id, case when m is not null then 'main' when a is not null then 'article' when slen > 200 then 'section' else 'body-minus-boilerplate' end as source,
    {collapse("case when m is not null then m when a is not null then a when slen > 200 then s else b.txt end")} as txt, boiler from mainsec left join bodytext b using (page_id)"""
_LETTERS = "regexp_replace(lower(w), '[^a-zà-ÿ]', '', 'g')"
# Endings that are not spoken, a first y, groups of vowels: the reading-ease rules once more.
_SPOKEN = f"regexp_replace(regexp_replace({_LETTERS}, '(?:ed|[^aeiouyl]e|[^aeiouyl]es)$', ''), '^y', '')"
_VOWEL_GROUP = "[à-ÿaeiouy]+"
_WORD = "[À-ÿA-Za-z]+(?:''[À-ÿA-Za-z]+)*"


# A terminator, then any white space of a browser or the end.
_STOP = r"[.!?]+(?:[\x09-\x0D\x20\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]|\z)"


def flesch_ctes(source: str, key: str, txt: str, name: str) -> None:
    CTES[f"{name}words"] = f"select {key}, unnest(regexp_extract_all({txt}, '{_WORD}')) as w from {source}"
    CTES[f"{name}syl"] = f"""select {key}, count(*) as words, sum(case when length({_LETTERS}) = 0 then 0 when length({_LETTERS}) <= 3 then 1
        else greatest(1, len(regexp_extract_all({_SPOKEN}, '{_VOWEL_GROUP}'))) end) as syl from {name}words group by {key}"""
    CTES[f"{name}flesch"] = f"""select *, case when words < 30 then 0e0 else greatest(0e0, least(100e0,
        206.835e0 - 1.015e0 * (cast(words as double) / sentences) - 84.6e0 * (cast(syl as double) / words))) end as flesch from (
      select s.{key}, coalesce(y.words, 0) as words, coalesce(y.syl, 0) as syl, greatest(1, len(regexp_extract_all(s.{txt}, '{_STOP}'))) as sentences
      from {source} s left join {name}syl y using ({key}))"""


flesch_ctes("main", "page_id", "txt", "main")
CTES["vis"] = f"select page_id, {collapse(chr(10).join(['string_agg(node, chr(32) order by pos)']))} as txt from txt where node is not null group by page_id"
CTES["ccf0"] = f"""select p.page_id, coalesce(t.title, '') as cc_title, {trim("coalesce(h.description, '')")} as cc_meta, coalesce(t.h1, '') as cc_h1, m.source as cc_main_source, m.txt as cc_main_text,
    m.boiler as cc_boilerplate_chars, coalesce(length(v.txt), 0) as cc_visible_chars,
    case when coalesce(length(v.txt), 0) = 0 then 0e0 else cast(m.boiler as double) / length(v.txt) end as cc_boilerplate_ratio,
    len(regexp_extract_all(m.txt, '[^ ]+')) as cc_word_count, f.words as cc_flesch_words, f.sentences as cc_sentences, f.syl as cc_syllables, f.flesch as cc_flesch
  from caps p left join titles t using (page_id) left join head1 h using (page_id) left join main m using (page_id) left join vis v using (page_id) left join mainflesch f using (page_id)"""
CTES["ccf1"] = f"""select *, length(cc_title) as cc_title_length, length(cc_meta) as cc_meta_length, {jaccard('cc_h1', 'cc_title', '0e0', '0e0')} as cc_h1_overlap,
    {snip('cc_title', 80)} as cc_title_80, {snip('cc_title', 100)} as cc_title_100, {snip('cc_title', 60)} as cc_title_60, {snip('cc_h1', 60)} as cc_h1_60, {snip('cc_meta', 200)} as cc_meta_200 from ccf0"""
CTES["ccf"] = f"""select *, {score('cc_score', 'cc_title_score + cc_meta_score + cc_h1_score + cc_readability_score + cc_boilerplate_score + cc_word_score')} from (
  select *, case when cc_title_length = 0 then 0 when cc_title_length < 10 then 8 when cc_title_length > 70 then 12 else 20 end as cc_title_score,
    case when cc_meta_length = 0 then 0 when cc_meta_length < 50 then 10 when cc_meta_length > 160 then 14 else 20 end as cc_meta_score,
    case when cc_h1 = '' then 0 when cc_title <> '' and cc_h1_overlap < 2e-1 then 8 else 15 end as cc_h1_score,
    case when cc_flesch = 0 then 8 when cc_flesch < 30 then 5 when cc_flesch < 50 then 10 else 15 end as cc_readability_score,
    case when cc_boilerplate_ratio < 3e-1 then 15 when cc_boilerplate_ratio < 6e-1 then 8 else 0 end as cc_boilerplate_score,
    case when cc_word_count >= 300 then 15 when cc_word_count >= 100 then 8 else 0 end as cc_word_score from ccf1)"""

# -- agent signals ----------------------------------------------------------------------------------
CTES["rob"] = f"""select *, sum(case when directive = 'user-agent' and coalesce(prev, '') <> 'user-agent' then 1 else 0 end) over (partition by origin order by line) as block from (
  select *, lag(directive) over (partition by origin order by line) as prev from (
    select origin, line, lower({trim("split_part(txt, ':', 1)")}) as directive, {trim("substr(txt, strpos(txt, ':') + 1)")} as value from (
      select origin, generate_subscripts(parts, 1) - 1 as line, {trim("regexp_replace(unnest(parts), '#.*', '')")} as txt
      from (select origin, regexp_split_to_array(robots, '\\r?\\n') as parts from sites where robots is not null)) where contains(txt, ':')))"""
CTES["robblock"] = "select origin, block, bool_or(directive = 'disallow' and value = '/') as bars from rob group by origin, block"
CTES["robagent"] = "select r.origin, lower(r.value) as agent, r.value as raw_agent, r.line, b.bars from rob r join robblock b using (origin, block) where r.directive = 'user-agent'"
_BOTS = "(values " + ", ".join(f"({lit(b)}, {i})" for i, b in enumerate(C.AI_BOTS)) + ") b(bot, ord)"
CTES["botacc"] = f"""select s.origin, b.bot, b.ord, not coalesce((select min_by(bars, line) from robagent a where a.origin = s.origin and a.agent = lower(b.bot)),
      (select min_by(bars, line) from robagent a where a.origin = s.origin and a.raw_agent = '*'), false) as allowed
  from sites s, {_BOTS} where {trim("coalesce(s.robots, '')")} <> ''"""
CTES["llmsx"] = f"""select origin, bool_or(regexp_matches(l, '^#{WS}+[^{WS[1:]}')) as h1, count(*) filter (regexp_matches(l, '^##{WS}+[^{WS[1:]}')) as sections,
    sum(len(regexp_extract_all(l, '\\[[^\\]]+\\]\\([^)]+\\)'))) as links,
    bool_or(len(list_filter(regexp_extract_all(l, '\\[[^\\]]+\\]\\([^)]+\\)'), lambda m: regexp_matches(m, '(?i)llms-full\\.txt'))) > 0) as full_link
  from (select origin, unnest(regexp_split_to_array(llms, '\\r?\\n')) as l from sites where {trim("coalesce(llms, '')")} <> '') group by origin"""
CTES["sitef"] = f"""select s.*, {trim("coalesce(robots, '')")} <> '' as as_has_robots, {trim("coalesce(llms, '')")} <> '' as as_has_llms, {trim("coalesce(sitemap, '')")} <> '' as as_has_sitemap,
    coalesce(b.allowed, 0) as as_allowed_count, coalesce(b.blocked, '') as as_blocked_list, coalesce(b.allowed_list, '') as as_allowed_list,
    coalesce((select count(*) from rob r where r.origin = s.origin and r.directive = 'sitemap'), 0) as as_sitemap_lines,
    coalesce(x.h1, false) as as_llms_has_h1, coalesce(x.sections, 0) as as_llms_sections, coalesce(x.links, 0) as as_llms_links, coalesce(x.full_link, false) as as_llms_full_link,
    coalesce(contains(sitemap, '<?xml') and regexp_matches(sitemap, '<(urlset|sitemapindex)[\\s>]'), false) as as_sitemap_valid,
    {snip('llms')} as as_llms_snippet, {snip('sitemap')} as as_sitemap_snippet
  from sites s left join (select origin, count(*) filter (allowed) as allowed, string_agg(bot, ', ' order by ord) filter (not allowed) as blocked,
      string_agg(bot, ', ' order by ord) filter (allowed) as allowed_list from botacc group by origin) b using (origin)
    left join llmsx x using (origin)"""
CTES["asf"] = f"""select *, {score('as_score', 'as_robots_score + as_bot_score + as_directive_score + as_llms_score + as_llms_valid_score + as_sitemap_score + as_https_score')} from (
  select p.page_id, p.final_url, s.*, case when as_has_robots then 10 else 0 end as as_robots_score, {round_half('as_allowed_count / 8e0 * 30')} as as_bot_score,
    case when as_sitemap_lines > 0 then 10 else 0 end as as_directive_score, case when as_has_llms then 20 else 0 end as as_llms_score,
    case when as_llms_has_h1 and as_llms_sections >= 1 then 10 else 0 end as as_llms_valid_score,
    case when as_has_sitemap and as_sitemap_valid then 10 else 0 end as as_sitemap_score,
    starts_with(p.final_url, 'https:') as as_https, case when starts_with(p.final_url, 'https:') then 10 else 0 end as as_https_score
  from caps p left join sitef s using (origin))"""

# -- findings, scores, reports ------------------------------------------------------------------------


def finding_ctes() -> None:
    from pagegauge.plans.dimensions import REGISTRY

    branches = []
    for d_ord, dim in enumerate(REGISTRY):
        for i, r in enumerate(dim.rules):
            branches.append(
                f"select page_id, '{dim.name}' as dimension, {d_ord} as dim_ord, {i} as ord, '{r.id}' as id, {severity(r.id)} as severity, "
                f"{r.title} as title, {r.description} as description, cast({r.evidence or 'null'} as varchar) as evidence "
                f"from {dim.prefix}f where {RULES[r.id][1]}"
            )
    CTES["finds"] = " union all ".join(branches)
    weighted = " + ".join(f"cast({d.score} as double) * {C.WEIGHTS[d.name]}e0" for d in REGISTRY)
    grade = " ".join(f"when overall_score >= {b} then '{g}'" for g, b in C.GRADE_BOUNDS)
    joins = " ".join(f"join {d.prefix}f using (page_id)" for d in REGISTRY)
    CTES["graded"] = f"""select *, case {grade} else 'F' end as grade from (
      select p.page_id, p.url, p.final_url, p.origin, p.captured_at, {", ".join(d.score for d in REGISTRY)}, asf.robots, asf.llms, asf.sitemap, {round_half(weighted)} as overall_score from caps p {joins})"""


finding_ctes()
