"""DuckDB building blocks for the expected results: the same inputs, parsed relationally.

Element text is found by joining elements to text tokens on position, unlike the library, which uses
running counts and slices.
"""

from __future__ import annotations

import re

from pagegauge import constants as C
from workload import inputs as I


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


WS = C.WHITESPACE_PATTERN
WS_CHARS = "concat(" + ", ".join(f"chr({ord(c)})" for c in C.WHITESPACE_CHARS) + ")"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def snip(x: str, n: int = 200) -> str:
    f = collapse(x)
    return f"case when length({f}) > {n} then concat(left({f}, {n}), '…') else {f} end"


# The references that the given pages and the rows made from them hold; the library reads the whole public table.
_NAMED = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·", "&nbsp;": "\u00a0", "&hellip;": "…", "&mdash;": "—", "&amp": "&"}


def decode(x: str) -> str:
    named = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in _NAMED.items())
    point = (
        "case when regexp_matches(p, '^&#[0-9]+;?$') then chr(cast(regexp_extract(p, '([0-9]+)', 1) as int)) "
        f"when regexp_matches(p, '^&#[xX][0-9a-fA-F]+;?$') then chr(cast(concat('0x', regexp_extract(p, '^&#[xX]([0-9a-fA-F]+)', 1)) as int)) else case p {named} else p end end"
    )
    pieces = f"regexp_extract_all({x}, '&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[a-zA-Z][a-zA-Z0-9]*;?|[^&]+|&')"
    return f"case when contains({x}, '&') then array_to_string(list_transform({pieces}, lambda p: {point}), '') else {x} end"


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]{{3,}}'))"


def jaccard(a: str, b: str, both_empty: str, one_empty: str) -> str:
    wa, wb = words(a), words(b)
    both = f"len(list_intersect({wa}, {wb}))"
    return (
        f"case when len({wa}) = 0 and len({wb}) = 0 then {both_empty} when len({wa}) = 0 or len({wb}) = 0 then {one_empty} "
        f"else cast({both} as double) / (len({wa}) + len({wb}) - {both}) end"
    )


def round_half(x: str) -> str:
    return f"cast(floor(({x}) + 5e-1) as int)"


def linear_sql(v: str, good: float, bad: float, points: int) -> str:
    return (
        f"case when {v} <= {good} then {points} when {v} >= {bad} then 0 "
        f"else {round_half(f'({bad}e0 - {v}) / ({bad}e0 - {good}e0) * {points}e0')} end"
    )


RAW_TAGS = inlist(C.RAW_TEXT_TAGS)
_RAW_ALT = "|".join(C.RAW_TEXT_TAGS)
_PERF = ", ".join(f"{sql} as {name}" for name, sql in I.PERF_SQL.items())

# The token grammar once more, for an engine that backtracks nowhere. Runs of bare "<" inside a page are split here; the pages have none.
_ATTR = """[^\\s/>=]+(?:\\s*=\\s*(?:"[^"]*"|'[^']*'|[^\\s>]*))?"""
_TOKEN = (
    "(?s)<!--.*?(?:-->|\\z)|<[!?][^>]*(?:>|\\z)|"
    + "|".join(f"<(?i:{t})(?:[\\s/][^>]*)?>.*?(?:</(?i:{t})[^>]*(?:>|\\z)|\\z)" for t in "script style title textarea noscript iframe noembed noframes xmp".split())
    + f"|</?[a-zA-Z][^\\s/>]*(?:[\\s/]+|{_ATTR}|=)*(?:>|\\z)|</(?:>|[^a-zA-Z>][^>]*(?:>|\\z))|(?:[^<]|<[^a-zA-Z/!?<]|<\\z|</\\z)+|<"
)

_TOKEN_COLUMNS = f"""
    nullif(lower(regexp_extract(tok, '^<[/]?([A-Za-z][^/>\\s]*)', 1)), '') as tag,
    case when starts_with(tok, '<!--') then 'comment'
         when regexp_matches(tok, '^<!(?i:doctype)') then 'doctype'
         when regexp_matches(tok, '^<[!?]') or regexp_matches(tok, '^</[^a-zA-Z]') then 'comment'
         when regexp_matches(tok, '^</?[a-zA-Z]') and not ends_with(tok, '>') and not regexp_matches(tok, '^<(?i:{_RAW_ALT})(?:[\\s/][^>]*)?>') then 'comment'
         when regexp_matches(tok, '^</[a-zA-Z]') then 'close'
         when regexp_matches(tok, '^<(?i:script)([\\s/>])') then 'script'
         when regexp_matches(tok, '^<(?i:style)([\\s/>])') then 'style'
         when regexp_matches(tok, '^<(?i:{_RAW_ALT})([\\s/>])') then 'rawtext'
         when regexp_matches(tok, '^<[a-zA-Z]') then 'open' else 'text' end as kind"""
_BODY = f"regexp_replace(regexp_replace(tok, '^<[^>]*>', ''), '</(?i:{_RAW_ALT})[^>]*>\\z', '')"


def _tokens(source: str, html: str) -> str:
    return f"""select page_id, pos, tok, {_TOKEN_COLUMNS} from (
      select page_id, unnest(toks) as tok, generate_subscripts(toks, 1) - 1 as pos
      from (select page_id, regexp_extract_all({html}, {lit(_TOKEN)}) as toks from {source}))"""


VOID = inlist(C.VOID_TAGS)

# The tree rules as rows: mark, tag, what it ends, what it does not reach out of, whether the outermost such element ends.
_SCOPE = "applet caption html marquee object table td template th".split()
_HEADS = "h1 h2 h3 h4 h5 h6".split()
_SPECIAL = _SCOPE + _HEADS + (
    "address article aside blockquote body button center colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "head header hgroup li listing main menu nav ol p plaintext pre search section select summary tbody tfoot thead tr ul"
).split()
_ENDS_P = (
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup hr listing main menu nav ol p "
    "plaintext pre search section summary table ul"
).split()


def _less(names, *without):
    return [n for n in names if n not in without]


def _tree_rules() -> list[tuple[str, str, list[str], list[str]]]:
    table, parts = ["table", "template", "html"], ["tr", "td", "th", "caption", "colgroup"]
    rules = [("open", t, ["p"], [*_SCOPE, "button"]) for t in _ENDS_P]
    rules += [("open", t, ["p", *_HEADS], _less(_SPECIAL, "p", *_HEADS)) for t in _HEADS]
    rules += [("open", "li", ["li", "p"], _less(_SPECIAL, "address", "div", "p", "li"))]
    rules += [("open", t, ["dd", "dt", "p"], _less(_SPECIAL, "address", "div", "p", "dd", "dt")) for t in ("dd", "dt")]
    rules += [("open", "option", ["option"], _SPECIAL), ("open", "optgroup", ["option", "optgroup"], _SPECIAL)]
    rules += [("open", "a", ["a"], _SCOPE), ("open", "button", ["button"], _SCOPE)]
    rules += [("open", t, ["td", "th"], [*table, "tr"]) for t in ("td", "th")] + [("open", "tr", parts, table)]
    rules += [("open", t, [*parts, "tbody", "thead", "tfoot"], table) for t in ("tbody", "thead", "tfoot")]
    rules += [("close", t, _HEADS, _SCOPE) for t in _HEADS] + [("close", t, [t], []) for t in ("body", "html")]
    rules += [("close", t, [t], _less(table, t)) for t in ("table", "caption", "tr", "td", "th", "tbody", "thead", "tfoot")]
    rules += [("close", "li", ["li"], [*_SCOPE, "ol", "ul"]), ("close", "p", ["p"], [*_SCOPE, "button"])]
    done = {t for k, t, _, _ in rules if k == "close"}
    return rules + [("close", t, [t], _less(_SCOPE, t)) for t in _SPECIAL if t not in done]


_RULES = ", ".join(f"('{k}', '{t}', {ends}::varchar[], {stops}::varchar[])" for k, t, ends, stops in _tree_rules())
# Place (from 1) on the stack of the innermost element that is a barrier; what is ended stands above it.
_STOP = "coalesce(list_max(list_filter(range(1, len(stack) + 1), lambda i: list_contains(k.stops, stack[i].tag))), 0)"
_HITS = f"list_filter(range(1, len(stack) + 1), lambda i: list_contains(k.ends, stack[i].tag) and i > {_STOP})"


def _tree(tokens: str) -> str:
    """Per token: the elements that it ends, its parent and level, what it is inside of. A walk, token by token, of all pages at once."""
    return f"""with recursive rules(mark, rtag, ends, stops) as (values {_RULES}),
      steps as materialized (
        select t.page_id, cast(row_number() over (partition by t.page_id order by t.pos) as int) as step, t.pos, t.tag, t.kind, t.tok,
          coalesce(r.ends, case when t.kind = 'close' then [t.tag] else []::varchar[] end) as ends, coalesce(r.stops, {_SPECIAL}::varchar[]) as stops
        from {tokens} t left join rules r on r.mark = t.kind and r.rtag = t.tag),
      walk(page_id, step, pos, stack, gone, parent, level, tags) as (
        select page_id, 0, -1, []::struct(pos bigint, tag varchar)[], []::bigint[], null::bigint, 0, []::varchar[] from steps group by page_id
        union all
        select page_id, step, pos, case when pushes then list_append(left_over, {{'pos': pos, 'tag': tag}}) else left_over end, gone, parent, level, tags from (
          select *, left_over[-1].pos as parent, len(left_over) as level, list_transform(left_over, lambda s: s.tag) as tags,
            kind = 'open' and tag not in {VOID} and not (ends_with(tok, '/>') and len(list_filter(left_over, lambda s: s.tag in ('svg', 'math'))) > 0) as pushes
          from (
            select *, list_slice(stack, 1, coalesce(cut, len(stack) + 1) - 1) as left_over,
              list_transform(list_slice(stack, coalesce(cut, len(stack) + 1), len(stack)), lambda s: s.pos) as gone
            from (
              select k.page_id, k.step, k.pos, k.tag, k.kind, k.tok, w.stack, case when k.kind = 'open' then list_min({_HITS}) else list_max({_HITS}) end as cut
              from walk w join steps k on k.page_id = w.page_id and k.step = w.step + 1))))
      select page_id, pos, gone, parent, level, list_contains(tags, 'template') as under_template, list_contains(tags, 'svg') or list_contains(tags, 'math') as drawing,
        len(list_intersect(tags, ['header', 'footer', 'nav', 'aside'])) > 0 as under_boiler from walk where step > 0"""


def _texts(tokens: str, tree: str) -> str:
    return f"""select *, case when not hidden then nullif({trim('txt')}, '') end as node from (
      select t.page_id, t.pos, t.tok, t.tag, t.kind,
        case when t.kind = 'text' then {decode('tok')}
             when t.kind = 'rawtext' and t.tag in ('title', 'textarea') then {decode(_BODY)}
             when t.kind in ('script', 'style', 'rawtext') then {_BODY} end as txt,
        coalesce(t.tag in {inlist(C.HIDDEN_TAGS)}, false) or w.under_template or (t.kind = 'open' and t.tag = 'template') as hidden,
        w.under_template as in_template
      from {tokens} t join {tree} w on w.page_id = t.page_id and w.pos = t.pos)"""


# URL splitting
_U = lit("^([A-Za-z][-+.0-9A-Za-z]*)://(?:([^#?/@]*)@)?([[][^]]*]|[^#?/:]*)(?::([0-9]*))?([^#?]*)([?][^#]*)?(#.*)?$")


def url_columns(url: str) -> str:
    g = lambda i: f"regexp_extract({url}, {_U}, {i})"
    return (
        f"lower({g(1)}) as u_scheme, {g(2)} as u_user, lower({g(3)}) as u_host, {g(4)} as u_port, "
        f"{g(5)} as u_path, {g(6)} as u_query, {g(7)} as u_frag"
    )


def port_suffix(scheme="u_scheme", port="u_port") -> str:
    return (
        f"case when {port} = '' or ({scheme} = 'http' and {port} = '80') or ({scheme} = 'https' and {port} = '443') "
        f"then '' else concat(':', cast(cast({port} as int) as varchar)) end"
    )


CTES: dict[str, str] = {
    "caps0": f"select page_id, url, html, {I.rendered_sql(False)} as rendered_html from pages",
    "caps": f"""select page_id, url, url as final_url, {I.RAW_SQL} as raw_html, rendered_html, {_PERF},
        make_timestamp((1706659200 + page_id) * 1000000) as captured_at, {I.ORIGIN_SQL} as origin from caps0""",
    "tok": _tokens("caps", "rendered_html"),
    "raw_tok": _tokens("caps", "raw_html"),
    "tree": _tree("tok"),
    "raw_tree": _tree("raw_tok"),
    "txt": _texts("tok", "tree"),
    "raw_txt": _texts("raw_tok", "raw_tree"),
    "ended": "select page_id, unnest(gone) as pos, pos as close_pos from tree",
    "els": f"""select page_id, pos, tag, kind, tok, level, parent, case when container then close_pos else pos end as close_pos,
        coalesce(case when container then close_pos else pos end, 1000000000) as upto, container
      from (select t.*, w.level, w.parent, n.close_pos,
          t.kind = 'open' and t.tag not in {VOID} and not (ends_with(t.tok, '/>') and w.drawing) as container
        from tok t join tree w on w.page_id = t.page_id and w.pos = t.pos left join ended n on n.page_id = t.page_id and n.pos = t.pos
        where t.kind in ('open', 'script', 'style', 'rawtext'))""",
    "attr0": f"""select page_id, pos, tag, unnest(parts) as part, generate_subscripts(parts, 1) as ord from (
        select page_id, pos, tag, regexp_extract_all(regexp_replace(
            case when tag in {RAW_TAGS} then regexp_extract(tok, '^<[^>]*>') else tok end, '^<[a-zA-Z][^\\s/>]*', ''),
            {lit(_ATTR)}) as parts from els)""",
    "attrs": f"""select page_id, pos, tag, ord, name, case when not contains(part, '=') then ''
          when regexp_matches(val, '^["'']') then {decode('substr(val, 2, length(val) - 2)')} else {decode('val')} end as value
        from (select *, lower(regexp_extract(part, '^[^\\s=]+')) as name, regexp_replace(part, '^[^=]*=\\s*', '') as val from attr0)
        qualify row_number() over (partition by page_id, pos, name order by ord) = 1""",
    # one row per element with the attributes the checks use
    "el": """select e.*, a.* exclude (page_id, pos) from els e left join (
        select page_id, pos, """
    + ", ".join(
        f"max(value) filter (name = {lit(n)}) as a_{n.replace('-', '_')}"
        for n in (
            "href", "type", "role", "onclick", "id", "class", "style", "name", "content", "property", "rel", "hreflang",
            "lang", "for", "value", "alt", "autocomplete", "itemscope", "aria-label", "aria-labelledby", "aria-modal",
        )
    )
    + """, bool_or(starts_with(name, 'data-')) as has_data from attrs group by page_id, pos) a
        on a.page_id = e.page_id and a.pos = e.pos""",
    # text below each element, untrimmed
    "eltext": """select e.page_id, e.pos, e.tag, coalesce(string_agg(t.txt, '' order by t.pos), '') as txt,
          coalesce(string_agg(case when t.kind not in ('script', 'style') and coalesce(t.tag, '') <> 'noscript' and not t.in_template then t.txt end, '' order by t.pos), '') as main_txt,
          coalesce(bool_or(regexp_matches(t.txt, '(?i)cookie|consent|gdpr|privacy')), false) as kw
        from els e left join txt t on t.page_id = e.page_id and t.txt is not null
          and ((e.container and t.pos > e.pos and t.pos < e.upto) or (not e.container and t.pos = e.pos))
        group by e.page_id, e.pos, e.tag""",
    "sites0": f"select {I.ORIGIN_SQL} as origin, min(page_id) as k from pages group by 1",
    "sites": f"select origin, {I.ROBOTS_SQL} as robots, {I.LLMS_SQL} as llms, {I.SITEMAP_SQL} as sitemap from sites0",
    "jobs": None,  # filled below
}
CTES["jobs"] = f"""select event_id, user_id, event_type, value, props, {I.JOB_ID_SQL[False]} as job_id,
    concat('https://s', user_id % 2, '.example.com/?token=', event_id) as url,
    concat('https://s', user_id % 2, '.example.com/') as normalized_url, {I.STATUS_SQL} as status,
    case when event_type = 'error' then concat('Upstream returned ', event_id % 500) end as error_message,
    case when event_id % 7 <> 0 then sha256(concat('token-', event_id)) end as delete_token_hash,
    cast(ts as timestamp) as created_at,
    case when event_type <> 'signup' then cast(ts as timestamp) + interval 5 second end as started_at,
    case when event_type not in ('signup', 'click') then make_timestamp(epoch_us(cast(ts as timestamp)) + 5000000 + cast(round(value * 1000) as bigint) * 1000) end as completed_at
    from events"""


_LITERAL = re.compile(r"'(?:[^']|'')*'")
_SOURCE = re.compile(r"\b(?:from|join)\s+([a-z_]\w*)", re.IGNORECASE)


def sql(body: str) -> str:
    """Prefix a query with the blocks that it reads, directly or through others: each after those that it reads itself."""
    ordered: list[str] = []

    def visit(text: str, open_blocks: tuple[str, ...]):
        for name in dict.fromkeys(_SOURCE.findall(_LITERAL.sub("''", text))):
            if name in CTES and name not in ordered:
                if name in open_blocks:
                    raise ValueError(f"block {name} reads itself")
                visit(CTES[name], (*open_blocks, name))
                ordered.append(name)

    visit(body, ())
    if not ordered:
        return body
    head = ",\n".join(f"{n} as materialized ({CTES[n]})" for n in ordered)
    return f"with {head}\n{body}"
