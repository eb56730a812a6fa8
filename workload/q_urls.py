"""URL screening, normalising, masking, address parsing, redirects."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import ips
from pagegauge.functions import urls as U
from pagegauge.operators import fetching
from workload import inputs as I
from workload.ctes import CTES, inlist, lit, port_suffix, url_columns
from workload.feature_ctes import READABLE
from workload.registry import query

# -- expected side ------------------------------------------------------------------------------
CTES["cases"] = f"select page_id * 2 as case_id, url from pages union all select page_id * 2 + 1, {I.url_variant_sql()} from pages"
_CLEAN = "regexp_replace(regexp_replace(url, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '^((?i)https?|wss?|ftp):[/\\\\]*', '\\1://')"
# The names beyond ASCII among the cases, and how the public registries write them.
_NAMES = {"bücher": "xn--bcher-kva", "例え": "xn--r8jz45g", "テスト": "xn--zckzah"}
_HOST = "u_host"
for _name, _ascii in _NAMES.items():
    _HOST = f"replace({_HOST}, '{_name}', '{_ascii}')"
CTES["cu0"] = f"select * replace ({_HOST} as u_host) from (select case_id, url, clean, {url_columns('clean')}, lower(regexp_extract(clean, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) as any_scheme from (select *, {_CLEAN} as clean from cases))"
_SAFE = "[\\x21\\x24-\\x3B\\x3D\\x40-\\x5F\\x61-\\x7A\\x7C\\x7E]"
CTES["cu"] = f"""select *, u_scheme <> '' and (u_port = '' or coalesce(try_cast(u_port as int) <= 65535, false)) and not regexp_matches(u_host, '[\\x00-\\x20<>^|%\\\\{{}}\\x7f]') as parsed,
    case when u_path = '' then '/' else array_to_string(list_transform(regexp_extract_all(u_path, '{_SAFE}+|[^\\x21\\x24-\\x3B\\x3D\\x40-\\x5F\\x61-\\x7A\\x7C\\x7E]+'),
      lambda s: case when regexp_matches(s, '^{_SAFE}') then s else url_encode(s) end), '') end as path from cu0"""


def form_encode(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def form_decode(x: str) -> str:
    bad = f"regexp_matches({x}, '%([^0-9a-fA-F]|[0-9a-fA-F][^0-9a-fA-F]|.?$)')"
    return f"case when {bad} then replace({x}, '+', ' ') else url_decode(replace({x}, '+', ' ')) end"


CTES["qp"] = f"""select case_id, idx, {form_decode("regexp_extract(part, '^[^=]*')")} as name, {form_decode("regexp_replace(part, '^[^=]*=?', '')")} as value
  from (select case_id, unnest(parts) as part, generate_subscripts(parts, 1) as idx from
    (select case_id, list_filter(string_split(substr(u_query, 2), '&'), lambda s: s <> '') as parts from cu where parsed))"""
_TRACK = " or ".join([f"lower(name) in {inlist(C.TRACKING_PARAMS)}"] + [f"starts_with(lower(name), '{p}')" for p in C.TRACKING_PREFIXES])
_SECRET = " or ".join([f"lower(name) in {inlist(C.SECRET_NAMES)}"] + [f"contains(lower(name), '{p}')" for p in C.SECRET_SUBSTRINGS])
_PAIR = f"concat({form_encode('name')}, '=', {form_encode('value')})"
CTES["normq"] = f"select case_id, concat('?', string_agg({_PAIR}, '&' order by lower(name), name desc, idx)) as q from qp where not ({_TRACK}) group by case_id"
CTES["maskq"] = f"""select case_id, concat('?', string_agg(concat({form_encode('name')}, '=', case when secret then '%5Bredacted%5D' else {form_encode('value')} end), '&' order by idx)) as q
  from (select *, {_SECRET} as secret, row_number() over (partition by case_id, name order by idx) as rep, bool_or({_SECRET}) over (partition by case_id) as any_secret from qp)
  where any_secret and (not secret or rep = 1) group by case_id"""
_USER = "case when u_user = '' then '' else concat(u_user, '@') end"


def v4(x: str) -> str:
    """BIGINT address of a dotted text, else NULL."""
    octal = "list_reduce(list_prepend(cast(0 as hugeint), list_transform(regexp_extract_all(p, '[0-7]'), lambda d: cast(d as hugeint))), lambda a, d: a * 8 + d)"
    hexa = "list_reduce(list_prepend(cast(0 as hugeint), list_transform(regexp_extract_all(substr(lower(p), 3), '.'), lambda d: cast(strpos('0123456789abcdef', d) - 1 as hugeint))), lambda a, d: a * 16 + d)"
    number = f"case when length(p) > 24 then null when regexp_matches(p, '^0[xX][0-9a-fA-F]+$') then {hexa} when regexp_matches(p, '^0[0-7]+$') then {octal} when regexp_matches(p, '^(0|[1-9][0-9]*)$') then try_cast(p as hugeint) end"
    return f"list_transform(string_split({x}, '.'), lambda p: {number})"


def v4_value(nums: str) -> str:
    return f"""case when len({nums}) > 4 or len(list_filter({nums}, lambda n: n is null)) > 0 or len(list_filter({nums}[1:len({nums}) - 1], lambda n: n > 255)) > 0 then null
      else case len({nums}) when 1 then case when {nums}[1] < 4294967296 then {nums}[1] end
        when 2 then case when {nums}[2] < 16777216 then {nums}[1] * 16777216 + {nums}[2] end
        when 3 then case when {nums}[3] < 65536 then {nums}[1] * 16777216 + {nums}[2] * 65536 + {nums}[3] end
        when 4 then case when {nums}[4] < 256 then {nums}[1] * 16777216 + {nums}[2] * 65536 + {nums}[3] * 256 + {nums}[4] end end end"""


def v4_class(v: str) -> str:
    a, b = f"({v} // 16777216)", f"(({v} // 65536) % 256)"
    return f"""case when {a} = 0 then 'reserved-ip' when {a} = 127 then 'loopback-ip' when {a} = 10 or ({a} = 172 and {b} between 16 and 31)
      or ({a} = 192 and {b} = 168) or ({a} = 100 and {b} between 64 and 127) then 'private-ip' when {a} = 169 and {b} = 254 then 'link-local'
      when {a} >= 224 then 'reserved-ip' end"""


def address_ctes(prefix: str, source: str, key: str, text: str) -> None:
    """<prefix>a: key, ip text, v4 value, eight v6 groups, class."""
    hexd = "list_reduce(list_prepend(cast(0 as int), list_transform(regexp_extract_all(lower(g), '[0-9a-f]'), lambda d: cast(strpos('0123456789abcdef', d) - 1 as int))), lambda a, d: a * 16 + d)"
    CTES[f"{prefix}1"] = f"""select {key}, ip, bare, {v4('bare')} as nums, regexp_extract(bare, ':([^:]*\\.[^:]*)$', 1) as tail,
        {v4("regexp_extract(bare, ':([^:]*\\.[^:]*)$', 1)")} as tail_nums from (
        select {key}, {text} as ip, case when starts_with({text}, '[') and ends_with({text}, ']') then substr({text}, 2, length({text}) - 2) else {text} end as bare from {source})"""
    CTES[f"{prefix}2"] = f"select *, {v4_value('nums')} as v4, {v4_value('tail_nums')} as tail_v4 from {prefix}1"
    CTES[f"{prefix}3"] = f"""select *, string_split(case when tail = '' then bare else concat(regexp_replace(bare, ':[^:]*\\.[^:]*$', ':'),
        printf('%x', cast(tail_v4 // 65536 as bigint)), ':', printf('%x', cast(tail_v4 % 65536 as bigint))) end, '::') as halves from {prefix}2"""
    side = lambda i: f"case when coalesce(halves[{i}], '') = '' then [] else string_split(halves[{i}], ':') end"
    CTES[f"{prefix}4"] = f"""select *, case when tail <> '' and tail_v4 is null then null when len(halves) = 1 then string_split(halves[1], ':')
        when len(halves) = 2 and len({side(1)}) + len({side(2)}) < 8 then {side(1)} || list_transform(range(8 - len({side(1)}) - len({side(2)})), lambda x: '0') || {side(2)} end as grp from {prefix}3"""
    CTES[f"{prefix}5"] = f"""select *, case when len(grp) = 8 and len(list_filter(grp, lambda g: not regexp_matches(g, '^[0-9a-fA-F]{{1,4}}$'))) = 0
        then list_transform(grp, lambda g: {hexd}) end as v6 from {prefix}4"""
    mapped = "(cast(v6[7] as hugeint) * 65536 + v6[8])"
    CTES[f"{prefix}a"] = f"""select {key}, ip, bare, v4, v6, {v4_class('v4')} as v4_class,
        case when v6 is null then 'invalid-url' when list_sum(v6[1:7]) = 0 and v6[8] = 1 then 'loopback-ip' when list_sum(v6) = 0 then 'reserved-ip'
          when list_sum(v6[1:5]) = 0 and v6[6] = 65535 then {v4_class(mapped)} when v6[1] // 64 = 1018 then 'link-local' when v6[1] // 512 = 126 then 'private-ip'
          when v6[1] // 256 = 255 then 'reserved-ip' end as v6_class from {prefix}5"""


CTES["addr"] = f"select event_id, {I.address_sql(False)} as ip from events"
address_ctes("ad", "addr", "event_id", "ip")
CTES["casehost"] = "select case_id, case when starts_with(u_host, '[') then u_host else regexp_replace(u_host, '\\.$', '') end as h from cu"
address_ctes("ch", "casehost", "case_id", "h")


def refusal(a: str = "a") -> str:
    return f"""case when clean = '' or any_scheme = '' then 'invalid-url' when any_scheme not in ('http', 'https') then 'unsupported-protocol'
      when not parsed then 'invalid-url' when u_user not in ('', ':') then 'embedded-credentials' when u_host = '' then 'invalid-url'
      when starts_with(u_host, '[') then {a}.v6_class when {a}.v4 is not null then {a}.v4_class
      when regexp_matches({a}.bare, '(^|\\.)([0-9]+|0[xX][0-9a-fA-F]*)$') then 'invalid-url'
      when u_host in {inlist(C.BLOCKED_HOSTNAMES)} then 'blocked-hostname' end"""


# -- queries ------------------------------------------------------------------------------------


@query(
    "url_parts",
    """select case_id, parsed, case when parsed then u_scheme else '' end as scheme, case when parsed then u_user else '' end as userinfo,
        case when parsed then u_host else '' end as host, case when parsed then u_port else '' end as port, case when parsed then u_path else '' end as path,
        case when parsed then u_query else '' end as query, case when parsed then u_frag else '' end as fragment from cu""",
)
def url_parts(t):
    rows = t.url_cases().withColumn("p", U.parts(F.col("url")))
    fields = ("scheme", "userinfo", "host", "port", "path", "query", "fragment")
    return rows.select(
        "case_id", F.col("p").isNotNull().alias("parsed"), *[F.coalesce(f"p.{f}", F.lit("")).alias(f) for f in fields]
    )


@query("url_shape_check", "select case_id, parsed and u_scheme in ('http', 'https') and u_host <> '' as ok from cu")
def url_shape_check(t):
    return t.url_cases().select("case_id", U.shape_ok(F.col("url")).alias("ok"))


@query(
    "url_validate",
    f"select cu.case_id, cu.url, ({refusal()}) is null as ok, coalesce({refusal()}, '') as reason from cu join cha a on a.case_id = cu.case_id",
)
def url_validate(t):
    return fetching.validate(t.url_cases()).withColumn("reason", F.coalesce("reason", F.lit("")))


@query("url_blocked_hostname", f"select case_id, parsed and u_host in {inlist(C.BLOCKED_HOSTNAMES)} as blocked from cu")
def url_blocked_hostname(t):
    host = U.parts(F.col("url"))["host"]
    return t.url_cases().select("case_id", F.coalesce(U.blocked_hostname(host), F.lit(False)).alias("blocked"))


@query(
    "ip4_parse",
    """select event_id, ip, v4 is not null as ok, case when v4 is null then '' else concat(cast(v4 // 16777216 as int), '.', cast(v4 // 65536 % 256 as int), '.',
        cast(v4 // 256 % 256 as int), '.', cast(v4 % 256 as int)) end as dotted from ada where not contains(ip, ':')""",
)
def ip4_parse(t):
    value = ips.parse_v4(F.col("ip"))
    rows = t.addresses().where(~F.contains("ip", F.lit(":")))
    return rows.select(
        "event_id", "ip", value.isNotNull().alias("ok"),
        F.when(value.isNotNull(), ips.dotted(value)).otherwise("").alias("dotted"),
    )


@query("ip4_classify", "select event_id, coalesce(v4_class, 'public') as verdict from ada where v4 is not null")
def ip4_classify(t):
    rows = t.addresses().withColumn("v4", ips.parse_v4(F.col("ip"))).where(F.col("v4").isNotNull())
    return rows.select("event_id", F.coalesce(ips.classify_v4(F.col("v4")), F.lit("public")).alias("verdict"))


@query(
    "ip6_parse",
    "select event_id, ip, v6 is not null as ok, coalesce(array_to_string(list_transform(v6, lambda g: printf('%04x', g)), ':'), '') as expanded from ada where contains(ip, ':')",
)
def ip6_parse(t):
    groups = ips.parse_v6(F.regexp_replace("ip", r"^\[|\]$", ""))
    rows = t.addresses().where(F.contains("ip", F.lit(":")))
    return rows.select(
        "event_id", "ip", groups.isNotNull().alias("ok"), F.coalesce(ips.expanded(groups), F.lit("")).alias("expanded")
    )


@query("ip6_classify", "select event_id, coalesce(v6_class, 'public') as verdict from ada where v6 is not null")
def ip6_classify(t):
    rows = t.addresses().withColumn("v6", ips.parse_v6(F.regexp_replace("ip", r"^\[|\]$", ""))).where(F.col("v6").isNotNull())
    return rows.select("event_id", F.coalesce(ips.classify_v6(F.col("v6")), F.lit("public")).alias("verdict"))


@query(
    "ip_classify",
    "select event_id, coalesce(case when contains(bare, ':') then v6_class when v4 is null then 'invalid-url' else v4_class end, 'public') as verdict from ada",
)
def ip_classify(t):
    return t.addresses().select("event_id", F.coalesce(ips.classify(F.col("ip")), F.lit("public")).alias("verdict"))


CTES["hosts"] = f"select {I.HOST_SQL} as host, min(page_id) as k from pages group by 1"
CTES["hostip"] = f"select host, unnest({I.HOST_IPS_SQL.format(array='list_value')}) as ip from hosts"
address_ctes("hi", "hostip", "host", "ip")


@query(
    "host_ip_verdict",
    """select h.host, case when j.host is null then 'dns-failed' when j.bad is not null then 'blocked-host' else 'ok' end as verdict, coalesce(j.bad, '') as blocked_ip
       from hosts h left join (select host, min(case when contains(bare, ':') then case when v6_class is not null then ip end
         when v4 is null or v4_class is not null then ip end) as bad from hia group by host) j on j.host = h.host""",
)
def host_ip_verdict(t):
    hosts = t.pages().select(F.expr(I.HOST_SQL).alias("host"))
    return fetching.host_verdicts(hosts, t.host_ips()).withColumn("blocked_ip", F.coalesce("blocked_ip", F.lit("")))


CTES["edge"] = f"select {I.HOP_SQL.format(id='page_id')} as from_url, {I.REDIRECT_SQL} as to_url from pages"
_BAD = "case when u = 'not a url' then 'invalid-url' when starts_with(u, 'http://192.168.') then 'blocked-host' end"


@query(
    "redirect_resolve",
    f"""with recursive walk(page_id, u, hops, reason) as (
         select page_id, {I.HOP_SQL.format(id='page_id')}, 0, cast(null as varchar) from pages
         union all select w.page_id, case when w.hops = 5 then w.u else e.to_url end, w.hops + 1,
           case when w.hops = 5 then 'too-many-redirects' when e.to_url = 'not a url' then 'invalid-url' when starts_with(e.to_url, 'http://192.168.') then 'blocked-host' end
         from walk w join (select {I.HOP_SQL.format(id='page_id')} as from_url, {I.REDIRECT_SQL} as to_url from pages) e on e.from_url = w.u and e.to_url is not null and w.reason is null and w.hops <= 5)
       select page_id, u as final_url, cast(hops as int) as hops, coalesce(reason, '') as reason from walk qualify row_number() over (partition by page_id order by hops desc) = 1""",
)
def redirect_resolve(t):
    done = fetching.resolve_redirects(t.redirect_starts(), t.redirects())
    return done.select("page_id", "final_url", "hops", F.coalesce("reason", F.lit("")).alias("reason"))


_REASONS = ("invalid-url", "blocked-host", "dns-failed", "too-many-redirects", "response-too-large", "timeout", "http-error", "network")
_REASON_SQL = "case event_id % 8 " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(_REASONS)) + " end"
_STATUS_SQL = "case when event_id % 3 <> 0 then cast(400 + event_id % 150 as int) end"


@query(
    "fetch_failure_class",
    f"""select event_id, reason in ('invalid-url', 'blocked-host') or (reason = 'http-error' and coalesce(status between 400 and 499, false)) as permanent,
        case reason when 'http-error' then case when status is null then 'The server answered with an error.' else concat('The server answered with status ', status, '.') end
          {" ".join(f"when {lit(k)} then {lit(v)}" for k, v in fetching.MESSAGES.items())} else 'The server gave no answer.' end as message
       from (select event_id, {_REASON_SQL} as reason, {_STATUS_SQL} as status from events)""",
)
def fetch_failure_class(t):
    rows = t.read("events").select("event_id", F.expr(_REASON_SQL).alias("reason"), F.expr(_STATUS_SQL).alias("status"))
    permanent, message = fetching.failure_class(F.col("reason"), F.col("status"))
    return rows.select("event_id", permanent.alias("permanent"), message.alias("message"))


@query("url_origin", f"select case_id, case when parsed then concat(u_scheme, '://', u_host, {port_suffix()}) else '' end as origin from cu")
def url_origin(t):
    return t.url_cases().select("case_id", F.coalesce(U.origin(F.col("url")), F.lit("")).alias("origin"))


@query(
    "url_normalize",
    f"""select cu.case_id, case when parsed then concat(u_scheme, '://', {_USER}, u_host, {port_suffix()},
        case when length(path) > 1 and ends_with(path, '/') then case when rtrim(path, '/') = '' then '/' else rtrim(path, '/') end else path end, coalesce(q, '')) else '' end as normalized_url
       from cu left join normq on normq.case_id = cu.case_id""",
)
def url_normalize(t):
    return t.url_cases().select("case_id", F.coalesce(U.normalize(F.col("url")), F.lit("")).alias("normalized_url"))


@query(
    "url_mask",
    f"""select cu.case_id, case when parsed then concat(u_scheme, '://', u_host, {port_suffix()}, path, coalesce(q, u_query), u_frag) else url end as masked_url
       from cu left join maskq on maskq.case_id = cu.case_id""",
)
def url_mask(t):
    return t.url_cases().select("case_id", U.mask(F.col("url")).alias("masked_url"))


@query("url_readable", f"select case_id, parsed and {READABLE.replace('u_path', 'path')} as ok from cu")
def url_readable(t):
    return t.url_cases().select("case_id", U.readable(F.col("url")).alias("ok"))


@query("url_https", "select case_id, parsed and u_scheme = 'https' as ok from cu")
def url_https(t):
    return t.url_cases().select("case_id", U.is_https(F.col("url")).alias("ok"))
