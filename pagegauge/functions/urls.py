"""URL columns: splitting, screening, normalising, masking, readability.

All of them are Column -> Column, so they run inside whichever projection uses them.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import ips
from pagegauge.functions.binding import let
from pagegauge.functions.punycode import ascii_host

_CONTROL = "".join(chr(c) for c in range(0x21))


# Web schemes take any number of slashes of either kind, or none, before the host.
_WEB = r"^(?i)(https?|wss?|ftp):[/\\]*"


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.btrim(url, F.lit(_CONTROL)), _WEB, "$1://")


def _host_forms() -> tuple[str, str, str]:
    """Characters that a host may be disguised with, by the compatibility forms of Unicode: those that stand for one
    ASCII character, those characters in the same order followed by none for characters that host names ignore, and
    the ones that stand for several ASCII characters."""
    single, plain, several = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        form = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).lower())
        form = form.replace("\u3002", ".")
        if form != c and form.isascii() and form.strip():
            if len(form) == 1:
                single.append(c)
                plain.append(form)
            else:
                several.append(c)
    single.append("\uff61")
    plain.append(".")
    ignored = "\u00ad\u034f\u180b\u180c\u180d\u200b\u200c\u200d\u2060\ufeff" + "".join(chr(c) for c in range(0xFE00, 0xFE10))
    return "".join(single) + "\u3002" + ignored, "".join(plain) + ".", "".join(several)


_DISGUISED, _PLAIN, _SEVERAL = _host_forms()


def canonical_host(host: Column) -> Column:
    """Lower case, with compatibility forms of ASCII characters (full width, circled, ideographic full stop) made plain."""
    return F.when(host.rlike(r"[^\x00-\x7F]"), F.lower(F.translate(F.lower(host), _DISGUISED, _PLAIN))).otherwise(F.lower(host))


_PARTS = ("scheme", "userinfo", "host", "port", "path", "query", "fragment")


def _split(clean: Column) -> Column:
    group = lambda i: F.regexp_extract(clean, C.URL_PATTERN, i)
    return F.struct(
        F.lower(group(1)).alias("scheme"), group(2).alias("userinfo"), canonical_host(group(3)).alias("host"),
        group(4).alias("port"), group(5).alias("path"), group(6).alias("query"), group(7).alias("fragment"),
    )


def _well_formed(p: Column) -> Column:
    port_ok = (p["port"] == "") | F.coalesce(p["port"].try_cast("int") <= 65535, F.lit(False))
    # Characters that stand for several ASCII ones could spell any name, so such hosts are refused.
    plain = F.translate(p["host"], _SEVERAL, "") == p["host"]
    return (p["scheme"] != "") & port_ok & ~p["host"].rlike(r"[\x00-\x20<>^|%\\{}\x7f]") & plain


def parts(url: Column) -> Column:
    """Struct (scheme, userinfo, host, port, path, query, fragment); NULL if the URL cannot be split.

    Hosts are in lower case and in ASCII, labels beyond it in Punycode, so the two spellings of a name are one host.
    """
    def named(p: Column) -> Column:
        return F.struct(*(p[c].alias(c) if c != "host" else ascii_host(p[c]).alias(c) for c in _PARTS))

    return let(let(_clean(url), _split), lambda p: F.when(_well_formed(p), named(p)))


def shape_ok(url: Column) -> Column:
    """Non-empty, splittable and http or https."""
    ok = let(parts(url), lambda p: p["scheme"].isin("http", "https") & (p["host"] != ""))
    return F.coalesce(ok, F.lit(False))


def without_dots(path: Column) -> Column:
    """Path with ``.`` and ``..`` segments resolved as a browser does; ``%2e`` is a dot."""
    last = F.regexp_replace(F.regexp_replace(path, r"(?i)%2e", "."), r"(^|/)(\.\.?)$", "$1$2/")

    def step(done: Column, segment: Column) -> Column:
        return (
            F.when(segment == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .when(segment == ".", done)
            .otherwise(F.array_append(done, segment))
        )

    # The empty segment before the first slash is not a folder.
    folders = F.split(F.regexp_replace(last, "^/", ""), "/")
    resolved = F.aggregate(folders, F.array().cast("array<string>"), step, lambda done: F.concat(F.lit("/"), F.array_join(done, "/")))
    return F.when(path.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)"), resolved).otherwise(path)


def encoded_path(raw: Column) -> Column:
    """Percent-encode what a browser would encode in a path and resolve its dots; an empty path is ``/``."""
    return let(without_dots(raw), _encoded)


def _encoded(path: Column) -> Column:
    unsafe = r"[^\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E]+"
    chunks = F.regexp_extract_all(path, F.lit(unsafe + r"|[\x21\x24-\x3B\x3D\x40-\x5F\x61-\x7A\x7C\x7E]+"), F.lit(0))
    encoded = F.array_join(
        F.transform(chunks, lambda s: F.when(s.rlike(unsafe), F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))).otherwise(s)),
        "",
    )
    return F.when(path == "", F.lit("/")).when(path.rlike(unsafe), encoded).otherwise(path)


def _port_suffix(p: Column) -> Column:
    number = F.ltrim(p["port"], F.lit("0"))
    default = ((p["scheme"] == "http") & (number == "80")) | ((p["scheme"] == "https") & (number == "443"))
    return F.when((p["port"] == "") | default, F.lit("")).otherwise(
        F.concat(F.lit(":"), F.when(number == "", F.lit("0")).otherwise(number))
    )


def origin(url: Column) -> Column:
    return let(parts(url), lambda p: F.concat(p["scheme"], F.lit("://"), p["host"], _port_suffix(p)))


def params(query: Column) -> Column:
    """``array<struct<name,value,idx>>`` of a query string, form-decoded, in order."""

    def decode(s: Column) -> Column:
        return F.coalesce(F.try_url_decode(s), F.replace(s, F.lit("+"), F.lit(" ")))

    raw = F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda s: s != "")
    return F.transform(
        raw,
        lambda s, i: F.struct(
            decode(F.regexp_extract(s, r"^[^=]*", 0)).alias("name"),
            decode(F.regexp_replace(s, r"^[^=]*=?", "")).alias("value"),
            i.alias("idx"),
        ),
    )


def encode_params(items: Column) -> Column:
    """``?a=b&c=d`` in form encoding, empty for no parameters."""
    joined = F.array_join(
        F.transform(items, lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))), "&"
    )
    return F.when(F.size(items) == 0, F.lit("")).otherwise(F.concat(F.lit("?"), joined))


def is_tracking(name: Column) -> Column:
    lower = F.lower(name)
    prefixed = reduce(lambda a, b: a | b, [F.startswith(lower, F.lit(p)) for p in C.TRACKING_PREFIXES])
    return lower.isin(*C.TRACKING_PARAMS) | prefixed


def is_secret(name: Column) -> Column:
    lower = F.lower(name)
    inside = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(s)) for s in C.SECRET_SUBSTRINGS])
    return lower.isin(*C.SECRET_NAMES) | inside


def _userinfo(p: Column) -> Column:
    return F.when(p["userinfo"] == "", F.lit("")).otherwise(F.concat(p["userinfo"], F.lit("@")))


def _param_order(a: Column, b: Column) -> Column:
    la, lb = F.lower(a["name"]), F.lower(b["name"])
    return (
        F.when(la < lb, -1).when(la > lb, 1)
        .when(a["name"] > b["name"], -1).when(a["name"] < b["name"], 1)
        .when(a["idx"] < b["idx"], -1).when(a["idx"] > b["idx"], 1)
        .otherwise(0)
    )


def normalize(url: Column) -> Column:
    """Deduplication key: no fragment, tracking parameter, default port or trailing slash; sorted parameters."""

    def shorten(path: Column) -> Column:
        short = F.when((F.length(path) > 1) & path.endswith("/"), F.rtrim(path, F.lit("/"))).otherwise(path)
        return F.coalesce(F.nullif(short, F.lit("")), F.lit("/"))

    def key(p: Column) -> Column:
        kept = F.filter(params(p["query"]), lambda x: ~is_tracking(x["name"]))
        return F.concat(
            p["scheme"], F.lit("://"), _userinfo(p), p["host"], _port_suffix(p),
            let(encoded_path(p["path"]), shorten), encode_params(F.array_sort(kept, _param_order)),
        )

    return let(parts(url), key)


def _masked_query(query: Column) -> Column:
    def mask_all(items: Column) -> Column:
        names = F.transform(items, lambda x: x["name"])
        # Redacting a repeated name leaves one of it.
        kept = F.filter(items, lambda x: ~is_secret(x["name"]) | (F.array_position(names, x["name"]) == x["idx"] + 1))
        masked = F.transform(
            kept,
            lambda x: F.struct(
                x["name"].alias("name"),
                F.when(is_secret(x["name"]), F.lit(C.URL_REDACTED)).otherwise(x["value"]).alias("value"),
            ),
        )
        return F.when(F.exists(names, is_secret), encode_params(masked)).otherwise(query)

    return let(params(query), mask_all)


def mask(url: Column) -> Column:
    """Copy of the URL fit for storage: no credentials, secret parameters redacted; unsplittable = unchanged."""

    def masked(p: Column) -> Column:
        return F.concat(
            p["scheme"], F.lit("://"), p["host"], _port_suffix(p), encoded_path(p["path"]), _masked_query(p["query"]),
            p["fragment"],
        )

    return F.coalesce(let(parts(url), masked), url)


def _random_token(segment: Column) -> Column:
    return (
        (F.length(segment) > 40)
        | segment.rlike("^[a-fA-F0-9]{16,}$")
        | (segment.rlike("^[A-Za-z0-9+/=_-]{32,}$") & ~segment.rlike("[a-z]-[a-z]"))
    )


def readable(url: Column) -> Column:
    """Lower-case, human path without session identifiers or random tokens; the root path always is."""

    def verdict(p: Column) -> Column:
        session = p["query"].rlike("(?i)[?&](?:" + "|".join(C.SESSION_PARAMS) + ")=")
        return let(
            encoded_path(p["path"]),
            lambda path: F.when(F.length(path) <= 1, F.lit(True))
            .when(path.rlike("[A-Z]") | session, F.lit(False))
            .otherwise(~F.exists(F.split(path, "/"), _random_token)),
        )

    return F.coalesce(let(parts(url), verdict), F.lit(False))


def is_https(url: Column) -> Column:
    return F.coalesce(parts(url)["scheme"] == "https", F.lit(False))


def blocked_hostname(host: Column) -> Column:
    return F.lower(host).isin(*C.BLOCKED_HOSTNAMES)


def _host_rejection(host: Column) -> Column:
    # A host whose last label is a number must be an IPv4 address.
    numeric = host.rlike(r"(?:^|\.)(?:[0-9]+|0[xX][0-9a-fA-F]*)$")
    return let(
        ips.parse_v4(host),
        lambda v4: F.when(v4.isNotNull(), ips.classify_v4(v4))
        .when(numeric, F.lit("invalid-url"))
        .when(blocked_hostname(host), F.lit("blocked-hostname")),
    )


def rejection(url: Column) -> Column:
    """Why a URL must not be fetched, NULL if it may be."""

    def screen(p: Column) -> Column:
        return (
            F.when(p.isNull(), F.lit("invalid-url"))
            .when(~p["userinfo"].isin("", ":"), F.lit("embedded-credentials"))
            .when(p["host"] == "", F.lit("invalid-url"))
            .when(F.startswith(p["host"], F.lit("[")), ips.classify_v6_text(F.regexp_replace(p["host"], r"^\[|\]$", "")))
            .otherwise(let(F.regexp_replace(p["host"], r"\.$", ""), _host_rejection))
        )

    scheme = F.lower(F.regexp_extract(_clean(url), "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return (
        F.when(F.coalesce(scheme, F.lit("")) == "", F.lit("invalid-url"))
        .when(~scheme.isin("http", "https"), F.lit("unsupported-protocol"))
        .otherwise(let(parts(url), screen))
    )
