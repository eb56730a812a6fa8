"""IP address columns: parsing every textual form and classifying the address range."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge.functions.binding import let


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _number(part: Column) -> Column:
    """Decimal, octal (leading 0) or hex (0x) number as BIGINT; NULL if malformed or far too large."""

    def convert(digits: Column, base: int, longest: int) -> Column:
        return let(digits, lambda d: F.when(F.length(d) <= longest, F.conv(F.concat(F.lit("0"), d), base, 10).cast("bigint")))

    zeros = F.lit("0")
    return (
        F.when(part.rlike("^0[xX][0-9a-fA-F]+$"), convert(F.ltrim(F.substring(part, F.lit(3), F.length(part)), zeros), 16, 9))
        .when(part.rlike("^0[0-7]+$"), convert(F.ltrim(part, zeros), 8, 12))
        .when(part.rlike("^(?:0|[1-9][0-9]{0,10})$"), part.try_cast("bigint"))
    )


def _pack(numbers: Column) -> Column:
    """Address value of 1 to 4 numbers; the last one fills the remaining bytes."""
    n = F.size(numbers)
    last = F.element_at(numbers, -1)
    head = sum(
        (F.when(n > k + 1, F.get(numbers, F.lit(k)) * _long(256 ** (3 - k))).otherwise(_long(0)) for k in range(3)),
        _long(0),
    )
    room = F.when(n == 1, _long(256**4)).when(n == 2, _long(256**3)).when(n == 3, _long(256**2)).otherwise(_long(256))
    leading_fit = F.forall(F.slice(numbers, F.lit(1), n - 1), lambda x: x <= 255)
    fits = n.between(1, 4) & F.forall(numbers, lambda x: x.isNotNull())
    return F.when(fits, F.when(leading_fit & (last < room), head + last))


def parse_v4(host: Column) -> Column:
    """IPv4 address as a BIGINT from 1 to 4 dotted parts, NULL if it is none."""
    return let(F.transform(F.split(host, r"\."), _number), _pack)


def dotted(address: Column) -> Column:
    """Dotted-quad text of a parsed IPv4 address."""
    return F.concat_ws(".", *[(F.shiftright(address, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])


def classify_v4(address: Column) -> Column:
    """Blocked range of an IPv4 address, NULL if it is public."""

    def verdict(value: Column) -> Column:
        a, b = F.shiftright(value, 24), F.shiftright(value, 16).bitwiseAND(F.lit(255))
        return (
            F.when(a == 0, F.lit("reserved-ip"))
            .when(a == 127, F.lit("loopback-ip"))
            .when(a == 10, F.lit("private-ip"))
            .when((a == 172) & b.between(16, 31), F.lit("private-ip"))
            .when((a == 192) & (b == 168), F.lit("private-ip"))
            .when((a == 100) & b.between(64, 127), F.lit("private-ip"))
            .when((a == 169) & (b == 254), F.lit("link-local"))
            .when(a >= 224, F.lit("reserved-ip"))
        )

    return let(address, verdict)


_V4_TAIL = r":([^:]*\.[^:]*)$"


def _with_hex_tail(host: Column) -> Column:
    """Rewrite a dotted tail as two hex groups; NULL if the tail is no IPv4 address."""

    def rewrite(v4: Column) -> Column:
        high, low = F.hex(F.shiftright(v4, 16)), F.hex(v4.bitwiseAND(F.lit(65535)))
        return F.concat(F.regexp_replace(host, _V4_TAIL, ":"), high, F.lit(":"), low)

    return F.when(host.rlike(_V4_TAIL), let(parse_v4(F.regexp_extract(host, _V4_TAIL, 1)), rewrite)).otherwise(host)


def _groups(half: Column) -> Column:
    return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))


def _expand(halves: Column) -> Column:
    def fill(sides: Column) -> Column:
        missing = F.lit(8) - F.size(sides["head"]) - F.size(sides["tail"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), missing))
        return F.when(missing > 0, F.concat(sides["head"], zeros, sides["tail"]))

    sides = F.struct(
        _groups(F.get(halves, F.lit(0))).alias("head"), _groups(F.get(halves, F.lit(1))).alias("tail")
    )
    return F.when(F.size(halves) == 2, let(sides, fill)).when(F.size(halves) == 1, F.split(F.get(halves, F.lit(0)), ":"))


def parse_v6(host: Column) -> Column:
    """IPv6 address as eight 16-bit groups (``array<int>``), NULL if malformed."""

    def values(parts: Column) -> Column:
        group = lambda g: F.when(g.rlike("^[0-9a-fA-F]{1,4}$"), F.conv(g, 16, 10).cast("int"))
        return F.when(F.size(parts) == 8, F.transform(parts, group))

    def whole(groups: Column) -> Column:
        return F.when(F.forall(groups, lambda g: g.isNotNull()), groups)

    return let(let(let(F.split(_with_hex_tail(host), "::"), _expand), values), whole)


def expanded(groups: Column) -> Column:
    """Full textual form of parsed groups, eight four-digit hex groups."""
    return F.array_join(F.transform(groups, lambda g: F.lpad(F.lower(F.hex(g)), 4, "0")), ":")


def classify_v6(groups: Column) -> Column:
    """Blocked range of an IPv6 address, NULL if it is public."""

    def verdict(value: Column) -> Column:
        g = lambda i: F.get(value, F.lit(i))
        zero = lambda n: F.forall(F.slice(value, 1, n), lambda x: x == 0)
        masked = lambda bits: g(0).bitwiseAND(F.lit(bits))
        return (
            F.when(zero(7) & (g(7) == 1), F.lit("loopback-ip"))
            .when(zero(8), F.lit("reserved-ip"))
            .when(zero(5) & (g(5) == 0xFFFF), classify_v4(g(6).cast("bigint") * _long(65536) + g(7)))
            .when(masked(0xFFC0) == 0xFE80, F.lit("link-local"))
            .when(masked(0xFE00) == 0xFC00, F.lit("private-ip"))
            .when(masked(0xFF00) == 0xFF00, F.lit("reserved-ip"))
        )

    return let(groups, verdict)


def _or_invalid(parsed: Column, classify) -> Column:
    return let(parsed, lambda p: F.when(p.isNull(), F.lit("invalid-url")).otherwise(classify(p)))


def classify_v6_text(host: Column) -> Column:
    return _or_invalid(parse_v6(host), classify_v6)


def classify(ip: Column) -> Column:
    """Blocked range of a literal address (brackets optional); malformed = ``invalid-url``, public = NULL."""
    bare = F.when(F.startswith(ip, F.lit("[")) & F.endswith(ip, F.lit("]")), F.substring(ip, F.lit(2), F.length(ip) - 2)).otherwise(ip)
    return let(
        bare,
        lambda b: F.when(F.contains(b, F.lit(":")), classify_v6_text(b)).otherwise(_or_invalid(parse_v4(b), classify_v4)),
    )
