"""Fetch safety as table jobs: screening URLs, judging resolved hosts, following redirect edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import ips
from pagegauge.functions import urls as U
from pagegauge.functions.binding import let
from pagegauge.operators.skew import spread_join
from pagegauge.session import written

# What a caller is told for each failure class; classes that are not listed count as unreachable.
_REFUSED = "Pages at this address are not graded."
MESSAGES = {
    "blocked-host": _REFUSED,
    "invalid-url": _REFUSED,
    "dns-failed": "No address is known for the host name.",
    "too-many-redirects": "The address forwards again and again.",
    "response-too-large": "The answer is larger than the limit.",
    "timeout": "No answer came in time.",
}
HTTP_ERROR = "The server answered with an error."
HTTP_STATUS = "The server answered with status "
UNREACHABLE = "The server gave no answer."


def validate(urls: DataFrame, column: str = "url") -> DataFrame:
    """Add ``ok`` and ``reason`` to a URL table."""
    return urls.withColumn("reason", U.rejection(F.col(column))).withColumn("ok", F.col("reason").isNull())


def host_verdicts(hosts: DataFrame, host_ips: DataFrame) -> DataFrame:
    """(host, verdict, blocked_ip): dns-failed without a record, blocked-host if any record is not public.

    Literal addresses need no record and are judged themselves. ``hosts`` may repeat a host; the result has one row per host.
    """
    distinct = hosts.select("host").distinct()
    blocked = let(ips.classify(F.col("ip")), lambda reason: reason.isNotNull())
    judged = host_ips.groupBy("host").agg(
        F.min(F.when(blocked, F.col("ip"))).alias("blocked_ip"),
        F.count("ip").alias("records"),
    )
    own = F.col("own")
    verdict = (
        F.when(own.isNull(), F.lit("ok"))
        .when(own != "invalid-url", F.lit("blocked-host"))
        .when(F.coalesce("records", F.lit(0)) == 0, F.lit("dns-failed"))
        .when(F.col("blocked_ip").isNotNull(), F.lit("blocked-host"))
        .otherwise(F.lit("ok"))
    )
    # The class of the host as an address; a name is no address ("invalid-url"), whatever letters it is made of.
    joined = distinct.join(judged, "host", "left").withColumn("own", ips.classify(F.col("host"))).withColumn("verdict", verdict)
    shown = F.when(F.col("verdict") == "blocked-host", F.when(own == "invalid-url", F.col("blocked_ip")).otherwise(F.col("host")))
    return joined.select("host", "verdict", shown.alias("blocked_ip"))


def _refused(url: Column) -> Column:
    return let(
        U.rejection(url),
        lambda reason: F.when(reason == "invalid-url", reason).when(reason.isNotNull(), F.lit("blocked-host")),
    )


def _further(walks: DataFrame, others: DataFrame) -> DataFrame:
    """Each walk (at, end, hops, reason) followed by the walk that starts at its end, unless it was refused there.

    ``mid`` is where the second walk's first hop leads. Many walks may end in one address, so each address is met in parts.
    """
    second = others.select(
        F.col("at").alias("end"), F.col("end").alias("_end"), F.col("hops").alias("_hops"), F.col("reason").alias("_reason"), F.col("first").alias("mid")
    )
    open_ended = walks.where("reason is null")
    moved = spread_join(open_ended, second, ["end"], ["at"], how="left")
    on = F.col("_hops").isNotNull()
    joined = moved.select(
        "at", "first", F.when(on, F.col("_end")).otherwise(F.col("end")).alias("end"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
        F.col("_reason").alias("reason"), "mid",
    )
    ended = walks.where("reason is not null").select("at", "first", "end", "hops", "reason", F.lit(None).cast("string").alias("mid"))
    return joined.unionByName(ended)


def resolve_redirects(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """Follow redirect edges from ``url``: adds ``final_url``, ``hops`` and ``reason``.

    Every address on the way is screened; a sixth hop fails and leaves the address after the fifth. Of several edges from one
    address the smallest counts. The screened edges double, to walks of two and four hops, and four and two make six; so the
    starts, which may be many more, are joined once.
    """
    one = edges.where(F.col("to_url").isNotNull()).groupBy(F.col("from_url").alias("at")).agg(F.min("to_url").alias("end"))
    one = written(one.select("at", "end", F.lit(1).alias("hops"), _refused(F.col("end")).alias("reason"), F.col("end").alias("first")), "hops-1")
    two = written(_further(one, one).drop("mid"), "hops-2")
    four = written(_further(two, two).drop("mid"), "hops-4")
    six = _further(four, two)
    failed = F.col("hops") > C.MAX_REDIRECTS
    walks = six.select(
        F.col("at").alias("url"), F.when(failed, F.col("mid")).otherwise(F.col("end")).alias("_final"), F.col("hops").alias("_hops"),
        F.when(failed, "too-many-redirects").otherwise(F.col("reason")).alias("_reason"),
    )
    screened = starts.withColumn("reason", _refused(F.col("url")))
    done = spread_join(screened, written(walks, "walks"), ["url"], [c for c in starts.columns if c != "url"] or ["url"], how="left")
    walked = F.col("reason").isNull() & F.col("_hops").isNotNull()
    return done.select(
        *starts.columns, F.when(walked, F.col("_final")).otherwise(F.col("url")).alias("final_url"), F.when(walked, F.col("_hops")).otherwise(0).alias("hops"),
        F.when(walked, F.col("_reason")).otherwise(F.col("reason")).alias("reason"),
    )


def failure_class(reason: Column, status: Column) -> tuple[Column, Column]:
    """(permanent, public message) of a failed fetch."""
    client_error = F.coalesce((reason == "http-error") & status.between(400, 499), F.lit(False))
    message = F.lit(UNREACHABLE)
    chain = F.when(reason == "http-error", F.when(status.isNotNull(), F.concat(F.lit(HTTP_STATUS), status.cast("string"), F.lit("."))).otherwise(HTTP_ERROR))
    for name, sentence in MESSAGES.items():
        chain = chain.when(reason == name, sentence)
    return reason.isin("invalid-url", "blocked-host") | client_error, chain.otherwise(message)
