"""Redaction of event and log rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge import constants as C

_MEMBERS = "map<string,variant>"
# Members that go, by the object that holds them.
DROPPED = {"user": ("ip_address", "email", "username"), "request": ("cookies", "data")}


def hide(values: Column, names: tuple[str, ...]) -> Column:
    """Map with the values of the given keys replaced, whatever their case."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).isin(*names), F.lit(C.EVENT_REDACTED)).otherwise(v))


def _members(value: Column) -> Column:
    return F.from_json(F.to_json(value), _MEMBERS)


def _object(members: Column) -> Column:
    return F.parse_json(F.to_json(members))


def redact_event(event_json: Column) -> Column:
    """Event JSON without user identity, cookies and body; credential headers and query string hidden.

    All other members stay, at every level. Members of nested objects come out in the order of their names. A member that is
    not the object it should be is dropped if it could hold what is hidden (headers, user, request), text that is no JSON
    object gives null.
    """
    hidden = F.parse_json(F.lit(f'"{C.EVENT_REDACTED}"'))

    def scrub_request(k: Column, v: Column) -> Column:
        headers = F.transform_values(_members(v), lambda name, x: F.when(F.lower(name).isin(*C.PII_HEADERS), hidden).otherwise(x))
        return F.when(k == "headers", _object(headers)).when((k == "query_string") & (F.schema_of_variant(v) != "VOID"), hidden).otherwise(v)

    def scrub(k: Column, v: Column) -> Column:
        user, request = (F.map_filter(_members(v), lambda m, _: ~m.isin(*DROPPED[name])) for name in ("user", "request"))
        return F.when(k == "user", _object(user)).when(k == "request", _object(F.transform_values(request, scrub_request))).otherwise(v)

    return F.to_json(F.transform_values(F.from_json(event_json, _MEMBERS), scrub))


# Log paths that are hidden.
REQUEST_HEADERS = ("authorization", "cookie")
RESPONSE_HEADERS = ("set-cookie",)
SECRET_FIELDS = ("password", "token", "apiKey")


def redact_record(record: Column) -> Column:
    """Log record ``map<string,map<string,string>>`` (member -> its fields) with secrets hidden.

    Request and response headers are the members ``req.headers`` and ``res.headers``; of any other member
    the password, token and apiKey fields are hidden. Names are matched exactly.
    """

    def by_member(member: Column, fields: Column) -> Column:
        def hidden(k: Column) -> Column:
            return (
                F.when(member == "req.headers", k.isin(*REQUEST_HEADERS))
                .when(member == "res.headers", k.isin(*RESPONSE_HEADERS))
                .otherwise(k.isin(*SECRET_FIELDS))
            )

        return F.transform_values(fields, lambda k, v: F.when(hidden(k), F.lit(C.EVENT_REDACTED)).otherwise(v))

    return F.transform_values(record, by_member)
