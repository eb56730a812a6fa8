"""The element tree of a page: where each element ends and which element holds each token.

One pass over the tags of a page with a stack of open elements, in a task-side Arrow function: a start tag opens, an end tag
closes the innermost element of its name that is in reach with everything open inside it, some start tags end elements that
leave their end tags out, and the page closes what is left. Every step looks up the innermost place of a few names, so the
pass is linear in the tags however deep they nest.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegauge import constants as C

_LABEL, _BOILER, _TEMPLATE = 1, 2, 4
_INSIDE = {"label": _LABEL, "template": _TEMPLATE} | dict.fromkeys(C.BOILERPLATE_TAGS, _BOILER)
PLACES = ("close_pos", "parent", "level", "inside")
_SPECIAL, _SCOPE, _VOID = frozenset(C.SPECIAL_TAGS), frozenset(C.SCOPE_TAGS), frozenset(C.VOID_TAGS)
_FOREIGN = ("svg", "math")


def _start_rules() -> dict[str, tuple[frozenset, frozenset]]:
    """For start tags that end other elements: what they end, and what they do not reach out of."""
    scope = _SCOPE | {"button"}
    rules = {tag: (frozenset({"p"}), scope) for tag in C.PARAGRAPH_ENDING_TAGS}
    headings = frozenset(C.HEADING_TAGS)
    rules |= {tag: (headings | {"p"}, _SPECIAL - headings - {"p"}) for tag in C.HEADING_TAGS}
    loose = frozenset({"address", "div", "p"})
    rules["li"] = (frozenset({"li", "p"}), _SPECIAL - loose - {"li"})
    rules |= {tag: (frozenset({"dd", "dt", "p"}), _SPECIAL - loose - {"dd", "dt"}) for tag in ("dd", "dt")}
    rules["option"] = (frozenset({"option"}), _SPECIAL)
    rules["optgroup"] = (frozenset({"option", "optgroup"}), _SPECIAL)
    rules["a"] = (frozenset({"a"}), _SCOPE)
    rules["button"] = (frozenset({"button"}), _SCOPE)
    rows, cells, table = frozenset({"tr"}), frozenset({"td", "th"}), frozenset({"table", "template", "html"})
    rules |= {tag: (cells, table | rows) for tag in cells}
    rules["tr"] = (rows | cells | {"caption", "colgroup"}, table)
    rules |= {tag: (rows | cells | {"caption", "colgroup"} | frozenset(C.TABLE_SECTION_TAGS), table) for tag in C.TABLE_SECTION_TAGS}
    return rules


_STARTS = _start_rules()


def _end_rule(tag: str) -> tuple[frozenset, frozenset]:
    """What the end tag closes, and what it does not reach out of."""
    own = frozenset({tag})
    if tag in C.HEADING_TAGS:
        return frozenset(C.HEADING_TAGS), _SCOPE
    if tag in ("body", "html"):
        return own, frozenset()
    if tag in ("table", "caption", "tr", "td", "th", *C.TABLE_SECTION_TAGS):
        return own, frozenset({"table", "template", "html"}) - own
    if tag == "li":
        return own, _SCOPE | {"ol", "ul"}
    if tag == "p":
        return own, _SCOPE | {"button"}
    return own, (_SCOPE if tag in _SPECIAL else _SPECIAL) - own


def nodes(marks: list[str | None]) -> tuple[list[int], list[int], list[int], list[int]]:
    """For each token: close, parent, level and the marks of what it is inside of, itself included.

    ``marks`` has ``<name`` for a start tag (``<name/`` if it closes itself), ``>name`` for an end tag, ``!name`` for an element
    that is one token, and None or "" for text. ``close`` is the token that ends an element (its own number for elements
    without content, the number of tokens where the page ends it) and -1 for other tokens; ``parent`` is the start tag of
    the innermost open element, -1 at the top; ``level`` counts the open elements.
    """
    n = len(marks)
    close, parent, level, inside = [-1] * n, [-1] * n, [0] * n, [0] * n
    stack: list[tuple[int, str, int]] = []  # token, name, marks of everything open
    places: dict[str, list[int]] = {}  # of each name that is open, its places on the stack
    ends: dict[str, tuple[frozenset, frozenset]] = {}

    def barrier(names) -> int:
        # A page has fewer different tags than the longer of these sets.
        if len(places) < len(names):
            return max((p[-1] for name, p in places.items() if p and name in names), default=-1)
        return max((p[-1] for name in names if (p := places.get(name))), default=-1)

    def cut(down_to: int, at: int) -> None:
        while len(stack) > down_to:
            pos, name, _ = stack.pop()
            places[name].pop()
            close[pos] = at

    for at, mark in enumerate(marks):
        kind = mark[0] if mark else ""
        if kind == ">":
            name = mark[1:]
            rule = ends.get(name)
            if rule is None:
                rule = ends[name] = _end_rule(name)
            place = barrier(rule[0])
            if place >= 0 and place > barrier(rule[1]):
                cut(place, at)
        elif kind == "<":
            name = mark[1:].rstrip("/")
            rule = _STARTS.get(name)
            if rule is not None:
                above = barrier(rule[1])
                outermost = [p[k] for other in rule[0] if (p := places.get(other)) and (k := bisect_right(p, above)) < len(p)]
                if outermost:
                    cut(min(outermost), at)
        if stack:
            parent[at], level[at], inside[at] = stack[-1][0], len(stack), stack[-1][2]
        if kind == "!" or (kind == "<" and (name in _VOID or (mark[-1] == "/" and any(places.get(f) for f in _FOREIGN)))):
            close[at] = at
        elif kind == "<":
            inside[at] |= _INSIDE.get(name, 0)
            places.setdefault(name, []).append(len(stack))
            stack.append((at, name, inside[at]))
    cut(0, n)
    return close, parent, level, inside


def _trees(marks: pa.Array) -> pa.Array:
    flat: list[list[int]] = [[], [], [], []]
    offsets = np.zeros(len(marks) + 1, dtype=np.int32)
    for i, page in enumerate(marks):
        listed = page.as_py() or []
        for column, values in zip(flat, nodes(listed), strict=True):
            column += values
        offsets[i + 1] = offsets[i] + len(listed)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(c, pa.int32())) for c in flat], names=list(PLACES))


def mark(tok: Column, tag: Column, kind: Column) -> Column:
    """What the tree needs to know of a token (see ``nodes``)."""
    slash = F.when(F.endswith(tok, F.lit("/>")), "/").otherwise("")
    return F.when(kind == "open", F.concat(F.lit("<"), tag, slash)).when(kind == "close", F.concat(F.lit(">"), tag)).when(
        kind.isin("script", "style", "rawtext"), F.concat(F.lit("!"), tag)
    )


def trees(marks: Column) -> Column:
    """struct of arrays (``PLACES``), one entry per token, of the marks of a page; empty arrays for NULL."""
    return F.arrow_udf(_trees, "struct<" + ",".join(f"{c}:array<int>" for c in PLACES) + ">")(marks)


def in_label(inside: Column) -> Column:
    return inside.bitwiseAND(F.lit(_LABEL)) != 0


def in_boilerplate(inside: Column) -> Column:
    return inside.bitwiseAND(F.lit(_BOILER)) != 0


def in_template(inside: Column) -> Column:
    return inside.bitwiseAND(F.lit(_TEMPLATE)) != 0
