"""The element tree against a plain stack parser, rule by rule, and on pages of every shape."""

import random
import time

import pytest
from pyspark.sql import functions as F

from pagegauge import constants as C
from pagegauge.functions import tree
from pagegauge.operators import structure

SPECIAL, SCOPE = set(C.SPECIAL_TAGS), set(C.SCOPE_TAGS)
TABLE = {"table", "template", "html"}
PARTS = {"tr", "td", "th", "caption", "colgroup"}


def reach(open_names, barriers):
    """Places above the innermost barrier, from the top of the stack down."""
    for place in range(len(open_names) - 1, -1, -1):
        if open_names[place] in barriers:
            return
        yield place


def plain(marks):
    """(close, parent, level) by walking the whole stack at every tag."""
    stack, out = [], [[-1, -1, 0] for _ in marks]

    def cut(place, at):
        while len(stack) > place:
            out[stack.pop()[0]][0] = at

    for at, mark in enumerate(marks):
        names = [n for _, n in stack]
        if mark and mark[0] == ">":
            name = mark[1:]
            if name in C.HEADING_TAGS:
                closes, barriers = set(C.HEADING_TAGS), SCOPE
            elif name in ("body", "html"):
                closes, barriers = {name}, set()
            elif name in PARTS - {"colgroup"} | {"table", "tbody", "thead", "tfoot"}:
                closes, barriers = {name}, TABLE - {name}
            elif name == "li":
                closes, barriers = {name}, SCOPE | {"ol", "ul"}
            elif name == "p":
                closes, barriers = {name}, SCOPE | {"button"}
            else:
                closes, barriers = {name}, (SCOPE if name in SPECIAL else SPECIAL) - {name}
            cut(next((p for p in reach(names, barriers - closes) if names[p] in closes), len(stack)), at)
        elif mark and mark[0] == "<":
            name = mark[1:].rstrip("/")
            ends, barriers = set(), set()
            if name in C.HEADING_TAGS:
                ends, barriers = {"p", *C.HEADING_TAGS}, SPECIAL - {"p", *C.HEADING_TAGS}
            elif name == "li":
                ends, barriers = {"li", "p"}, SPECIAL - {"address", "div", "p", "li"}
            elif name in ("dd", "dt"):
                ends, barriers = {"dd", "dt", "p"}, SPECIAL - {"address", "div", "p", "dd", "dt"}
            elif name in ("option", "optgroup"):
                ends, barriers = {"option", name}, SPECIAL
            elif name in ("a", "button"):
                ends, barriers = {name}, SCOPE - {name}
            elif name in ("td", "th"):
                ends, barriers = {"td", "th"}, TABLE | {"tr"}
            elif name == "tr":
                ends, barriers = PARTS, TABLE
            elif name in ("tbody", "thead", "tfoot"):
                ends, barriers = PARTS | {"tbody", "thead", "tfoot"}, TABLE
            elif name in C.PARAGRAPH_ENDING_TAGS:
                ends, barriers = {"p"}, SCOPE | {"button"}
            above = [p for p in reach(names, barriers - ends) if names[p] in ends]
            # A barrier that is itself ended does not occur in a rule.
            cut(min(above, default=len(stack)), at)
        if stack:
            out[at][1:] = [stack[-1][0], len(stack)]
        if mark and mark[0] == "!":
            out[at][0] = at
        elif mark and mark[0] == "<":
            foreign = mark.endswith("/") and any(n in ("svg", "math") for _, n in stack)
            if name in C.VOID_TAGS or foreign:
                out[at][0] = at
            else:
                stack.append((at, name))
    cut(0, len(marks))
    return out


def random_page(rng, n):
    names = [*SPECIAL, "span", "b", "a", "option", "optgroup", "svg", "path/", "br", "hr", "em", "label", "custom-tag", "p", "li", "div", "section", "td", "tr"]
    pick = lambda: rng.choice(names)
    return [rng.choice([None, "<" + pick(), "<" + pick(), ">" + pick().rstrip("/"), ">" + pick().rstrip("/"), "!script"]) for _ in range(n)]


def test_against_a_plain_stack_parser():
    rng = random.Random(2)
    for _ in range(1500):
        marks = random_page(rng, rng.randint(0, 60))
        close, parent, level, _ = tree.nodes(marks)
        assert [list(x) for x in zip(close, parent, level)] == plain(marks), marks


@pytest.mark.parametrize("html, tag, below", [
    ("<div><section>a</div><p>tail", "section", "a"),
    ("<section>x<div><section>a</div>y</section>z", "section", "xay"),
    ("<main><div><article>a</main>b", "article", "a"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "li", "a"),
    ("<p>one<div>two</div>three", "p", "one"),
    ("<p>one<span>two</span>three<p>four", "p", "onetwothree"),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", "tr", "ab"),
    ("<div><table><tr><td>a</div>b</table>c</div>d", "div", "abc"),
    ("<span>a<div>b</span>c</div>d", "span", "abcd"),
    ("<label>Name <input><div>x</label>y", "label", "Name xy"),
    ("<main>a<br/>b<hr/>c</main>d", "main", "abc"),
    ("<svg><g><path/><path/></g></svg><main>a</main>b", "main", "a"),
    ("<h1>a<h2>b</h1>c", "h1", "a"),
    ("<nav>a", "nav", "a"),
    ("</div></p>a<section>b", "section", "b"),
])
def test_text_below_the_first_element_of_a_name(spark, html, tag, below):
    captures = spark.createDataFrame([(1, html, html)], "page_id bigint, raw_html string, rendered_html string")
    rows = structure.elements(captures).where(F.col("tag") == tag).orderBy("pos").collect()
    tokens = {r["pos"]: r["tok"] for r in structure.tokens(captures).where("kind = 'text'").collect()}
    assert "".join(tokens[p] for p in sorted(tokens) if rows[0]["pos"] < p < rows[0]["close_pos"]) == below


def test_intervals_nest_and_parents_hold_their_children(spark, sf_dir):
    from workload.inputs import Tables

    rows = structure.elements(Tables(spark, sf_dir).captures())
    outer = rows.select("page_id", F.col("pos").alias("parent"), F.col("close_pos").alias("p_close"), F.col("level").alias("p_level"))
    inner = rows.join(outer, ["page_id", "parent"])
    assert inner.count() == rows.where("parent is not null").count() > 0
    assert inner.where("not (pos > parent and close_pos <= p_close and level = p_level + 1)").count() == 0
    assert rows.where("parent is null and level <> 0 or close_pos < pos").count() == 0


def test_time_is_linear_however_deep():
    start = time.time()
    for marks in (["<div"] * 200_000, ["<div", "<p"] * 100_000, ["<li"] * 200_000, ["<b"] * 100_000 + [">i"] * 100_000, ["<ul", "<li"] * 50_000 + [">div"] * 100_000):
        assert len(tree.nodes(marks)[0]) == 200_000
    assert time.time() - start < 20


def test_empty_and_null_pages(spark):
    captures = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "plain text", "plain text")], "page_id bigint, raw_html string, rendered_html string")
    assert structure.elements(captures).count() == 0
    assert [r["page_id"] for r in structure.page_documents(captures).orderBy("page_id").collect()] == [1, 2, 3]
    assert structure.text_nodes(captures).collect() == [(3, 0, "plain text")]
