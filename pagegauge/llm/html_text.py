"""Main text of web pages by composite text density.

A page is parsed into a tree, scripts and page furniture are taken out, and every element gets a density: characters per
tag, adjusted for the share of both that lies in links. The densities of an element's children are summed; the element
with the largest sum, and every one that does at least as well as the path from the body to it, is content.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# One tag, comment or declaration. Quantifiers are possessive, so a broken tag costs no second look.
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?|=)*+)>?",
    re.S,
)
_ATTR = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?", re.S)
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PIECES = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
# Markup of its own: a block ends it, and its tags may end themselves. Inner tags of the sheltered ones end nothing outside.
FOREIGN = frozenset(("svg", "math"))
SHELTERED = frozenset(("template", "noscript"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option select".split()
)
CLOSES_P = BLOCK - frozenset("body caption html legend option select tbody td tfoot th thead tr".split())
# A start tag of the key ends an open element of the value, not looking past the stops.
SAME = {
    "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("td", "th", "tr", "tbody", "thead"), "tfoot": ("td", "th", "tr", "tbody", "thead"),
}
STOPS = frozenset("ul ol dl table select menu dir html body td th".split())
P_STOPS = frozenset("table td th caption button object html body".split())
# Never part of an article, whatever they are called.
FURNITURE = frozenset("nav footer aside form head button select input label dialog menu svg template noscript annotation annotation-xml".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion promoted banner sidebar sidebars "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar cookie cookies consent gdpr notice "
    "notices alert newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations "
    "widget widgets skip hidden".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
KEEP = frozenset("html body article main".split())
_EPS = 1e-9


class _Tree:
    """Elements in page order, each after its parent; texts lie between them in ``flow``."""

    def __init__(self) -> None:
        self.tag, self.parent, self.attrs = ["html"], [-1], [""]
        self.flow: list[tuple[int, int, str]] = []  # (element, kind, text); kind 0 text, 1 block edge, 2 blank


def parse(page: str) -> _Tree:
    tree = _Tree()
    tags, parents, attrs, flow = tree.tag, tree.parent, tree.attrs, tree.flow
    stack, open_tags = [0], {"html": 1}

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            name = tags[stack.pop()]
            open_tags[name] -= 1
            if name in BLOCK:
                flow.append((stack[-1], 1, ""))

    def end(names, stops) -> None:
        """Closes the outermost open element of ``names`` above the first stop; of a single name only one can be open."""
        if not any(open_tags.get(n) for n in names):
            return
        found = None
        for depth in range(len(stack) - 1, 0, -1):
            name = tags[stack[depth]]
            if name in names:
                found = depth
                if len(names) == 1:
                    break
            elif name in stops:
                break
        if found is not None:
            pop_to(found)

    def text(piece: str) -> None:
        if piece:
            flow.append((stack[-1], 0, piece))

    last_ends: dict[str, int] = {}

    def ends_ahead(name: str) -> bool:
        if name not in last_ends:
            last_ends[name] = max((m.start() for m in re.finditer(rf"</{name}(?=[\s/>]|\Z)", page, re.I)), default=-1)
        return last_ends[name] >= at

    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TAG.match(page, lt)
        if m is None:
            following = page.find("<", lt + 1)
            following = size if following < 0 else following
            text(page[at:following])
            at = following
            continue
        text(page[at:lt])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in VOID or not open_tags.get(name):
                if name == "br":
                    flow.append((stack[-1], 2, ""))
                continue
            if name in ("html", "body"):
                continue
            stops = frozenset() if name in FOREIGN or name in SHELTERED else STOPS - {name} if name in ("li", "dd", "dt") else P_STOPS if name == "p" else frozenset() if name in BLOCK else BLOCK
            for depth in range(len(stack) - 1, 0, -1):
                here = tags[stack[depth]]
                if here == name:
                    pop_to(depth)
                    break
                if here in stops or here in SHELTERED:
                    break
            continue
        if name == "html" or (name == "body" and open_tags.get("body")):
            continue
        if name in BLOCK and not (open_tags.get("foreignobject") or open_tags.get("annotation-xml")):
            while open_tags.get("svg") or open_tags.get("math"):
                pop_to(len(stack) - 1)
        if name == "body" or (name in BLOCK and open_tags.get("head")):
            end(("head",), SHELTERED)
        if name in CLOSES_P and open_tags.get("p"):
            end(("p",), P_STOPS | SHELTERED)
        if name in SAME:
            stops = STOPS - set(SAME[name]) if name not in ("tr", "td", "th", "tbody", "tfoot") else frozenset(("table", "html", "body"))
            end(SAME[name], stops | SHELTERED)
        if name in SHELTERED and not ends_ahead(name):
            continue
        node = len(tags)
        tags.append(name), parents.append(stack[-1]), attrs.append(m[3])
        if name in BLOCK:
            flow.append((stack[-1], 1, ""))
        elif name == "br":
            flow.append((stack[-1], 2, ""))
        foreign = name in FOREIGN or open_tags.get("svg") or open_tags.get("math")
        if name in VOID or (m[3].endswith("/") and (name in RAW or name in SHELTERED or foreign)):
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if close is None:
                break
            gt = page.find(">", close.end())
            at = size if gt < 0 else gt + 1
            continue
        stack.append(node)
        open_tags[name] = open_tags.get(name, 0) + 1
    return tree


def _hints(attrs: str) -> tuple[bool, bool]:
    """Whether the attributes call an element furniture, and whether they call it reader comments."""
    hinted = False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            for one in value.split():
                pieces = [x.lower() for x in _PIECES.split(one)]
                if pieces[0] in ("has", "with", "no"):
                    continue
                if not COMMENTS.isdisjoint(pieces):
                    return True, True
                hinted = hinted or not HINTS.isdisjoint(pieces)
        elif name == "role":
            hinted = hinted or value.strip().lower() in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN_STYLE.search(value)):
            hinted = True
    return hinted, False


def furniture(tree: _Tree) -> list[bool]:
    """For each element whether it lies in a menu, header, footer, sidebar, notice, advert, form, script or comment list.

    Names alone do not take out an element that holds the article, a main heading or most of the page's text.
    """
    n = len(tree.tag)
    size = [0] * n
    for node, kind, piece in tree.flow:
        if kind == 0:
            size[node] += len(piece)
    holds = [False] * n
    for i in range(n - 1, 0, -1):
        size[tree.parent[i]] += size[i]
        if holds[i] or tree.tag[i] in ("article", "main", "h1"):
            holds[tree.parent[i]] = True
    out, in_article = [False] * n, [False] * n
    for i in range(1, n):
        tag, parent = tree.tag[i], tree.parent[i]
        in_article[i] = in_article[parent] or tag in ("article", "main")
        if out[parent] or tag in FURNITURE:
            out[i] = True
        elif tag in KEEP:
            out[i] = False
        elif tag == "header":
            out[i] = not in_article[parent]
        elif tree.attrs[i]:
            hinted, comments = _hints(tree.attrs[i])
            out[i] = hinted and not holds[i] and (comments or 2 * size[i] <= size[0])
    return out


def densities(tree: _Tree, out: list[bool]) -> tuple[list[float], list[float]]:
    """Composite text density and sum of the children's densities, per element."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
    for node, kind, piece in tree.flow:
        if kind == 0 and not out[node]:
            k = len(" ".join(piece.split()))
            chars[node] += k
            if in_link[node]:
                link_chars[node] += k
    for i in range(n - 1, 0, -1):
        if not out[i]:
            p = tree.parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + in_link[i]
    body = tree.tag.index("body") if "body" in tree.tag else 0
    share = link_chars[body] / max(1, chars[body])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
        if c and not out[i]:
            base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + share * c + math.e)
            density[i] = c / t * math.log(c * t / (lc * lt) + _EPS) / math.log(base + _EPS) if base > 1 + _EPS else c / t * math.log(c * t / (lc * lt) + 1)
        if i and not out[i]:
            sums[tree.parent[i]] += density[i]
    return density, sums


def content(tree: _Tree, out: list[bool]) -> list[bool]:
    """For each element whether it belongs to the main text."""
    n = len(tree.tag)
    density, sums = densities(tree, out)
    best_in = list(range(n))  # the element with the largest sum in each subtree
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if not out[i] and sums[best_in[i]] > sums[best_in[p]]:
            best_in[p] = best_in[i]
    # The article an element is part of, where the page names one; else the element itself.
    whole = list(range(n))
    for i in range(1, n):
        above = whole[tree.parent[i]]
        if tree.tag[above] == "article" or (tree.tag[above] == "main" and tree.tag[i] != "article"):
            whole[i] = above
    path, at = set(), best_in[0]
    while at != -1:
        path.add(at)
        at = tree.parent[at]
    threshold = min((density[i] for i in path if density[i] > 0), default=0.0)
    marked = [False] * n
    marked[whole[best_in[0]]] = True
    for i in range(1, n):
        if not out[i] and density[i] > 0 and density[i] >= threshold and tree.tag[i] in BLOCK and i not in path:
            marked[whole[best_in[i]]] = True
    inside = [False] * n
    for i in range(n):
        inside[i] = not out[i] and (marked[i] or (i > 0 and inside[tree.parent[i]]))
    return inside


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, joined by a blank line; empty for null or empty pages."""
    if not page:
        return ""
    tree = parse(page)
    out = furniture(tree)
    inside = content(tree, out)
    blocks, words = [], []
    for node, kind, piece in tree.flow:
        if kind == 1:
            if words:
                blocks.append("".join(words))
                words = []
        elif inside[node]:
            words.append(" " if kind == 2 else entities.unescape(piece) if "&" in piece else piece)
    blocks.append("".join(words))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(pages: DataFrame) -> DataFrame:
    """One row (page_id, url, text, n_chars) per page; ``n_chars`` counts code points.

    Null and empty pages give an empty text, pages without markup their whole text; null ids and urls and repeated rows stay
    as they are; other columns are ignored; an empty table gives no rows. Whole pages are parsed, one at a time.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
