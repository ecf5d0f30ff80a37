"""HTML main text by minimum cut: each block of a page is content or boilerplate, and neighbours want to agree."""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_content long, n_swayed long"

# HTML element names by what they do to text.
RAW = {"script", "style", "template", "iframe", "noembed", "noframes", "noscript", "svg"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "br", "wbr", "img"}
MATHS = {"mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mspace", "mstyle", "semantics"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "nav", "aside", "header", "footer", "select", "blockquote"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
#: What an element's own kind costs the content side. A header inside an article holds its heading and costs nothing.
CHROME = dict.fromkeys("nav footer aside form button select option textarea menu dialog title head input header".split(), 500)
#: Roles that say the same of any element.
ROLES = dict.fromkeys("navigation contentinfo complementary banner search dialog alertdialog form menu menubar".split(), 500)
#: What words of class and id values cost the content side: words that hardly name anything else, and ambiguous ones.
NAMES = dict.fromkeys(
    "ad ads advert adverts advertisement advertisements advertising breadcrumb breadcrumbs cookie cookies consent gdpr disqus masthead navbar newsletter notice notices pager pagination "
    "popup modal overlay promo promoted sidebar sponsor sponsored subscribe subscription signup login toolbar".split(), 400
) | dict.fromkeys("alert aside banner copyright disclaimer footer header legal menu nav navigation recommended recommendations related respond search share sharing skip social tags teaser widget".split(), 160)
#: From this cost on a word hardly names anything else.
STRONG = 400
COMMENTS = {"comment", "comments", "reply", "replies"}
#: Names that are readers' comments only beside a word for readers, and headings that open them.
TALK, READERS = {"discussion", "discussions", "feedback", "response", "responses", "thread", "threads"}, {"community", "public", "reader", "readers", "user", "users", "visitor", "visitors"}
_TALK_HEAD = re.compile(r"(?i)(?:[\d,]+|no)\s+(?:comments?|replies|responses)|(?:reader |user )?comments?\s*(?:\(\d+\))?|leave a (?:comment|reply)|join the (?:discussion|conversation)")
#: Headings that a list of links belongs to.
_LIST_HEAD = re.compile(r"(?i)\W*(?:sources?|references?|citations?|notes|footnotes|bibliography|further reading|works cited|external links)\W*")
GOOD = {"article", "articlebody", "body", "content", "entry", "main", "page", "post", "story", "text"}
#: Parts of a name that make it tell a state of something else ("has-sidebar", "menu-open").
STATES = {"has", "with", "without", "no", "not", "is", "open", "closed", "on", "off", "enabled", "disabled", "active"}

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|$)|<[!?][^>]*+(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|$)|'[^']*+(?:'|$))?)*+)(>|$)""", re.S)
_NAMES = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]+))?""")
#: Names come apart at signs, and where a capital follows a small letter ("cookieBanner").
_PART = re.compile(r"[\s_:.-]+|(?<=[a-z0-9])(?=[A-Z])")
_STOP = re.compile(r"[.!?。！？…]")
_ends: dict[str, re.Pattern] = {}


@dataclass
class Node:
    """An element that bounds blocks; `cost` is what its kind and its ancestors' kinds say against content, `named` what its own name says."""

    parent: int
    depth: int
    name: str
    cost: int = 0
    named: int = 0
    comments: bool = False
    main: bool = False
    good: bool = False
    heading: bool = False
    chars: int = 0


@dataclass
class Block:
    """A run of text between block boundaries: its element, how much of it is linked, and how many words it has."""

    text: str
    node: int
    linked: int
    words: int = field(init=False)

    def __post_init__(self) -> None:
        self.words = len(self.text.split())


def named(told: str) -> tuple[int, bool, bool]:
    """(cost to the content side, names comments, names content) of class and id values.

    A word counts in full where it is a whole name or its last part ("cookie-notice"), at 0.6 where it is the first ("share-buttons", "cookieBanner");
    one that hardly names anything else so within a longer name too ("google_ads_iframe"), unless that names content. A name that tells a
    state ("has-sidebar") says nothing. A discussion is of readers where the name says so ("user-discussion").
    """
    cost, comments, good = 0, False, False
    for token in told.split():
        parts = [x.lower() for x in _PART.split(token) if x]
        if not parts or STATES.intersection(parts):
            continue
        within = [] if GOOD.intersection(parts) else [c for x in parts[1:-1] if (c := NAMES.get(x, 0)) >= STRONG]
        cost = max(cost, NAMES.get(parts[-1], 0), *(c * 6 // 10 for c in within), NAMES.get(parts[0], 0) * 6 // 10 if len(parts) > 1 else 0)
        comments |= parts[-1] in COMMENTS or parts[0] in COMMENTS or bool(TALK.intersection(parts) and READERS.intersection(parts))
        good |= parts[-1] in GOOD
    return cost, comments, good


def parsed(page: str) -> tuple[list[Block], list[Node]]:
    """The text blocks of a page in its order, and its elements. Unclosed and misnested ones are closed as browsers do, near enough."""
    nodes = [Node(0, 0, "")]
    stack, standing = [0], {"": 1}  # open elements, and how many of each name
    out: list[Block] = []
    part: list[tuple[str, bool]] = []
    links = at = 0

    def flush() -> None:
        text = " ".join("".join(t for t, _ in part).split())
        if text:
            out.append(Block(text, stack[-1], sum(len(t.strip()) for t, in_link in part if in_link)))
        part.clear()

    def say(text: str) -> None:
        if text:
            part.append((html.unescape(text), links > 0))

    def close(k: int) -> None:
        for x in stack[k:]:
            standing[nodes[x].name] -= 1
        del stack[k:]

    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name or not m[4]:
            continue
        if m[1]:  # an end tag
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE or name in VOID or name in MATHS:
                continue
            flush()
            if standing.get(name):
                close(next(k for k in range(len(stack) - 1, 0, -1) if nodes[stack[k]].name == name))
            continue
        if name in RAW:
            end = _ends.setdefault(name, re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|$)", re.I)).search(page, at)
            if not m[3].rstrip().endswith("/") or name != "svg":
                at = end.end() if end else len(page)
            continue
        if name == "br":
            part.append((" ", False))
        if name == "a":
            links += 1
        if name in INLINE or name in MATHS or name in VOID - {"hr"}:
            continue
        flush()
        links = 0
        ends = {"p"} if name in CLOSES_P else SAME[name] | {"p"} if name in SAME else set()
        if any(standing.get(x) for x in ends):
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].name in ends:
                    close(k)
                elif nodes[stack[k]].name in SCOPE:
                    break
        if name in VOID:
            continue
        nodes.append(_opened(name, m[3], stack[-1], nodes))
        stack.append(len(nodes) - 1)
        standing[name] = standing.get(name, 0) + 1
    say(page[at:])
    flush()
    return out, nodes


def _opened(name: str, attributes: str, parent: int, nodes: list[Node]) -> Node:
    up = nodes[parent]
    names = {a[0].lower(): a[1].strip("\"'") for a in _NAMES.findall(attributes)}
    hidden = "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in names.get("style", "").replace(" ", "")
    cost, comments, good = named(names.get("class", "") + " " + names.get("id", "")) if name not in ("body", "html") else (0, False, False)
    role = names.get("role", "").lower()
    kind = max(CHROME.get(name, 0), ROLES.get(role, 0)) if not (name == "header" and up.main) else 0
    main = name in MAIN or role == "main"
    return Node(parent, up.depth + 1, name, max(up.cost, kind, 1200 if hidden else 0), cost, up.comments or comments, main or up.main, good or up.good, name in HEADINGS or up.heading)


def _talk(found: list[Block], nodes: list[Node]) -> set[int]:
    """Blocks under a heading over readers' comments: the heading and all that follows in the element that holds it."""
    out, opened = set(), {}
    for k, b in enumerate(found):
        if nodes[b.node].heading and nodes[nodes[b.node].parent].parent and _TALK_HEAD.fullmatch(b.text):
            opened[nodes[b.node].parent] = k
        up = b.node
        while opened and up:
            if up in opened:
                out.add(k)
                break
            up = nodes[up].parent
    return out


def _listed(found: list[Block], nodes: list[Node]) -> set[int]:
    """Linked items of an article's list that stands amid its prose, or under a heading such as Sources.

    Amid prose: a block of ten words or more, mostly not linked, comes before and after it in the same article.
    """
    prose = [k for k, b in enumerate(found) if b.words >= 10 and 2 * b.linked < len(b.text) and nodes[b.node].main and not nodes[b.node].cost]
    if not prose:
        return set()
    out, head, said = set(), "", set(prose)
    for k, b in enumerate(found):
        if nodes[b.node].heading:
            head = b.text
        elif k in said:
            head = ""
        if nodes[b.node].name == "li" and nodes[b.node].main and not nodes[b.node].cost and (prose[0] < k < prose[-1] or prose[0] < k and _LIST_HEAD.fullmatch(head)):
            out.add(k)
    return out


#: What every block has against it: short pieces of text are boilerplate until something says otherwise.
PRIOR = 40


def costs(found: list[Block], nodes: list[Node]) -> list[tuple[int, int]]:
    """(cost of calling a block boilerplate, cost of calling it content) for every block: the classifier's evidence on either side.

    For content: words, sentence ends, headings. Against: being a line at all (PRIOR), links, the kind of an element around it, lying
    outside the page's article, and names of classes and ids. A name says nothing against what it wraps where
    it wraps the largest article; nor does one of several meanings where it wraps half of the page's text, or a strong one that wraps most of it with a heading. Links in a list
    of the article (see `_listed`) say little against it. What follows a heading over comments, in the same element, is comments.
    """
    talk, listed = _talk(found, nodes), _listed(found, nodes)
    for b in found:
        if not nodes[b.node].cost and not nodes[b.node].comments:
            nodes[b.node].chars += len(b.text)
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].parent].chars += nodes[k].chars
    roots = [k for k, n in enumerate(nodes) if n.main and not n.cost and not n.comments and not nodes[n.parent].main]
    root = max(roots, key=lambda k: nodes[k].chars, default=0)
    has_main = bool(root) and nodes[root].chars > 0
    around = set()
    while root:
        around.add(root)
        root = nodes[root].parent
    against, headed = [0] * len(nodes), {nodes[b.node].parent for b in found if nodes[b.node].heading}
    for k in range(1, len(nodes)):
        n = nodes[k]
        share = n.chars / max(1, nodes[0].chars)
        wraps = k in around or share >= 0.5 and n.named < STRONG or share >= 0.8 and k in headed
        against[k] = max(against[n.parent], 0 if wraps else n.named)
    out = []
    for k, b in enumerate(found):
        n = nodes[b.node]
        share = b.linked / max(1, len(b.text)) * (0.2 if k in listed else 1)
        content = 10 + 3 * min(b.words, 40) + (25 if _STOP.search(b.text) else 0) + (20 if n.heading else 0)
        boiler = PRIOR + int(90 * share) + (15 if b.words < 4 and b.linked and k not in listed else 0) + n.cost + against[b.node] + (600 if n.comments or k in talk else 0)
        if has_main and not n.main:
            boiler += 260
        elif not has_main and n.good:
            content += 60
        out.append((content, boiler))
    return out


def min_cut(terminals: list[tuple[int, int]], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut: terminals (from source, to sink), edges (a, b, both ways).

    Flow straight through a node is sent first; what remains goes along shortest augmenting paths.
    """
    n = len(terminals)
    flow: list[dict[int, int]] = [{} for _ in range(n + 2)]
    source, sink = n, n + 1
    for k, (a, b) in enumerate(terminals):
        through = min(a, b)
        if a > through:
            flow[source][k] = a - through
            flow[k][source] = 0
        if b > through:
            flow[k][sink] = b - through
            flow[sink][k] = 0
    for a, b, c in edges:
        flow[a][b] = flow[a].get(b, 0) + c
        flow[b][a] = flow[b].get(a, 0) + c
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            x = queue.popleft()
            for y, c in flow[x].items():
                if c and y not in level:
                    level[y] = level[x] + 1
                    queue.append(y)
        if sink not in level:
            return [k in level for k in range(n)]
        ways = {x: iter(list(flow[x])) for x in level}
        path = [source]
        while path:  # blocking flow: paths along the levels, each dead end left once
            x = path[-1]
            if x == sink:
                least = min(flow[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    flow[a][b] -= least
                    flow[b][a] = flow[b].get(a, 0) + least
                full = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if not flow[a][b])
                del path[full + 1 :]
                continue
            for y in ways[x]:
                if flow[x].get(y) and level.get(y) == level[x] + 1:
                    path.append(y)
                    break
            else:
                level[x] = -1
                path.pop()


#: Smoothness: what it costs to part two blocks that follow each other under one element, two of one element with others between,
#: and a block from the article or main element it stands in.
NEXT, SIBLING, INSIDE = 72, 36, 60


def edges(found: list[Block], nodes: list[Node], against: list[int]) -> tuple[list[tuple[int, int, int]], int]:
    """Which blocks want one label and how much, and how many anchors: nodes after the blocks, one for each article or main element.

    A block wants the label of the next block, less with its distance in the document tree, of the last one of its own parent, and of
    the article that it stands in (half as much, of the whole page, where it has none). Where links, elements and names say 80 more against one block than against the other, they want it a sixth as much.
    """
    alike = lambda a, b, c: c if abs(against[a] - against[b]) < 80 else c // 6
    out, last, anchors = [], {}, {}
    within = [0] * len(nodes)
    for k in range(1, len(nodes)):
        up = nodes[k].parent
        within[k] = within[up] or (k if nodes[k].main and not nodes[k].cost else 0)
    any_main = any(within[b.node] for b in found)
    for k, b in enumerate(found):
        if k:
            out.append((k - 1, k, alike(k - 1, k, NEXT // (1 + _apart(nodes, found[k - 1].node, b.node)))))
        parent = nodes[b.node].parent
        if parent in last and last[parent] != k - 1:
            out.append((last[parent], k, alike(last[parent], k, SIBLING)))
        last[parent] = k
        if within[b.node] or not any_main:
            out.append((anchors.setdefault(within[b.node], len(found) + len(anchors)), k, INSIDE if any_main else INSIDE // 2))
    return [x for x in out if x[2]], len(anchors)


def main_blocks(page: str) -> tuple[list[str], int, int]:
    """(the content blocks' texts in page order, number of blocks, how many of them the cut labels against their own evidence)."""
    found, nodes = parsed(page)
    terminals = costs(found, nodes)
    links, anchors = edges(found, nodes, [boiler for _, boiler in terminals])
    label = min_cut(terminals + [(INSIDE * len(found), 0)] * anchors, links)  # the elements themselves say content
    swayed = sum(content != (c > b) for content, (c, b) in zip(label, terminals))
    return [b.text for b, content in zip(found, label) if content], len(found), swayed


def _apart(nodes: list[Node], a: int, b: int, most: int = NEXT) -> int:
    """Steps in the document tree between two blocks' parents, `most` where there are more."""
    a, b, steps = nodes[a].parent, nodes[b].parent, 0
    while a != b and steps < most:
        if nodes[a].depth >= nodes[b].depth:
            a = nodes[a].parent
        else:
            b = nodes[b].parent
        steps += 1
    return steps


def extracted(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars, n_blocks, n_content, n_swayed (labels that neighbours decide).

    Blocks that the cut leaves with the content side, in page order, two newlines between; white space inside one is one
    space. No content (null and empty pages too) gives an empty text. Every row is answered by itself, repeated rows alike; pages are
    parsed whole, where they are read, without a shuffle.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [main_blocks(page or "") for page in batch.column(2).to_pylist()]
            texts = ["\n\n".join(r[0]) for r in rows]
            numbers = [[len(t) for t in texts], [r[1] for r in rows], [len(r[0]) for r in rows], [r[2] for r in rows]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), *(pa.array(x, pa.int64()) for x in numbers)], [c.split()[0] for c in SCHEMA.split(", ")])

    slim = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    return slim.mapInArrow(extract, SCHEMA)
