"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. One page of each host is its reference; every page's tree is aligned with it by simple
tree matching (largest set of matched nodes that keeps order and ancestry; runs of like siblings are matched as runs).
A reference block whose text is the same on most aligned pages is template, what varies is a slot. Template texts are
dropped from every page; of the slots, those whose tag or whole class name marks a role other than the article (menus,
adverts, footers, forms, comments, ...) are dropped too, and lists of links on pages where no article is found.

Defined results: NULL and empty html give empty text; a NULL or odd url is a host of its own name (empty); pages equal to
their reference say nothing about its template, so hosts with fewer than ``LEAST_PAGES`` other pages have no template;
repeated rows are extracted each; an empty table gives no rows. Unclosed tags, comments and scripts end with the page.
"""

from __future__ import annotations

import html as html_lib
import re
import sys
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import keyed, slices, small_batches

TOKEN = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|[!?/][^>]*>)", re.S)
# One attribute after another: its name, and its value in quotes or without.
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAMING = frozenset(("class", "id", "role"))
# Elements nested deeper stand beside each other, as in browsers; their texts stay in page order.
DEEPEST = 512
# Blocks of text, which no class name takes out of the article.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figure figcaption td th tr table tbody".split())
WORD = re.compile(r"[a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
# An opening tag that ends an open element of these names.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section div body select".split())
# Roles other than the article's, by tag and by words of class, id or role.
OTHER_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea input iframe object svg canvas dialog menu".split())
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments disqus respond reply replies widget toolbar pagination pager search copyright "
    "skip complementary contentinfo dialog".split()
)
MAIN_WORDS = frozenset("article articlebody post entry story content main maincontent".split())
LEAST_PAGES = 3
SAME = 0.6
CELLS = 1_000_000
BROADCAST_BYTES = 32 << 20


class Node:
    __slots__ = ("tag", "words", "names", "kids", "texts", "sign", "number", "hidden")

    def __init__(self, tag: str, words: frozenset, hidden: bool = False, names: frozenset = frozenset()):
        # ``words``: parts of class, id and role; ``names``: these names whole.
        self.tag, self.words, self.hidden, self.names = tag, words, hidden, names
        self.kids: list[Node] = []
        # Own text pieces: (number of kids before it, text).
        self.texts: list[tuple[int, str]] = []
        self.sign = tag if not words else tag + "." + ".".join(sorted(w for w in words if not w.isdigit()))
        self.number = -1

    def own(self) -> str:
        """A block's text with that of its inline elements; inline elements have none of their own."""
        return "" if self.tag in INLINE else " ".join("".join(self._pieces()).split())

    def _pieces(self) -> list[str]:
        out, at = [], 0
        for i in range(len(self.kids) + 1):
            while at < len(self.texts) and self.texts[at][0] == i:
                out.append(self.texts[at][1])
                at += 1
            if i < len(self.kids):
                out += self.kids[i]._pieces() if self.kids[i].tag in INLINE else [" "]
        return out

    def inline(self) -> list[Node]:
        """Its inline elements, those inside them too."""
        out = [k for k in self.kids if k.tag in INLINE]
        for k in list(out):
            out += k.inline()
        return out


def parse(page: str) -> Node:
    """A tree of elements; blocks that HTML closes by itself are closed."""
    root = Node("#page", frozenset())
    stack = [root]
    at, n, below = 0, len(page), 0

    def add_text(raw: str):
        if raw and not raw.isspace():
            stack[-1].texts.append((len(stack[-1].kids), html_lib.unescape(raw) if "&" in raw else raw))
        elif raw and stack[-1].tag != "#page":
            stack[-1].texts.append((len(stack[-1].kids), " "))

    while at < n:
        less = page.find("<", at)
        if less < 0:
            add_text(page[at:])
            break
        m = TOKEN.match(page, less)
        if not m:
            if less + 1 < n and (page[less + 1].isalpha() or page[less + 1] in "/!?"):
                # A tag that the page's end cuts off.
                add_text(page[at:less])
                break
            add_text(page[at : less + 1])
            at = less + 1
            continue
        add_text(page[at:less])
        at = m.end()
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = n if end < 0 else end + 3
            continue
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1] and below and name not in INLINE:
            below -= 1
            continue
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
            continue
        words, names, hidden = frozenset(), frozenset(), False
        if m[3]:
            found = [(a.lower(), b or c or d) for a, b, c, d in ATTRIBUTE.findall(m[3])]
            words = frozenset(w for a, v in found if a in NAMING for w in WORD.findall(v.lower()))
            names = frozenset(w for a, v in found if a in NAMING for w in v.lower().split())
            hidden = any(a == "hidden" for a, _ in found)
        if name not in INLINE and name != "br":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        ends = CLOSES.get(name)
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and not (name == "tr" and stack[k].tag == "tbody"):
                    break
        node = Node(name, words, hidden, names)
        stack[-1].kids.append(node)
        if name in VOID or (m[3] or "").endswith("/"):
            continue
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            if not end:
                break
            close = page.find(">", end.end())
            at = n if close < 0 else close + 1
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
        elif name not in INLINE:
            below += 1
    return root


def number(root: Node) -> list[Node]:
    """All nodes in page order, each with its number."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(out)
        out.append(node)
        todo.extend(reversed(node.kids))
    return out


def _runs(kids: list[Node]) -> list[tuple[str, list[Node]]]:
    out: list[tuple[str, list[Node]]] = []
    for kid in kids:
        if out and out[-1][0] == kid.sign:
            out[-1][1].append(kid)
        else:
            out.append((kid.sign, [kid]))
    return out


def _match_runs(a: list, b: list, weight) -> list[tuple[int, int]]:
    """Places (i, j) of the heaviest matching in order of two lists of runs."""
    if len(a) * len(b) > CELLS:
        # Too many kinds of siblings in a row for the table: the next run of the same kind, in one pass.
        places, out, low = defaultdict(list), [], -1
        for j in range(len(b) - 1, -1, -1):
            places[b[j][0]].append(j)
        for i, (sign, _) in enumerate(a):
            free = places[sign]
            while free and free[-1] <= low:
                free.pop()
            if free:
                low = free.pop()
                out.append((i, low))
        return out
    best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    gains = {}
    for i in range(len(a)):
        for j in range(len(b)):
            here = max(best[i, j + 1], best[i + 1, j])
            if a[i][0] == b[j][0]:
                gains[i, j] = best[i, j] + weight(a[i][1], b[j][1])
                here = max(here, gains[i, j])
            best[i + 1, j + 1] = here
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def align(reference: Node, page: Node) -> list[tuple[Node, Node]]:
    """Matched (reference node, page node) by simple tree matching."""
    sizes: dict[int, int] = {}

    def size(x: Node) -> int:
        if id(x) not in sizes:
            sizes[id(x)] = 1 + sum(map(size, x.kids)) if x.kids else 1
        return sizes[id(x)]

    memo: dict[tuple[int, int], tuple[int, list]] = {}
    texts: dict[int, str] = {}

    def own(x: Node) -> str:
        if id(x) not in texts:
            texts[id(x)] = x.own()
        return texts[id(x)]

    def in_run(p: list[Node], q: list[Node]) -> list[tuple[Node, Node]]:
        """Pairs of two runs of like siblings: one by one if they are equally long, else the heaviest matching in order.

        Like siblings often have equal trees, so equal texts count too.
        """
        if len(p) == len(q) or min(len(p), len(q)) == 0 or len(p) * len(q) > CELLS:
            return list(zip(p, q))
        best = np.zeros((len(p) + 1, len(q) + 1), np.int64)
        gain = [[2 * match(u, v)[0] + (own(u) == own(v)) for v in q] for u in p]
        for i in range(len(p)):
            for j in range(len(q)):
                best[i + 1, j + 1] = max(best[i, j + 1], best[i + 1, j], best[i, j] + gain[i][j])
        out, i, j = [], len(p), len(q)
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((p[i], q[j]))
        return out[::-1]

    def match(x: Node, y: Node) -> tuple[int, list]:
        key = (id(x), id(y))
        if key not in memo:
            if not x.kids or not y.kids:
                memo[key] = (1, [])
            else:
                a, b = _runs(x.kids), _runs(y.kids)
                if [s for s, _ in a] == [s for s, _ in b]:
                    pairs = [(i, i) for i in range(len(a))]
                else:
                    pairs = _match_runs(a, b, lambda p, q: sum(match(u, v)[0] for u, v in in_run(p, q)))
                kids = [(u, v) for i, j in pairs for u, v in in_run(a[i][1], b[j][1])]
                memo[key] = (1 + sum(match(u, v)[0] for u, v in kids), kids)
        return memo[key]

    out, todo = [], [(reference, page)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        todo.extend(match(x, y)[1])
    return out


def _marked(node: Node) -> bool:
    """Whether a whole name marks another role: a role word, or role words only ("cookie-notice"; not "has-sidebar")."""
    return any(parts and OTHER_WORDS.issuperset(parts) for parts in map(WORD.findall, node.names))


def _other(node: Node, inside: bool) -> bool:
    """Whether a node has a role other than the article's; a header counts only outside of the article."""
    if node.tag in OTHER_TAGS or node.hidden:
        return True
    if node.tag not in ("body", "html", "article", "main", "#page") and not (inside and node.tag in PROSE) and _marked(node):
        return True
    if node.tag == "article" and node.names & {"comment", "comments", "reply", "ad", "related", "promo"}:
        return True
    return not inside and (node.tag == "header" or "header" in node.names) and node.tag not in ("body", "html", "article", "main", "#page")


def _volume(node: Node, template: set[int], inside: bool, memo: dict, inside_link: bool = False) -> tuple[int, int]:
    """(characters, characters in links) of what a node would give."""
    link = inside_link or node.tag == "a"
    own = 0 if id(node) in template else sum(len(t.strip()) for _, t in node.texts)
    total, linked = own, own if link else 0
    for kid in node.kids:
        if not _other(kid, inside or kid.tag in ("article", "main")):
            t, ln = _volume(kid, template, inside or kid.tag in ("article", "main"), memo, link)
            total, linked = total + t, linked + ln
    memo[id(node)] = (total, linked)
    return total, linked


def _below(node: Node) -> Iterator[Node]:
    """All nodes inside a node."""
    todo = list(node.kids)
    while todo:
        node = todo.pop()
        yield node
        todo.extend(node.kids)


def main_text(root: Node, template: set[int]) -> str:
    """The article's blocks, joined by one space. ``template``: ids of nodes whose own text is the wrapper's."""
    if root.number < 0:
        number(root)
    volumes: dict[int, tuple[int, int]] = {}
    _volume(root, template, False, volumes)
    articles, mains, named, boxes = [], [], [], []
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        if id(node) not in volumes or _other(node, inside):
            # Boxes that hold the article itself, whatever they are called.
            if not node.hidden and node.tag not in OTHER_TAGS - {"form"} and node.tag != "article":
                boxes.append(node)
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main" or "main" in node.words:
            mains.append(node)
        elif node.tag in ("div", "section", "td") and node.words & MAIN_WORDS:
            named.append(node)
        todo.extend((k, inside or node.tag == "main") for k in node.kids)
    picks = [root]
    if not any(volumes[id(x)][0] for x in articles + mains):
        # No article outside of such boxes: the ones inside them count beside named blocks.
        while boxes:
            node = boxes.pop()
            for kid in node.kids:
                if kid.tag in ("article", "main"):
                    if not _other(kid, True):
                        _volume(kid, template, True, volumes)
                        named.append(kid)
                elif not kid.hidden and kid.tag not in OTHER_TAGS - {"form"}:
                    boxes.append(kid)
    for group in (articles, mains, named):
        full = [x for x in group if volumes[id(x)][0]]
        if full:
            # All of them in page order; one inside another comes with it.
            picks = sorted(full, key=lambda x: x.number)
            break
    inner: set[int] = set()
    for x in picks:
        if id(x) not in inner:
            inner.update(id(y) for y in _below(x))
    picks = [x for x in picks if id(x) not in inner]
    whole_page = picks == [root]
    parts: list[str] = []

    def walk(node: Node, inside: bool) -> None:
        block = node.tag not in INLINE
        if block:
            parts.append(" ")
        at = 0
        texts = node.texts if id(node) not in template else []
        for i in range(len(node.kids) + 1):
            while at < len(texts) and texts[at][0] == i:
                parts.append(texts[at][1])
                at += 1
            if i < len(node.kids):
                kid = node.kids[i]
                deep = inside or kid.tag in ("article", "main")
                if _other(kid, deep):
                    parts.append(" " if kid.tag not in INLINE else "")
                    continue
                total, linked = volumes.get(id(kid), (0, 0))
                if whole_page and kid.tag in ("ul", "ol", "table", "div", "section") and linked > 0.6 * total and total:
                    continue
                walk(kid, deep)
        if block:
            parts.append(" ")

    for pick in picks:
        walk(pick, not whole_page)
    return " ".join("".join(parts).split())


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


class _References:
    """Parsed reference pages of the hosts at hand."""

    def __init__(self):
        self.held: dict[str, tuple[str, Node, list[Node], list[str]]] = {}

    def of(self, host: str, page: str):
        known = self.held.get(host)
        if not known or known[0] != page:
            if len(self.held) > 256:
                self.held.clear()
            root = parse(page)
            nodes = number(root)
            known = self.held[host] = (page, root, nodes, [x.own() for x in nodes])
        return known


def _observe(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Per (host, reference node): pages that have a node aligned with it, and those where its text is the same."""
    references = _References()
    for part in slices(batch, "html"):
        seen: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0])
        for host, page, ref in zip(*(part.column(c).to_pylist() for c in ("host", "html", "ref"))):
            if page is None or page == ref:
                continue
            _, root, _, own = references.of(host, ref)
            for x, y in align(root, parse(page)):
                if own[x.number]:
                    count = seen[host, x.number]
                    count[0] += 1
                    count[1] += y.own() == own[x.number]
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k][0] for k in keys], pa.int64()), pa.array([seen[k][1] for k in keys], pa.int64())],
            ["host", "node", "pages", "same"],
        )


def _extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    references = _References()
    for part in slices(batch, "html"):
        out = []
        for host, page, ref, constant in zip(*(part.column(c).to_pylist() for c in ("host", "html", "ref", "constant"))):
            if not page:
                out.append("")
                continue
            root = parse(page)
            number(root)
            template: set[int] = set()
            if constant:
                _, ref_root, _, own = references.of(host, ref)
                fixed = set(constant)
                same = [y for x, y in align(ref_root, root) if x.number in fixed and y.own() == own[x.number]]
                template = {id(z) for y in same for z in (y, *y.inline())}
            out.append(main_text(root, template))
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])


def _met(pages: DataFrame, by_host: DataFrame, size: int) -> DataFrame:
    """Pages with what is known of their host: by broadcast if that is small, else by a join whose hot hosts Spark splits."""
    return pages.join(F.broadcast(by_host) if size <= BROADCAST_BYTES else by_host, "host", "left")


def induce(pages: DataFrame) -> tuple[DataFrame, int]:
    """(host, ref, constant): each host's reference page and its template nodes; and the bytes of that table."""
    placed = pages.select(host_of(F.col("url")).alias("host"), "url", "page_id", "html").where(F.col("html").isNotNull() & (F.col("html") != ""))
    # A whole page rather than one that is cut off.
    order = F.struct((~F.rtrim(F.lower(F.col("html"))).endswith("</html>")).alias("cut"), F.xxhash64("html").alias("h"))
    references = cut_lineage(placed.groupBy("host").agg(F.min_by("html", order).alias("ref")))
    size = references.agg(F.sum(F.octet_length("ref"))).first()[0] or 0
    joined = _met(placed.select("host", "html"), references, size)
    seen = joined.mapInArrow(_each(_observe), "host string, node int, pages long, same long")
    totals = seen.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    constant = totals.where((F.col("pages") >= LEAST_PAGES) & (F.col("same") >= SAME * F.col("pages")))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("constant"))
    return cut_lineage(references.join(constant, "host", "left")), size


def _each(run):
    def wrapped(batches):
        # Trees are DEEPEST deep at most, with a few calls per level.
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * DEEPEST))
        for batch in batches:
            yield from run(batch)

    return wrapped


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of ``pages`` (page_id, url, html)."""
    small_batches(pages.sparkSession)
    wrappers, size = induce(pages)
    kind = pages.schema["page_id"].dataType
    joined = _met(pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")), wrappers, size)
    return joined.mapInArrow(_each(_extract), keyed("url string, text string", page_id=kind))
