"""Main text of web pages by wrapper induction.

The DOM trees of a host's pages are aligned by simple tree matching (most matched nodes, in order, under matched
parents) and merged into one template tree. How often which text stands at each node of the template tells its
constant nodes, which belong to the site, from its varying slots, which hold content. Of the slots those in elements
that say they are something else (menus, adverts, comments) are left out.

Three passes read the pages: one makes templates (a task merges its own pages first, so a host costs one row a task,
and these are merged a few at a time), one counts texts by node, one extracts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# Kinds of elements and the words that name them.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold main text.
_CHROME = frozenset("aside audio button canvas datalist dialog fieldset footer form head header menu nav noscript object optgroup option select svg template video".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in classes and ids of elements that hold something else.
_NAMES = frozenset(
    "ad ads advert advertisement advertising advertorial adsense banner breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr header login masthead menu modal nav navbar navigation newsletter notice "
    "notification pager pagination paywall popup promo promoted promotion recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split())
_COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
_HEADERS = frozenset("header masthead".split())
#: An open element is closed by the start of one of these.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tbody": {"tr", "td", "th", "thead", "tbody", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody", "tfoot"},
}
#: ... but not beyond one of these.
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_PARAGRAPH, _HOLDS_PARAGRAPHS = {"p"}, {"td", "th", "li", "div", "button", "table", "article", "body"}
#: Boxes whose place among their siblings tells what they are, if nothing else does.
_BOXES = frozenset("div section table tbody td center".split())
#: Elements that the region of content is looked for in.
_WRAPS = _BOXES | {"body", "html", "main", "tr", "form", "article"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?=[\s=/]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")

#: Deeper elements count as parts of their ancestor of this depth.
DEEPEST = 64
#: Boxes without a name are told apart by their place in rows of up to so many, and children lists of up to WIDEST are aligned in order.
ROW, WIDEST = 8, 32
#: A text is common at a node if it stands there beside so many different contents, and beside half of all that node has.
BESIDE = 4
#: States merged by one task.
FAN = 32


# ------------------------------------------------------------------ trees


class Node:
    """An element (label: tag, class and id) or, with label #, texts; blocks are numbers of a page's texts."""

    __slots__ = ("blocks", "kids", "label", "number")

    def __init__(self, label: str, kids: list[Node] | None = None, blocks: list[int] | None = None):
        self.label, self.kids, self.blocks, self.number = label, kids or [], blocks or [], -1

    def shape(self) -> str:
        return f"{self.label}({''.join(k.shape() for k in self.kids)})" if self.kids else self.label + ";"

    def walk(self) -> Iterator[Node]:
        yield self
        for k in self.kids:
            yield from k.walk()

    def plain(self) -> list:
        return [self.label, [k.plain() for k in self.kids]]

    @staticmethod
    def of(plain: list) -> Node:
        return Node(plain[0], [Node.of(k) for k in plain[1]])


def _weight(a: Node, b: Node, memo: dict) -> int:
    """Nodes matched by the best matching of two trees; 0 if their roots differ."""
    if a.label != b.label:
        return 0
    key = id(a), id(b)
    if key not in memo:
        memo[key] = 1 + _table(a.kids, b.kids, memo)[-1][-1]
    return memo[key]


def _table(xs: list[Node], ys: list[Node], memo: dict) -> list[list[int]]:
    rows = [[0] * (len(ys) + 1)]
    for x in xs:
        above, row = rows[-1], [0]
        for j, y in enumerate(ys):
            w = _weight(x, y, memo)
            row.append(max(above[j + 1], row[j], above[j] + w) if w else max(above[j + 1], row[j]))
        rows.append(row)
    return rows


def _pairs(xs: list[Node], ys: list[Node], memo: dict) -> list[tuple[int, int]]:
    """Numbers of the children that simple tree matching pairs, in order."""
    names = [x.label for x in xs]
    if names == [y.label for y in ys] and len(set(names)) == len(names):
        return [(i, i) for i in range(len(names))]  # no other pairs of so many are in order
    rows, out = _table(xs, ys, memo), []
    i, j = len(xs), len(ys)
    while i and j:
        if rows[i][j] == rows[i - 1][j]:
            i -= 1
        elif rows[i][j] == rows[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(into: Node, other: Node) -> None:
    """Adds to a tree what it lacks of another one with the same root; what matches is one node, with the texts of both."""
    into.blocks += other.blocks
    if not other.kids:
        return
    met = _pairs(into.kids, other.kids, {})
    if len(met) == len(other.kids):
        for i, j in met:
            merge(into.kids[i], other.kids[j])
        return
    partner = {j: into.kids[i] for i, j in met}
    out, at = list(into.kids), 0
    for j, kid in enumerate(other.kids):
        if j in partner:
            at = next(k for k in range(at, len(out)) if out[k] is partner[j]) + 1
            merge(partner[j], kid)
        else:
            out.insert(at, kid)
            at += 1
    into.kids = fold(out)


def fold(kids: list[Node]) -> list[Node]:
    """Children with neighbours of one label as one node: a list's items, an article's paragraphs.

    Boxes without class or id stay apart in rows of up to ROW. Of more than WIDEST children those of one label are one
    wherever they stand, and of more than WIDEST labels those of one tag are one label.
    """
    if len(kids) < 2:
        return kids
    out: list[Node] = []
    i = 0
    while i < len(kids):
        j = i + 1
        while j < len(kids) and kids[j].label == kids[i].label:
            j += 1
        if j - i <= ROW and kids[i].label in _BOXES:
            out += kids[i:j]
        else:
            for k in kids[i + 1 : j]:
                merge(kids[i], k)
            out.append(kids[i])
        i = j
    if len(out) > WIDEST:
        for short in (False, True):
            known: dict[str, Node] = {}
            for k in out:
                if short and k.label != "#":
                    k.label = re.split("[.#]", k.label)[0]
                if k.label in known:
                    merge(known[k.label], k)
                else:
                    known[k.label] = k
            out = list(known.values())
            if len(out) <= WIDEST:
                break
    return out


def align(template: Node, page: Node) -> dict[int, int]:
    """Number of the template's node for each block of the page whose node is matched."""
    out, stack, memo = {}, [(template, page)], {}
    while stack:
        t, p = stack.pop()
        out.update(dict.fromkeys(p.blocks, t.number))
        stack += [(t.kids[i], p.kids[j]) for i, j in _pairs(t.kids, p.kids, memo)]
    return out


# ------------------------------------------------------------------ pages


class _Open:
    """An element that isn't closed yet: its node, what else than main text it may hold, its first text, and what is in it."""

    __slots__ = ("article", "begin", "depth", "h1", "kind", "main", "node", "tag")

    def __init__(self, tag: str, node: Node, kind: str | None, begin: int):
        self.tag, self.node, self.kind, self.begin, self.depth = tag, node, kind, begin, 1
        self.main = self.article = self.h1 = False


class Page:
    """A page's tree and texts. Of each text: the characters in links, whether it is chrome, and its article, main or heading."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.linked: list[int] = []
        self.chrome: list[bool] = []
        self.article: list[bool] = []
        self.main: list[bool] = []
        self.heading: list[bool] = []
        self._parts: list[str] = []
        self._links = self._in_link = 0
        self._stack: list[_Open] = []
        self._open("html", "html", None)
        self._read(html)
        while len(self._stack) > 1:
            self._close()
        self._flush()
        top = self._stack[0].node
        top.kids = fold(top.kids)
        self.tree = top

    def _flush(self) -> None:
        if not self._parts:
            return
        text = " ".join("".join(self._parts).split())
        if text:
            self._stack[-1].node.kids.append(Node("#", None, [len(self.texts)]))
            self.texts.append(text)
            self.linked.append(self._links)
            self.heading.append(any(s.tag in _HEADINGS for s in self._stack[-2:]))
            self.chrome.append(False)
            self.article.append(False)
            self.main.append(False)
        self._parts.clear()
        self._links = 0

    def _open(self, tag: str, label: str, kind: str | None) -> None:
        self._stack.append(_Open(tag, Node(label), kind, len(self.texts)))

    def _close(self) -> None:
        self._flush()
        e = self._stack.pop()
        node, above, kind, tag = e.node, self._stack[-1], e.kind, e.tag
        node.kids = fold(node.kids)
        above.node.kids.append(node)
        own = range(e.begin, len(self.texts))
        # what is around the main text is no chrome, whatever it is called
        if kind and not (e.main or e.h1 and kind in ("form", "comments") or e.article and kind != "comments"):
            inside = kind == "header" and any(s.tag == "article" and not s.kind for s in self._stack)
            for i in own:
                self.chrome[i] = self.chrome[i] or not (inside and self.heading[i])
        elif tag in ("article", "main") and not kind:
            marks = self.article if tag == "article" else self.main
            for i in own:
                marks[i] = True
            setattr(above, tag, True)
        above.main, above.article, above.h1 = above.main or e.main, above.article or e.article, above.h1 or e.h1 or tag == "h1"

    def _start(self, tag: str, rest: str) -> None:
        attributes, words, hidden = {}, frozenset(), False
        if rest and not rest.isspace():
            attributes = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(rest)}
            words = {w.lower() for w in _WORDS.findall(unescape(f"{attributes.get('class', '')} {attributes.get('id', '')}"))}
            hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        kind = None
        if tag in _CHROME:
            kind = tag if tag in ("form", "header") else "chrome"
        elif tag not in ("html", "body", "main"):
            if words & _COMMENTS:
                kind = "comments"
            elif tag == "article":
                # an article inside another's text is a reader's comment
                outer = next((s for s in reversed(self._stack) if s.tag == "article"), None)
                kind = "comments" if outer and len(self.texts) > outer.begin else None
            elif words & _HEADERS:
                kind = "header"
            elif hidden or words & _NAMES or attributes.get("role", "").lower() in _ROLES:
                kind = "chrome"
        if tag in _INLINE and not kind:
            self._in_link += tag == "a"
            return
        top = self._stack[-1]
        if tag in _INLINE and top.tag == tag:
            top.depth += 1
            return
        self._flush()
        if tag in _CLOSES:
            self._close_upto(_CLOSES[tag], _FENCE.get(tag, ()))
        elif tag not in _INLINE:
            self._close_upto(_PARAGRAPH, _HOLDS_PARAGRAPHS)
        if len(self._stack) < DEEPEST:
            label = tag if not attributes else tag + "".join("." + _DIGITS.sub("", c) for c in sorted(attributes.get("class", "").split())[:3]) + ("#" + _DIGITS.sub("", attributes["id"]) if attributes.get("id") else "")
            self._open(tag, label, kind)

    def _close_upto(self, tags: set[str], fence: set[str]) -> None:
        """Closes the outermost open element of these tags before an element of the fence."""
        found = 0
        for n in range(1, len(self._stack)):
            s = self._stack[-n]
            if s.tag in fence and s.tag not in tags:
                break
            if s.tag in tags:
                found = n
        for _ in range(found):
            self._close()

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._in_link = max(0, self._in_link - 1)
        for n in range(1, len(self._stack)):
            s = self._stack[-n]
            if s.tag == tag:
                s.depth -= 1
                if not s.depth:
                    for _ in range(n):
                        self._close()
                return
        if tag not in _INLINE:
            self._flush()

    def _text(self, raw: str) -> None:
        if raw:
            self._parts.append(unescape(raw) if "&" in raw else raw)
            if self._in_link:
                self._links += len(self._parts[-1])

    def _read(self, html: str) -> None:
        at = 0
        while m := _TOKEN.search(html, at):
            self._text(html[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in _RAW:
                self._flush()
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
            elif tag in _VOID or m[3].endswith("/") and tag not in _INLINE and tag not in _WRAPS and tag != "p":
                if tag not in _INLINE:
                    self._flush()
            else:
                self._start(tag, m[3])
        # an unfinished tag at the end is a token; what is left is text
        self._text(html[at:])
        self._flush()

    def longest(self) -> int | None:
        """The number of the longest text that is no chrome."""
        open_texts = [i for i, c in enumerate(self.chrome) if not c]
        return max(open_texts, key=lambda i: len(self.texts[i])) if open_texts else None


def key_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Wrapper:
    """A host's template with the constant nodes and the unlinked characters at each node; without a host, of one page."""

    def __init__(self, template: str, constant: list[int] = (), chars: dict[int, int] | None = None):
        self.root = Node.of(json.loads(template))
        self.nodes = list(self.root.walk())
        for k, n in enumerate(self.nodes):
            n.number = k
        self.constant, self.known = set(constant), {}
        self.region = self._region(chars or {})

    def _region(self, chars: dict[int, int]) -> set[int]:
        """Numbers of the nodes in the deepest box that holds most of the text of the box around it, from the root on."""
        total: dict[int, int] = {}
        for n in reversed(self.nodes):
            total[n.number] = (0 if n.number in self.constant else chars.get(n.number, 0)) + sum(total[k.number] for k in n.kids)
        at = self.root
        while True:
            best = max((k for k in at.kids if re.split("[.#]", k.label)[0] in _WRAPS), key=lambda k: total[k.number], default=None)
            if best is None or 5 * total[best.number] <= 3 * total[at.number]:
                return {n.number for n in at.walk()}
            at = best

    def numbers(self, page: Page) -> dict[int, int]:
        """Number of the node of each text; pages of one shape are aligned once."""
        shape = page.tree.shape()
        order = [n for n in page.tree.walk() if n.blocks]
        if shape not in self.known:
            if len(self.known) > 256:
                self.known.clear()
            found = align(self.root, page.tree)
            self.known[shape] = [found.get(n.blocks[0], -1) for n in order]
        return {b: number for n, number in zip(order, self.known[shape]) for b in n.blocks}


def page_template(page: Page) -> str:
    return json.dumps(Node(page.tree.label, page.tree.kids).plain(), separators=(",", ":"))


def main_text(page: Page, wrapper: Wrapper | None) -> str:
    """The texts in varying slots: in the page's articles, else in its main element, else in the region of content, there without lists of links."""
    open_texts = [i for i, c in enumerate(page.chrome) if not c]
    if wrapper is None:
        chars: dict[int, int] = {}
        wrapper = Wrapper(page_template(page))
        for i, n in wrapper.numbers(page).items():
            if not page.chrome[i]:
                chars[n] = chars.get(n, 0) + max(0, len(page.texts[i]) - page.linked[i])
        wrapper.region = wrapper._region(chars)
    at = wrapper.numbers(page)
    open_texts = [i for i in open_texts if at[i] not in wrapper.constant]
    for marks in (page.article, page.main):
        if any(marks):
            return " ".join(page.texts[i] for i in open_texts if marks[i])
    return " ".join(page.texts[i] for i in open_texts if (at[i] < 0 or at[i] in wrapper.region) and 2 * page.linked[i] <= len(page.texts[i]))


# ------------------------------------------------------------------ jobs


def host_of(url: str) -> Column:
    """The host of an absolute URL in lower case; null if there is none."""
    found = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return F.when(found != "", found)


_TEMPLATE = "part long, host string, template string"
_COUNTED = "host string, node int, text_key long, beside long, chars long"


def _merged(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["template"]))
    tree = Node.of(json.loads(rows[0]["template"]))
    for r in rows[1:]:
        merge(tree, Node.of(json.loads(r["template"])))
    return pa.Table.from_pylist([{"part": rows[0]["part"] // FAN, "host": rows[0]["host"], "template": json.dumps(tree.plain(), separators=(",", ":"))}], schema=table.schema)


def templates(pages: DataFrame) -> DataFrame:
    """host and template of every host. pages: host, html."""
    arrow = pa.schema([("part", pa.int64()), ("host", pa.string()), ("template", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Node] = {}
        seen: dict[str, set[int]] = {}
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tree = Page(html).tree
                shape = key_of(tree.shape())
                if shape not in seen.setdefault(host, set()):
                    seen[host].add(shape)
                    for n in tree.walk():
                        n.blocks = []
                    if host in trees:
                        merge(trees[host], tree)
                    else:
                        trees[host] = tree
        if trees:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"part": part, "host": h, "template": json.dumps(t.plain(), separators=(",", ":"))} for h, t in trees.items()], schema=arrow)

    states = C.materialize(pages.filter("host IS NOT NULL").select("host", "html").mapInArrow(run, _TEMPLATE))
    top = states.agg(F.max("part")).first()[0] or 0
    while top:
        states, top = states.groupBy("host", F.floor(F.col("part") / FAN).alias("_group")).applyInArrow(_merged, _TEMPLATE), top // FAN
    return C.materialize(states.select("host", "template"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, template, constant (numbers of nodes) and chars (by number of node) of every host. pages: host, html.

    A text is common at a node if it stands there on pages of at least BESIDE different longest texts, and of half of
    all longest texts of pages with the node; so copies of one article make nothing common. A node is constant if nine
    of ten texts there are common ones.
    """
    made = templates(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for batch in batches:
            out: list[tuple] = []
            for host, html, template in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if host not in held:
                    if len(held) > 256:
                        held.clear()
                    held[host] = Wrapper(template)
                page = Page(html)
                longest = page.longest()
                if longest is None:
                    continue
                at, beside = held[host].numbers(page), key_of(page.texts[longest])
                out += [(host, at[i], key_of(t), beside, max(0, len(t) - page.linked[i])) for i, t in enumerate(page.texts) if not page.chrome[i] and at[i] >= 0]
            if out:
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["host", "node", "text_key", "beside", "chars"])

    seen = C.materialize(pages.join(made, "host").select("host", "html", "template").mapInArrow(run, _COUNTED))
    by_node = seen.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("beside").alias("all_contents"), F.sum("chars").alias("chars"))
    # few texts stand beside many contents, so a hot slot brings few rows to the join
    often = seen.groupBy("host", "node", "text_key").agg(F.count(F.lit(1)).alias("texts"), F.count_distinct("beside").alias("contents")).filter(F.col("contents") >= BESIDE)
    common = often.join(by_node.select("host", "node", "all_contents"), ["host", "node"]).filter(2 * F.col("contents") >= F.col("all_contents")).groupBy("host", "node").agg(F.sum("texts").alias("common"))
    nodes = by_node.join(common, ["host", "node"], "left")
    constant = 10 * F.col("common") >= 9 * F.col("n")
    per_host = nodes.groupBy("host").agg(F.collect_list(F.when(constant, F.col("node"))).alias("constant"), F.collect_list(F.struct("node", "chars")).alias("chars"))
    return C.materialize(made.join(per_host, "host", "left"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.

    A null, empty or blank page, and one without main text, has the empty text. Repeated rows stay and have equal
    texts. A page without a host (null or relative URL) and hosts of fewer than BESIDE different contents have no
    constant nodes, so their elements alone decide. White space is what Unicode calls so, no-break spaces included. Elements
    and comments left open end with the page; a page of any length is read whole, elements more than DEEPEST deep count
    as part of those above. Other columns are ignored; an empty table gives no rows. A host's wrapper reaches its pages
    by a join: Spark broadcasts wrappers if their table is small and else shuffles, splitting hot hosts.
    """
    rows = C.spread(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")))
    found = wrappers(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        for batch in batches:
            out = []
            for host, html, template, constant, chars in zip(*(batch.column(k).to_pylist() for k in range(2, 7))):
                if template is not None and host not in held:
                    if len(held) > 256:
                        held.clear()
                    held[host] = Wrapper(template, constant or [], {c["node"]: c["chars"] for c in chars or []})
                out.append(main_text(Page(html), held[host] if template is not None else None))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(found, "host", "left").select("page_id", "url", "host", "html", "template", "constant", "chars")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
