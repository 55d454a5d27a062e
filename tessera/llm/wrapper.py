"""Main text of web pages by wrapper induction: pages of a host are aligned to one of them by simple tree matching; what stays
the same is the host's template, what varies are slots, and slots that are no navigation, notice, form and so on hold content."""

import html
import re
import sys
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, written

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = frozenset("article aside body button div footer form html main nav section table ul ol dl td th header".split())
#: Elements, roles, and words of class and id that hold no content.
NOT_CONTENT = frozenset("nav footer aside form script style noscript template iframe svg canvas button select input textarea head title dialog menu object embed audio video noembed noframes xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs topbar masthead footer comment comments disqus reply replies respond share sharing social related recommended recommendations pagination pager login search toolbar skip copyright legal".split()
)
_MAIN = frozenset("content article post entry story main body text".split())


class Node:
    __slots__ = ("tag", "attrs", "parts", "at")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.attrs, self.parts, self.at = tag, attrs, [], 0

    @property
    def nodes(self) -> "list[Node]":
        return [x for x in self.parts if not isinstance(x, str)]


def parse(page: str) -> Node:
    """A tree of a page's elements and texts; unclosed, crossed and broken tags are mended much as browsers do."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * page.count("<") + 10_000))  # a tree is no deeper than its tags; such calls take no C stack
    root = Node("#root")
    stack, pos, end = [root], 0, len(page)
    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            stack[-1].parts.append(page[pos:])
            break
        m = _TOKEN.match(page, lt)
        if lt > pos:
            stack[-1].parts.append(page[pos:lt])
        if not m:
            stack[-1].parts.append("<")
            pos = lt + 1
            continue
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].parts.append(Node("br"))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag in _SCOPE:
                    break
            continue
        if tag in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in _SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SAME[tag]:
                    del stack[k:]
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif stack[k].tag in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        node = Node(tag, m[3])
        stack[-1].parts.append(node)
        if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag not in _SCOPE and tag != "p":
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}[\\s/>]", re.I).search(page, pos)
            stop = close.start() if close else end
            node.parts.append(page[pos:stop])
            pos = page.find(">", stop) + 1 if close else end
            pos = pos or end
            continue
        stack.append(node)
    return root


def _attrs(node: Node) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(node.attrs)} if node.attrs.strip() else {}


def signature(node: Node) -> str:
    """What two nodes must share to be matched: tag and class."""
    return f"{node.tag}.{_attrs(node).get('class', '')}" if "class" in node.attrs else node.tag


def words_of(node: Node) -> set[str]:
    a = _attrs(node)
    return set(re.split(r"[^a-z0-9]+", f"{a.get('class', '')} {a.get('id', '')}".lower())) - {""}


def no_content(node: Node) -> bool:
    """Whether its element, role or class says that a node is navigation, notice, advert, form, comment or the like."""
    if node.tag in NOT_CONTENT:
        return True
    if not node.attrs.strip():
        return False
    a = _attrs(node)
    if a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return True
    if node.tag in ("html", "body", "main", "article"):
        return "comment" in words_of(node) or "comments" in words_of(node)
    return bool(words_of(node) & _WORDS)


def text_of(node: Node) -> str:
    return " ".join(html.unescape("".join(x if isinstance(x, str) else " " if x.tag == "br" else text_of(x) for x in node.parts if isinstance(x, str) or x.tag not in RAW)).split())


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of the largest matching of two trees whose roots match, order and depth kept (simple tree matching). Children
    with equal signatures at both ends are paired first; dynamic programming decides between them in what is left."""
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        p, q = x.nodes, y.nodes
        if not p or not q:
            continue
        s, t = [signature(n) for n in p], [signature(n) for n in q]
        i, n, m = 0, len(p), len(q)
        while i < min(n, m) and s[i] == t[i]:
            todo.append((p[i], q[i]))
            i += 1
        while n > i and m > i and s[n - 1] == t[m - 1]:
            n, m = n - 1, m - 1
            todo.append((p[n], q[m]))
        s, t = s[i:n], t[i:m]
        if s and t and set(s) & set(t):
            best = np.zeros((len(s) + 1, len(t) + 1), np.int32)
            tt = np.array(t)
            for k, v in enumerate(s):  # a row at a time: the best without s[k], or with it at each place, is a running maximum
                row = np.maximum(best[k, 1:], best[k, :-1] + (tt == v) * (1 + _weight(p[i + k])))
                best[k + 1, 1:] = np.maximum.accumulate(row)
            k, l = len(s), len(t)
            while k and l:
                if best[k, l] == best[k - 1, l]:
                    k -= 1
                elif best[k, l] == best[k, l - 1]:
                    l -= 1
                else:
                    k, l = k - 1, l - 1
                    todo.append((p[i + k], q[i + l]))
    return out


def _weight(node: Node) -> int:
    return min(50, len(node.parts))


def numbered(root: Node) -> Node:
    """root, with each node's place in the order of the page."""
    n, todo = 0, [root]
    while todo:
        x = todo.pop()
        x.at, n = n, n + 1
        todo.extend(reversed(x.nodes))
    return root


#: Elements that make a page's layout; others come and go with its content.
_FRAME = frozenset("html body header nav main article aside section footer div form table".split())


def layout(root: Node) -> int:
    """Hash of a page's skeleton: the distinct paths of its framing elements by tag and class, numbers in classes left out."""
    paths, todo = set(), [(root, "")]  # (node, hash of its path): a path's length must not grow with depth
    while todo:
        x, path = todo.pop()
        for y in x.nodes:
            if y.tag in _FRAME:
                at = _hash(f"{path}/{re.sub('[0-9]+', '0', signature(y))}")
                paths.add(at)
                todo.append((y, at))
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode(errors="surrogatepass")) - (1 << 63)


def _own_text(node: Node) -> str:
    """Text of a block without the blocks inside it; inline elements are part of their block and have none of their own."""
    if node.tag in RAW or node.tag in INLINE:
        return ""

    out, todo = [], list(reversed(node.parts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append(" ")
        elif x.tag in INLINE:
            todo.extend(reversed(x.parts))
    return " ".join(html.unescape("".join(out)).split())


def _hash(text: str) -> str:
    return xxhash.xxh64_hexdigest(text.encode(errors="surrogatepass"))


def main_text(page: str, wrapper: tuple[Node, dict[int, str]] | None = None) -> str:
    """Blocks of main text, joined by two newlines. wrapper: the host's reference tree, and its constant nodes with their text's hash."""
    root = parse(page)
    constant: set[int] = set()
    if wrapper and wrapper[1]:
        constant = {id(y) for x, y in align(wrapper[0], root) if x.at in wrapper[1] and (t := _own_text(y)) and _hash(t) == wrapper[1][x.at]}
    regions = _regions(root)
    if not regions:
        regions = [root]
    blocks = _blocks(regions, constant)
    if not blocks and constant:
        blocks = _blocks(regions, set())
    if regions == [root]:  # slots of pages without a marked article: those that are mostly links are menus
        rest = [b for b in blocks if 2 * b[1] < b[2]]
        blocks = rest or blocks
    return "\n\n".join(b[0] for b in blocks)


def _regions(root: Node) -> list[Node]:
    """Outermost articles, else main elements, else elements classed as content, that stand in no part without content."""
    found: dict[str, list[Node]] = {"article": [], "main": [], "class": []}

    def go(n: Node, within: frozenset) -> None:
        for x in n.nodes:
            if no_content(x) or x.tag == "header":
                continue
            a = _attrs(x) if x.attrs.strip() else {}
            kind = "article" if x.tag == "article" else "main" if x.tag == "main" or a.get("role") == "main" else "class" if x.tag in ("div", "section", "td") and words_of(x) & _MAIN and "articleBody" not in a.get("itemprop", "") or a.get("itemprop") == "articleBody" else None
            if kind and kind not in within:
                found[kind].append(x)
            go(x, within | {kind} if kind else within)

    go(root, frozenset())
    if found["article"]:
        return found["article"]
    return found["main"] or found["class"]


def _blocks(regions: list[Node], constant: set[int]) -> list[tuple[str, int, int]]:
    """(text, characters in links, characters) of each block, in the order of the page."""
    out: list[tuple[str, int, int]] = []
    cur: list[str] = []
    linked = [0]

    def flush() -> None:
        t = " ".join(html.unescape("".join(cur)).split())
        if t:
            out.append((t, linked[0], len(t)))
        cur.clear()
        linked[0] = 0

    def go(n: Node, heading: bool, link: bool) -> None:
        fixed = id(n) in constant
        for x in n.parts:
            if isinstance(x, str):
                if not heading and not fixed:
                    cur.append(x)
                    linked[0] += len(x.strip()) if link else 0
                continue
            if x.tag == "br":
                cur.append(" ")
                continue
            if no_content(x):
                if x.tag not in INLINE:
                    flush()
                continue
            inline = x.tag in INLINE
            if inline and fixed:
                continue
            head = x.tag == "header" or "header" in words_of(x) if x.attrs or x.tag == "header" else False
            if not inline:
                flush()
            go(x, (heading or head) and not re.fullmatch("h[1-6]", x.tag), link or x.tag == "a")
            if not inline:
                flush()

    for r in regions:
        go(r, False, False)
        flush()
    return out


#: Hashes of pages, up to which they are sent to every executor: those with copies, and those of the references.
_FEW = 1_000_000


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extract(pages: DataFrame, least: int = 5, share: float = 0.8, url: str = "url", page: str = "html") -> DataFrame:
    """pages with `text`, the main text of each whole page.

    A host's pages are grouped by layout; a layout of fewer than `least` pages that differ goes with the host's largest one. Every group's
    page of the smallest hash (of its main layout) is its reference. All pages of the group are aligned to it, and the texts of each of its
    nodes are counted over the pages that differ; where one text has at least `share` of at least `least` such pages that have the node, it is template.
    Then each page is aligned again and read without the template's nodes that have the template's text and without the parts that hold no content.
    Each of m copies counts 1 / m; sums are rounded. Counting is done per task first, so a host of any size needs no group in memory. A null or empty page has an empty text; a null
    url is a host of its own. Repeated rows each give a row; an own column `text` is replaced."""
    kept = ["row", "_page"]

    def laid(at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = pa.array([layout(parse(p.as_py())) if p.is_valid else None for p in b.column(at)], pa.int64())
                yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, "_layout"])

        return run

    whole = boxed(pages, ("text",), _page=F.col(page), _host=host_of(F.col(url)))
    base = whole
    seen = pages.where(F.col(page).isNotNull()).select(host_of(F.col(url)).alias("_host"), F.col(page).alias("_page"), F.xxhash64(page).alias("h"))
    shapes = seen.mapInArrow(laid(1), "_host string, _page string, h long, _layout long").groupBy("_host", "h", "_layout").agg(F.count("*").alias("m"))
    shapes = written(shapes, "layouts")
    copies = written(shapes.where("m > 1").select("_host", "h", "m"), "copies")
    if copies.count() <= _FEW:  # else by shuffle
        copies = F.broadcast(copies)
    sizes = shapes.groupBy("_host", "_layout").agg(F.count("*").alias("n"))
    main = sizes.groupBy("_host").agg(F.max_by("_layout", F.struct("n", "_layout")).alias("_main"))
    groups = sizes.join(main, "_host").select("_host", "_layout", F.when(F.col("n") >= least, F.col("_layout")).otherwise(F.col("_main")).alias("_group"))
    member = shapes.join(groups, ["_host", "_layout"])
    pick = member.groupBy("_host", "_group").agg(F.min(F.struct(F.col("_layout") != F.col("_group"), "h")).alias("x"), F.count("*").alias("_n")).where(F.col("_n") >= least).select("_host", "_group", F.col("x.h").alias("h"))
    pick = written(pick, "picked")
    if pick.count() <= _FEW:
        pick = F.broadcast(pick)
    refs = seen.join(pick, ["_host", "h"]).groupBy("_host", "_group").agg(F.min("_page").alias("_ref"))
    refs = written(refs, "references")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple[str, int], Node] = {}
        for b in batches:
            c: Counter = Counter()
            for host, group, ref, text, m in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if (host, group) not in trees:
                    if len(trees) > 200:
                        trees.clear()
                    trees[host, group] = numbered(parse(ref))
                for x, y in align(trees[host, group], parse(text)):
                    if y.tag not in RAW and y.tag not in INLINE:
                        t = _own_text(y)
                        c[host, group, x.at, _hash(t) if t else ""] += 1 / m
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in c], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))] + [pa.array(list(c.values()), pa.float64())], ["_host", "_group", "node", "t", "n"])

    own = seen.join(copies, ["_host", "h"], "left").select("_host", "_page", F.coalesce("m", F.lit(1)).alias("m")).mapInArrow(laid(1), "_host string, _page string, m long, _layout long")
    own = own.join(refs.join(groups, ["_host", "_group"]), ["_host", "_layout"]).select("_host", "_group", "_ref", "_page", "m")
    counted = own.mapInArrow(count, "_host string, _group long, node int, t string, n double").groupBy("_host", "_group", "node", "t").agg(F.round(F.sum("n")).cast("long").alias("n"))
    told = F.col("t") != ""
    counted = counted.groupBy("_host", "_group", "node").agg(F.sum("n").alias("all"), F.max(F.when(told, F.col("n"))).alias("n"), F.max_by("t", F.when(told, F.struct("n", "t"))).alias("t"))
    fixed = counted.where((F.col("n") >= share * F.col("all")) & (F.col("n") > 1) & (F.col("all") >= least)).groupBy("_host", "_group").agg(F.collect_list(F.struct("node", "t")).alias("_fixed"))
    wrap = written(refs.join(fixed, ["_host", "_group"]).join(groups, ["_host", "_group"]).select("_host", "_layout", "_group", "_ref", "_fixed"), "wrappers")
    with_layout = base.withColumn("_layout", F.lit(None).cast("long")).schema
    both = base.mapInArrow(laid(1), with_layout).join(wrap, ["_host", "_layout"], "left")
    at, n = 1, len(kept)
    shape = whole.select("row", F.lit("").alias("text")).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[tuple[str, int], tuple[Node, dict[int, str]]] = {}
        for b in batches:
            out = []
            keys = list(zip(b.column(n).to_pylist(), b.column(n + 1).to_pylist(), strict=True))
            for i, p in enumerate(b.column(at)):
                w = None
                if b.column(n + 3)[i].is_valid:
                    if keys[i] not in trees:
                        if len(trees) > 200:
                            trees.clear()
                        trees[keys[i]] = (numbered(parse(b.column(n + 2)[i].as_py())), {x["node"]: x["t"] for x in b.column(n + 3)[i].as_py()})
                    w = trees[keys[i]]
                out.append(main_text(p.as_py(), w) if p.is_valid else "")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["row", "text"])

    return both.select(*kept, "_host", "_group", "_ref", "_fixed").mapInArrow(read, shape).select("row.*", "text")
