"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dipstick.llm.common import by_value, kept, pieces, text_of, worker_memo

by_value(__name__)

# Elements of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title svg math object select canvas xmp noembed noframes".split())
DROPPED = RAW | set("nav footer aside form button menu dialog head label fieldset input audio video map figure-tools".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img del".split())
ENDS_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu "
    "nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = set("ul ol dl table div section article main body".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = set(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar side aside related "
    "recommended share sharing social comment comments commentlist disqus reply replies respond footer masthead topbar toolbar skip widget widgets copyright".split()
)
DEPTH = 200  # deeper elements hang on as siblings, as browsers do
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""", re.S
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|\Z)""", re.I)
_PART = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"([a-z0-9])([A-Z])")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "sign", "children", "text", "number", "main")

    def __init__(self, tag: str, sign: str = ""):
        self.tag, self.sign, self.children, self.text, self.number, self.main = tag, sign, [], [], -1, False


def _boilerplate(tag: str, attrs: str, inside: bool = False) -> tuple[bool, str]:
    """Whether an element's kind, role or names mark it as no content; and its class for matching.

    Inside the main part only a whole name marks (``related``, not ``related-work``): there the wrapper decides.
    """
    if tag in DROPPED:
        return True, ""
    if not attrs or attrs.isspace():
        return False, ""
    sign = ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, ""
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, ""
        if name == "role" and value.lower() in ROLES:
            return True, ""
        if name in ("class", "id"):
            if tag not in ("body", "html", "article", "main") or name == "class" and tag == "article":
                low = value.lower().split() if inside else _PART.findall(_CAMEL.sub(r"\1 \2", value).lower())
                if MARKS.intersection(low):
                    return True, ""
            if name == "class":
                sign = value.lower()
    return False, sign


def parse(page: str) -> Node:
    """The element tree without comments, scripts and styles. Marked elements stay, as ``tag`` empty, until the tree is known."""
    root = Node("html")
    stack, at, size = [root], 0, len(page)
    low = None
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            stack[-1].text.append((len(stack[-1].children), page[at:]))
            break
        if found.start() > at:
            stack[-1].text.append((len(stack[-1].children), page[at : found.start()]))
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/") or tag not in ("svg", "math"):
                low = low or page.lower()
                end = low.find(f"</{tag}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = size if close < 0 else close + 1
            continue
        if tag in ("html", "body", "tbody", "thead", "tfoot"):
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag not in INLINE:
                    break
        elif tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    del stack[i:]
                    if tag != "tr":
                        break
                elif stack[i].tag in HOLDS or stack[i].tag == "tr":
                    break
        marked, sign = _boilerplate(tag, attrs, bool(attrs) and any(n.main for n in stack))
        node = Node(tag, sign)
        node.main = tag in ("article", "main") or 'role="main"' in attrs
        if marked:
            node.number = -2
        stack[-1].children.append(node)
        if tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
    return root


def _holds_main(node: Node) -> bool:
    """Whether an unmarked main element lies below; iterative, as all walks of a tree here."""
    left = [*node.children]
    while left:
        n = left.pop()
        if n.main and n.number != -2:
            return True
        left.extend(n.children)
    return False


def prune(node: Node, inside: bool = False) -> None:
    """Take marked elements out. One that holds the main part stays if only its names mark it."""
    out, where = [], []
    for i, child in enumerate(node.children):
        drop = child.number == -2 and (child.tag in DROPPED or not _holds_main(child))
        if child.tag == "header" and not drop:
            # A page's header goes; an article's keeps its headings.
            if not inside and not _holds_main(child):
                drop = True
            elif inside:
                heads = [n for n in _walk(child) if n.tag in HEADINGS]
                child.children, child.text = heads, []
        if not drop:
            prune(child, inside or child.main)
            out.append(child)
        where.append(len(out))
    node.text = [(0 if at == 0 else where[at - 1], text) for at, text in node.text]
    node.children = out


def _walk(node: Node) -> list[Node]:
    out, left = [], [node]
    while left:
        n = left.pop()
        out.append(n)
        left.extend(reversed(n.children))
    return out


def main_parts(root: Node) -> list[Node]:
    """The outermost article or main elements with text; the whole page where it has none."""
    out, left = [], [root]
    while left:
        n = left.pop()
        if n.main and any(text.strip() for m in _walk(n) for _, text in m.text):
            out.append(n)
        else:
            left.extend(reversed(n.children))
    articles = [a for part in out if part.tag != "article" for a in _walk(part) if a.tag == "article"]
    return out or [root] if not articles or len(out) > 1 else out


def blocks(part: Node) -> list[tuple[Node, str]]:
    """(block element, its text) in page order: references decoded, white space made single."""
    out: list[list] = []

    def add(owner: Node, text: str) -> None:
        if out and out[-1][0] is owner:
            out[-1][1].append(text)
        else:
            out.append([owner, [text]])

    def visit(node: Node, owner: Node) -> None:
        at = 0
        for i, child in enumerate([*node.children, None]):
            while at < len(node.text) and node.text[at][0] == i:
                add(owner, node.text[at][1])
                at += 1
            if child is None:
                break
            if child.tag in ("br", "hr", "img"):
                add(owner, " ")
            elif child.tag in INLINE:
                visit(child, owner)
            else:
                out.append([None, []])
                visit(child, child)
                out.append([None, []])

    visit(part, part)
    whole = [(owner, _SPACE.sub(" ", entities.unescape("".join(texts))).strip()) for owner, texts in out if owner]
    return [(owner, text) for owner, text in whole if text]


def match(a: Node, b: Node, limit: int = 1 << 20) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest order-keeping match of two trees with equal roots.

    Elements match if kind and class are equal. Subtrees of one shape weigh the same, so weights are
    kept by pairs of shapes, and equal shapes at both ends of two rows of children belong to a largest
    match. Between them stands the usual table; each row follows from the one before by a running maximum.
    Only the children of matched elements need more than the last row: up to ``limit`` cells the
    whole table is kept and walked back, beyond that the rows are halved until the parts are small
    (the columns where the halves' best matches meet come from their last rows), so memory stays
    linear in the children of long pages.
    """
    shapes: dict = {}
    shape_of: dict[int, int] = {}
    within: list[list[int]] = []
    heads: list[tuple[str, str]] = []
    weights: dict[tuple[int, int], int] = {}

    def children(n: Node) -> list[Node]:
        return [c for c in n.children if c.tag not in INLINE]

    for tree in (a, b):
        for n in reversed(_walk(tree)):
            if n.tag in INLINE and n is not tree:
                continue
            inner = [shape_of[id(c)] for c in children(n)]
            key = (n.tag, n.sign, *inner)
            if key not in shapes:
                shapes[key] = len(within)
                within.append(inner)
                heads.append((n.tag, n.sign))
            shape_of[id(n)] = shapes[key]

    def weigh(x: int, y: int) -> int:
        if heads[x] != heads[y]:
            return 0
        if (x, y) not in weights:
            weights[x, y] = 1 + int(last_row(within[x], within[y])[-1])
        return weights[x, y]

    def rows(xs: list[int], ys: list[int]) -> Iterator[np.ndarray]:
        kinds, at = np.unique(np.array(ys, np.int64), return_inverse=True)
        held: dict[int, np.ndarray] = {}
        row = np.zeros(len(ys) + 1, np.int64)
        yield row
        for x in xs:
            if x not in held:
                held[x] = np.array([weigh(x, int(y)) for y in kinds], np.int64)
            best = np.maximum(row[1:], row[:-1] + held[x][at])
            row = np.concatenate([row[:1], np.maximum.accumulate(best)])
            yield row

    def last_row(xs: list[int], ys: list[int]) -> np.ndarray:
        if not xs or not ys:
            return np.zeros(len(ys) + 1, np.int64)
        for row in rows(xs, ys):
            pass
        return row

    def pairs_of(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
        sx, sy = [shape_of[id(x)] for x in xs], [shape_of[id(y)] for y in ys]
        start, x1, y1 = 0, len(xs), len(ys)
        while start < min(x1, y1) and sx[start] == sy[start]:
            start += 1
        while min(x1, y1) > start and sx[x1 - 1] == sy[y1 - 1]:
            x1, y1 = x1 - 1, y1 - 1
        out = [*zip(xs[:start], ys[:start]), *zip(xs[x1:], ys[y1:])]
        parts = [(start, x1, start, y1)]
        while parts:
            x0, x1, y0, y1 = parts.pop()
            if x0 == x1 or y0 == y1:
                continue
            if x1 - x0 > 1 and (x1 - x0) * (y1 - y0) > limit:
                half = (x0 + x1) // 2
                ahead = last_row(sx[x0:half], sy[y0:y1])
                behind = last_row(sx[half:x1][::-1], sy[y0:y1][::-1])[::-1]
                cut = y0 + int(np.argmax(ahead + behind))
                parts += [(x0, half, y0, cut), (half, x1, cut, y1)]
                continue
            table = list(rows(sx[x0:x1], sy[y0:y1]))
            i, j = x1 - x0, y1 - y0
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    out.append((xs[x0 + i - 1], ys[y0 + j - 1]))
                    i, j = i - 1, j - 1
        return out

    pairs, left = [], [(a, b)]
    while left:
        x, y = left.pop()
        pairs.append((x, y))
        left += pairs_of(children(x), children(y))
    return pairs


def _prepared(page: str) -> tuple[Node, list[Node]]:
    root = parse(page)
    prune(root)
    return root, _walk(root)


def _seed(host: str, page: str):
    """The numbered tree of a host's first page, kept in the worker while it serves that host."""

    def make():
        root, nodes = _prepared(page)
        for i, n in enumerate(nodes):
            n.number = i
        return root

    store = worker_memo("seeds", dict)
    key = (host, xxhash.xxh64_intdigest(page))
    if key not in store:
        if len(store) > 256:
            store.clear()
        store[key] = make()
    return store[key]


def _aligned(page: str, host: str | None, seed: str | None):
    """(main blocks, number of the seed's element for each, or -1)."""
    root, _ = _prepared(page)
    numbers: dict[int, int] = {}
    if seed is not None:
        numbers = {id(y): x.number for x, y in match(_seed(host, seed), root)}
    found = [b for part in main_parts(root) for b in blocks(part)]
    return found, [numbers.get(id(owner), -1) for owner, _ in found]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode()) - (1 << 63)


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(host, F.lit(""))


# Containers and their classes; what a page says stands inside them.
_CONTAINER = r"""(?i)<(?:body|header|nav|main|article|section|aside|footer|div|form|table)\b(?:[^>]*?\bclass\s*=\s*(?:"[^">]*"|'[^'>]*'|[^\s>"']+))?"""


def layout_of(html: Column) -> Column:
    """Hash of the set of containers in the markup with their classes, numbers left out: pages of one layout share it."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(_CONTAINER), F.lit(0))))
    return F.xxhash64(F.regexp_replace(F.array_join(found, ""), "[0-9]+", ""))


def _of_layout(table: str) -> Column:
    """A page's entry among its host's, by its layout, else that of the host's commonest layout."""

    def entry(layout: str) -> Column:
        return F.get(F.filter(table, lambda s: s["layout"] == F.col(layout)), F.lit(0))

    return F.coalesce(entry("layout"), entry("usual"))


def extract(pages: DataFrame, share: float = 0.8, least: int = 5, layouts: int = 20) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the article, its blocks joined by line ends.

    A layout is the set of a page's containers and their classes. The commonest layout of a host, and each other that
    at least ``least`` different pages and one in ``layouts`` of the host's have, has the first of its pages (smallest id)
    as seed; pages of rarer layouts go with the commonest. So an odd first page, or a second
    layout, does not hide the template of the rest. Every page's element tree is aligned
    with its seed's by simple tree matching. An element that has one and the same text on ``share``
    of the different pages of that seed, ``least`` pages or more, is template; all others are slots, whose
    varying text is content. Elements that HTML itself or their names mark as menu, header, footer,
    sidebar, notice, advert, form, script, style or comment are taken out beforehand; where a page
    has article or main elements, content is what they hold. The slots are the answer, be they short
    or empty. Only where the different pages of a seed have at most half as many different slot contents
    as there are pages, they are copies of one text, and it stays on all of them.

    One row per host (its seeds, no more than ``layouts`` + 1, and their templates) meets the pages: broadcast while its measured size
    allows, else by a join that is split where a host is hot. Copies of a page count once. Trees that
    nest deeper than ``DEPTH`` are flattened there, as browsers do.

    NULL html is empty and gives an empty text; pages without a host are taken by their marks alone;
    repeated rows are answered row by row; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id"), F.col("url"), host_of(F.col("url").cast("string")).alias("host"), text_of("html").alias("html"))
    marked = rows.where(F.col("host").isNotNull() & F.col("html").contains("<")).withColumn("layout", layout_of(F.col("html")))
    sizes = marked.select("host", "layout", F.xxhash64("html").alias("page")).distinct().groupBy("host", "layout").agg(F.count("*").alias("n"))
    sizes = kept(sizes, "layouts")
    hosts = sizes.groupBy("host").agg(F.max_by("layout", F.struct("n", "layout")).alias("usual"), F.sum("n").alias("n_pages"))
    large = (F.col("layout") == F.col("usual")) | ((F.col("n") >= least) & (F.col("n") * layouts >= F.col("n_pages")))
    chosen = kept(sizes.join(hosts, "host").where(large).select("host", "layout", "usual"), "chosen-layouts")
    first = F.min_by("html", F.struct("page_id", F.xxhash64("html"))).alias("seed")
    seeds = kept(marked.join(chosen, ["host", "layout"]).groupBy("host", "layout", "usual").agg(first), "seeds")
    by_host = seeds.groupBy("host").agg(F.first("usual").alias("usual"), F.collect_list(F.struct("layout", "seed")).alias("seeds"))
    seeded = marked.join(kept(by_host, "host-seeds"), "host").select("host", "html", _of_layout("seeds").alias("own"))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for host, page, seed, layout in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found, numbers = _aligned(page, host, seed)
                whole = _hash("\n".join(text for _, text in found))
                out += [(host, layout, -1, 0, whole)] + [(host, layout, n, _hash(text), whole) for (_, text), n in zip(found, numbers) if n >= 0]
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "layout", "node", "text", "page"])

    seen = seeded.select("host", "html", "own.seed", "own.layout").mapInArrow(survey, "host string, layout bigint, node bigint, text bigint, page bigint")
    counts = kept(seen.distinct().groupBy("host", "layout", "node", "text").agg(F.count("*").alias("n")), "slots")
    totals = counts.where("node = -1").select("host", "layout", F.col("n").alias("n_pages"))
    constant = counts.where("node >= 0").join(totals, ["host", "layout"]).where((F.col("n") >= least) & (F.col("n") >= F.lit(share) * F.col("n_pages")))
    # At most 1 / share texts for each element of the seed.
    template = constant.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "text")).alias("template"))
    entry = F.collect_list(F.struct("layout", "seed", "template")).alias("wrappers")
    wrappers = kept(seeds.join(template, ["host", "layout"], "left").groupBy("host").agg(F.first("usual").alias("usual"), entry), "wrappers")

    def content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            wholes, cuts, hashes = [], [], []
            for host, page, seed, template in zip(*(batch.column(i).to_pylist() for i in range(4))):
                constant = {(t["node"], t["text"]) for t in template or ()}
                found, numbers = _aligned(page, host, seed if constant else None)
                cut = [i for i, ((_, text), n) in enumerate(zip(found, numbers)) if (n, _hash(text)) in constant]
                whole, gone = "\n".join(text for _, text in found), set(cut)
                slots = "\n".join(text for i, (_, text) in enumerate(found) if i not in gone) if cut else whole
                wholes.append(whole)
                cuts.append(cut or None)
                hashes.append((_hash(whole), _hash(slots)))
            numbers = [pa.array([h[i] for h in hashes], pa.int64()) for i in range(2)]
            columns = [batch.column(0), batch.column(6), batch.column(4), batch.column(5), pa.array(wholes, pa.string()), pa.array(cuts, pa.list_(pa.int32())), *numbers]
            yield pa.RecordBatch.from_arrays(columns, ["host", "layout", "page_id", "url", "whole", "cut", "page", "content"])

    wrapped = rows.withColumn("layout", layout_of(F.col("html"))).join(wrappers, "host", "left").withColumn("own", _of_layout("wrappers"))
    wrapped = wrapped.select("host", "html", "own.seed", "own.template", "page_id", "url", "own.layout")
    kinds = dict(pages.dtypes)
    stored = f"host string, layout bigint, page_id {kinds['page_id']}, url {kinds['url']}, whole string, cut array<int>, page bigint, content bigint"
    taken = kept(wrapped.mapInArrow(content, stored), "contents")
    # Pages and their slot contents, each counted once by its hash, by seeds where template was taken out.
    group = ["host", "layout"]
    cut = taken.where("cut IS NOT NULL").select(*group).distinct()
    each = taken.select(*group, "page", "content").distinct().join(cut, group, "left_semi")
    contents = each.groupBy(*group, "content").agg(F.count("*").alias("n")).groupBy(*group).agg(F.count("*").alias("n_contents"), F.sum("n").alias("n_pages"))
    copies = kept(contents.where("2 * n_contents <= n_pages").select(*group, F.lit(True).alias("copies")), "copies")
    # No block holds a line end, so the blocks of a text are its lines.
    slots = F.array_join(F.filter(F.split("whole", "\n"), lambda _, i: ~F.array_contains("cut", i)), "\n")
    text = F.when(F.col("copies") | F.col("cut").isNull(), F.col("whole")).otherwise(slots).alias("text")
    return taken.join(copies, group, "left").select("page_id", "url", text).withColumn("n_chars", F.length("text").cast("bigint"))
