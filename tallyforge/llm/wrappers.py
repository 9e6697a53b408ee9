"""Main text of web pages by wrapper induction.

Pages of one host come out of the same template. A page's tree of block elements is folded (runs
of siblings with the same shape are one node) into a skeleton. The commonest skeleton of a host is
its pivot, and every other skeleton is aligned with it by simple tree matching, which maps its
nodes to slots of the host. Over all pages of the host, each slot is judged by its texts: a slot
that mostly says the same is template, one whose text varies is content, one that is mostly links
is navigation. Elements that declare their role (`nav`, `footer`, `aside`, `form`, `article`,
`main`, telling classes and ids) are taken at their word, so a menu or an advert whose words vary
from page to page is not content, and an article is judged template only if nearly all pages agree.

Pages are parsed once; all that follows works on folded skeletons and hashes of blocks. Equal
pages of a host count once. A host that has a third of all pages is aggregated in tasks first.

White space in a block is one space; blocks are joined by line feeds in page order. Null html is
empty, a null or unparsable url is the host ''. Broken markup is read leniently, as browsers do.
Nesting beyond `DEPTH` elements is flattened; its text stays. Repeated ids are rows of their own.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyforge.llm.common import arrow_map, arrow_rows, batches, query, table
from tallyforge.session import bounded_broadcast, settle

DEPTH = 150
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul noscript template "
    "svg math object video audio canvas head label".split())
_STRONG = frozenset("nav footer aside form dialog menu button select option noscript template svg math object video audio canvas head search fieldset label".split())
_MAIN = frozenset(("article", "main"))
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead related recommended share sharing social comment comments "
    "disqus replies widget login signup search toolbar pagination pager copyright alert".split())
_AROUND = frozenset("with has no layout page wrapper container main content article js".split())
_BODY = frozenset("content article post entry story main".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_ATTR = re.compile(r"""([a-zA-Z][\w:-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"\s+")


@lru_cache(8192)
def signature(tag: str, attributes: str) -> tuple[str, int]:
    """Name of an element in a skeleton, and its role: -2 set apart by its tag, -1 by a class or id, 1 main, 0 neither."""
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTR.findall(attributes)} if attributes else {}
    names = [n for key in ("id", "class") for n in found.get(key, "").lower().split()]
    role = -2 if tag in _STRONG else 1 if tag in _MAIN else 0
    kind = found.get("role", "").lower()
    if kind in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu") or "hidden" in found \
            or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden", "").lower() == "true":
        role = -2
    elif kind == "main":
        role = 1
    if tag not in ("html", "body") and role >= 0:
        parts = [set(re.split(r"[^a-z]+", n)) - {""} for n in names]
        if any(p & _NOISE and not p & _AROUND for p in parts):
            role = -1
        elif role == 0 and any(p and p <= _BODY for p in parts):
            role = 1
    shape = ".".join([tag, *sorted({re.sub(r"[^a-z-]", "", n) for n in names})])
    return re.sub(r"[(),+~-]", "_", shape), role


class _Node:
    __slots__ = ("name", "tag", "role", "children", "number", "key")

    def __init__(self, name: str, tag: str, role: int):
        self.name, self.tag, self.role, self.children, self.number, self.key = name, tag, role, [], -1, ""


def parse(source: str) -> tuple[str, list[tuple[int, str, int]]]:
    """Folded skeleton of a page and its blocks: (node of the skeleton, text, characters of it in links)."""
    root = _Node("root", "root", 0)
    stack, blocks, text = [root], [], []
    at, links, linked = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            line = _SPACE.sub(" ", "".join(text)).strip()
            if line:
                blocks.append((stack[-1], line, linked))
            text.clear()
            linked = 0

    def words(piece: str) -> None:
        nonlocal linked
        if piece:
            if "&" in piece:
                piece = entities.unescape(piece)
            text.append(piece)
            if links:
                linked += len(piece.strip())

    def close(tags: set[str] | frozenset[str], fence: set[str] | frozenset[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                flush()
                del stack[k:]
                return
            if stack[k].tag in fence:
                return

    end = len(source)
    while at < end:
        m = _TAG.search(source, at)
        if m is None:
            words(source[at:])
            break
        words(source[at:m.start()])
        at = m.end()
        shut, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if shut:
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCK or any(n.tag == tag for n in stack[-3:]):
                if tag != "p" or stack[-1].tag == "p":
                    close({tag}, {"table", "td"} if tag not in ("table", "td", "tr", "th", "tbody", "body", "html") else set())
                flush()
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            at = stop.end() if stop else end
            continue
        if tag in ("br", "hr", "wbr", "img"):
            text.append(" " if tag != "wbr" else "")
            if tag == "hr":
                flush()
            continue
        if tag in _VOID:
            continue
        if tag == "a":
            links += 1
            continue
        name, role = signature(tag, attributes.rstrip("/").strip())
        if tag not in _BLOCK and (role == 0 or role == 1):
            continue
        flush()
        if tag in ("body", "article", "main", "div", "section", "p", "h1"):  # an open head ends where a body begins
            if any(n.tag == "head" for n in stack):
                close({"head"}, set())
        if tag in _BLOCK and stack[-1].tag == "p":
            stack.pop()
        if tag in _CLOSES:
            close(*_CLOSES[tag])
        if len(stack) >= DEPTH or attributes.endswith("/") and tag in ("svg", "object"):
            continue
        above = stack[-1].role
        if above < 0:
            role = above
        elif role == 0:
            # An article's own header stays part of it; a page's header is set apart.
            role = -2 if tag == "header" and above == 0 else above
        node = _Node(name, tag, role)
        stack[-1].children.append(node)
        stack.append(node)
    flush()
    return _fold(root, blocks)


_SIGN = {-2: "-", -1: "-", 0: "", 1: "+"}


def _fold(root: _Node, blocks: list[tuple[_Node, str, int]]) -> tuple[str, list[tuple[int, str, int]]]:
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(node.children)
    for node in reversed(order):
        folded: list[list[_Node]] = []
        for child in node.children:
            if folded and folded[-1][0].key == child.key:
                folded[-1].append(child)
            else:
                folded.append([child])
        node.children = folded
        inner = ",".join(run[0].key for run in folded)
        node.key = f"{_SIGN[node.role]}{node.name}({inner})" if inner else f"{_SIGN[node.role]}{node.name}"
    count, todo = 0, [[root]]
    while todo:  # equal siblings share a number, and so do their parts
        run = todo.pop()
        for node in run:
            node.number = count
        count += 1
        for k in range(len(run[0].children) - 1, -1, -1):
            todo.append([n for node in run for n in node.children[k]])
    return root.key, [(node.number, line, linked) for node, line, linked in blocks]


def read_skeleton(skeleton: str) -> tuple[list[str], list[list[int]]]:
    """Names and children of a skeleton's nodes, numbered in order of appearance."""
    names, children, stack = [], [], []
    for token in re.findall(r"[(),]|[^(),]+", skeleton):
        if token == "(":
            stack.append(len(names) - 1 if not stack else latest)
        elif token == ")":
            latest = stack.pop()
        elif token != ",":
            names.append(token)
            children.append([])
            latest = len(names) - 1
            if stack:
                children[stack[-1]].append(latest)
    return names, children


def tree_matching(a: str, b: str) -> dict[int, int]:
    """Nodes of skeleton `a` matched with nodes of `b`: simple tree matching, names equal, order kept, the most nodes."""
    names_a, kids_a = read_skeleton(a)
    names_b, kids_b = read_skeleton(b)
    size: dict[tuple[int, int], int] = {}

    def grid(x: int, y: int) -> list[list[int]]:
        rows = [[0] * (len(kids_b[y]) + 1)]
        for c in kids_a[x]:
            row, before = [0], rows[-1]
            for k, d in enumerate(kids_b[y]):
                row.append(max(row[-1], before[k + 1], before[k] + size.get((c, d), 0)))
            rows.append(row)
        return rows

    for x in range(len(names_a) - 1, -1, -1):  # children have larger numbers than their parents
        for y in range(len(names_b) - 1, -1, -1):
            if names_a[x] == names_b[y]:
                size[x, y] = 1 + (grid(x, y)[-1][-1] if kids_a[x] and kids_b[y] else 0)
    matched, todo = {}, [(0, 0)] if (0, 0) in size else []
    while todo:
        x, y = todo.pop()
        matched[x] = y
        rows = grid(x, y)
        i, j = len(kids_a[x]), len(kids_b[y])
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((kids_a[x][i], kids_b[y][j]))
    return matched


def host(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page_key (hash of the html), skeleton and blocks (node, text, linked) of every page."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", kind), ("url", pa.string()), ("host", pa.string()), ("page_key", pa.int64()), ("skeleton", pa.string()),
                            ("blocks", pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string()), ("linked", pa.int32())])))])

        def rows():
            for page_id, url, site, key, source in arrow_rows(stream):
                skeleton, blocks = parse(source)
                yield page_id, url, site, key, skeleton, [{"node": n, "text": t, "linked": k} for n, t, k in blocks]

        yield from batches(rows(), schema, weigh=lambda r: 64 * len(r[5]) + sum(len(b["text"]) for b in r[5]))

    source = F.coalesce("html", F.lit(""))
    given = pages.select("page_id", "url", host("url").alias("host"), F.xxhash64(source).alias("page_key"), source.alias("html"))
    name = given.schema["page_id"].dataType.simpleString()
    kind = pa.int64() if name == "bigint" else pa.string()
    return given.transform(arrow_map, run, f"page_id {name}, url string, host string, page_key long, skeleton string, blocks array<struct<node:int,text:string,linked:int>>")


def aligned(shapes: DataFrame) -> DataFrame:
    """host, skeleton, node, slot and role (-1, 0, 1): every node of every skeleton against its host's pivot; unmatched nodes are slots of their own.

    `shapes` has host, skeleton and pages, once each.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for site, skeleton, pivot in arrow_rows(stream):
                matched = tree_matching(skeleton, pivot) if skeleton != pivot else None
                for node, name in enumerate(read_skeleton(skeleton)[0]):
                    slot = node if matched is None else matched.get(node)
                    yield (site, skeleton, node, str(slot) if slot is not None else f"{skeleton}#{node}", {"+": 1, "-": -1}.get(name[0], 0))

        yield from batches(rows(), pa.schema([("host", pa.string()), ("skeleton", pa.string()), ("node", pa.int32()), ("slot", pa.string()), ("role", pa.int32())]))

    pivots = shapes.groupBy("host").agg(F.max_by("skeleton", F.struct("pages", "skeleton")).alias("pivot"))
    return shapes.join(pivots, "host").select("host", "skeleton", "pivot").transform(arrow_map, run, "host string, skeleton string, node int, slot string, role int")


def induced(parsed: DataFrame) -> DataFrame:
    """host, skeleton and `content`, the nodes of the skeleton whose text is content."""
    shapes = parsed.groupBy("host", "skeleton").agg(F.count(F.lit(1)).alias("pages"))
    slots = settle(aligned(shapes))
    once = parsed.groupBy("host", "page_key").agg(F.first(F.struct("skeleton", F.transform("blocks", lambda b: F.struct(
        b.node.alias("node"), F.xxhash64(b.text).alias("says"), F.char_length(b.text).alias("chars"), b.linked.alias("linked"))).alias("blocks"))).alias("p"))
    said = (once.select("host", "p.skeleton", F.explode("p.blocks").alias("b")).groupBy("host", "skeleton", F.col("b.node").alias("node"), F.col("b.says").alias("says"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("b.chars").alias("chars"), F.sum("b.linked").alias("linked")))
    by_slot = (said.join(slots, ["host", "skeleton", "node"]).groupBy("host", "slot", "says").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
               .groupBy("host", "slot").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")))
    judged = slots.join(by_slot, ["host", "slot"], "left")
    links = F.coalesce(F.col("linked") > 0.5 * F.col("chars"), F.lit(False))
    fixed = F.coalesce((F.col("n") >= 3) & (F.col("top") > 0.5 * F.col("n")), F.lit(False))
    frozen = F.coalesce((F.col("n") >= 10) & (F.col("top") > 0.9 * F.col("n")), F.lit(False))
    picked = judged.groupBy("host", "skeleton").agg(
        F.max((F.col("role") == 1) & F.col("n").isNotNull()).alias("has_main"),
        F.collect_list(F.when((F.col("role") == 1) & ~frozen, F.col("node"))).alias("main"),
        F.collect_list(F.when(F.col("role") == 1, F.col("node"))).alias("all_main"),
        F.collect_list(F.when((F.col("role") == 0) & ~fixed & ~links, F.col("node"))).alias("varying"),
        F.collect_list(F.when((F.col("role") == 0) & ~links, F.col("node"))).alias("plain"))
    main = F.when(F.size("main") > 0, F.col("main")).otherwise(F.col("all_main"))
    return picked.select("host", "skeleton", F.when(F.col("has_main"), main).when(F.size("varying") > 0, F.col("varying")).otherwise(F.col("plain")).alias("content"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and `text` of every row of `pages` (page_id, url, html)."""
    parsed = settle(parsed_pages(pages), compression="zstd")
    # Hosts and their skeletons are few beside pages; checked in bytes, so that the texts needn't move where they are.
    content = bounded_broadcast(induced(parsed).withColumnsRenamed({"host": "_host", "skeleton": "_skeleton"}))
    joined = parsed.join(content, (F.col("host") == F.col("_host")) & (F.col("skeleton") == F.col("_skeleton")), "left")
    kept = F.filter("blocks", lambda b: F.array_contains("content", b.node))
    return joined.select("page_id", "url", F.coalesce(F.array_join(F.transform(kept, lambda b: b.text), "\n"), F.lit("")).alias("text"))


@query("op3_wrappers")
def op3_wrappers(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
