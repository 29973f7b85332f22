"""Main text of web pages by wrappers inferred from the pages of each host.

A wrapper is a regular expression without unions over a page's stream of tags
and texts: labels, text slots, optional parts ``( )?`` and repeated groups
``( )+``.  Streams of a host are aligned node by node: what has the same path
of open tags (name, class, id; digits alike) is the same node.  What some
instances of a node lack is optional there; children that stand in either order
or again and again are a repeated group of optional ones; a text that most
pages of the host have at the same place is part of the template, and any
other is a slot.  All of it is counts per host and node, so pages are aligned
in any order and in any task, linear in their length, and partial counts are
added before they are shuffled.

A page is then read by its host's wrapper, from the root downwards: a node's
stream of children is matched against the node's expression, and only what an
explained stream holds is read on.  A text block belongs to the page's slots if
all its pieces stand where the expressions have a text.  Blocks of slots at the
same node of a host are compared over its pages: what most of them have there is
template, the others are slot text.  An expression is kept as one rule a label
(its item, what must have come before, whether it may come again), so a page
needs the rules of its own labels only and is matched in one pass.

The main region is found from the body downwards: into the child whose slots
hold at least half of the slot text below, and no further than an ``article``, a
``main`` without one, or a node with a slot heading of its own.  A page's text is
that of the region's slots, or of all slots in articles where an ``article`` with
a fair part of the slot text says itself what the article is.
Pages count once however often they are repeated, and a page without a node says
nothing about it, so error pages and single odd pages decide for no other.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments
are told by element or by the words of their class, id or role, as tags and texts are read.

Defined cases: null or empty pages have no text; a page alone on its host is
its own wrapper; a page with no host shares the host ``''`` with its like;
unclosed and stray tags end with their parents or are left out; repeated rows
give the same text; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import col, stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that a new one of the kind ends.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCK_ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
SCOPE = set("article aside body div footer form header main nav section table td th ul ol dl blockquote".split())
DIGITS = re.compile("[0-9]+")
#: What a label has as a code, so that expressions and streams can be told apart from it.
UNSAFE = re.compile(r"[\s()?+\\]")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "template", "object", "svg", "canvas", "audio", "video", "head", *RAW}
OUT_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside comment comments reply replies cookie cookies consent
notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs footer masthead header share sharing social related recommended newsletter subscribe subscription
signup login search widget toolbar pagination pager disqus""".split())
IN_WORDS = set("article content main body post story entry text".split())
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar"}
MAIN = ("article", "main")
CONTAINERS = {"article", "main", "section", "div", "td", "body"}
#: Different pages that must agree on a text of the template; of those with its place, more than one in so many must.
AGREE, SHARE = 5, 2
#: A region's child is gone into for one in so many parts of the slot text; an article element counts for one in so many.
HALF, FAIR = 2, 4


def _safe(label: str, unsafe: re.Pattern = UNSAFE) -> str:
    return unsafe.sub(lambda m: f"\\{ord(m[0]):x};", label) if unsafe.search(label) else label


def _tag(name: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, left out, a header) of an opening tag."""
    plain = _safe(name, re.compile(r"[\s()?+\\.#]"))
    if not attributes.strip(" \t\n\r\f/"):
        return plain, name in OUT, name == "header"
    given = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)}
    label = plain + _safe(DIGITS.sub("0", "".join(sorted(f".{x}" for x in given.get("class", "").split())) + (f"#{given['id']}" if given.get("id") else "")))
    words = set(re.findall(r"[a-z]+", f"{given.get('class', '')} {given.get('id', '')}".lower()))
    named = name not in ("html", "body", *MAIN) and words & OUT_WORDS and not (words & IN_WORDS and not words & (OUT_WORDS - {"header", "footer"}))
    out = name in OUT or given.get("role", "").lower() in OUT_ROLES or "hidden" in given or "display:none" in given.get("style", "").replace(" ", "").lower()
    head = name == "header" or bool(named and words & OUT_WORDS <= {"header", "masthead"})
    return label, out or bool(named and not head), head


class Page:
    """``instances``: of each node in the order of opening, the one above it, its label, and the labels and '#' in it, in order;
    ``blocks``: (its innermost block-level instance, the instances whose '#' it fills, text)."""

    def __init__(self, page: str):
        self.instances: list[tuple[int, str, list[str]]] = [(-1, "", [])]
        self.blocks: list[tuple[int, tuple[int, ...], str]] = []
        # the open nodes: (name, left out, only headings kept, inside a heading, inside a main element, innermost block-level instance, instance); all but the name hold for what is inside
        stack: list[tuple] = [("", False, False, False, False, 0, 0)]
        parts: list[str] = []
        fills: list[int] = []

        def flush():
            if parts:
                _, out, keeps, heading, _, leaf, _ = stack[-1]
                if not out and (not keeps or heading):  # of an article's header, the headings
                    text = " ".join(html.unescape("".join(parts)).split())
                    if text:
                        self.blocks.append((leaf, tuple(dict.fromkeys(fills)), text))
                parts.clear()
                fills.clear()

        def text(x):
            parts.append(x)
            if x.strip():
                at = stack[-1][-1]
                stream = self.instances[at][2]
                if not stream or stream[-1] != "#":
                    stream.append("#")
                fills.append(at)

        at, n = 0, len(page)
        for m in iter(lambda: TOKEN.search(page, at), None):
            if m.start() > at:
                text(page[at : m.start()])
            at = max(m.end(), m.start() + 1)
            if m[1]:
                text(html.escape(m[1]))
            if not m[3]:
                continue
            name = m[3].lower()
            if m[2]:
                open_ = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), len(stack))
                if name not in INLINE:
                    flush()
                del stack[open_:]
                continue
            if name not in INLINE:
                flush()
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if name in BLOCK_ENDS_P:
                del stack[self._end(stack, {"p"}) :]
            if name in ENDS:
                del stack[self._end(stack, ENDS[name]) :]
            attributes = m[4] or ""
            label, out, head = _tag(name, attributes)
            _, above_out, keeps, heading, in_main, leaf, above = stack[-1]
            self.instances[above][2].append(label)
            if name in VOID or attributes.endswith("/"):
                continue
            here = len(self.instances)
            self.instances.append((above, label, []))
            stack.append((name, above_out or out or (head and not in_main), keeps or (head and in_main), heading or name in HEADINGS, in_main or name in MAIN, leaf if name in INLINE else here, here))
        if at < n:
            text(page[at:])
        flush()

    @property
    def children(self) -> dict[tuple[str, ...], list[list[str]]]:
        """Of each node (labels from the root), its instances' streams."""
        paths, out = [], {}
        for above, label, stream in self.instances:
            paths.append((*paths[above], label) if paths else ())
            out.setdefault(paths[-1], []).append(stream)
        return out

    def streams(self) -> str:
        """The instances as text, a line each."""
        return "\n".join(f"{above} {label} {' '.join(stream)}" for above, label, stream in self.instances)

    @staticmethod
    def _end(stack: list, names: set) -> int:
        """How many elements stay open when an open one of these names ends, if no other container has begun inside it."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in SCOPE:
                break
        return len(stack)


# --- wrappers ---------------------------------------------------------------------------------------------------------
class Node:
    """A node of a wrapper: its instances aligned.  ``n`` of them, how many have each child, and which child follows which."""

    def __init__(self, n=0, having=(), follows=()):
        self.n, self.having, self.follows = n, Counter(dict(having)), set(follows)

    def align(self, children: list[str], n: int = 1) -> None:
        self.n += n
        self.having.update(dict.fromkeys(children, n))
        self.follows.update(zip(children, children[1:]))

    def items(self) -> list[tuple[list[str], bool, bool]]:
        """(labels, optional, repeated) in order.  Labels that can follow each other in a circle are one group; groups follow the order of their instances."""
        after: dict[str, set[str]] = {a: set() for a in self.having}
        for a, b in self.follows:
            after[a].add(b)
        order, seen = [], set()
        for root in sorted(after):  # labels in the order in which a walk along ``follows`` leaves them
            walk = [(root, iter(sorted(after[root])))] if root not in seen else []
            seen.add(root)
            while walk:
                label, rest = walk[-1]
                for b in rest:
                    if b not in seen:
                        seen.add(b)
                        walk.append((b, iter(sorted(after[b]))))
                        break
                else:
                    order.append(label)
                    walk.pop()
        before: dict[str, set[str]] = {a: set() for a in after}
        for a, bs in after.items():
            for b in bs:
                before[b].add(a)
        groups, taken = [], set()
        for root in reversed(order):  # against ``follows``: what is reached is the root's circle
            if root in taken:
                continue
            group, todo = [], [root]
            taken.add(root)
            while todo:
                label = todo.pop()
                group.append(label)
                new = before[label] - taken
                taken |= new
                todo.extend(new)
            groups.append(sorted(group))
        return [(g, len(g) > 1 or self.having[g[0]] < self.n, len(g) > 1 or g[0] in after[g[0]]) for g in groups]


def expression(items: list[tuple[list[str], bool, bool]]) -> str:
    """A node's items as text."""
    out = []
    for labels, optional, repeated in items:
        inner = " ".join(f"({x})?" if len(labels) > 1 else x for x in labels)
        inner = f"({inner})+" if repeated else inner
        out.append(f"({inner})?" if optional else inner)
    return " ".join(out)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#\s]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


@lru_cache(1 << 16)
def step(node: int, label: str) -> int:
    """The wrapper's node ``label`` in ``node``; the root is the host in 0, the end of a node's stream ``''`` in it."""
    return _hash(str(node), label)


def read_expression(text: str) -> list[tuple[list[str], bool, bool]]:
    """The items that ``expression`` wrote."""
    items, item, depth = [], [], 0
    for x in re.findall(r"[()]|[^()]+", text):
        depth += (x == "(") - (x == ")")
        if depth or x in "()":
            item.append(x)
            continue
        first, *others = x.split(" ")  # outside of brackets a space ends an item
        item.append(first)
        for other in others:
            items.append("".join(item))
            item = [other]
    items.append("".join(item))
    return [(re.findall(r"[^ ()?+]+", x), x.endswith("?"), "+" in x) for x in items if x]


def rules(items: list[tuple[list[str], bool, bool]]) -> list[tuple[str, int]]:
    """A node's expression as (label, code): the number of its item, how many items must have come before it, whether it must come and may come again; ``''`` is the end."""
    out, must = [], 0
    for i, (labels, optional, repeated) in enumerate(items, 1):
        out += [(x, i << 32 | must << 2 | (not optional) << 1 | repeated) for x in labels]
        must += not optional
    return [*out, ("", (len(items) + 1) << 32 | must << 2)]


def explained(codes: list[int | None]) -> bool:
    """Whether an expression matches a stream, from the codes of its labels and its end: no item but one that may come again stands twice, none before an earlier one, none that must come is left out."""
    last = through = 0
    for code in codes:
        if code is None:
            return False
        item, must = code >> 32, code >> 2 & 0x3FFFFFFF
        if item < last or (item == last and not code & 1) or (item > last and must != through):
            return False
        last, through = item, must + (code >> 1 & 1)
    return True


class Rules(dict):
    """Codes by wrapper item; looked up in sorted arrays when first asked for."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        self.ids, self.codes = ids, codes

    def __missing__(self, x: int) -> int | None:
        i = int(np.searchsorted(self.ids, x))
        self[x] = int(self.codes[i]) if i < len(self.ids) and self.ids[i] == x else None
        return self[x]


def name_of(label: str) -> str:
    return label.partition("#")[0].partition(".")[0]


@lru_cache(1 << 12)
def _kind(label: str) -> tuple[bool, bool]:
    return name_of(label) in CONTAINERS, name_of(label) in HEADINGS


def placed(host: str, streams: str) -> Iterator[tuple[int, str, int, list[int]]]:
    """Of each instance: the one above it, its label, its node of the wrapper, and the wrapper's items of its stream, with its end."""
    nodes: list[int] = []
    for line in streams.split("\n"):
        above, label, stream = line.split(" ", 2)
        node = step(nodes[int(above)], label) if nodes else step(0, host)
        nodes.append(node)
        yield int(above), label, node, [*(step(node, x) for x in stream.split(" ") if x), step(node, "")]


class Read:
    """A page as its host's wrapper sees it.  ``blocks``, those of its slots: (labels of the containers above it, inside a heading, text); ``keys``: their (container, node, text's key), 64-bit hashes."""

    def __init__(self, host: str, streams: str, at: str, texts: list[str], rules: dict[int, int | None]):
        seen: list[tuple[bool, tuple, bool, int, int]] = []  # (explained, containers, in a heading, container's hash, node) of each instance
        for above, label, node, items in placed(host, streams):
            path, heading, container, fits = ((), False, step(0, host), True) if not seen else (seen[above][1], seen[above][2], seen[above][3], seen[above][0])
            contains, heads = _kind(label)
            if contains:
                path, container = (*path, label), step(container, label)
            seen.append((fits and explained([rules[x] for x in items]), path, heading or heads, container, node))
        self.blocks, self.keys = [], []
        self.nodes: dict[tuple, int] = {}
        for block, text in zip(at.split(" ") if at else (), texts, strict=True):
            leaf, *fills = map(int, block.split(","))
            if all(seen[x][0] for x in fills):
                _, path, heading, container, node = seen[leaf]
                if path not in self.nodes:
                    on = step(0, host)
                    for i, label in enumerate(path):
                        self.nodes[path[:i]] = on
                        on = step(on, label)
                    self.nodes[path] = on
                self.blocks.append((path, heading, text))
                self.keys.append((container, node, _hash(str(node), text)))

    def region(self, own: dict[int, tuple[float, float]]) -> tuple[tuple, bool] | None:
        """(path of the main region, whether only its articles are meant), from each node's slot text (all, headings); None if there is none."""
        below: Counter = Counter()
        for path, node in self.nodes.items():
            size = own.get(node, (0.0, 0.0))[0]
            for i in range(len(path) + 1):
                below[path[:i]] += size
        if not below[()]:
            return None
        is_article = lambda path: any(name_of(x) == "article" for x in path)
        if FAIR * sum(own.get(node, (0.0, 0.0))[0] for path, node in self.nodes.items() if is_article(path)) >= below[()]:
            return (), True
        at: tuple = ()
        while True:
            name = name_of(at[-1]) if at else ""
            inside = [p for p in self.nodes if len(p) == len(at) + 1 and p[: len(at)] == at]
            best = min(inside, key=lambda p: (-below[p], p), default=None)
            if best is None or HALF * below[best] < below[at] or name == "main" or (name not in ("", "html", "body") and own.get(self.nodes[at], (0.0, 0.0))[1] > 0):
                return at, False
            at = best

    def text(self, own: dict[int, tuple[float, float]], template: set[int]) -> str:
        found = self.region(own)
        if found is None:
            return ""
        at, article = found
        kept = (t for (path, _, t), (_, _, key) in zip(self.blocks, self.keys, strict=True)
                if (any(name_of(x) == "article" for x in path) if article else path[: len(at)] == at and key not in template))
        return " ".join(kept)


# --- the job --------------------------------------------------------------------------------------------------------
def parsed(pages: DataFrame, id_col: str | None, url_col: str, html_col: str) -> DataFrame:
    """``page_id, url, page`` (the html's hash), ``host, streams, at, texts`` of every page: its instances a line each, and its blocks (``at``: of each, the instance and those it fills)."""
    kind = dict(pages.dtypes)[id_col] if id_col else "bigint"
    ids = col(id_col) if id_col else F.lit(None).cast("bigint")
    names = ["page_id", "url", "page", "host", "streams", "at", "texts"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, streams, at, texts = [], [], [], []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                page = Page(page or "")
                hosts.append(host_of(url))
                streams.append(page.streams())
                at.append(" ".join(",".join(map(str, (leaf, *fills))) for leaf, fills, _ in page.blocks))
                texts.append([text for *_, text in page.blocks])
            yield pa.record_batch([*batch.columns[:3], *(pa.array(x, pa.string()) for x in (hosts, streams, at)), pa.array(texts, pa.list_(pa.string()))], names)

    rows = pages.select(ids.alias("page_id"), col(url_col).cast("string").alias("url"), F.xxhash64(col(html_col)).alias("page"), col(html_col).alias("html"))
    return rows.mapInArrow(read, f"page_id {kind}, url string, page bigint, host string, streams string, at string, texts array<string>")


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, node, instances, expression``: a row for each node of a host's wrapper (``node``: labels from the root, joined by a space)."""
    read = stored(parsed(pages, None, url_col, html_col), "parsed-pages", "zstd")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: dict[int, tuple[str, str]] = {}
            for host, streams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                paths: list[str] = []
                for above, label, node, _ in placed(host, streams):
                    paths.append(f"{paths[above]} {label}".strip(" ") if paths else "")
                    names[node] = host, paths[-1]
            yield pa.record_batch([pa.array(names, pa.int64()), *(pa.array([x[i] for x in names.values()], pa.string()) for i in range(2))], ["id", "host", "node"])

    names = read.select("host", "streams").mapInArrow(named, "id bigint, host string, node string").distinct()
    return names.join(aligned(read), "id").select("host", "node", "instances", "expression")


def aligned(read: DataFrame) -> DataFrame:
    """``id, instances, expression``: the wrappers of parsed pages, a row for each node."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for host, streams in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids: list[int] = []
                for line in streams.split("\n"):
                    above, label, stream = line.split(" ", 2)
                    ids.append(step(ids[int(above)], label) if ids else step(0, host))
                    counts[ids[-1], stream] += 1
            nodes: dict[int, Node] = {}
            for (node, stream), n in counts.items():
                nodes.setdefault(node, Node()).align(stream.split(" ") if stream else [], n)
            rows = [(i, a, b, n) for i, x in nodes.items() for a, b, n in [("", "", x.n), *(("", b, n) for b, n in x.having.items()), *((a, b, 0) for a, b in x.follows)]]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], ["id", "a", "b", "n"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # the distinct labels of a node, not its instances
        for batch in batches:
            sizes, texts = [], []
            for parts in batch.column(1).to_pylist():
                node = Node()
                for part in parts:
                    if part["a"]:
                        node.follows.add((part["a"], part["b"]))
                    elif part["b"]:
                        node.having[part["b"]] = part["n"]
                    else:
                        node.n = part["n"]
                sizes.append(node.n)
                texts.append(expression(node.items()))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], ["id", "instances", "expression"])

    rows = read.select("host", "streams").mapInArrow(partial, "id bigint, a string, b string, n bigint")
    rows = rows.groupBy("id", "a", "b").agg(F.sum("n").alias("n"))
    rows = rows.groupBy("id").agg(F.collect_list(F.struct("a", "b", "n")).alias("parts"))
    return rows.mapInArrow(whole, "id bigint, instances bigint, expression string")


def wrapped(read: DataFrame, wrappers: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, Broadcast | None]:
    """Parsed pages and their wrappers' rules: broadcast as sorted arrays, or beyond the limit in a column ``rules``, for each page those of its own labels."""

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for label, code in rules(read_expression(text)):
                    ids.append(step(node, label))
                    codes.append(code)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(codes, pa.int64())], ["id", "code"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = {(page, x) for page, host, streams in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for *_, items in placed(host, streams) for x in items}
            yield pa.record_batch([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], ["page", "id"])

    told = stored(wrappers.select("id", "expression").mapInArrow(compiled, "id bigint, code bigint"), "wrapper-rules")
    if 16 * told.count() <= broadcast_bytes:
        table = told.orderBy("id").toArrow()
        return read, read.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("id", "code")))
    pairs = read.select("page", "host", "streams").mapInArrow(own, "page bigint, id bigint").distinct()
    return read.join(pairs.join(told, "id").groupBy("page").agg(F.collect_list(F.struct("id", "code")).alias("rules")), "page", "left"), None


#: The columns by which ``reads`` reads a page.
READ = ("host", "streams", "at", "texts")


def reads(batch: pa.RecordBatch, shared: Broadcast | None) -> Iterator[Read]:
    """The batch's pages by their wrappers."""
    common = Rules(*shared.value) if shared else None
    given = [common] * batch.num_rows if shared else (defaultdict(lambda: None, ((x["id"], x["code"]) for x in r or ())) for r in batch.column("rules").to_pylist())
    for host, streams, at, texts, own in zip(*(batch.column(c).to_pylist() for c in READ), given, strict=True):
        yield Read(host, streams, at, texts, own)


def slots(pages: DataFrame, shared: Broadcast | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the slots of the wrappers' expressions hold (pages and rules of ``wrapped``): ``read`` (page, node, place, key, size, heading: a row a text), ``own`` (node, own, headings: characters of slots a page) and ``template`` (key)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for fp, read in zip(batch.column("page").to_pylist(), reads(batch, shared), strict=True):
                seen = set()
                for (_, heading, text), (node, place, key) in zip(read.blocks, read.keys, strict=True):
                    if key not in seen:
                        seen.add(key)
                        for column, x in zip(out, (fp, node, place, key, len(text), heading), strict=True):
                            column.append(x)
            types = [pa.int64()] * 5 + [pa.bool_()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(out, types, strict=True)], ["page", "node", "place", "key", "size", "heading"])

    rows = pages.where("at <> ''").select("page", *READ, *(() if shared else ("rules",)))
    read = stored(rows.mapInArrow(texts, "page bigint, node bigint, place bigint, key bigint, size bigint, heading boolean"), "page-texts")
    once = read.groupBy("node", "place", "key", "page").agg(F.max("size").alias("size"), F.max("heading").alias("heading"))  # repeated pages count once
    by_key = stored(once.groupBy("node", "place", "key").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max("heading").alias("heading")), "page-keys")
    places = read.select("place", "page").distinct().groupBy("place").agg(F.count("*").alias("pages"))
    agreed = by_key.where(F.col("n") >= AGREE)  # the few texts that may be template
    template = agreed.join(places, "place").where(SHARE * F.col("n") > F.col("pages")).select("node", "key", "n", "size", "heading")
    chars = F.col("n") * F.col("size")
    mass = by_key.select("node", chars.alias("c"), "heading").union(template.select("node", -chars, "heading")).groupBy("node").agg(
        F.sum("c").alias("c"), F.sum(F.when(F.col("heading"), F.col("c")).otherwise(0)).alias("h"))
    on = read.select("node", "page").distinct().groupBy("node").agg(F.count("*").alias("pages"))
    own = mass.join(on, "node").select("node", (F.col("c") / F.col("pages")).alias("own"), (F.col("h") / F.col("pages")).alias("headings"))
    return read, own, template.select("key")


#: Bytes of all wrappers that may be broadcast (16 a label of a node; 24 a node and 8 a template text of the slots); beyond, each page is joined with those of its own nodes and texts.
BROADCAST_BYTES = 32 << 20


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    once = stored(parsed(pages, id_col, url_col, html_col), "parsed-pages", "zstd")
    known, rules = wrapped(once, aligned(once), broadcast_bytes)
    read, own, template = slots(known, rules)
    own, template = stored(own, "own"), stored(template.distinct(), "template")
    kind = dict(pages.dtypes)[id_col]
    schema, names = f"page_id {kind}, url string, text string, n_chars bigint", ["page_id", "url", "text", "n_chars"]
    needed = ["page_id", "url", *READ, *(() if rules else ("rules",))]

    def told(batch: pa.RecordBatch, says) -> pa.RecordBatch:
        texts = [page.text(*s) for page, s in zip(reads(batch, rules), says, strict=True)]
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names)

    if 24 * own.count() + 8 * template.count() <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast(({r.node: (r.own, r.headings) for r in own.collect()}, {r.key for r in template.collect()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield told(batch, [shared.value] * batch.num_rows)

        return known.select(*needed).mapInArrow(run, schema)
    nodes = read.select("page", "node").distinct().join(own, "node").groupBy("page").agg(F.collect_list(F.struct("node", "own", "headings")).alias("nodes"))
    keys = read.select("page", "key").distinct().join(template, "key").groupBy("page").agg(F.collect_list("key").alias("keys"))
    joined = known.join(nodes, "page", "left").join(keys, "page", "left")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield told(batch, [({x["node"]: (x["own"], x["headings"]) for x in n or ()}, set(k or ())) for n, k in zip(batch.column("nodes").to_pylist(), batch.column("keys").to_pylist(), strict=True)])

    return joined.select(*needed, "nodes", "keys").mapInArrow(run_joined, schema)
