"""Main text of web pages through union-free wrappers that are inferred for each host.

A page is read as a stream of block-level elements, keyed by tag and class tokens, and text tokens. Class tokens that don't
recur on the host, such as a page's own name, are no keys, so that a wrapper is bounded by its template. Each page's stream is
folded first: neighbours that repeat, single or in groups, become one repeated group `( )+`. The distinct folded streams of a
host are then aligned in a fixed order, where an element that only one has becomes optional `( )?`; the result is a
union-free regular expression, the host's wrapper. Text tokens are aligned by value over the whole host: a text on nearly all
pages that have its place belongs to the template (`T`), other places are slots (`#`), which vary where they have several
texts or stand in a repeated group, and are still where they always have one. All of this is counted over distinct pages and
merged in an order that the data alone fix, so that the result doesn't depend on the partitioning.

On a page, what stands inside article or main is the article, template text included: headings and sentences that every
article of a host has are its own. A page without them is read by its wrapper: the slots that vary and aren't mostly links are
the article, still slots and template text are not. Tags and class words only say what is a menu, notice, advert, form or
comment; inside an article a class counts only where a whole token says so. A host with a single page has no template and no
still slots, so that its page is read by tags, class words and density alone.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, release
from .url_filter import host_and_path

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article main body div section".split())
#: Elements that never hold the article's text.
ASIDE = frozenset("nav footer aside form head title button select option textarea dialog menu iframe object svg canvas noscript label fieldset".split())
#: Words in class, id or role attributes, and the kind of part that they mark.
HINTS = {
    "ad": "ad ads advert advertisement advertising banner promo promoted sponsor sponsored".split(),
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs".split(),
    "head": "header masthead topbar".split(),
    "foot": "footer copyright colophon".split(),
    "side": "sidebar aside widget related recommended recommendations".split(),
    "note": "notice cookie cookies consent gdpr alert popup modal overlay subscribe newsletter paywall".split(),
    "talk": "comment comments reply replies disqus respond discussion".split(),
    "share": "share sharing social".split(),
    "form": "form search searchbox login signup".split(),
}
_HINT = {w: k for k, words in HINTS.items() for w in words}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|xmp)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)|</?\Z|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: A text is template where at least so many distinct pages of a host, and this share of those that have its place, have it.
TEMPLATE_PAGES, TEMPLATE_SHARE = 5, 0.9
#: A class token is a key where at least so many distinct pages of a host, and more than this share of them, have it.
KEY_PAGES, KEY_SHARE = 2, 0.01
#: What a wrapper says of a place counts from so many distinct pages on, and from this share of the host's pages.
SLOT_PAGES, SLOT_SHARE = 2, 0.01
#: Longest repeated group of elements, salts of the first alignment step, and bytes of all wrappers up to which they are
#: shared with every task; larger ones are joined to the pages.
GROUP, SALTS, SHARED_BYTES = 8, 64, 32 << 20
#: Bytes of what wrappers say that a task keeps parsed.
HELD_BYTES = 8 << 20


@lru_cache(4096)
def symbol(name: str, attrs: str) -> str:
    """An element's name with the tokens of its class, id and role, digits as 0, as in `div.ad.box`."""
    tokens: set[str] = set()
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            tokens.update(re.sub("[0-9]+", "0", (m[1] or m[2] or m[3] or "").lower()).split())
    return ".".join([name, *sorted(tokens)]) if tokens else name


def keyed(sym: str, keys: frozenset[str] | None) -> str:
    """A symbol with those of its tokens that are keys; with all of them if no keys are given."""
    name, _, rest = sym.partition(".")
    if keys is None or not rest:
        return sym
    return ".".join([name, *[t for t in rest.split(".") if t in keys]])


@lru_cache(4096)
def marks(sym: str) -> tuple[bool, bool]:
    """Whether class words mark an element as something else than the article: by any word, and by a whole token."""
    name, _, rest = sym.partition(".")
    if name in ("body", "html", "article", "main") or not rest:
        return False, False
    tokens = rest.split(".")
    return any(w in _HINT for t in tokens for w in _WORD.findall(t)), any(t in _HINT for t in tokens)


@lru_cache(1 << 16)
def below(path: int, sym: str) -> int:
    """A 63-bit name for the place of an element of this kind below another place."""
    return int.from_bytes(hashlib.blake2b(f"{path} {sym}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def read(page: str) -> Iterator[tuple[str, object]]:
    """Events of a page: ("open", symbol), ("close", symbol), ("text", decoded text), ("link", in a link or not)."""
    stack: list[tuple[str, str]] = []
    count: dict[str, int] = {}  # open elements of each name, so that no tag looks through the stack in vain

    def close(to: int) -> Iterator[tuple[str, object]]:
        while len(stack) > to:
            name, sym = stack.pop()
            count[name] -= 1
            yield "close", sym

    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            yield "text", html.unescape(m["text"])
            continue
        if not m["name"]:
            continue
        name = m["name"].lower()
        if name in INLINE:
            if name == "a":
                yield "link", not m["end"]
            continue
        if name in VOID:
            yield ("text", " ") if name in ("br", "wbr", "img", "input") else ("break", "")
            continue
        if m["end"]:
            if count.get(name):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        yield from close(i)
                        break
            continue
        closed = CLOSED_BY.get(name, frozenset())
        for names in (("p",) if name in CLOSES_P else (), closed):
            if any(count.get(n) for n in names):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in names:
                        yield from close(i)
                        break
                    if stack[i][0] in SCOPE:
                        break
        stack.append((name, symbol(name, m["attrs"] or "")))
        count[name] = count.get(name, 0) + 1
        yield "open", stack[-1][1]
    yield from close(0)


class Node:
    """An element of a wrapper, or a repeated group of several (sym is empty): children in order, whether it is optional or
    repeated, and whether it has text of its own."""

    __slots__ = ("children", "opt", "rep", "sym", "text")

    def __init__(self, sym: str, children: list[Node] | None = None) -> None:
        self.sym, self.children, self.opt, self.rep, self.text = sym, children or [], False, False, False

    def key(self) -> str:
        return self.sym or "(" + " ".join(c.sym for c in self.children) + ")"

    def dump(self) -> str:
        """One line for each node, parents first: depth, flags and symbol. No nesting, so any depth is fine."""
        lines, stack = [], [(self, 0)]
        while stack:
            n, depth = stack.pop()
            lines.append(f"{depth} {n.opt + 2 * n.rep + 4 * n.text} {n.sym}")
            stack += [(c, depth + 1) for c in reversed(n.children)]
        return "\n".join(lines)

    @classmethod
    def load(cls, lines: str) -> Node:
        path: list[Node] = []
        for line in lines.split("\n"):
            depth, flags, sym = line.split(" ", 2)
            n = cls(sym)
            n.opt, n.rep, n.text = (bool(int(flags) & k) for k in (1, 2, 4))
            del path[int(depth) :]
            if path:
                path[-1].children.append(n)
            path.append(n)
        return path[0]

    def expression(self, template: frozenset[int] = frozenset()) -> str:
        """The wrapper as a union-free regular expression; `template` holds the places with template text."""
        out, stack = [], [(self, 0, False)]
        while stack:
            n, path, done = stack.pop()
            if done:
                out.append(("</>" if n.sym else "") + (")" if n.rep or n.opt else "") + ("+" if n.rep else "") + ("?" if n.opt else ""))
                continue
            at = below(path, n.sym) if n.sym else path
            out.append(("(" if n.rep or n.opt else "") + (f"<{n.sym}>" if n.sym else "") + ("T" if at in template else "") + ("#" if n.text else ""))
            stack.append((n, path, True))
            stack += [(c, at, False) for c in reversed(n.children)]
        return "".join(out)


def fold(items: list[Node], todo: list[tuple[Node, Node]]) -> list[Node]:
    """Neighbours that repeat, as one repeated node or group; what has to be aligned for that goes to `todo`. Linear."""
    out: list[Node] = []
    keys = [n.key() for n in items]
    i = 0
    while i < len(items):
        if out:
            top = out[-1]
            if top.key() == keys[i]:
                todo.append((top, items[i]))
                top.rep = True
                i += 1
                continue
            m = len(top.children)
            if not top.sym and [c.sym for c in top.children] == keys[i : i + m]:
                todo += zip(top.children, items[i : i + m], strict=True)
                i += m
                continue
        p = 0
        if i + 1 < len(keys) and keys[i] != keys[i + 1]:
            p = next((p for p in range(2, GROUP + 1) if keys[i : i + p] == keys[i + p : i + 2 * p] and len(keys) >= i + 2 * p and all(n.sym for n in items[i : i + p])), 0)
        if p:
            group = Node("", items[i : i + p])
            group.rep = True
            out.append(group)
            i += p
        else:
            out.append(items[i])
            i += 1
    return out


def grouped(items: list[Node], other: list[Node], todo: list[tuple[Node, Node]]) -> list[Node]:
    """`items` with neighbours that make a repeated group of `other` as such a group."""
    known = {tuple(c.sym for c in n.children) for n in other if not n.sym}
    if not known:
        return items
    sizes, syms = sorted({len(k) for k in known}, reverse=True), [n.sym for n in items]
    out: list[Node] = []
    i = 0
    while i < len(items):
        m = next((m for m in sizes if tuple(syms[i : i + m]) in known), 0)
        out.append(Node("", items[i : i + m]) if m else items[i])
        i += m or 1
    return fold(out, todo)


def together(left: list[Node], right: list[Node], todo: list[tuple[Node, Node]]) -> list[Node]:
    """Both lists in one: equal keys are matched in order (each with the next one that is free, after equal ends), the
    others become optional. Takes n log n steps."""
    left, right = grouped(left, right, todo), grouped(right, left, todo)
    a, b = [n.key() for n in left], [n.key() for n in right]
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    places: dict[str, list[int]] = {}
    for k in range(lo, len(b) - hi):
        places.setdefault(b[k], []).append(k)
    pairs, at = [(k, k) for k in range(lo)], lo
    for k in range(lo, len(a) - hi):
        spots = places.get(a[k], ())
        j = bisect_left(spots, at)
        if j < len(spots):
            pairs.append((k, spots[j]))
            at = spots[j] + 1
    pairs += [(len(a) - k, len(b) - k) for k in range(hi, 0, -1)]
    out: list[Node] = []
    i = j = 0
    for x, y in [*pairs, (len(a), len(b))]:
        for n in left[i:x] + right[j:y]:
            n.opt = True
            out.append(n)
        if x < len(a):
            todo.append((left[x], right[y]))
            out.append(left[x])
        i, j = x + 1, y + 1
    return out


def align(a: Node, b: Node) -> Node:
    """The least wrapper found that covers both; `a` is changed into it. Works through a list of pairs, without recursion."""
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        x.opt, x.rep, x.text = x.opt or y.opt, x.rep or y.rep, x.text or y.text
        if y.children:
            x.children = fold(together(x.children, y.children, todo), todo) if x.children else y.children
            if x.children is y.children:
                y.children = []
    return a


class Element:
    """An element of one page, with the text of its own slot and of all below it. `sym` has all its tokens, `key` those that
    are keys."""

    __slots__ = ("article", "chars", "deep", "inside", "linked", "name", "node", "parent", "place", "sym")

    def __init__(self, sym: str, parent: Element | None, key: str | None = None) -> None:
        self.sym, self.parent, self.name = sym, parent, sym.partition(".")[0]
        key = sym if key is None else key
        self.place = below(parent.place, key) if parent else 0
        self.inside = self.name in ("article", "main") or parent is not None and parent.inside
        self.article = False  # an article or main lies below
        self.chars, self.linked, self.deep = 0, 0, 0
        self.node = Node(key)
        if parent:
            parent.node.children.append(self.node)


def page_blocks(page: str, keys: frozenset[str] | None = None) -> tuple[list[Element], list[tuple[Element, str]]]:
    """Elements of a page in order, parents first, and its blocks of text with the element whose slot holds each."""
    at = Element("", None)
    elements, blocks = [at], []
    named: dict[str, str] = {}
    part: list[str] = []
    link = False

    def end() -> None:
        if part:
            if said := " ".join("".join(part).split()):
                blocks.append((at, said))
                at.node.text = True
            part.clear()

    for kind, value in read(page):
        if kind == "text":
            part.append(value)
            n = len(" ".join(value.split()))
            at.chars += n
            at.linked += n * link
        elif kind == "link":
            link = bool(value)
        else:
            end()
            if kind == "open":
                if value not in named:
                    named[value] = keyed(value, keys)
                at = Element(value, at, named[value])
                elements.append(at)
            elif kind == "close" and at.parent is not None:
                at = at.parent
    end()
    for e in reversed(elements):
        e.deep += e.chars - e.linked
        if e.parent is not None:
            e.parent.deep += e.deep
            e.parent.article |= e.article or e.name in ("article", "main")
    return elements, blocks


def shape(elements: list[Element]) -> Node:
    """The wrapper of one page: its elements, with repeated neighbours folded from the innermost on."""
    for e in reversed(elements):
        todo: list[tuple[Node, Node]] = []
        e.node.children = fold(e.node.children, todo)
        for x, y in todo:
            align(x, y)
    return elements[0].node


class Slots(NamedTuple):
    """What a host's wrapper says of its places, and its keys (None: all tokens are)."""

    template: frozenset[tuple[int, int]]  # (place, text): text of the template
    still: frozenset[int]  # slots with the same text on all pages that have them
    links: frozenset[int]  # slots of mostly links
    keys: frozenset[str] | None = None


NOTHING = Slots(frozenset(), frozenset(), frozenset())


def text_print(said: str) -> int:
    return int.from_bytes(hashlib.blake2b(said.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> 1


def pruned(e: Element, root: Element) -> bool:
    """Marked as something else than the article, and not a hinted element or form with most of the page's text outside of
    links. A header is part of the article that it is in, and there a class counts only as a whole token."""
    if e.name == "header":
        return not e.inside
    if e.name in ASIDE:
        return e.name != "form" or 2 * e.deep <= root.deep
    return marks(e.sym)[e.inside] and 2 * e.deep <= root.deep


def content(elements: list[Element], known: Slots) -> set[Element]:
    """The elements whose slots hold the article of a page.

    Those inside article or main where the page itself has text there. Else all whose slots aren't still on the host and
    aren't mostly links; in the smallest element that has most of the page's text outside of links, a slot is one of links
    only if it is over the whole host. Parts that are marked as something else are left out.
    """
    for around in (False, True):  # an article in a marked part, such as a comment, counts where there is no other
        ok: set[Element] = set()
        for e in elements:
            if e.parent is None or e.parent in ok and (around and e.article or not pruned(e, elements[0])):
                ok.add(e)
        spots = [e for e in elements if e in ok]
        found = {e for e in spots if e.inside}
        if any(e.chars > e.linked for e in found):
            return found
    held = dict.fromkeys(spots, 0)
    for e in reversed(spots):
        held[e] += e.chars - e.linked
        if e.parent is not None:
            held[e.parent] += held[e]
    best = spots[0]
    for e in spots:
        if held[best] and held[e] >= 0.6 * held[spots[0]] and e.name in ("body", "div", "section", "td", "center", "form"):
            best = e
    own: dict[int, list[int]] = {}
    for e in spots:
        at = own.setdefault(e.place, [0, 0])
        at[0], at[1] = at[0] + e.chars, at[1] + e.linked
    under: set[Element] = set()
    out: set[Element] = set()
    for e in spots:
        if e is best or e.parent in under:
            under.add(e)
        links = own[e.place][1] > 0.5 * own[e.place][0]
        if e.place not in known.still and (not links or e in under and e.place not in known.links):
            out.add(e)
    return out


def extract(page: str, known: Slots = NOTHING) -> str:
    """The article's text: blocks in page order, one line each, white space inside a block as one space."""
    elements, blocks = page_blocks(page, known.keys)
    wanted = content(elements, known)
    return "\n".join(said for e, said in blocks if e in wanted and (e.inside or not (known.template and (e.place, text_print(said)) in known.template)))


_SEEN = pa.schema([("host", pa.string()), ("page", pa.int64()), ("shape", pa.string()), ("place", pa.int64()), ("text", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])


def _keys(shared, column: object) -> frozenset[str]:
    """The keys of a row's host: looked up by the host where they were sent to the task, else from the row itself."""
    said = shared.value.get(column) if shared is not None else column
    return frozenset(said or ())


def _see(shared):
    """Of each page (host, html, keys or host) a row with its folded stream, and one for each text token at each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for host, page, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                page = page.as_py()
                elements, blocks = page_blocks(page, _keys(shared, own))
                print_ = text_print(page)
                tokens: dict[tuple[int, int], tuple] = {}
                for e, said in blocks:
                    share = e.linked / max(1, e.chars)
                    tokens.setdefault((e.place, t := text_print(said)), (host, print_, None, e.place, t, len(said), round(share * len(said))))
                rows += tokens.values()
                rows.append((host, print_, shape(elements).dump(), None, None, None, None))
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SEEN.types, strict=True)], schema=_SEEN)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SEEN.types, strict=True)], schema=_SEEN)

    return run


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each run of rows with one (host, salt), which come in order; holds one wrapper at a time."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
    for (host, salt), group in groupby(rows, key=lambda r: r[:2]):
        wrapper = None
        for _, _, lines in group:
            node = Node.load(lines)
            wrapper = node if wrapper is None else align(wrapper, node)
        yield pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([salt], pa.int64()), pa.array([wrapper.dump()], pa.string())], names=["host", "salt", "shape"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each wrapper (host, salt, shape) its places with text, and those of them in a repeated group."""
    for batch in batches:
        found = [text_places(Node.load(lines)) for lines in batch.column(2).to_pylist()]
        lists = [pa.array([sorted(f[k]) for f in found], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], names=["host", "shape", "places", "repeated"])


def text_places(wrapper: Node) -> tuple[set[int], set[int]]:
    """The places of a wrapper that have text, and of these the ones in a repeated node or group."""
    known: set[int] = set()
    repeated: set[int] = set()
    stack: list[tuple[Node, int | None, bool]] = [(wrapper, None, False)]
    while stack:
        n, path, rep = stack.pop()
        at = 0 if path is None else below(path, n.sym) if n.sym else path
        rep = rep or n.rep
        if n.text:
            known.add(at)
            if rep:
                repeated.add(at)
        stack += [(c, at, rep) for c in n.children]
    return known, repeated


def _given(rows: DataFrame, table: DataFrame, column: str, shared_bytes: int):
    """(rows with `column`, what is shared): a value for each host, given to the rows of that host. Up to `shared_bytes` the
    table is sent to every task and the column is the host itself; beyond that it is joined, and Spark splits hot hosts."""
    size = table.agg(F.sum(F.octet_length(F.to_json(F.struct(column))) + F.octet_length("host"))).first()[0] or 0
    if size <= shared_bytes:
        sent = {r["host"]: r[column] for r in table.select("host", column).collect()}  # size checked
        return rows.withColumn(column, F.col("host")), rows.sparkSession.sparkContext.broadcast(sent)
    return rows.join(table.select("host", column), "host", "left"), None


def host_keys(rows: DataFrame) -> DataFrame:
    """(host, keys): the class, id and role tokens that recur on each host of (host, html), sorted, written. They are counted
    by expressions over the whole texts; a list has at most some 1 / `KEY_SHARE` times the tokens of a page."""
    said = F.regexp_extract_all("html", F.lit(r"(?i)[\x20\x09-\x0D\"'](?:class|id|role)\s*=\s*(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)"), 1)
    tokens = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(F.array_join(said, " ")), "[0-9]+", "0"), "[\\s\"']+"), lambda t: t != ""))
    pages = materialize(rows.select("host", F.xxhash64("html").alias("page"), tokens.alias("tokens")), "names")
    distinct = pages.groupBy("host", "page").agg(F.first("tokens").alias("tokens"))
    size = distinct.groupBy("host").agg(F.count("*").alias("size"))
    counted = distinct.select("host", F.explode("tokens").alias("token")).groupBy("host", "token").agg(F.count("*").alias("pages")).where(F.col("pages") >= KEY_PAGES)
    good = counted.join(size, "host").where(F.col("pages") > F.col("size") * KEY_SHARE)
    out = materialize(good.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("keys")), "keys")
    release(pages)
    return out


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """(host, shape, template, still, links, keys): the wrapper of each host of `pages`, written.

    `shape` is the expression's tree (`Node.load`), `template` lists (place, text) of template texts, `still` and `links` the
    places of slots with one text outside of repeated groups and of mostly links, `keys` the class tokens that recur. Pages
    that are equal count once. Null urls and urls without a host count as an empty host, null html as empty. Counts are
    pre-aggregated; the shapes of a host are aligned by salts of their hash first, so that a hot host is spread, and the
    wrappers of the salts, bounded by the template, one after another. Lists hold places on 1 % of a host's pages or more,
    which bounds them.
    """
    rows = pages.select(host_and_path(F.col(url_col).cast("string"))[0].alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keys = host_keys(rows)
    given, shared = _given(rows, keys, "keys", shared_bytes)
    spec = "host string, page long, shape string, place long, text long, chars long, linked long"
    seen = materialize(given.select("host", "html", "keys").mapInArrow(_see(shared), spec), "tokens")
    shapes = seen.where("shape is not null")
    size = materialize(shapes.groupBy("host", "page").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("size")), "hosts")
    aligned = shapes.groupBy("host", "shape").agg(F.lit(1)).select("host", F.pmod(F.xxhash64("shape"), F.lit(SALTS)).alias("salt"), "shape")
    aligned = aligned.repartition("host", "salt").sortWithinPartitions("host", "salt", "shape").mapInArrow(_align, "host string, salt long, shape string")
    aligned = aligned.repartition("host").sortWithinPartitions("host", "salt").select("host", F.lit(0).cast("long").alias("salt"), "shape").mapInArrow(_align, "host string, salt long, shape string")
    aligned = aligned.mapInArrow(_places, "host string, shape string, places array<long>, repeated array<long>")
    tokens = seen.where("place is not null").groupBy("host", "place", "text", "page").agg(F.max("chars").alias("chars"), F.max("linked").alias("linked"))
    texts = materialize(tokens.groupBy("host", "place", "text").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")), "texts")
    # Of a place: its distinct texts, the pages that have it, and how much of its text is in links.
    having = tokens.groupBy("host", "place", "page").agg(F.lit(1)).groupBy("host", "place").agg(F.count("*").alias("having"))
    places = texts.groupBy("host", "place").agg(F.count("*").alias("texts"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")).join(having, ["host", "place"])
    places = materialize(places.join(size, "host").where(F.col("having") >= F.col("size") * SLOT_SHARE).drop("size"), "places")
    common = texts.where(F.col("pages") >= TEMPLATE_PAGES).join(places.select("host", "place", "having"), ["host", "place"]).where(F.col("pages") >= F.col("having") * TEMPLATE_SHARE)
    template = common.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("template"))
    still, links = (F.col("texts") == 1) & (F.col("having") >= SLOT_PAGES), 2 * F.col("linked") > F.col("chars")
    lists = places.where(still | links).groupBy("host").agg(F.sort_array(F.collect_set(F.when(still, F.col("place")))).alias("still"), F.sort_array(F.collect_set(F.when(links, F.col("place")))).alias("links"))
    both = aligned.join(template, "host", "left").join(lists, "host", "left").join(keys, "host", "left")
    own = F.filter("template", lambda x: F.array_contains("places", x["place"]))
    kept = F.array_except(F.array_intersect("still", "places"), F.col("repeated"))
    out = materialize(both.select("host", "shape", own.alias("template"), kept.alias("still"), F.array_intersect("links", "places").alias("links"), "keys"), "wrappers")
    release(keys, seen, size, texts, places)
    return out


def slots_of(wrapper: str | None) -> Slots:
    """What a wrapper says of its places, from the JSON of its row without the shape."""
    if wrapper is None:
        return NOTHING
    w = json.loads(wrapper)
    return Slots(frozenset((x["place"], x["text"]) for x in w.get("template") or ()), frozenset(w.get("still") or ()), frozenset(w.get("links") or ()), frozenset(w.get("keys") or ()))


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, Slots] = {}
        held = 0
        for batch in batches:
            texts = []
            for page, w in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if w not in known:
                    said = w if shared is None else shared.value.get(w)
                    held += len(said or "")
                    if held > HELD_BYTES:  # parsed lists of the last hosts are kept, in bounded memory
                        known.clear()
                        held = len(said or "")
                    known[w] = slots_of(said)
                texts.append(extract(page.as_py(), known[w]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """(id, url, text, n_chars) for each row of `pages`: the article's blocks, joined by line ends; empty if there is none.

    Null html counts as empty. Repeated rows and null ids stay; other columns are ignored, whatever their names; an empty
    table gives no rows. Pages of any depth and length are read whole, in time that grows with their length but for the search
    of the wrapper's aligned ends, which is n log n; of elements with equally much text the last and so innermost counts.
    What wrappers say (lists of places and keys, not their shapes) is sent to every task up to `shared_bytes` for all hosts
    together; beyond that each page is joined with its host's.
    """
    wrappers = infer_wrappers(pages, url_col, html_col, shared_bytes)
    said = wrappers.select("host", F.to_json(F.struct("template", "still", "links", "keys")).alias("wrapper"))
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host_and_path(url)[0].alias("host"))
    given, shared = _given(rows, said, "wrapper", shared_bytes)
    out = given.select("id", "url", "html", "wrapper").mapInArrow(_extract(shared), "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)
    if shared is not None:
        release(wrappers)  # the tasks have what they need of it
    return out
