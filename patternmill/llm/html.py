"""Main-text extraction by wrappers: union-free regular expressions learned from pages of one host.

A page becomes a stream of tokens: tags (name and class or id) and text. Streams are folded
(equal neighbours become a repeated group) to structures. All distinct structures of a host
are aligned, in parts and then part with part: a text is a slot, a repeated group's bodies
are merged, and what only one side has becomes optional. The result has sequence, (...)+ and (...)? but
no alternatives, and is matched as an automaton in time that grows with the page, which also
tells the slot of every text.

Blocks are judged whole: those in menus, forms, footers and the like, those that are nothing
but links, and, outside a marked main part, those whose text is the same in their slot on
most pages of the host are no content. Everything else is kept, however short.
"""

from __future__ import annotations

import difflib
import html as entities
import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Parts that a host's distinct structures are dealt to; wrappers of parts merge level by level.
PARTS = (1024, 32, 1)
#: Different pages that must say the same before it counts as the host's; two may be copies.
LEAST_PAGES = 3
#: Bytes of wrappers that are broadcast at most; more are joined to the pages by host.
BROADCAST_BYTES = 32 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"|<(script|style|noscript|template|svg|iframe|textarea|select|math|object|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>",
    re.S | re.I,
)
_NAME = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_NO_TEXT = frozenset("nav footer aside form button head title menu dialog option label figcaption audio video map".split())
_NO_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|menu|nav\w*|breadcrumbs?|side-?bar|widget|footer|masthead|site-?header|page-?header|top-?bar|header|cookies?|consent|"
    r"notice|alert|popup|modal|newsletter|subscribe|share|social|related|recommend\w*|comments?|comment-?list|respond|reply|replies|discussion|pagination|pager|tags?|meta|login|search|toolbar|skip|copyright|legal|disclaimer)(?:$|[\s_-]|\d)",
    re.I,
)
_MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:main|content|article|post|entry|story|body-?text)(?:$|[\s_-])", re.I)

Token = tuple[str, str, str]  # symbol, tag ('' for text, '/x' for an end), text or names


def tokens(page: str) -> list[Token]:
    """Tags and non-blank texts in page order, without comments, scripts, styles and the like."""
    out: list[Token] = []
    at = 0

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            out.append(("#", "", piece))

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        slash, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if slash:
            out.append((f"/{name}", f"/{name}", ""))
        else:
            names = " ".join(x for got in _NAME.findall(attributes) for x in got if x) if "=" in attributes else ""
            out.append((f"{name}.{re.sub('[0-9]+', '', names)}" if names else name, name, names))
    text(page[at:])
    return out


def places(stream: list[Token]) -> list[tuple[bool, bool, bool]]:
    """For each token: whether it lies in a part without content, in the main part, in a link."""
    stack: list[tuple[str, bool, bool]] = []
    out = []
    bad = main = link = 0
    for _, tag, names in stream:
        if tag and tag[0] != "/":
            if tag not in _VOID:
                is_main = tag in ("article", "main") or bool(names and _MAIN_NAME.search(names) and tag in ("div", "section", "td"))
                is_bad = tag in _NO_TEXT or (tag == "header" and not main) or bool(names and tag not in ("body", "html", "article", "main") and _NO_NAME.search(names))
                stack.append((tag, is_bad, is_main))
                bad, main, link = bad + is_bad, main + is_main, link + (tag == "a")
        elif tag:
            name = tag[1:]
            # An end tag closes the nearest open tag of its name; a block is not closed by an inline tag's end.
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for t, b, m in stack[i:]:
                        bad, main, link = bad - b, main - m, link - (t == "a")
                    del stack[i:]
                    break
                if name in _INLINE and stack[i][0] not in _INLINE:
                    break
        out.append((bad > 0, main > 0, link > 0))
    return out


# ---- wrappers: nodes are a symbol, ("+", nodes) or ("?", nodes)


def fold(nodes: list) -> list:
    """Replaces runs of equal neighbouring sequences by a repeated group, short periods first.

    Periods go up to half of the sequence. One is looked at only where it occurs: where as
    many neighbouring nodes as the period equal those a period later.
    """
    number: dict = {}
    x = np.array([number.setdefault(n, len(number)) for n in nodes])
    size = 1
    while 2 * size <= len(nodes):
        apart = np.flatnonzero(x[size:] != x[:-size])
        if np.diff(apart, prepend=-1, append=len(x) - size).max() > size:
            out, i = [], 0
            while i < len(nodes):
                body = nodes[i : i + size]
                n = 1
                while len(body) == size and nodes[i + n * size : i + (n + 1) * size] == body:
                    n += 1
                if n > 1 and not (size == 1 and body[0] == "#"):
                    out.append(_repeated(body))
                    i += n * size
                else:
                    out.append(nodes[i])
                    i += 1
            if len(out) < len(nodes):
                x = np.array([number.setdefault(n, len(number)) for n in out])
            nodes = out
        size += 1
    return nodes


def _repeated(body: list) -> tuple:
    if len(body) == 1 and body[0][0] == "+":
        return body[0]
    if len(body) == 1 and body[0][0] == "?":
        return ("?", (_repeated(list(body[0][1])),))
    return ("+", tuple(body))


def _bare(node: object) -> object:
    return node[1][0] if node[0] == "?" else node


def _optional(node: object) -> tuple:
    """A node that may be missing; only single nodes are optional, so that they align one by one."""
    return node if node[0] == "?" else ("?", (node,))


def align(wrapper: list, other: list) -> list:
    """The least general wrapper, in this alignment, that covers both sides (tokens or wrappers)."""
    out: list = []
    left, right = [_bare(n) for n in wrapper], [_bare(n) for n in other]

    def add(node: object, *sides: object) -> None:
        out.append(_optional(node) if any(n[0] == "?" for n in sides) else node)

    for what, a, b, c, d in difflib.SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if what == "equal":
            for x, y in zip(wrapper[a:b], other[c:d], strict=True):
                add(_bare(x), x, y)
        elif b - a == d - c == 1 and left[a][0] == right[c][0] == "+":
            add(_repeated(align(list(left[a][1]), list(right[c][1]))), wrapper[a], other[c])
        elif b - a == 1 and left[a][0] == "+" and list(left[a][1]) == other[c:d]:
            out.append(wrapper[a])
        elif d - c == 1 and right[c][0] == "+" and list(right[c][1]) == wrapper[a:b]:
            out.append(other[c])
        else:
            out += [_optional(n) for n in wrapper[a:b] + other[c:d]]
    return fold(out)


def _pattern(nodes: tuple | list, letters: dict[str, str]) -> str:
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append("(#)?" if n == "#" else letters.setdefault(n, chr(0x4E00 + len(letters))))
        else:
            out.append(f"(?:{_pattern(n[1], letters)}){n[0]}")
    return "".join(out)


def _frozen(nodes: list) -> list:
    return [n if isinstance(n, str) else (n[0], tuple(_frozen(n[1]))) for n in nodes]


class Wrapper:
    """A wrapper as an automaton over tokens, of one position for each symbol.

    Sets of positions are bits of a number. A step from a set by a symbol is computed once
    and kept, so a page takes one look-up a token, and at most a pass over the wrapper.
    """

    def __init__(self, nodes: list, constant: frozenset[tuple[int, int]] = frozenset()):
        self.nodes, self.constant = nodes, constant
        self.symbols: list[str] = []
        self.next: list[tuple[int, ...]] = []  # where to go on, without a token, from each place
        self.at: list[int] = []  # the position at a place, or -1
        self._build(nodes)
        self.end = len(self.next)
        self.next.append(())
        self.at.append(len(self.symbols))
        self.of: dict[str, int] = defaultdict(int)
        self.places: list[int] = [0] * (len(self.symbols) + 1)
        for place, k in enumerate(self.at):
            if k >= 0:
                self.places[k] = place
                if k < len(self.symbols):
                    self.of[self.symbols[k]] |= 1 << k
        slots = [k for k, s in enumerate(self.symbols) if s == "#"]
        self.slot = {k: n for n, k in enumerate(slots)}
        self.n_slots = len(slots)
        self.follow: dict[int, int] = {}
        self.steps: dict[tuple[int, str], int] = {}

    @property
    def source(self) -> str:
        return _pattern(self.nodes, {})

    def _build(self, nodes: list | tuple) -> None:
        for n in nodes:
            start = len(self.next)
            if isinstance(n, str):
                # A text may always be missing.
                self.next.append((start + 1,) if n == "#" else ())
                self.at.append(len(self.symbols))
                self.symbols.append(n)
                continue
            self.next.append((start + 1,))
            self.at.append(-1)
            self._build(n[1])
            last = len(self.next)
            if n[0] == "?":
                self.next[start] = (start + 1, last)
            else:
                self.next.append((start + 1, last + 1))
                self.at.append(-1)

    def _after(self, k: int) -> int:
        """Positions that may follow position k (-1: that may come first)."""
        got = self.follow.get(k)
        if got is None:
            got, seen, todo = 0, set(), [0 if k < 0 else self.places[k] + 1]
            while todo:
                place = todo.pop()
                if place in seen:
                    continue
                seen.add(place)
                if self.at[place] >= 0:
                    got |= 1 << self.at[place]
                todo += self.next[place]
            self.follow[k] = got
        return got

    def _step(self, now: int, symbol: str) -> int:
        out, rest = 0, now
        while rest:
            low = rest & -rest
            out |= self._after(low.bit_length() - 1)
            rest ^= low
        out &= self.of.get(symbol, 0)
        if len(self.steps) > 50_000:
            self.steps.clear()
        self.steps[now, symbol] = out
        return out

    def match(self, stream: list[Token]) -> list[tuple[int, int]] | None:
        """(slot, token number) of every text that a slot took, or None where the page does not fit.

        Of several ways the one of the last positions is taken, from the page's end.
        """
        if not stream:
            return [] if self._after(-1) >> len(self.symbols) & 1 else None
        sets = [self._after(-1) & self.of.get(stream[0][0], 0)]
        for symbol, _, _ in stream[1:]:
            now = sets[-1]
            if not now:
                return None
            got = self.steps.get((now, symbol))
            sets.append(self._step(now, symbol) if got is None else got)
        out = []
        then = len(self.symbols)
        for i in range(len(stream) - 1, -1, -1):
            rest = sets[i]
            while rest:
                k = rest.bit_length() - 1
                if self._after(k) >> then & 1:
                    break
                rest ^= 1 << k
            else:
                return None
            if stream[i][0] == "#":
                out.append((self.slot[k], i))
            then = k
        return out[::-1]

    def dumps(self) -> str:
        return json.dumps([self.nodes, sorted(self.constant)])

    @staticmethod
    def loads(text: str) -> Wrapper:
        nodes, constant = json.loads(text)
        return Wrapper(_frozen(nodes), frozenset(map(tuple, constant)))


def structure(stream: list[Token]) -> list:
    return fold([s for s, _, _ in stream])


def merged(wrappers: list[list]) -> list:
    """One wrapper that covers all given ones, shorter ones first."""
    wrappers.sort(key=lambda w: (len(w), json.dumps(w)))
    out = wrappers[0]
    for other in wrappers[1:]:
        out = align(out, other)
    return out


def infer(pages: list[str]) -> Wrapper | None:
    """The wrapper of a host's pages, all of them; None where no page has a token."""
    streams = [s for s in map(tokens, dict.fromkeys(pages)) if s]
    if not streams:
        return None
    made = Wrapper(merged([_frozen(json.loads(t)) for t in {json.dumps(structure(s)) for s in streams}]))
    seen = Counter(x for stream in streams for x in repeatable(stream, made))
    made.constant = frozenset(x for x, n in seen.items() if constant_over(n, len(streams)))
    return made


def constant_over(n: int | Column, pages: int | Column) -> bool | Column:
    """Whether what n of a host's different pages say in a place is said by the host, not by them."""
    return (n >= LEAST_PAGES) & (n > 0.6 * pages)


def blocks(stream: list[Token], keep: set[int]) -> list[tuple[str, list[int]]]:
    """Text and token numbers of each block: kept texts between two tags that are not inline."""
    out: list[tuple[str, list[int]]] = []
    now: list[str] = []
    at: list[int] = []

    def close() -> None:
        block = " ".join(entities.unescape("".join(now)).split())
        if block:
            out.append((block, at.copy()))
        now.clear()
        at.clear()

    for i, (_, tag, text) in enumerate(stream):
        if not tag:
            if i in keep:
                now.append(text)
                at.append(i)
        elif tag.strip("/") == "br":
            now.append(" ")
        elif tag.strip("/") not in _INLINE:
            close()
    close()
    return out


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def repeatable(stream: list[Token], wrapper: Wrapper) -> set[tuple[int, int]]:
    """(slot, digest of the text) of each block that could be the same on other pages.

    A block has the slot of its first text. Parts that are dropped by name do not count.
    """
    found = wrapper.match(stream)
    slot_at = {at: slot for slot, at in found or ()}
    where = places(stream)
    return {(slot_at[own[0]], _digest(text)) for text, own in blocks(stream, {i for i in slot_at if not where[i][0]})}


def extract(page: str | None, wrapper: Wrapper | None) -> str:
    """The page's main text; empty for a null, blank or textless page.

    A page with texts in a marked main part is those. Of others every block is kept, whatever
    its length, but those that are links and nothing else, unless one is longer than a menu's
    (80 characters), and those that are constant over the host.
    """
    stream = tokens(page) if page else []
    where = places(stream)
    texts = {i for i, (_, tag, _) in enumerate(stream) if not tag and not where[i][0]}
    main = {i for i in texts if where[i][1]}
    if main:
        return "\n\n".join(text for text, _ in blocks(stream, main))
    constant = wrapper.constant if wrapper else frozenset()
    slot_at = {at: slot for slot, at in wrapper.match(stream) or ()} if constant else {}
    kept = []
    for text, own in blocks(stream, texts):
        linked = any(where[i][2] for i in own) and all(
            len(stream[i][2]) <= 80 if where[i][2] else not any(map(str.isalnum, entities.unescape(stream[i][2]))) for i in own
        )
        if not linked and (slot_at.get(own[0]), _digest(text)) not in constant:
            kept.append(text)
    return "\n\n".join(kept)


@lru_cache(512)
def _loaded(text: str) -> Wrapper:
    return Wrapper.loads(text)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _structures(pages: DataFrame) -> DataFrame:
    """Distinct (host, structure) over all pages (host, page)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stream = tokens(page)
                if stream:
                    found.add((host, json.dumps(structure(stream))))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in rows], pa.string()), pa.array([t for _, t in rows], pa.string())], names=["host", "nodes"])

    return pages.mapInArrow(run, "host string, nodes string").distinct()


def _merged(found: DataFrame) -> DataFrame:
    """(host, nodes) with one wrapper a host; wrappers of few distinct structures meet at each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def done() -> pa.RecordBatch:
            nodes = group[0] if len(group) == 1 else json.dumps(merged([_frozen(json.loads(t)) for t in group]))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int64()), pa.array([nodes], pa.string())], names=["host", "part", "nodes"])

        for batch in batches:
            for host, part, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (host, part):
                    if key:
                        yield done()
                    key, group = (host, part), []
                group.append(nodes)
        if key:
            yield done()

    found = found.select("host", F.xxhash64("nodes").alias("part"), "nodes")
    for parts in PARTS:
        dealt = found.withColumn("part", F.pmod("part", F.lit(parts))).repartition("host", "part").sortWithinPartitions("host", "part", "nodes")
        found = dealt.mapInArrow(run, "host string, part long, nodes string")
    return found.select("host", "nodes")


def _with_wrappers(rows: DataFrame, wrappers: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, object]:
    """rows (with __host) and __wrapper, or the broadcast of all wrappers where they are small."""
    size = wrappers.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    if size <= broadcast_bytes:
        known = rows.sparkSession.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.collect()})
        return rows.withColumn("__wrapper", F.lit(None).cast("string")), known
    return rows.join(wrappers.select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper")), "__host", "left"), None


def _constants(pages: DataFrame, wrappers: DataFrame, broadcast_bytes: int) -> DataFrame:
    """(host, constant) from counts over all different pages of each host."""
    rows, known = _with_wrappers(pages.withColumnRenamed("host", "__host"), wrappers, broadcast_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for page, host, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source = known.value.get(host) if known else own
                stream = tokens(page)
                if stream and source:
                    seen[host, -1, 0] += 1
                    seen.update((host, *x) for x in repeatable(stream, _loaded(source)))
            columns = list(zip(*((*k, n) for k, n in seen.items()), strict=True)) or [()] * 4
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "slot", "digest", "n"])

    counts = rows.select("__page", "__host", "__wrapper").mapInArrow(run, "host string, slot long, digest long, n long").groupBy("host", "slot", "digest").agg(F.sum("n").alias("n"))
    counts = stored(counts.filter((F.col("slot") < 0) | (F.col("n") >= LEAST_PAGES)), "slots")
    totals = counts.filter("slot < 0").select("host", F.col("n").alias("pages"))
    same = counts.filter("slot >= 0").join(totals, "host").filter(constant_over(F.col("n"), F.col("pages")))
    return same.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.array("slot", "digest")))).alias("constant"))


def learn_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, wrapper) from all pages of each host.

    Structures are made distinct and texts of slots counted where the pages are, so a host
    with a large share of all pages moves little to one place. Equal pages of a host count
    once, so copies do not make their text the host's; they meet by host and hash of the page.
    """
    page = F.col(html_col).cast("string")
    rows = pages.filter(page.isNotNull()).select(host_of(F.col(url_col)).alias("host"), page.alias("__page"))
    wrappers = stored(_merged(_structures(rows)).select("host", F.concat(F.lit("["), "nodes", F.lit(", []]")).alias("wrapper")), "structures")
    different = rows.groupBy("host", F.xxhash64("__page").alias("h"), F.octet_length("__page").alias("size")).agg(F.min("__page").alias("__page")).select("host", "__page")
    constant = _constants(different, wrappers, broadcast_bytes)
    nodes = F.expr("substring(wrapper, 1, length(wrapper) - 3)")
    return wrappers.join(constant, "host", "left").select("host", F.concat(nodes, F.coalesce("constant", F.lit("[]")), F.lit("]")).alias("wrapper"))


def extract_pages(pages: DataFrame, wrappers: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Returns id_col, url_col, text, n_chars for each page, whole pages read.

    wrappers (host, wrapper) should be a stored table. A null page has the empty text, a null
    url no host and so the wrapper of pages without a host. Repeated rows each give a row.
    """
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("__page"), host_of(F.col(url_col)).alias("__host"))
    rows, known = _with_wrappers(rows, wrappers, broadcast_bytes)
    rows = rows.select(id_col, url_col, "__page", "__host", "__wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, host, own in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                source = known.value.get(host.as_py()) if known else own.as_py()
                texts.append(extract(page.as_py(), _loaded(source) if source else None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"]
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return rows.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
