"""Benchmark decontamination by greedy string tiling.

A test item leaks into a document to the extent that tiles cover it: equal runs of at least
LEAST words, no word in two tiles, the longest marked first. Tiles may lie in any order, so
a passage whose sentences were shuffled is covered like the original.

Runs of LEAST equal words (seeds) are joined first; only pairs of a document and an item
that share a seed are tiled. An item with fewer words is one seed, and has one tile, whole. Matches grow from seeds by running Karp-Rabin hashes: the hash
of any window follows from two prefix sums, so a match's length is found by doubling and
halving, and the words are compared once at the end. A heap yields the longest match; one
that meets marked words is cut to its free parts and goes back.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest_of

#: Words of a seed, and of the shortest tile.
LEAST = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Bytes of benchmark text that are broadcast at most; a larger benchmark is joined by shuffle.
BROADCAST_BYTES = 16 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: ASCII upper case becomes lower case, other ASCII but digits becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: Characters of scripts that put no spaces between words: Thai to Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = re.compile("([\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff])")
#: Bytes that do not start a character of three or four bytes, as all of those scripts have.
_NARROW = bytes(c for c in range(256) if c < 0xE0)


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII marks and white space; single characters of unspaced scripts."""
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    if data.translate(None, _NARROW):
        data = _UNSPACED.sub(r" \1 ", text).encode("utf-8", "surrogatepass")
    return data.translate(_TABLE).split()


class _Windows:
    """Karp-Rabin hashes of all windows of a sequence of numbers, modulo 2**64."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, _BASE, np.uint64)) if n else np.zeros(0, np.uint64)
            self.back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _INVERSE, np.uint64))]) if n else np.ones(1, np.uint64)
            mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum((mixed ^ (mixed >> np.uint64(31))) * power, dtype=np.uint64)])

    def at(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.back[start]


def tiles(item: np.ndarray, doc: np.ndarray, p: np.ndarray, t: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, words) from seeds item[p:p+least] == doc[t:t+least]."""
    # A seed that continues the one before it is part of the same match.
    order = np.lexsort((p, t - p))
    p, t = p[order], t[order]
    first = np.ones(len(p), bool)
    first[1:] = (t[1:] - p[1:] != t[:-1] - p[:-1]) | (p[1:] != p[:-1] + 1)
    p, t = p[first], t[first]
    a, b = _Windows(item), _Windows(doc)
    size = np.full(len(p), least)
    step = 1 << int(np.log2(max(1, len(item))))
    while step:
        longer = np.minimum(size + step, np.minimum(len(item) - p, len(doc) - t))
        same = (longer > size) & (a.at(p, longer) == b.at(t, longer))
        size = np.where(same, longer, size)
        step //= 2
    heap = [(-n, i, j) for n, i, j in zip(size.tolist(), p.tolist(), t.tolist(), strict=True) if np.array_equal(item[i : i + n], doc[j : j + n])]
    heapq.heapify(heap)
    in_item, in_doc = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []
    while heap:
        n, i, j = heapq.heappop(heap)
        taken = in_item[i : i - n] | in_doc[j : j - n]
        if not taken.any():
            in_item[i : i - n] = in_doc[j : j - n] = True
            out.append((i, j, -n))
            if len(item) - int(in_item.sum()) < least:
                break  # no word is left for another tile
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[1], taken.view(np.int8), [1]])))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= least:
                heapq.heappush(heap, (s - e, i + s, j + s))
    return out


class Items:
    """A benchmark's items as numbered words, with an index of their seeds."""

    def __init__(self, rows: list[tuple[int, str]], least: int = LEAST):
        self.least = least
        self.number: dict[bytes, int] = {}
        self.ids = [i for i, _ in rows]
        # Word numbers start at 1; 0 is any word that no item has.
        self.words = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.int64) for _, text in rows]
        #: All items' words with a 0 before each item, and where the word before an item's first one stands.
        self.flat = np.concatenate([np.concatenate([[0], own]) for own in self.words] or [np.zeros(0)]).astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum([len(own) + 1 for own in self.words])]).astype(np.int64)
        #: Seeds by their number of words: sorted hashes, items, places in the items.
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(least, len(own)) for own in self.words if len(own)}):
            keys, of, at = [], [], []
            for k, own in enumerate(self.words):
                if min(least, len(own)) == size:
                    keys.append(_Windows(own).at(np.arange(len(own) - size + 1), size))
                    of.append(np.full(len(keys[-1]), k))
                    at.append(np.arange(len(keys[-1])))
            order = np.argsort(np.concatenate(keys), kind="stable")
            self.seeds[size] = np.concatenate(keys)[order], np.concatenate(of)[order], np.concatenate(at)[order]

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(number of the text, number of the item, tiles) for each pair that shares a seed."""
        own = [words(t) for t in texts]
        flat: list[bytes] = []
        starts = []
        for x in own:
            starts.append(len(flat))
            flat += x
            flat.append(b"")
        x = np.fromiter(map(self.number.get, flat, repeat(0)), np.int64, len(flat))
        known = np.concatenate([[0], np.cumsum(x > 0)])
        near = _Windows(x)
        for size, (keys, of, places) in self.seeds.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            hashes = near.at(at, size)
            low, high = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, "right")
            hit = high > low
            at, low, count = at[hit], low[hit], (high - low)[hit]
            if not len(at):
                continue
            pairs = [self._starts(x, at[own_], low[own_], count[own_], of, places) for own_ in self._pieces(count)]
            which, place = (np.concatenate(c) for c in zip(*pairs, strict=True))
            text = np.searchsorted(starts, place, "right") - 1
            item = of[which]
            order = np.lexsort((item, text))
            edges = np.flatnonzero((np.diff(text[order], prepend=-1) != 0) | (np.diff(item[order], prepend=-1) != 0))
            for part in np.split(order, edges[1:]):
                k, i = int(text[part[0]]), int(item[part[0]])
                doc = x[starts[k] : starts[k] + len(own[k])]
                found = tiles(self.words[i], doc, places[which[part]], place[part] - starts[k], size)
                if found:
                    yield k, i, found


    @staticmethod
    def _pieces(count: np.ndarray, most: int = 1 << 20) -> Iterator[slice]:
        """Runs of places with about `most` pairs each."""
        cuts = np.searchsorted(np.cumsum(count), np.arange(most, int(count.sum()) + most, most))
        edges = [0, *sorted(set((cuts[:-1] + 1).tolist())), len(count)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield slice(a, b)

    def _starts(self, x: np.ndarray, at: np.ndarray, low: np.ndarray, count: np.ndarray, of: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a seed and a place where a match begins; words before both that are equal make it begin earlier."""
        which = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        place = np.repeat(at, count)
        before = self.flat[self.offset[of[which]] + places[which]]
        begins = (before == 0) | (place == 0) | (before != x[np.maximum(place - 1, 0)])
        return which[begins], place[begins]


_SCHEMA = "item_id long, coverage double, n_tiles int, longest int"


def _rows(ids: pa.Array, found: list[tuple[int, int, float, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.float64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]], names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])


def _measure(size: int, found: list[tuple[int, int, int]]) -> tuple[float, int, int]:
    return sum(n for _, _, n in found) / size, len(found), max(n for _, _, n in found)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs of a document and an item that tiles cover to at least `coverage` of the item's words.

    Returns doc_id, item_id, coverage, n_tiles, longest. Words are runs of characters other
    than ASCII marks and white space, ASCII letters lower-cased, and single characters of
    scripts without spaces; texts are read whole. An item with fewer than `least` words leaks
    where it is copied whole, one without words nowhere; a null text has no words, and a null
    id of either stays null. Repeated
    documents or items give repeated pairs. The benchmark is broadcast up to broadcast_bytes
    of text, and joined by its seeds beyond.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    if size > broadcast_bytes:
        return _joined(docs, items, coverage, least, kind)
    rows = sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    shared = docs.sparkSession.sparkContext.broadcast(Items(rows, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out, start, n = [], 0, 0
            for i, t in enumerate(texts):
                n += len(t)
                if n > 500_000 or i == len(texts) - 1:
                    for k, item, found in own.search(texts[start : i + 1]):
                        measured = _measure(len(own.words[item]), found)
                        if measured[0] >= coverage:
                            out.append((start + k, own.ids[item], *measured))
                    start, n = i + 1, 0
            yield _rows(batch.column(0), out)

    return docs.mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")


def _joined(docs: DataFrame, items: DataFrame, coverage: float, least: int, kind: str) -> DataFrame:
    """The way for a benchmark of any size: seeds meet by shuffle, then texts are tiled pair by pair."""

    sizes_of = F.udf(lambda text: min(least, len(words(text))), "int")
    sizes = sorted(r["n"] for r in items.select(sizes_of("text").alias("n")).distinct().collect() if r["n"])

    def seeds(df: DataFrame, key: str, key_kind: str, whole: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, text in enumerate(batch.column(1)):
                    own = words(text.as_py())
                    wanted = [n for n in (min(least, len(own)),) if n] if whole else sizes
                    found = {xxhash.xxh3_64_intdigest(b" ".join(own[k : k + n])) - (1 << 63) for n in wanted for k in range(len(own) - n + 1)}
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(found), pa.int64())), pa.array(sorted(found), pa.int64())], names=[key, "seed"])

        return df.mapInArrow(run, f"{key} {key_kind}, seed long")

    # Numbers stand for rows, so that rows with equal or null ids stay apart.
    docs = docs.withColumn("d", digest_of(F.col("doc_id"), F.col("text")))
    items = items.withColumn("b", digest_of(F.col("item_id"), F.col("text")))
    pairs = seeds(docs.select("d", "text").distinct(), "d", "binary", False).join(seeds(items.select("b", "text").distinct(), "b", "binary", True), "seed").select("d", "b").distinct()
    both = pairs.join(docs, "d").join(items.withColumnRenamed("text", "item"), "b").select("doc_id", "text", "item_id", "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (text, item_id, item) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                own = Items([(item_id, item)], least)
                for _, _, found in own.search([text]):
                    measured = _measure(len(own.words[0]), found)
                    if measured[0] >= coverage:
                        out.append((i, item_id, *measured))
            yield _rows(batch.column(0), out)

    return both.mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")
