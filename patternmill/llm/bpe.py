"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

The vocabulary's byte strings are placed by hash-and-displace: one 64-bit hash names a
bucket, and the bucket's displacement, found when the table is built, sends each of its
keys to a slot of its own. The table has exactly as many slots as keys. A lookup hashes
the pre-token once, reads one displacement and compares one stored key.

Pre-tokens that are not in the vocabulary are merged from their bytes: a doubly linked
list of parts and a heap of adjacent pairs by (rank, position), so the leftmost pair of
the lowest rank merges first and each merge costs a logarithm.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1
_MIX = 0x9E3779B97F4A7C15
#: Distinct pre-tokens whose ids a worker keeps; at more it starts afresh.
#: Pre-tokens that a worker remembers at most, and their characters; longer ones are encoded each time.
MEMO_LIMIT = 300_000
MEMO_CHARS = 64


def parse_ranks(data: bytes) -> list[bytes]:
    """The byte strings of a rank file, by rank; ranks must run from 0 without gaps."""
    pairs = [line.split() for line in data.splitlines() if line.strip()]
    tokens: list[bytes | None] = [None] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    if any(t is None for t in tokens):
        raise ValueError("the ranks have gaps")
    return tokens  # type: ignore[return-value]


class PerfectHash:
    """A minimal perfect hash over a fixed list of byte strings; get() gives a key's index or -1."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.keys = keys
        self.buckets = max(1, n // 2)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        if len(np.unique(hashes)) != n:
            raise ValueError("equal keys, or two keys with one hash")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        slot_of = np.zeros(n, np.int64)
        shift = np.zeros(self.buckets, np.int64)
        tries = np.arange(512, dtype=np.uint64)
        singles = []
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            own = order[bounds[b] : bounds[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                singles.append((b, own[0]))
                continue
            base = np.uint64(1)
            while True:
                d = tries + base
                slots = self._slots(hashes[own][:, None], d[None, :])
                free = ~taken[slots].any(axis=0)
                if len(own) > 1:
                    ranked = np.sort(slots, axis=0)
                    free &= (ranked[1:] != ranked[:-1]).all(axis=0)
                if free.any():
                    at = int(np.argmax(free))
                    break
                base += np.uint64(len(tries))
            taken[slots[:, at]] = True
            slot_of[own] = slots[:, at]
            shift[b] = int(d[at])
        # A bucket with one key goes straight to a slot that is still free.
        for (b, own), slot in zip(singles, np.flatnonzero(~taken), strict=True):
            slot_of[own] = slot
            shift[b] = -int(slot) - 1
        self.shift = shift.tolist()
        self.at = np.empty(n, np.int64)
        self.at[slot_of] = np.arange(n)
        self.at = self.at.tolist()

    def _slots(self, h, d):
        x = (h ^ (d * np.uint64(_MIX))) * np.uint64(_MIX)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def get(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else ((((h ^ (d * _MIX & _MASK)) * _MIX & _MASK) >> 32) % self.n)
        i = self.at[slot]
        return i if self.keys[i] == key else -1


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token by lowest-rank merges, leftmost first."""
    n = len(piece)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue  # one of the two parts has changed since
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := rank.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (j := before[i]) >= 0 and (r := rank.get(piece[j:stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = end[i]
    return out


class _Memo(dict):
    """Ids, packed, of pre-tokens seen before."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        out = self.codec.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_LIMIT:
                self.clear()
            self[piece] = out
        return out


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str, index: PerfectHash | None = None):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.index = index or PerfectHash(tokens)
        self.pattern = regex.compile(pattern)
        self.memo = _Memo(self)

    def encode_piece(self, piece: bytes) -> bytes:
        whole = self.index.get(piece)
        ids = [whole] if whole >= 0 else merge(piece, self.rank)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: By vocabulary and pattern: a worker that runs several tasks keeps its codec and memo.
_codecs: dict[str, Codec] = {}


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = False) -> DataFrame:
    """Encodes every whole text and decodes its ids again.

    Returns id_col, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of
    int) and decoded (the text of the decoded bytes). A null text counts as empty: no
    tokens, and the digests of nothing. Every row gives a row, repeated ones too; other
    columns are ignored. The vocabulary file is read on the driver and its table, of a size
    fixed by the file, is broadcast, so executors need no copy of the file.
    """
    spark = df.sparkSession
    with open(vocabulary, "rb") as f:
        data = f.read()
    tokens, key = parse_ranks(data), hashlib.sha256(data + pattern.encode()).hexdigest()
    shared = spark.sparkContext.broadcast((tokens, pattern, PerfectHash(tokens)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.get(key)
        if codec is None:
            codec = _codecs[key] = Codec(*shared.value)
        for batch in batches:
            n, ids_hex, text_hex, kept, decoded = [], [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                back = codec.decode(ids)
                n.append(len(ids) // 4)
                ids_hex.append(hashlib.sha256(ids).hexdigest())
                text_hex.append(hashlib.sha256(back).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
                if keep_decoded:
                    decoded.append(back)
            columns = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_hex, pa.string()), "decoded_sha256": pa.array(text_hex, pa.string())}
            if keep_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            if keep_decoded:
                columns["decoded"] = pa.array(decoded, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded
    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
