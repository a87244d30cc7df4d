"""Removal of repeated 200-byte strings by a sparse suffix array.

Every SPAN-byte string contains an anchor: the position whose GRAM-byte string has the
least hash among the string's grams. The anchor depends on the string alone, so two equal
strings have their anchors at the same place, and it is enough to sort the suffixes that
start at anchors, about one position in eighty.

1. Anchors whose gram is unique in the corpus cannot lie in a repeated string and go.
2. An anchor's context is all that a SPAN-byte string around its gram can reach. Where two
   places have one context (compared by 128-bit hash), all of it is repeated.
3. What is left are anchors with the same gram in different contexts, where a repeated
   passage begins or ends. Their suffixes are range-partitioned by their leading bytes with
   sampled splitters and sorted inside each bucket by multikey quicksort; neighbours that
   share a gram form a run. A string around an anchor is its part before and its part from
   the anchor on; for each anchor of a run the first and the last of its strings that
   another anchor of the run has too are found by hashes and confirmed on the bytes.
4. Runs at a bucket's ends may go on in other buckets, however long they are. Two anchors
   in different buckets share no more bytes behind the anchor than each shares with the end
   of its own bucket. So the runs at the ends are dealt out once more, by the bytes before
   the anchor, and compared in those buckets. Anchors that are apart in both orders share
   at most what each shares with the ends of both of its buckets: only strings within those
   bounds that could extend what was found are asked for, by a shuffle of their hashes.
5. Each text's repeated parts are joined and cut out.

Every anchor gives one row, not one for each string or partner, so rows grow with the input.
Texts that occur more than once are repeated as a whole; one copy stands for all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

#: Bytes of a string that must not repeat, and of the grams that anchors are chosen by.
SPAN = 200
GRAM = 40
WINDOW = SPAN - GRAM + 1
REACH = SPAN - GRAM
#: Suffixes in a bucket, about.
BUCKET = 20_000
#: Rows sampled for each bucket's splitter, about; Spark takes three times as many, and never over 3 million in all.
SAMPLES = 10

_rng = np.random.default_rng(23)
_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Powers:
    """Powers of the hash base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 14)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64))])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, _INVERSE, np.uint64))])


_powers = _Powers()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, the hashes of their grams, and two columns of hashes of their contexts."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
    _powers.need(n + 1)
    x = np.frombuffer(data, np.uint8)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[x] * _powers.up[:n], dtype=np.uint64)])
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * _powers.down[: n - GRAM + 1])
    # The upper half orders grams, the position below it makes the leftmost of equals the least.
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = len(keys)
    padded = np.full(-(-size // WINDOW) * WINDOW, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:size] = keys
    rows = padded.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    windows = size - WINDOW + 1
    least = np.minimum(behind[:windows], ahead[WINDOW - 1 : WINDOW - 1 + windows])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    digests = [xxhash.xxh3_128_digest(data[max(0, p - REACH) : p + SPAN], min(p, REACH)) for p in at.tolist()]
    return at, grams[at], np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _anchored(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in range(0, batch.num_rows, 512):
                part = batch.slice(piece, 512)
                columns: tuple[list, ...] = ([], [], [], [], [], [])
                for text in part.column(2):
                    data = text.as_buffer().to_pybytes()
                    at, gram, context = anchors(data)
                    own = (len(data), hashlib.sha256(data).hexdigest(), at.astype(np.int32), gram.view(np.int64), context[:, 0].view(np.int64), context[:, 1].view(np.int64))
                    for c, v in zip(columns, own, strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *arrays], names=["doc_id", "node", "n_bytes", "sha256", "at", "gram", "c1", "c2"])

    return docs.mapInArrow(run, "doc_id long, node binary, n_bytes long, sha256 string, at array<int>, gram array<long>, c1 array<long>, c2 array<long>")


def _suffixes(marked: DataFrame) -> DataFrame:
    """(suffix, before, node, at) for the wanted anchors of each text; before is reversed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for node, text, wanted in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                for at in wanted.as_py():
                    out[0].append(data[at : at + SPAN])
                    out[1].append(data[max(0, at - REACH) : at][::-1])
                    out[2].append(node.as_py())
                    out[3].append(at)
                    if len(out[0]) > 20_000:
                        yield _suffix_rows(out)
                        out = ([], [], [], [])
            yield _suffix_rows(out)

    return marked.mapInArrow(run, "suffix binary, before binary, node binary, at int")


def _suffix_rows(out: tuple) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["suffix", "before", "node", "at"])


def multikey_quicksort(words: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words: three-way partition on one word, then on the next."""
    order = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        low, high, depth = todo.pop()
        if high - low < 2 or depth == words.shape[1]:
            continue
        part = order[low:high]
        if high - low <= 48:
            own = words[part, depth:]
            order[low:high] = part[np.lexsort(own.T[::-1])]
            continue
        key = words[part, depth]
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        less, same = key < pivot, key == pivot
        order[low:high] = np.concatenate([part[less], part[same], part[~(less | same)]])
        a, b = low + int(less.sum()), low + int(less.sum()) + int(same.sum())
        todo += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _padded(column: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in column], np.int64)
    out = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in column), np.uint8).reshape(len(column), size)
    return out, lengths


class _Places:
    """Anchors as arrays: the bytes from each on, those before it (reversed), and both lengths."""

    def __init__(self, suffix: np.ndarray, suffix_size: np.ndarray, before: np.ndarray, before_size: np.ndarray):
        self.suffix, self.suffix_size, self.before, self.before_size = suffix, suffix_size, before, before_size

    def __len__(self) -> int:
        return len(self.suffix)

    def __getitem__(self, rows) -> _Places:
        return _Places(self.suffix[rows], self.suffix_size[rows], self.before[rows], self.before_size[rows])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.ascontiguousarray(x).view(">u8").astype(np.uint64) for x in (self.suffix, self.before))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes the rows of a share with those of b."""
    differs = a != b
    return np.where(differs.any(1), differs.argmax(1), a.shape[1])


def _string_hashes(p: _Places, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each row and each count 0..REACH of bytes before the anchor, and which strings lie in the text."""
    left, right = np.zeros((len(p), REACH + 1), np.uint64), np.zeros((len(p), REACH + 1), np.uint64)
    for i in range(REACH):
        left[:, i + 1] = (left[:, i] + _BYTE[p.before[:, i]]) * np.uint64(_BASE)
        right[:, i + 1] = (right[:, i] + _BYTE[p.suffix[:, GRAM + i]]) * np.uint64(_INVERSE)
    o = np.arange(REACH + 1)
    fits = (o <= p.before_size[:, None]) & (SPAN - o <= p.suffix_size[:, None])
    return _mix(_mix(left + o.astype(np.uint64) * _MIX) + right[:, ::-1] * _MIX + run[:, None]), fits


def repeated_strings(p: _Places, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the most and the least bytes before it in a string that its run has twice; -1 and SPAN for none.

    run numbers the runs. Hashes name the candidates; the two that count are compared byte by byte.
    """
    n = len(p)
    keys, fits = _string_hashes(p, run.astype(np.uint64) * _MIX)
    flat = np.flatnonzero(fits)
    flat = flat[np.argsort(keys.ravel()[flat])]
    ranked = keys.ravel()[flat]
    same = ranked[1:] == ranked[:-1]
    partner = np.full(n * (REACH + 1), -1, np.int32)
    partner[flat[1:][same]] = flat[:-1][same] // (REACH + 1)
    partner[flat[:-1][same]] = flat[1:][same] // (REACH + 1)
    partner = partner.reshape(n, REACH + 1)
    twin = partner >= 0
    some = twin.any(1)
    most = np.where(some, REACH - twin[:, ::-1].argmax(1), -1)
    least = np.where(some, twin.argmax(1), SPAN)
    rows = np.flatnonzero(some)
    wrong = np.zeros(n, bool)
    for o in (most, least):
        there = partner[rows, o[rows]]
        own, other = p[rows], p[there]
        wrong[rows] |= (there == rows) | (_common(own.before, other.before) < o[rows]) | (_common(own.suffix, other.suffix) < SPAN - o[rows])
    for i in np.flatnonzero(wrong).tolist():  # two strings with one hash: compare the anchor with its whole run
        others = np.flatnonzero(run == run[i])
        others = others[others != i]
        own, other = p[np.full(len(others), i)], p[others]
        ahead = np.minimum(np.minimum(_common(own.before, other.before), own.before_size), other.before_size)
        after = np.minimum(np.minimum(_common(own.suffix, other.suffix), own.suffix_size), other.suffix_size)
        holds = ahead + after >= SPAN
        most[i] = ahead[holds].max() if holds.any() else -1
        least[i] = (SPAN - after[holds]).min() if holds.any() else SPAN
    return most, least


_FOUND = "node binary, at int, most int, least int, reach int, ahead int, suffix binary, before binary"


def _resolve(suffixes: DataFrame, buckets: int, by_before: bool) -> DataFrame:
    """What is repeated around each anchor: node, at, most and least; reach and ahead are -1 where that is final.

    Else the anchor's run may go on in other buckets, with anchors that share at most `reach`
    bytes behind the anchor, or `ahead` bytes before it when dealt out by_before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:  # a bucket that no suffix fell in
            return
        table = pa.Table.from_batches(found).combine_chunks()
        p = _Places(*_padded(table.column("suffix").to_pylist(), SPAN), *_padded(table.column("before").to_pylist(), REACH))
        after, ahead = p.words()
        gram = GRAM // 8
        order = multikey_quicksort(np.concatenate([after[:, :gram], ahead, after[:, gram:]], 1) if by_before else np.concatenate([after, ahead], 1))
        p, after = p[order], after[order]
        new = np.concatenate([[True], (after[1:, :gram] != after[:-1, :gram]).any(1)])
        runs = np.cumsum(new)
        most, least = np.full(len(p), -1), np.full(len(p), SPAN)
        cuts = [0]
        for s in np.flatnonzero(new)[1:].tolist():  # whole runs, some thousand rows at a time
            if s - cuts[-1] > 4000:
                cuts.append(s)
        for low, high in zip(cuts, [*cuts[1:], len(p)], strict=True):
            most[low:high], least[low:high] = repeated_strings(p[low:high], runs[low:high])
        bound = np.full(len(p), -1)
        side = p.before if by_before else p.suffix
        for edge in (0, len(p) - 1) if buckets > 1 else ():
            own = np.flatnonzero(runs == runs[edge])
            bound[own] = np.maximum(bound[own], _common(side[own], side[np.full(len(own), edge)]))
        table = table.take(pa.array(order))
        reach = np.full(len(p), -1)
        if by_before:
            reach = table.column("reach").to_numpy()
            most = np.maximum(most, table.column("most").to_numpy())
            least = np.minimum(least, table.column("least").to_numpy())
        open_ = bound >= 0
        numbers = [most, least, np.where(open_, reach if by_before else bound, -1), np.where(open_ & by_before, bound, -1)]
        out = [table.column("node"), table.column("at"), *[pa.array(x.astype(np.int32)) for x in numbers]]
        for name in ("suffix", "before"):  # bytes go on only with what is open
            column = table.column(name)
            out.append(pa.array([v if o else None for v, o in zip(column.to_pylist(), open_.tolist(), strict=True)], pa.binary()))
        names = ["node", "at", "most", "least", "reach", "ahead", "suffix", "before"]
        yield from pa.table(out, names=names).filter(pa.array(open_ | (most >= 0))).to_batches(max_chunksize=10_000)

    by = (F.substring("suffix", 1, GRAM), "before", "suffix") if by_before else ("suffix", "before")
    return suffixes.repartitionByRange(buckets, *by).mapInArrow(run, _FOUND)


def _digests(rows: DataFrame) -> DataFrame:
    """(node, at, o, d1, d2) for the strings with o bytes before the anchor, of those that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for node, at, suffix, before, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for o in wanted:
                    if o <= len(before) and SPAN - o <= len(suffix):
                        for c, v in zip(out, (node, at, o, xxhash.xxh3_128_digest(before[:o] + suffix[: SPAN - o], o)), strict=True):
                            c.append(v)
            hashes = np.frombuffer(b"".join(out[3]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=["node", "at", "o", "d1", "d2"])

    return rows.select("node", "at", "suffix", "before", "wanted").mapInArrow(run, "node binary, at int, o int, d1 long, d2 long")


def _apart(rows: DataFrame) -> DataFrame:
    """(node, at, most, least) of strings shared by anchors that are apart in both orders."""
    low, high = F.greatest(F.lit(SPAN) - F.col("reach"), F.lit(0)), F.least(F.col("ahead"), F.lit(REACH))
    within = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("name", F.xxhash64(F.substring("suffix", 1, GRAM))).withColumn("within", within)
    extends = F.filter("within", lambda o: (o > F.col("most")) | (o < F.col("least")))
    # At most REACH + 1 counts are asked for in a run, whoever asks.
    asked = rows.select("name", F.explode(extends).alias("o")).distinct().groupBy("name").agg(F.collect_list("o").alias("asked"))
    wanted = rows.join(asked, "name").withColumn("wanted", F.array_intersect("within", "asked")).filter(F.size("wanted") > 0)
    strings = stored(_digests(wanted), "suffix-asked")
    twins = strings.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1", "d2")
    return strings.join(twins, ["d1", "d2"]).groupBy("node", "at").agg(F.max("o").alias("most"), F.min("o").alias("least"))


def _sampled(rows: DataFrame, by_before: bool, name: str) -> DataFrame:
    """_resolve's result, stored. Splitters come from SAMPLES rows a bucket, as the driver holds the sample."""
    setting = "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    held = rows.sparkSession.conf.get(setting)
    rows.sparkSession.conf.set(setting, str(SAMPLES))
    try:
        return stored(_resolve(rows, max(1, -(-rows.count() // BUCKET)), by_before), name)
    finally:
        rows.sparkSession.conf.set(setting, held)


def _cut(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept_text's bytes cut by the spans of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text, parts in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                kept, at, spans, last = hashlib.sha256(), 0, 0, -1
                removed = 0
                for start, end in sorted((max(0, p["start"]), min(len(data), p["end"])) for p in parts.as_py()):
                    if start > last:
                        spans += 1
                        kept.update(data[at:start])
                        at = start
                    removed += max(0, end - at)
                    at = last = max(at, end)
                kept.update(data[at:])
                for c, v in zip(out, (len(data), removed, spans, kept.hexdigest()), strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def repeated_parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For docs (doc_id, node, text): one row a text with its size and digest, and (node, parts) of repeated parts.

    Texts that occur in several rows are marked by copies > 1 and have no parts: all of them is repeated.
    """
    rows = stored(_anchored(docs), "suffix-anchors")
    every = rows.select("node", F.explode(F.arrays_zip("at", "gram", "c1", "c2")).alias("x")).select("node", "x.at", "x.gram", "x.c1", "x.c2")
    # Stored, so that the join deals out both sides anew and can split a hot gram.
    shared = stored(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "suffix-grams")
    again = stored(every.join(shared, "gram"), "suffix-shared")
    release(shared)
    # Copies of a text repeat its anchors; only different places count.
    contexts = again.groupBy("gram", "c1", "c2").agg(F.min("node").alias("low"), ((F.min("node") != F.max("node")) | (F.min("at") != F.max("at"))).alias("twice"))
    contexts = stored(contexts, "suffix-contexts")
    several = stored(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram", F.lit(True).alias("several")), "suffix-several")
    judged = stored(contexts.join(several, "gram", "left").filter("twice or several"), "suffix-judged")
    release(contexts, several)
    marks = again.join(judged, ["gram", "c1", "c2"]).select("node", "at", "twice", (F.coalesce("several", F.lit(False)) & (F.col("node") == F.col("low"))).alias("wanted"))
    marks = stored(marks.filter("twice or wanted").distinct(), "suffix-marks")
    release(again, judged)

    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    wanted = marks.filter("wanted").groupBy("node").agg(F.collect_list("at").alias("at")).join(copies, "node").select("node", "at", "first")
    texts = docs.join(wanted, "node").filter(F.col("doc_id").eqNullSafe(F.col("first"))).select("node", "text", "at")
    suffixes = stored(_suffixes(texts), "suffix-rows")
    found = _sampled(suffixes, False, "suffix-found")
    release(suffixes)
    further = _sampled(found.filter("reach >= 0"), True, "suffix-edges")
    parts = (
        found.filter("reach < 0").select("node", "at", "most", "least")
        .unionByName(further.filter("most >= 0").select("node", "at", "most", "least"))
        .unionByName(_apart(further.filter("ahead >= 0")))
        .select("node", (F.col("at") - F.col("most")).alias("start"), (F.col("at") - F.col("least") + SPAN).alias("end"))
        .unionByName(marks.filter("twice").select("node", (F.col("at") - REACH).alias("start"), (F.col("at") + SPAN).alias("end")))
    )
    single = copies.filter("copies = 1").select("node")
    parts = stored(parts.join(single, "node", "left_semi").groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("parts")), "suffix-parts")
    release(found, further, marks)
    return rows.join(copies.select("node", "copies"), "node"), parts


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row.

    Every byte covered by a SPAN-byte string that also starts elsewhere, in any row or the
    same one, is removed; strings never cross rows and are judged on the input. A null text
    counts as empty, a null id stays null. Rows that repeat an id and text are copies of each
    other. Texts are told apart by 128-bit hashes. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    rows, parts = repeated_parts(docs)
    cut = _cut(docs.join(parts, "node").select("doc_id", "text", "parts"))
    rest = rows.join(parts.select("node"), "node", "left_anti")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= SPAN)
    rest = rest.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.lit(0)).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha256")).alias("kept_sha256"),
    )
    return cut.unionByName(rest)
