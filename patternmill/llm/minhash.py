"""MinHash near-duplicates by a join on signature coordinates, confirmed on full shingle sets.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes) and a signature of
   COORDINATES minima. Rows with equal sets form a class; only classes are compared.
2. A class is posted under every (coordinate, value) pair. Values that no other class has
   cannot collide and are dropped; a class left with fewer than MATCHES pairs has no partner
   and goes. Of the rest a partner must be met within all but the MATCHES - 1 most frequent,
   so only those rarest pairs (the prefix) stay as postings.
3. Each posting list is first compared with one of its members, the hub, which costs no
   more than the list is long. Collisions are counted over FINE further coordinates, which
   only posted classes get; pairs from FINE_MATCHES on are confirmed on full sets, and
   connected components merge what is linked.
   Further turns take a hub outside the list's first component.
4. Pairs inside one component need no look (they are skipped). What still has several
   components in one list is compared completely: short lists by a join, long ones in blocks
   of BLOCK members whose signatures meet in numpy and of which only pairs above the
   threshold leave the task. No list is cut, so a pair is lost only if fewer than MATCHES
   coordinates agree, or fewer than FINE_MATCHES of the further ones: for a similarity of
   0.75, with a chance of about 1e-6.

Long lists are never gathered in one task: counts and hubs come from partial aggregation,
joins on a hot pair or hub are split by adaptive execution, and blocks bound the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import digest_of, release, stored, unused

WORDS = 5
#: Similarity in hundredths from which documents are linked.
SIMILAR = 75
COORDINATES = 48
MATCHES = 21
#: Further coordinates of the classes that are posted, and how many of them must agree.
FINE = 256
FINE_MATCHES = 156
#: Members of a posting list that are joined directly, and of a block of a longer one.
SHORT = 16
BLOCK = 512
#: Rounds in which lists are compared with a hub before they are compared completely.
HUB_TURNS = 3
#: Words that a worker remembers at most, and their bytes.
MEMO_LIMIT = 300_000
MEMO_BYTES = 64

_M = np.uint64(0x9E3779B97F4A7C15)
_R = np.random.default_rng(11)
_A = (_R.integers(0, 1 << 63, COORDINATES + FINE, np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _R.integers(0, 1 << 63, COORDINATES + FINE, np.uint64)
_POSTED, _FINE = slice(0, COORDINATES), slice(COORDINATES, COORDINATES + FINE)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_LIMIT:
                self.clear()
            self[word] = h
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; with fewer words, of the whole sequence as one."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    out = h[:n].copy()
    for i in range(1, WORDS):
        out = out * _M + h[i : i + n]
    out ^= out >> np.uint64(32)
    out *= _M
    return np.unique(out ^ (out >> np.uint64(29)))


def signature(found: np.ndarray, which: slice = _POSTED) -> np.ndarray:
    a, b = _A[which], _B[which]
    best = np.full(len(a), np.uint64(0xFFFFFFFF))
    for at in range(0, len(found), 256):
        part = found[at : at + 256]
        np.minimum(best, ((part[None, :] * a[:, None] + b[:, None]) >> np.uint64(32)).min(1), out=best)
    return best.astype(np.uint32).view(np.int32)


def _join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Joins by shuffling. Spark takes exploded lists and well compressed ids for many times
    smaller than they are; a broadcast decided on that fills the driver.
    """
    return left.join(right.hint("merge"), on, how)


def _sketches(docs: DataFrame) -> DataFrame:
    """Per row: key, doc_id, n_shingles, node (a 128-bit digest of the set) and signature; both null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, signatures = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                sizes.append(len(found))
                nodes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.list_(pa.int32()))],
                names=["key", "doc_id", "n_shingles", "node", "signature"],
            )

    return docs.select("key", "doc_id", "text").mapInArrow(run, "key binary, doc_id long, n_shingles long, node binary, signature array<int>")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            fine = [signature(x, _FINE) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array(fine, pa.list_(pa.int32()))], names=["v", "found", "fine"])

    return docs.select("v", "text").mapInArrow(run, "v long, found array<long>, fine array<int>")


def _sizes_fit(a: str, b: str) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * SIMILAR


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose sizes allow a link and whose fine signatures agree often enough."""
    left = classes.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("fine").alias("sa"))
    right = classes.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("fine").alias("sb"))
    same = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return _join(_join(pairs, left, "a"), right, "b").filter(_sizes_fit("na", "nb")).filter(same >= FINE_MATCHES).select("a", "b")


class _Confirm:
    """Confirms pairs on full sets; each class's set is made once, from one document of the class."""

    def __init__(self, docs: DataFrame, classes: DataFrame, members: DataFrame):
        wanted = _join(members.select("v").distinct(), classes.select("v", "key"), "v")
        self.sets = stored(_sets(_join(docs.select("key", "text"), wanted, "key").dropDuplicates(["key"]).select("v", "text")), "near-sets")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        left = self.sets.select(F.col("v").alias("a"), F.col("found").alias("fa"))
        right = self.sets.select(F.col("v").alias("b"), F.col("found").alias("fb"))
        both = F.size(F.array_intersect("fa", "fb"))
        every = F.size("fa") + F.size("fb") - both
        return _join(_join(pairs, left, "a"), right, "b").select("a", "b", (both * 100 >= every * SIMILAR).alias("linked"))


def components(links: DataFrame, labels: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """(v, component) for every row of nodes (v): the smallest node reachable over links (a, b).

    labels, if given, is the answer for earlier links; only the components that new links
    join are worked on. Each round takes the smallest label among a component's neighbours
    and then the label of that label, so long chains shrink by doubling. Rounds are stored;
    only whether anything changed reaches the driver.
    """
    if labels is None:
        labels = nodes.select("v", F.col("v").alias("component"))
    ends = _join(links, labels.select(F.col("v").alias("a"), F.col("component").alias("x")), "a")
    ends = _join(ends, labels.select(F.col("v").alias("b"), F.col("component").alias("y")), "b")
    ends = ends.filter("x <> y")
    both = stored(ends.select("x", "y").union(ends.select(F.col("y"), F.col("x"))).distinct(), "near-links")
    own, before = both.select("x").distinct().withColumn("c", F.col("x")), None
    while True:
        near = _join(both, own.select(F.col("x").alias("y"), "c"), "y").groupBy("x").agg(F.min("c").alias("near"))
        lower = _join(own, near, "x").select("x", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        step = stored(_join(lower, lower.select(F.col("x").alias("c"), F.col("c").alias("next")), "c").select("x", "old", F.col("next").alias("c")), "near-step")
        if before is not None:
            release(before)
        own, before = step.select("x", "c"), step
        if step.filter("c <> old").isEmpty():
            break
    renamed = _join(labels, own.select(F.col("x").alias("component"), "c"), "component", "left")
    named = stored(renamed.select("v", F.coalesce("c", "component").alias("component")), "near-labels")
    release(both, step)
    return named


def _block_links(long: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components, from lists cut into blocks.

    Every two blocks of a list meet in one group of at most about 2 * BLOCK rows. Pairs that
    collide often enough are confirmed there on full sets, so only links leave the task.
    """
    rows = long.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("second"), "v", "component")
    rows = _join(_join(rows, classes.select("v", "n", "signature", "mask"), "v"), sets.select("v", "found"), "v")

    def run(table: pa.Table) -> pa.Table:
        v, n, second, component, mask = (table.column(c).to_numpy() for c in ("v", "n", "second", "component", "mask"))
        coordinate = table.column("token")[0].as_py() >> 32
        bits = (mask[:, None] >> np.arange(COORDINATES)) & 1 > 0
        signatures = table.column("signature").combine_chunks().flatten().to_numpy().reshape(len(v), -1)
        ends = np.cumsum(n)
        found = np.split(table.column("found").combine_chunks().flatten().to_numpy().view(np.uint64), ends[:-1])
        alone = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        left = np.arange(len(v)) if alone else np.flatnonzero(~second)
        right = left if alone else np.flatnonzero(second)
        out: list[np.ndarray] = []
        for i in left:
            j = right[(component[right] != component[i]) & ((v[right] > v[i]) | (not alone))]
            j = j[(np.minimum(n[j], n[i]) * 100 >= np.maximum(n[j], n[i]) * SIMILAR)]
            same = signatures[j] == signatures[i]
            # A pair meets in every list that both are posted in; the first of them reports it.
            j = j[(same.sum(1) >= MATCHES) & ((same & bits[j] & bits[i]).argmax(1) == coordinate)]
            if not len(j):
                continue
            flat, own = np.concatenate([found[k] for k in j]), found[i]
            hits = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
            common = np.add.reduceat(hits.astype(np.int64), np.concatenate([[0], np.cumsum(n[j])[:-1]]))
            j = j[common * 100 >= (n[i] + n[j] - common) * SIMILAR]
            out.append(np.stack([np.minimum(v[i], v[j]), np.maximum(v[i], v[j])], 1))
        got = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(got[:, 0], pa.int64()), "b": pa.array(got[:, 1], pa.int64())})

    return rows.groupBy("token", "x", "y").applyInArrow(run, "a long, b long")


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart by id and text, in 128 bits."""
    return digest_of(F.col(id_col), F.col(text_col))


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: key, doc_id, n_shingles, component_id and component (a class number; null for an empty set)."""
    text = F.col(text_col).cast("string")
    docs = docs.select(row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = stored(_sketches(docs), "near-rows")
    classes = rows.filter("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("low"), F.any_value("key").alias("key"), F.any_value("n_shingles").alias("n"), F.any_value("signature").alias("signature")
    )
    # The number is given once: the stored table is what every later step reads.
    classes = stored(classes.withColumn("v", F.monotonically_increasing_id()), "near-classes")

    value = F.shiftleft(F.col("pos").cast("long"), 32) + F.col("value").cast("long") + F.lit(1 << 31)
    tokens = classes.select("v", F.posexplode("signature").alias("pos", "value")).select("v", value.alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    live = _join(tokens, shared, "token")
    by_class = Window.partitionBy("v")
    live = live.withColumn("own", F.count(F.lit(1)).over(by_class)).filter(F.col("own") >= MATCHES)
    live = live.withColumn("rank", F.row_number().over(by_class.orderBy("m", "token")))
    postings = stored(live.filter(F.col("rank") <= F.col("own") - (MATCHES - 1)).select("token", "v"), "near-postings")
    members = stored(postings.select("v").distinct(), "near-members")
    confirm = _Confirm(docs, classes, members)
    masks = postings.groupBy("v").agg(F.sum(F.expr("shiftleft(1L, cast(shiftright(token, 32) as int))")).alias("mask"))
    posted = _join(_join(classes.select("v", "n", "signature"), masks, "v"), confirm.sets.select("v", "fine"), "v")
    posted = stored(posted, "near-posted")
    #: Tables that only the search for links reads.
    made = [postings, members, confirm.sets, posted]

    lists, seen, labels = postings, None, None
    for turn in range(HUB_TURNS):
        if labels is None:
            hubs = lists.groupBy("token").agg(F.min("v").alias("a"))
            pairs = _join(lists, hubs, "token").filter("a <> v").select("a", F.col("v").alias("b"))
        else:
            # A member outside the list's first component, the same one for all lists where possible.
            other = F.when(F.col("component") != F.col("least"), F.struct(F.xxhash64("v", F.lit(turn)).alias("h"), "v", "component"))
            hubs = lists.groupBy("token").agg(F.min(other).alias("hub")).select("token", F.col("hub.v").alias("a"), F.col("hub.component").alias("of_a"))
            pairs = _join(lists, hubs, "token").filter("component <> of_a").select("a", F.col("v").alias("b"))
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs if seen is None else _join(pairs, seen.select("a", "b"), ["a", "b"], "left_anti")
        tried = stored(confirm(_alike(pairs, posted)), "near-hub-pairs")
        made.append(tried)
        seen = tried if seen is None else seen.union(tried)
        links = tried.filter("linked").select("a", "b")
        if links.isEmpty():
            labels = labels if labels is not None else stored(members.select("v", F.col("v").alias("component")), "near-labels")
            last = True
        else:
            labels, last = components(links, labels, members), turn == HUB_TURNS - 1
        marked = _join(postings, labels, "v")
        ends = marked.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
        lists = stored(_join(marked, ends.select("token", "m", "least"), "token"), "near-open")
        made.append(lists)
        if last or lists.isEmpty():
            break

    short = lists.filter(F.col("m") <= SHORT).select("token", "v", "component")
    other = short.select("token", F.col("v").alias("b"), F.col("component").alias("of_b"))
    found = _join(short, other, "token").filter("v < b and component <> of_b").select(F.col("v").alias("a"), "b").distinct()
    found = _alike(_join(found, seen.select("a", "b"), ["a", "b"], "left_anti"), posted)
    more = confirm(found).filter("linked").select("a", "b").union(_block_links(lists.filter(F.col("m") > SHORT), posted, confirm.sets))
    more = stored(more, "near-rest-links")
    if not more.isEmpty():
        labels = components(more, labels, members)
    release(*made, more)

    named = _join(labels, classes.select("v", "low"), "v")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = _join(_join(classes.select("v", "node", "low"), labels, "v", "left"), lowest, "component", "left")
    of_class = of_class.select("node", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("component", "v").alias("component"))
    full = rows.select("key", "doc_id", "n_shingles", "node").filter("node is not null")
    full = _join(full, of_class, "node").drop("node")
    empty = rows.filter("node is null").select("key", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return full.unionByName(empty)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_shingles, component_id, kept: one row for each input row.

    Words are the runs of bytes other than space and tab to carriage return, A to Z in lower
    case. A null, empty or blank text has no shingles, links with nothing and is its own
    component. Rows that repeat an id keep their rows; kept tells that doc_id is the
    smallest id of the component. A null id is never smallest nor kept. Other columns are ignored.
    """
    rows = _grouped(docs, id_col, text_col)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id (null last), rows without shingles all."""
    rows = stored(_grouped(docs, id_col, text_col), "near-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    keys = rows.filter("component is not null").groupBy("component").agg(first.alias("first")).select("first.key")
    keys = keys.union(rows.filter("component is null").select("key"))
    name = unused(docs, "__key")
    keyed = docs.withColumn(name, row_key(id_col, text_col))
    # Rows with one id and one text have one key; the first of them stays.
    return _join(keyed, keys.withColumnRenamed("key", name), name, "left_semi").dropDuplicates([name]).drop(name)
