"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector's direction o is turned by a fixed random orthogonal matrix, in a space of BITS times
its dimensions, and kept as the signs of its coordinates there, one bit each. With o' the unit
vector of those signs and a = <o', o>, <o', q> / a estimates <o, q> without bias, and its error
is below EPSILON * sqrt((1 - a * a) / (a * a) / (D - 1)), D the number of bits, but for a share
of about 3e-6 of the vectors. Code, norm and a are the index; every vector is in it, nothing is
trained.

For a query and a block of vectors, the best estimates are scored exactly; their k-th score
is a threshold, and every vector whose estimate plus error reaches it is scored exactly as
well. Blocks of queries meet blocks of vectors, so a task's memory is set by the two block
sizes and only k rows for each query and block are shuffled again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bits of a code for each component, and the error bound in standard deviations.
BITS = 4
EPSILON = 4.5
#: Blocks of these sizes are copied to as many tasks as there are blocks of the other kind.
QUERY_BLOCK = 8192
ROW_BLOCK = 4096


@lru_cache(4)
def rotation(dim: int, seed: int = 41) -> np.ndarray:
    """The first dim rows of a random orthogonal matrix, with a column for each bit, a multiple of 8."""
    bits = -(-dim * BITS // 8) * 8
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def lengths(x: np.ndarray) -> np.ndarray:
    """Each row's norm, without overflow on the way."""
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, norm and a for each row of x (no row zero)."""
    most = np.abs(x).max(1)[:, None]
    turned = x / most / lengths(x / most)[:, None] @ rotation(x.shape[1])
    signs = turned >= 0
    return np.packbits(signs, axis=1), lengths(x), np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers, and not only zeros."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dim, vector, code, norm, align) for each usable vector, stored in the shared folder.

    Vectors that are null, zero, empty or hold null or non-finite components take no part,
    nor do rows without an id. Vectors of several dimensions may stand in one table. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column(1))
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
                code, norm, align = codes(x)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(align)],
                    names=["id", "dim", "vector", "code", "norm", "align"],
                )

    # Single precision stays what it is in the shuffle; all arithmetic is in double precision.
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    vector = F.col(vector_col).cast(kind)
    rows = vectors.filter(usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.size(vector).alias("dim"), vector.alias("vector"))
    return stored(rows.mapInArrow(run, f"id long, dim int, vector {kind}, code binary, norm double, align double"), "ann-index")


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in the order of the components."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[j]
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, x: np.ndarray, code: np.ndarray, norm: np.ndarray, align: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, and the ids and exact scores of its k best rows of the block."""
    bits = code.shape[1] * 8
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    scale = norm / align / np.sqrt(bits)
    slack = EPSILON * norm * np.sqrt(np.maximum(0, 1 - align * align) / (align * align) / max(1, bits - 1))
    size = lengths(queries)
    turned = (queries / size[:, None] @ rotation(queries.shape[1])).astype(np.float32)
    for at in range(0, len(queries), 64):
        estimates = (turned[at : at + 64] @ signs.T).astype(float) * scale  # of inner products with the query's direction
        for i, estimate in enumerate(estimates, at):
            others = ids != query_ids[i]
            count = int(others.sum())
            if not count:
                continue
            estimate[~others] = -np.inf
            first = np.argpartition(-estimate, min(2 * k, count) - 1)[: min(2 * k, count)]
            scores = exact(x[first], queries[i])
            if count > len(first):
                least = np.partition(scores, len(scores) - k)[len(scores) - k] / size[i]
                more = others & (estimate + slack >= least)
                more[first] = False
                rest = np.flatnonzero(more)
                first = np.concatenate([first, rest])
                scores = np.concatenate([scores, exact(x[rest], queries[i])])
            top = _best(ids[first], scores, k)
            yield int(query_ids[i]), ids[first][top], scores[top]


def nearest(index: DataFrame, is_query: Column, k: int = 20, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of an index with the largest inner products.

    Queries are the index's rows for which is_query holds; candidates are all rows of the
    same dimension but those with the query's own id. Equal scores go to the smaller id, and
    equal rows (one id, one vector) count as often as they are there. A query with fewer
    candidates has them all; one without any has no row.
    """
    sizes = index.agg(F.count(F.lit(1)).alias("rows"), F.sum(is_query.cast("long")).alias("queries")).first()
    row_blocks = max(1, -(-sizes["rows"] // row_block))
    query_blocks = max(1, -(-(sizes["queries"] or 0) // query_block))
    columns = ["dim", "qb", "rb", "asks", "id", "vector", "code", "norm", "align"]

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int, asks: bool) -> DataFrame:
        rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(asks))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).select(*columns)

    both = dealt(index.filter(is_query), "qb", query_blocks, "rb", row_blocks, True).unionByName(dealt(index, "rb", row_blocks, "qb", query_blocks, False))

    def run(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks"))
        dim = table.column("dim")[0].as_py()
        ids = table.column("id").to_numpy()
        x = table.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(float)
        code = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)
        norm, align = table.column("norm").to_numpy(), table.column("align").to_numpy()
        out: tuple[list, list, list] = ([], [], [])
        own = ~asks
        if own.any() and asks.any():
            for query, found, scores in search_block(ids[asks], x[asks], ids[own], x[own], code[own], norm[own], align[own], k):
                out[0].append(np.full(len(found), query))
                out[1].append(found)
                out[2].append(scores)
        parts = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(parts[0].astype(np.int64)), "vec_id": pa.array(parts[1].astype(np.int64)), "score": pa.array(parts[2].astype(float))})

    found = both.groupBy("dim", "qb", "rb").applyInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
