"""Proportional stratified interleaving: shards that all match the corpus mixture.

Every row gets a seeded hash. Its rank by that hash among the rows of its source, halved
off and divided by the source's size, is a fraction in (0, 1); all rows sorted by that
fraction and cut into equal runs give shards whose counts differ by one at most and whose
share of every source is the corpus's share, to within a row or two.

No step sorts a source or the corpus in one task. Ranks come from two-level counting: the
hash's leading bits name a bucket, a small table holds the count of each (source, bucket),
its running sum is the rank at which the bucket starts, and a window ranks rows inside one
bucket. For the second sort the number of rows before each slice of fractions follows from
the sources' sizes alone, so the rows are shuffled twice in all, without their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interleave_shards(
    docs: DataFrame,
    n_shards: int = 8,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_bits: int = 10,
) -> DataFrame:
    """Returns doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    size is the text's UTF-8 bytes plus 1; a null text counts as empty. A null source is a
    stratum of its own, apart from a source that is the empty string. Rows with equal ids
    are ordered by checksum and size; rows equal in all of these are interchangeable, and
    each still gets a slot. An empty table gives no rows. Other columns are ignored.
    """
    slices = 1 << bucket_bits
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))).alias("stratum"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
    ).withColumn("b", F.shiftrightunsigned("h", 64 - bucket_bits).cast("int"))

    by_stratum = Window.partitionBy("stratum")
    counted = rows.groupBy("stratum", "b").agg(F.count(F.lit(1)).alias("n"))
    starts = counted.select(
        "stratum",
        "b",
        F.coalesce(F.sum("n").over(by_stratum.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(by_stratum).alias("of"),
    )
    ranked = rows.join(starts, ["stratum", "b"]).withColumn(
        "rank",
        F.col("before") + F.row_number().over(Window.partitionBy("stratum", "b").orderBy("h", "doc_id", "text_crc32", "size")),
    )
    # slice = floor of the fraction (2 rank - 1) / (2 of), times the number of slices
    ranked = ranked.withColumn("slice", F.expr(f"((2 * rank - 1) * {slices}L) div (2 * of)").cast("int"))

    # A source of n rows has floor((2 n f + slices - 1) / (2 slices)) of them before slice f.
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    cuts = (
        sizes.select("n", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
        .groupBy("slice")
        .agg(F.sum(F.expr(f"(2 * n * slice + {slices - 1}L) div {2 * slices}L")).alias("ahead"), F.sum("n").alias("total"))
    )
    in_slice = Window.partitionBy("slice").orderBy(
        (F.col("rank") - F.lit(0.5)) / F.col("of"), F.xxhash64(F.lit(seed), F.col("stratum")), "stratum", "rank"
    )
    # cuts has exactly `slices` rows of three numbers, whatever the input.
    placed = ranked.join(F.broadcast(cuts), "slice").withColumn("g", F.col("ahead") + F.row_number().over(in_slice) - 1)
    placed = placed.withColumn("shard", F.expr(f"(g * {n_shards}L) div total"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("g") - F.expr(f"(shard * total + {n_shards - 1}L) div {n_shards}L")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
