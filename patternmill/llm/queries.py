"""The corpus operators as queries over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, scratch, stored, table


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import Tagger, find_pii

    return find_pii(table(spark, sf_dir, "documents"), Tagger())


def op8_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that leaks into it."""
    from .tiling import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import interleave_shards

    return interleave_shards(table(spark, sf_dir, "documents"), n_shards=8)


def op1_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import extract_pages, learn_wrappers

    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, stored(learn_wrappers(pages), "wrappers"))


def op2_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_texts

    docs = table(spark, sf_dir, "documents")
    return encode_texts(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op3_one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import build_index, nearest

    return nearest(build_index(table(spark, sf_dir, "embeddings")), F.col("id") % 20 == 0, k=20)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, in_training, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes archives, deduplicates them into fresh ones and reads those back, resolved."""
    from . import warc

    first, second = scratch(spark, "warc"), scratch(spark, "warc-dedup")
    warc.write_warc(warc.page_records(table(spark, sf_dir, "pages")), first)
    warc.dedup_warc(spark, first, second, min_bytes=0)
    remove(spark, first)
    found = warc.resolve_revisits(warc.read_headers(spark, second))
    return found.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_wrappers": op1_html_wrappers,
    "op2_byte_level_bpe": op2_byte_level_bpe,
    "op3_one_bit_neighbours": op3_one_bit_neighbours,
    "op4_language_id": op4_language_id,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_personal_data": op7_personal_data,
    "op8_string_tiling": op8_string_tiling,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_stratified_sharding": op10_stratified_sharding,
}

#: 5 hex digits are 20 bits, so 4 base32 digits.
_BASE32 = """
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hexed, 5 * i + 1, 5))::BIGINT) >> b) & 31)::INT + 1, 1)), '')), '')"""

ORACLE_SQL: dict[str, str] = {
    "op3_one_bit_neighbours": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op6_warc_revisits": f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hexed FROM pages),
firsts AS (SELECT hexed, payload_bytes, min(page_id) AS first_id FROM hashed GROUP BY ALL)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed JOIN firsts USING (hexed, payload_bytes)""",
}
