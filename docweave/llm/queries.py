"""The queries of this subpackage: one opN_<name> for each operator, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import covertree, html_extract, langid, linededup, mixing, neardup, packing, quality, tiff, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.resolved(warc.archive(table(spark, sf_dir, "pages"), min_payload_bytes=0))
    page = lambda of: F.nullif(F.col(f"{of}.fields")["pageId"], F.lit("")).cast("long")
    return captures.select(
        page("metadata").alias("page_id"),
        # rows that are there twice have record ids of their place, which others can't refer to: then the writer's note says what a revisit repeats
        F.coalesce(F.col("main.payload_bytes"), F.col("response.main.payload_bytes"), F.col("metadata.fields")["payloadBytes"].cast("long")).alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.warc_type").alias("record_type"),
        F.coalesce(page("response.metadata"), F.col("metadata.fields")["refersToPage"].cast("long")).alias("refers_to"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=2048, end_id=0)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)


def op4_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store(table(spark, sf_dir, "documents"), width=64, page_rows=1024)
    stored = stored.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    images = tiff.joined(tiff.read_pages(stored, features=False))
    return images.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
        "n_pages",
        "error",
    )


def op5_dual_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op6_random_index_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), max_sample=quality.MAX_SAMPLE)


def op7_odd_sketch_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=linededup.MIN_WORDS)
    spans = F.array_join(F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return cut.select("doc_id", "text", "n_removed", "removed_chars", spans.alias("removed_spans"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=(3, 2), most=2, seed="mix")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_main_text": op1_html_main_text,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_best_two_fit": op3_best_two_fit,
    "op4_tiff_pages": op4_tiff_pages,
    "op5_dual_tree_top_k": op5_dual_tree_top_k,
    "op6_random_index_quality": op6_random_index_quality,
    "op7_odd_sketch_neardup": op7_odd_sketch_neardup,
    "op8_bitmask_langid": op8_bitmask_langid,
    "op9_line_dedup": op9_line_dedup,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE: dict[str, str] = {
    "op2_warc_transactions": """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS hex, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages
), h AS (SELECT hex, max(page_id) AS holder FROM p GROUP BY hex)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, (1 + 5 * k)::INT, 5))::BIGINT >> b) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM p JOIN h USING (hex)""",
    "op5_dual_tree_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5""",
    "op10_source_mixing": """
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))) AS h,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / w, w, source NULLS LAST) AS k FROM s
), c AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
    sum(w) OVER (ORDER BY k DESC)::BIGINT AS free, (sum(source_size) OVER ()) * 3 / 2 AS whole
  FROM o
), f AS (SELECT capped, free, whole FROM c WHERE cap > (whole - capped) * w / free ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((f.whole - f.capped) * w / f.free, cap::DOUBLE)) AS target
  FROM o LEFT JOIN f ON true
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS rounds FROM t
), g AS (
  SELECT source, left(h, 12) AS p, sum(size)::BIGINT AS n FROM d GROUP BY ALL
), r AS (
  SELECT source, p, n, sum(n) OVER (PARTITION BY source ORDER BY p) AS upto FROM g
), x AS (
  SELECT r.source, r.p, (upto <= budget OR (upto - n <= budget AND upto - budget < budget - (upto - n))) AS yes
  FROM r JOIN (SELECT *, target - rounds * source_size AS budget FROM b) b ON r.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, size * least(rounds + yes::BIGINT, 2) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND left(d.h, 12) = x.p""",
}
