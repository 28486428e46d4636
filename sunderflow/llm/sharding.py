"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are ranked within their source after a seeded shuffle by doc_id and text; rank (2r - 1) / 2n, the fraction of the source that lies
before the row's middle, orders all rows; that order is cut into shards of equal row counts. So each shard holds each
source in its share, to within a row or two. Ranks come from bucket counts plus a window within a bucket, so that no
task holds a source.

Null text has no bytes, null sources form one stratum, and rows that agree in everything are interchangeable. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import F, Window, bucket_count, documents, durable, hex_bucket, null_safe_key, running_total, seeded

SEED, SHARDS = 17, 16


def interleave(rows: DataFrame, key: str = "_k", shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot to rows that have _sn, _sv (the stratum) and a hex key; order within equal keys by doc_id, size."""
    strata = durable(rows.groupBy("_sn", "_sv").agg(F.count(F.lit(1)).alias("_n")), "strata")
    total = strata.agg(F.sum("_n")).first()[0] or 0
    buckets = bucket_count(total)
    one, w = F.lit(1).cast("long"), [F.col(key), F.col("doc_id"), F.col("size")]
    ranked = running_total(rows.withColumn("_b", hex_bucket(F.col(key), buckets)), ["_sn", "_sv"], "_b", w, one, "_rank").drop("_b")
    part = (2 * F.col("_rank") - 1) / (2 * F.col("_n"))
    placed = ranked.join(strata, ["_sn", "_sv"]).withColumn("_frac", part).withColumn("_g", F.floor(F.col("_frac") * buckets))
    whole = running_total(placed.withColumn("_all", F.lit(0)), ["_all"], "_g", [F.col("_frac"), F.col("_sn"), F.col("_sv")], one, "_pos")
    at = F.col("_pos") - 1
    shard = F.expr(f"(_pos - 1) * {shards} div {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return whole.withColumn("_shard", shard).withColumn("shard", F.col("_shard").cast("int")).withColumn("slot", at - first).drop("_n", "_rank", "_frac", "_g", "_all", "_pos", "_shard")


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard. The law is rows: counts at most one apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *null_safe_key(F.col("source")), seeded(seed, F.col("doc_id"), F.md5(text)).alias("_k"))
    out = interleave(durable(rows, "shard-rows"), shards=shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))


#: CRC-32 byte by byte: its table of 256 entries comes from the polynomial 0xEDB88320 (3988292384).
OP4_SQL = r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS tbl FROM (
    SELECT i, list_reduce(range(8), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v
    FROM (SELECT unnest(range(256)) AS i))),
r AS (
  SELECT doc_id, coalesce(text, '') AS t, source IS NULL AS sn, coalesce(source, '') AS sv, strlen(coalesce(text, '')) + 1 AS size,
         md5(concat_ws('|', '17', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k FROM documents),
c AS (
  SELECT r.*, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda h: CAST(('0x' || h) AS BIGINT)),
              lambda a, b: xor(tbl[CAST((xor(a, b) & 255) + 1 AS BIGINT)], a >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM r, tab),
f AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY sn, sv ORDER BY k, doc_id, size) - 1) / CAST(2 * count(*) OVER (PARTITION BY sn, sv) AS DOUBLE) AS frac FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY frac, sn, sv) - 1 AS pos, count(*) OVER () AS n FROM f),
s AS (SELECT *, pos * 16 // n AS shard FROM p)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, pos - (shard * n + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""
