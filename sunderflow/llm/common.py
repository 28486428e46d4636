"""What the text operators share: durable tables, text expressions and distributed prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.storage import durable, shared_folder

#: The white space that the contracts mean by [\x20\x09-\x0D].
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
#: A word in that sense, for Java's regular expressions.
WORD = "[^\\x20\\x09-\\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; pure ASCII takes the fast way."""
    plain = F.length(c) == F.octet_length(c)
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, _UPPER, _UPPER.lower()))


def without_spaces(c: Column) -> Column:
    """Deletes every character of SPACES."""
    for s in SPACES:
        c = F.replace(c, F.lit(s), F.lit(""))
    return c


def trimmed(c: Column) -> Column:
    """Strips SPACES at both ends."""
    return F.btrim(c, F.lit(SPACES))


def word_count(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key128(c: Column) -> list[Column]:
    """Two differently seeded 64-bit hashes of a column: [h1, h2]."""
    return [F.xxhash64(F.lit(1), c).alias("_h1"), F.xxhash64(F.lit(2), c).alias("_h2")]


def seeded(seed: int, *cols: Column) -> Column:
    """A 32-digit hex key that shuffles rows; also expressible in SQL."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hex_bucket(key: Column, buckets: int) -> Column:
    """The bucket, from 0, of a hex key; buckets follow the key's order."""
    return F.floor(F.conv(F.substring(key, 1, 7), 16, 10).cast("long") * F.lit(buckets) / F.lit(16**7)).cast("long")


def bucket_count(rows: int) -> int:
    """Buckets for a two-level rank: neither the buckets nor the rows of one outgrow the square root of all rows."""
    return max(1, math.isqrt(max(rows, 1)))


def running_total(df: DataFrame, by: list[str], bucket: str, order: list[Column], weight: Column, out: str) -> DataFrame:
    """Adds the running total of weight over each group of `by`, in order of (bucket, order), without one task per group.

    Sums per bucket give each bucket's start; a window within the bucket gives the rest. `by` columns mustn't be null.
    """
    keys = [*by, bucket]
    sums = df.groupBy(*keys).agg(F.sum(weight).alias("_w"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = df.withColumn(out, F.sum(weight).over(within))
    return ranked.join(starts, keys).withColumn(out, F.col(out) + F.col("_start")).drop("_start")


def null_safe_key(c: Column) -> list[Column]:
    """A column as two that are never null: [is null, value]; nulls come last."""
    return [c.isNull().alias("_sn"), F.coalesce(c, F.lit("")).alias("_sv")]


def text_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Bounds what goes to a Python worker at once; long texts make for small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


__all__ = ["F", "T", "Window", "ascii_lower", "bucket_count", "documents", "durable", "hex_bucket", "key128", "null_safe_key", "running_total", "seeded", "shared_folder", "text_batches", "trimmed", "without_spaces", "word_count", "WORD", "SPACES"]
