"""Candidate logs as streams: new rows of a growing folder, scored statelessly and counted by family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "candidate_id string, family string, valid boolean, auc_cNBI double, R double, time_s double, logged_at timestamp"


def candidate_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the JSON lines that a search appends to a folder."""
    return spark.readStream.schema(SCHEMA).json(folder)


def progress(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Per window of log time and family: candidates, valid share and best auc; rows later than `late` don't count."""
    rows = stream.withWatermark("logged_at", late).groupBy(F.window("logged_at", window).alias("window"), "family")
    return rows.agg(F.count(F.lit(1)).alias("candidates"), F.avg(F.col("valid").cast("double")).alias("valid_rate"), F.max(F.when(F.col("valid"), F.col("auc_cNBI"))).alias("best_auc"))


def new_candidates(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each candidate once, however often its row is logged within the watermark."""
    return stream.withWatermark("logged_at", late).dropDuplicatesWithinWatermark(["candidate_id"])
