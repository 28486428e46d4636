"""Runs as streams: the best candidate so far as state, and result tables that a restart doesn't change."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.tables import keep_last

#: The state store that keeps a value for each key of best_so_far; sessions name it in STORE.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "candidates bigint, valid bigint, best_auc double, best_candidate string"


class _Best(StatefulProcessor):
    """Counts and the best valid candidate of a key; the state is one row, whatever number of candidates came."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("best", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        count, valid, auc, name = self.state.get() if self.state.exists() else (0, 0, None, None)
        for part in rows:
            good = part[part["valid"].eq(True) & part["auc_cNBI"].notna()]
            count, valid = count + len(part), valid + int(part["valid"].eq(True).sum())
            if len(good):
                top = good["auc_cNBI"].max()
                first = good.loc[good["auc_cNBI"] == top, "candidate_id"].dropna().min()
                first = None if pd.isna(first) else str(first)
                if auc is None or top > auc or (top == auc and first is not None and (name is None or first < name)):
                    auc, name = float(top), first
        self.state.update((count, valid, auc, name))
        yield pd.DataFrame({self.key: [key[0]], "candidates": [count], "valid": [valid], "best_auc": pd.Series([auc], dtype="float64"), "best_candidate": pd.Series([name], dtype="object")})

    def close(self) -> None:
        pass


def best_so_far(stream: DataFrame, key: str = "family") -> DataFrame:
    """(key, candidates, valid, best_auc, best_candidate), a new row for each key that a batch brings rows for.

    Ties go to the smallest candidate_id. Rows without a key have a state of their own. Needs STORE to be ROCKS.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, "candidate_id", "valid", "auc_cNBI")
    return rows.groupBy(key).transformWithStateInPandas(_Best(key), f"{key} {kind}, {_STATE}", "Update", "None")


def upsert(stream: DataFrame, path: str, keys: list[str], order: list[Column], checkpoint: str) -> StreamingQuery:
    """Writes what is new in a stream to a result table, and ends when all that is there is written.

    A batch is a folder of the table, the last row of each of its keys in it. A batch that is run again after a failure
    overwrites its own folder, so that the table is the same however often a run is restarted.
    """

    def put(batch: DataFrame, number: int) -> None:
        keep_last(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: list[str], order: list[Column]) -> DataFrame:
    """A result table's row of each key: the last by batch and order. Rows that were skipped for a timeout (`error`) give way
    to any other."""
    rows = spark.read.parquet(path)
    skipped = F.coalesce(F.col("error"), F.lit("")).startswith("skipped_timeout_") if "error" in rows.columns else F.lit(False)
    return keep_last(rows, keys, [~skipped, F.col("batch"), *order]).drop("batch")
