"""Result tables: pruned CSV, pipe tables in Markdown, contracts, resuming and upserts."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FORMAL_MODEL, FORMAL_SIMULATIONS = "LT_RandomThreshold", 4096
FORMAL_COLUMNS = ("dataset", "method", "method_group", "model_type", "k", "valid", "spread", "normalized_spread", "spread_std", "spread_ci95", "simulations", "time_s", "evaluation_time_s", "seed_nodes", "error")


def read_csv(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """A CSV with header, with or without a byte order mark; only those of the wanted columns that it has."""
    found = spark.read.option("header", True).csv(path)
    found = found.toDF(*[c.removeprefix("﻿") for c in found.columns])
    return found.select(*[c for c in wanted if c in found.columns]) if wanted else found


def markdown_tables(text: str) -> list[tuple[list[str], list[list[str]]]]:
    """(header, rows) of each pipe table; rows with other numbers of cells don't count."""
    cells = lambda line: [c.strip() for c in line.strip().strip("|").split("|")]
    out, lines, i = [], text.splitlines(), 0
    while i + 1 < len(lines):
        if not (lines[i].strip().startswith("|") and re.fullmatch(r"\s*\|?[\s:|-]+\|?\s*", lines[i + 1])):
            i += 1
            continue
        header, i, rows = cells(lines[i]), i + 2, []
        while i < len(lines) and lines[i].strip().startswith("|"):
            rows.append(cells(lines[i]))
            i += 1
        if rows := [r for r in rows if len(r) == len(header)]:
            out.append((header, rows))
    return out


def read_markdown_table(spark: SparkSession, path: str, needles: list[str]) -> DataFrame | None:
    """The first pipe table of a document with a column for every needle, as text columns."""
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    for header, rows in markdown_tables(text):
        if all(any(n in c for c in header) for n in needles):
            return spark.createDataFrame([tuple(r) for r in rows], [f"`{c}`".strip("`") for c in header])
    return None


def formal_results(results: DataFrame) -> DataFrame:
    """The rows of the formal model and simulations; raises when columns lack or no row is left."""
    if lacking := [c for c in FORMAL_COLUMNS if c not in results.columns]:
        raise ValueError(f"results lack columns: {', '.join(lacking)}")
    kept = results.where((F.col("model_type") == FORMAL_MODEL) & (F.col("simulations").try_cast("long") == FORMAL_SIMULATIONS))
    if kept.isEmpty():
        raise ValueError(f"no {FORMAL_MODEL} rows with {FORMAL_SIMULATIONS} simulations")
    return kept


def still_to_do(wanted: DataFrame, done: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """The wanted rows that aren't done; rows that were skipped for a timeout are to be done again."""
    finished = done.where(~F.coalesce(F.col(error), F.lit("")).startswith("skipped_timeout_"))
    return wanted.join(finished.select(*keys).distinct(), keys, "left_anti")


def keep_last(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last in order."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose keys the new ones don't have, and the new ones; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_csv(df: DataFrame, path: str, mark: bool = True) -> None:
    """A folder of CSV with header; mark: the first name begins with a byte order mark, as some programs want."""
    named = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if mark else df
    named.write.option("header", True).mode("overwrite").csv(path)


def write_manifest(spark: SparkSession, values: dict[str, object], path: str) -> None:
    """A run's values as one line of JSON."""
    spark.createDataFrame([(json.dumps(values, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
