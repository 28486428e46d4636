"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Folders that were made for applications without a setting, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir or setCheckpointDir().

    Where neither is set: a temporary folder if the session is local, as in tests, else one in the warehouse, which
    executors share.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or _OWN.get(sc.applicationId)
    if not root:
        local = re.fullmatch(r"local(\[.*\])?", sc.master)
        root = "file://" + tempfile.mkdtemp(prefix="sunderflow-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_sunderflow"
        _OWN[sc.applicationId] = root
    return f"{root.rstrip('/')}/{sc.applicationId}"


#: Where the tables are that durable() has written and drop() may delete, by the DataFrame that reads them.
_PLACES: WeakKeyDictionary = WeakKeyDictionary()


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def durable(df: DataFrame, label: str, replaces: DataFrame | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts lineage and survives lost executors.

    replaces: the table of a loop's round before, which isn't needed once this one is written. Others go when the driver
    ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where, system = _place(spark, path)
    system.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    if replaces is not None:
        drop(replaces)
    return out


def drop(df: DataFrame) -> None:
    """Deletes the table that durable() wrote for df, if it did; nothing may read it any more."""
    if (path := _PLACES.pop(df, None)) is not None:
        where, system = _place(df.sparkSession, path)
        system.delete(where, True)


class Growing:
    """A set of rows that rounds add to. Each addition is a table of its own; as many as BUNDLE become one, but the newest."""

    BUNDLE = 16

    def __init__(self, first: DataFrame, label: str):
        self.label, self.parts = label, [first]

    def add(self, rows: DataFrame) -> None:
        if len(self.parts) >= self.BUNDLE:
            joined = durable(self.rows, self.label)
            for part in self.parts:
                drop(part)
            self.parts = [joined]
        self.parts.append(rows)

    @property
    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def fresh(df: DataFrame) -> DataFrame:
    """df with columns that Spark tells apart from those it was made of, for cogroups and self-joins."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])
