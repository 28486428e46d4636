import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    made = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def _plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 8) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Runs a query and its SQL on the same tables and compares names and rows."""

    def check(query, sql, sf_dir=DATA):
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            if f.endswith(".parquet"):
                con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
        df = query(spark, sf_dir)
        names = sorted(df.columns)
        got = sorted(tuple(map(_plain, r)) for r in df.select(*names).collect())
        found = con.execute(sql)
        columns = [c[0] for c in found.description]
        assert sorted(columns) == names
        at = [columns.index(n) for n in names]
        assert got == sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())

    return check
