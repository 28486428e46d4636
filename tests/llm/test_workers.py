"""Executors need no copy of the package."""

import os
import subprocess
import sys

PROGRAM = """
import sys
from pyspark.sql import SparkSession

root, data, shared = sys.argv[1:]
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
spark.sparkContext.setLogLevel("OFF")


def known(batches):
    try:
        import sunderflow
        found = 1
    except ImportError:
        found = 0
    for b in batches:
        yield b.slice(0, len(b) * found)


assert spark.range(3).mapInArrow(known, "id long").count() == 0, "the package is on the workers' path"
sys.path.insert(0, root)
import __spark_entry__ as entry

for name, query in entry.queries().items():
    if name.startswith("op") and name[2].isdigit():
        assert query(spark, data).count() > 0, name
print("all ran")
"""


def test_workers_without_the_package(tmp_path, data):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "program.py").write_text(PROGRAM)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "program.py", root, data, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]
