"""Every query of the subpackage from an empty working directory, where workers cannot import the package."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
FOLDER = "/root/testdata/sf0.001"
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession

spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.ui.showConsoleProgress", "false").getOrCreate()
)
spark.sparkContext.setLogLevel("OFF")
for name, query in entry.LLM_QUERIES.items():
    try:
        print("DONE", name, query(spark, {FOLDER!r}).count())
    except Exception as problem:
        print("FAILED", name, repr(problem)[-500:])
print("NAMES", *entry.LLM_QUERIES)
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_queries_run_without_an_installed_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    lines = [line.split() for line in done.stdout.splitlines()]
    names = next(line[1:] for line in lines if line[0] == "NAMES")
    assert len([n for n in names if n.startswith("op")]) == 13 and "pipeline" in names
    assert [" ".join(line) for line in lines if line[0] == "FAILED"] == []
    assert {line[1] for line in lines if line[0] == "DONE" and int(line[2]) > 0} == set(names)
