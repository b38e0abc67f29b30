"""The llm queries where workers can't import the repository."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.driver.memory", "3g").config("spark.checkpoint.dir", "file://" + {tmp!r} + "/c").config("spark.sql.warehouse.dir", {tmp!r} + "/w").getOrCreate()
)
spark.sparkContext.setLogLevel("FATAL")

def there(_):
    try:
        import loomline
    except ModuleNotFoundError:
        return [False]
    return [True]

assert not any(spark.sparkContext.range(4).mapPartitions(there).collect())
names = [n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op") and n[2].isdigit()]
assert len(names) == 14, names
for name in names:
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() >= (name != "op11_collocations"), name
print("all", len(names))
"""


def test_queries_run_without_the_repository_on_workers(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    got = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo, tmp=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all 14" in got.stdout, got.stdout[-2000:] + got.stderr[-4000:]
