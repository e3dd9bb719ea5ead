"""Every query of the subpackage runs where the executors have no copy of the library."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import os, sys, tempfile
from pyspark.sql import SparkSession
home = tempfile.mkdtemp(prefix="spark-")
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", home).config("spark.checkpoint.dir", "file://" + home + "/shared").config("spark.sql.warehouse.dir", home + "/warehouse").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def there(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("cairn") is not None])], names=["there"])
sys.path.insert(0, REPO)  # the driver alone
import cairn.llm.queries
assert not any(r["there"] for r in spark.range(1).mapInArrow(there, "there boolean").collect())
for name, query in cairn.llm.queries.queries().items():
    query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print("DONE", name)
"""


def test_no_query_needs_the_package_on_the_executors(tmp_path):
    run = subprocess.run([sys.executable, "-c", SCRIPT.replace("REPO", repr(str(REPO)))], cwd=tmp_path, capture_output=True, text=True, timeout=900)
    assert run.returncode == 0, run.stderr[-3000:]
    assert run.stdout.count("DONE") == 13
