"""Operators with Python tasks run where only the driver has the package on its path."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent
CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "warehouse").getOrCreate()
for name in ("op6_toxicity", "op5_substring_dedup", "op11_merkle_manifest", "op13_whitening"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO))], cwd=tmp_path, capture_output=True, text=True, timeout=400, check=False)
    assert out.stdout.split() == ["op6_toxicity", "200", "op5_substring_dedup", "200", "op11_merkle_manifest", "200", "op13_whitening", "8000"], out.stderr[-2000:]
