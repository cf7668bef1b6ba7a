"""Operators in Python work when the driver runs in another folder than the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.append({root!r})  # known to the driver only
from pyspark.sql import SparkSession
from txrisk.sources.tables import transactions
from txrisk.ml import oversample
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {work!r}).getOrCreate()
tx = transactions(spark, {sf!r}).selectExpr("transaction_id", "amount", "is_fraud")
print("rows", oversample.smote(tx, ["amount"], 100).count())
"""


def test_workers_find_the_package(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=ROOT, sf=sf, work=str(tmp_path / "work"))
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 64" in done.stdout, done.stderr[-2000:]
