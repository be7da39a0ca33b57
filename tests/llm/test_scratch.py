"""A session that names no shared folder: a fresh process, since the folder belongs to the driver."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import os
from pyspark.sql import SparkSession
from satchel.llm.common import materialize, scratch_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert materialize(spark.range(3), "t")[0].count() == 3 and scratch_dir(spark) == scratch_dir(spark)
print("folder", scratch_dir(spark))
"""


def test_no_checkpoint_dir(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
    folder = next(x for x in done.stdout.splitlines() if x.startswith("folder ")).split(" ", 1)[1]
    assert not os.path.exists(folder)
