"""The package works for a session that was started in another folder."""

import os
import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
SCRIPT = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {root!r})
from tracemill.functions.pseudonym import blake_hex
from tracemill.session import configure
configure(spark)
print(spark.range(1).select(blake_hex(spark.range(1).id.cast("string"))).first()[0])
"""


def test_other_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=str(ROOT)).replace("spark.range(1).id", "__import__('pyspark').sql.functions.col('id')")
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert len(done.stdout.strip().splitlines()[-1]) == 8, done.stderr[-2000:]
