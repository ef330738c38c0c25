"""Intermediate tables go to the shared folder, whatever the session was given."""

import os
import subprocess
import sys

import pytest

from shutterlake.session import cut, drop, materialise, shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PLAIN = """
from pyspark.sql import SparkSession
from shutterlake.session import cut, materialise, shared_folder
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert materialise(spark.range(3))[0].count() == 3 and cut(spark.range(4)).count() == 4
print("folder", shared_folder(spark))
"""


@pytest.mark.parametrize("given", [None, "ckpt"])
def test_session_with_and_without_a_folder(tmp_path, given):
    conf = tmp_path / "conf"
    conf.mkdir()
    if given:
        (conf / "spark-defaults.conf").write_text(f"spark.checkpoint.dir file://{tmp_path}/ckpt\n")
    env = os.environ | {"SPARK_CONF_DIR": str(conf), "PYTHONPATH": ROOT}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    out = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=180)
    assert out.returncode == 0, out.stderr[-2000:]
    folder = next(x for x in out.stdout.splitlines() if x.startswith("folder"))
    assert (given is None) == (str(tmp_path) not in folder)


def test_tables_are_removed(spark):
    df, path = materialise(spark.range(5))
    assert df.count() == 5 and path.startswith(shared_folder(spark).rstrip("/"))
    drop(spark, path)
    local = path.removeprefix("file://").removeprefix("file:")
    assert not os.path.exists(local)
    assert cut(spark.range(2)).count() == 2


def test_a_loop_of_cuts_forgets_the_size_of_the_plan(spark):
    df = cut(spark.range(100).selectExpr("id", "id as up"))
    for _ in range(5):
        above = df.selectExpr("id as up", "up as top")
        df = cut(df.join(above, "up").selectExpr("id", "top as up"))
    # estimates that multiply with every join would have hundreds of digits by now
    assert df.count() == 100 and int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1_000_000
