"""Python workers find the package although it is neither installed nor in the working folder."""

import os
import subprocess
import sys
import time
from types import SimpleNamespace

import pytest

from tamarack.session import fresh_path, shared_root, stage, unstage

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from tamarack.session import ship_package
from tamarack.operators.throttle import throttle_events
ship_package(spark)
ship_package(spark)
df = spark.range(5).select("id", F.lit("r").alias("run"), F.timestamp_seconds(F.col("id") * 200).alias("ts"))
print("EMITTED", sorted(r.id for r in throttle_events(df, "run", "ts", "id").collect()))
"""


def test_package_reaches_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=REPO)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180, check=False,
    )
    assert "EMITTED [0, 2, 4]" in done.stdout, done.stderr[-2000:]


def test_shared_folder_is_the_sessions_own(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) == root
    a, b = fresh_path(spark, "x"), fresh_path(spark, "x")
    assert a != b and a.startswith(f"{root}/tamarack/{spark.sparkContext.applicationId}/x-")
    assert sorted(r.id for r in stage(spark.range(3), "three").collect()) == [0, 1, 2]


def test_staged_table_can_be_removed(spark):
    table = stage(spark.range(3), "gone")
    assert os.path.isdir(table.staged_path)
    unstage(table)
    assert not os.path.exists(table.staged_path)


def bare(master, checkpoint_dir=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(
            applicationId=f"app-{master}", master=master, getCheckpointDir=lambda: checkpoint_dir
        ),
    )


def test_local_session_without_shared_folder_gets_one():
    for master in ("local", "local[4]"):
        assert shared_root(bare(master)) == shared_root(bare(master))
        assert os.path.isdir(shared_root(bare(master)))


def test_cluster_without_shared_folder_is_refused():
    for master in ("spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_root(bare(master))
    assert shared_root(bare("yarn", "hdfs://name/shared/")) == "hdfs://name/shared"


CLEAN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {root!r}).getOrCreate())
from tamarack.session import stage
print("ROWS", stage(spark.range(7), "t").count())
spark.stop()
"""


def test_staged_tables_go_with_the_application(tmp_path):
    code = CLEAN.format(repo=REPO, root=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, check=False)
    assert "ROWS 7" in done.stdout, done.stderr[-2000:]
    for _ in range(50):
        if not os.listdir(tmp_path / "tamarack"):
            break
        time.sleep(0.2)
    assert os.listdir(tmp_path / "tamarack") == []
