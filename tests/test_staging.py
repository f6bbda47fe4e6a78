"""Tables between steps: where they lie, and when they go."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from latticeq import staging

REPO = Path(__file__).resolve().parents[1]


def session(master, root=None):
    get = {"spark.checkpoint.dir": root} if root else {}
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: get), conf=SimpleNamespace(get=lambda key, default: default, set=lambda *_: None))


def test_no_local_folder_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging.shared_root(session(master))
        assert staging.shared_root(session(master, "hdfs:///shared/")) == "hdfs:///shared"
    assert Path(staging.shared_root(session("local[2]"))).is_dir()


def test_tables_go_with_the_process(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from latticeq.staging import Workspace
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", "file://{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
work = Workspace(spark, "some")
one, two = work.table(spark.range(3)), work.table(spark.range(4))
work.drop(one)
assert two.count() == 4
import os
assert [sorted(os.listdir("{tmp_path}/" + d)) for d in os.listdir("{tmp_path}") if d.startswith("some-")] == [["002"]]
spark.stop()
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
    assert not any(tmp_path.glob("some-*"))


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for value, want in (("64m", staging.BATCH_BYTES), ("1m", "1m"), (str(10**9), staging.BATCH_BYTES)):
        spark.conf.set(key, value)
        staging.ship(spark)
        assert spark.conf.get(key) == str(want)
