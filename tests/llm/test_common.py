import os
from types import SimpleNamespace

import pytest

from vellum.llm import common


def session(master, folder=None):
    settings = {"spark.checkpoint.dir": folder} if folder else {}
    conf = SimpleNamespace(get=lambda k, d=None: settings.get(k, d), set=settings.__setitem__)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda k: None)), conf=conf)


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_dir(session(master))
    assert common.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    one = session("local[4]")
    assert common.shared_dir(one).startswith("file://") and common.shared_dir(one) == common.shared_dir(one)


def test_scratch_tables_go(spark):
    scratch = common.Scratch(spark, "test")
    rows = scratch.write(spark.range(5), "rows")
    path = scratch.base.removeprefix("file://")
    assert rows.count() == 5 and os.path.isdir(f"{path}/rows")
    scratch.drop("rows")
    assert not os.path.exists(f"{path}/rows")
    scratch.write(spark.range(5), "more")
    scratch._at_exit()
    assert not os.path.exists(path)


def test_names():
    assert common.own_name("Score", ["score"]) == "id" and common.own_name("doc_id", ["score"]) == "doc_id"
