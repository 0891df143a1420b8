"""The shared folder is what the cluster names, and nothing else on a cluster."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from gatelens.session import shared_dir, work_table


def _session(master: str, folder: str | None):
    context = SimpleNamespace(master=master, applicationId="app-1")
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=context)


def test_named_folder_is_used():
    assert shared_dir(_session("spark://host:7077", "hdfs:///work/")) == "hdfs:///work"


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_session(master, None))


def test_work_table_keeps_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "i int, s string")
    assert sorted(work_table(df, "test").collect(), key=str) == sorted(df.collect(), key=str)
