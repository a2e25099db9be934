"""Lineage cuts: the same rows, without the plan they came from and with a size that was measured."""

from pyspark.sql import functions as F

import os
from types import SimpleNamespace

import pytest

from termweave.session import cut, discard, shared_folder


def size(frame):
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_cut_keeps_rows_and_measures_their_size(spark):
    rows = spark.createDataFrame([("a", 1, ["x", None]), (None, 2, None), ("a", 1, ["x", None])], "node string, n int, parts array<string>")
    for _ in range(3):
        other = rows.select("n", F.col("node").alias("other")).distinct()
        rows = cut(rows.join(other, "n").select("node", "n", "parts"))
        assert size(rows) < 100_000
        assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.where("node = 'a' AND n = 1 AND parts[0] = 'x' AND parts[1] IS NULL").count() == 2
    assert rows.count() == 3 and rows.where("node IS NULL AND parts IS NULL").count() == 1


def test_cut_of_no_rows_keeps_the_columns(spark):
    rows = cut(spark.createDataFrame([], "a string, b struct<c: long>"))
    assert rows.count() == 0 and rows.dtypes == [("a", "string"), ("b", "struct<c:bigint>")]


def test_discarded_tables_are_gone(spark):
    rows = cut(spark.range(3))
    place = rows.cut_path.removeprefix("file:")
    assert os.path.isdir(place)
    discard(rows)
    assert not os.path.isdir(place)


@pytest.mark.parametrize("master,given,wanted", [("yarn", None, None), ("local-cluster[3,2,1024]", None, None), ("spark://x:7077", "hdfs://x/y", "hdfs://x/y"), ("yarn", "hdfs://x/y", "hdfs://x/y")])
def test_no_machine_local_folder_on_a_cluster(master, given, wanted):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: {})
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: given or default))
    if wanted:
        assert shared_folder(session) == wanted
    else:
        with pytest.raises(RuntimeError):
            shared_folder(session)
