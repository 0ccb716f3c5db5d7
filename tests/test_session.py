"""Where lineage cuts are written."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from barloom import session


def fake(configured=None, checkpoint=None, master="local[2]"):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: configured),
        sparkContext=SimpleNamespace(
            getCheckpointDir=lambda: checkpoint, master=master, applicationId="app"
        ),
    )


def test_shared_folder_order():
    assert session.shared_folder(fake("hdfs://x/c/", "file:/y")) == "hdfs://x/c"
    assert session.shared_folder(fake(None, "file:/y")) == "file:/y"
    local = session.shared_folder(fake())
    assert local == session.shared_folder(fake())
    with pytest.raises(RuntimeError):
        session.shared_folder(fake(master="spark://host"))


def test_materialize_keeps_rows_and_schema(spark):
    df = spark.range(5).selectExpr("id", "cast(id as decimal(18,6)) as x")
    stored = session.materialize(df, "t")
    assert stored.dtypes == df.dtypes and stored.count() == 5
    assert session.path_exists(spark, stored.inputFiles()[0].rsplit("/", 1)[0])
