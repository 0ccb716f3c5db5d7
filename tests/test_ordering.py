"""Distributed ordinals against a sorted list."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import ordering


def test_ordinals_are_positions_in_the_sorted_table(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 20), k) for k in range(2_000)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(7)
    out = ordering.with_ordinal(df, [F.col("k"), F.col("v").desc(), F.col("id")]).collect()
    told = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1], r[2]))
    assert [r[:3] for r in sorted(map(tuple, out), key=lambda r: r[3])] == told
    assert sorted(r.ordinal for r in out) == list(range(len(rows)))


def test_one_value_in_all_rows_and_no_rows(spark):
    df = spark.createDataFrame([("x",)] * 500, "k string").repartition(5)
    assert sorted(r.ordinal for r in ordering.with_ordinal(df, [F.col("k")]).collect()) == list(range(500))
    assert ordering.with_ordinal(df.limit(0), [F.col("k")]).count() == 0
    with pytest.raises(ValueError, match="ordinal"):
        ordering.with_ordinal(df.withColumn("ordinal", F.lit(1)), [F.col("k")])


def test_findings_are_never_in_one_partition(spark, capsys):
    day = dt.date(2020, 1, 1)
    rows = [("a", "c", "error", "code", day + dt.timedelta(k % 300), day + dt.timedelta(400), None if k % 2 else "open", ["s"], "{}", "m") for k in range(3_000)]
    kinds = (
        "asset_id string, check_id string, severity string, finding_code string, affected_start date, affected_end date, "
        "field string, source_ids array<string>, observed string, message string"
    )
    findings = spark.createDataFrame(rows, kinds).repartition(4)
    out = ordering.ordered_findings(findings)
    assert [r.ordinal - r.place for r in out.collect()] == [0] * len(rows)
    in_order = [(r.affected_start, r.field or "") for r in out.orderBy("ordinal").collect()]
    assert in_order == sorted(in_order)
    # Only the sizes of the ranges meet in one partition, for their running sum.
    out.explain()
    plan = capsys.readouterr().out.splitlines()
    below = [plan[k + 1] for k, line in enumerate(plan) if "SinglePartition" in line]
    assert below and all("HashAggregate(keys=[_range" in line for line in below)
