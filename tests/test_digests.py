"""Digest trees against a comparison of all rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from barloom.functions import digests

ROWS = "asset_id string, run_id string, place int, text string"


def rows_of(spark, rows):
    return digests.row_digests(spark.createDataFrame(rows, ROWS).repartition(3), "t", F.col("place"), F.col("text")).cache()


def test_differences_are_the_rows_that_differ(spark):
    rng = random.Random(3)
    places = sorted(rng.sample(range(200_000), 400))
    before = [(a, r, p, f"{a}{r}{p}") for a in "abc" for r in ("1", "2") for p in places]
    after = list(before)
    removed, changed = after.pop(5), after[700]
    after[700] = (*changed[:3], "new")
    after += [("a", "1", 199_999_9, "added"), ("new", "1", 0, "added")]
    kept, found = rows_of(spark, before), rows_of(spark, after)
    trees = digests.tree(kept), digests.tree(found)
    got = sorted((r.asset_id, r.run_id, r.place, r.change) for r in digests.differences(trees[0], kept, trees[1], found).collect())
    assert got == sorted([(*removed[:3], "missing"), (*changed[:3], "changed"), ("a", "1", 1_999_999, "added"), ("new", "1", 0, "added")])
    assert digests.differences(trees[0], kept, digests.tree(rows_of(spark, before[::-1])), kept).count() == 0
    # No node lists more than a bounded number of children.
    assert trees[0]["root"].first().n == len(before)
    assert kept.groupBy(*digests.LEVELS["blocks"][0]).count().agg(F.max("count")).first()[0] <= digests.FAN_OUT


def test_trees_of_no_rows(spark):
    empty, some = rows_of(spark, []), rows_of(spark, [("a", "1", 0, "x")])
    assert digests.differences(digests.tree(empty), empty, digests.tree(empty), empty).count() == 0
    assert digests.differences(digests.tree(empty), empty, digests.tree(some), some).first().change == "added"
