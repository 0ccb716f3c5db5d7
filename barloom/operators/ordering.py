"""A total order over rows of any number, without bringing them together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.quality import with_finding_id
from barloom.session import materialize

#: What findings are ordered by inside one check.
FINDING_ORDER = ("affected_start", "affected_end", "finding_code", "field", "source_ids", "finding_id")
#: Rows of one task: the low bits of Spark's increasing row ids.
_ROW_BITS = (1 << 33) - 1


def with_ordinal(rows: DataFrame, order: Sequence[Column], *, name: str = "ordinal") -> DataFrame:
    """Add the position of every row in ``order``, counted from zero over the whole table.

    Rows are dealt to ranges of the order, sorted inside their range and written once with their place in it; the
    ranges' sizes then give each range its offset. Only those sizes, one row per shuffle partition, ever meet in one
    task. Rows that agree in all of ``order`` get neighbouring ordinals in no stated order, so end it
    with a unique column. Spark's null order holds: nulls first in ascending columns.
    """
    for taken in (name, "_range", "_place", "_before"):
        if taken in rows.columns:
            raise ValueError(f"the table has a column {taken} already")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = dealt.withColumns(
        {"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))}
    )
    # Written, so that a task which is run again cannot sort rows into other ranges than those counted.
    kept = materialize(placed, "ordered")
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return kept.join(offsets, "_range").select(*rows.columns, (F.col("_before") + F.col("_place")).alias(name))


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Findings with ``finding_id``, ``ordinal`` over all of them, and ``place`` inside their asset and check.

    The order is asset, check, then the six keys of a check's result; a finding without a field comes before those
    with one. Equal findings (same content id) are kept, side by side.
    """
    identified = with_finding_id(findings)
    keys = [F.coalesce(F.col(c), F.lit("")) if c == "field" else F.col(c) for c in FINDING_ORDER]
    numbered = with_ordinal(identified, [F.col("asset_id"), F.col("check_id"), *keys])
    group = ["asset_id", "check_id"]
    first = numbered.groupBy(*group).agg(F.min("ordinal").alias("_first"))
    return numbered.join(first, group).withColumn("place", F.col("ordinal") - F.col("_first")).drop("_first")
