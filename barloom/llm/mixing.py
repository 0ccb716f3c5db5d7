"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tables import aside, restored

#: Buckets of the order within a source: prefix sums are exact over buckets first, rows second.
SLICES = 1 << 16
#: Columns that :func:`assign` adds.
ASSIGNED = ("size", "source_size", "target", "taken", "uses")
#: Columns that :func:`training_order` adds in place of ``uses``.
USE = ("epoch", "words", "position")


def targets(
    sizes: DataFrame, *, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, weight, target) of each source.

    ``sizes`` has a row per source. Sources in code-point order, NULL last, take ``weights`` in
    turn and share ``share`` times all sizes. No target exceeds ``most`` times its source's size;
    the excess goes to the others by weight until none is above. That level is found directly:
    in order of size by weight, the capped sources are those below the share each would leave
    to itself and all after it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    named = sizes.select(
        "source",
        F.col("source_size"),
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight"),
    ).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    levels = named.withColumn("level", level)
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    return levels.withColumn("open", F.max(open_level).over(everything)).select(
        "source",
        "source_size",
        "weight",
        F.least("cap", F.coalesce(F.col("open") * F.col("weight"), F.col("cap"))).alias("target"),
    )


def position(demand: Column, tilt: Column) -> Column:
    """Training time in [0, 1] at which a share ``demand`` of a source's tokens is used up.

    The weight of a source runs linearly from 1 - tilt to 1 + tilt times its mean; its integral
    t * (1 - tilt) + tilt * t^2 is inverted in the form that stays exact for tilt 0.
    """
    root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * demand)
    return F.when(demand <= 0, F.lit(0.0)).otherwise(2 * demand / ((1 - tilt) + root))


def order_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def assign(
    docs: DataFrame,
    size: Column,
    *,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    tilts: tuple[float, ...] = (-0.5, 0.0, 0.5),
    share: float = 1.5,
    most: float = 2.0,
    slices: int = SLICES,
) -> DataFrame:
    """What the mix takes of every document, and when.

    Adds ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted) and the
    array ``uses`` of (epoch, words, position). A source lays its documents end to end in a
    fixed pseudo-random order, again and again, and the mix takes the first ``target`` words
    of that line, so at most one document per source is cut and reruns agree. ``position`` is the
    training time at which the source's cumulative demand reaches the use's middle word.
    Sources with a small ``tilt`` come early, with a large one late.

    The running size of a hot source is not one window: hashes cut each source into ``slices``
    parts, whose totals are summed first. NULL sizes count 0; documents without words
    take 0 words and have no use; NULL sources form one source; repeated ids are ordered by size,
    and rows alike in both are interchangeable. Further columns of any name pass through; one called
    like a new column is replaced.
    """
    key = order_key(F.col("doc_id"))
    sized = docs.select(
        *aside(docs),
        "doc_id",
        "source",
        F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("size"),
        key.alias("_key"),
        (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % slices).alias("_slice"),
    )
    taken = take(sized, weights=weights, tilts=tilts, share=share, most=most)
    return taken.select(*restored(docs, ASSIGNED), *ASSIGNED)


def take(sized: DataFrame, *, weights, tilts, share, most) -> DataFrame:
    parts = sized.groupBy("source", "_slice").agg(F.sum("size").alias("_part"))
    sources = targets(
        parts.groupBy("source").agg(F.sum("_part").alias("source_size")), weights=weights, share=share, most=most
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    tilt = F.element_at(
        F.array(*[F.lit(float(t)) for t in tilts]), ((F.row_number().over(by_name) - 1) % len(tilts) + 1).cast("int")
    )
    sources = sources.withColumn("tilt", tilt).withColumnRenamed("source", "_source")
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        F.col("source").alias("_psource"),
        F.col("_slice").alias("_pslice"),
        F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_carry"),
    )
    inside = (
        Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = (
        sized.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(carried, F.col("source").eqNullSafe(F.col("_psource")) & (F.col("_slice") == F.col("_pslice")))
        .join(sources, F.col("source").eqNullSafe(F.col("_source")))
    )
    start = F.col("_carry") + F.col("_inside")
    budget = F.floor("target").cast("long")
    epochs = F.sequence(F.lit(0), F.lit(max(0, -int(-most // 1) - 1)))

    def use(epoch):
        at = start + epoch * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), budget - at))
        middle = F.try_divide(at + words / 2, F.col("target"))
        return F.struct(
            epoch.cast("int").alias("epoch"), words.alias("words"), position(middle, F.col("tilt")).alias("position")
        )

    uses = F.filter(F.transform(epochs, use), lambda u: u["words"] > 0)
    kept = [c for c in sized.columns if c not in ("_key", "_slice")]
    return placed.withColumn("uses", uses).select(
        *kept,
        "source_size",
        "target",
        F.aggregate("uses", F.lit(0).cast("long"), lambda total, u: total + u["words"]).alias("taken"),
        "uses",
    )


def training_order(assigned: DataFrame) -> DataFrame:
    """One row per use of a document, range-sorted by training position.

    ``uses`` becomes epoch, words and position, which replace columns of those names.
    """
    rows = assigned.select(*aside(assigned), "doc_id", F.explode("uses").alias("use"))
    ordered = rows.orderBy("use.position", "doc_id", "use.epoch")
    return ordered.select(*restored(assigned, (*USE, "uses")), *[f"use.{c}" for c in USE])
