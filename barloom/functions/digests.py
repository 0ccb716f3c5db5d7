"""A tree of digests over keyed tables: one root, and the way down to the rows that differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

#: Places of a series under one node, and buckets of series under one node.
FAN_OUT, SERIES_FAN_OUT = 256, 4_096
SERIES = ("table_name", "asset_id", "run_id")
#: From the rows up: the path that names a node, and what orders its children.
LEVELS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "blocks": (("part", "bucket", *SERIES, "span", "block"), ("place",)),
    "spans": (("part", "bucket", *SERIES, "span"), ("block",)),
    "series": (("part", "bucket", *SERIES), ("span",)),
    "buckets": (("part", "bucket"), SERIES),
    "parts": (("part",), ("bucket",)),
    "root": ((), ("part",)),
}


#: Levels that are stored: where the way down stops, and the root.
STORED = ("blocks", "series", "root")


def row_digests(rows: DataFrame, table: str, place: Column, payload: Column) -> DataFrame:
    """(path of its block, place, digest) of every row; ``place`` is a row's place in its series.

    Places are whole numbers from zero up to sixteen millions, such as days; they need not be dense.
    """
    at = place.cast("long")
    bucket = F.pmod(F.xxhash64(F.lit(table), "asset_id", "run_id"), F.lit(SERIES_FAN_OUT**2))
    return rows.select(
        F.floor(bucket / SERIES_FAN_OUT).cast("long").alias("part"),
        bucket.alias("bucket"),
        F.lit(table).alias("table_name"),
        "asset_id",
        "run_id",
        F.floor(at / FAN_OUT**2).cast("long").alias("span"),
        F.floor(at / FAN_OUT).cast("long").alias("block"),
        at.alias("place"),
        F.sha2(payload, 256).alias("digest"),
    )


def tree(rows: DataFrame) -> dict[str, DataFrame]:
    """The levels above :func:`row_digests`, by name; each node has its path, ``digest`` and ``n``, the rows below it.

    A node hashes its children in order. It has at most 256 of them inside a series and about 4,096 among series, so no
    task lists the digests of more, whatever the number of rows. No rows have no root. Blocks and series, which later
    readers look into, are written below the shared folder once.
    """
    found, below = {}, rows.withColumn("n", F.lit(1).cast("long"))
    for name, (path, order) in LEVELS.items():
        children = F.array_sort(F.collect_list(F.struct(*order, "digest")))
        digests = F.transform(children, lambda child: child["digest"])
        below = below.groupBy(*path).agg(
            F.sha2(F.array_join(digests, "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")
        )
        if name in ("blocks", "series"):
            below = materialize(below, f"digests-{name}")
        found[name] = below
    return found


def differences(kept: dict[str, DataFrame], kept_rows: DataFrame, actual: dict[str, DataFrame], actual_rows: DataFrame) -> DataFrame:
    """(table_name, asset_id, run_id, place, change) of the rows in which two trees differ.

    Goes down from the series whose digests differ (none, if the roots agree) to their blocks and from those to the rows,
    and looks only below what differs. ``change`` is ``changed``, ``missing`` (kept only) or ``added`` (found only). Rows of
    one place are compared together.
    """
    differing = None
    for name in ("series", "blocks"):
        path = LEVELS[name][0]
        sides = [_below(nodes[name], differing) for nodes in (kept, actual)]
        differing = materialize(_unequal(*sides, path).select(*path), f"differing-{name}")
    held = [
        _below(rows, differing).groupBy(*SERIES, "place").agg(F.array_join(F.sort_array(F.collect_list("digest")), "\n").alias("digest"))
        for rows in (kept_rows, actual_rows)
    ]
    return _unequal(*held, (*SERIES, "place")).select(*SERIES, "place", "change")


def _below(nodes: DataFrame, differing: DataFrame | None) -> DataFrame:
    """Nodes under those that differ."""
    return nodes if differing is None else nodes.join(differing, differing.columns, "left_semi")


def _unequal(kept: DataFrame, actual: DataFrame, path: Sequence[str]) -> DataFrame:
    """Nodes of either side whose digests differ, and how."""
    a = kept.select(*path, F.col("digest").alias("_kept"))
    b = actual.select(*path, F.col("digest").alias("_found"))
    both = a.join(b, list(path), "full_outer")
    change = F.when(F.col("_found").isNull(), "missing").when(F.col("_kept").isNull(), "added").otherwise("changed")
    return both.filter(~F.col("_kept").eqNullSafe(F.col("_found"))).withColumn("change", change)
