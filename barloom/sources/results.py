"""Backtest results as tables with a tree of digests, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import digests
from barloom.functions.identity import canonical_json, instant_text
from barloom.operators.backtest import RUN, Backtest, run_totals
from barloom.session import materialize

TABLES = ("points", "trades", "totals")
_EPOCH = "0001-01-01"


def write_run(result: Backtest, path: str, *, engine: str, dataset: str) -> None:
    """Store points, trades and totals, the digests of all their rows, the tree over them, and one manifest row per series and run.

    ``path`` holds one experiment; it must not exist yet. ``digests`` and ``nodes`` let a later reader name the rows that changed.
    """
    spark = result.points.sparkSession
    for name in ("points", "trades"):
        getattr(result, name).write.partitionBy("run_id").parquet(f"{path}/{name}")
    # Totals and digests come from what is stored, not from a further run of the backtest.
    run_totals(_read(spark, path, "points"), _read(spark, path, "trades")).write.parquet(f"{path}/totals")
    _row_digests(spark, path).write.parquet(f"{path}/digests")
    nodes = digests.tree(spark.read.parquet(f"{path}/digests"))
    for level in digests.STORED:
        nodes[level].write.parquet(f"{path}/nodes/{level}")
    _manifest(spark.read.parquet(f"{path}/nodes/series")).withColumns(
        {"engine": F.lit(engine), "dataset": F.lit(dataset)}
    ).write.parquet(f"{path}/manifest")


def verify_run(spark: SparkSession, path: str) -> DataFrame:
    """Recompute the digests of each series' stored points, trades and totals and compare them with the manifest."""
    manifest = spark.read.parquet(f"{path}/manifest")
    actual = _manifest(digests.tree(_row_digests(spark, path))["series"]).select(
        *RUN, F.col("row_count").alias("_rows"), F.col("content_hash").alias("_hash")
    )
    return manifest.join(actual, RUN, "full_outer").select(
        *RUN,
        F.coalesce("row_count", "_rows").alias("row_count"),
        F.when(F.col("content_hash").isNull(), "not_in_manifest")
        .when(F.col("_hash").isNull(), "result_missing")
        .when(F.col("row_count") != F.col("_rows"), "row_count_differs")
        .when(F.col("content_hash") != F.col("_hash"), "content_changed")
        .otherwise("verified")
        .alias("verdict"),
    )


def changed_rows(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, asset_id, run_id, session, change) of the stored rows that no longer are what was written.

    A total has no session. Found by going down the tree, so only blocks of 256 days that differ are compared row by row.
    """
    rows = materialize(_row_digests(spark, path), "digests")
    kept = {level: spark.read.parquet(f"{path}/nodes/{level}") for level in digests.STORED}
    found = digests.differences(kept, spark.read.parquet(f"{path}/digests"), digests.tree(rows), rows)
    day = F.date_add(F.lit(_EPOCH).cast("date"), F.col("place").cast("int"))
    return found.select(
        "table_name", *RUN, F.when(F.col("table_name") != "totals", day).alias("session"), "change"
    )


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")


def _row_digests(spark: SparkSession, path: str) -> DataFrame:
    """Digests of every stored row, by table, series and day."""
    day = F.datediff("session", F.lit(_EPOCH).cast("date"))
    parts = [
        digests.row_digests(rows := _read(spark, path, name), name, F.lit(0) if name == "totals" else day, _payload(rows))
        for name in TABLES
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _payload(rows: DataFrame) -> Column:
    """Canonical JSON of all columns but the key, in name order."""
    kinds = dict(rows.dtypes)

    def text(name: str) -> Column:
        if kinds[name].startswith("timestamp"):
            return instant_text(F.col(name))
        return F.col(name).cast("string") if kinds[name].startswith("decimal") else F.col(name)

    return canonical_json(F.struct(*[text(c).alias(c) for c in sorted(set(rows.columns) - set(RUN))]))


def _manifest(series: DataFrame) -> DataFrame:
    """One row per series and run: its points, and one hash over the roots of its tables."""
    roots = F.array_sort(F.collect_list(F.struct("table_name", "digest")))
    return series.groupBy(*RUN).agg(
        F.coalesce(F.sum(F.when(F.col("table_name") == "points", F.col("n"))), F.lit(0)).alias("row_count"),
        F.sha2(F.array_join(F.transform(roots, lambda r: F.concat_ws("\n", r["table_name"], r["digest"])), "\n"), 256).alias("content_hash"),
    )
