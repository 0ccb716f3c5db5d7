"""Close-by-close comparison of two sources without blending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import relative_bps, within_relative_bps


def compare_close(
    primary: DataFrame,
    secondary: DataFrame,
    *,
    pass_bps: str = "10",
    warning_bps: str = "50",
) -> DataFrame:
    """One check per asset and session found in either source; bps relative to the primary."""
    if not 0 <= float(pass_bps) <= float(warning_bps):
        raise ValueError("the pass tolerance must not exceed the warning tolerance")

    def side(bars: DataFrame, name: str) -> DataFrame:
        return bars.select("asset_id", "session", F.col("close").alias(f"{name}_close"))

    joined = side(primary, "primary").join(
        side(secondary, "secondary"), ["asset_id", "session"], "full_outer"
    )
    a, b = F.col("primary_close"), F.col("secondary_close")
    missing = a.isNull() | b.isNull()
    return joined.select(
        "asset_id",
        "session",
        "primary_close",
        "secondary_close",
        F.when(~missing, relative_bps(a, b)).alias("difference_bps"),
        F.when(missing, "missing")
        .when(within_relative_bps(a, b, pass_bps), "pass")
        .when(within_relative_bps(a, b, warning_bps), "warning")
        .otherwise("fail")
        .alias("status"),
        F.when(missing, "session is absent from one source").alias("reason"),
    )


def summarize(checks: DataFrame) -> DataFrame:
    """Counts and overall verdict per asset; a missing session fails closed."""
    status = F.col("status")
    counted = checks.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("total_sessions"),
        F.count_if(status != "missing").alias("overlapping_sessions"),
        *[
            F.count_if(status == s).alias(f"{s}_count")
            for s in ("pass", "warning", "fail", "missing")
        ],
    )
    return counted.withColumn(
        "overall_status",
        F.when((F.col("fail_count") > 0) | (F.col("missing_count") > 0), "fail")
        .when(F.col("warning_count") > 0, "warning")
        .otherwise("pass"),
    )


def duplicate_sessions(bars: DataFrame) -> DataFrame:
    """Sessions a source reports more than once; comparing such a source is an error."""
    return (
        bars.groupBy("asset_id", "session")
        .agg(F.count(F.lit(1)).alias("bar_count"))
        .filter(F.col("bar_count") > 1)
    )
