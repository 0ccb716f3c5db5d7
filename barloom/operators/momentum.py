"""Relative/absolute momentum selection over aligned monthly series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import calendar
from barloom.functions.features import require_positive, trailing_watermark

# Reasons of a decision.
RISK_ON = "risk_on"
CASH = "cash_non_positive"
TIE = "relative_tie"


def momentum_selection(
    periods: DataFrame, *, lookback: int = 12, hurdle: float = 0.0
) -> DataFrame:
    """Per period: the asset with the best trailing return, cash, or an explicit tie.

    A tie is exact: returns are compared by cross-multiplying closes, not as rounded ratios.
    The signal carries no execution time. ``decision_at`` is the latest availability over all
    assets and all months consumed.
    """
    require_positive("lookback", lookback)
    # At most twelve rows a year and asset.
    spec = Window.partitionBy("asset_id").orderBy("period_start")
    rows = periods.select(
        "asset_id",
        "period_start",
        "period_end",
        F.col("close").alias("now"),
        F.lag("close", lookback).over(spec).alias("then"),
        F.lag("period_start", lookback).over(spec).alias("_from"),
        trailing_watermark("available_at", lookback + 1, spec).alias("available_at"),
    )
    # The row that many rows before must also be that many months before: a gap has no return.
    rows = rows.filter(F.col("then").isNotNull() & (F.add_months("_from", lookback) == F.col("period_start")))
    ratio = F.col("now").cast("double") / F.col("then").cast("double")
    # Closes are compared by cross-multiplication. The largest rounded ratio is at most a few units
    # of the last place above the true one, so only assets that close can be the best.
    near = F.col("ratio") >= F.col("top") * (1 - 1e-12)
    tops = rows.groupBy("period_start").agg(F.max(ratio).alias("top"))
    contenders = rows.withColumn("ratio", ratio).join(tops, "period_start").filter(near)
    leaders = contenders.groupBy("period_start").agg(
        F.collect_set(F.struct("now", "then")).alias("_ratios")
    )
    ahead = F.aggregate(
        "_ratios",
        F.get("_ratios", F.lit(0)),
        lambda x, y: F.when(y["now"] * x["then"] > x["now"] * y["then"], y).otherwise(x),
    )
    leaders = leaders.select("period_start", ahead.alias("best"))
    ties = (
        contenders.join(leaders, "period_start")
        .filter(F.col("now") * F.col("best.then") == F.col("best.now") * F.col("then"))
        .groupBy("period_start")
        .agg(F.count(F.lit(1)).alias("leaders"), F.min("asset_id").alias("leader"), F.first("best").alias("best"))
    )
    best = rows.groupBy("period_start", "period_end").agg(
        F.max("available_at").alias("decision_at"),
        F.count(F.lit(1)).alias("asset_count"),
        F.min(ratio - 1).alias("weakest_return"),
    )
    # The exact difference first, so that the sign is never lost to rounding.
    gain = F.col("best.now") - F.col("best.then")
    strongest = gain.cast("double") / F.col("best.then").cast("double")
    above = (
        F.col("best.now") > F.col("best.then") if hurdle == 0 else strongest > F.lit(hurdle)
    )
    tied = F.col("leaders") > 1
    return best.join(ties, "period_start").select(
        "period_start",
        "period_end",
        "decision_at",
        "asset_count",
        strongest.alias("strongest_return"),
        "weakest_return",
        F.when(~tied & above, F.col("leader")).alias("selected_asset"),
        F.when(tied, TIE).when(above, RISK_ON).otherwise(CASH).alias("reason"),
    )


def alignment_violations(periods: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Why monthly series must not be compared.

    Every period needs all assets on identical expected sessions, months must be consecutive,
    and ``descriptors`` (asset_id, frequency, adjustment_mode, calendar_id, ...) must agree
    and describe monthly total-return series.
    """
    assets = descriptors.agg(F.count_distinct("asset_id")).scalar()
    uneven = (
        periods.groupBy("period_start")
        .agg(
            F.count_distinct("asset_id").alias("n"),
            F.count_distinct("expected_hash").alias("hashes"),
        )
        .select(
            "period_start",
            F.when(F.col("n") < assets, "asset_missing")
            .when(F.col("hashes") > 1, "sessions_differ")
            .alias("rule"),
        )
        .filter(F.col("rule").isNotNull())
        .select(F.lit("*").alias("asset_id"), "period_start", "rule")
    )
    spec = Window.partitionBy("asset_id").orderBy("period_start")
    previous = F.lag("period_start").over(spec)
    gaps = (
        periods.select("asset_id", "period_start", previous.alias("previous"))
        .filter(
            F.col("period_start")
            != calendar.next_period_start(F.col("previous"), calendar.MONTH)
        )
        .select("asset_id", "period_start", F.lit("month_gap").alias("rule"))
    )
    semantics = [c for c in descriptors.columns if c != "asset_id"]
    kinds = descriptors.select(F.count_distinct(F.struct(*semantics))).scalar()
    odd = descriptors.select(
        "asset_id",
        F.lit(None).cast("date").alias("period_start"),
        F.when(F.col("frequency") != calendar.MONTH, "not_monthly")
        .when(F.col("adjustment_mode") != "total_return", "not_total_return")
        .when(kinds > 1, "semantics_differ")
        .alias("rule"),
    ).filter(F.col("rule").isNotNull())
    return uneven.unionByName(gaps).unionByName(odd)


def signal_violations(signals: DataFrame) -> DataFrame:
    """Closed reasons and their consistency with the selection."""
    r = F.col("reason")
    broken = (
        F.when(~r.isin(RISK_ON, CASH, TIE), "unknown_reason")
        .when((r == RISK_ON) & F.col("selected_asset").isNull(), "winner_missing")
        .when((r != RISK_ON) & F.col("selected_asset").isNotNull(), "selection_without_winner")
        .when((r == CASH) & (F.col("strongest_return") > 0), "positive_winner_in_cash")
        .when((r == RISK_ON) & (F.col("strongest_return") <= 0), "non_positive_winner")
        .when(F.col("weakest_return") <= -1, "return_below_minus_one")
        .when(F.dayofmonth("period_start") != 1, "not_a_natural_month")
        .when(F.col("period_end") != F.last_day("period_start"), "not_a_natural_month")
    )
    return signals.select("period_start", broken.alias("rule")).filter(
        F.col("rule").isNotNull()
    )
