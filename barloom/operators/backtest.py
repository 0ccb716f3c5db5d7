"""Long/flat backtest in closed form over all series and cost settings at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import segments

RUN = ["asset_id", "run_id"]


@dataclass(frozen=True)
class Costs:
    """One cost setting; ``run_id`` names it in the results."""

    run_id: str = "base"
    initial_cash: float = 10_000.0
    commission_bps: float = 0.0
    slippage_bps: float = 0.0

    def __post_init__(self) -> None:
        if not 0 < self.initial_cash < float("inf"):
            raise ValueError("initial cash must be positive and finite")
        for value in (self.commission_bps, self.slippage_bps):
            if not 0 <= value < float("inf"):
                raise ValueError("costs must be non-negative and finite")
        if self.slippage_bps >= 10_000:
            raise ValueError("slippage must stay below 10000 bps")


@dataclass(frozen=True)
class Backtest:
    points: DataFrame
    trades: DataFrame
    totals: DataFrame


def backtest(
    bars: DataFrame,
    targets: DataFrame,
    costs: Sequence[Costs] = (Costs(),),
    *,
    position: str = "session_no",
    size: int | None = None,
) -> Backtest:
    """Act at the open when the target weight changes; start flat; all in or all out.

    All-in/all-out means capital is the initial cash times one factor per trade: a buy divides
    by the cost-laden open, a sell multiplies with the cost-reduced open. The running product
    replaces a bar-by-bar loop. ``bars`` carries the calendar position of each bar.
    """
    ledger = _ledger(bars, targets, costs, position, size)
    long = F.col("target_weight") == 1
    traded = F.col("_traded")
    asset_value = F.col("quantity") * F.col("_close")
    points = (
        ledger.withColumns(
            {
                "quantity": F.when(long, F.col("_capital")).otherwise(0.0),
                "cash": F.when(long, 0.0).otherwise(F.col("_capital")),
            }
        )
        .withColumn("equity", F.col("cash") + asset_value)
        .select(
            *RUN,
            "session",
            position,
            F.col("session_close_at").alias("observed_at"),
            F.col("close"),
            "cash",
            "quantity",
            "equity",
            F.col("target_weight").cast("int").alias("target_weight"),
            F.when(long, asset_value / F.col("equity")).otherwise(0.0).alias("actual_weight"),
        )
    )
    before = F.coalesce(F.col("_capital_before"), F.col("_cost.initial_cash"))
    commission = F.col("_cost.commission_bps") / 10_000
    slippage = F.col("_cost.slippage_bps") / 10_000
    execution = F.when(long, F.col("_open") * (1 + slippage)).otherwise(
        F.col("_open") * (1 - slippage)
    )
    filled = ledger.filter(traded).withColumns({"_before": before, "execution_price": execution})
    quantity = F.when(long, F.col("_before") / (1 + commission) / F.col("execution_price")).otherwise(
        F.col("_before")
    )
    trades = filled.withColumn("quantity", quantity).select(
        *RUN,
        "session",
        F.when(long, "buy").otherwise("sell").alias("side"),
        F.col("session_open_at").alias("executed_at"),
        F.col("open").alias("reference_price"),
        "execution_price",
        "quantity",
        F.when(long, F.col("_before") * commission / (1 + commission))
        .otherwise(F.col("_before") * F.col("execution_price") * commission)
        .alias("commission"),
        (F.col("quantity") * F.abs(F.col("execution_price") - F.col("_open"))).alias(
            "slippage_cost"
        ),
    )
    return Backtest(points, trades, run_totals(points, trades))


def run_totals(points: DataFrame, trades: DataFrame) -> DataFrame:
    """Final equity and costs per series and run."""
    spent = trades.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("trade_count"),
        F.sum("commission").alias("total_commission"),
        F.sum("slippage_cost").alias("total_slippage"),
    )
    return (
        points.groupBy(*RUN)
        .agg(
            F.max_by("equity", "session").alias("final_equity"),
            F.count(F.lit(1)).alias("point_count"),
        )
        .join(spent, RUN, "left")
        .na.fill(0, ["trade_count", "total_commission", "total_slippage"])
    )


def _ledger(bars, targets, costs, position: str, size: int | None) -> DataFrame:
    wanted = targets.select(
        "asset_id",
        F.col("effective_at").alias("session_open_at"),
        F.col("weight").cast("double").alias("_weight"),
    )
    matched = bars.select(
        "asset_id", "session", position, "session_open_at", "session_close_at", "open", "close"
    ).join(wanted, ["asset_id", "session_open_at"], "left")
    earlier = segments.running(
        matched,
        ["asset_id"],
        position,
        {"_previous": ("last", F.col("_weight"))},
        size,
        exclusive=True,
    )
    settings = F.array(
        *[
            F.struct(
                F.lit(c.run_id).alias("run_id"),
                F.lit(float(c.initial_cash)).alias("initial_cash"),
                F.lit(float(c.commission_bps)).alias("commission_bps"),
                F.lit(float(c.slippage_bps)).alias("slippage_bps"),
            )
            for c in costs
        ]
    )
    flat = F.lit(0.0)
    expanded = earlier.withColumns(
        {
            "target_weight": F.coalesce("_weight", "_previous", flat),
            "_open": F.col("open").cast("double"),
            "_close": F.col("close").cast("double"),
            "_cost": F.explode(settings),
        }
    ).withColumn("run_id", F.col("_cost.run_id"))
    commission = F.col("_cost.commission_bps") / 10_000
    slippage = F.col("_cost.slippage_bps") / 10_000
    traded = F.col("target_weight") != F.coalesce("_previous", flat)
    factor = F.when(
        F.col("target_weight") == 1,
        1 / ((1 + commission) * F.col("_open") * (1 + slippage)),
    ).otherwise(F.col("_open") * (1 - slippage) * (1 - commission))
    priced = expanded.withColumns(
        {"_traded": traded, "_factor": F.when(traded, factor).otherwise(1.0)}
    )
    grown = segments.running(priced, RUN, position, {"_growth": ("product", F.col("_factor"))}, size)
    return grown.withColumns(
        {
            "_capital": F.col("_cost.initial_cash") * F.col("_growth"),
            "_capital_before": F.col("_cost.initial_cash") * F.col("_growth") / F.col("_factor"),
        }
    )
