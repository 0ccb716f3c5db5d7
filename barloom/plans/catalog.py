"""Registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import features
from barloom.operators import exact, metrics, segments
from barloom.operators.alignment import cover
from barloom.operators.backtest import Costs, backtest
from barloom.operators.metrics import (
    MetricPolicy,
    drawdown_points,
    long_form,
    metric_set,
)
from barloom.operators.rsi import with_wilder_rsi
from barloom.plans import strategies, views
from barloom.plans.publish import publish

KEY = ["asset_id"]
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


market = views.market


@query
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars_all(spark, sf_dir)
    return publish(
        bars.select("asset_id", "session", "open", "high", "low", "close", "volume", "line_count")
    )


def _covered(spark, sf_dir):
    return cover(*market(spark, sf_dir))


def _features(spark, sf_dir, halo, add):
    """Features over framed windows of the covered series."""
    a = _covered(spark, sf_dir)
    framed = segments.cut_with_halo(a.bars, "session_no", halo, a.size)
    return segments.drop_halo(
        add(framed, segments.series_window(KEY, "session_no", a.size)), "session_no", a.size
    )


@query
def sma_200(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _features(
        spark, sf_dir, 199, lambda df, w: features.with_sma(df, {"sma": ("close", 200)}, w)
    )
    return publish(out.select("asset_id", "session", "close", "sma"))


@query
def donchian_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def add(df, w):
        return df.withColumns(
            {
                "upper": features.prior_max("high", 55, w),
                "lower": features.prior_min("low", 20, w),
            }
        )

    return publish(
        _features(spark, sf_dir, 55, add).select("asset_id", "session", "upper", "lower")
    )


@query
def trailing_return_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _features(
        spark,
        sf_dir,
        12,
        lambda df, w: df.withColumn("momentum", features.trailing_return("close", 12, w)),
    )
    return publish(out.select("asset_id", "session", "momentum"), momentum=8)


@query
def running_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _covered(spark, sf_dir)
    points = drawdown_points(_as_equity(a.bars), KEY, size=a.size)
    return publish(
        points.select("asset_id", "observed_on", "running_peak", "drawdown"), drawdown=8
    )


@query
def wilder_rsi_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rsi(spark, sf_dir, 2)


@query
def wilder_rsi_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rsi(spark, sf_dir, 14)


def _rsi(spark, sf_dir, period):
    a = _covered(spark, sf_dir)
    out = with_wilder_rsi(a.bars, KEY, "session_no", "close", period, size=a.size)
    return publish(out.select("asset_id", "session", "rsi"))


@query
def targets_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, sessions = market(spark, sf_dir)
    return publish(strategies.sma_targets(bars, sessions, window=200).clean())


@query
def targets_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, sessions = market(spark, sf_dir, after="1d")
    return publish(strategies.rsi_pullback_targets(bars, sessions).clean())


@query
def targets_s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, sessions = market(spark, sf_dir, after="1d")
    return publish(strategies.donchian_targets(bars, sessions).clean())


COSTS = (Costs("free", 10_300), Costs("costly", 10_300, 10, 5))


def _run(spark, sf_dir, window=200):
    bars, sessions = market(spark, sf_dir)
    a = cover(bars, sessions)
    targets = strategies.sma_targets(bars, sessions, window=window).clean()
    return backtest(a.bars, targets, COSTS, size=a.size), a.size


@query
def backtest_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _run(spark, sf_dir)[0].points.drop("session_no")
    return publish(points, significant=("cash", "equity", "quantity"))


@query
def backtest_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = _run(spark, sf_dir)[0].trades
    return publish(
        trades, significant=("quantity", "commission", "slippage_cost"), execution_price=7
    )


@query
def backtest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = _run(spark, sf_dir)[0].totals
    return publish(totals, significant=("final_equity", "total_commission", "total_slippage"))


POLICY = MetricPolicy(252, 365, 1, 0.02, "annual_effective")


def _as_equity(aligned: DataFrame, value: str = "close") -> DataFrame:
    return aligned.select(
        "asset_id",
        F.col("session").alias("observed_on"),
        F.col("session_no").alias("position"),
        F.col(value).alias("equity"),
    )


@query
def metrics_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _covered(spark, sf_dir)
    scored = metric_set(_as_equity(a.bars), KEY, POLICY, size=a.size)
    return publish(long_form(scored, KEY), significant=("value",))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: bars -> SMA targets -> costed backtest -> five metrics per run."""
    result, size = _run(spark, sf_dir, window=50)
    equity = result.points.select(
        "asset_id",
        "run_id",
        F.col("session").alias("observed_on"),
        F.col("session_no").alias("position"),
        "equity",
    )
    keys = ["asset_id", "run_id"]
    scored = metric_set(equity, keys, POLICY, size=size)
    return publish(long_form(scored, keys), significant=("value",))


@query
def research_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry(spark, sf_dir)


S1_GRID = tuple(
    (entry, exit_, trend)
    for entry in (5, 10, 15, 20)
    for exit_ in (50, 60, 70, 80)
    for trend in (150, 200, 250)
)
S2_PAIRS = ((20, 10), (40, 20), (55, 20), (80, 40))


def _sweep_summary(targets: DataFrame) -> DataFrame:
    return targets.groupBy("asset_id", "params").agg(
        F.count(F.lit(1)).alias("targets"),
        F.sum("weight").alias("long_days"),
        F.max(F.when(F.col("weight") == 1, F.col("session"))).alias("last_long"),
    )


@query
def sweep_s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pullback strategy over 48 parameter sets in one pass."""
    bars, sessions = market(spark, sf_dir, after="1d")
    return publish(
        _sweep_summary(strategies.rsi_pullback_targets(bars, sessions, grid=S1_GRID).clean())
    )


@query
def sweep_s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breakout strategy over four window pairs in one pass."""
    bars, sessions = market(spark, sf_dir, after="1d")
    return publish(
        _sweep_summary(strategies.donchian_targets(bars, sessions, pairs=S2_PAIRS).clean())
    )


@query
def exact_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _covered(spark, sf_dir)
    return publish(metrics.exact_returns(_as_equity(a.bars), KEY, size=a.size))


def _supplier_equity(spark, sf_dir) -> DataFrame:
    """Close prices of every supplier as an equity series, numbered by date."""
    bars = views.stored(
        spark, sf_dir, "bars-supplier", lambda: views.bars_by_supplier(spark, sf_dir)
    ).select("asset_id", "session", "close")
    return segments.positions(bars, KEY, "session").select(
        "asset_id",
        F.col("session").alias("observed_on"),
        "position",
        F.col("close").alias("equity"),
    )


@query
def metrics_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version 2 metrics of every supplier's price series."""
    scored = metric_set(_supplier_equity(spark, sf_dir), KEY, POLICY, version=2)
    return publish(long_form(scored, KEY), significant=("value",))


@query
def sma_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moving average over many uneven series."""
    spec = segments.series_window(KEY, "position", None)
    out = features.with_sma(_supplier_equity(spark, sf_dir), {"sma": ("equity", 20)}, spec)
    return publish(out.select("asset_id", "observed_on", "sma"))


@query
def metric_input_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns rounded to two digits rarely reconcile exactly; some are missing or too low."""
    a = _covered(spark, sf_dir)
    d = views.day_number("observed_on")
    equity = _as_equity(a.bars).withColumn(
        "equity", F.when(d % 401 == 0, F.lit(0)).otherwise(F.col("equity")).cast("decimal(18,6)")
    )
    rounded = (
        metrics.simple_returns(_as_equity(a.bars), KEY, size=a.size)
        .select(
            "asset_id",
            "observed_on",
            F.when(d % 307 == 0, -2)
            .otherwise(F.round("value", 2))
            .cast("decimal(18,6)")
            .alias("value"),
        )
        .filter(d % 211 != 0)
    )
    found = metrics.metric_input_violations(equity, rounded, KEY, size=a.size)
    return publish(found.groupBy("asset_id", "rule").agg(F.count(F.lit(1)).alias("n")))


@query
def exact_rsi_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal RSI, printed like the native one."""
    a = _covered(spark, sf_dir)
    rsi = exact.exact_wilder_rsi(a.bars, KEY, "session_no", "close", 2)
    dated = rsi.join(a.bars.select("asset_id", "session_no", "session"), ["asset_id", "session_no"])
    return publish(dated.select("asset_id", "session", F.col("rsi").cast("double").alias("rsi")))


@query
def exact_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal backtest of the costly setting."""
    bars, sessions = market(spark, sf_dir)
    targets = strategies.sma_targets(bars, sessions, window=200).clean()
    points = exact.exact_backtest(cover(bars, sessions).bars, targets, COSTS[1])
    return publish(
        points.select(
            "asset_id",
            "session",
            *[F.col(c).cast("double").alias(c) for c in ("cash", "quantity", "equity")],
            "target_weight",
        ),
        significant=("cash", "quantity", "equity"),
    )
