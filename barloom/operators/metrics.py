"""Performance metrics with explicit policies, status and reason."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import segments

METRICS = ("total_return", "cagr", "volatility", "sharpe", "max_drawdown")

# Status and reason vocabulary of a metric.
VALID = "valid"
UNDEFINED = "undefined"
FAILURE = "failure"
FEW_EQUITY = "insufficient_equity_observations"
FEW_RETURNS = "insufficient_return_observations"
NO_TIME = "non_positive_elapsed_time"
NO_VOLATILITY = "zero_volatility"
NUMERIC_ERROR = "numeric_error"


@dataclass(frozen=True)
class MetricPolicy:
    """Annualization, ddof and risk-free assumption; nothing is implied."""

    periods_per_year: float
    days_per_year: float
    volatility_ddof: int
    risk_free_rate: float = 0.0
    risk_free_kind: str = "per_observation_simple"

    def __post_init__(self) -> None:
        if self.periods_per_year <= 0 or self.days_per_year <= 0:
            raise ValueError("annualization values must be positive")
        if self.volatility_ddof < 0:
            raise ValueError("ddof must not be negative")
        if self.risk_free_rate <= -1:
            raise ValueError("the risk-free rate must be greater than -1")
        if self.risk_free_kind not in ("annual_effective", "per_observation_simple"):
            raise ValueError("unknown risk-free rate kind")

    @property
    def periodic_risk_free(self) -> float:
        if self.risk_free_kind == "annual_effective":
            return (1 + self.risk_free_rate) ** (1 / self.periods_per_year) - 1
        return self.risk_free_rate


def simple_returns(
    equity: DataFrame, keys: Sequence[str], *, size: int | None = None
) -> DataFrame:
    """Adjacent simple returns; ``equity`` has keys, observed_on, position, equity."""
    rows = _with_previous(equity, keys, size).filter(F.col("_previous").isNotNull())
    return rows.select(
        *keys,
        "observed_on",
        (F.col("equity").cast("double") / F.col("_previous").cast("double") - 1).alias("value"),
    )


def exact_returns(
    equity: DataFrame, keys: Sequence[str], *, size: int | None = None
) -> DataFrame:
    """Adjacent returns as reduced integer ratios.

    ``equity`` is a decimal column of any scale up to 18, its values of at most 18 digits. Both values share one scale, so the ratio of the unscaled
    integers is the exact return; Euclid's algorithm runs as a bounded fold over a short array
    (a 19-digit pair needs at most 90 steps).
    """
    rows = _with_previous(equity, keys, size).filter(F.col("_previous").isNotNull())
    scale = equity.schema["equity"].dataType.scale
    unscaled = rows.select(
        *keys,
        "observed_on",
        (_unscaled(F.col("equity"), scale) - _unscaled(F.col("_previous"), scale)).alias("_n"),
        _unscaled(F.col("_previous"), scale).alias("_d"),
    )
    divisor = F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        F.struct(F.abs("_n").alias("a"), F.col("_d").alias("b")),
        lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(
            F.struct(acc["b"].alias("a"), (acc["a"] % F.nullif(acc["b"], F.lit(0))).alias("b"))
        ),
        lambda acc: acc["a"],
    )
    return unscaled.withColumn("_g", divisor).select(
        *keys,
        "observed_on",
        F.expr("_n div _g").alias("numerator"),
        F.expr("_d div _g").alias("denominator"),
    )


def drawdown_points(
    equity: DataFrame, keys: Sequence[str], *, size: int | None = None
) -> DataFrame:
    """Each observation with its running peak and drawdown."""
    peaked = segments.running(
        equity,
        keys,
        "position",
        {"running_peak": ("max", F.col("equity").cast("double"))},
        size,
    )
    return peaked.withColumn(
        "drawdown", F.col("equity").cast("double") / F.col("running_peak") - 1
    )


def metric_set(
    equity: DataFrame,
    keys: Sequence[str],
    policy: MetricPolicy,
    *,
    returns: DataFrame | None = None,
    version: int = 1,
    size: int | None = None,
) -> DataFrame:
    """Five metrics per run, each a struct of status, value and reason.

    ``equity`` has keys, observed_on, position (from zero) and equity. ``returns`` defaults to
    the simple returns of the equity. Version 2 defines CAGR at terminal zero as -1.
    """
    if version not in (1, 2):
        raise ValueError("metric set version must be 1 or 2")
    points = drawdown_points(equity, keys, size=size)
    value = F.col("equity").cast("double")
    if returns is None:
        # Peak and previous value come from one pass over the same window partitions.
        points = _with_previous(points, keys, size).withColumn(
            "value", value / F.col("_previous").cast("double") - 1
        )
    shape = [
        F.count(F.lit(1)).alias("n_equity"),
        F.min_by(value, "observed_on").alias("first"),
        F.max_by(value, "observed_on").alias("last"),
        F.datediff(F.max("observed_on"), F.min("observed_on")).alias("days"),
        F.least(F.min("drawdown"), F.lit(0.0)).alias("worst"),
    ]
    observed = F.col("value").cast("double")
    moments = [
        F.count("value").alias("n_returns"),
        F.avg(observed).alias("mean"),
        F.var_pop(observed).alias("variance"),
    ]
    if returns is None:
        facts = points.groupBy(*keys).agg(*shape, *moments)
    else:
        facts = (
            points.groupBy(*keys)
            .agg(*shape)
            .join(returns.groupBy(*keys).agg(*moments), list(keys), "full_outer")
            .na.fill(0, ["n_equity", "n_returns"])
        )
    few_equity = F.col("n_equity") < 2
    degrees = F.col("n_returns") - policy.volatility_ddof
    volatility = F.sqrt(F.col("variance") * F.col("n_returns") / F.nullif(degrees, F.lit(0))) * (
        policy.periods_per_year**0.5
    )
    growth = F.pow(
        F.try_divide("last", "first"), F.try_divide(F.lit(policy.days_per_year), F.col("days"))
    )
    if version == 2:
        growth = F.when(F.col("last") == 0, 0.0).otherwise(growth)
    excess = (F.col("mean") - policy.periodic_risk_free) * policy.periods_per_year
    few_returns = degrees <= 0
    scored = facts.withColumn("_vol", F.when(~few_returns, volatility))
    return scored.select(
        *keys,
        _metric(F.try_divide("last", "first") - 1, [(few_equity, FEW_EQUITY)]).alias(
            "total_return"
        ),
        _metric(growth - 1, [(few_equity, FEW_EQUITY), (F.col("days") <= 0, NO_TIME)]).alias(
            "cagr"
        ),
        _metric(F.col("_vol"), [(few_returns, FEW_RETURNS)]).alias("volatility"),
        _metric(
            F.try_divide(excess, F.col("_vol")),
            [(few_returns, FEW_RETURNS), (F.col("_vol") == 0, NO_VOLATILITY)],
        ).alias("sharpe"),
        _metric(F.col("worst"), [(F.col("n_equity") == 0, FEW_EQUITY)]).alias("max_drawdown"),
    )


def long_form(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run and metric."""
    items = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.col(f"{name}.status").alias("status"),
                F.col(f"{name}.value").alias("value"),
                F.col(f"{name}.reason").alias("reason"),
            )
            for name in METRICS
        ]
    )
    return metrics.select(*keys, F.inline(items))


def metric_input_violations(
    equity: DataFrame,
    returns: DataFrame | None,
    keys: Sequence[str],
    *,
    size: int | None = None,
) -> DataFrame:
    """Contract of the metric input: positive start, zero only at the end, exact returns.

    Equity and returns are decimals; the reconciliation multiplies instead of dividing.
    """
    flagged = _with_terminal(_with_previous(equity, keys, size), keys)
    first = flagged.filter(F.col("_previous").isNull() & (F.col("equity") <= 0))
    zero = flagged.filter((F.col("equity") <= 0) & ~F.col("_terminal"))
    found = _rule(first, keys, "non_positive_start").unionByName(
        _rule(zero, keys, "non_terminal_zero")
    )
    found = found.unionByName(
        _rule(
            equity.groupBy(*keys, "observed_on").count().filter("count > 1"),
            keys,
            "duplicate_observation",
        )
    )
    if returns is None:
        return found
    pairs = (
        flagged.filter(F.col("_previous").isNotNull())
        .select(*keys, "observed_on", F.col("equity").alias("_now"), "_previous")
        .join(returns.select(*keys, "observed_on", "value"), [*keys, "observed_on"], "full_outer")
    )
    exact = F.col("value") * F.col("_previous") == F.col("_now") - F.col("_previous")
    whole_loss = _with_terminal(returns, keys).filter((F.col("value") < -1) | ((F.col("value") == -1) & ~F.col("_terminal")))
    return (
        found.unionByName(_rule(pairs.filter(F.col("value").isNull()), keys, "return_missing"))
        .unionByName(_rule(pairs.filter(F.col("_now").isNull()), keys, "return_without_transition"))
        .unionByName(_rule(pairs.filter(~exact), keys, "return_mismatch"))
        .unionByName(_rule(whole_loss, keys, "invalid_loss"))
    )


def _with_previous(equity: DataFrame, keys: Sequence[str], size: int | None) -> DataFrame:
    framed = segments.cut_with_halo(equity, "position", 1, size)
    spec = segments.series_window(keys, "position", size)
    return segments.drop_halo(
        framed.withColumn("_previous", F.lag("equity").over(spec)), "position", size
    )


def _with_terminal(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    last = rows.groupBy(*keys).agg(F.max("observed_on").alias("_last"))
    return rows.join(last, list(keys)).withColumn(
        "_terminal", F.col("observed_on") == F.col("_last")
    )


def _metric(value: Column, undefined: Sequence[tuple[Column, str]]) -> Column:
    reason = F.lit(None).cast("string")
    for condition, text in reversed(undefined):
        reason = F.when(condition, text).otherwise(reason)
    broken = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.struct(
        F.when(reason.isNotNull(), UNDEFINED).when(broken, FAILURE).otherwise(VALID).alias("status"),
        F.when(reason.isNull() & ~broken, value).alias("value"),
        F.when(reason.isNotNull(), reason).when(broken, NUMERIC_ERROR).alias("reason"),
    )


def _rule(rows: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    return rows.select(*keys, "observed_on", F.lit(rule).alias("rule"))


def _unscaled(value: Column, scale: int) -> Column:
    """The integer behind a decimal; a value of more than 18 digits at its scale is an error, never rounded."""
    return (value.cast(f"decimal(18,{scale})") * F.lit(Decimal(10**scale))).cast("bigint")
