"""Causal features over one series. Warm-up rows are NULL, never a shorter window.

Every function takes a window spec ordered by session whose partitions hold the series (or a
segment of it with enough halo rows, see ``operators.segments``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def require_positive(name: str, value: int) -> None:
    if value <= 0:
        raise ValueError(f"{name} must be positive")


def with_rolling_sums(
    df: DataFrame, sums: dict[str, tuple[str, int]], window: WindowSpec
) -> DataFrame:
    """Add exact trailing sums of ``n`` rows including the current one.

    ``sums`` maps an output name to (column, n). A decimal prefix sum minus its own lag costs
    the same for 200 rows as for 2; decimals make the difference exact.
    """
    for _, n in sums.values():
        require_positive("window", n)
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = {column: f"_prefix_{column}" for column, _ in sums.values()}
    summed = df.withColumns(
        {alias: F.sum(column).over(running) for column, alias in prefixes.items()}
        | {"_row": F.row_number().over(window)}
    )
    return summed.withColumns(
        {
            name: F.when(
                F.col("_row") >= n,
                F.col(prefixes[column])
                - F.coalesce(F.lag(prefixes[column], n).over(window), F.lit(0)),
            )
            for name, (column, n) in sums.items()
        }
    ).drop("_row", *prefixes.values())


def with_sma(df: DataFrame, averages: dict[str, tuple[str, int]], window: WindowSpec) -> DataFrame:
    """Add inclusive trailing means of ``n`` rows as doubles."""
    sums = {f"_sum_{name}": spec for name, spec in averages.items()}
    out = with_rolling_sums(df, sums, window)
    return out.withColumns(
        {name: F.col(f"_sum_{name}").cast("double") / n for name, (_, n) in averages.items()}
    ).drop(*sums)


def prior_max(column: str, n: int, window: WindowSpec) -> Column:
    """Maximum of the ``n`` rows before the current one."""
    return _prior(F.max, column, n, window)


def prior_min(column: str, n: int, window: WindowSpec) -> Column:
    """Minimum of the ``n`` rows before the current one."""
    return _prior(F.min, column, n, window)


def trailing_return(column: str, n: int, window: WindowSpec) -> Column:
    """``value[t] / value[t - n] - 1``."""
    require_positive("lookback", n)
    return F.col(column).cast("double") / F.lag(column, n).over(window).cast("double") - 1


def trailing_watermark(column: str, n: int, window: WindowSpec) -> Column:
    """Latest availability instant among the ``n`` rows a value at this row consumed."""
    require_positive("window", n)
    return F.max(column).over(window.rowsBetween(-(n - 1), 0))


def _prior(extreme, column: str, n: int, window: WindowSpec) -> Column:
    require_positive("window", n)
    frame = window.rowsBetween(-n, -1)
    return F.when(F.count(F.lit(1)).over(frame) == n, extreme(column).over(frame))
