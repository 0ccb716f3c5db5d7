"""Wilder RSI as a blocked linear recurrence."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.features import require_positive
from barloom.operators import segments

BLOCK_ROWS = 256


def with_wilder_rsi(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    column: str,
    period: int,
    *,
    name: str = "rsi",
    size: int | None = None,
) -> DataFrame:
    """Add Wilder's RSI; ``position`` numbers the rows of each series from zero without gaps.

    The smoothed averages obey ``a[t] = r * a[t-1] + x[t] / p`` with ``r = (p - 1) / p``, where
    the mean of the first ``p`` changes enters at row ``p``. Within a block of 256 rows the
    solution is a weighted prefix sum; blocks before contribute their end values, damped by
    ``r ** 256`` each. All terms are non-negative, so nothing cancels. A row without any price
    change scales both averages alike and therefore keeps the RSI of the row before.
    """
    require_positive("period", period)
    ratio = (period - 1) / period
    block = BLOCK_ROWS
    spec = segments.series_window(keys, position, block)
    framed = segments.cut_with_halo(df, position, period, block)
    changes = framed.withColumn("_change", F.col(column) - F.lag(column).over(spec))
    seed = spec.rowsBetween(-(period - 1), 0)
    place = F.col(position) % block

    def impulse(value):
        moved = F.greatest(value, F.lit(0)).cast("double")
        return (
            F.when(F.col(position) > period, moved / period)
            .when(F.col(position) == period, F.sum(moved).over(seed) / period)
            .otherwise(0.0)
        )

    own = F.floor(F.col(position) / block) == F.col(segments.SEGMENT)
    pulses = changes.withColumns(
        {"_gain": impulse(F.col("_change")), "_loss": impulse(-F.col("_change"))}
    ).filter(own)
    if ratio == 0:
        averaged = pulses.withColumns({"_avg_gain": F.col("_gain"), "_avg_loss": F.col("_loss")})
    else:
        averaged = _averages(pulses, keys, position, ratio, place)

    both_zero = (F.col("_avg_gain") == 0) & (F.col("_avg_loss") == 0)
    value = (
        F.when(F.col(position) < period, None)
        .when(both_zero & (F.col(position) == period), 50.0)
        .when((F.col("_change") == 0) & (F.col(position) > period), None)
        .when(F.col("_avg_loss") == 0, 100.0)
        .when(F.col("_avg_gain") == 0, 0.0)
        .otherwise(100 * F.col("_avg_gain") / (F.col("_avg_gain") + F.col("_avg_loss")))
    )
    if ratio == 0:
        # Without memory a flat row has no average at all: both sides are zero.
        value = F.when(
            (F.col(position) >= period) & both_zero, 50.0
        ).otherwise(value)
    filled = segments.running(
        averaged.drop(segments.SEGMENT).withColumn("_rsi", value),
        keys,
        position,
        {name: ("last", F.col("_rsi"))},
        size,
    )
    return filled.select(*df.columns, name)


def _averages(pulses: DataFrame, keys, position: str, ratio: float, place) -> DataFrame:
    block = BLOCK_ROWS
    decay = ratio**block
    depth = max(1, math.ceil(36 / -math.log10(decay)))
    weighted = {side: F.col(f"_{side}") * F.pow(F.lit(ratio), -place) for side in ("gain", "loss")}
    ends = pulses.groupBy(*keys, segments.SEGMENT).agg(
        *[(F.sum(w) * ratio ** (block - 1)).alias(f"_end_{side}") for side, w in weighted.items()]
    )
    order = Window.partitionBy(*keys).orderBy(segments.SEGMENT)
    carries = ends.select(
        *keys,
        segments.SEGMENT,
        *[
            sum(
                (
                    F.coalesce(F.lag(f"_end_{side}", back).over(order), F.lit(0.0))
                    * decay ** (back - 1)
                    for back in range(1, depth + 1)
                ),
                F.lit(0.0),
            ).alias(f"_carry_{side}")
            for side in weighted
        ],
    )
    rows = segments.series_window(keys, position, block).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = pulses.withColumns(
        {
            f"_local_{side}": F.sum(w).over(rows) * F.pow(F.lit(ratio), place)
            for side, w in weighted.items()
        }
    )
    return local.join(carries, [*keys, segments.SEGMENT], "left").withColumns(
        {
            f"_avg_{side}": F.col(f"_local_{side}")
            + F.col(f"_carry_{side}") * F.pow(F.lit(ratio), place + 1)
            for side in weighted
        }
    )
