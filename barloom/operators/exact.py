"""Digit-exact RSI and backtest: 28-digit decimal arithmetic with banker's rounding.

Decimal division with that rounding has no Catalyst counterpart, so rows are folded in Python. Series
are hash-partitioned by key and sorted inside their partition; one pass carries the state of
the current series from batch to batch, so memory is one batch and a series may be of any length.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_EVEN, Context, Decimal, localcontext

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from barloom.functions.features import require_positive
from barloom.operators.backtest import Costs


def exact_wilder_rsi(
    df: DataFrame, keys: Sequence[str], position: str, column: str, period: int
) -> DataFrame:
    """Wilder RSI as decimal text, one row per input row."""
    require_positive("period", period)

    def step(state, row):
        """State: rows so far, last value, average gain and loss."""
        i, last, up, down = state or (0, row[column], Decimal(0), Decimal(0))
        move = row[column] - last
        gain, loss = max(move, Decimal(0)), max(-move, Decimal(0))
        if i <= period:
            up, down = up + gain, down + loss
            if i == period:
                up, down = up / period, down / period
        else:
            up, down = (up * (period - 1) + gain) / period, (down * (period - 1) + loss) / period
        if i < period:
            rsi = None
        elif down == 0:
            rsi = "50" if up == 0 else "100"
        else:
            rsi = str(Decimal(0) if up == 0 else 100 * up / (up + down))
        return (i + 1, row[column], up, down), {"rsi": rsi}

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*keys, position))
    return _fold(df.select(*keys, position, column), keys, position, step, (*keys, position), f"{schema}, rsi string")


def exact_backtest(
    bars: DataFrame, targets: DataFrame, costs: Costs, *, position: str = "session_no"
) -> DataFrame:
    """Equity points of the long/flat rule as decimal text."""
    initial = str(costs.initial_cash)
    fee, slip = str(costs.commission_bps), str(costs.slippage_bps)

    def step(state, row):
        """State: cash, quantity held, target weight."""
        one, c, s = Decimal(1), Decimal(fee) / 10_000, Decimal(slip) / 10_000
        cash, held, weight = state or (Decimal(initial), Decimal(0), 0)
        wanted = row["_weight"]
        if wanted is not None and wanted != weight:
            weight = wanted
            if weight:
                held, cash = cash / (one + c) / (row["open"] * (one + s)), Decimal(0)
            else:
                proceeds = held * (row["open"] * (one - s))
                held, cash = Decimal(0), proceeds - proceeds * c
        equity = cash + held * row["close"]
        out = {"cash": str(cash), "quantity": str(held), "equity": str(equity), "target_weight": weight}
        return (cash, held, weight), out

    wanted = targets.select(
        "asset_id", F.col("effective_at").alias("session_open_at"), F.col("weight").alias("_weight")
    )
    rows = bars.join(wanted, ["asset_id", "session_open_at"], "left").select(
        "asset_id", "session", position, "open", "close", "_weight"
    )
    return _fold(
        rows,
        ["asset_id"],
        position,
        step,
        ("asset_id", "session"),
        "asset_id string, session date, cash string, quantity string, equity string, target_weight int",
    )


def _fold(df: DataFrame, keys: Sequence[str], position: str, step, kept: Sequence[str], schema: str) -> DataFrame:
    """Run ``step(state, row)`` over each series in order; its values follow the ``kept`` columns."""

    def run(batches):
        key, state = None, None
        for batch in batches:
            rows = []
            with localcontext(Context(prec=28, rounding=ROUND_HALF_EVEN)):
                for row in batch.to_pylist():
                    own = tuple(row[k] for k in keys)
                    if own != key:
                        key, state = own, None
                    state, values = step(state, row)
                    rows.append({c: row[c] for c in kept} | values)
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    target = to_arrow_schema(_parse_datatype_string(schema))
    ordered = df.repartition(*keys).sortWithinPartitions(*keys, position)
    return ordered.mapInArrow(run, schema)
