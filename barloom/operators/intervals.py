"""Date intervals against date intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bin widths in days, each level eight times the one before up to one bin for all dates.
WIDTHS = (16, 128, 1_024, 8_192, 65_536, 8_388_608)
_EPOCH = "1970-01-01"


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], *, start: str = "start", end: str = "end") -> DataFrame:
    """Pairs of rows with equal ``keys`` whose closed date intervals share a day: structs ``left`` and ``right``.

    An interval lives on the finest level whose bins are longer than itself, so that it touches two bins there
    at most, and is listed on all coarser levels too: at most twelve rows. A pair meets on the coarser of its two own
    levels, and of the bins it shares there counts the one in which the later of them starts, so every pair comes out once
    without a distinct. What is compared are intervals of about one length that lie near each other, not all
    of a key. Rows with NULL ends, or that end before they start, overlap nothing.
    """
    pairs = _listed(left, keys, start, end, "l").join(_listed(right, keys, start, end, "r"), [*keys, "_level", "_bin"])
    near = (F.col("_own_l") | F.col("_own_r")) & (F.col("_bin") == F.greatest("_first_l", "_first_r"))
    touch = (F.col("_row_l")[start] <= F.col("_row_r")[end]) & (F.col("_row_r")[start] <= F.col("_row_l")[end])
    return pairs.filter(near & touch).select(*keys, F.col("_row_l").alias("left"), F.col("_row_r").alias("right"))


def _listed(rows: DataFrame, keys: Sequence[str], start: str, end: str, side: str) -> DataFrame:
    """Every row under each level from its own up and each bin it touches there."""
    a, b = (F.datediff(F.col(c), F.lit(_EPOCH).cast("date")) for c in (start, end))
    own = F.lit(len(WIDTHS) - 1)
    for level in reversed(range(len(WIDTHS) - 1)):
        own = F.when(b - a < WIDTHS[level], level).otherwise(own)
    levels = F.array(
        *[
            F.struct(F.lit(k).alias("_level"), _bin(a, width).alias("_first"), _bin(b, width).alias("_last"))
            for k, width in enumerate(WIDTHS)
        ]
    )
    sound = rows.filter(F.col(start) <= F.col(end))
    row = F.struct(*[F.col(c) for c in rows.columns if c not in keys])
    named = sound.select(*keys, row.alias(f"_row_{side}"), own.alias("_own"), F.explode(levels).alias("_at"))
    listed = named.filter(F.col("_at._level") >= F.col("_own"))
    return listed.select(
        *keys,
        f"_row_{side}",
        F.col("_at._level").alias("_level"),
        (F.col("_at._level") == F.col("_own")).alias(f"_own_{side}"),
        F.col("_at._first").alias(f"_first_{side}"),
        F.explode(F.sequence("_at._first", "_at._last")).alias("_bin"),
    )


def _bin(day: Column, width: int) -> Column:
    return F.floor(day / width).cast("long")
