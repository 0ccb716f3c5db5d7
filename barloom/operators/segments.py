"""Windows over series of any length.

Series that passed the calendar cover check hold one row per session, and a calendar at most one
session per date: 366 rows a year bound every per-series window partition. Where even that is
too much for a task, the session setting ``barloom.segment.rows`` makes the same operators cut
each series into segments of that many consecutive positions (``size``):

* bounded frames (means, channels, lags) get the rows they need from the segment before as
  halo copies, so no task holds more than ``size + halo`` rows of a series;
* unbounded running values (peak, latch, product, sum) are computed inside a segment and
  completed with a carry from the segment totals, of which there are ``rows / size``.

Both layouts give the same result; the tests compare them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SEGMENT = "_segment"
LAYOUT = "barloom.segment.rows"

_COMBINE = {
    "max": F.max,
    "sum": F.sum,
    "product": F.product,
    "last": lambda value: F.last(value, ignorenulls=True),
}


def layout_for(sessions: DataFrame) -> int | None:
    """Segment size the session asks for, or None for whole series in a window. Reads a setting, runs no job."""
    rows = sessions.sparkSession.conf.get(LAYOUT, None)
    return int(rows) if rows else None


def cut(df: DataFrame, position: str, size: int | None) -> DataFrame:
    """Label each row with the segment its position falls into."""
    if size is None:
        return df
    return df.withColumn(SEGMENT, F.floor(F.col(position) / size).cast("long"))


def cut_with_halo(df: DataFrame, position: str, halo: int, size: int | None) -> DataFrame:
    """Like :func:`cut`, and copy the last ``halo`` positions of a segment into the next ones."""
    if size is None:
        return df
    first = F.floor(F.col(position) / size).cast("long")
    last = F.floor((F.col(position) + halo) / size).cast("long")
    return df.withColumn(SEGMENT, F.explode(F.sequence(first, last)))


def drop_halo(df: DataFrame, position: str, size: int | None) -> DataFrame:
    """Keep each row in its own segment only, and drop the segment label."""
    if size is None:
        return df
    return df.filter(F.floor(F.col(position) / size) == F.col(SEGMENT)).drop(SEGMENT)


def series_window(keys: Sequence[str], position: str, size: int | None) -> WindowSpec:
    parts = list(keys) if size is None else [*keys, SEGMENT]
    return Window.partitionBy(*parts).orderBy(position)


def running(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    specs: Mapping[str, tuple[str, Column]],
    size: int | None,
    *,
    exclusive: bool = False,
) -> DataFrame:
    """Add unbounded running values per series.

    ``specs`` maps an output name to (kind, value) with kind one of max, sum, product, last.
    ``exclusive`` stops each frame at the row before.
    """
    frame = (Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    if size is None:
        rows = series_window(keys, position, None).rowsBetween(*frame)
        return df.withColumns(
            {name: _COMBINE[kind](value).over(rows) for name, (kind, value) in specs.items()}
        )
    return running_in_parts(cut(df, position, size), keys, SEGMENT, position, specs, frame).drop(
        SEGMENT
    )


def running_in_parts(
    df: DataFrame,
    keys: Sequence[str],
    part: str,
    order: str,
    specs: Mapping[str, tuple[str, Column]],
    frame=(Window.unboundedPreceding, Window.currentRow),
) -> DataFrame:
    """Running values over rows already labelled with consecutive parts of bounded size."""
    rows = Window.partitionBy(*keys, part).orderBy(order).rowsBetween(*frame)
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    inputs = df.select("*", *[v.alias(f"_in_{name}") for name, (_, v) in specs.items()])
    totals = inputs.groupBy(*keys, part).agg(
        *[_total(kind, f"_in_{name}", order).alias(f"_total_{name}")
          for name, (kind, _) in specs.items()]
    )
    carries = totals.select(
        *keys,
        part,
        *[_COMBINE[kind](F.col(f"_total_{name}")).over(before).alias(f"_carry_{name}")
          for name, (kind, _) in specs.items()],
    )
    local = inputs.select(
        *df.columns,
        *[_COMBINE[kind](F.col(f"_in_{name}")).over(rows).alias(f"_local_{name}")
          for name, (kind, _) in specs.items()],
    )
    return local.join(carries, [*keys, part], "left").select(
        *[c for c in df.columns if c not in specs],
        *[_join_parts(kind, F.col(f"_carry_{name}"), F.col(f"_local_{name}")).alias(name)
          for name, (kind, _) in specs.items()],
    )


def any_in_series(
    df: DataFrame, keys: Sequence[str], condition: Column, name: str, size: int | None
) -> DataFrame:
    """Flag every row of a series in which ``condition`` holds somewhere."""
    if size is None:
        return df.withColumn(
            name, F.coalesce(F.max(condition).over(Window.partitionBy(*keys)), F.lit(False))
        )
    hit = df.filter(condition).select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(hit, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def positions(
    df: DataFrame, keys: Sequence[str], day: str, *, name: str = "position", days: int = 4096
) -> DataFrame:
    """Number the rows of each series from zero in date order, where no calendar does.

    Dates are cut into spans of ``days`` days, rows are numbered inside a span and shifted by
    the counts of the spans before. With one row per date a span never exceeds ``days`` rows.
    """
    span = F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / days).cast("long")
    numbered = running_in_parts(
        df.withColumn("_span", span), keys, "_span", day, {name: ("sum", F.lit(1).cast("long"))}
    )
    return numbered.withColumn(name, F.col(name) - 1).drop("_span")


def _total(kind: str, column: str, order: str) -> Column:
    value = F.col(column)
    if kind == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col(order)))
    return _COMBINE[kind](value)


def _join_parts(kind: str, carry: Column, local: Column) -> Column:
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "last":
        return F.coalesce(local, carry)
    if kind == "sum":
        return F.coalesce(carry + local, carry, local)
    return F.coalesce(carry * local, carry, local)
