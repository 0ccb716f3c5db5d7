"""Sets of sessions as bitmaps over calendar positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of one bitmap and bytes that hold them, as Spark's bitmap functions define them.
BUCKET_BITS, BUCKET_BYTES = 32_768, 4_096


def bitmaps(rows: DataFrame, keys: Sequence[str], members: dict[str, Column], *, position: str = "no") -> DataFrame:
    """(keys, bucket, one bitmap per member): the positions at which the member's condition holds.

    Positions count from zero; a calendar of up to 32,768 sessions is one bucket. Repeated rows set a bit once, so
    duplicates cost nothing, and the bitmaps combine before the shuffle. NULL positions belong to no set.
    """
    place = F.col(position) + 1
    bits = F.bitmap_bit_position(place)
    return (
        rows.filter(F.col(position).isNotNull())
        .groupBy(*keys, F.bitmap_bucket_number(place).alias("bucket"))
        .agg(*[F.bitmap_construct_agg(F.when(holds, bits)).alias(name) for name, holds in members.items()])
    )


def union(sets: DataFrame, keys: Sequence[str], name: str = "bits") -> DataFrame:
    """Positions that any set of a group has, per bucket."""
    return sets.groupBy(*keys, "bucket").agg(F.bitmap_or_agg(name).alias(name))


def intersection(sets: DataFrame, keys: Sequence[str], members: DataFrame, name: str = "bits") -> DataFrame:
    """Positions that all sets of a group have, per bucket.

    ``members`` has the keys and ``n_members``: a bucket that one of them lacks holds nothing in common.
    """
    common = sets.groupBy(*keys, "bucket").agg(F.bitmap_and_agg(name).alias(name), F.count(F.lit(1)).alias("_n"))
    joined = common.join(members, list(keys)) if keys else common.crossJoin(members)
    return joined.filter(F.col("_n") == F.col("n_members")).select(*keys, "bucket", name)


def sizes(sets: DataFrame, keys: Sequence[str], name: str = "bits") -> DataFrame:
    """(keys, n): how many positions each set has."""
    return sets.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count(name)), F.lit(0)).alias("n"))


def packed(sets: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per key: a map from bucket to bitmap for every name. A calendar has a bucket per 32,768 sessions."""
    held = [F.map_from_entries(F.collect_list(F.struct("bucket", n))).alias(n) for n in names]
    return sets.groupBy(*keys).agg(*held)


def bits_between(held: Column, low: Column, high: Column) -> Column:
    """An array of "0" and "1", one per position from ``low`` to ``high``; empty if there is none."""
    first = F.floor(low / BUCKET_BITS)
    empty = F.repeat(F.lit("00"), F.lit(BUCKET_BYTES))
    buckets = F.transform(
        F.sequence(first, F.floor(high / BUCKET_BITS)),
        lambda k: F.coalesce(F.hex(F.try_element_at(held, k + 1)), empty),
    )
    byte = F.floor(low / 8)
    start = 2 * (byte - first * BUCKET_BYTES) + 1
    digits = F.substring(F.array_join(buckets, ""), start.cast("int"), (2 * (F.floor(high / 8) - byte + 1)).cast("int"))
    # A byte holds its lowest position in its lowest bit: low digit first, each digit from its lowest bit up.
    text = F.translate(F.regexp_replace(digits, "(.)(.)", "$2$1"), "0123456789ABCDEF", "ghijklmnopqrstuv")
    for value in range(16):
        text = F.replace(text, F.lit(chr(ord("g") + value)), F.lit(f"{value:04b}"[::-1]))
    text = F.substring(text, (low % 8 + 1).cast("int"), (high - low + 1).cast("int"))
    return F.when(low <= high, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def runs(states: Column, wanted: str, low: Column) -> Column:
    """Array of structs (a, b, n): maximal runs of ``wanted`` in an array of states that begins at position ``low``."""
    def of(held):
        places = F.when(F.size(held) > 0, F.sequence(F.lit(0), F.size(held) - 1)).otherwise(F.array().cast("array<int>"))

        def edge(k, other):
            return (F.get(held, k) == wanted) & ~F.get(held, other).eqNullSafe(F.lit(wanted))

        return F.zip_with(
            F.filter(places, lambda k: edge(k, k - 1)),
            F.filter(places, lambda k: edge(k, k + 1)),
            lambda a, b: F.struct((low + a).alias("a"), (low + b).alias("b"), (b - a + 1).cast("long").alias("n")),
        )

    # The states are evaluated once, not once per place.
    return F.transform(F.array(states), of)[0]
