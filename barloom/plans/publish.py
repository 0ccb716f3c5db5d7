"""Uniform output types, so results compare across engines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def publish(df: DataFrame, significant: tuple[str, ...] = (), **digits: int) -> DataFrame:
    """Dates and instants as text, integers as bigint, decimals and doubles rounded.

    ``digits`` overrides the six decimal places per column; ``significant`` columns keep nine
    significant digits instead, for values that span many magnitudes.
    """
    columns = []
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        kind = field.dataType
        if isinstance(kind, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType, T.BooleanType)):
            value = value.cast("bigint")
        elif field.name in significant:
            value = F.format_string("%.8e", value.cast("double")).cast("double")
        elif isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
            # Adding zero turns a negative zero into a plain one.
            value = F.round(value.cast("double"), digits.get(field.name, 6)) + F.lit(0.0)
        columns.append(value.alias(field.name))
    return df.select(*columns)
