"""Shared helpers: reading tables, Arrow batches of texts, tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import prepare, scratch_path

#: A word is a run of characters other than space and \t \n \x0B \f \r.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Rows in one Arrow batch: bounds what a Python worker holds when texts are long.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text_session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_session(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, since one text can be megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return prepare(spark)


class Stored:
    """A table below the shared folder, written once so that later branches do not repeat its work.

    ``drop()`` deletes it again; only rounds of a loop that a later round has replaced do so.
    """

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        # Spark deletes shuffle files once the driver has collected what refers to them; a driver that
        # holds little collects too seldom, and the files of all steps so far would pile up.
        self.spark._jvm.System.gc()
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    return Stored(df, name).df


def word_count(text: Column) -> Column:
    """Words of a text, 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def aside(df: DataFrame) -> list[Column]:
    """All columns under names of their position, so that no name of theirs can clash with a working column."""
    return [F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(df.columns)]


def restored(df: DataFrame, replaced=()) -> list[Column]:
    """The columns that were set aside under their own names, without those that new columns replace."""
    return [F.col(f"_in_{i}").alias(c) for i, c in enumerate(df.columns) if c.lower() not in replaced]


def unused(name: str, df: DataFrame) -> str:
    """A name that no column has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
