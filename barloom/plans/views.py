"""Market views over the driver's tables: daily bars, calendars, further sources."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.calendar import number_sessions, period_end
from barloom.operators.segments import running_in_parts
from barloom.schemas import PRICE, VOLUME
from barloom.session import path_exists, prepare, write_scratch

CALENDAR = "LINE"
EPOCH = "1995-01-01"
MICRO = 1_000_000
PRICE_SPAN = Decimal(10**18)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bars_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per return flag."""
    return bars_of_lines(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"))


def bars_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier: the number of series grows with the data."""
    return bars_of_lines(table(spark, sf_dir, "lineitem"), F.col("l_suppkey"))


def bars_of_lines(lines: DataFrame, asset: Column) -> DataFrame:
    """Daily bars out of order lines.

    Lines are ordered by (order, price) within a day. Order key and unscaled price are packed into
    one decimal(38,0), so first and last price are a plain minimum and maximum: all buffers are
    of fixed size, aggregation hashes and combines before the shuffle, and only
    assets x days rows are exchanged however many lines there are. Every order key and every
    decimal(18,6) price fits, unrounded.
    """
    price = F.col("l_extendedprice").cast(PRICE)
    unscaled = (price * MICRO).cast("decimal(18,0)")
    packed = F.col("l_orderkey").cast("decimal(20,0)") * F.lit(PRICE_SPAN) + unscaled
    grouped = (
        lines.select(
            asset.alias("asset_id"),
            F.col("l_shipdate").cast("date").alias("session"),
            packed.cast("decimal(38,0)").alias("tick"),
            price.alias("price"),
            (F.col("l_quantity") * MICRO + 0.5).cast("bigint").alias("volume"),
        )
        .groupBy("asset_id", "session")
        .agg(
            F.min("tick").alias("first"),
            F.max("tick").alias("last"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("line_count"),
        )
    )
    return with_times(
        grouped.select(
            F.col("asset_id").cast("string").alias("asset_id"),
            F.lit("lines").alias("source"),
            "session",
            _price(F.col("first") % F.lit(PRICE_SPAN)).alias("open"),
            "high",
            "low",
            _price(F.col("last") % F.lit(PRICE_SPAN)).alias("close"),
            (F.col("volume").cast("decimal(24,0)") / MICRO).cast("decimal(24,6)").alias("volume"),
            "line_count",
        )
    )


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived table, written once per application and source below the shared folder.

    Daily bars are the normalized input of every research query; like any ingest product they
    are stored once and read many times.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED or not path_exists(spark, _STORED[key]):
        _STORED[key] = write_scratch(build(), name)
    return prepare(spark).read.parquet(_STORED[key])


def stored_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Folder of a table that :func:`stored` has written."""
    return _STORED[(spark.sparkContext.applicationId, sf_dir, name)]


def bars_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All daily bars, stored."""
    return stored(spark, sf_dir, "bars-all", lambda: bars_all(spark, sf_dir))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All daily bars with the calendar of their asset, stored."""

    def build():
        bars = bars_table(spark, sf_dir)
        return bars.withColumn("calendar_id", F.concat(F.lit(f"{CALENDAR}-"), "asset_id"))

    return stored(spark, sf_dir, "bars-daily", build)


def market(spark: SparkSession, sf_dir: str, *, after: str | None = None):
    """Daily bars and the numbered calendar of every asset: the days on which it trades.

    ``after`` adds one session to each calendar: on the next day (``1d``), or on the first day of the
    next week (``1w``) or month (``1mo``), which leaves the last period of the bars whole.
    """
    bars = bars_daily(spark, sf_dir)

    def build():
        return number_sessions(calendar_of(bars, after=after))

    return bars, stored(spark, sf_dir, f"sessions-{after}", build)


def common_days(bars: DataFrame) -> DataFrame:
    """The calendar of the days on which every asset trades."""
    assets = bars.agg(F.count_distinct("asset_id")).scalar()
    days = bars.groupBy("session").agg(F.count_distinct("asset_id").alias("n"))
    return with_times(days.filter(F.col("n") == assets).select("session")).select(
        F.lit(CALENDAR).alias("calendar_id"), "session", "session_open_at", "session_close_at"
    )


def with_times(rows: DataFrame) -> DataFrame:
    """Open 14:30, close 21:00, available 21:05 UTC of the session date."""
    midnight = F.col("session").cast("timestamp")
    return rows.withColumns(
        {
            "session_open_at": midnight + F.expr("interval 870 minutes"),
            "session_close_at": midnight + F.expr("interval 1260 minutes"),
            "available_at": midnight + F.expr("interval 1265 minutes"),
        }
    )


def calendar_of(bars: DataFrame, *, after: str | None = None) -> DataFrame:
    """The observed sessions of every calendar, optionally with one more after its end."""
    days = bars.select("calendar_id", "session").distinct()
    if after:
        last = F.max("session")
        following = F.date_add(last if after == "1d" else period_end(last, after), 1)
        days = days.unionByName(days.groupBy("calendar_id").agg(following.alias("session")))
    return with_times(days).select("calendar_id", "session", "session_open_at", "session_close_at")


def all_days(bars: DataFrame, *, weekdays_only: bool = False) -> DataFrame:
    """Every date (or weekday) between the first and the last bar."""
    span = bars.agg(F.min("session").alias("a"), F.max("session").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("session"))
    if weekdays_only:
        days = days.filter(F.weekday("session") < 5)
    return with_times(days).select(
        F.lit(CALENDAR).alias("calendar_id"), "session", "session_open_at", "session_close_at"
    )


def day_number(day: str = "session") -> Column:
    return F.datediff(F.col(day), F.lit(EPOCH).cast("date"))


def _price(unscaled: Column) -> Column:
    return (unscaled.cast("decimal(18,0)") / MICRO).cast(PRICE)


# Quality inputs: two sources per asset with planted defects, keyed by the day number so that
# every engine plants the same ones.
PRIMARY, SECONDARY = "alpha", "beta"
CURRENT = "alpha-2"


#: A finite number of 64 digits, beyond every decimal type.
LONG_PRICE = "1234567890" * 6 + "123.5"


def quality_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text bars of two sources, with broken and very long cells, repeated and late rows."""
    return stored(spark, sf_dir, "quality-bars", lambda: _quality_bars(spark, sf_dir))


def _quality_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = bars_table(spark, sf_dir).withColumn("d", day_number())
    d = F.col("d")
    copies = F.when(d % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = {f: F.col(f).cast("string") for f in ("open", "high", "low", "close", "volume")}
    alpha = bars.select(
        "asset_id",
        F.lit(PRIMARY).alias("source_id"),
        "session",
        "d",
        F.explode(copies).alias("copy"),
        F.when(d % 211 == 0, "NaN").otherwise(text["open"]).alias("open"),
        F.when(d % 227 == 0, (F.col("low") - 1).cast(PRICE).cast("string"))
        .when(d % 239 == 0, "1234567890123.5")
        .when(d % 241 == 0, LONG_PRICE)
        .otherwise(text["high"])
        .alias("high"),
        F.when(d % 223 == 0, "-1").when(d % 251 == 0, "0.0000001").otherwise(text["low"]).alias("low"),
        text["close"].alias("close"),
        F.when(d % 229 == 0, "-5")
        .when(d % 233 == 0, "n/a")
        .when(d % 257 == 0, LONG_PRICE)
        .otherwise(text["volume"])
        .alias("volume"),
    )
    scaled = F.col("close") * (10_000 + (d % 13) * 6) / 10_000
    beta = bars.filter(d % 41 != 0).select(
        "asset_id",
        F.lit(SECONDARY).alias("source_id"),
        "session",
        "d",
        F.lit(0).alias("copy"),
        text["open"].alias("open"),
        text["high"].alias("high"),
        text["low"].alias("low"),
        scaled.cast(PRICE).cast("string").alias("close"),
        text["volume"].alias("volume"),
    )
    arrival = F.date_add("session", F.when(d % 103 == 0, 3).otherwise(0))
    order = F.concat_ws(
        "|", F.date_format(arrival, "yyyy-MM-dd"), F.date_format("session", "yyyy-MM-dd"), "copy"
    )
    rows = alpha.unionByName(beta).withColumns({"_arrival": arrival, "_order": order})
    return _arrival_numbers(rows).drop("d", "copy")


def _arrival_numbers(rows: DataFrame) -> DataFrame:
    """Dense arrival numbers per source; a span of arrival dates bounds each window."""
    span = F.floor(F.datediff("_arrival", F.lit(EPOCH).cast("date")) / 1024).cast("long")
    return (
        running_in_parts(
            rows.withColumn("_span", span),
            ["asset_id", "source_id"],
            "_span",
            "_order",
            {"row_seq": ("sum", F.lit(1).cast("long"))},
        )
        .withColumn("row_seq", F.col("row_seq") - 1)
        .drop("_span", "_order", "_arrival")
    )


def quality_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source dimension; one asset's second source has an unknown schema."""
    return stored(spark, sf_dir, "quality-sources", lambda: _quality_sources(spark, sf_dir))


def _quality_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = (F.col("asset_id") == "N") & (F.col("source_id") == SECONDARY)
    return (
        bars_table(spark, sf_dir)
        .select("asset_id")
        .distinct()
        .select("asset_id", F.explode(F.array(F.lit(PRIMARY), F.lit(SECONDARY))).alias("source_id"))
        .select(
            "asset_id",
            "source_id",
            F.upper("source_id").alias("provider"),
            F.when(old, "normalized-bar-v0").otherwise("normalized-bar-v1").alias("schema_version"),
            F.lit("daily").alias("normalizer_id"),
            F.lit("1").alias("normalizer_version"),
        )
    )


def quality_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requested ranges per asset, one of them for adjusted data, and a weekend without any session."""
    return stored(spark, sf_dir, "quality-requests", lambda: _quality_requests(spark, sf_dir))


def _quality_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asset = F.col("asset_id")

    def request(start: str, end: str, mode: Column) -> Column:
        return F.struct(
            F.lit(start).cast("date").alias("requested_start"),
            F.lit(end).cast("date").alias("requested_end"),
            mode.alias("adjustment_mode"),
        )

    asked = F.array(
        request("1996-02-03", "2000-11-30", F.when(asset == "R", "split_adjusted").otherwise("raw")),
        request("1997-06-10", "1997-08-15", F.lit("raw")),
        F.when(asset == "A", request("1996-02-03", "1996-02-04", F.lit("raw"))),
    )
    assets = bars_table(spark, sf_dir).select("asset_id").distinct()
    return assets.select("asset_id", F.inline(F.array_compact(asked)))


def weekdays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every weekday between the first and the last bar, as the expected calendar."""
    return stored(
        spark,
        sf_dir,
        "weekdays",
        lambda: number_sessions(all_days(bars_table(spark, sf_dir), weekdays_only=True)),
    )


def revisions(spark: SparkSession, sf_dir: str):
    """Two observations of the first source: (bars of both, pairs)."""
    return (
        stored(spark, sf_dir, "revision-bars", lambda: _revisions(spark, sf_dir)[0]),
        stored(spark, sf_dir, "revision-pairs", lambda: _revisions(spark, sf_dir)[1]),
    )


def _revisions(spark: SparkSession, sf_dir: str):
    bars = bars_table(spark, sf_dir).withColumn("d", day_number())
    cells = [F.col(f).cast("string").alias(f) for f in ("open", "high", "low", "close")]
    before = bars.select(
        "asset_id",
        F.lit(PRIMARY).alias("source_id"),
        "session",
        *cells,
        F.col("volume").cast("string").alias("volume"),
    )
    changed = F.when(F.col("d") % 53 == 0, F.col("volume") + 1).otherwise(F.col("volume"))
    after = bars.filter(F.col("d") % 307 != 0).select(
        "asset_id",
        F.lit(CURRENT).alias("source_id"),
        "session",
        *cells,
        changed.cast(VOLUME).cast("string").alias("volume"),
    )
    pairs = (
        bars.select("asset_id")
        .distinct()
        .select(
            "asset_id", F.lit(PRIMARY).alias("previous_id"), F.lit(CURRENT).alias("current_id")
        )
    )
    return before.unionByName(after), pairs
