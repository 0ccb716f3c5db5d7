"""Registered queries on contracts, identities, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import credentials, digests
from barloom.functions.calendar import WEEK
from barloom.functions.identity import (
    canonical_decimal,
    canonical_json,
    series_fingerprint,
    session_set_hash,
    stable_id,
)
from barloom.operators import contracts
from barloom.operators import session_sets as bitmaps
from barloom.operators.alignment import align, cover
from barloom.operators.backtest import Costs, backtest
from barloom.plans import strategies, views
from barloom.plans.publish import publish
from barloom.session import materialize, scratch_path
from barloom.sources import captures, fixtures, providers, results
from barloom.streaming import bars as streams

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _numbered_days(bars: DataFrame) -> DataFrame:
    return bars.withColumn("d", views.day_number())


def _defective(bars: DataFrame) -> DataFrame:
    """Bars with planted contract breaks."""
    d = F.col("d")
    early = F.col("session_close_at") - F.expr("interval 1 minute")
    return _numbered_days(bars).withColumns(
        {
            "available_at": F.when(d % 59 == 0, early).otherwise(F.col("available_at")),
            "high": F.when(d % 61 == 0, F.col("low") - 1).otherwise(F.col("high")),
            "volume": F.when(d % 67 == 0, -F.col("volume")).otherwise(F.col("volume")),
            "low": F.when(d % 71 == 0, F.lit(0).cast("decimal(18,6)")).otherwise(F.col("low")),
        }
    ).drop("d")


@query
def con_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, broken = contracts.split(_defective(views.bars_table(spark, sf_dir)), contracts.bar_rules())
    return publish(
        broken.select("asset_id", "session", F.array_join("violations", ",").alias("violations"))
    )


@query
def con_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that close after local midnight, overlap the next one, or leave the range."""
    _, sessions = views.market(spark, sf_dir)
    d = F.col("d")
    hours = F.when(d % 71 == 0, 10).when(d % 73 == 0, 20).otherwise(0)
    shifted = _numbered_days(sessions).withColumn(
        "session_close_at",
        F.timestamp_add("HOUR", hours, F.col("session_close_at")),
    ).drop("d")
    calendars = sessions.select("calendar_id").distinct().select(
        "calendar_id",
        F.lit("America/New_York").alias("timezone"),
        F.lit("close_local_date").alias("label_policy"),
        F.lit("1995-02-01").cast("date").alias("requested_start"),
        F.lit("2001-12-31").cast("date").alias("requested_end"),
    )
    found = contracts.schedule_violations(shifted, calendars)
    return publish(
        found.select("calendar_id", "session", F.array_join("violations", ",").alias("violations"))
    )


@query
def con_causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that become available only after the next open make their signal late."""
    bars, sessions = views.market(spark, sf_dir)
    d = F.col("d")
    late = _numbered_days(bars).withColumn(
        "available_at",
        F.when(d % 97 == 0, F.col("session_close_at") + F.expr("interval 20 hours")).otherwise(
            F.col("available_at")
        ),
    ).drop("d")
    return publish(strategies.sma_targets(late, sessions, window=50).violations)


def _sma_targets(spark, sf_dir):
    bars, sessions = views.market(spark, sf_dir)
    return bars, sessions, strategies.sma_targets(bars, sessions, window=50).clean()


@query
def con_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, targets = _sma_targets(spark, sf_dir)
    d = F.col("d")
    planted = _numbered_days(targets).withColumns(
        {
            "weight": F.when(d % 83 == 0, 2).otherwise(F.col("weight")),
            "effective_at": F.when(d % 89 == 0, F.col("decision_at")).otherwise(
                F.col("effective_at")
            ),
        }
    )
    _, broken = contracts.split(planted.drop("d"), contracts.target_rules())
    return publish(
        broken.select("asset_id", "session", F.array_join("violations", ",").alias("violations"))
    )


@query
def con_engine_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, _, targets = _sma_targets(spark, sf_dir)
    d = F.col("d")
    off = F.col("effective_at") + F.expr("interval 1 minute")
    planted = _numbered_days(targets).withColumns(
        {
            "weight": F.when(d % 83 == 0, 2).otherwise(F.col("weight")),
            "effective_at": F.when(d % 89 == 0, off).otherwise(F.col("effective_at")),
            "_copies": F.when(d % 79 == 0, 2).otherwise(1),
        }
    )
    repeated = planted.select(
        "asset_id", "effective_at", "weight", F.explode(F.sequence(F.lit(1), "_copies"))
    )
    return publish(contracts.engine_input_violations(bars, repeated))


def _intervals(spark, sf_dir):
    """Runs of calendar days on which an asset trades, as eligible intervals."""
    bars = views.bars_table(spark, sf_dir)
    aligned = align(bars, views.all_days(bars))
    from pyspark.sql import Window

    order = Window.partitionBy("asset_id").orderBy("session_no")  # one row per day
    islands = (
        aligned.withColumn("_island", F.col("session_no") - F.row_number().over(order))
        .groupBy("asset_id", "_island")
        .agg(
            F.min("session").alias("start_session"),
            F.max("session").alias("end_session"),
            F.count(F.lit(1)).alias("session_count"),
        )
    )
    return bars, islands.select(
        F.col("asset_id").alias("release_id"),
        "start_session",
        "end_session",
        "session_count",
        F.concat_ws("-", F.lit("report"), "asset_id", F.date_format("start_session", "yyyyMMdd")).alias(
            "report_id"
        ),
    )


@query
def release_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calendar months of bars lie wholly inside one eligible interval."""
    bars, intervals = _intervals(spark, sf_dir)
    consumed = bars.groupBy(
        F.col("asset_id").alias("release_id"), F.trunc("session", "month").alias("_m")
    ).agg(F.min("session").alias("first_session"), F.max("session").alias("last_session"))
    return publish(contracts.supported_ranges(consumed.drop("_m"), intervals))


@query
def con_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals stretched over their successor, one repeated report, a tight schedule."""
    bars, intervals = _intervals(spark, sf_dir)
    n = F.datediff("start_session", F.lit(views.EPOCH).cast("date"))
    planted = intervals.withColumns(
        {
            "end_session": F.when(n % 5 == 0, F.date_add("end_session", 400)).otherwise(
                F.col("end_session")
            ),
            "report_id": F.when(n % 7 == 0, F.lit("report-same")).otherwise(F.col("report_id")),
        }
    )
    releases = bars.groupBy(F.col("asset_id").alias("release_id")).agg(
        F.min("session").alias("schedule_start"),
        F.lit("2001-06-30").cast("date").alias("schedule_end"),
        (F.count(F.lit(1)) - 1).alias("schedule_count"),
    )
    return publish(contracts.interval_violations(planted, releases))


@query
def session_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union and intersection of all assets' sessions, and per asset what it lacks of one and has beyond the other."""
    bars = views.bars_table(spark, sf_dir)
    placed = align(bars, views.all_days(bars)).withColumn("no", F.col("session_no"))
    sets = materialize(bitmaps.bitmaps(placed, ["asset_id"], {"bits": F.lit(True)}), "session-sets")
    own = bitmaps.sizes(sets, ["asset_id"])
    members = own.agg(F.count(F.lit(1)).alias("n_members"))
    every = bitmaps.sizes(bitmaps.union(sets, []), []).select(F.lit("*").alias("asset_id"), F.lit("union").alias("op"), "n")
    common = bitmaps.sizes(bitmaps.intersection(sets, [], members), [])
    common = common.select(F.lit("*").alias("asset_id"), F.lit("intersection").alias("op"), "n")
    # An asset's sessions are part of the union and hold the intersection, so differences are differences of sizes.
    ops = F.array(
        *[
            F.struct(F.lit(op).alias("op"), n.alias("n"))
            for op, n in (
                ("own", F.col("n")),
                ("missing", every.select("n").scalar() - F.col("n")),
                ("beyond", F.col("n") - common.select("n").scalar()),
            )
        ]
    )
    return publish(every.unionByName(common).unionByName(own.select("asset_id", F.inline(ops))))


@query
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, sessions = views.market(spark, sf_dir)
    return publish(series_fingerprint(cover(bars, sessions).bars, ["asset_id"], "session_no"))


@query
def session_set_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish(session_set_hash(views.market(spark, sf_dir)[1]))


@query
def bar_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of single bars, over scale-free decimals."""
    bars = views.bars_table(spark, sf_dir)
    payload = canonical_json(
        F.struct(
            F.col("asset_id").alias("asset"),
            canonical_decimal(F.col("close")).alias("close"),
            F.date_format("session", "yyyy-MM-dd").alias("session"),
            canonical_decimal(F.col("volume")).alias("volume"),
        )
    )
    return publish(bars.select("asset_id", "session", stable_id("bar", payload).alias("bar_id")))


@query
def canonical_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars_table(spark, sf_dir)
    return publish(
        bars.select(
            "asset_id",
            "session",
            canonical_decimal(F.col("close")).alias("close"),
            canonical_decimal(F.col("volume")).alias("volume"),
            canonical_decimal(F.col("open") - F.col("open")).alias("zero"),
        )
    )


def _request_json(events: DataFrame) -> DataFrame:
    """Request documents around the event properties; some carry credential-like keys, some cannot be read."""
    kind = F.col("event_type")
    extra = (
        F.when(kind == "click", F.lit('"apiKey":"x"'))
        .when(kind == "error", F.lit('"headers":[{"X-Auth-Token2":"x"}]'))
        .when(kind == "purchase", F.lit('"meta":{"client%5Fsecret":"x","monkey":"y"}'))
        .when(kind == "signup", F.lit('"keyword":"x","tokens":"y"'))
        .otherwise(F.lit('"ｐａｓｓｗｄ":"x"'))
    )
    body = F.regexp_replace("props", r"\}$", "")
    # Two kinds of text that cannot be read: cut off, and with something before the brace.
    cut, led = ((kind == "signup") & (F.col("event_id") % n == 0) for n in (97, 101))
    return events.select(
        "event_id",
        "event_type",
        F.concat(
            F.when(led, "x ").otherwise(""), body, F.lit(","), extra, F.when(cut, "").otherwise("}")
        ).alias("request"),
    )


@query
def credential_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _request_json(views.table(spark, sf_dir, "events"))
    return publish(credentials.screen_json(docs, "event_id", "request"))


@query
def credential_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _request_json(views.table(spark, sf_dir, "events"))
    hit = credentials.screen_json(docs, "event_id", "request").select("event_id").distinct()
    kept = docs.join(hit, "event_id", "left_anti")
    return publish(
        docs.groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("documents"))
        .join(kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept")), "event_type", "left")
        .na.fill(0, ["kept"])
    )


def _raw_rows(spark, sf_dir) -> DataFrame:
    """Provider text rows: three date spellings, and defects in one asset."""
    bars = _numbered_days(views.bars_table(spark, sf_dir))
    d, bad = F.col("d"), F.col("asset_id") == "N"
    written = (
        F.when(bad & (d % 500 == 0), "not-a-date")
        .when(d % 3 == 0, F.date_format("session", "yyyy-MM-dd"))
        .when(d % 3 == 1, F.date_format("session", "yyyy-MM-dd'T'23:30:00'-05:00'"))
        .otherwise(F.date_format("session", "yyyy-MM-dd'T'00:00:00'Z'"))
    )
    return bars.select(
        "asset_id",
        written.alias("date"),
        *[F.col(f).cast("string").alias(f) for f in ("open", "high", "low")],
        F.when(bad & (d % 503 == 0), "inf").otherwise(F.col("close").cast("string")).alias("close"),
        F.when(bad & (d % 509 == 0), "NaN").otherwise(F.col("volume").cast("string")).alias("volume"),
    )


@query
def normalize_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the range are dropped; the asset with bad cells is withheld."""
    raw = _raw_rows(spark, sf_dir)
    calendar = views.all_days(views.bars_table(spark, sf_dir))
    out = providers.normalize_bars(
        raw, calendar, providers.LOWER_CASE, start="1996-01-01", end="1999-12-31"
    )
    return publish(out.bars)


@query
def normalize_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside the range are errors, as are weekend rows and bad cells."""
    raw = _raw_rows(spark, sf_dir).withColumnsRenamed(
        {f: f.title() for f in ("date", "open", "high", "low", "close", "volume")}
    )
    out = providers.normalize_bars(
        raw,
        views.weekdays(spark, sf_dir),
        providers.TITLE_CASE,
        start="1995-01-02",
        end="2001-06-30",
    )
    return publish(out.violations)


def _captures(spark, sf_dir) -> DataFrame:
    """One capture per asset and year, observed twice; one request carries a secret."""
    raw = captures.capture_text(
        views.bars_table(spark, sf_dir).select("asset_id", "session", "open", "close", "volume")
    )
    fields = ("session", "open", "close", "volume")
    grouped = raw.groupBy("asset_id", F.substring("session", 1, 4).alias("year")).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("_rows")
    )  # one provider response: at most 366 days
    records = F.transform(
        "_rows", lambda r: F.create_map(*[x for f in fields for x in (F.lit(f), r[f])])
    )
    twice = grouped.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    secret = (F.col("asset_id") == "R") & (F.col("year") == "1999") & (F.col("n") == 2)
    return twice.select(
        F.concat_ws("-", "asset_id", "year", F.col("n").cast("string")).alias("capture_id"),
        F.lit("lines").alias("provider"),
        F.lit("daily").alias("endpoint"),
        F.when(
            secret,
            F.create_map(F.lit("symbol"), F.col("asset_id"), F.lit("api_key"), F.lit("x")),
        )
        .otherwise(F.create_map(F.lit("symbol"), F.col("asset_id"), F.lit("year"), F.col("year")))
        .alias("request"),
        records.alias("records"),
        F.timestamp_add("DAY", F.col("n"), F.lit("2002-01-01").cast("timestamp")).alias("captured_at"),
        F.lit("raw-capture-v1").alias("schema_version"),
        F.lit("1").alias("adapter_version"),
        F.lit("research").alias("license_profile"),
        F.array(F.lit("research")).alias("permitted_uses"),
        F.lit(False).alias("redistribution_allowed"),
    )


def _stored_captures(spark, sf_dir) -> str:
    path = scratch_path(spark, "captures")
    captures.write_captures(_captures(spark, sf_dir), path)
    return path


@query
def captures_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write captures, read them back, compare hashes; contents are stored once."""
    path = _stored_captures(spark, sf_dir)
    verdicts = captures.verify_captures(spark, path)
    contents = spark.read.parquet(f"{path}/{captures.CONTENTS}")
    kept = contents.agg(F.count(F.lit(1))).scalar()
    return publish(verdicts.withColumn("stored_contents", kept))


@query
def capture_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = captures.read_records(spark, _stored_captures(spark, sf_dir))
    return publish(
        rows.groupBy(F.col("request")["symbol"].alias("asset_id")).agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("record")["close"].cast("decimal(18,6)")).alias("total_close"),
            F.max("record_index").alias("last_index"),
        )
    )


@query
def fixture_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, sessions = views.market(spark, sf_dir)
    path = scratch_path(spark, "fixtures")
    fixtures.write_fixture(bars, sessions, "lines-daily-v1", path)
    fixture = fixtures.read_fixture(spark, "lines-daily-v1", path)
    broken = fixture.violations.groupBy("asset_id").agg(F.count(F.lit(1)).alias("violations"))
    return publish(
        fixture.manifest.select("fixture_id", "asset_id", "row_count", "content_hash")
        .join(broken, "asset_id", "left")
        .na.fill(0, ["violations"])
    )


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["asset_id", "session", "open", "high", "low", "close", "volume"]
    path = scratch_path(spark, "csv")
    bars = views.bars_table(spark, sf_dir).select(columns)
    bars.write.csv(path, header=True)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    return publish(fixtures.read_bars_csv(spark, path, schema))


@query
def calendar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset's calendar through JSON lines and back."""
    _, sessions = views.market(spark, sf_dir)
    path = scratch_path(spark, "calendar-json")
    sessions.select("calendar_id", "session", "session_open_at", "session_close_at").write.json(path)
    return publish(fixtures.read_calendar_json(spark, path))


@query
def run_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verify a stored costed run and a copy of it with one trade and one total changed; name the changed rows."""
    bars, sessions, targets = _sma_targets(spark, sf_dir)
    covered = cover(bars, sessions)
    run = backtest(
        covered.bars, targets, (Costs("stored", 10_000, 10, 5),), size=covered.size
    )
    path, copy = scratch_path(spark, "runs"), scratch_path(spark, "runs-copy")
    results.write_run(run, path, engine="closed-form-1", dataset="lines-daily-v1")
    _changed_copy(spark, path, copy)
    none = F.lit(None).cast("date")
    parts = [
        results.verify_run(spark, at).select(F.lit(name).alias("part"), "asset_id", "run_id", none.alias("session"), "row_count", "verdict")
        for name, at in (("run", path), ("copy", copy))
    ]
    changed = results.changed_rows(spark, copy).unionByName(results.changed_rows(spark, path))
    rows = changed.select(
        F.col("table_name").alias("part"), "asset_id", "run_id", "session", F.lit(1).cast("long").alias("row_count"), F.col("change").alias("verdict")
    )
    return publish(parts[0].unionByName(parts[1]).unionByName(rows))


def _changed_copy(spark, path, copy) -> None:
    """A copy of a stored run with the commission of A's first trade and the number of N's trades raised by one."""
    trades = spark.read.parquet(f"{path}/trades")
    first = trades.filter(F.col("asset_id") == "A").agg(F.min("session")).scalar()
    planted = {
        "trades": ("commission", (F.col("asset_id") == "A") & (F.col("session") == first)),
        "totals": ("trade_count", F.col("asset_id") == "N"),
    }
    for name in ("points", "trades", "totals", "digests", "manifest", *[f"nodes/{level}" for level in digests.STORED]):
        rows = spark.read.parquet(f"{path}/{name}")
        if name in planted:
            column, where = planted[name]
            rows = rows.withColumn(column, F.when(where, F.col(column) + 1).otherwise(F.col(column)))
        rows.write.parquet(f"{copy}/{name}")


def _streamed_weeks(spark, source, sessions) -> DataFrame:
    path, checkpoint = scratch_path(spark, "weeks"), scratch_path(spark, "weeks-state")
    streams.append_to(streams.period_stream(source, sessions, WEEK), path, checkpoint).awaitTermination()
    return spark.read.parquet(path)


@query
def stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars from a stream of the stored daily bars."""
    bars, sessions = views.market(spark, sf_dir)
    source = spark.readStream.schema(bars.schema).parquet(views.stored_path(spark, sf_dir, "bars-daily"))
    weeks = _streamed_weeks(spark, source, sessions).filter(F.col("kind") == streams.PERIOD)
    return publish(
        weeks.select(
            "asset_id", "period_start", "open", "high", "low", "close", "volume", "available_at",
            "constituent_count", "expected_count", "completeness",
        )
    )


@query
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which some bars become available weeks after their session."""
    bars, sessions = views.market(spark, sf_dir)

    def build():
        planted = F.when(F.col("d") % 97 == 0, F.col("available_at") + F.expr("interval 20 days"))
        return _numbered_days(bars).withColumn("available_at", F.coalesce(planted, F.col("available_at"))).drop("d")

    late = views.stored(spark, sf_dir, "bars-late", build)
    source = spark.readStream.schema(late.schema).parquet(views.stored_path(spark, sf_dir, "bars-late"))
    weeks = _streamed_weeks(spark, source, sessions)
    return publish(
        weeks.select(
            "asset_id", "period_start", "kind", "row_count", "close", "volume", "cutoff_at", "expected_count", "completeness"
        )
    )


@query
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of bars split into clean and quarantined rows."""
    bars = views.stored(
        spark, sf_dir, "bars-defective", lambda: _defective(views.bars_table(spark, sf_dir))
    )
    source = spark.readStream.schema(bars.schema).parquet(
        views.stored_path(spark, sf_dir, "bars-defective")
    )
    clean, broken = scratch_path(spark, "clean"), scratch_path(spark, "quarantine")
    streams.quarantine_stream(
        source, clean, broken, scratch_path(spark, "quarantine-state")
    ).awaitTermination()
    counted = [
        spark.read.parquet(p).groupBy("asset_id").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "sink", F.lit(name)
        )
        for name, p in (("clean", clean), ("quarantine", broken))
    ]
    return publish(counted[0].unionByName(counted[1]))
