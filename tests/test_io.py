"""Sources, sinks, identities, credential keys, contracts and streams."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import tempfile
from decimal import Decimal

import pytest
from conftest import bar, bars_frame, calendar_frame, instant, weekdays
from pyspark.sql import functions as F

from barloom.functions import credentials, digests, identity
from barloom.operators import contracts
from barloom.operators.alignment import cover
from barloom.operators.backtest import Costs, backtest
from barloom.plans import strategies, views
from barloom.sources import captures, fixtures, providers, results
from barloom.streaming import bars as streams

DAYS = weekdays("2026-01-05", 10)
TEXT = "asset_id string, date string, open string, high string, low string, close string, volume string"


def fresh():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def row(asset, date, close="10", volume="5"):
    return (asset, date, "10", "11", "9", close, volume)


def test_normalize_shapes_and_rules(spark):
    rows = [
        row("ok", "2026-01-05"),
        row("ok", "2026-01-06T23:30:00-05:00"),
        row("ok", "2026-01-07T00:00:00Z"),
        row("ok", "2025-12-31"),
        row("date", "soon"),
        row("nan", "2026-01-05", close="NaN"),
        row("inf", "2026-01-05", volume="Infinity"),
        row("twice", "2026-01-05"),
        row("twice", "2026-01-05"),
        row("sunday", "2026-01-11"),
        row("range", "2026-01-05", close="12"),
    ]
    raw = spark.createDataFrame(rows, TEXT)
    sessions = calendar_frame(spark, DAYS)
    out = providers.normalize_bars(raw, sessions, providers.LOWER_CASE, start="2026-01-01", end="2026-01-31")
    bars = out.bars.orderBy("session").collect()
    assert [(b.asset_id, b.session) for b in bars] == [("ok", DAYS[0]), ("ok", DAYS[1]), ("ok", DAYS[2])]
    assert bars[0].available_at == bars[0].session_close_at and bars[0].source == "lower:raw"
    assert {(v.asset_id, v.rule) for v in out.violations.collect()} == {
        ("date", "invalid_date"),
        ("nan", "invalid_close"),
        ("inf", "invalid_volume"),
        ("twice", "duplicate_session"),
        ("sunday", "not_a_session"),
        ("range", "close_in_range"),
    }
    title = raw.withColumnsRenamed({f: f.title() for f in providers.FIELDS})
    strict = providers.normalize_bars(title, sessions, providers.TITLE_CASE, start="2026-01-01", end="2026-01-31")
    assert ("ok", "outside_requested_range") in {(v.asset_id, v.rule) for v in strict.violations.collect()}
    none = providers.normalize_bars(title.filter("asset_id = 'ok'"), sessions, providers.TITLE_CASE, start="2027-01-01", end="2027-01-31")
    assert "no_bars_in_range" in {v.rule for v in none.violations.collect()}
    with pytest.raises(ValueError):
        providers.normalize_bars(raw, sessions, providers.TITLE_CASE)


def test_adjustment_flags(spark):
    df = spark.createDataFrame([("",), ("qfq",)], "flag string")
    assert [r[0] for r in df.select(providers.adjustment_mode(F.col("flag"))).collect()] == ["raw", "split_adjusted"]
    with pytest.raises(Exception, match="unsupported adjustment"):
        spark.createDataFrame([("hfq",)], "flag string").select(providers.adjustment_mode(F.col("flag"))).collect()


CREDENTIAL_KEYS = [
    "apikey", "api_key", "apiKey2", "X-API-Key", "Authorization", "client%5Fsecret", "%2561pi_key",
    "ｐａｓｓｗｏｒｄ", "myapikey", "AWSAccessKeyId", "key", "Key1", "sessionToken", "oauth2Key",
    "Ocp-Apim-Subscription-Key", "refresh.token", "privateKEY",
]
PLAIN_KEYS = ["symbol", "keyword", "monkey", "tokens", "primary_key", "sort-key", "authority", "start", "", "123"]


def test_credential_keys(spark):
    keys = spark.createDataFrame([(k,) for k in CREDENTIAL_KEYS + PLAIN_KEYS], "key string")
    got = {r.key: r.is_credential for r in credentials.classify_keys(keys).collect()}
    assert got == {k: True for k in CREDENTIAL_KEYS} | {k: False for k in PLAIN_KEYS}


def test_json_is_screened_at_any_depth_and_fails_closed(spark):
    def deep(levels, key):
        return '{"a":' * levels + '{"' + key + '":1}' + "}" * levels

    docs = spark.createDataFrame(
        [
            (1, '{"symbol":"Q","headers":[{"apiKey":"x"}]}'), (2, '{"symbol":"Q"}'), (3, deep(9, "b")),
            (4, "[1, 2]"), (5, deep(10, "apiKey")), (6, '{"apiKey":"x"'), (7, 'x {"a":1}'), (8, '{"a":1} {"apiKey":1}'),
            (9, None), (10, ' "text" '), (11, '{"a":"}{ \\" apiKey: "}'), (12, deep(12, "\\u0061piKey")), (13, "-1.5e3"), (14, '[{"a":[]},{"b":{}}]'),
        ],
        "id int, doc string",
    )
    rows = {(r.id, r.key) for r in credentials.screen_json(docs, "id", "doc").collect()}
    unreadable = "<unreadable>"
    assert rows - {(8, "apiKey")} == {(1, "apiKey"), (5, "apiKey"), (12, "apiKey"), (6, unreadable), (7, unreadable), (8, unreadable)}


def capture(spark, rows):
    return spark.createDataFrame(
        [(i, "p", "daily", req, recs, instant(DAYS[0], h), "v1", "1", "lic", ["research"], False) for i, req, recs, h in rows],
        "capture_id string, provider string, endpoint string, request map<string,string>, records array<map<string,string>>, "
        "captured_at timestamp, schema_version string, adapter_version string, license_profile string, "
        "permitted_uses array<string>, redistribution_allowed boolean",
    )


def test_captures_store_content_once_and_detect_tampering(spark):
    path = fresh()
    records = [{"date": "2026-01-05", "close": "1"}, {"date": "2026-01-06", "close": "2"}]
    first = capture(spark, [("c1", {"symbol": "Q", "b": "1"}, records, 1), ("c2", {"b": "1", "symbol": "Q"}, records, 2), ("bad", {"api_key": "x"}, records, 3)])
    rejected = captures.write_captures(first, path)
    assert [r.capture_id for r in rejected.collect()] == ["bad"]
    captures.write_captures(capture(spark, [("c3", {"symbol": "Q", "b": "1"}, records, 4), ("c4", {"symbol": "Z"}, records[:1], 5)]), path)
    contents = spark.read.parquet(f"{path}/contents")
    assert contents.count() == 2 and spark.read.parquet(f"{path}/observations").count() == 4
    assert {r.verdict for r in captures.verify_captures(spark, path).collect()} == {"verified"}
    assert captures.read_records(spark, path).count() == 7
    document = {
        "endpoint": "daily", "provider": "p", "records": records,
        "request": {"symbol": "Q", "b": "1"}, "schema_version": "v1",
    }
    text = json.dumps(document, sort_keys=True, separators=(",", ":"))
    assert hashlib.sha256(text.encode()).hexdigest() in {r.content_hash for r in contents.collect()}
    forged = fresh()
    contents.withColumn("schema_version", F.lit("v2")).write.partitionBy("provider").parquet(f"{forged}/contents")
    spark.read.parquet(f"{path}/observations").write.parquet(f"{forged}/observations")
    assert {r.verdict for r in captures.verify_captures(spark, forged).collect()} == {"content_changed"}
    assert captures.read_records(spark, forged).count() == 0


def scanned_prefixes(spark, path, batch):
    """Store partitions that the search for known hashes reads."""
    frame = spark.createDataFrame(batch, "provider string, hash_prefix string, content_hash string")
    plan = captures.stored_hashes(frame, path)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "contents" in line)
    assert "ReadSchema: struct<content_hash:string>" in scan
    return scan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]


def test_capture_store_reads_only_touched_partitions(spark):
    path = fresh()
    captures.write_captures(capture(spark, [(f"c{i}", {"symbol": str(i)}, [{"close": str(i)}], 1) for i in range(40)]), path)
    stored = spark.read.schema(captures.STORED).parquet(f"{path}/contents").select("provider", "hash_prefix", "content_hash").collect()
    assert len(stored) == 40 and all(r.content_hash.startswith(r.hash_prefix) for r in stored)
    one = stored[0]
    filters = scanned_prefixes(spark, path, [tuple(one)])
    assert one.hash_prefix in filters and not any(r.hash_prefix in filters for r in stored if r.hash_prefix != one.hash_prefix)
    found = captures.stored_hashes(spark.createDataFrame([tuple(one), ("p", "zz", "zz1")], "provider string, hash_prefix string, content_hash string"), path)
    assert [r[0] for r in found.collect()] == [one.content_hash]


def test_capture_input_is_evaluated_once(spark):
    path, seen = fresh(), spark.sparkContext.accumulator(0)

    def count(value):
        seen.add(1)
        return value

    rows = [(f"c{i}", {"symbol": str(i), "api_key": "x"} if i == 3 else {"symbol": str(i)}, [{"close": "1"}], 1) for i in range(20)]
    counted = capture(spark, rows).withColumn("endpoint", F.udf(count, "string").asNondeterministic()("endpoint"))
    for expected in (20, 40):  # the second time against a store that knows every content
        captures.write_captures(counted, path).collect()
        assert seen.value == expected
    assert spark.read.parquet(f"{path}/contents").count() == 19
    assert spark.read.parquet(f"{path}/observations").count() == 38


def test_capture_commits_can_be_repeated_and_survive_a_stop_in_between(spark):
    path = fresh()
    batch = capture(spark, [("a", {"symbol": "Q"}, [{"close": "1"}], 1), ("b", {"symbol": "R"}, [{"close": "2"}], 1)])
    for _ in range(2):
        captures.write_captures(batch, path, commit_id="batch-1")
    assert spark.read.parquet(f"{path}/contents").count() == 2
    assert spark.read.parquet(f"{path}/observations").count() == 2
    # A writer that stopped after its contents: nothing refers to them until a later commit does.
    stopped, full = fresh(), spark.read.schema(captures.STORED).parquet(f"{path}/contents")
    full.withColumn("commit_id", F.lit("lost")).write.partitionBy("provider", "hash_prefix").parquet(f"{stopped}/contents")
    captures.write_captures(batch, stopped, commit_id="batch-2")
    assert spark.read.parquet(f"{stopped}/contents").count() == 2
    assert captures.read_records(spark, stopped).count() == 2
    # Two writers at once: one content stored twice, records are read once; an intact copy outlives a damaged one.
    full.withColumn("commit_id", F.lit("again")).write.mode("append").partitionBy("provider", "hash_prefix").parquet(f"{path}/contents")
    assert captures.read_records(spark, path).count() == 2
    full.withColumns({"commit_id": F.lit("a-first"), "schema_version": F.lit("v9")}).write.mode("append").partitionBy("provider", "hash_prefix").parquet(f"{path}/contents")
    assert {r.verdict for r in captures.verify_captures(spark, path).collect()} == {"verified"}
    assert captures.read_records(spark, path).count() == 2


def test_rejected_captures_leave_no_secret_and_empty_batches_commit(spark):
    path = fresh()
    hidden = [
        ("nested", {"q": '{"headers": [{"api%4bey": "s3cr3t"}]}'}, [{"close": "s3cr3t"}], 1), ("broken", {"q": '{"a": s3cr3t'}, [], 1),
        ("wide", {"\uff41piKey": "s3cr3t"}, [{"close": "1"}], 1), ("mixed", {"token": "s3cr3t"}, [], 1), ("mixed", {"symbol": "Q"}, [], 1),
        ("good", {"symbol": "Q", "keyboard": "1"}, [{"close": "1"}], 1),
    ]
    rejected = captures.write_captures(capture(spark, hidden), path)
    assert sorted(r.capture_id for r in rejected.collect()) == ["broken", "mixed", "nested", "wide"]
    assert {r.capture_id for r in spark.read.parquet(f"{path}/observations").collect()} == {"good"}
    staged = captures._staged(capture(spark, hidden)).filter("rejected")
    assert all(r.request is None and r.records is None and r.content_hash is None for r in staged.collect())
    captures.write_captures(capture(spark, hidden).limit(0), path)
    empty = fresh()
    captures.write_captures(capture(spark, hidden).limit(0), empty)
    assert captures.read_records(spark, path).count() == 1 and captures.read_records(spark, empty).count() == 0


def test_capture_text_rejects_non_finite(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 2), Decimal("1.50"), 2.5)], "d date, x decimal(9,2), y double")
    assert tuple(captures.capture_text(df).first()) == ("2026-01-02", "1.50", "2.5")
    with pytest.raises(Exception, match="must be finite"):
        captures.capture_text(spark.createDataFrame([(float("nan"),)], "y double")).collect()


def test_fixture_roundtrip_and_tampering(spark):
    path = fresh()
    bars, sessions = bars_frame(spark, [bar(d, 10 + i) for i, d in enumerate(DAYS)]), calendar_frame(spark, DAYS)
    fixtures.write_fixture(bars, sessions, "f1", path)
    assert fixtures.read_fixture(spark, "f1", path).violations.count() == 0
    bars.withColumn("close", F.col("close") + 1).write.mode("overwrite").parquet(f"{path}/f1/bars")
    assert [r.rule for r in fixtures.read_fixture(spark, "f1", path).violations.collect()] == ["content_hash_differs"]
    with pytest.raises(ValueError):
        fixtures.read_fixture(spark, "latest", path)


def test_csv_reader_fails_on_malformed_rows(spark):
    path = fresh() + "/csv"
    spark.createDataFrame([("2026-01-05", "x")], "session string, close string").write.csv(path, header=True)
    with pytest.raises(Exception):
        fixtures.read_bars_csv(spark, path, "session date, close decimal(18,6)").collect()


def test_run_roundtrip_and_tampering(spark):
    bars, sessions = bars_frame(spark, [bar(d, 10 + i % 3) for i, d in enumerate(DAYS)]), calendar_frame(spark, DAYS)
    targets = strategies.sma_targets(bars, sessions, window=2).require()
    run = backtest(cover(bars, sessions).bars, targets, (Costs("one"), Costs("two", 500, 1, 1)))
    path = fresh()
    results.write_run(run, path := path + "/run", engine="e", dataset="d")
    assert {(r.run_id, r.verdict) for r in results.verify_run(spark, path).collect()} == {("one", "verified"), ("two", "verified")}
    assert results.changed_rows(spark, path).count() == 0

    def copied(**changes):
        at = fresh()
        for name in ("points", "trades", "totals", "digests", "manifest", *[f"nodes/{level}" for level in digests.STORED]):
            rows = spark.read.parquet(f"{path}/{name}")
            changes.get(name, lambda r: r)(rows).write.parquet(f"{at}/{name}")
        verdicts = {r.run_id: r.verdict for r in results.verify_run(spark, at).collect()}
        return verdicts, sorted((r.table_name, r.run_id, str(r.session), r.change) for r in results.changed_rows(spark, at).collect())

    one = F.col("run_id") == "one"
    trade = str(spark.read.parquet(f"{path}/trades").filter(one).agg(F.min("session")).first()[0])
    last = str(spark.read.parquet(f"{path}/points").filter(one).agg(F.max("session")).first()[0])
    on = F.col("session") == trade
    found = copied(
        points=lambda r: r.withColumn("cash", F.when(one & (F.col("session") == last), F.col("cash") + 1).otherwise(F.col("cash"))),
        # A row twice is a change of its place.
        trades=lambda r: r.unionByName(r.filter(one & on)),
        totals=lambda r: r.withColumn("trade_count", F.when(one, 99).otherwise(F.col("trade_count"))),
    )
    assert found == (
        {"one": "content_changed", "two": "verified"},
        [("points", "one", last, "changed"), ("totals", "one", "None", "changed"), ("trades", "one", trade, "changed")],
    )
    verdicts, rows = copied(**{t: (lambda r: r.filter(~one)) for t in results.TABLES})
    assert verdicts == {"one": "result_missing", "two": "verified"} and {r[3] for r in rows} == {"missing"}
    assert {r[0] for r in rows} == set(results.TABLES)


def test_identities(spark):
    values = ["1.50", "1.5", "100", "-0", "0.000", "-2.5000", "0.000001"]
    df = spark.createDataFrame([(i, Decimal(v)) for i, v in enumerate(values)], "i int, v decimal(18,6)")
    got = [r[0] for r in df.orderBy("i").select(identity.canonical_decimal(F.col("v"))).collect()]
    assert got == ["1.5", "1.5", "100", "0", "0", "-2.5", "0.000001"]
    expected = "x_" + hashlib.sha256(b'x\n{"a":null}').hexdigest()[:12]
    payload = identity.canonical_json(F.struct(F.lit(None).cast("string").alias("a")))
    assert spark.range(1).select(identity.stable_id("x", payload, 12)).first()[0] == expected
    rows = spark.createDataFrame([("k", i, str(i)) for i in range(10)], "k string, n bigint, t string")
    swapped = rows.withColumn("n", 9 - F.col("n"))
    hashes = [identity.series_fingerprint(d, ["k"], "n", F.col("t")).first().content_hash for d in (rows, rows.repartition(3), swapped)]
    assert hashes[0] == hashes[1] != hashes[2]


def test_schedule_contract_in_local_time(spark):
    winter, summer = dt.date(2026, 1, 5), dt.date(2026, 7, 6)
    rows = [
        ("C", winter, instant(winter, 14, 30), instant(winter, 21)),
        ("C", summer, instant(summer, 13, 30), instant(summer, 20)),
        ("C", dt.date(2026, 7, 8), instant(dt.date(2026, 7, 8), 13, 30), instant(dt.date(2026, 7, 9), 5)),
        ("C", dt.date(2026, 7, 9), instant(dt.date(2026, 7, 9), 4), instant(dt.date(2026, 7, 9), 20)),
    ]
    sessions = spark.createDataFrame(rows, "calendar_id string, session date, session_open_at timestamp, session_close_at timestamp")
    calendars = spark.createDataFrame(
        [("C", "America/New_York", "close_local_date", winter, dt.date(2026, 7, 8))],
        "calendar_id string, timezone string, label_policy string, requested_start date, requested_end date",
    )
    found = {(r.session.day, tuple(r.violations)) for r in contracts.schedule_violations(sessions, calendars).collect()}
    assert found == {(8, ("label_is_local_date",)), (9, ("inside_requested_range", "no_overlap"))}


def test_release_ranges(spark):
    d = dt.date
    intervals = spark.createDataFrame(
        [("r", d(2025, 12, 1), d(2026, 1, 31)), ("r", d(2026, 3, 1), d(2026, 3, 31))],
        "release_id string, start_session date, end_session date",
    )
    consumed = spark.createDataFrame(
        [("r", d(2025, 12, 1), d(2026, 1, 31)), ("r", d(2026, 1, 31), d(2026, 3, 1)), ("r", d(2026, 3, 2), d(2026, 3, 2)), ("q", d(2026, 3, 2), d(2026, 3, 2))],
        "release_id string, first_session date, last_session date",
    )
    got = {(r.release_id, r.first_session, r.supported) for r in contracts.supported_ranges(consumed, intervals).collect()}
    assert got == {("r", d(2025, 12, 1), True), ("r", d(2026, 1, 31), False), ("r", d(2026, 3, 2), True), ("q", d(2026, 3, 2), False)}


def test_quarantine_stream(spark):
    days = weekdays("2026-01-05", 15)
    bars = bars_frame(spark, [bar(d, 10 + i) for i, d in enumerate(days) if i != 6])
    source, out = fresh() + "/bars", fresh()
    bad = bars.withColumn("high", F.when(F.col("session") == str(days[3]), (F.col("low") - 1).cast("decimal(18,6)")).otherwise(F.col("high")))
    bad.write.parquet(source + "2")
    stream = spark.readStream.schema(bars.schema).parquet(source + "2")
    streams.quarantine_stream(stream, f"{out}/clean", f"{out}/broken", f"{out}/state2").awaitTermination()
    assert spark.read.parquet(f"{out}/clean").count() == 13
    broken = spark.read.parquet(f"{out}/broken").collect()
    assert len(broken) == 1 and "high_at_least_low" in broken[0].violations


def test_capture_text_keeps_fractions_of_seconds(spark):
    times = ("00:00:00", "00:00:00.123456", "00:00:00.9", "00:00:00.900001")
    rows = spark.createDataFrame([(f"2024-01-02 {t}",) for t in times], "t string").selectExpr("cast(t as timestamp) t")
    assert [r.t for r in captures.capture_text(rows).collect()] == [f"2024-01-02T{t}" for t in times]


def test_bars_of_large_and_fine_prices(spark):
    """Prices and order keys of any size keep their order and all six decimals."""
    keys = (1, 2**55, 2**62)
    prices = (Decimal("167772.160001"), Decimal("999999999999.999999"), Decimal("0.000001"))
    rows = [("A", k, dt.date(2024, 1, 2), p, Decimal("1")) for k, p in zip(keys, prices)]
    lines = spark.createDataFrame(
        rows,
        "l_returnflag string, l_orderkey bigint, l_shipdate date, l_extendedprice decimal(18,6), l_quantity decimal(12,2)",
    )
    bar_ = views.bars_of_lines(lines, F.col("l_returnflag")).first()
    assert (bar_.open, bar_.high, bar_.low, bar_.close) == (prices[0], prices[1], prices[2], prices[2])
