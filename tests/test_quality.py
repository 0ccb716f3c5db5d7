"""One small case per finding code, eligibility, replay and the single-pair comparison."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from decimal import Decimal

import pytest
from conftest import bar, bars_frame, calendar_frame
from pyspark.sql import functions as F

from barloom.operators import cross_source, quality

DAYS = [dt.date(2026, 1, d) for d in (5, 6, 7, 8, 9)]
RAW = "asset_id string, source_id string, row_seq bigint, session date, open string, high string, low string, close string, volume string"


def raw(source, days=DAYS, close="100", asset="X", **cells):
    rows = []
    for i, d in enumerate(days):
        row = {"open": "100", "high": "110", "low": "90", "close": close, "volume": "10"} | (
            cells.get(f"at_{i}", {})
        )
        rows.append((asset, source, i, d, row["open"], row["high"], row["low"], row["close"], row["volume"]))
    return rows


def inputs(spark, rows, options=None):
    """Bars, sources, calendar and requests; ``options`` holds schema/mode/start/end per asset."""
    options = options or {}
    ids = sorted({r[:2] for r in rows})
    ranges = []
    for asset in sorted({r[0] for r in rows}):
        o = options.get(asset, {})
        ranges.append((asset, o.get("start", DAYS[0]), o.get("end", DAYS[-1]), o.get("mode", "raw")))
    return (
        spark.createDataFrame(rows, RAW),
        spark.createDataFrame(
            [(a, i, i, options.get(a, {}).get("schema", "normalized-bar-v1"), "n", "1") for a, i in ids],
            "asset_id string, source_id string, provider string, schema_version string, normalizer_id string, normalizer_version string",
        ),
        calendar_frame(spark, DAYS),
        spark.createDataFrame(
            ranges, "asset_id string, requested_start date, requested_end date, adjustment_mode string"
        ),
    )


def judge(spark, rows, options=None, policy=quality.QualityPolicy()):
    """Finding codes and verdict per asset, all assets in one run."""
    args = inputs(spark, rows, options)
    report = quality.quality_report(*args, policy)
    codes = {}
    for r in report.findings.select("asset_id", "finding_code").collect():
        codes.setdefault(r.asset_id, []).append(r.finding_code)
    return {
        r.asset_id: (sorted(codes.get(r.asset_id, [])), r.status)
        for r in report.eligibility.collect()
    }


CASES = {
    "clean": (raw("a"), {}, [], "eligible"),
    "duplicate": (raw("a", [*DAYS, DAYS[4]]), {}, ["duplicate_session"], "ineligible"),
    "order": (raw("a", [DAYS[1], DAYS[0], *DAYS[2:]]), {}, ["non_monotonic_sessions"], "ineligible"),
    "nan": (raw("a", at_1={"open": "NaN"}), {}, ["non_finite_field"], "ineligible"),
    "zero": (raw("a", at_1={"close": "0"}), {}, ["invalid_ohlc", "non_positive_price"], "ineligible"),
    "inverted": (raw("a", at_1={"high": "80"}), {}, ["invalid_ohlc"], "ineligible"),
    "volume": (raw("a", at_1={"volume": "-1"}), {}, ["negative_volume"], "ineligible"),
    "no volume": (raw("a", at_1={"volume": "x"}), {}, ["non_finite_field"], "ineligible"),
    "weekend": (raw("a", [*DAYS, dt.date(2026, 1, 10)]), {}, ["unexpected_session"], "eligible"),
    "hole": (raw("a", [DAYS[0], DAYS[1], DAYS[4]]), {}, ["insufficient_session_coverage", "source_missing_session"], "incomplete"),
    "schema": (raw("a"), {"schema": "other"}, ["unsupported_normalized_schema"], "incomplete"),
    "adjusted": (raw("a"), {"mode": "split_adjusted"}, ["unsupported_adjustment_semantics"], "incomplete"),
    "outside": (raw("a"), {"start": dt.date(2026, 2, 1), "end": dt.date(2026, 2, 9)}, ["no_expected_sessions_in_requested_range"], "incomplete"),
    "close apart": (raw("a") + raw("b", close="100.3"), {}, ["cross_source_field_warning"] * 5, "eligible"),
    "conflict": (raw("a") + raw("b", close="101"), {}, ["cross_source_field_conflict"] * 5, "ineligible"),
    "absent": (raw("a") + raw("b", DAYS[1:]), {}, ["cross_source_session_missing", "source_missing_session"], "eligible"),
    # 0.1 % of the mean: exactly ten basis points pass.
    "edge": (raw("a", close="99.95") + raw("b", close="100.05"), {}, [], "eligible"),
    # A finding outside the requested range leaves it eligible.
    "scoped": (raw("a", at_0={"high": "80"}), {"start": DAYS[2]}, ["invalid_ohlc"], "eligible"),
}


def test_finding_codes_of_many_assets_in_any_order(spark):
    rows = [(name, *row[1:]) for name, case in CASES.items() for row in case[0]]
    options = {name: case[1] for name, case in CASES.items()}
    expected = {name: (case[2], case[3]) for name, case in CASES.items()}
    assert judge(spark, rows[::-1], options) == expected


def test_second_source_requirement_islands(spark):
    rows = raw("a") + raw("b", [DAYS[0], DAYS[3]])
    args = inputs(spark, rows)
    found = quality.requested_range_coverage(*args, quality.QualityPolicy(minimum_sources=2))
    got = [
        (r.finding_code, r.affected_start, r.affected_end, json.loads(r.observed)["missing_count"])
        for r in found.orderBy("affected_start").collect()
    ]
    assert got == [
        ("insufficient_source_verification", DAYS[1], DAYS[2], 2),
        ("insufficient_source_verification", DAYS[4], DAYS[4], 1),
    ]


def test_revision_and_policy(spark):
    before = spark.createDataFrame(raw("v1"), RAW)
    after = spark.createDataFrame(raw("v2", DAYS[:4], at_1={"volume": "11"}, at_2={"close": "100.00"}), RAW)
    pairs = spark.createDataFrame([("X", "v1", "v2")], "asset_id string, previous_id string, current_id string")
    found = quality.provider_revision(before.unionByName(after), pairs).orderBy("affected_start").collect()
    assert [(r.affected_start, json.loads(r.observed)["changed_fields"]) for r in found] == [
        (DAYS[1], ["volume"]),
        (DAYS[4], ["session_presence"]),
    ]
    args = inputs(spark, raw("v1"))
    strict = quality.QualityPolicy(revision_blocks=True)
    report = quality.quality_report(*args, strict, before.unionByName(after), pairs)
    assert report.eligibility.first().status == "incomplete"
    status = {r.check_id: r.status for r in report.check_results.collect()}
    assert len(status) == 11 and status["provider_revision"] == "warning"
    assert status["cross_source_ohlc"] == "not_applicable" and status["ohlc_integrity"] == "pass"
    again = quality.all_findings(*args, strict, before.unionByName(after), pairs)
    assert quality.report_differences(report.findings, again).count() == 0
    forged = report.findings.filter("check_id <> 'provider_revision'")
    assert quality.report_differences(forged, again).count() == 2


def test_finding_id_is_the_hash_of_canonical_json(spark):
    found = quality.with_finding_id(
        quality.ohlc_integrity(spark.createDataFrame(raw("a", at_1={"open": "NaN"}), RAW))
    ).first()
    payload = {
        "check_id": "ohlc_integrity",
        "check_version": "2",
        "severity": "blocker",
        "finding_code": "non_finite_field",
        "affected_start": "2026-01-06",
        "affected_end": "2026-01-06",
        "field": "open",
        "source_evidence_ids": ["a"],
        "observed_values": {"value": "NaN"},
        "message": "open is no finite number",
    }
    text = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    assert found.finding_id == "dqf_" + hashlib.sha256(f"dqf\n{text}".encode()).hexdigest()[:24]


def test_arrival_order_across_run_borders(spark, monkeypatch):
    monkeypatch.setattr(quality, "ARRIVAL_ROWS", 2)
    days = [DAYS[0], DAYS[2], DAYS[1], DAYS[3], DAYS[2], DAYS[4]]
    found = quality.session_integrity(spark.createDataFrame(raw("a", days), RAW))
    inverted = found.filter("finding_code = 'non_monotonic_sessions'").orderBy("affected_start")
    assert [(r.affected_start, r.affected_end) for r in inverted.collect()] == [
        (DAYS[1], DAYS[2]),
        (DAYS[2], DAYS[3]),
    ]


def test_independent_sources_and_revision_pairs(spark):
    _, sources, _, _ = inputs(spark, raw("a") + raw("A"))
    assert quality.dependent_sources(sources).first().source_count == 2
    seen = spark.createDataFrame(
        [("1", "P", "e", "r", "x"), ("2", "p", "e", "r", "y"), ("3", "p", "e", "other", "z"), ("4", "p", "e", "r", "x")],
        "source_id string, provider string, endpoint string, request_fingerprint string, evidence_id string",
    )
    pairs = spark.createDataFrame(
        [("X", "1", "2"), ("X", "1", "3"), ("X", "1", "4")],
        "asset_id string, previous_id string, current_id string",
    )
    bad = {(r.current_id, r.rule) for r in quality.invalid_revision_pairs(pairs, seen).collect()}
    assert bad == {("3", "different_request"), ("4", "same_observation")}


def test_policy_contract():
    for bad in ({"pass_bps": "60"}, {"minimum_sources": 3}, {"accepted_schemas": ()}, {"accepted_schemas": ("a", "a")}):
        with pytest.raises(ValueError):
            quality.QualityPolicy(**bad)


def test_single_pair_close_comparison(spark):
    closes = {0: "100.05", 1: "100.25", 2: "101", 3: "100.1"}
    one = bars_frame(spark, [bar(d, 100) for d in DAYS])
    two = bars_frame(spark, [bar(DAYS[i], c) for i, c in closes.items()])
    checks = cross_source.compare_close(one, two)
    assert [r.status for r in checks.orderBy("session").collect()] == ["pass", "warning", "fail", "pass", "missing"]
    summary = cross_source.summarize(checks).first()
    assert summary.overall_status == "fail" and summary.overlapping_sessions == 4
    mild = cross_source.summarize(cross_source.compare_close(one.limit(2), two.limit(2))).first()
    assert mild.overall_status == "warning"
    assert cross_source.duplicate_sessions(one.unionByName(one.limit(1))).count() == 1
