"""Several requests per asset, bitmaps of sessions, and intervals, against brute force."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import calendar_frame, weekdays
from pyspark.sql import functions as F

from barloom.operators import contracts, intervals, quality, session_sets

DAY = dt.date(2020, 1, 1)
RANGES = "k string, id int, start date, end date"
FINDINGS = (
    "asset_id string, request_id string, check_id string, severity string, finding_code string, affected_start date, "
    "affected_end date, field string, source_ids array<string>, observed string, message string"
)
REQUESTS = "asset_id string, requested_start date, requested_end date, adjustment_mode string"


def ranges(rng, n, longest):
    out = []
    for k in range(n):
        start = DAY + dt.timedelta(rng.randint(-3000, 3000))
        # A third of all rows belongs to one key; lengths go from a day to decades.
        out.append((rng.choice(["hot", "a", "b"]), k, start, start + dt.timedelta(int(longest ** rng.random()) - 1)))
    return out


@pytest.mark.parametrize("longest", [2, 40, 20_000])
def test_overlapping_pairs_come_out_once(spark, longest):
    rng = random.Random(longest)
    left, right = ranges(rng, 300, longest), ranges(rng, 200, 700)
    broken = [("hot", 1000, DAY, DAY - dt.timedelta(1)), ("hot", 1001, None, DAY), ("hot", 1002, DAY, None)]
    found = intervals.overlapping(
        spark.createDataFrame(left + broken, RANGES).repartition(3), spark.createDataFrame(right + broken, RANGES), ["k"]
    )
    got = sorted((r.left.id, r.right.id) for r in found.collect())
    assert got == sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3])


def test_far_intervals_of_one_key_are_not_compared(spark):
    """Two thousand short intervals of one key a month apart meet their neighbours only."""
    rows = [("hot", k, DAY + dt.timedelta(30 * k), DAY + dt.timedelta(30 * k + 2)) for k in range(2_000)]
    df = spark.createDataFrame(rows, RANGES)
    bins = intervals._listed(df, ["k"], "start", "end", "l").filter("_own_l").groupBy("_level", "_bin").count()
    assert bins.agg(F.max("count")).first()[0] == 1
    assert intervals.overlapping(df, df, ["k"]).count() == 2_000


def finding(asset, code, start, end, *, check="session_integrity", severity="error", request=None):
    return (asset, request, check, severity, code, start, end, None, ["s"], "{}", "m")


def test_eligibility_counts_what_touches_each_request(spark):
    rng = random.Random(5)
    codes = [
        ("duplicate_session", "error", "session_integrity"),
        ("cross_source_field_conflict", "error", "cross_source_ohlc"),
        ("cross_source_field_warning", "warning", "cross_source_ohlc"),
        ("source_missing_session", "warning", "source_coverage"),
        ("unsupported_normalized_schema", "error", "schema_contract"),
        ("noted", "info", "schema_contract"),
    ]
    requests = [
        (asset, a, a + dt.timedelta(rng.randint(0, 300)), rng.choice(["raw", "adjusted"]))
        for asset in ("hot", "a", "none")
        for a in (DAY + dt.timedelta(rng.randint(-400, 400)) for _ in range(12))
    ]
    found = []
    for _ in range(900):
        code, severity, check = rng.choice(codes)
        start = DAY + dt.timedelta(rng.randint(-500, 500))
        found.append(finding(rng.choice(["hot", "hot", "a"]), code, start, start + dt.timedelta(rng.choice([0, 0, 30, 500])), check=check, severity=severity))
    asked = quality.with_request_id(spark.createDataFrame(requests, REQUESTS)).collect()
    for r in asked[:20]:
        found += [finding(r.asset_id, "insufficient_session_coverage", r.requested_start, r.requested_start, check="requested_range_coverage", request=r.request_id)] * 2
    effects = {c: e for e, cs in (("blocking", quality.INELIGIBLE_CODES), ("incomplete", quality.INCOMPLETE_CODES)) for c in cs}
    told = {}
    for r in asked:
        touching = {
            f
            for f in map(lambda f: (*f[:8], *f[9:]), found)
            if f[0] == r.asset_id
            and f[1] in (None, r.request_id)
            and f[5] <= r.requested_end
            and f[6] >= r.requested_start
            and f[3] != "info"
            and (f[2] != "cross_source_ohlc" or r.adjustment_mode == "raw")
        }
        counts = [sum(effects.get(f[4], "warning") == e for f in touching) for e in quality.EFFECTS]
        told[r.asset_id, r.request_id] = (*counts, "ineligible" if counts[0] else "incomplete" if counts[1] else "eligible")
    findings = spark.createDataFrame(found, FINDINGS)
    table = spark.createDataFrame(requests, REQUESTS)
    policy = quality.QualityPolicy()
    got = {(r.asset_id, r.request_id): tuple(r)[4:] for r in quality.range_eligibility(findings, table, policy).collect()}
    assert got == told
    pairs = quality.range_findings(findings, table, policy).groupBy("asset_id", "request_id").count().collect()
    assert {(r.asset_id, r.request_id): r["count"] for r in pairs} == {k: sum(v[:3]) for k, v in told.items() if sum(v[:3])}


def test_each_request_is_judged_on_its_own_range(spark):
    days = weekdays("2024-01-01", 40)
    sessions = calendar_frame(spark, days)
    held = [d for k, d in enumerate(days) if k not in (3, 4, 20, 39)]
    text = ("10", "11", "9", "10", "5")
    rows = [("A", "s1", k, d, *text) for k, d in enumerate(held)] + [("A", "s2", k, d, *text) for k, d in enumerate(days[10:20])]
    bars = spark.createDataFrame(rows * 2, "asset_id string, source_id string, row_seq bigint, session date, open string, high string, low string, close string, volume string")
    sources = spark.createDataFrame([(a, s, "normalized-bar-v1", "n", "1") for a, s in (("A", "s1"), ("A", "s2"), ("B", "s1"))], "asset_id string, source_id string, schema_version string, normalizer_id string, normalizer_version string")
    asked = [("A", days[0], days[9], "raw"), ("A", days[10], days[24], "raw"), ("A", days[5], days[8], "raw"), ("A", days[4] + dt.timedelta(1), days[4] + dt.timedelta(2), "raw"), ("B", days[0], days[1], "raw")]
    requests = spark.createDataFrame(asked, REQUESTS)
    for minimum in (1, 2):
        found = quality.requested_range_coverage(bars, sources, sessions, requests, quality.QualityPolicy(minimum_sources=minimum)).collect()
        got = {(r.asset_id, r.request_id, r.finding_code, r.affected_start, r.affected_end) for r in found}
        told = set()
        for asset, a, b, mode in asked:
            key = f"{a}/{b}/{mode}"
            inside = [d for d in days if a <= d <= b]
            if not inside:
                told.add((asset, key, "no_expected_sessions_in_requested_range", a, b))
            counts = [sum(asset == "A" and d in x for x in (held, days[10:20])) for d in inside]
            codes = ["insufficient_session_coverage" if n == 0 else "insufficient_source_verification" if n < minimum else None for n in counts]
            k = 0
            while k < len(codes):
                end = k
                while end + 1 < len(codes) and codes[end + 1] == codes[k]:
                    end += 1
                if codes[k]:
                    told.add((asset, key, codes[k], inside[k], inside[end]))
                k = end + 1
        assert got == told and len(found) == len(told)
    missing = quality.source_coverage(bars, sources, sessions).collect()
    assert {(r.asset_id, r.source_ids[0], r.affected_start, r.affected_end) for r in missing} == {
        ("A", "s1", days[3], days[4]),
        ("A", "s1", days[20], days[20]),
        ("A", "s1", days[39], days[39]),
        ("A", "s2", days[0], days[9]),
        ("A", "s2", days[20], days[39]),
        ("B", "s1", days[0], days[39]),
    }


def test_bits_and_runs_across_buckets(spark):
    rng = random.Random(1)
    places = sorted(rng.sample(range(70_000), 30_000))
    df = spark.createDataFrame([("a", p) for p in places] + [("a", None)], "k string, no bigint")
    held = session_sets.packed(session_sets.bitmaps(df, ["k"], {"bits": F.lit(True)}), ["k"], ["bits"])
    known = set(places)
    for low, high in ((0, 100), (3, 3), (32_760, 32_790), (5, 69_999), (69_990, 70_010), (10, 9), (200_000, 200_008)):
        a, b = F.lit(low).cast("long"), F.lit(high).cast("long")
        states = session_sets.bits_between(F.col("bits"), a, b)
        row = held.select(states.alias("states"), session_sets.runs(states, "0", a).alias("runs")).first()
        assert row.states == ["1" if p in known else "0" for p in range(low, high + 1)]
        assert sum(r.n for r in row.runs) == row.states.count("0")
        assert all(r.b - r.a + 1 == r.n and r.a - 1 not in set(range(low, high + 1)) - known for r in row.runs)


def test_sets_of_many_members(spark):
    rng = random.Random(2)
    sets = {f"m{k}": {rng.randint(0, 200) for _ in range(400)} | {40_000 + k} for k in range(7)}
    sets["m0"].discard(40_000)
    df = spark.createDataFrame([(m, p) for m, ps in sets.items() for p in ps], "m string, no bigint")
    bits = session_sets.bitmaps(df, ["m"], {"bits": F.lit(True)})
    members = spark.createDataFrame([(7,)], "n_members bigint")
    assert session_sets.sizes(session_sets.union(bits, []), []).first().n == len(set().union(*sets.values()))
    assert session_sets.sizes(session_sets.intersection(bits, [], members), []).first().n == len(set.intersection(*sets.values()))
    assert {r.m: r.n for r in session_sets.sizes(bits, ["m"]).collect()} == {m: len(p) for m, p in sets.items()}


def test_intervals_of_one_release_are_disjoint_by_a_running_maximum(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        start = DAY + dt.timedelta(rng.randint(0, 4000))
        rows.append((rng.choice(["hot", "hot", "x"]), start, start + dt.timedelta(rng.choice([0, 3, 3, 900])), 1, f"r{k}"))
    kinds = "release_id string, start_session date, end_session date, session_count bigint, report_id string"
    releases = spark.createDataFrame([(r, DAY, DAY + dt.timedelta(9000), 10**6) for r in ("hot", "x")], "release_id string, schedule_start date, schedule_end date, schedule_count bigint")
    found = contracts.interval_violations(spark.createDataFrame(rows, kinds), releases).collect()
    told, last = [], {}
    for release, start, end, _, report in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[4])):
        if release in last and start <= last[release]:
            told.append((release, start))
        last[release] = max(end, last.get(release, end))
    assert sorted((r.release_id, r.start_session) for r in found if r.rule == "disjoint") == sorted(told)
