"""Quality policies as rows, against one report per policy."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F
from test_quality import DAYS, inputs, raw

from barloom.functions import digits
from barloom.operators import policies, quality

POLICY = (
    "policy_id string, version string, valid_from date, accepted_schemas array<string>, minimum_sources int, pass_bps string, "
    "warning_bps string, revision_blocks boolean"
)
FROM = dt.date(2020, 1, 1)
V1 = ["normalized-bar-v1"]


def table(spark, *rows):
    return spark.createDataFrame(list(rows), POLICY)


def test_broken_versions_are_named_and_judge_nothing(spark):
    rows = table(
        spark,
        ("good", "1", FROM, V1, 1, "10", "50", False), ("zero", "1", FROM, V1, 2, "0", "0", True), ("order", "1", FROM, V1, 1, "50.1", "50", False),
        ("minus", "1", FROM, V1, 1, "-1", "50", False), ("text", "1", FROM, V1, 1, "ten", "50", False), ("fine", "1", FROM, V1, 1, "0.00001", "50", False),
        ("huge", "1", FROM, V1, 1, "1", "880000", False), ("three", "1", FROM, V1, 3, "1", "2", False), ("none", "1", FROM, [], 1, "1", "2", False),
        ("twin", "1", FROM, V1 * 2, 1, "1", "2", False), ("null", "1", FROM, [None], 1, "1", "2", False), ("open", "1", None, V1, 1, "1", "2", False),
        ("unsaid", "1", FROM, None, None, None, "2", None), ("same", "1", FROM, V1, 1, "1", "2", False), ("same", "1", FROM + dt.timedelta(1), V1, 1, "1", "2", False),
        ("day", "1", FROM, V1, 1, "1", "2", False), ("day", "2", FROM, V1, 1, "1", "2", False),
    )
    got = {}
    for r in policies.invalid_policies(rows).collect():
        got.setdefault(r.policy_id, set()).add(r.rule)
    tolerances, schemas = {"invalid_tolerances"}, {"invalid_schemas"}
    assert got == {
        "order": tolerances, "minus": tolerances, "text": tolerances, "fine": tolerances, "huge": tolerances, "three": {"invalid_minimum_sources"},
        "none": schemas, "twin": schemas, "null": schemas, "open": {"invalid_identity"}, "same": {"repeated_version"}, "day": {"repeated_validity"},
        "unsaid": {"invalid_tolerances", "invalid_minimum_sources", "invalid_schemas", "invalid_revision_rule"},
    }
    asked = spark.createDataFrame(
        [("X", FROM, FROM, "raw", p, FROM) for p in ("good", "order", "same", "unknown", None)],
        "asset_id string, requested_start date, requested_end date, adjustment_mode string, policy_id string, as_of date",
    )
    given = policies.applied(asked, rows)
    assert [(r.policy_key, r.pass_bps) for r in given.requests.collect()] == [("good@1", Decimal("10.0000"))]
    assert sorted(str(r.policy_id) for r in given.violations.collect()) == ["None", "order", "same", "unknown"]


def test_versions_are_looked_up_as_of_the_request(spark):
    days = [FROM + dt.timedelta(30 * k) for k in range(4)]
    rows = table(spark, *[("p", str(k), d, V1, 1, str(k), "50", False) for k, d in enumerate(days)], ("q", "a", days[2], V1, 1, "7", "50", False))
    rng = random.Random(3)
    moments = [(rng.choice(["p", "q"]), FROM + dt.timedelta(rng.randint(-20, 120))) for _ in range(60)] + [("p", days[1]), ("q", None)]
    asked = spark.createDataFrame(
        [(str(n), FROM, FROM, "raw", p, d, str(n)) for n, (p, d) in enumerate(moments)],
        "asset_id string, requested_start date, requested_end date, adjustment_mode string, policy_id string, as_of date, request_id string",
    )
    given = policies.applied(asked, rows)
    want = {}
    for n, (p, d) in enumerate(moments):
        started = [k for k in range(4) if d and days[k] <= d] if p == "p" else ["a"] if d and days[2] <= d else []
        if started:
            want[str(n)] = f"{p}@{started[-1]}"
    assert {r.request_id: r.policy_key for r in given.requests.collect()} == want
    assert {r.request_id for r in given.violations.collect()} == {str(n) for n in range(len(moments))} - set(want)
    hashes = {r.policy_key: r.policy_hash for r in given.requests.collect()}
    assert len(set(hashes.values())) == len(hashes)


def test_two_policies_in_one_job_equal_two_jobs(spark):
    rows = (
        raw("a", at_2={"close": "100.2"}, at_3={"close": "103"}) + raw("b", DAYS[1:]) + raw("a", asset="Y") + raw("b", asset="Y", at_1={"close": "100.6"})
        + raw("solo", asset="Z") + raw("a", asset="S") + raw("old", asset="S")
    )
    bars, sources, sessions, requests = inputs(spark, rows)
    sources = sources.withColumn("schema_version", F.when(F.col("source_id") == "old", "normalized-bar-v0").otherwise(F.col("schema_version")))
    kinds = {
        "lax": quality.QualityPolicy(("normalized-bar-v0", "normalized-bar-v1"), 1, "30", "400", False),
        "strict": quality.QualityPolicy(("normalized-bar-v1",), 2, "10", "50.5", True),
    }
    versions = table(
        spark, *[(k, "1", FROM, list(p.accepted_schemas), p.minimum_sources, p.pass_bps, p.warning_bps, p.revision_blocks) for k, p in kinds.items()]
    )
    named = requests.withColumn("policy_id", F.explode(F.array(*[F.lit(k) for k in kinds]))).withColumn("as_of", F.lit(FROM))
    revised = bars.filter(F.col("source_id") == "a").withColumn("source_id", F.lit("a-2")).withColumn("volume", F.lit("11"))
    pairs = spark.createDataFrame([("Y", "a", "a-2")], "asset_id string, previous_id string, current_id string")
    history = bars.unionByName(revised).filter(F.col("asset_id") == "Y")
    report = policies.policy_report(bars, sources, sessions, named, versions, history, pairs)
    verdicts, checks = {}, {}
    for r in report.eligibility.collect():
        verdicts[r.asset_id, r.policy_key] = (r.blocking_count, r.incomplete_count, r.warning_count, r.status)
    for r in report.check_results.collect():
        checks[r.asset_id, r.request_id.rsplit("/", 1)[1], r.check_id] = (r.finding_count, r.status)
    assert report.violations.count() == 0 and len(verdicts) == 8 and len(checks) == 88
    for kind, policy in kinds.items():
        alone = quality.quality_report(bars, sources, sessions, requests, policy, history, pairs)
        for r in alone.eligibility.collect():
            assert verdicts[r.asset_id, f"{kind}@1"] == (r.blocking_count, r.incomplete_count, r.warning_count, r.status)
        for r in alone.check_results.collect():
            assert checks[r.asset_id, f"{kind}@1", r.check_id] == (r.finding_count, r.status)
    assert verdicts["X", "lax@1"][3] == "eligible" and verdicts["X", "strict@1"][3] == "ineligible"
    assert verdicts["Z", "lax@1"][3] == "eligible" and verdicts["Z", "strict@1"][3] == "incomplete"


def test_tolerance_columns_answer_like_literals(spark):
    cells = ["100", "100.1", "0", "-3", "1e30", "1.0000000001e30", "0.00000001", "99.5", "200000"]
    bounds = ["0", "10", "50.5", "10.0001", "19999.9999", "20000", "879999.9999"]
    pairs = spark.createDataFrame([(a, b) for a in cells for b in cells], "a string, b string").select(
        "a", "b", digits.cell(F.col("a")).alias("x"), digits.cell(F.col("b")).alias("y")
    )
    x, y = F.col("x"), F.col("y")
    asked = pairs.withColumn("t", F.explode(F.array(*[F.lit(t) for t in bounds])))
    by_column = digits.cell_within_symmetric_bps(x, y, F.col("t").cast("decimal(12,4)"))
    got = {(r.a, r.b, r.t): r.close for r in asked.select("a", "b", "t", by_column.alias("close")).collect()}
    for (a, b, t), close in got.items():
        p, q = Decimal(a), Decimal(b)
        assert close == (abs(p - q) * 20_000 <= Decimal(t) * (abs(p) + abs(q))), (a, b, t)
