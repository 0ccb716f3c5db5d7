"""Registered data-quality queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import cross_source, ordering, policies, quality
from barloom.plans import views
from barloom.plans.publish import publish
from barloom.session import materialize

POLICY = quality.QualityPolicy(minimum_sources=2)
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


class Inputs:
    """The quality inputs of one scale directory, built on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        for name in ("quality_bars", "quality_sources", "quality_requests", "weekdays"):
            setattr(self, name.removeprefix("quality_"), partial(getattr(views, name), spark, sf_dir))
        self.revisions = partial(views.revisions, spark, sf_dir)

    def findings(self) -> DataFrame:
        """The findings of all eleven checks, stored like those of a report."""

        def build():
            return quality.all_findings(
                self.bars(), self.sources(), self.weekdays(), self.requests(), POLICY, *self.revisions()
            )

        return views.stored(self.spark, self.sf_dir, "findings", build)


def flat(findings: DataFrame) -> DataFrame:
    return publish(findings.withColumn("source_ids", F.array_join("source_ids", ",")))


def finding_query(name, build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flat(build(Inputs(spark, sf_dir)))

    QUERIES[name] = run


finding_query(
    "dq_schema",
    lambda i: quality.schema_contract(i.bars(), i.sources(), i.requests(), POLICY),
)
finding_query("dq_session", lambda i: quality.session_integrity(i.bars()))
finding_query("dq_ohlc", lambda i: quality.ohlc_integrity(i.bars()))
finding_query("dq_volume", lambda i: quality.volume_integrity(i.bars()))
finding_query("dq_calendar", lambda i: quality.calendar_membership(i.bars(), i.weekdays()))
finding_query(
    "dq_source_coverage", lambda i: quality.source_coverage(i.bars(), i.sources(), i.weekdays())
)
finding_query(
    "dq_range_coverage",
    lambda i: quality.requested_range_coverage(
        i.bars(), i.sources(), i.weekdays(), i.requests(), POLICY
    ),
)
finding_query("dq_overlap", lambda i: quality.cross_source_overlap(i.bars(), i.sources()))
finding_query("dq_cross_ohlc", lambda i: quality.cross_source_ohlc(i.bars(), i.requests(), POLICY))
finding_query("dq_revision", lambda i: quality.provider_revision(*i.revisions()))
finding_query("dq_adjustment", lambda i: quality.adjustment_semantics(i.requests()))


@query
def dq_finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids of the findings of all eleven checks."""
    found = quality.with_finding_id(Inputs(spark, sf_dir).findings())
    return publish(found.select("asset_id", "check_id", "finding_code", "affected_start", "field", "finding_id"))


@query
def dq_findings_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in one total order."""
    found = ordering.ordered_findings(Inputs(spark, sf_dir).findings())
    return publish(found.select("ordinal", "place", "asset_id", "check_id", "finding_code", "affected_start", "affected_end", "finding_id"))


@query
def dq_revision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of observations, one of another endpoint and one of a single capture, and what each sound pair finds."""
    bars, pairs = Inputs(spark, sf_dir).revisions()
    a = F.col("asset_id")
    bars = bars.withColumn("source_id", F.concat_ws(":", a, "source_id"))
    pairs = pairs.withColumns({c: F.concat_ws(":", a, c) for c in ("previous_id", "current_id")})
    observations = pairs.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.col(c).alias("source_id"),
                        F.lit(provider).alias("provider"),
                        F.when((a == "N") & F.lit(c == "current_id"), "weekly").otherwise("daily").alias("endpoint"),
                        a.alias("request_fingerprint"),
                        F.when(a == "R", F.col("previous_id")).otherwise(F.col(c)).alias("evidence_id"),
                    )
                    for c, provider in (("previous_id", "Alpha"), ("current_id", "ALPHA"))
                ]
            )
        )
    )
    wrong = quality.invalid_revision_pairs(pairs, observations).select("asset_id", "rule")
    found = quality.provider_revision(bars, pairs, observations).groupBy("asset_id").agg(F.count(F.lit(1)).alias("findings"))
    return publish(pairs.select("asset_id").join(wrong, "asset_id", "left").join(found, "asset_id", "left").na.fill(0, ["findings"]))


@query
def dq_cross_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    values = quality.cross_source_values(i.bars(), i.requests())
    return publish(
        values.groupBy("asset_id", "left_id", "right_id").agg(
            F.count(F.lit(1)).alias("compared_values"),
            F.max("difference_bps").alias("max_difference_bps"),
        )
    )


@query
def dq_check_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return publish(
        quality.check_results(i.findings(), i.sources(), i.requests(), i.revisions()[1])
    )


@query
def dq_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    return publish(quality.range_eligibility(i.findings(), i.requests(), POLICY))


#: Two versions of one policy, and one whose tolerances contradict each other.
POLICY_ROWS = (
    ("research", "1", "2000-01-01", ["normalized-bar-v1"], 1, "10", "50", False),
    ("research", "2", "2001-01-01", ["normalized-bar-v0", "normalized-bar-v1"], 2, "20", "60.5", True),
    ("broken", "1", "2000-01-01", ["normalized-bar-v1"], 1, "60", "50", False),
)


def policy_inputs(i: Inputs) -> tuple[DataFrame, DataFrame]:
    """Every request under both versions, before the first, and under the broken policy."""
    policy = "policy_id string, version string, valid_from string, accepted_schemas array<string>, minimum_sources int, "
    rows = i.spark.createDataFrame(list(POLICY_ROWS), policy + "pass_bps string, warning_bps string, revision_blocks boolean")
    asked = (("research", "1999-12-31"), ("research", "2000-06-30"), ("research", "2001-06-30"), ("broken", "2001-06-30"))
    named = F.array(*[F.struct(F.lit(p).alias("policy_id"), F.lit(d).cast("date").alias("as_of")) for p, d in asked])
    requests = i.requests()
    return (
        requests.select(*requests.columns, F.inline(named)),
        rows.withColumn("valid_from", F.col("valid_from").cast("date")),
    )


@query
def dq_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of requests under policy versions of their own, and those that no version judges."""
    i = Inputs(spark, sf_dir)
    requests, rows = policy_inputs(i)
    report = policies.policy_report(i.bars(), i.sources(), i.weekdays(), requests, rows, *i.revisions())
    withheld = quality.with_request_id(report.violations).withColumns(
        {"request_id": F.concat_ws("/", "request_id", "policy_id", "as_of"), "status": F.col("rule")}
    )
    return publish(
        report.eligibility.drop("policy_hash").unionByName(
            withheld.select("asset_id", "request_id", "requested_start", "requested_end", "status"), allowMissingColumns=True
        )
    )


@query
def dq_policy_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every check under each policy version."""
    i = Inputs(spark, sf_dir)
    given = policies.applied(*policy_inputs(i)).requests
    bars, pairs = i.revisions()
    found = policies.findings(i.bars(), i.sources(), i.weekdays(), given, bars, pairs)
    return publish(policies.check_results(materialize(found, "policy-findings"), i.sources(), given, pairs))


@query
def dq_range_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that touch each requested range."""
    i = Inputs(spark, sf_dir)
    return publish(quality.range_findings(i.findings(), i.requests(), POLICY))


@query
def dq_dependent_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both observations of the first source are one provider."""
    i = Inputs(spark, sf_dir)
    again = i.sources().withColumn(
        "provider",
        F.when(F.col("asset_id") == "A", F.lit("Alpha")).otherwise(F.col("provider")),
    )
    return publish(quality.dependent_sources(again))


@query
def cross_source_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish(_close_checks(spark, sf_dir))


@query
def cross_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish(cross_source.summarize(_close_checks(spark, sf_dir)))


def _close_checks(spark, sf_dir):
    bars = views.bars_table(spark, sf_dir).withColumn("d", views.day_number())
    d = F.col("d")
    second = bars.filter(d % 41 != 0).withColumn(
        "close", (F.col("close") * (10_000 + (d % 13) * 6) / 10_000).cast("decimal(18,6)")
    )
    return cross_source.compare_close(bars.filter(d % 43 != 0), second)


@query
def dq_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish(quality.observed_ranges(Inputs(spark, sf_dir).bars()))


@query
def dq_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored report of all eleven checks with one kind of finding taken out and one severity softened."""
    i = Inputs(spark, sf_dir)
    honest = i.findings()
    stored = materialize(
        honest.filter(F.col("finding_code") != "non_monotonic_sessions").withColumn(
            "severity",
            F.when(F.col("finding_code") == "negative_volume", "info").otherwise(
                F.col("severity")
            ),
        ),
        "report",
    )
    found = quality.report_differences(stored, honest)
    return publish(found.groupBy("side", "finding_code").agg(F.count(F.lit(1)).alias("n")))
