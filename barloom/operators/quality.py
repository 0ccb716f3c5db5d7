"""Range-scoped quality findings over any number of assets and sources.

Inputs
  bars      asset_id, source_id, row_seq (arrival order from zero), session and the raw text of
            open, high, low, close, volume, so that broken values survive until they are judged
  sources   asset_id, source_id, schema_version, normalizer_id, normalizer_version
  sessions  the expected calendars; bars, sources and requests name theirs in calendar_id where there are several
  requests  asset_id, requested_start, requested_end, adjustment_mode; any number per asset
  revisions asset_id, previous_id, current_id, with the bars of both in ``revision_bars``

Sources are compared, never blended, and every finding names the dates it affects. Findings that hold for one request only
(what it lacks, what it asks for) carry its ``request_id``; all others hold for every request of their asset.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import digits
from barloom.functions.calendar import number_sessions
from barloom.functions.identity import canonical_json, stable_id
from barloom.operators import intervals, segments, session_sets
from barloom.operators.calendars import SESSION_KEY, with_calendar_id
from barloom.schemas import PRICE_FIELDS
from barloom.session import materialize

SERIES = ["asset_id", "source_id"]
ARRIVAL_ROWS = 4096

# Check ids, their version, and what each finding code means for a range.
CHECK_VERSION = "2"
CHECK_IDS = (
    "schema_contract",
    "session_integrity",
    "ohlc_integrity",
    "volume_integrity",
    "calendar_membership",
    "source_coverage",
    "requested_range_coverage",
    "cross_source_overlap",
    "cross_source_ohlc",
    "provider_revision",
    "adjustment_semantics",
)
INELIGIBLE_CODES = (
    "cross_source_field_conflict",
    "duplicate_session",
    "invalid_ohlc",
    "negative_volume",
    "non_finite_field",
    "non_monotonic_sessions",
    "non_positive_price",
    "unexpected_session",
)
INCOMPLETE_CODES = (
    "insufficient_session_coverage",
    "insufficient_source_verification",
    "no_expected_sessions_in_requested_range",
    "unsupported_adjustment_semantics",
    "unsupported_normalized_schema",
)


@dataclass(frozen=True)
class QualityPolicy:
    """Tolerances and requirements; basis points as decimal text."""

    accepted_schemas: tuple[str, ...] = ("normalized-bar-v1",)
    minimum_sources: int = 1
    pass_bps: str = "10"
    warning_bps: str = "50"
    revision_blocks: bool = False

    def __post_init__(self) -> None:
        if not 0 <= float(self.pass_bps) <= float(self.warning_bps):
            raise ValueError("the pass tolerance must not exceed the warning tolerance")
        if self.minimum_sources not in (1, 2):
            raise ValueError("minimum sources per session must be 1 or 2")
        if not self.accepted_schemas or len(set(self.accepted_schemas)) != len(
            self.accepted_schemas
        ):
            raise ValueError("accepted schemas must be distinct and not empty")


def schema_contract(
    bars: DataFrame, sources: DataFrame, requests: DataFrame, policy: QualityPolicy
) -> DataFrame:
    """Sources of an unknown schema, over the dates of their bars; a source without bars is reported to each request."""
    unknown = sources.filter(~F.col("schema_version").isin(*policy.accepted_schemas))
    return unsupported_schemas(unknown.join(delivered_spans(bars), SERIES, "left"), requests)


def delivered_spans(bars: DataFrame) -> DataFrame:
    """First and last session of each source."""
    return bars.groupBy(*SERIES).agg(F.min("session").alias("_first"), F.max("session").alias("_last"))


def unsupported_schemas(unknown: DataFrame, requests: DataFrame) -> DataFrame:
    """Findings on sources that no policy of ``requests`` accepts, given with the span of their bars."""
    asked = with_request_id(requests).select("asset_id", "request_id", "requested_start", "requested_end")
    silent = unknown.filter(F.col("_first").isNull()).join(asked, "asset_id")
    rows = (
        unknown.filter(F.col("_first").isNotNull())
        .withColumn("request_id", F.lit(None).cast("string"))
        .unionByName(silent.withColumns({"_first": F.col("requested_start"), "_last": F.col("requested_end")}), allowMissingColumns=True)
    )
    return _findings(
        rows,
        "schema_contract",
        "error",
        F.lit("unsupported_normalized_schema"),
        F.col("_first"),
        F.col("_last"),
        F.lit("the source's schema version is not among the accepted ones"),
        F.array("source_id"),
        F.struct("normalizer_id", "normalizer_version", "schema_version"),
        request=F.col("request_id"),
    )


def session_integrity(bars: DataFrame) -> DataFrame:
    repeated = (
        bars.groupBy(*SERIES, "session")
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") > 1)
    )
    duplicates = _findings(
        repeated,
        "session_integrity",
        "error",
        F.lit("duplicate_session"),
        F.col("session"),
        F.col("session"),
        F.lit("more than one bar for this session"),
        F.array("source_id"),
        F.struct("count"),
    )
    # Arrival order is cut into runs with one row of overlap: a source of any size, even one
    # that repeats a session without end, never sits in one window partition.
    arrivals = segments.cut_with_halo(
        bars.select(*SERIES, "row_seq", "session"), "row_seq", 1, ARRIVAL_ROWS
    )
    spec = segments.series_window(SERIES, "row_seq", ARRIVAL_ROWS)
    steps = segments.drop_halo(
        arrivals.withColumn("previous", F.lag("session").over(spec)), "row_seq", ARRIVAL_ROWS
    ).filter(F.col("previous") > F.col("session"))
    inversions = _findings(
        steps,
        "session_integrity",
        "error",
        F.lit("non_monotonic_sessions"),
        F.col("session"),
        F.col("previous"),
        F.lit("a bar arrived after one of a later session"),
        F.array("source_id"),
        F.struct(
            _iso("session").alias("current_session"), _iso("previous").alias("previous_session")
        ),
    )
    return duplicates.unionByName(inversions)


def ohlc_integrity(bars: DataFrame) -> DataFrame:
    """Prices that are no number, not above zero or in contradiction; numbers of any length are judged by their digits."""
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in PRICE_FIELDS])
    fields = F.transform(
        texts, lambda t: F.struct(t["field"].alias("field"), t["text"].alias("text"), digits.sign(t["text"]).alias("sign"))
    )
    cells = bars.select(*SERIES, "session", F.inline(fields)).filter(
        F.col("sign").isNull() | (F.col("sign") <= 0)
    )
    lost = F.col("sign").isNull()
    broken = _findings(
        cells,
        "ohlc_integrity",
        "blocker",
        F.when(lost, "non_finite_field").otherwise("non_positive_price"),
        F.col("session"),
        F.col("session"),
        F.when(lost, F.concat("field", F.lit(" is no finite number"))).otherwise(
            F.concat("field", F.lit(" is not above zero"))
        ),
        F.array("source_id"),
        F.struct(F.coalesce("text", F.lit("None")).alias("value")),
        field=F.col("field"),
    )

    def contradicts(keys: Column) -> Column:
        o, h, low, c = (keys[i] for i in range(4))
        numbers = o.isNotNull() & h.isNotNull() & low.isNotNull() & c.isNotNull()
        return numbers & ~((h >= low) & (low <= o) & (o <= h) & (low <= c) & (c <= h))

    # A row in which any of the four is not a number is judged above only.
    short = F.array(*[digits.short(F.col(f)) for f in PRICE_FIELDS])
    keys = F.transform(F.array(*PRICE_FIELDS), lambda t: digits.let(digits.number(t), digits.order_key))
    by_decimals, by_digits = (digits.let(values, contradicts) for values in (short, keys))
    fits = F.lit(True)
    for f in PRICE_FIELDS:
        fits = fits & F.col(f).rlike(digits.SHORT)
    order = _findings(
        bars.filter(F.when(fits, by_decimals).otherwise(by_digits)),
        "ohlc_integrity",
        "blocker",
        F.lit("invalid_ohlc"),
        F.col("session"),
        F.col("session"),
        F.lit("open, high, low and close contradict each other"),
        F.array("source_id"),
        F.struct("close", "high", "low", "open"),
    )
    return broken.unionByName(order)


def volume_integrity(bars: DataFrame) -> DataFrame:
    lost = F.col("_sign").isNull()
    return _findings(
        bars.withColumn("_sign", digits.sign(F.col("volume"))).filter(lost | (F.col("_sign") < 0)),
        "volume_integrity",
        "blocker",
        F.when(lost, "non_finite_field").otherwise("negative_volume"),
        F.col("session"),
        F.col("session"),
        F.when(lost, "the volume is no finite number").otherwise("the volume is below zero"),
        F.array("source_id"),
        F.struct(F.coalesce("volume", F.lit("None")).alias("value")),
        field=F.lit("volume"),
    )


def calendar_membership(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    return _findings(
        with_calendar_id(bars, sessions).join(sessions.select(*SESSION_KEY), [*SESSION_KEY], "left_anti"),
        "calendar_membership",
        "error",
        F.lit("unexpected_session"),
        F.col("session"),
        F.col("session"),
        F.lit("the calendar has no such session"),
        F.array("source_id"),
        F.struct(F.lit(False).alias("calendar_member")),
    )


def source_coverage(bars: DataFrame, sources: DataFrame, sessions: DataFrame) -> DataFrame:
    """Runs of calendar sessions a source lacks, read from the bitmap of those it has."""
    calendar = _numbered(sessions)
    tops = calendar.groupBy("calendar_id").agg(F.max("no").alias("_hi"))
    present = _placed(bars.select(*SERIES, "session", *_calendar_of(bars)), sessions)
    held = session_sets.packed(session_sets.bitmaps(present, SERIES, {"bits": F.lit(True)}), SERIES, ["bits"])
    spans = with_calendar_id(sources, sessions).select(*SERIES, "calendar_id").join(tops, "calendar_id")
    rows = spans.join(held, SERIES, "left").withColumn("bits", _or_empty("bits"))
    low = F.lit(0).cast("long")
    gaps = session_sets.runs(session_sets.bits_between(F.col("bits"), low, F.col("_hi")), "0", low)
    found = _dated(rows.select(*SERIES, "calendar_id", F.inline(gaps)), calendar)
    return _findings(
        found,
        "source_coverage",
        "warning",
        F.lit("source_missing_session"),
        F.col("start"),
        F.col("end"),
        F.lit("no bar of this source for these calendar sessions"),
        F.array("source_id"),
        F.struct(F.col("n").alias("missing_count")),
    )


def requested_range_coverage(
    bars: DataFrame,
    sources: DataFrame,
    sessions: DataFrame,
    requests: DataFrame,
    policy: QualityPolicy | None,
) -> DataFrame:
    """Sessions of each requested range with no source, or with too few.

    The sessions of an asset become two bitmaps, of those with any source and of those with two; every request reads
    its own stretch of the ones it needs, so requests never multiply bars. Without a policy, requests carry
    ``minimum_sources`` of their own.
    """
    calendar = _numbered(sessions)
    ids = sources.groupBy("asset_id").agg(F.array_sort(F.collect_set("source_id")).alias("_ids"))
    minimum = F.col("_minimum")
    days = (
        _placed(bars.select(*SERIES, "session", *_calendar_of(bars)), sessions)
        .select(*SERIES, "no")
        .distinct()
        .groupBy("asset_id", "no")
        .agg(F.count(F.lit(1)).alias("_sources"))
    )
    sets = session_sets.bitmaps(days, ["asset_id"], {"_any": F.lit(True), "_two": F.col("_sources") >= 2})
    held = session_sets.packed(sets, ["asset_id"], ["_any", "_two"])
    wanted = F.col("minimum_sources").cast("int") if policy is None else F.lit(policy.minimum_sources)
    ranges = requested_positions(requests, sessions).join(ids, "asset_id").withColumn("_minimum", wanted)
    empty = _findings(
        ranges.filter(F.col("_lo") > F.col("_hi")),
        "requested_range_coverage",
        "error",
        F.lit("no_expected_sessions_in_requested_range"),
        F.col("requested_start"),
        F.col("requested_end"),
        F.lit("the calendar has no session in this range"),
        F.col("_ids"),
        F.struct(minimum.alias("minimum_sources")),
        request=F.col("request_id"),
    )
    low, high = F.col("_lo"), F.col("_hi")
    rows = ranges.filter(low <= high).join(held, "asset_id", "left")
    enough_sources = F.when(minimum > 1, _or_empty("_two")).otherwise(_or_empty("_any"))
    # "0": no source, "1": some, "2": enough.
    states = F.zip_with(
        session_sets.bits_between(_or_empty("_any"), low, high),
        session_sets.bits_between(enough_sources, low, high),
        lambda some, enough: F.when(enough == "1", "2").otherwise(some),
    )
    def of_kind(held_states: Column, state: str, code: str) -> Column:
        def described(r: Column) -> Column:
            return F.struct(r["a"].alias("a"), r["b"].alias("b"), r["n"].alias("n"), F.lit(code).alias("code"), F.lit(int(state)).cast("long").alias("observed"))

        return F.transform(session_sets.runs(held_states, state, low), described)

    def every(held_states: Column) -> Column:
        return F.concat(
            of_kind(held_states, "0", "insufficient_session_coverage"),
            of_kind(held_states, "1", "insufficient_source_verification"),
        )

    short_runs = F.transform(F.array(states), every)[0]
    gaps = rows.select("asset_id", "request_id", "calendar_id", "_ids", "_minimum", F.inline(short_runs))
    short = _findings(
        _dated(gaps, calendar),
        "requested_range_coverage",
        "error",
        F.col("code"),
        F.col("start"),
        F.col("end"),
        F.lit("fewer sources than required for these sessions"),
        F.col("_ids"),
        F.struct(
            minimum.alias("minimum_sources"),
            F.col("n").alias("missing_count"),
            F.col("observed").alias("observed_min_sources"),
        ),
        request=F.col("request_id"),
    )
    return empty.unionByName(short)


def cross_source_overlap(bars: DataFrame, sources: DataFrame) -> DataFrame:
    """Sessions one source has and another lacks, for every pair of an asset's sources.

    An asset has a handful of independent sources; each session lists the ones present and is
    paired with the ones absent.
    """
    everyone = sources.groupBy("asset_id").agg(F.collect_set("source_id").alias("_all"))
    present = (
        bars.select(*SERIES, "session")
        .distinct()
        .groupBy("asset_id", "session")
        .agg(F.collect_set("source_id").alias("_present"))
        .join(everyone, "asset_id")
        .withColumn("_absent", F.array_except("_all", "_present"))
        .filter(F.size("_absent") > 0)
    )
    pairs = present.select(
        "asset_id", "session", "_present", F.explode("_absent").alias("missing_from")
    ).select("asset_id", "session", "missing_from", F.explode("_present").alias("_other"))
    return _findings(
        pairs,
        "cross_source_overlap",
        "warning",
        F.lit("cross_source_session_missing"),
        F.col("session"),
        F.col("session"),
        F.lit("only one of the two sources has these sessions"),
        F.array("missing_from", "_other"),
        F.struct("missing_from"),
    )


def cross_source_values(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """Every comparable price of every source pair with its symmetric difference; ``left`` and ``right`` are cells.

    Only raw series are comparable.
    """
    raw = requests.filter(F.col("adjustment_mode") == "raw").select("asset_id")
    bar = stable_bars(bars.join(raw, "asset_id", "left_semi"))
    left = bar.select(
        "asset_id",
        "session",
        F.col("source_id").alias("left_id"),
        *[F.col(f"bar.{f}").alias(f"l_{f}") for f in PRICE_FIELDS],
    )
    right = bar.select(
        "asset_id",
        "session",
        F.col("source_id").alias("right_id"),
        *[F.col(f"bar.{f}").alias(f"r_{f}") for f in PRICE_FIELDS],
    )
    texts = F.array(
        *[
            F.struct(F.lit(f).alias("field"), F.array(f"l_{f}", f"r_{f}").alias("sides"))
            for f in PRICE_FIELDS
        ]
    )
    read = F.transform(
        texts, lambda t: F.struct(t["field"].alias("field"), F.transform(t["sides"], digits.cell).alias("sides"))
    )
    cells = F.transform(
        read, lambda t: F.struct(t["field"].alias("field"), t["sides"][0].alias("left"), t["sides"][1].alias("right"))
    )
    joined = left.join(right, ["asset_id", "session"]).filter(F.col("left_id") < F.col("right_id"))
    return (
        joined.select("asset_id", "session", "left_id", "right_id", F.inline(cells))
        .filter(F.col("left").isNotNull() & F.col("right").isNotNull())
        .filter((digits.cell_sign(F.col("left")) != 0) | (digits.cell_sign(F.col("right")) != 0))
        .withColumn("difference_bps", digits.cell_symmetric_bps(F.col("left"), F.col("right")))
    )


def cross_source_ohlc(bars: DataFrame, requests: DataFrame, policy: QualityPolicy) -> DataFrame:
    values = cross_source_values(bars, requests)
    left, right = F.col("left"), F.col("right")
    apart = values.filter(~digits.cell_within_symmetric_bps(left, right, policy.pass_bps)).withColumn(
        "_mild", digits.cell_within_symmetric_bps(left, right, policy.warning_bps)
    )
    return source_conflicts(apart)


def source_conflicts(apart: DataFrame) -> DataFrame:
    """Findings on pairs of cells further apart than allowed; ``_mild`` ones only warn."""
    left, right, mild = F.col("left"), F.col("right"), F.col("_mild")
    return _findings(
        apart,
        "cross_source_ohlc",
        F.when(mild, "warning").otherwise("error"),
        F.when(mild, "cross_source_field_warning").otherwise("cross_source_field_conflict"),
        F.col("session"),
        F.col("session"),
        F.lit("the sources differ by more than the policy allows"),
        F.array("left_id", "right_id"),
        F.struct(
            F.format_string("%.6f", F.col("difference_bps")).alias("difference_bps"),
            digits.cell_canonical(left).alias("left"),
            digits.cell_canonical(right).alias("right"),
        ),
        field=F.col("field"),
    )


def provider_revision(
    revision_bars: DataFrame, revisions: DataFrame, observations: DataFrame | None = None
) -> DataFrame:
    """Sessions whose values differ between two observations of the same request.

    With ``observations``, pairs that are not two observations of one request are left out; :func:`invalid_revision_pairs`
    says which and why.
    """
    if observations is not None:
        wrong = invalid_revision_pairs(revisions, observations).drop("rule")
        revisions = revisions.join(wrong, ["asset_id", "previous_id", "current_id"], "left_anti")
    bar = stable_bars(revision_bars)
    fields = (*PRICE_FIELDS, "volume")

    def side(role: str) -> DataFrame:
        other = "current_id" if role == "previous_id" else "previous_id"
        return bar.join(
            revisions.select("asset_id", F.col(role).alias("source_id"), F.col(other)), SERIES
        ).select(
            "asset_id",
            F.col("source_id").alias(role),
            other,
            "session",
            F.col("bar").alias(f"_{role}"),
        )

    keys = ["asset_id", "previous_id", "current_id", "session"]
    both = side("previous_id").join(side("current_id"), keys, "full_outer")
    before, after = F.col("_previous_id"), F.col("_current_id")
    changed = F.when(before.isNull() | after.isNull(), F.array(F.lit("session_presence"))).otherwise(
        F.array_compact(
            F.array(
                *[
                    F.when(~_same_number(before[f], after[f]), F.lit(f))
                    for f in fields
                ]
            )
        )
    )
    return _findings(
        both.withColumn("changed_fields", changed).filter(F.size("changed_fields") > 0),
        "provider_revision",
        "warning",
        F.lit("provider_history_revision"),
        F.col("session"),
        F.col("session"),
        F.lit("a later observation of the same request differs"),
        F.array("previous_id", "current_id"),
        F.struct(
            "changed_fields",
            F.col("current_id").alias("current_capture"),
            F.col("previous_id").alias("previous_capture"),
        ),
    )


def adjustment_semantics(requests: DataFrame) -> DataFrame:
    return _findings(
        with_request_id(requests).filter(F.col("adjustment_mode") != "raw"),
        "adjustment_semantics",
        "error",
        F.lit("unsupported_adjustment_semantics"),
        F.col("requested_start"),
        F.col("requested_end"),
        F.lit("adjusted prices are not supported as they can change afterwards"),
        F.array().cast("array<string>"),
        F.struct("adjustment_mode"),
        request=F.col("request_id"),
    )


@dataclass(frozen=True)
class QualityReport:
    findings: DataFrame
    check_results: DataFrame
    eligibility: DataFrame


def all_findings(
    bars: DataFrame,
    sources: DataFrame,
    sessions: DataFrame,
    requests: DataFrame,
    policy: QualityPolicy,
    revision_bars: DataFrame | None = None,
    revisions: DataFrame | None = None,
) -> DataFrame:
    """The findings of all eleven checks."""
    return union_all(
        [
            schema_contract(bars, sources, requests, policy),
            requested_range_coverage(bars, sources, sessions, requests, policy),
            cross_source_ohlc(bars, requests, policy),
            *policy_free_findings(bars, sources, sessions, requests, revision_bars, revisions),
        ]
    )


def policy_free_findings(
    bars: DataFrame,
    sources: DataFrame,
    sessions: DataFrame,
    requests: DataFrame,
    revision_bars: DataFrame | None = None,
    revisions: DataFrame | None = None,
) -> list[DataFrame]:
    """Findings of the checks that are the same under every policy."""
    parts = [
        session_integrity(bars),
        ohlc_integrity(bars),
        volume_integrity(bars),
        calendar_membership(bars, sessions),
        source_coverage(bars, sources, sessions),
        cross_source_overlap(bars, sources),
        adjustment_semantics(requests),
    ]
    if revisions is not None:
        parts.append(provider_revision(revision_bars, revisions))
    return parts


def union_all(parts: list[DataFrame]) -> DataFrame:
    while len(parts) > 1:  # pairwise, so that no plan is analysed more than log(n) times
        parts = [
            parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i]
            for i in range(0, len(parts), 2)
        ]
    return parts[0]


def check_results(
    findings: DataFrame,
    sources: DataFrame,
    requests: DataFrame,
    revisions: DataFrame | None = None,
) -> DataFrame:
    """Status of each of the eleven checks per request; checks without findings appear too.

    Hard findings fail a check unless all of them only make it incomplete.
    """
    hard = F.col("severity").isin("error", "blocker")
    grades = {
        "_count": F.lit(1),
        "_fails": F.when(hard & ~F.col("finding_code").isin(*INCOMPLETE_CODES), 1).otherwise(0),
        "_hard": F.when(hard, 1).otherwise(0),
        "_warns": F.when(F.col("severity") == "warning", 1).otherwise(0),
    }

    def graded(rows: DataFrame, suffix: str, *keys: str) -> DataFrame:
        return rows.groupBy("asset_id", *keys, "check_id").agg(*[F.sum(v).alias(f"{k}{suffix}") for k, v in grades.items()])

    shared = graded(findings.filter(F.col("request_id").isNull()), "")
    own = graded(findings.filter(F.col("request_id").isNotNull()), "_own", "request_id")
    scope = with_request_id(requests).select("asset_id", "request_id", "adjustment_mode").distinct().join(
        sources.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_sources")), "asset_id", "left"
    )
    if revisions is None:
        scope = scope.withColumn("_revisions", F.lit(0))
    else:
        scope = scope.join(
            revisions.groupBy("asset_id").agg(F.count(F.lit(1)).alias("_revisions")),
            "asset_id",
            "left",
        )
    every = scope.select(
        "*", F.explode(F.array(*[F.lit(c) for c in CHECK_IDS])).alias("check_id")
    )
    check = F.col("check_id")
    idle = (
        (check.isin("cross_source_overlap", "cross_source_ohlc") & (F.coalesce("_sources", F.lit(0)) < 2))
        | ((check == "cross_source_ohlc") & (F.col("adjustment_mode") != "raw"))
        | ((check == "provider_revision") & (F.coalesce("_revisions", F.lit(0)) == 0))
    )
    joined = every.join(shared, ["asset_id", "check_id"], "left").join(own, ["asset_id", "request_id", "check_id"], "left")
    total = {k: F.coalesce(k, F.lit(0)) + F.coalesce(f"{k}_own", F.lit(0)) for k in grades}
    return joined.select(
        "asset_id",
        "request_id",
        "check_id",
        F.when(idle, 0).otherwise(total["_count"]).alias("finding_count"),
        F.when(idle, "not_applicable")
        .when(total["_fails"] > 0, "fail")
        .when(total["_hard"] > 0, "incomplete")
        .when(total["_warns"] > 0, "warning")
        .otherwise("pass")
        .alias("status"),
    )


EFFECTS = ("blocking", "incomplete", "warning")


def _with_effect(findings: DataFrame, policy: QualityPolicy) -> DataFrame:
    """Distinct findings that matter for a range, and what they do to it."""
    code = F.col("finding_code")
    incomplete = code.isin(*INCOMPLETE_CODES)
    if policy.revision_blocks:
        incomplete = incomplete | (code == "provider_history_revision")
    effect = (
        F.when(code.isin(*INELIGIBLE_CODES), "blocking")
        .when(incomplete, "incomplete")
        .when(F.col("severity") != "info", "warning")
    )
    # Prices of adjusted series are not compared, so such requests leave those findings out.
    raw_only = F.col("check_id") == "cross_source_ohlc"
    return (
        with_finding_id(findings)
        .select("asset_id", "request_id", "finding_id", "affected_start", "affected_end", effect.alias("effect"), raw_only.alias("_raw_only"))
        .filter(F.col("effect").isNotNull())
        .distinct()
    )


def range_findings(findings: DataFrame, requests: DataFrame, policy: QualityPolicy) -> DataFrame:
    """(asset_id, request_id, finding_id, effect): the findings behind each request's verdict, by a binned interval join."""
    judged = _with_effect(findings, policy)
    asked = with_request_id(requests).distinct().select(
        "asset_id", "request_id", "adjustment_mode", F.col("requested_start").alias("start"), F.col("requested_end").alias("end")
    )
    ranged = judged.withColumnsRenamed({"affected_start": "start", "affected_end": "end"})
    pairs = intervals.overlapping(ranged, asked, ["asset_id"])
    own = F.col("left.request_id").isNull() | (F.col("left.request_id") == F.col("right.request_id"))
    compared = ~F.col("left._raw_only") | (F.col("right.adjustment_mode") == "raw")
    return pairs.filter(own & compared).select("asset_id", "right.request_id", "left.finding_id", "left.effect").distinct()



def range_eligibility(
    findings: DataFrame, requests: DataFrame, policy: QualityPolicy
) -> DataFrame:
    """Verdict per requested range from the distinct findings that touch it.

    Findings and requests never meet in pairs: those that touch a range are the ones that start by its end less the ones
    that end before its start, two running counts over the dates of an asset. One row per asset and date is all
    that a window holds, however many findings or requests an asset has.
    """
    judged = _with_effect(findings, policy)
    asked = with_request_id(requests).distinct()
    sums = {
        f"{e}{suffix}": (F.col("effect") == e) & (F.col("_raw_only") | F.lit(suffix == ""))
        for e in EFFECTS
        for suffix in ("", "_raw")
    }
    shared = judged.filter(F.col("request_id").isNull())

    def running(day: str, point: str, name: str, *, before: bool) -> DataFrame:
        """Counts of findings by their ``day``, up to every date that some request has as ``point``."""
        daily = shared.groupBy("asset_id", F.col(day).alias("_day")).agg(
            *[F.count_if(hit).alias(c) for c, hit in sums.items()]
        )
        points = asked.select("asset_id", F.col(point).alias("_day")).distinct()
        every = daily.unionByName(points, allowMissingColumns=True).groupBy("asset_id", "_day").agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
        )
        so_far = Window.partitionBy("asset_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
        return every.select(
            "asset_id", F.col("_day").alias(point), *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(f"{c}_{name}") for c in sums]
        )

    started = running("affected_start", "requested_end", "started", before=False)
    ended = running("affected_end", "requested_start", "ended", before=True)
    own = (
        judged.filter(F.col("request_id").isNotNull())
        .join(asked.select("asset_id", "request_id", "requested_start", "requested_end"), ["asset_id", "request_id"])
        .filter((F.col("affected_start") <= F.col("requested_end")) & (F.col("requested_start") <= F.col("affected_end")))
        .groupBy("asset_id", "request_id")
        .agg(*[F.count_if(F.col("effect") == e).alias(f"{e}_own") for e in EFFECTS])
    )
    joined = (
        asked.join(started, ["asset_id", "requested_end"])
        .join(ended, ["asset_id", "requested_start"])
        .join(own, ["asset_id", "request_id"], "left")
    )

    def touching(effect: str) -> Column:
        every, raw = (F.col(f"{effect}{s}_started") - F.col(f"{effect}{s}_ended") for s in ("", "_raw"))
        compared = F.when(F.col("adjustment_mode") == "raw", 0).otherwise(raw)
        return every - compared + F.coalesce(f"{effect}_own", F.lit(0))

    counted = joined.select(
        "asset_id", "request_id", "requested_start", "requested_end", *[touching(e).alias(f"{e}_count") for e in EFFECTS]
    )
    return counted.withColumn("status", verdict())


def verdict() -> Column:
    """Of the counts of a range: blocking precedes incomplete, warnings do not decide."""
    return (
        F.when(F.col("blocking_count") > 0, "ineligible")
        .when(F.col("incomplete_count") > 0, "incomplete")
        .otherwise("eligible")
    )


def quality_report(
    bars: DataFrame,
    sources: DataFrame,
    sessions: DataFrame,
    requests: DataFrame,
    policy: QualityPolicy,
    revision_bars: DataFrame | None = None,
    revisions: DataFrame | None = None,
) -> QualityReport:
    """Findings, check results and eligibility of all requested ranges."""
    # Three consumers: store the findings once instead of running eleven checks three times.
    found = materialize(
        all_findings(bars, sources, sessions, requests, policy, revision_bars, revisions),
        "findings",
    )
    return QualityReport(
        found,
        check_results(found, sources, requests, revisions),
        range_eligibility(found, requests, policy),
    )


def report_differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Replay check: rows of either side the other lacks; empty when the report holds."""
    return (
        stored.exceptAll(recomputed)
        .withColumn("side", F.lit("stored_only"))
        .unionByName(recomputed.exceptAll(stored).withColumn("side", F.lit("recomputed_only")))
    )


def observed_ranges(bars: DataFrame) -> DataFrame:
    """What each source delivered: first and last session, rows, distinct sessions."""
    days = bars.groupBy(*SERIES, "session").agg(F.count(F.lit(1)).alias("n"))
    return days.groupBy(*SERIES).agg(
        F.min("session").alias("observed_start"),
        F.max("session").alias("observed_end"),
        F.sum("n").alias("bar_count"),
        F.count(F.lit(1)).alias("session_count"),
    )


def dependent_sources(sources: DataFrame) -> DataFrame:
    """Providers that occur more than once per asset, ignoring case."""
    return (
        sources.groupBy("asset_id", F.lower("provider").alias("provider"))
        .agg(F.count(F.lit(1)).alias("source_count"))
        .filter(F.col("source_count") > 1)
    )


def invalid_revision_pairs(pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """Pairs that are not two different observations of one provider request.

    ``observations`` has source_id, provider, endpoint, request_fingerprint, evidence_id.
    """

    def side(name: str) -> DataFrame:
        return observations.select(
            F.col("source_id").alias(f"{name}_id"),
            F.struct(
                F.lower("provider").alias("provider"), "endpoint", "request_fingerprint"
            ).alias(f"_{name}_request"),
            F.col("evidence_id").alias(f"_{name}_evidence"),
        )

    joined = pairs.join(side("previous"), "previous_id", "left").join(
        side("current"), "current_id", "left"
    )
    reason = F.when(
        ~F.col("_previous_request").eqNullSafe(F.col("_current_request"))
        | F.col("_previous_request").isNull(),
        "different_request",
    ).when(F.col("_previous_evidence") == F.col("_current_evidence"), "same_observation")
    return joined.select("asset_id", "previous_id", "current_id", reason.alias("rule")).filter(
        F.col("rule").isNotNull()
    )


def with_finding_id(findings: DataFrame) -> DataFrame:
    """Add the content id of each finding."""
    payload = F.concat(
        F.lit('{"affected_end":"'),
        _iso("affected_end"),
        F.lit('","affected_start":"'),
        _iso("affected_start"),
        F.lit('","check_id":"'),
        F.col("check_id"),
        F.lit(f'","check_version":"{CHECK_VERSION}","field":'),
        F.coalesce(F.concat(F.lit('"'), "field", F.lit('"')), F.lit("null")),
        F.lit(',"finding_code":"'),
        F.col("finding_code"),
        F.lit('","message":"'),
        F.col("message"),
        F.lit('","observed_values":'),
        F.col("observed"),
        F.lit(',"severity":"'),
        F.col("severity"),
        F.lit('","source_evidence_ids":'),
        F.to_json("source_ids"),
        F.lit("}"),
    )
    return findings.withColumn("finding_id", stable_id("dqf", payload))


def stable_bars(bars: DataFrame) -> DataFrame:
    """One bar per series and session; of duplicates the first in text order.

    A minimum over a struct combines before the shuffle, so a session repeated a billion times
    stays cheap.
    """
    return bars.groupBy(*SERIES, "session").agg(
        F.min(F.struct(*PRICE_FIELDS, "volume")).alias("bar")
    )


def with_request_id(requests: DataFrame) -> DataFrame:
    """Requests with an id of their own inside their asset."""
    if "request_id" in requests.columns:
        return requests
    return requests.withColumn("request_id", F.concat_ws("/", _iso("requested_start"), _iso("requested_end"), "adjustment_mode"))


def requested_positions(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Positions of each requested range in its calendar; ``_lo > _hi`` when it holds no session."""
    numbered = number_sessions(sessions)
    spans = numbered.groupBy("calendar_id").agg(
        F.min("session").alias("_first"), F.max("session").alias("_last"), F.max("session_no").alias("_top")
    )
    days = numbered.select(
        "calendar_id",
        F.col("session_no"),
        F.col("session"),
        F.explode(
            F.sequence("session", F.coalesce(F.date_add("next_session", -1), "session"))
        ).alias("_day"),
    )
    start = days.select(
        "calendar_id",
        F.col("_day").alias("_from"),
        F.when(F.col("_day") == F.col("session"), F.col("session_no"))
        .otherwise(F.col("session_no") + 1)
        .alias("_lo"),
    )
    end = days.select("calendar_id", F.col("_day").alias("_to"), F.col("session_no").alias("_hi"))
    keyed = with_calendar_id(with_request_id(requests), sessions)
    clamped = keyed.join(spans, "calendar_id", "left").withColumns(
        {
            "_from": F.greatest("requested_start", "_first"),
            "_to": F.least("requested_end", "_last"),
        }
    )
    return (
        clamped.join(start, ["calendar_id", "_from"], "left")
        .join(end, ["calendar_id", "_to"], "left")
        .select(
            *keyed.columns,
            F.coalesce("_lo", F.col("_top") + 1, F.lit(0)).alias("_lo"),
            F.coalesce("_hi", F.lit(-1)).alias("_hi"),
        )
    )


def _numbered(sessions: DataFrame) -> DataFrame:
    return number_sessions(sessions).select("calendar_id", "session", F.col("session_no").alias("no"))


def _calendar_of(rows: DataFrame) -> list[str]:
    return ["calendar_id"] if "calendar_id" in rows.columns else []


def _placed(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows on sessions of their calendar, with the position ``no``."""
    return with_calendar_id(rows, sessions).join(_numbered(sessions), [*SESSION_KEY])


def _or_empty(name: str) -> Column:
    """The bitmaps of an asset, none for one without bars."""
    return F.coalesce(F.col(name), F.create_map().cast("map<bigint,binary>"))


def _dated(gaps: DataFrame, calendar: DataFrame) -> DataFrame:
    first = calendar.select("calendar_id", F.col("no").alias("a"), F.col("session").alias("start"))
    last = calendar.select("calendar_id", F.col("no").alias("b"), F.col("session").alias("end"))
    return gaps.join(first, ["calendar_id", "a"]).join(last, ["calendar_id", "b"]).drop("a", "b")


def _same_number(a: Column, b: Column) -> Column:
    """Equal as numbers where both are, else equal as text."""
    return F.coalesce(digits.same(a, b), a.eqNullSafe(b))


def _iso(column: str) -> Column:
    return F.date_format(F.col(column), "yyyy-MM-dd")


def _findings(
    rows: DataFrame,
    check_id: str,
    severity: str | Column,
    code: Column,
    start: Column,
    end: Column,
    message: Column,
    source_ids: Column,
    observed: Column,
    *,
    field: Column | None = None,
    request: Column | None = None,
) -> DataFrame:
    return rows.select(
        "asset_id",
        (F.lit(None).cast("string") if request is None else request).alias("request_id"),
        F.lit(check_id).alias("check_id"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        code.alias("finding_code"),
        start.alias("affected_start"),
        end.alias("affected_end"),
        (F.lit(None).cast("string") if field is None else field).alias("field"),
        F.array_sort(source_ids).alias("source_ids"),
        canonical_json(observed).alias("observed"),
        message.alias("message"),
    )
