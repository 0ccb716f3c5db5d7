"""SQL of the data-quality queries."""

from __future__ import annotations

from barloom.plans.oracle import LINES, day, num, oracle

Q = f"""{LINES},
base AS (SELECT *, session - DATE '1995-01-01' AS d FROM bars_all),
alpha AS (
  SELECT asset_id, 'alpha' AS source_id, session, d, copy,
         CASE WHEN d % 211 = 0 THEN 'NaN' ELSE CAST(open AS VARCHAR) END AS open,
         CASE WHEN d % 227 = 0 THEN CAST(CAST(low - 1 AS DECIMAL(18,6)) AS VARCHAR)
              WHEN d % 239 = 0 THEN '1234567890123.5' WHEN d % 241 = 0 THEN repeat('1234567890', 6) || '123.5' ELSE CAST(high AS VARCHAR) END AS high,
         CASE WHEN d % 223 = 0 THEN '-1' WHEN d % 251 = 0 THEN '0.0000001' ELSE CAST(low AS VARCHAR) END AS low,
         CAST(close AS VARCHAR) AS close,
         CASE WHEN d % 229 = 0 THEN '-5' WHEN d % 233 = 0 THEN 'n/a'
              WHEN d % 257 = 0 THEN repeat('1234567890', 6) || '123.5' ELSE CAST(CAST(volume AS DECIMAL(24,6)) AS VARCHAR) END AS volume
  FROM base, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR d % 101 = 0
),
beta AS (
  SELECT asset_id, 'beta' AS source_id, session, d, 0 AS copy, CAST(open AS VARCHAR) AS open, CAST(high AS VARCHAR) AS high,
         CAST(low AS VARCHAR) AS low,
         CAST(CAST(close * CAST(10000 + (d % 13) * 6 AS DECIMAL(6,0)) * 0.0001 AS DECIMAL(18,6)) AS VARCHAR) AS close,
         CAST(CAST(volume AS DECIMAL(24,6)) AS VARCHAR) AS volume
  FROM base WHERE d % 41 <> 0
),
q AS (
  SELECT *, row_number() OVER (PARTITION BY asset_id, source_id
           ORDER BY session + CASE WHEN d % 103 = 0 THEN 3 ELSE 0 END, session, copy) - 1 AS row_seq
  FROM (SELECT * FROM alpha UNION ALL SELECT * FROM beta)
),
assets AS (SELECT DISTINCT asset_id FROM base),
sources AS (
  SELECT asset_id, source_id, upper(source_id) AS provider,
         CASE WHEN asset_id = 'N' AND source_id = 'beta' THEN 'normalized-bar-v0' ELSE 'normalized-bar-v1' END AS schema_version
  FROM assets, (VALUES ('alpha'), ('beta')) s(source_id)
),
requests AS (
  SELECT *, strftime(requested_start, '%Y-%m-%d') || '/' || strftime(requested_end, '%Y-%m-%d') || '/' || adjustment_mode AS request_id FROM (
    SELECT asset_id, DATE '1996-02-03' AS requested_start, DATE '2000-11-30' AS requested_end,
           CASE WHEN asset_id = 'R' THEN 'split_adjusted' ELSE 'raw' END AS adjustment_mode FROM assets
    UNION ALL SELECT asset_id, DATE '1997-06-10', DATE '1997-08-15', 'raw' FROM assets
    UNION ALL SELECT asset_id, DATE '1996-02-03', DATE '1996-02-04', 'raw' FROM assets WHERE asset_id = 'A')
),
weekdays AS (
  SELECT CAST(u AS DATE) AS session FROM (SELECT unnest(generate_series(min(session), max(session), INTERVAL 1 DAY)) AS u FROM base)
  WHERE isodow(u) < 6
),
numbered AS (SELECT session, row_number() OVER (ORDER BY session) AS no FROM weekdays)"""


def finding(check, severity, code, start, end, field, ids, observed, message, source, request="CAST(NULL AS VARCHAR)"):
    """One finding relation; arguments are SQL expressions."""
    return f"""
SELECT asset_id, {request} AS request_id, '{check}' AS check_id, {severity} AS severity, {code} AS finding_code, {start} AS affected_start,
       {end} AS affected_end, {field} AS field, {ids} AS source_ids, {observed} AS observed, {message} AS message
FROM {source}"""


SCHEMA = finding(
    "schema_contract", "'error'", "'unsupported_normalized_schema'", "a", "b", "CAST(NULL AS VARCHAR)", "source_id",
    "'{\"normalizer_id\":\"daily\",\"normalizer_version\":\"1\",\"schema_version\":\"' || schema_version || '\"}'",
    "'the source''s schema version is not among the accepted ones'",
    """(SELECT s.*,
        (SELECT min(session) FROM q WHERE q.asset_id = s.asset_id AND q.source_id = s.source_id) AS a,
        (SELECT max(session) FROM q WHERE q.asset_id = s.asset_id AND q.source_id = s.source_id) AS b
        FROM sources s WHERE s.schema_version <> 'normalized-bar-v1')""",
)
SESSION = (
    finding(
        "session_integrity", "'error'", "'duplicate_session'", "session", "session", "CAST(NULL AS VARCHAR)",
        "source_id", "'{\"count\":' || n || '}'", "'more than one bar for this session'",
        "(SELECT asset_id, source_id, session, count(*) AS n FROM q GROUP BY ALL HAVING count(*) > 1)",
    )
    + " UNION ALL "
    + finding(
        "session_integrity", "'error'", "'non_monotonic_sessions'", "session", "previous",
        "CAST(NULL AS VARCHAR)", "source_id",
        f"'{{\"current_session\":\"' || {day('session')} || '\",\"previous_session\":\"' || {day('previous')} || '\"}}'",
        "'a bar arrived after one of a later session'",
        "(SELECT *, lag(session) OVER (PARTITION BY asset_id, source_id ORDER BY row_seq) AS previous FROM q) WHERE previous > session",
    )
)
# The planted cell of 64 digits exceeds every price and every tolerance, as 10^17 does, which still fits.
TRY = "CASE WHEN {0} = 'NaN' THEN NULL WHEN length({0}) > 60 THEN CAST(100000000000000000 AS DECIMAL(27,9)) ELSE TRY_CAST({0} AS DECIMAL(27,9)) END"
CELLS = " UNION ALL ".join(
    f"SELECT asset_id, source_id, session, '{f}' AS field, {f} AS text, {TRY.format(f)} AS number FROM q"
    for f in ("open", "high", "low", "close")
)
OHLC = (
    finding(
        "ohlc_integrity", "'blocker'", "CASE WHEN number IS NULL THEN 'non_finite_field' ELSE 'non_positive_price' END",
        "session", "session", "field", "source_id", "'{\"value\":\"' || text || '\"}'",
        "field || CASE WHEN number IS NULL THEN ' is no finite number' ELSE ' is not above zero' END",
        f"({CELLS}) WHERE number IS NULL OR number <= 0",
    )
    + " UNION ALL "
    + finding(
        "ohlc_integrity", "'blocker'", "'invalid_ohlc'", "session", "session", "CAST(NULL AS VARCHAR)", "source_id",
        "'{\"close\":\"' || close || '\",\"high\":\"' || high || '\",\"low\":\"' || low || '\",\"open\":\"' || open || '\"}'",
        "'open, high, low and close contradict each other'",
        f"""(SELECT *, {TRY.format('open')} AS o, {TRY.format('high')} AS h, {TRY.format('low')} AS l, {TRY.format('close')} AS c FROM q)
        WHERE o IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL
          AND NOT (h >= l AND l <= o AND o <= h AND l <= c AND c <= h)""",
    )
)
VOLUME = finding(
    "volume_integrity", "'blocker'", "CASE WHEN v IS NULL THEN 'non_finite_field' ELSE 'negative_volume' END",
    "session", "session", "'volume'", "source_id", "'{\"value\":\"' || volume || '\"}'",
    "CASE WHEN v IS NULL THEN 'the volume is no finite number' ELSE 'the volume is below zero' END",
    "(SELECT *, TRY_CAST(left(volume, 15) AS DECIMAL(24,6)) AS v FROM q) WHERE v IS NULL OR v < 0",
)
CALENDAR = finding(
    "calendar_membership", "'error'", "'unexpected_session'", "session", "session", "CAST(NULL AS VARCHAR)",
    "source_id", "'{\"calendar_member\":false}'", "'the calendar has no such session'",
    "q WHERE session NOT IN (SELECT session FROM weekdays)",
)
SOURCE_COVERAGE = finding(
    "source_coverage", "'warning'", "'source_missing_session'", "min(session)", "max(session)",
    "CAST(NULL AS VARCHAR)", "source_id", "'{\"missing_count\":' || count(*) || '}'",
    "'no bar of this source for these calendar sessions'",
    """(SELECT s.asset_id, s.source_id, n.session, n.no - row_number() OVER (PARTITION BY s.asset_id, s.source_id ORDER BY n.no) AS island
        FROM sources s CROSS JOIN numbered n
        WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.asset_id = s.asset_id AND q.source_id = s.source_id AND q.session = n.session))
        GROUP BY asset_id, source_id, island""",
)
RANGE_COVERAGE = finding(
    "requested_range_coverage", "'error'", "code", "min(session)", "max(session)", "CAST(NULL AS VARCHAR)",
    "'alpha,beta'",
    "'{\"minimum_sources\":2,\"missing_count\":' || count(*) || ',\"observed_min_sources\":' || min(k) || '}'",
    "'fewer sources than required for these sessions'",
    """(SELECT *, no - row_number() OVER (PARTITION BY asset_id, request_id, code ORDER BY no) AS island FROM (
         SELECT r.asset_id, r.request_id, n.session, n.no, count(DISTINCT q.source_id) AS k,
                CASE count(DISTINCT q.source_id) WHEN 0 THEN 'insufficient_session_coverage' WHEN 1 THEN 'insufficient_source_verification' ELSE 'ok' END AS code
         FROM requests r JOIN numbered n ON n.session BETWEEN r.requested_start AND r.requested_end
         LEFT JOIN q ON q.asset_id = r.asset_id AND q.session = n.session
         GROUP BY r.asset_id, r.request_id, n.session, n.no))
        WHERE code <> 'ok' GROUP BY asset_id, request_id, code, island""",
    "request_id",
) + " UNION ALL " + finding(
    "requested_range_coverage", "'error'", "'no_expected_sessions_in_requested_range'", "requested_start", "requested_end",
    "CAST(NULL AS VARCHAR)", "'alpha,beta'", "'{\"minimum_sources\":2}'", "'the calendar has no session in this range'",
    "requests r WHERE NOT EXISTS (SELECT 1 FROM numbered n WHERE n.session BETWEEN r.requested_start AND r.requested_end)",
    "request_id",
)
OVERLAP = finding(
    "cross_source_overlap", "'warning'", "'cross_source_session_missing'", "session", "session",
    "CAST(NULL AS VARCHAR)", "'alpha,beta'", "'{\"missing_from\":\"' || missing || '\"}'",
    "'only one of the two sources has these sessions'",
    """(SELECT asset_id, session, CASE WHEN min(source_id) = 'alpha' THEN 'beta' ELSE 'alpha' END AS missing
        FROM q GROUP BY asset_id, session HAVING count(DISTINCT source_id) = 1)""",
)
STABLE = """
stable AS (
  SELECT * FROM q WHERE asset_id IN (SELECT asset_id FROM requests WHERE adjustment_mode = 'raw')
  QUALIFY row_number() OVER (PARTITION BY asset_id, source_id, session ORDER BY open, high, low, close, volume) = 1
),
compared AS (
  SELECT *, abs(l - r) AS gap, abs(l) + abs(r) AS total,
         CAST(abs(l - r) AS DOUBLE) / (CAST(abs(l) + abs(r) AS DOUBLE) / 2) * 10000 AS bps
  FROM (""" + " UNION ALL ".join(
    f"""SELECT a.asset_id, a.session, '{f}' AS field, {TRY.format('a.' + f)} AS l, {TRY.format('b.' + f)} AS r, a.{f} AS left_text, b.{f} AS right_text
        FROM stable a JOIN stable b ON a.asset_id = b.asset_id AND a.session = b.session AND a.source_id = 'alpha' AND b.source_id = 'beta'"""
    for f in ("open", "high", "low", "close")
) + """) WHERE l IS NOT NULL AND r IS NOT NULL AND abs(l) + abs(r) > 0
)"""


def plain(expr: str) -> str:
    """Decimal text without trailing zeros."""
    return f"regexp_replace(regexp_replace(CAST({expr} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"


CROSS = finding(
    "cross_source_ohlc", "CASE WHEN gap * 20000 <= 50 * total THEN 'warning' ELSE 'error' END",
    "CASE WHEN gap * 20000 <= 50 * total THEN 'cross_source_field_warning' ELSE 'cross_source_field_conflict' END",
    "session", "session", "field", "'alpha,beta'",
    f"'{{\"difference_bps\":\"' || printf('%.6f', bps) || '\",\"left\":\"' || {plain('left_text')} || '\",\"right\":\"' || {plain('right_text')} || '\"}}'",
    "'the sources differ by more than the policy allows'",
    "compared WHERE gap * 20000 > 10 * total",
)
REVISION = finding(
    "provider_revision", "'warning'", "'provider_history_revision'", "session", "session", "CAST(NULL AS VARCHAR)",
    "'alpha,alpha-2'",
    "'{\"changed_fields\":[\"' || CASE WHEN d % 307 = 0 THEN 'session_presence' ELSE 'volume' END || '\"],\"current_capture\":\"alpha-2\",\"previous_capture\":\"alpha\"}'",
    "'a later observation of the same request differs'",
    "base WHERE d % 53 = 0 OR d % 307 = 0",
)
ADJUSTMENT = finding(
    "adjustment_semantics", "'error'", "'unsupported_adjustment_semantics'", "requested_start", "requested_end",
    "CAST(NULL AS VARCHAR)", "''", "'{\"adjustment_mode\":\"' || adjustment_mode || '\"}'",
    "'adjusted prices are not supported as they can change afterwards'",
    "requests WHERE adjustment_mode <> 'raw'",
    "request_id",
)
PARTS = {
    "dq_schema": SCHEMA,
    "dq_session": SESSION,
    "dq_ohlc": OHLC,
    "dq_volume": VOLUME,
    "dq_calendar": CALENDAR,
    "dq_source_coverage": SOURCE_COVERAGE,
    "dq_range_coverage": RANGE_COVERAGE,
    "dq_overlap": OVERLAP,
    "dq_cross_ohlc": CROSS,
    "dq_revision": REVISION,
    "dq_adjustment": ADJUSTMENT,
}
SELECT = f"""
SELECT asset_id, request_id, check_id, severity, finding_code, {day('affected_start')} AS affected_start,
       {day('affected_end')} AS affected_end, field, source_ids, observed, message FROM found"""
#: Findings that hold for a request r.
HOLDS = """f.asset_id = r.asset_id AND (f.request_id IS NULL OR f.request_id = r.request_id)
  AND (f.check_id <> 'cross_source_ohlc' OR r.adjustment_mode = 'raw')"""

for _name, _part in PARTS.items():
    oracle(_name, f"WITH {Q}, {STABLE}, found AS ({_part}) {SELECT}")

ALL = " UNION ALL ".join(PARTS.values())

_IDS = """CASE WHEN source_ids = '' THEN '[]' ELSE '["' || replace(source_ids, ',', '","') || '"]' END"""
ID = f"""'dqf_' || substr(sha256('dqf' || chr(10) || '{{"affected_end":"' || {day('affected_end')} || '","affected_start":"' || {day('affected_start')}
  || '","check_id":"' || check_id || '","check_version":"2","field":' || coalesce('"' || field || '"', 'null') || ',"finding_code":"' || finding_code
  || '","message":"' || message || '","observed_values":' || observed || ',"severity":"' || severity || '","source_evidence_ids":'
  || {_IDS} || '}}'), 1, 24)"""

IDENTIFIED = f"""found AS ({ALL}), identified AS (SELECT *, {ID} AS finding_id FROM found)"""
oracle("dq_finding_ids", f"""
WITH {Q}, {STABLE}, {IDENTIFIED}
SELECT asset_id, check_id, finding_code, {day('affected_start')} AS affected_start, field, finding_id FROM identified""")
_KEYS = "affected_start, affected_end, finding_code, coalesce(field, ''), string_split(source_ids, ','), finding_id"
oracle("dq_findings_ordered", f"""
WITH {Q}, {STABLE}, {IDENTIFIED}
SELECT row_number() OVER (ORDER BY asset_id, check_id, {_KEYS}) - 1 AS ordinal,
       row_number() OVER (PARTITION BY asset_id, check_id ORDER BY {_KEYS}) - 1 AS place,
       asset_id, check_id, finding_code, {day('affected_start')} AS affected_start, {day('affected_end')} AS affected_end, finding_id
FROM identified""")

oracle("dq_revision_pairs", f"""
WITH {Q}
SELECT asset_id, CASE asset_id WHEN 'N' THEN 'different_request' WHEN 'R' THEN 'same_observation' END AS rule,
       CASE WHEN asset_id IN ('N', 'R') THEN 0 ELSE count(*) FILTER (d % 53 = 0 OR d % 307 = 0) END AS findings
FROM base GROUP BY asset_id""")

oracle("dq_cross_summary", f"""
WITH {Q}, {STABLE}
SELECT asset_id, 'alpha' AS left_id, 'beta' AS right_id, count(*) AS compared_values, {num('max(bps)')} AS max_difference_bps
FROM compared GROUP BY asset_id""")

INCOMPLETE = """('insufficient_session_coverage', 'insufficient_source_verification', 'no_expected_sessions_in_requested_range',
  'unsupported_adjustment_semantics', 'unsupported_normalized_schema')"""
INELIGIBLE = """('cross_source_field_conflict', 'duplicate_session', 'invalid_ohlc', 'negative_volume', 'non_finite_field',
  'non_monotonic_sessions', 'non_positive_price', 'unexpected_session')"""

oracle("dq_check_results", f"""
WITH {Q}, {STABLE}, found AS ({ALL}),
checks AS (SELECT unnest(['schema_contract', 'session_integrity', 'ohlc_integrity', 'volume_integrity', 'calendar_membership',
  'source_coverage', 'requested_range_coverage', 'cross_source_overlap', 'cross_source_ohlc', 'provider_revision', 'adjustment_semantics']) AS check_id),
graded AS (
  SELECT r.asset_id, r.request_id, r.adjustment_mode, c.check_id, count(f.finding_code) AS finding_count,
         count(*) FILTER (f.severity IN ('error', 'blocker') AND f.finding_code NOT IN {INCOMPLETE}) AS fails,
         count(*) FILTER (f.severity IN ('error', 'blocker')) AS hard, count(*) FILTER (f.severity = 'warning') AS warns
  FROM requests r CROSS JOIN checks c LEFT JOIN found f ON {HOLDS} AND f.check_id = c.check_id
  GROUP BY ALL
)
SELECT asset_id, request_id, check_id, finding_count,
       CASE WHEN check_id = 'cross_source_ohlc' AND adjustment_mode <> 'raw' THEN 'not_applicable' WHEN fails > 0 THEN 'fail'
            WHEN hard > 0 THEN 'incomplete' WHEN warns > 0 THEN 'warning' ELSE 'pass' END AS status
FROM graded""")

oracle("dq_eligibility", f"""
WITH {Q}, {STABLE}, found AS ({ALL}),
effects AS (
  SELECT DISTINCT r.asset_id, r.request_id, r.requested_start, r.requested_end, f.*EXCLUDE (asset_id, request_id),
         CASE WHEN finding_code IN {INELIGIBLE} THEN 'b' WHEN finding_code IN {INCOMPLETE} THEN 'i' WHEN severity <> 'info' THEN 'w' END AS effect
  FROM requests r LEFT JOIN found f ON {HOLDS} AND f.affected_start <= r.requested_end AND r.requested_start <= f.affected_end
)
SELECT asset_id, request_id, {day('requested_start')} AS requested_start, {day('requested_end')} AS requested_end,
       count(*) FILTER (effect = 'b') AS blocking_count, count(*) FILTER (effect = 'i') AS incomplete_count,
       count(*) FILTER (effect = 'w') AS warning_count,
       CASE WHEN count(*) FILTER (effect = 'b') > 0 THEN 'ineligible' WHEN count(*) FILTER (effect = 'i') > 0 THEN 'incomplete' ELSE 'eligible' END AS status
FROM effects GROUP BY ALL""")

# Requests under two policy versions; tolerances in halves of a basis point, so that they are integers.
VERSIONED = Q.replace("requests AS (", "plain_requests AS (") + f""",
policies(policy_id, version, as_of, accepts_v0, minimum, pass2, warn2, blocks) AS (
  VALUES ('research', '1', DATE '2000-06-30', false, 1, 20, 100, false), ('research', '2', DATE '2001-06-30', true, 2, 40, 121, true)),
requests AS (
  SELECT r.* EXCLUDE (request_id), request_id || '/' || policy_id || '@' || version AS request_id, policy_id || '@' || version AS policy_key, p.*
  FROM plain_requests r, policies p)"""
FREE = " UNION ALL ".join((SESSION, OHLC, VOLUME, CALENDAR, SOURCE_COVERAGE, OVERLAP, REVISION, ADJUSTMENT, RANGE_COVERAGE, SCHEMA))
POLICY_FINDINGS = f"""
found AS ({FREE}),
held AS (
  SELECT r.asset_id, r.request_id, f.check_id, f.severity, f.finding_code, f.affected_start, f.affected_end, f.field, f.source_ids, f.observed,
         r.blocks AND f.finding_code = 'provider_history_revision' AS revised
  FROM requests r JOIN found f ON f.asset_id = r.asset_id AND (f.request_id IS NULL OR f.request_id = r.request_id)
   AND NOT (f.finding_code = 'unsupported_normalized_schema' AND r.accepts_v0)
   AND NOT (f.finding_code = 'insufficient_source_verification' AND r.minimum = 1)
  UNION ALL
  SELECT r.asset_id, r.request_id, 'cross_source_ohlc', CASE WHEN gap * 40000 <= warn2 * total THEN 'warning' ELSE 'error' END,
         CASE WHEN gap * 40000 <= warn2 * total THEN 'cross_source_field_warning' ELSE 'cross_source_field_conflict' END, session, session, field,
         'alpha,beta', left_text || '/' || right_text, false
  FROM requests r JOIN compared c ON c.asset_id = r.asset_id AND r.adjustment_mode = 'raw' AND gap * 40000 > pass2 * total
)"""
oracle("dq_policy", f"""
WITH {VERSIONED}, {STABLE}, {POLICY_FINDINGS},
effects AS (
  SELECT DISTINCT r.asset_id, r.request_id, r.requested_start, r.requested_end, r.policy_key, f.* EXCLUDE (asset_id, request_id),
         CASE WHEN finding_code IN {INELIGIBLE} THEN 'b' WHEN revised OR finding_code IN {INCOMPLETE} THEN 'i' WHEN severity <> 'info' THEN 'w' END AS effect
  FROM requests r LEFT JOIN held f
    ON f.asset_id = r.asset_id AND f.request_id = r.request_id AND f.affected_start <= r.requested_end AND r.requested_start <= f.affected_end
)
SELECT asset_id, request_id, {day('requested_start')} AS requested_start, {day('requested_end')} AS requested_end, policy_key,
       count(*) FILTER (effect = 'b') AS blocking_count, count(*) FILTER (effect = 'i') AS incomplete_count,
       count(*) FILTER (effect = 'w') AS warning_count,
       CASE WHEN count(*) FILTER (effect = 'b') > 0 THEN 'ineligible' WHEN count(*) FILTER (effect = 'i') > 0 THEN 'incomplete' ELSE 'eligible' END AS status
FROM effects GROUP BY ALL
UNION ALL
SELECT asset_id, request_id || '/' || p || '/' || d, {day('requested_start')}, {day('requested_end')}, NULL, NULL, NULL, NULL, 'no_policy'
FROM plain_requests, (VALUES ('research', '1999-12-31'), ('broken', '2001-06-30')) w(p, d)""")
oracle("dq_policy_checks", f"""
WITH {VERSIONED}, {STABLE}, {POLICY_FINDINGS},
checks AS (SELECT unnest(['schema_contract', 'session_integrity', 'ohlc_integrity', 'volume_integrity', 'calendar_membership',
  'source_coverage', 'requested_range_coverage', 'cross_source_overlap', 'cross_source_ohlc', 'provider_revision', 'adjustment_semantics']) AS check_id),
graded AS (
  SELECT r.asset_id, r.request_id, r.adjustment_mode, c.check_id, count(f.finding_code) AS finding_count,
         count(*) FILTER (f.severity IN ('error', 'blocker') AND f.finding_code NOT IN {INCOMPLETE}) AS fails,
         count(*) FILTER (f.severity IN ('error', 'blocker')) AS hard, count(*) FILTER (f.severity = 'warning') AS warns
  FROM requests r CROSS JOIN checks c LEFT JOIN held f ON f.asset_id = r.asset_id AND f.request_id = r.request_id AND f.check_id = c.check_id
  GROUP BY ALL
)
SELECT asset_id, request_id, check_id, finding_count,
       CASE WHEN check_id = 'cross_source_ohlc' AND adjustment_mode <> 'raw' THEN 'not_applicable' WHEN fails > 0 THEN 'fail'
            WHEN hard > 0 THEN 'incomplete' WHEN warns > 0 THEN 'warning' ELSE 'pass' END AS status
FROM graded""")

oracle("dq_range_findings", f"""
WITH {Q}, {STABLE}, {IDENTIFIED}
SELECT * FROM (
  SELECT DISTINCT r.asset_id, r.request_id, f.finding_id,
         CASE WHEN finding_code IN {INELIGIBLE} THEN 'blocking' WHEN finding_code IN {INCOMPLETE} THEN 'incomplete' WHEN severity <> 'info' THEN 'warning' END AS effect
  FROM requests r JOIN identified f ON {HOLDS} AND f.affected_start <= r.requested_end AND r.requested_start <= f.affected_end)
WHERE effect IS NOT NULL""")

oracle("dq_dependent_sources", f"""
WITH {Q}
SELECT asset_id, lower(CASE WHEN asset_id = 'A' THEN 'Alpha' ELSE provider END) AS provider, count(*) AS source_count
FROM sources GROUP BY 1, 2 HAVING count(*) > 1""")

CLOSE = f"""
WITH {Q},
one AS (SELECT asset_id, session, close AS a FROM base WHERE d % 43 <> 0),
two AS (SELECT asset_id, session, CAST(close * CAST(10000 + (d % 13) * 6 AS DECIMAL(6,0)) * 0.0001 AS DECIMAL(18,6)) AS b FROM base WHERE d % 41 <> 0),
checks AS (
  SELECT coalesce(one.asset_id, two.asset_id) AS asset_id, coalesce(one.session, two.session) AS session, a, b,
         CAST(abs(a - b) AS DOUBLE) / CAST(a AS DOUBLE) * 10000 AS bps,
         CASE WHEN a IS NULL OR b IS NULL THEN 'missing' WHEN abs(a - b) * 10000 <= 10 * a THEN 'pass'
              WHEN abs(a - b) * 10000 <= 50 * a THEN 'warning' ELSE 'fail' END AS status
  FROM one FULL OUTER JOIN two ON one.asset_id = two.asset_id AND one.session = two.session
)"""
oracle("cross_source_close", f"""{CLOSE}
SELECT asset_id, {day('session')} AS session, {num('a')} AS primary_close, {num('b')} AS secondary_close,
       {num('bps')} AS difference_bps, status,
       CASE WHEN status = 'missing' THEN 'session is absent from one source' END AS reason
FROM checks""")
oracle("cross_source_report", f"""{CLOSE}
SELECT asset_id, count(*) AS total_sessions, count(*) FILTER (status <> 'missing') AS overlapping_sessions,
       count(*) FILTER (status = 'pass') AS pass_count, count(*) FILTER (status = 'warning') AS warning_count,
       count(*) FILTER (status = 'fail') AS fail_count, count(*) FILTER (status = 'missing') AS missing_count,
       CASE WHEN count(*) FILTER (status IN ('fail', 'missing')) > 0 THEN 'fail' WHEN count(*) FILTER (status = 'warning') > 0 THEN 'warning' ELSE 'pass' END AS overall_status
FROM checks GROUP BY asset_id""")

oracle("dq_observed", f"""
WITH {Q}
SELECT asset_id, source_id, {day('min(session)')} AS observed_start, {day('max(session)')} AS observed_end,
       count(*) AS bar_count, count(DISTINCT session) AS session_count
FROM q GROUP BY asset_id, source_id""")
oracle("dq_replay", f"""
WITH {Q}, {STABLE}, found AS ({ALL})
SELECT 'stored_only' AS side, finding_code, count(*) AS n FROM found WHERE finding_code = 'negative_volume' GROUP BY 2
UNION ALL SELECT 'recomputed_only', finding_code, count(*) FROM found WHERE finding_code IN ('negative_volume', 'non_monotonic_sessions') GROUP BY 2""")
