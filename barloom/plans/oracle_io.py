"""SQL of the contract, identity, source, sink and stream queries."""

from __future__ import annotations

from barloom.plans.oracle import BARS, LINES, SMA_TARGETS, backtest_cte, day, num, oracle
from barloom.plans.oracle_periods import periods
from barloom.plans.oracle_quality import plain

BASE = f"{LINES}, base AS (SELECT *, session - DATE '1995-01-01' AS d FROM bars_all)"
SMA_50 = (
    SMA_TARGETS.replace("199 PRECEDING", "49 PRECEDING").replace("* 200", "* 50").replace("no >= 199", "no >= 49")
)
DEFECTS = """
defective AS (
  SELECT asset_id, session, d, open, close, d % 59 = 0 AS early,
         CASE WHEN d % 61 = 0 THEN low - 1 ELSE high END AS high, CASE WHEN d % 71 = 0 THEN 0 ELSE low END AS low,
         CASE WHEN d % 67 = 0 THEN -volume ELSE volume END AS volume
  FROM base
),
judged AS (
  SELECT *, list_filter([CASE WHEN early THEN 'available_after_close' END, CASE WHEN high < low THEN 'high_at_least_low' END,
    CASE WHEN NOT open BETWEEN low AND high THEN 'open_in_range' END, CASE WHEN NOT close BETWEEN low AND high THEN 'close_in_range' END,
    CASE WHEN least(open, high, low, close) <= 0 THEN 'positive_prices' END, CASE WHEN volume < 0 THEN 'non_negative_volume' END],
    lambda x: x IS NOT NULL) AS violations
  FROM defective
)"""

oracle("con_bars", f"""
WITH {BASE}, {DEFECTS}
SELECT asset_id, {day('session')} AS session, array_to_string(violations, ',') AS violations FROM judged WHERE len(violations) > 0""")

oracle("con_schedule", f"""
WITH {BARS},
shifted AS (
  SELECT asset_id, session, CASE WHEN (session - DATE '1995-01-01') % 71 = 0 THEN 10 WHEN (session - DATE '1995-01-01') % 73 = 0 THEN 20 ELSE 0 END AS h FROM sessions
),
steps AS (SELECT *, lag(session) OVER w AS p, lag(h) OVER w AS ph FROM shifted WINDOW w AS (PARTITION BY asset_id ORDER BY session)),
judged AS (
  SELECT asset_id, session, list_filter([CASE WHEN NOT session BETWEEN DATE '1995-02-01' AND DATE '2001-12-31' THEN 'inside_requested_range' END,
    CASE WHEN h > 0 THEN 'label_is_local_date' END, CASE WHEN ph = 20 AND session = p + 1 THEN 'no_overlap' END], lambda x: x IS NOT NULL) AS violations
  FROM steps
)
SELECT 'LINE-' || asset_id AS calendar_id, {day('session')} AS session, array_to_string(violations, ',') AS violations FROM judged WHERE len(violations) > 0""")

oracle("con_causality", f"""
WITH {BARS}
SELECT asset_id, 'late_signal' AS rule, {day('session')} AS session, {day('session + 1')} || ' 17:00:00' AS detail
FROM aligned WHERE no >= 49 AND (session - DATE '1995-01-01') % 97 = 0 AND next_session = session + 1""")

PLANTED = f"WITH {BARS}, {SMA_50}, numbered_targets AS (SELECT *, session - DATE '1995-01-01' AS d FROM targets)"
oracle("con_targets", f"""{PLANTED},
judged AS (
  SELECT asset_id, session, list_filter([CASE WHEN d % 89 = 0 THEN 'effective_after_decision' END, CASE WHEN d % 83 = 0 THEN 'long_or_flat' END], lambda x: x IS NOT NULL) AS violations
  FROM numbered_targets
)
SELECT asset_id, {day('session')} AS session, array_to_string(violations, ',') AS violations FROM judged WHERE len(violations) > 0""")
oracle("con_engine_input", f"""{PLANTED},
timed AS (SELECT asset_id, d, {day('next_session')} || CASE WHEN d % 89 = 0 THEN ' 14:31:00' ELSE ' 14:30:00' END AS effective_at FROM numbered_targets),
copied AS (SELECT * FROM timed, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR d % 79 = 0)
SELECT asset_id, effective_at, 'weight_not_long_flat' AS rule FROM copied WHERE d % 83 = 0
UNION ALL SELECT asset_id, effective_at, 'duplicate_effective_at' FROM timed WHERE d % 79 = 0
UNION ALL SELECT asset_id, effective_at, 'no_such_open' FROM copied WHERE d % 89 = 0""")

INTERVALS = """
intervals AS (
  SELECT asset_id AS release_id, min(session) AS start_session, max(session) AS end_session, count(*) AS session_count
  FROM (SELECT asset_id, session, d - row_number() OVER (PARTITION BY asset_id ORDER BY session) AS island FROM base)
  GROUP BY asset_id, island
)"""
oracle("release_support", f"""
WITH {BASE}, {INTERVALS},
consumed AS (SELECT asset_id AS release_id, min(session) AS first_session, max(session) AS last_session FROM base GROUP BY asset_id, date_trunc('month', session))
SELECT release_id, {day('first_session')} AS first_session, {day('last_session')} AS last_session,
       CAST(EXISTS (SELECT 1 FROM intervals i WHERE i.release_id = c.release_id AND i.start_session <= c.first_session AND c.last_session <= i.end_session) AS BIGINT) AS supported
FROM consumed c""")
oracle("con_intervals", f"""
WITH {BASE}, {INTERVALS},
planted AS (
  SELECT release_id, start_session, session_count, CASE WHEN (start_session - DATE '1995-01-01') % 5 = 0 THEN end_session + 400 ELSE end_session END AS end_session,
         CASE WHEN (start_session - DATE '1995-01-01') % 7 = 0 THEN 'report-same' ELSE 'report-' || release_id || '-' || strftime(start_session, '%Y%m%d') END AS report_id
  FROM intervals
),
releases AS (SELECT asset_id AS release_id, min(session) AS a, DATE '2001-06-30' AS b, count(*) - 1 AS n FROM base GROUP BY 1),
steps AS (SELECT p.*, r.a, r.b, max(end_session) OVER (PARTITION BY release_id ORDER BY start_session, end_session, report_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_end FROM planted p JOIN releases r USING (release_id))
SELECT release_id, {day('start_session')} AS start_session, 'inside_schedule' AS rule FROM steps WHERE start_session < a OR end_session > b
UNION ALL SELECT release_id, {day('start_session')}, 'disjoint' FROM steps WHERE start_session <= last_end
UNION ALL SELECT release_id, NULL, 'more_sessions_than_schedule' FROM planted JOIN releases USING (release_id) GROUP BY release_id HAVING sum(session_count) > max(n)
UNION ALL SELECT release_id, {day('min(start_session)')}, 'repeated_report' FROM planted GROUP BY release_id, report_id HAVING count(*) > 1""")

oracle("session_sets", f"""
WITH {BASE}, days AS (SELECT session, count(DISTINCT asset_id) AS k FROM base GROUP BY session),
every AS (SELECT count(*) AS u, count(*) FILTER (k = (SELECT count(DISTINCT asset_id) FROM base)) AS i FROM days),
own AS (SELECT asset_id, count(DISTINCT session) AS n FROM base GROUP BY asset_id)
SELECT '*' AS asset_id, 'union' AS op, u AS n FROM every UNION ALL SELECT '*', 'intersection', i FROM every
UNION ALL SELECT asset_id, 'own', n FROM own UNION ALL SELECT asset_id, 'missing', u - n FROM own, every
UNION ALL SELECT asset_id, 'beyond', n - i FROM own, every""")

BAR_JSON = f"""'{{"asset":"' || asset_id || '","available_at":"' || {day('session')} || 'T21:05:00.000000+00:00","close":"' || {plain('close')}
  || '","high":"' || {plain('high')} || '","low":"' || {plain('low')} || '","open":"' || {plain('open')} || '","session":"' || {day('session')}
  || '","session_close_at":"' || {day('session')} || 'T21:00:00.000000+00:00","session_open_at":"' || {day('session')}
  || 'T14:30:00.000000+00:00","source":"lines","volume":"' || {plain('CAST(volume AS DECIMAL(24,6))')} || '"}}'"""
PRINTS = f"""
hashed AS (SELECT asset_id, no, sha256({BAR_JSON}) AS h FROM aligned),
chunks AS (SELECT asset_id, no // 4096 AS chunk, sha256(string_agg(h, chr(10) ORDER BY no)) AS h, count(*) AS n FROM hashed GROUP BY 1, 2),
spans AS (SELECT asset_id, chunk // 4096 AS span, sha256(string_agg(h, chr(10) ORDER BY chunk)) AS h, sum(n) AS n FROM chunks GROUP BY 1, 2),
prints AS (SELECT asset_id, sha256(string_agg(h, chr(10) ORDER BY span)) AS content_hash, CAST(sum(n) AS BIGINT) AS row_count FROM spans GROUP BY 1)"""
oracle("fingerprints", f"WITH {BARS}, {PRINTS} SELECT * FROM prints")
oracle("fixture_roundtrip", f"""WITH {BARS}, {PRINTS}
SELECT 'lines-daily-v1' AS fixture_id, asset_id, row_count, content_hash, 0::BIGINT AS violations FROM prints""")
oracle("session_set_hashes", f"""
WITH {BARS}
SELECT 'LINE-' || asset_id AS calendar_id, count(*) AS session_count,
       sha256('{{"calendar_id":"LINE-' || asset_id || '","sessions":[' || string_agg('"' || {day('session')} || '"', ',' ORDER BY session) || ']}}') AS sessions_hash
FROM sessions GROUP BY asset_id""")
oracle("bar_ids", f"""
WITH {BASE}
SELECT asset_id, {day('session')} AS session, 'bar_' || substr(sha256('bar' || chr(10) || '{{"asset":"' || asset_id || '","close":"' || {plain('close')}
  || '","session":"' || {day('session')} || '","volume":"' || {plain('CAST(volume AS DECIMAL(24,6))')} || '"}}'), 1, 24) AS bar_id
FROM base""")
oracle("canonical_decimals", f"""
WITH {BASE}
SELECT asset_id, {day('session')} AS session, {plain('close')} AS close, {plain('CAST(volume AS DECIMAL(24,6))')} AS volume, '0' AS zero FROM base""")

oracle("credential_scan", """
SELECT e.event_id, v.key, CAST(v.level AS BIGINT) AS level
FROM events e JOIN (VALUES ('click', 'apiKey', 1), ('error', 'X-Auth-Token2', 3), ('purchase', 'client%5Fsecret', 2), ('view', 'ｐａｓｓｗｄ', 1)) v(kind, key, level)
  ON e.event_type = v.kind
UNION ALL SELECT event_id, '<unreadable>', 0 FROM events WHERE event_type = 'signup' AND (event_id % 97 = 0 OR event_id % 101 = 0)""")
oracle("credential_quarantine", """
SELECT event_type, count(*) AS documents, count(*) FILTER (event_type = 'signup' AND event_id % 97 <> 0 AND event_id % 101 <> 0) AS kept FROM events GROUP BY event_type""")

oracle("normalize_lower", f"""
WITH {BASE},
bad AS (SELECT DISTINCT asset_id FROM base WHERE asset_id = 'N' AND (d % 500 = 0 OR (session BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND (d % 503 = 0 OR d % 509 = 0))))
SELECT asset_id, 'lower:raw' AS source, {day('session')} AS session, {day('session')} || ' 14:30:00' AS session_open_at,
       {day('session')} || ' 21:00:00' AS session_close_at, {day('session')} || ' 21:00:00' AS available_at,
       {num('open')} AS open, {num('high')} AS high, {num('low')} AS low, {num('close')} AS close, {num('volume')} AS volume
FROM base WHERE session BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND asset_id NOT IN (SELECT asset_id FROM bad)""")
oracle("normalize_title", f"""
WITH {BASE}, span AS (SELECT min(session) AS a, max(session) AS b FROM base),
judged AS (
  SELECT asset_id, CASE WHEN asset_id = 'N' AND d % 500 = 0 THEN NULL ELSE session END AS session,
         CASE WHEN asset_id = 'N' AND d % 500 = 0 THEN 'invalid_date' WHEN session > DATE '2001-06-30' OR session < DATE '1995-01-02' THEN 'outside_requested_range'
              WHEN isodow(session) > 5 THEN 'not_a_session' WHEN asset_id = 'N' AND d % 503 = 0 THEN 'invalid_close'
              WHEN asset_id = 'N' AND d % 509 = 0 THEN 'invalid_volume' END AS rule
  FROM base
)
SELECT asset_id, {day('session')} AS session, rule FROM judged WHERE rule IS NOT NULL""")

oracle("captures_verified", f"""
WITH {BASE}, years AS (SELECT asset_id, strftime(session, '%Y') AS y, count(*) AS n FROM base GROUP BY 1, 2)
SELECT asset_id || '-' || y || '-' || c.n AS capture_id, 'lines' AS provider, years.n AS record_count, 'verified' AS verdict,
       (SELECT count(*) FROM years) AS stored_contents
FROM years, (VALUES (1), (2)) c(n) WHERE NOT (asset_id = 'R' AND y = '1999' AND c.n = 2)""")
oracle("capture_records", f"""
WITH {BASE}, years AS (SELECT *, strftime(session, '%Y') AS y, row_number() OVER (PARTITION BY asset_id, strftime(session, '%Y') ORDER BY session) - 1 AS i FROM base),
seen AS (SELECT * FROM years, (VALUES (1), (2)) c(n) WHERE NOT (asset_id = 'R' AND y = '1999' AND n = 2))
SELECT asset_id, count(*) AS n, {num('sum(close)')} AS total_close, max(i) AS last_index FROM seen GROUP BY asset_id""")
oracle("csv_roundtrip", f"""
WITH {BASE}
SELECT asset_id, {day('session')} AS session, {num('open')} AS open, {num('high')} AS high, {num('low')} AS low, {num('close')} AS close, {num('volume')} AS volume FROM base""")
oracle("calendar_roundtrip", f"""
WITH {BARS}
SELECT 'LINE-' || asset_id AS calendar_id, {day('session')} AS session, {day('session')} || ' 14:30:00' AS session_open_at,
       {day('session')} || ' 21:00:00' AS session_close_at FROM sessions""")
oracle("run_roundtrip", f"""
WITH {BARS}, {backtest_cte(50)},
counts AS (SELECT asset_id, count(*) AS n FROM aligned GROUP BY asset_id)
SELECT 'run' AS part, asset_id, 'stored' AS run_id, CAST(NULL AS VARCHAR) AS session, n AS row_count, 'verified' AS verdict FROM counts
UNION ALL SELECT 'copy', asset_id, 'stored', NULL, n, CASE WHEN asset_id IN ('A', 'N') THEN 'content_changed' ELSE 'verified' END FROM counts
UNION ALL SELECT 'trades', 'A', 'stored', {day('min(session)')}, 1, 'changed' FROM trades WHERE asset_id = 'A'
UNION ALL SELECT 'totals', 'N', 'stored', NULL, 1, 'changed'""")
oracle("stream_weekly", f"""
WITH {BARS}, {periods('1w')}
SELECT asset_id, {day('period_start')} AS period_start, {num('open')} AS open, {num('high')} AS high, {num('low')} AS low, {num('close')} AS close,
       {num('volume')} AS volume, {day('last_session')} || ' 21:05:00' AS available_at, n AS constituent_count, expected_count, 'complete' AS completeness
FROM periods""")
oracle("stream_late", f"""
WITH {BARS}, {periods('1w', 'whole')},
timed AS (
  SELECT b.*, CAST(date_trunc('week', session) AS DATE) AS period_start,
         session + TIME '21:05:00' + CASE WHEN (session - DATE '1995-01-01') % 97 = 0 THEN INTERVAL 20 DAY ELSE INTERVAL 0 DAY END AS available
  FROM bars b
),
due AS (
  SELECT t.*, w.expected_count, w.days[-1] + TIME '21:00:00' + INTERVAL 12 HOUR AS cutoff
  FROM timed t JOIN whole w USING (asset_id, period_start)
),
weeks AS (
  SELECT asset_id, period_start, cutoff, expected_count, count(*) FILTER (available <= cutoff) AS n, count(*) FILTER (available > cutoff) AS late,
         arg_max(close, session) FILTER (available <= cutoff) AS close, sum(volume) FILTER (available <= cutoff) AS volume
  FROM due GROUP BY ALL
),
final AS (SELECT max(available) - INTERVAL 3 DAY AS mark FROM due)
SELECT asset_id, {day('period_start')} AS period_start, 'period' AS kind, n AS row_count, {num('close')} AS close, {num('volume')} AS volume,
       strftime(cutoff, '%Y-%m-%d %H:%M:%S') AS cutoff_at, expected_count,
       CASE WHEN n = expected_count THEN 'complete' ELSE 'incomplete_missing_data' END AS completeness
FROM weeks, final WHERE n > 0 AND (n = expected_count OR cutoff < mark)
UNION ALL SELECT asset_id, {day('period_start')}, 'late', late, NULL, NULL, NULL, NULL, NULL FROM weeks WHERE late > 0""")
oracle("stream_quarantine", f"""
WITH {BASE}, {DEFECTS}
SELECT asset_id, count(*) AS n, CASE WHEN len(violations) = 0 THEN 'clean' ELSE 'quarantine' END AS sink FROM judged GROUP BY ALL""")
