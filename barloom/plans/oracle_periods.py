"""SQL of the weekly and monthly queries."""

from __future__ import annotations

from barloom.plans.oracle import BARS, ORACLES, day, num, oracle, sig
from barloom.plans.oracle_quality import plain


def unit(frequency: str) -> str:
    return "week" if frequency == "1w" else "month"


def period_end(frequency: str, start: str = "period_start") -> str:
    return f"({start} + 6)" if frequency == "1w" else f"last_day({start})"


def periods(frequency: str, name: str = "periods", bars: str = "bars", calendar: str = "sessions") -> str:
    u = unit(frequency)
    return f"""
{name}_expected AS (
  SELECT asset_id, CAST(date_trunc('{u}', session) AS DATE) AS period_start, count(*) AS expected_count, max(session) AS expected_last,
         list(session ORDER BY session) AS days
  FROM {calendar} GROUP BY 1, 2
),
{name} AS (
  SELECT o.*, e.expected_count, e.days, {period_end(frequency, 'o.period_start')} AS period_end
  FROM (SELECT asset_id, CAST(date_trunc('{u}', session) AS DATE) AS period_start,
          arg_min(open, session) AS open, max(high) AS high, min(low) AS low, arg_max(close, session) AS close,
          sum(volume) AS volume, max(session) AS last_session, count(*) AS n
        FROM {bars} GROUP BY 1, 2) o JOIN {name}_expected e USING (asset_id, period_start)
)"""


def period_select(frequency: str) -> str:
    return f"""
WITH {BARS}, {periods(frequency)}
SELECT asset_id, {day('period_start')} AS period_start, {day('period_end')} AS period_end, {num('open')} AS open,
       {num('high')} AS high, {num('low')} AS low, {num('close')} AS close, {num('volume')} AS volume,
       {day('last_session')} || ' 21:05:00' AS available_at, n AS constituent_count, expected_count,
       CASE WHEN n = expected_count THEN 'complete' ELSE 'incomplete_missing_data' END AS completeness
FROM periods"""


oracle("weekly_bars", period_select("1w"))
oracle("monthly_bars", period_select("1mo"))

KNOWN = "known AS (SELECT * FROM bars WHERE session <= DATE '2001-06-13')"


def graded(name: str, cutoff: str) -> str:
    return f"""SELECT *, CASE WHEN n = expected_count THEN last_session + TIME '21:05:00' ELSE TIMESTAMP '{cutoff}' END AS cutoff_at,
       CASE WHEN n = expected_count THEN 'complete'
            WHEN TIMESTAMP '{cutoff}' < days[n + 1] + TIME '21:00:00' THEN 'partial_cutoff' ELSE 'incomplete_missing_data' END AS completeness
FROM {name}"""


CASES = [
    (f"{f} {label}", name, cutoff)
    for f, name in (("1w", "w"), ("1mo", "m"))
    for label, cutoff in (("early", "2001-06-14 12:00:00"), ("late", "2001-06-16 00:00:00"))
]
oracle(
    "period_completeness",
    f"WITH {BARS}, {KNOWN}, {periods('1w', 'w', 'known')}, {periods('1mo', 'm', 'known')} "
    + " UNION ALL ".join(
        f"""SELECT '{case}' AS "case", asset_id, {day('period_start')} AS period_start,
        strftime(cutoff_at, '%Y-%m-%d %H:%M:%S') AS cutoff_at, n AS constituent_count, expected_count, completeness
        FROM ({graded(name, cutoff)})"""
        for case, name, cutoff in CASES
    ),
)
oracle("incomplete_periods", f"""
WITH {BARS}, {KNOWN}, {periods('1mo', 'm', 'known')}
SELECT asset_id, 'incomplete_period' AS rule, {day('period_start')} AS session, completeness AS detail
FROM ({graded('m', '2001-06-16 00:00:00')}) WHERE completeness <> 'complete'""")

oracle("resample_checks", f"""
WITH {BARS},
broken AS (
  SELECT * FROM aligned WHERE (asset_id = 'A' AND session <= DATE '2001-05-01')
    OR (asset_id = 'N' AND session <= DATE '2001-06-13' AND (session - DATE '1995-01-01') % 97 <> 0)
    OR (asset_id = 'R' AND session <= DATE '2001-06-20')
),
late AS (SELECT asset_id, 'bar_after_cutoff' AS rule, session, {day('session')} || ' 21:05:00' AS detail
  FROM broken WHERE session + TIME '21:05:00' > TIMESTAMP '2001-06-16 00:00:00'),
missing AS (SELECT asset_id, 'missing_session' AS rule, max(session) AS session, CAST(max(no) + 1 - count(*) AS VARCHAR) AS detail
  FROM broken GROUP BY asset_id HAVING max(no) + 1 > count(*)),
weeks AS (SELECT asset_id, CAST(date_trunc('week', session) AS DATE) AS p, min(session) AS first FROM sessions GROUP BY 1, 2),
upcoming AS (SELECT asset_id, p, lead(p) OVER w AS np, lead(first) OVER w AS nf FROM weeks WINDOW w AS (PARTITION BY asset_id ORDER BY p)),
elapsed AS (
  SELECT asset_id, 'elapsed_period_without_bars' AS rule, np AS session, {day('np')} AS detail
  FROM (SELECT asset_id, CAST(date_trunc('week', max(session)) AS DATE) AS p FROM broken GROUP BY asset_id) JOIN upcoming USING (asset_id, p)
  WHERE nf + TIME '21:00:00' <= TIMESTAMP '2001-06-16 00:00:00'
)
SELECT asset_id, rule, {day('session')} AS session, detail
FROM (SELECT * FROM late UNION ALL SELECT * FROM missing UNION ALL SELECT * FROM elapsed)""")

oracle("cover_checks", f"""
WITH {BARS},
every_day AS (SELECT CAST(u AS DATE) AS session FROM (SELECT unnest(generate_series(min(session), max(session), INTERVAL 1 DAY)) AS u FROM bars_all)),
common AS (SELECT session FROM bars_all GROUP BY session HAVING count(DISTINCT asset_id) = (SELECT count(DISTINCT asset_id) FROM bars_all)),
calendars AS (
  SELECT 'common' AS calendar, session, row_number() OVER (ORDER BY session) - 1 AS no FROM common
  UNION ALL SELECT 'all days', session, row_number() OVER (ORDER BY session) - 1 FROM every_day
),
sizes AS (SELECT calendar, count(*) AS size FROM calendars GROUP BY calendar),
facts AS (
  SELECT s.calendar, b.asset_id, count(*) FILTER (c.no IS NULL) AS unexpected, count(c.no) AS covered, max(c.no) AS last_no,
         max(b.session) AS session, any_value(s.size) AS size
  FROM bars_all b CROSS JOIN sizes s LEFT JOIN calendars c ON c.calendar = s.calendar AND c.session = b.session
  GROUP BY s.calendar, b.asset_id
),
rules AS (
  SELECT calendar, asset_id, session, 'unexpected_session' AS rule, unexpected AS n FROM facts
  UNION ALL SELECT calendar, asset_id, session, 'missing_session', last_no + 1 - covered FROM facts
  UNION ALL SELECT calendar, asset_id, session, 'calendar_not_covered', size - covered FROM facts
)
SELECT asset_id, rule, {day('session')} AS session, CAST(n AS VARCHAR) AS detail, calendar FROM rules WHERE n > 0""")


FOLLOWED = """
days AS (SELECT CAST(u AS DATE) AS session FROM (SELECT unnest(generate_series(min(session), max(session), INTERVAL 1 DAY)) AS u FROM bars_all)),
scheduled AS (
  SELECT asset_id, session FROM days, (SELECT DISTINCT asset_id FROM bars_all)
  WHERE asset_id = 'R' OR isodow(session) < 6 OR (asset_id <> 'N' AND session >= DATE '1998-01-01')
),
placed AS (
  SELECT asset_id, session, row_number() OVER w - 1 AS no, lead(session) OVER w AS next_session, count(*) OVER (PARTITION BY asset_id) AS size
  FROM scheduled WINDOW w AS (PARTITION BY asset_id ORDER BY session)
)"""
oracle("two_calendars", f"""
WITH {BARS}, {FOLLOWED}
SELECT b.asset_id, CASE b.asset_id WHEN 'N' THEN 'WEEKDAYS' WHEN 'R' THEN 'ALL'
         ELSE 'WEEKDAYS[0001-01-01,1998-01-01)+ALL[1998-01-01,9999-12-31)' END AS calendar_id,
       {day('b.session')} AS session, p.no AS session_no, {day('p.next_session')} AS next_session
FROM bars b LEFT JOIN placed p ON p.asset_id = b.asset_id AND p.session = b.session""")
oracle("two_calendars_cover", f"""
WITH {BARS}, {FOLLOWED},
facts AS (
  SELECT b.asset_id, max(b.session) AS session, count(*) FILTER (p.no IS NULL) AS unexpected, count(p.no) AS covered, max(p.no) AS last_no, max(p.size) AS size
  FROM bars b LEFT JOIN placed p ON p.asset_id = b.asset_id AND p.session = b.session GROUP BY b.asset_id
),
rules AS (
  SELECT asset_id, session, 'unexpected_session' AS rule, unexpected AS n FROM facts
  UNION ALL SELECT asset_id, session, 'missing_session', last_no + 1 - covered FROM facts
  UNION ALL SELECT asset_id, session, 'calendar_not_covered', size - covered FROM facts
)
SELECT asset_id, rule, {day('session')} AS session, CAST(n AS VARCHAR) AS detail FROM rules WHERE n > 0""")


def extended(frequency: str) -> str:
    """Every calendar with one session after the last period of its bars."""
    begins = "date_trunc('week', max(session)) + INTERVAL 7 DAY" if frequency == "1w" else "last_day(max(session)) + 1"
    return f"""
calendar AS (
  SELECT asset_id, session FROM sessions UNION ALL SELECT asset_id, CAST({begins} AS DATE) FROM sessions GROUP BY asset_id
),
following AS (SELECT asset_id, session AS last_session, lead(session) OVER (PARTITION BY asset_id ORDER BY session) AS nxt FROM calendar)"""


def gaps(frequency: str, name: str) -> str:
    """Assets whose periods are not consecutive; the strategies withhold them."""
    step = "7" if frequency == "1w" else "INTERVAL 1 MONTH"
    return f"""
gaps AS (
  SELECT DISTINCT asset_id FROM (SELECT asset_id, period_start, lag(period_start) OVER (PARTITION BY asset_id ORDER BY period_start) AS p FROM {name})
  WHERE period_start <> p + {step}
)"""


def period_targets(frequency: str, warmup: int, condition: str) -> str:
    return f"""
WITH {BARS}, {extended(frequency)}, {periods(frequency, calendar='calendar')},
whole AS (SELECT * FROM periods WHERE n = expected_count), {gaps(frequency, 'whole')},
scored AS (
  SELECT *, row_number() OVER w - 1 AS i,
         sum(close) OVER (PARTITION BY asset_id ORDER BY period_start ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS s13,
         sum(close) OVER (PARTITION BY asset_id ORDER BY period_start ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS s40,
         sum(close) OVER (PARTITION BY asset_id ORDER BY period_start ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS s10
  FROM whole WINDOW w AS (PARTITION BY asset_id ORDER BY period_start)
)
SELECT asset_id, {day('last_session')} AS session, {day('last_session')} || ' 21:05:00' AS decision_at,
       {day('nxt')} || ' 14:30:00' AS effective_at, CAST({condition} AS BIGINT) AS weight
FROM scored JOIN following USING (asset_id, last_session) WHERE i >= {warmup - 1} AND asset_id NOT IN (SELECT asset_id FROM gaps)"""


oracle("targets_s3", period_targets("1w", 40, "s13 * 40 > s40 * 13"))
oracle("targets_s4", period_targets("1mo", 10, "close * 10 > s10"))

MOMENTUM = f"""
rows AS (
  SELECT asset_id, period_start, period_end, last_session, close AS now, lag(close, 12) OVER (PARTITION BY asset_id ORDER BY period_start) AS past FROM {{0}}
),
ratios AS (SELECT *, CAST(now AS DOUBLE) / CAST(past AS DOUBLE) AS ratio FROM rows WHERE past IS NOT NULL),
best AS (
  SELECT period_start, period_end, max(last_session) AS d, arg_max(asset_id, ratio) AS asset, arg_max(now, ratio) AS bn, arg_max(past, ratio) AS bp,
         count(*) AS k, min(ratio - 1) AS weakest FROM ratios GROUP BY 1, 2
),
ties AS (SELECT b.period_start, count(*) FILTER (CAST(r.now AS DECIMAL(30,6)) * CAST(b.bp AS DECIMAL(30,6)) = CAST(b.bn AS DECIMAL(30,6)) * CAST(r.past AS DECIMAL(30,6))) AS leaders FROM ratios r JOIN best b USING (period_start) GROUP BY 1)
SELECT {day('period_start')} AS period_start, {day('period_end')} AS period_end, {day('d')} || ' 21:05:00' AS decision_at,
       k AS asset_count, {num('CAST(bn AS DOUBLE) / CAST(bp AS DOUBLE) - 1', 8)} AS strongest_return, {num('weakest', 8)} AS weakest_return,
       CASE WHEN leaders = 1 AND bn > bp THEN asset END AS selected_asset,
       CASE WHEN leaders > 1 THEN 'relative_tie' WHEN bn > bp THEN 'risk_on' ELSE 'cash_non_positive' END AS reason
FROM best JOIN ties USING (period_start)"""

oracle("signals_s5", f"WITH {BARS}, {periods('1mo')}, {MOMENTUM.format('periods')}")
oracle("signals_s5_pair", f"""WITH {BARS}, {periods('1mo')},
pair AS (
  SELECT * FROM periods WHERE asset_id = 'A' OR (asset_id = 'N' AND period_start >= DATE '1997-01-01')
  UNION ALL SELECT * REPLACE ('N' AS asset_id) FROM periods WHERE asset_id = 'A' AND period_start < DATE '1997-01-01'
), {MOMENTUM.format('pair')}""")

oracle("momentum_alignment", f"""
WITH {BARS}, {periods('1mo')},
holes AS (SELECT * FROM periods WHERE NOT (asset_id = 'N' AND period_start BETWEEN DATE '1998-03-01' AND DATE '1998-04-01')),
steps AS (SELECT asset_id, period_start, lag(period_start) OVER (PARTITION BY asset_id ORDER BY period_start) AS previous FROM holes)
SELECT '*' AS asset_id, {day('period_start')} AS period_start,
       CASE WHEN count(DISTINCT asset_id) < (SELECT count(DISTINCT asset_id) FROM bars_all) THEN 'asset_missing' ELSE 'sessions_differ' END AS rule
FROM holes GROUP BY period_start
HAVING count(DISTINCT asset_id) < (SELECT count(DISTINCT asset_id) FROM bars_all) OR count(DISTINCT days) > 1
UNION ALL SELECT asset_id, {day('period_start')}, 'month_gap' FROM steps WHERE period_start <> previous + INTERVAL 1 MONTH
UNION ALL SELECT DISTINCT asset_id, NULL, CASE WHEN asset_id = 'R' THEN 'not_total_return' ELSE 'semantics_differ' END FROM bars_all""")

oracle("period_contract", f"""
WITH {BARS},
known AS (SELECT * FROM bars WHERE session <= DATE '2001-06-13' OR asset_id <> 'A'),
{periods('1w', 'w', 'known')},
weeks AS (
  SELECT * FROM ({graded('w', '2001-06-16 00:00:00')})
  WHERE NOT (asset_id = 'N' AND period_start = DATE '1999-06-07') AND (asset_id <> 'A' OR period_start <= DATE '2001-06-13')
),
steps AS (SELECT asset_id, period_start, lag(period_start) OVER (PARTITION BY asset_id ORDER BY period_start) AS previous FROM weeks)
SELECT asset_id, 'incomplete_period' AS rule, {day('period_start')} AS session, completeness AS detail FROM weeks WHERE completeness <> 'complete'
UNION ALL SELECT asset_id, 'period_gap', {day('period_start')}, {day('previous')} FROM steps WHERE period_start <> previous + 7
UNION ALL SELECT asset_id, 'calendar_mismatch', {day('period_start')}, NULL FROM weeks
  WHERE period_start = DATE '1998-02-09' AND EXISTS (SELECT 1 FROM sessions s WHERE s.asset_id = weeks.asset_id AND session = DATE '1998-02-11')""")

oracle("period_rules", f"""
WITH {BARS},
days AS (SELECT asset_id, CAST(date_trunc('week', session) AS DATE) AS p, list(session ORDER BY session) AS expected FROM sessions GROUP BY 1, 2),
planted AS (
  SELECT asset_id, session - CASE WHEN asset_id = 'N' AND d % 89 = 0 THEN 1 ELSE 0 END AS session, asset_id = 'R' AND d % 83 = 0 AS early,
         asset_id = 'R' AND d % 83 <> 0 AND d % 79 = 0 AS late
  FROM (SELECT *, session - DATE '1995-01-01' AS d FROM bars) WHERE NOT (asset_id = 'A' AND d % 97 = 0)
),
held AS (
  SELECT asset_id, CAST(date_trunc('week', session) AS DATE) AS p, list(session ORDER BY session) AS days, count(*) AS n,
         count(*) FILTER (early) AS early, count(*) FILTER (late) AS late
  FROM planted GROUP BY 1, 2
),
judged AS (SELECT h.*, d.expected FROM held h LEFT JOIN days d USING (asset_id, p))
SELECT asset_id, 'not_a_prefix' AS rule, {day('p')} AS session, CAST(n AS VARCHAR) AS detail FROM judged WHERE expected IS NULL OR days <> expected[1:n]
UNION ALL SELECT asset_id, 'available_before_close', {day('p')}, CAST(early AS VARCHAR) FROM judged WHERE early > 0
UNION ALL SELECT asset_id, 'available_after_cutoff', {day('p')}, CAST(late AS VARCHAR) FROM judged WHERE late > 0""")

oracle("weekly_backtest", f"""
WITH {BARS}, {extended('1w')}, {periods('1w', calendar='calendar')}, {gaps('1w', 'periods')},
scored AS (
  SELECT asset_id, last_session, row_number() OVER (PARTITION BY asset_id ORDER BY period_start) - 1 AS i,
         sum(close) OVER (PARTITION BY asset_id ORDER BY period_start ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS s13,
         sum(close) OVER (PARTITION BY asset_id ORDER BY period_start ROWS BETWEEN 39 PRECEDING AND CURRENT ROW) AS s40
  FROM periods WHERE asset_id NOT IN (SELECT asset_id FROM gaps)
),
targets AS (
  SELECT s.asset_id, n.nxt AS next_session, CASE WHEN s13 * 40 > s40 * 13 THEN 1 ELSE 0 END AS weight
  FROM scored s JOIN following n USING (asset_id, last_session) WHERE i >= 39
),
held AS (
  SELECT b.asset_id, b.session, CAST(b.open AS DOUBLE) AS o, CAST(b.close AS DOUBLE) AS k,
         coalesce(last_value(t.weight IGNORE NULLS) OVER (PARTITION BY b.asset_id ORDER BY b.session), 0) AS w
  FROM aligned b LEFT JOIN targets t ON t.asset_id = b.asset_id AND t.next_session = b.session
),
steps AS (SELECT *, w <> coalesce(lag(w) OVER (PARTITION BY asset_id ORDER BY session), 0) AS traded FROM held),
factors AS (SELECT *, CASE WHEN NOT traded THEN 1.0 WHEN w = 1 THEN 1 / (1.001::DOUBLE * o * 1.0005::DOUBLE) ELSE o * 0.9995::DOUBLE * 0.999::DOUBLE END AS f FROM steps),
grown AS (
  SELECT *, 10000 * product(f) OVER (PARTITION BY asset_id ORDER BY session) AS capital,
         10000 * coalesce(product(f) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before
  FROM factors
),
money AS (
  SELECT *, CASE WHEN w = 1 THEN capital * k ELSE capital END AS equity,
         CASE WHEN NOT traded THEN 0 WHEN w = 1 THEN before * 0.001::DOUBLE / 1.001::DOUBLE ELSE before * o * 0.9995::DOUBLE * 0.001::DOUBLE END AS commission,
         CASE WHEN NOT traded THEN 0 WHEN w = 1 THEN before / 1.001::DOUBLE / (o * 1.0005::DOUBLE) * o * 0.0005::DOUBLE ELSE before * o * 0.0005::DOUBLE END AS slip
  FROM grown
)
SELECT asset_id, 'weekly' AS run_id, {sig('arg_max(equity, session)')} AS final_equity, count(*) AS point_count,
       count(*) FILTER (traded) AS trade_count, {sig('sum(commission)')} AS total_commission, {sig('sum(slip)')} AS total_slippage
FROM money GROUP BY asset_id""")

oracle("period_ids", f"""
WITH {BARS}, {periods('1mo')},
described AS (
  SELECT *, sha256(list_reduce(list_transform(days, lambda x: {day('x')}), lambda x, y: x || ',' || y)) AS eh, {day('last_session')} || 'T21:05:00.000000+00:00' AS stamp FROM periods
)
SELECT asset_id, {day('period_start')} AS period_start, 'period-bar_' || substr(sha256('period-bar' || chr(10) || '{{"asset":"' || asset_id || '","available_at":"' || stamp
  || '","close":"' || {plain('close')} || '","constituent_count":' || n || ',"cutoff_at":"' || stamp || '","expected_hash":"' || eh || '","frequency":"1mo","high":"' || {plain('high')}
  || '","low":"' || {plain('low')} || '","open":"' || {plain('open')} || '","period_start":"' || {day('period_start')} || '","volume":"'
  || {plain('CAST(volume AS DECIMAL(24,6))')} || '"}}'), 1, 24) AS period_bar_id
FROM described""")

_signals = ORACLES["signals_s5"]
oracle("signal_ids", f"""
SELECT period_start, 'dual-momentum-signal_' || substr(sha256('dual-momentum-signal' || chr(10) || '{{"decision_at":"' || replace(decision_at, ' ', 'T')
  || '.000000+00:00","observed_period_end":"' || period_end || '","observed_period_start":"' || period_start || '","reason":"' || reason
  || '","selected_asset":' || coalesce('"' || selected_asset || '"', 'null') || '}}'), 1, 24) AS signal_id
FROM ({_signals})""")
oracle("range_boundaries", f"""
WITH {BARS}
SELECT 'LINE-' || asset_id AS calendar_id, {day('min(session)')} AS requested_start, {day('max(session)')} AS requested_end,
       {day("date_trunc('month', min(session))")} AS first_start, {day('last_day(max(session))')} AS last_end
FROM sessions GROUP BY asset_id HAVING min(session) <> date_trunc('month', min(session)) OR max(session) <> last_day(max(session))""")
