"""The registered queries as SQL for a second engine."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

LINES = """
lines AS (
  SELECT l_returnflag AS asset_id, CAST(l_shipdate AS DATE) AS session,
         l_orderkey AS line,
         CAST(l_extendedprice AS DECIMAL(18,6)) AS px, CAST(l_quantity AS DECIMAL(18,6)) AS qty
  FROM lineitem
),
bars_all AS (
  SELECT asset_id, session, first(px ORDER BY line, px) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY line, px) AS close, sum(qty) AS volume, count(*) AS line_count
  FROM lines GROUP BY asset_id, session
)"""

BARS = f"""{LINES},
bars AS (SELECT * FROM bars_all),
sessions AS (SELECT DISTINCT asset_id, session FROM bars),
numbered AS (
  SELECT asset_id, session, row_number() OVER w - 1 AS no, lead(session) OVER w AS next_session
  FROM sessions WINDOW w AS (PARTITION BY asset_id ORDER BY session)
),
aligned AS (SELECT b.*, n.no, n.next_session FROM bars b JOIN numbered n USING (asset_id, session))"""

# The calendar of an asset runs one day longer than its bars.
NEXT_DAY = "coalesce(next_session, session + 1)"


def day(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def available(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d') || ' 21:05:00'"


def opens(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d') || ' 14:30:00'"


def num(expr: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0"


def sig(expr: str) -> str:
    """Nine significant digits."""
    return f"CAST(printf('%.8e', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


oracle("bars_daily", f"""
WITH {LINES}
SELECT asset_id, {day('session')} AS session, {num('open')} AS open, {num('high')} AS high,
       {num('low')} AS low, {num('close')} AS close, {num('volume')} AS volume, line_count
FROM bars_all""")

oracle("sma_200", f"""
WITH {BARS}
SELECT asset_id, {day('session')} AS session, {num('close')} AS close,
       CASE WHEN no >= 199 THEN {num('CAST(sum(close) OVER w AS DOUBLE) / 200')} END AS sma
FROM aligned
WINDOW w AS (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)""")

oracle("donchian_channels", f"""
WITH {BARS}
SELECT asset_id, {day('session')} AS session,
       CASE WHEN no >= 55 THEN {num('max(high) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING)')} END AS upper,
       CASE WHEN no >= 20 THEN {num('min(low) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)')} END AS lower
FROM aligned""")

oracle("trailing_return_12", f"""
WITH {BARS}
SELECT asset_id, {day('session')} AS session,
       {num('CAST(close AS DOUBLE) / CAST(lag(close, 12) OVER (PARTITION BY asset_id ORDER BY session) AS DOUBLE) - 1', 8)} AS momentum
FROM aligned""")

oracle("running_drawdown", f"""
WITH {BARS}, peaks AS (
  SELECT *, max(close) OVER (PARTITION BY asset_id ORDER BY session) AS peak FROM aligned
)
SELECT asset_id, {day('session')} AS observed_on, {num('peak')} AS running_peak,
       {num('CAST(close AS DOUBLE) / CAST(peak AS DOUBLE) - 1', 8)} AS drawdown
FROM peaks""")


def rsi_cte(period: int) -> str:
    p = period
    return f"""
changes AS (
  SELECT asset_id, session, no, close, next_session,
         greatest(CAST(close - lag(close) OVER w AS DOUBLE), 0) AS gain,
         greatest(CAST(lag(close) OVER w - close AS DOUBLE), 0) AS loss
  FROM aligned WINDOW w AS (PARTITION BY asset_id ORDER BY session)
),
smoothed AS (
  SELECT asset_id, CAST({p} AS BIGINT) AS no, avg(gain) AS g, avg(loss) AS l
  FROM changes WHERE no BETWEEN 1 AND {p} GROUP BY asset_id HAVING count(*) = {p}
  UNION ALL
  SELECT c.asset_id, c.no, (s.g * {p - 1} + c.gain) / {p}, (s.l * {p - 1} + c.loss) / {p}
  FROM smoothed s JOIN changes c ON c.asset_id = s.asset_id AND c.no = s.no + 1
),
strength AS (
  SELECT c.*, CASE WHEN s.g = 0 AND s.l = 0 THEN 50.0 WHEN s.l = 0 THEN 100.0 WHEN s.g = 0 THEN 0.0
                   ELSE 100.0 * s.g / (s.g + s.l) END AS rsi
  FROM changes c LEFT JOIN smoothed s ON s.asset_id = c.asset_id AND s.no = c.no
)"""


for _period in (2, 14):
    oracle(f"wilder_rsi_{_period}", f"""
WITH RECURSIVE {BARS}, {rsi_cte(_period)}
SELECT asset_id, {day('session')} AS session, {num('rsi')} AS rsi FROM strength""")

SMA_TARGETS = """
scored AS (
  SELECT *, sum(close) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS total
  FROM aligned
),
targets AS (
  SELECT asset_id, session, next_session, CASE WHEN close * 200 > total THEN 1 ELSE 0 END AS weight
  FROM scored WHERE no >= 199 AND next_session IS NOT NULL
)"""

oracle("targets_sma", f"""
WITH {BARS}, {SMA_TARGETS}
SELECT asset_id, {day('session')} AS session, {available('session')} AS decision_at,
       {opens('next_session')} AS effective_at, CAST(weight AS BIGINT) AS weight
FROM targets""")

oracle("targets_s1", f"""
WITH RECURSIVE {BARS}, {rsi_cte(2)},
events AS (
  SELECT *, CASE WHEN no >= 199 AND round(rsi, 9) < 10 AND close * 200 > total THEN 1
                 WHEN no >= 199 AND round(rsi, 9) > 70 THEN 0 END AS event
  FROM (SELECT *, sum(close) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS total FROM strength)
)
SELECT * FROM (
  SELECT asset_id, '10/70/200' AS params, {day('session')} AS session, {available('session')} AS decision_at,
         {opens(NEXT_DAY)} AS effective_at,
         CAST(coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY session), 0) AS BIGINT) AS weight,
         no
  FROM events) WHERE no >= 199""".replace("SELECT * FROM (\n  SELECT asset_id", "SELECT * EXCLUDE (no) FROM (\n  SELECT asset_id"))

oracle("targets_s2", f"""
WITH {BARS},
events AS (
  SELECT *, CASE WHEN no >= 55 AND close > max(high) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 55 PRECEDING AND 1 PRECEDING) THEN 1
                 WHEN no >= 55 AND close < min(low) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) THEN 0 END AS event
  FROM aligned
)
SELECT * EXCLUDE (no) FROM (
  SELECT asset_id, '55/20' AS params, {day('session')} AS session, {available('session')} AS decision_at,
         {opens(NEXT_DAY)} AS effective_at,
         CAST(coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY asset_id ORDER BY session), 0) AS BIGINT) AS weight,
         no
  FROM events) WHERE no >= 55""")


def backtest_cte(window: int = 200) -> str:
    return f"""
{SMA_TARGETS.replace('199 PRECEDING', f'{window - 1} PRECEDING').replace('* 200', f'* {window}').replace('no >= 199', f'no >= {window - 1}')},
costs AS (
  SELECT * FROM (VALUES ('free', 10300.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE),
                        ('costly', 10300.0::DOUBLE, 0.001::DOUBLE, 0.0005::DOUBLE)) v(run_id, initial, c, s)
),
held AS (
  SELECT b.asset_id, b.session, b.no, CAST(b.open AS DOUBLE) AS o, CAST(b.close AS DOUBLE) AS k,
         coalesce(last_value(t.weight IGNORE NULLS) OVER (PARTITION BY b.asset_id ORDER BY b.session), 0) AS w
  FROM aligned b LEFT JOIN targets t ON t.asset_id = b.asset_id AND t.next_session = b.session
),
steps AS (
  SELECT h.*, c.run_id, c.initial, c.c, c.s,
         w <> coalesce(lag(w) OVER (PARTITION BY h.asset_id, c.run_id ORDER BY session), 0) AS traded
  FROM held h, costs c
),
factors AS (
  SELECT *, CASE WHEN NOT traded THEN 1.0 WHEN w = 1 THEN 1 / ((1 + c) * o * (1 + s)) ELSE o * (1 - s) * (1 - c) END AS f
  FROM steps
),
grown AS (
  SELECT *, initial * product(f) OVER (PARTITION BY asset_id, run_id ORDER BY session) AS capital,
         initial * coalesce(product(f) OVER (PARTITION BY asset_id, run_id ORDER BY session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS before
  FROM factors
),
points AS (
  SELECT *, CASE WHEN w = 1 THEN 0.0 ELSE capital END AS cash, CASE WHEN w = 1 THEN capital ELSE 0.0 END AS quantity,
         CASE WHEN w = 1 THEN capital * k ELSE capital END AS equity
  FROM grown
),
trades AS (
  SELECT *, CASE WHEN w = 1 THEN before / (1 + c) / ex ELSE before END AS q,
         CASE WHEN w = 1 THEN before * c / (1 + c) ELSE before * ex * c END AS commission
  FROM (SELECT *, CASE WHEN w = 1 THEN o * (1 + s) ELSE o * (1 - s) END AS ex FROM grown WHERE traded)
)"""


oracle("backtest_equity", f"""
WITH {BARS}, {backtest_cte()}
SELECT asset_id, run_id, {day('session')} AS session, {day('session')} || ' 21:00:00' AS observed_at,
       {num('k')} AS close, {sig('cash')} AS cash, {sig('quantity')} AS quantity, {sig('equity')} AS equity,
       CAST(w AS BIGINT) AS target_weight, {num('CASE WHEN w = 1 THEN 1.0 ELSE 0.0 END')} AS actual_weight
FROM points""")

oracle("backtest_trades", f"""
WITH {BARS}, {backtest_cte()}
SELECT asset_id, run_id, {day('session')} AS session, CASE WHEN w = 1 THEN 'buy' ELSE 'sell' END AS side,
       {opens('session')} AS executed_at, {num('o')} AS reference_price, {num('ex', 7)} AS execution_price,
       {sig('q')} AS quantity, {sig('commission')} AS commission, {sig('q * abs(ex - o)')} AS slippage_cost
FROM trades""")

oracle("backtest_totals", f"""
WITH {BARS}, {backtest_cte()},
spent AS (
  SELECT asset_id, run_id, count(*) AS n, sum(commission) AS c, sum(q * abs(ex - o)) AS s FROM trades GROUP BY ALL
)
SELECT p.asset_id, p.run_id, {sig('arg_max(equity, session)')} AS final_equity, count(*) AS point_count,
       coalesce(any_value(t.n), 0) AS trade_count, {sig('coalesce(any_value(t.c), 0)')} AS total_commission,
       {sig('coalesce(any_value(t.s), 0)')} AS total_slippage
FROM points p LEFT JOIN spent t ON t.asset_id = p.asset_id AND t.run_id = p.run_id
GROUP BY p.asset_id, p.run_id""")


def metrics_sql(keys: str, source: str, extra: str = "") -> str:
    """Five metrics of a relation (keys, session, no, equity DOUBLE); 252/365 days, ddof 1, 2% a year."""
    return f"""
obs AS (
  SELECT *, equity / lag(equity) OVER (PARTITION BY {keys} ORDER BY session) - 1 AS r,
         equity / max(equity) OVER (PARTITION BY {keys} ORDER BY session) - 1 AS dd
  FROM {source}
),
facts AS (
  SELECT {keys}, count(*) AS n, arg_min(equity, session) AS a, arg_max(equity, session) AS b,
         max(session) - min(session) AS days, least(min(dd), 0.0) AS worst,
         count(r) AS nr, avg(r) AS mean, CASE WHEN count(r) > 1 THEN var_pop(r) END AS vp
  FROM obs GROUP BY {keys}
),
vols AS (SELECT *, CASE WHEN nr > 1 THEN sqrt(vp * nr / (nr - 1)) * sqrt(252.0) END AS vol FROM facts),
graded AS (
  SELECT {keys}, 'total_return' AS metric, CASE WHEN n < 2 THEN 'insufficient_equity_observations' END AS reason, b / a - 1 AS value FROM vols
  UNION ALL SELECT {keys}, 'cagr', CASE WHEN n < 2 THEN 'insufficient_equity_observations' WHEN days <= 0 THEN 'non_positive_elapsed_time' END,
         CASE WHEN n >= 2 AND days > 0 THEN pow(b / a, 365.0 / days) - 1 END FROM vols
  UNION ALL SELECT {keys}, 'volatility', CASE WHEN nr <= 1 THEN 'insufficient_return_observations' END, vol FROM vols
  UNION ALL SELECT {keys}, 'sharpe', CASE WHEN nr <= 1 THEN 'insufficient_return_observations' WHEN vol = 0 THEN 'zero_volatility' END,
         CASE WHEN vol > 0 THEN (mean - (pow(1.02::DOUBLE, 1.0::DOUBLE / 252) - 1)) * 252 / vol END FROM vols
  UNION ALL SELECT {keys}, 'max_drawdown', NULL, worst FROM vols
)
SELECT {keys}, metric, CASE WHEN reason IS NULL THEN 'valid' ELSE 'undefined' END AS status,
       CASE WHEN reason IS NULL THEN {sig('value')} END AS value, reason
FROM graded"""


oracle("metrics_v1", f"""
WITH {BARS}, equity AS (SELECT asset_id, session, no, CAST(close AS DOUBLE) AS equity FROM aligned),
{metrics_sql('asset_id', 'equity')}""")

oracle("research_run", f"""
WITH {BARS}, {backtest_cte(50)}, {metrics_sql('asset_id, run_id', 'points')}""")


def sweep(events: str) -> str:
    """Summary per asset and parameter set of (asset_id, params, session, no, warmup, event)."""
    return f"""
states AS (
  SELECT *, coalesce(last_value(event IGNORE NULLS) OVER (PARTITION BY asset_id, params ORDER BY session), 0) AS weight FROM ({events})
)
SELECT asset_id, params, count(*) AS targets, CAST(sum(weight) AS BIGINT) AS long_days,
       {day('max(CASE WHEN weight = 1 THEN session END)')} AS last_long
FROM states WHERE no >= warmup GROUP BY asset_id, params"""


_values = ", ".join(
    f"({e}, {x}, {n})" for e in (5, 10, 15, 20) for x in (50, 60, 70, 80) for n in (150, 200, 250)
)
_pullback = """
  SELECT asset_id, session, no, n - 1 AS warmup, entry || '/' || leave || '/' || n AS params,
         CASE WHEN no < n - 1 THEN NULL
              WHEN round(rsi, 9) < entry AND close * n > CASE n WHEN 150 THEN s150 WHEN 200 THEN s200 ELSE s250 END THEN 1
              WHEN round(rsi, 9) > leave THEN 0 END AS event
  FROM sums, grid"""
oracle("sweep_s1", f"""
WITH RECURSIVE {BARS}, {rsi_cte(2)},
grid AS (SELECT * FROM (VALUES {_values}) g(entry, leave, n)),
sums AS (
  SELECT *, sum(close) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 149 PRECEDING AND CURRENT ROW) AS s150,
         sum(close) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS s200,
         sum(close) OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 249 PRECEDING AND CURRENT ROW) AS s250
  FROM strength
), {sweep(_pullback)}""")


def _channel(n: int, m: int) -> str:
    past = "OVER (PARTITION BY asset_id ORDER BY session ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
    return f"""SELECT asset_id, session, no, {n} AS warmup, '{n}/{m}' AS params,
    CASE WHEN no < {n} THEN NULL WHEN close > max(high) {past.format(n)} THEN 1 WHEN close < min(low) {past.format(m)} THEN 0 END AS event FROM aligned"""


oracle(
    "sweep_s2",
    f"WITH {BARS}, "
    + sweep(" UNION ALL ".join(_channel(n, m) for n, m in ((20, 10), (40, 20), (55, 20), (80, 40)))),
)

oracle("exact_returns", f"""
WITH {BARS},
units AS (
  SELECT asset_id, session, CAST(close * 1000000 AS BIGINT) AS c,
         CAST(lag(close) OVER (PARTITION BY asset_id ORDER BY session) * 1000000 AS BIGINT) AS p
  FROM aligned
)
SELECT asset_id, {day('session')} AS observed_on, (c - p) // gcd(c - p, p) AS numerator, p // gcd(c - p, p) AS denominator
FROM units WHERE p IS NOT NULL""")

SUPPLIERS = """
equity AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS asset_id, CAST(l_shipdate AS DATE) AS session,
         CAST(last(CAST(l_extendedprice AS DECIMAL(18,6)) ORDER BY l_orderkey, l_extendedprice) AS DOUBLE) AS equity
  FROM lineitem GROUP BY 1, 2
)"""
oracle("metrics_v2", f"WITH {SUPPLIERS}, {metrics_sql('asset_id', 'equity')}")
_total_20 = num("CAST(sum(CAST(equity AS DECIMAL(18,6))) OVER w AS DOUBLE) / 20")
oracle("sma_by_supplier", f"""
WITH {SUPPLIERS}
SELECT asset_id, {day('session')} AS observed_on, CASE WHEN count(*) OVER w = 20 THEN {_total_20} END AS sma
FROM equity WINDOW w AS (PARTITION BY asset_id ORDER BY session ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")

oracle("metric_input_contract", f"""
WITH {BARS},
steps AS (
  SELECT asset_id, session, session - DATE '1995-01-01' AS d, close, lag(close) OVER w AS past, lead(session) OVER w AS following,
         CASE WHEN (session - DATE '1995-01-01') % 401 = 0 THEN 0 ELSE close END AS e
  FROM aligned WINDOW w AS (PARTITION BY asset_id ORDER BY session)
),
paired AS (
  SELECT *, lag(e) OVER (PARTITION BY asset_id ORDER BY session) AS pe,
         CASE WHEN past IS NULL OR d % 211 = 0 THEN NULL WHEN d % 307 = 0 THEN -2
              ELSE CAST(round(CAST(close AS DOUBLE) / CAST(past AS DOUBLE) - 1, 2) AS DECIMAL(18,6)) END AS r
  FROM steps
),
last_return AS (SELECT asset_id, max(session) AS s FROM paired WHERE r IS NOT NULL GROUP BY 1),
rules AS (
  SELECT asset_id, 'non_positive_start' AS rule FROM paired WHERE pe IS NULL AND e <= 0
  UNION ALL SELECT asset_id, 'non_terminal_zero' FROM paired WHERE e <= 0 AND following IS NOT NULL
  UNION ALL SELECT asset_id, 'return_missing' FROM paired WHERE pe IS NOT NULL AND r IS NULL
  UNION ALL SELECT asset_id, 'return_mismatch' FROM paired WHERE pe IS NOT NULL AND r IS NOT NULL
     AND CAST(r AS DECIMAL(18,6)) * CAST(pe AS DECIMAL(20,6)) <> CAST(e - pe AS DECIMAL(30,6))
  UNION ALL SELECT b.asset_id, 'invalid_loss' FROM paired b JOIN last_return l USING (asset_id) WHERE r < -1 OR (r = -1 AND session <> l.s)
)
SELECT asset_id, rule, count(*) AS n FROM rules GROUP BY ALL""")

oracle("exact_rsi_2", ORACLES["wilder_rsi_2"])
oracle("exact_run", f"""
WITH {BARS}, {backtest_cte()}
SELECT asset_id, {day('session')} AS session, {sig('cash')} AS cash, {sig('quantity')} AS quantity, {sig('equity')} AS equity,
       CAST(w AS BIGINT) AS target_weight
FROM points WHERE run_id = 'costly'""")
