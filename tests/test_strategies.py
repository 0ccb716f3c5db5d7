"""Hand-computed position paths, timing rules and metamorphic properties."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from conftest import bar, bars_frame, calendar_frame, instant, weekdays
from pyspark.sql import functions as F

from barloom.operators import segments
from barloom.operators.alignment import align, cover, cover_violations
from barloom.operators.backtest import Costs, backtest
from barloom.plans import strategies

DAYS = weekdays("2026-01-02", 9)
# Chosen so that SMA(3) gives 1, 1, 1, 0, 0, 1 for sessions 3 to 8.
CLOSES = (100, 102, 104, 105, 106, 98, 95, 103, 104)
OPENS = (100, 101, 103, 103, 105, 104, 98, 95, 103)


def sample(spark, asset="X"):
    return bars_frame(
        spark,
        [
            bar(d, c, asset=asset, open_=o, high=max(o, c) + 1, low=min(o, c) - 1)
            for d, c, o in zip(DAYS, CLOSES, OPENS)
        ],
    )


def path(targets):
    return [r.weight for r in targets.orderBy("session").collect()]


def test_sma_targets_and_timing(spark):
    targets = strategies.sma_targets(sample(spark), calendar_frame(spark, DAYS), window=3).require()
    rows = targets.orderBy("session").collect()
    assert [r.weight for r in rows] == [1, 1, 1, 0, 0, 1]
    assert rows[0].session == DAYS[2]
    assert rows[0].decision_at == instant(DAYS[2], 21, 5).replace(tzinfo=None)
    assert rows[0].effective_at == instant(DAYS[3], 14, 30).replace(tzinfo=None)


def test_sma_tie_stays_flat(spark):
    rows = [bar(d, 100) for d in DAYS]
    targets = strategies.sma_targets(bars_frame(spark, rows), calendar_frame(spark, DAYS), window=3)
    assert path(targets.require()) == [0] * 6


def test_gap_and_shift_withhold_only_their_series(spark):
    good, gap = sample(spark), sample(spark, "GAP").filter(F.col("session") != str(DAYS[4]))
    late = sample(spark, "SHIFT").withColumn(
        "session_open_at", F.col("session_open_at") + F.expr("interval 1 minute")
    )
    targets = strategies.sma_targets(
        good.unionByName(gap).unionByName(late), calendar_frame(spark, DAYS), window=3
    )
    assert {r.asset_id for r in targets.clean().select("asset_id").distinct().collect()} == {"X"}
    found = {(r.asset_id, r.rule) for r in targets.violations.collect()}
    assert ("GAP", "missing_session") in found and ("SHIFT", "shifted_session") in found
    with pytest.raises(strategies.ContractViolation):
        targets.require()


def test_late_bar_withholds_series(spark):
    rows = [
        bar(d, c, available=instant(DAYS[i + 1], 15) if i == 4 else None)
        for i, (d, c) in enumerate(zip(DAYS, CLOSES))
    ]
    targets = strategies.sma_targets(bars_frame(spark, rows), calendar_frame(spark, DAYS), window=3)
    assert targets.clean().count() == 0
    assert {r.rule for r in targets.violations.collect()} == {"late_signal"}


def test_mixed_sources_duplicates_and_foreign_sessions(spark):
    days = calendar_frame(spark, DAYS[:-1])
    rows = [bar(d, 100, source="s" if i else "other") for i, d in enumerate(DAYS[:5])]
    rows += [bar(DAYS[0], 100, asset="D"), bar(DAYS[0], 100, asset="D"), bar(DAYS[8], 1, asset="F")]
    found = {
        (r.asset_id, r.rule, r.detail)
        for r in cover_violations(align(bars_frame(spark, rows), days)).collect()
    }
    assert found == {
        ("X", "mixed_sources", "1"),
        ("D", "duplicate_session", "1"),
        ("F", "unexpected_session", "1"),
    }


def channel_rows(scale=1):
    days = weekdays("2025-01-02", 61)
    special = {55: (110, 100, 101), 56: (108, 91, 105), 57: (109, 80, 89), 58: (120, 110, 111), 59: (119, 100, 115)}
    rows = []
    for i, d in enumerate(days[:60]):
        high, low, close = (Decimal(v) * scale for v in special.get(i, (100, 90, 95)))
        rows.append(bar(d, close, open_=close, high=high, low=low))
    return days, rows


def test_donchian_path_and_scaling(spark):
    for scale in (1, 7):
        days, rows = channel_rows(scale)
        targets = strategies.donchian_targets(bars_frame(spark, rows), calendar_frame(spark, days))
        assert path(targets.require()) == [1, 1, 0, 1, 1]


def test_donchian_truncation_never_changes_the_past(spark):
    days, rows = channel_rows()
    full = strategies.donchian_targets(bars_frame(spark, rows), calendar_frame(spark, days))
    part = strategies.donchian_targets(bars_frame(spark, rows[:58]), calendar_frame(spark, days))
    assert path(part.require()) == path(full.require())[:3]


def test_donchian_needs_a_next_session(spark):
    days, rows = channel_rows()
    targets = strategies.donchian_targets(bars_frame(spark, rows), calendar_frame(spark, days[:60]))
    assert {r.rule for r in targets.violations.collect()} == {"missing_next_session"}
    assert targets.clean().count() == 0


def rsi_loop(closes, period):
    out, gains, losses = [None] * min(period, len(closes)), [], []
    for a, b in zip(closes, closes[1:]):
        gains.append(max(b - a, 0.0))
        losses.append(max(a - b, 0.0))
    if len(closes) <= period:
        return out
    g, l = sum(gains[:period]) / period, sum(losses[:period]) / period

    def value():
        if l == 0:
            return 50.0 if g == 0 else 100.0
        return 100 * g / (g + l)

    out.append(value())
    for i in range(period, len(gains)):
        g, l = (g * (period - 1) + gains[i]) / period, (l * (period - 1) + losses[i]) / period
        out.append(value())
    return out


def random_closes(seed, n):
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        if not 300 < i < 700:  # a long flat stretch crosses block borders
            price = round(max(1.0, price + rng.choice((-1, 1, 0, 2, -2)) * rng.random()), 2)
        out.append(price)
    return out


@pytest.mark.parametrize("period", [1, 2, 14])
def test_rsi_matches_the_recurrence_across_blocks(spark, period):
    from barloom.operators.rsi import with_wilder_rsi

    data = {"a": random_closes(1, 1200), "b": random_closes(2, 257), "c": [5.0] * 40, "d": [1.0]}
    rows = [(k, i, Decimal(str(c))) for k, cs in data.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "asset_id string, pos bigint, close decimal(18,6)")
    for size in (None, 500):
        got = with_wilder_rsi(df, ["asset_id"], "pos", "close", period, size=size).orderBy("pos").collect()
        for key, closes in data.items():
            mine = [r.rsi for r in got if r.asset_id == key]
            for x, y in zip(mine, rsi_loop(closes, period), strict=True):
                assert (x is None) == (y is None)
                assert x is None or abs(x - y) < 1e-9


def test_rsi_small_vectors(spark):
    from barloom.operators.rsi import with_wilder_rsi

    def last(closes):
        df = spark.createDataFrame(
            [("x", i, Decimal(c)) for i, c in enumerate(closes)],
            "asset_id string, pos bigint, close decimal(18,6)",
        )
        return [r.rsi for r in with_wilder_rsi(df, ["asset_id"], "pos", "close", 2).orderBy("pos").collect()]

    assert last([100, 102, 101, 105])[:2] == [None, None]
    assert abs(last([100, 102, 101, 105])[2] - 200 / 3) < 1e-9
    assert abs(last([100, 102, 101, 105])[3] - 1000 / 11) < 1e-9
    assert abs(last([100, 101, 92])[2] - 10) < 1e-9
    assert abs(last([100, 107, 104])[2] - 70) < 1e-9


def pullback_loop(closes, entry, exit_, trend, period=2):
    strengths, long, out = rsi_loop(closes, period), False, []
    for i in range(trend - 1, len(closes)):
        average = sum(map(Decimal, map(str, closes[i - trend + 1 : i + 1]))) / trend
        r = round(strengths[i], 9)
        if long:
            long = not r > exit_
        elif r < entry and Decimal(str(closes[i])) > average:
            long = True
        out.append(int(long))
    return out


def test_pullback_matches_the_stateful_rule_over_a_grid(spark):
    rng, price, closes = random.Random(5), 100.0, []
    for _ in range(420):
        price = round(price * (1 + rng.gauss(0.001, 0.02)), 2)
        closes.append(price)
    days = weekdays("2024-01-01", 421)
    grid = ((10, 70, 200), (20, 50, 150))
    targets = strategies.rsi_pullback_targets(
        bars_frame(spark, [bar(d, c) for d, c in zip(days, closes)]),
        calendar_frame(spark, days),
        grid=grid,
    ).require()
    for entry, exit_, trend in grid:
        rows = targets.filter(F.col("params") == f"{entry}/{exit_}/{trend}")
        expected = pullback_loop(closes, entry, exit_, trend)
        assert path(rows) == expected and 0 < sum(expected) < len(expected)


def test_pullback_thresholds_must_not_cross(spark):
    with pytest.raises(ValueError):
        strategies.rsi_pullback_targets(None, None, grid=((80, 70, 200),))


def test_segmented_layout_equals_one_window(spark, monkeypatch):
    rng = random.Random(9)
    days = weekdays("2023-01-02", 331)
    rows = []
    for asset in ("A", "B"):
        price = 100.0
        for d in days[:330]:
            price = round(price * (1 + rng.gauss(0, 0.02)), 2)
            rows.append(bar(d, price, asset=asset, high=price + rng.random(), low=price - rng.random()))
    bars, sessions = bars_frame(spark, rows).cache(), calendar_frame(spark, days).cache()

    def everything():
        sma = strategies.sma_targets(bars, sessions.filter(F.col("session") <= str(days[329])), window=20).require()
        run = backtest(
            cover(bars, sessions).bars, sma, (Costs("c", 1000, 10, 5),), size=segments.layout_for(sessions)
        )
        return [
            sorted(map(tuple, sma.collect())),
            sorted(map(tuple, strategies.donchian_targets(bars, sessions).require().collect())),
            sorted(map(tuple, strategies.rsi_pullback_targets(bars, sessions, grid=((20, 70, 50),)).require().collect())),
            sorted((r.asset_id, str(r.session), round(r.equity, 6)) for r in run.points.collect()),
        ]

    whole = everything()
    spark.conf.set(segments.LAYOUT, "64")
    try:
        assert segments.layout_for(sessions) == 64
        assert everything() == whole
    finally:
        spark.conf.unset(segments.LAYOUT)


def golden(spark, costs):
    days = DAYS[:7]
    opens = (100, 101, 102, 103, 104, 105, 98)
    closes = (100, 101, 102, 104, 105, 101, 97)
    bars = bars_frame(spark, [bar(d, c, open_=o) for d, c, o in zip(days, closes, opens)])
    wanted = [(3, 1), (4, 1), (5, 1), (6, 0)]
    targets = spark.createDataFrame(
        [("X", days[i - 1], instant(days[i - 1], 21, 5), instant(days[i], 14, 30), w) for i, w in wanted],
        "asset_id string, session date, decision_at timestamp, effective_at timestamp, weight int",
    )
    return backtest(cover(bars, calendar_frame(spark, days)).bars, targets, costs)


def test_backtest_golden(spark):
    run = golden(spark, (Costs("free", 10300), Costs("costly", 10300, 10, 5)))
    trades = run.trades.filter("run_id = 'free'").orderBy("session").collect()
    assert [(t.side, round(t.quantity, 9), float(t.reference_price)) for t in trades] == [
        ("buy", 100.0, 103.0),
        ("sell", 100.0, 98.0),
    ]
    totals = {r.run_id: r for r in run.totals.collect()}
    assert abs(totals["free"].final_equity - 9800) < 1e-8
    assert totals["free"].total_commission == 0 and totals["free"].trade_count == 2
    assert totals["costly"].final_equity < 9800
    assert totals["costly"].total_commission > 0 and totals["costly"].total_slippage > 0
    points = run.points.filter("run_id = 'free'").orderBy("session").collect()
    assert [round(p.equity, 6) for p in points] == [10300, 10300, 10300, 10400, 10500, 10100, 9800]
    assert [p.target_weight for p in points] == [0, 0, 0, 1, 1, 1, 0]


def test_backtest_equals_a_decimal_loop(spark):
    rng = random.Random(3)
    days = weekdays("2025-01-01", 120)
    opens = [Decimal(str(round(50 + 10 * rng.random(), 2))) for _ in days]
    closes = [Decimal(str(round(50 + 10 * rng.random(), 2))) for _ in days]
    weights = {i: rng.randint(0, 1) for i in range(5, 118, 3)}
    bars = bars_frame(spark, [bar(d, c, open_=o) for d, c, o in zip(days, closes, opens)])
    targets = spark.createDataFrame(
        [("X", days[i - 1], instant(days[i - 1], 22), instant(days[i], 14, 30), w) for i, w in weights.items()],
        "asset_id string, session date, decision_at timestamp, effective_at timestamp, weight int",
    )
    run = backtest(
        cover(bars, calendar_frame(spark, days)).bars, targets, (Costs("x", 5000, 7, 3),)
    )
    cash, held, state, expected, fees = Decimal(5000), Decimal(0), 0, [], Decimal(0)
    c, s = Decimal(7) / 10000, Decimal(3) / 10000
    for i, (o, k) in enumerate(zip(opens, closes)):
        want = weights.get(i, state)
        if want != state:
            if want:
                gross = cash / (1 + c)
                fees += cash - gross
                held, cash = gross / (o * (1 + s)), Decimal(0)
            else:
                proceeds = held * o * (1 - s)
                fees += proceeds * c
                cash, held = proceeds - proceeds * c, Decimal(0)
            state = want
        expected.append(float(cash + held * k))
    got = [p.equity for p in run.points.orderBy("session").collect()]
    assert all(abs(a - b) < 1e-8 for a, b in zip(got, expected, strict=True))
    assert abs(run.totals.first().total_commission - float(fees)) < 1e-8


def test_cost_limits():
    for bad in ({"initial_cash": 0}, {"commission_bps": -1}, {"slippage_bps": 10_000}):
        with pytest.raises(ValueError):
            Costs(**bad)


def test_holiday_calendar_positions(spark):
    days = [dt.date(2026, 1, 2), dt.date(2026, 1, 5), dt.date(2026, 1, 20)]
    rows = cover(
        bars_frame(spark, [bar(d, 10) for d in days[:2]]), calendar_frame(spark, days)
    ).bars.orderBy("session").collect()
    assert [r.session_no for r in rows] == [0, 1]
    assert rows[1].next_session == days[2]


def test_exact_mode_is_digit_exact(spark):
    from decimal import ROUND_HALF_EVEN, Context, localcontext

    from barloom.operators import exact

    closes = [Decimal(v) for v in ("100", "102", "101", "105", "105", "104.5")]
    days = weekdays("2026-01-05", len(closes))
    bars = cover(
        bars_frame(spark, [bar(d, c, open_=c + 1) for d, c in zip(days, closes)]),
        calendar_frame(spark, days),
    ).bars
    got = exact.exact_wilder_rsi(bars, ["asset_id"], "session_no", "close", 2).orderBy("session_no")
    with localcontext(Context(prec=28, rounding=ROUND_HALF_EVEN)):
        g, l, expected = Decimal(1), Decimal("0.5"), [None, None, str(Decimal(200) / 3)]
        for gain, loss in ((4, 0), (0, 0), (0, Decimal("0.5"))):
            g, l = (g + gain) / 2, (l + loss) / 2
            expected.append(str(100 * g / (g + l)))
    assert [r.rsi for r in got.collect()][:2] == [None, None]
    assert [Decimal(r.rsi) for r in got.collect()[2:]] == [Decimal(x) for x in expected[2:]]
    targets = spark.createDataFrame(
        [("X", days[0], instant(days[0], 22), instant(days[1], 14, 30), 1),
         ("X", days[3], instant(days[3], 22), instant(days[4], 14, 30), 0)],
        "asset_id string, session date, decision_at timestamp, effective_at timestamp, weight int",
    )
    points = exact.exact_backtest(bars, targets, Costs("x", 1000, 10, 5)).orderBy("session").collect()
    with localcontext(Context(prec=28, rounding=ROUND_HALF_EVEN)):
        c, s = Decimal(10) / 10000, Decimal(5) / 10000
        held = Decimal(1000) / (1 + c) / (Decimal(103) * (1 + s))
        proceeds = held * (Decimal(106) * (1 - s))
        cash = proceeds - proceeds * c
    assert Decimal(points[1].quantity) == held and Decimal(points[4].cash) == cash


def test_exact_mode_takes_series_of_any_length(spark):
    """The state goes from batch to batch, and not from one series to the next."""
    from decimal import ROUND_HALF_EVEN, Context, localcontext

    from barloom.operators import exact

    rows = [(a, i, Decimal((i * 7919 + a * 13) % 1009 + 1)) for a in (1, 2) for i in range(20_500)]
    df = spark.createDataFrame(rows, "k int, no int, close decimal(18,6)").repartition(5)
    got = {(r.k, r.no): r.rsi for r in exact.exact_wilder_rsi(df, ["k"], "no", "close", 14).collect()}
    assert len(got) == len(rows)
    for a in (1, 2):
        closes = [c for k, _, c in rows if k == a]
        with localcontext(Context(prec=28, rounding=ROUND_HALF_EVEN)):
            moves = [y - x for x, y in zip(closes, closes[1:])]
            up = sum(max(m, 0) for m in moves[:14]) / Decimal(14)
            down = sum(max(-m, 0) for m in moves[:14]) / Decimal(14)
            for m in moves[14:]:
                up, down = (up * 13 + max(m, 0)) / 14, (down * 13 + max(-m, 0)) / 14
            assert Decimal(got[(a, 20_499)]) == 100 * up / (up + down)
