"""Decimals of any length against Python's, in any context precision."""

import random
from decimal import Decimal, getcontext, localcontext

from pyspark.sql import functions as F

from barloom.functions import digits

PLANTED = [
    "0", "-0", "0.000", "+5", "-5", "5.", ".5", "-.5", "1e3", "1E-7", "-1e400", "1e999999999999", "1234567890123.5", "0.0000001",
    "1" + "0" * 63, "9" * 64, "9" * 63 + "8", "-" + "9" * 64, "0." + "0" * 62 + "1", " 7 ", "007.70", "100", "1000000000", "999999999.999999999",
]
BROKEN = ["", " ", "NaN", "Infinity", "-inf", "n/a", "1,5", "1e", "e5", ".", "+", "--1", "1.2.3", "0x10", "1e9999999999999999999", None]


def spelled(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        whole, part = ("".join(r.choice("0123456789") for _ in range(r.randrange(0, 40))) for _ in range(2))
        out.append(r.choice(["", "-"]) + (whole or "0") + r.choice(["", "." + part]) + r.choice(["", f"e{r.randrange(-30, 30)}"]))
    return out


def test_order_and_canonical_text(spark):
    texts = PLANTED + spelled(1, 200)
    n = digits.number(F.col("t"))
    rows = spark.createDataFrame([(t,) for t in texts + BROKEN], "t string").select("t", digits.order_key(n).alias("k"), digits.canonical(n).alias("c")).collect()
    keys = {r.t: r.k for r in rows}
    assert all(keys[t] is None for t in BROKEN)
    values = {t: Decimal(t) for t in texts}
    ordered = sorted(texts, key=lambda t: keys[t].encode())
    assert [values[t] for t in ordered] == sorted(values[t] for t in texts)
    assert len(set(keys[t] for t in texts)) == len(set(values.values()))
    for r in rows:
        if r.c is None:
            continue
        assert Decimal(r.c) == values[r.t], r
        assert "E" in r.c or r.c == (f"{values[r.t].normalize():f}" if values[r.t] else "0") or len(r.c) > 28


def test_tolerance_is_exact_at_the_bound(spark):
    r, pairs = random.Random(2), []
    with localcontext() as c:
        c.prec = 400
        for i in range(200):
            small = Decimal(r.randrange(1, 10 ** r.randrange(1, 60))).scaleb(r.randrange(-40, 20))
            large = small * 20_010 / 19_990  # ten basis points, rounded at 400 digits
            nudge = Decimal(1).scaleb(large.adjusted() - r.randrange(1, 300))
            pairs += [(str(small), str(large + nudge)), (str(large - nudge), str(small)), (str(-small), str(-large - nudge)), (str(small), str(-small))]
        whole = Decimal(19_990) * 7
        pairs += [(str(whole), str(Decimal(20_010) * 7)), ("0", "0.0"), ("0", "1e-90"), ("1" + "0" * 63, "12.5"), ("-3", "3"), ("12.5", "12.51"), ("0", "-0.00"), ("5", "5.0000000000000001"), ("123456789012.123456", "123456789012.123457")]
        pairs = list(dict.fromkeys(pairs))
        left, right = digits.number(F.col("l")), digits.number(F.col("r"))
        rows = (
            spark.createDataFrame(pairs, "l string, r string")
            .select(
                "l", "r",
                digits.within_symmetric_bps(left, right, "10").alias("near"),
                digits.within_symmetric_bps(left, right, "0.25").alias("tight"),
                digits.within_symmetric_bps(left, right, "20000").alias("all"),
                digits.symmetric_bps(left, right).alias("bps"),
                digits.cell_within_symmetric_bps(digits.cell(F.col("l")), digits.cell(F.col("r")), "10").alias("cells_near"),
                digits.cell_symmetric_bps(digits.cell(F.col("l")), digits.cell(F.col("r"))).alias("cells_bps"),
            )
            .collect()
        )
        for row in rows:
            a, b = Decimal(row.l), Decimal(row.r)
            gap, total = abs(a - b), abs(a) + abs(b)
            assert row.near == (gap * 20_000 <= 10 * total), row
            assert row.cells_near == row.near, row
            assert row.tight == (gap * 20_000 <= Decimal("0.25") * total), row
            assert row["all"]
            if total == 0:
                assert row.bps is None and row.cells_bps is None
            else:
                assert abs(row.bps - row.cells_bps) < 1e-9
                assert abs(Decimal(row.bps) - gap * 20_000 / total) < Decimal("1e-9")
    assert getcontext().prec == 28


def test_long_values_through_the_checks(spark):
    from barloom.operators import quality

    cells = [
        ("a", 1, "1234567890123.5", "1234567890123.5", "0.0000001", "9" * 13 + "e-1"),
        ("b", 1, "1234567890123.5", "1234567890123.50", "0.0000001", "9" * 13 + "e-1"),
        ("a", 2, "5", "5." + "0" * 62 + "1", "5", "5"),
        ("b", 2, "5", "5", "5", "5." + "0" * 62 + "1"),
        ("a", 3, "1", "1", "1", "1"),
        ("b", 3, "1", "1" + "0" * 63, "1", "1"),
    ]
    bars = spark.createDataFrame(
        [("X", s, i, str(d), o, h, low, c, "1" * 50) for i, (s, d, o, h, low, c) in enumerate(cells)],
        "asset_id string, source_id string, row_seq long, d string, open string, high string, low string, close string, volume string",
    ).selectExpr("*", "cast('2020-01-0' || d as date) as session")
    found = {(str(r.affected_start)[-1], r.source_ids[0], r.finding_code) for r in quality.ohlc_integrity(bars).collect()}
    assert found == {("2", "b", "invalid_ohlc")}
    assert quality.volume_integrity(bars).count() == 0
    requests = spark.sql("select 'X' as asset_id, 'raw' as adjustment_mode, date'2020-01-01' as requested_start, date'2020-01-09' as requested_end")
    crossed = quality.cross_source_ohlc(bars, requests, quality.QualityPolicy()).collect()
    assert [(str(r.affected_start)[-1], r.field, r.finding_code) for r in crossed] == [("3", "high", "cross_source_field_conflict")]
    assert '"difference_bps":"20000.000000"' in crossed[0].observed and '"right":"1' + "0" * 63 + '"' in crossed[0].observed
