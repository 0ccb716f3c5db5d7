"""Exact arithmetic on decimals of any length, held as text.

A number is a struct (sign, exponent, digits): sign * 0.digits * 10^exponent, digits without zeros at either end, so equal
numbers are equal structs. Nothing here is rounded but :func:`symmetric_bps`, and no length is too long for a cast.

Most cells fit a decimal type, which is many times faster. A *cell* is a struct (short, long): the decimal where the text fits it
exactly, else the digits. The functions named ``cell_...`` take cells and give the same answers whichever side is filled.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions import numeric
from barloom.functions.identity import canonical_decimal
from barloom.schemas import PRICE

#: Texts that the price type holds exactly.
SHORT = r"^[+-]?[0-9]{1,12}(\.[0-9]{1,6})?$"
#: Moves every exponent to 19 digits without a sign.
EXPONENT_SHIFT = 5 * 10**18
#: Digits of one limb in products: a limb times a factor below 9 * 10^9 and a carry fit 64 bits.
LIMB = 9
#: Tolerances in columns stay below this, so that their factors stay below 9 * 10^9.
BPS_LIMIT = 880_000
#: Digits in which two numbers are lined up to measure their difference.
ALIGNED = 36
#: Numbers with larger exponents are written with an E.
PLAIN_EXPONENT = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def number(text: Column) -> Column:
    """The number a text spells; NULL for NULL and for anything that is no finite number.

    Sign, point and an exponent of up to 18 digits may occur, blanks around them too.
    """
    finite = text.rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,18})?\s*$")
    whole = F.regexp_extract(text, r"^\s*[+-]?([0-9]*)", 1)
    fraction = F.regexp_extract(text, r"\.([0-9]*)", 1)
    power = F.coalesce(F.regexp_extract(text, r"[eE]([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    negative = F.ltrim(text).startswith("-")

    def valued(parts: Column) -> Column:
        every = F.concat(parts["whole"], parts["fraction"])
        return let(
            F.ltrim(every, F.lit("0")),
            lambda tail: _number(
                F.when(tail == "", 0).when(negative, -1).otherwise(1),
                F.length(parts["whole"]) + power - F.length(every) + F.length(tail),
                F.rtrim(tail, F.lit("0")),
            ),
        )

    return F.when(finite, let(F.struct(whole.alias("whole"), fraction.alias("fraction")), valued))


def order_key(n: Column) -> Column:
    """Text whose byte order is the order of the numbers."""
    size = F.concat(F.lpad((n["exponent"] + F.lit(EXPONENT_SHIFT)).cast("string"), 19, "0"), n["digits"])
    # Complemented digits turn the order round; "~" follows all digits, so a prefix comes after what goes on.
    mirrored = F.concat(F.lit("0"), F.translate(size, "0123456789", "9876543210"), F.lit("~"))
    return F.when(n["sign"] > 0, F.concat(F.lit("2"), size)).when(n["sign"] < 0, mirrored).when(n["sign"] == 0, "1")


def canonical(n: Column) -> Column:
    """Plain text without superfluous zeros; zero has no sign."""
    digits, exponent, length = n["digits"], n["exponent"], F.length(n["digits"])
    at = exponent.cast("int")
    plain = (
        F.when(exponent <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), digits))
        .when(exponent >= length, F.rpad(digits, at, "0"))
        .otherwise(F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, length)))
    )
    rest = F.when(length > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), length))).otherwise("")
    scientific = F.concat(F.substring(digits, 1, 1), rest, F.lit("E"), (exponent - 1).cast("string"))
    size = F.when(F.abs(exponent) <= PLAIN_EXPONENT, plain).otherwise(scientific)
    return F.when(n["sign"] == 0, "0").when(n["sign"] < 0, F.concat(F.lit("-"), size)).otherwise(size)


def times(n: Column, factor: Column | int) -> Column:
    """The exact product with a positive integer below 9 * 10^9, limb by limb from the right with a carry."""
    base = F.lit(10**LIMB)
    limbs = F.ceil(F.length(n["digits"]) / LIMB).cast("int")

    def step(state: Column, i: Column) -> Column:
        limb = F.rpad(F.substring(n["digits"], (limbs - i - 1) * LIMB + 1, F.lit(LIMB)), LIMB, "0").cast("bigint")
        return let(
            limb * factor + state["carry"],
            lambda v: F.struct(
                F.call_function("div", v, base).alias("carry"),
                F.concat(F.lpad((v % base).cast("string"), LIMB, "0"), state["text"]).alias("text"),
            ),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("text"))
    # Whole digits before the point of 0.digits move left by as many places as the product is longer.
    text = F.aggregate(
        F.sequence(F.lit(0), limbs - 1), start, step, lambda s: F.ltrim(F.concat(s["carry"].cast("string"), s["text"]), F.lit("0"))
    )
    product = let(text, lambda t: _number(n["sign"], n["exponent"] - limbs * LIMB + F.length(t), F.rtrim(t, F.lit("0"))))
    return F.when(n["sign"] == 0, n).otherwise(product)


def magnitude(n: Column) -> Column:
    return _number(F.abs(n["sign"]), n["exponent"], n["digits"])


def within_symmetric_bps(left: Column, right: Column, tolerance: str | Column) -> Column:
    """|left - right| * 20,000 <= tolerance * (|left| + |right|), exactly and without a division or a difference.

    A tolerance column is a decimal of at most four places, not negative and below ``BPS_LIMIT``.

    With one sign, larger and smaller magnitude, that is larger * (20,000 - tolerance) <= smaller * (20,000 + tolerance). With two
    signs, or one zero, the difference is the whole sum.
    """
    if isinstance(tolerance, Column):
        factors = F.array(*[((20_000 + side * tolerance) * 10_000).cast("bigint") for side in (-1, 1)])
        return let(
            factors,
            lambda f: F.when(f[0] <= 0, left.isNotNull() & right.isNotNull()).otherwise(_within(left, right, f[0], f[1])),
        )
    bound = Decimal(tolerance)
    scale = 10 ** max(0, -bound.normalize().as_tuple().exponent)
    less, more = (int((20_000 + side * bound) * scale) for side in (-1, 1))
    if more >= 9 * 10**9:
        raise ValueError("the tolerance has too many digits")
    if less <= 0:
        return left.isNotNull() & right.isNotNull()
    return _within(left, right, less, more)


def _within(left: Column, right: Column, less: Column | int, more: Column | int) -> Column:
    keyed = F.transform(
        F.array(left, right), lambda n: let(magnitude(n), lambda m: F.struct(order_key(m).alias("key"), m.alias("n")))
    )
    # Smaller magnitude first, each with its factor.
    products = F.transform(
        F.sort_array(keyed), lambda k, i: let(times(k["n"], F.when(i == 0, more).otherwise(less)), order_key)
    )
    close = let(products, lambda p: p[1] <= p[0])
    return F.when(left == right, True).when(left["sign"] == right["sign"], close).otherwise(False)


def symmetric_bps(left: Column, right: Column) -> Column:
    """Difference over the mean magnitude in basis points, a double; NULL when both are zero.

    Both are lined up in ``ALIGNED`` digits below the larger one's first before they are subtracted.
    """

    def exponent(n: Column) -> Column:
        return F.when(n["sign"] != 0, n["exponent"])

    def aligned(n: Column, top: Column) -> Column:
        """The first digits of a number as an integer."""
        zeros = F.repeat(F.lit("0"), F.least(top - n["exponent"], F.lit(ALIGNED)).cast("int"))
        text = F.rpad(F.concat(zeros, n["digits"]), ALIGNED, "0")
        return F.when(n["sign"] == 0, F.lit(0).cast("decimal(36,0)")).otherwise(text.cast("decimal(36,0)") * n["sign"])

    def measured(top: Column) -> Column:
        return let(
            F.transform(F.array(left, right), lambda n: aligned(n, top)), lambda p: numeric.symmetric_bps(p[0], p[1])
        )

    return let(F.greatest(exponent(left), exponent(right)), measured)


def short(text: Column) -> Column:
    """The decimal of a text that the price type holds exactly, else NULL."""
    return F.when(text.rlike(SHORT), text.try_cast(PRICE))


def sign(text: Column) -> Column:
    """-1, 0 or 1; NULL for anything that is no finite number."""
    return F.coalesce(F.signum(short(text)).cast("int"), number(text)["sign"])


def same(a: Column, b: Column) -> Column:
    """Equality of two texts as numbers; NULL where one is none."""
    return F.coalesce(short(a) == short(b), number(a) == number(b))


def cell(text: Column) -> Column:
    """The number of a text as a cell; NULL for anything that is no finite number."""
    return let(
        F.struct(short(text).alias("short"), F.when(short(text).isNull(), number(text)).alias("long")),
        lambda c: F.when(c["short"].isNotNull() | c["long"].isNotNull(), c),
    )


def cell_sign(c: Column) -> Column:
    return F.coalesce(F.signum(c["short"]).cast("int"), c["long"]["sign"])


def cell_canonical(c: Column) -> Column:
    return F.when(c["short"].isNotNull(), canonical_decimal(c["short"])).otherwise(canonical(c["long"]))


def cell_within_symmetric_bps(left: Column, right: Column, tolerance: str | Column) -> Column:
    return _of_pair(
        left,
        right,
        lambda a, b: numeric.within_symmetric_bps(a, b, tolerance),
        lambda a, b: within_symmetric_bps(a, b, tolerance),
    )


def cell_symmetric_bps(left: Column, right: Column) -> Column:
    return _of_pair(left, right, numeric.symmetric_bps, symmetric_bps)


def _of_pair(left: Column, right: Column, of_short, of_long) -> Column:
    """One answer for two cells, by decimals where both are short."""

    def spread(c: Column) -> Column:
        return F.coalesce(c["long"], number(c["short"].cast("string")))

    pair = F.transform(F.array(left, right), spread)
    both = left["short"].isNotNull() & right["short"].isNotNull()
    return F.when(both, of_short(left["short"], right["short"])).otherwise(let(pair, lambda p: of_long(p[0], p[1])))


def _number(sign: Column, exponent: Column, digits: Column) -> Column:
    return F.struct(sign.cast("int").alias("sign"), exponent.cast("bigint").alias("exponent"), digits.alias("digits"))
