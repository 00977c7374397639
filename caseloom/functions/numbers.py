"""Exact numbers: whole cents, ratios kept as numerator and denominator until they are rounded, clamps and sums.

All functions take and give Columns and stay null where an argument is null. Money is BIGINT cents; a product
beyond DECIMAL(38,0), or a result beyond BIGINT, raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def _c(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _div(a: Column, b: Column) -> Column:
    """Whole quotient, toward zero."""
    return F.call_function("div", a, b)


def mul_round(cents: Column | int, num: Column | int, den: Column | int) -> Column:
    """cents * num / den, half away from zero; a zero denominator raises.

    Numbers whose product surely fits BIGINT are worked out in it, the others in DECIMAL(38,0).
    """
    a, b, c = (_c(x).cast("bigint") for x in (cents, num, den))

    def half_away(n: Column, d: Column, kind: str) -> Column:
        twice = (F.abs(n) * 2 + F.abs(d)).cast(kind)
        sign = F.when((n < 0) == (d < 0), F.lit(1)).otherwise(-1)
        return (sign * _div(twice, (F.abs(d) * 2).cast(kind))).cast("bigint")

    small = a.between(-(1 << 40), 1 << 40) & b.between(-(1 << 20), 1 << 20) & c.between(-(1 << 60), 1 << 60)
    wide = half_away(_c(cents).cast(WIDE) * _c(num).cast(WIDE), _c(den).cast(WIDE), WIDE)
    return F.when(small, half_away(a * b, c, "bigint")).otherwise(wide)


def money_times(cents: Column, num: Column | int, den: Column | int = 1) -> Column:
    return mul_round(cents, num, den)


def money_over(cents: Column, num: Column | int, den: Column | int = 1) -> Column:
    return mul_round(cents, den, num)


def money_ratio(a: Column, b: Column) -> Column:
    """a / b as DOUBLE of the exact quotient; zero b raises."""
    return a.cast("double") / b.cast("double")


def whole_units(cents: Column) -> Column:
    """Rounded to whole units."""
    return mul_round(cents, 1, 100) * 100


def half_away(x: Column) -> Column:
    """A DECIMAL rounded to an integer."""
    return F.round(x, 0).cast("bigint")


def toward_zero(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("bigint")


def units_toward_zero(cents: Column) -> Column:
    return _div(cents, F.lit(100).cast("bigint")) * 100


def units_down(cents: Column) -> Column:
    return cents - F.pmod(cents, F.lit(100))


def units_up(cents: Column) -> Column:
    return cents + F.pmod(-cents, F.lit(100))


def round_money(cents: Column, places: int) -> Column:
    """Two places and more change nothing; none or fewer truncate to units first and then round."""
    if places >= 2:
        return cents
    if places == 1:
        return mul_round(cents, 1, 10) * 10
    step = 10 ** (-places)
    return mul_round(_div(cents, F.lit(100).cast("bigint")), 1, step) * (100 * step)


def capped(x: Column, most: Column | int) -> Column:
    return F.when(x.isNotNull(), F.least(x, _c(most)))


def at_least(x: Column, least: Column | int) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, _c(least)))


def positive(x: Column) -> Column:
    return at_least(x, 0)


def in_excess(x: Column, reference: Column) -> Column:
    return positive(x - reference)


def in_default(x: Column, reference: Column) -> Column:
    return positive(reference - x)


def log2_floor(x: Column) -> Column:
    """Exact for positive whole numbers; null otherwise."""
    return F.when(x > 0, F.length(F.bin(x)) - 1)


def power(x: Column, exponent: int) -> Column:
    """Whole power by repeated multiplication; raises where it leaves BIGINT."""
    out = F.lit(1).cast("bigint")
    for _ in range(exponent):
        out = out * x
    return out


def parse_cents(text: Column) -> Column:
    """Cents of an amount such as -$1,234.5; null where it is none."""
    clean = F.trim(text)
    fits = clean.rlike(r"^-?\$?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]{1,2})?$")
    return F.when(fits, (F.regexp_replace(clean, r"[$,]", "").try_cast("decimal(30,2)") * 100).cast("bigint"))


def show_cents(cents: Column) -> Column:
    """Whole amounts without, all others with two places."""
    a = F.abs(cents)
    sign = F.when(cents < 0, "-").otherwise("")
    units = _div(a, F.lit(100).cast("bigint")).cast("string")
    return F.when(cents % 100 == 0, F.concat(sign, units)).otherwise(F.concat(sign, units, F.lit("."), F.lpad((a % 100).cast("string"), 2, "0")))


def within_share(a: Column, b: Column, num: int, den: int) -> Column:
    """Whether a differs from b by at most that share of b, rounded to the cent."""
    return F.abs(a - b) <= mul_round(b, num, den)
