"""Calendar arithmetic with a stated rounding, durations of months and days, and closed periods.

A duration is STRUCT<months INT, days INT>, a period STRUCT<begin DATE, end DATE>; both ends belong to it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DOWN, UP, ABORT = "down", "up", "abort"

#: Names in order.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _c(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def duration(years: Column | int = 0, months: Column | int = 0, days: Column | int = 0) -> Column:
    return F.struct((_c(years) * 12 + _c(months)).cast("int").alias("months"), _c(days).cast("int").alias("days"))


def from_text(text: Column) -> Column:
    """A day written YYYY-MM-DD; null for anything else and for days that do not exist."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), text.try_cast("date"))


def plus(day: Column, span: Column, rounding: str = ABORT) -> Column:
    """Months first, rounded once where the month lacks the day, then days.

    down: the last day of that month; up: the first of the next; abort: raises.
    """
    moved = F.add_months(day, span["months"])
    short = F.dayofmonth(moved) < F.dayofmonth(day)
    if rounding == UP:
        moved = F.when(short, F.date_add(moved, 1)).otherwise(moved)
    elif rounding == ABORT:
        moved = F.when(short, F.raise_error(F.lit("the month lacks the day")).cast("date")).otherwise(moved)
    return F.date_add(moved, span["days"])


def minus(day: Column, span: Column, rounding: str = ABORT) -> Column:
    return plus(day, negated(span), rounding)


def between(later: Column, earlier: Column) -> Column:
    return duration(days=F.date_diff(later, earlier))


def negated(span: Column) -> Column:
    return F.struct((-span["months"]).alias("months"), (-span["days"]).alias("days"))


def added(a: Column, b: Column) -> Column:
    return F.struct((a["months"] + b["months"]).alias("months"), (a["days"] + b["days"]).alias("days"))


def times(span: Column, k: Column | int) -> Column:
    return F.struct((span["months"] * _c(k)).cast("int").alias("months"), (span["days"] * _c(k)).cast("int").alias("days"))


def comparable(a: Column, b: Column) -> Column:
    """-1, 0 or 1; raises unless both are of months alone or both of days alone."""
    order = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return (
        F.when((a["months"] == b["months"]) & (a["days"] == b["days"]), 0)
        .when((a["months"] == 0) & (b["months"] == 0), order(a["days"], b["days"]))
        .when((a["days"] == 0) & (b["days"] == 0), order(a["months"], b["months"]))
        .otherwise(F.raise_error(F.lit("durations of months and of days cannot be compared")).cast("int"))
    )


def over(a: Column, b: Column) -> Column:
    """How many times b goes into a, as DOUBLE; raises unless both are of days alone."""
    return F.when((a["months"] == 0) & (b["months"] == 0), a["days"] / b["days"].cast("double")).otherwise(F.raise_error(F.lit("only days can be divided")).cast("double"))


def show_duration(span: Column) -> Column:
    return F.format_string("[%d years, %d months, %d days]", (span["months"] / 12).cast("int"), span["months"] % 12, span["days"])


def read_duration(text: Column) -> Column:
    """The form show_duration gives, without signs; null for anything else."""
    part = lambda i: F.regexp_extract(text, r"^\[([0-9]+) years, ([0-9]+) months, ([0-9]+) days\]$", i).try_cast("int")
    return F.when(part(1).isNotNull(), duration(part(1), part(2), part(3)))


def first_of_month(day: Column) -> Column:
    return F.trunc(day, "MM")


def first_of_year(day: Column) -> Column:
    return F.trunc(day, "YYYY")


def last_of_year(day: Column) -> Column:
    return F.make_date(F.year(day), F.lit(12), F.lit(31))


def month_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))


def month_number(name: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, MONTHS)), name).cast("int")
    return F.when(at > 0, at).otherwise(F.raise_error(F.concat(F.lit("no month: "), name)).cast("int"))


def day_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), F.weekday(day) + 1)


def leap(day: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(F.year(day), F.lit(2), F.lit(1)))) == 29


def old_enough(birth: Column, years: int, at: Column, rounding: str = DOWN) -> Column:
    return at >= plus(birth, duration(years=years), rounding)


def young_enough(birth: Column, years: int, at: Column, rounding: str = DOWN) -> Column:
    return at <= plus(birth, duration(years=years), rounding)


def period(begin: Column, end: Column) -> Column:
    return F.struct(begin.alias("begin"), end.alias("end"))


def month_period(day: Column) -> Column:
    return period(first_of_month(day), F.last_day(day))


def valid(p: Column) -> Column:
    return p["begin"] <= p["end"]


def length(p: Column) -> Column:
    return F.date_diff(p["end"], p["begin"]) + 1


def adjacent(a: Column, b: Column) -> Column:
    return a["end"] == F.date_sub(b["begin"], 1)


def hull(a: Column, b: Column) -> Column:
    return period(F.least(a["begin"], b["begin"]), F.greatest(a["end"], b["end"]))


def covers(p: Column, day: Column) -> Column:
    return day.between(p["begin"], p["end"])


def contained(a: Column, b: Column) -> Column:
    return (a["begin"] >= b["begin"]) & (a["end"] <= b["end"])


def overlap(a: Column, b: Column) -> Column:
    """The days in both; null where there are none."""
    both = period(F.greatest(a["begin"], b["begin"]), F.least(a["end"], b["end"]))
    return F.when(valid(both), both)


def find_period(periods: Column, day: Column) -> Column:
    """The first of a list that holds the day, or null."""
    return F.get(F.filter(periods, lambda p: covers(p, day)), F.lit(0))


def split_by_month(p: Column) -> Column:
    """Slices that end with their month; the last ends with the period. A period of one day or less gives none."""
    firsts = F.when(p["begin"] < p["end"], F.sequence(first_of_month(p["begin"]), F.date_sub(p["end"], 1), F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return _slices(p, firsts)


def _slices(p: Column, firsts: Column) -> Column:
    """From each start to the day before the next; the last slice keeps the period's end."""
    n = F.size(firsts)
    return F.transform(
        firsts,
        lambda m, i: period(F.greatest(m, p["begin"]), F.when(i == n - 1, p["end"]).otherwise(F.date_sub(F.coalesce(F.get(firsts, i + 1), p["end"]), 1))),
    )


def split_by_year(p: Column, start_month: int) -> Column:
    """As split_by_month, for years that begin with start_month."""
    this = F.make_date(F.year(p["begin"]), F.lit(start_month), F.lit(1))
    first = F.when(this > p["begin"], F.add_months(this, -12)).otherwise(this)
    firsts = F.when(p["begin"] < p["end"], F.sequence(first, F.date_sub(p["end"], 1), F.expr("interval 1 year"))).otherwise(F.array().cast("array<date>"))
    return _slices(p, firsts)


def sort_by_begin(pairs: Column) -> Column:
    """A list of STRUCT<p PERIOD, x> by begin; equal ones keep their order."""
    keyed = F.transform(pairs, lambda x, i: F.struct(x["p"]["begin"].alias("begin"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])
