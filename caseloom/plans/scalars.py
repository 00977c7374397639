"""Queries over numbers, dates, periods and lists, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import dates as D
from caseloom.functions import lists as L
from caseloom.functions import numbers as N
from caseloom.plans.registry import query
from caseloom.session import read_table

LINE, ORDER = ("l_orderkey", "l_linenumber"), ("o_orderkey",)
SQL_LINE = "(select *, round(l_extendedprice * 100)::bigint as price, l_quantity::bigint as qty, round(l_tax * 100)::bigint as tax, l_shipdate::date as day from lineitem)"
SQL_ORDER = "(select *, round(o_totalprice * 100)::bigint as price, o_orderdate::date as day from orders)"


def _bind() -> None:
    """The columns that the cells below are made of; columns need a running session."""
    global PRICE, QTY, TAX, ODAY, _AT, _SPAN, _MAY, _P, _Q, _BAG
    PRICE, QTY = F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.col("l_quantity").cast("bigint")
    TAX, ODAY = F.round(F.col("l_tax") * 100).cast("bigint"), F.col("o_orderdate").cast("date")
    _AT, _SPAN = F.lit("2014-02-28").cast("date"), D.duration(months=F.month(ODAY), days=F.dayofmonth(ODAY))
    _MAY = D.month_period(F.lit("1996-05-10").cast("date"))
    _P = D.period(ODAY, F.date_add(ODAY, (F.col("o_orderkey") % 100).cast("int")))
    _Q, _BAG = D.period(F.date_add(ODAY, 30), F.date_add(ODAY, 60)), F.array(QTY, TAX, F.col("l_linenumber").cast("bigint"))


def scalar(name: str, table: str, keys: tuple[str, ...], cells: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A query of keys and computed cells over a whole table, with its SQL."""
    source = {"lineitem": SQL_LINE, "orders": SQL_ORDER}[table]
    sql = f"select {', '.join(keys)}, {', '.join(f'{s} as {c}' for c, (_, s) in cells.items())} from {source}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        _bind()
        return read_table(spark, d, table).select(*keys, *[e().alias(c) for c, (e, _) in cells.items()])

    query(name, sql)(run)


def half(n: str, d: str) -> str:
    return f"(sign({n}) * ((2 * abs({n}) + {d}) // (2 * {d})))::bigint"


iso = lambda c: F.date_format(c, "yyyy-MM-dd")

scalar("a_01", "lineitem", LINE, {"plus": (lambda: PRICE + QTY, "price + qty"), "minus": (lambda: PRICE - QTY, "price - qty"), "times": (lambda: QTY * QTY, "qty * qty"), "negative": (lambda: -QTY, "-qty")})
scalar("a_02", "lineitem", LINE, {"quotient": (lambda: F.round(QTY.cast("double") / 7, 9), "round(qty::double / 7, 9)")})
scalar("a_03", "lineitem", LINE, {"whole": (lambda: N.toward_zero((25 - F.col("l_quantity")) * F.col("l_discount")), "trunc((25 - l_quantity) * l_discount)::bigint")})
scalar("a_04", "lineitem", LINE, {"tenfold": (lambda: (F.col("l_quantity").cast("decimal(20,2)") * 3 - 1).cast("double"), "(l_quantity::decimal(20,2) * 3 - 1)::double")})
scalar("a_05", "lineitem", LINE, {"plus": (lambda: PRICE + TAX, "price + tax"), "minus": (lambda: TAX - PRICE, "tax - price")})
scalar("a_06", "lineitem", LINE, {"share": (lambda: N.money_times(PRICE, TAX, 100), half("(price::hugeint * tax)", "100")), "back": (lambda: N.money_times(-PRICE, 1, 2), half("(-price)", "2"))})
scalar("a_07", "lineitem", LINE, {"part": (lambda: N.money_over(PRICE, QTY), half("price", "qty")), "third": (lambda: N.money_over(PRICE, 3), half("price", "3"))})
scalar("a_08", "lineitem", LINE, {"ratio": (lambda: F.round(N.money_ratio(PRICE, PRICE + TAX), 9), "round(price::double / (price + tax)::double, 9)")})
scalar("a_09", "lineitem", LINE, {"less": (lambda: PRICE < QTY * 100000, "price < qty * 100000"), "same": (lambda: QTY == TAX, "qty = tax"), "least": (lambda: PRICE >= 5000000, "price >= 5000000")})
scalar("a_10", "lineitem", LINE, {"lenient": (lambda: F.round(F.try_divide(PRICE.cast("double"), TAX), 6), "round(case when tax <> 0 then price::double / tax end, 6)")})
scalar("a_11", "lineitem", LINE, {"rounded": (lambda: N.half_away(-F.col("l_quantity").cast("decimal(20,2)") / 2), half("(-qty)", "2"))})
scalar("a_12", "lineitem", LINE, {"units": (lambda: N.whole_units(PRICE), half("price", "100") + " * 100")})
scalar("a_14", "lineitem", LINE, {"cents": (lambda: N.parse_cents(N.show_cents(PRICE)), "price"), "text": (lambda: N.show_cents(PRICE), "case when price % 100 = 0 then (price // 100)::varchar else (price // 100)::varchar || '.' || lpad((price % 100)::varchar, 2, '0') end")})
scalar("a_16", "orders", ORDER, {"number": (lambda: F.col("o_orderkey").cast("string").cast("bigint"), "o_orderkey"), "text": (lambda: F.col("o_orderkey").cast("string"), "o_orderkey::varchar")})
scalar("a_17", "orders", ORDER, {"log2": (lambda: N.log2_floor(F.col("o_orderkey")).cast("bigint"), "case when o_orderkey > 0 then floor(log2(o_orderkey))::bigint end")})
scalar("a_18", "lineitem", LINE, {"cube": (lambda: N.power(QTY, 3), "qty * qty * qty"), "none": (lambda: N.power(QTY, 0), "1::bigint")})
scalar("a_19", "lineitem", LINE, {"both": (lambda: (QTY > 10) & (TAX > 3), "qty > 10 and tax > 3"), "either": (lambda: (QTY > 40) | ~(TAX > 3), "qty > 40 or not tax > 3"), "one": (lambda: (QTY > 25) != (TAX > 3), "(qty > 25) <> (tax > 3)")})
scalar("a_20", "lineitem", LINE, {"band": (lambda: F.when(QTY > 30, "many").otherwise("few"), "case when qty > 30 then 'many' else 'few' end")})
scalar("a_23", "lineitem", LINE, {"total": (lambda: F.struct(PRICE.alias("p"), TAX.alias("t")).withField("t", TAX + 1)["t"], "tax + 1"), "kept": (lambda: F.struct(PRICE.alias("p"), TAX.alias("t")).withField("t", TAX + 1)["p"], "price")})
scalar("a_24", "lineitem", LINE, {"flag": (lambda: F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted").otherwise("open"), "case l_returnflag when 'R' then 'returned' when 'A' then 'accepted' else 'open' end")})
scalar("a_25", "lineitem", LINE, {"hit": (lambda: (F.col("l_returnflag") == "R") & (QTY > 20), "l_returnflag = 'R' and qty > 20")})
scalar("n_01", "lineitem", LINE, {"low": (lambda: F.least(PRICE, QTY * 90000), "least(price, qty * 90000)"), "high": (lambda: F.greatest(PRICE, QTY * 90000), "greatest(price, qty * 90000)")})
scalar("n_02", "lineitem", LINE, {"capped": (lambda: N.capped(PRICE, 3000000), "least(price, 3000000)")})
scalar("n_03", "lineitem", LINE, {"raised": (lambda: N.at_least(PRICE, 3000000), "greatest(price, 3000000)")})
scalar("n_04", "lineitem", LINE, {"positive": (lambda: N.positive(QTY - 25), "greatest(qty - 25, 0)")})
scalar("n_05", "lineitem", LINE, {"total": (lambda: L.total(F.array(PRICE, QTY, TAX)), "price + qty + tax"), "nothing": (lambda: L.total(F.array().cast("array<bigint>")), "0::bigint")})
scalar("n_06", "lineitem", LINE, {"units": (lambda: N.units_toward_zero(-PRICE), "-(price // 100) * 100")})
scalar("n_07", "lineitem", LINE, {"units": (lambda: N.units_down(-PRICE), "-((price + 99) // 100) * 100")})
scalar("n_08", "lineitem", LINE, {"units": (lambda: N.units_up(PRICE), "((price + 99) // 100) * 100")})
scalar("n_09", "lineitem", LINE, {"hundreds": (lambda: F.round(PRICE, -2).cast("bigint"), half("price", "100") + " * 100")})
scalar("n_10", "lineitem", LINE, {"tenths": (lambda: N.round_money(PRICE, 1), half("price", "10") + " * 10"), "tens": (lambda: N.round_money(PRICE, -1), half("(price // 100)", "10") + " * 1000"), "same": (lambda: N.round_money(PRICE, 2), "price")})
scalar("n_11", "lineitem", LINE, {"excess": (lambda: N.in_excess(PRICE, F.lit(2500000)), "greatest(price - 2500000, 0)"), "default_": (lambda: N.in_default(PRICE, F.lit(2500000)), "greatest(2500000 - price, 0)")})

scalar("t_01", "orders", ORDER, {"day": (lambda: iso(F.make_date(F.year(ODAY), F.month(ODAY), F.lit(1))), "strftime(make_date(year(day), month(day), 1), '%Y-%m-%d')")})
scalar("t_02", "orders", ORDER, {"y": (lambda: F.year(ODAY), "year(day)::int"), "m": (lambda: F.month(ODAY), "month(day)::int"), "d": (lambda: F.dayofmonth(ODAY), "day(day)::int")})
scalar("t_03", "orders", ORDER, {"text": (lambda: iso(D.from_text(iso(ODAY))), "strftime(day, '%Y-%m-%d')"), "none": (lambda: iso(D.from_text(F.concat(iso(ODAY), F.lit("x")))), "null::varchar")})
_SHORT = "day(day + interval 13 month) < day(day)"
scalar("t_04", "orders", ORDER, {
    "down": (lambda: iso(D.plus(ODAY, D.duration(1, 1, 3), D.DOWN)), "strftime((day + interval 13 month)::date + 3, '%Y-%m-%d')"),
    "up": (lambda: iso(D.plus(ODAY, D.duration(1, 1, 3), D.UP)), f"strftime((day + interval 13 month)::date + 3 + case when {_SHORT} then 1 else 0 end, '%Y-%m-%d')"),
    "exact": (lambda: iso(D.plus(ODAY, D.duration(days=40))), "strftime(day + 40, '%Y-%m-%d')"),
})
scalar("t_05", "orders", ORDER, {"later": (lambda: iso(F.date_add(ODAY, 45)), "strftime(day + 45, '%Y-%m-%d')"), "earlier": (lambda: iso(F.date_add(ODAY, -45)), "strftime(day - 45, '%Y-%m-%d')")})
scalar("t_06", "orders", ORDER, {"back": (lambda: iso(D.minus(ODAY, D.duration(0, 1, 2), D.DOWN)), "strftime((day - interval 1 month)::date - 2, '%Y-%m-%d')")})
scalar("t_07", "orders", ORDER, {"days": (lambda: D.between(ODAY, F.lit("1995-01-01").cast("date"))["days"], "(day - date '1995-01-01')::int")})
scalar("t_08", "orders", ORDER, {"there": (lambda: iso(D.minus(D.plus(ODAY, D.duration(days=9)), D.duration(days=4))), "strftime(day + 5, '%Y-%m-%d')")})
scalar("t_09", "orders", ORDER, {"first": (lambda: iso(F.least(ODAY, F.lit("1996-06-15").cast("date"))), "strftime(least(day, date '1996-06-15'), '%Y-%m-%d')"), "after": (lambda: ODAY > F.lit("1996-06-15").cast("date"), "day > date '1996-06-15'")})
scalar("t_10", "orders", ORDER, {
    "m1": (lambda: iso(D.first_of_month(ODAY)), "strftime(date_trunc('month', day), '%Y-%m-%d')"), "m2": (lambda: iso(F.last_day(ODAY)), "strftime(last_day(day), '%Y-%m-%d')"),
    "y1": (lambda: iso(D.first_of_year(ODAY)), "strftime(date_trunc('year', day), '%Y-%m-%d')"), "y2": (lambda: iso(D.last_of_year(ODAY)), "strftime(make_date(year(day), 12, 31), '%Y-%m-%d')"),
})
scalar("t_11", "orders", ORDER, {"old": (lambda: D.old_enough(ODAY, 18, _AT), "date '2014-02-28' >= (day + interval 18 year)::date"), "young": (lambda: D.young_enough(ODAY, 18, _AT), "date '2014-02-28' <= (day + interval 18 year)::date")})
scalar("t_12", "orders", ORDER, {"name": (lambda: D.month_name(ODAY), "monthname(day)"), "number": (lambda: D.month_number(D.month_name(ODAY)), "month(day)::int")})
scalar("t_13", "orders", ORDER, {"name": (lambda: D.day_name(ODAY), "dayname(day)")})
scalar("t_14", "orders", ORDER, {"months": (lambda: D.times(D.added(_SPAN, D.negated(D.duration(months=1))), 3)["months"], "(3 * (month(day) - 1))::int"), "days": (lambda: D.times(_SPAN, 3)["days"], "(3 * day(day))::int")})
scalar("t_15", "orders", ORDER, {"times": (lambda: F.round(D.over(D.duration(days=F.dayofmonth(ODAY)), D.duration(days=7)), 9), "round(day(day) / 7.0::double, 9)")})
scalar("t_16", "orders", ORDER, {"order_": (lambda: D.comparable(D.duration(days=F.dayofmonth(ODAY)), D.duration(days=15)), "sign(day(day) - 15)::int")})
scalar("t_17", "orders", ORDER, {"days": (lambda: D.between(F.last_day(ODAY), ODAY)["days"], "(last_day(day) - day)::int")})
scalar("t_18", "orders", ORDER, {"begin_": (lambda: iso(D.month_period(ODAY)["begin"]), "strftime(date_trunc('month', day), '%Y-%m-%d')"), "end_": (lambda: iso(D.month_period(ODAY)["end"]), "strftime(last_day(day), '%Y-%m-%d')")})
scalar("t_19", "orders", ORDER, {"in_it": (lambda: D.covers(_MAY, ODAY), "day between date '1996-05-01' and date '1996-05-31'"), "before": (lambda: ODAY < _MAY["begin"], "day < date '1996-05-01'"), "after": (lambda: ODAY > _MAY["end"], "day > date '1996-05-31'")})
scalar("t_20", "orders", ORDER, {"leap": (lambda: D.leap(ODAY), "day(last_day(make_date(year(day), 2, 1))) = 29"), "days": (lambda: F.dayofmonth(F.last_day(ODAY)), "day(last_day(day))::int")})
scalar("t_21", "orders", ORDER, {"up": (lambda: iso(D.plus(ODAY, D.duration(months=1), D.UP)), "strftime((day + interval 1 month)::date + case when day((day + interval 1 month)::date) < day(day) then 1 else 0 end, '%Y-%m-%d')")})
scalar("t_22", "orders", ORDER, {"text": (lambda: D.show_duration(_SPAN), "'[' || month(day) // 12 || ' years, ' || month(day) % 12 || ' months, ' || day(day) || ' days]'"), "days": (lambda: D.read_duration(D.show_duration(_SPAN))["days"], "day(day)::int")})
scalar("t_23", "orders", ORDER, {"less": (lambda: F.struct(F.year(ODAY), F.month(ODAY)) < F.struct(F.lit(1996), F.lit(6)), "year(day) < 1996 or year(day) = 1996 and month(day) < 6")})

_END = "(day + (o_orderkey % 100)::int)"
scalar("p_01", "orders", ORDER, {"begin_": (lambda: iso(D.month_period(ODAY)["begin"]), "strftime(date_trunc('month', day), '%Y-%m-%d')"), "end_": (lambda: iso(D.month_period(ODAY)["end"]), "strftime(last_day(day), '%Y-%m-%d')")})
scalar("p_02", "orders", ORDER, {"valid": (lambda: D.valid(D.period(F.date_add(ODAY, 50), _P["end"])), f"day + 50 <= {_END}")})
scalar("p_03", "orders", ORDER, {"days": (lambda: D.length(_P), "(o_orderkey % 100 + 1)::int")})
scalar("p_04", "orders", ORDER, {"adjacent": (lambda: D.adjacent(_P, _Q), "o_orderkey % 100 = 29")})
scalar("p_05", "orders", ORDER, {"end_": (lambda: iso(D.hull(_P, _Q)["end"]), f"strftime(greatest({_END}, day + 60), '%Y-%m-%d')")})
scalar("p_06", "orders", ORDER, {"covers": (lambda: D.covers(_P, F.date_add(ODAY, 33)), "o_orderkey % 100 >= 33"), "contained": (lambda: D.contained(_Q, _P), "o_orderkey % 100 >= 60")})
scalar("p_07", "orders", ORDER, {"begin_": (lambda: iso(D.overlap(_P, _Q)["begin"]), "case when o_orderkey % 100 >= 30 then strftime(day + 30, '%Y-%m-%d') end"), "end_": (lambda: iso(D.overlap(_P, _Q)["end"]), f"case when o_orderkey % 100 >= 30 then strftime(least({_END}, day + 60), '%Y-%m-%d') end")})
scalar("p_08", "orders", ORDER, {"found": (lambda: iso(D.find_period(F.array(_Q, _P), F.date_add(ODAY, 40))["begin"]), "strftime(day + 30, '%Y-%m-%d')"), "none": (lambda: iso(D.find_period(F.array(_Q), ODAY)["begin"]), "null::varchar")})

_SBAG = "[qty, tax, l_linenumber::bigint]"
scalar("l_01", "lineitem", LINE, {"many": (lambda: L.total(F.filter(_BAG, lambda x: x > 3)), f"coalesce(list_sum(list_filter({_SBAG}, lambda x: x > 3)), 0)::bigint")})
scalar("l_02", "lineitem", LINE, {"twice": (lambda: L.total(F.transform(_BAG, lambda x: x * 2)), "2 * (qty + tax + l_linenumber)::bigint")})
scalar("l_03", "lineitem", LINE, {"some": (lambda: L.total(F.transform(F.filter(_BAG, lambda x: x > 3), lambda x: x + 1)), f"coalesce(list_sum(list_transform(list_filter({_SBAG}, lambda x: x > 3), lambda x: x + 1)), 0)::bigint")})
scalar("l_04", "lineitem", LINE, {"inner_": (lambda: L.total(L.zip_map(_BAG, F.array(QTY, QTY, QTY), lambda a, b: a * b)), "((qty + tax + l_linenumber) * qty)::bigint")})
scalar("l_05", "lineitem", LINE, {"fold": (lambda: F.aggregate(_BAG, F.lit(7).cast("bigint"), lambda a, x: a * 2 + x), "(((14 + qty) * 2 + tax) * 2 + l_linenumber)::bigint")})
scalar("l_06", "lineitem", LINE, {"most": (lambda: L.reduce_or(_BAG, lambda a, x: F.greatest(a, x), F.lit(0).cast("bigint")), "greatest(qty, tax, l_linenumber)::bigint"), "none": (lambda: L.reduce_or(F.slice(_BAG, 1, 0), lambda a, x: a + x, F.lit(-1).cast("bigint")), "(-1)::bigint")})
scalar("l_07", "lineitem", LINE, {"n": (lambda: F.size(F.filter(_BAG, lambda x: x > 4)), f"len(list_filter({_SBAG}, lambda x: x > 4))::int")})
scalar("l_08", "lineitem", LINE, {"total": (lambda: L.total(_BAG), "(qty + tax + l_linenumber)::bigint")})
scalar("l_09", "lineitem", LINE, {"most": (lambda: L.largest_or(F.filter(_BAG, lambda x: x > 5), F.lit(0).cast("bigint")), f"coalesce(list_max(list_filter({_SBAG}, lambda x: x > 5)), 0)::bigint"), "least": (lambda: L.smallest_or(_BAG, F.lit(0).cast("bigint")), "least(qty, tax, l_linenumber)::bigint")})
scalar("l_10", "lineitem", LINE, {"near": (lambda: L.arg_least(_BAG, lambda x: F.abs(x - 5)), f"(select x from (select unnest({_SBAG}) as x, unnest([1, 2, 3]) as i) order by abs(x - 5), i limit 1)::bigint")})
scalar("l_11", "lineitem", LINE, {"has": (lambda: F.array_contains(_BAG, F.lit(3).cast("bigint")), f"list_contains({_SBAG}, 3)")})
scalar("l_12", "lineitem", LINE, {"any_": (lambda: F.exists(_BAG, lambda x: x > 45), "greatest(qty, tax, l_linenumber) > 45")})
scalar("l_13", "lineitem", LINE, {"all_": (lambda: L.every(_BAG, lambda x: x > 1), "least(qty, tax, l_linenumber) > 1"), "none": (lambda: L.every(F.slice(_BAG, 1, 0), lambda x: x > 99), "true")})
scalar("l_14", "lineitem", LINE, {"n": (lambda: F.size(F.concat(_BAG, _BAG)), "6::int")})
scalar("l_15", "lineitem", LINE, {"same": (lambda: _BAG == F.array(QTY, QTY, QTY), "qty = tax and qty = l_linenumber")})
scalar("l_16", "lineitem", LINE, {"n": (lambda: F.size(L.sequence(TAX, QTY)), "greatest(qty - tax, 0)::int"), "last": (lambda: L.last(L.sequence(TAX, QTY)), "case when qty > tax then qty - 1 end")})
scalar("l_17", "lineitem", LINE, {"at": (lambda: L.nth(_BAG, F.col("l_linenumber") - 1), f"case when l_linenumber between 2 and 4 then {_SBAG}[l_linenumber - 1] end")})
scalar("l_18", "lineitem", LINE, {"first": (lambda: F.get(_BAG, F.lit(0)), "qty"), "last": (lambda: L.last(_BAG), "l_linenumber::bigint")})
scalar("l_19", "lineitem", LINE, {"left_": (lambda: L.total(L.without_nth(_BAG, F.col("l_linenumber"))), f"(qty + tax + l_linenumber - case when l_linenumber <= 3 then {_SBAG}[l_linenumber] else 0 end)::bigint")})
scalar("l_20", "lineitem", LINE, {"first": (lambda: F.get(F.reverse(_BAG), F.lit(0)), "l_linenumber::bigint")})


@query("p_09", """select o_orderkey, strftime(greatest(m, day), '%Y-%m-%d') as begin_, strftime(case when m = max(m) over (partition by o_orderkey) then day + n else last_day(m) end, '%Y-%m-%d') as end_
  from (select o_orderkey, o_orderdate::date as day, (o_orderkey % 100)::int as n from orders) o, lateral (select unnest(generate_series(date_trunc('month', day), (day + n - 1)::timestamp, interval 1 month))::date as m) s where n > 0""")
def p_09(spark: SparkSession, d: str) -> DataFrame:
    """Periods cut by month."""
    _bind()
    rows = read_table(spark, d, "orders").select("o_orderkey", F.explode(D.split_by_month(_P)).alias("s"))
    return rows.select("o_orderkey", iso(F.col("s.begin")).alias("begin_"), iso(F.col("s.end")).alias("end_"))


@query("p_10", """select o_orderkey, strftime(greatest(m, day), '%Y-%m-%d') as begin_, strftime(case when m = max(m) over (partition by o_orderkey) then day + n else (m + interval 1 year)::date - 1 end, '%Y-%m-%d') as end_
  from (select o_orderkey, o_orderdate::date as day, (o_orderkey % 900)::int as n from orders) o,
  lateral (select unnest(generate_series((case when make_date(year(day), 4, 1) > day then make_date(year(day) - 1, 4, 1) else make_date(year(day), 4, 1) end)::timestamp, (day + n - 1)::timestamp, interval 1 year))::date as m) s where n > 0""")
def p_10(spark: SparkSession, d: str) -> DataFrame:
    """Periods cut by years that begin in April."""
    _bind()
    p = D.period(ODAY, F.date_add(ODAY, (F.col("o_orderkey") % 900).cast("int")))
    rows = read_table(spark, d, "orders").select("o_orderkey", F.explode(D.split_by_year(p, 4)).alias("s"))
    return rows.select("o_orderkey", iso(F.col("s.begin")).alias("begin_"), iso(F.col("s.end")).alias("end_"))


@query("p_11", "select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderdate, o_orderkey) as order_ from orders group by o_custkey")
def p_11(spark: SparkSession, d: str) -> DataFrame:
    """A customer's periods sorted by their begin, equal ones in the order they came in."""
    came = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderdate")))
    rows = read_table(spark, d, "orders").groupBy("o_custkey").agg(came.alias("came"))
    pairs = F.transform("came", lambda o: F.struct(F.struct(o["o_orderdate"].alias("begin"), o["o_orderdate"].alias("end")).alias("p"), o["o_orderkey"].alias("x")))
    return rows.select("o_custkey", F.array_join(F.transform(D.sort_by_begin(pairs), lambda x: x["x"].cast("string")), ",").alias("order_"))


scalar("a_13", "lineitem", LINE, {"rounded": (lambda: F.round(F.col("l_quantity").cast("decimal(20,2)") / 4, 0).cast("double"), f"({half('qty', '4')})::double")})
scalar("a_15", "lineitem", LINE, {"units": (lambda: N.mul_round(PRICE, 1, 100), half("price", "100")), "half_of": (lambda: N.mul_round(PRICE, F.split(F.lit("1/2"), "/")[0].cast("bigint"), F.split(F.lit("1/2"), "/")[1].cast("bigint")), half("price", "2"))})
scalar("a_21", "lineitem", LINE, {"twice": (lambda: (lambda x: x + x)(PRICE - QTY), "2 * (price - qty)")})
scalar("d_06", "lineitem", LINE, {"v": (lambda: F.when((F.col("l_returnflag") != "N") & (QTY > 10), "large").when((F.col("l_returnflag") != "N") & (QTY <= 10), "small"), "case when l_returnflag <> 'N' then case when qty > 10 then 'large' else 'small' end end")})
scalar("d_09", "lineitem", LINE, {"v": (lambda: F.when(QTY > 0, QTY).otherwise(F.raise_error(F.lit("impossible")).cast("bigint")), "qty")})
scalar("l_21", "lineitem", LINE, {"only": (lambda: F.when(F.size(F.filter(_BAG, lambda x: x == QTY)) == 1, QTY), f"case when len(list_filter({_SBAG}, lambda x: x = qty)) = 1 then qty end")})
scalar("c_23", "orders", ORDER, {"same": (lambda: F.abs(F.col("o_totalprice") - F.round(F.col("o_totalprice"), 0)) <= 0.005, "abs(o_totalprice - round(o_totalprice, 0)) <= 0.005")})
