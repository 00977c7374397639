"""Queries over test cases, decisions and rule source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions import numbers as N
from caseloom.operators import cases as C
from caseloom.operators import decisions as R
from caseloom.operators import graphs as G
from caseloom.operators import structural_csv as S
from caseloom.operators.decisions import Rule
from caseloom.operators.observations import unpacked
from caseloom.plans import registry
from caseloom.plans.logs import TOLD
from caseloom.session import materialize, read_table

LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
SRC = "(select *, l_quantity::bigint as qty, round(l_extendedprice * 100)::bigint as price from lineitem)"


def _bind() -> None:
    """The columns that the queries below are made of; columns need a running session."""
    global QTY, PRICE, CODES, _SCORES
    QTY, PRICE = F.col("l_quantity").cast("bigint"), F.round(F.col("l_extendedprice") * 100).cast("bigint")
    CODES = {"MANY": QTY > 40, "DEAR": PRICE > 6000000, "RETURNED": F.col("l_returnflag") == "R"}
    _SCORES = [QTY % 5 + 1, PRICE % 5 + 1, F.col("l_partkey") % 5 + 1, F.when(F.col("l_suppkey") % 9 > 0, F.col("l_suppkey") % 5 + 1)]


def query(name: str, sql: str | None = None) -> Callable[[registry.Query], registry.Query]:
    """Registers a query that starts with its columns bound."""

    def put(run: registry.Query) -> registry.Query:
        def bound(spark: SparkSession, d: str) -> DataFrame:
            _bind()
            return run(spark, d)

        return registry.query(name, sql)(bound)

    return put


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem")


# ------------------------------------------------------------------- decisions


@query("d_01", f"select l_orderkey, l_linenumber, l_quantity, qty * 2 + 1 as v from {SRC}")
def d_01(spark: SparkSession, d: str) -> DataFrame:
    """A plain definition."""
    return _lines(spark, d).select(*LINE, (QTY * 2 + 1).alias("v"))


@query("d_02", f"select l_orderkey, l_linenumber, l_quantity, case when qty < 20 and qty % 2 = 0 then null when qty < 20 then 'small' when qty % 2 = 0 then 'even' end as v, case when qty < 20 and qty % 2 = 0 then 'conflict' when qty < 20 or qty % 2 = 0 then 'value' else 'none' end as status from {SRC}")
def d_02(spark: SparkSession, d: str) -> DataFrame:
    """Guarded definitions of which exactly one must hold; others are reported."""
    rules = [Rule("small", QTY < 20, F.lit("small")), Rule("even", QTY % 2 == 0, F.lit("even"))]
    return _lines(spark, d).select(*LINE, R.resolve(rules, strict=False).alias("v"), R.status(rules).alias("status"))


@query("d_03", f"select l_orderkey, l_linenumber, l_quantity, case when l_returnflag = 'R' and qty > 40 then 'large return' when l_returnflag = 'R' then 'return' else 'sale' end as v from {SRC}")
def d_03(spark: SparkSession, d: str) -> DataFrame:
    """An exception of an exception comes first."""
    base = Rule("base", F.lit(True), F.lit("sale"), [Rule("returned", F.col("l_returnflag") == "R", F.lit("return"), [Rule("large", (F.col("l_returnflag") == "R") & (QTY > 40), F.lit("large return"))])])
    return _lines(spark, d).select(*LINE, R.resolve([base]).alias("v"))


@query("d_04", f"select l_orderkey, l_linenumber, l_quantity, (case when qty > 30 then 1 else 0 end + case when l_returnflag = 'R' then 1 else 0 end) as firing from {SRC}")
def d_04(spark: SparkSession, d: str) -> DataFrame:
    """How many exceptions fire."""
    fired = F.array_compact(F.array(F.when(QTY > 30, "many"), F.when(F.col("l_returnflag") == "R", "returned")))
    return _lines(spark, d).select(*LINE, F.size(fired).alias("firing"))


@query("d_05", f"select l_orderkey, l_linenumber, l_quantity, case when qty > 30 or l_returnflag = 'R' then 'check' else 'pass' end as v from {SRC}")
def d_05(spark: SparkSession, d: str) -> DataFrame:
    """Rules of one consequence do not conflict."""
    rule = Rule("base", F.lit(True), F.lit("pass"), [Rule("many", QTY > 30, F.lit("check")), Rule("returned", F.col("l_returnflag") == "R", F.lit("check"))])
    return _lines(spark, d).select(*LINE, R.resolve([rule]).alias("v"))


@query("d_07", "select line_no, log, coalesce(exit_code = 0, false) as fulfilled from session_event")
def d_07(spark: SparkSession, d: str) -> DataFrame:
    """A condition that is unknown is not fulfilled."""
    return read_table(spark, d, "session_event").select("line_no", "log", R.fulfilled(F.col("exit_code") == 0).alias("fulfilled"))


@query("d_08", "select doc_id, concat_ws(',', case when not coalesce(n_chars > 0, false) then 'no_length' end, case when not coalesce(length(text) = n_chars, false) then 'wrong_length' end) as broken from documents")
def d_08(spark: SparkSession, d: str) -> DataFrame:
    """Assertions that do not hold."""
    checks = {"no_length": F.col("n_chars") > 0, "wrong_length": F.length("text") == F.col("n_chars")}
    return read_table(spark, d, "documents").select("doc_id", F.array_join(R.violations(checks), ",").alias("broken"))


@query("d_10", f"select l_orderkey, l_linenumber, l_quantity, price as before, price - price // 10 as after from {SRC}")
def d_10(spark: SparkSession, d: str) -> DataFrame:
    """A variable before and after a step."""
    rows = _lines(spark, d).select(*LINE, PRICE.alias("before"))
    return rows.withColumn("after", F.col("before") - N._div(F.col("before"), F.lit(10).cast("bigint")))


@query("d_11", "select l_orderkey, l_linenumber, l_quantity, p_size as size, p_partkey is not null as found from lineitem left join part on p_partkey = l_partkey")
def d_11(spark: SparkSession, d: str) -> DataFrame:
    """A table looked up by key, misses included."""
    table = read_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    return R.look_up(_lines(spark, d), table, ["l_partkey"], "p_size").select(*LINE, F.col("p_size").alias("size"), "found")


@query("d_13", f"select l_orderkey, l_linenumber, l_quantity, (qty * 3 + 1) as first, (l_linenumber * 3 + 1)::bigint as second from {SRC}")
def d_13(spark: SparkSession, d: str) -> DataFrame:
    """One sub-decision applied to two things."""
    sub = lambda x: (x * 3 + 1).cast("bigint")
    return _lines(spark, d).select(*LINE, sub(QTY).alias("first"), sub(F.col("l_linenumber")).alias("second"))


@query("d_15", f"select l_orderkey, l_linenumber, l_quantity, abs(price - qty * 150000) <= (2 * (qty * 150000) + 10) // 20 as near from {SRC}")
def d_15(spark: SparkSession, d: str) -> DataFrame:
    """Within a tenth, rounded to the cent."""
    return _lines(spark, d).select(*LINE, N.within_share(PRICE, QTY * 150000, 1, 10).alias("near"))


CODES_SQL = "concat_ws(',', case when qty > 40 then 'MANY' end, case when price > 6000000 then 'DEAR' end, case when l_returnflag = 'R' then 'RETURNED' end)"


@query("d_17", f"select l_orderkey, l_linenumber, l_quantity, {CODES_SQL} as codes from {SRC}")
def d_17(spark: SparkSession, d: str) -> DataFrame:
    """Reasons in the order they are declared."""
    return _lines(spark, d).select(*LINE, F.array_join(R.reasons(CODES), ",").alias("codes"))


@query("d_18", f"select l_orderkey, l_linenumber, l_quantity, case when {CODES_SQL} <> '' then 'stop' when qty > 30 then 'look' else 'go' end as decision from {SRC}")
def d_18(spark: SparkSession, d: str) -> DataFrame:
    """Any reason comes first, then doubt."""
    return _lines(spark, d).select(*LINE, R.first_of([(F.size(R.reasons(CODES)) > 0, "stop"), (QTY > 30, "look")], "go").alias("decision"))


@query("d_19", f"select l_orderkey, l_linenumber, l_quantity, case when qty >= 40 then 'high' when qty >= 20 then 'middle' when qty >= 10 then 'low' else 'none' end as tier from {SRC}")
def d_19(spark: SparkSession, d: str) -> DataFrame:
    """The highest step reached."""
    return _lines(spark, d).select(*LINE, R.tier(QTY, [(10, "low"), (20, "middle"), (40, "high")], "none").alias("tier"))


@query("d_22", f"select l_orderkey, l_linenumber, l_quantity, qty * 2 as twice, {CODES_SQL} as codes, l_returnflag <> 'N' as decided from {SRC}")
def d_22(spark: SparkSession, d: str) -> DataFrame:
    """A whole rule set evaluated."""
    rows = R.evaluate(_lines(spark, d), {"twice": QTY * 2, "closed": F.when(F.col("l_returnflag") != "N", True)}, CODES)
    return rows.select(*LINE, F.col("outputs.twice").alias("twice"), F.array_join("reasons", ",").alias("codes"), "decided")


@query("d_23", """select l_orderkey, l_linenumber, l_quantity, '{"a":"' || l_returnflag || '","b":"' || l_linestatus || '"}' as text from lineitem""")
def d_23(spark: SparkSession, d: str) -> DataFrame:
    """Keys in order, whatever order they come in."""
    return _lines(spark, d).select(*LINE, R.canonical_json(F.create_map(F.lit("b"), F.col("l_linestatus"), F.lit("a"), F.col("l_returnflag"))).alias("text"))


@query("d_24", "select doc_id, coalesce(lang, 'en') as lang from documents")
def d_24(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", R.given(F.col("lang"), F.lit("en")).alias("lang"))


# ------------------------------------------------------------------ test cases


@query("c_02", "select module, pos, case when len(enum_values) > 0 then 'enum' when leaf_type in ('int', 'float', 'money', 'bool', 'date', 'string', 'enum', 'list') then leaf_type else 'string' end as leaf from field_spec")
def c_02(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "field_spec").select("module", "pos", C.leaf_type(F.col("leaf_type"), F.col("enum_values")).alias("leaf"))


AMOUNT = r"\$[0-9][0-9,]*(?:\.[0-9]{1,2})?"


@query("c_04", r"""select doc_id, case when regexp_full_match(t, '\$([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]{1,2})?') then round(replace(replace(t, '$', ''), ',', '')::decimal(30, 2) * 100)::bigint end as cents
  from (select doc_id, regexp_extract(text, '\$[0-9][0-9,]*(?:\.[0-9]{1,2})?') as t from documents where text is not null) where t <> ''""")
def c_04(spark: SparkSession, d: str) -> DataFrame:
    """The first amount in each text, in cents."""
    rows = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.regexp_extract("text", AMOUNT, 0).alias("t")).where("t <> ''")
    return rows.select("doc_id", N.parse_cents(F.col("t")).alias("cents"))


#: The lines of cases in SQL: lines parts them, faults has a row for each failure, good those without any.
_FIELD = r'"(?:[^"]|"")*"|[^",\r\n]*'
LINES = rf"""with spec as (select distinct module from import_line where module is not null), cols as (
  select module, k as pos, c as column_name, 'string' as leaf_type, false as optional, null::varchar[] as enum_values from spec, (values (-3, 'case_id'), (-2, 'short_description'), (-1, 'description')) h(k, c)
  union all select module, pos * 10, column_name, leaf_type, coalesce(optional, false), enum_values from field_spec
  union all select module, k, c, 'string', true, null from spec, (values (1000001, 'tags'), (1000002, 'notes')) t(k, c)),
place as (select *, row_number() over (partition by module order by pos) as i from cols), width as (select module, count(*) as n from cols group by module),
raw as (select distinct line_id, import_file, module, row_num, line from import_line where line is not null and row_num is distinct from 1 and not regexp_matches(line, '^\s*"?\s*#desc\s*"?\s*(,|$)')),
cut as (select *, regexp_full_match(line, '(?:{_FIELD})((?:,|\r\n|\r|\n)(?:{_FIELD}))*') as fine, regexp_replace(line, '[\r\n]+$', '') as solid from raw),
split as (select *, list_transform(regexp_extract_all(solid || ',', '({_FIELD})(?:,|\r|\n)', 1), lambda f: trim(case when f like '"%' then replace(f[2:-2], '""', '"') else f end, e' \t\n\r\x0b\x0c')) as f from cut),
lines as (select s.*, n from split s left join width w on w.module = s.module where not (fine and len(f) = coalesce(n, 5) and len(list_filter(f[4:], lambda x: x <> '')) = 0)),
cells as (select line_id, import_file, l.module, row_num, column_name, leaf_type, optional, enum_values, f[i] as v, i from lines l join place p on p.module = l.module where fine and len(f) = n),
checked as (select *, case when v = '' then case when not optional then 'MISSING_REQUIRED' end
  when leaf_type = 'bool' and v not in ('true', 'True', 'TRUE', '1', 'false', 'False', 'FALSE', '0') then 'INVALID_BOOL' when leaf_type = 'int' and not regexp_full_match(v, '[+-]?[0-9]+') then 'INVALID_INT'
  when leaf_type = 'float' and not regexp_full_match(v, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then 'INVALID_FLOAT'
  when leaf_type = 'money' and not regexp_full_match(v, '-?\$?([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)(\.[0-9]{{1,2}})?') then 'INVALID_MONEY'
  when leaf_type = 'date' and not (regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') and try_cast(v as date) is not null) then 'INVALID_DATE'
  when leaf_type = 'enum' and not coalesce(list_contains(enum_values, v), false) then 'INVALID_ENUM' end as reason from cells),
faults as (select distinct line_id, '' as column_name, case when not fine then 'BROKEN_QUOTING' else 'WRONG_COLUMN_COUNT' end as reason from lines where not fine or len(f) <> n
  union select line_id, column_name, reason from checked where reason is not null),
good as (select line_id, import_file, module, row_num, f[1] as case_id, f[2] as short_description, f[-2] as tags from (select * from lines where line_id not in (select line_id from faults)) qualify row_number() over (partition by line_id order by import_file) = 1) """


registry.ORACLES["p1_found"] = LINES + "select line_id, column_name, reason from faults"


def _faults(spark: SparkSession, d: str) -> DataFrame:
    return S.failures(read_table(spark, d, "import_line"), read_table(spark, d, "field_spec"))


@query("c_05", LINES + "select column_name, reason, count(*) as lines from faults where reason like 'INVALID%' group by all")
def c_05(spark: SparkSession, d: str) -> DataFrame:
    """Values that do not fit their type, by column."""
    return _faults(spark, d).where("reason like 'INVALID%'").groupBy("column_name", "reason").agg(F.count("*").alias("lines"))


@query("c_06", "select module, count(*) filter (row_num = 1) as headers, count(*) filter (regexp_matches(line, '^#desc')) as notes from (select distinct line_id, module, row_num, line from import_line) group by module")
def c_06(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are no cases."""
    rows = read_table(spark, d, "import_line").select("line_id", "module", "row_num", "line").distinct()
    return rows.groupBy("module").agg(F.sum((F.col("row_num") == 1).cast("int")).cast("bigint").alias("headers"), F.sum(F.col("line").rlike("^#desc").cast("int")).cast("bigint").alias("notes"))


@query("c_07", LINES + "select line_id, column_name from faults where reason = 'MISSING_REQUIRED'")
def c_07(spark: SparkSession, d: str) -> DataFrame:
    """Required values that are missing."""
    return _faults(spark, d).where("reason = 'MISSING_REQUIRED'").select("line_id", "column_name")


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return S.load_cases(read_table(spark, d, "import_line"), read_table(spark, d, "field_spec"))


@query("c_08", LINES + "select line_id, import_file, case_id, count(*) over (partition by import_file, case_id) - 1 as replaced from good qualify row_number() over (partition by import_file, case_id order by row_num desc, line_id desc) = 1")
def c_08(spark: SparkSession, d: str) -> DataFrame:
    """Of cases that share a case_id in a file, the last."""
    return C.last_wins(_cases(spark, d), ["import_file", "case_id"], ["row_num", "line_id"]).select("line_id", "import_file", "case_id", "replaced")


@query("c_11", LINES + """, r as (select g.*, received_at from good g join (select line_id, min(received_at) as received_at from import_line group by line_id) t using (line_id)),
m as (select make_timestamp(epoch_us(min(received_at)) + (epoch_us(max(received_at)) - epoch_us(min(received_at))) // 2) as middle from r), k as (select module, case_id, bool_or(not coalesce(received_at >= middle, false)) as a, bool_or(coalesce(received_at >= middle, false)) as b from r, m group by all)
select case when a and b then 'updated' when a then 'kept' else 'added' end as action, count(*) as cases from k group by 1""")
def c_11(spark: SparkSession, d: str) -> DataFrame:
    """The cases of lines received later put over those received earlier."""
    from caseloom.operators.catalog import by_time

    received = read_table(spark, d, "import_line").groupBy("line_id").agg(F.min("received_at").alias("received_at"))
    cases = materialize(_cases(spark, d).join(received, "line_id").select("line_id", "module", "case_id", "received_at"), "cases")
    keyed = lambda rows: C.last_wins(rows, ["module", "case_id"], ["line_id"]).select("line_id", F.concat_ws("/", "module", "case_id").alias("case"))
    earlier, later = by_time(cases, "received_at")
    return C.upsert(keyed(earlier), keyed(later), "case").groupBy("action").agg(F.count("*").alias("cases"))


@query("c_13")
def c_13(spark: SparkSession, d: str) -> DataFrame:
    """Cases as comma-separated text again."""
    middle = F.transform("cells", lambda c: C.quoted(C.export_cell(c["value"])))
    return _cases(spark, d).select("line_id", "module", F.array_join(middle, ",").alias("line"))


@query("c_15", LINES + "select module, short_description, count(*) as cases, min((import_file, row_num))[1] as first_import_file, min((import_file, row_num))[2] as first_row_num from good where short_description <> '' group by all having count(*) > 1")
def c_15(spark: SparkSession, d: str) -> DataFrame:
    """Labels used more than once in a module."""
    return C.shared_labels(_cases(spark, d), ["module"], "short_description", ["import_file", "row_num"])


@query("c_16", """with a as (select o_orderkey, 'total' as name, o_totalprice as value from orders union all select o_orderkey, 'lines', o_orderkey % 5 + 1 from orders),
b as (select l_orderkey as o_orderkey, 'total' as name, sum(l_extendedprice) as value from lineitem group by 1 union all select l_orderkey, 'lines', count(*) from lineitem group by 1)
select o_orderkey, name, a.value is null as only_new, b.value is null as only_old from a full join b using (o_orderkey, name) where a.value is null or b.value is null or abs(a.value - b.value) > 0.005""")
def c_16(spark: SparkSession, d: str) -> DataFrame:
    """Recorded totals and line counts against recomputed ones."""
    stack = lambda df, key, total, lines: df.select(F.col(key).alias("o_orderkey"), F.inline(F.array(F.struct(F.lit("total").alias("name"), total.cast("double").alias("value")), F.struct(F.lit("lines").alias("name"), lines.cast("double").alias("value")))))
    recorded = stack(read_table(spark, d, "orders"), "o_orderkey", F.col("o_totalprice"), F.col("o_orderkey") % 5 + 1)
    sums = _lines(spark, d).groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("t"), F.count("*").alias("n"))
    diff = C.differences(recorded, stack(sums, "l_orderkey", F.col("t"), F.col("n")), ["o_orderkey"], 0.005)
    return diff.select("o_orderkey", "name", F.col("recorded").isNull().alias("only_new"), F.col("recomputed").isNull().alias("only_old"))


@query("c_17", "select distinct p_brand, (p_size + k)::int as p_size from part, (values (-1), (0), (1)) v(k) where p_partkey % 2 = 0 except select p_brand, p_size from part where p_partkey % 2 = 1")
def c_17(spark: SparkSession, d: str) -> DataFrame:
    """Sizes next to those of even parts that no odd part of the brand has."""
    parts = read_table(spark, d, "part")
    return C.boundaries(parts.where("p_partkey % 2 = 0"), "p_brand", "p_size", parts.where("p_partkey % 2 = 1"))


@query("c_18", "select p_brand, p_size from part where p_partkey % 2 = 0 except select p_brand, p_size from part where p_partkey % 2 = 1")
def c_18(spark: SparkSession, d: str) -> DataFrame:
    parts = read_table(spark, d, "part")
    return parts.where("p_partkey % 2 = 0").select("p_brand", "p_size").subtract(parts.where("p_partkey % 2 = 1").select("p_brand", "p_size"))


@query("c_19", "select module, column_name, scenario from field_spec, (values ('null'), ('empty'), ('blank'), ('wrong_type')) s(scenario) where not coalesce(optional, false)")
def c_19(spark: SparkSession, d: str) -> DataFrame:
    """Each required column in four ways of being wrong."""
    kinds = F.explode(F.array(*map(F.lit, ("null", "empty", "blank", "wrong_type"))))
    return read_table(spark, d, "field_spec").where(~F.coalesce("optional", F.lit(False))).select("module", "column_name", kinds.alias("scenario"))


@query("c_21", "select distinct qty, l_discount, l_tax from (select l_quantity::bigint as qty, l_discount, l_tax, l_linenumber from lineitem) where l_linenumber > 3 except select l_quantity::bigint, l_discount, l_tax from lineitem where l_linenumber <= 3")
def c_21(spark: SparkSession, d: str) -> DataFrame:
    """Inputs not tried yet."""
    rows = _lines(spark, d).select(QTY.alias("qty"), "l_discount", "l_tax", "l_linenumber")
    return rows.where("l_linenumber > 3").drop("l_linenumber").subtract(rows.where("l_linenumber <= 3").drop("l_linenumber"))


@query("c_22", LINES + r""", t as (select distinct module, unnest(regexp_split_to_array(tags, '\s*;\s*')) as tag from good)
select tag, count(*) as modules, (select count(distinct module) from t where tag <> '') - count(*) as lacking from t where tag <> '' group by tag""")
def c_22(spark: SparkSession, d: str) -> DataFrame:
    """Each tag in use: how many modules have cases with it, and how many of those with tags lack it."""
    cell = F.get(F.filter("cells", lambda c: c["column_name"] == "tags"), F.lit(0))["value"]["text"]
    tags = materialize(_cases(spark, d).select("module", F.explode(F.split(F.coalesce(cell, F.lit("")), r"\s*;\s*")).alias("tag")).where("tag <> ''").distinct(), "tags")
    return C.coverage(tags, "tag", "module").select("tag", F.col("having").alias("modules"), "lacking")


@query("c_25", r"""with n as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from documents where text is not null),
h as (select *, last_value(case when regexp_matches(line, '^#{1,6} +\S') then regexp_extract(line, '^#{1,6} +(.*?)\s*$', 1) end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as heading from n)
select doc_id, i::int as line_no, heading from h where regexp_matches(line, '^- ')""")
def c_25(spark: SparkSession, d: str) -> DataFrame:
    """The heading above each list item."""
    lines = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return G.preceding_heading(lines, "doc_id").where("line rlike '^- '").select("doc_id", (F.col("at") + 1).alias("line_no"), "heading")


# ----------------------------------------------------------------- rule source

DEFS = r"""with b as (select doc_id, unnest(regexp_extract_all(text, '(?s)```rules\r?\n(.*?)```', 1)) as block from documents where text is not null),
l as (select doc_id, unnest(regexp_split_to_array(block, '\r?\n')) as line from b),
f as (select doc_id, regexp_extract(line, '^\s*(?:exception )?(definition|rule|assertion) ([a-z_][a-z0-9_]*)\s*(.*)$', 1) as kind, regexp_extract(line, '^\s*(?:exception )?(definition|rule|assertion) ([a-z_][a-z0-9_]*)\s*(.*)$', 2) as name,
  regexp_extract(line, '^\s*(?:exception )?(definition|rule|assertion) ([a-z_][a-z0-9_]*)\s*(.*)$', 3) as body from l),
defs as (select * from f where kind <> ''),
u as (select doc_id, name, unnest(list_distinct(list_filter(regexp_split_to_array(body, '[^A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[a-z_][a-z0-9_]*') and x not in (""" + ", ".join(f"'{k}'" for k in G.KEYWORDS) + r""")))) as src from defs),
edges as (select src, name as dst, count(*) as uses from u where src <> name group by all) """


def _defs(spark: SparkSession, d: str) -> DataFrame:
    return G.definitions(read_table(spark, d, "documents").where("text is not null"))


@query("k_01", DEFS + """, e as (select dst as node, 1 as i, 0 as o from edges union all select src, 0, 1 from edges)
select node, sum(i)::bigint as ins, sum(o)::bigint as outs, case when sum(i) = 0 then 'input' when sum(o) = 0 then 'output' else 'intermediate' end as class from e group by node""")
def k_01(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(G.edges(_defs(spark, d)))


@query("k_02", DEFS + "select distinct '  ' || regexp_replace(src, '[^A-Za-z0-9]', '_', 'g') || ' -> ' || regexp_replace(dst, '[^A-Za-z0-9]', '_', 'g') || ';' as line from edges")
def k_02(spark: SparkSession, d: str) -> DataFrame:
    return G.dot(G.edges(_defs(spark, d)))


@query("k_03", r"""select doc_id, regexp_extract(text, '(?m)^#{0,3} *Module ([A-Z][A-Za-z0-9_]*)', 1) as module, len(regexp_extract_all(text, '(?m)^scope ([A-Z][A-Za-z0-9]*):', 1))::int as scopes from documents where regexp_matches(text, '(?m)^#{0,3} *Module [A-Z]')""")
def k_03(spark: SparkSession, d: str) -> DataFrame:
    """Modules and how many scopes each document of one has."""
    rows = read_table(spark, d, "documents").where(r"text rlike '(?m)^#{0,3} *Module [A-Z]'")
    return rows.select("doc_id", F.regexp_extract("text", r"(?m)^#{0,3} *Module ([A-Z][A-Za-z0-9_]*)", 1).alias("module"), F.size(F.regexp_extract_all("text", F.lit(r"(?m)^scope ([A-Z][A-Za-z0-9]*):"), F.lit(1))).alias("scopes"))


@query("k_04", DEFS.replace("with b as", "with recursive b as") + """, links as (select distinct src, name as dst from u), nodes as (select src as node from links union select dst from links),
far as (select src, dst from links union select far.src, links.dst from far join links on links.src = far.dst), bad as (select src as node from far where src = dst union select dst from far where src in (select src from far where src = dst)),
walk as (select node, 0 as depth from nodes where node not in (select dst from links) union select links.dst, walk.depth + 1 from walk join links on links.src = walk.node where links.dst not in (select node from bad))
select node, (select max(depth) from walk where walk.node = nodes.node)::int as depth from nodes""")
def k_04(spark: SparkSession, d: str) -> DataFrame:
    """In what order names can be computed; null for those on or behind a cycle, which have no such place."""
    return G.topological(G.edges(_defs(spark, d), loops=True))


@query("k_05", r"""with n as (select doc_id, unnest(regexp_extract_all(text, 'File "[^"]+", line [0-9]+, in \w+')) as t from documents where text is not null)
select doc_id, regexp_extract(t, 'File "([^"]+)"', 1) as file, regexp_extract(t, 'line ([0-9]+)', 1)::int as line, regexp_extract(t, 'in (\w+)$', 1) as place from n""")
def k_05(spark: SparkSession, d: str) -> DataFrame:
    """Places that diagnostics in texts point to."""
    rows = read_table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r'File "[^"]+", line [0-9]+, in \w+'), F.lit(0))).alias("t"))
    return rows.select("doc_id", F.regexp_extract("t", r'File "([^"]+)"', 1).alias("file"), F.regexp_extract("t", r"line ([0-9]+)", 1).cast("int").alias("line"), F.regexp_extract("t", r"in (\w+)$", 1).alias("place"))


@query("k_06", "select doc_id, case when lower(text) like '%not found%' then 'missing' when lower(text) like '%timeout%' then 'slow' when lower(text) like '%error%' then 'error' else 'other' end as category from documents where text is not null")
def k_06(spark: SparkSession, d: str) -> DataFrame:
    """The first keyword that a text holds."""
    low = F.lower("text")
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", R.first_of([(low.contains("not found"), "missing"), (low.contains("timeout"), "slow"), (low.contains("error"), "error")], "other").alias("category"))


@query("k_08", DEFS + "select distinct kind, name from defs")
def k_08(spark: SparkSession, d: str) -> DataFrame:
    return _defs(spark, d).select("kind", "name").distinct()


@query("k_09", DEFS + "select name, 'undeclared' as side from (select distinct name from defs) where name not in (select column_name from field_spec) union all select distinct column_name, 'unused' from field_spec where column_name not in (select name from defs)")
def k_09(spark: SparkSession, d: str) -> DataFrame:
    """Names in rules that no module declares, and declared ones that no rule defines."""
    used, known = _defs(spark, d).select("name").distinct(), read_table(spark, d, "field_spec").select(F.col("column_name").alias("name")).distinct()
    return used.join(known, "name", "left_anti").withColumn("side", F.lit("undeclared")).unionByName(known.join(used, "name", "left_anti").withColumn("side", F.lit("unused")))


@query("k_10", DEFS + "select name, count(distinct doc_id) as documents, min(doc_id) as first_doc from defs group by name")
def k_10(spark: SparkSession, d: str) -> DataFrame:
    """Who declares a name."""
    return _defs(spark, d).groupBy("name").agg(F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first_doc"))


@query("k_13", DEFS + "select src as name, sum(uses)::bigint as uses from edges group by src")
def k_13(spark: SparkSession, d: str) -> DataFrame:
    """Names on the right side of definitions."""
    return G.edges(_defs(spark, d)).groupBy(F.col("src").alias("name")).agg(F.sum("uses").alias("uses"))


@query("k_14", DEFS + "select distinct dst as name from edges where dst in (select src from edges)")
def k_14(spark: SparkSession, d: str) -> DataFrame:
    """Names that are defined and used."""
    links = G.edges(_defs(spark, d))
    return links.select(F.col("dst").alias("name")).join(links.select(F.col("src").alias("name")), "name", "left_semi").distinct()


SCORES = "case when l_suppkey % 9 = 0 then 'unscored' when qty % 5 + 1 <= 2 or price % 5 + 1 <= 2 then 'uncertain' when l_partkey % 5 + 1 >= 4 or l_suppkey % 5 + 1 >= 4 then 'complex' else 'verified' end"


@query("k_19", f"select l_orderkey, l_linenumber, l_quantity, {SCORES} as bucket from {SRC}")
def k_19(spark: SparkSession, d: str) -> DataFrame:
    """Four scores, here made of a line's numbers, in buckets."""
    return _lines(spark, d).select(*LINE, G.bucket(*_SCORES).alias("bucket"))


@query("k_20", f"select {SCORES} as bucket, count(*) as items, min(l_orderkey) as first, max(l_orderkey) as last from {SRC} group by 1")
def k_20(spark: SparkSession, d: str) -> DataFrame:
    """How many fall in each bucket."""
    return _lines(spark, d).groupBy(G.bucket(*_SCORES).alias("bucket")).agg(F.count("*").alias("items"), F.min("l_orderkey").alias("first"), F.max("l_orderkey").alias("last"))


@query("k_22", TOLD + "select result_id, count(*) as phrases from (select distinct source_doc, policy_phrase from told where policy_phrase is not null and source_doc is not null) o join parse_result p on p.source = replace(o.source_doc, '.md', '.pdf') where contains(p.markdown, o.policy_phrase) group by 1")
def k_22(spark: SparkSession, d: str) -> DataFrame:
    """Phrases that stand word for word in their source."""
    said = unpacked(read_table(spark, d, "observations")).where("policy_phrase is not null and source_doc is not null").select(F.replace("source_doc", F.lit(".md"), F.lit(".pdf")).alias("source"), "policy_phrase").distinct()
    return said.join(read_table(spark, d, "parse_result"), "source").where(F.contains("markdown", "policy_phrase")).groupBy("result_id").agg(F.count("*").alias("phrases"))


@query("k_24", """select event_id, (props::json->>'k')::int as k from events""")
def k_24(spark: SparkSession, d: str) -> DataFrame:
    """A value out of JSON text."""
    return read_table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("k_25", "select n_regionkey, left(n_name, 1) as letter, count(*) as n from nation group by all having count(*) > 1")
def k_25(spark: SparkSession, d: str) -> DataFrame:
    """What should be unique in its group and is not."""
    w = Window.partitionBy("n_regionkey", F.substring("n_name", 1, 1))
    rows = read_table(spark, d, "nation").withColumn("n", F.count("*").over(w)).where("n > 1")
    return rows.select("n_regionkey", F.substring("n_name", 1, 1).alias("letter"), "n").distinct()


@query("k_26", f"select bucket || ': ' || count(*) || ' items, ' || sum(qty) || ' pieces' as line from (select {SCORES} as bucket, qty from {SRC}) group by bucket")
def k_26(spark: SparkSession, d: str) -> DataFrame:
    """A report's lines."""
    sums = _lines(spark, d).groupBy(G.bucket(*_SCORES).alias("bucket")).agg(F.count("*").alias("n"), F.sum(QTY).alias("q"))
    return sums.select(F.concat("bucket", F.lit(": "), F.col("n").cast("string"), F.lit(" items, "), F.col("q").cast("string"), F.lit(" pieces")).alias("line"))


@query("v_06", DEFS + r"select kind, count(*) as lines, count(*) filter (regexp_matches(name, '^[a-z][a-z0-9_]*$') and regexp_matches(body, '^equals \S')) as assignments from defs group by kind")
def v_06(spark: SparkSession, d: str) -> DataFrame:
    """How many lines of each kind are assignments to a name in snake case."""
    fits = F.col("name").rlike("^[a-z][a-z0-9_]*$") & F.col("body").rlike(r"^equals \S")
    return _defs(spark, d).groupBy("kind").agg(F.count("*").alias("lines"), F.sum(fits.cast("int")).cast("bigint").alias("assignments"))


@query("k_12", DEFS + r"""select doc_id, count(*) as lines, sum(length(regexp_replace(regexp_replace(body, '"[^"]*"|\$[0-9][0-9,.]*|[0-9.]+%', ' ', 'g'), '\s+', ' ', 'g')))::bigint as left_chars from defs group by doc_id""")
def k_12(spark: SparkSession, d: str) -> DataFrame:
    """Rule lines without their literals."""
    bare = F.regexp_replace(F.regexp_replace("body", r'"[^"]*"|\$[0-9][0-9,.]*|[0-9.]+%', " "), r"\s+", " ")
    return _defs(spark, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length(bare)).cast("bigint").alias("left_chars"))


@query("k_23", r"""with n as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from documents where contains(text, '```')),
f as (select *, regexp_matches(line, '^```') as fence, sum(case when regexp_matches(line, '^```') then 1 else 0 end) over (partition by doc_id order by i) as n from n)
select doc_id, ((n + 1) // 2)::bigint as block, coalesce(max(case when fence and n % 2 = 1 then regexp_extract(line, '^```\s*(\w*)', 1) end), '') as kind, count(*) filter (not fence) as lines from f where n % 2 = 1 group by all""")
def k_23(spark: SparkSession, d: str) -> DataFrame:
    """Fenced blocks with their kind; one that is not closed runs to the end."""
    lines = read_table(spark, d, "documents").where(F.contains("text", F.lit("```"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    fence = F.col("line").rlike("^```")
    marked = lines.withColumns({"fence": fence, "n": F.sum(fence.cast("int")).over(Window.partitionBy("doc_id").orderBy("at"))}).where("n % 2 = 1")
    kind = F.max(F.when(F.col("fence"), F.regexp_extract("line", r"^```\s*(\w*)", 1)))
    return marked.groupBy("doc_id", F.expr("(n + 1) div 2").alias("block")).agg(F.coalesce(kind, F.lit("")).alias("kind"), F.sum((~F.col("fence")).cast("int")).cast("bigint").alias("lines"))


@query("f_14", DEFS.replace("with b as", "with recursive b as") + """, needs as (select distinct src, name as dst from u where src <> name),
late as (select distinct name from defs join documents using (doc_id) where added_at >= (select date_trunc('month', min(added_at)) + interval 1 month from documents where text is not null)),
far as (select name, 0 as distance from late union select needs.dst, far.distance + 1 from far join needs on needs.src = far.name where far.distance < (select count(distinct dst) from needs))
select name, min(distance)::int as distance from far group by name""")
def f_14(spark: SparkSession, d: str) -> DataFrame:
    """Names that change with those that documents define after the first month, and over how many steps."""
    from caseloom.operators import catalog

    docs = read_table(spark, d, "documents").where("text is not null")
    since = docs.agg(F.add_months(F.trunc(F.min("added_at"), "month"), 1).cast("timestamp").alias("since"))
    links = G.edges(_defs(spark, d))
    late = G.definitions(docs.crossJoin(F.broadcast(since)).where("added_at >= since"))
    return catalog.propagate(late.select("name"), links.select(F.col("dst").alias("name"), F.col("src").alias("needs")))


@query("m_06", TOLD + """, e as (select domain, entry_section, policy_phrase, list_sort(list_distinct(list(entry_name))) as names from told where entry_name is not null and policy_phrase is not null group by all)
select domain, entry_section, policy_phrase, array_to_string(list_sort(list_distinct(list_append(names, lower(names[1])))), ',') as synonyms from e""")
def m_06(spark: SparkSession, d: str) -> DataFrame:
    """All names that one phrase of a section goes by, a prior name among them."""
    from caseloom.operators import catalog

    rows = unpacked(read_table(spark, d, "observations")).where("entry_name is not null and policy_phrase is not null").groupBy("domain", "entry_section", "policy_phrase").agg(F.array_sort(F.collect_set("entry_name")).alias("names"))
    return rows.select("domain", "entry_section", "policy_phrase", F.array_join(F.array_sort(catalog.renamed_entry(F.col("names"), F.lower(F.get("names", F.lit(0))))), ",").alias("synonyms"))


@query("k_17", DEFS + """select doc_id, case when bool_and(body like 'equals %') then 'computed_only' else 'needs_source' end as class, case when count(*) filter (name in (select column_name from field_spec)) > 0 then 'high' else 'low' end as priority from defs group by doc_id""")
def k_17(spark: SparkSession, d: str) -> DataFrame:
    """Rule documents by whether all of it is computed, and whether it defines a declared column."""
    known = read_table(spark, d, "field_spec").select(F.col("column_name").alias("name")).distinct().withColumn("known", F.lit(1))
    rows = _defs(spark, d).join(known, "name", "left")
    computed = F.min(F.col("body").startswith("equals "))
    return rows.groupBy("doc_id").agg(F.when(computed, "computed_only").otherwise("needs_source").alias("class"), F.when(F.count("known") > 0, "high").otherwise("low").alias("priority"))


@query("k_07", DEFS + """, t as (select doc_id, count(*) as n, count(*) filter (kind = 'assertion') as a from defs group by doc_id)
select doc_id, case when a * 2 > n then 'regenerate' else 'repair' end as action from t""")
def k_07(spark: SparkSession, d: str) -> DataFrame:
    """Documents so full of one kind of line that they are made anew rather than mended."""
    rows = _defs(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum((F.col("kind") == "assertion").cast("int")).alias("a"))
    return rows.select("doc_id", F.when(F.col("a") * 2 > F.col("n"), "regenerate").otherwise("repair").alias("action"))
