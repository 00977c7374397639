import datetime as dt
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from caseloom.functions import dates as D
from caseloom.functions import lists as L
from caseloom.functions import numbers as N
from caseloom.operators import catalog, freshness, graphs, markdown_quality, markup, telemetry
from caseloom.operators.decisions import Rule, resolve, status
from caseloom.operators.ranking import numbered


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rounding_is_half_away_from_zero(spark):
    cases = [(a, n, d) for a in (-5, -3, 0, 1, 7, 250) for n in (-2, 1, 3) for d in (2, 4, -6)]
    rows = spark.createDataFrame(cases, "a bigint, n bigint, d bigint").select("*", N.mul_round(F.col("a"), F.col("n"), F.col("d")).alias("v")).collect()
    for r in rows:
        x = Fraction(r.a * r.n, r.d)
        whole = int(abs(x) + Fraction(1, 2))
        assert r.v == (whole if x >= 0 else -whole), r


def test_amounts(spark):
    rows = spark.createDataFrame([("$1,234.5",), ("-$3",), ("12 50",), ("1,23",), (None,)], "t string").select(N.parse_cents(F.col("t")).alias("v"))
    assert [r.v for r in rows.collect()] == [123450, -300, None, None, None]
    assert one(spark, N.show_cents(F.lit(-1205).cast("bigint"))) == "-12.05"
    assert one(spark, N.round_money(F.lit(1549).cast("bigint"), 0)) == 1500
    assert one(spark, N.half_away(F.lit(Decimal("-2.5")))) == -3


def test_dates_round_as_told(spark):
    jan31 = F.lit(dt.date(2024, 1, 31))
    month = D.duration(months=1)
    assert one(spark, D.plus(jan31, month, D.DOWN)) == dt.date(2024, 2, 29)
    assert one(spark, D.plus(jan31, month, D.UP)) == dt.date(2024, 3, 1)
    with pytest.raises(PySparkException):
        one(spark, D.plus(jan31, month))
    assert one(spark, D.minus(F.lit(dt.date(2024, 3, 31)), month, D.DOWN)) == dt.date(2024, 2, 29)
    assert one(spark, D.from_text(F.lit("2023-02-29"))) is None
    with pytest.raises(PySparkException):
        one(spark, D.comparable(month, D.duration(days=30)))
    p = D.period(F.lit(dt.date(2024, 1, 15)), F.lit(dt.date(2024, 3, 1)))
    got = [(r.begin, r.end) for r in one(spark, D.split_by_month(p))]
    assert got == [(dt.date(2024, 1, 15), dt.date(2024, 1, 31)), (dt.date(2024, 2, 1), dt.date(2024, 3, 1))]
    assert one(spark, D.split_by_month(D.period(jan31, jan31))) == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-9, 9), max_size=5), st.integers(-2, 7))
def test_lists(spark, values, place):
    a = F.array(*[F.lit(v).cast("bigint") for v in values]).cast("array<bigint>")
    want = values[place - 1] if 1 <= place <= len(values) else None
    row = spark.range(1).select(L.nth(a, F.lit(place)).alias("n"), L.total(a).alias("t"), L.without_nth(a, F.lit(place)).alias("w"), L.reduce_or(a, lambda x, y: F.greatest(x, y), F.lit(99).cast("bigint")).alias("r")).first()
    assert (row.n, row.t, row.r) == (want, sum(values), max(values, default=99))
    assert row.w == [v for i, v in enumerate(values) if i != place - 1]


def test_rules_conflict_only_over_different_values(spark):
    yes = F.lit(True)
    assert one(spark, resolve([Rule("a", yes, F.lit("x")), Rule("b", yes, F.lit("x"))])) == "x"
    assert one(spark, status([Rule("a", yes, F.lit("x")), Rule("b", yes, F.lit("y"))])) == "conflict"
    assert one(spark, resolve([Rule("a", yes, F.lit("x"), [Rule("b", yes, F.lit("y"))])])) == "y"
    for rules in ([Rule("a", F.lit(False), F.lit("x"))], [Rule("a", yes, F.lit("x")), Rule("b", yes, F.lit("y"))]):
        with pytest.raises(PySparkException):
            one(spark, resolve(rules))


def rated(spark, text):
    return markdown_quality.rate(spark.createDataFrame([(text,)], "markdown string")).first()


def test_quality_of_markdown(spark):
    prose = "\n\n".join(f"## Part {i}\n\nSome words here, number {i}." for i in range(10))
    assert (rated(spark, prose).score, rated(spark, prose).flags) == (100, [])
    pages = "\n".join(f"Agency Handbook\n\nText number {i} of this page.\n\nPage {i}" for i in range(19))
    assert rated(spark, pages).score < 40 and set(rated(spark, pages).flags) == {"no_headings", "repeated_page_headers", "repeated_page_numbers"}
    assert (rated(spark, "").score, rated(spark, "").flags) == (60, ["no_headings"])
    assert rated(spark, None).score == 60
    assert "bold_as_headings" in rated(spark, "**One**\n\ntext\n\n**Two**").flags
    nav = "# T\n" + "\n".join(f"- https://x.example/{i}" for i in range(10))
    assert rated(spark, nav).flags == ["navigation_list_pollution"]
    assert "unindented_nested_lists" in rated(spark, "# T\n  - a\n- b").flags and "unindented_nested_lists" not in rated(spark, "# T\n- a\n  - b\n- c").flags
    assert {"html_entity_remnants", "navigation_pollution"} <= set(rated(spark, "Home > A > B\nHome > A > C\nx &amp; y").flags)


def test_markup(spark):
    html = "<html><head><script>x()</script></head><body><h2>T</h2><p>a <a href='/b'>link</a></p><ul><li>one</li><li>two</li></ul></body></html>"
    out = markup.html_to_markdown(spark.createDataFrame([(1, html, "http://h/x"), (2, "plain", None), (3, None, None)], "doc_id int, text string, path string"), base="path")
    got = {r.doc_id: r.markdown for r in out.collect()}
    assert "## T" in got[1] and "[link](http://h/b)" in got[1] and "- one\n- two" in got[1] and "x()" not in got[1]
    assert got[2] == "plain\n" and got[3] is None
    assert one(spark, markup.absolute_links(F.lit('<a href="e$1">a</a> <a href="#x">b</a> <a href="mailto:q@r">c</a>'), F.lit("http://h/c/d"))) == '<a href="http://h/c/e$1">a</a> <a href="#x">b</a> <a href="mailto:q@r">c</a>'
    assert one(spark, markup.tidy(F.lit("a\n- b\n\n- c\n\n\n\n\nd \ne\n\n"))) == "a\n- b\n- c\n\n\nd\ne\n"
    made = markup.csv_tables(spark.createDataFrame([(1, "a,b\n1,x|y\n"), (2, 'h1,h2\n"a, b",c\n'), (3, "a,b\n1"), (4, None), (5, " , \n")], "id int, text string"))
    got = {r.id: (r.markdown, r.ragged) for r in made.collect()}
    assert got[1] == ("| a | b |\n| --- | --- |\n| 1 | x\\|y |", False) and got[2] == ("| h1 | h2 |\n| --- | --- |\n| a, b | c |", False)
    assert got[3] == ("| a | b |\n| --- | --- |\n| 1 |  |", True) and got[4] == (None, None) and got[5] == (None, None)
    rows = markup.sections(spark.createDataFrame([(1, "pre\n# A\nx\n## B\ny\n# C"), (2, None)], "k int, t string"), "k", "t").collect()
    assert {(r.k, r.section, r.heading, r.body) for r in rows} == {(1, 0, None, "pre"), (1, 1, "A", "x\n## B\ny"), (1, 2, "B", "y"), (1, 3, "C", ""), (2, 0, None, "")}


EVENT = "log string, line_no int, ts timestamp, session_id string, type string, domain string, prompt string, response string"


def test_durations(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("l", 1, t(0), "S ", "user_prompt", "d", "/go x", None), ("l", 2, t(10), "s", "assistant_response", "d", None, "r"), ("l", 3, t(50), "s", "ai_question", "d", None, None), ("l", 4, t(60), "s", "assistant_response", "d", None, "q"), ("l", 5, None, "s", "user_prompt", "d", "p", None), ("l", 6, t(1), None, "user_prompt", "d", "p", None)]
    events = spark.createDataFrame(rows, EVENT)
    assert [(r.line_no, r.seconds) for r in telemetry.turn_durations(events).orderBy("line_no").collect()] == [(2, 10), (4, 10)]
    r = telemetry.skill_durations(events).first()
    assert (r.skill, r.active, r.waited, r.turns) == ("go", 20, 40, 3)
    assert telemetry.turn_durations(events.limit(0)).count() == 0


def test_drift(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    listing = df([("a", "1"), ("b", "2"), ("n", "9"), ("u", "untracked")], "path string, sha string")
    index = df([("a", "1", 90), ("b", "x", 90), ("r", "5", 90), ("low", "5", 10), ("u", "3", None)], "path string, sha string, score int")
    derived = df([("a",), ("o",)], "path string")
    got = {(r.category, r.path) for r in freshness.facets_drift(listing, index, derived).collect()}
    assert got == {("source_edited", "b"), ("source_added", "n"), ("source_removed", "r"), ("git_unavailable", "u"), ("derived_missing", "b"), ("derived_missing", "u"), ("orphan_derived", "o")}
    plan = freshness.plan(df([("a.md", "1"), ("b.md", "2"), ("c.txt", "3")], "path string, sha string"), df([("a.md", "1"), ("g.md", "1")], "path string, sha string"))
    assert {tuple(r) for r in plan.collect()} == {("a.md", "noop"), ("b.md", "work"), ("c.txt", "skipped"), ("g.md", "delete")}
    done = freshness.finalize(plan, df([("b.md", "in_progress", 2), ("b.md", "succeeded", 1)], "src string, status string, at int"))
    assert dict(tuple(r) for r in done.collect()) == {"a.md": "kept", "b.md": "aborted", "c.txt": "kept", "g.md": "pruned"}


def test_merge_keeps_what_is_known(spark):
    s = "k string, phrase string, obs array<string>"
    e, i = spark.createDataFrame([("a", None, ["x"]), (None, "old", None)], s), spark.createDataFrame([("a", "new", ["y", "x"]), (None, "late", ["z"]), ("b", "b", [])], s)
    got = {r.k: (r.phrase, r.obs, r.action) for r in catalog.merge(e, i, ["k"], ["phrase"], ["obs"]).collect()}
    assert got == {"a": ("new", ["x", "y"], "merged"), None: ("old", ["z"], "merged"), "b": ("b", [], "added")}


def test_topological_order_and_cycles(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string")
    assert {r.node: r.depth for r in graphs.topological(links).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None, "z": None}


def test_numbering_within_a_large_key(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    got = numbered(rows, ["k"], ["id"]).collect()
    assert all(r.nth == (r.id if r.k == "hot" else 0) and r.of == (4000 if r.k == "hot" else 1) for r in got)


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    import pytest

    from caseloom.session import shared_dir

    conf = SimpleNamespace(get=lambda k, d: None)
    for master in ("yarn", "spark://a:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


def test_running_values_go_on_over_ranges(spark):
    from caseloom.operators.ranking import numbered, running

    rows = spark.createDataFrame([(k, i, i if i % 4 == 0 else None) for k in ("a", None) for i in range(40)], "k string, i int, v int")
    got = {(r.k, r.i): (r.s, r.l) for r in running(rows, ["k"], ["i"], {"s": F.col("i")}, {"l": F.col("v")}).collect()}
    assert got == {(k, i): (i * (i + 1) // 2, None if i == 0 else (i - 1) // 4 * 4) for k in ("a", None) for i in range(40)}
    assert {(r.k, r.i): r.nth for r in numbered(rows, ["k"], ["i"]).collect()} == {(k, i): i for k in ("a", None) for i in range(40)}


def test_exceptions_of_any_depth_make_a_plan_of_their_length(spark):
    def nested(depth):
        rule = Rule("last", F.col("x") >= depth, F.lit(depth))
        for i in reversed(range(depth)):
            rule = Rule(str(i), F.col("x") >= i, F.lit(i), [rule])
        return rule

    plan = lambda n: len(spark.range(1).withColumnRenamed("id", "x").select(resolve([nested(n)]).alias("v"))._jdf.queryExecution().optimizedPlan().toString())
    assert plan(16) < 3 * plan(8)
    rows = spark.range(20).withColumnRenamed("id", "x").select("x", resolve([nested(12)]).alias("v")).collect()
    assert [r.v for r in rows] == [min(r.x, 12) for r in rows]
