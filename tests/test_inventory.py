import datetime as dt
import json

from pyspark.sql import functions as F

from caseloom.operators import cases, decisions, graphs
from caseloom.operators import inventory as I

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "file_id bigint, program string, domain string, committed_at timestamp, body string, e string"


def manifests(spark, bodies):
    rows = [(i, "p", "d", DAY, b if b is None or isinstance(b, str) else json.dumps(b), "clash") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA)


GOOD = {"name": "a_b", "section": "inputs.House", "type": "integer", "optional": True, "values": [], "description": "d", "observations": []}


def test_load_states(spark):
    rows = manifests(spark, [{"version": "3.0"}, {"version": 3}, {"version": "1.0"}, {}, None, " ", "[1]", '{"version": "3.0"'])
    assert [r.s for r in rows.select("file_id", I.load_state(F.col("body")).alias("s")).orderBy("file_id").collect()] == ["loaded", "loaded", "rejected", "rejected", "empty", "empty", "unreadable", "unreadable"]


def test_first_fault_of_each_entry(spark):
    broken = [{"name": None}, {"name": 5}, {"name": "A"}, {"section": "x"}, {"section": None}, {"type": "float"}, {"optional": "true"}, {"values": "x"}, {"observations": {}}, {"description": ""}]
    rows = I.entries(manifests(spark, [{"entries": [GOOD, *[GOOD | b for b in broken], "no object", None]}, {"entries": None}, None, "{"]))
    got = [(r.pos, r.f and (r.f.field, r.f.problem)) for r in rows.select("pos", I.first_fault(F.col("e")).alias("f")).orderBy("pos").collect()]
    want = ["name missing", "name missing", "name not snake case", "section unknown", "section missing", "type unknown", "optional no boolean", "values no list", "observations no list", "description no text"]
    assert got == [(0, None)] + [(i, tuple(w.split(" ", 1))) for i, w in enumerate(want, 1)]


def test_repeated_files_count_once_and_nothing_gives_nothing(spark):
    rows = manifests(spark, [{"entries": [GOOD]}])
    assert I.entries(rows.unionAll(rows)).count() == 1 and I.entries(rows.limit(0)).count() == 0


def test_columns_of_cases(spark):
    rows = [(1, 0, "tags", "inputs.A", "string", None), (1, 1, "x", "outputs", "money", None), (1, 2, "n", "inputs.A", "integer", None), (1, 3, "c", "computed", None, None), (2, 0, "n", "inputs.A", None, ["u"]), (2, 1, "m", "inputs.B", "odd", []), (2, 2, "k", "inputs.A", None, None)]
    got = I.column_specs(spark.createDataFrame(rows, "file_id int, pos int, name string, section string, type string, values array<string>")).orderBy("file_id", "pos").collect()
    assert [(r.column_name, r.leaf_type, r.is_decision) for r in got] == [("A.tags", "string", False), ("n", "int", False), ("expected_x", "money", True), ("A.n", "enum", False), ("A.k", "string", False), ("B.m", "string", False)]


def test_first_known_stays(spark):
    rows = spark.createDataFrame([("k", 2, "new", None), ("k", 1, None, "t"), ("k", 3, "newer", "u")], "k string, at int, d string, t string")
    assert tuple(I.merged(rows, ["k"], ["d", "t"], ["at"]).first()) == ("k", "new", "t", 3)


def test_places_groups_forms_and_programs(spark):
    rows = spark.createDataFrame([(1, "n", "outputs"), (1, "n", "inputs.B"), (1, "n", "computed")], "file_id int, name string, section string")
    assert tuple(I.located(rows).first()) == (1, "n", "inputs.B", 3)
    groups = spark.createDataFrame([("a", "old"), ("b", None)], "name string, description string"), spark.createDataFrame([("a", "new"), ("c", "c"), ("b", "b")], "name string, description string")
    assert {tuple(r) for r in I.merged_groups(*groups).collect()} == {("a", "old", "existing"), ("b", "b", "existing"), ("c", "c", "new")}
    forms = I.json_form(I.entries(manifests(spark, [{"entries": [{"name": "a", "v": 1}, {"v": None, "name": "b"}]}, {"entries": [{"name": "a", "v": [1]}]}, {"entries": [{"name": "a"}, {"v": 1}]}])))
    assert {r.file_id: r.form for r in forms.collect()} == {0: "table", 1: "fenced", 2: "fenced"}
    programs = spark.createDataFrame([("d", "p"), ("d", "p"), ("e", "p"), ("e", "q")], "domain string, program string")
    assert {tuple(r) for r in I.chosen_program(programs).collect()} == {("d", "p", "single"), ("e", None, "ambiguous")}


def test_names_in_every_form(spark):
    rows = I.entries(manifests(spark, [{"entries": [{"s": ["a", {"name": "b"}, 3]}, {"s": {"c": 1}}, {"s": None}, {}]}]))
    assert [r.n for r in rows.select("pos", I.names_listed(I.field(F.col("e"), "s")).alias("n")).orderBy("pos").collect()] == [["a", "b"], ["c"], None, None]


def test_conditions_traces_and_edges(spark):
    row = spark.createDataFrame([(5, None)], "x int, y int")
    held = decisions.condition([F.col("x") > 1, {"any_of": [F.col("x") > 9, {"all_of": [F.col("x") < 7]}]}])
    got = row.select(held.alias("h"), decisions.condition({"any_of": []}).alias("none"), decisions.trace({"A": F.col("x") > 1, "B": F.col("y") > 1}).alias("t")).first()
    assert (got.h, got.none, [tuple(s) for s in got.t]) == (True, False, [(1, "A", True), (2, "B", False)])
    assert cases.scenarios(row, cases.EDGES).count() == 7


def test_tags_reviews_and_relevance(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    assert {tuple(r) for r in graphs.tagged([("one", names("a", "b")), ("two", names("b", "c"))]).collect()} == {("a", "one"), ("b", "one"), ("c", "two")}
    text = "# H\nx\n```rules\nscope A:\n```\n## I\n```\n```"
    lines = spark.createDataFrame([(1, i, line) for i, line in enumerate(text.split("\n"))], "doc_id int, at int, line string")
    assert [tuple(r) for r in graphs.review_items(lines, "doc_id").orderBy("line_no").collect()] == [(1, 3, "H", "scope A:", 3), (1, 7, "I", "```", 3)]
    docs = spark.createDataFrame([(1, "see § 4"), (2, "the income_x counts"), (3, "nothing"), (4, "")], "doc_id int, text string")
    assert {tuple(r) for r in graphs.relevant(docs, spark.createDataFrame([("income_x",)], "word string")).collect()} == {(1, "citation"), (2, "vocabulary")}


def test_coverage(spark):
    pairs = spark.createDataFrame([("m", "a"), ("n", "a"), ("n", "b")], "module string, tag string")
    assert {tuple(r) for r in cases.coverage(pairs, "tag", "module").collect()} == {("a", 2, 0), ("b", 1, 1)}
