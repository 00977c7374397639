import datetime as dt
import json

from caseloom.operators import schema_drift as D

SCHEMA = "file_id bigint, domain string, program string, path string, committed_at timestamp, ingested_at timestamp, body string, nth int"


def table(spark, bodies, program="p"):
    rows = []
    for i, body in enumerate(bodies):
        text = body if isinstance(body, str) or body is None else json.dumps(body)
        rows.append((i, None, program, None, dt.datetime(2024, 1, 1 + i), dt.datetime(2024, 2, 1), text, 1))
    return spark.createDataFrame(rows, SCHEMA)


def entries(**by_name):
    return [{"name": n} | f for n, f in by_name.items()]


def test_each_kind_of_change(spark):
    a = {"version": "1", "title": "t", "entries": entries(x={"unit": "h", "note": "n", "obs": [{"doc": "d", "sec": "s"}]}, y={"unit": "m", "obs": [{"doc": "e", "sec": None}]})}
    b = {"version": 1, "name": "t", "entries": entries(y={"measure": "m", "obs": [{"doc": "e", "sec": {"text": "s"}}]}, x={"measure": "h", "obs": [{"doc": "d", "sec": {"text": "s"}}]}, z={"measure": "new"})}
    got = {tuple(r) for r in D.changes(table(spark, [a, "{broken", b, None, "[1]"])).collect()}
    assert got == {
        (2, "type_changed", "version", "version"), (2, "renamed", "title", "name"), (2, "renamed", "entries.unit", "entries.measure"), (2, "removed", "entries.note", ""),
        (2, "type_changed", "entries.obs.sec", "entries.obs.sec"),
    }


def test_fields_below_a_reported_field_are_left_out_and_null_is_absent(spark):
    a = {"entries": entries(x={"obs": [{"doc": "d"}], "gone": None})}
    b = {"entries": entries(x={"seen": [{"doc": "d"}]})}
    c = {"entries": entries(x={"seen": [{"doc": "d"}], "extra": {"k": 1}})}
    got = {tuple(r) for r in D.changes(table(spark, [a, b, c])).collect()}
    assert got == {(1, "renamed", "entries.obs", "entries.seen"), (2, "added", "", "entries.extra")}


def test_files_delivered_twice_count_once_and_order_is_by_commit(spark):
    rows = table(spark, [{"a": 1}, {"a": 1, "b": 2}])
    assert [tuple(r) for r in D.changes(rows.unionAll(rows)).collect()] == [(1, "added", "", "b")]


def test_lifespans_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 3)
    rows = table(spark, [{"a": 1} | ({"b": 1} if i in (1, 2, 3, 6) else {}) for i in range(9)])
    spans = {(r.field, r.first_file, r.last_file, r.files) for r in D.lifespans(rows).collect()}
    assert spans == {("a", 0, 8, 9), ("b", 1, 3, 3), ("b", 6, 6, 1)}
    got = sorted((r.file_id, r.change_kind) for r in D.changes(rows).collect())
    assert got == [(1, "added"), (4, "removed"), (6, "added"), (7, "removed")]


def test_one_table_takes_every_form(spark):
    a = {"version": "1", "entries": entries(x={"policy_phrase": "p", "source_doc": "d", "section_text": "s", "optional": "true"})}
    b = {"version": "1", "entries": entries(x={"phrase_text": "p", "source_doc": "d", "section_text": "s", "optional": True})}
    c = {"version": "2", "entries": entries(x={"observations": [{"policy_phrase": "p", "section": {"text": "s"}}], "more": 5})}
    rows = sorted(D.one_table(table(spark, [a, b, c])).collect(), key=lambda r: r.file_id)
    assert [r.policy_phrases for r in rows] == [["p"]] * 3 and [r.sections for r in rows] == [["s"]] * 3
    assert rows[1].optional is True and rows[2].version == "2" and rows[2].other == {"more": "5"}


def test_a_column_and_its_other_name_in_one_entry_are_both_kept(spark):
    a = {"entries": entries(x={"help": "h"}, y={"help": "i"})}
    b = {"entries": entries(x={"description": "h"}, y={"description": "i"})}
    c = {"entries": entries(x={"help": "short help", "description": "long text"})}
    rows = {(r.file_id, r.name): (r.description, r.other) for r in D.one_table(table(spark, [a, b, c])).collect()}
    assert rows == {(0, "x"): ("h", {}), (0, "y"): ("i", {}), (1, "x"): ("h", {}), (1, "y"): ("i", {}), (2, "x"): ("long text", {"help": "short help"})}


def test_a_name_stands_for_a_column_while_it_lasts(spark):
    """In p the name is given up and later means something else; q never renamed it and follows what others did."""
    p = [{"entries": entries(x={"old": "1"})}, {"entries": entries(x={"unit": "1"})}, {"entries": entries(x={"unit": "1"})}]
    q = [{"entries": entries(z={"old": "2", "n": None})}]
    rows = table(spark, p, "p").unionAll(table(spark, q, "q").selectExpr("file_id + 10 as file_id", "domain", "program", "path", "committed_at", "ingested_at", "body", "nth"))
    assert {(r.file_id, r.name): r.unit for r in D.one_table(rows).collect()} == {(0, "x"): "1", (1, "x"): "1", (2, "x"): "1", (10, "z"): "2"}


def test_of_two_deliveries_that_differ_one_counts_whole(spark):
    rows = table(spark, [{"a": 1}, {"a": 1, "b": 2}])
    other = table(spark, [{"a": 1}, {"a": 1, "c": 2}]).where("file_id = 1").selectExpr("file_id", "domain", "program", "path", "committed_at", "ingested_at + interval 1 day as ingested_at", "body", "nth")
    broken = other.selectExpr("file_id", "domain", "program", "path", "committed_at", "ingested_at - interval 9 days as ingested_at", "'{\"x' as body", "nth")
    assert [tuple(r) for r in D.changes(rows.unionAll(other).unionAll(broken)).collect()] == [(1, "added", "", "b")]


def test_nothing(spark):
    empty = table(spark, [{"a": 1}]).limit(0)
    assert D.changes(empty).count() == 0 and D.lifespans(empty).count() == 0 and D.one_table(empty).count() == 0
