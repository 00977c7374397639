"""Queries and operators that once did less than the whole job."""

import datetime as dt
import hashlib

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from caseloom.operators import catalog
from caseloom.plans import load
from caseloom.session import read_table
from verify import rows as compared


def rules(*lines):
    return "```rules\n" + "\n".join(lines) + "\n```"


def written(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")


def test_k_04_orders_all_names_and_leaves_cycles_without_a_place(spark, tmp_path):
    day = dt.datetime(2024, 5, 1)
    text = rules("definition b equals z", "definition a equals b", "definition x equals y", "definition y equals x", "definition w equals x", "rule s under condition s > 1")
    written(spark, tmp_path, "documents", [(1, text, day), (2, None, day)], "doc_id long, text string, added_at timestamp")
    got = {r.node: r.depth for r in load()[0]["k_04"](spark, str(tmp_path)).collect()}
    assert got == {"z": 0, "b": 1, "a": 2, "x": None, "y": None, "w": None, "s": None}


def test_f_14_starts_from_all_names_of_late_documents(spark, tmp_path):
    early, late = dt.datetime(2024, 4, 30), dt.datetime(2024, 5, 1)
    rows = [(1, rules("definition c equals a", "definition d equals c", "definition e equals b", "definition g equals f"), early), (2, rules("definition a equals h"), late), (3, rules("definition b equals h"), dt.datetime(2024, 5, 31)), (4, "no rules", dt.datetime(2024, 7, 9))]
    written(spark, tmp_path, "documents", rows, "doc_id long, text string, added_at timestamp")
    got = {r.name: r.distance for r in load()[0]["f_14"](spark, str(tmp_path)).collect()}
    assert got == {"a": 0, "b": 0, "c": 1, "e": 1, "d": 2}


def test_changes_go_on_over_more_than_a_hundred_steps(spark):
    needs = spark.createDataFrame([(i + 1, i) for i in range(103)], "name int, needs int")
    got = {r.name: r.distance for r in catalog.propagate(spark.createDataFrame([(0,)], "name int"), needs).collect()}
    assert got == {i: i for i in range(104)}


UNPACKED = """create view observations as select obs_id, domain, entry_section, entry_name, null::varchar as payload, observed_at, ingested_at,
  case when outside then p->>'policy_phrase' else policy_phrase end as policy_phrase, case when outside then p->>'source_doc' else source_doc end as source_doc, case when outside then p->>'section' else section end as section
  from (select *, try_cast(payload as json) as p, coalesce(policy_phrase, source_doc, section) is null and payload is not null as outside from '/root/testdata/sf0.01/observations.parquet')"""


@pytest.mark.parametrize("name", ["m_03", "m_05", "m_06", "m_11", "m_12", "m_13", "v_03"])
def test_observations_in_payload_count_like_those_in_columns(spark, name):
    """The SQL as it stands, over a view in which payload has been unpacked."""
    runs, sql = load()
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    con.execute(UNPACKED)
    con.execute("create view parse_result as select * from '/root/testdata/sf0.01/parse_result.parquet'")
    assert compared(runs[name](spark, "/root/testdata/sf0.01").toPandas()) == compared(con.execute(sql[name]).df())


SMALL = "/root/testdata/sf0.001"


def test_two_sides_hold_every_row_once(spark):
    rows = spark.createDataFrame([(1, None)] + [(i, dt.datetime(2024, 1, i)) for i in range(2, 8)], "id int, at timestamp")
    earlier, later = catalog.by_time(rows, "at")
    assert ([r.id for r in earlier.orderBy("id").collect()], [r.id for r in later.orderBy("id").collect()]) == ([1, 2, 3, 4], [5, 6, 7])


def test_merges_take_in_all_entries_and_cases(spark):
    runs, _ = load()
    entries = read_table(spark, SMALL, "observations").where("entry_section is not null and entry_name is not null").select("domain", "entry_section", "entry_name").distinct().count()
    merged = runs["m_03"](spark, SMALL).collect()
    told = Counter((r.domain, r.entry_section, r.entry_name) for r in runs["m_05"](spark, SMALL).collect())
    assert {(r.domain, r.entry_section, r.entry_name): r.observations for r in merged} == told and len(merged) == entries
    assert sum(r.entries for r in runs["m_09"](spark, SMALL).collect()) == entries
    kept = sum(r.action == "kept" for r in merged)
    assert runs["m_07"](spark, SMALL).count() == kept
    cases = runs["p1_loaded"](spark, SMALL).select("module", "case_id").distinct().count()
    assert sum(r.cases for r in runs["c_11"](spark, SMALL).collect()) == cases


def test_rules_and_look_up_take_in_all_lines_and_parts(spark):
    runs, _ = load()
    lines = read_table(spark, SMALL, "lineitem").count()
    assert runs["d_02"](spark, SMALL).count() == lines
    assert runs["d_02"](spark, SMALL).where("l_quantity = 12 and (v is not null or status <> 'conflict')").count() == 0
    found = read_table(spark, SMALL, "lineitem").join(read_table(spark, SMALL, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").count()
    assert runs["d_11"](spark, SMALL).where("found").count() == found


def test_large_groups_are_neither_array_nor_one_text(spark):
    runs, _ = load()
    plan = runs["m_03"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "array_distinct" not in plan


def test_digests_cover_blocks_of_one_size(spark, monkeypatch):
    monkeypatch.setattr(catalog, "WALK", 3)
    rows = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(7)], "k string, i int")
    got = {(r.k, r.block): (r.n, r.digest) for r in catalog.walk_digests(rows, "k", ["i"], "n").collect()}
    md5 = lambda ns: hashlib.md5("\n".join(map(str, ns)).encode()).hexdigest()
    assert got == {(k, b): (len(ns), md5(ns)) for k in ("a", "b", None) for b, ns in enumerate(([0, 1, 2], [3, 4, 5], [6]))}
