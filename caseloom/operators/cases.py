"""Test cases as data: types, duplicates, upserts, exports, what went stale and what is not covered yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The types of a manifest and of a column of cases.
LEAF = {"integer": "int", "decimal": "float", "money": "money", "boolean": "bool", "date": "date", "string": "string", "enum": "enum", "list": "list", "duration": "string", "structure": "string"}


def leaf_type(declared: Column, allowed: Column) -> Column:
    """The column type of a declared one; whatever has allowed values is an enum, whatever is unknown a string."""
    table = F.create_map(*[F.lit(x) for pair in LEAF.items() for x in pair])
    known = F.when(declared.isin(*LEAF.values()), declared).otherwise(F.try_element_at(table, declared))
    return F.when(F.coalesce(F.size(allowed) > 0, F.lit(False)), "enum").otherwise(F.coalesce(known, F.lit("string")))


def last_wins(cases: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of cases that share a key the last one, with the number of those it replaces."""
    w = Window.partitionBy(*keys)
    return cases.withColumns({"__n": F.row_number().over(w.orderBy(*[F.desc(c) for c in order])), "replaced": F.count("*").over(w) - 1}).where("__n = 1").drop("__n")


def shared_labels(cases: DataFrame, group: list[str], label: str, where: list[str]) -> DataFrame:
    """Labels that more than one case of a group has, with the place where each was first used."""
    named = cases.where(F.col(label).isNotNull() & (F.col(label) != ""))
    return named.groupBy(*group, label).agg(F.count("*").alias("cases"), F.min(F.struct(*where)).alias("first")).where("cases > 1").select(*group, label, "cases", *[F.col(f"first.{c}").alias(f"first_{c}") for c in where])


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All cases, incoming ones in place of existing ones of the same key; action says which."""
    rows = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key)
    marked = rows.withColumns({"__both": F.min("__new").over(w) != F.max("__new").over(w), "__n": F.row_number().over(w.orderBy(F.desc("__new")))})
    action = F.when(F.col("__new") == 0, "kept").when(F.col("__both"), "updated").otherwise("added")
    return marked.where("__n = 1").withColumn("action", action).drop("__new", "__both", "__n")


def export_cell(value: Column) -> Column:
    """A typed value (as load_cases gives it) as text: lists joined by ;, booleans in lower case."""
    amount = F.regexp_replace(value["amount"].cast("string"), r"\.00$", "")
    return F.coalesce(value["flag"].cast("string"), value["whole"].cast("string"), value["number"].cast("string"), amount, value["day"].cast("string"), F.array_join(value["items"], "; "), value["text"], F.lit(""))


def quoted(text: Column) -> Column:
    """A field as comma-separated text holds it."""
    return F.when(text.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def differences(recorded: DataFrame, recomputed: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, name, recorded, recomputed) where values (keys, name, value DOUBLE) differ or stand on one side only."""
    on = [*keys, "name"]
    both = recorded.withColumnRenamed("value", "recorded").join(recomputed.withColumnRenamed("value", "recomputed"), on, "full")
    same = (F.abs(F.col("recorded") - F.col("recomputed")) <= tolerance) | (F.col("recorded").isNull() & F.col("recomputed").isNull())
    return both.where(~F.coalesce(same, F.lit(False)))


def boundaries(thresholds: DataFrame, group: str, value: str, covered: DataFrame) -> DataFrame:
    """(group, value): one below, at and one above each threshold, without those that covered has."""
    around = thresholds.select(group, F.explode(F.array(*[F.col(value) + k for k in (-1, 0, 1)])).alias(value)).distinct()
    return around.join(covered.select(group, value).distinct(), [group, value], "left_anti")


def coverage(pairs: DataFrame, value: str, group: str) -> DataFrame:
    """(value, having, lacking): in how many of all groups a value of distinct (group, value) occurs, and in how many not."""
    groups = pairs.select(F.count_distinct(group).alias("__groups"))
    return pairs.groupBy(value).agg(F.count("*").alias("having")).crossJoin(F.broadcast(groups)).select(value, "having", (F.col("__groups") - F.col("having")).alias("lacking"))


#: The edges at which a numeric column is tried.
EDGES = ("zero", "negative", "just_below", "exact", "just_above", "very_large", "missing")


def scenarios(columns: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """columns with scenario, one row for each of kinds."""
    return columns.withColumn("scenario", F.explode(F.array(*map(F.lit, kinds))))
