"""Inventories: entries out of manifests, checked field by field, located, merged and turned into columns of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.cases import leaf_type
from caseloom.operators.catalog import section_rank
from caseloom.operators.schema_drift import parsed

_OBJECT, _LIST = "map<string,variant>", "array<variant>"

#: The version that is read, the types of entries, and the columns that every case has.
VERSION = 3.0
TYPES = ("integer", "decimal", "money", "boolean", "date", "string", "enum", "list", "duration", "structure")
RESERVED = ("case_id", "short_description", "description", "tags", "notes")
SNAKE, SECTION = r"^[a-z][a-z0-9_]*$", r"^(inputs\.[A-Z][A-Za-z0-9]*|computed|outputs)$"


def _json(value: Column) -> Column:
    """A value's JSON text; null where it is absent or null."""
    return F.when(value.isNotNull() & ~F.is_variant_null(value), F.to_json(value))


def text_of(value: Column) -> Column:
    """A value that is text; null for any other."""
    return F.when(_json(value).startswith('"'), F.try_variant_get(value, "$", "string"))


def field(entry: Column, name: str) -> Column:
    return F.try_element_at(entry, F.lit(name))


def load_state(body: Column) -> Column:
    """loaded; empty for a missing or blank body, unreadable for one that is no JSON object, rejected for another version."""
    held = parsed(body)
    version = F.try_variant_get(field(held, "version"), "$", "string").try_cast("double")
    return F.when(F.coalesce(F.trim(body), F.lit("")) == "", "empty").when(held.isNull(), "unreadable").when(F.coalesce(version == VERSION, F.lit(False)), "loaded").otherwise("rejected")


def entries(manifests: DataFrame) -> DataFrame:
    """(file_id, program, committed_at, pos, e): the objects in each distinct body's list of entries, pos from 0."""
    once = manifests.select("file_id", "program", "committed_at", "body").distinct()
    listed = F.try_variant_get(field(parsed(F.col("body")), "entries"), "$", _LIST)
    rows = once.select("file_id", "program", "committed_at", F.posexplode(listed).alias("pos", "v"))
    return rows.select("file_id", "program", "committed_at", "pos", F.try_variant_get("v", "$", _OBJECT).alias("e")).where("e is not null")


def first_fault(entry: Column) -> Column:
    """STRUCT<field, problem> of the first rule that an entry breaks, or null."""
    json = lambda n: _json(field(entry, n))
    name, section, kind = (text_of(field(entry, n)) for n in ("name", "section", "type"))
    broken = [
        (F.coalesce(name, F.lit("")) == "", "name", "missing"),
        (~name.rlike(SNAKE), "name", "not snake case"),
        (F.coalesce(section, F.lit("")) == "", "section", "missing"),
        (~section.rlike(SECTION), "section", "unknown"),
        (json("observations").isNotNull() & ~json("observations").startswith("["), "observations", "no list"),
        (json("description").isNotNull() & (F.coalesce(text_of(field(entry, "description")), F.lit("")) == ""), "description", "no text"),
        (json("type").isNotNull() & ~F.coalesce(kind.isin(*TYPES), F.lit(False)), "type", "unknown"),
        (json("values").isNotNull() & ~json("values").startswith("["), "values", "no list"),
        (json("optional").isNotNull() & ~json("optional").isin("true", "false"), "optional", "no boolean"),
    ]
    return F.coalesce(*[F.when(on, F.struct(F.lit(f).alias("field"), F.lit(p).alias("problem"))) for on, f, p in broken])


def located(rows: DataFrame) -> DataFrame:
    """(file_id, name, section, places): where a name stands first, inputs before computed before outputs, and in how many places.

    rows: entries with name and section.
    """
    rank = section_rank(F.regexp_extract("section", "^[a-z]+", 0))
    return rows.groupBy("file_id", "name").agg(F.min(F.struct(rank.alias("rank"), "section"))["section"].alias("section"), F.count_distinct("section").alias("places"))


def merged(rows: DataFrame, keys: list[str], scalars: list[str], order: list[str]) -> DataFrame:
    """One entry of each key: of each scalar what was known first stays, gaps are filled by what comes later."""
    return rows.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in scalars], F.count("*").alias("mentions"))


def column_specs(rows: DataFrame) -> DataFrame:
    """(file_id, pos, column_name, leaf_type, is_decision) of the columns that a manifest's cases have.

    Inputs come by entity in order of mention, then outputs as expected ones; computed entries have no column.
    Several entities, and names that cases need themselves, put the entity before the name. rows: file_id, pos,
    name, section, type and values.
    """
    entity = F.nullif(F.regexp_extract("section", r"^inputs\.(.*)$", 1), F.lit(""))
    known = rows.withColumn("entity", entity).withColumn("decision", F.col("section") == "outputs").where("entity is not null or decision")
    per_file, per_entity = Window.partitionBy("file_id"), Window.partitionBy("file_id", "entity")
    known = known.withColumns({"first": F.min("pos").over(per_entity), "entities": F.size(F.collect_set("entity").over(per_file))})
    bare = ~(F.col("name").isin(*RESERVED) | F.col("name").startswith("expected_")) & (F.col("entities") <= 1)
    column = F.when(F.col("decision"), F.concat(F.lit("expected_"), "name")).when(bare, F.col("name")).otherwise(F.concat_ws(".", "entity", "name"))
    place = F.row_number().over(per_file.orderBy("decision", F.when(~F.col("decision"), F.col("first")), "pos"))
    return known.select("file_id", place.alias("pos"), column.alias("column_name"), leaf_type(F.col("type"), F.col("values")).alias("leaf_type"), F.col("decision").alias("is_decision"))


def names_listed(value: Column) -> Column:
    """The names in a list of texts, a list of objects with a name, or an object whose keys are names."""
    items = F.transform(F.try_variant_get(value, "$", _LIST), lambda x: F.coalesce(text_of(x), text_of(field(F.try_variant_get(x, "$", _OBJECT), "name"))))
    keys = F.map_keys(F.try_variant_get(value, "$", _OBJECT))
    return F.filter(F.coalesce(items, keys), lambda x: x.isNotNull())


def harvest(body: Column, key: str) -> Column:
    """The texts that a key has in a JSON text at any depth, as they are written."""
    return F.regexp_extract_all(body, F.lit(rf'"{key}"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))


def merged_groups(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """(name, description, origin): groups of both; what exists keeps its description, new ones bring theirs."""
    both = existing.select("name", F.col("description").alias("old"), F.lit(True).alias("is_old")).join(candidates.select("name", F.col("description").alias("new")), "name", "full")
    return both.select("name", F.coalesce("old", "new").alias("description"), F.when(F.col("is_old"), "existing").otherwise("new").alias("origin"))


def json_form(rows: DataFrame) -> DataFrame:
    """(file_id, form): table where all entries of a file have the same fields and only plain values, else fenced.

    rows: file_id and e of each entry.
    """
    nested = F.exists(F.map_values("e"), lambda v: F.coalesce(_json(v).rlike(r"^[\[{]"), F.lit(False)))
    fields = F.array_join(F.array_sort(F.map_keys("e")), "\u001f")
    return rows.groupBy("file_id").agg(F.when((F.count_distinct(fields) == 1) & ~F.bool_or(nested), "table").otherwise("fenced").alias("form"))


def chosen_program(candidates: DataFrame, given: Column | None = None) -> DataFrame:
    """(domain, program, how): the program given, else the only one there is; without a program where several are."""
    only = candidates.groupBy("domain").agg(F.count_distinct("program").alias("n"), F.min("program").alias("one"))
    asked = F.lit(None).cast("string") if given is None else given
    how = F.when(asked.isNotNull(), "given").when(F.col("n") == 1, "single").otherwise("ambiguous")
    return only.select("domain", F.coalesce(asked, F.when(F.col("n") == 1, F.col("one"))).alias("program"), how.alias("how"))
