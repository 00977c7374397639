"""A catalogue of named entries: provenance joined from many observations, merges that keep what is known, checks."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.ranking import numbered

#: The sections of a catalogue, verbs and endings that names go without.
SECTIONS = ("inputs", "computed", "outputs")
VERBS = ("determine", "assess", "compute", "evaluate", "calculate")
STAGES = ("_test", "_check", "_evaluation")


def section_of(text: Column) -> Column:
    """STRUCT<section, entity>: inputs.Entity, computed or outputs; null for anything else."""
    fits = text.rlike(r"^(inputs\.[A-Z][A-Za-z0-9]*|computed|outputs)$")
    return F.when(fits, F.struct(F.regexp_extract(text, r"^[a-z]+", 0).alias("section"), F.nullif(F.regexp_extract(text, r"^inputs\.(.*)$", 1), F.lit("")).alias("entity")))


def section_rank(section: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SECTIONS)), section)


def plain_phrase(phrase: Column) -> Column:
    """A phrase as it is looked up: lower case, no leading article, no punctuation, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(phrase)), r"^(the|an|a)\s+", ""), r"[^\w\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def joined_observations(existing: Column, incoming: Column) -> Column:
    """Both lists, the existing first, each element once; nulls in an element compare as equal."""
    none = F.array()
    return F.array_distinct(F.concat(F.coalesce(existing, none), F.coalesce(incoming, none)))


def kept(existing: Column, incoming: Column) -> Column:
    """What is known stays."""
    return F.coalesce(existing, incoming)


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str], scalars: list[str], lists: list[str], keep_unmentioned: bool = True) -> DataFrame:
    """Entries of both by key with action added, merged, kept or dropped.

    Scalars keep what is there and fill gaps; lists are joined. Entries not mentioned again stay, or are marked
    dropped. Keys must be unique on either side; null keys match each other.
    """
    e, i = existing.alias("e"), incoming.alias("i")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"e.{k}").eqNullSafe(F.col(f"i.{k}"))
    both = e.withColumn("__e", F.lit(True)).alias("e").join(i.withColumn("__i", F.lit(True)).alias("i"), on, "full")
    action = F.when(F.col("e.__e").isNull(), "added").when(F.col("i.__i").isNotNull(), "merged").otherwise("kept" if keep_unmentioned else "dropped")
    return both.select(
        *[F.coalesce(F.col(f"e.{k}"), F.col(f"i.{k}")).alias(k) for k in keys],
        *[kept(F.col(f"e.{c}"), F.col(f"i.{c}")).alias(c) for c in scalars],
        *[joined_observations(F.col(f"e.{c}"), F.col(f"i.{c}")).alias(c) for c in lists],
        action.alias("action"),
    )


def look_up(phrases: DataFrame, entries: DataFrame) -> DataFrame:
    """phrases (phrase_id, phrase, source_doc) each with its best entry of the same plain phrase: from the same
    document first, then by entity and name."""
    left = phrases.withColumn("plain", plain_phrase(F.col("phrase"))).where("plain <> ''")
    right = entries.select(plain_phrase(F.col("phrase")).alias("plain"), F.col("source_doc").alias("entry_doc"), "entity", "name").where("plain <> ''")
    # an entry seen many times under one phrase and document is one candidate
    best = right.groupBy("plain", "entry_doc").agg(F.min(F.struct(F.coalesce("entity", F.lit("")).alias("entity"), "name")).alias("e"))
    overall = best.groupBy("plain").agg(F.min("e").alias("any"))
    return (
        left.join(best.withColumnRenamed("e", "same"), (left["plain"] == best["plain"]) & (left["source_doc"] == best["entry_doc"]), "left")
        .select(left["phrase_id"], left["plain"], "same")
        .join(overall, "plain", "left")
        .select("phrase_id", F.coalesce("same.name", "any.name").alias("name"))
    )


def unresolved(references: DataFrame, names: DataFrame) -> DataFrame:
    """References (ref, name) to names that are not there."""
    return references.join(names.select("name").distinct(), "name", "left_anti")


def disagreements(left: DataFrame, right: DataFrame, key: str, fields: list[str], module: str | None = None) -> DataFrame:
    """(key, field, left, right): fields that both sides give and give differently.

    With module, both sides hold several; each pair of them is compared once and named left_module, right_module.
    """
    both = left.alias("l").join(right.alias("r"), key)
    named = []
    if module:
        both = both.where(F.col(f"l.{module}") < F.col(f"r.{module}"))
        named = [F.col(f"l.{module}").alias("left_module"), F.col(f"r.{module}").alias("right_module")]
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").cast("string").alias("left"), F.col(f"r.{f}").cast("string").alias("right")) for f in fields])
    return both.select(*named, key, F.inline(F.filter(pairs, lambda p: p["left"] != p["right"])))


def stage(text: Column) -> Column:
    """A stage's name: trimmed, lower case, without one of the usual endings; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(text)), "(" + "|".join(STAGES) + ")$", ""), F.lit(""))


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the place at which each was first seen."""
    return rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("place"))


def humanize(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def snake(text: Column) -> Column:
    """Snake case without one leading verb of judging."""
    bare = F.regexp_replace(F.lower(F.trim(text)), "^(" + "|".join(VERBS) + r")\s+", "")
    return F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def assignment(hint: Column) -> Column:
    """STRUCT<left, right> of a hint name = expression; null where it is none."""
    fits = hint.rlike(r"^\s*[a-z][a-z0-9_]*\s*=[^=].*\S")
    return F.when(fits, F.struct(F.trim(F.substring_index(hint, "=", 1)).alias("left"), F.trim(F.regexp_extract(hint, r"^[^=]*=(.*)$", 1)).alias("right")))


def newest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


#: Rows of a key that one digest covers.
WALK = 1024


def walk_digests(rows: DataFrame, key: str, order: list[str], total: str) -> DataFrame:
    """(key, block, total, digest): a key's rows in order, in blocks of WALK, and the MD5 of a block's texts.

    A text is the columns of order joined by bars, a block's texts are joined by line breaks. Rows are numbered in
    ranges, so a key of any size has blocks of one size.
    """
    placed = numbered(rows, [key], order).withColumn("block", F.expr(f"nth div {WALK}"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("nth", F.concat_ws("|", *order).alias("text")))), lambda x: x["text"])
    return placed.groupBy(key, "block").agg(F.count("*").alias(total), F.md5(F.array_join(texts, "\n")).alias("digest"))


def by_time(rows: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(earlier, later) rows: before the middle between the first and last time, and from it on; null times are earlier.

    Together they hold every row once.
    """
    middle = rows.agg(F.timestamp_micros(F.expr(f"unix_micros(min({at})) + (unix_micros(max({at})) - unix_micros(min({at}))) div 2")).alias("__middle"))
    both = rows.crossJoin(F.broadcast(middle)).withColumn("__later", F.coalesce(F.col(at) >= F.col("__middle"), F.lit(False)))
    return both.where("not __later").drop("__middle", "__later"), both.where("__later").drop("__middle", "__later")


def renamed_entry(synonyms: Column, prior_name: Column) -> Column:
    """The synonyms of an entry that had another name, that name among them; the same again when repeated."""
    return F.array_distinct(F.concat(F.coalesce(synonyms, F.array().cast("array<string>")), F.when(prior_name.isNotNull(), F.array(prior_name)).otherwise(F.array().cast("array<string>"))))


def propagate(changed: DataFrame, depends_on: DataFrame) -> DataFrame:
    """(name, distance): what is changed, or depends on it over any number of (name, needs) steps; the least distance.

    Each round is a join with what was reached last, written so that the plan stays short; the last one finds nothing new.
    """
    from caseloom.operators.graphs import folded
    from caseloom.session import materialize

    reached = materialize(changed.select("name").distinct().withColumn("distance", F.lit(0)), "reached")
    fresh, parts = reached, [reached]
    for step in count(1):
        out = reduce(DataFrame.unionByName, parts)
        onward = depends_on.join(fresh.select(F.col("name").alias("needs")), "needs").select("name").distinct()
        fresh = materialize(onward.join(out.select("name"), "name", "left_anti").withColumn("distance", F.lit(step)), "reached")
        if fresh.isEmpty():
            return out
        parts = folded([*parts, fresh], "reached")
