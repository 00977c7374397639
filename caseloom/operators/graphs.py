"""Rule source read as a graph: modules, names, who depends on whom, in what order, and reviews of its parts."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.session import materialize

KEYWORDS = ("if", "then", "else", "and", "or", "not", "of", "true", "false", "under", "condition", "equals", "min", "max", "sum", "exception", "definition", "rule", "assertion", "scope")


def definitions(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, name, body) of every definition, rule and assertion in the fenced blocks of rule documents."""
    block = F.explode(F.regexp_extract_all("text", F.lit(r"(?s)```rules\r?\n(.*?)```"), F.lit(1)))
    lines = documents.select("doc_id", block.alias("block")).select("doc_id", F.explode(F.split("block", r"\r?\n")).alias("line"))
    part = lambda i: F.regexp_extract("line", r"^\s*(?:exception )?(definition|rule|assertion) ([a-z_][a-z0-9_]*)\s*(.*)$", i)
    return lines.select("doc_id", part(1).alias("kind"), part(2).alias("name"), part(3).alias("body")).where("kind <> ''")


def names_in(text: Column) -> Column:
    """The identifiers in an expression, without keywords, each once."""
    words = F.filter(F.split(text, "[^A-Za-z0-9_]+"), lambda x: x.rlike("^[a-z_][a-z0-9_]*$"))
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, KEYWORDS))))


def edges(defined: DataFrame, loops: bool = False) -> DataFrame:
    """(src, dst, uses): dst is defined from src so many times; names defined from themselves only with loops."""
    uses = defined.select(F.explode(names_in(F.col("body"))).alias("src"), F.col("name").alias("dst"))
    return (uses if loops else uses.where("src <> dst")).groupBy("src", "dst").agg(F.count("*").alias("uses"))


def degrees(links: DataFrame) -> DataFrame:
    """(node, ins, outs, class): input without edges in, output without edges out, else intermediate."""
    ends = links.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(links.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sums = ends.groupBy("node").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"))
    return sums.withColumn("class", F.when(F.col("ins") == 0, "input").when(F.col("outs") == 0, "output").otherwise("intermediate"))


def folded(parts: list[DataFrame], name: str, at: int = 50) -> list[DataFrame]:
    """parts, written as one where there are so many that their union would make a long plan."""
    return parts if len(parts) < at else [materialize(reduce(DataFrame.unionByName, parts), name)]


def topological(links: DataFrame) -> DataFrame:
    """(node, depth): the length of the longest path to each node; null for nodes on or behind a cycle.

    Nodes without edges in are taken off round by round until none is left without; every round is a join, and its
    rest is written so that the plan stays short.
    """
    left = links.select("src", "dst").where("src <> dst").distinct()
    loops = links.where("src = dst").select(F.col("src").alias("node")).distinct()
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    remaining, done = materialize(nodes, "nodes"), []
    left = materialize(left.unionByName(loops.select(F.col("node").alias("src"), F.col("node").alias("dst"))), "links")
    for depth in count():
        free = materialize(remaining.join(left.select(F.col("dst").alias("node")), "node", "left_anti"), "free")
        if free.isEmpty():
            break
        done = folded([*done, free.withColumn("depth", F.lit(depth))], "order")
        remaining = materialize(remaining.join(free, "node", "left_anti"), "nodes")
        left = materialize(left.join(free.withColumnRenamed("node", "src"), "src", "left_anti"), "links")
    return reduce(DataFrame.unionByName, done, remaining.withColumn("depth", F.lit(None).cast("int")))


def safe_id(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9]", "_")


def dot(links: DataFrame) -> DataFrame:
    """One line of a graph drawing for each edge."""
    return links.select(F.concat(F.lit("  "), safe_id(F.col("src")), F.lit(" -> "), safe_id(F.col("dst")), F.lit(";")).alias("line")).distinct()


def bucket(fidelity: Column, clarity: Column, logic: Column, policy: Column) -> Column:
    """unscored, uncertain (fidelity or clarity at most 2), complex (logic or policy at least 4) or verified."""
    scored = fidelity.isNotNull() & clarity.isNotNull() & logic.isNotNull() & policy.isNotNull()
    return F.when(~scored, "unscored").when((fidelity <= 2) | (clarity <= 2), "uncertain").when((logic >= 4) | (policy >= 4), "complex").otherwise("verified")


def preceding_heading(lines: DataFrame, key: str) -> DataFrame:
    """lines (key, at, line) with the nearest heading before each."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("heading", F.last(F.when(F.col("line").rlike(r"^#{1,6} +\S"), F.regexp_extract("line", r"^#{1,6} +(.*?)\s*$", 1)), ignorenulls=True).over(w))


def tagged(passes: list[tuple[str, DataFrame]]) -> DataFrame:
    """(name, reason): every name that any pass (reason, names) finds, with the reason of the first that does."""
    found = reduce(DataFrame.unionByName, [names.select("name", F.lit(i).alias("rank"), F.lit(reason).alias("reason")) for i, (reason, names) in enumerate(passes)])
    return found.groupBy("name").agg(F.min_by("reason", "rank").alias("reason"))


def review_items(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, heading, first, score) of each fenced block in lines (key, at, line): the heading above it, its
    first line, and 3 for a score that is not given."""
    from pyspark.sql import Window

    by_line = Window.partitionBy(key).orderBy("at")
    fence = F.col("line").rlike("^```")
    marked = preceding_heading(lines, key).withColumns({"fences": F.sum(fence.cast("int")).over(by_line), "first": F.coalesce(F.lead("line").over(by_line), F.lit(""))})
    return marked.where(fence & (F.col("fences") % 2 == 1)).select(key, (F.col("at") + 1).alias("line_no"), "heading", "first", F.lit(3).alias("score"))


def module_hints(entries: DataFrame, defined: DataFrame, entities: int = 2, rules: int = 3) -> DataFrame:
    """(hint, key, n): fields that several entities of a file have, and conditions that several rules share.

    A field's running number, and the amounts in a condition, do not matter.

    entries: file_id, entity, name; defined: as definitions gives it.
    """
    base = F.regexp_replace("name", "_[0-9]+$", "")
    mirrored = entries.where("entity is not null").groupBy("file_id", base.alias("name")).agg(F.count_distinct("entity").alias("n")).where(F.col("n") >= entities)
    mirrored = mirrored.groupBy("name").agg(F.count("*").alias("n")).select(F.lit("mirrored").alias("hint"), F.col("name").alias("key"), "n")
    gate = F.regexp_replace(F.regexp_extract("body", r"under condition (.*\S)", 1), r"\$?[0-9][0-9,.]*", "#")
    gates = defined.select(gate.alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= rules)
    return mirrored.unionByName(gates.select(F.lit("gate").alias("hint"), "key", "n"))


def relevant(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, why): citation for texts that cite a section, else vocabulary for those with a word of it; others are left out.

    vocabulary: distinct words.
    """
    cites = F.col("text").rlike(r"§ ?[0-9]|[Ss]ection [0-9]+\.[0-9]")
    words = F.explode(F.array_distinct(F.split("text", "[^A-Za-z0-9_]+")))
    known = documents.where(~cites).select("doc_id", words.alias("word")).join(vocabulary.select("word"), "word", "left_semi").select("doc_id").distinct()
    return documents.where(cites).select("doc_id").distinct().withColumn("why", F.lit("citation")).unionByName(known.withColumn("why", F.lit("vocabulary")))
