"""Fields that come, go, change type or change name between successive files of a producer.

Each file's body, read as a VARIANT, becomes one row for each field and entry: path, type and a digest of the value.
A catalogue of field lifespans follows from lag and lead over the numbered files: where a run of files with a
field begins or ends, a change is logged. Fields that end and begin in the same place with the same values are
one field under another name. The names found so make the alias table from which the casts into one table are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators.ranking import numbered
from caseloom.session import materialize

#: Files in one window group, and distinct renamings of a program that the alias table takes.
BLOCK, MAX_ALIASES = 1000, 20_000

_OBJECT, _LIST = "map<string,variant>", "array<variant>"
#: What entries without a name go by.
NAMELESS = "\u0000"


def _as(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)


def parsed(body: Column) -> Column:
    """The JSON object that a body is, as MAP<STRING, VARIANT>, or null; a key given twice makes it unreadable."""
    return F.when(body.rlike(r"\}\s*$"), _as(F.try_parse_json(body), _OBJECT))


def _filled(value: Column) -> Column:
    return value.isNotNull() & ~F.is_variant_null(value)


def _plain_kind(json: Column) -> Column:
    """string, number, boolean, object or list, of a value's JSON text."""
    first = F.left(json, F.lit(1))
    return F.when(first == '"', "string").when(first == "{", "object").when(first == "[", "list").when(first.isin("t", "f"), "boolean").otherwise("number")


def _kind(value: Column, json: Column) -> Column:
    """The JSON type; that of a list names the types of its items."""
    items = F.filter(_as(value, _LIST), _filled)
    inner = F.array_sort(F.array_distinct(F.transform(items, lambda x: _plain_kind(F.to_json(x)))))
    # most long lists are of objects, which need not be written out to be told
    listed = F.when(json == "[]", "list").when(json.startswith("[{") & F.forall(items, lambda x: _as(x, _OBJECT).isNotNull()), "list of object").otherwise(F.coalesce(F.concat(F.lit("list of "), F.nullif(F.array_join(inner, " or "), F.lit(""))), F.lit("list")))
    return F.when(json.startswith("["), listed).otherwise(_plain_kind(json))


def _objects(value: Column) -> Column:
    """The objects that a value is or holds, with their place among them."""
    own, held = _as(value, _OBJECT), F.filter(F.transform(_as(value, _LIST), lambda x: _as(x, _OBJECT)), lambda x: x.isNotNull())
    return F.when(own.isNotNull(), F.array(own)).otherwise(F.coalesce(held, F.array().cast(f"array<{_OBJECT}>")))


def entry_name(entry: Column) -> Column:
    """What an entry is called; null unless its name is text."""
    name = F.try_element_at(entry, F.lit("name"))
    return F.when(F.to_json(name).startswith('"'), _as(name, "string"))


def readable(manifests: DataFrame) -> DataFrame:
    """(file_id, program, committed_at, object) of each file once, written.

    A file delivered several times counts by its first readable delivery. Files without file_id, program or
    committed_at, and bodies that are no JSON objects, are left out.
    """
    known = manifests.where("file_id is not null and program is not null and committed_at is not null and body is not null")
    rows = known.select("file_id", "program", "committed_at", "ingested_at", "body", F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows.withColumn("readable", parsed(F.col("body")).isNotNull()).where("readable").drop("readable"), "bodies")
    # only ids and digests are shuffled to choose among deliveries
    first = rows.groupBy("file_id").agg(F.min(F.struct("ingested_at", F.xxhash64("body"), "row"))["row"].alias("row"))
    return rows.join(first, ["file_id", "row"], "left_semi").select("file_id", "program", "committed_at", parsed(F.col("body")).alias("object"))


def field_values(objects: DataFrame) -> DataFrame:
    """(file_id, path, entry, place, v): every field of each file with its value, for each entry that has it.

    Entries are the objects of a list at the top of which some have a name; a path below them is compared entry by
    entry, whatever their order. At the top the entry is ''. '' as a path has the entries there are. place tells
    the objects of a list apart. Objects are gone through level by level; each level reads
    what the level above it wrote.
    """
    level = objects.select("file_id", F.lit("").alias("prefix"), F.lit("").alias("entry"), F.lit("").alias("place"), F.col("object").alias("m"))
    none = F.lit(None).cast("variant").alias("v")
    parts = [objects.select("file_id", F.lit("").alias("path"), F.lit("").alias("entry"), F.lit("").alias("place"), none)]
    depth = 0
    while True:
        fields = level.select("file_id", "prefix", "entry", "place", F.explode("m").alias("key", "v")).where(_filled(F.col("v")))
        path = F.when(F.col("prefix") == "", F.col("key")).otherwise(F.concat_ws(".", "prefix", "key"))
        told = fields.select("file_id", path.alias("path"), "entry", "place", "v", (F.col("prefix") == "").alias("top"))
        parts.append(told.select("file_id", "path", "entry", "place", "v"))
        held = told.withColumn("inner", _objects(F.col("v"))).where(F.size("inner") > 0)
        named = F.col("top") & _as(F.col("v"), _LIST).isNotNull() & F.exists("inner", lambda o: entry_name(o).isNotNull())
        below = held.select("file_id", "path", "entry", "place", named.alias("named"), F.posexplode("inner").alias("at", "m"))
        level = materialize(
            below.select(
                "file_id", F.col("path").alias("prefix"), "named", F.when(F.col("named"), F.coalesce(entry_name(F.col("m")), F.lit(NAMELESS))).otherwise(F.col("entry")).alias("entry"),
                F.when(F.col("named"), "").otherwise(F.concat_ws(".", "place", F.lpad(F.col("at").cast("string"), 9, "0"))).alias("place"), "m",
            ), f"level-{depth}",
        )
        parts.append(level.where("named").select("file_id", F.lit("").alias("path"), "entry", F.lit("").alias("place"), none))
        if level.isEmpty():
            break
        depth += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_kind(values: DataFrame) -> DataFrame:
    return values.withColumn("kind", F.when(F.col("v").isNull(), "object").otherwise(_kind(F.col("v"), F.to_json("v"))))


def field_catalogue(manifests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, fields, values): the readable files, numbered by (committed_at, file_id) within each program; their
    fields (path, kind); and the values of the fields, as field_values gives them. See readable for what counts."""
    objects = readable(manifests)
    values = field_values(objects)
    files = materialize(numbered(objects.select("file_id", "program", "committed_at"), ["program"], ["committed_at", "file_id"]), "files")
    # an empty list fits any list
    kinds = F.array_sort("kinds")
    named = F.filter(kinds, lambda k: (k != "list") | ~F.exists("kinds", lambda x: x.startswith("list of")))
    per_file = with_kind(values).groupBy("file_id", "path").agg(F.collect_set("kind").alias("kinds")).select("file_id", "path", F.array_join(named, " or ").alias("kind"))
    return files, materialize(per_file.join(files.select("file_id", "program", "nth", "of"), "file_id"), "fields"), values


def _neighbours(fields: DataFrame) -> DataFrame:
    """fields with the file numbers and types before and after in which each path occurs.

    Files are taken in blocks that overlap by one file on either side, so no window group outgrows a block.
    """
    own = F.expr(f"nth div {BLOCK}")
    blocks = F.explode(F.array_distinct(F.array(own, F.expr(f"(nth + 1) div {BLOCK}"), F.expr(f"greatest(nth - 1, 0) div {BLOCK}"))))
    lean = fields.where("path <> ''").select("program", "path", "kind", "nth", "of", own.alias("own"), blocks.alias("block"))
    run = Window.partitionBy("program", "path", "block").orderBy("nth")
    beside = lean.withColumns({"nth_before": F.lag("nth").over(run), "kind_before": F.lag("kind").over(run), "nth_after": F.lead("nth").over(run)})
    return beside.where("own = block").drop("own", "block")


def _events(fields: DataFrame) -> DataFrame:
    """(program, nth, change, path): where in the files' order a field starts, ends or changes type."""
    seen = _neighbours(fields)
    follows = F.coalesce(F.col("nth_before") == F.col("nth") - 1, F.lit(False))
    starts = seen.where((F.col("nth") > 0) & ~follows).select("program", "nth", F.lit("added").alias("change"), "path")
    ends = seen.where((F.col("nth") < F.col("of") - 1) & ~F.coalesce(F.col("nth_after") == F.col("nth") + 1, F.lit(False))).select("program", (F.col("nth") + 1).alias("nth"), F.lit("removed").alias("change"), "path")
    compatible = (F.col("kind") == "list") & F.col("kind_before").startswith("list") | (F.col("kind_before") == "list") & F.col("kind").startswith("list")
    kinds = seen.where(follows & (F.col("kind") != F.col("kind_before")) & ~compatible).select("program", "nth", F.lit("type_changed").alias("change"), "path")
    return starts.unionByName(ends).unionByName(kinds)


def _parent(path: Column) -> Column:
    return F.when(path.contains("."), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise("")


#: Places at which fields are compared that are sent to every task; more are joined by shuffle.
BROADCAST_PLACES = 200_000


def _renames(events: DataFrame, files: DataFrame, values: DataFrame) -> DataFrame:
    """(program, nth, old_field, new_field): an end and a start in one place whose values agree in all entries held by
    both files, at least one of which has the field. Of several that agree, the first by name go together.

    Only the values of fields that end or start beside each other are digested.
    """
    moved = events.where("change <> 'type_changed'").withColumn("parent", _parent(F.col("path")))
    both = moved.groupBy("program", "nth", "parent").agg(F.count_distinct("change").alias("n")).where("n = 2").drop("n")
    at = F.when(F.col("change") == "added", F.col("nth")).otherwise(F.col("nth") - 1)
    ids = files.select("program", F.col("nth").alias("at"), "file_id")
    asked = materialize(moved.join(both, ["program", "nth", "parent"]).withColumn("at", at).join(ids, ["program", "at"]).drop("at"), "asked")
    sent = lambda df: F.broadcast(df) if df.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES else df
    told = values.join(sent(asked), ["file_id", "path"])
    digest = F.xxhash64("place", F.to_json("v"))
    keys = ["program", "nth", "parent", "change", "path", F.col("entry").alias("name")]
    hashed = told.select(*keys, digest.alias("digest")).groupBy("program", "nth", "parent", "change", "path", "name")
    asked_values = hashed.agg(F.xxhash64(F.bit_xor("digest"), F.count("*"), F.sum(F.col("digest").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("digest"))
    # the entries that both the file and the one before it hold
    wanted = both.select("program", "nth").distinct()
    sides = wanted.select("program", "nth", F.explode(F.array(F.col("nth"), F.col("nth") - 1)).alias("at")).join(ids, ["program", "at"])
    held = values.where("path = ''").select("file_id", F.col("entry").alias("name")).distinct().join(sent(sides), "file_id")
    common = held.groupBy("program", "nth", "name").agg(F.count_distinct("at").alias("n")).where("n = 2").select("program", "nth", "name")
    shared = asked_values.join(common, ["program", "nth", "name"], "left_semi")
    signed = shared.groupBy("program", "nth", "parent", "change", "path").agg(F.bit_xor(F.xxhash64("name", "digest")).alias("signature"), F.count("*").alias("entries"))
    turn = Window.partitionBy("program", "nth", "parent", "signature", "entries", "change").orderBy("path")
    ranked = signed.withColumn("turn", F.row_number().over(turn))
    side = lambda change, name: ranked.where(F.col("change") == change).select("program", "nth", "parent", "signature", "entries", "turn", F.col("path").alias(name))
    return side("removed", "old_field").join(side("added", "new_field"), ["program", "nth", "parent", "signature", "entries", "turn"]).select("program", "nth", "old_field", "new_field")


def _changes(files: DataFrame, fields: DataFrame, values: DataFrame) -> DataFrame:
    events = materialize(_events(fields), "events")
    renamed = materialize(_renames(events, files, values), "renames")
    gone = renamed.select("program", "nth", F.lit("removed").alias("change"), F.col("old_field").alias("path")).unionByName(
        renamed.select("program", "nth", F.lit("added").alias("change"), F.col("new_field").alias("path"))
    )
    left = events.join(gone, ["program", "nth", "change", "path"], "left_anti")
    rows = left.select(
        "program", "nth", F.col("change").alias("change_kind"),
        F.when(F.col("change") == "added", "").otherwise(F.col("path")).alias("old_field"), F.when(F.col("change") == "removed", "").otherwise(F.col("path")).alias("new_field"),
    ).unionByName(renamed.select("program", "nth", F.lit("renamed").alias("change_kind"), "old_field", "new_field"))
    reported = rows.select("program", "nth", F.explode(F.array("old_field", "new_field")).alias("above")).where("above <> ''").distinct()
    path = F.when(F.col("old_field") != "", F.col("old_field")).otherwise(F.col("new_field"))
    steps = F.split(path, r"\.")
    inner = rows.where(F.size(steps) > 1).withColumn("above", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda k: F.array_join(F.slice(steps, 1, k), "."))))
    below = inner.join(reported, ["program", "nth", "above"], "left_semi").select("program", "nth", "change_kind", "old_field", "new_field").distinct()
    kept = rows.join(below, ["program", "nth", "change_kind", "old_field", "new_field"], "left_anti")
    return kept.join(files.select("program", "nth", "file_id"), ["program", "nth"])


def changes(manifests: DataFrame) -> DataFrame:
    """(file_id, change_kind, old_field, new_field) against the file before; see field_catalogue for what counts.

    Fields below a reported field are not reported. Two fields without a value in any entry that both files hold
    are never taken for one. Empty tables give no rows.
    """
    return _changes(*field_catalogue(manifests)).select("file_id", "change_kind", "old_field", "new_field")


def lifespans(manifests: DataFrame) -> DataFrame:
    """(program, field, first_file, last_file, files): every run of successive files that have a field."""
    files, fields, _ = field_catalogue(manifests)
    seen = _neighbours(fields)
    begins = seen.where(F.col("nth_before").isNull() | (F.col("nth_before") < F.col("nth") - 1)).select("program", "path", "nth", F.lit(True).alias("begins"))
    ends = seen.where(F.col("nth_after").isNull() | (F.col("nth_after") > F.col("nth") + 1)).select("program", "path", "nth", F.lit(False).alias("begins"))
    run = Window.partitionBy("program", "path").orderBy("nth", F.desc("begins"))
    spans = begins.unionByName(ends).withColumn("last", F.lead("nth").over(run)).where("begins")
    ids = files.select("program", "nth", "file_id")
    return (
        spans.join(ids.withColumnRenamed("file_id", "first_file"), ["program", "nth"])
        .join(ids.select("program", F.col("nth").alias("last"), F.col("file_id").alias("last_file")), ["program", "last"])
        .select("program", F.col("path").alias("field"), "first_file", "last_file", (F.col("last") - F.col("nth") + 1).alias("files"))
    )


#: The columns of the one table with their types, and the forms besides renamings in which a body may hold an observation's parts.
COLUMNS = {"section": "string", "type": "string", "description": "string", "optional": "boolean", "unit": "string", "default_value": "string"}
PARTS = {"policy_phrase": ("policy_phrase",), "source_doc": ("source_doc",), "section": ("section", "section_text")}
_KNOWN = (*COLUMNS, *PARTS, "section_text", "version", "observations", "entries", "name", "values", "synonyms")


def alias_table(renamed: list[tuple[str, str]]) -> dict[str, str]:
    """{last name of a path: the name its column has}: names joined by renamings share the one that is a column, else the
    first by the alphabet."""
    leader: dict[str, str] = {}

    def find(x: str) -> str:
        while leader.setdefault(x, x) != x:
            x = leader[x]
        return x

    for old, new in sorted(renamed):
        a, b = find(old.rpartition(".")[2]), find(new.rpartition(".")[2])
        first, other = sorted((a, b), key=lambda n: (n not in _KNOWN, n))
        leader[other] = first
    return {x: find(x) for x in leader if find(x) != x}


def aliases(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(program, since, until, alias, column): for which files of a program a name stands for which column.

    A name that a renaming ends or begins stands for the column in the files on its side of it, up to the program's
    next or previous renaming of the same field. Programs without a renaming of the name have program null: there it
    stands for what it stands for elsewhere.
    """
    renames = changes.where("change_kind = 'renamed'").select("program", "nth", F.element_at(F.split("old_field", r"\."), -1).alias("old"), F.element_at(F.split("new_field", r"\."), -1).alias("new")).distinct()
    pairs = renames.select("old", "new").distinct().limit(MAX_ALIASES + 1).collect()
    if len(pairs) > MAX_ALIASES:
        raise ValueError(f"more than {MAX_ALIASES} renamings")
    table = alias_table([(p.old, p.new) for p in pairs])
    spark = files.sparkSession
    known = spark.createDataFrame(list(table.items()), "alias string, column string")
    # a name stands from the renaming that began it to the one that ended it
    sides = renames.select("program", F.col("new").alias("alias"), F.col("nth").alias("at"), F.lit(True).alias("begins")).unionByName(renames.select("program", F.col("old").alias("alias"), F.col("nth").alias("at"), F.lit(False).alias("begins"))).distinct()
    run = Window.partitionBy("program", "alias").orderBy("at", "begins")
    first, next_at, next_begins = F.row_number().over(run) == 1, F.lead("at").over(run), F.lead("begins").over(run)
    open_ended = F.lit(1 << 60)
    spans = sides.select("program", "alias", F.when(F.col("begins"), F.struct(F.col("at").alias("since"), F.when(~next_begins, next_at).otherwise(open_ended).alias("until"))).otherwise(F.when(first, F.struct(F.lit(0).cast("bigint").alias("since"), F.col("at").alias("until")))).alias("s")).where("s is not null")
    own = spans.join(F.broadcast(known), "alias").select("program", "s.since", "s.until", "alias", "column")
    everywhere = known.select(F.lit(None).cast("string").alias("program"), F.lit(0).cast("bigint").alias("since"), open_ended.cast("bigint").alias("until"), "alias", "column")
    return own.unionByName(everywhere)


def _named(held: Column, alias: Column) -> Column:
    """A MAP's filled fields as ARRAY<STRUCT<column, raw, v>>; a field of the column's own name comes before its aliases."""
    cells = F.transform(F.filter(F.map_entries(held), lambda e: _filled(e["value"])), lambda e: F.struct(F.coalesce(F.try_element_at(alias, e["key"]), e["key"]).alias("column"), e["key"].alias("raw"), e["value"].alias("v")))
    return F.concat(F.filter(cells, lambda c: c["column"] == c["raw"]), F.array_sort(F.filter(cells, lambda c: c["column"] != c["raw"]), lambda a, b: F.when(a["raw"] < b["raw"], -1).otherwise(1)))


def _pick(cells: Column, *columns: str) -> Column:
    """The first cell of the first of these columns that there is."""
    of = lambda name: F.get(F.filter(cells, lambda c: c["column"] == name), F.lit(0))
    return F.coalesce(*[of(n) for n in columns])


def _cast(value: Column, kind: str = "string") -> Column:
    """A value as a column of this type: an object of one field is what that field holds, other nesting is JSON text."""
    inner = F.map_values(_as(value, _OBJECT))
    bare = F.when(F.size(inner) == 1, F.get(inner, F.lit(0))).otherwise(value)
    text = F.when(F.is_variant_null(bare), F.lit(None).cast("string")).when(_plain_kind(F.to_json(bare)).isin("object", "list"), F.to_json(bare)).otherwise(_as(bare, "string"))
    if kind == "boolean":
        return F.when(F.lower(text).isin("true", "yes", "1"), True).when(F.lower(text).isin("false", "no", "0"), False)
    return text


def one_table(manifests: DataFrame) -> DataFrame:
    """Every entry of every readable file in one set of columns, in whatever form and under whatever name it is held.

    Names are translated by the program's own renamings where these hold (see aliases), else by those found in
    other programs, and cast to the column's type. What has no column, and what stands beside the column it would
    go to, is kept in other under its own name, as text. The three arrays go together: one element for each
    observation.
    """
    files, fields, values = field_catalogue(manifests)
    table = materialize(aliases(files, _changes(files, fields, values)), "aliases")
    entry = F.map_from_entries(F.collect_list(F.struct("alias", "column")))
    shared = table.where("program is null").agg(entry.alias("shared"))
    own = files.select("file_id", "program", "nth").join(F.broadcast(table.where("program is not null")), "program").where("nth >= since and nth < until")
    own = own.groupBy("file_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("alias", "column")))).alias("own"))
    objects = readable(manifests).join(own, "file_id", "left").crossJoin(F.broadcast(shared))
    none = F.create_map().cast("map<string,string>")
    mixed = F.map_concat(F.map_filter(F.coalesce("shared", none), lambda k, v: ~F.coalesce(F.map_contains_key("own", k), F.lit(False))), F.coalesce("own", none))
    # a generator's columns are worked out once, however often what follows mentions them
    once = lambda **c: F.inline(F.array(F.struct(*[v.alias(n) for n, v in c.items()])))
    known = objects.select("file_id", "program", "committed_at", "object", once(alias=mixed))
    top = known.select("file_id", "program", "committed_at", "alias", once(top=_named(F.col("object"), F.col("alias"))))
    lists = F.filter("top", lambda c: F.exists(F.transform(_as(c["v"], _LIST), lambda x: entry_name(_as(x, _OBJECT))), lambda n: n.isNotNull()))
    rows = top.select("file_id", "program", "committed_at", "alias", once(version=_cast(_pick(F.col("top"), "version")["v"]), entries=_objects(F.get(lists, F.lit(0))["v"])))
    flat = [n for part, names in PARTS.items() for n in names if n != "section"]
    entries = rows.select("file_id", "program", "committed_at", "version", "alias", F.explode(F.transform("entries", lambda m: _named(m, F.col("alias")))).alias("e"))
    told = F.array_compact(F.array(*[_pick(F.col("e"), n) for n in flat]))
    seen = F.transform(_objects(_pick(F.col("e"), "observations")["v"]), lambda o: _named(o, F.col("alias")))
    taken = F.array_compact(F.array(*[_pick(F.col("e"), c)["raw"] for c in (*COLUMNS, "name", "observations", *flat)]))
    cells = entries.select("file_id", "program", "committed_at", "version", "e", once(seen=F.concat(F.filter(F.array(told), lambda x: F.size(x) > 0), seen), taken=taken))
    other = F.filter("e", lambda c: ~F.array_contains("taken", c["raw"]))
    part = lambda p: F.transform("seen", lambda o: _cast(_pick(o, *PARTS[p])["v"]))
    return cells.select(
        "file_id", "program", "committed_at", "version", _cast(_pick(F.col("e"), "name")["v"]).alias("name"),
        *[_cast(_pick(F.col("e"), c)["v"], kind).alias(c) for c, kind in COLUMNS.items()],
        part("policy_phrase").alias("policy_phrases"), part("source_doc").alias("source_docs"), part("section").alias("sections"),
        F.map_from_entries(F.transform(other, lambda c: F.struct(c["raw"], _cast(c["v"])))).alias("other"),
    )
