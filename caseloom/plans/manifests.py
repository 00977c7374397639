"""Queries over inventories: entries of manifests checked, located, merged, flattened and turned into columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import cases as T
from caseloom.operators import catalog as C
from caseloom.operators import decisions as R
from caseloom.operators import freshness as H
from caseloom.operators import graphs as G
from caseloom.operators import inventory as I
from caseloom.operators import schema_drift as D
from caseloom.operators import structural_csv as S
from caseloom.operators.ranking import numbered
from caseloom.plans.cases import DEFS, LINES
from caseloom.plans.registry import query
from caseloom.session import materialize, read_table

#: Entries in SQL; txt(x) stands for a field that is text.
ENTRIES = """with files as (select distinct file_id, program, committed_at, try_cast(body as json) as b from naming_manifest),
listed as (select file_id, program, committed_at, json_extract(b, '$.entries[*]') as l from files where json_type(b) = 'OBJECT' and json_type(b->'entries') = 'ARRAY'),
entries as (select file_id, program, committed_at, i - 1 as pos, l[i] as e from (select *, unnest(range(1, len(l) + 1)) as i from listed) where json_type(l[i]) = 'OBJECT'),
named as (select file_id, program, committed_at, pos, e, case when json_type(e->'name') = 'VARCHAR' then e->>'name' end as name, case when json_type(e->'section') = 'VARCHAR' then e->>'section' end as section, case when json_type(e->'type') = 'VARCHAR' then e->>'type' end as type,
  case when json_type(e->'description') = 'VARCHAR' then e->>'description' end as description, case when json_type(e->'unit') = 'VARCHAR' then e->>'unit' end as unit from entries) """
RANK = "case regexp_extract(section, '^[a-z]+') when 'inputs' then 1 when 'computed' then 2 when 'outputs' then 3 else 0 end"


def _entries(spark: SparkSession, d: str) -> DataFrame:
    rows = I.entries(read_table(spark, d, "naming_manifest"))
    return rows.select("file_id", "program", "committed_at", "pos", "e", *[I.text_of(I.field(F.col("e"), n)).alias(n) for n in ("name", "section", "type", "description", "unit")])


_SET = lambda f: f"(json_type(e->'{f}') is not null and json_type(e->'{f}') <> 'NULL')"


@query("m_01", ENTRIES + f"""select file_id, pos, split_part(f, ':', 1) as field, split_part(f, ':', 2) as problem from (select *, case when coalesce(name, '') = '' then 'name:missing' when not regexp_matches(name, '^[a-z][a-z0-9_]*$') then 'name:not snake case'
  when coalesce(section, '') = '' then 'section:missing' when not regexp_matches(section, '^(inputs\\.[A-Z][A-Za-z0-9]*|computed|outputs)$') then 'section:unknown' when {_SET('observations')} and json_type(e->'observations') <> 'ARRAY' then 'observations:no list'
  when {_SET('description')} and coalesce(description, '') = '' then 'description:no text' when {_SET('type')} and coalesce(type, '') not in {I.TYPES} then 'type:unknown' when {_SET('values')} and json_type(e->'values') <> 'ARRAY' then 'values:no list'
  when {_SET('optional')} and json_type(e->'optional') <> 'BOOLEAN' then 'optional:no boolean' end as f from named) where f is not null""")
def m_01(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that each entry breaks."""
    return _entries(spark, d).select("file_id", "pos", I.first_fault(F.col("e")).alias("f")).where("f is not null").select("file_id", "pos", "f.field", "f.problem")


@query("m_04", ENTRIES + "select program, name, arg_min(description, (committed_at, file_id, pos)) filter (description is not null) as description, count(*) as mentions from named where name is not null and committed_at is not null group by all")
def m_04(spark: SparkSession, d: str) -> DataFrame:
    """The description that each name of a program had first."""
    rows = _entries(spark, d).where("name is not null and committed_at is not null")
    return I.merged(rows, ["program", "name"], ["description"], ["committed_at", "file_id", "pos"])


@query("m_14", ENTRIES + f"select file_id, name, arg_min(section, ({RANK}, section)) as section, count(distinct section) as places from named where name is not null and section is not null group by all")
def m_14(spark: SparkSession, d: str) -> DataFrame:
    """Where each name stands first in a file."""
    return I.located(_entries(spark, d).where("name is not null and section is not null"))


@query("m_15", ENTRIES + "select program, name, " + ", ".join(f"arg_min({c}, (committed_at, file_id, pos)) filter ({c} is not null) as {c}" for c in ("section", "type", "description", "unit")) + ", count(*) as mentions from named where name is not null and committed_at is not null group by all")
def m_15(spark: SparkSession, d: str) -> DataFrame:
    """Each entry put together over all files of its program."""
    rows = _entries(spark, d).where("name is not null and committed_at is not null")
    return I.merged(rows, ["program", "name"], ["section", "type", "description", "unit"], ["committed_at", "file_id", "pos"])


@query("m_17", """select distinct file_id, case when coalesce(trim(body), '') = '' then 'empty' when coalesce(json_type(try_cast(body as json)), '') <> 'OBJECT' then 'unreadable'
  when coalesce(try_cast(try_cast(body as json)->>'version' as double) = 3.0, false) then 'loaded' else 'rejected' end as state from naming_manifest where file_id is not null""")
def m_17(spark: SparkSession, d: str) -> DataFrame:
    """Which files are read, and why others are not."""
    return read_table(spark, d, "naming_manifest").where("file_id is not null").select("file_id", I.load_state(F.col("body")).alias("state")).distinct()


@query("v_05", r"""select distinct file_id, unnest(regexp_extract_all(body, '"source_doc"\s*:\s*"((?:[^"\\]|\\.)*)"', 1)) as source_doc from naming_manifest where body is not null""")
def v_05(spark: SparkSession, d: str) -> DataFrame:
    """The documents that a file refers to, at any depth."""
    return read_table(spark, d, "naming_manifest").where("body is not null").select("file_id", F.explode(I.harvest(F.col("body"), "source_doc")).alias("source_doc")).distinct()


@query("v_07", ENTRIES + ", k as (select file_id, pos, e, unnest(json_keys(e)) as k from entries) select file_id, pos, count(*) filter (json_type(json_extract(e, '$.\"' || k || '\"')) <> 'NULL') as filled, count(*) as fields from k group by all")
def v_07(spark: SparkSession, d: str) -> DataFrame:
    """How many fields of each entry are left without those that are null."""
    kept = F.map_filter("e", lambda k, v: ~F.is_variant_null(v))
    return _entries(spark, d).select("file_id", "pos", F.size(kept).cast("bigint").alias("filled"), F.size("e").cast("bigint").alias("fields")).where("fields > 0").distinct()


@query("v_09", """with m as (select module, min(pos) as first, bool_or(is_decision) as main from field_spec group by module), f as (select distinct module from import_line)
select m.module, row_number() over (order by main, first, m.module) as place, case when f.module is not null then 'reference' else 'generate' end as action from m left join f on f.module = m.module""")
def v_09(spark: SparkSession, d: str) -> DataFrame:
    """Modules in the order of work, those with decisions last; what has lines already is referred to."""
    modules = read_table(spark, d, "field_spec").groupBy("module").agg(F.min("pos").alias("first"), F.bool_or("is_decision").alias("main")).withColumn("all", F.lit(1))
    there = read_table(spark, d, "import_line").select("module").distinct().withColumn("there", F.lit(True))
    placed = numbered(modules, ["all"], ["main", "first", "module"], "place")
    return placed.join(there, "module", "left").select("module", (F.col("place") + 1).alias("place"), F.when(F.col("there"), "reference").otherwise("generate").alias("action"))


@query("v_11", ENTRIES + r"select distinct file_id, regexp_extract(section, '^[a-z]+') as role, lower(nullif(regexp_extract(section, '^inputs\.(.*)$', 1), '')) as entity, name from named where name is not null and regexp_matches(section, '^(inputs\.[A-Z][A-Za-z0-9]*|computed|outputs)$')")
def v_11(spark: SparkSession, d: str) -> DataFrame:
    """The names of each file by role and entity."""
    rows = _entries(spark, d).select("file_id", C.section_of(F.col("section")).alias("s"), "name").where("s is not null and name is not null")
    return rows.select("file_id", F.col("s.section").alias("role"), F.lower("s.entity").alias("entity"), "name").distinct()


@query("v_12", ENTRIES + """, s as (select file_id, name, unnest(case json_type(e->'synonyms') when 'ARRAY' then list_transform(json_extract(e, '$.synonyms[*]'), lambda x: case json_type(x) when 'VARCHAR' then x->>'$' when 'OBJECT' then x->>'name' end) when 'OBJECT' then json_keys(e->'synonyms') end) as synonym from named)
select distinct file_id, name, synonym from s where synonym is not null and name is not null""")
def v_12(spark: SparkSession, d: str) -> DataFrame:
    """Synonyms, in whatever form they are listed."""
    rows = _entries(spark, d).where("name is not null")
    return rows.select("file_id", "name", F.explode(I.names_listed(I.field(F.col("e"), "synonyms"))).alias("synonym")).distinct()


_STAGE = "nullif(regexp_replace(lower(trim(name)), '(_test|_check|_evaluation)$', ''), '')"


@query("g_05", ENTRIES + f""", c as (select {_STAGE} as name, description, committed_at, file_id, pos from named where name is not null and committed_at is not null), m as (select make_timestamp(epoch_us(min(committed_at)) + (epoch_us(max(committed_at)) - epoch_us(min(committed_at))) // 2) as middle from c),
g as (select name, arg_min(description, (committed_at, file_id, pos)) filter (description is not null and committed_at < middle) as old, arg_min(description, (committed_at, file_id, pos)) filter (description is not null and committed_at >= middle) as new, bool_or(committed_at < middle) as is_old from c, m where name is not null group by name)
select name, coalesce(old, new) as description, case when is_old then 'existing' else 'new' end as origin from g""")
def g_05(spark: SparkSession, d: str) -> DataFrame:
    """Stages of earlier files with those of later ones; what is described stays so."""
    rows = materialize(_entries(spark, d).where("name is not null and committed_at is not null").select(C.stage(F.col("name")).alias("name"), "description", "committed_at", "file_id", "pos"), "stages")
    earlier, later = C.by_time(rows, "committed_at")
    of = lambda part: I.merged(part.where("name is not null"), ["name"], ["description"], ["committed_at", "file_id", "pos"])
    return I.merged_groups(of(earlier), of(later))


_LEAFS = "case when json_array_length(e->'values') > 0 and json_type(e->'values') = 'ARRAY' then 'enum' else coalesce(map " + "{" + ", ".join(f"'{k}': '{v}'" for k, v in ({v: v for v in T.LEAF.values()} | T.LEAF).items() if k not in T.LEAF.values() or T.LEAF.get(k, k) == k) + "}[type], 'string') end"


@query("c_01", ENTRIES + rf""", i as (select file_id, pos, name, section = 'outputs' as decision, nullif(regexp_extract(section, '^inputs\.(.*)$', 1), '') as entity, {_LEAFS} as leaf_type from named where name is not null and section is not null),
k as (select *, min(pos) over (partition by file_id, entity) as first from i where entity is not null or decision), n as (select file_id, count(distinct entity) as entities from k group by file_id)
select file_id, row_number() over (partition by file_id order by decision, case when not decision then first end, pos)::int as pos,
  case when decision then 'expected_' || name when not (name in {I.RESERVED} or name like 'expected\_%' escape '\') and entities <= 1 then name else entity || '.' || name end as column_name, leaf_type, decision as is_decision from k join n using (file_id)""")
def c_01(spark: SparkSession, d: str) -> DataFrame:
    """The columns that each manifest's cases have."""
    rows = _entries(spark, d).where("name is not null and section is not null")
    return I.column_specs(rows.withColumn("values", F.try_variant_get(I.field(F.col("e"), "values"), "$", "array<variant>")))


@query("c_10", LINES + """, l as (select distinct line_id, column_name, v from checked where leaf_type = 'list' and v <> '' and line_id in (select line_id from good))
select line_id, column_name, list_filter(list_transform(string_split(v, ';'), lambda x: trim(x)), lambda x: x <> '') as parts, to_json(list_transform(list_filter(list_transform(string_split(v, ';'), lambda x: trim(x)), lambda x: x <> ''), lambda x: {'code': x}))::varchar as items from l""".replace("list_filter(list_transform(string_split(v, ';'), lambda x: trim(x)), lambda x: x <> '') as parts, ", ""))
def c_10(spark: SparkSession, d: str) -> DataFrame:
    """List cells as the lists of objects they stand for."""
    cells = S.load_cases(read_table(spark, d, "import_line"), read_table(spark, d, "field_spec")).select("line_id", F.explode("cells").alias("c")).where("c.leaf_type = 'list' and c.value.items is not null")
    return cells.select("line_id", "c.column_name", F.to_json(F.transform("c.value.items", lambda x: F.struct(x.alias("code")))).alias("items"))


@query("c_20", "select module, column_name, scenario from field_spec, (values ('zero'), ('negative'), ('just_below'), ('exact'), ('just_above'), ('very_large'), ('missing')) s(scenario) where leaf_type in ('money', 'int', 'float')")
def c_20(spark: SparkSession, d: str) -> DataFrame:
    """Each numeric column at its edges."""
    return T.scenarios(read_table(spark, d, "field_spec").where("leaf_type in ('money', 'int', 'float')"), T.EDGES).select("module", "column_name", "scenario")


@query("c_24", """with f as (select distinct file_id, body from naming_manifest where json_type(try_cast(body as json)) = 'OBJECT' and file_id is not null and program is not null and committed_at is not null),
t as (select file_id, t.fullkey, t.type from f, json_tree(f.body) t)
select file_id, regexp_replace(regexp_replace(regexp_replace(fullkey, '^\\$\\.', ''), '\\[[0-9]+\\]', '', 'g'), '"', '', 'g') as key, count(*) as cells from t where type not in ('OBJECT', 'ARRAY', 'NULL') and fullkey not like '%]' group by all""".replace("\\\\", "\\"))
def c_24(spark: SparkSession, d: str) -> DataFrame:
    """Nested bodies as cells under dotted keys: how many each key has."""
    found = D.with_kind(D.field_values(D.readable(read_table(spark, d, "naming_manifest"))).where("path <> ''")).where("kind in ('string', 'number', 'boolean')")
    return found.groupBy("file_id", F.col("path").alias("key")).agg(F.count("*").alias("cells"))


@query("c_27", "select module, count(distinct import_file) as files, count(distinct import_file) filter (import_file like '%.csv') as tables from import_line group by module")
def c_27(spark: SparkSession, d: str) -> DataFrame:
    """The files of cases of each module."""
    name = F.col("import_file")
    return read_table(spark, d, "import_line").groupBy("module").agg(F.count_distinct(name).alias("files"), F.count_distinct(F.when(name.endswith(".csv"), name)).alias("tables"))


@query("c_28", LINES + "select line_id, to_json({'case_id': case_id, 'short_description': short_description, 'module': module})::varchar as body from good")
def c_28(spark: SparkSession, d: str) -> DataFrame:
    """Cases as JSON, fields in fixed order."""
    return S.load_cases(read_table(spark, d, "import_line"), read_table(spark, d, "field_spec")).select("line_id", F.to_json(F.struct("case_id", "short_description", "module")).alias("body"))


@query("c_29", LINES + "select (select count(*) from good) as loaded, (select count(distinct line_id) from faults) as refused, (select count(*) from faults) as failures")
def c_29(spark: SparkSession, d: str) -> DataFrame:
    """What an import came to."""
    lines, spec = read_table(spark, d, "import_line"), read_table(spark, d, "field_spec")
    bad = S.failures(lines, spec).agg(F.count_distinct("line_id").alias("refused"), F.count("*").alias("failures"))
    return S.load_cases(lines, spec).agg(F.count("*").alias("loaded")).crossJoin(bad)


@query("f_07", r"""with s as (select path, sha1(('blob ' || strlen(body))::blob || '\x00'::blob || encode(body)) as sha, row_number() over (partition by path order by committed_at desc, file_id desc, sha1(('blob ' || strlen(body))::blob || '\x00'::blob || encode(body))) as n from naming_manifest where path is not null and body is not null and committed_at is not null)
select path, sha, row_number() over (order by path) as place from s where n = 1""")
def f_07(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each path, in order of paths, as a manifest records it."""
    rows = read_table(spark, d, "naming_manifest").where("path is not null and body is not null and committed_at is not null").withColumn("sha", H.blob_sha(F.col("body")))
    last = rows.groupBy("path").agg(F.min_by("sha", F.struct(-F.unix_micros("committed_at"), -F.col("file_id"), F.col("sha"))).alias("sha"))
    placed = numbered(last.withColumn("all", F.lit(1)), ["all"], ["path"], "place")
    return placed.select("path", "sha", (F.col("place") + 1).alias("place"))


@query("f_17", r"select path, bool_or(json_type(try_cast(body as json)) = 'OBJECT') as readable, regexp_matches(path, '\.json$') as allowed from naming_manifest where path is not null and body is not null group by path")
def f_17(spark: SparkSession, d: str) -> DataFrame:
    """Which manifests may be used, and which can be read in some state."""
    rows = read_table(spark, d, "naming_manifest").where("path is not null and body is not null")
    return rows.groupBy("path").agg(F.bool_or(D.parsed(F.col("body")).isNotNull()).alias("readable")).select("path", "readable", F.col("path").rlike(r"\.json$").alias("allowed"))


@query("k_11", DEFS + """, t as (select src as name, 1 as rank from u join defs using (doc_id) where false union all select unnest(list_distinct(list_filter(regexp_split_to_array(body, '[^A-Za-z0-9_]+'), lambda x: regexp_full_match(x, '[a-z_][a-z0-9_]*') and x not in (""" + ", ".join(f"'{k}'" for k in G.KEYWORDS) + """)))), 1 from defs where contains(body, 'under condition')
  union all select entry_name, 2 from observations where entry_section = 'outputs' and entry_name is not null union all select column_name, 3 from field_spec)
select name, case min(rank) when 1 then 'condition' when 2 then 'output' else 'existing' end as reason from t group by name""")
def k_11(spark: SparkSession, d: str) -> DataFrame:
    """Names to put out, each with the first reason for it."""
    defs = G.definitions(read_table(spark, d, "documents").where("text is not null"))
    asked = defs.where(F.contains("body", F.lit("under condition"))).select(F.explode(G.names_in(F.col("body"))).alias("name"))
    given = read_table(spark, d, "observations").where("entry_section = 'outputs' and entry_name is not null").select(F.col("entry_name").alias("name"))
    return G.tagged([("condition", asked), ("output", given), ("existing", read_table(spark, d, "field_spec").select(F.col("column_name").alias("name")))])


@query("k_16", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity > 10 and (l_returnflag = 'R' or (l_linestatus = 'O' and l_discount > 0.05))")
def k_16(spark: SparkSession, d: str) -> DataFrame:
    """Lines on which a nested condition holds."""
    held = R.condition([F.col("l_quantity") > 10, {"any_of": [F.col("l_returnflag") == "R", {"all_of": [F.col("l_linestatus") == "O", F.col("l_discount") > 0.05]}]}])
    return read_table(spark, d, "lineitem").where(held).select("l_orderkey", "l_linenumber", "l_quantity")


@query("k_18", r"""with n as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from documents where contains(text, '```')),
h as (select *, last_value(case when regexp_matches(line, '^#{1,6} +\S') then regexp_extract(line, '^#{1,6} +(.*?)\s*$', 1) end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as heading,
  sum(case when regexp_matches(line, '^```') then 1 else 0 end) over (partition by doc_id order by i) as fences, coalesce(lead(line) over (partition by doc_id order by i), '') as first from n)
select doc_id, i::int as line_no, heading, first, 3 as score from h where regexp_matches(line, '^```') and fences % 2 = 1""")
def k_18(spark: SparkSession, d: str) -> DataFrame:
    """Blocks to be reviewed: heading above, first line, and the middle score where none is given."""
    lines = read_table(spark, d, "documents").where(F.contains("text", F.lit("```"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return G.review_items(lines, "doc_id")


@query("k_27", "select distinct column_name as name from field_spec where column_name not in (select entry_name from observations where entry_name is not null and entry_section = 'computed')")
def k_27(spark: SparkSession, d: str) -> DataFrame:
    """Names to be added to a block; those that it has are left alone."""
    there = read_table(spark, d, "observations").where("entry_section = 'computed'").select(F.col("entry_name").alias("name"))
    return C.unresolved(read_table(spark, d, "field_spec").select(F.col("column_name").alias("name")).distinct(), there.where("name is not null"))


@query("h_09", "select doc_id, md5('Source: ' || path || chr(10) || chr(10) || text) as digest from documents where text is not null and path is not null")
def h_09(spark: SparkSession, d: str) -> DataFrame:
    """Documents under a line that names their source."""
    from caseloom.operators.markup import with_source

    return read_table(spark, d, "documents").where("text is not null and path is not null").select("doc_id", F.md5(with_source(F.col("path"), F.col("text"))).alias("digest"))


@query("x_07", ENTRIES + """, k as (select file_id, e, array_to_string(list_sort(json_keys(e)), chr(31)) as keys from entries), n as (select distinct file_id, pos from (select file_id, pos, json_type(json_extract(e, '$."' || k || '"')) as t from (select *, unnest(json_keys(e)) as k from entries)) where t in ('OBJECT', 'ARRAY'))
select file_id, case when count(distinct keys) = 1 and file_id not in (select file_id from n where file_id is not null) then 'table' else 'fenced' end as form from k group by file_id""")
def x_07(spark: SparkSession, d: str) -> DataFrame:
    """Whether each manifest's entries make a table."""
    return I.json_form(_entries(spark, d).where("size(e) > 0"))


@query("x_14", r"select result_id, coalesce(nullif(regexp_replace(regexp_replace(source, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'document') as name, md5(coalesce(markdown, '')) as markdown_digest, to_json({'result_id': result_id, 'page_count': page_count})::varchar as diagnostics from parse_result where page_count is not null and source is not null")
def x_14(spark: SparkSession, d: str) -> DataFrame:
    """What is laid down for each result: its name, its text and its diagnostics."""
    from caseloom.operators.markup import safe_name

    rows = read_table(spark, d, "parse_result").where("page_count is not null and source is not null")
    return rows.select("result_id", safe_name(F.col("source")).alias("name"), F.md5(F.coalesce("markdown", F.lit(""))).alias("markdown_digest"), F.to_json(F.struct("result_id", "page_count")).alias("diagnostics"))


@query("h_02")
def h_02(spark: SparkSession, d: str) -> DataFrame:
    """Texts with tags, links made absolute."""
    from caseloom.operators.markup import TAGGED, absolute_links

    rows = read_table(spark, d, "documents").where(F.col("text").rlike(TAGGED))
    return rows.select("doc_id", F.md5(absolute_links(F.col("text"), F.concat(F.lit("http://host/"), F.coalesce("path", F.lit(""))))).alias("digest"))


@query("h_05", r"select doc_id, md5(coalesce(" + ", ".join(rf"nullif(trim(regexp_extract(text, '(?is)<{t}\b[^>]*>(.*?)</{t}\s*>', 1)), '')" for t in ("main", "article", "body")) + ", text)) as digest from documents where text is not null")
def h_05(spark: SparkSession, d: str) -> DataFrame:
    """The main content of texts."""
    from caseloom.operators.markup import main_content

    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(main_content(F.col("text"))).alias("digest"))


@query("v_10", "select domain, case when count(distinct program) = 1 then min(program) end as program, case when count(distinct program) = 1 then 'single' else 'ambiguous' end as how from naming_manifest where domain is not null and program is not null group by domain")
def v_10(spark: SparkSession, d: str) -> DataFrame:
    """Which program of each domain is meant when none is named."""
    return I.chosen_program(read_table(spark, d, "naming_manifest").where("domain is not null and program is not null"))


@query("e_13", "select l_orderkey, l_linenumber, l_quantity, '1:MANY=' || (l_quantity > 40)::varchar || ' 2:RETURNED=' || (l_returnflag = 'R')::varchar as trace from lineitem")
def e_13(spark: SparkSession, d: str) -> DataFrame:
    """What each rule came to, step by step."""
    steps = R.trace({"MANY": F.col("l_quantity") > 40, "RETURNED": F.col("l_returnflag") == "R"})
    said = F.array_join(F.transform(steps, lambda s: F.concat(s["step"].cast("string"), F.lit(":"), s["code"], F.lit("="), s["held"].cast("string"))), " ")
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", said.alias("trace"))


@query("k_15", ENTRIES.replace("with files", DEFS.strip() + ", files") + r""", m as (select file_id, regexp_replace(name, '_[0-9]+$', '') as name, count(distinct lower(regexp_extract(section, '^inputs\.(.*)$', 1))) as n from named where name is not null and regexp_matches(section, '^inputs\.[A-Z][A-Za-z0-9]*$') group by 1, 2 having count(distinct lower(regexp_extract(section, '^inputs\.(.*)$', 1))) >= 2)
select 'mirrored' as hint, name as key, count(*) as n from m group by name union all select 'gate', key, count(*) from (select regexp_replace(regexp_extract(body, 'under condition (.*\S)', 1), '\$?[0-9][0-9,.]*', '#', 'g') as key from defs) where key <> '' group by key having count(*) >= 3""")
def k_15(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for parting or joining modules."""
    rows = _entries(spark, d).select("file_id", F.lower(C.section_of(F.col("section"))["entity"]).alias("entity"), "name").where("name is not null")
    return G.module_hints(rows, G.definitions(read_table(spark, d, "documents").where("text is not null")))


@query("c_26", """with w as (select distinct entry_name as word from observations where entry_name is not null), t as (select doc_id, text, regexp_matches(text, '§ ?[0-9]|[Ss]ection [0-9]+\\.[0-9]') as cites from documents where text is not null)
select distinct doc_id, 'citation' as why from t where cites union all select distinct doc_id, 'vocabulary' from (select doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_]+')) as word from t where not cites) where word in (select word from w)""".replace("\\\\", "\\"))
def c_26(spark: SparkSession, d: str) -> DataFrame:
    """Texts that bear on the entries, and why."""
    words = read_table(spark, d, "observations").where("entry_name is not null").select(F.col("entry_name").alias("word")).distinct()
    return G.relevant(read_table(spark, d, "documents").where("text is not null"), words)
