"""Queries over Markdown and documents as files: quality, tables, HTML, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import markdown_quality as Q
from caseloom.operators import markup as X
from caseloom.plans.registry import query
from caseloom.session import read_table

#: The lines of a result in SQL, numbered.
LINES = r"""
with raw as (select result_id, string_split(regexp_replace(coalesce(markdown, ''), '\r\n|[\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), chr(10)) as l from parse_result),
d as (select result_id, case when l[-1] = '' then l[:-2] else l end as l from raw),
n as (select result_id, generate_subscripts(l, 1) as i, unnest(l) as line from d),
h as (select d.result_id, coalesce(sum(case when regexp_matches(line, '^#{1,3} ') then 1 else 0 end), 0)::int as headings, coalesce(sum(case when regexp_matches(line, '\S') then 1 else 0 end), 0)::int as filled
  from d left join n on n.result_id = d.result_id group by d.result_id)
"""


def _hits(pattern: str, least: int) -> str:
    return LINES + f"select d.result_id, coalesce((select count(*) from n where n.result_id = d.result_id and regexp_matches(line, '{pattern}')), 0) >= {least} as hit from d"


SQL = {
    "no_headings": LINES + "select result_id, headings = 0 as hit from h",
    "low_heading_density": LINES + "select result_id, filled >= 30 and headings > 0 and headings * 50 < filled as hit from h",
    "repeated_page_headers": LINES + r"select d.result_id, exists (select 1 from n where n.result_id = d.result_id and not regexp_matches(line, '^#{1,3} ') and length(trim(line)) between 5 and 99 group by trim(line) having count(*) >= 3) as hit from d",
    "repeated_page_numbers": _hits(r"^\s*[Pp]age\s+\d+(\.\d+)?\s*$", 3),
    "bold_as_headings": LINES + r"select h.result_id, headings = 0 and exists (select 1 from n where n.result_id = h.result_id and regexp_matches(line, '^\s*\*\*[^*\n]+\*\*\s*$')) as hit from h",
    "html_entity_remnants": _hits(Q.ENTITY, 1),
    "navigation_pollution": LINES + r"select d.result_id, coalesce((select count(*) from n where n.result_id = d.result_id and regexp_matches(trim(line), '^\w[\w\s,().''-]*(?:\s*>\s*\w[\w\s,().''-]*){2,}\s*$')), 0) >= 2 as hit from d",
    "navigation_list_pollution": LINES + r""", g as (select *, regexp_matches(line, '^\s*-\s') as item, i - row_number() over (partition by result_id, regexp_matches(line, '^\s*-\s') order by i) as island from n),
      b as (select result_id from g where item group by result_id, island having count(*) >= 8 and (2 * count(*) filter (regexp_matches(line, 'https?://\S+|www\.\S+')) >= count(*) or 10 * count(*) filter (length(trim(line)) < 40) >= 7 * count(*)))
      select result_id, result_id in (select result_id from b) as hit from d""",
    "unindented_nested_lists": LINES + r""", x as (select *, regexp_matches(line, '^\s*-\s') as item, length(regexp_extract(line, '^(\s*)-\s', 1)) as indent from n where regexp_matches(line, '\S')),
      g as (select *, sum(case when item then 0 else 1 end) over (partition by result_id order by i) as block from x),
      p as (select *, lag(indent) over (partition by result_id, block order by i) as before, max(case when indent = 0 then 1 else 0 end) over (partition by result_id, block order by i rows between unbounded preceding and 1 preceding) as rooted from g where item)
      select result_id, result_id in (select result_id from p where indent = 0 and before > 0 and coalesce(rooted, 0) = 0) as hit from d""",
    "repeated_boilerplate": LINES + ", t as (select result_id, array_to_string(l, chr(10)) as t from d) select result_id, greatest(" + ", ".join(f"len(regexp_extract_all(t, '{p}'))" for p in Q.BOILERPLATE) + ") >= 2 as hit from t",
}
for _i, _fault in enumerate(("no_headings", "low_heading_density", "repeated_page_headers", "repeated_page_numbers", "bold_as_headings", "unindented_nested_lists", "html_entity_remnants", "navigation_pollution", "repeated_boilerplate", "navigation_list_pollution"), 1):
    query(f"q_{_i:02d}", SQL[_fault])(lambda spark, d, f=_fault: Q.rate(read_table(spark, d, "parse_result")).select("result_id", F.col(f).alias("hit")))

_RATED = "with " + ", ".join(f"{f} as ({s})" for f, s in SQL.items()) + ", s as (select r.result_id, greatest(100 - (" + " + ".join(f"case when {f}.hit then {p} else 0 end" for f, p in Q.PENALTIES.items()) + "), 0)::int as score, list_filter([" + ", ".join(f"case when {f}.hit then '{f}' end" for f in Q.PENALTIES) + "], lambda x: x is not null) as flags from parse_result r " + " ".join(f"join {f} on {f}.result_id = r.result_id" for f in SQL) + ") "


@query("q_11", _RATED + "select result_id, score, array_to_string(flags, ',') as flags from s")
def q_11(spark: SparkSession, d: str) -> DataFrame:
    """Score and faults of each result."""
    return Q.rate(read_table(spark, d, "parse_result")).select("result_id", "score", F.array_join("flags", ",").alias("flags"))


@query("q_12", _RATED + "select score < 40 as rejected, count(*) as results from s group by 1")
def q_12(spark: SparkSession, d: str) -> DataFrame:
    """How many results a score rejects."""
    return Q.rate(read_table(spark, d, "parse_result")).groupBy("rejected").agg(F.count("*").alias("results"))


@query("x_01", r"""select doc_id, case when ext in ('md', 'markdown') then 'markdown' when ext in ('htm', 'html') then 'html' when ext in ('csv', 'json', 'docx', 'pdf', 'xlsx', 'txt') then ext else 'unknown' end as format
  from (select doc_id, lower(regexp_extract(coalesce(path, ''), '\.([A-Za-z0-9]+)$', 1)) as ext from documents)""")
def x_01(spark: SparkSession, d: str) -> DataFrame:
    """Formats by extension."""
    ext = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ext.isin("md", "markdown"), "markdown").when(ext.isin("htm", "html"), "html").when(ext.isin("csv", "json", "docx", "pdf", "xlsx", "txt"), ext).otherwise("unknown")
    return read_table(spark, d, "documents").select("doc_id", kind.alias("format"))


@query("x_02", """select result_id, sha256(coalesce(markdown, '')) as sha, sha256(coalesce(markdown, '')) in (select source_sha256 from conversion_diagnostics where source_sha256 is not null) as cached from parse_result""")
def x_02(spark: SparkSession, d: str) -> DataFrame:
    """Content hashes, and whether a conversion of that content is on record."""
    rows = read_table(spark, d, "parse_result").select("result_id", F.sha2(F.coalesce("markdown", F.lit("")), 256).alias("sha"))
    known = read_table(spark, d, "conversion_diagnostics").select(F.col("source_sha256").alias("sha")).where("sha is not null").distinct().withColumn("known", F.lit(True))
    return rows.join(known, "sha", "left").select("result_id", "sha", F.coalesce("known", F.lit(False)).alias("cached"))


@query("x_03", "select doc_id, greatest(1, length(text) // 4)::bigint as tokens from documents where text is not null")
def x_03(spark: SparkSession, d: str) -> DataFrame:
    """Token estimates."""
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("x_04", "select diag_id, count(*) as n, bool_and(page_count <= 30 and estimated_input_tokens <= 50000) as may_clean from conversion_diagnostics group by diag_id")
def x_04(spark: SparkSession, d: str) -> DataFrame:
    """Conversions that may be cleaned without asking."""
    rows = read_table(spark, d, "conversion_diagnostics")
    return rows.groupBy("diag_id").agg(F.count("*").alias("n"), F.min(X.may_clean(F.col("page_count"), F.col("estimated_input_tokens"))).alias("may_clean"))


#: A field is free of quotes or wholly enclosed in them; a record is fields and commas up to a break.
_FIELD = r'"(?:[^"]|"")*"|[^",\r\n]*'


@query("x_05", rf"""with t as (select result_id, regexp_replace(markdown, '^\x{{FEFF}}', '') as t from parse_result where regexp_matches(markdown, '^[^,\s#][^,\n]*(,[^,\n]+)+\n')),
r as (select result_id, regexp_extract_all(t || chr(10), '((?:{_FIELD})(?:,(?:{_FIELD}))*)(?:\r\n|\r|\n)', 1) as r from t where regexp_full_match(t, '(?:{_FIELD})((?:,|\r\n|\r|\n)(?:{_FIELD}))*')),
c as (select result_id, list_filter(list_transform(r, lambda x: list_transform(regexp_extract_all(x || ',', '({_FIELD}),', 1), lambda f: trim(case when f like '"%' then replace(f[2:-2], '""', '"') else f end))), lambda x: len(list_filter(x, lambda f: f <> '')) > 0) as c from r),
k as (select result_id, list_transform(c, lambda r: list_transform(r, lambda f: replace(replace(replace(f, '|', '\|'), chr(13), ''), chr(10), ' '))) as k from c),
w as (select result_id, k, len(k[1]) as n from k)
select q.result_id, '| ' || array_to_string(k[1], ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(k[1], lambda h: repeat('-', greatest(3, length(h))::int)), ' | ') || ' |'
  || array_to_string(list_transform(k[2:], lambda r: chr(10) || '| ' || array_to_string(list_transform(range(n), lambda i: coalesce(r[i + 1], '')), ' | ') || ' |'), '') as markdown,
  len(list_distinct(list_transform(k, lambda r: len(r)))) > 1 as ragged
from (select distinct result_id from t) q left join w on w.result_id = q.result_id""")
def x_05(spark: SparkSession, d: str) -> DataFrame:
    """Comma-separated results as pipe tables."""
    rows = read_table(spark, d, "parse_result").where(r"markdown rlike '^[^,\\s#][^,\n]*(,[^,\n]+)+\n'")
    return X.csv_tables(rows.select("result_id", F.col("markdown").alias("text")))


@query("x_08", r"""select module, '| ' || string_agg(column_name, ' | ' order by pos) || ' |' || chr(10) || '| ' || string_agg(repeat('-', greatest(3, length(column_name))::int), ' | ' order by pos) || ' |' || chr(10) || '| ' || string_agg(leaf_type, ' | ' order by pos) || ' |' as markdown
  from field_spec group by module""")
def x_08(spark: SparkSession, d: str) -> DataFrame:
    """Each module's columns as a pipe table."""
    rows = read_table(spark, d, "field_spec").groupBy("module").agg(F.array_sort(F.collect_list(F.struct("pos", "column_name", "leaf_type"))).alias("f"))
    return rows.select("module", X.table(F.transform("f", lambda x: x["column_name"]), F.array(F.transform("f", lambda x: x["leaf_type"]))).alias("markdown"))


@query("x_11", "select distinct diag_id, source, format_detected, page_count is not null and page_count > 0 as paged from conversion_diagnostics where diag_id is not null")
def x_11(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics through JSON without null fields, and back."""
    rows = read_table(spark, d, "conversion_diagnostics").where("diag_id is not null")
    text = F.to_json(F.struct("diag_id", "source", "format_detected", "page_count"))
    back = rows.select(F.from_json(text, "diag_id bigint, source string, format_detected string, page_count int").alias("r"))
    return back.select("r.diag_id", "r.source", "r.format_detected", F.coalesce(F.col("r.page_count") > 0, F.lit(False)).alias("paged")).distinct()


@query("x_12", r"""select doc_id, coalesce(nullif(regexp_replace(regexp_replace(path, '[^A-Za-z0-9._-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'document') as name from documents where path is not null""")
def x_12(spark: SparkSession, d: str) -> DataFrame:
    """Paths as safe file names."""
    return read_table(spark, d, "documents").where("path is not null").select("doc_id", X.safe_name(F.col("path")).alias("name"))


def _tidied(source: str) -> str:
    """SQL that tidies m of source (doc_id, m)."""
    return rf"""a as (select doc_id, string_split(regexp_replace(m, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g'), chr(10)) as l from {source}),
b as (select doc_id, list_transform(l, lambda x, i: case when i < len(l) then regexp_replace(x, ' $', '') else x end) as l from a),
c as (select doc_id, list_filter(l, lambda x, i: x <> '' or not ((i > 3 and l[i - 1] = '' and l[i - 2] = '') or (i > 2 and i < len(l) and regexp_matches(l[i - 1], '{X.ITEM}') and regexp_matches(l[i + 1], '{X.ITEM}')))) as l from b)
select doc_id, regexp_replace(array_to_string(l, chr(10)), '^\s+|\s+$', '', 'g') || chr(10) as markdown from c"""


def _in_sql(column: str, steps: tuple) -> str:
    for pattern, new in steps:
        said = new.replace("$", chr(92)).replace("'", "''").replace("\n", "' || chr(10) || '")
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{said}', 'g')"
    return column


@query("h_01", f"select doc_id, md5({_in_sql('text', X.STRIP)}) as digest from documents where regexp_matches(text, '{X.TAGGED}')")
def h_01(spark: SparkSession, d: str) -> DataFrame:
    """Texts with tags without what holds no content."""
    return read_table(spark, d, "documents").where(F.col("text").rlike(X.TAGGED)).select("doc_id", F.md5(X.without_chrome(F.col("text"))).alias("digest"))


@query("h_06", f"with s as (select doc_id, {_in_sql('text', (*X.STRIP, *X.MARK))} as m from documents where regexp_matches(text, '{X.TAGGED}')), " + _tidied("s"))
def h_06(spark: SparkSession, d: str) -> DataFrame:
    """Texts that hold tags as Markdown."""
    return X.html_to_markdown(read_table(spark, d, "documents").where(F.col("text").rlike(X.TAGGED)).select("doc_id", "text")).select("doc_id", "markdown")


@query("h_07", "with s as (select doc_id, text as m from documents where text is not null), " + _tidied("s"))
def h_07(spark: SparkSession, d: str) -> DataFrame:
    """Texts tidied."""
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", X.tidy(F.col("text")).alias("markdown"))


@query("h_08", r"""select doc_id, nullif(trim(coalesce(nullif(trim(regexp_extract(text, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), nullif(trim(regexp_extract(text, '(?is)<h[12][^>]*>(.*?)</h[12]>', 1)), ''), regexp_extract(text, '(?m)^#{1,2} +([^\n\r\x{85}\x{2028}\x{2029}]+)$', 1))), '') as title from documents where text is not null""")
def h_08(spark: SparkSession, d: str) -> DataFrame:
    """Titles."""
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", X.title(F.col("text")).alias("title"))


@query("k_21", r"""with n as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
  s as (select *, length(regexp_extract(line, '^(#{1,3}) +\S', 1)) as level, sum(case when regexp_matches(line, '^#{1,3} +\S') then 1 else 0 end) over (partition by doc_id order by i) as section from n),
  g as (select doc_id, section, max(level) as level, coalesce(max(case when level > 0 then 1 else 0 end), 0) as headed, md5(coalesce(string_agg(line, chr(10) order by i) filter (level = 0), '')) as own, string_agg(line, chr(10) order by i) as whole, string_agg(line, chr(10) order by i) filter (level = 0) as own_text from s group by all),
  e as (select a.doc_id, a.section, a.level, a.own, a.own_text, (select min(b.section) from g b where b.doc_id = a.doc_id and b.section > a.section and b.level <= a.level) as stop from g a)
  select e.doc_id, e.section::bigint as section, e.level::int as level, e.own as own_digest, md5(coalesce(e.own_text, '') || coalesce((select string_agg(chr(10) || g.whole, '' order by g.section) from g where e.level > 0 and g.doc_id = e.doc_id and g.section > e.section and g.section < coalesce(e.stop, 1073741824)), '')) as body_digest from e""")
def k_21(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every document, as digests of what stands in them."""
    return X.sections(read_table(spark, d, "documents"), "doc_id", "text").select("doc_id", "section", "level", F.md5("own_body").alias("own_digest"), F.md5("body").alias("body_digest"))
