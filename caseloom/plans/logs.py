"""Queries over session logs, file freshness and the catalogue of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import catalog as C
from caseloom.operators import freshness as H
from caseloom.operators import telemetry as E
from caseloom.operators.observations import FIELDS, unpacked
from caseloom.operators.ranking import numbered
from caseloom.plans.registry import query
from caseloom.session import read_table

# ---------------------------------------------------------------- session logs

EV = """with ev as (select *, lower(trim(session_id)) as sid, ts as at from session_event where session_id is not null and ts is not null) """
WIN = "partition by sid order by ts, log, line_no"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "session_event")


@query("e_02", r"""select log, line_no, coalesce(nullif(regexp_extract(coalesce(prompt, ''), '(?:^|\s|/)domains/([A-Za-z0-9_-]+)', 1), ''), nullif(regexp_extract(coalesce(prompt, ''), '^/[a-z-]+\s+([A-Za-z0-9_-]+)', 1), ''),
  nullif(regexp_extract(coalesce(prompt, ''), '^([A-Za-z0-9_-]+)/(?:input|specs|logs|tests)/', 1), ''), '.shared') as inferred from session_event where type = 'user_prompt'""")
def e_02(spark: SparkSession, d: str) -> DataFrame:
    """The domain that each prompt names."""
    return _events(spark, d).where("type = 'user_prompt'").select("log", "line_no", E.infer_domain(F.coalesce("prompt", F.lit(""))).alias("inferred"))


@query("e_03", EV + "select sid as session_id, count(*) as events, epoch_us(min(ts)) as first_us, epoch_us(max(ts)) as last_us from ev group by sid")
def e_03(spark: SparkSession, d: str) -> DataFrame:
    """Sessions read from all logs together."""
    return E.ordered(_events(spark, d)).groupBy("session_id").agg(F.count("*").alias("events"), F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"))


@query("e_04", "select log, line_no, case when to_ts >= from_ts then floor((epoch_us(to_ts) - epoch_us(from_ts)) / 1000000)::bigint end as seconds from session_event where from_ts is not null")
def e_04(spark: SparkSession, d: str) -> DataFrame:
    """Stated spans in seconds."""
    return _events(spark, d).where("from_ts is not null").select("log", "line_no", E.seconds_between(F.col("from_ts"), F.col("to_ts")).alias("seconds"))


@query("e_05", EV + f"""select log, line_no, sid as session_id, case when ts >= since then floor((epoch_us(ts) - epoch_us(since)) / 1000000)::bigint end as seconds from (
  select *, last_value(case when type in ('user_prompt', 'assistant_response', 'ai_question') then ts end ignore nulls) over ({WIN} rows between unbounded preceding and 1 preceding) as since from ev) where type = 'assistant_response'""")
def e_05(spark: SparkSession, d: str) -> DataFrame:
    return E.turn_durations(_events(spark, d))


@query("e_06", EV + f""", a as (select *, sum(case when type = 'user_prompt' and prompt like '/%' then 1 else 0 end) over ({WIN}) as island,
    case when type = 'ai_question' then floor((epoch_us(ts) - epoch_us(lag(ts) over ({WIN}))) / 1000000)::bigint else 0 end as wait
  from ev where type in ('user_prompt', 'assistant_response', 'ai_question'))
select sid as session_id, regexp_extract(arg_min(prompt, (ts, log, line_no)), '^/(\\S*)', 1) as skill, epoch_us(min(ts)) as started_us, (floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) - sum(wait))::bigint as active, sum(wait)::bigint as waited,
  (count(*) filter (type = 'assistant_response') + 1)::bigint as turns from a where island > 0 group by sid, island""".replace("\\\\S", r"\S"))
def e_06(spark: SparkSession, d: str) -> DataFrame:
    rows = E.skill_durations(_events(spark, d))
    return rows.select("session_id", "skill", F.unix_micros("started").alias("started_us"), "active", "waited", "turns")


@query("e_07", "select log, line_no, case when type = 'cli_command' then cmd when type in ('file_written', 'file_edited') then path end as subject, coalesce(bytes, strlen(diff))::bigint as size_bytes from session_event where type in ('cli_command', 'file_written', 'file_edited')")
def e_07(spark: SparkSession, d: str) -> DataFrame:
    """What tools did: commands run, files written, with the bytes they moved."""
    rows = _events(spark, d).where(F.col("type").isin("cli_command", "file_written", "file_edited"))
    subject = F.when(F.col("type") == "cli_command", F.col("cmd")).otherwise(F.col("path"))
    return rows.select("log", "line_no", subject.alias("subject"), F.coalesce("bytes", F.octet_length("diff").cast("bigint")).alias("size_bytes"))


@query("e_08", EV + f""", own as (select distinct sid from ev where domain = 'harrowgate-transit'), k as (select * from ev where domain in ('harrowgate-transit', '.shared') and sid in (select sid from own))
select sid as session_id, epoch_us(min(ts) over (partition by sid)) as first_us, row_number() over ({WIN}) as n, type, log, line_no from k""")
def e_08(spark: SparkSession, d: str) -> DataFrame:
    """One domain's sessions with what the shared log has of them."""
    rows = E.report(_events(spark, d), F.coalesce(F.col("domain") == "harrowgate-transit", F.lit(False)))
    return rows.select("session_id", F.unix_micros("first_seen").alias("first_us"), "n", "type", "log", "line_no")


@query("e_09", EV + f""", t as (select *, sum(case when type = 'user_prompt' then 1 else 0 end) over ({WIN}) as turn from ev)
select sid as session_id, turn::bigint as turn, epoch_us(min(ts)) as started_us, count(*) as events, arg_max(response, (ts, log, line_no)) filter (type = 'assistant_response') as response from t where turn > 0 group by sid, turn""")
def e_09(spark: SparkSession, d: str) -> DataFrame:
    return E.turns(_events(spark, d)).select("session_id", "turn", F.unix_micros("started").alias("started_us"), "events", "response")


@query("e_10", EV + f""", t as (select *, sum(case when type = 'user_prompt' and prompt like '/%' then 1 else 0 end) over ({WIN}) as island from ev)
select log, line_no from (select log, line_no, row_number() over (partition by sid, island order by ts desc, log desc, line_no desc) as n from t where type = 'skill_duration') where n = 1""")
def e_10(spark: SparkSession, d: str) -> DataFrame:
    return E.last_of_skill(_events(spark, d))


@query("e_11", "select log, line_no, case when duration_seconds < 60 then duration_seconds || 's' else (duration_seconds // 60) || 'm ' || (duration_seconds % 60) || 's' end as shown from session_event where duration_seconds is not null")
def e_11(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).where("duration_seconds is not null").select("log", "line_no", E.show_seconds(F.col("duration_seconds")).alias("shown"))


@query("e_12", EV + f"select sid as session_id, row_number() over ({WIN}) as n, row_number() over ({WIN}) || '. ' || coalesce(prompt, '') as line from ev where type = 'user_prompt'")
def e_12(spark: SparkSession, d: str) -> DataFrame:
    """Each session's prompts as the lines of a numbered list."""
    return E.prompt_list(_events(spark, d))


# ------------------------------------------------------------------- freshness

#: A manifest's file is one path at many times: the index has its last state in the first half of all time, the
#: listing its last state in the second half; derived is what some state with observations was made from.
_SHA = r"sha1(('blob ' || strlen(body))::blob || '\x00'::blob || encode(body))"
LISTED = f"""with m as (select make_timestamp(epoch_us(min(committed_at)) + (epoch_us(max(committed_at)) - epoch_us(min(committed_at))) // 2) as middle from naming_manifest where path is not null and body is not null),
w as (select path, {_SHA} as sha, (strlen(body) % 100)::int as score, committed_at >= middle as later, committed_at, file_id from naming_manifest, m where path is not null and body is not null and committed_at is not null),
v as (select *, row_number() over (partition by path, later order by committed_at desc, file_id desc, sha) as n from w),
l as (select path, sha from v where n = 1 and later), x as (select path, sha, score from v where n = 1 and not later),
e as (select distinct path from naming_manifest where path is not null and contains(body, 'policy_phrase')) """


def _listing(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = read_table(spark, d, "naming_manifest").where("path is not null and body is not null")
    states = rows.where("committed_at is not null").withColumns({"sha": H.blob_sha(F.col("body")), "score": (F.octet_length("body") % 100).cast("int")})
    of = lambda half: half.groupBy("path").agg(F.min_by(F.struct("sha", "score"), F.struct(-F.unix_micros("committed_at"), -F.col("file_id"), F.col("sha"))).alias("s")).select("path", "s.*")
    earlier, later = C.by_time(states.select("path", "sha", "score", "committed_at", "file_id"), "committed_at")
    return of(later).select("path", "sha"), of(earlier), rows.where(F.contains("body", F.lit("policy_phrase"))).select("path").distinct()


#: The same of conversions: each source's latest one is the listing, the first one on record the index.
CONVERTED = """with l as (select source as path, source_sha256 as sha from (select *, row_number() over (partition by source order by converted_at desc nulls last, diag_id desc) as n from conversion_diagnostics where source is not null) where n = 1),
x as (select source as path, source_sha256 as sha from (select *, row_number() over (partition by source order by converted_at nulls first, diag_id, coalesce(page_count, 0)) as n from conversion_diagnostics where source is not null) where n = 1) """


def _conversions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read_table(spark, d, "conversion_diagnostics").where("source is not null").select(F.col("source").alias("path"), F.col("source_sha256").alias("sha"), "converted_at", "diag_id", F.coalesce("page_count", F.lit(0)).alias("p"))
    now = rows.groupBy("path").agg(F.max_by("sha", F.struct("converted_at", "diag_id")).alias("sha"))
    return now, rows.groupBy("path").agg(F.min_by("sha", F.struct("converted_at", "diag_id", "p")).alias("sha"))


@query("f_01", r"""select doc_id, sha1(('blob ' || strlen(text))::blob || '\x00'::blob || encode(text)) as sha from documents where text is not null""")
def f_01(spark: SparkSession, d: str) -> DataFrame:
    """The hash under which git files each text."""
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", H.blob_sha(F.col("text")).alias("sha"))


@query("f_02", LISTED + """, k as (select * from x where score >= 40), r as (select path from x where score < 40)
select 'facets' as tier, category, path from (
 select coalesce(l.path, k.path) as path, case when l.path is null then 'source_removed' when k.path is null then 'source_added' when l.sha <> k.sha then 'source_edited' end as category from l full join k on l.path = k.path
) where category is not null and path not in (select path from r)
union all select 'facets', 'derived_missing', path from k where path in (select path from l) and path not in (select path from e)
union all select 'facets', 'orphan_derived', path from e where path not in (select path from l)""")
def f_02(spark: SparkSession, d: str) -> DataFrame:
    """Drift between the latest conversions, the first ones on record, and the results."""
    return H.facets_drift(*_listing(spark, d))


@query("f_03", LISTED + "select 'guidance' as tier, 'guidance_stale' as category, x.path from x left join l on l.path = x.path where l.sha is null or l.sha <> x.sha")
def f_03(spark: SparkSession, d: str) -> DataFrame:
    now, index, _ = _listing(spark, d)
    return H.recorded_drift("guidance", index, now)


@query("f_04", LISTED + f""", r as (select path, sha from (select path, {_SHA} as sha, row_number() over (partition by path order by file_id, {_SHA}) as n from naming_manifest where path is not null and body is not null) where n = 1)
select 'rules' as tier, 'rules_stale' as category, r.path from r left join l on l.path = r.path where l.sha is null or l.sha <> r.sha""")
def f_04(spark: SparkSession, d: str) -> DataFrame:
    """Of several records of a path, the first by place counts."""
    rows = read_table(spark, d, "naming_manifest").where("path is not null and body is not null").withColumn("sha", H.blob_sha(F.col("body")))
    return H.recorded_drift("rules", rows.select("path", "sha", F.struct("file_id", "sha").alias("pos")), _listing(spark, d)[0])


@query("f_05", LISTED + ", s as (select count(*) as n from x left join l on l.path = x.path where l.sha is null or l.sha <> x.sha) select tier, rank::int as rank, case when tier = 'guidance' then n else 0 end::bigint as drifted from s, (values ('facets', 0), ('guidance', 1), ('rules', 2), ('tests', 3)) t(tier, rank)")
def f_05(spark: SparkSession, d: str) -> DataFrame:
    """Drift by tier, empty tiers too."""
    return H.tier_summary(f_03(spark, d))


@query("f_08", CONVERTED + "select coalesce(l.path, x.path) as path, case when l.path is null then 'delete' when not regexp_matches(l.path, '\\.md$') then 'skipped' when l.sha = x.sha then 'noop' else 'work' end as action from l full join x on l.path = x.path".replace("\\\\", "\\"))
def f_08(spark: SparkSession, d: str) -> DataFrame:
    now, index = _conversions(spark, d)
    return H.plan(now, index)


@query("f_09", "with t as (select path, min(sha1(coalesce(text, ''))) as sha, min(doc_id) as id from documents where path is not null group by path) select path, case when not regexp_matches(path, '\\.md$') then 'skipped' when id % 2 = 0 and id % 3 = 0 then 'noop' else 'work' end as action from t".replace("\\\\", "\\"))
def f_09(spark: SparkSession, d: str) -> DataFrame:
    """As f_08, what was not written being work again; here every second path changed and every third was written."""
    rows = read_table(spark, d, "documents").where("path is not null").groupBy("path").agg(F.min(F.sha1(F.coalesce("text", F.lit("")))).alias("sha"), F.min("doc_id").alias("id"))
    recorded = rows.select("path", F.when(F.col("id") % 2 == 0, F.col("sha")).otherwise("other").alias("sha"))
    return H.plan(rows.select("path", "sha"), recorded, rows.where("id % 3 = 0").select("path"))


@query("f_10", CONVERTED + """, p as (select coalesce(l.path, x.path) as path, case when l.path is null then 'delete' when not regexp_matches(l.path, '\\.md$') then 'skipped' when l.sha = x.sha then 'noop' else 'work' end as action from l full join x on l.path = x.path),
m as (select source as path, arg_max(case when cleanup_applied then 'succeeded' when cleanup_applied is null then 'in_progress' else 'failed' end, diag_id) as status from conversion_diagnostics where source is not null group by source)
select p.path, case when action = 'delete' then 'pruned' when action = 'work' then case status when 'succeeded' then 'recorded' when 'failed' then 'failed' else 'aborted' end else 'kept' end as outcome from p left join m on m.path = p.path""".replace("\\\\", "\\"))
def f_10(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of a plan by its markers; the conversions' cleanup stands for the work."""
    now, index = _conversions(spark, d)
    rows = read_table(spark, d, "conversion_diagnostics").where("source is not null")
    status = F.when(F.col("cleanup_applied"), "succeeded").when(F.col("cleanup_applied").isNull(), "in_progress").otherwise("failed")
    return H.finalize(H.plan(now, index), rows.select(F.col("source").alias("src"), status.alias("status"), F.col("diag_id").alias("at")))


@query("f_12", LISTED + "select count(*) > 0 as changed from x join l on l.path = x.path where l.sha <> x.sha")
def f_12(spark: SparkSession, d: str) -> DataFrame:
    """Whether any recorded source has changed."""
    now, index, _ = _listing(spark, d)
    return index.join(now.withColumnRenamed("sha", "now"), "path").where("now <> sha").limit(1).agg((F.count("*") > 0).alias("changed"))


@query("f_13", LISTED + "select x.path, l.sha from x join l on l.path = x.path")
def f_13(spark: SparkSession, d: str) -> DataFrame:
    """Records with today's hashes, without what is gone."""
    now, index, _ = _listing(spark, d)
    return index.select("path").join(now, "path")


# -------------------------------------------------------------------- catalogue

def _observations(spark: SparkSession, d: str) -> DataFrame:
    return unpacked(read_table(spark, d, "observations"))


KEYS = ["domain", "entry_section", "entry_name"]
ENTRY = "entry_section is not null and entry_name is not null"

#: The observations in SQL, payload unpacked where the columns are null.
TOLD = """with told as (select obs_id, domain, entry_section, entry_name, observed_at, case when inside then p->>'policy_phrase' else policy_phrase end as policy_phrase,
  case when inside then p->>'source_doc' else source_doc end as source_doc, case when inside then p->>'section' else section end as section
  from (select *, try_cast(payload as json) as p, coalesce(policy_phrase, source_doc, section) is null and payload is not null as inside from observations)) """
MIDDLE = "(select make_timestamp(epoch_us(min(observed_at)) + (epoch_us(max(observed_at)) - epoch_us(min(observed_at))) // 2) from told where entry_section is not null and entry_name is not null)"


@query("m_02", r"""select obs_id, regexp_extract(entry_section, '^[a-z]+') as section, nullif(regexp_extract(entry_section, '^inputs\.(.*)$', 1), '') as entity from observations where regexp_matches(entry_section, '^(inputs\.[A-Z][A-Za-z0-9]*|computed|outputs)$')""")
def m_02(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "observations").select("obs_id", C.section_of(F.col("entry_section")).alias("s")).where("s is not null")
    return rows.select("obs_id", "s.section", "s.entity")


@query("m_05", TOLD + f", o as (select domain, entry_section, entry_name, min(obs_id) as seen from told where {ENTRY} group by domain, entry_section, entry_name, policy_phrase, source_doc, section) select *, row_number() over (partition by domain, entry_section, entry_name order by seen) as place from o")
def m_05(spark: SparkSession, d: str) -> DataFrame:
    """Each entry's observations, each once and in the order they were made (nulls compare as equal)."""
    first = _observations(spark, d).where(ENTRY).groupBy(*KEYS, *FIELDS).agg(F.min("obs_id").alias("seen"))
    return numbered(first.select(*KEYS, "seen"), KEYS, ["seen"], "place").select(*KEYS, "seen", (F.col("place") + 1).alias("place"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entries of the observations made before and after the middle of all their time; those without a time come first."""
    earlier, later = C.by_time(_observations(spark, d).where(ENTRY), "observed_at")
    of = lambda rows: rows.groupBy(*KEYS).agg(F.min_by("policy_phrase", "obs_id").alias("phrase"))
    return of(earlier), of(later)


SIDES = TOLD + f""", o as (select *, coalesce(observed_at >= {MIDDLE}, false) as later from told where {ENTRY}),
s as (select domain, entry_section, entry_name, bool_or(not later) as a, bool_or(later) as b from o group by all) """


@query("m_03", SIDES + """, p as (select domain, entry_section, entry_name, arg_min_null(policy_phrase, obs_id) filter (not later) as pa, arg_min_null(policy_phrase, obs_id) filter (later) as pb from o group by all),
t as (select domain, entry_section, entry_name, count(*)::int as observations from (select distinct domain, entry_section, entry_name, policy_phrase, source_doc, section from told) group by all)
select s.domain, s.entry_section, s.entry_name, coalesce(pa, pb) as phrase, observations, case when a and b then 'merged' when a then 'kept' else 'added' end as action
from s join p on s.domain is not distinct from p.domain and s.entry_section = p.entry_section and s.entry_name = p.entry_name join t on s.domain is not distinct from t.domain and s.entry_section = t.entry_section and s.entry_name = t.entry_name""")
def m_03(spark: SparkSession, d: str) -> DataFrame:
    """Entries of earlier observations merged with those of later ones."""
    merged = C.merge(*_halves(spark, d), KEYS, ["phrase"], []).alias("m")
    # both sides hold all rows; what either says counts once
    told = _observations(spark, d).where(ENTRY).select(*KEYS, *FIELDS).distinct().groupBy(*KEYS).agg(F.count("*").cast("int").alias("observations")).alias("t")
    same = reduce(Column.__and__, [F.col(f"m.{k}").eqNullSafe(F.col(f"t.{k}")) for k in KEYS])
    return merged.join(told, same).select(*[f"m.{k}" for k in KEYS], "phrase", "observations", "action")


@query("m_07", SIDES + "select domain, entry_section, entry_name from s where not b")
def m_07(spark: SparkSession, d: str) -> DataFrame:
    """Entries no longer mentioned."""
    merged = C.merge(*_halves(spark, d), ["domain", "entry_section", "entry_name"], [], [], keep_unmentioned=False)
    return merged.where("action = 'dropped'").select("domain", "entry_section", "entry_name")


@query("m_08", r"""select domain, entry_name, regexp_extract(entry_section, '^[a-z]+') as section, row_number() over (partition by domain order by case regexp_extract(entry_section, '^[a-z]+') when 'inputs' then 1 when 'computed' then 2 when 'outputs' then 3 else 0 end, entry_section, entry_name) as place
  from (select distinct domain, entry_section, entry_name from observations where entry_section is not null and entry_name is not null)""")
def m_08(spark: SparkSession, d: str) -> DataFrame:
    """Entries in their usual order within a domain."""
    section = F.regexp_extract("entry_section", "^[a-z]+", 0)
    rows = read_table(spark, d, "observations").where(ENTRY).select("domain", "entry_section", "entry_name").distinct()
    placed = numbered(rows.withColumn("rank", C.section_rank(section)), ["domain"], ["rank", "entry_section", "entry_name"], "place")
    return placed.select("domain", "entry_name", section.alias("section"), (F.col("place") + 1).alias("place"))


@query("m_09", SIDES + "select case when a and b then 'merged' when a then 'kept' else 'added' end as action, count(*) as entries from s group by 1")
def m_09(spark: SparkSession, d: str) -> DataFrame:
    return C.merge(*_halves(spark, d), ["domain", "entry_section", "entry_name"], [], []).groupBy("action").agg(F.count("*").alias("entries"))


PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(policy_phrase)), '^(the|an|a)\s+', ''), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))"


@query("m_12", TOLD + f"select obs_id, {PLAIN} as plain from told where policy_phrase is not null")
def m_12(spark: SparkSession, d: str) -> DataFrame:
    return _observations(spark, d).where("policy_phrase is not null").select("obs_id", C.plain_phrase(F.col("policy_phrase")).alias("plain"))


@query("m_13", TOLD + f""", p as (select obs_id, entry_name, coalesce(entry_section, '') as entity, source_doc, {PLAIN} as plain from told where policy_phrase is not null),
b as (select plain, source_doc, min((entity, entry_name)) as e from p where plain <> '' group by all), a as (select plain, min((entity, entry_name)) as e from p where plain <> '' group by all)
select p.obs_id as phrase_id, coalesce(b.e, a.e)[2] as name from p left join b on b.plain = p.plain and b.source_doc = p.source_doc left join a on a.plain = p.plain where p.plain <> ''""")
def m_13(spark: SparkSession, d: str) -> DataFrame:
    """Each phrase with the entry it stands for."""
    rows = _observations(spark, d).where("policy_phrase is not null")
    phrases = rows.select(F.col("obs_id").alias("phrase_id"), F.col("policy_phrase").alias("phrase"), "source_doc")
    return C.look_up(phrases, rows.select(F.col("policy_phrase").alias("phrase"), "source_doc", F.col("entry_section").alias("entity"), F.col("entry_name").alias("name")))


@query("v_01", "select module, column_name as name from field_spec where column_name not in (select entry_name from observations where entry_name is not null)")
def v_01(spark: SparkSession, d: str) -> DataFrame:
    """Columns that no entry is named after."""
    refs = read_table(spark, d, "field_spec").select("module", F.col("column_name").alias("name"))
    return C.unresolved(refs, read_table(spark, d, "observations").select(F.col("entry_name").alias("name")).where("name is not null")).select("module", "name")


@query("v_02", """with p as (select a.module as left_module, b.module as right_module, column_name, a.pos as lp, b.pos as rp, a.description as ld, b.description as rd, a.enum_values::varchar as le, b.enum_values::varchar as re, a.optional::varchar as lo, b.optional::varchar as ro from field_spec a join field_spec b using (column_name) where a.module < b.module)
select left_module, right_module, column_name, 'pos' as field, lp::varchar as "left", rp::varchar as "right" from p where lp <> rp union all select left_module, right_module, column_name, 'description', ld, rd from p where ld <> rd
union all select left_module, right_module, column_name, 'optional', lo, ro from p where lo <> ro""")
def v_02(spark: SparkSession, d: str) -> DataFrame:
    """Where two modules describe one column differently."""
    spec = read_table(spark, d, "field_spec").select("module", "column_name", "pos", "description", "optional")
    return C.disagreements(spec, spec, "column_name", ["pos", "description", "optional"], "module")


@query("v_03", TOLD + "select obs_id, case when policy_phrase is null then 'no_phrase' else 'unpaired' end as fault from told where policy_phrase is null or (source_doc is null) <> (section is null)")
def v_03(spark: SparkSession, d: str) -> DataFrame:
    """Observations that lack what provenance needs."""
    fault = F.when(F.col("policy_phrase").isNull(), "no_phrase").when(F.col("source_doc").isNull() != F.col("section").isNull(), "unpaired")
    return _observations(spark, d).select("obs_id", fault.alias("fault")).where("fault is not null")


@query("v_04", """with n as (select distinct e->>'name' as name from (select unnest(json_extract(try_cast(body as json), '$.entries[*]')) as e from naming_manifest) where json_type(e) = 'OBJECT')
select name from n where name is not null and name not in (select entry_name from observations where entry_name is not null)""")
def v_04(spark: SparkSession, d: str) -> DataFrame:
    """Entries of manifests that no observation is of."""
    entries = F.from_json("body", "entries array<struct<name: string>>")["entries"]
    names = read_table(spark, d, "naming_manifest").select(F.explode(F.transform(entries, lambda e: e["name"])).alias("name")).where("name is not null").distinct()
    return C.unresolved(names, read_table(spark, d, "observations").select(F.col("entry_name").alias("name")).where("name is not null"))


@query("g_01", r"""select distinct entry_name, nullif(regexp_replace(lower(trim(entry_name)), '(_test|_check|_evaluation)$', ''), '') as stage from observations where entry_name is not null""")
def g_01(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "observations").where("entry_name is not null").select("entry_name", C.stage(F.col("entry_name")).alias("stage")).distinct()


@query("g_02", "select entry_name, min(obs_id) as place from observations where entry_name is not null group by 1")
def g_02(spark: SparkSession, d: str) -> DataFrame:
    return C.first_seen(read_table(spark, d, "observations"), "entry_name", "obs_id")


@query("g_03", "select module, pos, (select string_agg(upper(w[1]) || lower(w[2:]), ' ') from (select unnest(string_split(column_name, '_')) as w)) as label from field_spec")
def g_03(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "field_spec").select("module", "pos", C.humanize(F.col("column_name")).alias("label"))


@query("g_04", r"""select module, pos, regexp_replace(regexp_replace(regexp_replace(lower(trim(description)), '^(determine|assess|compute|evaluate|calculate)\s+', ''), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as name from field_spec where description is not null""")
def g_04(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "field_spec").where("description is not null").select("module", "pos", C.snake(F.col("description")).alias("name"))


@query("e_15", EV + """select sid as session_id, epoch_us(time_bucket(interval 10 minutes, ts)) as window_us, sum((type = 'user_prompt')::int)::bigint as prompts, sum((type = 'assistant_response')::int)::bigint as responses, sum((type = 'ai_question')::int)::bigint as questions
  from ev where type in ('user_prompt', 'assistant_response', 'ai_question') group by all""")
def e_15(spark: SparkSession, d: str) -> DataFrame:
    """Activity by session and ten minutes; the same expression runs on a stream."""
    from caseloom.streaming.activity import activity

    return activity(_events(spark, d)).select("session_id", F.unix_micros("window_start").alias("window_us"), "prompts", "responses", "questions")


_WALK = "coalesce(source_doc, '~') collate C, coalesce(section, '~') collate C, coalesce(policy_phrase, '~') collate C"


@query("m_11", TOLD + f""", o as (select distinct entry_name, policy_phrase, source_doc, section from told where entry_name is not null), r as (select *, (row_number() over (partition by entry_name order by {_WALK}) - 1) // {C.WALK} as block from o)
select entry_name, block, count(*) as observations, md5(string_agg(coalesce(source_doc, '~') || '|' || coalesce(section, '~') || '|' || coalesce(policy_phrase, '~'), chr(10) order by {_WALK})) as digest from r group by all""")
def m_11(spark: SparkSession, d: str) -> DataFrame:
    """Each name's observations over all documents, walked in order of document and section, a digest for each block."""
    rows = _observations(spark, d).where("entry_name is not null").select("entry_name", "policy_phrase", "source_doc", "section").distinct()
    tilde = lambda c: F.coalesce(F.col(c), F.lit("~"))
    walked = rows.select("entry_name", tilde("source_doc").alias("a"), tilde("section").alias("b"), tilde("policy_phrase").alias("c"))
    return C.walk_digests(walked, "entry_name", ["a", "b", "c"], "observations")


@query("f_06", LISTED + "select 1::int as rank, x.path, row_number() over (order by x.path) as place from x left join l on l.path = x.path where l.sha is null or l.sha <> x.sha")
def f_06(spark: SparkSession, d: str) -> DataFrame:
    """Drift in the order of a report; ranges of paths are numbered on their own and then put together."""
    ranks = F.create_map(*[F.lit(x) for i, t in enumerate(H.TIERS) for x in (t, i)])
    rows = f_03(spark, d).select(F.element_at(ranks, F.col("tier")).alias("rank"), "path")
    return numbered(rows, ["rank"], ["path"], "place").select("rank", "path", (F.col("place") + 1).alias("place"))


@query("f_11", "select source as src, arg_max(cleanup_applied, diag_id) as status from conversion_diagnostics where source is not null and cleanup_applied is not null group by 1")
def f_11(spark: SparkSession, d: str) -> DataFrame:
    """The last marker of each source."""
    rows = read_table(spark, d, "conversion_diagnostics").where("source is not null and cleanup_applied is not null")
    return rows.groupBy(F.col("source").alias("src")).agg(F.max_by("cleanup_applied", "diag_id").alias("status"))


@query("f_16", LISTED + "select count(*) filter (l.sha is null) as missing, count(*) filter (l.sha <> x.sha) as drifted, count(*) filter (l.sha is null or l.sha <> x.sha) = 0 as may_go_on from x left join l on l.path = x.path")
def f_16(spark: SparkSession, d: str) -> DataFrame:
    """What keeps a run from going on."""
    now, index, _ = _listing(spark, d)
    both = index.join(now.withColumnRenamed("sha", "now"), "path", "left")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("bigint")
    gone, other = F.col("now").isNull(), F.coalesce(F.col("now") != F.col("sha"), F.lit(False))
    return both.agg(n(gone).alias("missing"), n(other).alias("drifted"), (n(gone | other) == 0).alias("may_go_on"))
