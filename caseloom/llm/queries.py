"""Queries of the operators on texts, and SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import conversations, format_copies, packing, residue, scans, shape, transducer
from caseloom.session import materialize, read_table

Query = Callable[[SparkSession, str], DataFrame]


def _scans(run: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, d: run(read_table(spark, d, "parse_result"), read_table(spark, d, "shape_sample"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    judged = shape.classify(read_table(spark, d, "parse_result"), read_table(spark, d, "shape_sample"))
    return shape.only(judged, *[s for s in shape.SHAPES if s != "prose"]).select("result_id", "shape")


def p5_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = shape.quality(read_table(spark, d, "parse_result").select("result_id", "markdown"), read_table(spark, d, "conversion_diagnostics"), read_table(spark, d, "shape_sample"))
    return rows.select("result_id", "word_count", "mean_word_length", "symbol_ratio", "closed_share", "common_share", "size_bytes", "stated_bytes", "size_stated_right", "shape")


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again, as its digest."""
    return transducer.decode(transducer.encode(read_table(spark, d, "documents"))).select("doc_id", F.md5("text").alias("digest"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, d, "documents"), read_table(spark, d, "pack_capacity"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    packed = materialize(p8_containers(spark, d), "packed")
    return packing.fill_report(packed, read_table(spark, d, "pack_capacity"))


QUERIES: dict[str, Query] = {
    "p2_found": lambda spark, d: conversations.dropped_sessions(spark, f"{d}/session_event.parquet"),
    "p2_conversations": lambda spark, d: conversations.conversations(spark, f"{d}/session_event.parquet").select("session_id", "turn", "role", F.unix_micros("ts").alias("ts_us"), "text"),
    "p3_found": _scans(scans.scan_noise),
    "p3_text": _scans(scans.paragraphs),
    "p4_found": lambda spark, d: format_copies.copies(read_table(spark, d, "observations")),
    "p4_records": lambda spark, d: format_copies.records(read_table(spark, d, "observations")),
    "p5_found": p5_found,
    "p5_quality": p5_quality,
    "p7_ids": lambda spark, d: transducer.encode(read_table(spark, d, "documents")),
    "p7_decoded": p7_decoded,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": lambda spark, d: residue.residue(read_table(spark, d, "documents")).select("doc_id").distinct(),
    "p9_kinds": lambda spark, d: residue.residue(read_table(spark, d, "documents")),
}

_COPIES = r"""
with placed as (
  select obs_id, coalesce(policy_phrase, source_doc, section) is null and payload is not null as inside, policy_phrase, source_doc, section, payload from observations),
fields as (
  select obs_id, case when inside then payload->>'policy_phrase' else policy_phrase end as p, case when inside then payload->>'source_doc' else source_doc end as d,
    case when inside then payload->>'section' else section end as s from placed),
bare as (
  select obs_id, regexp_replace(lower(p), '[^\p{L}\p{N}]', '', 'g') as p, regexp_replace(lower(d), '[^\p{L}\p{N}]', '', 'g') as d,
    regexp_replace(lower(s), '[^\p{L}\p{N}]', '', 'g') as s
  from fields where p is not null and not regexp_full_match(p, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*')),
kept as (select obs_id, min(obs_id) over (partition by p, d, s) as keep_id, count(*) over (partition by p, d, s) as copies from bare)
"""

_SESSIONS = r"""
with e as (
  select lower(trim(session_id, e' \t\n\r')) as session_id, ts, type, log, line_no,
    regexp_replace(coalesce(case type when 'user_prompt' then prompt when 'assistant_response' then response when 'ai_question' then question end, ''),
      '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') as a,
    regexp_replace(case when type = 'ai_question' then coalesce(answer, '') else '' end,
      '^[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g') as b
  from session_event where session_id is not null),
names as (select distinct session_id from e),
once as (
  select session_id, ts, type, a, b, min(coalesce(log, '') || chr(31) || lpad(coalesce(line_no::varchar, ''), 12, '0')) as place
  from e where type in ('user_prompt', 'assistant_response', 'ai_question') group by all),
m as (
  select session_id, ts, place, 1 as k, case when type = 'user_prompt' then 'user' else 'assistant' end as role, a as text from once
  union all select session_id, ts, place, 2, 'user', b from once where type = 'ai_question'),
o as (
  select *, lag(role) over w as prior, row_number() over w as n, row_number() over (partition by session_id order by ts desc, place desc, k desc) as back
  from m window w as (partition by session_id order by ts, place, k)),
s as (
  select session_id, bool_or(text <> '') as spoken, bool_or(ts is null or text = '') as holed,
    bool_or(n = 1 and role = 'assistant' or role = 'assistant' and prior = 'assistant') as wrong,
    bool_or(role = 'user' and prior = 'user' or back = 1 and role = 'user') as missing
  from o group by session_id),
v as (
  select names.session_id, case when not coalesce(spoken, false) then 'empty' when holed or wrong then 'broken' when missing then 'missing_reply' end as verdict
  from names left join s using (session_id))
"""

ORACLES: dict[str, str] = {
    "p2_found": _SESSIONS + "select session_id, verdict from v where verdict is not null",
    "p2_conversations": _SESSIONS + "select session_id, n as turn, role, epoch_us(ts) as ts_us, text from o where session_id in (select session_id from v where verdict is null)",
    "p4_found": _COPIES + "select distinct keep_id, obs_id as copy_id from kept where keep_id <> obs_id",
    "p4_records": _COPIES + "select distinct obs_id, coalesce(copies, 1) as copies from observations left join (select distinct obs_id, keep_id, copies from kept) k using (obs_id) where coalesce(keep_id, obs_id) = obs_id",
    "p7_decoded": "select doc_id, md5(coalesce(text, '')) as digest from documents",
}
