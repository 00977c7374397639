"""Session logs: durations of turns and skills, turns of a session, and reports over logs that share sessions.

Sessions run along (session, time) in ranges, of which a long session has several (see ranking). The boundary
events of a session are its prompts, responses and questions; a prompt that begins with a slash starts a skill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.ranking import numbered, running

#: The events between which time is measured.
BOUNDARY = ("user_prompt", "assistant_response", "ai_question")
SHARED = ".shared"


def seconds_between(begin: Column, end: Column) -> Column:
    """Whole seconds; null if end lies before begin or either is null."""
    n = F.floor((F.unix_micros(end) - F.unix_micros(begin)) / 1_000_000)
    return F.when(n >= 0, n)


def show_seconds(n: Column) -> Column:
    return F.when(n < 60, F.concat(n.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(n / 60).cast("string"), F.lit("m "), (n % 60).cast("string"), F.lit("s")))


def infer_domain(text: Column, domains: DataFrame | None = None) -> Column:
    """The domain a prompt or path names: the first folder, or the argument of a slash command; else the shared one."""
    got = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(got(r"(?:^|\s|/)domains/([A-Za-z0-9_-]+)"), got(r"^/[a-z-]+\s+([A-Za-z0-9_-]+)"), got(r"^([A-Za-z0-9_-]+)/(?:input|specs|logs|tests)/"), F.lit(SHARED))


def ordered(events: DataFrame) -> DataFrame:
    """The events that have a session and a time, session ids spelled evenly."""
    return events.where("session_id is not null and ts is not null").withColumn("session_id", F.lower(F.trim("session_id")))


SESSION, BY_TIME = ["session_id"], ["ts", "log", "line_no"]


def _slash() -> Column:
    """1 for a prompt that begins a skill, else 0."""
    return F.coalesce(((F.col("type") == "user_prompt") & F.col("prompt").startswith("/")).cast("int"), F.lit(0))


def turn_durations(events: DataFrame) -> DataFrame:
    """(log, line_no, session_id, seconds) of each response: the time since the last boundary event before it."""
    acts = ordered(events).where(F.col("type").isin(*BOUNDARY)).select(*SESSION, *BY_TIME, "type")
    rows = running(acts, SESSION, BY_TIME, lasts={"since": F.col("ts")}).where("type = 'assistant_response'")
    return rows.select("log", "line_no", "session_id", seconds_between(F.col("since"), F.col("ts")).alias("seconds"))


def skill_durations(events: DataFrame) -> DataFrame:
    """(session_id, skill, started, active, waited, turns) of each skill, that is from a slash prompt to the next.

    waited adds up the time before each question of the assistant since the activity before it; active is the
    rest; turns are its responses and one.
    """
    acts = ordered(events).where(F.col("type").isin(*BOUNDARY)).select(*SESSION, *BY_TIME, "type", "prompt")
    wait = F.when(F.col("type") == "ai_question", seconds_between(F.col("since"), F.col("ts"))).otherwise(0)
    marked = running(acts, SESSION, BY_TIME, {"island": _slash()}, {"since": F.col("ts")}).withColumn("wait", wait).where("island > 0")
    per = marked.groupBy("session_id", "island").agg(
        F.min("ts").alias("started"),
        F.min_by("prompt", F.struct("ts", "log", "line_no")).alias("prompt"),
        F.max("ts").alias("ended"),
        F.sum("wait").alias("waited"),
        (F.sum((F.col("type") == "assistant_response").cast("int")) + 1).alias("turns"),
    )
    skill = F.regexp_extract("prompt", r"^/(\S*)", 1)
    return per.select("session_id", skill.alias("skill"), "started", (seconds_between(F.col("started"), F.col("ended")) - F.col("waited")).alias("active"), "waited", "turns")


def last_of_skill(events: DataFrame) -> DataFrame:
    """(log, line_no) of the skill_duration events to keep: the last one of each skill's range."""
    rows = ordered(events).where("type in ('user_prompt', 'skill_duration')").select(*SESSION, *BY_TIME, "type", "prompt")
    marked = running(rows, SESSION, BY_TIME, {"island": _slash()}).where("type = 'skill_duration'")
    return marked.groupBy("session_id", "island").agg(F.max(F.struct(*BY_TIME)).alias("last")).select("last.log", "last.line_no")


def turns(events: DataFrame) -> DataFrame:
    """(session_id, turn, started, events, response): each user prompt begins a turn; its last response counts."""
    rows = ordered(events).select(*SESSION, *BY_TIME, "type", "response")
    marked = running(rows, SESSION, BY_TIME, {"turn": F.coalesce((F.col("type") == "user_prompt").cast("int"), F.lit(0))}).where("turn > 0")
    return marked.groupBy("session_id", "turn").agg(
        F.min("ts").alias("started"),
        F.count("*").alias("events"),
        F.max_by("response", F.when(F.col("type") == "assistant_response", F.struct("ts", "log", "line_no"))).alias("response"),
    )


def report(events: DataFrame, domain: Column) -> DataFrame:
    """The events of a domain's sessions, those in the shared log included, each session's in order; first seen first.

    domain picks the rows whose sessions count.
    """
    rows = ordered(events)
    own = rows.where(domain).select("session_id").distinct()
    kept = rows.where(domain | (F.col("domain") == SHARED)).join(own, "session_id", "left_semi")
    first = kept.groupBy("session_id").agg(F.min("ts").alias("first_seen"))
    placed = numbered(kept.select(*SESSION, *BY_TIME, "type"), SESSION, BY_TIME, "n")
    return placed.join(first, "session_id").select("session_id", "first_seen", (F.col("n") + 1).alias("n"), "type", "log", "line_no")


def prompt_list(events: DataFrame) -> DataFrame:
    """(session_id, n, line): each session's prompts as the lines of a numbered list."""
    rows = ordered(events).where("type = 'user_prompt'").select(*SESSION, *BY_TIME, "prompt")
    n = F.col("n") + 1
    return numbered(rows, SESSION, BY_TIME, "n").select("session_id", n.alias("n"), F.concat(n.cast("string"), F.lit(". "), F.coalesce("prompt", F.lit(""))).alias("line"))
