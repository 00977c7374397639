"""Conversations put together from message rows by keyed streaming state.

Three stateful steps, all of them Spark's own and so without Python. Copies of a message are one key, reduced
before the shuffle. The messages of a session and an hour are one state, so that a session that holds much of all
rows is spread over many; it buffers late arrivals until the watermark has passed the hour, and is emitted then and
only then. What is known of closed hours, a few flags each, is the state of their session, a session window that is
closed by its timeout: then its conversation is validated and emitted, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.session import materialize, scratch_path

#: For streams without an end: how long after its time a message is still taken, and after which pause a session ends.
LATENESS, IDLE = "2 hours", "1 day"
SLICE = "1 hour"

#: Bytes of input in one micro-batch of a replay.
BATCH_BYTES = 64 << 30

_STRIP = r"(?U)^\s+|\s+$"
#: Behind all other time; its arrival closes whatever is open.
_END, _CLOSING = "9000-01-01 00:00:00", "\u0000closing"

MESSAGE = "session_id string, ts timestamp, kind string, first string, second string, place string"
SLICES = (
    "session_id string, start timestamp, spoken boolean, blank boolean, first_role string, last_role string, twice_assistant boolean, twice_user boolean, "
    "turns array<struct<stamp: bigint, role: string, text: string>>"
)
CLOSED = "session_id string, spoken boolean, broken boolean, missing boolean, hours array<struct<start: timestamp, turns: int>>"


def keyed_events(events: DataFrame, texts: bool = True) -> DataFrame:
    """Stateless part: session and time of each event, its kind (U, A, Q, or null for no message) and trimmed texts.

    Without texts, digests stand for them, which is all that a verdict needs.
    """
    strip = lambda c: F.coalesce(F.regexp_replace(c, _STRIP, ""), F.lit(""))
    told = lambda c: c if texts else F.when(c == "", "").otherwise(F.md5(c))
    kind = F.when(F.col("type") == "user_prompt", "U").when(F.col("type") == "assistant_response", "A").when(F.col("type") == "ai_question", "Q")
    first = F.when(kind == "U", F.col("prompt")).when(kind == "A", F.col("response")).when(kind == "Q", F.col("question"))
    return events.where("session_id is not null").select(
        F.lower(F.regexp_replace("session_id", _STRIP, "")).alias("session_id"),
        "ts",
        kind.alias("kind"),
        told(strip(first)).alias("first"),
        F.when(kind == "Q", told(strip(F.col("answer")))).otherwise("").alias("second"),
        F.concat_ws("\u001f", F.coalesce("log", F.lit("")), F.lpad(F.coalesce(F.col("line_no").cast("string"), F.lit("")), 12, "0")).alias("place"),
    )


def session_marks(keyed: DataFrame) -> DataFrame:
    """(session_id, mark) once each, as soon as they come: known for an event that is no message, and for a message
    without time untimed, or untimed_blank where it has a text that is blank or none at all."""
    spoken = (F.col("first") != "") | (F.col("second") != "")
    mark = F.when(F.col("kind").isNull(), "known").when(spoken, "untimed").otherwise("untimed_blank")
    return keyed.where("kind is null or ts is null").select("session_id", mark.alias("mark")).dropDuplicates(["session_id", "mark"])


def _turns(messages: Column) -> Column:
    """Messages in order of time and place, a question followed at once by its answer."""
    turn = lambda m, role, text: F.struct(m["stamp"].alias("stamp"), F.lit(role).alias("role"), m[text].alias("text"))
    said = lambda m: F.when(m["kind"] == "U", F.array(turn(m, "user", "first"))).when(m["kind"] == "A", F.array(turn(m, "assistant", "first"))).otherwise(
        F.array(turn(m, "assistant", "first"), turn(m, "user", "second"))
    )
    return F.flatten(F.transform(F.array_sort(messages), said))


def _twice(roles: Column, role: str) -> Column:
    follows = F.zip_with(F.slice(roles, 1, F.greatest(F.size(roles) - 1, F.lit(0))), F.slice(roles, 2, F.size(roles)), lambda a, b: (a == role) & (b == role))
    return F.exists(follows, lambda x: x)


def conversation_slices(keyed: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """The hours of sessions, each emitted once when the watermark has closed it; keyed is a stream of keyed_events.

    A message repeated in another log or line is one message, at its first place. Messages without time are no
    part of an hour; see session_marks.
    """
    timed = keyed.withWatermark("ts", lateness).where("kind is not null and ts is not null")
    once = timed.groupBy("session_id", F.window("ts", SLICE).alias("hour"), F.unix_micros("ts").alias("stamp"), "kind", "first", "second").agg(F.min("place").alias("place"))
    held = once.groupBy("session_id", "hour").agg(F.collect_list(F.struct("stamp", "place", "kind", "first", "second")).alias("messages"))
    rows = held.select("session_id", F.col("hour.start").alias("start"), _turns(F.col("messages")).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    return rows.select(
        "session_id", "start", F.exists("turns", lambda t: t["text"] != "").alias("spoken"), F.exists("turns", lambda t: t["text"] == "").alias("blank"),
        F.element_at(roles, 1).alias("first_role"), F.element_at(roles, -1).alias("last_role"), _twice(roles, "assistant").alias("twice_assistant"), _twice(roles, "user").alias("twice_user"), "turns",
    )


def closed_sessions(slices: DataFrame, idle: str = IDLE) -> DataFrame:
    """(session_id, spoken, broken, missing, hours): sessions validated when their timeout closes them.

    slices is a stream of conversation_slices. hours says how many turns each of the session's hours has.
    """
    one = F.struct("start", F.size("turns").alias("turns"), "spoken", "blank", "first_role", "last_role", "twice_assistant", "twice_user")
    held = slices.withWatermark("start", SLICE).select("session_id", "start", one.alias("h")).groupBy("session_id", F.session_window("start", idle).alias("w")).agg(F.array_sort(F.collect_list("h")).alias("hours"))
    any_of = lambda name: F.exists("hours", lambda h: h[name])
    size = F.size("hours")
    across = lambda role: F.exists(
        F.zip_with(F.slice("hours", 1, size - 1), F.slice("hours", 2, size), lambda a, b: (a["last_role"] == role) & (b["first_role"] == role)), lambda x: x
    )
    broken = any_of("blank") | any_of("twice_assistant") | across("assistant") | (F.get("hours", F.lit(0))["first_role"] == "assistant")
    missing = any_of("twice_user") | across("user") | (F.element_at("hours", -1)["last_role"] == "user")
    counted = F.transform("hours", lambda h: F.struct(h["start"].alias("start"), h["turns"].alias("turns")))
    return held.select("session_id", any_of("spoken").alias("spoken"), broken.alias("broken"), missing.alias("missing"), counted.alias("hours"))


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB rather than in the heap, unless the session says otherwise."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # many small stores: no disk set aside ahead of need
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }
    with_state = {k: spark.conf.get(k, None) for k in wanted}
    own = with_state["spark.sql.streaming.stateStore.providerClass"]
    change = own is None or own.endswith("HDFSBackedStateStoreProvider")
    try:
        if change:
            for k, v in wanted.items():
                spark.conf.set(k, v)
        yield
    finally:
        for k, v in with_state.items() if change else ():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(df: DataFrame, out: str, log: str, lateness: str, last: bool = True) -> None:
    """Takes in what there is; only the last run has a batch of its own for what the watermark then closes."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(last).lower())
    try:
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    query.awaitTermination()
    dropped = sum(int(o.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for o in p.get("stateOperators", []))
    if dropped:
        raise ValueError(f"{dropped} rows came later than {lateness}")


def _end_row(spark: SparkSession, schema: str, at: str) -> DataFrame:
    """The row that ends a stream of this schema."""
    fields = [f.split(" ", 1) for f in schema.split(", turns ")[0].split(", ")] + ([["turns", schema.split(", turns ")[1]]] if ", turns " in schema else [])
    known = {"session_id": F.lit(_CLOSING), "kind": F.lit("U"), at: F.lit(_END)}
    return spark.range(1).select(*[known.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields])


def replay(spark: SparkSession, path: str, texts: bool = True, lateness: str | None = None, idle: str | None = None, **source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs the streams over all files there are at path: (marks, slices, closed sessions).

    Files come in no order of time, so that by default a message may be as late, and a session as long idle, as
    all time there is; were rows refused as too late, the run fails rather than leave them out. Files are taken in
    micro-batches of BATCH_BYTES (or as source, options of the file source, says). After the last one a row behind
    all time closes what is open.
    """
    kept = spark.read.parquet(path)
    low, high = kept.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    span = f"{(high - low if low is not None else 0) + 7200} seconds"
    lateness, idle = lateness or span, idle or span
    limits = source or {"maxBytesPerTrigger": str(BATCH_BYTES)}
    slices, closed, ends, ends_of = (scratch_path(spark, f"conversation-{n}") for n in ("slices", "closed", "end", "last"))
    # as a pattern, a path may be a folder of files as well as one file
    events = keyed_events(spark.readStream.schema(kept.schema).options(**limits).parquet(f"{path[:-1]}[{path[-1]}]"), texts)
    end = _end_row(spark, MESSAGE, "ts")
    with _state_on_disk(spark):
        end.limit(0).write.parquet(ends)
        hours = conversation_slices(events.unionByName(spark.readStream.schema(MESSAGE).parquet(ends)), lateness)
        _run(hours, slices, slices + "-log", lateness, last=False)
        end.write.mode("append").parquet(ends)
        _run(hours, slices, slices + "-log", lateness)
        # the hours are all there and make one batch, and so the row that ends them may come with them
        _end_row(spark, SLICES, "start").write.parquet(ends_of)
        told = spark.readStream.schema(SLICES)
        _run(closed_sessions(told.parquet(slices).unionByName(told.parquet(ends_of)), idle), closed, closed + "-log", idle)
    return session_marks(keyed_events(kept, texts)), spark.read.schema(SLICES).parquet(slices), spark.read.schema(CLOSED).parquet(closed)


def verdicts(marks: DataFrame, closed: DataFrame) -> DataFrame:
    """(session_id, verdict) of every session; null for one to keep, else the first that holds of

    empty (no message, or none with a text), broken (a message without ts or text, the assistant first, or twice
    in a row), missing_reply (the user twice in a row, or last). Messages of one ts keep the order of log and line.
    """
    seen = marks.select("session_id", (F.col("mark") == "untimed").alias("spoken"), F.col("mark").startswith("untimed").alias("broken"), F.lit(False).alias("missing"))
    rows = seen.unionByName(closed.select("session_id", "spoken", "broken", "missing"))
    said = rows.groupBy("session_id").agg(*[F.bool_or(c).alias(c) for c in ("spoken", "broken", "missing")])
    return said.select("session_id", F.when(~F.col("spoken"), "empty").when(F.col("broken"), "broken").when(F.col("missing"), "missing_reply").alias("verdict"))


def dropped_sessions(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, verdict) of the sessions to drop."""
    marks, _, closed = replay(spark, path, texts=False)
    return verdicts(marks, closed).where("verdict is not null")


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, turn, role, ts, text): the messages of every session to keep, in order; turn counts from 1."""
    marks, slices, closed = replay(spark, path)
    kept = materialize(verdicts(marks, closed).where("verdict is null").select("session_id"), "kept")
    before = Window.partitionBy("session_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    hours = closed.join(kept, "session_id", "left_semi").select("session_id", F.inline("hours"))
    placed = hours.select("session_id", "start", F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("offset"))
    rows = slices.select("session_id", "start", "turns").join(placed, ["session_id", "start"]).select("session_id", "offset", F.posexplode("turns").alias("at", "t"))
    return rows.select("session_id", (F.col("offset") + F.col("at") + 1).alias("turn"), F.col("t.role").alias("role"), F.timestamp_micros("t.stamp").alias("ts"), F.col("t.text").alias("text"))
