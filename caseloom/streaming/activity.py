"""Session logs as a stream: activity by session and time window, late events taken up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.telemetry import BOUNDARY


def activity(events: DataFrame, lateness: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """(session_id, window_start, prompts, responses, questions) of a streaming or a batch DataFrame of events.

    Events without session or time, and types that are no turn's boundary, do not count.
    """
    rows = events.where(F.col("session_id").isNotNull() & F.col("ts").isNotNull() & F.col("type").isin(*BOUNDARY)).withColumn("session_id", F.lower(F.trim("session_id")))
    count = lambda kind, name: F.sum((F.col("type") == kind).cast("int")).alias(name)
    sums = rows.withWatermark("ts", lateness).groupBy("session_id", F.window("ts", width).alias("w"))
    out = sums.agg(count("user_prompt", "prompts"), count("assistant_response", "responses"), count("ai_question", "questions"))
    return out.select("session_id", F.col("w.start").alias("window_start"), "prompts", "responses", "questions")
