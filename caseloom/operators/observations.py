"""Observations as they are told: in three columns or, with these null, as a JSON object in payload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("policy_phrase", "source_doc", "section")


def unpacked(observations: DataFrame) -> DataFrame:
    """observations with policy_phrase, source_doc and section from the columns or, where these are null, from payload.

    A payload that is no JSON object, or lacks a key, gives nulls.
    """
    inside = F.from_json("payload", ", ".join(f"{f} string" for f in FIELDS))
    outside = F.coalesce(*[F.col(f) for f in FIELDS]).isNull() & F.col("payload").isNotNull()
    told = observations.withColumn("__in", inside).withColumn("__out", outside)
    return told.withColumns({f: F.when(F.col("__out"), F.col(f"__in.{f}")).otherwise(F.col(f)) for f in FIELDS}).drop("__in", "__out")
