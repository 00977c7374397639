"""Records that differ at most in formatting, collapsed by recursive radix partitioning and counted in tries.

A record's canonical bytes are the letters and digits of its fields. Buckets are the records that share the
first bytes. In each pass the buckets that fit one task are counted in tries; the rows of those that do not, and
only they, go on to the next pass with twice as many bytes, for as long as any bucket is too large. Copies within
an Arrow batch are counted before anything is shuffled; a key whose bytes are all used up in a bucket too large
has its counter added up by Spark in parts, so that no group of copies comes to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.observations import unpacked
from caseloom.session import materialize

#: Entries and bytes of keys that one trie takes, bytes that one edge of a trie spans, bytes of the first pass.
BUCKET_ROWS, BUCKET_BYTES, EDGE, FIRST = 20_000, 16 << 20, 16, 2

#: A group holding at least this share of all records is hot; there are at most 1 / HOT of them.
HOT = 0.001

#: Bytes that are sent to every task; what is larger is joined by shuffle, the large side in so many salted parts.
BROADCAST_BYTES, SALTS = 32 << 20, 32

SEPARATOR, ABSENT = "\u001f", "\u001a"


def canonical(*fields: Column) -> Column:
    """Letters and digits of each field in lower case, fields set apart; a null field is not an empty one."""
    bare = [F.coalesce(F.regexp_replace(F.lower(f), r"[^\p{L}\p{N}]+", ""), F.lit(ABSENT)) for f in fields]
    return F.concat_ws(SEPARATOR, *bare)


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copies of a key within a batch become one entry."""
    for batch in batches:
        yield batch.groupby("key", sort=False).agg(records=("obs_id", "size"), first=("obs_id", "min")).reset_index()


def _count_in_tries(group: pd.DataFrame) -> pd.DataFrame:
    """A trie for each bucket of the group, below the bytes its keys share."""
    tries: dict[bytes, dict] = {}
    ends: list[tuple[str, list[int]]] = []
    for bucket, key, records, first in zip(group["bucket"], group["key"], group["records"].tolist(), group["first"].tolist()):
        data, node = key.encode(), tries.setdefault(bytes(bucket), {})
        for at in range(len(bucket), len(data), EDGE):
            node = node.setdefault(data[at : at + EDGE], {})
        counter = node.get(None)
        if counter is None:
            node[None] = counter = [0, first]
            ends.append((key, counter))
        counter[0] += records
        counter[1] = min(counter[1], first)
    return pd.DataFrame([(key, first, n) for key, (n, first) in ends if n > 1], columns=["key", "keep_id", "copies"])


def _counted(rows: DataFrame, groups: int) -> DataFrame:
    """The copies in buckets that fit. Small buckets share a group, which on average takes no more than one that just fits."""
    return rows.groupBy(F.pmod(F.xxhash64("bucket"), F.lit(groups)).alias("g")).applyInPandas(_count_in_tries, "key string, keep_id bigint, copies bigint")


def _marked(rows: DataFrame, listed: DataFrame, key: str, flag: str, size: int) -> DataFrame:
    """rows with flag, whether listed (distinct values of key, of size bytes together) has theirs.

    A list too large for a broadcast meets the rows in salted parts, since its values are those that many rows have.
    """
    told = listed.select(key).withColumn(flag, F.lit(True))
    if size <= BROADCAST_BYTES:
        out = rows.join(F.broadcast(told), key, "left")
    else:
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
        out = salted.join(told.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), [key, "__salt"], "left").drop("__salt")
    return out.withColumn(flag, F.coalesce(flag, F.lit(False)))


def _bytes(df: DataFrame, key: str) -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(key) + 16), F.lit(0))).first()[0]


def copy_groups(keyed: DataFrame, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, first: int = FIRST) -> DataFrame:
    """(key, keep_id, copies) of every key that more than one of the records (obs_id, key) has.

    The depth doubles from pass to pass without a bound; a key ends at the latest where its bytes do.
    """
    left = materialize(keyed.select("key", "obs_id").mapInPandas(_combine, "key string, records bigint, first bigint"), "combined")
    entries, size = left.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key")), F.lit(0))).first()
    groups = max(entries // bucket_rows, size // bucket_bytes, left.sparkSession.sparkContext.defaultParallelism)
    found, depth = [], first
    while True:
        rows = left.withColumn("bucket", F.substring(F.col("key").cast("binary"), 1, depth))
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("bytes"))
        large = materialize(sizes.where((F.col("n") > bucket_rows) | (F.col("bytes") > bucket_bytes)).select("bucket"), "large")
        if large.isEmpty():
            found.append(_counted(rows, groups))
            break
        # rows go to one of three places; they are told apart once, and written
        ended = F.octet_length("key") <= depth
        place = F.when(~F.col("over"), "fits").when(ended, "ended").otherwise("deeper")
        placed = materialize(_marked(rows, large, "bucket", "over", _bytes(large, "bucket")).withColumn("place", place).drop("over"), "placed")
        found.append(_counted(placed.where("place = 'fits'"), groups))
        terminals = placed.where("place = 'ended'").groupBy("key").agg(F.min("first").alias("keep_id"), F.sum("records").alias("copies"))
        found.append(terminals.where("copies > 1").select("key", "keep_id", "copies"))
        left = placed.where("place = 'deeper'").select("key", "records", "first")
        depth *= 2
    return reduce(DataFrame.unionByName, found)


def keyed_observations(observations: DataFrame) -> DataFrame:
    """(obs_id, key) of the observations that can be copies: policy_phrase neither null nor blank."""
    rows = unpacked(observations).where(r"policy_phrase is not null and not policy_phrase rlike '(?U)^\\s*$'")
    return rows.select("obs_id", canonical(F.col("section"), F.col("policy_phrase"), F.col("source_doc")).alias("key"))


def collapse(observations: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """(the keyed records, their groups of copies); see copy_groups. Rows of null obs_id are left out."""
    keyed = materialize(keyed_observations(observations.where("obs_id is not null")), "keyed")
    return keyed, materialize(copy_groups(keyed, bucket_rows), "groups")


def members(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """(keep_id, copy_id) of all records of each group but the kept one.

    Hot groups are sent to every task if their keys are few bytes, else met in salted parts; the others by shuffle.
    """
    least = max(keyed.count() * HOT, 2)
    hot, cold = groups.where(F.col("copies") >= least), groups.where(F.col("copies") < least)
    flagged = _marked(keyed, hot, "key", "hot", (size := _bytes(hot, "key")))
    if size <= BROADCAST_BYTES:
        warm = keyed.join(F.broadcast(hot), "key")
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
        warm = keyed.withColumn("salt", F.pmod(F.xxhash64("obs_id"), F.lit(SALTS))).join(hot.withColumn("salt", parts), ["key", "salt"])
    pairs = warm.select("keep_id", "obs_id").unionByName(flagged.where("not hot").join(cold, "key").select("keep_id", "obs_id"))
    return pairs.where("obs_id <> keep_id").select("keep_id", F.col("obs_id").alias("copy_id")).distinct()


def copies(observations: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(keep_id, copy_id): for each set of copies its smallest obs_id with every other one.

    Rows repeated under one obs_id are one observation. Observations whose policy_phrase is null or blank are no
    copies; one that has no letter or digit but is not blank is a copy of others like it. Texts are compared as
    they are encoded: a letter with a combining mark differs from the composed letter.
    """
    return members(*collapse(observations, bucket_rows))


def records(observations: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(obs_id, copies): every record once, with how many observations say the same; 1 where none can be a copy.

    What is counted here are rows, so one obs_id delivered twice counts twice.
    """
    keyed, groups = collapse(observations, bucket_rows)
    dropped = members(keyed, groups).select(F.col("copy_id").alias("obs_id"))
    counted = observations.select("obs_id").join(dropped, "obs_id", "left_anti").join(groups.select(F.col("keep_id").alias("obs_id"), "copies"), "obs_id", "left")
    return counted.select("obs_id", F.coalesce("copies", F.lit(1)).alias("copies")).distinct()
