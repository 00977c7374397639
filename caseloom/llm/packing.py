"""Texts packed into containers of fixed capacity by minimum bin slack.

What decides a packing is how many items of each length there are: at most one row per length up to the
capacity, however many texts lie behind it. The slack search runs on those counts, one small group for each
capacity; its work grows with the square of the capacity, not with the texts. Items find their container by their rank among the items of their length, without gathering.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.transducer import TOKENIZER_DIR, token_counts
from caseloom.session import materialize

#: Items ranked in one window group, ranks that one row of a plan covers when items look it up, and capacities that are
#: sent to every task.
RANK_GROUP, RANK_BLOCK, CAPACITIES = 200_000, 1024, 10_000

PLAN = "capacity_id int, length bigint, start bigint, stop bigint, each bigint, container bigint"


def tightest(counts: dict[int, int], room: int) -> Counter:
    """The multiset of lengths whose sum comes closest to room without passing it.

    Bit s of a bitset says that some multiset sums to s. Lengths are added from the longest on, in powers of two
    of their count, until room itself is reached; walking the kept bitsets backwards tells which were used.
    """
    full = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((n for n, k in counts.items() if k and n <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left and not sums >> room & 1:
            k = min(k, left)
            steps.append((length, k, sums))
            sums |= sums << (length * k) & full
            left -= k
            k *= 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, Counter()
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] += k
            at -= length * k
    return used


def slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(lengths with how many of each a container takes, containers filled so)], covering all counts.

    Each pattern starts with the longest length left, fills its room as closely as the other lengths allow, and
    is repeated as long as they last.
    """
    counts, plan = dict(counts), []
    while counts:
        longest = max(counts)
        others = dict(counts)
        others[longest] -= 1
        pattern = tightest(others, capacity - longest)
        pattern[longest] += 1
        times = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        plan.append((dict(pattern), times))
    return plan


def _plan_rows(key: tuple, counts: pd.DataFrame) -> pd.DataFrame:
    capacity_id, capacity = int(key[0]), int(key[1])
    taken, container, rows = Counter(), 0, []
    for pattern, times in slack_plan(dict(zip(counts["length"].tolist(), counts["items"].tolist())), capacity):
        for n, k in pattern.items():
            rows.append((capacity_id, n, taken[n], taken[n] + k * times, k, container))
            taken[n] += k * times
        container += times
    return pd.DataFrame(rows, columns=["capacity_id", "length", "start", "stop", "each", "container"])


def pack(items: DataFrame, capacities: DataFrame) -> DataFrame:
    """(capacity_id, item_id, piece, tokens, container) from items (item_id, tokens) and (capacity_id, capacity).

    An item longer than the capacity is cut into full pieces, each a container of its own (container ``f...``),
    and a rest that is packed like any other item (``p...``). Items of zero or null tokens, and capacities that
    are null or not positive, give nothing. item_id must be unique.
    """
    # every item goes into a container of each capacity
    wanted = capacities.where("capacity > 0").select("capacity_id", "capacity")
    few = wanted.limit(CAPACITIES + 1).count() <= CAPACITIES
    sized = (
        items.where("tokens > 0")
        .crossJoin(F.broadcast(wanted) if few else wanted)
        .select("capacity_id", "capacity", "item_id", F.expr("tokens div capacity").alias("full"), F.expr("tokens % capacity").alias("length"))
    )
    groups = max(1, -(-items.count() // RANK_GROUP))
    rest = sized.where("length > 0").withColumn("part", F.expr(f"pmod(xxhash64(item_id), {groups})"))
    counts = materialize(rest.groupBy("capacity_id", "capacity", "length", "part").agg(F.count("*").alias("items")), "lengths")
    whole = counts.groupBy("capacity_id", "capacity", "length").agg(F.sum("items").alias("items"))
    plan = materialize(whole.groupBy("capacity_id", "capacity").applyInPandas(_plan_rows, PLAN), "plan")

    before = Window.partitionBy("capacity_id", "length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("capacity_id", "length", "part", F.coalesce(F.sum("items").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("capacity_id", "length", "part").orderBy("item_id")
    ranked = (
        rest.withColumn("nth", F.row_number().over(own) - 1)
        .join(offsets, ["capacity_id", "length", "part"])
        .withColumn("nth", F.col("nth") + F.col("offset"))
        .withColumn("block", F.expr(f"nth div {RANK_BLOCK}"))
    )
    blocks = plan.withColumn("block", F.explode(F.expr(f"sequence(start div {RANK_BLOCK}, (stop - 1) div {RANK_BLOCK})")))
    packed = (
        ranked.join(blocks, ["capacity_id", "length", "block"])
        .where("nth >= start and nth < stop")
        .select("capacity_id", "item_id", F.col("full").alias("piece"), F.col("length").alias("tokens"), F.expr("concat('p', container + (nth - start) div each)").alias("container"))
    )
    pieces = (
        sized.where("full > 0")
        .select("capacity_id", "item_id", F.explode(F.expr("sequence(0L, full - 1)")).alias("piece"), F.col("capacity").cast("bigint").alias("tokens"))
        .withColumn("container", F.expr("concat('f', item_id, '-', piece)"))
    )
    return packed.unionByName(pieces)


def pack_documents(documents: DataFrame, pack_capacity: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(capacity_id, doc_id, piece, tokens, container) of all non-empty texts, for each capacity.

    Each row of documents is an item of its own; null and empty texts are none. Texts are measured once for each
    tokenizer named, of which there are few files, and the measures are written to the shared folder.
    """
    out = None
    for (name,) in pack_capacity.select("tokenizer").where("tokenizer is not null").distinct().collect():
        measured = materialize(token_counts(documents, name, folder).withColumn("item_id", F.monotonically_increasing_id()), "sizes")
        packed = pack(measured.select("item_id", "tokens"), pack_capacity.where(F.col("tokenizer") == name))
        named = packed.join(measured.select("item_id", "doc_id"), "item_id").select("capacity_id", "doc_id", "piece", "tokens", "container")
        out = named if out is None else out.unionByName(named)
    if out is None:
        out = documents.sparkSession.createDataFrame([], "capacity_id int, doc_id bigint, piece bigint, tokens bigint, container string")
    return out


def fill_report(packed: DataFrame, pack_capacity: DataFrame) -> DataFrame:
    """(capacity_id, containers, tokens, least, unused_share): least is the number of containers no packing beats."""
    used = packed.groupBy("capacity_id").agg(F.count_distinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return used.join(pack_capacity.select("capacity_id", "capacity"), "capacity_id").select(
        "capacity_id",
        "containers",
        "tokens",
        F.expr("(tokens + capacity - 1) div capacity").alias("least"),
        F.expr("round(1 - tokens / (containers * cast(capacity as double)), 6)").alias("unused_share"),
    )
