"""Numbering rows, and running along them, within keys when one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import materialize


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df in ranges of (keys, order), so that a large key lies in several; written, since ranges are sampled."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, *keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")


def _beside(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """rows with what totals has for their key and range; null keys match each other."""
    on = rows["__range"] == totals["__range"]
    for k in keys:
        on = on & rows[k].eqNullSafe(totals[k])
    return rows.join(totals, on).drop(*[totals[k] for k in [*keys, "__range"]])


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "nth", total: str = "of") -> DataFrame:
    """df with name, counting from 0 within keys by order, and total, the number of rows of the key.

    Each range counts on its own and adds what the ranges before it hold. order should tell the rows of a key
    apart; ties go in any order.
    """
    ranged = _ranged(df, keys, order)
    counts = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(by_key).alias(total))
    within = ranged.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)) - 1)
    return _beside(within, offsets, keys).withColumn(name, F.col("__at") + F.col("__before")).drop("__range", "__at", "__before")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """df with each of sums, added up to and with the row, and each of lasts, its last value that is not null before the row.

    Each range runs on its own; what the ranges before it come to is carried over. Ties go in any order.
    """
    sums, lasts = sums or {}, lasts or {}
    ranged = _ranged(df.withColumns({f"__s_{n}": c for n, c in sums.items()} | {f"__l_{n}": c for n, c in lasts.items()}), keys, order)
    here = Window.partitionBy(*keys, "__range").orderBy(*order)
    prior = here.rowsBetween(Window.unboundedPreceding, -1)
    at_end = [F.sum(f"__s_{n}").alias(f"__s_{n}") for n in sums] + [F.max_by(f"__l_{n}", F.when(F.col(f"__l_{n}").isNotNull(), F.struct(*order))).alias(f"__l_{n}") for n in lasts]
    by_range = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranged.groupBy(*keys, "__range").agg(*at_end).select(
        *keys, "__range", *[F.sum(f"__s_{n}").over(by_range).alias(f"__cs_{n}") for n in sums], *[F.last(f"__l_{n}", ignorenulls=True).over(by_range).alias(f"__cl_{n}") for n in lasts]
    )
    within = ranged.withColumns({f"__ws_{n}": F.sum(f"__s_{n}").over(here.rowsBetween(Window.unboundedPreceding, 0)) for n in sums} | {f"__wl_{n}": F.last(f"__l_{n}", ignorenulls=True).over(prior) for n in lasts})
    both = _beside(within, carried, keys)
    out = {n: F.col(f"__ws_{n}") + F.coalesce(f"__cs_{n}", F.lit(0)) for n in sums} | {n: F.coalesce(f"__wl_{n}", f"__cl_{n}") for n in lasts}
    return both.withColumns(out).select(*df.columns, *out)
