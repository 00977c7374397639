"""What changed since it was last looked at: hashes, drift between listing and index, and plans of what to redo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNTRACKED = "untracked"
REJECT_BELOW = 40
TIERS = ("facets", "guidance", "rules", "tests")


def blob_sha(text: Column) -> Column:
    """The hash under which git files a text."""
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(text).cast("string").cast("binary"), F.lit(bytearray([0])), text.cast("binary")))


def facets_drift(listing: DataFrame, index: DataFrame, derived: DataFrame) -> DataFrame:
    """(tier, category, path) from what lies there (path, sha), the index (path, sha, score) and derived (path).

    Indexed files whose score rejects them are left alone; an untracked hash is not compared.
    """
    known = index.where(F.coalesce(F.col("score"), F.lit(100)) >= REJECT_BELOW).select("path", F.col("sha").alias("old"))
    rejected = index.where(F.col("score") < REJECT_BELOW).select("path")
    both = listing.where("path is not null").select("path", F.col("sha").alias("new"), F.lit(True).alias("there")).join(known.withColumn("indexed", F.lit(True)), "path", "full")
    category = (
        F.when(F.col("there").isNull(), "source_removed")
        .when(F.col("indexed").isNull(), "source_added")
        .when((F.col("old") != UNTRACKED) & (F.col("new") == UNTRACKED), "git_unavailable")
        .when((F.col("old") != UNTRACKED) & (F.col("new") != F.col("old")), "source_edited")
    )
    sources = both.withColumn("category", category).where("category is not null").join(rejected, "path", "left_anti").select("category", "path")
    missing = known.join(listing, "path", "left_semi").join(derived, "path", "left_anti").select(F.lit("derived_missing").alias("category"), "path")
    orphans = derived.join(listing, "path", "left_anti").select(F.lit("orphan_derived").alias("category"), "path")
    return sources.unionByName(missing).unionByName(orphans).select(F.lit("facets").alias("tier"), "category", "path")


def recorded_drift(tier: str, recorded: DataFrame, listing: DataFrame) -> DataFrame:
    """Recorded files (path, sha) that are stale: another hash now, or gone. The first record of a path counts."""
    first = recorded.groupBy("path").agg(F.min_by("sha", "pos").alias("sha") if "pos" in recorded.columns else F.min("sha").alias("sha"))
    now = listing.select("path", F.col("sha").alias("now"))
    stale = first.join(now, "path", "left").where("now is null or now <> sha")
    return stale.select(F.lit(tier).alias("tier"), F.lit(f"{tier}_stale").alias("category"), "path")


def tier_summary(drift: DataFrame) -> DataFrame:
    """(tier, rank, drifted) for all tiers, also those without drift."""
    spark = drift.sparkSession
    tiers = spark.createDataFrame([(t, i) for i, t in enumerate(TIERS)], "tier string, rank int")
    counted = drift.where("category <> 'not_applicable'").groupBy("tier").agg(F.count("*").alias("n"))
    return tiers.join(counted, "tier", "left").select("tier", "rank", F.coalesce("n", F.lit(0)).alias("drifted"))


def plan(listing: DataFrame, recorded: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(path, action): work, noop, delete or skipped. Given done (path), what was not written is work again."""
    both = listing.select("path", F.col("sha").alias("new"), F.lit(True).alias("there")).join(recorded.select("path", F.col("sha").alias("old"), F.lit(True).alias("known")), "path", "full")
    written = F.lit(True)
    if done is not None:
        both = both.join(done.select("path").distinct().withColumn("written", F.lit(True)), "path", "left")
        written = F.coalesce(F.col("written"), F.lit(False))
    same = F.coalesce((F.col("old") == F.col("new")) & (F.col("new") != UNTRACKED), F.lit(False)) & written
    action = F.when(F.col("there").isNull(), "delete").when(~F.col("path").rlike(r"\.md$"), "skipped").when(same, "noop").otherwise("work")
    return both.select("path", action.alias("action"))


def finalize(planned: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, outcome) of planned work by its last marker (src, status, at): recorded, failed, or aborted where the
    marker is missing or still in progress; deletions are pruned and the rest is kept."""
    last = markers.groupBy("src").agg(F.max_by("status", "at").alias("status"))
    rows = planned.join(last, F.col("path") == F.col("src"), "left")
    done = F.when(F.col("status") == "succeeded", "recorded").when(F.col("status") == "failed", "failed").otherwise("aborted")
    return rows.select("path", F.when(F.col("action") == "delete", "pruned").when(F.col("action") == "work", done).otherwise("kept").alias("outcome"))


def latest(rows: DataFrame, key: str, at: list[str]) -> DataFrame:
    """The last row of each key."""
    order = Window.partitionBy(key).orderBy(*[F.desc(c) for c in at])
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
