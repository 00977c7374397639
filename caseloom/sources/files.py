"""Folders of documents, logs and manifests read as tables, and tables written as the files tools expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.operators.freshness import blob_sha
from caseloom.session import materialize

EVENT = (
    "ts timestamp, session_id string, type string, domain string, prompt string, response string, question string, answer string, cmd string, exit_code int, "
    "path string, bytes bigint, diff string, from_ts timestamp, to_ts timestamp, duration_seconds bigint, wait_seconds bigint, turns int"
)


def documents(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, text, sha, modified) of the files below folder that match pattern; sha is the one git files them under."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    text = F.decode(F.col("content"), "UTF-8")
    return files.select("path", text.alias("text"), F.col("modificationTime").alias("modified")).withColumn("sha", blob_sha(F.col("text")))


def session_logs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): JSON lines of all logs below folder, and (log, raw) of the lines that are no JSON objects.

    Fields of another type than EVENT's are null. Blank lines are neither.
    """
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(folder).select(F.col("_metadata.file_path").alias("log"), "value").where(r"value rlike '\\S'")
    parsed = lines.withColumn("e", F.from_json("value", EVENT + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    good = parsed.where("e._bad is null and e is not null").select("log", "e.*").drop("_bad")
    return good, parsed.where("e._bad is not null or e is null").select("log", F.col("value").alias("raw"))


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(import_file, row_num, line) of comma-separated files below folder; quoted line breaks stay within a line's record.

    Files are read in blocks, wherever these begin. A line break ends a record where the number of quotes before it
    in the file is even: lines count theirs within a block, and blocks add what the blocks before them hold, of which
    there are few. Blank records are left out, but counted.
    """
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("lineSep", "\n").text(folder)
    lines = materialize(text.select(F.col("_metadata.file_path").alias("import_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value"), "csv-lines")
    within = Window.partitionBy("import_file", "block").orderBy("at")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lambda c, w: F.pmod(F.coalesce(F.sum(c).over(w), F.lit(0)), F.lit(2))
    blocks = lines.groupBy("import_file", "block").agg(F.sum(quotes).alias("q"))
    by_block = Window.partitionBy("import_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parity = materialize(blocks.select("import_file", "block", odd("q", by_block).alias("open")), "csv-blocks")
    opened = lines.join(parity, ["import_file", "block"]).withColumn("starts", (F.pmod(odd(quotes, before) + F.col("open"), F.lit(2)) == 0).cast("int"))
    counted = materialize(opened.withColumn("nth", F.sum("starts").over(within)), "csv-records")
    totals = counted.groupBy("import_file", "block").agg(F.max("nth").alias("records"))
    offsets = totals.select("import_file", "block", F.coalesce(F.sum("records").over(by_block), F.lit(0)).alias("offset"))
    # a record that goes on into the next block has there the number of the last one begun before it
    whole = counted.join(offsets, ["import_file", "block"]).groupBy("import_file", (F.col("nth") + F.col("offset")).cast("int").alias("row_num")).agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    line = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["value"]), "\n"), "\r$", "")
    return whole.select("import_file", "row_num", line.alias("line")).where("line <> ''")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, without null fields."""
    df.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrites the table at path with one made from it: written beside it first, then put in its place.

    Files have no swap: between two renames there is a moment without a table. A crash then leaves the old one whole
    beside it, and the next call puts it back before anything else; recover_table does the same for readers.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".new")
    recover_table(spark, path)
    fs, (target, fresh, old) = _paths(spark, path)
    if fs.exists(target):
        fs.delete(old, True)
        fs.rename(target, old)
    fs.rename(fresh, target)
    fs.delete(old, True)


def recover_table(spark: SparkSession, path: str) -> None:
    """Puts the old table back where a replacement broke off between its renames."""
    fs, (target, _, old) = _paths(spark, path)
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)


def _paths(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = at(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), (target, at(path + ".new"), at(path + ".old"))
