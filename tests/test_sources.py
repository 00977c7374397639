import json

from pyspark.sql import functions as F

from caseloom.sources import files
from caseloom.streaming.activity import activity


def test_folders_as_tables(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "sub" / "a.md").write_text("hello\n")
    (tmp_path / "docs" / "b.txt").write_text("no")
    rows = files.documents(spark, str(tmp_path / "docs")).collect()
    assert [(r.text, r.sha) for r in rows] == [("hello\n", "ce013625030ba8dba906f756967f9e9ca394464a")]
    (tmp_path / "c.csv").write_text('a,"x\ny",1\nb,c,2\n')
    assert [r.line for r in files.raw_lines(spark, str(tmp_path)).orderBy("row_num").collect()] == ['a,"x\ny",1', "b,c,2"]


def test_long_files_are_cut_into_records_across_blocks(spark, tmp_path):
    rows = [f'{i},"x ""{i}""\ny",{"z" * (i % 7)}' if i % 3 else f"{i},plain" for i in range(5000)]
    (tmp_path / "long.csv").write_text("\r\n".join(rows) + "\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = [(r.row_num, r.line) for r in files.raw_lines(spark, str(tmp_path)).orderBy("row_num").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i + 1, line) for i, line in enumerate(rows)]


def test_logs_and_their_broken_lines(spark, tmp_path):
    good = {"ts": "2024-01-01T00:00:00Z", "session_id": "s", "type": "user_prompt", "prompt": "p"}
    (tmp_path / "session.jsonl").write_text(json.dumps(good) + "\n\n{broken\n" + json.dumps(good | {"type": "assistant_response"}) + "\n")
    events, rejects = files.session_logs(spark, str(tmp_path))
    assert events.count() == 2 and [r.raw for r in rejects.collect()] == ["{broken"]
    got = activity(events).collect()
    assert [(r.session_id, r.prompts, r.responses, r.questions) for r in got] == [("s", 1, 1, 0)]


def test_activity_as_a_stream(spark, tmp_path):
    rows = spark.range(40).select((F.lit(1704067200) + F.col("id") * 60).cast("timestamp").alias("ts"), F.lit("S").alias("session_id"), F.when(F.col("id") % 2 == 0, "user_prompt").otherwise("assistant_response").alias("type"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = activity(stream).writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("act").collect()} == {tuple(r) for r in activity(rows).collect()}


def test_a_table_made_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    files.replace_table(spark.read.parquet(path).withColumn("id", F.col("id") + 1), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_a_replacement_that_broke_off_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path + ".old")
    files.recover_table(spark, path)
    assert spark.read.parquet(path).count() == 3
    spark.range(4).write.parquet(path + ".old")
    files.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
