from pathlib import Path

import __spark_entry__ as entry


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p6_found"} <= set(entry.queries())


def test_flagship(spark):
    out = entry.entry(spark)
    assert out.columns == ["line_id", "column_name", "reason"] and out.count() > 0


def test_scratch_goes_with_the_application(spark):
    from caseloom.session import clear_scratch, materialize, shared_dir

    kept = materialize(spark.range(3), "t")
    place = kept.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 3 and spark.sparkContext.applicationId in place and shared_dir(spark).removeprefix("file://") in place
    clear_scratch(spark)
    assert not Path(place).exists()
