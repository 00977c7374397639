"""Queries by name, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caseloom.operators import schema_drift, structural_csv
from caseloom.session import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name."""

    def put(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return put


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return structural_csv.failures(read_table(spark, d, "import_line"), read_table(spark, d, "field_spec"))


@query("p1_loaded")
def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return structural_csv.load_cases(read_table(spark, d, "import_line"), read_table(spark, d, "field_spec"))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.changes(read_table(spark, d, "naming_manifest"))


@query("p6_entries")
def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.one_table(read_table(spark, d, "naming_manifest"))


@query("p6_lifespans")
def p6_lifespans(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.lifespans(read_table(spark, d, "naming_manifest"))
