"""Queries of the general training-data operators of the core (problems 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnwise.operators.schema_drift import find_changes, unified_records
from turnwise.operators.timestamps import find_instants
from turnwise.sources.tables import table


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return find_changes(table(spark, base, "session_files"), table(spark, base, "session_lines"))


def p3_unified(spark: SparkSession, base: str) -> DataFrame:
    """All session records in one table with stable columns."""
    return unified_records(table(spark, base, "session_files"), table(spark, base, "session_lines"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return find_instants(table(spark, base, "turns"), table(spark, base, "session_messages"), table(spark, base, "clients"))


QUERIES = {"p3_found": p3_found, "p3_unified": p3_unified, "p5_found": p5_found}
