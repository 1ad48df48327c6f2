"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnwise.llm.leakage import find_leaks
from turnwise.llm.packing import fill_containers
from turnwise.llm.pairs import find_defects
from turnwise.llm.pii import find_personal
from turnwise.llm.secrets import find_credentials
from turnwise.llm.subjects import find_subjects
from turnwise.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return find_credentials(table(spark, base, "turns"))


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return find_defects(table(spark, base, "turns"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    return find_personal(table(spark, base, "turns"), table(spark, base, "session_messages"))


def p6_containers(spark: SparkSession, base: str) -> DataFrame:
    return fill_containers(table(spark, base, "documents"), table(spark, base, "context_windows"))


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    return find_leaks(table(spark, base, "documents"), table(spark, base, "eval_items")).select("doc_id", "item_id").distinct()


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return find_subjects(table(spark, base, "documents"), table(spark, base, "subjects"))


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p6_containers": p6_containers, "p7_found": p7_found, "p8_found": p8_found}
#: SQL can express none of these; they are tested against brute force and small cases.
ORACLE: dict[str, str] = {}
