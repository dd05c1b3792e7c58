"""Queries of problem 7: near-duplicate records with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.near import SHINGLE, SIMILARITY, near_duplicate_classes, near_duplicate_pairs
from folioscope.llm.sql import near_sql
from folioscope.sources.tables import table


def found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of passages of similarity 0.6 or more."""
    return near_duplicate_pairs(table(spark, d, "passages"), "id", "raw_text")


def classes(spark: SparkSession, d: str) -> DataFrame:
    """Every passage that counts with its class of equal texts and its number of links."""
    return near_duplicate_classes(table(spark, d, "passages"), "id", "raw_text")


def queries() -> dict:
    return {"p7_found": found, "p7_classes": classes}


def oracle_sql() -> dict[str, str]:
    return {"p7_found": near_sql(SIMILARITY, SHINGLE)}
