"""Queries of problem 4: visually identical text with different characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.lookalike import consistent, look_alike_members, look_alike_pairs
from folioscope.llm.sql import look_alike_sql
from folioscope.sources.tables import table


def found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passages that look the same but differ in code points."""
    return look_alike_pairs(table(spark, d, "passages"), "id", "raw_text")


def form(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every passage's raw_text, beside normalized_text's agreement with it."""
    return consistent(table(spark, d, "passages"), "id", "raw_text").distinct()


def classes(spark: SparkSession, d: str) -> DataFrame:
    """Passages that look like a different one, with the class of what they look like."""
    return look_alike_members(table(spark, d, "passages"), "id", "raw_text")


def queries() -> dict:
    return {"p4_found": found, "p4_form": form, "p4_classes": classes}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": look_alike_sql()}
