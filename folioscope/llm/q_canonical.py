"""Queries of problem 3: mapping free-entered values to the canonical list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.canonical import map_values, unmatched_report
from folioscope.sources.tables import table


def found(spark: SparkSession, d: str) -> DataFrame:
    """The entity of every entry."""
    return map_values(table(spark, d, "term_entries"), table(spark, d, "spec"))


def unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Entered values that stand for no entity."""
    return unmatched_report(map_values(table(spark, d, "term_entries"), table(spark, d, "spec"), carry=("entered",)))


def queries() -> dict:
    return {"p3_found": found, "p3_unmatched": unmatched}


def oracle_sql() -> dict[str, str]:
    return {}
