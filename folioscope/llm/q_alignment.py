"""Queries of problem 2: sentence alignment in bilingual documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.alignment import aligned
from folioscope.sources.tables import table


def found(spark: SparkSession, d: str) -> DataFrame:
    """French and Chinese sentences of one session that translate each other."""
    return aligned(table(spark, d, "passages"))


def queries() -> dict:
    return {"p2_found": found}


def oracle_sql() -> dict[str, str]:
    return {}
