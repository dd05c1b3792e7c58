"""Queries of problem 5: noise in text from scanned pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.scans import noise_places, readable
from folioscope.sources.tables import table


def found(spark: SparkSession, d: str) -> DataFrame:
    """Every header, page number, cut word and misread word of the editions."""
    passages = table(spark, d, "passages")
    return noise_places(passages.where("text_role = 'edition'"), passages)


def text(spark: SparkSession, d: str) -> DataFrame:
    """The continuous readable text of the editions."""
    passages = table(spark, d, "passages")
    return readable(passages.where("text_role = 'edition'"), passages)


def queries() -> dict:
    return {"p5_found": found, "p5_text": text}


def oracle_sql() -> dict[str, str]:
    return {}
