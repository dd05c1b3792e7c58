"""Queries of problem 10: abusive, hateful or sexual content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.abuse import rates, score_documents
from folioscope.sources.tables import table


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and significant passages of every document."""
    return score_documents(table(spark, d, "documents"), table(spark, d, "moderation_labels"))


def found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with such language of their own."""
    return scores(spark, d).where("found").select("doc_id")


def by_source(spark: SparkSession, d: str) -> DataFrame:
    """The rate per source."""
    return rates(score_documents(table(spark, d, "documents"), table(spark, d, "moderation_labels"), carry=("source",)))


def queries() -> dict:
    return {"p10_found": found, "p10_scores": scores, "p10_rates": by_source}


def oracle_sql() -> dict[str, str]:
    return {}
