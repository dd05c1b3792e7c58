"""Queries of problem 8: encoding of the whole corpus with a public tokenizer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.transducer import encode_corpus, token_totals
from folioscope.sources.tables import table


def ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def totals(spark: SparkSession, d: str) -> DataFrame:
    """Documents, tokens and exact round trips per source."""
    return token_totals(table(spark, d, "documents"), "source")


def queries() -> dict:
    return {"p8_ids": ids, "p8_totals": totals}


def oracle_sql() -> dict[str, str]:
    return {}
