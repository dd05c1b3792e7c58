"""Queries of problem 9: mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.mixing import mixture, mixture_report
from folioscope.sources.tables import table


def mixed(spark: SparkSession, d: str) -> DataFrame:
    """The mixed training blocks of all output shards."""
    return mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def report(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source, with its most repeated block."""
    return mixture_report(*mixture(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def queries() -> dict:
    return {"p9_mix": mixed, "p9_report": report}


def oracle_sql() -> dict[str, str]:
    return {}
