"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEPT: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder, as parquet; projections and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def file_states(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files under a path: they change when a table does."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found, out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def kept_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A small table kept in memory until its files change; a newer one takes its place."""
    place, now = (spark.sparkContext.applicationId, folder, name), file_states(spark, f"{folder}/{name}.parquet")
    for old in [k for k in _KEPT if k[:3] == place and k[3] != now]:
        _KEPT.pop(old).unpersist()
    if (*place, now) not in _KEPT:
        _KEPT[(*place, now)] = table(spark, folder, name).persist()
    return _KEPT[(*place, now)]


def look_up(df: DataFrame, key: str, wanted: object) -> dict | None:
    """The row of a key, None if there is none: nothing is made up. The filter reaches the scan."""
    rows = df.where(F.col(key) == F.lit(wanted)).limit(1).collect()
    return rows[0].asDict(recursive=True) if rows else None
