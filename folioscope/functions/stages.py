"""Cutting lineage: stage tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where a local session sets none, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="folioscope-stages-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


@atexit.register
def _clear() -> None:
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a stage table and read it back, so that later plans start from files that survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    staged = spark.read.schema(df.schema).parquet(path)
    staged._stage = path
    return staged


def drop_stage(*stages: DataFrame) -> None:
    """Delete stage tables that nothing reads any more, as soon as what was made of them is written itself."""
    for df in stages:
        path = getattr(df, "_stage", None)
        if path is not None:
            _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]
            _delete(df.sparkSession, path)
