"""Streams: deduplicated ingestion of deliveries, sessions of activity, windowed counts and upserts."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of an upserted table: a batch rewrites only those that it touches.
BUCKETS = 64


def deliveries(stream: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """Each key once within the watermark: later deliveries of a row are dropped, state is bounded by `late`."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def window_counts(stream: DataFrame, at: str, by: str, size: str, late: str) -> DataFrame:
    """start, by, n of tumbling windows; rows later than `late` are left out."""
    w = F.window(at, size)
    return stream.withWatermark(at, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(stream: DataFrame, user: str, at: str, gap: str, late: str) -> DataFrame:
    """user, start, n of runs of activity without a gap."""
    w = F.session_window(at, gap)
    return stream.withWatermark(at, late).groupBy(user, w).agg(F.count("*").alias("n")).select(user, F.col("session_window.start").alias("start"), "n")


class Versions:
    """Which version of each bucket of a table counts: one small manifest per epoch, which appears at once or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def latest(self, before: int | None = None) -> dict[int, int]:
        """Bucket -> epoch of the newest manifest, or of the newest one before an epoch; empty if there is none."""
        folder = self._path("manifests")
        if not self.fs.exists(folder):
            return {}
        epochs = [int(n[:-5]) for f in self.fs.listStatus(folder) if (n := f.getPath().getName()).endswith(".json") and n[:-5].isdigit()]
        epochs = [e for e in epochs if before is None or e < before]
        if not epochs:
            return {}
        stream = self.fs.open(self._path(f"manifests/{max(epochs):012d}.json"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return {int(k): v for k, v in json.loads(text).items()}

    def commit(self, epoch: int, versions: dict[int, int]) -> None:
        """Writes the epoch's manifest under another name and renames it."""
        draft, final = self._path(f"manifests/{epoch}.draft"), self._path(f"manifests/{epoch:012d}.json")
        out = self.fs.create(draft, True)
        try:
            out.write(bytearray(json.dumps(versions).encode()))
        finally:
            out.close()
        self.fs.delete(final, False)
        if not self.fs.rename(draft, final):
            raise OSError(f"cannot commit epoch {epoch} under {self.path}")


def current(spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
    """The upserted table, or the given buckets of it as they were before an epoch; None if there is nothing yet."""
    versions = Versions(spark, path).latest(before)
    folders = [f"{path}/bucket={b}/epoch={e}" for b, e in sorted(versions.items()) if buckets is None or b in buckets]
    return spark.read.option("mergeSchema", True).parquet(*folders) if folders else None


def upsert(path: str, key: str, order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the latest row per key under path, read by `current`.

    A bucket's rows are written as a new version beside the old one, and a manifest switches to it: whatever fails
    before leaves the old table, and a batch that is run again writes the same. Columns may come and go. Null keys are
    a key; of rows equal in the order column any one stays.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        rows = batch.withColumn("_bucket", bucket).persist()
        try:
            touched = sorted(r[0] for r in rows.select("_bucket").distinct().collect())  # a number per bucket
            if not touched:
                return
            store = Versions(spark, path)
            versions = store.latest(before=epoch)
            old = current(spark, path, epoch, touched)
            every = rows if old is None else old.withColumn("_bucket", bucket).unionByName(rows, allowMissingColumns=True)
            columns = [c for c in every.columns if c != "_bucket"]
            latest = every.groupBy("_bucket", key).agg(F.max_by(F.struct(*columns), F.struct(F.col(order).isNotNull(), order)).alias("r")).select("_bucket", "r.*").persist()
            try:
                placed = latest.withColumn("bucket", F.col("_bucket")).withColumn("epoch", F.lit(epoch)).drop("_bucket")
                placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(path)
                store.commit(epoch, {**versions, **{b: epoch for b in touched}})
            finally:
                latest.unpersist()
        finally:
            rows.unpersist()

    return apply
