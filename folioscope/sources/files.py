"""Readers and writers of files: JSON lines, text of unknown encoding, HTML, CSV and directory inventories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.functions.text import decode_bytes, strip_markup


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, tolerant: bool = False, limit: int | None = None) -> DataFrame:
    """JSON lines by a given schema; blank lines are skipped. tolerant drops corrupt lines, else they are an error."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    return rows if limit is None else rows.limit(limit)


def write_jsonl(df: DataFrame, path: str, key: str, force: bool = False) -> bool:
    """JSON lines in the order of the key, keys of an object sorted; whether anything was written: nothing if the rows are the same as before."""
    ordered = df.select(*sorted(df.columns)).repartitionByRange(key).sortWithinPartitions(key)
    return _write_changed(ordered, path, force, lambda w: w.json(path))


def write_store(df: DataFrame, path: str, key: str, force: bool = False) -> bool:
    """Parquet in the order of the key over ranges, so that look-ups by key read a few row groups; nothing if the rows are the same as before."""
    return _write_changed(df.repartitionByRange(key).sortWithinPartitions(key), path, force, lambda w: w.parquet(path))


def _write_changed(df: DataFrame, path: str, force: bool, write: Callable) -> bool:
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    note = jvm.org.apache.hadoop.fs.Path(f"{path}.manifest.json")
    fs = note.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = None
    if fs.exists(note):
        stream = fs.open(note)
        old = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
    same, now = unchanged(df, old)
    if same and not force:
        return False
    fs.delete(note, False)  # a failed write leaves no manifest that would vouch for it
    write(df.write.mode("overwrite"))
    out = fs.create(note, True)
    out.write(bytearray(now.encode()))
    out.close()
    return True


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def inventory(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """path, name, extension, size, modified, sha256, duplicates of all files under a folder, hidden and system files left out.

    max_files keeps the first ones in the order of their paths: a limit that the user sets.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    files = raw.select("path", name.alias("name"), F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    files = files.where(~F.col("name").rlike("^\\.|^Thumbs\\.db$"))
    if max_files is not None:
        files = files.orderBy("path").limit(max_files)
    same = files.groupBy("sha256").agg((F.count("*") - 1).alias("duplicates"))
    return files.join(same, "sha256").select("path", "name", "extension", "size", "modified", "sha256", "duplicates")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of files whose encoding is found by trying (UTF-8, GB 18030, Big5, Latin-1)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", decode_bytes(F.col("content")).alias("text"))


def read_html(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of HTML or XML files without their markup."""
    return read_texts(spark, folder).select("path", strip_markup(F.col("text")).alias("text"))


def segments(texts: DataFrame, key: str, column: str, least: int = 120, target: int = 1100) -> DataFrame:
    """key, n, segment: paragraphs longer than `least`, packed greedily up to about `target` characters."""
    parts = F.filter(F.transform(F.split(column, "\\n\\s*\\n"), lambda p: F.trim(p)), lambda p: F.length(p) > least)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, p):
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        full = (acc["open"] != "") & (F.length(joined) > target)
        return F.struct(F.when(full, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"), F.when(full, p).otherwise(joined).alias("open"))

    packed = F.aggregate(parts, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))
    return texts.select(key, F.posexplode(packed).alias("pos", "segment")).select(key, (F.col("pos") + 1).alias("n"), "segment")


def unchanged(df: DataFrame, manifest: str | None) -> tuple[bool, str]:
    """Whether the content hash of a table equals a manifest's, and the hash: order of rows does not matter."""
    row = df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).first()
    now = f"{row.n}:{row.s}"
    return now == manifest, now
