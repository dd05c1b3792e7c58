"""Orphan references: keys of records that are missing, deleted or loaded only later.

Keys are coded as order-preserving integers over the sorted union of parent and reference keys. The sorted integer
parent keys are compressed into contiguous runs of like state, and references are matched as-of to the preceding run
start. Those beyond its run end are missing; a run of deleted parents makes them deleted; a run whose latest parent was
loaded after a reference may hold late ones, which an exact comparison of load times then settles. Runs end at every
code that no parent has, so that the references' own orphans part them, too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.stages import stage

#: Low bits of a code that count within one range of keys.
BLOCK_BITS = 33


def parent_states(parents: DataFrame, key: str, loaded: str, deleted: str | None) -> DataFrame:
    """One row per parent key: key, first_loaded, deleted. Null keys are no parents."""
    gone = F.max(F.col(deleted).isNotNull()) if deleted else F.max(F.lit(False))
    return parents.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(loaded).alias("first_loaded"), gone.alias("deleted"))


def code_keys(parents: DataFrame, references: DataFrame) -> DataFrame:
    """key, first_loaded, deleted (of parents), loaded (of references) and code: integers in the order of the keys, consecutive within a block of them.

    The keys are range partitioned; a code's high bits name the range, its low BLOCK_BITS count within it.
    """
    none = lambda kind: F.lit(None).cast(kind)
    tagged = parents.select("key", "first_loaded", "deleted", none("timestamp").alias("loaded"), F.lit(False).alias("asked"))
    tagged = tagged.unionByName(references.select("key", none("timestamp").alias("first_loaded"), none("boolean").alias("deleted"), "loaded", F.lit(True).alias("asked")))
    keys = tagged.groupBy("key").agg(F.min("first_loaded").alias("first_loaded"), F.max("deleted").alias("deleted"), F.min("loaded").alias("loaded"), F.max("asked").alias("asked"))
    ordered = keys.repartitionByRange("key").sortWithinPartitions("key").withColumn("code", F.monotonically_increasing_id())
    return stage(ordered, "keys")  # the codes depend on the ranges, which must not be drawn twice


def contiguous_runs(codes: DataFrame) -> DataFrame:
    """block, run_start, run_end, deleted, latest of the parents' codes: gaps and islands of one state within each block."""
    w = Window.partitionBy("block", "deleted").orderBy("code")
    parents = codes.where("deleted is not null").select("code", "deleted", "first_loaded", F.shiftright("code", BLOCK_BITS).alias("block"))
    islands = parents.withColumn("island", F.col("code") - F.row_number().over(w)).groupBy("block", "deleted", "island")
    return islands.agg(F.min("code").alias("run_start"), F.max("code").alias("run_end"), F.max("first_loaded").alias("latest")).drop("island")


def matched_runs(codes: DataFrame) -> DataFrame:
    """key, kind and first_loaded of the reference keys that are missing, deleted or perhaps late (kind null): as-of match to the preceding run start."""
    run = F.struct("run_end", "deleted", "latest")
    runs = contiguous_runs(codes).select("block", F.col("run_start").alias("code"), run.alias("run"))
    refs = codes.where("asked").select(F.shiftright("code", BLOCK_BITS).alias("block"), "code", "key", "loaded", "first_loaded")
    w = Window.partitionBy("block").orderBy("code", F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    at = runs.unionByName(refs, allowMissingColumns=True).withColumn("at", F.last("run", ignorenulls=True).over(w)).where("key is not null")
    beyond = F.col("at").isNull() | (F.col("code") > F.col("at.run_end"))
    kind = F.when(beyond, "missing").when(F.col("at.deleted"), "deleted")
    late = F.col("at.latest") > F.col("loaded")
    return at.withColumn("kind", kind).where(F.col("kind").isNotNull() | late).select("key", "kind", "first_loaded")


def orphan_references(
    records: DataFrame, parents: DataFrame, *, tbl: str, field: str, record: str, parent_key: str = "id", loaded: str = "loaded_at", deleted: str | None = "deleted_at"
) -> DataFrame:
    """tbl, record_id, field, kind, period: one row per reference whose parent is missing, deleted or late.

    A null reference is no case, an empty string is one like any other key. A record delivered more than once
    counts once, with its earliest load; a null load time gives a null period and is never late. Ties and repeated
    rows change nothing, empty tables give no rows (empty parents: every reference is missing), other columns are
    never read. Hot keys: references are first made distinct, and only distinct keys are coded and matched.
    """
    refs = records.where(F.col(field).isNotNull()).groupBy(F.col(record).alias("record_id"), F.col(field).alias("key"))
    refs = refs.agg(F.min(loaded).alias("loaded"))
    asked = records.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("key")).agg(F.min(loaded).cast("timestamp").alias("loaded"))
    states = parent_states(parents, parent_key, loaded, deleted).withColumn("first_loaded", F.col("first_loaded").cast("timestamp"))
    cases = matched_runs(code_keys(states, asked))
    found = refs.join(cases, "key").where(F.col("kind").isNotNull() | (F.col("first_loaded") > F.col("loaded")))
    return found.select(
        F.lit(tbl).alias("tbl"), "record_id", F.lit(field).alias("field"), F.coalesce("kind", F.lit("late")).alias("kind"), F.date_format("loaded", "yyyy-MM").alias("period")
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """References without a live parent per table, field, kind and month."""
    return found.groupBy("tbl", "field", "kind", "period").agg(F.count("*").alias("n"))
