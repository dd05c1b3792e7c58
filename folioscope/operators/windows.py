"""Ordered operators: sequences, contexts, caps, interleaving and samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.stages import stage


def numbered(df: DataFrame, group: list[str], order: list, name: str = "seq") -> DataFrame:
    """1, 2, ... within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def numbered_evenly(df: DataFrame, group: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """1, 2, ... within each group, however large one is: no task holds more than a range of its rows.

    Rows are range-partitioned by group and order and counted where they stand; per range and group only the count goes
    into a running sum. Rows equal in group and order are numbered in any order.
    """
    keys = [*group, *order]
    placed = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    counts = placed.groupBy("_range", *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group))).agg(F.count("*").alias("_n"), F.min("_at").alias("_from"))
    names = [f"_g{i}" for i in range(len(group))]
    earlier = F.coalesce(F.sum("_n").over(Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("_range", *names, (earlier - F.col("_from") + 1).alias("_shift")).withColumnRenamed("_range", "_r")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)], F.col("_range") == F.col("_r"))
    return placed.join(shifts, same).withColumn(name, F.col("_at") + F.col("_shift")).drop("_range", "_at", "_r", "_shift", *names)


def first_n(df: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; the window's row_number limit is pushed below the shuffle by the optimizer."""
    return numbered(df, group, order, "_n").where(F.col("_n") <= n).drop("_n")


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first in the order."""
    return first_n(df, key, order, 1)


def context(df: DataFrame, targets: DataFrame, key: str, group: str, order: str, radius: int) -> DataFrame:
    """target, neighbour, distance: rows of the same group at most radius places from each target."""
    placed = numbered_evenly(df.select(group, key, *([order] if order != key else [])), [group], [order], "_n")
    at = placed.join(targets.select(F.col(key).alias("_t")).distinct(), F.col(key) == F.col("_t"), "left_semi").select(F.col(key).alias("target"), F.col(group).alias("_g"), F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("distance"), F.col("_n").alias("_at"))
    # The place is a join key, so that a long group is spread over many tasks.
    at = at.withColumn("_n", F.col("_at") + F.col("distance"))
    return at.join(placed.select(F.col(group).alias("_g"), "_n", F.col(key).alias("neighbour")), ["_g", "_n"]).select("target", "neighbour", "distance")


def neighbours(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds has_prev and has_next; groups of any size are numbered by ranges."""
    most = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_most"))
    placed = numbered_evenly(df, [group], [order], "_n").join(most, F.col(group).eqNullSafe(F.col("_g")))
    return placed.withColumn("has_prev", F.col("_n") > 1).withColumn("has_next", F.col("_n") < F.col("_most")).drop("_g", "_n", "_most")


def capped(df: DataFrame, query: str, group: str, rank: str, most: int) -> DataFrame:
    """At most `most` rows per query and group, the best ranked; ranks are numbered anew."""
    kept = first_n(df, [query, group], [rank], most)
    return kept.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(rank)))


def diversified(df: DataFrame, query: str, group: str, rank: str, item: str, most_in_row: int, top: int) -> DataFrame:
    """query, items: the greedy selection in rank order that never takes more than most_in_row of one group in a row."""
    kept = diversify(df.withColumn("_fp", F.col(item).cast("string")), query, rank, item, "_fp", item, group, top, session_limit=None, streak=most_in_row).where("reason is null")
    return kept.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, F.col(item).cast("string").alias("i")))), lambda x: x["i"]).alias("items"))


def diversify(df: DataFrame, query: str, rank: str, item: str, fingerprint: str, session: str, group: str, top: int, session_limit: int | None = 3, streak: int | None = None) -> DataFrame:
    """query, rank, item, reason: a greedy selection in rank order until `top` are kept; reason tells why one was dropped.

    'near_duplicate': a kept one has the fingerprint; 'session_concentration': session_limit kept ones share the
    session; 'streak': the last `streak` kept ones share the group. What was dropped registers nothing. A query's ranked
    list is bounded by its retrieval limit; the fold runs inside the JVM.
    """
    cell = F.struct(F.col(rank).alias("r"), F.col(item).alias("i"), F.col(fingerprint).alias("f"), F.col(session).cast("string").alias("s"), F.col(group).cast("string").alias("g"))
    rows = df.groupBy(query).agg(F.array_sort(F.collect_list(cell)).alias("l"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = f"array<struct<r: {kinds[rank]}, i: {kinds[item]}, reason: string>>"
    none = lambda kind: F.array().cast(kind)
    start = F.struct(none(out).alias("out"), none(f"array<{kinds[fingerprint]}>").alias("seen"), none("array<string>").alias("sessions"), none("array<string>").alias("groups"))

    def step(acc: Column, x: Column) -> Column:
        full = F.size(acc["groups"]) >= top
        reason = F.when(F.array_contains(acc["seen"], x["f"]), "near_duplicate")
        if session_limit is not None:
            reason = reason.when(F.size(F.filter(acc["sessions"], lambda s: s == x["s"])) >= session_limit, "session_concentration")
        if streak is not None:
            last = F.slice(acc["groups"], F.greatest(F.size(acc["groups"]) - (streak - 1), F.lit(1)), streak)
            reason = reason.when((F.size(acc["groups"]) >= streak) & F.forall(last, lambda g: g.eqNullSafe(x["g"])), "streak")
        take = ~full & reason.isNull()
        add = lambda name, value: F.when(take, F.concat(acc[name], F.array(value))).otherwise(acc[name]).alias(name)
        row = F.array(F.struct(x["r"].alias("r"), x["i"].alias("i"), reason.alias("reason")))
        return F.struct(F.when(full, acc["out"]).otherwise(F.concat(acc["out"], row)).alias("out"), add("seen", x["f"]), add("sessions", x["s"]), add("groups", x["g"]))

    return rows.select(query, F.inline(F.aggregate("l", start, step)["out"])).select(query, F.col("r").alias(rank), F.col("i").alias(item), "reason")


def interleaved(df: DataFrame, query: str, lane: str, rank: str, item: str) -> DataFrame:
    """query, item, rank: lanes taken in turn, rank by rank; an item counts at its first place."""
    first = df.groupBy(query, item).agg(F.min(F.struct(rank, lane)).alias("_at"))
    return first.select(query, item, F.row_number().over(Window.partitionBy(query).orderBy(F.col("_at")[rank], F.col("_at")[lane], item)).alias("rank"))


def hash_sample(df: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """n rows per stratum in the order of their keys' SHA-256: the same on every run."""
    return first_n(df.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)), strata, ["_h", key], n).drop("_h")
