"""Retrieval metrics over ranked lists (query, item, rank) and gold (query, item, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.operators.retrieval import RRF


def metrics(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """query, recall, hit, mrr, ndcg at k of every query of the gold; a query without results has zeros."""
    top = run.where(F.col("rank") <= k)
    g = gold.groupBy("query", "item").agg(F.max("grade").alias("grade"))
    joined = g.join(top.select("query", "item", "rank"), ["query", "item"], "left")
    ideal = g.withColumn("i", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "item"))).where(F.col("i") <= k)
    ideal = ideal.groupBy("query").agg(F.sum((F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("i") + 1.0)).alias("idcg"))
    gain = F.when(F.col("rank").isNotNull(), (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    per = joined.groupBy("query").agg(
        F.round(F.count("rank") / F.count("*"), 6).alias("recall"), F.max(F.col("rank").isNotNull().cast("int")).alias("hit"), F.round(F.coalesce(F.max(1.0 / F.col("rank")), F.lit(0.0)), 6).alias("mrr"), F.sum(gain).alias("dcg")
    )
    return per.join(ideal, "query").select("query", "recall", "hit", "mrr", F.round(F.col("dcg") / F.col("idcg"), 6).alias("ndcg"))


def macro(per_query: DataFrame) -> DataFrame:
    """Means over queries; nulls are left out."""
    return per_query.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("recall", "hit", "mrr", "ndcg")), F.count("*").alias("queries"))


def lift(per_query: DataFrame, gold: DataFrame, n_items: int, k: int = 10) -> DataFrame:
    """query, recall, baseline, lift: against k draws out of n_items."""
    return per_query.select("query", "recall", F.lit(round(k / n_items, 6)).alias("baseline"), F.round(F.col("recall") * n_items / k, 3).alias("lift"))


def top1(run: DataFrame, gold: DataFrame, classes: DataFrame) -> DataFrame:
    """class, queries, top1: how often the first hit is gold, by class (query, class); queries without results count as missed."""
    first = run.where("rank = 1").join(gold.select("query", "item").distinct(), ["query", "item"], "left_semi").select("query", F.lit(1).alias("hit"))
    return classes.join(first, "query", "left").groupBy("class").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("top1"))


def leave_one_out(lists: DataFrame, gold: DataFrame, components: list[str], k: int) -> DataFrame:
    """component, marginal: mean recall at k of all components fused less that without the component. All sets are fused in one pass."""
    spark = lists.sparkSession
    sets = {"": components, **{c: [x for x in components if x != c] for c in components}}
    cfg = spark.createDataFrame([(name, c) for name, cs in sets.items() for c in cs], "config string, component string")
    score = lists.join(cfg, "component").groupBy("config", "query", "item").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"))
    top = score.withColumn("rank", F.row_number().over(Window.partitionBy("config", "query").orderBy(F.desc("score"), "item"))).where(F.col("rank") <= k)
    size = gold.groupBy("query").agg(F.count("*").alias("size"))
    hits = top.join(gold, ["query", "item"], "left_semi").groupBy("config", "query").agg(F.count("*").alias("hits"))
    every = size.withColumn("config", F.explode(F.array(*map(F.lit, sets))))
    recall = every.join(hits, ["config", "query"], "left").groupBy("config").agg(F.avg(F.coalesce("hits", F.lit(0)) / F.col("size")).alias("recall"))
    whole = F.max(F.when(F.col("config") == "", F.col("recall"))).over(Window.partitionBy())  # a row per set
    return recall.withColumn("whole", whole).where("config <> ''").select(F.col("config").alias("component"), F.round(F.col("whole") - F.col("recall"), 6).alias("marginal"))


def lane_recall(run: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """lane, size, recall at k against the smaller of k and the lane's gold."""
    size = gold.groupBy("lane").agg(F.count("*").alias("size"))
    hits = run.where(F.col("rank") <= k).join(gold, ["lane", "item"], "left_semi").groupBy("lane").agg(F.count("*").alias("hits"))
    return size.join(hits, "lane", "left").select("lane", "size", F.round(F.coalesce("hits", F.lit(0)) / F.least(F.lit(k), F.col("size")), 6).alias("recall"))
