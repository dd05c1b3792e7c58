"""Retrieval: ranks, vectors, fusion, fingerprints and graph expansion."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.stages import stage
from folioscope.functions.text import char_ngrams, compat

#: BM25 saturation and length weight; the constant of reciprocal-rank fusion.
K1, B, RRF = 1.2, 0.75, 60


def ranked(df: DataFrame, query: str, score: str, item: str, k: int) -> DataFrame:
    """The k best per query with their rank; ties by item."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """keys and matrix (doubles, row after row) of whole batches of vectors."""
    kind = dict(vectors.dtypes)[key]

    def pack(batches):
        for b in batches:
            rows = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            keys = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([keys, pa.array([rows.tobytes()], pa.binary())], ["keys", "matrix"])

    return vectors.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector)).mapInArrow(pack, f"keys array<{kind}>, matrix binary")


def vector_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """query, item, score, rank: exact top k of each query vector (query, v) against all other vectors.

    Blocks of vectors meet blocks of queries in a grid: every block of queries goes to each of as many strips as there
    are shuffle partitions, every block of vectors to one, so that no task and no driver holds all queries. Each meeting
    passes on its k best per query only. Null vectors have no score; ties go by item.
    """
    strips = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    items = stage(_packed(vectors, key, vector), "vectors").withColumn("strip", F.pmod(F.monotonically_increasing_id() + F.shiftright(F.monotonically_increasing_id(), 33), F.lit(strips)))
    asked = stage(_packed(queries, "query", "v"), "queries").toDF("names", "wanted").withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))))

    def best(batches):
        for b in batches:
            for row in b.to_pylist():
                items, names = np.array(row["keys"]), np.array(row["names"])
                left = np.frombuffer(row["matrix"]).reshape(len(items), -1)
                scores = np.round(left @ np.frombuffer(row["wanted"]).reshape(len(names), -1).T, 6)
                scores[items[:, None] == names[None, :]] = -np.inf
                least = np.partition(scores, -min(k, len(items)), 0)[-min(k, len(items))]  # ties with the last stay
                at, q = np.nonzero((scores >= least[None, :]) & np.isfinite(scores))
                new = pd.DataFrame({"query": names[q], "item": items[at], "score": scores[at, q]})
                new = new.sort_values(["query", "score", "item"], ascending=[True, False, True]).groupby("query").head(k)
                yield pa.RecordBatch.from_pandas(new, preserve_index=False)

    met = items.join(asked, "strip").select("keys", "matrix", "names", "wanted")
    return ranked(met.mapInArrow(best, f"query {dict(queries.dtypes)['query']}, item {dict(vectors.dtypes)[key]}, score double"), "query", "score", "item", k)


def hashed_vectors(df: DataFrame, key: str, text: str, dims: int = 256, sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """key, v: signed counts of character sequences in hashed slots, of length 1; zeros of a text without characters.

    Slot and sign are bits of the sequence's SHA-256, which SQL engines share.
    """
    t = F.trim(F.regexp_replace(F.lower(compat(F.coalesce(F.col(text), F.lit("")))), "\\s+", " "))
    grams = F.flatten(F.array(*(F.when(F.length("t") >= n, char_ngrams(F.col("t"), n)).otherwise(F.array().cast("array<string>")) for n in sizes)))
    rows = df.select(key, t.alias("t")).select(key, F.explode_outer(grams).alias("g")).withColumn("h", F.sha2("g", 256))
    slot = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dims
    sign = F.when(F.substring("h", 9, 1).isin(*"02468ace"), -1).otherwise(1)
    sums = rows.groupBy(key, slot.alias("slot")).agg(F.sum(sign).alias("x"))
    whole = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("slot", "x")))).alias("m"), F.sqrt(F.sum(F.when(F.col("slot").isNotNull(), F.col("x") * F.col("x")))).alias("norm"))
    cell = lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("norm")).otherwise(0.0)
    return whole.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), cell).alias("v"))


def fused(lists: DataFrame, k: int) -> DataFrame:
    """query, item, score, rank by reciprocal ranks of (query, component, item, rank); scores of components say nothing."""
    score = lists.groupBy("query", "item").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score"))
    return ranked(score, "query", "score", "item", k)


def rank_table(lists: DataFrame, components: list[str]) -> DataFrame:
    """query, item and each component's rank."""
    return lists.groupBy("query", "item").pivot("component", components).agg(F.min("rank"))


def hops(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth: what is reached over undirected edges (a, b), with its least number of steps. Each step is one join."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    edge_of = seen
    for d in range(1, depth + 1):
        reached = edge_of.join(both, edge_of.node == both.a).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(d))
        seen, edge_of = seen.unionByName(reached), reached
    return seen


def paths(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """node, depth, reason: what is reached over undirected edges (a, b), and the first path that leads there, a>b>c."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0)).withColumn("reason", F.col("node"))
    last = seen
    for d in range(1, depth + 1):
        step = last.select(F.col("node").alias("a"), "reason").join(both, "a").groupBy(F.col("b").alias("node")).agg(F.min("reason").alias("via"))
        last = step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(d).alias("depth"), F.concat("via", F.lit(">"), "node").alias("reason"))
        seen = seen.unionByName(last)
    return seen


def fingerprint(c: Column, n: int = 120) -> Column:
    """The first n letters, digits and underscores of a text, case kept: equal for near-identical beginnings."""
    return F.substring(F.regexp_replace(c, "[^\\p{L}\\p{N}_]+", ""), 1, n)
