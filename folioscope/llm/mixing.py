"""Mixing sources to target weights (problem 9).

Token ids are packed into fixed-length blocks. Every output shard draws its counts of slots per source; a slot's
ordinal is mapped through its source's pseudorandom index permutation, and blocks join the slots by index. The shards
are split among sources down a binary tree of seeded draws, so that each task draws its own shards by itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.stages import stage
from folioscope.llm.arrow import mix
from folioscope.llm.transducer import encode_corpus

#: Tokens of a block, slots of a shard, documents packed together, seed.
BLOCK, SHARD, PACK, SEED = 256, 1024, 4096, 42
#: Shards that a task draws at once; counts under which the library draws hypergeometric numbers.
SHARDS, EXACT = 256, 500_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def pack(tokens: DataFrame, docs: dict[str, int], block: int = BLOCK, per_pack: int = PACK) -> DataFrame:
    """Stage table source, block (0, 1, ... per source), tokens, n of (doc_id, source, ids).

    Documents are spread by hash over packs of about per_pack, each cut into blocks by itself (its last may be short),
    so that a source of any size is packed in parallel; documents without tokens fill nothing. docs tells about how many
    documents each source has.
    """
    packs = F.lit(1)
    for source, n in sorted(docs.items()):
        packs = F.when(F.col("source") == source, max(1, math.ceil(n / per_pack))).otherwise(packs)
    placed = tokens.where(F.size("ids") > 0).withColumn("pack", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), packs.cast("long")))
    per = Window.partitionBy("source", "pack").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id", "ids")
    placed = placed.withColumn("end", F.sum(F.size("ids")).over(per.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.size("ids"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block)
    pieces = placed.withColumn("b", F.explode(F.sequence(first, last))).withColumn("from", F.greatest(F.col("start"), F.col("b") * block))
    pieces = pieces.select("source", "pack", "b", "from", F.slice("ids", (F.col("from") - F.col("start") + 1).cast("int"), (F.least("end", (F.col("b") + 1) * block) - F.col("from")).cast("int")).alias("ids"))
    cut = pieces.groupBy("source", "pack", "b").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("from", "ids"))), lambda x: x["ids"])).alias("tokens"))
    cut = stage(cut, "cut")
    counts = cut.groupBy("source", "pack").agg(F.count("*").alias("n"))
    offset = F.sum("n").over(Window.partitionBy("source").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("source", "pack", F.coalesce(offset, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("source", "pack").orderBy("b")) - 1
    return cut.withColumn("rank", rank).join(offsets, ["source", "pack"]).select("source", (F.col("offset") + F.col("rank")).alias("block"), "tokens", F.size("tokens").alias("n"))


def plan(supply: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """source, target_share, max_repeats, blocks, mean and slots: as many slots as the scarcest source allows.

    supply has source, blocks, tokens. A slot of a source holds its blocks' mean tokens, so slots are shared out by
    target_share / mean. Sources without tokens, and null or non-positive shares or repeats, get no slots.
    """
    t = targets.dropna(subset=["source"]).drop_duplicates("source").merge(supply, "left", "source")
    t["blocks"] = t.blocks.fillna(0).astype(int)
    t["tokens"] = t.tokens.fillna(0).astype(int)
    t["max_repeats"] = t.max_repeats.fillna(0).clip(lower=0).astype(int)
    use = (t.target_share.fillna(0) > 0) & (t.blocks > 0) & (t.max_repeats > 0)
    t["mean"] = (t.tokens / t.blocks.clip(lower=1)).where(use, 1.0)
    if not use.any():
        return t.assign(slots=0)
    most = (t.tokens * t.max_repeats / t.target_share)[use].min()
    t["slots"] = np.minimum(np.floor(most * t.target_share.fillna(0) / t["mean"]).where(use, 0), t.blocks * t.max_repeats).astype(int)
    return t


def _share_out(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind are among n drawn without replacement; where the library's draw ends, by its normal law."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for k, c in enumerate(counts.tolist()):
        left -= c
        least, most = max(0, n - left), min(c, n)
        if least == most:
            x = least
        elif max(c, left) < EXACT:
            x = int(rng.hypergeometric(c, left, n))
        else:
            whole = c + left
            spread = math.sqrt(n * (c / whole) * (left / whole) * ((whole - n) / max(whole - 1, 1)))
            x = min(most, max(least, round(n * (c / whole) + spread * rng.standard_normal())))
        out[k] = x
        n -= x
    return out


def draw_shards(slots: np.ndarray, first: int, last: int, shard: int = SHARD, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Counts of slots per shard and source, of the shards from first to before last, and how many come before them.

    Each shard's counts are multinomial given what is left to draw: drawing without replacement keeps the totals, and so
    the shares and the repeats, exact. A node of the tree splits its slots among its halves by a draw of its own seed,
    so that any range of shards is drawn in time of its length and the tree's depth, the same by every task.
    """
    total = int(slots.sum())
    counts, starts = np.zeros((last - first, len(slots)), np.int64), np.zeros((last - first, len(slots)), np.int64)
    nodes = [(0, -(-total // shard), slots.astype(np.int64), np.zeros(len(slots), np.int64))]
    while nodes:
        lo, hi, own, before = nodes.pop()
        if hi <= first or lo >= last or lo >= hi:
            continue
        if hi - lo == 1:
            counts[lo - first], starts[lo - first] = own, before
            continue
        middle = (lo + hi) // 2
        left = _share_out(own, (middle - lo) * shard, np.random.default_rng([seed, lo, hi]))
        nodes += [(lo, middle, left, before), (middle, hi, own - left, before + left)]
    return counts, starts


def permute(ordinal: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 per key: a Feistel network that walks its cycle until inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, todo = ordinal.astype(np.uint64), np.arange(len(ordinal))
    while len(todo):
        left, right = x[todo] >> half[todo], x[todo] & mask[todo]
        for r in range(4):
            f = mix((right + np.uint64((r + 1) * int(_MULT) % 2**64)) ^ key[todo]) & mask[todo]
            left, right = right, left ^ f
        x[todo] = (left << half[todo]) | right
        todo = todo[x[todo] >= n[todo].astype(np.uint64)]
    return x.astype(np.int64)


def slots_of(spark, planned: pd.DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """shard, source, ordinal's repeat and block of every output slot. The driver holds a row per source only."""
    p = planned.reset_index(drop=True)
    slots, sources, size = p.slots.to_numpy(np.int64), p.source.tolist(), p.blocks.to_numpy(np.int64)
    shards = -(-int(slots.sum()) // shard)

    def expand(batches):
        for batch in batches:
            runs = batch.column(0).to_numpy()
            for run in runs.tolist():
                first, last = run * SHARDS, min(shards, (run + 1) * SHARDS)
                counts, starts = draw_shards(slots, first, last, shard, seed)
                s, k = np.nonzero(counts)
                count = counts[s, k]
                at = np.repeat(np.arange(len(s)), count)
                ordinal = starts[s, k][at] + np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
                code = k[at]
                n = size[code]
                repeat = ordinal // n
                key = mix(((repeat.astype(np.uint64) << np.uint64(20)) + code.astype(np.uint64) + np.uint64(seed)) * _MULT)
                names = pa.array(sources, pa.string()).take(pa.array(code))
                yield pa.RecordBatch.from_pydict({"shard": s[at] + first, "source": names, "repeat": pa.array(repeat, pa.int32()), "block": permute(ordinal % n, n, key)})

    return spark.range(-(-shards // SHARDS)).mapInArrow(expand, "shard long, source string, repeat int, block long")


def mixture(documents: DataFrame, targets: DataFrame, key: str = "doc_id", column: str = "text", block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, pd.DataFrame]:
    """The mixed blocks (shard, source, repeat, block, tokens, n) and the plan behind them.

    Every source has its target share of the tokens as closely as whole blocks allow, and none of its blocks is used
    more often than max_repeats. Null and empty texts hold no tokens; documents of null or untargeted sources are left
    out; repeated rows are documents of their own; without documents or targets nothing comes out. targets is a fixed
    small table.
    """
    spark = documents.sparkSession
    wanted = documents.select(F.col(key).alias("doc_id"), F.col("source"), F.col(column).alias("text")).join(targets.select("source").distinct(), "source", "left_semi")
    docs = {r.source: r.n for r in wanted.where("text <> ''").groupBy("source").agg(F.count("*").alias("n")).collect()}  # a row per targeted source
    blocks = stage(pack(encode_corpus(wanted, "doc_id", "text", carry=("source",)), docs, block), "blocks")
    supply = blocks.groupBy("source").agg(F.count("*").alias("blocks"), F.sum("n").alias("tokens")).toPandas()
    planned = plan(supply, targets.select("source", "target_share", "max_repeats").toPandas())
    return slots_of(spark, planned, shard, seed).join(blocks, ["source", "block"]).select("shard", "source", "repeat", "block", "tokens", "n"), planned


def mixture_report(mixed: DataFrame, planned: pd.DataFrame) -> DataFrame:
    """source, target_share, share, tokens, blocks, most_repeats, max_repeats of the mixture."""
    spark = mixed.sparkSession
    uses = mixed.groupBy("source", "block").agg(F.count("*").alias("uses"), F.sum("n").alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"), F.sum("uses").alias("blocks"), F.max("uses").alias("most_repeats"))
    plans = spark.createDataFrame(planned[["source", "target_share", "max_repeats"]].values.tolist(), "source string, target_share double, max_repeats int")
    total = Window.partitionBy()
    out = plans.join(uses, "source", "left").select("source", "target_share", "max_repeats", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "blocks", "most_repeats")))
    return out.withColumn("share", F.round(F.col("tokens") / F.sum("tokens").over(total), 6))
