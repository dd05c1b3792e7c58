"""Near-duplicate records by a chosen-path join (problem 7).

A text's set of distinct character sequences is embedded into a min-hash signature. Per run, a record walks down
paths: a path's pseudorandom draw samples signature coordinates, and the record follows each with its own value, so
that similar records meet on the same path. Small buckets of records on one path are compared by brute force
(first by sketch, then exactly); larger ones are split further, and whatever stays together down to the last level
is compared in full by a skew-split join. Each level parts some similar records, so those that descend further get
more runs.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.stages import drop_stage, stage
from folioscope.llm.arrow import code_points, map_batches, mix
from folioscope.llm.lookalike import LEAST, corpus_classes, rewriter

#: Length of the character sequences and the least similarity of a pair.
SHINGLE, SIMILARITY = 5, 0.6
#: Signature coordinates, levels of the first descent and of each further one, most levels.
COORDINATES, FIRST_LEVELS, MORE_LEVELS, MOST_LEVELS = 128, 3, 1, 8
#: Coordinates that a node follows, times the least similarity: under 1 a run dies out more often, but the runs that the
#: recall then needs write fewer paths together (24 a record after three levels, 37 with 1; 139 and 321 after six).
BRANCHING = 0.5
#: Expected share of pairs at the least similarity that meet, at whatever level their buckets end.
RECALL = 0.97
#: Buckets up to this many records are compared at once; larger ones are split further.
SMALL = 1024
#: Sketch bits in which a pair may differ; at similarity 0.6, 128 bits differ in 25.6 on average with deviation 4.3.
SKETCH_BITS, MOST_DIFFERENT = 128, 41
#: The same for texts with fewer filled bins than this, whose bits deviate more (5.5 for 45 sequences).
FEW_BINS = {60: 46, 90: 43}
#: Bits of a path's hash: shuffled rows compress better, while strangers hardly ever share a path.
PATH_BITS = 44
_MULT = np.uint64(0x9E3779B97F4A7C15)


def skeleton(form: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(filter(str.isalnum, form.lower()))


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each sequence, repeats included, and the index of its text."""
    points, offsets = code_points(texts)
    m = len(points) - SHINGLE + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        h *= np.uint64(1_000_003)
        h += points[k : k + m]
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    inside = owner[:m] == owner[SHINGLE - 1 :]
    return mix(h[inside]), owner[:m][inside]


def signatures(texts: list[str]) -> np.ndarray:
    """One-permutation min-hash of each text's set, texts x COORDINATES; an empty bin borrows from the next filled one."""
    return _signatures(texts)[0]


def _signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the number of filled bins."""
    h, owner = shingle_hashes(texts)
    n, none = len(texts), np.uint64(2**64 - 1)
    sig = np.full(n * COORDINATES, none)
    np.minimum.at(sig, owner * COORDINATES + (h & np.uint64(COORDINATES - 1)).astype(np.int64), h)
    sig = sig.reshape(n, COORDINATES)
    filled = sig != none
    twice = np.where(np.concatenate([filled, filled], 1), np.arange(2 * COORDINATES), 2 * COORDINATES)
    nearest = np.minimum.accumulate(twice[:, ::-1], 1)[:, ::-1][:, :COORDINATES]
    sig = np.take_along_axis(sig, nearest % COORDINATES, 1)
    return sig + (nearest - np.arange(COORDINATES)).astype(np.uint64) * _MULT, filled.sum(1)


def most_different(filled: np.ndarray) -> np.ndarray:
    """Sketch bits in which a text may differ from a similar one, by its number of filled bins."""
    return np.select([filled < few for few in FEW_BINS], list(FEW_BINS.values()), MOST_DIFFERENT).astype(np.int8)


def sketches(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of one bit per coordinate."""
    bits = (mix(sig * _MULT + np.arange(COORDINATES, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    words = np.packbits(bits, axis=1).view(np.int64)
    return words[:, 0], words[:, 1]


@lru_cache(4)
def _draws(similarity: float) -> np.ndarray:
    """Distribution of the number of draws at a node. Poisson draws with replacement follow each coordinate independently."""
    rate = -COORDINATES * math.log1p(-BRANCHING / (similarity * COORDINATES))
    return np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(16)])


def _followed(path: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index of the node and coordinate of everything that the nodes follow, each coordinate once; a node is a path."""
    share = (mix(path ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    count = np.searchsorted(_draws(similarity), share)
    nodes, coords = [], []
    earlier: list[np.ndarray] = []
    for k in range(int(count.max(initial=0))):
        c = (mix((path + np.uint64(k + 1)) * _MULT) >> np.uint64(64 - COORDINATES.bit_length() + 1)).astype(np.int64)
        new = count > k
        for e in earlier:
            new &= c != e
        earlier.append(c)
        nodes.append(np.flatnonzero(new))
        coords.append(c[new])
    return (np.concatenate(nodes), np.concatenate(coords)) if nodes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _next(path: np.ndarray, coord: np.ndarray, value: np.ndarray) -> np.ndarray:
    return mix((path ^ (coord.astype(np.uint64) + np.uint64(1)) * _MULT) * np.uint64(0xBF58476D1CE4E5B9) + value) >> np.uint64(64 - PATH_BITS)


def descend(sig: np.ndarray, owner: np.ndarray, path: np.ndarray, levels: int, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Owners and paths `levels` further down; each node is followed by BRANCHING/similarity coordinates on average."""
    for _ in range(levels):
        node, c = _followed(path, similarity)
        owner = owner[node]
        path = _next(path[node], c, sig[owner, c])
    return owner, path


def first_paths(sig: np.ndarray, runs: int, levels: int = FIRST_LEVELS, similarity: float = SIMILARITY, done: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Owners and paths of the runs from `done` on after the first descent. Nobody has parted at the roots."""
    n = len(sig)
    roots = mix((np.arange(done, runs, dtype=np.uint64) + np.uint64(77)) * _MULT)
    run, c = _followed(roots, similarity)
    owner = np.tile(np.arange(n), len(run))
    path = _next(np.repeat(roots[run], n), np.repeat(c, n), sig.T[c].ravel())
    return descend(sig, owner, path, levels - 1, similarity)


def runs_for(levels: int, similarity: float = SIMILARITY, recall: float | None = None) -> int:
    """Runs after which pairs of the least similarity have met `levels` down with the recall wanted (RECALL).

    How many coordinates a pair has in common is binomial; each is followed with probability BRANCHING/(similarity * COORDINATES).
    """
    common = np.arange(COORDINATES + 1)
    weight = np.array([math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in common])
    met = np.ones(COORDINATES + 1)
    for _ in range(levels):
        met = 1 - (1 - met * BRANCHING / (similarity * COORDINATES)) ** common
    lost, runs = 1 - (RECALL if recall is None else recall), 1
    while weight @ (1 - met) ** runs > lost:
        runs *= 2
    low = runs // 2
    while runs - low > 1:
        middle = (low + runs) // 2
        low, runs = (low, middle) if weight @ (1 - met) ** middle <= lost else (middle, runs)
    return runs


def _u(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def fingerprints(texts: DataFrame, key: str, column: str, least: int = LEAST) -> DataFrame:
    """Stage table id, code (64-bit hash of the skeleton), s1, s2 (sketch), most (bits that may differ), skeleton of every text that counts."""
    classes = corpus_classes(texts, column)

    def make():
        form = rewriter(classes)

        def step(b: pa.RecordBatch):
            rows = [(i, s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None and t and len(t) >= least and len(s := skeleton(form(t))) >= least]
            if not rows:
                return None
            ids, texts = zip(*rows)
            sig, filled = _signatures(list(texts))
            s1, s2 = sketches(sig)
            codes = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(codes), pa.array(s1), pa.array(s2), pa.array(most_different(filled)), pa.array(texts, pa.string())], ["id", "code", "s1", "s2", "most", "skeleton"])

        return step

    source = texts.select(F.col(key).cast("string").alias("id"), column)
    return stage(map_batches(source, "id string, code long, s1 long, s2 long, most byte, skeleton string", make), "fingerprints")


def _walk(records: DataFrame, levels: int, runs: int = 0, done: int = 0) -> DataFrame:
    """code, path of records (code, skeleton, and the paths reached so far, or none at the start of the runs from `done` on)."""
    further = "paths" in records.columns

    def make():
        def step(b: pa.RecordBatch):
            codes, sig = _u(b.column(0)), signatures(b.column(1).to_pylist())
            if further:
                counts = pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
                owner, path = descend(sig, np.repeat(np.arange(len(codes)), counts), _u(b.column(2).flatten()), levels)
            else:
                owner, path = first_paths(sig, runs, levels, done=done)
            return pa.RecordBatch.from_arrays([pa.array(codes[owner].view(np.int64)), pa.array(path.view(np.int64))], ["code", "path"])

        return step

    return map_batches(records, "code long, path long", make)


def _buckets(paths: DataFrame) -> DataFrame:
    """Stage table code, path, n of paths on which several records met; those that met nobody are settled.

    Paths are counted by an aggregation, whose partial counts leave a hot path one row a task, and joined back, where
    AQE splits it.
    """
    walked = stage(paths, "paths")
    met = walked.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stage(walked.join(met, "path").select("code", "path", "n"), "buckets")
    drop_stage(walked)
    return buckets


def _close(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """a < b of records on one path whose sketches agree as much as similar records' do."""
    drawn = rows.join(prints, "code")
    a = drawn.select("path", F.col("code").alias("a"), F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("most").alias("am"))
    b = drawn.select("path", F.col("code").alias("b"), F.col("s1").alias("b1"), F.col("s2").alias("b2"), F.col("most").alias("bm"))
    near = F.expr("bit_count(a1 ^ b1) + bit_count(a2 ^ b2) <= greatest(am, bm)")
    return a.join(b, "path").where((F.col("a") < F.col("b")) & near).select("a", "b")


def unique_texts(prints: DataFrame) -> DataFrame:
    """Stage table uid, code, s1, s2, most, skeleton: one row per skeleton, with a short number that is shuffled in its stead."""
    return stage(prints.select("code", "s1", "s2", "most", "skeleton").dropDuplicates(["code"]).withColumn("uid", F.monotonically_increasing_id()), "unique")


def candidate_pairs(unique: DataFrame) -> DataFrame:
    """Distinct pairs a < b of uids that met in a bucket of the chosen-path recursion."""
    sketch = unique.select(F.col("uid").alias("code"), "s1", "s2", "most")
    texts = unique.select(F.col("uid").alias("code"), "skeleton")
    found = []

    def settle(paths: DataFrame) -> DataFrame:
        """The large buckets of the paths; the small ones are compared."""
        buckets = _buckets(paths)
        found.append(_close(buckets.where(F.col("n") <= SMALL), sketch))
        return buckets.where(F.col("n") > SMALL)

    runs, levels = runs_for(FIRST_LEVELS), FIRST_LEVELS
    large = settle(_walk(texts, FIRST_LEVELS, runs))
    while levels < MOST_LEVELS and not large.isEmpty():
        # Whoever descends further gets more runs; those lead down to the new level at once.
        levels += MORE_LEVELS
        reached = large.groupBy("code").agg(F.collect_list("path").alias("paths"))
        deeper = texts.join(reached, "code").select("code", "skeleton", "paths")
        more = runs_for(levels)
        again = _walk(deeper.select("code", "skeleton"), levels, more, runs)
        large, runs = settle(_walk(deeper, MORE_LEVELS).unionByName(again)), more
    found.append(_close(large, sketch))
    return reduce(DataFrame.unionByName, found).distinct()


def similar_pairs(unique: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b (uids), similarity of the candidate pairs that an exact count of shared sequences confirms."""
    pairs = stage(candidate_pairs(unique), "candidates")
    wanted = pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))).distinct()
    texts = unique.select("uid", "skeleton").join(wanted, "uid", "left_semi")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def make():
        def grams(t: str) -> set[str]:
            return {t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)}

        def step(b: pa.RecordBatch):
            value = np.zeros(b.num_rows)
            for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = grams(x), grams(y)
                n = len(x & y)
                value[k] = n / (len(x) + len(y) - n)
            keep = pa.array(value >= similarity)
            return pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(value).filter(keep)], ["a", "b", "similarity"])

        return step

    return map_batches(both, "a long, b long, similarity double", make)


def near_duplicate_pairs(texts: DataFrame, key: str, column: str) -> DataFrame:
    """id_a < id_b of all texts at least SIMILARITY alike; equal texts and mere disguises are pairs too.

    Null keys, null, empty and short texts (under LEAST letters and digits) are in no pair; rows repeated under one
    key count once. Copies are compared once, as one skeleton, and expanded into their pairs at the end; sets of any
    size and buckets of any size are compared in full. Empty tables give no pairs.
    """
    prints = fingerprints(texts, key, column)
    members = prints.select("id", "code").distinct()
    unique = unique_texts(prints)
    codes = unique.select("uid", "code")
    similar = similar_pairs(unique).select("a", "b").join(codes.toDF("a", "code_a"), "a").join(codes.toDF("b", "code_b"), "b").select(F.col("code_a").alias("a"), F.col("code_b").alias("b"))
    across = similar.join(members.toDF("x", "a"), "a").join(members.toDF("y", "b"), "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    copied = members.groupBy("code").count().where("count > 1").select("code")
    copies = members.join(copied, "code", "left_semi")
    within = copies.select(F.col("id").alias("id_a"), "code").join(copies.select(F.col("id").alias("id_b"), "code"), "code").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def near_duplicate_classes(texts: DataFrame, key: str, column: str) -> DataFrame:
    """id, code (the class of equal skeletons) and links: how many other classes are similar to it."""
    prints = fingerprints(texts, key, column)
    unique = unique_texts(prints)
    similar = stage(similar_pairs(unique), "similar")
    links = similar.select(F.col("a").alias("uid")).unionByName(similar.select(F.col("b").alias("uid"))).groupBy("uid").agg(F.count("*").alias("links")).join(unique.select("uid", "code"), "uid").drop("uid")
    return prints.select("id", "code").distinct().join(links, "code", "left").select("id", F.col("code").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
