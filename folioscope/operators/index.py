"""An inverted index on disk, and searches that read the postings of their own terms only."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.stages import drop_stage, stage
from folioscope.operators.retrieval import K1, B

_BUILT: dict[tuple, Index] = {}
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


@dataclass(frozen=True)
class Index:
    """postings: part, term, doc, dl, positions, in the order of part and term; sizes: documents and mean length by part."""

    postings: DataFrame
    sizes: dict[str, tuple[int, float]]


def signature(df: DataFrame) -> tuple:
    """Names of the files behind a table with their sizes and times: it changes when the source does."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in sorted(df.inputFiles())]
    states = [p.getFileSystem(conf).getFileStatus(p) for p in paths]
    return tuple((p.toString(), s.getLen(), s.getModificationTime()) for p, s in zip(paths, states))


def build(tokens: DataFrame) -> Index:
    """The index of (part, doc, ws): words in their order. Sorted by term over ranges, a term's postings are a few row groups.

    Documents without words count for the sizes. A frequent term is spread over as many ranges as its postings need.
    """
    sized = stage(tokens.withColumn("dl", F.size("ws")), "tokens")  # texts are taken apart once
    sizes = {r.part: (r.n, float(r.av or 1.0)) for r in sized.groupBy("part").agg(F.count("*").alias("n"), F.avg("dl").alias("av")).collect()}  # a row per language
    words = sized.select("part", "doc", "dl", F.posexplode("ws").alias("pos", "term"))
    postings = words.groupBy("part", "term", "doc", "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    built = stage(postings.repartitionByRange("part", "term", "doc").sortWithinPartitions("part", "term", "doc"), "postings")
    drop_stage(sized)
    return Index(built, sizes)


def kept(name: str, source: DataFrame, tokens: DataFrame) -> Index:
    """The index of a source under a name: built once, and again when the source's files have changed."""
    key = (source.sparkSession.sparkContext.applicationId, name, signature(source))
    if key not in _BUILT:
        _BUILT[key] = build(tokens)
    return _BUILT[key]


def asked(spark: SparkSession, rows: list[tuple], schema: str = "query string, part string, tier int, term string, ord int") -> DataFrame:
    """What is looked for, made on the driver from what users type: a local relation, whose size the planner knows."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table({n: pa.array(c, _KINDS[k]) for n, k, c in zip(names, kinds, columns)}))


def reads(index: Index, wanted: list[tuple]) -> DataFrame:
    """The postings of the terms in wanted rows (query, part, tier, term, ord); the filter reaches the scan."""
    terms = sorted({(w[1], w[3]) for w in wanted})
    hit = F.lit(False)
    for part in sorted({p for p, _ in terms}):
        hit = hit | ((F.col("part") == part) & F.col("term").isin([t for p, t in terms if p == part]))
    return index.postings.where(hit)


def matches(index: Index, wanted: list[tuple], phrases: frozenset[int] = frozenset({1}), anyway: frozenset[int] = frozenset()) -> DataFrame:
    """query, part, tier, doc of documents that hold a tier's terms: one after the other in the tiers `phrases`, one of them in `anyway`, else all.

    wanted: (query, part, tier, term, ord), terms of a phrase in their order.
    """
    spark = index.postings.sparkSession
    rows = asked(spark, wanted)
    need = rows.groupBy("query", "part", "tier").agg(F.count("*").alias("places"), F.countDistinct("term").alias("terms"))
    hits = reads(index, wanted).join(rows, ["part", "term"])
    adjacent = hits.where(F.col("tier").isin(sorted(phrases))).select("query", "part", "tier", "doc", "ord", F.explode("positions").alias("pos"))
    adjacent = adjacent.groupBy("query", "part", "tier", "doc", (F.col("pos") - F.col("ord")).alias("start")).agg(F.countDistinct("ord").alias("n")).join(need, ["query", "part", "tier"]).where("n = places").select("query", "part", "tier", "doc").distinct()
    rest = hits.where(~F.col("tier").isin(sorted(phrases))).groupBy("query", "part", "tier", "doc").agg(F.countDistinct("term").alias("n")).join(need, ["query", "part", "tier"])
    enough = (F.col("n") == F.col("terms")) | F.col("tier").isin(sorted(anyway))
    return adjacent.unionByName(rest.where(enough).select("query", "part", "tier", "doc"))


def scores(index: Index, wanted: list[tuple]) -> DataFrame:
    """query, part, tier, doc, score: BM25 of the terms of each query's tier, idf ln(1 + (N - df + .5) / (df + .5))."""
    spark = index.postings.sparkSession
    terms = asked(spark, sorted({(q, p, t, w, 0) for q, p, t, w, _ in wanted})).drop("ord")
    held = reads(index, wanted).select("part", "term", "doc", "dl", F.size("positions").alias("tf"))
    df = held.groupBy("part", "term").agg(F.count("*").alias("df"))
    size = asked(spark, [(p, n, av) for p, (n, av) in sorted(index.sizes.items())] or [("", 0, 1.0)], "part string, N long, av double")
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("av")))
    return held.join(terms, ["part", "term"]).join(df, ["part", "term"]).join(size, "part").withColumn("s", part).groupBy("query", "part", "tier", "doc").agg(F.sum("s").alias("score"))


def search(index: Index, wanted: list[tuple], pool: DataFrame | None, limit: int, phrases: frozenset[int] = frozenset({1})) -> DataFrame:
    """query, part, doc, tier, score, rank of the tightest tier with any hit in the pool (query, doc), per query and language.

    The pool holds what the metadata filters of each query let through; None lets everything through. Tiers are never
    mixed. The scores of two languages come from two indexes: each has its own ranks.
    """
    hits = matches(index, wanted, phrases)
    if pool is not None:
        hits = hits.join(pool, ["query", "doc"], "left_semi")
    best = hits.groupBy("query", "part").agg(F.min("tier").alias("tier"))
    found = hits.join(best, ["query", "part", "tier"]).join(scores(index, wanted), ["query", "part", "tier", "doc"]).withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("query", "part").orderBy(F.desc("score"), "doc"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "part", "doc", "tier", "score", "rank")


def prevalence(index: Index, wanted: list[tuple], phrases: frozenset[int] = frozenset({1})) -> DataFrame:
    """query, n of documents under the tightest tier that has any; 0 is left to the caller's outer join."""
    hits = matches(index, wanted, phrases)
    best = hits.groupBy("query").agg(F.min("tier").alias("tier"))
    return hits.join(best, ["query", "tier"]).groupBy("query").agg(F.countDistinct("doc").alias("n"))


def words_index(source: DataFrame, key: str, words: Column) -> Index:
    """The kept index of a table of documents in one part."""
    return kept(f"words-{key}", source, source.select(F.lit("").alias("part"), F.col(key).alias("doc"), words.alias("ws")))
