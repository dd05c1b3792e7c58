"""Core operators on small fixtures."""

from __future__ import annotations

import math
import os

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as X
from folioscope.operators import evaluation, filters, index, queries, retrieval, windows
from folioscope.sources import files
from folioscope.streaming import ingest


def column(spark, value, c):
    return spark.createDataFrame([(value,)], "v string").select(c(F.col("v")).alias("r")).first().r


def test_text_functions(spark):
    assert column(spark, "L'Été, déjà — là!", X.words) == ["l", "ete", "deja", "la"]
    assert column(spark, None, X.words) == []
    assert column(spark, "不忠的a水", X.cjk_bigrams) == ["不忠", "忠的", "a", "水"]
    assert [column(spark, t, X.language) for t in ("", "这是中文", "один два", "the cat", "été à côté là-bas où ça")] == ["und", "zh", "ru", "en", "fr"]
    assert column(spark, "9780306406157", X.isbn13_valid) and not column(spark, "9780306406158", X.isbn13_valid)
    assert column(spark, "<p>a&nbsp;b</p>", X.strip_markup) == "a b"
    assert column(spark, "ab", lambda c: X.char_ngrams(c, 3)) == ["ab"]
    assert column(spark, "x" * 100_000, lambda c: F.size(X.char_ngrams(c, 2))) == 99_999


def test_decoding(spark):
    rows = [(b"\xef\xbb\xbfd\xc3\xa9j\xc3\xa0",), ("时间".encode("gb18030"),), ("déjà".encode("latin-1"),)]
    got = [r.t for r in spark.createDataFrame(rows, "b binary").select(X.decode_bytes(F.col("b")).alias("t")).collect()]
    assert got[:2] == ["déjà", "时间"]


def test_quotes_and_overlap(spark):
    df = spark.createDataFrame([("Le miroir  rouge.", "miroir rouge"), ("Le miroir.", "Le miroir"), ("rien", "miroir")], "t string, s string")
    assert [r.q for r in df.select(X.quote_status(F.col("t"), F.col("s")).alias("q")).collect()] == ["normalised", "exact", "absent"]
    df = spark.createDataFrame([("abc def ghi", "xx abc def ghi yy"), ("abc def ghi", "def zzz"), ("abc", "zzz")], "c string, e string")
    assert [r.q for r in df.select(X.overlap_strength(F.col("c"), F.col("e")).alias("q")).collect()] == ["E4", "E2", "E0"]


def test_filters_and_pages(spark):
    with pytest.raises(ValueError):
        filters.validated({"language": "xx"}, {"language": {"fr"}})
    with pytest.raises(ValueError):
        filters.validated({"other": 1}, {"language": None})
    assert filters.clamp(0) == 1 and filters.clamp(500) == 50
    token = filters.cursor({"a": 1}, ("k",))
    assert filters.resume(token, {"a": 1}) == ("k",)
    with pytest.raises(ValueError):
        filters.resume(token, {"a": 2})
    df = spark.createDataFrame([(i // 3, i) for i in range(20)], "a int, b int")
    seen, after = [], None
    while True:
        rows = [tuple(r) for r in filters.keyset_page(df, ["a", "b"], after, 6).collect()]
        seen += rows[:6]
        if len(rows) <= 6:
            break
        after = rows[5]
    assert seen == [(i // 3, i) for i in range(20)]
    spans = spark.createDataFrame([(1950, None), (1940, 1960), (None, 1950), (1970, 1980)], "yf int, yt int")
    assert spans.where(filters.overlaps("yf", "yt", 1945, 1955)).count() == 2


def test_windows(spark):
    df = spark.createDataFrame([("g", i) for i in range(6)] + [("h", 9)], "g string, i int")
    near = windows.context(df, df.where("i in (0, 9)"), "i", "g", "i", 2)
    assert sorted((r.target, r.neighbour, r.distance) for r in near.collect()) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (9, 9, 0)]
    ranks = spark.createDataFrame([("q", "a", 1, "1"), ("q", "a", 2, "2"), ("q", "a", 3, "3"), ("q", "b", 4, "4"), ("q", "a", 5, "5")], "q string, g string, r int, i string")
    assert windows.diversified(ranks, "q", "g", "r", "i", 2, 4).first()["items"] == ["1", "2", "4", "5"]
    assert {r.i for r in windows.capped(ranks, "q", "g", "r", 1).collect()} == {"1", "4"}
    lanes = spark.createDataFrame([("q", 0, "x", 1), ("q", 1, "y", 1), ("q", 0, "y", 2), ("q", 1, "z", 2)], "q string, lane int, item string, rank int")
    assert [r["item"] for r in windows.interleaved(lanes, "q", "lane", "rank", "item").orderBy("rank").collect()] == ["x", "y", "z"]


def test_bm25_against_python(spark):
    docs = [(1, "a b b c"), (2, "a a"), (3, "c d"), (4, None), (5, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    built = index.build(df.select(F.lit("").alias("part"), F.col("doc_id").alias("doc"), X.words(F.col("text")).alias("ws")))
    got = {(r.query, r.doc): r.score for r in index.scores(built, [("q", "", 0, "a", 0), ("q", "", 0, "b", 1)]).collect()}
    tokens = {i: (t or "").split() for i, t in docs}
    avg, n = sum(map(len, tokens.values())) / 5, 5
    for i, ws in tokens.items():
        score = 0.0
        for term in ("a", "b"):
            dfreq = sum(term in w for w in tokens.values())
            if tf := ws.count(term):
                score += math.log(1 + (n - dfreq + 0.5) / (dfreq + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / avg))
        assert (("q", i) in got) == (score > 0) and (not score or abs(got["q", i] - score) < 1e-9)


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "voix très basse"), (2, "basse voix"), (3, "voix"), (4, "la voix basse")], "d int, t string")
    built = index.build(docs.select(F.lit("fr").alias("part"), F.col("d").alias("doc"), X.words(F.col("t")).alias("ws")))
    wanted = queries.wanted_of("q", "fr", "voix basse") + queries.wanted_of("none", "fr", "zzz voix") + queries.wanted_of("elided", "fr", "l'voix")
    assert {(r.query, r.doc, r.tier) for r in index.search(built, wanted, None, 10).collect()} == {("q", 4, 1)}
    pool = spark.createDataFrame([("q", 1), ("q", 2), ("q", 3)], "query string, doc int")  # tiers are chosen within the pool
    assert [(r.doc, r.tier, r["rank"]) for r in index.search(built, wanted, pool, 10).orderBy("rank").collect()] == [(2, 2, 1), (1, 2, 2)]
    assert {(r.query, r.n) for r in index.prevalence(built, wanted).collect()} == {("q", 1)}
    assert queries.elisions("l'Autre de l’être") == ["l", "autre", "lautre", "de", "etre", "letre"]
    assert queries.bigrams("镜子里a b") == ["镜子", "子里", "a", "b"]
    lists = spark.createDataFrame([("q", "L", "p1", 1), ("q", "L", "p2", 2), ("q", "G", "p2", 1)], "query string, component string, item string, rank int")
    assert retrieval.fused(lists, 2).orderBy("rank").first()["item"] == "p2"
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")], "a string, b string")
    assert {(r.node, r.depth) for r in retrieval.hops(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_metrics(spark):
    run = spark.createDataFrame([("q", "x", 1), ("q", "a", 2)], "query string, item string, rank int")
    gold = spark.createDataFrame([("q", "a", 1), ("q", "b", 1), ("r", "c", 1)], "query string, item string, grade int")
    got = {r.query: r for r in evaluation.metrics(run, gold).collect()}
    assert got["q"].recall == 0.5 and got["q"].mrr == 0.5 and got["r"].hit == 0 and got["r"].ndcg == 0
    assert abs(got["q"].ndcg - (1 / math.log2(3)) / (1 + 1 / math.log2(3))) < 1e-5


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "n": 2}\n\n{"id": "2"}\n{broken\n')
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int", tolerant=True).count() == 2
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, n int").collect()
    df = spark.createDataFrame([("b", [1]), ("a", [2, 3])], "id string, x array<int>")
    files.write_jsonl(df, str(tmp_path / "out"), "id")
    files.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    os.makedirs(tmp_path / "in")
    for name, data in (("x.html", b"<b>caf\xc3\xa9</b>"), ("y.html", b"<b>caf\xc3\xa9</b>"), (".hidden", b"z")):
        (tmp_path / "in" / name).write_bytes(data)
    inv = files.inventory(spark, str(tmp_path / "in")).collect()
    assert [(r.extension, r.duplicates) for r in inv] == [("html", 1), ("html", 1)]
    assert "café" in {r.text for r in files.read_html(spark, str(tmp_path / "in")).collect()}
    same, mark = files.unchanged(df, None)
    assert not same and files.unchanged(df.orderBy("id"), mark)[0]


def test_segments(spark):
    text = "\n\n".join(["a" * 500, "b" * 10, "c" * 500, "d" * 900])
    got = files.segments(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").collect()
    assert [(r.k, r.n, len(r.segment)) for r in got] == [(1, 1, 1002), (1, 2, 900)]


def test_streams(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:0{i}:00", "x") for i in (1, 1, 5)] + [("b", "2024-01-01 02:00:00", "y")]
    spark.createDataFrame(rows, "id string, at string, kind string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("id string, at timestamp, kind string").parquet(str(tmp_path / "in"))
    for name, df, mode, n in (
        ("s1", ingest.deliveries(source(), "id", "at"), "append", 2),
        ("s2", ingest.sessions(source(), "id", "at", "10 minutes", "1 minute"), "complete", 2),
        ("s3", ingest.window_counts(source(), "at", "kind", "1 hour", "1 minute"), "complete", 2),
    ):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == n
    q = source().writeStream.foreachBatch(ingest.upsert(str(tmp_path / "up"), "id", "at")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.at.minute) for r in ingest.current(spark, str(tmp_path / "up")).collect()} == {("a", 5), ("b", 0)}


def test_mentions_of_names_of_any_shape(spark, tmp_path):
    from folioscope.plans import browse

    spec = [("a", "common ship", None, None, "共同 船只", ["le navire commun"]), ("b", "Ship", None, None, None, None), ("c", "absent name here", None, None, "船", None)]
    spark.createDataFrame(spec, "id string, canonical_name string, fr string, en string, zh string, aliases array<string>").write.parquet(f"{tmp_path}/spec.parquet")
    docs = [(1, "Le Navire, commun!"), (2, "这共同船只在"), (3, "shipping"), (4, "看ship吧"), (5, None), (6, "a common ship, a common ship"), (7, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    query = browse.queries()["j8_all_mentions"]
    assert {r.id: r.documents for r in query(spark, str(tmp_path)).collect()} == {"a": 3, "b": 2, "c": 1}


def test_upsert_keeps_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    apply = ingest.upsert(path, "id", "at", buckets=4)
    assert ingest.current(spark, path) is None
    apply(spark.range(100).selectExpr("id", "1 AS at"), 0)
    apply(spark.range(100, 101).selectExpr("id", "2 AS at", "'new' AS extra"), 1)  # one more column
    assert ingest.current(spark, path).count() == 101
    apply(spark.createDataFrame([(5, 9), (None, 1), (None, 2), (5, 3)], "id long, at int"), 2)
    rows = {r.id: r.at for r in ingest.current(spark, path).collect()}
    assert len(rows) == 102 and rows[5] == 9 and rows[None] == 2 and rows[100] == 2

    def fail(*_):
        raise OSError("lost")

    monkeypatch.setattr(ingest.Versions, "commit", fail)  # a crash between the rows and the manifest
    with pytest.raises(OSError):
        apply(spark.range(100).selectExpr("id", "50 AS at"), 3)
    assert {r.id: r.at for r in ingest.current(spark, path).collect()} == rows
    monkeypatch.undo()
    for _ in range(2):  # and the batch run again, twice
        apply(spark.range(100).selectExpr("id", "50 AS at"), 3)
        again = {r.id: r.at for r in ingest.current(spark, path).collect()}
        assert len(again) == 102 and again[5] == 50 and again[None] == 2


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_of_groups_of_any_size(spark, partitions):
    from folioscope.operators import windows

    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 5}", i * 7919 % 500) for i in range(500)]
    got = windows.numbered_evenly(spark.createDataFrame(rows, "g string, o int").repartition(partitions), ["g"], ["o"]).collect()
    want = {}
    for g, o in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want.setdefault(g, []).append(o)
    assert sorted((str(r.g), r.seq, r.o) for r in got) == sorted((str(g), k + 1, o) for g, os in want.items() for k, o in enumerate(os))


def test_vectors_against_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(7).normal(size=(300, 8)).round(1)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    asked = df.where("id % 50 = 0").selectExpr("id AS query", "v")
    got = {(r["query"], r["rank"]): r.item for r in retrieval.vector_topk(df, "id", "v", asked, 4).collect()}
    for q in range(0, 300, 50):
        want = sorted((-round(float(v[i] @ v[q]), 6), i) for i in range(300) if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in want]
    assert retrieval.vector_topk(df, "id", "v", asked.limit(0), 4).count() == 0 and len(got) == 24


def test_postings_are_read_by_term(spark, tmp_path):
    rows = [(i, f"w{i % 97} w{i % 89} le") for i in range(3000)] + [(-1, None)]
    spark.createDataFrame(rows, "d int, t string").write.parquet(f"{tmp_path}/t.parquet")
    source = spark.read.parquet(f"{tmp_path}/t.parquet")
    first = index.words_index(source, "d", X.words(F.col("t")))
    assert index.words_index(spark.read.parquet(f"{tmp_path}/t.parquet"), "d", X.words(F.col("t"))) is first and first.sizes[""][0] == 3001
    plan = index.reads(first, [("q", "", 1, "w5", 0)])._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "EqualTo(term,w5)" in plan
    spark.createDataFrame(rows[:5], "d int, t string").write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert index.words_index(spark.read.parquet(f"{tmp_path}/t.parquet"), "d", X.words(F.col("t"))).sizes[""][0] == 5


def test_leave_one_out_and_lanes(spark):
    lists = spark.createDataFrame([("q", "E", "a", 1), ("q", "L", "b", 1), ("q", "L", "a", 2)], "query string, component string, item string, rank int")
    gold = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "z")], "query string, item string")
    assert {r.component: r.marginal for r in evaluation.leave_one_out(lists, gold, ["E", "L"], 10).collect()} == {"E": 0.0, "L": 0.25}
    lane = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "lane string, item string")
    run = spark.createDataFrame([("x", "a", 1), ("x", "n", 2), ("x", "b", 3)], "lane string, item string, rank int")
    assert {r.lane: (r.size, r.recall) for r in evaluation.lane_recall(run, lane, 1).collect()} == {"x": (2, 1.0), "y": (1, 0.0)}
