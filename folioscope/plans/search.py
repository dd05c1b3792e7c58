"""Retrieval, fusion, quotation checks, evaluation and store audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as X
from folioscope.operators import evaluation, index, retrieval, windows
from folioscope.plans.browse import _ALIASES, _aliases, _passages
from folioscope.plans.sql import ONCE, compat, normal, words
from folioscope.sources.tables import table

#: Typed queries of the catalogue.
TYPED = {"mirror": "miroir fragile", "page": "voix basse dans la salle", "river": "the living river", "none": "zzz qqq", "turn": "fleuve vivant absent"}
PHRASE = "à voix basse"
#: Queries of vector search: every vector whose id this number divides, against all vectors.
EVERY = 50
#: Depth of ranked lists.
TOP = 10


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _index(spark, d):
    docs = _docs(spark, d)
    return index.words_index(docs, "doc_id", X.words(F.col("text")))


def _typed(tiers: dict[int, Callable[[str], list[str]]], queries: dict[str, str] = TYPED) -> list[tuple]:
    """Rows (query, part, tier, term, ord) of typed queries."""
    return [(k, "", tier, t, i) for k, q in sorted(queries.items()) for tier, words in tiers.items() for i, t in enumerate(words(q.lower()))]


def r4_term_stats(spark, d):
    return _index(spark, d).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.size("positions")).alias("cf"))


def r2_cjk_bigrams(spark, d):
    p = _passages(spark, d, "language", "raw_text").where("language = 'zh'")
    return p.select(F.explode(F.filter(X.cjk_bigrams(F.col("raw_text")), lambda g: g.rlike("^\\p{IsHan}{2}$"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def r3_char_ngrams(spark, d):
    names = _aliases(spark, d).where("length(folded) >= 3").select("folded").distinct()
    return names.select(F.explode(X.char_ngrams(F.col("folded"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def r5_bm25(spark, d):
    top = index.scores(_index(spark, d), _typed({0: lambda q: list(dict.fromkeys(q.split()))})).withColumn("score", F.round("score", 6))
    return retrieval.ranked(top, "query", "score", "doc", TOP).select("query", "doc", "score", "rank")


def r7_all_words(spark, d):
    return index.matches(_index(spark, d), [("q", "", 2, t, i) for i, t in enumerate(("miroir", "lettre"))]).select(F.col("doc").alias("doc_id"))


def r8_phrase(spark, d):
    return index.matches(_index(spark, d), [("q", "", 1, t, i) for i, t in enumerate(("a", "voix", "basse"))]).select(F.col("doc").alias("doc_id"))


def r9_ladder(spark, d):
    long = lambda q: [t for t in q.split() if len(t) > 1]
    hits = index.matches(_index(spark, d), _typed({1: str.split, 2: long, 3: long}), anyway=frozenset({3}))
    return hits.join(hits.groupBy("query").agg(F.min("tier").alias("tier")), ["query", "tier"]).select("query", "doc", "tier")


def _queries(spark, d):
    return table(spark, d, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))


def r16_vector_topk(spark, d):
    return retrieval.vector_topk(table(spark, d, "embeddings"), "vec_id", "embedding", _queries(spark, d), TOP).select("query", "item", "score", "rank")


def _components(spark, d):
    exact = index.matches(_index(spark, d), [("q", "", 1, t, i) for i, t in enumerate(("miroir", "fragile"))]).select(F.col("doc").alias("doc_id")).select(F.lit("mirror").alias("query"), F.lit("E").alias("component"), F.col("doc_id").alias("item"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("doc_id")).alias("rank")).where(f"rank <= {TOP}")
    lexical = r5_bm25(spark, d).select("query", F.lit("L").alias("component"), F.col("doc").alias("item"), "rank")
    long = index.matches(_index(spark, d), [("q", "", 2, "miroir", 0)]).select(F.col("doc").alias("doc_id")).join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.lit("mirror").alias("query"), F.lit("M").alias("component"), F.col("doc_id").alias("item"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n_chars"), "doc_id")).alias("rank")).where(f"rank <= {TOP}")
    return reduce(DataFrame.unionByName, [exact, lexical, long])


def r19_fused(spark, d):
    return retrieval.fused(_components(spark, d), TOP).select("query", "item", "score", "rank")


def r20_rank_table(spark, d):
    return retrieval.rank_table(_components(spark, d), ["E", "L", "M"])


def r21_fingerprints(spark, d):
    """Passages that a fingerprint keeps, and those it drops as near duplicates of one of the same witness."""
    p = _passages(spark, d, "witness_id", retrieval.fingerprint(F.col("raw_text")).alias("print"))
    groups = p.groupBy("print", "witness_id").agg(F.count("*").alias("n"))
    return groups.select(F.explode(F.array(F.struct(F.lit(False).alias("dropped"), F.lit(1).cast("long").alias("n")), F.struct(F.lit(True).alias("dropped"), (F.col("n") - 1).alias("n")))).alias("x")).where("x.n > 0").groupBy("x.dropped").agg(F.sum("x.n").alias("n"))


def r23_hops(spark, d):
    links = table(spark, d, "spec").where("distinction_from is not null").select(F.col("id").alias("a"), F.explode("distinction_from").alias("b"))
    start = table(spark, d, "spec").where("size(distinction_from) > 0").orderBy("id").limit(3).select(F.col("id").alias("node"))
    return retrieval.hops(links, start, 2)


def r28_contrast(spark, d):
    own, other = ["miroir", "lettre"], ["silence", "voix"]
    count = lambda forms: reduce(lambda a, b: a + b, [F.contains(F.col("t"), F.lit(f)).cast("int") for f in forms])
    docs = _docs(spark, d).where("text is not null").select("doc_id", F.lower("text").alias("t"))
    return docs.select("doc_id", (count(own) - count(other)).alias("contrast")).where("contrast <> 0")


def r31_alias_lookup(spark, d):
    asked = spark.createDataFrame([("Miroir",), ("fleuve vivant",), ("LIVING RIVER",), ("活着河流",), ("rien",)], "asked string").withColumn("folded", X.normal(F.col("asked")))
    found = asked.join(_aliases(spark, d), "folded", "left")
    return found.groupBy("asked").agg(F.countDistinct("id").alias("entities"), F.min("id").alias("first"), F.max(F.coalesce((F.col("asked") == F.col("alias")).cast("int"), F.lit(0))).alias("exact_case"))


def r32_alias_collisions(spark, d):
    """Folded aliases of two entities or more, those that need context among them."""
    spec = table(spark, d, "spec")
    more = spec.select("id", F.explode("context_required_aliases").alias("alias")).where("trim(alias) <> ''").select("id", X.fold_nfkc(F.col("alias")).alias("folded"))
    every = _aliases(spark, d).select("id", X.fold_nfkc(F.col("alias")).alias("folded")).unionByName(more).where("folded <> ''").distinct()
    return every.groupBy("folded").agg(F.count("*").alias("entities"), F.min("id").alias("first")).where("entities > 1")


def r33_entity_search(spark, d):
    blob = F.lower(F.concat_ws(" ", "id", "canonical_name", "fr", "en", "zh"))
    return table(spark, d, "spec").where(F.contains(blob, F.lit("miroir"))).select("id").distinct()


def x8_same_clause(spark, d):
    clauses = F.split(F.lower("text"), "[.!?。！？;；]")
    both = F.exists(clauses, lambda c: F.contains(c, F.lit("miroir")) & F.contains(c, F.lit("lettre")))
    docs = _docs(spark, d).where("text is not null")
    any_ = F.contains(F.lower("text"), F.lit("miroir")) & F.contains(F.lower("text"), F.lit("lettre"))
    level = F.when(both, "R2").when(any_, "R1").otherwise("R0")
    return docs.groupBy(level.alias("level")).agg(F.count("*").alias("n"))


SPANS = ("Est-ce le miroir", "à voix  basse", "jamais écrit ainsi", "N. B. :", "Le fleuve", "le fleuve")


def x26_quotes(spark, d):
    spans = F.array(*map(F.lit, SPANS))
    pairs = _docs(spark, d).where("text is not null").select("text", F.explode(spans).alias("span"))
    return pairs.groupBy("span", X.quote_status(F.col("text"), F.col("span")).alias("status")).agg(F.count("*").alias("n"))


def x27_overlap(spark, d):
    claim = F.lit("le miroir fragile traverse la lettre")
    return _docs(spark, d).where("text is not null").groupBy(X.overlap_strength(claim, F.col("text")).alias("strength")).agg(F.count("*").alias("n"))


def _gold(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query"), "label")
    return e.join(q, "label").where(F.col("vec_id") != F.col("query")).select("query", F.col("vec_id").alias("item"), (1 + (F.col("vec_id") % 3 == 0).cast("int")).alias("grade"))


def e1_metrics(spark, d):
    return evaluation.metrics(r16_vector_topk(spark, d), _gold(spark, d), TOP)


def e2_macro(spark, d):
    return evaluation.macro(e1_metrics(spark, d))


def e8_lift(spark, d):
    return evaluation.lift(e1_metrics(spark, d), _gold(spark, d), table(spark, d, "embeddings").count(), TOP)


def e9_contrastive(spark, d):
    gold = _gold(spark, d).select("query", "item", F.lit(True).alias("good"))
    run = r16_vector_topk(spark, d).join(gold, ["query", "item"], "left")
    first = run.groupBy("query").agg(F.min(F.when(F.col("good"), F.col("rank"))).alias("pos"), F.min(F.when(F.col("good").isNull(), F.col("rank"))).alias("neg"))
    return first.select("query", F.coalesce(F.col("pos") < F.coalesce("neg", F.lit(TOP + 1)), F.lit(False)).alias("passed"))


def c12_audit(spark, d):
    p = table(spark, d, "passages")
    one = p.agg(
        F.count("*").alias("rows"), F.countDistinct("id").alias("ids"), F.count_if(~F.col("id").rlike("^passage\\.S[0-9]{2}\\.")).alias("bad_ids"), F.count_if((F.col("trace_status") == "SOURCE_TRACE_INCOMPLETE") & F.coalesce(F.size("trace_missing") <= 0, F.lit(True))).alias("silent_traces"),
        F.count_if((F.col("raw_text") != F.col("normalized_text")) & F.coalesce(F.size("normalization_operations") <= 0, F.lit(True))).alias("silent_changes"), F.count_if(F.length(F.trim("raw_text")) == 0).alias("empty_texts"),
    )
    names = one.columns
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("long").alias("n")) for c in names))).alias("x")).select("x.check", "x.n")


def c13_links(spark, d):
    p = _passages(spark, d, "session_id", "witness_id")
    s = table(spark, d, "sessions").select(F.col("id").alias("session_id")).distinct()
    w = table(spark, d, "witnesses").select(F.col("id").alias("witness_id")).distinct()
    a = p.join(s, "session_id", "left_anti").select(F.lit("session").alias("link"))
    b = p.where("witness_id is not null").join(w, "witness_id", "left_anti").select(F.lit("witness").alias("link"))
    return a.unionByName(b).groupBy("link").agg(F.count("*").alias("broken"))


def d1_latest_orders(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return windows.first_n(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "o_totalprice")


def d2_chain_counts(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity").groupBy("l_orderkey").agg(F.count("*").alias("n"))  # pre-aggregated below the joins
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(F.sum("n").alias("lines"), F.countDistinct("o_orderkey").alias("orders"))


def d3_timeline(spark, d):
    e = table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    return e.withColumn("running", F.sum("n").over(Window.partitionBy("event_type").orderBy("day")))


def d4_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi"))


_Q = [r2_cjk_bigrams, r3_char_ngrams, r4_term_stats, r5_bm25, r7_all_words, r8_phrase, r9_ladder, r16_vector_topk, r19_fused, r20_rank_table, r21_fingerprints, r23_hops, r28_contrast, r31_alias_lookup, r32_alias_collisions, r33_entity_search, x8_same_clause, x26_quotes, x27_overlap, e1_metrics, e2_macro, e8_lift, e9_contrastive, c12_audit, c13_links, d1_latest_orders, d2_chain_counts, d3_timeline, d4_props]


def queries() -> dict:
    return {f.__name__: f for f in _Q}


def oracle_sql() -> dict[str, str]:
    aliases = _ALIASES.format(n=normal("alias"))
    typed = " UNION ALL ".join(f"SELECT '{k}' AS query, unnest({words(repr(v))}) AS term" for k, v in TYPED.items())
    bm25 = f"""t AS (SELECT DISTINCT query, term FROM ({typed})), w AS (SELECT doc_id, {words('text')} AS ws FROM documents), tot AS (SELECT count(*) AS N, avg(len(ws)) AS av FROM w),
        h AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM t) GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM h GROUP BY 1),
        s AS (SELECT query, doc_id AS doc, round(sum(ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM h JOIN f USING (term) JOIN t USING (term) CROSS JOIN tot GROUP BY 1, 2),
        lx AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= {TOP})"""
    vec = f"""v AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (SELECT q.vec_id AS query, e.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score
        FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % {EVERY} = 0) QUALIFY rank <= {TOP})"""
    gold = f"g AS (SELECT q.vec_id AS query, e.vec_id AS item, 1 + (e.vec_id % 3 = 0)::INT AS grade FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % {EVERY} = 0)"
    per = f"""{vec}, {gold}, m AS (SELECT g.query, round(count(v.rank) / count(*), 6) AS recall, max((v.rank IS NOT NULL)::INT) AS hit, round(coalesce(max(1.0 / v.rank), 0), 6) AS mrr,
        round(sum(CASE WHEN v.rank IS NULL THEN 0 ELSE (pow(2, grade) - 1) / log2(v.rank + 1.0) END) / list_sum(list_transform(range(1, 1 + least({TOP}, count(*))), lambda i: (pow(2, list_reverse_sort(list(grade))[i]) - 1) / log2(i + 1.0))), 6) AS ndcg FROM g LEFT JOIN v ON v.query = g.query AND v.item = g.item GROUP BY 1)"""
    pad = lambda c: f"(' ' || {normal(c)} || ' ')"
    has = lambda w, c="text": f"list_contains({words(c)}, '{w}')"
    tiers = " UNION ALL ".join(
        f"SELECT '{k}' AS query, doc_id AS doc, CASE WHEN contains({pad('text')}, {pad(repr(v))}) THEN 1 WHEN {' AND '.join(has(t) for t in v.split() if len(t) > 1)} THEN 2 WHEN {' OR '.join(has(t) for t in v.split() if len(t) > 1)} THEN 3 END AS tier FROM documents" for k, v in TYPED.items()
    )
    comp = f"""{bm25}, c AS (SELECT query, 'L' AS component, doc AS item, rank FROM lx UNION ALL (SELECT 'mirror', 'E', doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE contains({pad('text')}, ' miroir fragile ') QUALIFY rank <= {TOP})
        UNION ALL (SELECT 'mirror', 'M', doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE {has('miroir')} QUALIFY rank <= {TOP}))"""
    forms = lambda f: " + ".join(f"contains(lower(text), '{x}')::INT" for x in f)
    plain = lambda c: f"trim(regexp_replace(nfc_normalize({compat(c)}), '[\\s\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g'))"
    squash = lambda c: f"regexp_replace(lower({c}), '\\s+', '', 'g')"
    mine = f"list_distinct(list_filter({words(repr('le miroir fragile traverse la lettre'))}, lambda w: length(w) >= 3))"
    share = f"len(list_intersect({mine}, {words('text')})) / len({mine})"
    return {
        "r2_cjk_bigrams": f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(run)), lambda i: substring(run, i, 2))) AS gram FROM (SELECT unnest(regexp_extract_all(lower(raw_text), '(\\p{{Han}}+)', 1)) AS run FROM {ONCE} WHERE language = 'zh')) GROUP BY 1",
        "r3_char_ngrams": f"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(folded) - 1), lambda i: substring(folded, i, 3))) AS gram FROM (SELECT DISTINCT folded FROM {aliases} WHERE length(folded) >= 3)) GROUP BY 1",
        "r4_term_stats": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({words('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1",
        "r5_bm25": f"WITH {bm25} SELECT query, doc, score, rank FROM lx",
        "r7_all_words": f"SELECT doc_id FROM documents WHERE {has('miroir')} AND {has('lettre')}",
        "r8_phrase": f"SELECT doc_id FROM documents WHERE contains({pad('text')}, {pad(repr(PHRASE))})",
        "r9_ladder": f"SELECT query, doc, tier::INTEGER AS tier FROM (SELECT *, min(tier) OVER (PARTITION BY query) AS best FROM ({tiers}) WHERE tier IS NOT NULL) WHERE tier = best",
        "r16_vector_topk": f"WITH {vec} SELECT query, item, score, rank FROM v",
        "r19_fused": f"WITH {comp} SELECT query, item, score, rank FROM (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (SELECT query, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM c GROUP BY 1, 2)) WHERE rank <= {TOP}",
        "r20_rank_table": f'WITH {comp} SELECT query, item, min(rank) FILTER (component = \'E\') AS "E", min(rank) FILTER (component = \'L\') AS "L", min(rank) FILTER (component = \'M\') AS "M" FROM c GROUP BY 1, 2',
        "r21_fingerprints": f"SELECT n > 1 AS dropped, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY substring(regexp_replace(raw_text, '[^\\p{{L}}\\p{{N}}_]+', '', 'g'), 1, 120), witness_id ORDER BY id) AS n FROM {ONCE}) GROUP BY 1",
        "r23_hops": """WITH RECURSIVE e AS (SELECT id AS a, unnest(distinction_from) AS b FROM spec), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), s AS (SELECT id AS node FROM spec WHERE len(distinction_from) > 0 ORDER BY id LIMIT 3),
            r(node, depth) AS (SELECT node, 0 FROM s UNION SELECT u.b, r.depth + 1 FROM r JOIN u ON u.a = r.node WHERE r.depth < 2) SELECT node, min(depth)::INTEGER AS depth FROM r GROUP BY 1""",
        "r28_contrast": f"SELECT doc_id, contrast FROM (SELECT doc_id, ({forms(['miroir', 'lettre'])}) - ({forms(['silence', 'voix'])}) AS contrast FROM documents WHERE text IS NOT NULL) WHERE contrast <> 0",
        "r31_alias_lookup": f"""SELECT asked, count(DISTINCT a.id) AS entities, min(a.id) AS first, max(CASE WHEN asked = a.alias THEN 1 ELSE 0 END) AS exact_case FROM (SELECT asked, {normal('asked')} AS folded FROM (SELECT unnest(['Miroir', 'fleuve vivant', 'LIVING RIVER', '活着河流', 'rien']) AS asked)) q
            LEFT JOIN {aliases} a ON a.folded = q.folded GROUP BY 1""",
        "r32_alias_collisions": f"""SELECT folded, count(*) AS entities, min(id) AS first FROM (SELECT DISTINCT id, trim(lower({compat('alias')})) AS folded FROM (
            SELECT id, unnest(list_concat([canonical_name, fr, en, zh], coalesce(aliases, []), coalesce(context_required_aliases, []))) AS alias FROM spec)) WHERE folded <> '' GROUP BY 1 HAVING count(*) > 1""",
        "r33_entity_search": "SELECT DISTINCT id FROM spec WHERE contains(lower(concat_ws(' ', id, canonical_name, fr, en, zh)), 'miroir')",
        "x8_same_clause": """SELECT CASE WHEN len(list_filter(string_split_regex(lower(text), '[.!?。！？;；]'), lambda c: contains(c, 'miroir') AND contains(c, 'lettre'))) > 0 THEN 'R2' WHEN contains(lower(text), 'miroir') AND contains(lower(text), 'lettre') THEN 'R1' ELSE 'R0' END AS level,
            count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""",
        "x26_quotes": f"SELECT span, CASE WHEN contains(text, span) THEN 'exact' WHEN contains({plain('text')}, {plain('span')}) THEN 'normalised' ELSE 'absent' END AS status, count(*) AS n FROM documents CROSS JOIN (SELECT unnest({list(SPANS)!r}) AS span) WHERE text IS NOT NULL GROUP BY 1, 2",
        "x27_overlap": f"SELECT CASE WHEN contains({squash('text')}, 'lemiroirfragiletraverselalettre') THEN 'E4' WHEN {share} >= 0.6 THEN 'E3' WHEN {share} >= 0.3 THEN 'E2' WHEN {share} > 0 THEN 'E1' ELSE 'E0' END AS strength, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "e1_metrics": f"WITH {per} SELECT query, recall, hit, mrr, ndcg FROM m",
        "e2_macro": f"WITH {per} SELECT round(avg(recall), 6) AS recall, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, count(*) AS queries FROM m",
        "e8_lift": f"WITH {per} SELECT query, recall, round({TOP} / (SELECT count(*) FROM embeddings), 6) AS baseline, round(recall * (SELECT count(*) FROM embeddings) / {TOP}, 3) AS lift FROM m",
        "e9_contrastive": f"WITH {vec}, {gold} SELECT v.query, coalesce(min(CASE WHEN g.item IS NOT NULL THEN rank END) < coalesce(min(CASE WHEN g.item IS NULL THEN rank END), {TOP + 1}), false) AS passed FROM v LEFT JOIN g ON g.query = v.query AND g.item = v.item GROUP BY 1",
        "c12_audit": """WITH a AS (SELECT count(*) AS rows, count(DISTINCT id) AS ids, count(*) FILTER (NOT regexp_matches(id, '^passage\\.S[0-9]{2}\\.')) AS bad_ids, count(*) FILTER (trace_status = 'SOURCE_TRACE_INCOMPLETE' AND coalesce(len(trace_missing), 0) = 0) AS silent_traces,
            count(*) FILTER (raw_text <> normalized_text AND coalesce(len(normalization_operations), 0) = 0) AS silent_changes, count(*) FILTER (length(trim(raw_text, ' ')) = 0) AS empty_texts FROM passages) """
        + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", {c} AS n FROM a" for c in ("rows", "ids", "bad_ids", "silent_traces", "silent_changes", "empty_texts")),
        "c13_links": f"SELECT link, count(*) AS broken FROM (SELECT 'session' AS link FROM {ONCE} WHERE session_id IS NULL OR session_id NOT IN (SELECT id FROM sessions WHERE id IS NOT NULL) UNION ALL SELECT 'witness' FROM {ONCE} WHERE witness_id IS NOT NULL AND witness_id NOT IN (SELECT id FROM witnesses WHERE id IS NOT NULL)) GROUP BY 1",
        "d1_latest_orders": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 2",
        "d2_chain_counts": "SELECT r_name, count(*) AS lines, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
        "d3_timeline": "SELECT event_type, day, n, sum(n) OVER (PARTITION BY event_type ORDER BY day)::BIGINT AS running FROM (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1, 2)",
        "d4_props": "SELECT event_type, count(k) AS n, min(k) AS lo, max(k) AS hi FROM (SELECT event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events) GROUP BY 1",
    }
