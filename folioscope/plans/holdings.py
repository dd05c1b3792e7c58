"""The store's contents: look-ups, contexts, lessons, inventories, graphs, audits and measures of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import rules as R
from folioscope.functions import text as X
from folioscope.operators import evaluation, filters, retrieval, windows
from folioscope.plans import lexical, search
from folioscope.plans.browse import _aliases, _passages
from folioscope.plans.rules import _usability
from folioscope.plans.sql import ONCE, Catalogue, norm_fr, text
from folioscope.sources import exports
from folioscope.sources.files import segments
from folioscope.sources.tables import table

query = Catalogue()
ASKED = ["passage.S36.1967-12-17.L01.P0014", "passage.S02.1932-02-16.L04.P0001", "passage.S00.nowhere.P0001", ""]


def _values(rows: list[str]) -> str:
    return f"[{', '.join(map(text, rows))}]"


@query(f"SELECT q AS id, p.id IS NOT NULL AS found, substring(p.raw_text, 1, 40) AS snippet FROM (SELECT unnest({_values(ASKED)}) AS q) LEFT JOIN {ONCE} p ON p.id = q")
def s4_look_up(spark, d):
    """Passages by key; an id that the store lacks comes out as not found, with nulls."""
    p = _passages(spark, d, X.snippet(F.col("raw_text"), 40).alias("snippet"), where=F.col("id").isin(ASKED)).withColumn("found", F.lit(True))
    return spark.createDataFrame([(i,) for i in ASKED], "id string").join(p, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"), "snippet")


@query(f"""WITH p AS (SELECT id, session_id, contains(raw_text, 'annexe B') AS hit, row_number() OVER (ORDER BY id) AS n FROM {ONCE})
    SELECT a.id AS target, b.id AS neighbour, (b.n - a.n)::INTEGER AS distance, a.session_id IS DISTINCT FROM b.session_id AS across FROM p a JOIN p b ON abs(a.n - b.n) <= 2 WHERE a.hit""")
def w3_store_context(spark, d):
    """Neighbours in the order of the whole store, with a mark on those of another session."""
    p = _passages(spark, d, "session_id", F.contains("raw_text", F.lit("annexe B")).alias("hit")).withColumn("store", F.lit(0))
    near = windows.context(p, p.where("hit"), "id", "store", "id", 2)
    of = p.select("id", "session_id")
    return near.join(of.toDF("target", "ts"), "target").join(of.toDF("neighbour", "ns"), "neighbour").select("target", "neighbour", "distance", (~F.col("ts").eqNullSafe(F.col("ns"))).alias("across"))


@query(f"""WITH p AS (SELECT id, session_id, contains(raw_text, 'miroir') AS hit, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM {ONCE})
    SELECT a.id AS target, count(*) FILTER (b.hit) AS persists FROM p a LEFT JOIN p b ON a.session_id = b.session_id AND a.n <> b.n AND abs(a.n - b.n) <= 2 WHERE a.hit GROUP BY 1""")
def w5_persistence(spark, d):
    """Neighbours of the session within two places that hold the topic's form, too."""
    p = _passages(spark, d, "session_id", F.contains("raw_text", F.lit("miroir")).alias("hit"))
    near = windows.context(p, p.where("hit"), "id", "session_id", "id", 2)
    of = near.where("distance <> 0").join(p.where("hit").select(F.col("id").alias("neighbour")), "neighbour", "left_semi").groupBy("target").agg(F.count("*").alias("persists"))
    return p.where("hit").select(F.col("id").alias("target")).join(of, "target", "left").select("target", F.coalesce("persists", F.lit(0)).alias("persists"))


@query("""WITH e AS (SELECT loaded_at AS "at", 'session' AS kind, id FROM sessions WHERE loaded_at IS NOT NULL UNION ALL SELECT deleted_at, 'deleted', id FROM sessions WHERE deleted_at IS NOT NULL UNION ALL SELECT loaded_at, 'document', doc_id::VARCHAR FROM documents WHERE loaded_at IS NOT NULL) SELECT DISTINCT strftime("at", '%Y-%m-%d %H:%M:%S') AS "at", kind, id FROM (SELECT * FROM e ORDER BY "at" DESC, kind, id LIMIT 50)""")
def w12_timeline(spark, d):
    """The last 50 events of the store."""
    s, docs = table(spark, d, "sessions"), table(spark, d, "documents")
    parts = [s.select(F.col("loaded_at").alias("at"), F.lit("session").alias("kind"), "id"), s.select("deleted_at", F.lit("deleted"), "id").toDF("at", "kind", "id"), docs.select("loaded_at", F.lit("document"), F.col("doc_id").cast("string")).toDF("at", "kind", "id")]
    last = reduce(DataFrame.unionByName, parts).where("at is not null").orderBy(F.desc("at"), "kind", "id").limit(50)
    return last.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "kind", "id").distinct()


@query(f"SELECT id, seminar_id FROM (SELECT id, seminar_id FROM {ONCE} QUALIFY row_number() OVER (PARTITION BY seminar_id ORDER BY id) <= 3) ORDER BY id LIMIT 100")
def w14_stratified(spark, d):
    """Three passages of each seminar, 100 in all."""
    return windows.first_n(_passages(spark, d, "seminar_id"), ["seminar_id"], ["id"], 3).orderBy("id").limit(100).select("id", "seminar_id")


@query(f"SELECT id FROM (SELECT * FROM (SELECT id, seminar_id, session_id, language, sha256(id) AS h FROM {ONCE} QUALIFY row_number() OVER (PARTITION BY seminar_id, session_id, language ORDER BY sha256(id), id) <= 2) QUALIFY row_number() OVER (PARTITION BY seminar_id ORDER BY h, id) <= 6)")
def w15_capped_sample(spark, d):
    """A sample in hash order with caps by session and language, then by seminar."""
    p = _passages(spark, d, "seminar_id", "session_id", "language")
    return windows.hash_sample(windows.hash_sample(p, ["seminar_id", "session_id", "language"], "id", 2), ["seminar_id"], "id", 6).select("id")


@query("""WITH RECURSIVE p AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x, ' ')), lambda x: length(x) > 60) AS ps FROM documents WHERE text IS NOT NULL AND seminar_id IS NOT NULL))),
    r(doc_id, k, n, open) AS (SELECT doc_id, k, 1, length(part) FROM p WHERE k = 1 UNION ALL SELECT r.doc_id, p.k, CASE WHEN open + 2 + length(part) > 200 THEN n + 1 ELSE n END, CASE WHEN open + 2 + length(part) > 200 THEN length(part) ELSE open + 2 + length(part) END FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1)
    SELECT regexp_extract(seminar_id, '(S[0-9]+)$', 1) || '.L' || lpad(((seq - 1) // 25 + 1)::VARCHAR, 2, '0') || '.P' || lpad(((seq - 1) % 25 + 1)::VARCHAR, 4, '0') AS key, doc_id FROM (SELECT seminar_id, s.doc_id, row_number() OVER (PARTITION BY seminar_id ORDER BY s.doc_id, n) AS seq FROM (SELECT DISTINCT doc_id, n FROM r) s JOIN documents USING (doc_id))""")
def s14_lessons(spark, d):
    """Segments of a seminar's documents in lessons of 25, with their keys."""
    docs = table(spark, d, "documents").where("text is not null and seminar_id is not null")
    s = segments(docs.select("doc_id", "text"), "doc_id", "text", least=60, target=200).select("doc_id", "n").join(docs.select("doc_id", "seminar_id"), "doc_id")
    q = windows.numbered_evenly(s, ["seminar_id"], ["doc_id", "n"], "seq").withColumn("seq", F.col("seq").cast("long"))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return q.select(F.concat(F.regexp_extract("seminar_id", "(S[0-9]+)$", 1), F.lit(".L"), pad(F.floor((F.col("seq") - 1) / 25) + 1, 2), F.lit(".P"), pad((F.col("seq") - 1) % 25 + 1, 4)).alias("key"), "doc_id")


_ITEMS = """(SELECT id, fr_title AS title, CASE WHEN coalesce(lessons, 0) % 3 = 0 THEN 'ftp' ELSE 'https' END || '://example.org/' || id AS url, year_from AS y FROM seminars QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"""


@query(f"SELECT id, CASE WHEN title IS NULL THEN 'missing_title' WHEN NOT regexp_matches(url, '^https?://') THEN 'bad_url' WHEN y IS NULL THEN 'missing_year' END AS reason FROM {_ITEMS} ORDER BY id LIMIT 50")
def s19_import(spark, d):
    """Bibliographic items read from JSON, 50 at most; each is taken or rejected with a reason."""
    s = windows.first_wins(table(spark, d, "seminars"), ["id"], ["loaded_at"])
    url = F.concat(F.when(F.coalesce("lessons", F.lit(0)) % 3 == 0, "ftp").otherwise("https"), F.lit("://example.org/"), "id")
    items = s.select(F.to_json(F.struct("id", F.col("fr_title").alias("title"), url.alias("URL"), F.struct(F.array(F.array("year_from")).alias("date-parts")).alias("issued"))).alias("item"))
    return exports.csl_items(items, "item", 50).select("id", "reason")


@query(f"SELECT id, '@book{{' || replace(id, '.', '_') || ', title = {{' || title || '}}' || CASE WHEN y IS NULL THEN '' ELSE ', year = {{' || y || '}}' END || '}}' AS bibtex, '## ' || title || CASE WHEN y IS NULL THEN '' ELSE ' (' || y || ')' END AS markdown, '<h2>' || replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</h2>' AS html FROM {_ITEMS} WHERE title IS NOT NULL")
def s20_exports(spark, d):
    """The seminars as BibTeX, Markdown and HTML."""
    s = windows.first_wins(table(spark, d, "seminars"), ["id"], ["loaded_at"]).where("fr_title is not null").select("id", F.col("fr_title").alias("title"), F.col("year_from").alias("year"))
    return s.select("id", exports.bibtex("id", "title", "year").alias("bibtex"), exports.markdown("title", "year").alias("markdown"), exports.html("title").alias("html"))


@query(f"SELECT (SELECT count(*) FROM {ONCE} WHERE language = 'fr') AS total, (SELECT count(*) FROM {ONCE} WHERE language = 'fr' AND id > 'passage.S20.') AS remaining, (SELECT count(*) FROM {ONCE}) AS everything")
def a1_totals(spark, d):
    """Rows in all, under the filters, and beyond the page's cursor: three different counts."""
    p = _passages(spark, d, "language")
    fr = F.col("language") == "fr"
    return p.agg(F.count_if(fr).alias("total"), F.count_if(fr & (F.col("id") > "passage.S20.")).alias("remaining"), F.count("*").alias("everything"))


@query(f"SELECT seminar_id, language, trace_status, lesson, grouping_id(seminar_id, language, trace_status, lesson)::INTEGER AS level, count(*) AS n FROM {ONCE} GROUP BY GROUPING SETS ((seminar_id, language), (seminar_id, trace_status), (seminar_id, lesson))")
def a3_breakdown(spark, d):
    """Each seminar by language, by trace and by lesson, in one pass."""
    p = _passages(spark, d, "seminar_id", "language", "trace_status", "lesson")
    c = {k: F.col(k) for k in ("seminar_id", "language", "trace_status", "lesson")}
    return p.groupingSets([[c["seminar_id"], c[k]] for k in ("language", "trace_status", "lesson")], *c.values()).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


@query("SELECT source, lang, doc_kind, month, size, grouping_id(source, lang, doc_kind, month, size)::INTEGER AS level, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT *, strftime(loaded_at, '%Y-%m') AS month, length(n_chars::VARCHAR) AS size FROM documents) GROUP BY GROUPING SETS ((source), (lang), (doc_kind), (month), (size), ())")
def a5_inventory(spark, d):
    """Five histograms of the documents and the totals, in one pass."""
    docs = table(spark, d, "documents").select("source", "lang", "doc_kind", F.date_format("loaded_at", "yyyy-MM").alias("month"), F.length(F.col("n_chars").cast("string")).cast("long").alias("size"), "n_chars")
    names = ("source", "lang", "doc_kind", "month", "size")
    return docs.groupingSets([*([F.col(c)] for c in names), []], *names).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""WITH u AS {_usability('raw_text', ONCE, 'id, authority_level, raw_text')}, c AS (SELECT 'usability' AS kind, usability AS value, id FROM u UNION ALL SELECT 'layer', authority_level, id FROM u UNION ALL SELECT DISTINCT 'symbol', unnest(regexp_extract_all(raw_text, '[§°%…«»]')), id FROM u)
    SELECT kind, value, count(*) AS n, array_to_string(list_sort(list(id))[1:3], ',') AS examples FROM c GROUP BY ALL""")
def a8_census(spark, d):
    """Symbols, usability classes and layers of the store, with three examples each."""
    p = _passages(spark, d, "authority_level", R.usability(F.col("raw_text")).alias("usability"), F.array_distinct(F.regexp_extract_all("raw_text", F.lit("([§°%…«»])"), F.lit(1))).alias("symbols"))
    kinds = F.concat(F.array(F.struct(F.lit("usability").alias("kind"), F.col("usability").alias("value")), F.struct(F.lit("layer").alias("kind"), F.col("authority_level").alias("value"))), F.coalesce(F.transform("symbols", lambda s: F.struct(F.lit("symbol").alias("kind"), s.alias("value"))), F.array().cast("array<struct<kind:string,value:string>>")))
    rows = p.select("id", F.inline(kinds))
    n = rows.groupBy("kind", "value").agg(F.count("*").alias("n"))
    few = windows.first_n(rows, ["kind", "value"], ["id"], 3).groupBy("kind", "value").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("examples"))
    return n.join(few, [n.kind == few.kind, n.value.eqNullSafe(few.value)]).select(n.kind, n.value, "n", "examples")


@query(f"""WITH e AS (SELECT DISTINCT expr, seminar_id, id FROM (SELECT id, seminar_id, replace(unnest(regexp_extract_all(raw_text, '(§ ?[0-9]+\\.[0-9]+)', 1)), ' ', '') AS expr FROM {ONCE}))
    SELECT expr, replace(expr, '§', '') AS equivalent, count(*) AS n, count(DISTINCT seminar_id) AS seminars, array_to_string(list_sort(list(id))[1:5], ',') AS sample FROM e GROUP BY 1""")
def a11_formula_samples(spark, d):
    """Expressions with their equivalent key, passages, seminars and five samples."""
    rows = _passages(spark, d, "seminar_id", F.array_distinct(F.transform(F.regexp_extract_all("raw_text", F.lit("(§ ?[0-9]+\\.[0-9]+)"), F.lit(1)), X.matheme)).alias("es"), where=F.contains("raw_text", F.lit("§"))).select("id", "seminar_id", F.explode("es").alias("expr"))
    n = rows.groupBy("expr").agg(F.count("*").alias("n"), F.countDistinct("seminar_id").alias("seminars"))
    few = windows.first_n(rows, ["expr"], ["id"], 5).groupBy("expr").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("sample"))
    return n.join(few, "expr").select("expr", F.replace("expr", F.lit("§"), F.lit("")).alias("equivalent"), "n", "seminars", "sample")


@query(f"SELECT seminar_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM {ONCE} WHERE contains(lower(raw_text), 'fleuve') GROUP BY 1")
def a12_distribution(spark, d):
    """The seminars' shares of a concept's passages."""
    n = _passages(spark, d, "seminar_id", where=F.contains(F.lower("raw_text"), F.lit("fleuve"))).groupBy("seminar_id").agg(F.count("*").alias("n"))
    return n.select("seminar_id", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))  # a row per seminar


@query(f"SELECT language, count(*) AS n, count(DISTINCT session_id) AS sessions, count(DISTINCT seminar_id) AS seminars, count(DISTINCT coalesce(year_from // 10, -1)) AS periods FROM {ONCE} WHERE contains(lower(raw_text), 'lettre') GROUP BY 1")
def a6_periods(spark, d):
    """Coverage of a form: sessions, seminars and decades."""
    p = _passages(spark, d, "language", "session_id", "seminar_id", F.coalesce(F.floor(F.col("year_from") / 10), F.lit(-1)).alias("decade"), where=F.contains(F.lower("raw_text"), F.lit("lettre")))
    return p.groupBy("language").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("seminar_id").alias("seminars"), F.countDistinct("decade").alias("periods"))


@query(f"SELECT trace_status, coalesce(witness_id, 'none') AS witness, source_state AS source, count(*) AS n FROM {ONCE} GROUP BY ALL")
def a7_sources(spark, d):
    """Passages by trace, witness and state of the source."""
    return _passages(spark, d, "trace_status", F.coalesce("witness_id", F.lit("none")).alias("witness"), F.col("source_state").alias("source")).groupBy("trace_status", "witness", "source").agg(F.count("*").alias("n"))


_CLAIM = "le miroir fragile traverse la lettre"


@query("""WITH s AS (SELECT source, CASE WHEN k = 0 THEN 'E0' WHEN k < 0.3 THEN 'E1' WHEN k < 0.6 THEN 'E2' ELSE 'E3' END AS strength FROM (SELECT source, len(list_intersect(['miroir', 'fragile', 'traverse', 'lettre'], list_filter(string_split(""" + norm_fr("text") + """, ' '), lambda w: w <> ''))) / 4 AS k FROM documents WHERE text IS NOT NULL))
    SELECT source, count(*) AS n, count(*) FILTER (strength = 'E0') AS e0, count(*) FILTER (strength = 'E1') AS e1, count(*) FILTER (strength = 'E2') AS e2, count(*) FILTER (strength = 'E3') AS e3, round(count(*) FILTER (strength <> 'E0') / count(*), 4) AS rate FROM s GROUP BY 1""")
def a22_strengths(spark, d):
    """How strongly the documents of each source bear a claim: histogram and rate."""
    mine = F.array(*map(F.lit, ("miroir", "fragile", "traverse", "lettre")))
    k = F.size(F.array_intersect(mine, F.split(X.norm_fr(F.col("text")), " "))) / 4
    s = table(spark, d, "documents").where("text is not null").select("source", F.when(k == 0, "E0").when(k < 0.3, "E1").when(k < 0.6, "E2").otherwise("E3").alias("strength"))
    levels = [F.count_if(F.col("strength") == e).alias(e.lower()) for e in ("E0", "E1", "E2", "E3")]
    return s.groupBy("source").agg(F.count("*").alias("n"), *levels, F.round(F.count_if(F.col("strength") != "E0") / F.count("*"), 4).alias("rate"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(sum(value), 4) AS total, round(count(*) FILTER (value > 50) / count(*), 4) AS rate, round(avg(nullif(value, 0)), 4) AS mean_of_some, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def a23_run_metrics(spark, d):
    """Means, sums and rates side by side; there is no composite score. Nulls are left out of means (A21)."""
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.sum(v), 4).alias("total"), F.round(F.count_if(v > 50) / F.count("*"), 4).alias("rate"), F.round(F.avg(F.nullif(v, F.lit(0.0))), 4).alias("mean_of_some"), F.countDistinct("user_id").alias("users"))


@query("SELECT seminar_id, count(*) AS sessions, count(passage_count) AS counted, round(avg(passage_count), 4) AS mean FROM (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at, passage_count) = 1) GROUP BY 1")
def a21_null_means(spark, d):
    """Macro means that leave nulls out and say how many there were."""
    s = windows.first_wins(table(spark, d, "sessions").select("id", "seminar_id", "loaded_at", "passage_count"), ["id"], ["loaded_at", F.col("passage_count").asc_nulls_last()])
    return s.groupBy("seminar_id").agg(F.count("*").alias("sessions"), F.count("passage_count").alias("counted"), F.round(F.avg("passage_count"), 4).alias("mean"))


@query("WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), i AS (SELECT h, min(doc_id) AS first FROM d GROUP BY 1) SELECT first, count(*) AS n FROM d JOIN i USING (h) GROUP BY 1")
def j6_by_hash(spark, d):
    """The inventory's document of each content, the first of several, found by its hash."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "h").groupBy("first").agg(F.count("*").alias("n"))


RULES = {"mirror": (["miroir"], [["lettre", "fleuve"]], ["silence"], None), "river": (["fleuve", "ruisseau"], [], ["miroir"], "S1"), "both": (["lettre"], [["miroir"], ["fleuve", "ruisseau"]], [], None)}


def _rule_sql(name: str) -> str:
    forms, require, exclude, scope = RULES[name]
    some = lambda fs: "(" + " OR ".join(f"contains(t, '{f}')" for f in fs) + ")"
    parts = [some(forms), *map(some, require), *(f"NOT {some([f])}" for f in exclude), *([f"contains(coalesce(seminar_id, ''), '{scope}')"] if scope else [])]
    return f"SELECT '{name}' AS rule, id, seminar_id FROM (SELECT id, seminar_id, lower(raw_text) AS t FROM {ONCE}) WHERE {' AND '.join(parts)}"


@query(f"SELECT rule, count(*) AS n, count(DISTINCT seminar_id) AS seminars, min(id) AS first FROM ({' UNION ALL '.join(map(_rule_sql, RULES))}) GROUP BY 1")
def j10_evidence_rules(spark, d):
    """Passages that meet rules of forms, required company, exclusions and scope: one scan for all rules."""
    t = F.lower("raw_text")
    some = lambda fs: reduce(lambda a, b: a | b, [F.contains(t, F.lit(f)) for f in fs])

    def holds(forms, require, exclude, scope):
        parts = [some(forms), *map(some, require), *(~some([f]) for f in exclude), *([F.contains(F.coalesce("seminar_id", F.lit("")), F.lit(scope))] if scope else [])]
        return reduce(lambda a, b: a & b, parts)

    met = F.array_compact(F.array(*(F.when(holds(*r), F.lit(k)) for k, r in RULES.items())))
    rows = _passages(spark, d, "seminar_id", met.alias("rules")).select("id", "seminar_id", F.explode("rules").alias("rule"))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.countDistinct("seminar_id").alias("seminars"), F.min("id").alias("first"))


@query(f"""SELECT chain, count(*) AS n FROM (SELECT concat_ws('>', 'passage', CASE WHEN w.id IS NOT NULL THEN 'witness' END, CASE WHEN w.c IS NOT NULL THEN 'corpus_source' END, CASE WHEN p.translation_id IS NOT NULL THEN 'translation' END, CASE WHEN p.realized > 0 THEN 'realized' END) AS chain
    FROM (SELECT p.*, (SELECT count(*) FROM passage_source_map m WHERE m.passage_id = p.id AND m.witness_id IS DISTINCT FROM p.witness_id) AS realized FROM {ONCE} p) p LEFT JOIN (SELECT id, min(corpus_source_id) AS c FROM witnesses GROUP BY 1) w ON w.id = p.witness_id) GROUP BY 1""")
def j3_translation_chain(spark, d):
    """The steps of provenance that are there, down to the translation and other witnesses that carry the passage (J5)."""
    w = table(spark, d, "witnesses").groupBy(F.col("id").alias("witness_id")).agg(F.min("corpus_source_id").alias("c"), F.lit(True).alias("w"))
    p = _passages(spark, d, "witness_id", "translation_id")
    m = table(spark, d, "passage_source_map").select(F.col("passage_id").alias("id"), F.col("witness_id").alias("other"))
    realized = p.select("id", "witness_id").join(m, "id").where(~F.col("witness_id").eqNullSafe(F.col("other"))).select("id").distinct().withColumn("r", F.lit(True))
    steps = [F.lit("passage"), F.when(F.col("w"), "witness"), F.when(F.col("c").isNotNull(), "corpus_source"), F.when(F.col("translation_id").isNotNull(), "translation"), F.when(F.col("r"), "realized")]
    return p.join(w, "witness_id", "left").join(realized, "id", "left").groupBy(F.concat_ws(">", *steps).alias("chain")).agg(F.count("*").alias("n"))


@query(f"WITH s AS (SELECT id, provenance.source_segment_id AS seg, language FROM {ONCE}), m AS (SELECT seg, min(id) AS first, count(*) AS n FROM s WHERE seg IS NOT NULL GROUP BY 1), q AS (SELECT DISTINCT coalesce(seg, 'none') AS seg FROM s UNION SELECT 'fr-s99-1') SELECT q.seg AS segment, first, coalesce(n, 0) AS n FROM q LEFT JOIN m USING (seg) WHERE coalesce(n, 0) <> 1")
def j16_segments(spark, d):
    """Source segments that name no passage, or several."""
    s = _passages(spark, d, F.col("provenance.source_segment_id").alias("segment"))
    m = s.where("segment is not null").groupBy("segment").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    asked = s.select(F.coalesce("segment", F.lit("none")).alias("segment")).distinct().unionByName(spark.createDataFrame([("fr-s99-1",)], "segment string")).distinct()
    return asked.join(m, "segment", "left").select("segment", "first", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


@query("""WITH c AS (SELECT DISTINCT id, min(canonical_name) OVER (PARTITION BY id) AS label FROM spec), o AS (SELECT DISTINCT unnest(distinction_from) AS id FROM spec) SELECT coalesce(c.id, o.id) AS id, label, concat_ws('+', CASE WHEN c.id IS NOT NULL THEN 'catalogue' END, CASE WHEN o.id IS NOT NULL THEN 'ontology' END) AS layers FROM c FULL OUTER JOIN o ON c.id = o.id""")
def j12_catalogue(spark, d):
    """The catalogue and the entities that others are told from, with the layers each is in."""
    spec = table(spark, d, "spec")
    c = spec.groupBy("id").agg(F.min("canonical_name").alias("label"), F.lit(True).alias("c"))
    o = spec.select(F.explode("distinction_from").alias("id")).distinct().withColumn("o", F.lit(True))
    return c.join(o, "id", "full_outer").select("id", "label", F.concat_ws("+", F.when(F.col("c"), "catalogue"), F.when(F.col("o"), "ontology")).alias("layers"))


@query("""WITH s AS (SELECT id, review_status, distinction_from FROM spec WHERE id IS NOT NULL), e AS (SELECT id AS a, unnest(distinction_from) AS b, review_status FROM s) SELECT a AS id, count(*) FILTER (review_status = 'reviewed') AS drawn, count(*) FILTER (review_status <> 'reviewed') AS candidates, string_agg(CASE WHEN review_status = 'reviewed' THEN b END, ',' ORDER BY b) AS neighbours FROM (SELECT * FROM e UNION ALL SELECT b, a, review_status FROM e) GROUP BY 1""")
def r24_concept_graph(spark, d):
    """Each concept's neighbours by reviewed relations; candidates are counted, not drawn (C18)."""
    e = table(spark, d, "spec").where("id is not null").select(F.col("id").alias("a"), F.explode("distinction_from").alias("b"), "review_status")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "review_status"))
    good = F.col("review_status") == "reviewed"
    names = F.array_join(F.sort_array(F.collect_list(F.when(good, F.col("b")))), ",")
    return both.groupBy(F.col("a").alias("id")).agg(F.count_if(good).alias("drawn"), F.count_if(~good).alias("candidates"), F.nullif(names, F.lit("")).alias("neighbours"))


@query("""WITH RECURSIVE e AS (SELECT id AS a, unnest(distinction_from) AS b FROM spec WHERE review_status = 'reviewed'), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), s AS (SELECT DISTINCT id AS node FROM spec WHERE len(distinction_from) > 0 AND review_status = 'reviewed' ORDER BY id LIMIT 5),
    d1 AS (SELECT b AS node, min(s.node) AS via FROM s JOIN u ON u.a = s.node WHERE b NOT IN (SELECT node FROM s) GROUP BY 1), d2 AS (SELECT b AS node, min(d1.via || '>' || d1.node) AS via FROM d1 JOIN u ON u.a = d1.node WHERE b NOT IN (SELECT node FROM s) AND b NOT IN (SELECT node FROM d1) GROUP BY 1)
    SELECT node, depth::INTEGER AS depth, reason FROM (SELECT node, 0 AS depth, node AS reason FROM s UNION ALL SELECT node, 1, via || '>' || node FROM d1 UNION ALL SELECT node, 2, via || '>' || node FROM d2) ORDER BY depth, node LIMIT 40""")
def r23_reasons(spark, d):
    """Reviewed relations up to two steps away, with the first path to each entity, 40 entities at most."""
    spec = table(spark, d, "spec").where("review_status = 'reviewed'")
    e = spec.select(F.col("id").alias("a"), F.explode("distinction_from").alias("b"))
    start = spec.where("size(distinction_from) > 0").select(F.col("id").alias("node")).distinct().orderBy("node").limit(5)
    return retrieval.paths(e, start, 2).orderBy("depth", "node").limit(40)


@query("SELECT id, witness_kind, edition FROM witnesses WHERE language = 'fr' AND witness_kind IN ('print_edition', 'transcription') AND contains(lower(coalesce(edition, '')), 'a') AND coalesce(nullif(regexp_extract(edition, '((?:19|20)[0-9]{2})', 1), '')::INTEGER, 1970) BETWEEN 1960 AND 1985 GROUP BY ALL")
def r34_bibliography(spark, d):
    """Witnesses by language, kind, words and year; unknown years are let through."""
    year = F.coalesce(F.nullif(F.regexp_extract("edition", "((?:19|20)[0-9]{2})", 1), F.lit("")).cast("int"), F.lit(1970))
    w = table(spark, d, "witnesses").where((F.col("language") == "fr") & F.col("witness_kind").isin("print_edition", "transcription") & F.contains(F.lower(F.coalesce("edition", F.lit(""))), F.lit("a")) & year.between(1960, 1985))
    return w.select("id", "witness_kind", "edition").distinct()


_NESTED = ("aliases", "context_required_aliases", "distinction_from")


@query("SELECT DISTINCT field, id, item FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, id, unnest({c}) AS item FROM spec" for c in _NESTED) + f" UNION ALL SELECT 'trace_missing', id, unnest(trace_missing) FROM {ONCE} WHERE id < 'passage.S05' UNION ALL SELECT 'normalization_operations', id, unnest(normalization_operations) FROM {ONCE} WHERE id < 'passage.S05') WHERE contains(lower(item), 'mir')".replace(" WHERE id < 'passage.S05'", ""))
def r35_nested_search(spark, d):
    """Words looked for in every nested list, with where they stand."""
    spec = table(spark, d, "spec")
    parts = [spec.select(F.lit(c).alias("field"), "id", F.explode(c).alias("item")) for c in _NESTED]
    parts += [_passages(spark, d, c).select(F.lit(c).alias("field"), "id", F.explode(c).alias("item")) for c in ("trace_missing", "normalization_operations")]
    return reduce(DataFrame.unionByName, parts).where(F.contains(F.lower("item"), F.lit("mir"))).distinct()


@query(f"""WITH a AS (SELECT id, witness_id FROM {ONCE} WHERE witness_id IS NOT NULL), b AS (SELECT passage_id AS id, min(witness_id) AS witness_id FROM passage_source_map WHERE witness_id IS NOT NULL GROUP BY 1)
    SELECT coalesce(a.id, b.id) AS id, coalesce(a.witness_id, b.witness_id) AS witness_id, concat_ws(',', CASE WHEN a.id IS NULL THEN 'map_only' END, CASE WHEN a.witness_id <> b.witness_id THEN 'witness_differs' END) AS warnings FROM a FULL OUTER JOIN b ON a.id = b.id""")
def u3_merged_evidence(spark, d):
    """Two sources of evidence merged: the first one's row counts, the warnings of both are kept."""
    a = _passages(spark, d, F.col("witness_id").alias("x"), where="witness_id is not null")
    b = table(spark, d, "passage_source_map").where("witness_id is not null").groupBy(F.col("passage_id").alias("id")).agg(F.min("witness_id").alias("y"))
    warnings = F.concat_ws(",", F.when(F.col("x").isNull(), "map_only"), F.when(F.col("x") != F.col("y"), "witness_differs"))
    return a.join(b, "id", "full_outer").select("id", F.coalesce("x", "y").alias("witness_id"), warnings.alias("warnings"))


@query(f"{lexical._COMP}, a AS (SELECT query, item, rank FROM comp WHERE component = 'E'), b AS (SELECT query, item, rank FROM comp WHERE component = 'L') SELECT query, item, CASE WHEN a.rank IS NULL THEN 'added' WHEN b.rank IS NULL THEN 'removed' WHEN a.rank = b.rank THEN 'same' ELSE 'moved' END AS state FROM a FULL OUTER JOIN b USING (query, item)")
def u7_run_diff(spark, d):
    """What differs between the lists of two runs."""
    lists = lexical._components(spark, d)
    a, b = (lists.where(F.col("component") == c).select("query", "item", F.col("rank").alias(n)) for c, n in (("E", "x"), ("L", "y")))
    state = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x") == F.col("y"), "same").otherwise("moved")
    return a.join(b, ["query", "item"], "full_outer").select("query", "item", state.alias("state"))


@query(f"SELECT page, id FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 20 AS page FROM {ONCE} WHERE language = 'zh') WHERE page < 3")
def k5_cursor_pages(spark, d):
    """Three pages, each from the cursor of the one before; the cursor holds to its filters."""
    chosen, token, pages = {"language": "zh"}, None, []
    p = _passages(spark, d, where=filters.equals(chosen))
    for n in range(3):
        after = None if token is None else filters.resume(token, chosen)
        page = filters.keyset_page(p, ["id"], after, 20)
        rows = [r.id for r in page.collect()]  # a page
        pages += [(n, i) for i in rows[:20]]
        if len(rows) <= 20:
            break
        token = filters.cursor(chosen, (rows[19],))
    return spark.createDataFrame(pages, "page long, id string")


_GATES = {
    "duplicate_sessions": "SELECT count(*) - count(DISTINCT id) AS n FROM sessions", "null_session_keys": "SELECT count(*) AS n FROM sessions WHERE id IS NULL", "bad_passage_ids": "SELECT count(*) AS n FROM passages WHERE NOT regexp_matches(id, '^passage\\.S[0-9]{2}\\.')",
    "bad_session_dates": "SELECT count(*) AS n FROM sessions WHERE session_date <> 'unknown' AND NOT regexp_matches(session_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')", "unknown_languages": "SELECT count(*) AS n FROM passages WHERE language NOT IN ('fr', 'zh')", "unknown_roles": "SELECT count(*) AS n FROM passages WHERE text_role NOT IN ('transcription', 'translation', 'edition', 'note')",
    "bad_authority": "SELECT count(*) AS n FROM passages WHERE authority_level NOT IN ('L0', 'L1', 'L2', 'L3', 'L4')", "years_reversed": "SELECT count(*) AS n FROM passages WHERE year_to < year_from", "null_texts": "SELECT count(*) AS n FROM passages WHERE raw_text IS NULL", "silent_traces": "SELECT count(*) AS n FROM passages WHERE trace_status = 'SOURCE_TRACE_INCOMPLETE' AND coalesce(len(trace_missing), 0) = 0",
    "traces_too_many": "SELECT count(*) AS n FROM passages WHERE trace_status = 'COMPLETE' AND len(trace_missing) > 0", "silent_changes": "SELECT count(*) AS n FROM passages WHERE raw_text <> normalized_text AND coalesce(len(normalization_operations), 0) = 0", "canonical_unreviewed": "SELECT count(*) AS n FROM passages WHERE canonical AND review_status <> 'reviewed'",
    "null_documents": "SELECT count(*) AS n FROM documents WHERE text IS NULL", "wrong_sizes": "SELECT count(*) AS n FROM documents WHERE length(text) <> n_chars", "deleted_seminars": "SELECT count(*) AS n FROM seminars WHERE deleted_at IS NOT NULL", "entities_without_name": "SELECT count(*) AS n FROM spec WHERE trim(coalesce(canonical_name, '')) = ''",
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS gate, n, n = 0 AS passed FROM ({s})" for k, s in _GATES.items()))
def c14_gates(spark, d):
    """Seventeen counters that must be zero; one aggregation per table."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    of = {
        "sessions": {"duplicate_sessions": F.count("*") - F.countDistinct("id"), "null_session_keys": F.count_if(F.col("id").isNull()), "bad_session_dates": F.count_if((F.col("session_date") != "unknown") & ~F.col("session_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))},
        "passages": {
            "bad_passage_ids": F.count_if(~F.col("id").rlike("^passage\\.S[0-9]{2}\\.")), "unknown_languages": F.count_if(~F.col("language").isin("fr", "zh")), "unknown_roles": F.count_if(~F.col("text_role").isin("transcription", "translation", "edition", "note")), "bad_authority": F.count_if(~F.col("authority_level").isin("L0", "L1", "L2", "L3", "L4")),
            "years_reversed": F.count_if(F.col("year_to") < F.col("year_from")), "null_texts": F.count_if(F.col("raw_text").isNull()), "silent_traces": F.count_if((F.col("trace_status") == "SOURCE_TRACE_INCOMPLETE") & (size("trace_missing") == 0)), "traces_too_many": F.count_if((F.col("trace_status") == "COMPLETE") & (size("trace_missing") > 0)),
            "silent_changes": F.count_if((F.col("raw_text") != F.col("normalized_text")) & (size("normalization_operations") == 0)), "canonical_unreviewed": F.count_if(F.col("canonical") & (F.col("review_status") != "reviewed")),
        },
        "documents": {"null_documents": F.count_if(F.col("text").isNull()), "wrong_sizes": F.count_if(F.length("text") != F.col("n_chars"))}, "seminars": {"deleted_seminars": F.count_if(F.col("deleted_at").isNotNull())}, "spec": {"entities_without_name": F.count_if(F.trim(F.coalesce("canonical_name", F.lit(""))) == "")},
    }
    rows = [table(spark, d, t).agg(*(c.alias(k) for k, c in counters.items())).select(F.explode(F.array(*(F.struct(F.lit(k).alias("gate"), F.col(k).cast("long").alias("n")) for k in counters))).alias("x")).select("x.*") for t, counters in of.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("passed", F.col("n") == 0)


@query(f"SELECT kind, CASE WHEN lower(review_status) IN ('reviewed', 'approved') THEN 'reviewed' ELSE 'candidate' END AS side, count(*) AS n FROM (SELECT 'passage' AS kind, review_status FROM {ONCE} UNION ALL SELECT 'entity', review_status FROM spec) GROUP BY ALL")
def c18_review_split(spark, d):
    """Reviewed and candidate records, never mixed."""
    side = F.when(F.lower("review_status").isin("reviewed", "approved"), "reviewed").otherwise("candidate").alias("side")
    rows = _passages(spark, d, "review_status").select(F.lit("passage").alias("kind"), "review_status").unionByName(table(spark, d, "spec").select(F.lit("entity").alias("kind"), "review_status"))
    return rows.groupBy("kind", side).agg(F.count("*").alias("n"))


@query(f"SELECT seminar_id, n, period FROM (SELECT p.seminar_id, n, CASE WHEN s.year_from IS NOT NULL THEN s.year_from || '-' || coalesce(s.year_to, s.year_from) WHEN k <= 15 THEN 'early' WHEN k <= 40 THEN 'middle' WHEN k IS NOT NULL THEN 'late' ELSE 'unknown' END AS period FROM (SELECT seminar_id, count(*) AS n, nullif(regexp_extract(seminar_id, '([0-9]+)$', 1), '')::INTEGER AS k FROM {ONCE} GROUP BY 1) p LEFT JOIN (SELECT id, year_from, year_to FROM seminars QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1) s ON s.id = p.seminar_id)")
def f13_fallback_periods(spark, d):
    """A seminar's period by its years, else by its place in the list of periods."""
    s = windows.first_wins(table(spark, d, "seminars"), ["id"], ["loaded_at"]).select(F.col("id").alias("seminar_id"), "year_from", "year_to")
    n = _passages(spark, d, "seminar_id").groupBy("seminar_id").agg(F.count("*").alias("n")).withColumn("k", F.nullif(F.regexp_extract("seminar_id", "([0-9]+)$", 1), F.lit("")).cast("int"))
    period = F.when(F.col("year_from").isNotNull(), F.concat_ws("-", "year_from", F.coalesce("year_to", "year_from"))).when(F.col("k") <= 15, "early").when(F.col("k") <= 40, "middle").when(F.col("k").isNotNull(), "late").otherwise("unknown")
    return n.join(s, "seminar_id", "left").select("seminar_id", "n", period.alias("period"))


_V = f"""v AS (SELECT query, item, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (SELECT q.vec_id AS query, e.vec_id AS item, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % {search.EVERY} = 0) QUALIFY rank <= {search.TOP}),
    g AS (SELECT q.vec_id AS query, e.vec_id AS item, q.label AS class FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % {search.EVERY} = 0)"""


def _class(spark, d):
    return table(spark, d, "embeddings").where(F.col("vec_id") % search.EVERY == 0).select(F.col("vec_id").alias("query"), F.col("label").alias("class"))


@query(f"WITH {_V} SELECT class, count(*) AS queries, round(avg(hit), 4) AS top1 FROM (SELECT q.query, q.class, max(CASE WHEN v.rank = 1 AND g.item IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM (SELECT vec_id AS query, label AS class FROM embeddings WHERE vec_id % {search.EVERY} = 0) q LEFT JOIN v ON v.query = q.query LEFT JOIN g ON g.query = v.query AND g.item = v.item GROUP BY ALL) GROUP BY 1")
def e6_top1(spark, d):
    """Precision of the first hit, by class of query."""
    return evaluation.top1(search.r16_vector_topk(spark, d), search._gold(spark, d), _class(spark, d))


@query(f"""{lexical._COMP}, cfg(config, component) AS (VALUES ('E+L+X', 'E'), ('E+L+X', 'L'), ('E+L+X', 'X'), ('-E', 'L'), ('-E', 'X'), ('-L', 'E'), ('-L', 'X'), ('-X', 'E'), ('-X', 'L')), gold AS (SELECT s.id AS query, p.id AS item FROM spec s JOIN {ONCE} p ON contains(lower(raw_text), lower(fr)) WHERE s.id IN {lexical.ENTITIES} GROUP BY ALL),
    f AS (SELECT config, query, item, row_number() OVER (PARTITION BY config, query ORDER BY score DESC, item) AS rank FROM (SELECT config, query, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM comp JOIN cfg USING (component) GROUP BY ALL) QUALIFY rank <= 10),
    r AS (SELECT c.config, g.query, count(f.item) / count(*) AS recall FROM (SELECT DISTINCT config FROM cfg) c CROSS JOIN gold g LEFT JOIN f ON f.config = c.config AND f.query = g.query AND f.item = g.item GROUP BY ALL), m AS (SELECT config, avg(recall) AS recall FROM r GROUP BY 1)
    SELECT substring(config, 2) AS component, round((SELECT recall FROM m WHERE config = 'E+L+X') - recall, 6) AS marginal FROM m WHERE config <> 'E+L+X'""")
def e7_leave_one_out(spark, d):
    """What each component adds to the recall of all together."""
    lists = lexical._components(spark, d)
    names = table(spark, d, "spec").where(F.col("id").isin(*lexical.ENTITIES)).select("id", F.lower("fr").alias("fr")).distinct().collect()  # of the few entities asked
    held = F.array_compact(F.array(*(F.when(F.contains(F.lower("raw_text"), F.lit(r.fr)), F.lit(r.id)) for r in names)))
    gold = _passages(spark, d, held.alias("held")).select(F.explode("held").alias("query"), F.col("id").alias("item")).distinct()
    return evaluation.leave_one_out(lists, gold, ["E", "L", "X"], 10)


@query(f"""WITH p AS (SELECT id, lower(raw_text) AS t, length(raw_text) AS n FROM {ONCE}), l AS (SELECT lane, id, row_number() OVER (PARTITION BY lane ORDER BY n DESC, id) AS rank FROM p JOIN (SELECT unnest(['fleuve', 'miroir', 'lettre']) AS lane) ON contains(t, lane)), g AS (SELECT lane, id FROM p JOIN (SELECT unnest(['fleuve', 'miroir', 'lettre']) AS lane) ON contains(t, lane || ' ')),
    s AS (SELECT lane, count(*) AS size FROM g GROUP BY 1) SELECT lane, size, round(hits / least(10, size), 6) AS recall FROM (SELECT s.lane, s.size, count(l.id) AS hits FROM s JOIN g ON g.lane = s.lane LEFT JOIN l ON l.lane = g.lane AND l.id = g.id AND l.rank <= 10 GROUP BY 1, 2)""")
def e10_lane_recall(spark, d):
    """Recall of each lane's list against what it can hold: the smaller of its gold and the list."""
    lanes = ["fleuve", "miroir", "lettre"]
    t = F.lower("raw_text")
    held = lambda add: F.array_compact(F.array(*(F.when(F.contains(t, F.lit(f + add)), F.lit(f)) for f in lanes)))
    p = _passages(spark, d, F.length("raw_text").alias("n"), held("").alias("in_list"), held(" ").alias("in_gold"))
    run = p.select("id", "n", F.explode("in_list").alias("lane")).withColumn("rank", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("n"), "id"))).where("rank <= 10").select("lane", F.col("id").alias("item"), "rank")
    return evaluation.lane_recall(run, p.select(F.explode("in_gold").alias("lane"), F.col("id").alias("item")), 10)


_BENCH = ["miroir", "fleuve vivant", "la lettre", "镜子", "水印"]


@query("WITH t AS (SELECT doc_id, lower(text) AS t, ' ' || array_to_string(list_filter(string_split(" + norm_fr("text") + ", ' '), lambda w: w <> ''), ' ') || ' ' AS w FROM documents WHERE text IS NOT NULL), q AS (SELECT unnest(" + _values(_BENCH) + ") AS q), h AS (SELECT q, contains(t, q) AS truth, contains(w, ' ' || q || ' ') AS words, list_has_all(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)), CASE WHEN length(q) < 3 THEN ['~~~'] ELSE list_transform(range(1, length(q) - 1), lambda i: substring(q, i, 3)) END) AS grams FROM t, q) SELECT q AS query, count(*) FILTER (truth) AS truth, round(count(*) FILTER (truth AND words) / nullif(count(*) FILTER (truth), 0), 4) AS words_recall, round(count(*) FILTER (truth AND grams) / nullif(count(*) FILTER (truth), 0), 4) AS grams_recall, round(count(*) FILTER (truth AND grams) / nullif(count(*) FILTER (grams), 0), 4) AS grams_precision FROM h GROUP BY 1")
def e12_tokenizers(spark, d):
    """Word and trigram matching against plain substrings."""
    docs = table(spark, d, "documents").where("text is not null").select(F.lower("text").alias("t"), F.concat(F.lit(" "), X.norm_fr(F.col("text")), F.lit(" ")).alias("w")).withColumn("g", X.char_ngrams(F.col("t"), 3))
    cells = [F.struct(F.lit(q).alias("query"), F.contains("t", F.lit(q)).alias("truth"), F.contains("w", F.lit(f" {q} ")).alias("words"), (F.size(F.array_except(F.array(*(F.lit(q[i : i + 3]) for i in range(len(q) - 2))), "g")) == 0 if len(q) > 2 else F.lit(False)).alias("grams")) for q in _BENCH]
    rows = docs.select(F.inline(F.array(*cells)))
    rate = lambda a, b: F.round(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), 4)
    t, w, g = F.col("truth"), F.col("words"), F.col("grams")
    return rows.groupBy("query").agg(F.count_if(t).alias("truth"), rate(t & w, t).alias("words_recall"), rate(t & g, t).alias("grams_recall"), rate(t & g, g).alias("grams_precision"))


@query("WITH p AS (SELECT doc_id, 0 AS k FROM moderation_labels WHERE doc_id IS NOT NULL UNION ALL SELECT doc_id, 1 FROM documents WHERE contains(text, 'miroir fragile') UNION ALL SELECT doc_id, 2 FROM documents WHERE contains(text, 'fleuve vivant')) SELECT doc_id, min(k)::INTEGER AS origin FROM p GROUP BY 1")
def e13_pool(spark, d):
    """The pool of an evaluation: labelled, gold and contrasting documents, each by its first origin."""
    docs = table(spark, d, "documents")
    parts = [table(spark, d, "moderation_labels").where("doc_id is not null").select("doc_id", F.lit(0).alias("k")), *(docs.where(F.contains("text", F.lit(f))).select("doc_id", F.lit(k).alias("k")) for k, f in ((1, "miroir fragile"), (2, "fleuve vivant")))]
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.min("k").alias("origin"))


@query(f"WITH {_V} SELECT direction, count(*) AS queries, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr FROM (SELECT g.query, CASE g.query % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'MUL' END AS direction, count(v.rank) / count(*) AS recall, coalesce(max(1.0 / v.rank), 0) AS mrr FROM (SELECT query // {search.EVERY} AS q, * FROM g) g LEFT JOIN v ON v.query = g.query AND v.item = g.item GROUP BY ALL) GROUP BY 1".replace("CASE g.query % 5", f"CASE g.query // {search.EVERY} % 5"))
def e14_directions(spark, d):
    """Recall and reciprocal rank by direction of language."""
    per = evaluation.metrics(search.r16_vector_topk(spark, d), search._gold(spark, d), search.TOP)
    k = F.floor(F.col("query") / search.EVERY) % 5
    way = F.when(k == 0, "A").when(k == 1, "B").when(k == 2, "C").when(k == 3, "D").otherwise("MUL")
    return per.groupBy(way.alias("direction")).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("mrr"), 4).alias("mrr"))


@query(f"""WITH s AS (SELECT DISTINCT witness_id AS w, seminar_id AS m FROM {ONCE} WHERE witness_id IS NOT NULL AND seminar_id IS NOT NULL), l AS (SELECT DISTINCT m.witness_id AS w, p.seminar_id AS m FROM passage_source_map m JOIN {ONCE} p ON p.id = m.passage_id WHERE m.witness_id IS NOT NULL AND p.seminar_id IS NOT NULL),
    j AS (SELECT w, count(*) FILTER (a AND b) / count(*) AS jaccard FROM (SELECT coalesce(s.w, l.w) AS w, s.w IS NOT NULL AS a, l.w IS NOT NULL AS b FROM s FULL OUTER JOIN l ON s.w = l.w AND s.m = l.m) GROUP BY 1) SELECT count(*) AS witnesses, round(avg(jaccard), 6) AS mean, round(min(jaccard), 6) AS least FROM j""")
def a18_mean_jaccard(spark, d):
    """How far two accounts of each witness's seminars agree, and the mean over witnesses."""
    p = _passages(spark, d, "witness_id", "seminar_id", where="seminar_id is not null")
    own = p.where("witness_id is not null").select("witness_id", "seminar_id").distinct().withColumn("a", F.lit(True))
    m = table(spark, d, "passage_source_map").where("witness_id is not null").select(F.col("passage_id").alias("id"), "witness_id").distinct()
    said = p.select("id", "seminar_id").join(m, "id").select("witness_id", "seminar_id").distinct().withColumn("b", F.lit(True))
    j = own.join(said, ["witness_id", "seminar_id"], "full_outer").groupBy("witness_id").agg((F.count_if(F.col("a") & F.col("b")) / F.count("*")).alias("j"))
    return j.agg(F.count("*").alias("witnesses"), F.round(F.avg("j"), 6).alias("mean"), F.round(F.min("j"), 6).alias("least"))


@query("SELECT page, doc_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) - 1) // 15 AS page FROM documents) WHERE page < 3")
def k7_offset_cursor(spark, d):
    """Pages by offset; the cursor that leads on holds the offset and its filters."""
    docs, token, pages = table(spark, d, "documents").select("doc_id", "n_chars"), None, []
    for n in range(3):
        (offset,) = (0,) if token is None else filters.resume(token, {}, "offset")
        rows = filters.offset_page(docs, [F.desc("n_chars"), "doc_id"], offset, 15).collect()  # a page
        pages += [(n, r.doc_id) for r in rows]
        token = filters.cursor({}, (offset + 15,), "offset")
    return spark.createDataFrame(pages, "page long, doc_id long")


@query(f"""WITH a AS (SELECT id, session_id, seminar_id, witness_id FROM {ONCE}), s AS (SELECT DISTINCT id FROM sessions WHERE id IS NOT NULL), m AS (SELECT DISTINCT id FROM seminars WHERE id IS NOT NULL), w AS (SELECT DISTINCT id FROM witnesses WHERE id IS NOT NULL), e AS (SELECT DISTINCT id FROM spec WHERE id IS NOT NULL), l AS (SELECT passage_id, witness_id FROM passage_source_map)
    SELECT 'passage>session' AS link, count(*) AS n FROM a WHERE session_id IS NOT NULL AND session_id NOT IN (FROM s) UNION ALL SELECT 'passage>seminar', count(*) FROM a WHERE seminar_id IS NOT NULL AND seminar_id NOT IN (FROM m) UNION ALL SELECT 'passage>witness', count(*) FROM a WHERE witness_id IS NOT NULL AND witness_id NOT IN (FROM w)
    UNION ALL SELECT 'map>passage', count(*) FROM l WHERE passage_id IS NOT NULL AND passage_id NOT IN (SELECT id FROM a WHERE id IS NOT NULL) UNION ALL SELECT 'map>witness', count(*) FROM l WHERE witness_id IS NOT NULL AND witness_id NOT IN (FROM w) UNION ALL SELECT 'session>seminar', count(*) FROM sessions WHERE seminar_id IS NOT NULL AND seminar_id NOT IN (FROM m)
    UNION ALL SELECT 'entity>entity', count(*) FROM (SELECT unnest(distinction_from) AS x FROM spec) WHERE x IS NOT NULL AND x NOT IN (FROM e) UNION ALL SELECT 'orphan_session', count(*) FROM s WHERE id NOT IN (SELECT session_id FROM a WHERE session_id IS NOT NULL) UNION ALL SELECT 'orphan_witness', count(*) FROM w WHERE id NOT IN (SELECT witness_id FROM a WHERE witness_id IS NOT NULL)
    UNION ALL SELECT 'orphan_passage', count(*) FROM a WHERE id NOT IN (SELECT passage_id FROM l WHERE passage_id IS NOT NULL) UNION ALL SELECT 'status_drift', count(*) FROM passages WHERE status NOT IN ('recovered', 'active') UNION ALL SELECT 'link_state_drift', count(*) FROM witnesses WHERE passage_link_state NOT IN ('linked', 'none')""")
def c13_vault_links(spark, d):
    """Links that lead nowhere, records nothing leads to, and values outside their lists."""
    p, m = _passages(spark, d, "session_id", "seminar_id", "witness_id"), table(spark, d, "passage_source_map")
    s, w, spec = table(spark, d, "sessions"), table(spark, d, "witnesses"), table(spark, d, "spec")
    keys = lambda df, c="id": df.where(F.col(c).isNotNull()).select(F.col(c).alias("k")).distinct()
    broken = lambda df, c, to, k="id": df.where(F.col(c).isNotNull()).select(F.col(c).alias("k")).join(keys(to, k), "k", "left_anti")
    rows = {
        "passage>session": broken(p, "session_id", s), "passage>seminar": broken(p, "seminar_id", table(spark, d, "seminars")), "passage>witness": broken(p, "witness_id", w), "map>passage": broken(m, "passage_id", p), "map>witness": broken(m, "witness_id", w), "session>seminar": broken(s, "seminar_id", table(spark, d, "seminars")),
        "entity>entity": broken(spec.select(F.explode("distinction_from").alias("x")), "x", spec), "orphan_session": keys(s).join(keys(p, "session_id"), "k", "left_anti"), "orphan_witness": keys(w).join(keys(p, "witness_id"), "k", "left_anti"), "orphan_passage": keys(p).join(keys(m, "passage_id"), "k", "left_anti"),
        "status_drift": table(spark, d, "passages").where(~F.col("status").isin("recovered", "active")), "link_state_drift": w.where(~F.col("passage_link_state").isin("linked", "none")),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("link"), "n") for k, df in rows.items()])


@query(f"WITH {_V}, r AS (SELECT g.query, count(v.rank) / count(*) AS recall, count(*) AS gold, count(v.rank) FILTER (v.rank <= 5) / count(*) AS half FROM g LEFT JOIN v ON v.query = g.query AND v.item = g.item GROUP BY 1) SELECT query, round(recall / ({search.TOP} * 1.0 / (SELECT count(*) FROM embeddings)), 3) AS lift, round(half / nullif(recall, 0), 4) AS retention FROM r")
def e8_retention(spark, d):
    """Lift over random draws, and what of the recall a list half as long keeps."""
    run, gold = search.r16_vector_topk(spark, d), search._gold(spark, d)
    n = table(spark, d, "embeddings").count()
    size = gold.groupBy("query").agg(F.count("*").alias("gold"))
    hits = run.join(gold.select("query", "item"), ["query", "item"], "left_semi").groupBy("query").agg(F.count("*").alias("a"), F.count_if(F.col("rank") <= search.TOP // 2).alias("b"))
    r = size.join(hits, "query", "left").na.fill(0, ["a", "b"])
    return r.select("query", F.round(F.col("a") / F.col("gold") / (search.TOP / n), 3).alias("lift"), F.round(F.col("b") / F.nullif(F.col("a"), F.lit(0)), 4).alias("retention"))


def queries() -> dict:
    return dict(query.functions)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
