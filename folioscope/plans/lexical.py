"""Searches over the passage store: query forms, filters, components, fusion and what is done with their lists."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as X
from folioscope.operators import filters, index, retrieval, windows
from folioscope.operators.mentions import mentions
from folioscope.operators.queries import alias_combinations, terms_of, wanted_of
from folioscope.operators.queries import norm_fr as norm
from folioscope.plans.browse import _aliases, _passages
from folioscope.plans.sql import ONCE, Catalogue, compat, grams_zh, norm_fr, text, unaccented
from folioscope.sources.tables import table

query = Catalogue()
#: Typed searches: languages, words and metadata filters.
SEARCHES = {
    "needle": (("fr",), "l'aiguille suspendue", {}),
    "role": (("fr",), "fleuve vivant", {"text_role": "transcription"}),
    "loose": (("fr",), "miroir lettre ruisseau", {}),
    "both": (("fr", "zh"), "镜子", {"authority_level": "L2"}),
    "nothing": (("fr", "zh"), "zzqx inconnu", {}),
    "elided": (("fr",), "l’intervalle", {"trace_status": "COMPLETE"}),
}
ALLOWED = {"text_role": {"transcription", "translation", "edition", "note"}, "authority_level": {"L0", "L1", "L2", "L3", "L4"}, "trace_status": {"COMPLETE", "SOURCE_TRACE_INCOMPLETE"}}
#: Rows of a ranked list, and how many times as many are fetched before lists of two languages are merged.
TOP, OVER = 10, 4
#: Entities whose names the components look for.
ENTITIES = ("concept.plafond-circulaire", "concept.comptoir-immobile", "concept.verger-solitaire")


def _list(values: list[str]) -> str:
    return f"[{', '.join(map(text, values))}]"


def _index(spark, d):
    source = table(spark, d, "passages")
    ws = F.when(F.col("language") == "zh", X.cjk_bigrams(F.col("raw_text"))).otherwise(F.filter(F.split(X.norm_fr(F.col("raw_text")), " "), lambda w: w != ""))
    tokens = _passages(spark, d, F.col("language").alias("part"), F.coalesce(ws, F.array().cast("array<string>")).alias("ws"), where=F.col("language").isin("fr", "zh"))
    return index.kept("passages", source, tokens.select("part", F.col("id").alias("doc"), "ws"))


def _pool(spark, d, searches=SEARCHES):
    """query, doc of what each search's filters let through."""
    chosen = {q: filters.validated(f, ALLOWED) for q, (_, _, f) in searches.items()}
    hold = [F.when(filters.equals(f), F.lit(q)) for q, f in sorted(chosen.items())]
    return _passages(spark, d, F.array_compact(F.array(*hold)).alias("qs")).select(F.explode("qs").alias("query"), F.col("id").alias("doc"))


def _wanted(searches=SEARCHES):
    return [w for q, (langs, typed, _) in sorted(searches.items()) for lang in langs for w in wanted_of(q, lang, typed)]


def _searched(spark, d, limit=TOP):
    return index.search(_index(spark, d), _wanted(), _pool(spark, d), limit)


_TOK = f"tok AS (SELECT id, language AS part, CASE WHEN language = 'zh' THEN {grams_zh('raw_text')} ELSE list_filter(string_split({norm_fr('raw_text')}, ' '), lambda w: w <> '') END AS toks FROM {ONCE} WHERE language IN ('fr', 'zh'))"


def _sql(wanted, pool: str = "", limit: int = TOP) -> str:
    """CTEs up to hits (query, part, tier, id) and ranked (query, part, doc, tier, score, rank)."""
    rows = ", ".join(f"({text(q)}, {text(p)}, {t}, {text(w)}, {o})" for q, p, t, w, o in wanted)
    return f"""{_TOK}, w(query, part, tier, term, ord) AS (VALUES {rows}), need AS (SELECT query, part, tier, count(DISTINCT term) AS terms, ' ' || string_agg(term, ' ' ORDER BY ord) || ' ' AS phrase FROM w GROUP BY ALL),
        post AS (SELECT part, id, dl, term, count(*) AS tf FROM (SELECT part, id, len(toks) AS dl, unnest(toks) AS term FROM tok) WHERE term IN (SELECT term FROM w) GROUP BY ALL),
        hits0 AS (SELECT query, part, tier, id FROM w JOIN post USING (part, term) JOIN need USING (query, part, tier) WHERE tier <> 1 GROUP BY ALL HAVING count(DISTINCT term) = max(terms)
            UNION ALL SELECT query, part, tier, id FROM need JOIN tok USING (part) WHERE tier = 1 AND contains(' ' || array_to_string(toks, ' ') || ' ', phrase)),
        hits AS (SELECT * FROM hits0 {f'SEMI JOIN ({pool}) pool ON pool.query = hits0.query AND pool.doc = hits0.id' if pool else ''}), size AS (SELECT part, count(*) AS n, avg(len(toks)) AS av FROM tok GROUP BY 1), df AS (SELECT part, term, count(*) AS df FROM post GROUP BY ALL),
        best AS (SELECT query, part, min(tier) AS tier FROM hits GROUP BY ALL),
        scored AS (SELECT query, part, tier, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM hits SEMI JOIN best USING (query, part, tier) JOIN (SELECT DISTINCT query, part, tier, term FROM w) USING (query, part, tier) JOIN post USING (part, id, term) JOIN df USING (part, term) JOIN size USING (part) GROUP BY ALL),
        ranked AS (SELECT query, part, id AS doc, tier::INTEGER AS tier, score, row_number() OVER (PARTITION BY query, part ORDER BY score DESC, id)::INTEGER AS rank FROM scored QUALIFY rank <= {limit})"""


_POOL = " UNION ALL ".join(f"SELECT {text(q)} AS query, id AS doc FROM {ONCE} WHERE {' AND '.join(f'{k} = {text(v)}' for k, v in f.items()) or 'true'}" for q, (_, _, f) in sorted(SEARCHES.items()))
_RANKED = f"WITH {_sql(_wanted(), _POOL)}"


@query(f"{_RANKED} SELECT query, part, doc, tier, score, rank FROM ranked")
def r11_search(spark, d):
    """Search as a user calls it: languages, filters and query forms from tight to loose."""
    return _searched(spark, d)


@query(f"{_RANKED} SELECT query, doc, rank, session_id, seminar_id, language, year_from, substring(raw_text, 1, 80) AS snippet FROM ranked JOIN {ONCE} ON id = doc")
def j1_hits(spark, d):
    """Hits with the metadata of their passages; only hits are joined."""
    meta = _passages(spark, d, "session_id", "seminar_id", "language", "year_from", X.snippet(F.col("raw_text"), 80).alias("snippet"))
    return _searched(spark, d).join(meta.withColumnRenamed("id", "doc"), "doc").select("query", "doc", "rank", "session_id", "seminar_id", "language", "year_from", "snippet")


@query(f"WITH {_sql(_wanted(), _POOL, TOP * OVER)} SELECT query, doc, part, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc)::INTEGER AS rank FROM ranked QUALIFY rank <= {TOP}")
def k1_merged(spark, d):
    """Both languages' hits in one total order: more are fetched of each than the merged list keeps."""
    every = _searched(spark, d, TOP * OVER)
    return retrieval.ranked(every.drop("rank"), "query", "score", "doc", TOP).select("query", "doc", "part", "score", "rank")


@query(f"WITH {_sql(_wanted(), _POOL, TOP * OVER)} SELECT query, count(*) AS bag, count(DISTINCT doc) AS docs, min(doc) AS first FROM ranked GROUP BY 1")
def u1_bag(spark, d):
    """The bag union of both languages' hits."""
    every = _searched(spark, d, TOP * OVER)
    bag = every.where("part = 'fr'").unionByName(every.where("part = 'zh'"))
    return bag.groupBy("query").agg(F.count("*").alias("bag"), F.countDistinct("doc").alias("docs"), F.min("doc").alias("first"))


_RAW = "list_filter(string_split_regex(trim({c}), '\\s+'), lambda w: w <> '')"


@query(f"""SELECT alias, array_to_string(list_filter(vs, lambda v: v <> ''), '|') AS variants FROM (SELECT alias, list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN list_position(ps, ps[i]) = i THEN ps[i] ELSE '' END) AS vs FROM (
    SELECT alias, list_transform(flatten(list_transform({_RAW.format(c=compat('alias'))}, lambda w: list_append(string_split_regex(w, '[''’ʼ]'), regexp_replace(w, '[''’ʼ]', '', 'g')))), lambda w: {norm_fr('w')}) AS ps
    FROM (SELECT DISTINCT trim(unnest(aliases)) AS alias FROM spec) WHERE alias <> ''))""")
def r6_elisions(spark, d):
    """The forms in which the index may hold each alias: beside and across its apostrophes."""
    names = table(spark, d, "spec").select(F.explode("aliases").alias("alias")).select(F.trim("alias").alias("alias")).where("alias <> ''").distinct()
    return names.select("alias", F.array_join(X.elision_variants(F.col("alias")), "|").alias("variants"))


FALLBACKS = {"english": ["suspended needle"], "two": ["solitary watermark", "miroir"], "known": ["aiguille"], "none": ["zzqx"]}


def _fallback_wanted(spark, d):
    """Wanted rows of each query: all its items, then with items replaced by other names of what they name, 48 combinations at most."""
    items = sorted({i for v in FALLBACKS.values() for i in v})
    typed = spark.createDataFrame([(i,) for i in items], "item string").withColumn("folded", X.normal(F.col("item")))
    names = _aliases(spark, d)
    others = typed.join(names.select("id", "folded").distinct(), "folded").join(names.select("id", F.col("alias").alias("other")), "id").where("item <> other").select("item", "other").distinct()
    swaps: dict[str, list[str]] = {}
    for r in windows.first_n(others, ["item"], ["other"], 4).collect():  # four names per typed item
        swaps.setdefault(r.item, []).append(r.other)
    return [w for q, v in sorted(FALLBACKS.items()) for tier, items in enumerate(alias_combinations(v, {k: sorted(x) for k, x in swaps.items()}), 2) for w in terms_of(q, "fr", tier, items)]


@query(f"""WITH RECURSIVE a AS (SELECT DISTINCT id, trim(alias) AS alias FROM (SELECT id, unnest(list_concat([canonical_name, fr, en, zh], coalesce(aliases, []))) AS alias FROM spec) WHERE trim(alias) <> ''),
    it AS (SELECT query, ord, item FROM (VALUES {', '.join(f"({text(q)}, {o}, {text(i)})" for q, v in sorted(FALLBACKS.items()) for o, i in enumerate(v))}) x(query, ord, item)),
    o AS (SELECT item, alias AS other FROM (SELECT DISTINCT item, b.alias FROM it JOIN a ON lower(a.alias) = lower(item) JOIN a b ON a.id = b.id AND b.alias <> item) QUALIFY row_number() OVER (PARTITION BY item ORDER BY alias) <= 4),
    alt AS (SELECT query, ord, item AS form, 0 AS k FROM it UNION ALL SELECT query, ord, other, row_number() OVER (PARTITION BY query, ord ORDER BY other) FROM it JOIN o USING (item)),
    c(query, ord, forms, key) AS (SELECT query, ord, [form], [k] FROM alt WHERE ord = 0 UNION ALL SELECT c.query, alt.ord, list_append(forms, form), list_append(key, k) FROM c JOIN alt ON alt.query = c.query AND alt.ord = c.ord + 1),
    combo AS (SELECT query, forms, row_number() OVER (PARTITION BY query ORDER BY key) AS tier FROM c JOIN (SELECT query, max(ord) AS m FROM it GROUP BY 1) USING (query) WHERE ord = m QUALIFY tier <= 48),
    {_TOK}, hit AS (SELECT query, tier, id FROM combo JOIN tok ON part = 'fr' AND list_has_all(toks, list_filter(flatten(list_transform(forms, lambda f: string_split({norm_fr('f')}, ' '))), lambda t: length(t) > 1)))
    SELECT query, id AS doc FROM hit SEMI JOIN (SELECT query, min(tier) AS tier FROM hit GROUP BY 1) b USING (query, tier)""")
def r10_alias_fallback(spark, d):
    """Where a query's own words find nothing, its items are replaced by other names of what they name."""
    hits = index.matches(_index(spark, d), _fallback_wanted(spark, d), phrases=frozenset())
    return hits.join(hits.groupBy("query").agg(F.min("tier").alias("tier")), ["query", "tier"]).select("query", "doc")


def _components(spark, d):
    """query, component, item, rank of the entities' names: exact (E), lexical (L), and by the terminology bridge (X).

    The bridge leads from an entity's Chinese name to all its equivalent French forms, each searched once; a passage
    counts where it first comes up.
    """
    idx, names = _index(spark, d), table(spark, d, "spec").where(F.col("id").isin(*ENTITIES))
    lists = []
    for name, phrases in (("E", frozenset({1})), ("L", frozenset()), ("X", frozenset({1}))):
        wanted = []
        for r in names.select("id", "canonical_name", "fr", "en", "aliases").collect():  # of the few entities asked
            other = {norm(x) for x in (r.canonical_name, r.en) if x}
            forms = {norm(x) for x in (r.fr, *(r.aliases or ())) if x and not re.search("[㐀-鿿]", x)} - other - {""} if name == "X" else {norm(r.fr)} if r.fr else set()
            wanted += [w for k, form in enumerate(sorted(forms), 1) for w in terms_of(f"{r.id}|{k}", "fr", 1, [form])]
        if wanted:
            hits = index.search(idx, sorted(set(wanted)), None, 30, phrases).select(F.split("query", "[|]").alias("q"), "doc", "rank")
            first = hits.groupBy(F.col("q")[0].alias("query"), F.col("doc").alias("item")).agg(F.min(F.struct(F.col("q")[1].cast("int").alias("k"), "rank")).alias("at"))
            lists.append(first.select("query", F.lit(name).alias("component"), "item", F.row_number().over(Window.partitionBy("query").orderBy("at", "item")).alias("rank")))
    return reduce(DataFrame.unionByName, lists)


def _component_sql() -> str:
    forms = f"SELECT DISTINCT id AS query, {norm_fr('alias')} AS form FROM (SELECT id, unnest(list_append(coalesce(aliases, []), fr)) AS alias, canonical_name, en FROM spec WHERE id IN {ENTITIES}) WHERE NOT regexp_matches(alias, '\\p{{Han}}') AND {norm_fr('alias')} NOT IN ({norm_fr('canonical_name')}, {norm_fr('en')}, '')"
    return f"""{_TOK}, post AS (SELECT part, id, term, count(*) AS tf FROM (SELECT part, id, unnest(toks) AS term FROM tok) GROUP BY ALL), df AS (SELECT part, term, count(*) AS df FROM post GROUP BY ALL), size AS (SELECT part, count(*) AS n, avg(len(toks)) AS av FROM tok GROUP BY 1),
        q AS (SELECT query, component, k, list_filter(string_split(form, ' '), lambda w: length(w) > 1) AS ts FROM (SELECT id AS query, unnest(['E', 'L']) AS component, 1 AS k, {norm_fr('fr')} AS form FROM (SELECT DISTINCT id, fr FROM spec WHERE id IN {ENTITIES})
            UNION ALL SELECT query, 'X', row_number() OVER (PARTITION BY query ORDER BY form), form FROM ({forms}))),
        h AS (SELECT query, component, k, ts, id, len(toks) AS dl FROM q JOIN tok ON part = 'fr' AND CASE WHEN component = 'L' THEN list_has_all(toks, ts) ELSE contains(' ' || array_to_string(toks, ' ') || ' ', ' ' || array_to_string(ts, ' ') || ' ') END),
        sc AS (SELECT query, component, k, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM (SELECT query, component, k, id, dl, unnest(list_distinct(ts)) AS term FROM h) h JOIN post USING (id, term) JOIN df ON df.part = 'fr' AND df.term = h.term JOIN size ON size.part = 'fr' GROUP BY ALL),
        rk AS (SELECT *, row_number() OVER (PARTITION BY query, component, k ORDER BY score DESC, id) AS r FROM sc QUALIFY r <= 30),
        comp AS (SELECT query, component, id AS item, row_number() OVER (PARTITION BY query, component ORDER BY k, r, id)::INTEGER AS rank FROM (SELECT * FROM rk QUALIFY row_number() OVER (PARTITION BY query, component, id ORDER BY k, r) = 1))"""


_COMP = f"WITH {_component_sql()}"


@query(f"{_COMP} SELECT query, component, item, rank FROM comp")
def w6_component_ranks(spark, d):
    """Ranks of the component lists of entities' names: exact, lexical, and across languages by the terminology bridge (R12 to R14)."""
    return _components(spark, d)


@query(f"{_COMP} SELECT query, item, rank FROM comp WHERE component = 'X'")
def r14_bridge(spark, d):
    """Passages of the other language that hold an equivalent form of the entity's name."""
    return _components(spark, d).where("component = 'X'").select("query", "item", "rank")


CONFIGS = {"E": "E", "L": "L", "X": "X", "E+L": "EL", "L+X": "LX", "E+X": "EX", "E+L+X": "ELX"}


@query(f"""{_COMP}, cfg(config, component) AS (VALUES {', '.join(f"({text(c)}, {text(k)})" for c, ks in CONFIGS.items() for k in ks)})
    SELECT config, query, item, score, row_number() OVER (PARTITION BY config, query ORDER BY score DESC, item)::INTEGER AS rank FROM (SELECT config, query, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM comp JOIN cfg USING (component) GROUP BY ALL) QUALIFY rank <= {TOP}""")
def r27_config_matrix(spark, d):
    """The fused list of every set of components: one pass for all of them."""
    cfg = spark.createDataFrame([(c, k) for c, ks in CONFIGS.items() for k in ks], "config string, component string")
    lists = _components(spark, d).join(cfg, "component")
    score = lists.groupBy("config", "query", "item").agg(F.round(F.sum(1.0 / (retrieval.RRF + F.col("rank"))), 9).alias("score"))
    return score.withColumn("rank", F.row_number().over(Window.partitionBy("config", "query").orderBy(F.desc("score"), "item"))).where(f"rank <= {TOP}")


_FUSED = f"{_COMP}, fused AS (SELECT query, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, string_agg(component || rank, ',' ORDER BY component) AS why FROM comp GROUP BY ALL)"


@query(f"""{_FUSED} SELECT query, item, score, why, session_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS rank FROM fused JOIN {ONCE} ON id = item WHERE year_from >= 1950 QUALIFY rank <= {TOP}""")
def r26_full_search(spark, d):
    """All components fused, kept where the years allow it (F10), with where each hit came from."""
    lists = _components(spark, d)
    fused = lists.groupBy("query", "item").agg(F.round(F.sum(1.0 / (retrieval.RRF + F.col("rank"))), 9).alias("score"), F.array_join(F.sort_array(F.collect_list(F.concat("component", F.col("rank").cast("string")))), ",").alias("why"))
    meta = _passages(spark, d, "session_id", where="year_from >= 1950").withColumnRenamed("id", "item")
    return retrieval.ranked(fused.join(meta, "item"), "query", "score", "item", TOP).select("query", "item", "score", "why", "session_id", "rank")


@query(f"""{_FUSED}, kept AS (SELECT f.*, p.seminar_id FROM fused f JOIN {ONCE} p ON p.id = f.item), wanted(query, seminar) AS (VALUES ('{ENTITIES[0]}', 'seminar.S05'), ('{ENTITIES[1]}', 'seminar.S99'))
    SELECT query, item, score FROM kept k LEFT JOIN wanted w USING (query) WHERE w.seminar IS NULL OR k.seminar_id = w.seminar OR NOT EXISTS (SELECT 1 FROM kept x WHERE x.query = k.query AND x.seminar_id = w.seminar)""")
def r15_metadata(spark, d):
    """Lists cut down to the seminar that a query names; where nothing would be left, the list stays whole."""
    fused = _components(spark, d).groupBy("query", "item").agg(F.round(F.sum(1.0 / (retrieval.RRF + F.col("rank"))), 9).alias("score"))
    named = spark.createDataFrame([(ENTITIES[0], "seminar.S05"), (ENTITIES[1], "seminar.S99")], "query string, seminar string")
    rows = fused.join(_passages(spark, d, "seminar_id").withColumnRenamed("id", "item"), "item").join(named, "query", "left").withColumn("in", F.coalesce(F.col("seminar_id") == F.col("seminar"), F.lit(False)))
    some = rows.groupBy("query").agg(F.max("in").alias("some"))
    return rows.join(some, "query").where("seminar is null or in or not some").select("query", "item", "score")


TYPED_TERMS = ["miroir", "l'aiguille suspendue", "fleuve vivant", "zzqx", "ruisseau"]


def _term_wanted():
    return [w for t in TYPED_TERMS for w in wanted_of(t, "fr", t)]


@query(f"WITH {_sql(_term_wanted())}, n AS (SELECT query, count(DISTINCT id) AS n FROM hits SEMI JOIN best USING (query, part, tier) GROUP BY 1) SELECT q AS term, coalesce(n, 0) AS n FROM (SELECT unnest({_list(TYPED_TERMS)}) AS q) LEFT JOIN n ON n.query = q")
def a15_prevalence(spark, d):
    """Passages that hold a term in its tightest form with any hit; 0 for terms without one."""
    n = index.prevalence(_index(spark, d), _term_wanted())
    return spark.createDataFrame([(t,) for t in TYPED_TERMS], "query string").join(n, "query", "left").select(F.col("query").alias("term"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {_sql(_term_wanted())} SELECT q AS term, coalesce(known, false) AS known, CASE WHEN known THEN row_number() OVER (PARTITION BY coalesce(known, false) ORDER BY pos) <= 4 ELSE false END AS used FROM (SELECT unnest({_list(TYPED_TERMS)}) AS q, generate_subscripts({_list(TYPED_TERMS)}, 1) AS pos) LEFT JOIN (SELECT DISTINCT query, true AS known FROM hits) k ON k.query = q")
def r25_decomposition(spark, d):
    """A query without hits taken apart: its known terms (the first four are used) and the unknown ones."""
    known = index.prevalence(_index(spark, d), _term_wanted()).select("query", F.lit(True).alias("known"))
    rows = spark.createDataFrame(list(enumerate(TYPED_TERMS)), "pos int, query string").join(known, "query", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("known").orderBy("pos"))
    return rows.select(F.col("query").alias("term"), "known", (F.col("known") & (place <= 4)).alias("used"))


@query(f"""WITH RECURSIVE {_sql(_wanted(), _POOL, 60)}, l AS (SELECT query, part, rank, doc, session_id, seminar_id, substring(regexp_replace(raw_text, '[^\\p{{L}}\\p{{N}}_]+', '', 'g'), 1, 120) || '|' || coalesce(witness_id, '') AS fp FROM ranked JOIN {ONCE} ON id = doc WHERE part = 'fr'),
    r(query, rank, doc, reason, seen, sess, n) AS (SELECT DISTINCT query, 0, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[], 0 FROM l
        UNION ALL SELECT query, rank, doc, reason, CASE WHEN reason IS NULL THEN list_append(seen, fp) ELSE seen END, CASE WHEN reason IS NULL THEN list_append(sess, session_id) ELSE sess END, CASE WHEN reason IS NULL THEN n + 1 ELSE n END
        FROM (SELECT r.query, l.rank, l.doc, l.fp, l.session_id, seen, sess, n, CASE WHEN list_contains(seen, fp) THEN 'near_duplicate' WHEN len(list_filter(sess, lambda s: s = session_id)) >= 2 THEN 'session_concentration' END AS reason
            FROM r JOIN l ON l.query = r.query AND l.rank = r.rank + 1 WHERE n < 10))
    SELECT query, rank, doc, reason FROM r WHERE rank > 0""")
def r22_diversified(spark, d):
    """Ranked hits without near duplicates of one witness and with two of a session at most; what was dropped and why."""
    p = _passages(spark, d, "session_id", "seminar_id", F.concat(retrieval.fingerprint(F.col("raw_text")), F.lit("|"), F.coalesce("witness_id", F.lit(""))).alias("fp")).withColumnRenamed("id", "doc")
    top = _searched(spark, d, 60).where("part = 'fr'").join(p, "doc")
    return windows.diversify(top, "query", "rank", "doc", "fp", "session_id", "seminar_id", 10, session_limit=2)


LANES = {"water": ["fleuve", "ruisseau"], "glass": ["miroir", "lanterne"], "paper": ["lettre", "archive"]}


@query("SELECT id, lane, own - other AS margin FROM (SELECT id, CASE " + " ".join(f"WHEN {' OR '.join(f'contains(t, {text(f)})' for f in fs)} THEN {text(k)}" for k, fs in LANES.items()) + " END AS lane, " + " + ".join(f"contains(t, {text(f)})::INT" for f in LANES["water"]) + " AS own, " + " + ".join(f"contains(t, {text(f)})::INT" for f in LANES["glass"]) + f" AS other FROM (SELECT id, lower(raw_text) AS t FROM {ONCE})) WHERE lane IS NOT NULL")
def r29_lanes(spark, d):
    """The first lane any of whose forms a passage holds, and by how much the forms of the first lane outnumber the second's."""
    t = F.lower("raw_text")
    some = lambda fs: reduce(lambda a, b: a | b, [F.contains(t, F.lit(f)) for f in fs])
    count = lambda fs: reduce(lambda a, b: a + b, [F.contains(t, F.lit(f)).cast("int") for f in fs])
    lane = F.coalesce(*(F.when(some(fs), k) for k, fs in LANES.items()))
    return _passages(spark, d, lane.alias("lane"), (count(LANES["water"]) - count(LANES["glass"])).alias("margin")).where("lane is not null")


@query(f"""WITH h AS (SELECT id, session_id, contains(lower(raw_text), 'fleuve') AS a, contains(lower(raw_text), 'miroir') AS b FROM {ONCE}), s AS (SELECT session_id, bool_or(a) AS a, bool_or(b) AS b FROM h GROUP BY 1)
    SELECT (SELECT count(*) FROM s WHERE a AND b) AS shared_sessions, (SELECT count(*) FROM h WHERE a AND b) AS overlapping, (SELECT count(*) FROM s WHERE a AND NOT b) AS only_a, (SELECT count(*) FROM s WHERE b AND NOT a) AS only_b""")
def j17_two_lanes(spark, d):
    """Two forms side by side: sessions they share, passages with both, and sessions of one only."""
    t = F.lower("raw_text")
    h = _passages(spark, d, "session_id", F.contains(t, F.lit("fleuve")).alias("a"), F.contains(t, F.lit("miroir")).alias("b"))
    s = h.groupBy("session_id").agg(F.coalesce(F.max("a"), F.lit(False)).alias("a"), F.coalesce(F.max("b"), F.lit(False)).alias("b"), F.count_if(F.col("a") & F.col("b")).alias("n"))
    return s.agg(F.count_if(F.col("a") & F.col("b")).alias("shared_sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("overlapping"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


@query(f"""WITH f AS (SELECT DISTINCT id, lang, {unaccented('form')} AS form FROM (SELECT id, 'fr' AS lang, fr AS form FROM spec UNION ALL SELECT id, 'en', en FROM spec UNION ALL SELECT id, 'zh', zh FROM spec) WHERE form IS NOT NULL)
    SELECT id, lang, count(*) AS n FROM term_entries JOIN f ON trim({unaccented('entered')}) = trim(form) AND trim(form) <> '' GROUP BY ALL""")
def j13_term_mapping(spark, d):
    """Entries whose folded form is a listed term, per entity and language."""
    forms = table(spark, d, "spec").select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("lang"), F.col(k).alias("form")) for k in ("fr", "en", "zh")))).alias("x")).select("id", "x.lang", F.trim(X.unaccented(F.col("x.form"))).alias("form")).where("form <> ''").distinct()
    return table(spark, d, "term_entries").select(F.trim(X.unaccented(F.col("entered"))).alias("form")).join(forms, "form").groupBy("id", "lang").agg(F.count("*").alias("n"))


NEEDLES = ["miroir fragile", "L'Aiguille suspendue", "镜子", "voix basse", "la lettre"]


@query("SELECT needle, count(*) AS n, min(id) AS first FROM (SELECT unnest(" + _list(NEEDLES) + f") AS needle) JOIN {ONCE} ON contains(regexp_replace({unaccented('raw_text')}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'), regexp_replace({unaccented('needle')}, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) GROUP BY 1")
def j11_needles(spark, d):
    """Passages that hold a needle when case, accents, blanks and punctuation are left out: one scan for all needles."""
    t = X.squashed(F.col("raw_text"))
    held = F.array_compact(F.array(*(F.when(F.contains("t", X.squashed(F.lit(n))), F.lit(n)) for n in NEEDLES)))
    rows = table(spark, d, "passages").select("id", t.alias("t")).select("id", held.alias("held")).where("size(held) > 0").distinct()
    return rows.select("id", F.explode("held").alias("needle")).groupBy("needle").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(f"SELECT id, session_id FROM {ONCE} WHERE seminar_id IN (SELECT id FROM seminars WHERE deleted_at IS NULL AND year_from <= 1955 AND coalesce(year_to, year_from) >= 1950) UNION ALL SELECT id, session_id FROM {ONCE} WHERE seminar_id IN (SELECT id FROM seminars WHERE year_from > 9999)")
def f8_in_list(spark, d):
    """Passages of the seminars of some years; a set without a seminar lets nothing through."""
    s = table(spark, d, "seminars")
    sets = [s.where(F.col("deleted_at").isNull() & filters.overlaps("year_from", "year_to", 1950, 1955)), s.where("year_from > 9999")]
    p = _passages(spark, d, "session_id", "seminar_id")
    return reduce(DataFrame.unionByName, [p.join(x.select(F.col("id").alias("seminar_id")).distinct(), "seminar_id", "left_semi").select("id", "session_id") for x in sets])


@query(f"{_RANKED} SELECT query, doc FROM ranked JOIN {ONCE} ON id = doc WHERE session_date >= '1950' AND session_date < '1970' AND authority_level IN ('L1', 'L2')")
def f9_post_filter(spark, d):
    """Hits kept by what is known of their sessions only after the search."""
    meta = _passages(spark, d, where=(F.col("session_date") >= "1950") & (F.col("session_date") < "1970") & F.col("authority_level").isin("L1", "L2")).withColumnRenamed("id", "doc")
    return _searched(spark, d).join(meta, "doc").select("query", "doc")


@query(f"""WITH p AS (SELECT p.id, p.seminar_id, CASE WHEN year_from < 1940 THEN 'early' WHEN year_from < 1970 THEN 'middle' ELSE 'late' END AS period, length(raw_text) AS n FROM {ONCE} p WHERE year_from IS NOT NULL),
    t AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, id) AS k FROM p QUALIFY k <= 12) SELECT period, seminar_id, string_agg(id, ',' ORDER BY k) AS ids FROM t GROUP BY ALL""")
def w9_by_period(spark, d):
    """The longest passages of each period, in its seminars."""
    period = F.when(F.col("year_from") < 1940, "early").when(F.col("year_from") < 1970, "middle").otherwise("late")
    p = _passages(spark, d, "seminar_id", period.alias("period"), F.length("raw_text").alias("n"), where="year_from is not null")
    top = p.withColumn("k", F.row_number().over(Window.partitionBy("period").orderBy(F.desc("n"), "id"))).where("k <= 12")
    return top.groupBy("period", "seminar_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]), ",").alias("ids"))


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label % 2 = 0) SELECT q.vec_id AS query, e.vec_id AS item, round(list_dot_product(q.v, e.v), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.v, e.v), 6) DESC, e.vec_id) AS rank
    FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id % 50 = 0) q JOIN g e ON e.vec_id <> q.vec_id QUALIFY rank <= 5""")
def k3_pool_vectors(spark, d):
    """Vector ranks within a pool: what is outside is never ranked."""
    e = table(spark, d, "embeddings")
    queries = e.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    pool = filters.in_pool(e, e.where(F.col("label") % 2 == 0), "vec_id")
    return retrieval.vector_topk(pool, "vec_id", "embedding", queries, 5).select("query", "item", "score", "rank")


@query(f"""WITH t AS (SELECT id, trim(regexp_replace(lower({compat("coalesce(fr, '')")}), '\\s+', ' ', 'g')) AS t FROM (SELECT id, min(fr) AS fr FROM spec WHERE id IS NOT NULL GROUP BY 1)),
    g AS (SELECT id, sha256(g) AS h FROM (SELECT id, unnest(list_concat(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3)), list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4)))) AS g FROM t)),
    s AS (SELECT id, ('0x' || substring(h, 1, 8))::BIGINT % 256 AS slot, sum(CASE WHEN substring(h, 9, 1) IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN -1 ELSE 1 END) AS x FROM g GROUP BY ALL) SELECT id, slot, round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS value FROM s WHERE x <> 0""")
def r17_hashed_vectors(spark, d):
    """Hashed vectors of the entities' names, their filled slots."""
    names = table(spark, d, "spec").where("id is not null").groupBy("id").agg(F.min("fr").alias("fr"))
    return retrieval.hashed_vectors(names, "id", "fr").select("id", F.posexplode("v").alias("slot", "x")).where("x <> 0").select("id", F.col("slot").cast("long").alias("slot"), F.round("x", 6).alias("value"))


@query(f"""{_COMP}, a AS (SELECT query, item, 'A' AS strategy, rank FROM comp WHERE component = 'E'), b AS (SELECT query, item, 'B' AS strategy, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM (SELECT query, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM comp WHERE component IN ('L', 'X') GROUP BY ALL))
    SELECT strategy, query, item, rank::INTEGER AS rank, contains(lower(raw_text), lower(fr)) AS verbatim, language = 'zh' AS across FROM (SELECT * FROM a UNION ALL SELECT query, item, strategy, rank FROM b) x JOIN {ONCE} p ON p.id = item JOIN (SELECT id, min(fr) AS fr FROM spec GROUP BY 1) s ON s.id = query WHERE rank <= 5""")
def r30_source_links(spark, d):
    """Passages that may be an entity's source, by exact names (A) and by words and equivalents (B), and whether they name it as it stands."""
    lists = _components(spark, d)
    a = lists.where("component = 'E'").select("query", "item", F.lit("A").alias("strategy"), "rank")
    b = retrieval.fused(lists.where("component in ('L', 'X')"), 5).select("query", "item", F.lit("B").alias("strategy"), "rank")
    names = table(spark, d, "spec").groupBy(F.col("id").alias("query")).agg(F.min("fr").alias("fr"))
    p = _passages(spark, d, "language", F.lower("raw_text").alias("t")).withColumnRenamed("id", "item")
    rows = a.where("rank <= 5").unionByName(b).join(p, "item").join(names, "query")
    return rows.select("strategy", "query", "item", "rank", F.contains("t", F.lower("fr")).alias("verbatim"), (F.col("language") == "zh").alias("across"))


_HAN = "regexp_replace({c}, '([\\p{{Han}}]+)', ' \\1 ', 'g')"
_WS = "list_filter(string_split(trim(regexp_replace(translate(lower({c}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda w: w <> '')"
_FOUND = f"""a AS (SELECT DISTINCT id, regexp_matches(alias, '\\p{{Han}}') AS han, {_WS.format(c=_HAN.format(c='alias'))} AS ws FROM (SELECT id, unnest(list_concat([canonical_name, fr, en, zh], coalesce(aliases, []))) AS alias FROM spec) WHERE trim(alias) <> ''),
    n AS (SELECT DISTINCT id, han, CASE WHEN han THEN array_to_string(ws, '') ELSE array_to_string(ws, ' ') END AS form FROM a WHERE len(ws) > 0), t AS (SELECT id AS doc, {_WS.format(c=_HAN.format(c='raw_text'))} AS ws FROM {ONCE} WHERE raw_text IS NOT NULL),
    m AS (SELECT doc, n.id, form FROM (SELECT doc, ' ' || array_to_string(ws, ' ') || ' ' AS padded, array_to_string(ws, '') AS packed FROM t) t JOIN n ON CASE WHEN han THEN contains(packed, form) ELSE contains(padded, ' ' || form || ' ') END QUALIFY row_number() OVER (PARTITION BY doc, n.id ORDER BY length(form) DESC, form) = 1)"""


@query(f"WITH {_FOUND} SELECT id AS entity, doc, form AS alias FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc) <= 400")
def j9_mention_rows(spark, d):
    """Mentions of the entities, 400 rows of each at most: the feature is a bounded list to read."""
    rows = mentions(_passages(spark, d, "raw_text").withColumnRenamed("id", "doc"), "doc", "raw_text", _aliases(spark, d).select("id", "alias"))
    return windows.first_n(rows, ["id"], ["doc"], 400).select(F.col("id").alias("entity"), "doc", "alias")


@query(f"""WITH {_FOUND}, p AS (SELECT m.id AS entity, language, trace_status, doc FROM m JOIN {ONCE} p ON p.id = doc) SELECT entity, count(*) AS mentions, count(*) FILTER (language = 'fr') AS fr, count(*) FILTER (language = 'zh') AS zh, count(*) FILTER (trace_status = 'COMPLETE') AS complete,
    array_to_string(list_sort(list(doc))[1:40], ',') AS sample FROM p GROUP BY 1""")
def a14_mention_stats(spark, d):
    """Mentions per entity, by language and trace, with the first 40 ids."""
    texts = _passages(spark, d, "raw_text", "language", "trace_status").withColumnRenamed("id", "doc")
    found = mentions(texts, "doc", "raw_text", _aliases(spark, d).select("id", "alias"))
    rows = found.select("id", "doc").join(texts.select("doc", "language", "trace_status"), "doc")
    stats = rows.groupBy(F.col("id").alias("entity")).agg(F.count("*").alias("mentions"), F.count_if(F.col("language") == "fr").alias("fr"), F.count_if(F.col("language") == "zh").alias("zh"), F.count_if(F.col("trace_status") == "COMPLETE").alias("complete"))
    first = windows.first_n(found, ["id"], ["doc"], 40).groupBy(F.col("id").alias("entity")).agg(F.array_join(F.sort_array(F.collect_list("doc")), ",").alias("sample"))
    return stats.join(first, "entity")


EXACT = ["miroir", "fleuve vivant", "ruisseau", "la lettre"]
_EXACT = [w for t in EXACT for w in terms_of(t, "fr", 1, [t])]


@query(f"WITH {_sql(_EXACT, limit=300)} SELECT doc, round(max(1.0 / rank), 6) AS score, row_number() OVER (ORDER BY round(max(1.0 / rank), 6) DESC, doc)::INTEGER AS rank FROM ranked GROUP BY doc QUALIFY row_number() OVER (ORDER BY round(max(1.0 / rank), 6) DESC, doc) <= 50")
def r12_exact(spark, d):
    """Passages by the best reciprocal rank among the exact lists of a query's terms."""
    lists = index.search(_index(spark, d), _EXACT, None, 300)
    score = lists.groupBy("doc").agg(F.round(F.max(1.0 / F.col("rank")), 6).alias("score")).withColumn("q", F.lit(0))
    return retrieval.ranked(score, "q", "score", "doc", 50).select("doc", "score", "rank")


_ORDERED = [w for k, t in enumerate(EXACT) for w in terms_of(str(k), "fr", 2, [t])]


@query(f"WITH {_sql(_ORDERED, limit=40)}, f AS (SELECT doc, min(struct_pack(k := query::INTEGER, r := rank)) AS place FROM ranked GROUP BY 1) SELECT doc, row_number() OVER (ORDER BY place, doc)::INTEGER AS rank FROM f QUALIFY row_number() OVER (ORDER BY place, doc) <= 60")
def r13_lexical(spark, d):
    """The query's list, then those of the names it has: each passage at its first place."""
    lists = index.search(_index(spark, d), _ORDERED, None, 40, phrases=frozenset())
    first = lists.groupBy("doc").agg(F.min(F.struct(F.col("query").cast("int").alias("k"), "rank")).alias("at")).withColumn("q", F.lit(0))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("at", "doc"))).where("rank <= 60").select("doc", "rank")


@query(f"""{_FUSED}, k AS (SELECT query, item, score FROM fused JOIN {ONCE} ON id = item WHERE text_role = 'note' AND seminar_id < 'seminar.S20') SELECT q.query, item, score, item IS NULL AS warned FROM (SELECT unnest({_list(list(ENTITIES))}) AS query) q LEFT JOIN (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, item) <= 3) k USING (query)""")
def f10_constrained(spark, d):
    """Fused hits that meet constraints, three of each query; a query left without any is named with a warning."""
    fused = _components(spark, d).groupBy("query", "item").agg(F.round(F.sum(1.0 / (retrieval.RRF + F.col("rank"))), 9).alias("score"))
    kept = fused.join(_passages(spark, d, where=(F.col("text_role") == "note") & (F.col("seminar_id") < "seminar.S20")).withColumnRenamed("id", "item"), "item")
    top = retrieval.ranked(kept, "query", "score", "item", 3).drop("rank")
    return spark.createDataFrame([(e,) for e in ENTITIES], "query string").join(top, "query", "left").select("query", "item", "score", F.col("item").isNull().alias("warned"))


def queries() -> dict:
    return dict(query.functions)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
