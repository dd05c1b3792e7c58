"""Filters, joins, aggregations, windows and pages over the passage store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions import text as X
from folioscope.operators import filters, windows
from folioscope.operators.mentions import mentions
from folioscope.plans.sql import ONCE, words
from folioscope.sources.files import segments
from folioscope.sources.tables import table

#: Literal forms whose attestations are counted.
FORMS = ["le miroir", "la lettre", "watermark", "silence", "档案", "%", "_", "LA LETTRE", "l_ lettre"]
#: Patterns whose occurrences are counted.
PATTERNS = {"year": "19[0-9][0-9]", "number_sign": "n°", "page": "(page|p\\.) [0-9]+", "ellipsis": "…"}
#: Texts whose hashes are hashed together.
BLOCK = 1024
_DOCS = {"fr", "zh", "en", "de"}


def _passages(spark: SparkSession, d: str, *columns: str | Column, where: Column | str | None = None) -> DataFrame:
    """id and the given columns of the passages that a filter lets through, each once.

    Deliveries of an id have one content. The filter and the expressions stand below the removal of repeats, so that
    they reach the scan and only what they give is shuffled.
    """
    rows = table(spark, d, "passages")
    rows = rows if where is None else rows.where(where)
    return rows.select("id", *(c for c in columns if not (isinstance(c, str) and c == "id"))).distinct()


def f1_filters(spark, d):
    chosen = filters.validated({"language": "fr", "text_role": "transcription"}, {"language": {"fr", "zh"}, "text_role": {"transcription", "translation", "edition", "note"}})
    return _passages(spark, d, X.snippet(F.col("raw_text"), 60).alias("snippet"), F.length("raw_text").alias("n"), (F.length("raw_text") > 60).alias("truncated"), where=filters.equals(chosen))


def f4_interval_overlap(spark, d):
    return _passages(spark, d, "year_from", "year_to", where=filters.overlaps("year_from", "year_to", 1950, 1955))


def f5_attestation(spark, d):
    docs = table(spark, d, "documents").select(F.lower("text").alias("t"), "text")
    hits = [F.sum(F.when(F.contains(F.col("text" if ord(f[0]) > 0x2E7F else "t"), F.lit(f.lower())), 1).otherwise(0)).alias(f"c{i}") for i, f in enumerate(FORMS)]
    one = docs.agg(*hits)
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("form"), F.col(f"c{i}").alias("n")) for i, f in enumerate(FORMS)))).alias("x")).select("x.form", "x.n")


def f6_patterns(spark, d):
    parts = [F.struct(F.lit(k).alias("pattern"), F.regexp_count("text", F.lit(p)).cast("long").alias("n")) for k, p in PATTERNS.items()]
    rows = table(spark, d, "documents").where("text is not null").select(F.explode(F.array(*parts)).alias("x")).select("x.pattern", "x.n")
    return rows.groupBy("pattern").agg(F.sum("n").alias("occurrences"), F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("documents"))


def f7_pool_topk(spark, d):
    pool = table(spark, d, "moderation_labels").where("label = 'ok'")
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return filters.in_pool(docs, pool, "doc_id").orderBy(F.desc("n_chars"), "doc_id").limit(20)


def f12_derived_seminar(spark, d):
    p = _passages(spark, d, "seminar_id").withColumn("derived", F.concat(F.lit("seminar."), F.regexp_extract("id", "^passage\\.(S[0-9]+)\\.", 1)))
    return p.groupBy("derived").agg(F.count("*").alias("n"), F.sum(F.when(F.col("derived") == F.col("seminar_id"), 0).otherwise(1)).alias("differing"))


def f13_period_labels(spark, d):
    dims = windows.first_wins(table(spark, d, "seminars"), ["id"], ["loaded_at"]).select(F.col("id").alias("seminar_id"), F.col("year_from").alias("yf"), F.col("year_to").alias("yt"))
    counts = _passages(spark, d, "seminar_id").groupBy("seminar_id").agg(F.count("*").alias("n"))
    label = F.when(F.col("yf").isNull(), "unknown").otherwise(F.concat_ws("-", F.col("yf").cast("string"), F.coalesce("yt", "yf").cast("string")))
    return counts.join(dims, "seminar_id", "left").select("seminar_id", "n", label.alias("period"))


def f14_overlay(spark, d):
    base = windows.first_wins(table(spark, d, "passage_source_map").where("witness_id is not null"), ["passage_id"], ["loaded_at", "witness_id"]).select(F.col("passage_id").alias("id"), "witness_id", F.lit("map").alias("origin"))
    rest = _passages(spark, d, "witness_id").where("witness_id is not null").select("id", "witness_id", F.lit("passage").alias("origin")).join(base, "id", "left_anti")
    return base.unionByName(rest)


def j2_sources(spark, d):
    m = table(spark, d, "passage_source_map").groupBy("passage_id").agg(F.min("corpus_source_id").alias("source"), F.count("*").alias("links"))
    p = _passages(spark, d, "language").join(m, F.col("id") == F.col("passage_id"), "left")
    return p.groupBy("language", F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"), F.sum(F.coalesce("links", F.lit(0))).alias("links"))


def j3_provenance_chain(spark, d):
    w = table(spark, d, "witnesses").groupBy("id").agg(F.min("source_file").alias("source_file"), F.min("corpus_source_id").alias("corpus_source_id"))
    s = table(spark, d, "sessions").select(F.col("id").alias("sid")).distinct()
    p = _passages(spark, d, "witness_id", "session_id")
    chain = p.join(s, F.col("session_id") == F.col("sid"), "left").join(w.withColumnRenamed("id", "wid"), F.col("witness_id") == F.col("wid"), "left")
    step = {"session": F.col("sid"), "witness": F.col("wid"), "file": F.col("source_file"), "corpus_source": F.col("corpus_source_id")}
    missing = F.concat_ws(",", *(F.when(c.isNull(), k) for k, c in step.items()))
    return chain.groupBy(missing.alias("missing")).agg(F.count("*").alias("n"))


def j4_unlinked_witnesses(spark, d):
    w = table(spark, d, "witnesses").select("id").distinct()
    used = _passages(spark, d, "witness_id").select(F.col("witness_id").alias("id")).distinct()
    return w.join(used, "id", "left_semi").withColumn("linked", F.lit(True)).unionByName(w.join(used, "id", "left_anti").withColumn("linked", F.lit(False)))


def j5_links(spark, d):
    m = table(spark, d, "passage_source_map").where("witness_id is not null").select("passage_id", "witness_id").distinct()
    return m.groupBy("passage_id").agg(F.array_join(F.sort_array(F.collect_list("witness_id")), ",").alias("witnesses"), F.count("*").alias("n"))


def _aliases(spark, d):
    spec = table(spark, d, "spec")
    names = F.array_compact(F.concat(F.array("canonical_name", "fr", "en", "zh"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return spec.select("id", F.explode(names).alias("alias")).where("trim(alias) <> ''").select("id", F.trim("alias").alias("alias"), X.normal(F.col("alias")).alias("folded")).distinct()


_ALIASES = """(SELECT DISTINCT id, trim(alias) AS alias, {n} AS folded FROM (
  SELECT id, unnest(list_concat([canonical_name, fr, en, zh], coalesce(aliases, []))) AS alias FROM spec) WHERE alias IS NOT NULL AND trim(alias) <> '')"""


def j7_other_aliases(spark, d):
    a = _aliases(spark, d).select("id", "folded").distinct()
    pairs = a.join(a.select("id", F.col("folded").alias("other")), "id").where("folded <> other")
    return windows.first_n(pairs, ["id", "folded"], ["other"], 4).select("id", "folded", "other")


def j8_all_mentions(spark, d):
    """Documents by entity, for names of any shape: Chinese ones anywhere in the packed text, others at word boundaries (also beside Chinese)."""
    found = mentions(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", _aliases(spark, d).select("id", "alias"))
    return found.groupBy("id").agg(F.countDistinct("doc_id").alias("documents"))


def j12_layers(spark, d):
    a = _passages(spark, d, "session_id").groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n"))
    b = table(spark, d, "sessions").groupBy("id").agg(F.max("passage_count").alias("declared"))
    layers = F.array_join(F.array_compact(F.array(F.when(F.col("n").isNotNull(), "passages"), F.when(F.col("known"), "sessions"))), "+")
    return a.join(b.withColumn("known", F.lit(True)), "id", "full_outer").select("id", "n", "declared", layers.alias("layers"))


def j14_equivalents(spark, d):
    spec = table(spark, d, "spec")
    forms = spec.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("lang"), F.trim(k).alias("form")) for k in ("fr", "en", "zh")))).alias("x")).select("id", "x.lang", "x.form").where("form is not null and form <> ''")
    return forms.join(forms.select("id", F.col("lang").alias("to_lang"), F.col("form").alias("to_form")), "id").where("lang <> to_lang").select("id", "lang", "form", "to_lang", "to_form")


def j15_period_of_year(spark, d):
    spans = table(spark, d, "seminars").where("deleted_at is null and year_from is not null").select(F.col("id").alias("seminar"), "year_from", F.coalesce("year_to", "year_from").alias("year_to")).distinct()
    years = _passages(spark, d, "year_from").where("year_from is not null").groupBy(F.col("year_from").alias("year")).agg(F.count("*").alias("n"))
    # Grouped by year first: the range join meets a year once, however many passages it has.
    return years.join(spans, F.col("year").between(F.col("year_from"), F.col("year_to"))).groupBy("seminar").agg(F.sum("n").alias("n"))


def j18_fallback(spark, d):
    linked = table(spark, d, "passage_source_map").where("witness_id is not null").select(F.col("passage_id").alias("id")).distinct().withColumn("mode", F.lit("recorded"))
    rest = _passages(spark, d, "witness_id").where("witness_id is not null").select("id").join(linked, "id", "left_anti").withColumn("mode", F.lit("attested"))
    return linked.unionByName(rest).groupBy("mode").agg(F.count("*").alias("n"))


def a2_facets(spark, d):
    p = _passages(spark, d, "seminar_id", "language", "trace_status")
    sets = [[F.col("seminar_id")], [F.col("seminar_id"), F.col("language")], [F.col("seminar_id"), F.col("trace_status")]]
    return p.groupingSets(sets, "seminar_id", "language", "trace_status").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def a4_sessions(spark, d):
    p = _passages(spark, d, "session_id", "language")
    return p.groupBy("session_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("language")), ",").alias("languages"))


def a6_coverage(spark, d):
    p = _passages(spark, d, "session_id", "seminar_id", "language", where=F.contains("raw_text", F.lit("miroir")) | F.contains("raw_text", F.lit("镜子")))
    return p.groupBy("language").agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("seminar_id").alias("seminars"))


def a7_provenance(spark, d):
    return _passages(spark, d, "trace_status", "text_role", "authority_level").groupBy("text_role", "authority_level").pivot("trace_status", ["COMPLETE", "SOURCE_TRACE_INCOMPLETE"]).agg(F.count(F.lit(1))).na.fill(0, ["COMPLETE", "SOURCE_TRACE_INCOMPLETE"]).toDF("text_role", "authority_level", "complete", "incomplete")


def a9_formalism(spark, d):
    rows = _passages(spark, d, "seminar_id", F.regexp_extract_all("raw_text", F.lit("(§ ?[0-9]+\\.[0-9]+)"), F.lit(1)).alias("es"), where=F.contains("raw_text", F.lit("§"))).select("seminar_id", F.explode("es").alias("e"))
    return rows.groupBy("seminar_id", F.regexp_replace("e", " ", "").alias("expr")).agg(F.count("*").alias("n"))


def a10_samples(spark, d):
    p = _passages(spark, d, "seminar_id", "text_role")
    return windows.first_n(p, ["seminar_id", "text_role"], ["id"], 3).select("seminar_id", "text_role", "id")


def a13_double_count(spark, d):
    t = F.lower("raw_text")
    p = _passages(spark, d, "seminar_id", (F.contains(t, F.lit("miroir")).cast("int") + F.contains(t, F.lit("lettre")).cast("int")).alias("n"))
    return p.groupBy("seminar_id").agg(F.sum("n").alias("hits")).where("hits > 0")


def a16_metadata(spark, d):
    p = _passages(spark, d, "session_date", "witness_id", "translation_id", "year_from")
    known = lambda c: F.col(c).isNotNull() & ~F.lower(F.trim(F.col(c).cast("string"))).isin("", "unknown")
    columns = ["session_date", "witness_id", "translation_id", "year_from"]
    one = p.agg(*(F.count(c).alias(f"p_{c}") for c in columns), *(F.countDistinct(F.when(known(c), F.col(c).cast("string"))).alias(f"k_{c}") for c in columns))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"p_{c}").alias("present"), F.col(f"k_{c}").alias("known")) for c in columns))).alias("x")).select("x.*")
    return rows.withColumn("state", F.when(F.col("present") == 0, "FIELD_ABSENT").when(F.col("known") == 0, "GLOBAL_UNKNOWN").otherwise("AVAILABLE"))


def a17_concentration(spark, d):
    n = _passages(spark, d, "seminar_id", "session_id").groupBy("seminar_id", "session_id").agg(F.count("*").alias("n"))
    return n.groupBy("seminar_id").agg(F.round(F.max("n") / F.sum("n"), 6).alias("share"), F.sum("n").alias("n"))


def a18_jaccard(spark, d):
    p = _passages(spark, d, "witness_id", "seminar_id", where="witness_id is not null").select("witness_id", "seminar_id").distinct()
    sizes = p.groupBy("witness_id").agg(F.count("seminar_id").alias("n"))
    left, right = p.toDF("a", "m"), p.toDF("b", "m")
    both = left.join(right, "m").where("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))  # only sets that share an element meet
    return both.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").select("a", "b", F.round(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), 6).alias("jaccard"))


def a19_duplicates(spark, d):
    docs = table(spark, d, "documents").where("text is not null and trim(text) <> ''").select("doc_id", F.sha2("text", 256).alias("h"))
    return docs.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


def a20_conflicts(spark, d):
    s = table(spark, d, "sessions")
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in ("session_date", "passage_count", "trace_status"))))
    rows = s.select("id", fields.alias("x")).select("id", "x.field", "x.v").where("v is not null")
    return rows.groupBy("id", "field").agg(F.countDistinct("v").alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("values > 1")


def a24_quantiles(spark, d):
    docs = table(spark, d, "documents").where("n_chars is not null")
    return docs.groupBy("source").agg(F.count("*").alias("n"), F.round(F.percentile("n_chars", 0.5), 6).alias("median"), F.round(F.percentile("n_chars", 0.95), 6).alias("p95"))


def a25_content_hash(spark, d):
    """Hash of a session's texts in order: of the hashes of its blocks of BLOCK texts, so that no list grows with all of them."""
    p = windows.numbered_evenly(_passages(spark, d, "session_id", F.sha2(F.coalesce("raw_text", F.lit("")), 256).alias("h")), ["session_id"], ["id"], "n")
    joined = lambda at, h: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, h))), lambda x: x[h]), "\n"), 256)
    blocks = p.groupBy("session_id", F.floor((F.col("n") - 1) / BLOCK).alias("block")).agg(joined("n", "h").alias("h"))
    return blocks.groupBy("session_id").agg(joined("block", "h").alias("content"))


def w1_numbering(spark, d):
    p = windows.numbered_evenly(_passages(spark, d, "session_id"), ["session_id"], ["id"], "seq")
    return p.select("id", F.concat(F.lit("P"), F.lpad(F.col("seq").cast("string"), 5, "0")).alias("key"))


def w2_context(spark, d):
    p = _passages(spark, d, "session_id", F.contains("raw_text", F.lit("annexe B")).alias("hit"))
    return windows.context(p, p.where("hit"), "id", "session_id", "id", 2)


def w4_neighbours(spark, d):
    return windows.neighbours(_passages(spark, d, "session_id"), "session_id", "id").select("id", "has_prev", "has_next")


def w7_capped(spark, d):
    p = _passages(spark, d, "session_id", "seminar_id", (-F.length("raw_text")).alias("shortness"))
    ranked = windows.numbered_evenly(p, ["seminar_id"], ["shortness", "id"], "rank")
    return windows.capped(ranked, "seminar_id", "session_id", "rank", 3).where("new_rank <= 10").select("seminar_id", "id", "rank", "new_rank")


def w8_diversified(spark, d):
    p = _passages(spark, d, "session_id", "seminar_id", F.length("raw_text").alias("n"))
    top = p.withColumn("rank", F.row_number().over(Window.partitionBy("seminar_id").orderBy(F.desc("n"), "id"))).where("rank <= 50")
    return windows.diversified(top, "seminar_id", "session_id", "rank", "id", 1, 10).select("seminar_id", F.array_join("items", ",").alias("items"))


def w10_interleaved(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", F.lower("text").alias("t"), "n_chars")
    lanes = [docs.where(F.contains("t", F.lit(f))).select(F.lit("q").alias("query"), F.lit(i).alias("lane"), "doc_id", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n_chars"), "doc_id")).alias("rank")).where("rank <= 20") for i, f in enumerate(("miroir", "lettre", "mirror"))]
    return windows.interleaved(lanes[0].unionByName(lanes[1]).unionByName(lanes[2]), "query", "lane", "rank", "doc_id").select("doc_id", "rank")


def w11_first_wins(spark, d):
    return windows.first_wins(table(spark, d, "passage_source_map").select("passage_id", "witness_id", "loaded_at"), ["passage_id"], ["loaded_at", F.col("witness_id").asc_nulls_last()]).select("passage_id", "witness_id")


def w13_series(spark, d):
    n = _passages(spark, d, "year_from").groupBy("year_from").agg(F.count("*").alias("n"))
    return n.select("year_from", "n", F.row_number().over(Window.orderBy(F.col("year_from").asc_nulls_last())).alias("place"))  # one row per year


def w15_hash_sample(spark, d):
    return windows.hash_sample(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 5)


def k4_keyset(spark, d):
    return filters.keyset_page(_passages(spark, d, "language"), ["id"], ("passage.S20.",), filters.clamp(80)).select("id", "language")


def k6_compound_keyset(spark, d):
    return filters.keyset_page(_aliases(spark, d).select("folded", "id").distinct(), ["folded", "id"], ("coquille nocturne", "concept.coquille-nocturne"), 10)


def k7_offset(spark, d):
    return filters.offset_page(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], 30, 20)


def u2_union(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    pools = [docs.where(F.contains("text", F.lit(f))).select("doc_id", F.lit(i).alias("pool")) for i, f in enumerate(("miroir", "lettre", "silence"))]
    return pools[0].unionByName(pools[1]).unionByName(pools[2]).groupBy("doc_id").agg(F.min("pool").alias("pool"))


def u4_intersection(spark, d):
    s = lambda f: _passages(spark, d, "session_id", where=F.contains("raw_text", F.lit(f))).select("session_id")
    return s("miroir").intersect(s("lettre"))


def u5_difference(spark, d):
    s = lambda lang: _passages(spark, d, "session_id", where=F.col("language") == lang).select("session_id")
    return s("fr").distinct().exceptAll(s("zh").distinct())


def u6_snapshot_diff(spark, d):
    s = table(spark, d, "sessions").select("id", "loaded_at", F.sha2(F.concat_ws("|", "seminar_id", "session_date", F.col("passage_count").cast("string")), 256).alias("h"))
    cut = F.lit("2023-03-01").cast("timestamp")
    old = s.where(F.col("loaded_at") < cut).groupBy("id").agg(F.max("h").alias("old"))
    new = s.where(F.col("loaded_at") >= cut).groupBy("id").agg(F.max("h").alias("new"))
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("modified")
    return old.join(new, "id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def x2_language(spark, d):
    return table(spark, d, "documents").groupBy("lang", X.language(F.col("text")).alias("detected")).agg(F.count("*").alias("n"))


def x13_claims(spark, d):
    parts = F.filter(F.split("text", "(?<=[。！？!?；;])|\\n+"), lambda p: F.trim(p) != "")
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.size(parts), F.lit(0)).alias("claims")).groupBy("claims").agg(F.count("*").alias("documents"))


def x15_isbn(spark, d):
    keys = table(spark, d, "orders").select(F.lpad((F.col("o_orderkey") * 7919).cast("string"), 13, "9").alias("code"))
    return keys.select("code", X.isbn13_valid(F.col("code")).alias("valid")).distinct()


def s13_segments(spark, d):
    """Paragraphs of the documents, parted by blank lines, those over 60 characters packed up to about 200."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return segments(docs, "doc_id", "text", least=60, target=200).groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum(F.length("segment")).cast("long").alias("chars"))


def streaming_sessions(spark, d):
    e = table(spark, d, "events").select("user_id", "ts")
    w = F.session_window("ts", "30 minutes")
    return e.groupBy("user_id", w).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


_Q = [f1_filters, f4_interval_overlap, f5_attestation, f6_patterns, f7_pool_topk, f12_derived_seminar, f13_period_labels, f14_overlay, j2_sources, j3_provenance_chain, j4_unlinked_witnesses, j5_links, j7_other_aliases, j8_all_mentions, j12_layers, j14_equivalents, j15_period_of_year, j18_fallback, a2_facets, a4_sessions, a6_coverage, a7_provenance, a9_formalism, a10_samples, a13_double_count, a16_metadata, a17_concentration, a18_jaccard, a19_duplicates, a20_conflicts, a24_quantiles, a25_content_hash, w1_numbering, w2_context, w4_neighbours, w7_capped, w8_diversified, w10_interleaved, w11_first_wins, w13_series, w15_hash_sample, k4_keyset, k6_compound_keyset, k7_offset, u2_union, u4_intersection, u5_difference, u6_snapshot_diff, x2_language, x13_claims, x15_isbn, s13_segments, streaming_sessions]


def queries() -> dict:
    return {f.__name__: f for f in _Q}


def _known(c: str) -> str:
    return f"count(DISTINCT CASE WHEN {c} IS NOT NULL AND lower(trim({c}::VARCHAR)) NOT IN ('', 'unknown') THEN {c}::VARCHAR END)"


def _sql() -> dict[str, str]:
    from folioscope.plans.sql import normal

    aliases = _ALIASES.format(n=normal("alias"))
    cnt = lambda p: f"(length(t) - length(regexp_replace(t, '{p}', '', 'g')))"
    return {
        "f1_filters": f"SELECT id, substring(raw_text, 1, 60) AS snippet, length(raw_text) AS n, length(raw_text) > 60 AS truncated FROM {ONCE} WHERE language = 'fr' AND text_role = 'transcription'",
        "f4_interval_overlap": f"SELECT id, year_from, year_to FROM {ONCE} WHERE year_from <= 1955 AND coalesce(year_to, year_from) >= 1950",
        "f5_attestation": " UNION ALL ".join(f"SELECT '{f}' AS form, sum(CASE WHEN contains({'text' if ord(f[0]) > 0x2E7F else 'lower(text)'}, lower('{f}')) THEN 1 ELSE 0 END)::BIGINT AS n FROM documents" for f in FORMS),
        "f6_patterns": " UNION ALL ".join(f"SELECT '{k}' AS pattern, sum(n)::BIGINT AS occurrences, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END)::BIGINT AS documents FROM (SELECT len(regexp_extract_all(text, '{p}')) AS n FROM documents WHERE text IS NOT NULL)" for k, p in PATTERNS.items()),
        "f7_pool_topk": "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM moderation_labels WHERE label = 'ok') ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20",
        "f12_derived_seminar": f"SELECT derived, count(*) AS n, sum(CASE WHEN derived = seminar_id THEN 0 ELSE 1 END)::BIGINT AS differing FROM (SELECT seminar_id, 'seminar.' || regexp_extract(id, '^passage\\.(S[0-9]+)\\.', 1) AS derived FROM {ONCE}) GROUP BY 1",
        "f13_period_labels": f"""SELECT p.seminar_id, p.n, CASE WHEN s.year_from IS NULL THEN 'unknown' ELSE s.year_from || '-' || coalesce(s.year_to, s.year_from) END AS period
            FROM (SELECT seminar_id, count(*) AS n FROM {ONCE} GROUP BY 1) p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS rn FROM seminars) s ON s.id = p.seminar_id AND s.rn = 1""",
        "f14_overlay": f"""WITH m AS (SELECT passage_id AS id, witness_id FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY loaded_at, witness_id) AS rn FROM passage_source_map WHERE witness_id IS NOT NULL) WHERE rn = 1)
            SELECT id, witness_id, 'map' AS origin FROM m UNION ALL SELECT id, witness_id, 'passage' FROM {ONCE} WHERE witness_id IS NOT NULL AND id NOT IN (SELECT id FROM m WHERE id IS NOT NULL)""",
        "j2_sources": f"""SELECT language, coalesce(source, 'none') AS source, count(*) AS n, sum(coalesce(links, 0))::BIGINT AS links FROM {ONCE} p
            LEFT JOIN (SELECT passage_id, min(corpus_source_id) AS source, count(*) AS links FROM passage_source_map GROUP BY 1) m ON m.passage_id = p.id GROUP BY 1, 2""",
        "j3_provenance_chain": f"""SELECT concat_ws(',', CASE WHEN s.id IS NULL THEN 'session' END, CASE WHEN w.id IS NULL THEN 'witness' END, CASE WHEN w.f IS NULL THEN 'file' END, CASE WHEN w.c IS NULL THEN 'corpus_source' END) AS missing, count(*) AS n
            FROM {ONCE} p LEFT JOIN (SELECT DISTINCT id FROM sessions) s ON s.id = p.session_id LEFT JOIN (SELECT id, min(source_file) AS f, min(corpus_source_id) AS c FROM witnesses GROUP BY 1) w ON w.id = p.witness_id GROUP BY 1""",
        "j4_unlinked_witnesses": "SELECT id, id IN (SELECT witness_id FROM passages WHERE witness_id IS NOT NULL) AS linked FROM (SELECT DISTINCT id FROM witnesses)",
        "j5_links": "SELECT passage_id, string_agg(witness_id, ',' ORDER BY witness_id) AS witnesses, count(*) AS n FROM (SELECT DISTINCT passage_id, witness_id FROM passage_source_map WHERE witness_id IS NOT NULL) GROUP BY 1",
        "j7_other_aliases": f"""WITH a AS (SELECT DISTINCT id, folded FROM {aliases})
            SELECT id, folded, other FROM (SELECT a.id, a.folded, b.folded AS other, row_number() OVER (PARTITION BY a.id, a.folded ORDER BY b.folded) AS rn FROM a JOIN a b ON a.id = b.id AND a.folded <> b.folded) WHERE rn <= 4""",
        "j8_all_mentions": f"""WITH a AS (SELECT DISTINCT id, folded FROM {aliases} WHERE folded <> ''),
            t AS (SELECT doc_id, ' ' || array_to_string({words("regexp_replace(text, '([\\p{Han}]+)', ' \\1 ', 'g')")}, ' ') || ' ' AS t FROM documents WHERE text IS NOT NULL)
            SELECT a.id, count(DISTINCT doc_id) AS documents FROM a JOIN t ON CASE WHEN regexp_matches(folded, '\\p{{Han}}') THEN contains(replace(t.t, ' ', ''), replace(a.folded, ' ', '')) ELSE contains(t.t, ' ' || a.folded || ' ') END GROUP BY 1""",
        "j12_layers": f"""SELECT coalesce(a.id, b.id) AS id, n, declared, concat_ws('+', CASE WHEN n IS NOT NULL THEN 'passages' END, CASE WHEN b.id IS NOT NULL THEN 'sessions' END) AS layers
            FROM (SELECT session_id AS id, count(*) AS n FROM {ONCE} GROUP BY 1) a FULL OUTER JOIN (SELECT id, max(passage_count) AS declared FROM sessions GROUP BY 1) b ON a.id = b.id""",
        "j14_equivalents": """WITH f AS (SELECT id, 'fr' AS lang, trim(fr) AS form FROM spec UNION ALL SELECT id, 'en', trim(en) FROM spec UNION ALL SELECT id, 'zh', trim(zh) FROM spec)
            SELECT a.id, a.lang, a.form, b.lang AS to_lang, b.form AS to_form FROM f a JOIN f b ON a.id = b.id AND a.lang <> b.lang WHERE a.form <> '' AND b.form <> ''""",
        "j15_period_of_year": f"""SELECT s.id AS seminar, count(*) AS n FROM {ONCE} p JOIN (SELECT DISTINCT id, year_from, coalesce(year_to, year_from) AS year_to FROM seminars WHERE deleted_at IS NULL AND year_from IS NOT NULL) s
            ON p.year_from BETWEEN s.year_from AND s.year_to GROUP BY 1""",
        "j18_fallback": f"""WITH l AS (SELECT DISTINCT passage_id AS id FROM passage_source_map WHERE witness_id IS NOT NULL)
            SELECT 'recorded' AS mode, count(*) AS n FROM l UNION ALL SELECT 'attested', count(*) FROM {ONCE} WHERE witness_id IS NOT NULL AND id NOT IN (SELECT id FROM l WHERE id IS NOT NULL)""",
        "a2_facets": f"SELECT seminar_id, language, trace_status, grouping_id(seminar_id, language, trace_status)::INTEGER AS level, count(*) AS n FROM {ONCE} GROUP BY GROUPING SETS ((seminar_id), (seminar_id, language), (seminar_id, trace_status))",
        "a4_sessions": f"SELECT session_id, count(*) AS n, (SELECT NULL) IS NULL AS _x, string_agg(DISTINCT language, ',' ORDER BY language) AS languages FROM {ONCE} GROUP BY 1".replace("(SELECT NULL) IS NULL AS _x, ", ""),
        "a6_coverage": f"SELECT language, count(*) AS n, count(DISTINCT session_id) AS sessions, count(DISTINCT seminar_id) AS seminars FROM {ONCE} WHERE contains(raw_text, 'miroir') OR contains(raw_text, '镜子') GROUP BY 1",
        "a7_provenance": f"SELECT text_role, authority_level, count(*) FILTER (trace_status = 'COMPLETE') AS complete, count(*) FILTER (trace_status = 'SOURCE_TRACE_INCOMPLETE') AS incomplete FROM {ONCE} GROUP BY 1, 2",
        "a9_formalism": f"SELECT seminar_id, replace(e, ' ', '') AS expr, count(*) AS n FROM (SELECT seminar_id, unnest(regexp_extract_all(raw_text, '(§ ?[0-9]+\\.[0-9]+)', 1)) AS e FROM {ONCE}) GROUP BY 1, 2",
        "a10_samples": f"SELECT seminar_id, text_role, id FROM (SELECT *, row_number() OVER (PARTITION BY seminar_id, text_role ORDER BY id) AS rn FROM {ONCE}) WHERE rn <= 3",
        "a13_double_count": f"SELECT seminar_id, sum(contains(lower(raw_text), 'miroir')::INT + contains(lower(raw_text), 'lettre')::INT)::BIGINT AS hits FROM {ONCE} GROUP BY 1 HAVING hits > 0",
        "a16_metadata": " UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, {_known(c)} AS known, CASE WHEN count({c}) = 0 THEN 'FIELD_ABSENT' WHEN {_known(c)} = 0 THEN 'GLOBAL_UNKNOWN' ELSE 'AVAILABLE' END AS state FROM {ONCE}" for c in ("session_date", "witness_id", "translation_id", "year_from")),
        "a17_concentration": f"SELECT seminar_id, round(max(n) / sum(n), 6) AS share, sum(n)::BIGINT AS n FROM (SELECT seminar_id, session_id, count(*) AS n FROM {ONCE} GROUP BY 1, 2) GROUP BY 1",
        "a18_jaccard": f"""WITH s AS (SELECT DISTINCT witness_id AS w, seminar_id AS m FROM {ONCE} WHERE witness_id IS NOT NULL), c AS (SELECT w, count(m) AS n FROM s GROUP BY 1),
            x AS (SELECT a.w AS a, b.w AS b, count(*) AS n FROM s a JOIN s b ON a.m = b.m AND a.w < b.w GROUP BY 1, 2)
            SELECT x.a, x.b, round(x.n / (a.n + b.n - x.n), 6) AS jaccard FROM x JOIN c a ON a.w = x.a JOIN c b ON b.w = x.b""",
        "a19_duplicates": "SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY 1 HAVING count(*) > 1",
        "a20_conflicts": """SELECT id, field, count(DISTINCT v) AS values, min(v) AS lo, max(v) AS hi FROM (SELECT id, 'session_date' AS field, session_date AS v FROM sessions UNION ALL
            SELECT id, 'passage_count', passage_count::VARCHAR FROM sessions UNION ALL SELECT id, 'trace_status', trace_status FROM sessions) WHERE v IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT v) > 1""",
        "a24_quantiles": "SELECT source, count(*) AS n, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.95), 6) AS p95 FROM documents WHERE n_chars IS NOT NULL GROUP BY 1",
        "a25_content_hash": f"""WITH p AS (SELECT session_id, sha256(coalesce(raw_text, '')) AS h, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM {ONCE}),
            b AS (SELECT session_id, (n - 1) // {BLOCK} AS block, sha256(string_agg(h, chr(10) ORDER BY n)) AS h FROM p GROUP BY 1, 2) SELECT session_id, sha256(string_agg(h, chr(10) ORDER BY block)) AS content FROM b GROUP BY 1""",
        "w1_numbering": f"SELECT id, 'P' || lpad((row_number() OVER (PARTITION BY session_id ORDER BY id))::VARCHAR, 5, '0') AS key FROM {ONCE}",
        "w2_context": f"""WITH p AS (SELECT id, session_id, raw_text, row_number() OVER (PARTITION BY session_id ORDER BY id) AS n FROM {ONCE})
            SELECT a.id AS target, b.id AS neighbour, (b.n - a.n)::INTEGER AS distance FROM p a JOIN p b ON a.session_id = b.session_id AND abs(a.n - b.n) <= 2 WHERE contains(a.raw_text, 'annexe B')""",
        "w4_neighbours": f"SELECT id, lag(1) OVER w IS NOT NULL AS has_prev, lead(1) OVER w IS NOT NULL AS has_next FROM {ONCE} WINDOW w AS (PARTITION BY session_id ORDER BY id)",
        "w7_capped": f"""SELECT seminar_id, id, rank, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY seminar_id ORDER BY rank) AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY seminar_id, session_id ORDER BY rank) AS c FROM (
            SELECT id, seminar_id, session_id, row_number() OVER (PARTITION BY seminar_id ORDER BY length(raw_text) DESC, id) AS rank FROM {ONCE})) WHERE c <= 3) WHERE new_rank <= 10""",
        "w8_diversified": f"""WITH RECURSIVE p AS (SELECT id, seminar_id, session_id, row_number() OVER (PARTITION BY seminar_id ORDER BY length(raw_text) DESC, id) AS rank FROM {ONCE} QUALIFY rank <= 50),
            r(seminar_id, rank, last, items, n) AS (SELECT DISTINCT seminar_id, 0::BIGINT, NULL::VARCHAR, []::VARCHAR[], 0 FROM p UNION ALL SELECT r.seminar_id, p.rank,
            CASE WHEN n < 10 AND (n = 0 OR p.session_id IS DISTINCT FROM last) THEN p.session_id ELSE last END, CASE WHEN n < 10 AND (n = 0 OR p.session_id IS DISTINCT FROM last) THEN list_append(items, p.id) ELSE items END,
            CASE WHEN n < 10 AND (n = 0 OR p.session_id IS DISTINCT FROM last) THEN n + 1 ELSE n END FROM r JOIN p ON p.seminar_id = r.seminar_id AND p.rank = r.rank + 1)
            SELECT seminar_id, array_to_string(items, ',') AS items FROM (SELECT *, row_number() OVER (PARTITION BY seminar_id ORDER BY rank DESC) AS k FROM r) WHERE k = 1""",
        "w10_interleaved": "WITH l AS (" + " UNION ALL ".join(f"(SELECT {i} AS lane, doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE contains(lower(text), '{f}') QUALIFY rank <= 20)" for i, f in enumerate(("miroir", "lettre", "mirror"))) + """)
            SELECT doc_id, row_number() OVER (ORDER BY rank, lane, doc_id) AS rank FROM (SELECT doc_id, rank, lane FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, lane) AS k FROM l) WHERE k = 1)""",
        "w11_first_wins": "SELECT passage_id, witness_id FROM (SELECT *, row_number() OVER (PARTITION BY passage_id ORDER BY loaded_at, witness_id NULLS LAST) AS rn FROM passage_source_map) WHERE rn = 1",
        "w13_series": f"SELECT year_from, count(*) AS n, row_number() OVER (ORDER BY year_from NULLS LAST) AS place FROM {ONCE} GROUP BY 1",
        "w15_hash_sample": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) AS rn FROM documents) WHERE rn <= 5",
        "k4_keyset": f"SELECT id, language FROM {ONCE} WHERE id > 'passage.S20.' ORDER BY id LIMIT 51",
        "k6_compound_keyset": f"SELECT DISTINCT folded, id FROM {aliases} WHERE folded > 'coquille nocturne' OR (folded = 'coquille nocturne' AND id > 'concept.coquille-nocturne') ORDER BY folded, id LIMIT 11",
        "k7_offset": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 30",
        "u2_union": "SELECT doc_id, min(pool)::INTEGER AS pool FROM (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS pool FROM documents WHERE contains(text, '{f}')" for i, f in enumerate(("miroir", "lettre", "silence"))) + ") GROUP BY 1",
        "u4_intersection": f"SELECT session_id FROM {ONCE} WHERE contains(raw_text, 'miroir') INTERSECT SELECT session_id FROM {ONCE} WHERE contains(raw_text, 'lettre')",
        "u5_difference": "SELECT DISTINCT session_id FROM passages WHERE language = 'fr' EXCEPT SELECT session_id FROM passages WHERE language = 'zh'",
        "u6_snapshot_diff": """WITH s AS (SELECT id, loaded_at, sha256(concat_ws('|', seminar_id, session_date, passage_count::VARCHAR)) AS h FROM sessions),
            o AS (SELECT id, max(h) AS old FROM s WHERE loaded_at < TIMESTAMP '2023-03-01' GROUP BY 1), n AS (SELECT id, max(h) AS new FROM s WHERE loaded_at >= TIMESTAMP '2023-03-01' GROUP BY 1)
            SELECT CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'unchanged' ELSE 'modified' END AS state, count(*) AS n FROM o FULL OUTER JOIN n ON o.id = n.id GROUP BY 1""",
        "x2_language": f"""SELECT lang, CASE WHEN n = 0 THEN 'und' WHEN {cnt('[一-鿿]')} / n > 0.05 THEN 'zh' WHEN {cnt('[Ѐ-ӿ]')} / n > 0.1 THEN 'ru' WHEN {cnt('[Ͱ-Ͽ]')} / n > 0.1 THEN 'el' WHEN {cnt('[؀-ۿ]')} / n > 0.1 THEN 'ar'
            WHEN lat / n > 0.2 THEN CASE WHEN de >= 3 AND de / lat > 0.004 AND fr / lat < 0.002 THEN 'de' WHEN fr >= 3 AND fr / lat > 0.003 THEN 'fr' ELSE 'en' END ELSE 'und' END AS detected, count(*) AS n
            FROM (SELECT lang, t, length(t) AS n, {cnt('[a-zà-öø-ÿœ]')} AS lat, {cnt('[àâäéèêëïîôöùûüÿçœæ]')} AS fr, {cnt('[äöüß]')} AS de FROM (SELECT lang, lower(coalesce(text, '')) AS t FROM documents)) GROUP BY 1, 2""",
        "x13_claims": "SELECT claims, count(*) AS documents FROM (SELECT coalesce(len(list_filter(string_split(regexp_replace(regexp_replace(text, '([。！？!?；;])', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda p: trim(p, ' ') <> '')), 0)::INTEGER AS claims FROM documents) GROUP BY 1",
        "x15_isbn": """SELECT DISTINCT code, (list_sum(list_transform(range(1, 14), lambda i: substring(code, i, 1)::INT * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END)) % 10) = 0 AS valid FROM (SELECT lpad((o_orderkey * 7919)::VARCHAR, 13, '9') AS code FROM orders)""",
        "s13_segments": """WITH RECURSIVE p AS (SELECT doc_id, length(part) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM (
            SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x, ' ')), lambda x: length(x) > 60) AS ps FROM documents WHERE text IS NOT NULL))),
            r(doc_id, k, parts, chars, open) AS (SELECT doc_id, k, 1, n, n FROM p WHERE k = 1 UNION ALL SELECT r.doc_id, p.k, CASE WHEN open + 2 + n > 200 THEN parts + 1 ELSE parts END,
            CASE WHEN open + 2 + n > 200 THEN chars + n ELSE chars + 2 + n END, CASE WHEN open + 2 + n > 200 THEN n ELSE open + 2 + n END FROM r JOIN p ON p.doc_id = r.doc_id AND p.k = r.k + 1)
            SELECT doc_id, parts::BIGINT AS parts, chars::BIGINT AS chars FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC) AS z FROM r) WHERE z = 1""",
        "streaming_sessions": """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts,
            CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    }


def oracle_sql() -> dict[str, str]:
    return _sql()
