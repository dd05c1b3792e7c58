"""Functions and ordered rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import rules as R
from folioscope.functions import text as X
from folioscope.operators import windows
from folioscope.plans.browse import _aliases, _passages
from folioscope.plans.sql import ONCE, Catalogue, compat, norm_fr, text, unaccented
from folioscope.sources.tables import table

query = Catalogue()


@query(f"""SELECT entry_id, trim(lower({compat('entered')})) AS fold_nfkc, trim(regexp_replace({unaccented('entered')}, '[^a-z0-9一-鿿]+', ' ', 'g')) AS fold_ascii, {norm_fr('entered')} AS norm_fr, regexp_replace({unaccented('entered')}, '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS squashed,
    trim(regexp_replace(regexp_replace({compat('entered')}, '[''’ʼ]', '''', 'g'), '[ \\t\\n\\r\\x0b\\f]+', ' ', 'g')) AS form_norm FROM term_entries""")
def x1_forms(spark, d):
    """The normal forms of every entry."""
    e = table(spark, d, "term_entries")
    return e.select("entry_id", *(f(F.col("entered")).alias(f.__name__) for f in (X.fold_nfkc, X.fold_ascii, X.norm_fr, X.squashed, X.form_norm)))


@query("SELECT language, count(*) AS n FROM (SELECT DISTINCT id, alias, CASE WHEN regexp_matches(alias, '\\p{Han}') AND regexp_matches(alias, '\\p{Latin}') THEN 'mul' WHEN regexp_matches(alias, '\\p{Han}') THEN 'zh' WHEN regexp_matches(alias, '[àâäéèêëïîôöùûüÿçœæ]') THEN 'fr' ELSE 'und' END AS language FROM (SELECT id, trim(unnest(list_concat([canonical_name, fr, en, zh], coalesce(aliases, [])))) AS alias FROM spec) WHERE alias <> '') GROUP BY 1")
def x3_form_languages(spark, d):
    """Languages of the listed names by their own characters."""
    return _aliases(spark, d).select("id", "alias").distinct().groupBy(X.form_language(F.col("alias")).alias("language")).agg(F.count("*").alias("n"))


def _names(spark, d):
    s = windows.first_wins(table(spark, d, "seminars"), ["id"], ["loaded_at"]).select("id", "roman", F.coalesce("fr_title", F.lit("sans titre")).alias("fr"), F.coalesce("zh_title", F.lit("无题")).alias("zh"), F.regexp_extract("id", "([0-9]+)$", 1).alias("n"))
    styles = [F.concat(F.lit("研讨班"), "n", F.lit("期 "), "zh"), F.concat("fr", F.lit("-part-01-pages-1-104")), F.concat("fr", F.lit("-part-02-pages-105-210")), F.concat(F.lit("Seminar "), "roman", F.lit(" "), "fr"), F.concat(F.lit("【中英】"), "n", "zh"), F.concat(F.lit("S"), "n", F.lit(" lettre"))]
    return s.select("id", F.posexplode(F.array(*styles)).alias("style", "name"))


_NAMES = """(SELECT id, unnest([0, 1, 2, 3, 4, 5]) AS style, unnest(['研讨班' || n || '期 ' || zh, fr || '-part-01-pages-1-104', fr || '-part-02-pages-105-210', 'Seminar ' || roman || ' ' || fr, '【中英】' || n || zh, 'S' || n || ' lettre']) AS name FROM (
    SELECT id, roman, coalesce(fr_title, 'sans titre') AS fr, coalesce(zh_title, '无题') AS zh, regexp_extract(id, '([0-9]+)$', 1) AS n FROM seminars QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1))"""
_NUMBER = "CASE WHEN style IN (0, 3, 4, 5) AND NOT (style = 3 AND roman IS NULL) THEN n END"


@query("""SELECT id, style::INTEGER AS style, CASE WHEN style IN (0, 4, 5) OR style = 3 AND roman IS NOT NULL THEN n END AS number, CASE style WHEN 1 THEN 1 WHEN 2 THEN 2 END AS part, CASE style WHEN 1 THEN 1 WHEN 2 THEN 105 END AS page_from, CASE style WHEN 1 THEN 104 WHEN 2 THEN 210 END AS page_to, CASE WHEN style = 4 THEN 'zh,en' ELSE '' END AS languages
    FROM (SELECT id, roman, regexp_extract(id, '([0-9]+)$', 1)::INTEGER AS n, unnest([0, 1, 2, 3, 4, 5]) AS style FROM seminars QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1) WHERE style <> 3 OR roman IS NOT NULL""".replace("FROM (SELECT id, roman, regexp", "FROM (SELECT id, roman, n, unnest([0, 1, 2, 3, 4, 5]) AS style FROM (SELECT id, roman, regexp").replace("::INTEGER AS n, unnest([0, 1, 2, 3, 4, 5]) AS style FROM seminars", "::INTEGER AS n FROM seminars").replace(" = 1) WHERE style", " = 1)) WHERE style"))
def x4_file_names(spark, d):
    """What file names of six styles say about seminar, part, pages and languages."""
    return _names(spark, d).where("name is not null").select("id", "style", R.file_name(F.col("name")).alias("f")).select("id", "style", "f.number", "f.part", "f.page_from", "f.page_to", "f.languages")


@query(f"SELECT book, count(*) AS parts, min(name) AS first FROM (SELECT name, regexp_replace(lower(trim(regexp_replace(regexp_replace(name, 'part[-_ ]?([0-9]+)[-_ ]?pages?[-_ ]?([0-9]+)[-_ ]([0-9]+)', ' '), '_+', ' ', 'g'))), '[\\s_–—·,，。.()（）\\[\\]【】《》''’\"-]+', '', 'g') AS book FROM {_NAMES} WHERE style IN (1, 2)) GROUP BY 1 HAVING count(*) > 1")
def a19_split_books(spark, d):
    """Files that are parts of one book: equal names without their parts."""
    f = _names(spark, d).where("name is not null").select("name", R.file_name(F.col("name")).alias("f")).where("f.part is not null")
    return f.groupBy(F.col("f.book").alias("book")).agg(F.count("*").alias("parts"), F.min("name").alias("first")).where("parts > 1")


@query(f"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(p, '(?i)研讨班|讲座|seminar|seminaire') THEN 'seminar_primary' WHEN regexp_matches(p, '(?i)écrits|ecrits') THEN 'ecrits_primary' WHEN regexp_matches(p, '(?i)想法|笔记|carnet|notes') THEN 'research_note' WHEN regexp_matches(p, '(?i)相关书籍|livres') THEN 'secondary_book'
    WHEN lower(regexp_extract(p, '\\.([^./]+)$', 1)) = 'md' THEN 'note' WHEN lower(regexp_extract(p, '\\.([^./]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'gif', 'webp', 'tif', 'tiff', 'bmp') THEN 'image_asset' ELSE 'unknown' END AS kind FROM (SELECT DISTINCT coalesce(provenance.recovered_file_path, source_file_relpath, '') AS p FROM passages)) GROUP BY 1""")
def x5_source_types(spark, d):
    """Types of the files behind the passages."""
    paths = table(spark, d, "passages").select(F.coalesce("provenance.recovered_file_path", "source_file_relpath", F.lit("")).alias("p")).distinct()
    return paths.groupBy(R.source_type(F.col("p")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT id, regexp_extract(id, '([0-9]+)$', 1)::INTEGER AS number, roman IS NULL AS unnamed FROM seminars WHERE roman IS NOT NULL GROUP BY ALL UNION ALL SELECT n::VARCHAR, n::INTEGER, false FROM range(1, 100) t(n)")
def x6_numerals(spark, d):
    """Roman numerals of the seminars, and the Chinese ones up to 99."""
    roman = table(spark, d, "seminars").where("roman is not null").select("id", X.roman_number(F.col("roman")).alias("number"), F.lit(False).alias("unnamed")).distinct()
    digit = lambda i: F.substring(F.lit(X.HAN_DIGITS), i + 1, F.lit(1))
    n = F.col("id").cast("int")
    tens, ones = F.floor(n / 10).cast("int"), n % 10
    han = F.concat(F.when(tens > 1, digit(tens)).otherwise(""), F.when(tens > 0, "十").otherwise(""), F.when(ones > 0, digit(ones)).otherwise(""))
    return roman.unionByName(spark.range(1, 100).select(F.col("id").cast("string").alias("id"), X.han_number(han).alias("number"), F.lit(False).alias("unnamed")))


_T = "regexp_replace(coalesce({c}, ''), '!\\[\\[[^\\]]*\\]\\]|!\\[[^\\]]*\\]\\([^)]*\\)|<img', ' ', 'g')"
_BODY = "trim(regexp_replace(regexp_replace(regexp_replace(t, '\\[[^\\]]{2,}\\]', ' ', 'g'), '〔[^〕]{2,}〕', ' ', 'g'), 'https?://|www\\.', ' ', 'g'))"


def _usability(c: str, table: str, keys: str) -> str:
    return f"""(SELECT {keys}, CASE WHEN NOT regexp_matches(t, '[\\p{{L}}\\p{{N}}_]') THEN 'MEDIA_ONLY' WHEN NOT regexp_matches(body, '[\\p{{L}}\\p{{N}}_]') THEN CASE WHEN b THEN 'BIBLIOGRAPHY_ONLY' ELSE 'EDITORIAL_METADATA' END WHEN length(body) < 12 THEN 'FRAGMENT_ONLY'
        WHEN label AND b THEN 'BIBLIOGRAPHY_ONLY' WHEN label AND e THEN 'EDITORIAL_METADATA' ELSE 'SUBSTANTIVE_TEXT' END AS usability FROM (SELECT *, NOT regexp_matches(body, '[。！？；.!?;]') AND length(body) < 200 AS label, regexp_matches(t, {text(R.BIBLIOGRAPHIC)}) AS b, regexp_matches(t, {text(R.EDITORIAL)}) AS e FROM (SELECT *, {_BODY} AS body FROM (SELECT *, {_T.format(c=c)} AS t FROM {table}))))"""


@query(f"SELECT text_role, usability, count(*) AS n FROM {_usability('raw_text', ONCE, 'text_role')} GROUP BY ALL")
def x7_usability(spark, d):
    """What the passages can serve as, by role."""
    return _passages(spark, d, "text_role", R.usability(F.col("raw_text")).alias("usability")).groupBy("text_role", "usability").agg(F.count("*").alias("n"))


_PAIR = ["miroir", "lettre", "fleuve"]


@query(f"""SELECT strength, count(*) AS n FROM (SELECT CASE WHEN k < 2 THEN 'R0' WHEN regexp_matches(t, {text(R.FORMAL_LINK)}) AND regexp_matches(t, {text(R.FORMAL_SYMBOL)}) THEN 'R4' WHEN regexp_matches(t, {text(R.RELATING)}) THEN 'R3'
    WHEN len(list_filter(string_split_regex(t, '[.!?。！？;；]'), lambda x: {' + '.join(f"contains(x, '{f}')::INT" for f in _PAIR)} = k)) > 0 THEN 'R2' ELSE 'R1' END AS strength FROM (SELECT lower(raw_text) AS t, {' + '.join(f"contains(lower(raw_text), '{f}')::INT" for f in _PAIR)} AS k FROM {ONCE})) GROUP BY 1""")
def x8_relation_strength(spark, d):
    """How strongly passages relate three entities, R0 to R4."""
    return _passages(spark, d, R.relation_strength(F.col("raw_text"), _PAIR).alias("strength")).groupBy("strength").agg(F.count("*").alias("n"))


@query(f"SELECT formula, count(*) AS n FROM (SELECT regexp_replace(translate(e, {text(X.GLYPHS[0])}, {text(X.GLYPHS[1])}), '[ \\t\\n\\r]+', '', 'g') AS formula FROM (SELECT unnest(regexp_extract_all(raw_text, '(§ ?[0-9.]*[0-9]|[0-9]+ ?[–−-] ?[0-9]+)', 1)) AS e FROM {ONCE})) GROUP BY 1")
def x9_formulas(spark, d):
    """Numbered and ranged expressions in one notation."""
    e = _passages(spark, d, F.regexp_extract_all("raw_text", F.lit("(§ ?[0-9.]*[0-9]|[0-9]+ ?[–−-] ?[0-9]+)"), F.lit(1)).alias("es")).select(F.explode("es").alias("e"))
    return e.groupBy(X.matheme(F.col("e")).alias("formula")).agg(F.count("*").alias("n"))


_NEEDLES = ["miroir", "la lettre", "voix basse", "uver"]
_CLAUSES = "list_transform(string_split_regex({u}, '[.,;:!?。，；：！？、…()（）]+'), lambda x: list_filter(string_split(trim(regexp_replace(x, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query(f"WITH c AS (SELECT doc_id, {_CLAUSES.format(u=unaccented('text')).replace('{{', '{').replace('}}', '}')} AS cs FROM documents WHERE text IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{n}' AS needle, count(*) AS n FROM c WHERE " + (f"len(list_filter(cs, lambda ts: len(list_filter(ts, lambda t: contains(t, '{n}'))) > 0)) > 0" if " " not in n else f"len(list_filter(cs, lambda ts: contains(' ' || array_to_string(ts, ' ') || ' ', ' {n} '))) > 0") for n in _NEEDLES))
def x10_token_bounds(spark, d):
    """Documents that hold a needle without crossing the bounds of words and clauses."""
    docs = table(spark, d, "documents").where("text is not null").agg(*(F.count_if(X.holds_tokens(F.col("text"), n)).alias(f"n{i}") for i, n in enumerate(_NEEDLES)))
    return docs.select(F.explode(F.array(*(F.struct(F.lit(n).alias("needle"), F.col(f"n{i}").alias("n")) for i, n in enumerate(_NEEDLES)))).alias("x")).select("x.*")


@query("""WITH c AS (SELECT DISTINCT w, cite FROM (SELECT coalesce(witness_id, '') AS w, rtrim(unnest(regexp_extract_all('voir ' || passage_id || ', puis (' || passage_id || ') et passage.S99.unknown.P9999.', '(passage\\.S[0-9A-Za-z.-]+)', 1)), '.,;)') AS cite FROM passage_source_map WHERE passage_id IS NOT NULL))
    SELECT w AS witness, count(*) AS cited, count(p.id) AS valid, round(count(p.id) / count(*), 4) AS validity, min(CASE WHEN p.id IS NULL THEN cite END) AS first_fabricated FROM c LEFT JOIN (SELECT DISTINCT id FROM passages) p ON p.id = cite GROUP BY 1""")
def x11_citations(spark, d):
    """Passages cited in notes of the witnesses: how many exist, and the first that does not (E11)."""
    note = F.concat(F.lit("voir "), "passage_id", F.lit(", puis ("), "passage_id", F.lit(") et passage.S99.unknown.P9999."))
    cites = table(spark, d, "passage_source_map").where("passage_id is not null").select(F.coalesce("witness_id", F.lit("")).alias("witness"), F.explode(F.regexp_extract_all(note, F.lit("(passage\\.S[0-9A-Za-z.-]+)"), F.lit(1))).alias("cite"))
    cites = cites.select("witness", F.regexp_replace("cite", "[.,;)]+$", "").alias("cite")).distinct()
    known = table(spark, d, "passages").select(F.col("id").alias("cite")).distinct().withColumn("known", F.lit(True))
    rows = cites.join(known, "cite", "left").groupBy("witness").agg(F.count("*").alias("cited"), F.count("known").alias("valid"), F.min(F.when(F.col("known").isNull(), F.col("cite"))).alias("first_fabricated"))
    return rows.withColumn("validity", F.round(F.col("valid") / F.col("cited"), 4))


@query(f"SELECT support, count(*) AS n FROM (SELECT CASE WHEN authority_level = 'L1' AND text_role = 'transcription' THEN 'primary' WHEN authority_level = 'L1' THEN 'primary_edition' WHEN authority_level = 'L2' THEN 'translated' WHEN authority_level = 'L3' THEN 'secondary' ELSE 'editorial' END || CASE WHEN trace_status = 'COMPLETE' THEN '' ELSE '_unverified' END AS support FROM {ONCE}) GROUP BY 1")
def x12_support(spark, d):
    """What the passages can carry."""
    return _passages(spark, d, R.support_level(F.col("authority_level"), F.col("text_role"), F.col("trace_status")).alias("support")).groupBy("support").agg(F.count("*").alias("n"))


@query(f"SELECT id, 'S' || s || CASE WHEN lesson IS NULL THEN '' ELSE ', leçon ' || lesson END AS short, 'Séminaire ' || s || CASE WHEN lesson IS NULL THEN '' ELSE ', leçon ' || lesson END || CASE WHEN session_date = 'unknown' OR session_date IS NULL THEN ', sans date' ELSE ', ' || session_date END || ', ' || coalesce(witness_id, 'sans témoin') AS whole FROM (SELECT *, regexp_extract(seminar_id, '([0-9]+)$', 1)::INTEGER AS s FROM {ONCE} WHERE regexp_matches(seminar_id, '[0-9]$'))")
def x14_citation_forms(spark, d):
    """Short and full citations of the passages."""
    s = F.regexp_extract("seminar_id", "([0-9]+)$", 1).cast("int").cast("string")
    lesson = F.when(F.col("lesson").isNull(), "").otherwise(F.concat(F.lit(", leçon "), F.col("lesson").cast("string")))
    date = F.when((F.col("session_date") == "unknown") | F.col("session_date").isNull(), ", sans date").otherwise(F.concat(F.lit(", "), "session_date"))
    return _passages(spark, d, F.concat(F.lit("S"), s, lesson).alias("short"), F.concat(F.lit("Séminaire "), s, lesson, date, F.lit(", "), F.coalesce("witness_id", F.lit("sans témoin"))).alias("whole"), where=F.col("seminar_id").rlike("[0-9]$"))


@query("""SELECT DISTINCT isbn, list_sum(list_transform(range(1, 11), lambda i: (11 - i) * CASE WHEN substring(isbn, i, 1) = 'X' THEN 10 ELSE substring(isbn, i, 1)::INT END)) % 11 = 0 AS isbn_valid, CASE WHEN k % 3 = 0 THEN NULL ELSE '10.' || (1000 + k % 9000) || '/o' || k END AS doi
    FROM (SELECT o_orderkey AS k, lpad((o_orderkey * 7919 % 1000000000)::VARCHAR, 9, '0') || CASE WHEN o_orderkey % 11 = 10 THEN 'X' ELSE (o_orderkey % 11)::VARCHAR END AS isbn FROM orders)""")
def x15_identifiers(spark, d):
    """ISBN-10 check digits and DOIs with and without their resolver, two of three well formed."""
    k = F.col("o_orderkey")
    isbn = F.concat(F.lpad((k * 7919 % 1000000000).cast("string"), 9, "0"), F.when(k % 11 == 10, "X").otherwise((k % 11).cast("string")))
    doi = F.concat(F.when(k % 3 == 0, "10.12/").when(k % 3 == 1, "https://doi.org/10.").otherwise("10."), F.when(k % 3 == 0, "").otherwise(F.concat((1000 + k % 9000).cast("string"), F.lit("/o"))), k.cast("string"))
    return table(spark, d, "orders").select(isbn.alias("isbn"), X.isbn10_valid(isbn).alias("isbn_valid"), X.doi(doi).alias("doi")).distinct()


@query("""SELECT level, count(*) AS n FROM (SELECT CASE WHEN p IS NOT NULL AND y IS NOT NULL AND a IS NOT NULL THEN 'PUBLISHABLE' WHEN edition IS NOT NULL AND (p IS NOT NULL OR y IS NOT NULL OR a IS NOT NULL) THEN 'PARTIAL' ELSE 'INTERNAL_ONLY' END AS level FROM (
    SELECT edition, nullif(regexp_extract(edition, 'Éditions ([\\p{L}]+)', 1), '') AS p, nullif(regexp_extract(edition, '((?:19|20)[0-9]{2})', 1), '') AS y, nullif(regexp_extract(edition, '(Transcription de|exemplaire) ([\\p{L}]+)', 2), '') AS a FROM witnesses)) GROUP BY 1""")
def x16_completeness(spark, d):
    """How complete the witnesses' metadata are."""
    group = lambda p, k=1: F.nullif(F.regexp_extract("edition", p, k), F.lit(""))
    level = R.completeness(group("Éditions ([\\p{L}]+)"), group("((?:19|20)[0-9]{2})"), group("(Transcription de|exemplaire) ([\\p{L}]+)", 2), F.col("edition"))
    return table(spark, d, "witnesses").groupBy(level.alias("level")).agg(F.count("*").alias("n"))


@query("""SELECT doc_kind, count(*) FILTER (c <> t) AS changed, sum(length(c))::BIGINT AS chars, count(*) FILTER (regexp_matches(u, '^https?://[^ ]+$')) AS followed FROM (SELECT doc_kind, t, u, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'), '<[^>]+>', ' ', 'g'), '&[a-z]+;', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS c FROM (
    SELECT doc_kind, '<p>' || text || '&nbsp;' AS t, CASE WHEN doc_id % 3 = 0 THEN 'javascript:' ELSE 'https://' END || doc_id AS u FROM documents WHERE text IS NOT NULL)) GROUP BY 1""")
def x17_cleaning(spark, d):
    """Values freed of tags, entities and control characters, and addresses whose scheme may be followed."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_kind", F.concat(F.lit("<p>"), "text", F.lit("&nbsp;")).alias("t"), F.concat(F.when(F.col("doc_id") % 3 == 0, "javascript:").otherwise("https://"), F.col("doc_id").cast("string")).alias("u"))
    return docs.withColumn("c", R.cleaned(F.col("t"))).groupBy("doc_kind").agg(F.count_if(F.col("c") != F.col("t")).alias("changed"), F.sum(F.length("c")).alias("chars"), F.count(R.allowed_url(F.col("u"))).alias("followed"))


@query(f"SELECT DISTINCT id, regexp_replace(regexp_replace({unaccented('fr_title')}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, id AS by_number, NULL::VARCHAR AS by_word FROM seminars WHERE fr_title IS NOT NULL")
def x18_ids(spark, d):
    """Slugs of titles, and seminar ids of either spelling."""
    s = table(spark, d, "seminars").where("fr_title is not null")
    return s.select("id", R.slug(F.col("fr_title")).alias("slug"), R.seminar_key(F.regexp_replace("id", "^seminar\\.S0?", "")).alias("by_number"), R.seminar_key(F.lit("vingt")).alias("by_word")).distinct()


@query(f"SELECT seminar_id, k AS language, coalesce(n, 0) AS n FROM (SELECT DISTINCT seminar_id, unnest(['fr', 'zh', 'en']) AS k FROM {ONCE} WHERE seminar_id IS NOT NULL) LEFT JOIN (SELECT seminar_id, language AS k, count(*) AS n FROM {ONCE} GROUP BY ALL) USING (seminar_id, k)")
def x23_counters(spark, d):
    """Counters per seminar as a map with defaults for what does not occur."""
    n = _passages(spark, d, "seminar_id", "language", where="seminar_id is not null and language is not null").groupBy("seminar_id", "language").agg(F.count("*").alias("n"))
    maps = n.groupBy("seminar_id").agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("m"))  # a few languages
    keys = F.map_keys(F.map_concat(F.create_map(*[x for k in ("fr", "zh", "en") for x in (F.lit(k), F.lit(0).cast("long"))]), F.map_filter("m", lambda k, v: ~k.isin("fr", "zh", "en"))))
    return maps.select("seminar_id", F.explode(keys).alias("language"), "m").select("seminar_id", "language", F.coalesce(F.try_element_at("m", F.col("language")), F.lit(0)).alias("n"))


@query(f"""SELECT 'year' AS kind, y AS value, count(*) AS n FROM (SELECT unnest(list_filter(regexp_extract_all(raw_text, '[0-9]+'), lambda y: regexp_matches(y, '^(19[5-9]|20[0-2])[0-9]$'))) AS y FROM {ONCE}) GROUP BY ALL UNION ALL SELECT 'day', strftime(try_strptime(session_date, '%Y-%m-%d'), '%Y-%m'), count(*) FROM {ONCE} WHERE regexp_matches(session_date, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') GROUP BY ALL""")
def x25_dates(spark, d):
    """Years from 1950 to 2029 in the texts, and days of the sessions by month."""
    y = _passages(spark, d, F.filter(F.regexp_extract_all("raw_text", F.lit("([0-9]+)"), F.lit(1)), lambda y: y.rlike("^(19[5-9]|20[0-2])[0-9]$")).alias("ys")).select(F.lit("year").alias("kind"), F.explode("ys").alias("value"))
    day = _passages(spark, d, "session_date", where=F.col("session_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).select(F.lit("day").alias("kind"), F.date_format(F.try_to_timestamp("session_date", F.lit("yyyy-MM-dd")), "yyyy-MM").alias("value"))
    return y.unionByName(day).groupBy("kind", "value").agg(F.count("*").alias("n"))


@query(f"SELECT term, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(string_split({norm_fr('text')}, ' ')) AS term FROM documents WHERE text IS NOT NULL AND lang = 'fr') WHERE length(term) >= 4 AND term NOT IN {R.STOPWORDS} GROUP BY 1")
def x28_salient_terms(spark, d):
    """Terms that say something about the subject of French documents, by documents."""
    docs = table(spark, d, "documents").where("text is not null and lang = 'fr'")
    return docs.select("doc_id", F.explode(R.salient(F.split(X.norm_fr(F.col("text")), " "))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH a AS (SELECT DISTINCT id, lower(trim(alias)) AS alias FROM (SELECT id, unnest(list_concat([canonical_name, fr, en, zh], coalesce(aliases, []))) AS alias FROM spec) WHERE trim(alias) <> ''), s AS (SELECT id, alias, regexp_replace(alias, {text(R.DETERMINERS)}, '') AS bare FROM a) SELECT id, bare, count(*) AS forms, min(alias) AS first FROM s GROUP BY ALL HAVING count(*) > 1")
def x29_determiners(spark, d):
    """Names of one entity that are equal without their determiners."""
    a = _aliases(spark, d).select("id", F.lower("alias").alias("alias")).distinct().withColumn("bare", F.regexp_replace("alias", R.DETERMINERS, ""))
    return a.groupBy("id", "bare").agg(F.count("*").alias("forms"), F.min("alias").alias("first")).where("forms > 1")


_FORMS = ["miroir", "miroir fragile", "la lettre", "lettre", "fleuve", "fleuve vivant"]


@query("WITH o AS (SELECT doc_id, form, i AS first, i + length(form) - 1 AS last FROM (SELECT doc_id, t, form, unnest(list_filter(range(1, length(t) - length(form) + 2), lambda i: substring(t, i, length(form)) = form)) AS i FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL) JOIN (SELECT unnest(" + repr(_FORMS) + ") AS form) ON contains(t, form))) SELECT form, count(*) AS n, count(DISTINCT doc_id) AS documents FROM o WHERE NOT EXISTS (SELECT 1 FROM o x WHERE x.doc_id = o.doc_id AND x.first <= o.first AND x.last >= o.last AND length(x.form) > length(o.form)) GROUP BY 1")
def x30_longest_spans(spark, d):
    """Occurrences of forms that no longer form covers."""
    return R.longest_spans(table(spark, d, "documents"), "doc_id", "text", _FORMS).groupBy("form").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def queries() -> dict:
    return dict(query.functions)


def oracle_sql() -> dict[str, str]:
    return dict(query.sql)
