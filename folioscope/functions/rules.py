"""Ordered rules over texts and records: first matching one wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.text import han_number, roman_number

# What marks a bibliographic line and an editor's note, and words that tie two entities in a sentence.
BIBLIOGRAPHIC = "出版社|商务印书馆|Éditions|Press|éd\\. *[0-9]{4}|Gesammelte Werke"
EDITORIAL = "sténotypie|reprographie|dactylographi|reconstruction|document internet|编者说明|原书|版次说明"
FORMAL_LINK, FORMAL_SYMBOL = "mathème|formule|schéma|公式|图式", "[◊§∃∀→]|[0-9]+\\.[0-9]+"
RELATING = "c'est|est un|est une|signifie|au contraire|tandis que|comme|renvoie|relit|reprend|是|意味着|相反|正如"
# Words that say nothing about a question's subject.
STOPWORDS = ("alors", "avec", "cette", "comment", "dans", "elle", "entre", "leur", "mais", "nous", "pour", "pourquoi", "quel", "quelle", "sans", "sont", "tout", "vous")
DETERMINERS = "^(le |la |les |l'|l’|un |une |des |du |the |a |an )"


def usability(c: Column) -> Column:
    """MEDIA_ONLY, BIBLIOGRAPHY_ONLY, EDITORIAL_METADATA, FRAGMENT_ONLY or SUBSTANTIVE_TEXT."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "!\\[\\[[^\\]]*\\]\\]|!\\[[^\\]]*\\]\\([^)]*\\)|<img", " ")
    body = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "\\[[^\\]]{2,}\\]", " "), "〔[^〕]{2,}〕", " "), "https?://|www\\.", " "))
    word, biblio, editorial = "[\\p{L}\\p{N}_]", t.rlike(BIBLIOGRAPHIC), t.rlike(EDITORIAL)
    label = ~body.rlike("[。！？；.!?;]") & (F.length(body) < 200)
    return (
        F.when(~t.rlike(word), "MEDIA_ONLY")
        .when(~body.rlike(word), F.when(biblio, "BIBLIOGRAPHY_ONLY").otherwise("EDITORIAL_METADATA"))
        .when(F.length(body) < 12, "FRAGMENT_ONLY")
        .when(label & biblio, "BIBLIOGRAPHY_ONLY")
        .when(label & editorial, "EDITORIAL_METADATA")
        .otherwise("SUBSTANTIVE_TEXT")
    )


def relation_strength(c: Column, forms: list[str]) -> Column:
    """R0 to R4 of a text and entities' forms: fewer than two, apart, in one clause, related by words, by a formula."""
    t = F.lower(c)
    present = sum((F.contains(t, F.lit(f)).cast("int") for f in forms), F.lit(0))
    clause = F.exists(F.split(t, "[.!?。！？;；]"), lambda x: sum((F.contains(x, F.lit(f)).cast("int") for f in forms), F.lit(0)) == present)
    return F.when(present < 2, "R0").when(t.rlike(FORMAL_LINK) & t.rlike(FORMAL_SYMBOL), "R4").when(t.rlike(RELATING), "R3").when(clause, "R2").otherwise("R1")


def file_name(c: Column) -> Column:
    """number, part, page_from, page_to, languages, book of a file's name: the plainest mention of a number wins."""
    part = "part[-_ ]?([0-9]+)[-_ ]?pages?[-_ ]?([0-9]+)[-_ ]([0-9]+)"
    t = F.trim(F.regexp_replace(F.regexp_replace(c, part, " "), "_+", " "))
    group = lambda pattern, of=t, k=1: F.nullif(F.regexp_extract(of, pattern, k), F.lit(""))
    arabic = ["研讨班 *([0-9]{1,2}) *期", "第 *([0-9]{1,2}) *期", "讲座 *([0-9]{1,2})", "^ *【[^】]*】 *([0-9]{1,2})", "\\bS([0-9]{1,2})\\b"]
    number = F.coalesce(group(arabic[0]).cast("int"), group(arabic[1]).cast("int"), han_number(group("第([一二三四五六七八九十]+)期")), *(group(p).cast("int") for p in arabic[2:]), roman_number(group("[Ss]eminar *(?:Book *)?([IVXLC]{1,7})\\b")), roman_number(group("\\bBook *([IVXLC]{1,7})\\b")))
    languages = F.when(F.contains(c, F.lit("中英")) | F.contains(c, F.lit("双语")), "zh,en").when(F.contains(c, F.lit("中法")) | F.contains(c, F.lit("法文")), "zh,fr").otherwise("")
    book = F.regexp_replace(F.lower(t), "[\\s_–—·,，。.()（）\\[\\]【】《》'’\"-]+", "")
    return F.struct(number.alias("number"), *(group(part, c, k).cast("int").alias(n) for k, n in enumerate(("part", "page_from", "page_to"), 1)), languages.alias("languages"), book.alias("book"))


def source_type(path: Column) -> Column:
    """What a file is, by its folders and name."""
    ext = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    has = lambda p: path.rlike(f"(?i){p}")
    return (
        F.when(has("研讨班|讲座|seminar|seminaire"), "seminar_primary").when(has("écrits|ecrits"), "ecrits_primary").when(has("想法|笔记|carnet|notes"), "research_note").when(has("相关书籍|livres"), "secondary_book")
        .when(ext == "md", "note").when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "tif", "tiff", "bmp"), "image_asset").otherwise("unknown")
    )


def support_level(authority: Column, role: Column, trace: Column) -> Column:
    """What a passage can carry: primary, translated, secondary, editorial; _unverified if its trace is incomplete."""
    level = F.when((authority == "L1") & (role == "transcription"), "primary").when(authority == "L1", "primary_edition").when(authority == "L2", "translated").when(authority == "L3", "secondary").otherwise("editorial")
    return F.concat(level, F.when(trace == "COMPLETE", "").otherwise("_unverified"))


def completeness(publisher: Column, year: Column, authors: Column, title: Column) -> Column:
    """PUBLISHABLE, PARTIAL or INTERNAL_ONLY metadata."""
    some = publisher.isNotNull() | year.isNotNull() | authors.isNotNull()
    return F.when(publisher.isNotNull() & year.isNotNull() & authors.isNotNull(), "PUBLISHABLE").when(title.isNotNull() & some, "PARTIAL").otherwise("INTERNAL_ONLY")


def cleaned(c: Column) -> Column:
    """A value without control characters, tags and named entities."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", ""), "<[^>]+>", " "), "&[a-z]+;", " "), "[ \\t\\n\\r]+", " "))


def allowed_url(c: Column) -> Column:
    """A URL of a scheme that may be followed, else null."""
    return F.when(c.rlike("^https?://[^\\s]+$"), c)


def salient(words: Column) -> Column:
    """Words of four letters or more that say something about the subject, each once, in their order."""
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS)))


def slug(c: Column) -> Column:
    """Folded letters and digits between hyphens."""
    from folioscope.functions.text import unaccented

    return F.regexp_replace(F.regexp_replace(unaccented(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def seminar_key(c: Column) -> Column:
    """seminar.S with two digits of 20, S20, s20 or seminar.S20; null of anything else."""
    n = F.nullif(F.regexp_extract(c, "^(?:seminar\\.)?[sS]?([0-9]{1,2})$", 1), F.lit(""))
    return F.concat(F.lit("seminar.S"), F.lpad(n, 2, "0"))


def occurrences(text: Column, forms: list[str]) -> Column:
    """first, last, form of every occurrence of forms in a text in lower case; a form is not met inside itself."""
    t = F.lower(F.coalesce(text, F.lit("")))

    def of(form: str) -> Column:
        parts = F.split(t, f"\\Q{form}\\E")
        before = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.length(F.array_join(F.slice(parts, F.lit(1), k), form)))
        here = F.transform(before, lambda n: F.struct((n + 1).alias("first"), (n + len(form)).alias("last"), F.lit(form).alias("form")))
        return F.when(F.contains(t, F.lit(form)), here).otherwise(F.array().cast("array<struct<first:int,last:int,form:string>>"))

    return F.concat(*map(of, forms))


def longest_spans(df: DataFrame, key: str, text: str, forms: list[str]) -> DataFrame:
    """key, first, last, form of the occurrences that no longer one covers: none that began before or there ends as late."""
    rows = df.select(key, F.inline(occurrences(F.col(text), forms)))
    earlier = Window.partitionBy(key).orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_reach", F.max("last").over(earlier)).where("_reach is null or _reach < last").drop("_reach")
