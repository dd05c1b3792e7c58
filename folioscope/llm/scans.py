"""Repair of text from scanned pages (problem 5).

Running headers and page numbers are found by masked digits, layout and repetition; cut words are joined across the
remaining lines; words are grouped by a skeleton in which glyphs that scanners confuse are alike, and a rare form
gives way to the frequent one of its group that its neighbours support. All of it is SQL over lines and words.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.stages import drop_stage, stage
from folioscope.llm.arrow import map_batches

# Glyphs that scanners confuse, brought to one; then letters that look like two others.
GLYPHS = ("01!|l59c6fyb", "oiiiisgeétvh")
STROKES = (("m", "rri"), ("n", "ri"), ("u", "ii"), ("d", "ei"), ("w", "vv"))
#: Hyphens at line ends.
HYPHENS = "\\-‐‑¬\u00ad"
#: A form is replaced by one of its group that is so many times as frequent and occurs at least so often.
TIMES, OFTEN = 5, 3
#: A line shorter than this share of its page's longest is no line of running text, unless it ends a paragraph.
SHORT = 0.6
#: Passages in which a masked line must recur to count as repeated.
RECUR = 3
_WIDE = ("０１２３４５６７８９", "0123456789")
_NUM = "[0-9OolI|]{1,4}"
_WORD = "[\\p{IsLatin}\\p{M}0-9!|]*\\p{IsLatin}[\\p{IsLatin}\\p{M}0-9!|]*"


#: What stands before and after a word that is replaced in its line: nothing that words are made of. The word is quoted.
_APART = ("(?<![\\p{IsLatin}\\p{M}0-9!|])\\Q", "\\E(?![\\p{IsLatin}\\p{M}0-9!|])")


def skeleton(word: Column) -> Column:
    """Words that differ by confusable glyphs only have one skeleton."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), STROKES, F.translate(F.lower(word), *GLYPHS))


_BLANKS = " \t\r\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u3000\u200b\u200c\u200d\u2060\ufeff"
_DIGITS = str.maketrans(*_WIDE)
_S = "[ \t\u00a0\u2000-\u200a\u202f\u3000]"
_ENDED = re.compile("[.!?。！？…][»”’」』）)\\]】\u00a0 ]*$")
_NUMBER = re.compile(f"[^\\w]*(?:[pP]{_S}*\\.|[pP]ages?|第)?{_S}*{_NUM}{_S}*页?[^\\w]*")
_DIGITAL = re.compile("[0-9]|^[\\W_]*[lIO]{1,4}[\\W_]*$")
_PROSE_NUMBER = re.compile(f"^[0-9OlI]+{_S}*[!?！？…。]")
_POINTED = re.compile("^[0-9OlI]+[.]$")
_NUMBERED = re.compile(f"^{_NUM}(?:{_S}{{2,}}|\u3000)[^\\W\\d_].*[^.!?]$|[^\\W\\d_](?:{_S}{{2,}}|\u3000){_NUM}$")
_UP = "A-ZÀ-ÖØ-Þ"
_TITLED = re.compile(f"^[{_UP}][{_UP}l0]{{3,}}{_S}+[IVXLCl]+{_S}*[—–-]|^[^\\W\\d_]\\w*!?\\w*{_S}+[IVXLCl]+{_S}*[·•]|^第[0-9]+[讲章课回]\u3000")
_OPEN_END = re.compile(f"[{HYPHENS},;:，；：、]$")
_MASKED = re.compile("[0-9]+|(?<![^\\W\\d_])[IVXLC]+(?![^\\W\\d_])")
_MASK_GLYPHS = str.maketrans("0O1IL!5S", "OOIIIISS")
#: What a line looks like by itself, as bits.
ENDED, CUT, NUMBER, PROSE_NUMBER, POINTED, CAPITALS, NUMBERED, TITLED, BARE, COMMA, CAPITAL, LOWER = (1 << k for k in range(12))


def looks(line: str) -> int:
    """Bits of a trimmed line's shape."""
    letters = sum(map(str.isalpha, line))
    upper = sum(map(str.isupper, line))
    ended = _ENDED.search(line) is not None
    bits = ENDED * ended
    bits |= CUT * (line[-1] in "-‐‑¬\u00ad") | BARE * (not ended and not _OPEN_END.search(line)) | COMMA * any(c in line for c in ",，;；")
    if letters < 12 and _NUMBER.fullmatch(line) and _DIGITAL.search(line):
        bits |= NUMBER
    bits |= PROSE_NUMBER * (_PROSE_NUMBER.match(line) is not None) | POINTED * (_POINTED.match(line) is not None)
    bits |= CAPITALS * (letters >= 4 and upper >= letters * 0.7)
    bits |= NUMBERED * (_NUMBERED.search(line) is not None) | TITLED * (_TITLED.match(line) is not None)
    first = line[0]
    return bits | CAPITAL * (first.isupper() or first.isdigit() or "㐀" <= first <= "鿿") | LOWER * first.islower()


def lines_of(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Stage table id, line_no (from 1), line (trimmed, digits of one width), widest, looks, mask of every line that is not blank."""
    one = texts.where(F.col(key).isNotNull() & (F.length(column) > 0)).select(F.col(key).cast("string").alias("id"), F.col(column).alias("text")).dropDuplicates(["id"])

    def make():
        def step(b: pa.RecordBatch):
            out: list[tuple] = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lines = [x.translate(_DIGITS).strip(_BLANKS) for x in t.split("\n")]
                widest = max(map(len, lines))
                for k, x in enumerate(lines, 1):
                    if x:
                        out.append((i, k, x, widest, looks(x), " ".join(_MASKED.sub("#", x.upper()).split()).translate(_MASK_GLYPHS)))
            if not out:
                return None
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["id", "line_no", "line", "widest", "looks", "mask"])

        return step

    return stage(map_batches(one, "id string, line_no int, line string, widest int, looks int, mask string", make), "pages")


def _has(bit: int, c: str = "looks") -> Column:
    return F.col(c).bitwiseAND(bit) != 0


def classify(lines: DataFrame) -> DataFrame:
    """id, line_no, line, kind: 'header', 'page_no' or null for running text."""
    recurring = lines.groupBy("mask").agg(F.count("*").alias("recur"), F.min("id").alias("lo"), F.max("id").alias("hi")).where(f"recur >= {RECUR} and lo <> hi").select("mask", "recur")
    page = Window.partitionBy("id").orderBy("line_no")
    full = F.max(F.when((F.length("line") >= F.col("widest") * 0.75) & ~_has(CAPITALS), F.col("line_no"))).over(Window.partitionBy("id"))
    near = lines.withColumns({"before": F.lag("looks").over(page), "after": F.lead("looks").over(page), "last_full": full}).join(recurring, "mask", "left")
    ended, cut = F.col("before").isNull() | _has(ENDED, "before"), F.coalesce(_has(CUT, "before"), F.lit(False))
    begins, closes = F.col("before").isNull(), F.col("after").isNull()
    short = F.length("line") < F.col("widest") * SHORT
    # A number that ends the last sentence of a page is no page number.
    prose_end = _has(PROSE_NUMBER) | ~ended & ~cut & (F.col("line_no") > F.col("last_full")) & _has(POINTED)
    alone = short & _has(BARE) & (~closes | ended)
    again = F.col("recur").isNotNull() & _has(BARE) & _has(CAPITAL) & ~_has(COMMA) & (F.length("line") < F.col("widest") * 0.95) & (begins | closes & ended | ~ended & F.coalesce(_has(LOWER, "after"), F.lit(False)))
    kind = F.when(_has(NUMBER) & ~prose_end, "page_no").when(_has(CAPITALS) | _has(NUMBERED) & _has(BARE) | _has(TITLED) | alone | again, "header")
    return near.withColumn("kind", kind).select("id", "line_no", "line", "kind")


def _clean(c: Column) -> Column:
    """A line without file names and numbers with points, and without invisible characters."""
    return F.regexp_replace(F.regexp_replace(c, "[\u200b-\u200d\u2060\ufeff]", ""), "[\\p{L}0-9]+(?:\\.[\\p{L}0-9]+)+", " . ")


def _runs(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1))


_LAT = "A-Za-zÀ-ÖØ-öø-ɏ"
_PY_WORD = re.compile(f"[0-9!|]*[{_LAT}][{_LAT}\u0300-\u036f0-9!|]*")
_COMPOUND = re.compile(f"(?<![{_LAT}])(?=([{_LAT}]+-[{_LAT}]+))")
_POINTS = re.compile("[^\\W_]+(?:\\.[^\\W_]+)+")
_INVISIBLE = re.compile("[\u200b-\u200d\u2060\ufeff]")
#: Distinct entries that a task counts before it passes them on.
FLUSH = 400_000


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """Stage table kind ('word', 'pair'), w, n: spellings of words and compounds, and neighbours in lower case."""

    def count(batches):
        words: Counter = Counter()
        pairs: Counter = Counter()

        def out():
            rows = [("word", w, n) for w, n in words.items()] + [("pair", f"{a} {b}", n) for (a, b), n in pairs.items()]
            words.clear()
            pairs.clear()
            for k in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 50_000])], ["kind", "w", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    if not t.isascii():
                        t = _INVISIBLE.sub("", t)
                    t = _POINTS.sub(" . ", t)
                    found = _PY_WORD.findall(t)
                    words.update(found)
                    low = " ".join(found).lower().split(" ")
                    pairs.update(zip(low, low[1:]))
                    if "-" in t:
                        words.update(_COMPOUND.findall(t.lower()))
            if len(words) + len(pairs) > FLUSH:
                yield from out()
        if words:
            yield from out()

    counted = texts.select(column).mapInArrow(count, "kind string, w string, n long")
    return stage(counted.groupBy("kind", "w").agg(F.sum("n").alias("n")), "words")


def spellings(counts: DataFrame) -> DataFrame:
    """form (lower case, hyphens kept inside compounds), n, cased (its most frequent spelling)."""
    return counts.where("kind = 'word'").groupBy(F.lower("w").alias("form")).agg(F.sum("n").alias("n"), F.max_by("w", F.struct("n", "w")).alias("cased"))


def listed_forms(words: DataFrame) -> DataFrame:
    """skeleton, right, right_n, right_cased: the forms of pure letters of each group of look-alikes."""
    plain = words.where(F.col("form").rlike("^[\\p{IsLatin}\\p{M}]{2,}$"))
    return plain.select(skeleton(F.col("form")).alias("skeleton"), F.col("form").alias("right"), F.col("n").alias("right_n"), F.col("cased").alias("right_cased"))


def frequent_forms(words: DataFrame) -> DataFrame:
    """skeleton, right, right_n, right_cased: the most frequent form of each group."""
    top = listed_forms(words).groupBy("skeleton").agg(F.max(F.struct("right_n", "right", "right_cased")).alias("top"))
    return top.select("skeleton", "top.right", "top.right_n", "top.right_cased")


def _recase(word: Column, right: Column, cased: Column) -> Column:
    first = F.substring(word, 1, 1)
    capital = F.concat(F.upper(F.substring(right, 1, 1)), F.substring(right, F.lit(2), F.length(right)))
    return F.when(first.rlike("^\\p{Lu}"), capital).when(first.rlike("^\\p{Ll}"), right).otherwise(cased)


def cut_words(running: DataFrame, words: DataFrame, forms: DataFrame) -> DataFrame:
    """id, line_no, left, right, fixed, own of every line end with a hyphen; own: the hyphen belongs to the word."""
    page = Window.partitionBy("id").orderBy("line_no")
    cut = running.select("id", "line_no", F.regexp_extract("line", f"({_WORD})[{HYPHENS}]$", 1).alias("left"), F.regexp_extract(F.lead("line").over(page), f"^({_WORD})", 1).alias("rest"))
    cut = cut.where("left <> '' and rest <> ''").withColumns({"whole": F.concat("left", "rest"), "compound": F.lower(F.concat_ws("-", "left", "rest"))})
    seen = words.select(F.col("form"), "n")
    cut = cut.join(seen.toDF("compound", "as_compound"), "compound", "left").join(seen.select(F.col("form").alias("low"), F.col("n").alias("as_word")), F.lower("whole") == F.col("low"), "left")
    cut = cut.withColumn("skeleton", skeleton(F.col("whole"))).join(forms, "skeleton", "left")
    known = F.coalesce("as_word", F.lit(0)) * TIMES >= F.coalesce("right_n", F.lit(0))
    fixed = F.when(F.col("right").isNull() | known & ~F.col("whole").rlike("[0-9!|]"), F.col("whole")).otherwise(_recase(F.col("whole"), F.col("right"), F.col("right_cased")))
    own = F.coalesce("as_compound", F.lit(0)) > F.greatest(F.coalesce("as_word", F.lit(0)), F.coalesce("right_n", F.lit(0)))
    return cut.select("id", "line_no", "left", "rest", fixed.alias("fixed"), own.alias("own"))


def misread_words(running: DataFrame, cuts: DataFrame, words: DataFrame, counts: DataFrame) -> DataFrame:
    """id, line_no, word, fixed of words with misread characters, outside cut words.

    Every frequent form of a word's group may be meant: the one that its neighbours support most often is, and the most
    frequent one where they say nothing.
    """
    page = Window.partitionBy("id").orderBy("line_no")
    lines = running.join(cuts.select("id", "line_no", F.lit(True).alias("cut")), ["id", "line_no"], "left").withColumn("cut_before", F.lag("cut").over(page))
    body = F.when(F.col("cut"), F.regexp_replace("line", f"{_WORD}[{HYPHENS}]$", "")).otherwise(F.col("line"))
    body = F.when(F.col("cut_before"), F.regexp_replace(body, f"^{_WORD}", "")).otherwise(body)
    tokens = lines.select("id", "line_no", _runs(_clean(body), _WORD).alias("ws")).select("id", "line_no", F.posexplode("ws").alias("i", "word"), "ws")
    tokens = tokens.select("id", "line_no", "i", "word", F.lower(F.get("ws", F.col("i") - 1)).alias("before"), F.lower(F.get("ws", F.col("i") + 1)).alias("after"))
    noisy = F.col("form").rlike("[0-9!|]")
    rare = words.where(~F.col("form").contains("-") & ((F.length("form") > 2) | noisy & (F.length("form") > 1))).withColumn("skeleton", skeleton(F.col("form"))).join(listed_forms(words), "skeleton")
    rare = rare.where((F.col("form") != F.col("right")) & ~F.col("form").rlike("^[0-9]+[eèé]?r?$|^\\p{L}[0-9]+$") & (noisy | (F.col("right_n") >= OFTEN) & (F.col("right_n") >= TIMES * F.col("n"))))
    found = tokens.join(rare.select("form", "n", "right", "right_n", "right_cased"), F.lower("word") == F.col("form"))
    wanted = found.select(F.explode(F.array(F.concat_ws(" ", "before", "right"), F.concat_ws(" ", "right", "after"))).alias("pair")).distinct()
    counted = counts.where("kind = 'pair'").select(F.col("w").alias("pair"), F.col("n").alias("m")).join(wanted, "pair", "left_semi")
    found = found.withColumns({"p1": F.concat_ws(" ", "before", "right"), "p2": F.concat_ws(" ", "right", "after")}).join(counted.toDF("p1", "m1"), "p1", "left").join(counted.toDF("p2", "m2"), "p2", "left")
    support = F.coalesce("m1", F.lit(0)) + F.coalesce("m2", F.lit(0))
    best = found.groupBy("id", "line_no", "i", "word").agg(F.max(F.struct(support.alias("m"), "right_n", "right", "right_cased", "n")).alias("b")).select("id", "line_no", "word", "b.*")
    supported = F.col("word").rlike("[0-9!|]") | (F.col("m") > 0) | (F.col("right_n") >= 10 * TIMES * F.col("n"))
    return best.where(supported).select("id", "line_no", "word", _recase(F.col("word"), F.col("right"), F.col("right_cased")).alias("fixed"))


def repair(pages: DataFrame, texts: DataFrame, key: str = "id", column: str = "raw_text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classified lines, cut words and misread words of pages; texts (the pages among them) give the word statistics."""
    marked = lines_of(pages, key, column)
    lines = stage(classify(marked), "lines")
    drop_stage(marked)
    running = lines.where("kind is null").select("id", "line_no", "line")
    counts = word_counts(texts, column)
    words = stage(spellings(counts), "spellings")
    forms = frequent_forms(words)
    cuts = stage(cut_words(running, words, forms), "cuts")
    return lines, cuts, misread_words(running, cuts, words, counts)


def noise_places(pages: DataFrame, texts: DataFrame, key: str = "id", column: str = "raw_text") -> DataFrame:
    """id, line_no, kind, fixed: one row per distinct place.

    Null keys and texts and empty ones have no places; a page delivered twice counts once; blank lines are counted but
    are no places; texts of any length are cut into lines in parallel; empty tables give no rows.
    """
    lines, cuts, misread = repair(pages, texts, key, column)
    marks = lines.where("kind is not null").select("id", "line_no", "kind", F.lit("").alias("fixed"))
    hyphens = cuts.where("not own").select("id", "line_no", F.lit("hyphen").alias("kind"), "fixed")
    chars = misread.select("id", "line_no", F.lit("char").alias("kind"), "fixed")
    return marks.unionByName(hyphens).unionByName(chars).distinct()


def readable(pages: DataFrame, texts: DataFrame, key: str = "id", column: str = "raw_text") -> DataFrame:
    """id and the continuous text: without headers and page numbers, words joined and corrected, lines reflowed."""
    lines, cuts, misread = repair(pages, texts, key, column)
    fixes = misread.groupBy("id", "line_no").agg(F.sort_array(F.collect_set(F.struct(F.col("word").alias("bad"), F.col("fixed").alias("good")))).alias("fixes"))
    page = Window.partitionBy("id").orderBy("line_no")
    line = F.coalesce(F.aggregate("fixes", F.col("line"), lambda t, x: F.regexp_replace(t, F.concat(F.lit(_APART[0]), x["bad"], F.lit(_APART[1])), x["good"])), F.col("line"))
    rows = lines.where("kind is null").join(fixes, ["id", "line_no"], "left").join(cuts, ["id", "line_no"], "left").withColumn("line", line)
    rows = rows.withColumn("dropped", F.lag(F.when(~F.col("own"), F.col("rest"))).over(page))
    start = F.when(F.col("dropped").isNotNull(), F.expr("substring(line, length(dropped) + 1)")).otherwise(F.col("line"))
    end = F.when(F.col("own").isNull(), F.concat(start, F.when(F.col("line").rlike("\\p{IsHan}.?$"), "").otherwise(" "))).when(F.col("own"), start).otherwise(F.concat(F.regexp_replace(start, f"{_WORD}[{HYPHENS}]$", ""), "fixed", F.lit("")))
    return rows.withColumn("piece", end).groupBy("id").agg(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "piece"))), lambda x: x["piece"]), "")).alias("text"))
