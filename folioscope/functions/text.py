"""Text functions as column expressions; all but decode_bytes run inside the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain ones.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
#: Blocks whose compatibility characters are brought to plain ones: Latin supplement, blanks, letter-like signs, radicals,
#: compatibility ideographs, wide and narrow forms.
_BLOCKS = ((0xA0, 0xBF), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x2070, 0x209C), (0x2100, 0x214F), (0x2F00, 0x2FD5), (0x3000, 0x3000), (0xF900, 0xFAD9), (0xFF01, 0xFFEE))
_SINGLE = [(chr(c), n) for lo, hi in _BLOCKS for c in range(lo, hi + 1) if len(n := unicodedata.normalize("NFKC", chr(c))) == 1 and n != chr(c)]
#: One compatibility character and its plain one, as two strings; and those that stand for several.
COMPATIBLE = ("".join(a for a, _ in _SINGLE), "".join(b for _, b in _SINGLE))
SEVERAL = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0xFB00, 0xFB07), 0x2026)}
# Apostrophes that elide, and signs of formulas with the one that stands for each.
APOSTROPHES = "'’ʼ"
GLYPHS = ("⋄♢⬦◇−–", "◊◊◊◊--")
# Chinese digits; Roman ones with their numbers.
HAN_DIGITS = "零一二三四五六七八九"
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), *ACCENTS)


def normal(c: Column) -> Column:
    """Folded words separated by single blanks."""
    return F.trim(F.regexp_replace(fold(c), "[^\\p{L}\\p{N}]+", " "))


def words(c: Column) -> Column:
    """The folded words; none of a null or empty text."""
    return F.filter(F.split(F.coalesce(normal(c), F.lit("")), " "), lambda w: w != "")


def compat(c: Column) -> Column:
    """Compatibility characters as plain ones, inside the JVM; combining accents stay."""
    for x, to in SEVERAL.items():
        c = F.replace(c, F.lit(x), F.lit(to))
    return F.translate(c, *COMPATIBLE)


def nfkc(c: Column) -> Column:
    """Unicode's NFKC form, in Arrow batches: the JVM side has no such function, and Arrow's own never composes accents."""

    @F.arrow_udf("string")
    def normalised(texts: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())

    return normalised(c)


def fold_nfkc(c: Column) -> Column:
    """Plain characters in lower case, trimmed; accents stay."""
    return F.trim(F.lower(compat(c)))


def fold_ascii(c: Column) -> Column:
    """Plain Latin letters, digits and ideographs; whatever else stands between becomes one blank."""
    return F.trim(F.regexp_replace(unaccented(c), "[^a-z0-9一-鿿]+", " "))


def unaccented(c: Column) -> Column:
    """Plain characters in lower case without accents, composed or combining."""
    return F.regexp_replace(fold(compat(c)), "[\u0300-\u036f]", "")


def norm_fr(c: Column) -> Column:
    """Words of the French index between single blanks: apostrophes vanish, hyphens and punctuation part words."""
    return F.trim(F.regexp_replace(F.regexp_replace(unaccented(c), f"[{APOSTROPHES}]", ""), "[^\\p{L}\\p{N}_]+", " "))


def squashed(c: Column) -> Column:
    """Letters and digits only, without case and accents."""
    return F.regexp_replace(unaccented(c), "[^\\p{L}\\p{N}_]", "")


def form_norm(c: Column) -> Column:
    """One apostrophe, runs of white space as one blank; case and accents stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(compat(c), f"[{APOSTROPHES}]", "'"), "\\s+", " "))


def clause_tokens(c: Column) -> Column:
    """Tokens by clause: an array of arrays of folded words."""
    return F.transform(F.split(unaccented(c), "[.,;:!?。，；：！？、…()（）]+"), lambda x: F.filter(F.split(F.trim(F.regexp_replace(x, "[^\\p{L}\\p{N}_]+", " ")), " "), lambda w: w != ""))


def holds_tokens(c: Column, needle: str) -> Column:
    """Whether a text holds a needle within a clause: one token inside a token, several one after the other."""
    tokens = [t for t in needle.split(" ") if t]
    if len(tokens) == 1:
        return F.exists(clause_tokens(c), lambda ts: F.exists(ts, lambda t: F.contains(t, F.lit(tokens[0]))))
    return F.exists(clause_tokens(c), lambda ts: F.contains(F.concat(F.lit(" "), F.array_join(ts, " "), F.lit(" ")), F.lit(f" {' '.join(tokens)} ")))


def elision_variants(c: Column) -> Column:
    """Words of a query as the index may hold them: each part beside an apostrophe, and the parts as one word."""
    raw = F.filter(F.split(F.trim(compat(c)), "\\s+"), lambda w: w != "")
    parts = F.flatten(F.transform(raw, lambda w: F.concat(F.split(w, f"[{APOSTROPHES}]"), F.array(F.regexp_replace(w, f"[{APOSTROPHES}]", "")))))
    return F.array_distinct(F.filter(F.transform(parts, norm_fr), lambda w: w != ""))


def roman_number(c: Column) -> Column:
    """The value of a Roman numeral; null of anything else."""
    digits = F.split(F.upper(c), "")
    value = F.create_map(*[x for k, v in ROMAN.items() for x in (F.lit(k), F.lit(v))])
    last = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("next"))
    total = F.aggregate(F.reverse(digits), last, lambda a, d: F.struct((a["sum"] + F.when(value[d] < a["next"], -value[d]).otherwise(value[d])).alias("sum"), value[d].alias("next")))["sum"]
    return F.when(F.upper(c).rlike("^M*(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (F.length(c) > 0), total)


def han_number(c: Column) -> Column:
    """The value of a Chinese numeral up to 99; null of anything else."""
    digit = lambda x: F.instr(F.lit(HAN_DIGITS), x) - 1
    tens = F.when(F.substring(c, 1, 1) == "十", 1).otherwise(digit(F.substring(c, 1, 1)))
    ones = F.when(c.endswith("十"), 0).otherwise(digit(F.substring(c, -1, 1)))
    return F.when(c.rlike("^[一二三四五六七八九]?十[一二三四五六七八九]?$"), tens * 10 + ones).when(c.rlike(f"^[{HAN_DIGITS}]$"), digit(c))


def matheme(c: Column) -> Column:
    """A formula with one sign for each meaning and without white space."""
    return F.regexp_replace(F.translate(c, *GLYPHS), "\\s+", "")


def form_language(c: Column) -> Column:
    """zh, fr (Latin with French letters), und; mul of a mixture."""
    han, latin = c.rlike("\\p{IsHan}"), c.rlike("\\p{IsLatin}")
    return F.when(han & latin, "mul").when(han, "zh").when(c.rlike("[àâäéèêëïîôöùûüÿçœæ]"), "fr").otherwise("und")


def char_ngrams(c: Column, n: int) -> Column:
    """Overlapping sequences of n characters; the text itself if it is shorter."""
    return F.when(F.length(c) <= n, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n))))


def cjk_bigrams(c: Column) -> Column:
    """Overlapping bigrams of each run of Han characters (a run of one is a token), other visible characters one by one."""
    runs = F.regexp_extract_all(F.lower(c), F.lit("([\\p{IsHan}]+|[^\\p{IsHan}\\s])"), F.lit(1))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^\\p{IsHan}"), char_ngrams(r, 2)).otherwise(F.array(r))))


def snippet(c: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


def strip_markup(c: Column) -> Column:
    """Tags and named entities become blanks; runs of white space one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), "&[a-z]+;", " "), "\\s+", " "))


def decode_bytes(c: Column, encodings: tuple[str, ...] = ("utf-8-sig", "gb18030", "big5", "iso-8859-1")) -> Column:
    """Text of bytes by the first encoding that takes them all; a byte order mark is dropped. Arrow batches, as the JVM's decode fails on the first bad byte."""

    @F.pandas_udf("string")
    def decoded(values: pd.Series) -> pd.Series:
        def one(data: bytes | None) -> str | None:
            for e in encodings if data is not None else ():
                try:
                    return data.decode(e)
                except UnicodeDecodeError:
                    continue
            return None

        return values.map(one)

    return decoded(c)


def language(c: Column) -> Column:
    """Language by shares of scripts and French or German letters: zh, ru, el, ar, de, fr, en, und."""
    t = F.lower(F.coalesce(c, F.lit("")))
    n = F.length(t)

    def count(pattern: str) -> Column:
        return n - F.length(F.regexp_replace(t, pattern, ""))

    latin, fr, de = count("[a-zà-öø-ÿœ]"), count("[àâäéèêëïîôöùûüÿçœæ]"), count("[äöüß]")
    return (
        F.when(n == 0, "und")
        .when(count("[一-鿿]") / n > 0.05, "zh")
        .when(count("[Ѐ-ӿ]") / n > 0.1, "ru")
        .when(count("[Ͱ-Ͽ]") / n > 0.1, "el")
        .when(count("[؀-ۿ]") / n > 0.1, "ar")
        .when(latin / n > 0.2, F.when((de >= 3) & (de / latin > 0.004) & (fr / latin < 0.002), "de").when((fr >= 3) & (fr / latin > 0.003), "fr").otherwise("en"))
        .otherwise("und")
    )


def isbn13_valid(c: Column) -> Column:
    """Whether 13 digits end with their check digit."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda s, i: s + F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return F.when(F.length(digits) == 13, total % 10 == 0).otherwise(F.lit(False))


def isbn10_valid(c: Column) -> Column:
    """Whether nine digits and a digit or X end with their check digit."""
    d = F.upper(F.regexp_replace(c, "[^0-9Xx]", ""))
    at = lambda i: F.substring(d, i, F.lit(1))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(10)), F.lit(0), lambda s, i: s + (11 - i) * F.when(at(i) == "X", 10).otherwise(at(i).cast("int")))
    return F.when(d.rlike("^[0-9]{9}[0-9X]$"), total % 11 == 0).otherwise(F.lit(False))


def doi(c: Column) -> Column:
    """A DOI without its resolver's address; null of what is none."""
    bare = F.regexp_replace(F.trim(c), "(?i)^https?://(dx\\.)?doi\\.org/", "")
    return F.when(bare.rlike("^10\\.[0-9]{4,9}/[^\\s]+$"), bare)


def squash(c: Column) -> Column:
    """Lower case without white space, for overlaps."""
    return F.regexp_replace(F.lower(c), "\\s+", "")


def quote_status(text: Column, span: Column) -> Column:
    """exact, normalised (NFKC, runs of white space as one blank, case as it is) or absent: how a text holds a quotation."""
    plain = lambda c: F.trim(F.regexp_replace(nfkc(c), "\\s+", " "))
    return F.when(F.contains(text, span), "exact").when(F.contains(plain(text), plain(span)), "normalised").otherwise("absent")


def overlap_strength(claim: Column, evidence: Column) -> Column:
    """E4 for containment of 8 characters or more, else E3, E2, E1, E0 by the share of the claim's words in the evidence."""
    mine = F.array_distinct(F.filter(words(claim), lambda w: F.length(w) >= 3))
    share = F.size(F.array_intersect(mine, words(evidence))) / F.greatest(F.size(mine), F.lit(1))
    whole = (F.length(claim) >= 8) & F.contains(squash(evidence), squash(claim))
    return F.when(whole, "E4").when(share >= 0.6, "E3").when(share >= 0.3, "E2").when(share > 0, "E1").otherwise("E0")
