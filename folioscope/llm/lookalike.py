"""One consistent form for texts that look the same (problem 4).

Look-alike relations between strings and code points (compatibility forms, composed accents, confusable letters,
blanks, invisible characters) are closed transitively by union-find; each class is represented by its most frequent
member in the corpus, and a multi-pattern automaton rewrites texts greedily, longest member first.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.stages import stage
from folioscope.llm.arrow import code_points, map_batches

# Letters of other scripts that look like Latin ones.
CONFUSABLE = dict(
    zip(
        "АВЕЅЗІЈКМНОРСТУХԌԚԜ" + "авеѕіјкорсухһԁԛԝ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" + "οανρυικχγ" + "ıɑɡ",
        "ABES3IJKMHOPCTYXGQW" + "aвesijкopcyxhdqw" + "ABEZHIKMNOPTYX" + "oavpuiĸxy" + "iag",
    )
)
# Letters of the table above that look like a Latin letter only in a pinch keep their own class.
for _c in "вкγυκΥ":
    CONFUSABLE.pop(_c, None)
CONFUSABLE["Υ"] = "Y"
# CJK radicals and the ideographs they look like (Kangxi radicals come from the compatibility forms).
RADICALS = dict(
    zip(
        "⺁⺄⺅⺆⺈⺉⺋⺎⺏⺐⺒⺓⺔⺕⺖⺘⺙⺛⺝⺞⺠⺡⺢⺣⺤⺥⺦⺨⺩⺪⺬⺭⺮⺯⺰⺱⺲⺶⺹⺺⺼⺽⺾⻁⻂⻃⻄⻅⻆⻈⻉⻋⻌⻏⻐⻑⻒⻓⻔⻖⻘⻙⻚⻛⻜⻝⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲⻳",
        "厂乙亻冂刀刂㔾兀尣尢巳幺彑彐忄扌攵旡月歺民氵氺灬爫爫丬犭王疋示礻竹糹纟罓罒羊耂肀肉臼艹虎衤覀西见角讠贝车辶阝钅長镸长门阝青韦页风飞食饣首马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀龟",
    )
)
#: Least letters and digits of a text that counts.
LEAST = 40
_SEQ = re.compile("[^̀-ͯ\n][̀-ͯ]")
_RUN = re.compile(" {2,}")
_INVISIBLE = re.compile("[\u0000-\u0008\u000e-\u001f\u007f-\u0084\u0086-\u009f­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
_BLANK = re.compile("[^\\S\n]|⠀")


def symbol_counts(texts: DataFrame, column: str) -> dict[str, int]:
    """How often each code point, and each letter with one combining mark, occurs; at most as many as Unicode has."""

    def make():
        def step(b: pa.RecordBatch):
            n: Counter = Counter()
            for t in b.column(0).to_pylist():
                if t:
                    n.update(t)
                    if not t.isascii():
                        n.update(s for s in _SEQ.findall(t) if len(unicodedata.normalize("NFC", s)) == 1)
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["symbol", "n"])

        return step

    counted = map_batches(texts.select(column), "symbol string, n long", make).groupBy("symbol").agg(F.sum("n").alias("n"))
    return {r.symbol: r.n for r in counted.collect()}


def confusables(spark: SparkSession, symbols: set[str]) -> list[tuple[str, str]]:
    """Letters and digits beyond ASCII and the ASCII ones they look like, by Unicode's table of confusable characters.

    The table comes with the session's JVM (its collation library). Two characters with one skeleton look alike; of several
    ASCII ones that share it (l, I and 1) the one of like case or kind is meant. A session that cannot give the table raises:
    without it pairs would be missing, and the rest would look like all of them.
    """
    wanted = sorted(s for s in symbols if len(s) == 1 and not s.isascii() and s.isalnum() and not "⺀" <= s <= "鿿")
    if not wanted:
        return []
    try:
        skeleton = getattr(spark._sc._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build().getSkeleton
    except (AttributeError, TypeError, Py4JError) as e:  # no JVM, or one without the library
        raise RuntimeError("the session's JVM does not give Unicode's table of confusable characters (com.ibm.icu.text.SpoofChecker)") from e
    alike: dict[str, list[str]] = {}
    for c in map(chr, range(33, 127)):
        if c.isalnum():
            alike.setdefault(skeleton(c), []).append(c)
    pairs = []
    for s in wanted:
        kind = lambda c, s=s: (c.isdigit() == s.isdigit(), c.isupper() == s.isupper())
        if found := alike.get(skeleton(s)):
            pairs.append((s, max(found, key=lambda c: (kind(c), c))))
    return pairs


def relations(symbols: set[str]) -> list[tuple[str, str]]:
    """Pairs of strings that look the same, for the symbols of a corpus."""
    pairs = []
    for s in symbols:
        for to in (unicodedata.normalize("NFKC", s), unicodedata.normalize("NFC", s), CONFUSABLE.get(s), RADICALS.get(s)):
            if to is not None and to != s:
                pairs.append((s, " " if to.isspace() and s != "\n" else to))
        if _INVISIBLE.fullmatch(s):
            pairs.append((s, ""))
        elif _BLANK.fullmatch(s):
            pairs.append((s, " "))
        if len(s) == 1 and (base := unicodedata.normalize("NFD", s)) != s and len(base) == 2 and (b := CONFUSABLE.get(base[0])):
            pairs.append((s, unicodedata.normalize("NFC", b + base[1])))
    return pairs


def look_alike_classes(pairs: list[tuple[str, str]], counts: dict[str, int]) -> dict[str, str]:
    """Each string's representative: the most frequent of its transitive class, then the shortest and smallest."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        parent[find(a)] = find(b)
    members: dict[str, list[str]] = {}
    for x in list(parent):
        members.setdefault(find(x), []).append(x)
    out = {}
    for group in members.values():
        # The empty string and the plain blank are on the page wherever their class is.
        best = min(group, key=lambda x: (x != "", x != " ", -counts.get(x, 0), len(x), x))
        out.update((x, best) for x in group if x != best and x)
    return out


def rewriter(classes: dict[str, str]) -> Callable[[str], str]:
    """A function that brings a text to its consistent form."""
    automaton = ahocorasick.Automaton()
    for x, to in classes.items():
        automaton.add_word(x, (len(x), to))
    if classes:
        automaton.make_automaton()
    normal = unicodedata.normalize
    plain = not any(map(str.isascii, classes))  # plain texts hold no member of a class

    def form(text: str) -> str:
        if classes and not (plain and text.isascii()):
            out, at = [], 0
            for end, (n, to) in automaton.iter_long(text):
                out += (text[at : end - n + 1], to)
                at = end + 1
            if at:
                out.append(text[at:])
                text = normal("NFC", "".join(out))
            elif not text.isascii():
                text = normal("NFC", text)
        return _RUN.sub(" ", text) if "  " in text else text

    return form


def corpus_classes(texts: DataFrame, column: str) -> dict[str, str]:
    """The look-alike classes of a corpus; null texts count nothing."""
    counts = symbol_counts(texts, column)
    return look_alike_classes(relations(set(counts)) + confusables(texts.sparkSession, set(counts)), counts)


_ALNUM: np.ndarray | None = None


def alnum_table() -> np.ndarray:
    """True at the code points that are letters or digits."""
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _ALNUM


def count_alnum(texts: list[str]) -> np.ndarray:
    """Letters and digits of each text."""
    points, offsets = code_points(texts)
    total = np.zeros(len(points) + 1, np.int64)
    np.cumsum(alnum_table()[points], out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def consistent(texts: DataFrame, key: str, column: str, out: str = "form") -> DataFrame:
    """key and the consistent form of each text; a null text keeps a null form, an empty one an empty form."""
    classes = corpus_classes(texts, column)

    def make():
        form = rewriter(classes)

        def step(b: pa.RecordBatch):
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else form(t) for t in b.column(1).to_pylist()], pa.string())], ["key", out])

        return step

    kind = dict(texts.dtypes)[key]
    return map_batches(texts.select(key, column), f"key {kind}, `{out}` string", make).withColumnRenamed("key", key)


def prints(texts: DataFrame, key: str, column: str, least: int = LEAST) -> DataFrame:
    """id, form (128-bit print of the consistent form), raw (64-bit one of the text) of every text that counts."""
    classes = corpus_classes(texts, column)

    def make():
        form = rewriter(classes)

        def step(b: pa.RecordBatch):
            rows = [(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None and t and len(t) >= least]
            if not rows:
                return None
            forms = [form(t) for _, t in rows]
            keep = np.flatnonzero(count_alnum(forms) >= least)
            marks = [xxhash.xxh3_128_digest(forms[k].encode("utf-8", "surrogatepass")) for k in keep]
            raw = [xxhash.xxh3_64_intdigest(rows[k][1].encode("utf-8", "surrogatepass")) - (1 << 63) for k in keep]
            return pa.RecordBatch.from_arrays([pa.array([rows[k][0] for k in keep], pa.string()), pa.array(marks, pa.binary()), pa.array(raw, pa.int64())], ["id", "form", "raw"])

        return step

    return map_batches(texts.select(F.col(key).cast("string").alias("id"), column), "id string, form binary, raw long", make)


def disguised(texts: DataFrame, key: str, column: str, least: int = LEAST) -> DataFrame:
    """Stage table id, form, raw of the texts whose form has several different texts, each id once."""
    every = prints(texts, key, column, least)
    varied = every.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo < hi").select("form")
    return stage(every.join(varied, "form", "left_semi").select("id", "form", "raw").distinct(), "disguised")


def look_alike_pairs(texts: DataFrame, key: str, column: str, least: int = LEAST) -> DataFrame:
    """id_a < id_b of texts that differ in code points and agree in the consistent form.

    Null and empty texts and those under `least` letters and digits are in no pair; rows repeated under one key count
    once; exact copies are no pair with each other, but each is one with every disguise. Only 128-bit fingerprints
    are shuffled. The different texts of a form are joined with each other first, and each pair of them with its copies
    then: copies alone are compared with nothing, and every row that comes out is a pair.
    """
    rows = disguised(texts, key, column, least)
    kinds = rows.select("form", "raw").distinct()
    pairs = kinds.withColumnRenamed("raw", "raw_a").join(kinds.withColumnRenamed("raw", "raw_b"), "form").where("raw_a < raw_b")
    both = pairs.join(rows.toDF("a", "form", "raw_a"), ["form", "raw_a"]).join(rows.toDF("b", "form", "raw_b"), ["form", "raw_b"])
    return both.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).where("id_a <> id_b").distinct()


def look_alike_members(texts: DataFrame, key: str, column: str, least: int = LEAST) -> DataFrame:
    """id, class (the form's print), text (the text's own) of all texts that look like a different one: the pairs without n² rows."""
    return disguised(texts, key, column, least).select("id", F.hex("form").alias("class"), F.hex("raw").alias("text"))
