"""Abusive, hateful or sexual language in documents (problem 10).

Words and word pairs get log-odds of standing in an abusive passage rather than anywhere, with a Dirichlet prior that
is centred on the corpus. A linear scan finds the maximum-scoring segments of each document; extreme-value statistics
turn a score into the number of such segments that chance would give a document of that length. Passages are not
labelled, documents are: the segments that score best in documents labelled abusive become the next round's passages.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import defaultdict
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.stages import drop_stage, stage
from folioscope.llm.arrow import collected, map_batches, mix
from folioscope.llm.lookalike import CONFUSABLE

#: Hashed words and pairs; prior weight in tokens; rounds; score of a sentence break; least score of a passage; log-odds
#: from which a word may be meant by a masked spelling.
SLOTS, PRIOR, ROUNDS, BREAK, LEAST, MARKED = 1 << 18, 200.0, 4, -6.0, 4.0, 2.0
#: Least surprise of a found document: chance gives one in a thousand documents such a segment.
SIGNIFICANT = math.log(1000)
#: Standard errors by which the threshold's F1 may be under the best.
SLACK = 0.25
#: Parts of the labelled documents: each is judged by weights that have not seen it when the threshold is fitted.
FOLDS = 4
#: Share of a single count that is taken off, and of abuse that annotators are expected to call harmless.
DISCOUNT, ERRORS = 0.6, 0.25
#: Weight of what a segment leaves out of its sentences, and the most that may cost: a word is harmless in a harmless
#: sentence, but a long sentence does not excuse a slur.
REST, MOST_REST = 0.5, 12.0
#: Parts of a point that best scores are whole multiples of where laws are fitted: their sums are the same in any number of tasks.
UNIT = 1 << 20
_INV = re.compile("[­​-‏⁠-⁤﻿͏]")
_LOOK = {ord(a): b for a, b in CONFUSABLE.items()}
_LOOKS = re.compile("[" + "".join(CONFUSABLE) + "]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*·]){2,}[^\W\d_](?![^\W_])")
_LEET = {"$": "s", "@": "a", "0": "o", "1": "i", "3": "e", "!": "i", "€": "e", "5": "s", "4": "a", "7": "t"}
_MIXED = re.compile(r"(?<![^\W_])[^\W\d_]+[$@013!€547][$@013!€547\w]*|[$@][^\W\d_]+")
_RUN = re.compile(r"([^\W\d_])\1+")
_STAR_HAN = re.compile(r"(?<=[㐀-鿿])[*＊·.\-_ ]+(?=[㐀-鿿])")
_TOKEN = re.compile(r"[㐀-鿿]|[^\W\d_㐀-鿿]+(?:\*+[^\W\d_㐀-鿿]*)*|\d+|[.!?。！？\n]")
_HAN = re.compile(r"[㐀-鿿]")


def _marks() -> str:
    """A class of all combining characters."""
    points = [c for c in range(0x300, 0x1E900) if unicodedata.combining(chr(c))]
    runs = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return "[" + "".join(f"{chr(r[0])}-{chr(r[-1])}" for r in runs) + "]+"


_MARKS, _LATIN_MARKS = re.compile(_marks()), re.compile("[\u0300-\u036f]+")


def tokens_of(text: str) -> list[str]:
    """Words without disguise: one script, no accents, no stretched, spaced or spelt-round letters; '.' breaks sentences."""
    t = text if text.isascii() else unicodedata.normalize("NFKC", _INV.sub("", text))
    t = t.translate(_LOOK) if _LOOKS.search(t) else t
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", m[0]), t)
    t = _STAR_HAN.sub("", t)
    t = _MIXED.sub(lambda m: "".join(_LEET.get(c, c) for c in m[0][:-1]) + (m[0][-1] if m[0][-1] == "!" else _LEET.get(m[0][-1], m[0][-1])), t)
    t = t.casefold()
    t = t if t.isascii() else _LATIN_MARKS.sub("", unicodedata.normalize("NFKD", t))
    t = t if t.isascii() else _MARKS.sub("", t)
    t = _RUN.sub(r"\1", t)
    return ["." if w in ".!?。！？\n" else "#" if w[0].isdigit() else w for w in _TOKEN.findall(t)]


@lru_cache(1 << 17)
def _slot(w: str) -> int:
    return zlib.crc32(w.encode("utf-8", "surrogatepass")) % SLOTS


@lru_cache(1 << 17)
def _code(w: str) -> int:
    """A token's 32-bit code; its highest bit beyond tells a Chinese character, -1 a break."""
    return -1 if w == "." else zlib.crc32(w.encode("utf-8", "surrogatepass")) | (1 << 32 if _HAN.match(w) else 0)


def slots_of(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each token and of it with the one before; -1 at a break. Chinese characters count as pairs only."""
    code = np.fromiter(map(_code, tokens), np.int64, len(tokens))
    before = np.concatenate([[-1], code[:-1]])
    pair = (mix((before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ code.astype(np.uint64)) % np.uint64(SLOTS)).astype(np.int64)
    one = np.where(code >> 32 > 0, pair, (code & 0xFFFFFFFF) % SLOTS)
    return np.where(code < 0, -1, one).astype(np.int32), np.where(code < 0, -1, pair).astype(np.int32)


@dataclass(frozen=True)
class Weights:
    """Log-odds of words and of pairs; decay and scale of the extreme-value law; least bits that count as found."""

    one: np.ndarray
    two: np.ndarray
    decay: float = 1.0
    scale: float = 0.0
    least: float = 0.0

    def scores(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        s = (self.one[one] + self.two[two]) / 2
        return np.where(one < 0, BREAK, s)

    def surprise(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-ln of the number of segments so good that chance gives a text of n tokens."""
        return self.decay * score - self.scale - np.log(np.maximum(n, 1))


def best_segment(s: np.ndarray) -> tuple[float, int, int]:
    """Score, start and end of the maximum-scoring segment; 0 of nothing if no score is positive."""
    if not len(s):
        return 0.0, 0, 0
    total = np.concatenate([[0.0], np.cumsum(s)])
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    return float(total[end] - total[start]), start, end


def maximal_segments(s: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments in one linear scan (disjoint, none extendable)."""
    # Start, end, totals before and after, and the nearest earlier segment with a lower total before: what lies between
    # the two can never be reached again, so that every segment is passed over once.
    stack: list[tuple[int, int, float, float, int]] = []
    done: list[tuple[float, int, int]] = []
    total = 0.0
    for i, x in enumerate(s.tolist()):
        if x > 0:
            start, left, right, j = i, total, total + x, len(stack) - 1
            while True:
                while j >= 0 and stack[j][2] >= left:
                    j = stack[j][4]
                if j < 0:  # no earlier one is lower: none of them grows any more
                    done += [(r - l, a, b) for a, b, l, r, _ in stack]
                    stack = [(start, i + 1, left, right, -1)]
                    break
                if stack[j][3] >= right:
                    stack.append((start, i + 1, left, right, j))
                    break
                start, _, left, _, below = stack[j]
                del stack[j:]
                j = below
        total += x
    return done + [(r - l, a, b) for a, b, l, r, _ in stack]


def passages_in(s: np.ndarray, breaks: np.ndarray) -> list[tuple[float, int, int]]:
    """Maximal segments with their scores, less what the rest of the sentences they touch says against them."""
    if not len(s) or best_segment(s)[0] < LEAST:
        return []
    total, ends = np.concatenate([[0.0], np.cumsum(np.where(breaks, 0, s))]), np.flatnonzero(breaks)
    out = []
    for score, i, j in maximal_segments(s):
        if score >= LEAST:
            k = np.searchsorted(ends, i)
            first = ends[k - 1] + 1 if k else 0
            k = np.searchsorted(ends, j)
            last = ends[k] if k < len(ends) else len(s)
            rest = total[last] - total[j] + total[i] - total[first]
            out.append((score + REST * max(min(rest, 0.0), -MOST_REST), i, j))
    return out


def _token_table(documents: DataFrame, key: str, column: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Stage table doc_id, words (tokens between blanks), one, two (their slots) and columns carried along, of every document."""

    def make():
        def step(b: pa.RecordBatch):
            words, ones, twos, ends = [], [], [], [0]
            for t in b.column(1).to_pylist():
                tokens = tokens_of(t) if t else []
                one, two = slots_of(tokens)
                words.append(" ".join(tokens))
                ones.append(one)
                twos.append(two)
                ends.append(ends[-1] + len(tokens))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (ones, twos)]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.string()), *lists, *b.columns[2:]], ["doc_id", "words", "one", "two", *carry])

        return step

    kinds = dict(documents.dtypes)
    schema = ", ".join(["doc_id long, words string, one array<int>, two array<int>", *(f"`{c}` {kinds[c]}" for c in carry)])
    return stage(map_batches(documents.select(F.col(key).cast("long").alias("doc_id"), column, *carry), schema, make), "tokens")


def verdicts(labels: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """doc_id, abusive of documents whose labels do not tie; null labels say nothing."""
    votes = labels.where(F.col(label).isin("abusive", "ok")).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.sum(F.when(F.col(label) == "abusive", 1).otherwise(-1)).alias("v"))
    return votes.where("v <> 0").select("doc_id", (F.col("v") > 0).alias("abusive"))


def _counts(rows: DataFrame, weights: list[Weights | None]) -> np.ndarray:
    """Counts of words and pairs per model, verdict and slot, of whole documents or of the models' best segments.

    Model 0 counts every document, model k those outside part k - 1. Its size is fixed: models x 2 x 2 * SLOTS numbers.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(weights)
    shape = (len(weights), 2, 2 * SLOTS)

    def count(batches):
        total = np.zeros(shape)
        for b in batches:
            size = pc.list_value_length(b.column("one")).to_numpy(zero_copy_only=False)
            one, two = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("one", "two"))
            part, bad = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "abusive"))
            at, text = np.concatenate([[0], np.cumsum(size)]), np.repeat(np.arange(len(size)), size)
            for m, w in enumerate(shipped.value):
                keep = (part != m - 1)[text]
                if w is not None:
                    s, keep = w.scores(one, two), np.zeros(len(one), bool)
                    for n in np.flatnonzero(part != m - 1):
                        parts = passages_in(s[at[n] : at[n + 1]], one[at[n] : at[n + 1]] < 0)
                        top = max((x[0] for x in parts), default=0.0)
                        for score, i, j in parts:
                            if score >= max(6.0, top * 0.5):
                                keep[at[n] + i : at[n] + j] = True
                for v in (0, 1):
                    mine = keep & (one >= 0) & (bad == v)[text]
                    total[m, v, :SLOTS] += np.bincount(one[mine], minlength=SLOTS)
                    total[m, v, SLOTS:] += np.bincount(two[mine], minlength=SLOTS)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], ["slot", "n"])

    got = collected(rows.select("part", "abusive", "one", "two").mapInArrow(count, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")))
    shipped.destroy()
    flat = np.zeros(np.prod(shape))
    flat[got["slot"]] = got["n"]
    return flat.reshape(shape)


def _log_odds(inside: np.ndarray, everywhere: np.ndarray, alarms: np.ndarray | None = None) -> np.ndarray:
    """Log-odds with a Dirichlet prior centred on the corpus; what one document alone says is discounted.

    alarms are counts of the best segments of documents labelled harmless: reports, scholarship and the like. What
    mislabelled abuse adds to them is taken off before they count as much as the corpus does.
    """
    p = (everywhere + 0.5) / (everywhere.sum() + 0.5 * len(everywhere))
    q = (np.maximum(inside - DISCOUNT, 0) + PRIOR * p) / (inside.sum() + PRIOR)
    if alarms is not None:
        z = np.maximum(alarms - ERRORS * inside - 1, 0)
        p = (p + (z + PRIOR * p) / (z.sum() + PRIOR)) / 2
    return np.log(q / p).astype(np.float32)


def _maxima(rows: DataFrame, weights: list[Weights]) -> DataFrame:
    """part, abusive, n and the best score of each document by the model that has not seen its part, and by model 0 as part -1."""
    shipped = rows.sparkSession.sparkContext.broadcast(weights)

    def make():
        def step(b: pa.RecordBatch):
            size = pc.list_value_length(b.column("one")).to_numpy(zero_copy_only=False)
            one, two = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("one", "two"))
            parts, at, out = b.column("part").to_numpy(), 0, np.zeros((2, len(size)))
            for k, (n, part) in enumerate(zip(size, parts.tolist())):
                o, t = one[at : at + n], two[at : at + n]
                for m, model in enumerate((part + 1, 0)):
                    out[m, k] = max((x[0] for x in passages_in(shipped.value[model].scores(o, t), o < 0)), default=0.0)
                at += n
            part, abusive = np.concatenate([parts, np.full(len(size), -1)]), pa.concat_arrays([b.column("abusive")] * 2)
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), abusive, pa.array(np.rint(out.ravel() * UNIT) / UNIT), pa.array(np.tile(size, 2), pa.int32())], ["part", "abusive", "score", "n"])

        return step

    return map_batches(rows.select("part", "abusive", "one", "two"), "part int, abusive boolean, score double, n int", make)


def _running(rows: DataFrame, group: str, order: str, counts: list[str]) -> DataFrame:
    """Stage table of each group's different values of order, their counts and, as c_to, those of all values up to them.

    However many rows are equal or in one group, no task holds more than a range of different values: only the ranges'
    totals go into a running sum.
    """
    each = rows.groupBy(group, order).agg(*(F.sum(c).alias(c) for c in counts))
    placed = stage(each.repartitionByRange(group, order).withColumn("_range", F.spark_partition_id()), "ranges")
    up = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(*(F.sum(c).alias(c) for c in counts))
    earlier = totals.select("_g", "_r", *(F.coalesce(F.sum(c).over(up), F.lit(0)).alias(f"_{c}") for c in counts))
    here = Window.partitionBy(group, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(earlier, (F.col(group) == F.col("_g")) & (F.col("_range") == F.col("_r")))
    out = stage(joined.select(group, order, *counts, *((F.sum(c).over(here) + F.col(f"_{c}")).alias(f"{c}_to") for c in counts)), "running")
    drop_stage(placed)
    return out


def _of_part(values: dict[int, float]) -> Column:
    """The value of a row's part."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), F.col("part"))


def _laws(maxima: DataFrame) -> dict[int, tuple[float, float]]:
    """Decay and scale per part of the Gumbel law of the maxima of harmless documents, by moments of their lower part, which mislabelled ones spare.

    All documents count: order statistics come from running counts, and a few numbers per part come to the driver.
    """
    fine = ~F.col("abusive") & (F.col("n") > 0)
    sizes = maxima.groupBy("part").agg(F.count("*").alias("n"), F.count(F.when(fine, 1)).alias("fine")).collect()
    rows = maxima.where(fine | F.col("part").isin([r.part for r in sizes if not r.fine]))
    size = {r.part: r.fine or r.n for r in sizes}
    ran = _running(rows.select("part", "score", F.lit(1).alias("c")), "part", "score", ["c"])
    low = {p: max(1, int(n * 0.9)) for p, n in size.items()}
    taken = F.least("c", F.greatest(_of_part(low) - F.col("c_to") + F.col("c"), F.lit(0))).cast("decimal(18,0)")
    units = (F.col("score") * UNIT).cast("decimal(19,0)")
    moments = ran.groupBy("part").agg(F.sum(taken * units).alias("one"), F.sum(taken * (units * units)).alias("two")).collect()
    spread = {r.part: math.sqrt(low[r.part] * int(r.two) - int(r.one) ** 2) / low[r.part] / UNIT for r in moments}
    decay = {p: float(np.clip(np.pi / np.sqrt(6) / max(x * 1.2, 1e-3), 0.2, 2.0)) for p, x in spread.items()}
    drop_stage(ran)
    level = _of_part(decay) * F.col("score") - F.log(F.greatest("n", F.lit(1)))
    ran = _running(rows.select("part", level.alias("level"), F.lit(1).alias("c")), "part", "level", ["c"])
    # The middle two are at two values, or one value holds both.
    holds = [(F.col("c_to") > m) & (F.col("c_to") - F.col("c") <= m) for m in (_of_part({p: (n - d) // 2 for p, n in size.items()}) for d in (1, 0))]
    middle = ran.where(holds[0] | holds[1]).groupBy("part").agg(F.min("level").alias("a"), F.max("level").alias("b")).collect()
    drop_stage(ran)
    return {r.part: (decay[r.part], (r.a + r.b) / 2 + math.log(math.log(2))) for r in middle}


def _threshold(maxima: DataFrame, laws: dict[int, tuple[float, float]]) -> float:
    """The strictest surprise whose F1 is SLACK standard errors under the best at most, over all labelled documents; equal ones are found together."""
    decay, scale = (_of_part({p: law[k] for p, law in laws.items()}) for k in (0, 1))
    bits = decay * F.col("score") - scale - F.log(F.greatest("n", F.lit(1)))
    ran = _running(maxima.where("part >= 0").select(F.lit(0).alias("all"), (-bits).alias("loss"), F.lit(1).alias("c"), F.col("abusive").cast("int").alias("hit")), "all", "loss", ["c", "hit"])
    hits = ran.agg(F.sum("hit")).first()[0]
    f1 = 2 * F.col("hit_to") / (F.col("c_to") + hits)
    best = ran.agg(F.max(f1)).first()[0]
    error = math.sqrt(best * (1 - best) / max(hits, 1))
    at = ran.where(f1 >= best - SLACK * error).agg(F.min("loss")).first()[0]
    after = ran.where(F.col("loss") > at).agg(F.min("loss")).first()[0]
    drop_stage(ran)
    return -at if after is None else -(at + after) / 2


def fit(tokens: DataFrame, judged: DataFrame) -> Weights | None:
    """Weights learnt from all documents and the labelled ones; None without a document labelled abusive.

    The threshold is the strictest one that is about the best for labelled documents, each scored by weights learnt
    without it: where their number tells little, weaker weights than the final ones would have it too low.
    """
    labelled = stage(tokens.select("doc_id", "one", "two").join(judged, "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "labelled")
    every = _counts(tokens.select("one", "two", F.lit(0).alias("part"), F.lit(False).alias("abusive")), [None])[0, 0]
    split = lambda x: (x[:SLOTS], x[SLOTS:])
    inside = _counts(labelled, [None] * (1 + FOLDS))
    if not inside[0, 1].any():
        return None
    models = [Weights(*(_log_odds(i, e) - np.float32(0.7) for i, e in zip(split(x[1]), split(every)))) for x in inside]
    for _ in range(ROUNDS):
        found = _counts(labelled, models)
        if not found[0, 1].any():
            break
        models = [Weights(*(_log_odds(*y) for y in zip(split(x[1]), split(every), split(x[0])))) if x[1].any() else m for m, x in zip(models, found)]
    maxima = stage(_maxima(labelled, models), "maxima")
    drop_stage(labelled)
    laws = _laws(maxima)
    least = _threshold(maxima, laws)
    drop_stage(maxima)
    decay, scale = laws[-1]
    return replace(models[0], decay=decay, scale=scale, least=max(least, SIGNIFICANT))


def _lexicon(tokens: DataFrame, judged: DataFrame, weights: Weights) -> dict[tuple[str, int], list[str]]:
    """Words of high log-odds in documents labelled abusive, by first letter and length, the most frequent of each slot: SLOTS words at most."""
    shipped = tokens.sparkSession.sparkContext.broadcast(weights.one)

    def make():
        def step(b: pa.RecordBatch):
            words = [w for t in b.column(0).to_pylist() for w in t.split(" ") if len(w) > 3 and "*" not in w and shipped.value[_slot(w)] > MARKED]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(map(_slot, words), pa.int32())], ["w", "slot"])

        return step

    seen = map_batches(tokens.select("doc_id", "words").join(judged.where("abusive"), "doc_id").select("words"), "w string, slot int", make).groupBy("slot", "w").agg(F.count("*").alias("n"))
    best = collected(seen.groupBy("slot").agg(F.max(F.struct("n", "w")).alias("b")).select("b.n", "b.w"))
    out: dict[tuple[str, int], list[str]] = defaultdict(list)
    for _, w in sorted(zip(-best["n"], best["w"])):
        out[w[0], len(w)].append(w)
    return dict(out)


def _unmask(word: str, lexicon: dict[tuple[str, int], list[str]], cache: dict[str, str]) -> str:
    """The most frequent listed word that a spelling with stars may stand for, or itself; a star hides a letter or so."""
    if word not in cache:
        runs = [len(m) for m in re.findall(r"\*+", word)]
        pattern = re.compile(re.sub(r"\*+", lambda m: ".{%d,%d}" % (max(1, len(m[0]) - 1), len(m[0]) + 1), word))
        lengths = range(len(word) - len(runs), len(word) + len(runs) + 1)
        cache[word] = next((w for n in lengths for w in lexicon.get((word[0], n), ()) if pattern.fullmatch(w)), word)
    return cache[word]


def score_documents(documents: DataFrame, labels: DataFrame, key: str = "doc_id", column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, surprise, found, passages (score, first and last token, text) of every document, and columns carried along.

    Null, empty and wordless texts score 0 and are not found; nor is anything without labels. Ties between annotators
    and null labels say nothing; documents repeated under one id are scored each; texts are scanned whole. The hashed
    weights have a fixed size and are shipped to the tasks; a text is taken apart once and scored from its tokens.
    """
    judged = verdicts(labels)
    tokens = _token_table(documents, key, column, carry)
    weights = fit(tokens, judged)
    if weights is None:
        zero = np.zeros(SLOTS, np.float32)
        weights, lexicon = Weights(zero, zero, least=np.inf), {}
    else:
        lexicon = _lexicon(tokens, judged, weights)
    shipped = documents.sparkSession.sparkContext.broadcast((weights, lexicon))
    passage = pa.struct([("score", pa.float64()), ("first", pa.int32()), ("last", pa.int32()), ("text", pa.string())])

    def make():
        w, words = shipped.value
        cache: dict[str, str] = {}

        def step(b: pa.RecordBatch):
            score, bits, found, parts = [], [], [], []
            size = pc.list_value_length(b.column("one")).to_numpy(zero_copy_only=False)
            ones, twos = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("one", "two"))
            at, texts = 0, b.column("words").to_pylist()
            for t, n in zip(texts, size.tolist()):
                one, two = ones[at : at + n], twos[at : at + n]
                at += n
                toks = None
                if "*" in t:
                    toks = [_unmask(x, words, cache) if "*" in x else x for x in t.split(" ")]
                    one, two = slots_of(toks)
                segments = passages_in(w.scores(one, two), one < 0)
                top = max((v for v, _, _ in segments), default=0.0)
                x = float(w.surprise(np.array([top]), np.array([n]))[0]) if top > 0 else 0.0
                hit = top > 0 and x >= w.least
                score.append(round(top, 4))
                bits.append(round(x, 4))
                found.append(bool(hit))
                toks = toks or t.split(" ")
                parts.append([{"score": round(v, 4), "first": i, "last": j - 1, "text": " ".join(toks[i:j])} for v, i, j in segments if w.surprise(np.array([v]), np.array([n]))[0] >= w.least] if hit else [])
            out = [b.column("doc_id"), pa.array(score, pa.float64()), pa.array(bits, pa.float64()), pa.array(found, pa.bool_()), pa.array(parts, pa.list_(passage)), *(b.column(c) for c in carry)]
            return pa.RecordBatch.from_arrays(out, ["doc_id", "score", "surprise", "found", "passages", *carry])

        return step

    kinds = dict(documents.dtypes)
    schema = ", ".join(["doc_id long, score double, surprise double, found boolean, passages array<struct<score: double, first: int, last: int, text: string>>", *(f"`{c}` {kinds[c]}" for c in carry)])
    return map_batches(tokens.select("doc_id", "words", "one", "two", *carry), schema, make)


def rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """Documents, found ones and their rate per value of a column that the scores carry."""
    return scored.groupBy(by).agg(F.count("*").alias("documents"), F.sum(F.col("found").cast("long")).alias("n_found")).withColumn("rate", F.round(F.col("n_found") / F.col("documents"), 6))
