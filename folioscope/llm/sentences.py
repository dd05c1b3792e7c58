"""Sentence boundaries by a hidden-event n-gram language model (problem 6).

Between words the model may insert a boundary token. What stands before a gap, its marks and what follows are scored
under both events, words backing off to their shapes; events of one line are chained by the length since the last
boundary. Parameters start from certain events (line starts, and what follows commas) and are re-estimated by
expectation-maximisation over all texts; forward-backward posteriors decide. In Chinese texts whose marks end no
sentence, blanks are gaps too. A line break always ends a sentence.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.stages import stage
from folioscope.llm.arrow import collected, map_batches
from folioscope.llm.lookalike import CONFUSABLE

#: Hashed words, shapes, mark classes and length classes of the model: its size does not grow with the corpus.
WORDS, SHAPES, MARKS, LENGTHS = 1 << 17, 64, 1 << 12, 8
#: Rounds of estimation, and how many occurrences the back-off to a shape weighs.
ROUNDS, BACK_OFF = 6, 2.0
#: What follows a comma stands for a continued sentence by this weight at first and a quarter of it in each further
#: round: clauses begin like sentences.
COMMA_WEIGHT, LEAST_WEIGHT = 0.25, 0.02
#: Largest overall log odds that a word's are compared with.
MOST_ODDS = 1.0
#: Prior log odds against a boundary where the words around tell that the sentence goes on; the posteriors decide.
DOUBT = 6.0
# Verbs that report what a closed quotation said.
REPORTING = ("喊道", "说道", "问道", "答道", "写道", "叫道", "回答", "喊", "说", "问", "答", "道", "dit", "demand", "répond", "cri", "écri", "murmur", "not", "ajout", "lanc")
_INVIS = "\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u034f\u061c\u180e"
_GAP = re.compile(rf"[.!?。！？…‥．｡](?:(?:[^\S\n]|[{_INVIS}])*[.!?。！？…‥．｡])*(?:(?:[^\S\n]|[{_INVIS}])*[»”’」』）)\]】》]|[{_INVIS}]*\")*")
_BLANKS = re.compile(rf"(?:[^\S\n]|[{_INVIS}])*")
_ZH_BLANK = re.compile(rf"(?:[{_INVIS}]*[^\S\n])+[{_INVIS}]*")
_TRAIL = re.compile(rf"(?:\s|[{_INVIS}])+\Z")
_INV = re.compile(f"[{_INVIS}]")
_ODD = re.compile("[^\\x00-\u00ac\u00ae-\u00ffœŒ‐-‧‹›一-鿿\u3000-〟！（），：；？]|[\u0300-\u036f]")
_NEXT = re.compile(r"[一-鿿⺀-⿟]{1,2}|[^\W_]+|.", re.S)
_WORDS = re.compile(r"[^\W_]+")
_CERTAIN = re.compile(r"[,;:，；：、]\s*([一-鿿⺀-⿟]{1,2}|[^\W_]+|.)(.{0,2})", re.S)
_LOOK = {ord(a): b for a, b in CONFUSABLE.items()}
#: Marks that may end a Chinese sentence; other marks of a Chinese text end none by themselves.
_FULL = set("。！？!?｡")
_NEVER_NEXT = set(",;:，；：、—–-)）]】》」』”’»")


def _plain(s: str) -> str:
    return s if s.isascii() else unicodedata.normalize("NFKC", _INV.sub("", s).translate(_LOOK))


def _tidy(s: str) -> str:
    """_plain for words: what holds no letter in disguise stays as it is, punctuation included."""
    return _plain(s) if _ODD.search(s) else s


@lru_cache(1 << 16)
def _slot(kind: str, word: str) -> int:
    return zlib.crc32((kind + word).encode("utf-8", "surrogatepass")) % WORDS


@lru_cache(1 << 16)
def _shape(w: str) -> int:
    """Script, case and length class of a word."""
    if not w:
        return 0
    c = w[0]
    if c.isdigit():
        return 1 if w.isdigit() else 2
    if "㐀" <= c <= "鿿":
        return 3
    if c.isalpha():
        mixed = any(map(str.isdigit, w))
        return 10 + 8 * mixed + 4 * c.isupper() + min(len(w), 4) - 1
    return 4 + (c in "«“‘「『（([《【") + 2 * (c in "—–-")


def _left(line: str, at: int) -> tuple[str, int]:
    part = _tidy(line[max(0, at - 30) : at])
    words = list(_WORDS.finditer(part))
    if not words:
        return "", 0
    word = words[-1][0]
    if "㐀" <= word[-1] <= "鿿":
        return word[-2:], 3
    if len(word) == 1 or word[-1].isdigit():  # initials and numbers mean what the word before them says
        before = words[-2][0].lower() if len(words) > 1 and "." not in part[words[-2].end() : words[-1].start()] else "."
        return f"{before}_{'#' if word[-1].isdigit() else word}", _shape(word[-1])
    return word if len(word) > 1 and word.isupper() else word.lower(), _shape(word)


def _right(line: str, at: int, zh: bool) -> tuple[str, int]:
    part = _tidy(line[at : at + 36 if zh else at + 16]).lstrip()
    m = _NEXT.match(part)
    if not m:
        return "", 0
    w = m[0]
    if zh and w[0].isalpha() and w[0] < "\u0250":  # a name says less than what comes after it
        return "X" + part[m.end() : m.end() + 2], _shape(w)
    return ("#" if w[0].isdigit() else w), _shape(w)


@lru_cache(1 << 16)
def _continued(word: str, tail: str, zh: bool) -> int:
    w, s = _right(word + tail, 0, zh)
    return _slot("zr" if zh else "fr", w) * SHAPES + s


@lru_cache(1 << 14)
def _mark(lang: str, marks: str, blank: bool) -> int:
    return zlib.crc32(f"{lang}{marks}{'_' if blank else ''}".encode()) % MARKS


#: A gap: its end, kind, mark class, word and shape before, word and shape after. Kind 0 is an open gap after a mark, 2 one
#: at a blank, 3 one after which words tell that the sentence goes on, 1 a line end and 4 a line end after a full mark.
Gap = tuple[int, int, int, int, int, int, int]


def gaps_of(text: str, zh: bool) -> tuple[list[Gap], list[int], list[int]]:
    """The gaps of a text, and (word slot * SHAPES + shape) of what certainly begins and certainly continues a sentence."""
    gaps: list[Gap] = []
    begins: list[int] = []
    continues: list[int] = []
    at, lang = 0, "z" if zh else "f"
    before, after = lang + "l", lang + "r"
    for line in text.split("\n"):
        stop = len(line)
        if t := _TRAIL.search(line):
            stop = t.start()
        if stop:
            body = line[:stop]
            w, s = _right(body, 0, zh)
            begins.append(_slot(after, w) * SHAPES + s)
            continues += [_continued(w, tail if zh else "", zh) for w, tail in _CERTAIN.findall(body)]
            marked: set[int] = set()
            for m in _GAP.finditer(body):
                end = m.end()
                if end >= stop:
                    break
                taken = _BLANKS.match(body, end).end()
                marks = m[0] if len(m[0]) == 1 else _plain(m[0]).replace(" ", "")
                w, s = _right(body, taken, zh)
                l, ls = _left(body, m.start())
                goes_on = (
                    "n" if w[:1] in _NEVER_NEXT
                    else "p" if zh and not _FULL.intersection(m[0]) and "…" not in marks and marks[:1] == "."
                    else "i" if marks == "." and len(l) == 3 and l[:2] == "._" and l[2].isupper()  # an initial
                    else "r" if marks[-1] in "»”’」』\"" and marks[0] not in ".。" and w.removeprefix("X").startswith(REPORTING)
                    else ""
                )
                gaps.append((at + end, 3 if goes_on else 0, _mark(lang, marks, taken > end), _slot(before, l), ls, _slot(after, w), s))
                marked.add(end)
            if zh and " " in body or "\u3000" in body:
                for m in _ZH_BLANK.finditer(body):
                    if zh and m.start() and m.end() < stop and not any(x in marked for x in range(m.start() - 2, m.end() + 1)):
                        w, s = _right(body, m.end(), zh)
                        l, ls = _left(body, m.start())
                        gaps.append((at + m.start(), 2, _mark("z", "blank", False), _slot(before, l), ls, _slot(after, w), s))
            gaps.append((at + stop, 4 if not _FULL.isdisjoint(body[-4:]) else 1, 0, 0, 0, 0, 0))
        at += len(line) + 1
    if zh:
        gaps.sort()
    return gaps, begins, continues


@dataclass(frozen=True)
class Model:
    """Expected counts, row 0 without and row 1 with a boundary."""

    left: np.ndarray
    left_shape: np.ndarray
    right: np.ndarray
    right_shape: np.ndarray
    mark: np.ndarray
    length: np.ndarray  # by the event before and the length class

    @staticmethod
    def empty() -> Model:
        return Model(*(np.zeros((2, n), np.float32) for n in (WORDS, SHAPES, WORDS, SHAPES, MARKS, 2 * LENGTHS)))

    @staticmethod
    def _ratio(words: np.ndarray, shapes: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Log odds of a boundary given a word, backing off to its shape, against the overall odds."""
        total = shapes.sum(1) + 1.0
        q = (shapes[1, s] + 0.5 * total[1] / total.sum()) / (shapes[:, s].sum(0) + 0.5)
        n, b = words[0, w] + BACK_OFF * (1 - q), words[1, w] + BACK_OFF * q
        # Where one event hardly occurs at all, its overall odds say more about the smoothing than about the word.
        return np.log(b + 1e-2) - np.log(n + 1e-2) - np.clip(np.log(total[1] / total[0]), -MOST_ODDS, MOST_ODDS)

    def emission(self, mark, left, left_shape, right, right_shape) -> np.ndarray:
        """Log odds of a boundary at each gap, its neighbours left aside."""
        out = self._ratio(self.right, self.right_shape, right, right_shape)
        if self.mark.sum() > 0:
            total = self.mark.sum(1) + 1.0
            out = out + np.log(self.mark[1, mark] + BACK_OFF * total[1] / total.sum()) - np.log(self.mark[0, mark] + BACK_OFF * total[0] / total.sum())
            out = out + self._ratio(self.left, self.left_shape, left, left_shape)
        return np.clip(out, -30, 30)

    def chain(self) -> np.ndarray:
        """Log odds by the event before and the length class, against the overall odds."""
        if not self.length.sum():
            return np.zeros((2, LENGTHS))
        total = self.length.sum(1) + 1.0
        odds = np.log(self.length[1] + 5 * total[1] / total.sum()) - np.log(self.length[0] + 5 * total[0] / total.sum()) - np.log(total[1] / total[0])
        return np.clip(odds, -4, 4).reshape(2, LENGTHS)


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(n, 1)).astype(int), 0, LENGTHS - 1)


def posteriors(model: Model, size: np.ndarray, end: np.ndarray, kind: np.ndarray, mark, left, left_shape, right, right_shape) -> tuple[np.ndarray, np.ndarray]:
    """Boundary posterior of every gap by forward-backward over each text's gaps, and the length class of each gap."""
    n, most = len(size), int(size.max(initial=0))
    text = np.repeat(np.arange(n), size)
    col = np.arange(len(end)) - np.repeat(np.cumsum(size) - size, size)
    e = model.emission(mark, left, left_shape, right, right_shape)
    e = np.where((kind == 1) | (kind == 4), 40.0, np.where(kind == 3, e - DOUBT, e))
    before = np.where(col == 0, 0, np.concatenate([[0], end[:-1]]))
    cls = _length_class(end - before)
    # Blanks are gaps only in texts none of whose marks ends a sentence.
    punctuated = np.bincount(text, ((kind == 4) | ((kind == 0) & (e > 0))).astype(float), n)[text] > 0
    e = np.where((kind == 2) & punctuated, -40.0, e)
    t = model.chain()
    odds = [np.clip(e + t[p][cls], -50, 50) for p in (0, 1)]  # of a boundary, by the event before
    # Step k handles the k-th gap of every text that has one, longest texts first: no text is padded to another's length.
    order = np.argsort(-size, kind="stable")
    first, alive = (np.cumsum(size) - size)[order], np.searchsorted(-size[order], -np.arange(most), "left")
    forward, backward = np.empty((2, len(end))), np.empty((2, len(end)))
    f0, f1 = np.full(n, -1e9), np.zeros(n)  # a text starts after a boundary
    for k, m in enumerate(alive):
        i, p0, p1 = first[:m] + k, f0[:m], f1[:m]
        f0, f1 = np.logaddexp(p0, p1), np.logaddexp(p0 + odds[0][i], p1 + odds[1][i])
        forward[0, i], forward[1, i] = f0, f1
    g0, g1 = np.zeros(n), np.zeros(n)
    for k in range(most - 1, -1, -1):
        m = alive[k]
        i = first[:m] + k
        p0, p1 = g0[:m].copy(), g1[:m].copy()
        backward[0, i], backward[1, i] = p0, p1
        g0[:m], g1[:m] = np.logaddexp(p0, p1 + odds[0][i]), np.logaddexp(p0, p1 + odds[1][i])
    joint = forward + backward
    return np.exp(joint[1] - np.logaddexp(joint[0], joint[1])), cls


_LISTS = ("end", "kind", "mark", "left", "left_shape", "right", "right_shape", "begins", "continues")
_SCHEMA = "id string, " + ", ".join(f"`{c}` array<int>" for c in _LISTS)


def gap_table(texts: DataFrame, key: str, column: str, language: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Stage table of one row per text with the lists of its gaps' features, and string columns to carry along."""

    def make():
        def step(b: pa.RecordBatch):
            ids, rows = [], []
            for n, (i, t, lang) in enumerate(zip(*(c.to_pylist() for c in b.columns[:3]))):
                if i is None or not t:
                    continue
                han = lang == "zh" if lang in ("fr", "zh") else sum("㐀" <= c <= "鿿" for c in t) * 4 > len(t)
                g, begins, continues = gaps_of(t, han)
                if g:
                    ids.append(n)
                    rows.append((*zip(*g), begins, continues))
            if not ids:
                return None
            kept = [b.column(k).take(pa.array(ids)) for k in (0, *range(3, 3 + len(carry)))]
            return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.list_(pa.int32())) for c in zip(*rows))], ["id", *carry, *_LISTS])

        return step

    schema = _SCHEMA.replace("id string", ", ".join(f"`{c}` string" for c in ("id", *carry)), 1)
    return stage(map_batches(texts.select(F.col(key).cast("string"), column, language, *carry), schema, make), "gaps")


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    size = pc.list_value_length(b.column("end")).to_numpy(zero_copy_only=False)
    cols = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in _LISTS if c in b.schema.names]
    return size, cols[:7], *(cols[7:] or (None, None))


def estimate(gaps: DataFrame, rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over all texts. Only the fixed number of hashed slots comes to the driver."""
    model = Model.empty()
    sizes = [2 * n for n in (WORDS, SHAPES, WORDS, SHAPES, MARKS, 2 * LENGTHS)]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for k in range(rounds + 1):
        shipped = gaps.sparkSession.sparkContext.broadcast(model)

        def count(batches, k=k, shipped=shipped):
            total = np.zeros(starts[-1])
            for b in batches:
                size, (end, kind, mark, left, left_shape, right, right_shape), begins, continues = _flat(b)
                for event, certain in ((1, begins), (0, continues)):
                    total[starts[2] + event * WORDS :][:WORDS] += (1.0 if event else COMMA_WEIGHT * max(0.25**k, LEAST_WEIGHT)) * np.bincount(certain // SHAPES, minlength=WORDS)
                    total[starts[3] + event * SHAPES :][:SHAPES] += (1.0 if event else COMMA_WEIGHT * max(0.25**k, LEAST_WEIGHT)) * np.bincount(certain % SHAPES, minlength=SHAPES)
                if k == 0:
                    continue
                post, cls = posteriors(shipped.value, size, end, kind, mark, left, left_shape, right, right_shape)
                first = np.cumsum(size) - size
                before = np.concatenate([[1.0], post[:-1]])
                before[first[size > 0]] = 1.0
                open_ = (kind == 0) | (kind == 3) | ((kind == 2) & (post > 1e-9))
                for event, w in ((1, post), (0, 1 - post)):
                    w = w[open_]
                    for at, n, values in ((0, WORDS, left), (1, SHAPES, left_shape), (2, WORDS, right), (3, SHAPES, right_shape), (4, MARKS, mark)):
                        total[starts[at] + event * n :][:n] += np.bincount(values[open_], w, n)
                    for p in (0, 1):
                        total[starts[5] + event * 2 * LENGTHS + p * LENGTHS :][:LENGTHS] += np.bincount(cls[open_], w * np.abs(1 - p - before[open_]), LENGTHS)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "n"])

        got = collected(gaps.select(*_LISTS).mapInArrow(count, "slot int, n double").groupBy("slot").agg(F.sum("n").alias("n")))
        shipped.destroy()
        flat = np.zeros(starts[-1], np.float32)
        flat[got["slot"]] = got["n"]
        model = Model(*(flat[a:b].reshape(2, -1) for a, b in zip(starts, starts[1:])))
    return model


def decide(gaps: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """id, end_char of the gaps whose boundary posterior is at least `least`."""
    shipped = gaps.sparkSession.sparkContext.broadcast(model)

    def make():
        def step(b: pa.RecordBatch):
            size, (end, *rest), _, _ = _flat(b)
            post, _ = posteriors(shipped.value, size, end, *rest)
            keep = np.flatnonzero(post >= least)
            owner = np.repeat(np.arange(len(size)), size)[keep]
            return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(owner)), pa.array(end[keep], pa.int32())], ["id", "end_char"])

        return step

    return map_batches(gaps, "id string, end_char int", make)


def sentence_ends(texts: DataFrame, key: str = "id", column: str = "raw_text", language: str = "language") -> DataFrame:
    """id, end_char of every sentence: the position, in code points from 1, of its last character.

    Null keys and texts, empty texts and mere blanks have no sentence; a text without a mark is one. A key's repeated
    deliveries count once. A null or unknown language goes by the script. Texts are read whole, of any length; an
    empty table gives no rows.
    """
    gaps = gap_table(texts, key, column, language)
    return decide(gaps, estimate(gaps)).distinct()
