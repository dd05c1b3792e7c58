"""Mapping free-entered values to a canonical list (problem 3).

A multi-pattern automaton over canonical names and aliases finds names embedded in a value; the longest
non-overlapping match wins. What remains goes to token-set similarity: each token stands for the listed words nearest
to it, and the entity all of whose words are there with the fewest changes is meant.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrow import map_batches
from folioscope.llm.lookalike import corpus_classes, rewriter

#: Names a list may hold to be kept in every task; a longer list is no list of entities.
MOST_NAMES = 1_000_000
#: Most changed characters of a token: none under 3 characters, one under 6, two above.
ONE_FROM, TWO_FROM = 3, 6
#: Shortest beginning that may stand for a word that was cut off.
CUT_FROM = 3
_CAMEL = re.compile(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Ý])")
_WORD = re.compile(r"[^\W_]+")
_HAN = re.compile(r"[㐀-鿿]+|[^㐀-鿿]+")


def fold(text: str) -> list[str]:
    """Words of a text without case and accents; Chinese runs are words of their own."""
    text = _CAMEL.sub(" ", text).casefold()
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return [p for w in _WORD.findall(text) for p in _HAN.findall(w)]


def stem(word: str) -> str:
    """A word without the endings of number and gender."""
    if not word.isascii():
        return word
    short = word.rstrip("esx")
    short = short if len(short) >= ONE_FROM else word
    return short[:-1] if len(short) > ONE_FROM and short[-1] == short[-2] else short


def changes(a: str, b: str, most: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that turn a into b; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        earlier, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, earlier[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _shortened(word: str, most: int) -> set[str]:
    out = now = {word}
    for _ in range(most):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        out = out | now
    return out


class Nearest:
    """Words within two changes of a given one, found by their shortened forms."""

    def __init__(self, words: Iterable[str]):
        self.words = set(words)
        self.short: dict[str, list[str]] = defaultdict(list)
        for w in self.words:
            for s in _shortened(w, self.most(w)):
                self.short[s].append(w)

    @staticmethod
    def most(word: str) -> int:
        return 0 if len(word) < ONE_FROM else 1 if len(word) < TWO_FROM else 2

    def __call__(self, word: str) -> tuple[int, set[str]]:
        """The least number of changes and the words at it."""
        if word in self.words:
            return 0, {word}
        most = self.most(word)
        near = {w for s in _shortened(word, most) for w in self.short.get(s, ())}
        scored = [(changes(word, w, most), w) for w in near]
        least = min((d for d, _ in scored), default=most + 1)
        return least, {w for d, w in scored if d == least and d <= most}


class Resolver:
    """Entity ids of values. names: (entity id, name); only_in_context: folded names that decide nothing alone."""

    def __init__(self, names: Iterable[tuple[str, str]], only_in_context: Iterable[str] = ()):
        weak = {"".join(fold(x)) for x in only_in_context}
        owners: dict[str, set[str]] = defaultdict(set)
        self.sets: dict[frozenset[str], set[str]] = defaultdict(set)
        self.surface: dict[str, str] = {}
        orders: dict[str, set[str]] = defaultdict(set)
        for entity, name in names:
            words = fold(name)
            packed = "".join(words)
            if not packed or packed in weak:
                continue
            owners[packed].add(entity)
            if len(words) > 1:
                orders[packed].add(entity)
                orders["".join(reversed(words))].add(entity)
                self.sets[frozenset(map(stem, words))].add(entity)
                self.surface.update((w, stem(w)) for w in words)
        self.owners, self.orders = dict(owners), dict(orders)
        self.by_word: dict[str, list[frozenset[str]]] = defaultdict(list)
        for s in self.sets:
            for w in s:
                self.by_word[w].append(s)
        self.automaton = ahocorasick.Automaton()
        for packed in owners:
            self.automaton.add_word(packed, packed)
        if owners:
            self.automaton.make_automaton()
        self.near, self.packed = Nearest(self.surface), Nearest(orders)
        self.sorted = sorted(self.surface)
        self.resolve = lru_cache(1 << 16)(self._resolve)

    def _resolve(self, words: tuple[str, ...]) -> str:
        if not words or not self.owners:
            return ""
        packed, starts, at = "".join(words), set(), 0
        for w in words:
            starts.add(at)
            at += len(w)
        matches = []
        for end, name in self.automaton.iter_long(packed):
            # A name of few letters must begin where a word does, or it is part of another one.
            begin = end - len(name) + 1
            if begin in starts or len(name) >= 2 * TWO_FROM or not name.isascii():
                matches.append(name)
        if matches:
            longest = max(map(len, matches))
            best = set().union(*(self.owners[m] for m in matches if len(m) == longest))
            return best.pop() if len(best) == 1 else ""
        return self._by_tokens(words)

    def _begun(self, start: str) -> Iterator[str]:
        """The listed words that begin so and go on."""
        for k in range(bisect_right(self.sorted, start), len(self.sorted)):
            if not self.sorted[k].startswith(start):
                return
            yield self.sorted[k]

    def _by_tokens(self, words: tuple[str, ...]) -> str:
        readings: list[list[tuple[int, str]]] = []
        for i, w in enumerate(words):
            d, near = (0, {w}) if stem(w) in self.by_word else self.near(w)
            found = [(d, stem(x)) for x in near]
            if d and CUT_FROM <= len(w) and (i == len(words) - 1 or not near):
                found += [(1, self.surface[x]) for x in self._begun(w)]
            readings.append(found)
        score: dict[str, int] = {}
        at_word: dict[str, tuple[int, int]] = {}
        for i, found in enumerate(readings):
            for d, x in found:
                if x not in at_word or d < at_word[x][0]:
                    at_word[x] = (d, i)
        for x in at_word:
            for s in self.by_word[x]:
                if all(y in at_word for y in s) and len({at_word[y][1] for y in s}) == len(s):
                    total = sum(at_word[y][0] for y in s)
                    for e in self.sets[s]:
                        score[e] = min(score.get(e, total), total)
        if score:
            least = min(score.values())
            best = [e for e, d in score.items() if d == least]
            return best[0] if len(best) == 1 else ""
        if sum(bool(found) for found in readings) > 1:
            return ""  # listed words, but not together
        for part in {"".join(words), *("".join(words[i:]) for i in range(1, min(len(words), 5)))}:
            _, near = self.packed(part) if len(part) >= TWO_FROM else (0, set())
            best = set().union(*(self.orders[p] for p in near)) if near else set()
            if len(best) == 1:
                return best.pop()
        return ""


def list_names(spec: DataFrame) -> tuple[list[tuple[str, str]], list[str]]:
    """(entity id, name) of the list's canonical names, other names and aliases, and those that need context."""
    rows = spec.select("id", "canonical_name", "fr", "en", "zh", "aliases", "context_required_aliases").where("id is not null").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the list has more than {MOST_NAMES} entities")
    names = {(r.id, x) for r in rows for x in (r.canonical_name, r.fr, r.en, r.zh, *(r.aliases or ())) if x and x.strip()}
    return sorted(names), sorted({x for r in rows for x in r.context_required_aliases or () if x and x.strip()})


def map_values(entries: DataFrame, spec: DataFrame, key: str = "entry_id", value: str = "entered", carry: tuple[str, ...] = ()) -> DataFrame:
    """entry_id, entity_id of every row, and columns carried along; '' where no entity is meant, and for null and blank values.

    Two entities equally near are no decision (''). Names shared by two entities decide nothing, nor do aliases that
    need context; an empty list maps everything to ''. Repeated rows are mapped alike; the list is checked to be small
    and kept in every task, so that the values are mapped in one narrow pass.
    """
    names, weak = list_names(spec)
    listed = spec.sparkSession.createDataFrame([(n,) for _, n in names] or [(None,)], "v string")
    classes = corpus_classes(entries.select(F.col(value).alias("v")).unionByName(listed), "v")

    def make():
        form = rewriter(classes)
        resolver = Resolver([(e, form(n)) for e, n in names], map(form, weak))

        def step(b: pa.RecordBatch):
            out = [resolver.resolve(tuple(fold(form(t)))) if t else "" for t in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), *b.columns[2:]], ["entry_id", "entity_id", *carry])

        return step

    kinds = dict(entries.dtypes)
    carried = [F.col(c).alias(f"_{c}") for c in carry]  # a value may be carried, too
    return map_batches(entries.select(key, value, *carried), ", ".join([f"entry_id {kinds[key]}, entity_id string", *(f"`{c}` {kinds[c]}" for c in carry)]), make)


def unmatched_report(mapped: DataFrame, value: str = "entered") -> DataFrame:
    """Values without an entity and how often they were entered; mapped carries the values."""
    return mapped.where("entity_id = ''").groupBy(value).agg(F.count("*").alias("n"))
