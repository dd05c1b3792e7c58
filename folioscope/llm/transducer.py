"""Encoding with a public byte-level BPE tokenizer by a streaming transducer (problem 8).

The transducer reads bytes from left to right. Of every prefix it keeps one token: the last one of that prefix's
encoding, which is the only token that ends there and is compatible with the last token of the shorter prefix. A
further token can reach back no more than the longest token's bytes: that is the sufficient lookahead. What all
prefixes within it have in common can no longer change and is emitted at once, so memory stays constant.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.arrow import map_batches

#: Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
# Fixed value: the pattern that splits text before the merges; white space is Unicode's.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Cached words and pairs of a task.
CACHE = 1 << 16


@dataclass(frozen=True)
class Merges:
    """Token bytes by id (in merge order) and the two parts of each merged token (itself for single bytes)."""

    tokens: tuple[bytes, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]

    @property
    def lookahead(self) -> int:
        """Bytes after which a token boundary is settled: no token reaches further back."""
        return max(map(len, self.tokens))


@lru_cache(4)
def load_merges(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Merges:
    """Reads a rank file; the parts of a token are what the earlier merges leave of its bytes."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    tokens = [b""] * (max(ranks.values()) + 1)
    left, right = list(range(len(tokens))), list(range(len(tokens)))
    for t, i in ranks.items():
        tokens[i] = t
        if len(t) > 1:
            left[i], right[i] = _parts(t, i, ranks)
    return Merges(tuple(tokens), tuple(left), tuple(right))


def _parts(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class Transducer:
    """Encodes byte strings of any length with memory bounded by the lookahead."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pairs = {(a, b): i for i, (a, b) in enumerate(zip(merges.left, merges.right)) if len(merges.tokens[i]) > 1}
        self.ends = ahocorasick.Automaton()
        for i, t in enumerate(merges.tokens):
            if t:
                self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.whole = {t: i for i, t in enumerate(merges.tokens)}
        self.reach = merges.lookahead
        self.compatible = lru_cache(CACHE)(self._compatible)
        self.word = lru_cache(CACHE)(lambda w: tuple(self.encode_bytes(w)))

    def _compatible(self, a: int, b: int) -> bool:
        """Whether b may follow a: no merge across their boundary comes before those that made the two."""
        left, right = self.merges.left, self.merges.right
        before = len(left)
        while True:
            if self.pairs.get((a, b), before) < before:
                return False
            # The younger of the two is taken apart; of equals the right one, which was merged after the left.
            if a > b and right[a] != a or right[b] == b and left[b] == b and right[a] != a:
                before, a = a, right[a]
            elif left[b] != b:
                before, b = b + 1, left[b]
            else:
                return True

    def encode_bytes(self, data: bytes) -> Iterator[int]:
        """Token ids of a byte string, each as soon as it is stable."""
        if (one := self.whole.get(data)) is not None:
            yield one
            return
        last: dict[int, tuple[int, int]] = {}  # end of a prefix -> its last token and where that starts
        start, end, seen = 0, 0, -1
        found: list[tuple[int, int]] = []

        def settle(at: int) -> None:
            for token, n in sorted(found, key=lambda x: -x[1]):
                begin = at - n
                if begin == start and (start == 0 or self.compatible(settled, token)) or begin in last and self.compatible(last[begin][0], token):
                    last[at] = (token, begin)
                    return

        settled = -1
        for at, match in self.ends.iter(data.decode("latin-1")):
            if at != seen and found:
                settle(seen + 1)
                found = []
                if len(last) > 4 * self.reach:
                    ready = self._stable(last, start, seen + 1)
                    for token, n in ready:
                        yield token
                        settled, start = token, n
                    if ready:
                        last = {e: x for e, x in last.items() if e > start}
            seen = at
            found.append(match)
        if found:
            settle(seen + 1)
        end, out = len(data), []
        while end > start:
            token, end = last[end]
            out.append(token)
        yield from reversed(out)

    def _stable(self, last: dict[int, tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
        """(token, end) of the tokens that every prefix within reach begins with."""
        common: list[tuple[int, int]] | None = None
        for at in range(end - self.reach, end + 1):
            if at in last:
                chain, e = [], at
                while e > start:
                    token, begin = last[e]
                    chain.append((token, e))
                    e = begin
                chain.reverse()
                if common is None:
                    common = chain
                else:
                    k = next((i for i, (x, y) in enumerate(zip(common, chain)) if x != y), min(len(common), len(chain)))
                    common = common[:k]
        return common or []

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty ones."""
        out: list[int] = []
        for m in _split().finditer(text or ""):
            w = m[0]
            out += self.word(w.encode()) if len(w) < 256 else self.encode_bytes(w.encode())
        return out


@lru_cache(1)
def _split():
    return regex.compile(SPLIT)


@lru_cache(2)
def transducer(merges: Merges) -> Transducer:
    """A worker's transducer, kept between tasks."""
    return Transducer(merges)


def decode(ids: Iterable[int], merges: Merges) -> str:
    """Text of ids, byte by byte through an incremental UTF-8 state machine; broken sequences become U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    return "".join([machine.decode(merges.tokens[i]) for i in ids] + [machine.decode(b"", True)])


_SHIPPED: dict[str, Merges] = {}


def _shipped(name: str, data) -> Merges:
    if name not in _SHIPPED:
        _SHIPPED[name] = Merges(*data.value)
    return _SHIPPED[name]


def _ship(df: DataFrame, name: str, folder: str):
    m = load_merges(name, folder)  # a vocabulary file: its size does not depend on the data
    return df.sparkSession.sparkContext.broadcast((m.tokens, m.left, m.right))


def encode_corpus(df: DataFrame, key: str, column: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, carry: tuple[str, ...] = ()) -> DataFrame:
    """key and ids (array<int>) of every row, without special tokens, and columns carried along.

    Null and empty texts have an empty list; null keys and repeated rows stay as they are; texts of any length are
    encoded whole; an empty table stays empty; other columns are not read. One narrow pass, no shuffle.
    """
    data = _ship(df, name, folder)

    def make():
        t = transducer(_shipped(name, data))

        def step(b: pa.RecordBatch):
            ids = [t.encode(x) for x in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), *b.columns[2:]], ["key", "ids", *carry])

        return step

    return map_batches(df.select(key, column, *carry), _schema(df, key, "ids array<int>", carry), make).withColumnRenamed("key", key)


def _schema(df: DataFrame, key: str, results: str, carry: tuple[str, ...]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([f"key {kinds[key]}", results, *(f"`{c}` {kinds[c]}" for c in carry)])


def round_trip(df: DataFrame, key: str, column: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, carry: tuple[str, ...] = ()) -> DataFrame:
    """key, n_tokens and whether the decoded ids give the text back (null counts as empty), and columns carried along."""
    data = _ship(df, name, folder)

    def make():
        m = _shipped(name, data)
        t = transducer(m)

        def step(b: pa.RecordBatch):
            texts = b.column(1).to_pylist()
            ids = [t.encode(x) for x in texts]
            same = [decode(i, m) == (x or "") for i, x in zip(ids, texts)]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([len(i) for i in ids], np.int32)), pa.array(same, pa.bool_()), *b.columns[2:]], ["key", "n_tokens", "same", *carry])

        return step

    return map_batches(df.select(key, column, *carry), _schema(df, key, "n_tokens int, same boolean", carry), make).withColumnRenamed("key", key)


def token_totals(df: DataFrame, by: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """Documents, tokens and round trips per group; every row counts, whatever its key."""
    return round_trip(df, key, column, carry=(by,)).groupBy(by).agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"), F.sum(F.col("same").cast("long")).alias("restored"))
