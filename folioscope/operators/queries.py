"""Typed queries brought to index terms, on the driver: a query is a few words, whatever the corpus."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice, product

from folioscope.functions.text import ACCENTS, APOSTROPHES

#: Words of a phrase by language, terms of an unordered query, combinations of other names.
PHRASE_WORDS, MOST_TERMS, MOST_COMBINATIONS = {"fr": 12, "zh": 24}, 6, 48
_PLAIN = str.maketrans(*ACCENTS)
_RUNS = re.compile("[㐀-鿿豈-﫿]+|[^㐀-鿿豈-﫿\\s]")


def norm_fr(s: str) -> str:
    """As the French index holds words: see functions.text.norm_fr."""
    s = unicodedata.normalize("NFKC", s).lower().translate(_PLAIN)
    s = "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))
    return re.sub(r"[^\w]+", " ", re.sub(f"[{APOSTROPHES}]", "", s)).strip()


def elisions(s: str) -> list[str]:
    """The forms of each word beside and across its apostrophes, each once."""
    out = []
    for raw in unicodedata.normalize("NFKC", s).split():
        out += [*re.split(f"[{APOSTROPHES}]", raw), re.sub(f"[{APOSTROPHES}]", "", raw)]
    return list(dict.fromkeys(t for w in out if (t := norm_fr(w))))


def bigrams(s: str) -> list[str]:
    """Pairs of ideographs of each run, other characters one by one: see functions.text.cjk_bigrams."""
    return [g for r in _RUNS.findall(s.lower()) for g in ([r[i : i + 2] for i in range(len(r) - 1)] if len(r) > 1 else [r])]


def tokens(lang: str, s: str) -> list[str]:
    return bigrams(s) if lang == "zh" else norm_fr(s).split()


def wanted_of(query: str, lang: str, typed: str) -> list[tuple]:
    """Rows (query, part, tier, term, ord) of a query from tight to loose: 1 the phrase, 2 all its terms."""
    phrase = tokens(lang, typed)[: PHRASE_WORDS[lang]]
    if lang == "zh":
        words = [w for w in re.split("[\\s，。！？、；：,.!?;:]+", typed) if w][:4]
        loose = [g for w in words for g in bigrams(w)] if len(words) > 1 else []
    else:
        loose = [t for t in elisions(typed) if len(t) >= 2][:MOST_TERMS]
    return [(query, lang, tier, t, i) for tier, ts in ((1, phrase), (2, loose)) for i, t in enumerate(ts)]


def terms_of(query: str, lang: str, tier: int, items: list[str]) -> list[tuple]:
    """Rows of a query that wants every token of its items."""
    return [(query, lang, tier, t, i) for i, t in enumerate(t for item in items for t in tokens(lang, item) if lang == "zh" or len(t) > 1)]


def alias_combinations(items: list[str], others: dict[str, list[str]]) -> Iterator[list[str]]:
    """The items as they stand, then with other names in their places, MOST_COMBINATIONS at most."""
    return (list(c) for c in islice(product(*[[i, *others.get(i, [])] for i in items]), MOST_COMBINATIONS))
