"""Fragments of the oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from folioscope.functions.text import ACCENTS, APOSTROPHES, COMPATIBLE, SEVERAL

_FROM, _TO = ACCENTS


class Catalogue:
    """Queries with the SQL that gives the same rows, where there is any."""

    def __init__(self) -> None:
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Callable], Callable]:
        def add(f: Callable) -> Callable:
            self.functions[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def text(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def compat(c: str) -> str:
    for x, to in SEVERAL.items():
        c = f"replace({c}, '{x}', '{to}')"
    return f"translate({c}, {text(COMPATIBLE[0])}, {text(COMPATIBLE[1])})"


def unaccented(c: str) -> str:
    return f"regexp_replace(translate(lower({compat(c)}), '{_FROM}', '{_TO}'), '[\u0300-\u036f]', '', 'g')"


def norm_fr(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({unaccented(c)}, {text(f'[{APOSTROPHES}]')}, '', 'g'), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def grams_zh(c: str) -> str:
    runs = f"regexp_extract_all(lower({c}), '([\\p{{Han}}]+|[^\\p{{Han}}\\s])', 1)"
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN length(r) > 1 THEN list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) ELSE [r] END))"


def normal(c: str) -> str:
    return f"trim(regexp_replace(translate(lower({c}), '{_FROM}', '{_TO}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split(coalesce({normal(c)}, ''), ' '), lambda w: w <> '')"


#: Passages with each id once.
ONCE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at) AS _rn FROM passages) WHERE _rn = 1)"
