"""Filters, validated filter objects and pages."""

from __future__ import annotations

import base64
import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest page; version of cursors.
MOST_ROWS, VERSION = 50, 1


def equals(filters: dict[str, object]) -> Column:
    """All columns equal their values; no filter is true."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in sorted(filters.items())], F.lit(True))


def validated(filters: dict[str, object], allowed: dict[str, set | None]) -> dict[str, object]:
    """The filters, if every key is allowed and every value is among its allowed ones (None: any); else an error."""
    for k, v in filters.items():
        if k not in allowed:
            raise ValueError(f"unknown filter {k}")
        if allowed[k] is not None and v not in allowed[k]:
            raise ValueError(f"illegal value of {k}: {v!r}")
    return dict(filters)


def clamp(limit: int, most: int = MOST_ROWS) -> int:
    """A page size between 1 and most."""
    return max(1, min(most, int(limit)))


def overlaps(start: str, end: str, lo: int, hi: int) -> Column:
    """Whether [start, end or start] meets [lo, hi]; a null start never does."""
    return (F.col(start) <= hi) & (F.coalesce(F.col(end), F.col(start)) >= lo)


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The next rows in the order of keys beyond `after`; one row more than the limit tells that there are others."""
    if after is not None:
        beyond = F.lit(False)
        for i in range(len(keys)):
            same = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in zip(keys[:i], after)], F.lit(True))
            beyond = beyond | (same & (F.col(keys[i]) > F.lit(after[i])))
        df = df.where(beyond)
    return df.orderBy(*keys).limit(limit + 1)


def budgeted(limit: int, most: int, left: int) -> int:
    """A page size that what is left of a budget allows; 0 when nothing is left."""
    return min(clamp(limit, most), max(0, left))


def _mark(filters: dict) -> str:
    return hashlib.sha256(json.dumps(filters, sort_keys=True).encode()).hexdigest()[:16]


def cursor(filters: dict, last: tuple, kind: str = "keyset") -> str:
    """An opaque cursor bound to its filters, its kind and its version."""
    return base64.urlsafe_b64encode(json.dumps({"v": VERSION, "t": kind, "f": _mark(filters), "k": list(last)}).encode()).decode()


def resume(token: str, filters: dict, kind: str = "keyset") -> tuple:
    """The position of a cursor; an error if it is none, of another version or kind, or belongs to other filters."""
    try:
        data = json.loads(base64.urlsafe_b64decode(token))
        position = tuple(data["k"])
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("no cursor") from e
    if (data.get("v"), data.get("t")) != (VERSION, kind):
        raise ValueError("the cursor is of another version or kind")
    if data.get("f") != _mark(filters):
        raise ValueError("the cursor belongs to other filters")
    return position


def offset_page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset+1 to offset+limit of a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def in_pool(df: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Only rows whose key is in the pool; joined before any ranking."""
    return df.join(pool.select(key).distinct(), key, "left_semi")
