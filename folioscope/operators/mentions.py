"""Names of a checked list in texts: word-bounded Latin names, Chinese ones anywhere, found by automata in one pass."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import words

#: Names a list may hold to be kept in every task.
MOST_NAMES = 1_000_000


def apart(c: Column) -> Column:
    """Folded words; a run of ideographs is a word of its own."""
    return words(F.regexp_replace(c, "(\\p{IsHan}+)", " $1 "))


def forms_of(names: DataFrame) -> DataFrame:
    """id, han, form (blanks around Latin words, none in Chinese) of id, alias."""
    han = F.col("alias").rlike("\\p{IsHan}")
    form = F.when(han, F.array_join(apart(F.col("alias")), "")).otherwise(F.concat(F.lit(" "), F.array_join(apart(F.col("alias")), " "), F.lit(" ")))
    return names.select("id", han.alias("han"), form.alias("form")).where("trim(form) <> ''").distinct()


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """key, id, alias: one row per text and entity named in it, with the longest of its names there (the first of equal ones).

    names has id, alias; it is checked to hold MOST_NAMES at most and kept in every task. Null texts name nothing.
    """
    rows = forms_of(names).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    shipped = texts.sparkSession.sparkContext.broadcast(sorted((r.id, r.han, r.form) for r in rows))
    kind = dict(texts.dtypes)[key]

    def run(batches):
        machines = {}
        for han in (False, True):
            owners: dict[str, list[str]] = {}
            for i, h, form in shipped.value:
                if h == han:
                    owners.setdefault(form, []).append(i)
            machines[han] = ahocorasick.Automaton()
            for form, ids in owners.items():
                machines[han].add_word(form, (form.strip(), ids))
            if owners:
                machines[han].make_automaton()
        for b in batches:
            at, ids, names = [], [], []
            for k, (padded, packed) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                best: dict[str, str] = {}
                for t, machine in ((padded, machines[False]), (packed, machines[True])):
                    if t and len(machine):
                        for _, (form, owners) in machine.iter(t):
                            for i in owners:
                                old = best.get(i)
                                if old is None or (-len(form), form) < (-len(old), old):
                                    best[i] = form
                at += [k] * len(best)
                ids += best.keys()
                names += best.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.string()), pa.array(names, pa.string())], [key, "id", "alias"])

    ws = texts.where(F.col(text).isNotNull()).select(key, apart(F.col(text)).alias("ws"))
    return ws.select(key, F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" ")), F.array_join("ws", "")).mapInArrow(run, f"`{key}` {kind}, id string, alias string")
