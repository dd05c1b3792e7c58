"""Orphan references against brute force, with every awkward case."""

from __future__ import annotations

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from folioscope.operators.references import code_keys, contiguous_runs, matched_runs, orphan_references

T0 = datetime(2024, 1, 31, 12)
RECORDS = "id string, session_id string, loaded_at timestamp, key string, kind int, code double"
PARENTS = "id string, loaded_at timestamp, deleted_at timestamp, key string, is_parent int"


def brute(records, parents):
    first, gone = {}, {}
    for i, at, deleted, *_ in parents:
        if i is not None:
            first[i] = min([x for x in (first.get(i), at) if x is not None], default=None)
            gone[i] = gone.get(i, False) or deleted is not None
    loads = {}
    for r, s, at, *_ in records:
        if s is not None:
            loads.setdefault((r, s), []).append(at)
    out = []
    for (r, s), ats in loads.items():
        at = min([x for x in ats if x is not None], default=None)
        kind = "missing" if s not in first else "deleted" if gone[s] else "late" if at and first[s] and first[s] > at else None
        if kind:
            out.append((r, kind, at.strftime("%Y-%m") if at else None))
    return sorted(out, key=str)


def run(spark, records, parents):
    rows = orphan_references(spark.createDataFrame(records, RECORDS), spark.createDataFrame(parents, PARENTS), tbl="t", field="session_id", record="id")
    assert rows.columns == ["tbl", "record_id", "field", "kind", "period"]
    got = [(r.record_id, r.kind, r.period) for r in rows.collect()]
    return sorted(got, key=str)


def test_cases(spark):
    day = timedelta(days=1)
    parents = [("a", T0, None, "x", 1), ("a", T0 + day, None, None, None), ("b", T0, T0 + day, None, None), ("c", T0 + day, None, None, None), (None, T0, None, None, None), ("e", None, None, None, None), ("z", T0, None, None, None)]
    records = [
        ("1", "a", T0, "k", 1, 0.5), ("1", "a", T0, "k", 1, 0.5), ("2", "b", T0, None, None, None), ("3", "c", T0, None, None, None), ("3", "c", T0 + 9 * day, None, None, None), ("4", "", T0, None, None, None), ("5", None, T0, None, None, None),
        ("6", "zz" * 50_000, T0 + 2 * day, None, None, None), ("7", "c", T0 + day, None, None, None), ("8", "e", T0, None, None, None), (None, "q", None, None, None, None), ("9", "0", T0, None, None, None),
    ]
    got = run(spark, records, parents)
    assert got == brute(records, parents)
    assert ("4", "missing", "2024-01") in got and not any(r == "5" for r, *_ in got)


def test_empty_tables(spark):
    assert run(spark, [], [("a", T0, None, None, None)]) == []
    assert run(spark, [("1", "a", T0, None, None, None)], []) == [("1", "missing", "2024-01")]


def test_runs_are_contiguous(spark):
    parents = spark.createDataFrame([(f"k{i:03d}", T0 + timedelta(hours=i == 55), i // 20 == 1) for i in range(100) if i % 10], "key string, first_loaded timestamp, deleted boolean")
    refs = spark.createDataFrame([(f"k{i:03d}", T0) for i in range(100)], "key string, loaded timestamp")
    codes = code_keys(parents, refs)
    kinds = {r.key: r.kind for r in matched_runs(codes).collect()}
    assert {k for k, v in kinds.items() if v == "missing"} == {f"k{i:03d}" for i in range(0, 100, 10)}
    assert {k for k, v in kinds.items() if v == "deleted"} == {f"k{i:03d}" for i in range(20, 40) if i % 10}
    assert "k055" in {k for k, v in kinds.items() if v is None} and len(kinds) < 50
    assert sum(r.run_end - r.run_start + 1 for r in contiguous_runs(codes).collect()) == 90



KEYS = st.sampled_from([None, "", "a", "b", "c", "é", "zz"])
DAYS = st.one_of(st.none(), st.integers(0, 40).map(lambda d: T0 + timedelta(days=d)))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(KEYS, KEYS, DAYS), max_size=25), st.lists(st.tuples(KEYS, DAYS, DAYS), max_size=12))
def test_any_tables(spark, records, parents):
    records = [(*r, None, None, None) for r in records]
    parents = [(*p, None, None) for p in parents]
    assert run(spark, records, parents) == brute(records, parents)
