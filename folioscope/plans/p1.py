"""Queries of problem 1: references to records that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators.references import orphan_references, orphan_report
from folioscope.sources.tables import table

#: Referencing table, field, record key and the table referred to.
REFERENCES = [
    ("passages", "session_id", "id", "sessions"),
    ("passages", "seminar_id", "id", "seminars"),
    ("passage_source_map", "witness_id", "passage_id", "witnesses"),
]


def found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference without a live parent."""
    return reduce(DataFrame.unionByName, [orphan_references(table(spark, d, t), table(spark, d, p), tbl=t, field=f, record=r) for t, f, r, p in REFERENCES])


def report(spark: SparkSession, d: str) -> DataFrame:
    """Cases per table, field, kind and month."""
    return orphan_report(found(spark, d))


def queries() -> dict:
    return {"p1_found": found, "p1_report": report}


_FOUND = " UNION ALL ".join(
    f"""SELECT '{t}' AS tbl, r.record_id, '{f}' AS field,
       CASE WHEN p.id IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' ELSE 'late' END AS kind,
       strftime(r.loaded, '%Y-%m') AS period
FROM (SELECT {r} AS record_id, {f} AS k, min(loaded_at) AS loaded FROM {t} WHERE {f} IS NOT NULL GROUP BY 1, 2) r
LEFT JOIN (SELECT id, min(loaded_at) AS first_loaded, max(CASE WHEN deleted_at IS NOT NULL THEN 1 ELSE 0 END) = 1 AS gone
           FROM {p} WHERE id IS NOT NULL GROUP BY id) p ON p.id = r.k
WHERE p.id IS NULL OR p.gone OR p.first_loaded > r.loaded"""
    for t, f, r, p in REFERENCES
)


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _FOUND, "p1_report": f"SELECT tbl, field, kind, period, count(*) AS n FROM ({_FOUND}) GROUP BY ALL"}
