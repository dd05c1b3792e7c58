"""Every core query against its oracle SQL on the smallest tables; the core does without its subpackage for texts."""

from __future__ import annotations

import glob
import importlib.util
import os
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parent.parent
FOLDER = entry.SMOKE
spec = importlib.util.spec_from_file_location("oracle", ROOT / "tools" / "oracle.py")
oracle = importlib.util.module_from_spec(spec)
spec.loader.exec_module(oracle)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted({k for m in entry.CORE for k in m.queries()}))
def test_oracle(spark, con, name):
    f, sql = {k: x for m in entry.CORE for k, x in m.queries().items()}[name], {k: x for m in entry.CORE for k, x in m.oracle_sql().items()}.get(name)
    said = oracle.compare(spark, con, FOLDER, name, f, sql)
    assert ": ok" in said, said


def test_core_does_without_llm():
    for p in (ROOT / "folioscope").rglob("*.py"):
        if "llm" not in p.parts:
            assert "folioscope.llm" not in p.read_text(), p


def test_entry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
