"""Every query that has SQL gives what DuckDB gives, on the smallest tables; without the text package too."""

import glob
import importlib
import os
import sys
from collections import Counter

import duckdb
import pytest

from ruleframe.queries import core, stepruns, steps

DATA = "/root/testdata/sf0.001"
QUERIES = core.QUERIES | steps.QUERIES | stepruns.QUERIES
ORACLE = core.ORACLE | steps.ORACLE | stepruns.ORACLE


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(round(float(v), 4) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in (r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", [*core.ORACLE, *steps.ORACLE, *stepruns.ORACLE])
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


def test_entry_without_text_package(monkeypatch):
    monkeypatch.syspath_prepend(os.path.dirname(os.path.dirname(__file__)))
    for m in [m for m in sys.modules if m.startswith("ruleframe.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "ruleframe.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "p1_found" in entry.queries() and "p2_found" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
