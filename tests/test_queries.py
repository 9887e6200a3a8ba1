"""Every registered graph query against its SQL on DuckDB, and the driver's contract."""

import importlib
import os
import re
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from skein.plans.oracles import ORACLES
from skein.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert set(QUERIES) == set(ORACLES)


def test_the_rest_imports_without_the_llm_folders(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("skein.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "skein.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    try:
        assert set(alone.queries()) == set(QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_nothing_else_imports_llm():
    top = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(top, "skein")):
        if "llm" in folder.split(os.sep):
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as source:
                    assert not re.search(r"\bllm\b|corpus_pipeline", source.read()), f
