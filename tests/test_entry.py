"""The driver's contract: names, SQL and a library that doesn't need the corpus operators."""

import ast
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry_module
from verdictframe import queries

ROOT = pathlib.Path(entry_module.__file__).parent


def test_entry_runs(spark):
    df = entry_module.entry(spark)
    assert df.columns and df.count() == 6


def test_every_sql_has_its_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries()) and set(queries.SQL) <= set(queries.QUERIES)


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "verdictframe").rglob("*.py"):
        if "llm" not in path.parts:
            names = [n.module or "" if isinstance(n, ast.ImportFrom) else a.name for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names]
            assert not any("llm" in n.split(".") for n in names), path


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_their_sql(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.sql(queries.SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    plain = lambda v: v if v is None or isinstance(v, (bool, int, str)) else round(v, 6) if isinstance(v, float) else str(v)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in df.columns) for r in rel.limit(10**9).fetchall()), key=str)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=str) == want
