"""The driver contract: registered names, SQL for known names only, and DuckDB's agreement."""

import os

import pytest

import __spark_entry__ as entry_module
from tessera import queries as engine

FOLDER = "/root/testdata/sf0.01"


def test_sql_names_are_queries():
    known, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(known) and set(engine.QUERIES) <= set(known)


def test_engine_imports_nothing_of_the_text_operators():
    root = os.path.dirname(engine.__file__)
    for folder, _, names in os.walk(root):
        if os.path.relpath(folder, root).split(os.sep)[0] != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert "tessera.llm" not in f.read()


def _rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="synthetic tables are absent")
@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_engine_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{FOLDER}/embeddings.parquet'")
    got, want = engine.QUERIES[name](spark, FOLDER).toPandas(), con.execute(engine.ORACLE_SQL[name]).df()
    assert len(got) and _rows(got) == _rows(want)
