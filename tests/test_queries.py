"""Every registered query against the same tables in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, sf_dir, oracle, name):
    frame = contract.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)
    assert rows
    if name not in contract.oracle_sql():
        return
    result = oracle.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert rows == sorted((tuple(r[i] for i in places) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_no_row_at_a_time_python(spark, sf_dir):
    for name in ("scoreboard", "clean_answers", "chunk_words", "dedup_exact", "embed_hash", "timing_pairs", "resolve_attempts"):
        plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan
