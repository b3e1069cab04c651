"""Every registered query against its SQL twin on the smoke tables (DuckDB)."""
import hashlib
import math

import duckdb
import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _digest(pdf):
    cols = sorted(pdf.columns)
    rows = sorted(repr(tuple(_norm(r[c]) for c in cols)) for r in pdf.to_dict("records"))
    return cols, len(rows), hashlib.sha256("\n".join(rows).encode()).hexdigest()


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_matches_sql(spark, con, key):
    got = E.queries()[key](spark, SMOKE).toPandas()
    want = con.execute(E.oracle_sql()[key]).df()
    assert _digest(got) == _digest(want)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["item_id", "rank", "doc_id", "n_matches", "similarity_value", "total_percent"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
