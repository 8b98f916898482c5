"""Every registered query against its DuckDB oracle at sf0.001 (rows, names,
types and exact values); the driver runs the same comparison at sf0.01."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))
from oracle_check import SPARK_TO_DUCK, TABLES, key, norm  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()), key=key)
    res = duck.execute(entry.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    types = {d[0]: str(d[1]) for d in res.description}
    for c, t in df.dtypes:
        assert SPARK_TO_DUCK.get(t, t) == types[c], (c, t, types[c])
    idx = sorted(range(len(ocols)), key=lambda i: ocols[i])
    want = sorted((tuple(norm(r[i]) for i in idx) for r in res.fetchall()), key=key)
    assert len(got) == len(want)
    assert got == want
