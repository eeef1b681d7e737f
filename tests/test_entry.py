"""The registered queries against their SQL, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from placewright import queries as library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    return "" if v is None else repr(round(float(v), 9)) if isinstance(v, float) else str([plain(x) for x in v]) if isinstance(v, (list, tuple)) or hasattr(v, "tolist") else str(v)


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["id1", "id2", "shared", "jaccard", "status"]


def test_registries_agree():
    assert set(library.ORACLE) <= set(library.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(library.ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = library.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = con.sql(library.ORACLE[name]).df()
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(plain(v if v == v else None) if isinstance(v, float) else plain(v) for v in r) for r in want[columns].astype(object).where(want[columns].notna(), None).itertuples(index=False))
