"""Every query with SQL, against an independent engine at the smallest scale."""

import math
import os

import duckdb
import pytest

from loomtable.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def cell(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(cell(r[c]) for c in names) for r in df.collect())
    cursor = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    want = sorted(tuple(cell(dict(zip(columns, r, strict=True))[c]) for c in names) for r in cursor.fetchall())
    assert got == want


def test_entry_has_unique_names():
    import __spark_entry__

    assert set(ORACLE_SQL) <= set(__spark_entry__.oracle_sql()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
