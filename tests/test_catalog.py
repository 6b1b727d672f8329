"""Every registered query of this package against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tesselle.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    r = c.execute(catalog.ORACLE_SQL[name])
    columns = [x[0] for x in r.description]
    want = sorted(tuple(plain(row[columns.index(k)]) for k in sorted(columns)) for row in r.fetchall())
    df = catalog.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(plain(row[k]) for k in sorted(columns)) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5000 and set(catalog.QUERIES) <= set(entry.queries())
