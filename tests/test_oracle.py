"""Every query of the package against its SQL, and every query without SQL for rows."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from vigilark import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose result may be empty at the smallest size.
MAY_BE_EMPTY = {"f1_document_secrets", "k2_expired_leases", "s13_range_reads", "o4_feedback_page"}


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(repr([norm(r[c]) for c in cols]) for r in df.collect())
    assert rows or name in MAY_BE_EMPTY
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    res = duck.sql(sql)
    at = [res.columns.index(c) for c in cols]
    assert sorted(res.columns) == cols
    assert rows == sorted(repr([norm(x[k]) for k in at]) for x in res.fetchall())
