import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from loanscope.plans.oracle import SQL
from loanscope.plans.registry import QUERIES

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
CHECKED = sorted(set(SQL) & set(QUERIES))


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 7
    assert df.columns == ["grade", "interest_actually_collected", "unrecovered_principal_loss", "realized_margin"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(QUERIES) == set(SQL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF001)
    got = sorted(tuple(_norm(r[c]) for c in sdf.columns) for r in sdf.collect())
    cur = duck.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(sdf.columns)
    idx = [cols.index(c) for c in sdf.columns]
    want = sorted(tuple(_norm(r[i]) for i in idx) for r in cur.fetchall())
    assert got == want
