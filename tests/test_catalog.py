"""Every registered query against its SQL twin."""

import duckdb
import pytest
from conftest import DATA

from tidemill.plans.catalog import QUERIES
from tidemill.plans.oracle import SQL


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for t in ("part", "customer", "orders", "lineitem", "events", "documents", "pages"):
        made.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return made


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DATA)
    want = db.execute(SQL[name])
    names = sorted(got.columns)
    assert names == sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(n) for n in names]
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str)
    b = sorted((tuple(plain(r[k]) for k in order) for r in want.fetchall()), key=str)
    assert a == b
