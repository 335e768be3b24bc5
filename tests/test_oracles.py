"""Every ledger query against its SQL, on the smallest tables."""

import duckdb
import pytest

from talliver.plans import closing, filing, folding, matching, papers, reporting  # noqa: F401
from talliver.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(str(tuple(row[names.index(c)] for c in cols)) for row in result.fetchall())
    assert sorted(names) == cols
    assert got == want
