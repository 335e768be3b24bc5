"""Recurring streams over all accounts and rows: sf0.01, where some are found, and hand-made rows."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from talliver.functions.text import grouping_key
from talliver.operators import schedules
from talliver.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.mark.parametrize("name", ["w2_detect_recurring_all", "j21_new_suggestions_all"])
def test_streams_of_all_accounts(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = QUERIES[name](spark, DIR)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall())
    # Real accounts and keys: weekly rhythms, and accounts that a fold into 100 would lose.
    assert any(r[0] >= 100 or r[0] <= -100 for r in rows) and {r[got.columns.index("frequency")] for r in rows} == {"weekly"}


def test_suggestions_leave_out_what_is_scheduled(spark):
    rows = [(a, dt.datetime(2024, 1, 1) + dt.timedelta(7 * i), f"{d} {i}", 5.0) for a, d in ((7, "Rent"), (707, "Rent"), (707, "Gym")) for i in range(5)]
    found = schedules.detect_recurring(spark.createDataFrame(rows, "account_id long, ts timestamp_ntz, description string, amount double"), "2024-02-05")
    held = spark.createDataFrame([(707, "RENT #12"), (7, "Gym")], "account_id long, description string")
    got = schedules.new_suggestions(found, held.select("account_id", grouping_key(F.col("description")).alias("stream")))
    assert sorted((r["account_id"], r["stream"], r["frequency"]) for r in got.collect()) == [(7, "rent", "weekly"), (707, "gym", "weekly")]
