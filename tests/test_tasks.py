"""Duplicates, statements, rules, funds, returns, breakdowns and closed accounts on hand-made rows, odd ones included."""

import datetime as dt
from decimal import Decimal as D

import pytest

from talliver.operators import categorise, links, portfolio, spend, tasks

DAY = dt.datetime(2024, 1, 5, 10)


def test_duplicate_groups_by_confidence(spark):
    kind = "txn_id long, account_id long, ts timestamp_ntz, amount decimal(18,2), description string, import_batch_id long"
    rows = [
        (1, 1, DAY, D("5.00"), "parking meter", 1), (2, 1, DAY, D("5.00"), "parking meter", 1),  # one batch, equal texts
        (3, 2, DAY, D("5.00"), "abc", 1), (4, 2, DAY, D("5.00"), "xyz", 1),  # one batch, a coincidence
        (5, 3, DAY, D("5.00"), "abc", 1), (6, 3, DAY, D("5.00"), None, 2),  # two batches, nothing in common
        (7, 4, DAY, D("5.00"), "said no", 1), (8, 4, DAY, D("5.00"), "said no", 2), (9, 5, DAY, D("5.00"), "alone", 1),
        (10, 6, DAY, D("5.00"), "coffee shop", None), (11, 6, DAY, D("5.00"), "coffee shop ", 3), (12, 6, DAY, D("5.00"), "coffee bar", 3),
    ]
    said = spark.createDataFrame([(4, DAY.date(), D("5.00"))], "account_id long, day date, amount decimal(18,2)")
    found = tasks.duplicate_confidence(spark.createDataFrame(rows, kind), said)
    got = {r["account_id"]: (r["n"], r["cross_batch"], r["confidence"]) for r in found.collect()}
    assert set(got) == {1, 3, 6} and got[1] == (2, False, 1.0) and got[3] == (2, True, 0.0) and got[6][:2] == (3, True) and 0.6 < got[6][2] < 1
    assert [r["account_id"] for r in sorted(tasks.ranked_duplicates(found, 2).collect(), key=lambda r: r["place"])] == [6, 3]
    pairs = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.9)], "a long, b long, score double")
    assert [r["a"] for r in tasks.undismissed_pairs(pairs, spark.createDataFrame([(2, 1)], "a long, b long")).collect()] == [3]


def test_statement_differences(spark):
    statements = [(1, "1000.00", "900.00", None), (2, "1000.00", "900.00", "50.00"), (3, "90000.00", "80000.00", None), (4, "5.00", None, None), (5, "5.00", "4.50", None)]
    frame = spark.createDataFrame([(i, D(b), D(p) if p else None, D(x) if x else None) for i, b, p, x in statements], "batch_id long, balance decimal(18,2), previous decimal(18,2), instalment decimal(18,2)")
    rows = spark.createDataFrame([(1, D("-101.00")), (2, D("48.99")), (3, D("10089.99"))], "batch_id long, amount decimal(18,2)")
    got = {r["batch_id"]: (r["moved"], r["expected"], r["matches"]) for r in tasks.statement_differences(frame, rows).collect()}
    assert got == {1: (D("-101.00"), D("100.00"), True), 2: (D("48.99"), D("50.00"), False), 3: (D("10089.99"), D("10000.00"), True), 5: (D("0.00"), D("0.50"), True)}


def test_rules_are_merged_and_patterns_compared_in_lower_case(spark):
    kind = "pattern string, user_id long, category_id long, hits long"
    held = spark.createDataFrame([("uber", 1, 5, 7), ("uber", 1, 4, 2), ("old", 1, 9, 3), (" ", 1, 1, 1)], kind)
    new = spark.createDataFrame([("uber", 1, 6, 2), ("new", 2, 8, 1), ("", 2, 8, 1)], kind)
    assert sorted(map(tuple, tasks.merge_rules(held, new).collect())) == [("new", 2, 8, 1), ("old", 1, 9, 3), ("uber", 1, 6, 9)]
    txns = spark.createDataFrame([(1, "UBER eats", D(0)), (2, "Salary", D(0)), (3, "Salary", D("-1.00")), (4, None, D(1)), (5, "a tax", None)], "txn_id long, description string, amount decimal(18,2)")
    rules = spark.createDataFrame([("Uber ", 1, 6, 1), ("  ", 1, 7, 9)], kind)
    words = spark.createDataFrame([(1, "SALARY", "in", 100), (2, "salary", "out", 101), (3, "ax", "any", 102), (4, "a", "any", 103)], "priority int, keyword string, sign string, category_id long")
    got = {r["txn_id"]: (r["category_id"], r["tier"]) for r in categorise.categorise(txns, rules, words).collect()}
    assert got == {1: (6, "rule"), 2: (100, "keyword"), 3: (101, "keyword"), 4: (None, "none"), 5: (102, "keyword")}


def test_training_pairs_keep_a_limit_of_each_class(spark):
    kind = "txn_id long, account_id long, ts timestamp_ntz, amount decimal(18,2), import_batch_id long"
    ledger = spark.createDataFrame([(i, i // 2, DAY, D("5.00"), i) for i in range(20)], kind)
    deleted = spark.createDataFrame([(100 + i, i, DAY, D("5.00"), 0) for i in range(6)], kind)
    said = spark.createDataFrame([(i, DAY.date(), D("5.00")) for i in range(4, 9)], "account_id long, day date, amount decimal(18,2)")
    whole = links.training_pairs(deleted, ledger, said).collect()
    few = links.training_pairs(deleted, ledger, said, limit=2).collect()
    assert len(whole) == 11 and sorted((r["a"], r["same"]) for r in few) == [(14, False), (16, False), (104, True), (105, True)]


def test_values_of_funds_and_unvested_units(spark):
    prices = spark.createDataFrame([(1, dt.date(2024, 1, 1), D("2.5")), (1, dt.date(2024, 2, 1), D("3.005")), (2, dt.date(2023, 1, 1), D("1"))], "instrument_id long, day date, price decimal(18,6)")
    lots = spark.createDataFrame([(7, 1, D("1")), (7, 2, D("10")), (7, 3, D("5")), (8, 3, D("5"))], "account_id long, instrument_id long, quantity decimal(18,6)")
    assert [tuple(r) for r in portfolio.fund_value(lots, prices).collect()] == [(7, 2, D("13.00"), dt.date(2024, 2, 1))]
    vests = [(7, 1, dt.date(2023, 1, 1), D("4"), None), (7, 1, dt.date(2025, 1, 1), D("4"), None), (7, 1, dt.date(2023, 1, 1), D("9"), D("2")), (9, 3, dt.date(2025, 1, 1), D("4"), None)]
    got = portfolio.unvested_value(spark.createDataFrame(vests, "account_id long, instrument_id long, vest_date date, units decimal(18,6), unvested decimal(18,6)"), prices, "2024-06-01")
    assert sorted((r["account_id"], r["units"], r["value"]) for r in got.collect()) == [(7, D("6"), D("18.03")), (9, D("4"), D("0.00"))]


def test_yearly_returns_and_indexed_values(spark):
    flat = [("flat", dt.date(2024, m, 28), 5.0) for m in range(1, 6)]
    up = [("up", dt.date(2024, m, d), v) for m, v in zip(range(1, 6), (1, 2, 4, 8, 16), strict=True) for d, v in ((1, 99.0), (28, float(v)))]
    odd = [("odd", dt.date(2024, m, 1), v) for m, v in zip(range(1, 6), (1.0, 0.0, 2.0, 3.0, 5.0), strict=True)]
    got = {r["k"]: (r["n"], r["return_pct"], r["volatility_pct"]) for r in portfolio.annual_returns(spark.createDataFrame(flat + up + odd, "k string, day date, v double"), "k", "day", "v").collect()}
    assert got == {"flat": (4, 0.0, 0.0), "up": (4, 409500.0, 0.0)}
    index = spark.createDataFrame([("a", dt.date(2020, 1, 1), 100.0), ("a", dt.date(2022, 1, 1), 0.0), ("a", dt.date(2024, 1, 1), 150.0)], "series string, day date, level double")
    homes = [(1, "a", dt.date(2021, 5, 5), D("200400.00")), (2, "a", dt.date(2019, 1, 1), D("1.00")), (3, "a", dt.date(2023, 1, 1), D("1.00")), (4, "b", dt.date(2023, 1, 1), D("1.00"))]
    found = portfolio.indexed_value(spark.createDataFrame(homes, "property_id long, series string, day date, value decimal(18,2)"), index).collect()
    assert [tuple(r) for r in found] == [(1, 301000.0, 50.0)]


def test_breakdown_takes_what_the_owner_said(spark):
    totals = spark.createDataFrame([("Council Tax", D("-30.00")), ("Fun", D("-60.00")), ("Rent", D("-10.00"))], "category string, total decimal(38,2)")
    said = spark.createDataFrame([("Rent", False), ("Fun", None)], "category string, is_essential boolean")
    got = {(r["part"], r["category"]): (r["total"], r["pct"]) for r in portfolio.essential_breakdown(totals, said, ("tax", "rent")).collect()}
    assert got == {("essential", "Council Tax"): (D("-30.00"), 30.0), ("discretionary", "Fun"): (D("-60.00"), 60.0), ("discretionary", "Rent"): (D("-10.00"), 10.0), ("essential", None): (D("-30.00"), 30.0), ("discretionary", None): (D("-70.00"), 70.0)}
    none = portfolio.essential_breakdown(spark.createDataFrame([("a", D("1.00")), ("b", D("-1.00"))], "category string, total decimal(38,2)"), said, ("tax",)).collect()
    assert {r["pct"] for r in none} == {0.0}


def test_closing_settles_a_balance_only_when_asked(spark):
    rows = [(i, D("5.00"), D("6.00"), dt.date(2024, 1, 1), dt.date(2024, 2, 1), None, None) for i in (1, 2, 3)]
    accounts = spark.createDataFrame(rows, "account_id long, statement_balance decimal(18,2), current_value decimal(18,2), statement_balance_as_of date, payment_due_date date, closed_at date, closed_reason string")
    closing = spark.createDataFrame([(1, dt.date(2024, 3, 1), " paid off ", True), (2, dt.date(2024, 3, 2), "  ", None)], "account_id long, closed_at date, reason string, zero_balance boolean")
    got = {r[0]: tuple(r)[1:] for r in portfolio.close_accounts(accounts, closing).collect()}
    assert got[1] == (D("0.00"), D("0.00"), dt.date(2024, 3, 1), None, dt.date(2024, 3, 1), "paid off")
    assert got[2] == (D("5.00"), D("6.00"), dt.date(2024, 1, 1), None, dt.date(2024, 3, 2), None) and got[3] == rows[2][1:]


def test_filters_by_currency(spark):
    rows = spark.createDataFrame([(1, "EUR"), (2, "USD"), (3, None)], "txn_id long, currency string")
    assert [r["txn_id"] for r in spend.filter_transactions(rows, currency="EUR").collect()] == [1]
    assert pytest.approx(3) == spend.filter_transactions(rows).count()
