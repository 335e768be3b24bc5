"""Hand-made rows with the results worked out by hand."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from talliver.functions import rules, text
from talliver.operators import balances as B
from talliver.operators import fx, ledger_jobs, pairs, schedules

D = dt.date


def test_comparison_key_keeps_references_and_drops_dates(spark):
    df = spark.createDataFrame([("RegularPayment-(Due06/01/2026)",), ("Faster Payment IPB4001744",), ("Rent Jan 2024!",), (None,)], "d string")
    assert [r[0] for r in df.select(text.comparison_key(F.col("d"))).collect()] == ["regularpayment due", "faster payment ipb4001744", "rent", ""]
    assert [r[0] for r in df.select(text.grouping_key(F.col("d"))).collect()] == ["regularpayment due", "faster payment ipb", "rent jan", ""]


def test_cosine_is_clamped(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(text.cosine01(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_card_rows_are_classified_by_their_most_specific_signal(spark):
    rows = [(-5, "coffee"), (-9, "Late fee"), (5, "Refund shop"), (50, "AUTOPAY thank you"), (3, "interest charge reversal"), (4, "interest"), (2, "Plan it"), (1, "shop")]
    df = spark.createDataFrame([(Decimal(a), d) for a, d in rows], "amount decimal(18,2), d string")
    got = df.select(rules.classify_event(F.col("amount"), F.col("d"), F.lit("credit_card"), F.lit(False), F.lit(""))).collect()
    assert [r[0] for r in got] == ["card_purchase", "fee", "merchant_refund", "card_payment_settlement", "merchant_refund", "fee", "card_credit", "merchant_refund"]


def test_nearest_rate_prefers_direct_then_near_then_late(spark):
    rates = spark.createDataFrame([("EUR", "USD", D(2024, 1, 1), 1.0), ("EUR", "USD", D(2024, 1, 11), 2.0), ("USD", "GBP", D(2024, 1, 6), 0.5)], "base_currency string, quote_currency string, rate_date date, rate double")
    df = spark.createDataFrame([(1, "EUR", "USD", D(2024, 1, 6)), (2, "GBP", "USD", D(2024, 1, 6)), (3, "USD", "USD", D(2024, 1, 6)), (4, "EUR", "USD", D(2024, 3, 6))], "i int, b string, q string, day date")
    got = {r["i"]: r["fx_rate"] for r in fx.rate_nearest(df, rates, "b", "q", "day").collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 1.0, 4: None}
    got = {r["i"]: r["fx_rate"] for r in fx.rate_asof(df, rates, "b", "q", "day").collect()}
    assert got == {1: 1.0, 2: 2.0, 3: 1.0, 4: 2.0}


def test_half_even_only_in_the_exact_mode(spark):
    df = spark.createDataFrame([(Decimal("0.05"), 0.5)], "a decimal(18,2), r double")
    assert df.select(fx.convert(F.col("a"), F.col("r"), exact=True)).first()[0] == Decimal("0.02")


def test_closing_row_is_the_one_that_no_row_follows(spark):
    t = [(1, 7, dt.datetime(2024, 1, 1), Decimal(10)), (2, 7, dt.datetime(2024, 1, 2), Decimal(5)), (3, 7, dt.datetime(2024, 1, 2), Decimal(-2)), (4, 7, dt.datetime(2024, 1, 3), Decimal(1))]
    txns = spark.createDataFrame(t, "txn_id int, account_id int, ts timestamp_ntz, amount decimal(18,2)")
    # Row 3 comes first on its day: 10 - 2 = 8, then row 2 closes with 13; row 4 has no balance.
    running = spark.createDataFrame([(1, Decimal(10)), (3, Decimal(8)), (2, Decimal(13)), (4, None)], "txn_id int, balance_after decimal(18,2)")
    dates = spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 9),)], "as_of date")
    got = {r["as_of"]: (r["marker"], r["marker_day"]) for r in B.marker_balance(txns, running, dates).collect()}
    assert got == {D(2024, 1, 2): (Decimal(13), D(2024, 1, 2)), D(2024, 1, 9): (Decimal(14), D(2024, 1, 2))}


def test_series_agrees_with_single_days(spark):
    from talliver.plans.queries import found_balances
    from talliver.sources.views import Ledger

    led = Ledger(spark, "/root/testdata/sf0.001")
    series = B.net_worth(found_balances(led, B.month_ends(spark, "2001-06-30", 3)))
    one = B.net_worth(found_balances(led, spark.createDataFrame([(D(2001, 5, 31),)], "as_of date")))
    assert sorted(series.filter("as_of = '2001-05-31'").collect()) == sorted(one.collect())


def test_month_steps_clamp_to_the_month_end(spark):
    s = spark.createDataFrame([(1, 1, Decimal(-5), "monthly", D(2024, 1, 31)), (2, 1, Decimal(-1), "weekly", D(2024, 2, 20))], "payment_id int, account_id int, amount decimal(18,2), frequency string, next_due date")
    got = sorted((r["payment_id"], r["due"]) for r in schedules.project_schedule(s, "2024-03-31").collect())
    assert [d for p, d in got if p == 1] == [D(2024, 1, 31), D(2024, 2, 29), D(2024, 3, 31)]
    assert [d for p, d in got if p == 2] == [D(2024, 2, 20) + dt.timedelta(7 * i) for i in range(6)]


def test_recurring_stream_is_found_and_a_stale_one_is_not(spark):
    rows = [(1, f"Gym {i}", dt.datetime(2024, 1 + i, 3), Decimal(-20)) for i in range(5)] + [(2, "Old", dt.datetime(2022, 1 + i, 3), Decimal(-20)) for i in range(5)]
    df = spark.createDataFrame(rows, "account_id int, description string, ts timestamp_ntz, amount decimal(18,2)")
    got = schedules.detect_recurring(df, "2024-06-01").collect()
    assert [(r["account_id"], r["stream"], r["frequency"], r["amount_type"], r["confidence"], r["next_due"]) for r in got] == [(1, "gym", "monthly", "fixed", 1.0, D(2024, 6, 3))]


def test_one_to_one_takes_the_best_and_uses_each_row_once(spark):
    p = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 1), (2, 10, 0.85, 1), (2, 11, 0.7, 2)], "a int, b int, score double, gap int")
    assert sorted((r["a"], r["b"]) for r in pairs.one_to_one(p, "a", "b").collect()) == [(1, 10), (2, 11)]


def test_splits_must_sum_within_a_cent(spark):
    t = spark.createDataFrame([(1, Decimal(-10)), (2, Decimal(-10)), (3, Decimal(0))], "txn_id int, amount decimal(18,2)")
    s = spark.createDataFrame([(1, Decimal("-4.00")), (1, Decimal("-5.99")), (2, Decimal("-9.98"))], "txn_id int, amount_native decimal(18,2)")
    assert {r["txn_id"]: r["valid"] for r in ledger_jobs.validate_splits(t, s).collect()} == {1: True, 2: False, 3: True}


def test_amounts_are_parsed(spark):
    df = spark.createDataFrame([("$1,234.50",), ("(20.00)",), ("-3",), ("n/a",)], "s string")
    assert [r[0] for r in df.select(ledger_jobs.parse_amount(F.col("s"))).collect()] == [Decimal("1234.50"), Decimal("-20.00"), Decimal("-3.00"), None]
