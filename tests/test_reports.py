"""Report rules on rows that the tables don't hold."""

from datetime import date
from decimal import Decimal

from talliver.operators import balances, reports, settle


def test_group_members_by_treatment_and_fee(spark):
    groups = spark.createDataFrame([(1, "USD", "none", True, Decimal("0.01"), date(2024, 1, 1)), (2, "USD", "member_rates", False, Decimal("0.01"), date(2024, 1, 1)), (3, "USD", "none", False, Decimal("0.01"), date(2024, 1, 1))], "group_id long, base_currency string, fx_treatment string, excludes_fees boolean, tolerance decimal(18,2), as_of date")
    rows = [(1, "USD", Decimal("10.00"), None, False), (1, "USD", Decimal("-10.00"), None, False), (1, "USD", Decimal("3.00"), None, True), (2, "EUR", Decimal("10.01"), None, False), (2, "USD", Decimal("-5.00"), None, False), (3, "EUR", Decimal("1.00"), None, False), (3, "USD", Decimal("0.00"), Decimal("0.00"), False)]
    members = spark.createDataFrame(rows, "group_id long, currency string, amount decimal(18,2), amount_base decimal(18,2), is_fee boolean")
    rates = spark.createDataFrame([("EUR", "USD", date(2024, 1, 3), Decimal("0.500000"))], "base_currency string, quote_currency string, rate_date date, rate decimal(18,6)")
    got = {r.group_id: (str(r.net), r.n_converted, r.n_missing, r.n_currencies, r.balanced) for r in reports.validate_groups(groups, members, rates).collect()}
    # 10.01 at a half is 5.005, and halves go to the even cent.
    assert got == {1: ("0.00", 2, 0, 1, True), 2: ("0.00", 2, 0, 2, True), 3: ("0.00", 1, 1, 2, True)}
    empty = reports.validate_groups(groups, members.filter("group_id > 9"), rates).collect()
    assert [(r.n_converted, r.balanced) for r in empty] == [(0, True)] * 3


def test_quality_of_an_empty_ledger_blocks(spark):
    txns = spark.createDataFrame([], "txn_id long, category_id int, event_type string, confidence double, is_transfer boolean, linked boolean")
    none = txns.select("txn_id")
    ages = spark.createDataFrame([], "account_id long, stale boolean, rate_stale boolean, aged boolean")
    groups = spark.createDataFrame([], "n_currencies long, n_missing long")
    got = {r["check"]: (r.n, r.blockers, r.warnings) for r in reports.quality_counters(txns, none, none, ages, groups).collect()}
    assert got.pop("uncategorized") == (0, 1, 0)
    assert len(got) == 9 and set(got.values()) == {(0, 0, 0)}


def test_trailing_average_needs_two_rows_of_its_sign(spark):
    dues = spark.createDataFrame([(1, 7, "Rent 12", Decimal("-50.00")), (2, 7, "Gym", Decimal("-9.00")), (3, 8, None, Decimal("-1.00"))], "payment_id long, account_id long, description string, amount decimal(18,2)")
    rows = [(7, "rent 13", "2024-01-20", "-40.00", False), (7, "RENT", "2024-01-02", "-44.00", False), (7, "rent 14", "2024-01-03", "99.00", False), (7, "rent", "2023-01-03", "-1.00", False), (7, "rent", "2024-01-04", "-2.00", True), (7, "gym", "2024-01-05", "-8.00", False)]
    txns = spark.createDataFrame([(a, t, d, Decimal(x), f) for a, t, d, x, f in rows], "account_id long, description string, ts string, amount decimal(18,2), is_transfer boolean")
    got = {r.payment_id: (r.n, str(r.amount)) for r in settle.trailing_average(dues, txns, "2024-02-01").collect()}
    assert got == {1: (2, "-42.00"), 2: (1, "-9.00"), 3: (0, "-1.00")}


def test_loan_is_paid_off(spark):
    loans = spark.createDataFrame([(1, 1000.0, 0.01, 300.0), (2, 1000.0, 0.01, 10.0)], "account_id long, principal double, rate double, payment double")
    rows = reports.amortisation(loans, 12).orderBy("month").collect()
    assert [r.month for r in rows] == [1, 2, 3, 4] and {r.account_id for r in rows} == {1} and {r.payoff_month for r in rows} == {4}
    assert rows[0].interest == 10.0 and rows[0].principal == 290.0 and rows[-1].balance == 0.0
    assert abs(sum(r.principal for r in rows) - 1000) < 0.001


def test_snapshots_of_a_day_replace_that_day(spark, tmp_path):
    folder = str(tmp_path / "snapshots")
    made = spark.createDataFrame([(1, date(2024, 1, 1), 5), (2, date(2024, 1, 2), 6)], "account_id long, as_of date, value long")
    reports.write_snapshots(made, folder)
    reports.write_snapshots(made.filter("account_id = 2").withColumnRenamed("value", "v").selectExpr("account_id", "as_of", "v + 1 AS value"), folder)
    assert sorted((r.account_id, r.value) for r in spark.read.parquet(folder).collect()) == [(1, 5), (2, 7)]


def test_household_totals_keep_users_apart(spark):
    rows = [(1, date(2024, 1, 1), True, 10.0, False, 0.9), (1, date(2024, 1, 1), False, 4.0, True, 0.4), (2, date(2024, 1, 1), True, None, False, 0.9)]
    found = spark.createDataFrame(rows, "user_id long, as_of date, is_asset boolean, value_base double, stale boolean, confidence double")
    got = {r.user_id: (r.assets, r.liabilities, r.net, r.n_stale, r.n_low, r.confidence) for r in balances.household_totals(found).collect()}
    assert got == {1: (1000, 400, 600, 1, 1, 0.0), 2: (0, 0, 0, 0, 0, 1.0)}
