"""Interest that is posted again, holdings by day, loan payments and late postings, by hand and against plain loops."""

import calendar
import datetime as dt
import random
from decimal import ROUND_HALF_UP
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from talliver.operators import balances, holdings, links, reports, settle, spend
from talliver.operators import ledger_jobs as jobs

ROW = "txn_id long, account_id long, ts timestamp_ntz, amount decimal(18,2), is_interest boolean"
ACCOUNT = "account_id long, monthly_rate decimal(12,10), balance_truth_source string"


def months(first, through):
    y, m = first.year, first.month
    while True:
        end = dt.date(y, m, calendar.monthrange(y, m)[1])
        if end > through:
            return
        yield end
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)


def interest(balance, rate):
    x = (abs(balance) * rate).quantize(D("0.01"), ROUND_HALF_UP)
    return x if balance > 0 else -x


def resynced(rows, accounts, through):
    """The rule as it is told: walk the months, rebuild from the first wrong one."""
    out = []
    for acc, rate, truth in accounts:
        own = [r for r in rows if r[1] == acc]
        if rate <= 0 or truth not in ("transaction_sum", "hybrid") or not any(r[4] for r in own):
            continue
        bad = None
        for end in months(min(r[2] for r in own).date(), through):
            month = [r for r in own if r[4] and (r[2].year, r[2].month) == (end.year, end.month)]
            due = interest(sum((r[3] for r in own if r[2].date() <= end and r not in month), D(0)), rate)
            if len(month) > 1 or sum((r[3] for r in month), D(0)) != due:
                bad = end.replace(day=1)
                break
        if bad is None:
            continue
        gone = [r for r in own if r[4] and r[2].date() >= bad]
        out += [(acc, bad, "remove", r[0], r[2].date(), r[3]) for r in gone]
        left = [r for r in own if r not in gone]
        for end in months(bad, through):
            due = interest(sum((r[3] for r in left if r[2].date() <= end), D(0)), rate)
            if due:
                left.append((None, acc, dt.datetime.combine(end, dt.time()), due, True))
                out.append((acc, bad, "post", None, end, due))
    return out


def test_interest_is_posted_again_from_the_first_wrong_month(spark):
    r, rate = random.Random(5), D("0.0050000000")
    accounts = [(i, rate if i != 6 else D("0E-10"), ["transaction_sum", "hybrid", "latest_statement"][i % 3 if i < 9 else 0]) for i in range(14)]
    rows, n = [], 0
    for acc, _, _ in accounts:
        own = [(dt.datetime(2023, 1, 1) + dt.timedelta(days=r.randrange(300)), D(r.randrange(-500000, 300000)) / 100) for _ in range(6)]
        balance_rows = list(own)
        for end in months(min(own)[0].date(), dt.date(2023, 9, 30)):
            due = interest(sum((a for t, a in balance_rows if t.date() <= end), D(0)), rate)
            if due and acc not in (3, 7):  # accounts that don't accrue yet
                balance_rows.append((dt.datetime.combine(end, dt.time()), due))
                rows.append((n := n + 1, acc, balance_rows[-1][0], due if acc != 9 or end.month != 5 else due + 1, True))
                if acc == 10 and end.month == 6:
                    rows.append((n := n + 1, acc, balance_rows[-1][0], due, True))
        rows += [(n := n + 1, acc, t, a, False) for t, a in own]
        if acc == 12:  # a row that turned up late
            rows.append((n := n + 1, acc, dt.datetime(2023, 4, 2), D("100.00"), False))
    want = resynced(rows, accounts, dt.date(2023, 9, 30))
    got = settle.resync_interest(spark.createDataFrame(rows, ROW).repartition(4), spark.createDataFrame(accounts, ACCOUNT), "2023-09-30").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {9, 10, 12} <= {w[0] for w in want} and not {3, 6, 7} & {w[0] for w in want}
    # What it says makes the ledger right, so a second run says nothing.
    gone = {w[3] for w in want if w[2] == "remove"}
    after = [x for x in rows if x[0] not in gone] + [(10**6 + i, w[0], dt.datetime.combine(w[4], dt.time()), w[5], True) for i, w in enumerate(want) if w[2] == "post"]
    assert settle.resync_interest(spark.createDataFrame(after, ROW), spark.createDataFrame(accounts, ACCOUNT), "2023-09-30").collect() == []


def test_holdings_are_wound_back_from_todays_lots(spark):
    r = random.Random(8)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    trades = [(a, i, day(r.randrange(40)), D(r.randrange(-5, 9))) for a in range(4) for i in range(3) for _ in range(r.randrange(4))]
    lots = [(a, i, D(r.randrange(12))) for a in range(5) for i in range(4) for _ in range(r.randrange(3))]
    quotes = [(i, day(n), float(r.choice([0, 3, 5, 7.25]))) for i in range(4) for n in range(-3, 44) if r.random() < 0.6]
    got = holdings.holdings_value(
        spark.createDataFrame(lots, "account_id long, instrument_id long, quantity decimal(18,6)"), spark.createDataFrame(trades, "account_id long, instrument_id long, trade_ts date, quantity decimal(18,6)"), spark.createDataFrame(quotes, "instrument_id long, day date, close double")
    ).collect()
    want = []
    for a in range(5):
        held = {i for x, i, _ in lots if x == a} | {i for x, i, *_ in trades if x == a}
        since = min((t for x, _, t, _ in trades if x == a), default=None)
        mine = [(i, d, c) for i, d, c in quotes if i in held and (since is None or d >= since - dt.timedelta(5))]
        rows, open_ = [], False
        for d in sorted({d for _, d, _ in mine}):
            today = []
            for i in sorted(held):
                q = sum(x for b, j, x in lots if (b, j) == (a, i)) - sum(x for b, j, _, x in trades if (b, j) == (a, i)) + sum(x for b, j, t, x in trades if (b, j) == (a, i) and t <= d)
                price = max(((e, c) for j, e, c in mine if j == i and e <= d), default=(None, 0.0))[1]
                today.append((a, d, i, q, (q * D(price)).quantize(D("0.01"), ROUND_HALF_UP) if price > 0 else D(0)))
            open_ = open_ or sum(x[4] for x in today) > 0
            rows += today if open_ else []
        worth = {x[2] for x in rows if x[4]}
        want += [x for x in rows if x[2] in worth]
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(want)
    none = spark.createDataFrame([], "account_id long, instrument_id long, trade_ts date, quantity decimal(18,6)")
    assert holdings.holdings_value(none.drop("trade_ts"), none, spark.createDataFrame([], "instrument_id long, day date, close double")).collect() == []


@pytest.mark.parametrize("few", [holdings.BROADCAST, 0])
def test_holdings_are_dealt_out_before_their_days_are_made(spark, monkeypatch, few):
    """No exchange lies above the rows of (account, instrument, day); large quotes are joined by a shuffle, to the same result."""
    monkeypatch.setattr(holdings, "BROADCAST", few)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    lots = spark.createDataFrame([(1, 1, D(10)), (1, 2, D(3)), (None, 1, D(1)), (2, None, D(1)), (3, 9, D(4))], "account_id long, instrument_id long, quantity decimal(18,6)")
    trades = spark.createDataFrame([(1, 1, None, D(4)), (1, 1, day(3), D(2)), (1, 1, day(3), D(-1)), (4, 2, day(2), None)], "account_id long, instrument_id long, trade_ts date, quantity decimal(18,6)")
    quotes = spark.createDataFrame([(1, day(1), 2.0), (2, day(2), 5.0), (1, day(3), 3.0), (1, day(3), 1.0), (1, None, 9.0), (None, day(1), 9.0), (2, day(4), None)], "instrument_id long, day date, close double")
    found = holdings.holdings_value(lots, trades, quotes)
    assert sorted(map(tuple, found.collect())) == sorted(
        [(1, day(n), 1, D(5 if n < 3 else 6), D(v)) for n, v in ((1, 10), (2, 10), (3, 18), (4, 18))] + [(1, day(n), 2, D(3), D(v)) for n, v in ((1, 0), (2, 15), (3, 15), (4, 15))]
    )
    plan = found._jdf.queryExecution().executedPlan().toString().split("Generate inline", 1)
    assert len(plan) == 2 and "Exchange" not in plan[0].split("Initial Plan")[0]


def test_loan_batches_take_one_outflow_each(spark):
    r = random.Random(3)
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(n)
    rows = [(i, r.randrange(6), at(r.randrange(40)), D(r.choice([100, 250, 350])) + D(r.randrange(3)) / 2) for i in range(260)]
    rows = [(i, a, a // 3, t, x if a % 3 == 0 else -x, r.randrange(60) if i < 200 else 5, a % 3 == 0) for i, a, t, x in rows]
    rows += [(900 + i, 0, 0, at(3), D("1.00"), 77, True) for i in range(14)] + [(990, 1, 0, at(9), D("-10.00"), 1, False), (991, 1, 0, at(3), D("-14.00"), 1, False)]
    grouped = [i for i in range(0, 260, 9)]
    kind = "txn_id long, account_id long, owner long, ts timestamp_ntz, amount decimal(18,2), import_batch_id long, is_loan boolean"
    got = links.group_loan_payments(spark.createDataFrame(rows, kind).repartition(3), spark.createDataFrame([(i,) for i in grouped], "txn_id long")).collect()
    taken, want = set(grouped), []
    for batch, loan, owner in sorted({(x[5], x[1], x[2]) for x in rows if x[6]}):
        side = sorted((x for x in rows if x[6] and x[5] == batch and x[1] == loan), key=lambda x: (x[3], x[0]), reverse=True)[:10]
        total = sum(x[4] for x in side)
        low, high = min(x[3] for x in side).date() - dt.timedelta(5), max(x[3] for x in side).date() + dt.timedelta(5)
        fits = [(abs(x[4] + total), x[0], x[4]) for x in rows if x[2] == owner and x[1] != loan and low <= x[3].date() <= high and abs(x[4] + total) <= 1 and x[0] not in taken]
        if fits:
            _, paid, amount = min(fits)
            taken.add(paid)
            want += [(batch, loan, x[0], "loan_inflow", x[4]) for x in side] + [(batch, loan, paid, "bank_outflow", amount)]
    assert len(want) > 30 and sorted(map(tuple, got)) == sorted(want)
    assert (77, 0, 990, "bank_outflow", D("-10.00")) not in want or any(w[2] == 990 for w in want)


def test_rows_that_were_posted_after_their_day(spark):
    cases = [
        ('{"Post Date": "06/13/2024"}', True), ('{"Post Date": "06/12/2024"}', False), ('{"Posted Date": "13/06/2024"}', True), ('{"posting_date": "2024-06-14"}', True), ('{"Post Date": "6/20/24"}', True), ('{"Post Date": "06/27/2024"}', False),
        ('{"Post Date": "06/11/2024"}', False), ('{"Post Date": "", "Settlement Date": "06/15/2024"}', True), ('{"Post Date": "soon", "Settlement Date": "06/15/2024"}', False), ("[1]", False), ("no json", False), ("", False), (None, False),
    ]
    rows = [(i, raw, dt.datetime(2024, 6, 12, 23)) for i, (raw, _) in enumerate(cases)]
    got = spark.createDataFrame(rows, "id long, raw string, ts timestamp_ntz").select("id", balances.posted_after(F.col("raw"), F.col("ts")).alias("late")).collect()
    assert {r["id"]: r["late"] for r in got} == {i: want for i, (_, want) in enumerate(cases)}
    accounts = spark.createDataFrame([(1, False, D("1000.00"), dt.date(2024, 6, 12)), (2, True, D("5.00"), dt.date(2024, 6, 12)), (3, True, None, None)], "account_id long, is_asset boolean, statement_balance decimal(18,2), statement_balance_as_of date")
    txns = [(1, dt.datetime(2024, 6, 12, 1), D("-509.00"), '{"Post Date": "06/13/2024"}'), (1, dt.datetime(2024, 6, 12, 1), D("-9.00"), None), (1, dt.datetime(2024, 6, 20), D("100.00"), None), (1, dt.datetime(2024, 6, 1), D("7.00"), '{"Post Date": "06/13/2024"}'), (3, dt.datetime(2024, 6, 20), D("1.00"), None)]
    found = balances.anchored_balance(accounts, spark.createDataFrame(txns, "account_id long, ts timestamp_ntz, amount decimal(18,2), raw_data string"))
    assert sorted(map(tuple, found.collect())) == [(1, D("1409.00"), 1), (2, D("5.00"), 0)]


def test_zeroes_divide_nothing(spark):
    """Loans without a rate, totals that cancel out, series that begin at 0."""
    loans = spark.createDataFrame([(1, 100.0, 0.0, 40.0), (2, 100.0, 0.01, 60.0)], "account_id long, principal double, rate double, payment double")
    got = {(r["account_id"], r["month"]): (r["interest"], r["principal"], r["balance"], r["payoff_month"]) for r in reports.amortisation(loans, 12).collect()}
    assert [got[1, m] for m in (1, 2, 3)] == [(0.0, 40.0, 60.0, 3), (0.0, 40.0, 20.0, 3), (0.0, 20.0, 0.0, 3)] and (1, 4) not in got and got[2, 1] == (1.0, 59.0, 41.0, 2)
    assert sorted((r["account_id"], r["month"], r["balance"]) for r in jobs.amortise(loans.filter("account_id = 1"), 3).collect()) == [(1, 1, 60.0), (1, 2, 20.0), (1, 3, 0.0)]
    totals = spark.createDataFrame([("rent", D("-5.00")), ("pay", D("5.00"))], "category string, total decimal(38,2)")
    assert [r["share"] for r in spend.category_breakdown(totals, ("rent",)).collect()] == [None, None]
    series = [("a", dt.date(2020, 1, 1), D(0)), ("a", dt.date(2024, 1, 1), D(5)), ("b", dt.date(2020, 1, 1), D(2)), ("b", dt.date(2024, 1, 1), D(2))]
    assert [(r["k"], r["growth"]) for r in jobs.index_growth(spark.createDataFrame(series, "k string, day date, v decimal(18,2)"), "k", "day", "v").collect()] == [("b", 0.0)]
