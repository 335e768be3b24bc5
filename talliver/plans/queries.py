"""The ledger queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliver.functions import rules, text
from talliver.operators import balances as B
from talliver.operators import change, fx, links, pairs, schedules, spend, updates
from talliver.operators import ledger_jobs as jobs
from talliver.sources import statements
from talliver.sources.views import Ledger, oracle

#: The day that stands for today.
AS_OF = "2001-06-30"
MONTHS = 24
M = "DECIMAL(38,2)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: str = ""):
    """Register a function of a Ledger under its name, with its SQL over the named views."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Ledger(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = oracle(sql, *views.split()) if views else sql
        return fn

    return add


def dates(led: Ledger, *days: str) -> DataFrame:
    return led.spark.range(1).select(F.explode(F.array(*[F.lit(d).cast("date") for d in days])).alias("as_of"))


def found_balances(led: Ledger, when: DataFrame) -> DataFrame:
    return B.balances(led.accounts, led.transactions, led.running, led.valuations, led.rates, when)


# The oracle of all balances; {dates} is a query that gives as_of.
def balances_sql(when: str) -> str:
    return f"""WITH d AS ({when}),
t AS (SELECT txn_id, account_id, CAST(ts AS DATE) AS day, amount FROM transactions),
r AS (SELECT t.*, running.balance_after AS ba FROM t JOIN running USING (txn_id)),
h AS (SELECT *, NOT EXISTS (SELECT 1 FROM r o WHERE o.account_id = r.account_id AND o.day = r.day AND o.txn_id <> r.txn_id AND o.ba IS NOT NULL AND o.ba - o.amount = r.ba) AS closing FROM r WHERE ba IS NOT NULL),
e AS (SELECT account_id, day, ba AS v FROM (SELECT *, row_number() OVER (PARTITION BY account_id, day ORDER BY closing DESC, txn_id DESC) AS n FROM h) WHERE n = 1),
mk AS (SELECT a.account_id, d.as_of, max(e.day) AS mday FROM accounts a CROSS JOIN d JOIN e ON e.account_id = a.account_id AND e.day <= d.as_of GROUP BY 1, 2),
mv AS (SELECT mk.account_id, mk.as_of, mk.mday, max(e.v) + coalesce((SELECT sum(r.amount) FROM r WHERE r.account_id = mk.account_id AND r.ba IS NULL AND r.day > mk.mday AND r.day <= mk.as_of), 0) AS marker
  FROM mk JOIN e ON e.account_id = mk.account_id AND e.day = mk.mday GROUP BY 1, 2, 3),
tot AS (SELECT a.account_id, d.as_of, coalesce(sum(t.amount) FILTER (t.day <= d.as_of), 0) AS total, coalesce(sum(t.amount) FILTER (t.day <= a.statement_balance_as_of), 0) AS at_anchor
  FROM accounts a CROSS JOIN d LEFT JOIN t ON t.account_id = a.account_id GROUP BY 1, 2),
val AS (SELECT account_id, as_of, value AS mark, val_date AS mark_day FROM (SELECT d.as_of, v.*, row_number() OVER (PARTITION BY v.account_id, d.as_of ORDER BY val_date DESC, valuation_id DESC) AS n FROM valuations v JOIN d ON v.val_date <= d.as_of) WHERE n = 1),
g AS (SELECT a.*, d.as_of, tot.total, tot.at_anchor, mv.marker, mv.mday, val.mark, val.mark_day,
  a.balance_truth_source IN ('transaction_sum', 'hybrid') AND mv.marker IS NOT NULL AS led,
  a.balance_truth_source IN ('latest_valuation', 'manual_mark') AND val.mark IS NOT NULL AS marked,
  date_diff('day', a.statement_balance_as_of, d.as_of) > 45 AS old_s, date_diff('day', val.mark_day, d.as_of) > 90 AS old_m
  FROM accounts a CROSS JOIN d JOIN tot ON tot.account_id = a.account_id AND tot.as_of = d.as_of
  LEFT JOIN mv ON mv.account_id = a.account_id AND mv.as_of = d.as_of LEFT JOIN val ON val.account_id = a.account_id AND val.as_of = d.as_of),
s AS (SELECT account_id, user_id, account_type, is_asset, as_of, currency, CAST(CASE WHEN led THEN marker
   WHEN balance_truth_source = 'transaction_sum' THEN CASE WHEN total <> 0 THEN total ELSE current_value END
   WHEN balance_truth_source = 'hybrid' THEN CASE WHEN is_asset THEN statement_balance + (total - at_anchor) ELSE statement_balance - (total - at_anchor) END
   WHEN balance_truth_source IN ('latest_statement', 'liability_balance') THEN coalesce(statement_balance, current_value)
   WHEN marked THEN mark ELSE current_value END AS {M}) AS value,
  CASE WHEN led THEN mday WHEN balance_truth_source IN ('hybrid', 'latest_statement', 'liability_balance') THEN statement_balance_as_of WHEN marked THEN mark_day END AS balance_as_of,
  CASE WHEN led THEN 'running_balance' WHEN balance_truth_source = 'transaction_sum' AND total <> 0 THEN 'transaction_sum' WHEN balance_truth_source = 'hybrid' THEN 'statement_anchored'
   WHEN balance_truth_source IN ('latest_statement', 'liability_balance') THEN 'statement' WHEN marked THEN 'valuation' ELSE 'current_value' END AS source_used,
  CASE WHEN led OR (balance_truth_source = 'transaction_sum' AND total <> 0) THEN FALSE WHEN balance_truth_source IN ('hybrid', 'latest_statement', 'liability_balance') THEN old_s WHEN marked THEN old_m ELSE TRUE END AS stale,
  led, marked, total, balance_truth_source FROM g),
c AS (SELECT *, CAST(CASE WHEN led THEN 0.92 WHEN balance_truth_source = 'transaction_sum' THEN CASE WHEN total <> 0 THEN 0.8 ELSE 0.3 END
   WHEN balance_truth_source = 'hybrid' THEN CASE WHEN stale THEN 0.6 ELSE 0.9 END WHEN balance_truth_source = 'latest_statement' THEN CASE WHEN stale THEN 0.5 ELSE 0.9 END
   WHEN balance_truth_source = 'liability_balance' THEN CASE WHEN stale THEN 0.4 ELSE 0.85 END
   WHEN balance_truth_source = 'latest_valuation' THEN CASE WHEN NOT marked THEN 0.3 WHEN stale THEN 0.4 ELSE 0.85 END
   ELSE CASE WHEN marked AND NOT stale THEN 0.5 ELSE 0.2 END END AS DOUBLE) AS confidence FROM s),
fxr AS (SELECT c.account_id, c.as_of, CASE WHEN c.currency = 'USD' THEN 1.0::DOUBLE ELSE coalesce(
   (SELECT CAST(arg_max(rate, rate_date) AS DOUBLE) FROM rates WHERE base_currency = c.currency AND rate_date <= c.as_of),
   (SELECT CAST(arg_min(rate, rate_date) AS DOUBLE) FROM rates WHERE base_currency = c.currency)) END AS fx_rate FROM c),
bal AS (SELECT account_id, user_id, account_type, is_asset, as_of, currency, value, balance_as_of, source_used, confidence, stale, fx_rate,
  CASE WHEN value = 0 THEN 0.0::DOUBLE ELSE CAST(value AS DOUBLE) * fx_rate END AS value_base FROM c JOIN fxr USING (account_id, as_of))
"""


_ALL = "accounts transactions running valuations rates"
_TWO_DAYS = "SELECT unnest([DATE '1999-12-31', DATE '2001-06-30']) AS as_of"
_SPINE = f"SELECT CAST(least(last_day(CAST(date_trunc('month', DATE '{AS_OF}') AS DATE) - to_months(CAST(i AS INTEGER))), DATE '{AS_OF}') AS DATE) AS as_of FROM range({MONTHS}) x(i)"
_CENTS = "CAST(coalesce(round(value_base * 100), 0.0) AS BIGINT)"


@query(balances_sql(_TWO_DAYS) + "SELECT * FROM bal", _ALL)
def b_balances(led):
    return found_balances(led, dates(led, "1999-12-31", AS_OF))


@query(
    balances_sql(_SPINE)
    + f"""SELECT user_id, as_of, CAST(sum(CASE WHEN is_asset THEN {_CENTS} ELSE 0 END) AS BIGINT) AS assets, CAST(sum(CASE WHEN NOT is_asset THEN {_CENTS} ELSE 0 END) AS BIGINT) AS liabilities,
 CAST(sum(CASE WHEN is_asset THEN {_CENTS} ELSE -{_CENTS} END) AS BIGINT) AS net, count(*) AS n_accounts, count(*) FILTER (stale) AS n_stale FROM bal GROUP BY 1, 2""",
    _ALL,
)
def a13_net_worth_series(led):
    return B.net_worth(found_balances(led, B.month_ends(led.spark, AS_OF, MONTHS)))


@query(
    balances_sql(_TWO_DAYS)
    + """SELECT as_of, CASE account_type WHEN 'checking' THEN 'Banking' WHEN 'credit_card' THEN 'Credit Cards' WHEN 'brokerage' THEN 'Investments & Retirement' WHEN 'real_estate' THEN 'Real Estate' ELSE 'Loans' END AS type_group,
 CAST(sum(CASE WHEN is_asset THEN CAST(coalesce(round(value_base * 100), 0.0) AS BIGINT) ELSE -CAST(coalesce(round(value_base * 100), 0.0) AS BIGINT) END) AS BIGINT) AS net FROM bal GROUP BY 1, 2""",
    _ALL,
)
def a38_net_worth_by_group(led):
    return B.net_worth_by_group(found_balances(led, dates(led, "1999-12-31", AS_OF)))


@query(
    balances_sql(_TWO_DAYS)
    + """SELECT user_id, as_of, count(*) AS n_accounts, count(*) FILTER (stale) AS n_stale, count(*) FILTER (confidence < 0.5) AS n_low,
 greatest(0.0::DOUBLE, CAST(count(*) - count(*) FILTER (stale) - count(*) FILTER (confidence < 0.5) AS DOUBLE) / count(*)) AS confidence FROM bal GROUP BY 1, 2""",
    _ALL,
)
def a14_household_snapshot(led):
    return B.household_snapshot(found_balances(led, dates(led, "1999-12-31", AS_OF)))


@query(f"SELECT account_id, CAST(sum(amount) AS {M}) AS total, count(*) AS n_rows FROM transactions WHERE CAST(ts AS DATE) <= DATE '{AS_OF}' GROUP BY 1", "transactions")
def a1_txn_sum(led):
    return B.txn_sum(led.transactions, AS_OF)


@query(
    f"""WITH d AS ({_TWO_DAYS}), r AS (SELECT v.account_id, d.as_of, v.value, v.val_date, row_number() OVER (PARTITION BY v.account_id, d.as_of ORDER BY val_date DESC, valuation_id DESC) AS n FROM valuations v JOIN d ON v.val_date <= d.as_of)
SELECT a.account_id, d.as_of, r.value AS mark, r.val_date AS mark_day FROM accounts a CROSS JOIN d LEFT JOIN r ON r.account_id = a.account_id AND r.as_of = d.as_of AND n = 1""",
    "accounts valuations",
)
def j5_latest_valuation(led):
    left = led.accounts.select("account_id").crossJoin(F.broadcast(dates(led, "1999-12-31", AS_OF)))
    return fx.asof_join(left, led.valuations, "account_id", "as_of", "val_date", "valuation_id", "value", "mark")


_PROBE = "p AS (SELECT t.txn_id, a.currency, 'USD' AS base, CAST(t.ts AS DATE) AS day, t.amount FROM transactions t JOIN accounts a USING (account_id))"


def _probes(led):
    rows = led.transactions.join(led.accounts.select("account_id", "currency"), "account_id")
    return rows.select("txn_id", "currency", F.lit("USD").alias("base"), F.to_date("ts").alias("day"), "amount")


@query(
    f"""WITH {_PROBE}, q AS (SELECT DISTINCT currency, day FROM p WHERE currency <> 'USD'),
c AS (SELECT q.*, CAST(r.rate AS DOUBLE) AS rate, row_number() OVER (PARTITION BY q.currency, q.day ORDER BY abs(date_diff('day', r.rate_date, q.day)), r.rate_date DESC) AS n FROM q JOIN rates r ON r.base_currency = q.currency AND abs(date_diff('day', r.rate_date, q.day)) <= 30)
SELECT p.*, CASE WHEN p.currency = 'USD' THEN 1.0::DOUBLE ELSE c.rate END AS fx_rate FROM p LEFT JOIN c ON c.currency = p.currency AND c.day = p.day AND c.n = 1""",
    "accounts transactions rates",
)
def j1_rate_nearest(led):
    return fx.rate_nearest(_probes(led), led.rates, "currency", "base", "day")


@query(
    f"""WITH {_PROBE}, q AS (SELECT DISTINCT currency, day FROM p WHERE currency <> 'USD'),
c AS (SELECT q.*, coalesce((SELECT CAST(arg_max(rate, rate_date) AS DOUBLE) FROM rates WHERE base_currency = q.currency AND rate_date <= q.day), (SELECT CAST(arg_min(rate, rate_date) AS DOUBLE) FROM rates WHERE base_currency = q.currency)) AS rate FROM q)
SELECT p.*, CASE WHEN p.currency = 'USD' THEN 1.0::DOUBLE ELSE c.rate END AS fx_rate, CAST(p.amount AS DOUBLE) * CASE WHEN p.currency = 'USD' THEN 1.0::DOUBLE ELSE c.rate END AS amount_base FROM p LEFT JOIN c ON c.currency = p.currency AND c.day = p.day""",
    "accounts transactions rates",
)
def j2_rate_asof_j4_convert(led):
    return fx.rate_asof(_probes(led), led.rates, "currency", "base", "day").withColumn("amount_base", fx.convert(F.col("amount"), F.col("fx_rate")))


@query("SELECT base_currency AS base, CAST(arg_max(rate, rate_date) AS DOUBLE) AS fx_rate, max(rate_date) AS fx_date FROM rates GROUP BY 1", "rates")
def j3_rate_latest(led):
    return fx.rate_latest(led.rates, "USD")


@query(
    f"""WITH j AS (SELECT s.*, strftime(t.ts, '%Y-%m') AS month FROM splits s JOIN transactions t USING (txn_id) WHERE counts_as_true_spend)
SELECT CASE grouping(month, spend_type, category_id) WHEN 7 THEN 'total' WHEN 5 THEN 'type' WHEN 6 THEN 'category' ELSE 'month_type' END AS level, month, spend_type, category_id, CAST(-sum(amount_native) AS {M}) AS total, count(*) AS n
FROM j GROUP BY GROUPING SETS ((), (spend_type), (category_id), (month, spend_type))""",
    "splits transactions",
)
def a2_true_spend(led):
    return spend.true_spend(led.splits, led.transactions)


@query(f"SELECT category_id, count(*) AS n, CAST(sum(amount) AS {M}) AS total, CAST(CAST(sum(amount) AS {M}) AS DOUBLE) / count(*) AS mean FROM transactions WHERE amount < 0 AND CAST(ts AS DATE) > DATE '{AS_OF}' - 180 AND CAST(ts AS DATE) <= DATE '{AS_OF}' GROUP BY 1", "transactions")
def a3_spend_by_category_f4_lookback(led):
    return spend.spend_by_category(spend.lookback(led.transactions, AS_OF, 6))


_EVENTS = """CASE WHEN is_transfer THEN 'internal_transfer'
 WHEN account_type = 'credit_card' THEN CASE WHEN amount <= 0 THEN CASE WHEN regexp_matches(lower(description), '\\b(fee|interest)\\b') THEN 'fee' ELSE 'card_purchase' END
   WHEN regexp_matches(lower(description), 'refund|return|reversal|chargeback|rebate|cashback|cash back|goodwill|statement credit|credit adjustment') THEN 'merchant_refund'
   WHEN regexp_matches(lower(description), 'payment|pymt|pmt|autopay|auto pay|thank you') THEN 'card_payment_settlement'
   WHEN regexp_matches(lower(description), '\\b(fee|interest)\\b') THEN 'fee' WHEN regexp_matches(lower(description), 'instalment plan|installment plan|plan it|pay over time') THEN 'card_credit' ELSE 'merchant_refund' END
 WHEN account_type = 'mortgage' THEN CASE WHEN amount > 0 THEN 'mortgage_payment' WHEN regexp_matches(lower(description), '\\binterest\\b') THEN 'mortgage_interest' ELSE 'fee' END
 WHEN account_type = 'brokerage' THEN CASE WHEN amount > 0 THEN 'investment_contribution' ELSE 'investment_withdrawal' END
 WHEN account_type = 'real_estate' THEN 'asset_flow'
 WHEN regexp_matches(lower(description), '\\bfee\\b|service charge|interest charge') THEN 'fee'
 WHEN regexp_matches(lower(description), '\\btax\\b|irs|hmrc') THEN 'tax_payment'
 WHEN amount >= 0 THEN CASE WHEN regexp_matches(lower(description), 'payroll|salary|wages|direct deposit|net pay|employer') THEN 'payroll_income' ELSE 'external_income' END
 ELSE 'lifestyle_expense' END"""
_CLASSED = f"k AS (SELECT txn_id, account_id, ts, amount, {_EVENTS} AS event_type FROM transactions JOIN accounts USING (account_id))"
_META = """CASE WHEN event_type IN ('external_income', 'payroll_income', 'internal_transfer', 'card_payment_settlement', 'investment_contribution', 'investment_withdrawal', 'asset_flow') THEN 'non_spend_cash_use'
 WHEN event_type IN ('mortgage_payment', 'mortgage_interest', 'fee') THEN 'debt_cost' WHEN event_type = 'tax_payment' THEN 'tax' ELSE 'lifestyle' END"""


@query(f"WITH {_CLASSED} SELECT *, {_META} AS spend_type, {_META} <> 'non_spend_cash_use' AS counts_as_spend FROM k", "transactions accounts")
def x11_classify_events_x12_metadata(led):
    return jobs.classify_all(led.transactions, led.accounts)


@query(
    f"""WITH {_CLASSED} SELECT strftime(ts, '%Y-%m') AS month, CAST(coalesce(-sum(amount) FILTER (amount < 0 OR event_type IN ('merchant_refund', 'card_credit')), 0) AS {M}) AS spending,
 CAST(coalesce(sum(amount) FILTER (NOT (amount < 0 OR event_type IN ('merchant_refund', 'card_credit'))), 0) AS {M}) AS income FROM k WHERE event_type NOT IN ('internal_transfer', 'card_payment_settlement') GROUP BY 1""",
    "transactions accounts",
)
def a4_monthly_cashflow(led):
    return spend.monthly_cashflow(jobs.classify_all(led.transactions, led.accounts))


@query(
    f"""SELECT description, count(*) AS n, CAST(sum(amount) AS {M}) AS total, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last, CAST(CAST(sum(amount) AS {M}) AS DOUBLE) / count(*) AS mean, count(*) >= 3 AS recurring
FROM transactions WHERE amount < 0 GROUP BY 1 ORDER BY total, description LIMIT 20""",
    "transactions",
)
def a5_top_merchants(led):
    return spend.top_merchants(led.transactions, 20)


@query(f"SELECT description, count(*) AS n, CAST(sum(amount) AS {M}) AS total, CAST(CAST(sum(amount) AS {M}) AS DOUBLE) / 3 AS monthly FROM transactions WHERE amount < 0 AND CAST(ts AS DATE) > DATE '{AS_OF}' - 90 AND CAST(ts AS DATE) <= DATE '{AS_OF}' GROUP BY 1 HAVING count(*) >= 3", "transactions")
def a6_recurring_expenses(led):
    return spend.recurring_expenses(led.transactions, AS_OF)


_CATS = "cats AS (SELECT CAST(r_regionkey AS BIGINT) AS category_id, lower(r_name) AS name FROM region)"


def _cats(led):
    return led.spark.read.parquet(f"{led.sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("category_id"), F.lower("r_name").alias("name"))


@query(f"WITH {_CATS} SELECT c.category_id, c.name, count(t.txn_id) AS n, CAST(coalesce(sum(amount), 0) AS {M}) AS total FROM cats c LEFT JOIN transactions t USING (category_id) GROUP BY 1, 2", "transactions")
def a7_category_stats(led):
    return spend.category_stats(_cats(led), led.transactions)


_TOTALS = f"tt AS (SELECT coalesce(c.name, 'Uncategorized') AS category, count(*) AS n, CAST(sum(amount) AS {M}) AS total FROM transactions t LEFT JOIN cats c USING (category_id) GROUP BY 1)"


@query(f"WITH {_CATS}, {_TOTALS} SELECT * FROM tt", "transactions")
def a37_category_totals(led):
    return spend.category_totals(led.transactions, _cats(led))


@query(f"WITH {_CATS}, {_TOTALS} SELECT *, CAST(total AS DOUBLE) * 100.0 / CAST((SELECT sum(total) FROM tt) AS DOUBLE) AS share, contains(lower(category), 'asia') OR contains(lower(category), 'europe') AS essential FROM tt", "transactions")
def a10_category_breakdown(led):
    return spend.category_breakdown(spend.category_totals(led.transactions, _cats(led)), ("asia", "europe"))


@query(
    "SELECT account_id, strftime(ts, '%Y-%m') AS month, " + ", ".join(f"CAST(coalesce(sum(amount) FILTER (category_id = {c}), 0) AS {M}) AS c{c}" for c in range(1, 6)) + " FROM transactions GROUP BY 1, 2",
    "transactions",
)
def a11_account_category_month(led):
    return spend.account_category_month(led.transactions, [1, 2, 3, 4, 5])


@query(
    f"""WITH c AS (SELECT last_day(CAST(ts AS DATE)) AS month_end, category_id, currency, CAST(-sum(amount) AS {M}) AS spent FROM transactions JOIN accounts USING (account_id) WHERE amount < 0 AND NOT is_transfer GROUP BY 1, 2, 3),
q AS (SELECT DISTINCT currency, month_end FROM c), n AS (SELECT q.*, CAST(r.rate AS DOUBLE) AS rate, row_number() OVER (PARTITION BY q.currency, q.month_end ORDER BY abs(date_diff('day', r.rate_date, q.month_end)), r.rate_date DESC) AS k
 FROM q JOIN rates r ON r.base_currency = q.currency AND abs(date_diff('day', r.rate_date, q.month_end)) <= 30),
z AS (SELECT c.*, CASE WHEN c.currency = 'USD' THEN 1.0::DOUBLE ELSE n.rate END AS fx FROM c LEFT JOIN n ON n.currency = c.currency AND n.month_end = c.month_end AND n.k = 1)
SELECT month_end, category_id, CAST(sum(CAST(round(CAST(spent AS DOUBLE) * coalesce(fx, 1.0::DOUBLE) * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) FILTER (fx IS NULL) AS n_unconverted FROM z GROUP BY 1, 2""",
    "transactions accounts rates",
)
def a9_spend_chart(led):
    return spend.spend_chart(led.transactions, led.accounts, led.rates, "USD")


@query("SELECT account_id, count(*) AS n FROM transactions GROUP BY 1", "transactions")
def a8_account_counts(led):
    return led.transactions.groupBy("account_id").agg(F.count("*").alias("n"))


@query("SELECT txn_id, account_id, ts, description, amount FROM transactions WHERE CAST(ts AS DATE) >= DATE '1999-01-01' AND CAST(ts AS DATE) <= DATE '2000-12-31' AND contains(lower(description), '3') AND NOT is_transfer AND amount BETWEEN -100000 AND 50000 AND account_id IN (SELECT account_id FROM accounts WHERE currency = 'EUR')", "transactions accounts")
def f1_filter_transactions(led):
    rows = led.transactions.join(led.accounts.select("account_id", "currency"), "account_id")
    return spend.filter_transactions(rows, currency="EUR", date_from="1999-01-01", date_to="2000-12-31", text="3", is_transfer=False, least=-100000, most=50000).select("txn_id", "account_id", "ts", "description", "amount")


@query("SELECT txn_id, account_id, amount FROM transactions WHERE account_id IN (SELECT account_id FROM accounts WHERE user_id = 7)", "transactions accounts")
def f2_owned_by(led):
    return spend.owned_by(led.transactions, led.accounts, 7).select("txn_id", "account_id", "amount")


@query("SELECT account_id, CASE account_type WHEN 'checking' THEN 'Banking' WHEN 'credit_card' THEN 'Credit Cards' WHEN 'brokerage' THEN 'Investments & Retirement' WHEN 'real_estate' THEN 'Real Estate' ELSE 'Loans' END AS type_group FROM accounts", "accounts")
def f5_type_group(led):
    return led.accounts.select("account_id", rules.type_group(F.col("account_type")).alias("type_group"))


@query(
    """SELECT payment_id, CASE WHEN s.amount > 0 THEN 'reminder' WHEN a.account_type IN ('loan', 'mortgage') THEN 'reminder'
 WHEN a.account_type IN ('checking', 'savings') AND (regexp_matches(lower(s.description), 'credit card|card payment|mortgage|loan|property|fee|rent|tax|council|school|tuition|fcu|amex|visa|mastercard') OR abs(s.amount) >= 500) THEN 'reminder' ELSE 'auto' END AS level
FROM schedules s JOIN accounts a USING (account_id)""",
    "schedules accounts",
)
def f8_flag_level(led):
    rows = led.schedules.join(led.accounts.select("account_id", "account_type"), "account_id")
    return rows.select("payment_id", rules.flag_level(F.col("amount"), F.col("account_type"), F.lit("manual"), F.col("description"), F.lit(None).cast("string")).alias("level"))


@query("SELECT account_id, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM transactions WHERE CAST(ts AS DATE) > DATE '2001-01-01' GROUP BY 1", "transactions")
def f9_future_dated(led):
    return spend.future_dated(led.transactions, "2001-01-01")


@query("SELECT txn_id, ts, amount FROM transactions ORDER BY ts DESC, txn_id DESC LIMIT 25 OFFSET 50", "transactions")
def k1_page(led):
    return spend.page(led.transactions, 50, 25).select("txn_id", "ts", "amount")


@query(f"SELECT txn_id, amount FROM transactions WHERE CAST(ts AS DATE) > DATE '{AS_OF}' - 30 AND CAST(ts AS DATE) <= DATE '{AS_OF}' AND amount < 0 AND NOT is_transfer ORDER BY amount, txn_id LIMIT 10", "transactions")
def k2_largest_expenses(led):
    return spend.largest_expenses(led.transactions, AS_OF, 10).select("txn_id", "amount")


@query("SELECT account_id, txn_id, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, txn_id DESC) AS place FROM transactions) WHERE place <= 10", "transactions")
def k3_recent(led):
    return spend.recent(led.transactions, "account_id", 10).select("account_id", "txn_id", "place")


@query("SELECT DISTINCT base_currency, quote_currency FROM rates", "rates")
def k5_distinct_pairs(led):
    return led.rates.select("base_currency", "quote_currency").distinct()


@query("SELECT txn_id FROM transactions WHERE txn_id NOT IN (SELECT txn_id FROM splits)", "transactions splits")
def u1_unsplit(led):
    return jobs.unsplit(led.transactions, led.splits).select("txn_id")


@query(f"WITH {_CLASSED} SELECT txn_id, 1 AS split_no, amount, {_META} AS spend_type, {_META} <> 'non_spend_cash_use' AS counts_as_spend FROM k WHERE txn_id NOT IN (SELECT txn_id FROM splits)", "transactions accounts splits")
def x22_default_splits(led):
    return jobs.default_splits(jobs.classify_all(led.transactions, led.accounts), led.splits)


@query(
    f"""WITH s AS (SELECT txn_id, count(*) AS n, CAST(sum(amount_native) AS {M}) AS t FROM splits GROUP BY 1)
SELECT t.txn_id, coalesce(s.n, 0) AS n_splits, coalesce(s.t, 0) AS split_sum, CAST(t.amount - coalesce(s.t, 0) AS {M}) AS residual, abs(t.amount - coalesce(s.t, 0)) <= 0.01 AS valid FROM transactions t LEFT JOIN s USING (txn_id)""",
    "transactions splits",
)
def a22_validate_splits(led):
    return jobs.validate_splits(led.transactions, led.splits)


@query(
    f"""WITH s AS (SELECT account_id, CAST(sum(amount) AS {M}) AS moved FROM transactions GROUP BY 1)
SELECT account_id, moved, CAST(statement_balance AS {M}) AS expected, least(abs(moved - statement_balance), abs(moved + statement_balance)) <= greatest(1, CAST(abs(statement_balance) / 1000 AS {M})) AS matches FROM accounts JOIN s USING (account_id)""",
    "transactions accounts",
)
def a25_statement_rollforward(led):
    return jobs.statement_rollforward(led.transactions, led.accounts)


_GROUPS = "SELECT account_id, CAST(ts AS DATE) AS day, amount, count(*) AS n, count(DISTINCT import_batch_id) AS n_batches, min(txn_id) AS first_id, max(txn_id) AS last_id, count(DISTINCT import_batch_id) > 1 AS cross_batch FROM feed GROUP BY 1, 2, 3 HAVING count(*) >= 2"


@query(_GROUPS, "feed")
def a19_duplicate_groups(led):
    return pairs.duplicate_groups(led.feed)


def _dismissed(led):
    return led.feed.filter("txn_id % 10 = 0").select("account_id", F.to_date("ts").alias("day"), "amount").distinct()


@query(f"WITH g AS ({_GROUPS}) SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM feed f WHERE f.txn_id % 10 = 0 AND f.account_id = g.account_id AND CAST(f.ts AS DATE) = g.day AND f.amount = g.amount)", "feed")
def j16_undismissed_groups(led):
    return pairs.not_dismissed(pairs.duplicate_groups(led.feed), _dismissed(led), ["account_id", "day", "amount"]).select("account_id", "day", "amount", "n", "n_batches", "first_id", "last_id", "cross_batch")


@query(
    """SELECT a.txn_id AS a, b.txn_id AS b, CAST(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE)) AS INTEGER) AS gap, 1.0::DOUBLE - CAST(levenshtein(a.description, b.description) AS DOUBLE) / greatest(length(a.description), length(b.description)) AS score
FROM feed a JOIN feed b ON a.account_id = b.account_id AND a.amount = b.amount AND a.import_batch_id <> b.import_batch_id AND date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE)) BETWEEN 1 AND 3
WHERE 1.0::DOUBLE - CAST(levenshtein(a.description, b.description) AS DOUBLE) / greatest(length(a.description), length(b.description)) >= 0.85""",
    "feed",
)
def j9_near_duplicates(led):
    return pairs.near_duplicates(led.feed, similarity=lambda a, b: text.ratio_by_edits(F.lower(a), F.lower(b)))


_WORDS = "[" + ", ".join(f"'{w}'" for w in pairs.TRANSFER_WORDS) + "]"


@query(
    f"""WITH w AS (SELECT DISTINCT txn_id, unnest(string_split_regex(regexp_replace(lower(description), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')) AS token FROM moves), l AS (SELECT DISTINCT token FROM w WHERE txn_id % 97 = 10 AND length(token) >= 4 AND token NOT IN ('that', 'this', 'with', 'from')),
m AS (SELECT *, CAST(ts AS DATE) AS day, len(list_filter({_WORDS}, lambda x: contains(lower(description), x))) AS hits, txn_id IN (SELECT txn_id FROM w JOIN l USING (token)) AS known FROM moves WHERE txn_id % 13 <> 0),
p AS (SELECT o.txn_id AS out_id, i.txn_id AS in_id, CAST(abs(date_diff('day', o.day, i.day)) AS INTEGER) AS gap, least(0.5::DOUBLE, (o.hits + i.hits) * 0.15::DOUBLE + CASE WHEN o.known OR i.known THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) AS text, CAST(o.is_transfer AS INTEGER) + CAST(i.is_transfer AS INTEGER) AS flags
 FROM m o JOIN m i ON o.household_id = i.household_id AND o.account_id <> i.account_id AND o.amount < 0 AND i.amount > 0 AND abs(o.amount + i.amount) <= 0.01 AND abs(date_diff('day', o.day, i.day)) <= 3)
SELECT out_id, in_id, gap, CAST(round(CAST(least(1.0::DOUBLE, 0.3::DOUBLE * (1 - gap / 4.0::DOUBLE) + 0.4::DOUBLE + 0.15::DOUBLE * text + 0.15::DOUBLE * flags) AS DECIMAL(12,9)), 3) AS DOUBLE) AS score FROM p WHERE NOT (out_id % 5 = 0 AND in_id % 2 = 0)""",
    "moves",
)
def j6_detect_transfers(led):
    token = F.explode(F.split(F.regexp_replace(F.lower("description"), r"[^a-z0-9\s]", " "), r"\s+")).alias("token")
    learned = led.moves.filter("txn_id % 97 = 10").select(token).filter(F.length("token") >= 4)
    linked = led.moves.filter("txn_id % 13 = 0").select("txn_id")
    found = pairs.detect_transfers(led.moves, "household_id", learned=learned, linked=linked)
    return found.filter("not (out_id % 5 = 0 and in_id % 2 = 0)")


_FLOWS = f"fl AS (SELECT a.account_id AS from_account, b.account_id AS to_account, count(*) AS n, CAST(sum(abs(a.amount)) AS {M}) AS total FROM feed a JOIN feed b ON b.txn_id = a.txn_id + 1 WHERE a.amount < 0 AND b.amount > 0 AND a.account_id <> b.account_id GROUP BY 1, 2)"


def _flows(led):
    a = led.feed.filter("amount < 0").select(F.col("txn_id").alias("out_id"), (F.col("txn_id") + 1).alias("in_id"), F.col("account_id").alias("x"))
    b = led.feed.filter("amount > 0").select(F.col("txn_id").alias("in_id"), F.col("account_id").alias("y"))
    return pairs.transfer_flows(a.join(b, "in_id").filter("x <> y").select("out_id", "in_id"), led.feed)


@query(f"WITH {_FLOWS} SELECT * FROM fl", "feed")
def a20_transfer_flows(led):
    return _flows(led)


@query(
    f"""WITH {_FLOWS}, z AS (SELECT least(from_account, to_account) AS lo, greatest(from_account, to_account) AS hi, sum(CASE WHEN from_account < to_account THEN total ELSE -total END) AS net FROM fl GROUP BY 1, 2)
SELECT CASE WHEN net > 0 THEN lo ELSE hi END AS from_account, CASE WHEN net > 0 THEN hi ELSE lo END AS to_account, CAST(abs(net) AS {M}) AS net FROM z WHERE net <> 0""",
    "feed",
)
def a21_net_flows(led):
    return pairs.net_flows(_flows(led))


@query(f"WITH {_FLOWS} SELECT account_id, CAST(sum(i) AS {M}) AS money_in, CAST(sum(o) AS {M}) AS money_out, CAST(sum(i) - sum(o) AS {M}) AS net FROM (SELECT to_account AS account_id, total AS i, 0 AS o FROM fl UNION ALL SELECT from_account, 0, total FROM fl) GROUP BY 1", "feed")
def a21_account_flows(led):
    return pairs.account_flows(_flows(led))


@query(
    """WITH w AS (SELECT DISTINCT txn_id, unnest(string_split_regex(regexp_replace(lower(description), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')) AS token FROM feed), l AS (SELECT DISTINCT token FROM w WHERE txn_id % 97 = 0 AND length(token) >= 4)
SELECT txn_id, count(*) AS n_shared FROM w JOIN l USING (token) GROUP BY 1""",
    "feed",
)
def u3_shared_tokens(led):
    learned = led.feed.filter("txn_id % 97 = 0").select(F.explode(F.split(F.lower("description"), r"\s+")).alias("token")).filter(F.length("token") >= 4)
    return pairs.shared_tokens(led.feed, learned)


@query(
    r"""SELECT DISTINCT description, lower(trim(regexp_replace(regexp_replace(description, '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS comparison_key,
 lower(trim(regexp_replace(regexp_replace(regexp_replace(description, '\d+', '', 'g'), '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS grouping_key, list_aggregate(list_sort(list_distinct(regexp_extract_all(description, '\d{4,}'))), 'string_agg', ',') AS refs FROM feed""",
    "feed",
)
def x1_x2_x5_text_keys(led):
    d = F.col("description")
    return led.feed.select("description").distinct().select("description", text.comparison_key(d).alias("comparison_key"), text.grouping_key(d).alias("grouping_key"), F.array_join(text.reference_numbers(d), ",").alias("refs"))


@query(
    """WITH f AS (SELECT txn_id, account_id, array_to_string(list_transform(list_sort(json_keys(raw_data)), lambda k: concat(k, '=', json_extract_string(raw_data, concat('$.', k)))), chr(30)) AS raw_data FROM feed), r AS (SELECT txn_id, account_id, raw_data, row_number() OVER (PARTITION BY account_id, raw_data ORDER BY txn_id) - 1 AS repeat FROM f)
SELECT txn_id, CAST(repeat AS INTEGER) AS repeat, sha256(concat(account_id, chr(31), raw_data, chr(31), repeat)) AS hash FROM r""",
    "feed",
)
def w3_x4_fingerprints(led):
    return jobs.fingerprints(led.feed)


@query(
    """WITH n AS (SELECT *, CAST(ts AS DATE) AS day FROM feed WHERE txn_id % 2 = 1), l AS (SELECT *, CAST(ts AS DATE) AS day FROM feed WHERE txn_id % 4 = 0), d AS (SELECT *, CAST(ts AS DATE) AS day FROM feed WHERE txn_id % 4 = 2)
SELECT txn_id, account_id, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.account_id = n.account_id AND l.day = n.day AND l.description = n.description AND l.amount = n.amount) THEN 'duplicate'
 WHEN EXISTS (SELECT 1 FROM d WHERE d.account_id = n.account_id AND d.day = n.day AND d.description = n.description AND d.amount = n.amount) THEN 'deleted' ELSE 'imported' END AS outcome FROM n""",
    "feed",
)
def j10_dedupe_against_ledger(led):
    part = lambda c: led.feed.filter(c)
    return jobs.dedupe_against_ledger(part("txn_id % 2 = 1"), part("txn_id % 4 = 0"), part("txn_id % 4 = 2"))


@query("SELECT txn_id, account_id, amount FROM feed WHERE txn_id % 4 = 2 AND txn_id NOT IN (SELECT txn_id FROM feed WHERE txn_id % 6 = 0)", "feed")
def j20_recover_deleted(led):
    return jobs.recover_deleted(led.feed.filter("txn_id % 4 = 2"), led.feed.filter("txn_id % 6 = 0")).select("txn_id", "account_id", "amount")


@query(
    """WITH m AS (SELECT import_batch_id, amount, regexp_matches(lower(description), 'payment|autopay|auto pay|thank you|pymt|online pmt|direct debit|bill pay') AS paid FROM moves),
n AS (SELECT import_batch_id, count(*) FILTER (paid AND amount > 0) AS paid_in, count(*) FILTER (paid AND amount < 0) AS paid_out, count(*) FILTER (NOT paid AND amount > 0) AS charged_in, count(*) FILTER (NOT paid AND amount < 0) AS charged_out FROM m GROUP BY 1)
SELECT *, CASE WHEN paid_in > paid_out AND charged_out >= charged_in THEN false WHEN paid_out > paid_in AND charged_in >= charged_out THEN true ELSE charged_out <= charged_in END AS flip FROM n""",
    "moves",
)
def i6_liability_sign_flip(led):
    return jobs.liability_sign_flip(led.moves)


@query("SELECT account_id, val_date, max_by(value, valuation_id) AS value, max(valuation_id) AS valuation_id FROM valuations GROUP BY 1, 2", "valuations")
def i13_upsert_latest(led):
    old, new = led.valuations.filter("valuation_id % 2 = 0"), led.valuations.filter("valuation_id % 2 = 1")
    return jobs.upsert_latest(old, new, ["account_id", "val_date"], "valuation_id").select("account_id", "val_date", "value", "valuation_id")


@query("SELECT * FROM valuations WHERE valuation_id % 5 = 0 UNION ALL SELECT * FROM valuations v WHERE valuation_id % 5 <> 0 AND account_id NOT IN (SELECT account_id FROM valuations WHERE valuation_id % 5 = 0)", "valuations")
def i15_replace_by_owner(led):
    return jobs.replace_by_owner(led.valuations.filter("valuation_id % 5 <> 0"), led.valuations.filter("valuation_id % 5 = 0"), ["account_id"]).select("valuation_id", "account_id", "val_date", "value")


def _history(led):
    """All rows of both ledgers; feed accounts are another number range."""
    part = lambda df, sign: df.select((sign * F.col("account_id")).cast("long").alias("account_id"), "ts", "description", "amount")
    return part(led.transactions, 1).unionByName(part(led.feed, -1))


# The oracle of the streams of all rows; as_of is 2001-08-01.
_RECURRING = r"""h AS (SELECT CAST(account_id AS BIGINT) AS account_id, ts, description, amount FROM transactions UNION ALL SELECT CAST(-account_id AS BIGINT), ts, description, amount FROM feed),
k AS (SELECT account_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(description, ''), '\d+', '', 'g'), '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS stream, CAST(ts AS DATE) AS day, CAST(amount AS DOUBLE) AS amount FROM h),
r AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY account_id, stream ORDER BY day), day) AS gap FROM k WHERE stream <> ''),
m AS (SELECT account_id, stream, quantile_cont(gap, 0.5) AS median, count(*) AS n, max(day) AS last, avg(amount) AS mean, stddev_samp(amount) AS sd, count(DISTINCT amount) AS kinds FROM r GROUP BY 1, 2 HAVING count(*) >= 3),
f AS (SELECT *, CASE WHEN abs(median - 7) <= 3 THEN 'weekly' WHEN abs(median - 14) <= 4 THEN 'biweekly' WHEN abs(median - 30) <= 8 THEN 'monthly' WHEN abs(median - 91) <= 12 THEN 'quarterly' WHEN abs(median - 365) <= 20 THEN 'annually' END AS frequency,
 CASE WHEN abs(median - 7) <= 3 THEN 3 WHEN abs(median - 14) <= 4 THEN 4 WHEN abs(median - 30) <= 8 THEN 8 WHEN abs(median - 91) <= 12 THEN 12 ELSE 20 END AS tol FROM m),
g AS (SELECT f.account_id, f.stream, CAST(count(*) FILTER (abs(gap - median) <= tol) AS DOUBLE) / count(*) AS regularity FROM f JOIN r USING (account_id, stream) WHERE frequency IS NOT NULL AND gap IS NOT NULL GROUP BY 1, 2),
c AS (SELECT *, round(CASE WHEN kinds = 1 THEN 1.0 WHEN mean = 0 THEN 0.5 ELSE greatest(0.0, 1 - sd / abs(mean)) END, 6) AS k FROM f JOIN g USING (account_id, stream)),
o AS (SELECT *, round(regularity * CASE WHEN k >= 0.85 THEN k ELSE 0.85 END, 3) AS confidence FROM c),
found AS (SELECT account_id, stream, n, frequency, CASE WHEN k >= 0.85 THEN 'fixed' ELSE 'variable' END AS amount_type, confidence, last AS last_seen FROM o
 WHERE k >= 0.30 AND confidence >= 0.50 AND date_diff('day', last, DATE '2001-08-01') <= 120)"""


@query(f"WITH {_RECURRING} SELECT * FROM found", "transactions feed")
def w2_detect_recurring_all(led):
    return schedules.detect_recurring(_history(led), "2001-08-01").drop("next_due")


@query(
    rf"""WITH {_RECURRING} SELECT * FROM found WHERE NOT EXISTS (SELECT 1 FROM schedules s WHERE s.account_id = found.account_id
 AND lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(s.description, ''), '\d+', '', 'g'), '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g'))) = found.stream)""",
    "transactions feed schedules",
)
def j21_new_suggestions_all(led):
    found = schedules.detect_recurring(_history(led), "2001-08-01").drop("next_due")
    return schedules.new_suggestions(found, led.schedules.select("account_id", text.grouping_key(F.col("description")).alias("stream")))


# Earlier names of the same two jobs.
for _name in ("w2_detect_recurring", "j21_new_suggestions"):
    QUERIES[_name], ORACLES[_name] = QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"]


_PROJECTED = """pr AS (SELECT payment_id, account_id, amount, CAST(CASE frequency WHEN 'weekly' THEN next_due + CAST(7 * i AS INTEGER) WHEN 'biweekly' THEN next_due + CAST(14 * i AS INTEGER) WHEN 'monthly' THEN next_due + to_months(CAST(i AS INTEGER))
 WHEN 'quarterly' THEN next_due + to_months(CAST(3 * i AS INTEGER)) ELSE next_due + to_months(CAST(12 * i AS INTEGER)) END AS DATE) AS due FROM schedules, range(60) x(i)), pd AS (SELECT payment_id, account_id, due, amount FROM pr WHERE due <= DATE '2002-07-31')"""


@query(f"WITH {_PROJECTED} SELECT * FROM pd", "schedules")
def x17_x18_project_schedule(led):
    return schedules.project_schedule(led.schedules, "2002-07-31")


@query(
    f"""WITH {_PROJECTED}, dd AS (SELECT account_id, due, sum(amount) AS delta FROM pd GROUP BY 1, 2), b AS (SELECT account_id, due, CAST(coalesce(a.current_value, 0) + sum(delta) OVER (PARTITION BY account_id ORDER BY due) AS {M}) AS balance FROM dd LEFT JOIN accounts a USING (account_id))
SELECT *, balance < 0 AS below_zero FROM b""",
    "schedules accounts",
)
def w1_running_balance(led):
    opening = led.accounts.select("account_id", F.col("current_value").alias("opening"))
    return schedules.running_balance(schedules.project_schedule(led.schedules, "2002-07-31"), opening)


@query(f"WITH {_PROJECTED} SELECT payment_id, min(due) AS first_due FROM pd GROUP BY 1", "schedules")
def w7_first_occurrence(led):
    return schedules.first_occurrence(schedules.project_schedule(led.schedules, "2002-07-31"))


@query("SELECT a.account_id, min(s.next_due) AS due FROM accounts a LEFT JOIN schedules s USING (account_id) WHERE NOT a.is_asset GROUP BY 1", "accounts schedules")
def b8_next_payment_due(led):
    return schedules.next_payment_due(led.accounts, led.schedules)


@query(
    """WITH h AS (SELECT payment_id, account_id, frequency, CAST(round(amount / 1000) * 1000 AS DECIMAL(18,2)) AS amount FROM schedules), r AS (SELECT h.*, is_asset, CAST(abs(round(amount * 100)) AS BIGINT) AS cents FROM h JOIN accounts a USING (account_id))
SELECT payment_id, account_id, frequency, amount FROM r WHERE is_asset AND EXISTS (SELECT 1 FROM r o WHERE NOT o.is_asset AND o.frequency = r.frequency AND abs(o.cents - r.cents) <= 1)""",
    "schedules accounts",
)
def j15_suppressed_sources(led):
    # Amounts in thousands, so that schedules of either side meet.
    rounded = led.schedules.withColumn("amount", (F.round(F.col("amount").cast("double") / 1000) * 1000).cast("decimal(18,2)"))
    return schedules.suppressed_sources(rounded, led.accounts)


_POS = f"""po AS (SELECT account_id, t.instrument_id, CAST(sum(quantity) AS DECIMAL(38,6)) AS quantity, CAST(sum(CASE WHEN quantity > 0 THEN proceeds ELSE -proceeds END) AS {M}) AS cost FROM trades t GROUP BY 1, 2),
pv AS (SELECT account_id, po.instrument_id, quantity, cost, CAST(round(CAST(quantity AS DECIMAL(18,2)) * CAST(price AS DECIMAL(18,2)), 2) AS {M}) AS value FROM po JOIN prices USING (instrument_id))"""


@query(f"WITH {_POS} SELECT *, CAST(value - cost AS {M}) AS gain FROM pv", "trades prices")
def a30_positions(led):
    return jobs.positions(led.trades, led.prices)


@query(f"WITH {_POS} SELECT account_id, count(*) AS n, CAST(sum(value) AS {M}) AS value, CAST(sum(cost) AS {M}) AS cost, CAST(sum(value - cost) AS {M}) AS gain FROM pv GROUP BY 1", "trades prices")
def a31_portfolio_totals(led):
    return jobs.portfolio_totals(jobs.positions(led.trades, led.prices))


@query(
    """WITH d AS (SELECT account_id, instrument_id, CAST(trade_ts AS DATE) AS day, CAST(sum(quantity) AS DECIMAL(38,6)) AS change FROM trades GROUP BY 1, 2, 3)
SELECT *, CAST(sum(change) OVER (PARTITION BY account_id, instrument_id ORDER BY day) AS DECIMAL(38,6)) AS held FROM d""",
    "trades",
)
def w4_holdings_history(led):
    return jobs.holdings_history(led.trades)


@query(
    """WITH m AS (SELECT base_currency, rate_date, ln(CAST(rate AS DOUBLE) / CAST(lag(rate) OVER (PARTITION BY base_currency ORDER BY rate_date) AS DOUBLE)) AS r FROM rates)
SELECT base_currency, count(*) AS n, round(avg(r), 9) AS mean, round(stddev_pop(r), 9) AS deviation FROM m WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) >= 3""",
    "rates",
)
def a35_return_stats(led):
    return jobs.return_stats(led.rates, "base_currency", "rate_date", "rate")


@query(
    """WITH l AS (SELECT account_id, CAST(statement_balance AS DOUBLE) AS principal, 0.004::DOUBLE AS rate, CAST(statement_balance AS DOUBLE) / 90 + 1 AS payment FROM accounts WHERE account_type = 'mortgage'), g AS (SELECT *, CAST(i + 1 AS INTEGER) AS month, pow(1 + rate, i + 1) AS grow FROM l, range(120) x(i) WHERE payment > principal * rate)
SELECT account_id, month, greatest(0.0::DOUBLE, round(principal * grow - payment * (grow - 1) / rate, 4)) AS balance FROM g""",
    "accounts",
)
def x19_amortise(led):
    principal = F.col("statement_balance").cast("double")
    loans = led.accounts.filter("account_type = 'mortgage'").select("account_id", principal.alias("principal"), F.lit(0.004).alias("rate"), (principal / 90 + 1).alias("payment"))
    return jobs.amortise(loans, 120)


_QUALITY = f"""qq AS (SELECT 'future_dated' AS "check", 'blocker' AS severity, count(*) AS n FROM transactions WHERE CAST(ts AS DATE) > DATE '{AS_OF}' UNION ALL SELECT 'without_account', 'blocker', count(*) FROM transactions WHERE account_id NOT IN (SELECT account_id FROM accounts)
 UNION ALL SELECT 'unsplit', 'warning', count(*) FROM transactions WHERE txn_id NOT IN (SELECT txn_id FROM splits) UNION ALL SELECT 'zero_amount', 'warning', count(*) FROM transactions WHERE amount = 0
 UNION ALL SELECT 'empty_description', 'warning', count(*) FROM transactions WHERE coalesce(description, '') = '' UNION ALL SELECT 'statement_stale', 'warning', count(*) FROM accounts WHERE date_diff('day', statement_balance_as_of, DATE '{AS_OF}') > 45)"""


@query(f"WITH {_QUALITY} SELECT * FROM qq", "transactions splits accounts")
def a26_data_quality(led):
    return jobs.data_quality(led.transactions, led.splits, led.accounts, AS_OF)


@query(f"SELECT account_id, CAST(max(ts) AS DATE) AS last FROM transactions JOIN accounts USING (account_id) GROUP BY 1 HAVING date_diff('day', CAST(max(ts) AS DATE), DATE '{AS_OF}') > 30", "transactions accounts")
def a27_stale_accounts(led):
    return jobs.stale_accounts(led.accounts, led.transactions, AS_OF)


@query(
    r"""WITH p AS (SELECT lower(trim(regexp_replace(regexp_replace(regexp_replace(description, '\d+', '', 'g'), '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g'))) AS pattern, user_id, category_id, ts, txn_id FROM transactions JOIN accounts USING (account_id))
SELECT pattern, user_id, category_id, hits FROM (SELECT *, count(*) OVER (PARTITION BY pattern, user_id) AS hits, row_number() OVER (PARTITION BY pattern, user_id ORDER BY ts DESC, txn_id DESC) AS n FROM p WHERE pattern <> '') WHERE n = 1""",
    "transactions accounts",
)
def c2_learn_rules(led):
    rows = led.transactions.join(led.accounts.select("account_id", "user_id"), "account_id").withColumn("pattern", text.grouping_key(F.col("description")))
    return jobs.learn_rules(rows)


_BLANK = "SELECT txn_id, account_id, CASE WHEN category_id = 3 THEN NULL ELSE category_id END AS category_id FROM transactions"


@query(f"WITH t AS ({_BLANK}) SELECT txn_id, account_id FROM t WHERE category_id IS NULL AND txn_id NOT IN (SELECT txn_id FROM splits WHERE category_id = 2)", "transactions splits")
def f3_uncategorised(led):
    txns = led.transactions.withColumn("category_id", F.when(F.col("category_id") != 3, F.col("category_id")))
    labelled = led.splits.withColumn("category_id", F.when(F.col("category_id") == 2, F.col("category_id")))
    return spend.uncategorised(txns, labelled).select("txn_id", "account_id")


@query(
    "SELECT strftime(ts, '%Y-%m') AS month FROM transactions JOIN splits USING (txn_id) WHERE counts_as_true_spend UNION SELECT strftime(ts, '%Y-%m') FROM transactions WHERE amount > 0 AND NOT is_transfer",
    "transactions splits",
)
def u4_months_union(led):
    """Months with spend or with income."""
    month = F.date_format("ts", "yyyy-MM").alias("month")
    spent = led.transactions.join(led.splits.filter("counts_as_true_spend").select("txn_id"), "txn_id", "left_semi").select(month)
    return spent.union(led.transactions.filter("amount > 0 and not is_transfer").select(month)).distinct()


@query(
    "SELECT txn_id, account_id, is_transfer OR (amount > 0 AND NOT is_asset AND regexp_matches(lower(description), 'payment|pymt|pmt|autopay|auto pay|thank you')) AS is_transfer FROM moves",
    "moves",
)
def f7_flag_payment_rows(led):
    owned = led.moves.select("account_id", "is_asset").distinct()
    return jobs.flag_payment_rows(led.moves.drop("is_asset"), owned)


@query(
    """WITH r AS (SELECT * FROM rates JOIN (SELECT base_currency, max(rate_date) AS newest FROM rates GROUP BY 1) USING (base_currency) WHERE rate_date > newest - 3650), g AS (SELECT base_currency, min(rate_date) AS first, max(rate_date) AS last, CAST(arg_min(rate, rate_date) AS DOUBLE) AS a, CAST(arg_max(rate, rate_date) AS DOUBLE) AS b FROM r GROUP BY 1)
SELECT base_currency, first, last, round(pow(b / a, 365.25 / date_diff('day', first, last)) - 1, 9) AS growth FROM g WHERE date_diff('day', first, last) >= 1095""",
    "rates",
)
def a36_index_growth(led):
    return jobs.index_growth(led.rates, "base_currency", "rate_date", "rate")


def _candidates(led):
    return pairs.detect_transfers(led.feed, "household_id")


@query()
def j8_resolve_links(led):
    return links.resolve_links(_candidates(led))


@query()
def j7_suggest_reconciliation(led):
    return links.suggest_reconciliation(_candidates(led), led.feed.filter("txn_id % 11 = 0"))


@query()
def j11_reconcile_placeholders(led):
    return links.reconcile_placeholders(led.feed.filter("txn_id % 9 = 0").withColumn("confirmed", F.expr("txn_id % 2 = 0")), led.feed.filter("txn_id % 9 <> 0"))


@query(
    """WITH n AS (SELECT account_id, CAST(ts AS DATE) AS day, amount, txn_id, txn_id % 3 AS part FROM feed WHERE txn_id % 3 = 1 OR (txn_id % 3 = 2 AND txn_id % 2 = 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY part, account_id, day, amount ORDER BY txn_id) AS n FROM n)
SELECT k.txn_id, g.txn_id AS from_id, g.amount AS balance_after FROM r k JOIN r g ON k.account_id = g.account_id AND k.day = g.day AND k.amount = g.amount AND k.n = g.n WHERE k.part = 2 AND g.part = 1""",
    "feed",
)
def j12_carry_balance(led):
    held = led.feed.withColumn("balance_after", F.when((F.col("txn_id") % 3 == 1) | (F.col("txn_id") % 2 == 0), F.col("amount")))
    return links.carry_balance(held.filter("txn_id % 3 = 1"), held.filter("txn_id % 3 = 2"))


@query(f"WITH g AS ({_GROUPS}) SELECT * FROM g WHERE EXISTS (SELECT 1 FROM feed f WHERE f.txn_id % 10 = 0 AND f.account_id = g.account_id AND CAST(f.ts AS DATE) = g.day AND f.amount = g.amount)", "feed")
def j17_dismissed_groups(led):
    return links.dismissed_groups(led.feed, _dismissed(led))


@query(
    """WITH f AS (SELECT txn_id, account_id, CAST(ts AS DATE) AS day, amount FROM feed), l AS (SELECT * FROM f WHERE txn_id % 4 <> 2), x AS (SELECT DISTINCT account_id, day, amount FROM f WHERE txn_id % 10 = 0),
t AS (SELECT account_id, day, amount, min(txn_id) AS b FROM l GROUP BY 1, 2, 3)
SELECT f.txn_id AS a, t.b, TRUE AS same FROM f JOIN t USING (account_id, day, amount) WHERE f.txn_id % 4 = 2 UNION ALL SELECT min(txn_id), max(txn_id), FALSE FROM l JOIN x USING (account_id, day, amount) GROUP BY account_id, day, amount HAVING count(*) >= 2""",
    "feed",
)
def j18_training_pairs(led):
    return links.training_pairs(led.feed.filter("txn_id % 4 = 2"), led.feed.filter("txn_id % 4 <> 2"), _dismissed(led))


_COMPONENTS = f"""py AS (SELECT txn_id, account_id, ts, amount FROM transactions JOIN accounts USING (account_id) WHERE NOT is_asset AND amount > 0),
cp AS (SELECT txn_id, spend_type, -amount_native AS part FROM splits), pc AS (SELECT py.txn_id, account_id, ts, amount, CAST(coalesce(sum(part) FILTER (spend_type = 'fixed_core'), 0) AS {M}) AS principal,
 CAST(coalesce(sum(part) FILTER (spend_type = 'debt_cost'), 0) AS {M}) AS interest, CAST(coalesce(sum(part) FILTER (spend_type = 'lifestyle'), 0) AS {M}) AS escrow, count(part) AS n_components FROM py LEFT JOIN cp ON cp.txn_id = py.txn_id GROUP BY 1, 2, 3, 4)"""


def _payments(led):
    component = F.when(F.col("spend_type") == "fixed_core", "principal").when(F.col("spend_type") == "debt_cost", "interest").otherwise("escrow")
    parts = led.splits.select("txn_id", component.alias("component"), (-F.col("amount_native")).alias("part"))
    paid = led.transactions.filter("amount > 0").join(led.accounts.filter("not is_asset").select("account_id"), "account_id")
    return links.payments_with_components(paid, parts)


@query(f"WITH {_COMPONENTS} SELECT * FROM pc", "transactions accounts splits")
def j19_payments_with_components(led):
    return _payments(led)


@query(f"WITH {_COMPONENTS} SELECT txn_id, CAST(principal + interest + escrow AS {M}) AS parts, abs(abs(principal + interest + escrow) - abs(amount)) <= 0.01 AS valid FROM pc WHERE n_components > 0", "transactions accounts splits")
def a23_validate_decomposition(led):
    return links.validate_decomposition(_payments(led))


@query(f"WITH {_COMPONENTS} SELECT account_id, count(*) AS n, CAST(sum(principal) AS {M}) AS principal, CAST(sum(interest) AS {M}) AS interest, CAST(sum(escrow) AS {M}) AS escrow FROM pc WHERE CAST(ts AS DATE) >= DATE '2000-01-01' GROUP BY 1", "transactions accounts splits")
def a34_payment_breakdown(led):
    return links.payment_breakdown(_payments(led), "2000-01-01")


@query(f"SELECT outcome, count(*) AS n FROM ({ORACLES['j10_dedupe_against_ledger']}) GROUP BY 1")
def i12_import_counts(led):
    return updates.import_counts(j10_dedupe_against_ledger(led))


@query("SELECT instrument_id, symbol_name, price FROM prices", "prices")
def i16_upsert_dimension(led):
    # Known instruments lack some names and prices, which the rows seen fill.
    gaps = {"symbol_name": F.when(F.col("instrument_id") % 5 != 0, F.col("symbol_name")), "price": F.when(F.col("instrument_id") % 4 != 0, F.col("price"))}
    return updates.upsert_dimension(led.prices.filter("instrument_id % 3 <> 0").withColumns(gaps), led.prices, "instrument_id", ["symbol_name", "price"])


_NEWEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY val_date DESC, valuation_id DESC) AS n FROM {0}) WHERE n = 1"


@query(f"WITH v AS ({_NEWEST.format('valuations')}) SELECT a.account_id, coalesce(v.value, a.current_value) AS current_value, v.val_date AS value_as_of FROM accounts a LEFT JOIN v ON v.account_id = a.account_id", "accounts valuations")
def b10_sync_current_value(led):
    return updates.sync_current_value(led.accounts, led.valuations)


@query(
    """SELECT txn_id, CASE WHEN contains(lower(description), 'purchase') AND amount < 0 THEN 'shopping' WHEN contains(lower(description), 'signup') AND amount >= 0 THEN 'income'
 WHEN contains(lower(description), 'ref 1000') THEN 'transfer' WHEN contains(lower(description), 'view') THEN 'browsing' END AS category FROM feed""",
    "feed",
)
def x13_keyword_category(led):
    known = [("ref 1000", "any", "transfer"), ("purchase", "out", "shopping"), ("signup", "in", "income"), ("view", "any", "browsing")]
    return led.feed.select("txn_id", updates.keyword_category(F.col("description"), F.col("amount"), known).alias("category"))


_PATTERN = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(description, '\d+', '', 'g'), '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g')))"


@query(
    f"""WITH r AS ({ORACLES['c2_learn_rules']}), m AS (SELECT {_PATTERN} AS pattern, user_id, count(*) AS n FROM transactions JOIN accounts USING (account_id) WHERE CAST(ts AS DATE) >= DATE '2001-01-01' GROUP BY 1, 2)
SELECT r.pattern, r.user_id, r.category_id, r.hits + coalesce(m.n, 0) AS hits FROM r LEFT JOIN m ON m.pattern = r.pattern AND m.user_id = r.user_id""",
    "transactions accounts",
)
def c4_rule_hits(led):
    matched = led.transactions.filter("to_date(ts) >= '2001-01-01'").join(led.accounts.select("account_id", "user_id"), "account_id").withColumn("pattern", text.grouping_key(F.col("description")))
    return updates.rule_hits(c2_learn_rules(led), matched, ["pattern", "user_id"])


@query(f"WITH {_PROJECTED} SELECT * FROM pd WHERE NOT (payment_id % 3 = 0 AND due < DATE '2001-12-31')", "schedules")
def c6_post_occurrences(led):
    due = schedules.project_schedule(led.schedules, "2002-07-31")
    return updates.post_occurrences(due, due.filter("payment_id % 3 = 0 and due < '2001-12-31'").select("payment_id", "due")).select("payment_id", "account_id", "due", "amount")


@query(
    f"""WITH {_PROJECTED}, l AS (SELECT payment_id, max(due) AS d FROM pd WHERE due <= DATE '2001-12-31' GROUP BY 1)
SELECT payment_id, CAST(greatest(next_due, CASE frequency WHEN 'weekly' THEN d + to_days(7) WHEN 'biweekly' THEN d + to_days(14) WHEN 'monthly' THEN d + to_months(1) WHEN 'quarterly' THEN d + to_months(3) ELSE d + to_months(12) END) AS DATE) AS next_due FROM schedules LEFT JOIN l USING (payment_id)""",
    "schedules",
)
def c6_advance(led):
    return updates.advance(led.schedules, schedules.project_schedule(led.schedules, "2001-12-31"))


@query(f"SELECT a, b, CASE WHEN a % 3 = 0 THEN 'accepted' ELSE 'open' END AS state FROM ({ORACLES['j9_near_duplicates']}) WHERE a % 3 <> 0 OR a % 2 = 0")
def c7_resolve_proposals(led):
    offered = j9_near_duplicates(led).select("a", "b")
    decided = offered.filter("a % 3 = 0").withColumn("accepted", F.col("a") % 2 == 0)
    taken, still = updates.resolve_proposals(offered, decided, ["a", "b"])
    return taken.withColumn("state", F.lit("accepted")).unionByName(still.withColumn("state", F.lit("open")))


@query(f"WITH v AS ({_NEWEST.format('valuations')}) SELECT account_id, -value AS amount, val_date AS next_due FROM v WHERE account_id % 4 <> 0", "valuations")
def c8_statement_schedules(led):
    statements = led.valuations.select("account_id", F.col("valuation_id").alias("statement_id"), F.col("val_date").alias("due"), (-F.col("value")).alias("amount"))
    return updates.statement_schedules(statements, led.accounts.filter("account_id % 4 = 0"))


@query(
    f"""WITH {_CLASSED}, c AS (SELECT txn_id, {_META} AS kind FROM k WHERE txn_id % 5 = 0)
SELECT s.txn_id, split_no, CASE WHEN split_no <> 1 AND kind IS NOT NULL THEN kind ELSE spend_type END AS spend_type, CASE WHEN split_no <> 1 AND kind IS NOT NULL THEN kind <> 'non_spend_cash_use' ELSE counts_as_true_spend END AS counts FROM splits s LEFT JOIN c ON c.txn_id = s.txn_id""",
    "transactions accounts splits",
)
def x23_cascade_event(led):
    changed = jobs.classify_all(led.transactions, led.accounts).filter("txn_id % 5 = 0")
    out = updates.cascade_event(led.splits.withColumn("linked", F.col("split_no") == 1), changed)
    return out.select("txn_id", "split_no", "spend_type", F.col("counts_as_true_spend").alias("counts"))


@query(
    "SELECT txn_id, split_no, category_id, amount_native, split_no = 1 AS linked FROM splits WHERE split_no = 1 OR txn_id NOT IN (SELECT txn_id FROM transactions WHERE txn_id % 50 = 0) UNION ALL SELECT txn_id, 100, category_id, amount, FALSE FROM transactions WHERE txn_id % 50 = 0",
    "transactions splits",
)
def x24_replace_splits(led):
    manual = led.transactions.filter("txn_id % 50 = 0").select("txn_id", F.lit(100).alias("split_no"), "category_id", F.col("amount").alias("amount_native"))
    return updates.replace_splits(led.splits.select("txn_id", "split_no", "category_id", "amount_native", (F.col("split_no") == 1).alias("linked")), manual)


@query("SELECT payment_id, account_id % 7 <> 0 AS active, CASE WHEN account_id % 7 <> 0 THEN next_due END AS next_due FROM schedules", "schedules")
def x25_flag_closed(led):
    return updates.flag_closed(led.schedules, led.accounts.filter("account_id % 7 = 0")).select("payment_id", "active", "next_due")


@query(
    f"""WITH c AS (SELECT DISTINCT account_id, val_date AS day FROM valuations), p AS (SELECT account_id, CAST(ts AS DATE) AS day, amount FROM feed WHERE description LIKE 'signup%')
SELECT c.account_id, c.day, CAST(coalesce(sum(p.amount), 0) AS {M}) AS received FROM c LEFT JOIN p ON p.account_id = c.account_id AND p.day <= c.day GROUP BY 1, 2""",
    "valuations feed",
)
def w5_dividends_to_date(led):
    pays = led.feed.filter("description like 'signup%'").select("account_id", F.to_date("ts").alias("day"), "amount")
    return updates.dividends_to_date(pays, led.valuations.select("account_id", F.col("val_date").alias("day")))


# The valuations are younger than all rates; 23 years earlier they meet them.
_EARLIER = "ev AS (SELECT valuation_id, account_id, CAST(val_date - to_months(276) AS DATE) AS val_date, value FROM valuations)"


def _earlier(led):
    return led.valuations.withColumn("val_date", F.add_months("val_date", -276))


# The nearest rate of each (currency, day) in q.
_NEAR = """nr AS (SELECT * FROM (SELECT q.*, CAST(r.rate AS DOUBLE) AS rate, row_number() OVER (PARTITION BY q.currency, q.day ORDER BY abs(date_diff('day', r.rate_date, q.day)), r.rate_date DESC) AS k
 FROM q JOIN rates r ON r.base_currency = q.currency AND abs(date_diff('day', r.rate_date, q.day)) <= 30) WHERE k = 1)"""


@query(
    f"""WITH {_EARLIER}, v AS ({_NEWEST.format('ev')}), w AS (SELECT a.account_id, a.currency, v.value, v.val_date AS day FROM accounts a JOIN v ON v.account_id = a.account_id), q AS (SELECT DISTINCT currency, day FROM w WHERE currency <> 'USD'), {_NEAR},
z AS (SELECT w.*, CASE WHEN w.currency = 'USD' THEN 1.0::DOUBLE ELSE nr.rate END AS fx_rate FROM w LEFT JOIN nr ON nr.currency = w.currency AND nr.day = w.day)
SELECT account_id, value, day AS val_date, fx_rate, CAST(round(CAST(value AS DOUBLE) * coalesce(fx_rate, 1.0::DOUBLE) * 100) AS BIGINT) AS cents FROM z""",
    "accounts valuations rates",
)
def b11_valuation_in_base(led):
    return change.valuation_in_base(led.accounts, _earlier(led), led.rates)


@query(
    f"""WITH {_EARLIER}, dd AS (SELECT unnest([DATE '2001-01-05', DATE '2001-01-25']) AS day), q AS (SELECT DISTINCT currency, day FROM accounts CROSS JOIN dd WHERE currency <> 'USD'), {_NEAR},
mk AS (SELECT * FROM (SELECT v.account_id, dd.day, v.value, row_number() OVER (PARTITION BY v.account_id, dd.day ORDER BY v.val_date DESC, v.valuation_id DESC) AS n FROM ev v JOIN dd ON v.val_date <= dd.day) WHERE n = 1),
z AS (SELECT a.account_id, a.user_id, dd.day, CAST(round(CAST(mk.value AS DOUBLE) * CASE WHEN a.currency = 'USD' THEN 1.0::DOUBLE ELSE nr.rate END * 100) AS BIGINT) AS c FROM accounts a CROSS JOIN dd
 LEFT JOIN mk ON mk.account_id = a.account_id AND mk.day = dd.day LEFT JOIN nr ON nr.currency = a.currency AND nr.day = dd.day WHERE a.is_asset),
w AS (SELECT account_id, user_id, max(c) FILTER (day = DATE '2001-01-25') - max(c) FILTER (day = DATE '2001-01-05') AS moved FROM z GROUP BY 1, 2)
SELECT user_id, CAST(coalesce(sum(moved), 0) AS BIGINT) AS moved, count(moved) AS n_used, count(*) FILTER (moved IS NULL) AS n_skipped, CAST(CASE WHEN count(*) FILTER (moved IS NULL) > count(moved) THEN 0.6 ELSE 0.75 END AS DOUBLE) AS confidence FROM w GROUP BY 1""",
    "accounts valuations rates",
)
def a17_market_movement(led):
    return change.market_movement(led.accounts, _earlier(led), led.rates, "2001-01-05", "2001-01-25")


@query(
    f"""WITH dd AS (SELECT unnest([DATE '2000-06-30', DATE '{AS_OF}']) AS day), q AS (SELECT DISTINCT currency, day FROM accounts CROSS JOIN dd WHERE currency <> 'USD'), {_NEAR},
t AS (SELECT account_id, CAST(sum(amount) AS {M}) AS total FROM transactions WHERE CAST(ts AS DATE) <= DATE '{AS_OF}' GROUP BY 1)
SELECT user_id, CAST(sum(CAST(round(CAST(total AS DOUBLE) * (e.rate - s.rate) * 100) AS BIGINT)) AS BIGINT) AS moved, count(*) AS n_used, CAST(least(85, 45 + 5 * count(*)) AS INTEGER) AS confidence_pct
FROM accounts a JOIN t ON t.account_id = a.account_id JOIN nr s ON s.currency = a.currency AND s.day = DATE '2000-06-30' JOIN nr e ON e.currency = a.currency AND e.day = DATE '{AS_OF}' GROUP BY 1""",
    "accounts transactions rates",
)
def a18_fx_translation(led):
    return change.fx_translation(led.accounts, led.transactions, led.rates, "2000-06-30", AS_OF)


@query("SELECT txn_id, CAST(ts AS DATE) AS day, amount, description FROM feed", "feed")
def i5_normalise_rows(led):
    # The feed as a bank prints it: days and amounts as text, outflows in parentheses.
    printed = F.format_number(F.abs("amount"), 2)
    cell = F.when(F.col("amount") < 0, F.concat(F.lit("($"), printed, F.lit(")"))).otherwise(F.concat(F.lit("$"), printed))
    rows = led.feed.select("txn_id", F.date_format("ts", "dd/MM/yyyy").alias("Date"), "description", cell.alias("Amount"))
    found = statements.normalise_rows(rows, {"date": "Date", "description": "description", "amount": "Amount"})
    return found.select("txn_id", "day", F.col("parsed").alias("amount"), F.col("text").alias("description"))
