"""Queries of reports, statements, documents and quality, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from talliver.functions import text
from talliver.operators import balances as B
from talliver.operators import ledger_jobs as jobs
from talliver.operators import links, reports, settle, spend
from talliver.plans.queries import _ALL, _CLASSED, _COMPONENTS, _TWO_DAYS, AS_OF, ORACLES, M, _earlier, _payments, balances_sql, change, dates, found_balances, query

START = "2000-06-30"
_CENTS = "CAST(coalesce(round(value_base * 100), 0.0) AS BIGINT)"
_NET = f"""CAST(sum(CASE WHEN is_asset THEN {_CENTS} ELSE 0 END) AS BIGINT) AS assets, CAST(sum(CASE WHEN NOT is_asset THEN {_CENTS} ELSE 0 END) AS BIGINT) AS liabilities,
 CAST(sum(CASE WHEN is_asset THEN {_CENTS} ELSE -{_CENTS} END) AS BIGINT) AS net"""


@query(
    balances_sql(_TWO_DAYS)
    + f"""SELECT user_id, as_of, {_NET}, count(*) AS n_accounts, count(*) FILTER (stale) AS n_stale, count(*) FILTER (confidence < 0.5) AS n_low,
 greatest(0.0::DOUBLE, CAST(count(*) - count(*) FILTER (stale) - count(*) FILTER (confidence < 0.5) AS DOUBLE) / count(*)) AS confidence FROM bal GROUP BY 1, 2""",
    _ALL,
)
def a14_household_totals(led):
    return B.household_totals(found_balances(led, dates(led, "1999-12-31", AS_OF)))


_SUMS = ", ".join(f"CAST(coalesce(sum(CASE WHEN event_type IN ({', '.join(f"'{k}'" for k in kinds)}) THEN amount END), 0) * 100 AS BIGINT) AS {part}" for part, kinds in reports.PARTS.items())
_MARKET = ORACLES["a17_market_movement"].replace("2001-01-05", START).replace("2001-01-25", AS_OF)


@query(
    balances_sql(_TWO_DAYS.replace("1999-12-31", START))
    + f""", nw AS (SELECT user_id, as_of, {_NET} FROM bal GROUP BY 1, 2), ends AS (SELECT user_id, max(net) FILTER (as_of = DATE '{START}') AS nw_start, max(net) FILTER (as_of = DATE '{AS_OF}') AS nw_end FROM nw GROUP BY 1),
{_CLASSED}, sums AS (SELECT user_id, {_SUMS} FROM k JOIN accounts USING (account_id) WHERE CAST(ts AS DATE) BETWEEN DATE '{START}' AND DATE '{AS_OF}' GROUP BY 1),
parts AS (SELECT ends.*, nw_end - nw_start AS change, {", ".join(f"coalesce({p}, 0) AS {p}" for p in reports.PARTS)}, coalesce(mk.moved, 0) AS market_movement, coalesce(fx.moved, 0) AS fx_movement,
 coalesce(mk.confidence, 0.0) AS market_confidence, coalesce(fx.confidence_pct, 0) AS fx_confidence_pct
 FROM ends LEFT JOIN sums USING (user_id) LEFT JOIN ({_MARKET}) mk USING (user_id) LEFT JOIN ({ORACLES["a18_fx_translation"]}) fx USING (user_id))
SELECT *, change - {" - ".join([*reports.PARTS, "market_movement", "fx_movement"])} AS unexplained FROM parts""",
    _ALL,
)
def a16_attribute_change(led):
    market = change.market_movement(led.accounts, _earlier(led), led.rates, START, AS_OF)
    fx = change.fx_translation(led.accounts, led.transactions, led.rates, START, AS_OF)
    return reports.attribute_change(found_balances(led, dates(led, START, AS_OF)), jobs.classify_all(led.transactions, led.accounts), led.accounts, market, fx, START, AS_OF)


# Amounts and rates have two decimals, so cents are whole numbers of a hundredth; halves go to even.
_GROUPS = f"""pb AS (SELECT DISTINCT m.currency, g.as_of AS day FROM members m JOIN recon_groups g USING (group_id)),
nr AS (SELECT currency, day, rate FROM (SELECT pb.*, rate, row_number() OVER (PARTITION BY currency, day ORDER BY abs(date_diff('day', day, rate_date)), rate_date DESC) AS n FROM pb JOIN rates ON base_currency = currency AND abs(date_diff('day', day, rate_date)) <= 30) WHERE n = 1),
mm AS (SELECT m.*, g.excludes_fees, g.fx_treatment, CAST(round(m.amount * 100) AS BIGINT) * CAST(round(nr.rate * 100) AS BIGINT) AS x FROM members m JOIN recon_groups g USING (group_id) LEFT JOIN nr ON nr.currency = m.currency AND nr.day = g.as_of),
mb AS (SELECT *, coalesce(amount_base, CASE WHEN currency = 'USD' THEN amount WHEN fx_treatment <> 'none' THEN CAST(sign(x) * (abs(x) // 100 + CASE WHEN abs(x) % 100 > 50 OR (abs(x) % 100 = 50 AND abs(x) // 100 % 2 = 1) THEN 1 ELSE 0 END) AS DECIMAL(38,2)) / 100 END) AS base FROM mm WHERE NOT (excludes_fees AND is_fee)),
sm AS (SELECT group_id, CAST(sum(CAST(base AS {M})) AS {M}) AS net, count(base) AS n_converted, count(*) FILTER (base IS NULL) AS n_missing FROM mb GROUP BY 1), kc AS (SELECT group_id, count(DISTINCT currency) AS n_currencies FROM members GROUP BY 1),
vg AS (SELECT group_id, CAST(coalesce(net, 0) AS {M}) AS net, coalesce(n_converted, 0) AS n_converted, coalesce(n_missing, 0) AS n_missing, coalesce(n_currencies, 0) AS n_currencies, abs(coalesce(net, 0)) <= tolerance AS balanced FROM recon_groups LEFT JOIN sm USING (group_id) LEFT JOIN kc USING (group_id))"""


@query(f"WITH {_GROUPS} SELECT * FROM vg", "members recon_groups rates")
def a24_validate_groups(led):
    return reports.validate_groups(led.recon_groups, led.members, led.rates)


_AGES = f"""ag AS (SELECT a.account_id, CASE WHEN balance_truth_source IN ('latest_statement', 'hybrid', 'liability_balance') THEN date_diff('day', statement_balance_as_of, DATE '2001-08-20') > 45
  WHEN balance_truth_source = 'manual_mark' THEN a.account_id % 2 = 1 WHEN balance_truth_source = 'latest_valuation' THEN v.marked IS NULL OR date_diff('day', v.marked, DATE '2001-08-20') > 90 ELSE FALSE END AS stale,
 currency <> 'USD' AND coalesce(date_diff('day', (SELECT max(rate_date) FROM rates WHERE base_currency = currency), DATE '2001-08-20') > 7, TRUE) AS rate_stale,
 NOT is_asset AND date_diff('day', statement_balance_as_of, DATE '2001-08-20') > 60 AS aged FROM accounts a LEFT JOIN (SELECT account_id, max(val_date) AS marked FROM valuations GROUP BY 1) v USING (account_id))"""


def _ages(led):
    marked = led.accounts.withColumn("value_as_of", F.when(F.col("account_id") % 2 == 0, F.col("statement_balance_as_of")))
    return reports.account_ages(marked, led.valuations, led.rates, "2001-08-20")


@query(f"WITH {_AGES} SELECT * FROM ag", "accounts valuations rates")
def b_account_ages(led):
    return _ages(led)


_COUNTERS = f"""{_CLASSED}, {_GROUPS}, {_AGES},
tx AS (SELECT k.txn_id, event_type, CASE WHEN k.txn_id % 5 <> 0 THEN 1 END AS category, k.txn_id % 11 = 0 AS low, t.is_transfer AND k.txn_id % 3 <> 0 AS open FROM k JOIN transactions t ON t.txn_id = k.txn_id),
tc AS (SELECT count(*) AS total, count(*) FILTER (category IS NULL) AS u, count(*) FILTER (event_type = 'unclassified' OR event_type IS NULL) AS ev, count(*) FILTER (low) AS lo, count(*) FILTER (open) AS op,
 count(*) FILTER (txn_id NOT IN (SELECT txn_id FROM splits WHERE split_no = 2)) AS un, count(*) FILTER (event_type IN ('liability_payment', 'mortgage_payment') AND txn_id NOT IN (SELECT txn_id FROM splits WHERE split_no = 3)) AS de FROM tx),
ac AS (SELECT count(*) FILTER (stale) AS st, count(*) FILTER (rate_stale) AS fx, count(*) FILTER (aged) AS age FROM ag), gc AS (SELECT count(*) FILTER (n_currencies > 1 AND n_missing > 0) AS gap FROM vg),
cc AS (SELECT 'uncategorized' AS "check", u AS n, CASE WHEN total = 0 OR u > total * 0.5 THEN 1 ELSE 0 END AS blockers, CASE WHEN u > total * 0.1 AND u <= total * 0.5 THEN 1 ELSE 0 END AS warnings FROM tc
 UNION ALL SELECT 'unresolved_reconciliation', op, CASE WHEN op > 10 THEN 1 ELSE 0 END, CASE WHEN op BETWEEN 1 AND 10 THEN 1 ELSE 0 END FROM tc UNION ALL SELECT 'reconciliation_fx_gap', gap, gap, 0 FROM gc
 UNION ALL SELECT 'unclassified', ev, 0, CAST(ev > 0 AS INTEGER) FROM tc UNION ALL SELECT 'low_confidence', lo, 0, CAST(lo > 0 AS INTEGER) FROM tc UNION ALL SELECT 'unsplit', un, 0, CAST(un > 0 AS INTEGER) FROM tc
 UNION ALL SELECT 'without_decomposition', de, 0, CAST(de > 0 AS INTEGER) FROM tc UNION ALL SELECT 'stale_valuation', st, 0, st FROM ac UNION ALL SELECT 'missing_fx', fx, 0, fx FROM ac UNION ALL SELECT 'aged_liability', age, 0, age FROM ac)"""


def _counters(led):
    rows = jobs.classify_all(led.transactions, led.accounts).select("txn_id", "event_type").join(led.transactions.select("txn_id", "is_transfer"), "txn_id")
    rows = rows.select("txn_id", "event_type", F.when(F.col("txn_id") % 5 != 0, 1).alias("category_id"), F.when(F.col("txn_id") % 11 == 0, 0.4).otherwise(0.9).alias("confidence"), "is_transfer", (F.col("txn_id") % 3 == 0).alias("linked"))
    groups = reports.validate_groups(led.recon_groups, led.members, led.rates)
    return reports.quality_counters(rows, led.splits.filter("split_no = 2"), led.splits.filter("split_no = 3"), _ages(led), groups)


_SEEN = "transactions accounts splits members recon_groups rates valuations"


@query(f'WITH {_COUNTERS} SELECT "check", n, CAST(blockers AS BIGINT) AS blockers, CAST(warnings AS BIGINT) AS warnings FROM cc', _SEEN)
def a26_quality_counters(led):
    return _counters(led)


@query("SELECT account_id, count(*) AS n, " + ", ".join(f"CAST(sum({c}) AS {M}) AS {c}" for c in ("gross", "taxes", "retirement", "benefits")) + f", CAST(sum(gross - taxes - retirement - benefits) AS {M}) AS net FROM paychecks WHERE pay_date BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' GROUP BY 1", "paychecks")
def a28_paycheck_summary(led):
    return reports.paycheck_summary(led.paychecks.withColumn("net", F.expr("gross - taxes - retirement - benefits")), 2024)


@query("SELECT *, CAST(row_number() OVER (PARTITION BY account_id ORDER BY pay_date DESC, paycheck_id DESC) AS INTEGER) AS place FROM paychecks QUALIFY place <= 12", "paychecks")
def k6_doc_series(led):
    return reports.document_series(led.paychecks, 12)


_KIND = "CAST(coalesce(sum(CASE WHEN kind = '{0}' THEN {1} END), 0) AS DECIMAL(38,2))"
_SPENT = "abs(least(amount, 0))"


@query(
    f"""WITH p AS (SELECT document_id, {_KIND.format("income", "greatest(amount, 0)")} AS income, {_KIND.format("expense", _SPENT)} AS expense, {_KIND.format("transfer", _SPENT)} AS owner_draw,
 {_KIND.format("liability", "amount")} AS liability_adjustment FROM doc_lines GROUP BY 1) SELECT *, CAST(income - expense AS {M}) AS net_operating_income FROM p""",
    "doc_lines",
)
def a29_property_pnl(led):
    return reports.property_pnl(led.doc_lines)


@query(
    f"""WITH h AS (SELECT account_id, instrument_id, CAST(sum(quantity) AS DECIMAL(38,6)) AS quantity, CAST(sum(proceeds) AS {M}) AS cost FROM trades WHERE quantity > 0 GROUP BY 1, 2),
v AS (SELECT h.*, CAST(round(CAST(quantity AS DECIMAL(18,2)) * CAST(price AS DECIMAL(18,2)), 2) AS {M}) AS value FROM h LEFT JOIN prices USING (instrument_id))
SELECT account_id, instrument_id, quantity, cost, CASE WHEN quantity <> 0 THEN CAST(cost AS DOUBLE) / CAST(quantity AS DOUBLE) END AS average_cost, value, CAST(value - cost AS {M}) AS gain,
 CASE WHEN cost <> 0 THEN CAST(value - cost AS DOUBLE) / CAST(cost AS DOUBLE) * 100 END AS gain_pct FROM v""",
    "trades prices",
)
def a30_lot_positions(led):
    return reports.lot_positions(led.trades.filter("quantity > 0").withColumnRenamed("proceeds", "cost"), led.prices)


@query(f"WITH {_COMPONENTS} SELECT account_id, CAST(sum(interest) AS {M}) AS interest FROM pc WHERE CAST(ts AS DATE) BETWEEN DATE '2001-01-01' AND DATE '{AS_OF}' GROUP BY 1", "transactions accounts splits")
def a34_interest_ytd(led):
    return links.interest_to_date(_payments(led), AS_OF)


@query(
    f"""WITH sn AS (SELECT account_id, arg_max(balance, (statement_date, snapshot_id)) AS snap, max(statement_date) AS day FROM snapshots WHERE statement_date <= DATE '2024-01-20' GROUP BY 1),
r AS (SELECT a.account_id, coalesce(snap, nullif(statement_balance, 0), nullif(current_value, 0), 0) AS value, coalesce(sn.day, statement_balance_as_of) AS balance_as_of, snap IS NOT NULL AS has FROM accounts a LEFT JOIN sn USING (account_id) WHERE balance_truth_source = 'latest_statement')
SELECT account_id, CAST(value AS {M}) AS value, balance_as_of, CAST(CASE WHEN date_diff('day', balance_as_of, DATE '2024-01-20') > 45 THEN 0.5 WHEN has THEN 0.95 ELSE 0.9 END AS DOUBLE) AS confidence, date_diff('day', balance_as_of, DATE '2024-01-20') > 45 AS stale FROM r""",
    "accounts snapshots",
)
def b4_statement_balances(led):
    return reports.statement_balances(led.accounts, led.snapshots, "2024-01-20")


@query(
    f"""SELECT account_id, CAST(CASE WHEN account_id % 3 = 1 AND statement_balance <> 0 THEN statement_balance * 2 ELSE coalesce(statement_balance, current_value, 0) END AS {M}) AS value,
 CAST(CASE WHEN account_id % 5 = 0 THEN 0.4 ELSE 0.85 END AS DOUBLE) AS confidence, account_id % 5 = 0 AS stale FROM accounts WHERE balance_truth_source = 'liability_balance'""",
    "accounts",
)
def b6_liability_balances(led):
    known = led.accounts.withColumns({"balance_from": F.when(F.col("account_id") % 3 == 1, "imported_principal_balance"), "principal": (F.col("statement_balance") * 2).cast("decimal(18,2)"), "flagged_stale": F.col("account_id") % 5 == 0})
    return reports.liability_balances(known, "2001-08-01")


@query(
    balances_sql(_TWO_DAYS)
    + """, q AS (SELECT account_id, as_of, currency, currency <> 'USD' AND value <> 0 AS asked, coalesce((SELECT max(rate_date) FROM rates WHERE base_currency = bal.currency AND rate_date <= bal.as_of), (SELECT min(rate_date) FROM rates WHERE base_currency = bal.currency)) AS at FROM bal)
SELECT account_id, as_of, CASE WHEN asked THEN currency || '/USD' END AS fx_pair, CASE WHEN asked THEN "at" END AS fx_rate_date, asked AND coalesce(date_diff('day', "at", as_of) > 7, TRUE) AS fx_stale FROM q""".replace(" AS at FROM", ' AS "at" FROM'),
    _ALL,
)
def b7_fx_finish(led):
    return reports.fx_finish(found_balances(led, dates(led, "1999-12-31", AS_OF)), led.rates)


@query(
    f"""WITH h AS (SELECT account_id, statement_date, arg_max(balance, snapshot_id) AS balance FROM snapshots JOIN accounts USING (account_id) WHERE NOT is_asset GROUP BY 1, 2)
SELECT *, CAST(balance - lag(balance) OVER (PARTITION BY account_id ORDER BY statement_date) AS {M}) AS change FROM h""",
    "accounts snapshots",
)
def b9_liability_history(led):
    return reports.liability_history(led.accounts, led.snapshots)


@query(
    f"""WITH m AS (SELECT DISTINCT account_id, import_batch_id, account_id % 500 + 10 AS principal, account_id % 50 AS interest, account_id % 3 * 5 AS escrow FROM moves WHERE account_id % 7 <> 0),
r AS (SELECT txn_id, m.* FROM moves JOIN m USING (account_id, import_batch_id) WHERE description ILIKE '%payment thank you%' AND txn_id NOT IN (SELECT txn_id FROM splits WHERE split_no = 4)),
p AS (SELECT txn_id, 'principal' AS component, principal AS amount FROM r UNION ALL SELECT txn_id, 'interest', interest FROM r UNION ALL SELECT txn_id, 'escrow', escrow FROM r WHERE escrow > 0)
SELECT txn_id, component, CAST(amount AS {M}) AS amount, CAST(0.8 AS DOUBLE) AS confidence FROM p""",
    "moves splits",
)
def i18_decompose_statement_payments(led):
    a = F.col("account_id")
    meta = led.moves.filter("account_id % 7 <> 0").select("account_id", "import_batch_id").distinct().withColumns({"principal": a % 500 + 10, "interest": a % 50, "escrow": a % 3 * 5, "confidence": F.lit(0.8)})
    return reports.decompose_statement_payments(led.moves, led.splits.filter("split_no = 4"), meta, "payment thank you")


@query("SELECT txn_id, account_id, ts, amount, (SELECT count(*) FROM transactions) AS total FROM transactions ORDER BY ts DESC, txn_id DESC LIMIT 50 OFFSET 100", "transactions")
def k1_page_with_total(led):
    return spend.page_with_total(led.transactions.select("txn_id", "account_id", "ts", "amount"), 100, 50)


_DUE_SIMILAR = "1.0::DOUBLE - CAST(levenshtein({0}, {1}) AS DOUBLE) / greatest(length({0}), length({1}), 1)"
_GROUPED = r"lower(trim(regexp_replace(regexp_replace(regexp_replace({0}, '\d+', '', 'g'), '[^a-zA-Z\s]', ' ', 'g'), '\s+', ' ', 'g')))"


@query(
    f"""WITH s AS (SELECT account_id, amount > 0 AS up, lower(description) AS text, sum(amount) AS total, count(*) AS c FROM moves WHERE CAST(ts AS DATE) >= DATE '2024-02-01' - 183 AND NOT is_transfer AND amount <> 0 GROUP BY 1, 2, 3),
j AS (SELECT payment_id, sum(c) AS n, sum(total) AS total FROM dues d JOIN s ON s.account_id = d.account_id AND s.up = (d.amount >= 0)
 WHERE {_GROUPED.format("s.text")} = {_GROUPED.format("lower(d.description)")} OR {_DUE_SIMILAR.format("s.text", "lower(d.description)")} >= 0.6 GROUP BY 1)
SELECT payment_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(CASE WHEN n >= 2 THEN round(CAST(total AS DOUBLE) / n, 2) ELSE amount END AS {M}) AS amount FROM dues LEFT JOIN j USING (payment_id)""",
    "dues moves",
)
def w6_trailing_average(led):
    return settle.trailing_average(led.dues, led.moves, "2024-02-01", similarity=text.ratio_by_edits)


@query()
def w6_trailing_average_x7(led):
    return settle.trailing_average(led.dues, led.moves, "2024-02-01")


@query(
    """WITH l AS (SELECT account_id, CAST(statement_balance AS DOUBLE) AS owed, 0.004::DOUBLE AS rate, CAST(statement_balance AS DOUBLE) / 90 + 1 AS paid FROM accounts WHERE account_type = 'mortgage' AND statement_balance > 0),
p AS (SELECT *, CAST(ceil(round(-ln(1 - owed * rate / paid) / ln(1 + rate), 9)) AS INTEGER) AS payoff FROM l WHERE paid > owed * rate),
g AS (SELECT *, CAST(i AS INTEGER) AS month, greatest(0.0::DOUBLE, owed * pow(1 + rate, i - 1) - paid * (pow(1 + rate, i - 1) - 1) / rate) AS before, greatest(0.0::DOUBLE, owed * pow(1 + rate, i) - paid * (pow(1 + rate, i) - 1) / rate) AS rest FROM p, range(1, 121) x(i) WHERE i <= payoff)
SELECT account_id, month, round(before * rate, 4) AS interest, round(before - rest, 4) AS principal, round(rest, 4) AS balance, CASE WHEN payoff <= 480 THEN payoff END AS payoff_month FROM g""",
    "accounts",
)
def x19_amortisation(led):
    principal = F.col("statement_balance").cast("double")
    loans = led.accounts.filter("account_type = 'mortgage' and statement_balance > 0").select("account_id", principal.alias("principal"), F.lit(0.004).alias("rate"), (principal / 90 + 1).alias("payment"))
    return reports.amortisation(loans, 120)
