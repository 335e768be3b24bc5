"""Queries of interest that is posted again, holdings by day, loan payments and rows that were posted late."""

from __future__ import annotations

from pyspark.sql import functions as F

from talliver.operators import balances, holdings, links, settle
from talliver.plans.matching import _IN_ORDER
from talliver.plans.queries import AS_OF, query

_FORMATS = ("%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%m/%d/%y", "%d/%m/%y")
_POSTED = f"""lagged AS (SELECT *, list_min(list_filter([{", ".join(f"date_diff('day', CAST(ts AS DATE), CAST(try_strptime(t, '{f}') AS DATE))" for f in _FORMATS)}], lambda d: d BETWEEN 0 AND 14)) AS lag
 FROM (SELECT *, CASE WHEN json_valid(raw_data) THEN coalesce({", ".join(f"nullif(trim(json_extract_string(raw_data, '$.\"{k}\"')), '')" for k in balances.POST_KEYS)}) END AS t FROM card_rows))"""


@query(f"WITH {_POSTED} SELECT txn_id, coalesce(lag > 0, FALSE) AS posted_after FROM lagged", "card_rows")
def b3_posted_after(led):
    return led.card_rows.select("txn_id", balances.posted_after(F.col("raw_data"), F.col("ts")).alias("posted_after"))


@query(
    f"""WITH {_POSTED}, a AS (SELECT account_id, is_asset, statement_balance, d FROM accounts JOIN (SELECT account_id, CAST(max_by(ts, txn_id) AS DATE) AS d FROM card_rows GROUP BY 1) USING (account_id)),
s AS (SELECT account_id, sum(amount) AS since, count(*) FILTER (CAST(ts AS DATE) = d) AS later FROM lagged JOIN a USING (account_id) WHERE CAST(ts AS DATE) > d OR (CAST(ts AS DATE) = d AND coalesce(lag > 0, FALSE)) GROUP BY 1)
SELECT account_id, CAST(CASE WHEN is_asset THEN statement_balance + coalesce(since, 0) ELSE statement_balance - coalesce(since, 0) END AS DECIMAL(38,2)) AS value, coalesce(later, 0) AS later FROM a LEFT JOIN s USING (account_id)""",
    "accounts card_rows",
)
def b2_anchored_balance(led):
    """Statements dated on the day of the account's row with the highest id."""
    day = led.card_rows.groupBy("account_id").agg(F.to_date(F.max_by("ts", "txn_id")).alias("statement_balance_as_of"))
    return balances.anchored_balance(led.accounts.drop("statement_balance_as_of").join(day, "account_id"), led.card_rows)


@query(
    """WITH q AS (SELECT account_id, instrument_id, sum(traded) AS traded, sum(held) AS held, min(since) AS since FROM (SELECT account_id, instrument_id, quantity AS traded, 0 AS held, trade_ts AS since FROM stock_trades UNION ALL SELECT account_id, instrument_id, 0, quantity, NULL FROM lots) GROUP BY 1, 2),
b AS (SELECT account_id, min(since) - INTERVAL 5 DAY AS begin FROM q GROUP BY 1),
d AS (SELECT DISTINCT q.account_id, day FROM q JOIN b USING (account_id) JOIN quotes USING (instrument_id) WHERE begin IS NULL OR day >= begin),
g AS (SELECT q.account_id, q.instrument_id, d.day, held - traded + coalesce((SELECT sum(t.quantity) FROM stock_trades t WHERE t.account_id = q.account_id AND t.instrument_id = q.instrument_id AND t.trade_ts <= d.day), 0) AS quantity,
 (SELECT max_by(close, p.day) FROM quotes p WHERE p.instrument_id = q.instrument_id AND p.day <= d.day AND (begin IS NULL OR p.day >= begin)) AS price FROM q JOIN d ON d.account_id = q.account_id JOIN b ON b.account_id = q.account_id),
v AS (SELECT account_id, day, instrument_id, CAST(quantity AS DECIMAL(38,6)) AS quantity, CAST(CASE WHEN price > 0 THEN round(CAST(quantity AS DECIMAL(12,0)) * CAST(price AS DECIMAL(18,2)), 2) ELSE 0 END AS DECIMAL(38,2)) AS value FROM g),
o AS (SELECT account_id, min(day) AS opens FROM (SELECT account_id, day FROM v GROUP BY 1, 2 HAVING sum(value) > 0) GROUP BY 1)
SELECT v.* FROM v JOIN o ON o.account_id = v.account_id AND day >= opens QUALIFY count(*) FILTER (value <> 0) OVER (PARTITION BY v.account_id, instrument_id) > 0""",
    "stock_trades lots quotes",
)
def w4_holdings_value(led):
    return holdings.holdings_value(led.lots, led.stock_trades, led.quotes)


@query(
    f"""WITH RECURSIVE side AS (SELECT * FROM loan_rows WHERE is_loan QUALIFY row_number() OVER (PARTITION BY owner, account_id, import_batch_id ORDER BY ts DESC, txn_id DESC) <= 10),
sums AS (SELECT owner, account_id AS loan, import_batch_id, sum(amount) AS total, min(CAST(ts AS DATE)) - INTERVAL 5 DAY AS low, max(CAST(ts AS DATE)) + INTERVAL 5 DAY AS high FROM side GROUP BY 1, 2, 3),
p AS (SELECT s.owner AS account_id, s.import_batch_id * 1000000 + s.loan AS ts, 0 AS txn_id, t.txn_id AS payment_id, 0::INTEGER AS gap, -CAST(abs(t.amount + total) AS DOUBLE) AS score FROM sums s JOIN loan_rows t ON t.owner = s.owner AND t.account_id <> s.loan AND CAST(t.ts AS DATE) BETWEEN low AND high AND abs(t.amount + total) <= 1 AND t.txn_id % 7 > 0),
{_IN_ORDER},
k AS (SELECT o.ts // 1000000 AS batch_id, o.ts % 1000000 AS loan_id, best.p AS paid FROM f JOIN o USING (account_id, i) WHERE best IS NOT NULL)
SELECT batch_id, loan_id, txn_id, 'loan_inflow' AS role, CAST(amount AS DECIMAL(38,2)) AS amount FROM k JOIN side ON account_id = loan_id AND import_batch_id = batch_id
UNION ALL SELECT batch_id, loan_id, txn_id, 'bank_outflow', CAST(amount AS DECIMAL(38,2)) FROM k JOIN loan_rows ON txn_id = paid""",
    "loan_rows",
)
def c9_group_loan_payments(led):
    return links.group_loan_payments(led.loan_rows, led.loan_rows.filter("txn_id % 7 = 0"))


def _accrued(name: str, rows: str, own: str, until: str) -> str:
    """Recursive CTEs that end in ``name`` (account_id, month, interest): interest on ``rows`` (account_id, month, moved, done) of the accounts ``own``."""
    return f"""{name}_f AS (SELECT account_id, min(month) AS first FROM {rows} JOIN {own} USING (account_id) GROUP BY 1),
{name}_g AS (SELECT account_id, CAST(x AS DATE) AS month, row_number() OVER (PARTITION BY account_id ORDER BY x) AS i FROM {name}_f, unnest(generate_series(CAST(first AS TIMESTAMP), TIMESTAMP '{until}', INTERVAL 1 MONTH)) u(x)),
{name}_m AS (SELECT g.account_id, g.month, g.i, coalesce(s.moved, 0) AS moved, coalesce(s.done, FALSE) AS done FROM {name}_g g LEFT JOIN {rows} s USING (account_id, month)),
{name}_r AS (SELECT account_id, 0::BIGINT AS i, CAST(0 AS DECIMAL(24,2)) AS balance, CAST(0 AS DECIMAL(24,2)) AS interest, CAST(NULL AS DATE) AS month FROM {name}_f
 UNION ALL SELECT account_id, i, CAST(b + n AS DECIMAL(24,2)), n, month FROM (SELECT account_id, i, month, b, CAST(CASE WHEN done THEN 0 ELSE round(abs(b) * CAST(0.005 AS DECIMAL(8,4)), 2) * sign(b) END AS DECIMAL(24,2)) AS n
 FROM (SELECT m.account_id, m.i, m.month, m.done, CAST(r.balance + m.moved AS DECIMAL(24,2)) AS b FROM {name}_r r JOIN {name}_m m ON m.account_id = r.account_id AND m.i = r.i + 1))),
{name} AS (SELECT account_id, month, interest FROM {name}_r WHERE interest <> 0)"""


_MONTH = "CAST(date_trunc('month', ts) AS DATE)"


@query(
    f"""WITH RECURSIVE own AS (SELECT account_id FROM accounts WHERE account_type IN ('mortgage', 'credit_card') AND balance_truth_source IN ('transaction_sum', 'hybrid')),
early AS (SELECT account_id, {_MONTH} AS month, sum(amount) AS moved, FALSE AS done FROM transactions WHERE txn_id % 97 > 0 GROUP BY 1, 2),
{_accrued("posted", "early", "own", "1999-12-01")},
plain AS (SELECT account_id, {_MONTH} AS month, sum(amount) AS moved FROM transactions JOIN own USING (account_id) GROUP BY 1, 2),
rows_ AS (SELECT account_id, month, coalesce(moved, 0) AS moved, coalesce(interest, 0) AS posted FROM plain FULL JOIN posted USING (account_id, month)),
span AS (SELECT account_id, min(month) AS first FROM rows_ GROUP BY 1 HAVING count(*) FILTER (posted <> 0) > 0),
grid AS (SELECT account_id, CAST(x AS DATE) AS month FROM span, unnest(generate_series(CAST(first AS TIMESTAMP), TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)) u(x)),
run AS (SELECT account_id, month, coalesce(posted, 0) AS posted, CAST(sum(coalesce(moved, 0) + coalesce(posted, 0)) OVER (PARTITION BY account_id ORDER BY month) - coalesce(posted, 0) AS DECIMAL(24,2)) AS b FROM grid LEFT JOIN rows_ USING (account_id, month)),
bad AS (SELECT account_id, min(month) AS from_month FROM run WHERE posted <> CAST(round(abs(b) * CAST(0.005 AS DECIMAL(8,4)), 2) * sign(b) AS DECIMAL(24,2)) GROUP BY 1),
rest AS (SELECT account_id, month, moved + CASE WHEN month < from_month THEN posted ELSE 0 END AS moved, month < from_month AND posted <> 0 AS done FROM rows_ JOIN bad USING (account_id)),
{_accrued("again", "rest", "bad", "2001-06-01")}
SELECT account_id, from_month, 'remove' AS action, -(account_id * 10000 + year(month) * 12 + month(month)) AS txn_id, last_day(month) AS day, CAST(interest AS DECIMAL(38,2)) AS amount FROM posted JOIN bad USING (account_id) WHERE month >= from_month
UNION ALL SELECT account_id, from_month, 'post', NULL, last_day(month), CAST(interest AS DECIMAL(38,2)) FROM again JOIN bad USING (account_id) WHERE month >= from_month""",
    "accounts transactions",
)
def x21_resync_interest(led):
    """Interest was posted up to 1999 on the rows known then; every 97th row turned up later."""
    kinds = led.accounts.filter("account_type in ('mortgage', 'credit_card')").select("account_id", "balance_truth_source", F.lit("0.005").cast("decimal(12,10)").alias("monthly_rate"))
    own = kinds.filter("balance_truth_source in ('transaction_sum', 'hybrid')")
    known = led.transactions.filter("txn_id % 97 > 0").join(own.select("account_id"), "account_id", "left_semi")
    posted = settle.accrue_interest(known, own.select("account_id", "monthly_rate"), "1999-12-31", led.spark.createDataFrame([], "account_id long, month date"))
    number = -(F.col("account_id") * 10000 + F.year("month") * 12 + F.month("month"))
    posted = posted.select(number.cast("long").alias("txn_id"), "account_id", F.last_day("month").cast("timestamp_ntz").alias("ts"), "interest", F.lit(True).alias("is_interest"))
    rows = led.transactions.select("txn_id", "account_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("amount").cast("decimal(38,2)").alias("amount"), F.lit(False).alias("is_interest"))
    return settle.resync_interest(rows.unionAll(posted), kinds, AS_OF)
