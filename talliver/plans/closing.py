"""Queries of duplicates by confidence, open tasks, statements that don't add up, readiness, rules that were held already."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from talliver.functions import text
from talliver.operators import pairs, portfolio, spend, tasks
from talliver.plans.matching import _KEY, _RATIO, _RULES, _rules
from talliver.plans.queries import _CLASSED, AS_OF, query
from talliver.plans.reporting import _COUNTERS, _SEEN, _counters

_LIKE = f"greatest({_RATIO.format('lower(x.text)', 'lower(y.text)')}, {_RATIO.format(_KEY.format('x.text'), _KEY.format('y.text'))})"
_CONFIDENCE = f"""fd AS (SELECT account_id, CAST(ts AS DATE) AS day, amount, description AS text, import_batch_id FROM moves), gs AS (SELECT account_id, day, amount, count(*) AS n, count(DISTINCT import_batch_id) AS n_batches FROM fd GROUP BY 1, 2, 3 HAVING count(*) > 1),
ds AS (SELECT DISTINCT account_id, day, amount, text FROM fd), wk AS (SELECT x.account_id, x.day, x.amount, min({_LIKE}) AS c FROM ds x JOIN ds y ON x.account_id = y.account_id AND x.day = y.day AND x.amount = y.amount AND x.text < y.text GROUP BY 1, 2, 3),
dc AS (SELECT gs.*, n_batches > 1 AS cross_batch, round(coalesce(c, 1.0::DOUBLE), 3) AS confidence FROM gs LEFT JOIN wk USING (account_id, day, amount) WHERE (n_batches > 1 OR coalesce(c, 1.0) >= 0.5)
 AND NOT EXISTS (SELECT 1 FROM moves m WHERE m.txn_id % 50 = 0 AND m.account_id = gs.account_id AND CAST(m.ts AS DATE) = gs.day AND m.amount = gs.amount))"""


def _confidence(led):
    said = led.moves.filter("txn_id % 50 = 0").select("account_id", F.to_date("ts").alias("day"), "amount")
    return tasks.duplicate_confidence(led.moves, said, text.edit_similarity)


@query(f"WITH {_CONFIDENCE} SELECT * FROM dc", "moves")
def a19_duplicate_confidence(led):
    return _confidence(led)


@query(f"WITH {_CONFIDENCE} SELECT *, CAST(row_number() OVER (ORDER BY cross_batch DESC, confidence DESC, account_id, day, amount) AS INTEGER) AS place FROM dc QUALIFY place <= 50", "moves")
def k4_rank_duplicates(led):
    return tasks.ranked_duplicates(_confidence(led), 50)


@query(
    """WITH p AS (SELECT a.txn_id AS a, b.txn_id AS b, CAST(date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE)) AS INTEGER) AS gap, 1.0::DOUBLE - CAST(levenshtein(a.description, b.description) AS DOUBLE) / greatest(length(a.description), length(b.description)) AS score
 FROM feed a JOIN feed b ON a.account_id = b.account_id AND a.amount = b.amount AND a.import_batch_id <> b.import_batch_id AND date_diff('day', CAST(a.ts AS DATE), CAST(b.ts AS DATE)) BETWEEN 1 AND 3)
SELECT * FROM p WHERE score >= 0.85 AND NOT (a + b) % 3 = 0""",
    "feed",
)
def j9_undismissed_pairs(led):
    """Near duplicates less the pairs whose ids sum to a multiple of three, which are dismissed, the larger id first."""
    near = pairs.near_duplicates(led.feed, similarity=lambda a, b: text.ratio_by_edits(F.lower(a), F.lower(b)))
    return tasks.undismissed_pairs(near, near.filter("(a + b) % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")))


@query(
    """WITH s AS (SELECT snapshot_id AS batch_id, account_id, statement_date, balance, lag(balance) OVER w AS previous, lag(statement_date) OVER w AS since, CASE WHEN snapshot_id % 3 = 0 THEN CAST(25 AS DECIMAL(18,2)) END AS instalment FROM snapshots WINDOW w AS (PARTITION BY account_id ORDER BY statement_date, snapshot_id)),
m AS (SELECT batch_id, sum(amount) AS moved FROM s JOIN feed f ON f.account_id = s.account_id AND CAST(f.ts AS DATE) > since AND CAST(f.ts AS DATE) <= statement_date GROUP BY 1)
SELECT batch_id, CAST(coalesce(moved, 0) AS DECIMAL(38,2)) AS moved, CAST(balance - previous - coalesce(instalment, 0) AS DECIMAL(38,2)) AS expected,
 least(abs(coalesce(moved, 0) - (balance - previous - coalesce(instalment, 0))), abs(coalesce(moved, 0) + (balance - previous - coalesce(instalment, 0)))) <= greatest(1, abs(balance) * 0.001) AS matches FROM s LEFT JOIN m USING (batch_id) WHERE previous IS NOT NULL""",
    "snapshots feed",
)
def a25_statement_differences(led):
    """Each snapshot of an account is a statement; its batch holds the rows since the one before."""
    w = Window.partitionBy("account_id").orderBy("statement_date", "snapshot_id")
    held = led.snapshots.select(F.col("snapshot_id").alias("batch_id"), "account_id", "statement_date", "balance", F.lag("balance").over(w).alias("previous"), F.when(F.col("snapshot_id") % 3 == 0, 25).cast("decimal(18,2)").alias("instalment"))
    # The batch of a row: the first statement of its account on its day or later; of statements of one day, the first.
    day = F.to_date("ts")
    marks = led.snapshots.groupBy("account_id", F.col("statement_date").alias("day")).agg(F.min("snapshot_id").alias("batch_id")).withColumns({"amount": F.lit(None).cast("decimal(38,2)"), "o": F.lit(1)})
    sums = led.feed.groupBy("account_id", day.alias("day")).agg(F.sum("amount").cast("decimal(38,2)").alias("amount")).withColumns({"batch_id": F.lit(None).cast("long"), "o": F.lit(0)})
    after = Window.partitionBy("account_id").orderBy("day", "o").rowsBetween(0, Window.unboundedFollowing)
    rows = marks.unionByName(sums).withColumn("batch_id", F.first("batch_id", ignorenulls=True).over(after)).filter("o = 0 and batch_id is not null")
    return tasks.statement_differences(held, rows)


@query(f"WITH {_COUNTERS} SELECT CAST(sum(blockers) AS BIGINT) AS blockers, CAST(sum(warnings) AS BIGINT) AS warnings, CAST(greatest(0, 100 - 20 * sum(blockers) - 5 * sum(warnings)) AS BIGINT) AS score FROM cc", _SEEN)
def a26_quality_score(led):
    return tasks.readiness(_counters(led))


@query(
    f"""WITH {_RULES}, held AS (SELECT pattern, user_id, category_id + 10 AS category_id, hits * 2 AS hits FROM lr WHERE hits % 2 = 1 UNION ALL SELECT 'never seen', 1, 9, 4), n AS (SELECT * FROM lr WHERE hits % 3 > 0)
SELECT pattern, user_id, coalesce(n.category_id, held.category_id) AS category_id, coalesce(held.hits, 0) + coalesce(n.hits, 0) AS hits FROM held FULL JOIN n USING (pattern, user_id)""",
    "moves",
)
def c2_merge_rules(led):
    learned = _rules(led)
    old = learned.filter("hits % 2 = 1").select("pattern", "user_id", (F.col("category_id") + 10).alias("category_id"), (F.col("hits") * 2).alias("hits"))
    return tasks.merge_rules(old.unionAll(led.spark.sql("SELECT 'never seen', 1L, 9L, 4L")), learned.filter("hits % 3 > 0"))


_LEVEL = "CASE WHEN s.amount > 0 THEN 'reminder' WHEN abs(s.amount) >= 500 THEN 'reminder' ELSE 'auto' END"


@query(
    f"""WITH a AS (SELECT account_id, user_id, account_type, is_asset, CASE WHEN account_id % 11 = 0 THEN DATE '2001-01-01' END AS closed_at FROM accounts),
t AS (SELECT txn_id, account_id, ts, CASE WHEN category_id <> 3 THEN category_id END AS category_id, is_transfer FROM transactions), l AS (SELECT account_id, CAST(max(ts) AS DATE) AS last FROM t GROUP BY 1),
u AS (SELECT account_id, user_id, count(*) AS c, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, account_id) AS place FROM t JOIN a USING (account_id) WHERE category_id IS NULL AND NOT is_transfer GROUP BY 1, 2),
g AS (SELECT account_id, count(DISTINCT import_batch_id) > 1 AS cross_batch FROM feed GROUP BY account_id, CAST(ts AS DATE), amount HAVING count(*) >= 2),
s AS (SELECT s.*, user_id, {_LEVEL} AS lvl FROM schedules s JOIN a USING (account_id) WHERE payment_id % 7 > 0)
SELECT user_id, 'stale' AS task, NULL AS account_id, NULL AS level, count(*) AS n, CAST(NULL AS DECIMAL(38,2)) AS outflow, CAST(NULL AS DECIMAL(38,2)) AS inflow, NULL AS detail FROM a LEFT JOIN l USING (account_id) WHERE account_type IN ('checking', 'credit_card', 'mortgage', 'brokerage') AND closed_at IS NULL AND (last IS NULL OR date_diff('day', last, DATE '{AS_OF}') > 30) GROUP BY 1
UNION ALL SELECT user_id, 'transfers', NULL, NULL, count(*), NULL, NULL, NULL FROM t JOIN a USING (account_id) WHERE is_transfer AND txn_id % 3 > 0 GROUP BY 1
UNION ALL SELECT user_id, 'categories', NULL, NULL, CAST(sum(c) AS BIGINT), NULL, NULL, string_agg(concat(account_id, ' (', c, ')'), ', ' ORDER BY place) FILTER (place <= 3) FROM u GROUP BY 1
UNION ALL SELECT user_id, 'duplicates', NULL, CASE WHEN cross_batch THEN 'cross' ELSE 'same' END, count(*), NULL, NULL, NULL FROM g JOIN a USING (account_id) GROUP BY 1, 4
UNION ALL SELECT user_id, 'overdue', NULL, NULL, count(*), NULL, NULL, NULL FROM s WHERE next_due < DATE '2001-08-14' GROUP BY 1
UNION ALL SELECT user_id, 'due', account_id, lvl, count(*), CAST(sum(greatest(0, -amount)) AS DECIMAL(38,2)), CAST(sum(greatest(0, amount)) AS DECIMAL(38,2)), NULL FROM s WHERE next_due BETWEEN DATE '2001-08-14' AND DATE '2001-09-13' GROUP BY 1, 3, 4""".replace(f"DATE '{AS_OF}'", "DATE '2001-08-14'"),
    "accounts transactions feed schedules",
)
def a27_task_list(led):
    accounts = led.accounts.withColumn("closed_at", F.when(F.col("account_id") % 11 == 0, F.lit("2001-01-01").cast("date")))
    txns = led.transactions.withColumn("category_id", F.when(F.col("category_id") != 3, F.col("category_id")))
    links = txns.filter("is_transfer").select("txn_id", (F.col("txn_id") % 3 == 0).alias("confirmed"))
    owed = led.schedules.withColumn("level", F.expr(_LEVEL.replace("s.amount", "amount")))
    return tasks.task_list(accounts, txns, links, pairs.duplicate_groups(led.feed), owed, owed.filter("payment_id % 7 = 0"), "2001-08-14")


@query(
    """WITH p AS (SELECT instrument_id, max(day) AS day, max_by(close, day) AS price FROM quotes GROUP BY 1),
v AS (SELECT account_id, instrument_id, day, CAST(round_even(CAST(quantity * CAST(price AS DECIMAL(18,2)) AS DOUBLE), 2) AS DECIMAL(38,2)) AS v FROM lots JOIN p USING (instrument_id) WHERE instrument_id <> 2)
SELECT account_id, count(DISTINCT instrument_id) AS n_funds, CAST(sum(v) AS DECIMAL(38,2)) AS value, max(day) AS as_of FROM v GROUP BY 1""",
    "lots quotes",
)
def a32_fund_value(led):
    return portfolio.fund_value(led.lots, led.quotes.filter("instrument_id <> 2").withColumnRenamed("close", "price"))


@query(
    """WITH p AS (SELECT instrument_id, max_by(close, day) AS price FROM quotes GROUP BY 1),
s AS (SELECT account_id, instrument_id, sum(CASE WHEN quantity % 3 = 0 THEN CAST(1 AS DECIMAL(18,6)) WHEN trade_ts > DATE '1998-06-30' THEN abs(quantity) ELSE 0 END) AS u FROM stock_trades GROUP BY 1, 2)
SELECT account_id, CAST(sum(u) AS DECIMAL(28,6)) AS units, CAST(sum(CAST(u * CAST(price AS DECIMAL(18,2)) AS DECIMAL(38,2))) AS DECIMAL(38,2)) AS value FROM s JOIN p USING (instrument_id) GROUP BY 1""",
    "stock_trades quotes",
)
def a32_unvested_value(led):
    """Trades as vests; the unvested units of every third quantity are known."""
    vests = led.stock_trades.select("account_id", "instrument_id", F.col("trade_ts").alias("vest_date"), F.abs("quantity").alias("units"), F.when(F.col("quantity") % 3 == 0, 1).cast("decimal(18,6)").alias("unvested"))
    return portfolio.unvested_value(vests, led.quotes.withColumnRenamed("close", "price"), "1998-06-30")


@query(
    """WITH m AS (SELECT instrument_id, date_trunc('month', day) AS month, CAST(max_by(close, day) AS DOUBLE) AS v FROM quotes GROUP BY 1, 2), r AS (SELECT instrument_id, v, lag(v) OVER (PARTITION BY instrument_id ORDER BY month) AS p FROM m),
f AS (SELECT instrument_id, count(*) AS n, avg(ln(v / p)) AS mu, sqrt(greatest(var_pop(ln(v / p)), 1e-10)) AS sd FROM r WHERE p > 0 AND v > 0 GROUP BY 1 HAVING count(*) >= 3)
SELECT instrument_id, n, round((exp(mu * 12) - 1) * 100, 2) AS return_pct, round(sd * sqrt(12.0::DOUBLE) * 100, 2) AS volatility_pct FROM f""",
    "quotes",
)
def a35_annual_returns(led):
    return portfolio.annual_returns(led.quotes, "instrument_id", "day", "close")


@query(
    """WITH n AS (SELECT base_currency AS series, CAST(max_by(rate, rate_date) AS DOUBLE) AS now FROM rates GROUP BY 1),
b AS (SELECT account_id AS property_id, a.currency AS series, value, (SELECT CAST(max_by(r.rate, r.rate_date) AS DOUBLE) FROM rates r WHERE r.base_currency = a.currency AND r.rate_date <= DATE '1995-03-15' + CAST(account_id % 900 AS INTEGER)) AS level FROM (SELECT account_id, currency, CAST(abs(current_value) * 100 AS DECIMAL(18,2)) AS value FROM accounts WHERE account_type = 'real_estate') a)
SELECT property_id, round(CAST(value AS DOUBLE) * (now / level), -3) AS value, round((now / level - 1) * 100, 4) AS growth_pct FROM b JOIN n USING (series) WHERE level <> 0""",
    "accounts rates",
)
def a36_indexed_value(led):
    """Real estate bought on a day of its own, carried by its currency's rates as an index."""
    homes = led.accounts.filter("account_type = 'real_estate'").select(F.col("account_id").alias("property_id"), F.col("currency").alias("series"), F.expr("date_add(DATE '1995-03-15', cast(account_id % 900 as int))").alias("day"), (F.abs("current_value") * 100).cast("decimal(18,2)").alias("value"))
    return portfolio.indexed_value(homes, led.rates.select(F.col("base_currency").alias("series"), F.col("rate_date").alias("day"), F.col("rate").alias("level")))


@query(
    """WITH t AS (SELECT description AS category, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM moves WHERE amount < 0 GROUP BY 1), o AS (SELECT category, CASE WHEN length(category) % 3 = 0 THEN TRUE WHEN length(category) % 3 = 1 THEN NULL ELSE FALSE END AS said FROM t WHERE length(category) % 2 = 0),
e AS (SELECT t.*, CASE WHEN coalesce(said, contains(lower(category), 'tax') OR contains(lower(category), 'bill')) THEN 'essential' ELSE 'discretionary' END AS part FROM t LEFT JOIN o USING (category)),
u AS (SELECT part, category, total FROM e UNION ALL SELECT part, NULL, CAST(sum(total) AS DECIMAL(38,2)) FROM e GROUP BY 1)
SELECT part, category, total, round(CAST(total AS DOUBLE) * 100 / (SELECT CAST(sum(total) AS DOUBLE) FROM t), 1) AS pct FROM u""",
    "moves",
)
def a10_essential_breakdown(led):
    totals = led.moves.filter("amount < 0").groupBy(F.col("description").alias("category")).agg(F.sum("amount").cast("decimal(38,2)").alias("total"))
    said = F.when(F.length("category") % 3 == 0, True).when(F.length("category") % 3 == 2, False)
    return portfolio.essential_breakdown(totals, totals.filter(F.length("category") % 2 == 0).select("category", said.alias("is_essential")), ("tax", "bill"))


@query(f"WITH {_CLASSED} SELECT txn_id, event_type, 'inferred' AS provenance, CAST(0.6 AS DOUBLE) AS confidence FROM k WHERE txn_id % 3 < 2", "transactions accounts")
def c5_classify_open(led):
    """Every third row has an event already; the others are classified."""
    rows = led.transactions.withColumn("event_type", F.expr("case txn_id % 3 when 0 then 'unclassified' when 2 then 'fee' end"))
    return portfolio.classify_open(rows, led.accounts)


@query(
    """SELECT account_id, CAST(CASE WHEN account_id % 15 = 0 THEN 0 ELSE statement_balance END AS DECIMAL(18,2)) AS statement_balance, CAST(CASE WHEN account_id % 15 = 0 THEN 0 ELSE current_value END AS DECIMAL(18,2)) AS current_value, CASE WHEN account_id % 15 = 0 THEN DATE '2001-05-01' ELSE statement_balance_as_of END AS statement_balance_as_of,
 CASE WHEN account_id % 5 > 0 THEN DATE '2001-07-01' END AS payment_due_date, CASE WHEN account_id % 5 = 0 THEN DATE '2001-05-01' END AS closed_at, CASE WHEN account_id % 10 = 0 THEN 'moved' END AS closed_reason FROM accounts""",
    "accounts",
)
def x25_close_accounts(led):
    rows = led.accounts.select("account_id", "statement_balance", "current_value", "statement_balance_as_of", F.lit("2001-07-01").cast("date").alias("payment_due_date"), F.lit(None).cast("date").alias("closed_at"), F.lit(None).cast("string").alias("closed_reason"))
    closing = rows.filter("account_id % 5 = 0").select("account_id", F.lit("2001-05-01").cast("date").alias("closed_at"), F.when(F.col("account_id") % 10 == 0, " moved ").otherwise(" ").alias("reason"), (F.col("account_id") % 3 == 0).alias("zero_balance"))
    return portfolio.close_accounts(rows, closing)


_FLOW_RATE = "CASE WHEN currency = 'USD' THEN 1.0::DOUBLE ELSE (SELECT CAST(arg_min(rate, (abs(date_diff('day', k.day, rate_date)), -date_diff('day', DATE '1970-01-01', rate_date))) AS DOUBLE) FROM rates WHERE base_currency = k.currency AND quote_currency = 'USD' AND abs(date_diff('day', k.day, rate_date)) <= 30) END"


@query(
    f"""WITH l AS (SELECT txn_id AS out_id, txn_id + 1 AS in_id FROM transactions WHERE is_transfer AND txn_id % 3 > 0),
r AS (SELECT o.account_id AS from_id, i.account_id AS to_id, currency, CAST(o.ts AS DATE) AS day, abs(o.amount) AS amount FROM l JOIN transactions o ON o.txn_id = out_id JOIN transactions i ON i.txn_id = in_id JOIN accounts a ON a.account_id = o.account_id),
k AS (SELECT from_id, to_id, currency, day, count(*) AS c, CAST(sum(amount) AS DECIMAL(38,2)) AS moved FROM r GROUP BY 1, 2, 3, 4), x AS (SELECT *, {_FLOW_RATE} AS fx FROM k),
y AS (SELECT from_id, to_id, currency, sum(c) AS c, CAST(sum(moved) AS DECIMAL(38,2)) AS moved, sum(CAST(round(CAST(moved AS DOUBLE) * fx * 100) AS BIGINT)) AS cents, sum(CASE WHEN fx IS NULL THEN c ELSE 0 END) AS u FROM x GROUP BY 1, 2, 3)
SELECT from_id, to_id, CAST(sum(c) AS BIGINT) AS n, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents, CAST(sum(u) AS BIGINT) AS n_unconverted, string_agg(concat(currency, ' ', moved), ', ' ORDER BY concat(currency, ' ', moved)) AS native FROM y GROUP BY 1, 2""",
    "transactions accounts rates",
)
def a20_confirmed_flows(led):
    """Transfers linked to the next row, all but every third confirmed."""
    links = led.transactions.filter("is_transfer").select(F.col("txn_id").alias("out_id"), (F.col("txn_id") + 1).alias("in_id"), (F.col("txn_id") % 3 > 0).alias("confirmed"))
    rows = led.transactions.join(led.accounts.select("account_id", "currency"), "account_id")
    return portfolio.confirmed_flows(links, rows, led.rates, "USD")


_SPOKEN = "concat(description, CASE txn_id % 17 WHEN 3 THEN ' MTG payment' WHEN 4 THEN ' Balance carried forward' ELSE '' END)"
_MONTH_RATE = "(SELECT CAST(arg_min(rate, (abs(date_diff('day', c.month_end, rate_date)), -date_diff('day', DATE '1970-01-01', rate_date))) AS DOUBLE) FROM rates WHERE base_currency = c.currency AND quote_currency = 'USD' AND abs(date_diff('day', c.month_end, rate_date)) <= 30)"


@query(
    f"""WITH t AS (SELECT x.account_id, last_day(CAST(ts AS DATE)) AS month_end, amount, is_transfer, lower({_SPOKEN}) AS text, CASE WHEN category_id <> 3 THEN category_id END AS category_id, currency, is_asset FROM transactions x JOIN accounts a ON a.account_id = x.account_id WHERE CAST(ts AS DATE) >= DATE '1996-01-01'),
k AS (SELECT CAST(r_regionkey AS BIGINT) AS category_id, lower(r_name) AS name, r_regionkey = 2 AS moves FROM region),
s AS (SELECT CASE WHEN amount < 0 AND NOT (contains(text, 'brought forward') OR contains(text, 'carried forward') OR contains(text, 'opening balance')) AND (NOT is_transfer OR contains(text, 'mortgage') OR contains(text, 'mtg') OR contains(text, 'blackhorse') OR contains(text, 'black horse')) THEN 'spend'
 WHEN amount > 0 AND NOT is_transfer AND is_asset THEN 'income' END AS side, month_end, coalesce(name, 'Uncategorized') AS category, currency, amount FROM t LEFT JOIN k USING (category_id) WHERE NOT coalesce(moves, FALSE)),
c AS (SELECT side, month_end, category, currency, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM s WHERE side IS NOT NULL GROUP BY 1, 2, 3, 4), z AS (SELECT *, CASE WHEN currency = 'USD' THEN 1.0::DOUBLE ELSE {_MONTH_RATE} END AS fx FROM c)
SELECT side, month_end, category, CAST(sum(CAST(round(CAST(total AS DOUBLE) * coalesce(fx, 1.0::DOUBLE) * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) FILTER (fx IS NULL) AS n_unconverted FROM z GROUP BY 1, 2, 3""",
    "transactions accounts rates",
)
def a9_income_and_spend(led):
    """Rows with loan words and balance markers in their texts; one category is of transfers, one is missing."""
    rows = led.transactions.withColumn("description", F.expr(_SPOKEN)).withColumn("category_id", F.when(F.col("category_id") != 3, F.col("category_id")))
    names = led.spark.read.parquet(f"{led.sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("category_id"), F.lower("r_name").alias("name"), F.when(F.col("r_regionkey") == 2, "transfer").otherwise("expense").alias("category_type"))
    return spend.income_and_spend(rows, led.accounts, names, led.rates, "USD", "1996-01-01")


@query(
    """WITH k AS (SELECT CAST(r_regionkey AS BIGINT) AS category_id, lower(r_name) AS name FROM region), t AS (SELECT account_id, strftime(ts, '%Y-%m') AS month, coalesce(name, 'Uncategorized') AS category, amount FROM transactions LEFT JOIN k USING (category_id))
SELECT account_id, month, category, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS total FROM t GROUP BY GROUPING SETS ((account_id, month, category), (account_id, category))""",
    "transactions",
)
def a11_account_category_summary(led):
    names = led.spark.read.parquet(f"{led.sf_dir}/region.parquet").select(F.col("r_regionkey").cast("long").alias("category_id"), F.lower("r_name").alias("name"))
    return spend.account_category_summary(led.transactions, names)
