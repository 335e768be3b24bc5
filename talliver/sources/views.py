"""Ledger tables as views over the star-schema tables; one SQL text serves Spark and the oracle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: {name} stands for a base table or an earlier view.
VIEWS = {
    "accounts": """SELECT c_custkey AS account_id, CAST(c_nationkey AS BIGINT) AS user_id, c_name AS name,
 CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'checking' WHEN 'MACHINERY' THEN 'credit_card' WHEN 'FURNITURE' THEN 'brokerage'
  WHEN 'BUILDING' THEN 'mortgage' ELSE 'real_estate' END AS account_type,
 c_mktsegment NOT IN ('MACHINERY','BUILDING') AS is_asset,
 CASE c_nationkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency,
 CASE c_custkey % 6 WHEN 0 THEN 'transaction_sum' WHEN 1 THEN 'hybrid' WHEN 2 THEN 'latest_statement'
  WHEN 3 THEN 'latest_valuation' WHEN 4 THEN 'liability_balance' ELSE 'manual_mark' END AS balance_truth_source,
 CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS statement_balance, DATE '2001-06-30' AS statement_balance_as_of,
 CAST(c_acctbal AS DECIMAL(18,2)) AS current_value FROM {customer}""",
    "transactions": """SELECT o.o_orderkey AS txn_id, o.o_custkey AS account_id, o.o_orderdate AS ts,
 concat(p.p_name, ' ', CAST(o.o_orderkey % 7 AS VARCHAR(2))) AS description,
 CAST(CASE WHEN o.o_orderstatus='F' THEN o.o_totalprice ELSE -o.o_totalprice END AS DECIMAL(18,2)) AS amount,
 CAST(substr(o.o_orderpriority,1,1) AS BIGINT) AS category_id, o.o_orderkey % 4 AS import_batch_id,
 o.o_orderpriority = '1-URGENT' AS is_transfer
 FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_custkey % 200 AND p.p_partkey < 200""",
    "running": """SELECT o_orderkey AS txn_id, o_custkey AS account_id, o_orderdate AS ts,
 CASE WHEN o_orderkey % 3 <> 0 THEN SUM(CAST(CASE WHEN o_orderstatus='F' THEN o_totalprice ELSE -o_totalprice END AS DECIMAL(18,2)))
  OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) END AS balance_after FROM {orders}""",
    "splits": """SELECT l_orderkey AS txn_id, l_linenumber AS split_no, l_suppkey % 5 AS category_id,
 -CAST(l_extendedprice AS DECIMAL(18,2)) AS amount_native, l_linestatus='F' AS counts_as_true_spend,
 CASE l_returnflag WHEN 'A' THEN 'lifestyle' WHEN 'N' THEN 'fixed_core' ELSE 'debt_cost' END AS spend_type FROM {lineitem}""",
    "rates": """SELECT CASE l_suppkey % 4 WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS base_currency, 'USD' AS quote_currency,
 CAST(date_trunc('month', l_shipdate) AS DATE) AS rate_date,
 CAST(CAST(0.5 AS DECIMAL(18,6)) + max(CAST(l_quantity AS DECIMAL(18,6))) / 100 AS DECIMAL(18,6)) AS rate
 FROM {lineitem} WHERE l_suppkey % 4 <> 0 GROUP BY 1,2,3""",
    "valuations": """SELECT event_id AS valuation_id, user_id AS account_id, CAST(ts AS DATE) AS val_date,
 CAST(value*100 AS DECIMAL(18,2)) AS value FROM {events} WHERE event_type='view'""",
    "feed": """SELECT event_id AS txn_id, user_id AS account_id, CAST(floor(user_id / 3) AS BIGINT) AS household_id, ts,
 CAST(CASE WHEN event_type IN ('purchase','error') THEN -(floor(value/25)*25+25) ELSE floor(value/25)*25+25 END AS DECIMAL(18,2)) AS amount,
 concat(event_type, ' ref ', CAST(1000 + event_id % 5 AS VARCHAR(8))) AS description,
 event_id % 3 AS import_batch_id, props AS raw_data FROM {events}""",
    # The events again, under texts that the rules look for.
    "moves": """SELECT event_id AS txn_id, user_id AS account_id, CAST(floor(user_id / 3) AS BIGINT) AS household_id, user_id % 3 AS user_id, ts,
 CAST(CASE WHEN event_type IN ('purchase','error') THEN -(floor(value/25)*25+25) ELSE floor(value/25)*25+25 END AS DECIMAL(18,2)) AS amount,
 concat(CASE event_id % 10 WHEN 0 THEN 'Online Transfer to savings' WHEN 1 THEN 'ACH PAYMENT thank you' WHEN 2 THEN 'Card purchase LIDL' WHEN 3 THEN 'Uber Eats order'
  WHEN 4 THEN 'Zelle from J Smith' WHEN 5 THEN 'NETFLIX.COM 2024-01-02' WHEN 6 THEN 'Direct Debit council tax' WHEN 7 THEN 'Salary ACME LTD'
  WHEN 8 THEN 'Payment Thank You Bill Pay Service' ELSE 'Payment Thank You Bill Pa' END,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' ref ', CAST(1000 + event_id % 3 AS VARCHAR(8))) WHEN 2 THEN ' IPB2603183152823' ELSE ' #42' END) AS description,
 event_id % 3 AS import_batch_id, event_id % 7 = 0 AS is_transfer, event_id % 5 AS category_id, user_id % 2 = 0 AS is_asset, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN '[1]' ELSE props END AS raw_data FROM {events}""",
    "dues": """SELECT s_suppkey AS payment_id, CAST(s_suppkey AS BIGINT) AS account_id,
 CASE s_suppkey % 4 WHEN 0 THEN 'ACH payment' WHEN 1 THEN 'Direct debit council tax' WHEN 2 THEN 'Netflix.com' ELSE 'Payment thank you bill pay' END AS description,
 CAST(-(s_suppkey % 4 * 25 + 25) AS DECIMAL(18,2)) AS amount, date_add(DATE '2024-01-05', CAST(s_suppkey % 20 AS INT)) AS next_due, s_suppkey % 3 * 10 AS last_text FROM {supplier}""",
    "snapshots": """SELECT event_id AS snapshot_id, user_id AS account_id, CAST(ts AS DATE) AS statement_date,
 CAST(value*100 AS DECIMAL(18,2)) AS balance FROM {events} WHERE event_type='click'""",
    "paychecks": """SELECT event_id AS paycheck_id, user_id AS account_id, CAST(ts AS DATE) AS pay_date, CAST(value*100 AS DECIMAL(18,2)) AS gross,
 CAST(floor(value*20) AS DECIMAL(18,2)) AS taxes, CAST(floor(value*5) AS DECIMAL(18,2)) AS retirement, CAST(floor(value*3) AS DECIMAL(18,2)) AS benefits FROM {events} WHERE event_type='purchase'""",
    "doc_lines": """SELECT l_orderkey AS document_id, l_linenumber AS line_no,
 CASE l_suppkey % 4 WHEN 0 THEN 'income' WHEN 1 THEN 'expense' WHEN 2 THEN 'transfer' ELSE 'liability' END AS kind,
 CAST(CASE WHEN l_suppkey % 4 = 0 OR l_suppkey % 8 = 3 THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(18,2)) AS amount FROM {lineitem}""",
    "members": """SELECT l_orderkey AS group_id, l_linenumber AS member_no,
 CASE l_suppkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'JPY' END AS currency,
 CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE -l_extendedprice END AS DECIMAL(18,2)) AS amount,
 CASE WHEN l_partkey % 5 = 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS amount_base, l_linenumber = 4 AS is_fee FROM {lineitem}""",
    "recon_groups": """SELECT o_orderkey AS group_id, 'USD' AS base_currency, CASE o_orderkey % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'spot_on_group_date' ELSE 'member_rates' END AS fx_treatment,
 o_orderkey % 2 = 0 AS excludes_fees, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 50000 ELSE 0.01 END AS DECIMAL(18,2)) AS tolerance, CAST(o_orderdate AS DATE) AS as_of FROM {orders}""",
    "trades": """SELECT o.o_custkey AS account_id, l.l_partkey AS instrument_id, l.l_shipdate AS trade_ts,
 CAST(CASE WHEN l.l_returnflag='R' THEN -l.l_quantity ELSE l.l_quantity END AS DECIMAL(18,6)) AS quantity,
 CAST(l.l_extendedprice AS DECIMAL(18,2)) AS proceeds FROM {lineitem} l JOIN {orders} o ON o.o_orderkey=l.l_orderkey""",
    "prices": "SELECT p_partkey AS instrument_id, p_name AS symbol_name, CAST(p_retailprice AS DECIMAL(18,6)) AS price FROM {part}",
    "schedules": """SELECT s_suppkey AS payment_id, s_suppkey AS account_id, s_name AS description,
 -CAST(abs(s_acctbal) AS DECIMAL(18,2)) AS amount, CASE s_suppkey % 5 WHEN 0 THEN 'weekly' WHEN 1 THEN 'biweekly' WHEN 2 THEN 'monthly'
  WHEN 3 THEN 'quarterly' ELSE 'annually' END AS frequency, date_add(DATE '2001-08-01', CAST(s_suppkey % 28 AS INT)) AS next_due FROM {supplier}""",
    # Values, lines and names of files, written from the tables' own.
    "file_values": """SELECT event_id % 499 * 2 + CASE WHEN day(ts) <= 12 THEN 0 ELSE 1 END AS file, event_id AS row,
 CASE CAST(event_id AS BIGINT) % 499 % 8 WHEN 0 THEN concat('Jan ', CAST(day(ts) AS VARCHAR(2)), ', ', CAST(year(ts) AS VARCHAR(4))) WHEN 1 THEN concat(CAST(year(ts) AS VARCHAR(4)), '-', CAST(month(ts) AS VARCHAR(2)), '-', CAST(day(ts) AS VARCHAR(2))) WHEN 2 THEN 'soon 7'
  WHEN 3 THEN '' WHEN 4 THEN concat(CAST(month(ts) AS VARCHAR(2)), '.', CAST(day(ts) AS VARCHAR(2)), '.', CAST(year(ts) AS VARCHAR(4))) WHEN 5 THEN concat(CAST(month(ts) AS VARCHAR(2)), '/', CAST(day(ts) AS VARCHAR(2)), '/', CAST(year(ts) AS VARCHAR(4)))
  WHEN 6 THEN concat(' ', CAST(1 + event_id % 3 AS VARCHAR(2)), '-', CAST(1 + event_id % 2 AS VARCHAR(2)), '-24 ') ELSE concat(CAST(day(ts) AS VARCHAR(2)), '/', CAST(month(ts) AS VARCHAR(2)), '/', CAST(year(ts) AS VARCHAR(4))) END AS value FROM {events}""",
    "file_lines": """SELECT CAST(floor(event_id / 20) AS BIGINT) AS file, event_id % 20 AS line_no,
 CASE WHEN event_id % 20 = CAST(floor(event_id / 20) AS BIGINT) % 9 THEN CASE CAST(floor(event_id / 20) AS BIGINT) % 5 WHEN 0 THEN 'Date,Description,Amount' WHEN 1 THEN ' "Posting Date" ,memo,' WHEN 2 THEN 'Booking date,Some amount' WHEN 3 THEN 'Date,only' ELSE 'foo,BALANCE,"narrative text"' END
  ELSE concat(event_type, ',', CAST(event_id AS VARCHAR(12))) END AS line FROM {events}""",
    "named_accounts": """SELECT c.c_custkey AS account_id, CAST(c.c_nationkey AS BIGINT) AS user_id, p.p_name AS name, CASE WHEN c.c_custkey % 10 = 0 THEN c.c_mktsegment END AS institution FROM {customer} c JOIN {part} p ON p.p_partkey = c.c_custkey % 200""",
    "uploads": """SELECT o.o_orderkey AS file, CAST(o.o_custkey % 25 AS BIGINT) AS user_id, CASE o.o_orderkey % 4 WHEN 0 THEN concat('statement ', p.p_name, '.csv') WHEN 1 THEN concat('x', p.p_name, 'x building date,amount') WHEN 2 THEN upper(substr(p.p_name, 1, 9)) ELSE concat(o.o_orderpriority, ' export') END AS text
 FROM {orders} o JOIN {part} p ON p.p_partkey = o.o_orderkey % 200""",
    "report_lines": """SELECT o_custkey AS file, CAST(-1 AS BIGINT) AS block, CAST(0 AS BIGINT) AS seq, 'Trades,Header,DataDiscriminator,Asset Category,Symbol,Date/Time,Quantity,Proceeds' AS line FROM {orders} GROUP BY o_custkey
 UNION ALL SELECT o.o_custkey, CAST(l.l_orderkey AS BIGINT), CAST(l.l_linenumber AS BIGINT), concat('Trades,Data,', CASE l.l_linenumber % 4 WHEN 0 THEN 'Trade' ELSE 'Order' END, ',Stocks,S', CAST(l.l_partkey AS VARCHAR(12)), ',', CASE l.l_linenumber % 5 WHEN 1 THEN 'someday' ELSE CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR(10)) END,
  ',"', CAST(CAST(l.l_quantity AS INTEGER) AS VARCHAR(9)), '",(', CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(20)), ')') FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey""",
    "card_rows": """SELECT txn_id, account_id, ts, amount, CASE txn_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'no json' WHEN 2 THEN concat(chr(123), '"Post Date": " ', CAST(month(p) AS VARCHAR(2)), '/', CAST(day(p) AS VARCHAR(2)), '/', CAST(year(p) AS VARCHAR(4)), '"', chr(125))
  WHEN 3 THEN concat(chr(123), '"Amount": "1", "Post Date": "", "posted_date": "', CAST(day(p) AS VARCHAR(2)), '/', CAST(month(p) AS VARCHAR(2)), '/', CAST(year(p) AS VARCHAR(4)), '"', chr(125)) WHEN 4 THEN concat(chr(123), '"Settlement Date": "', CAST(p AS VARCHAR(10)), '"', chr(125)) ELSE concat(chr(123), '"Post Date": "soon"', chr(125)) END AS raw_data
 FROM (SELECT o_orderkey AS txn_id, o_custkey AS account_id, o_orderdate AS ts, date_add(CAST(o_orderdate AS DATE), CAST(o_orderkey % 17 - 1 AS INT)) AS p, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM {orders}) x""",
    "stock_trades": """SELECT o.o_custkey AS account_id, l.l_partkey % 4 AS instrument_id, CAST(l.l_shipdate AS DATE) AS trade_ts, CAST(CASE WHEN l.l_returnflag='R' THEN -l.l_quantity ELSE l.l_quantity END AS DECIMAL(18,6)) AS quantity
 FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey WHERE o.o_custkey % 5 > 0""",
    "lots": """SELECT c_custkey AS account_id, c_custkey % 4 AS instrument_id, CAST(c_custkey % 90 AS DECIMAL(18,6)) AS quantity FROM {customer} WHERE c_custkey % 3 > 0""",
    "quotes": """SELECT l_partkey % 4 AS instrument_id, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS day, max(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE)) AS close FROM {lineitem}
 WHERE (l_partkey % 4 + month(l_shipdate)) % 5 > 0 GROUP BY 1, 2""",
    "loan_rows": """SELECT event_id AS txn_id, user_id AS account_id, CAST(floor(user_id / 3) AS BIGINT) AS owner, ts, CAST(CASE WHEN user_id % 3 = 0 THEN floor(value/25)*25+25 ELSE -(floor(value/25)*25+25) END + CASE WHEN event_id % 4 = 0 THEN 0.75 ELSE 0 END AS DECIMAL(18,2)) AS amount,
 CAST(floor(event_id / 300) AS BIGINT) AS import_batch_id, user_id % 3 = 0 AS is_loan FROM {events}""",
    # Orders as documents; every fifth net amount is off by a unit, every seventh document lacks something.
    "order_lines": """SELECT o.o_orderkey AS n, o.o_custkey AS account_id, CAST(o.o_orderdate AS DATE) AS day, o.o_orderkey % 2 = 0 AS pay, CASE WHEN o.o_orderkey % 7 = 3 THEN o.o_orderkey % 4 ELSE -1 END AS lacks, CAST(CASE WHEN o.o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS off, l.l_linenumber AS k,
 CASE l.l_suppkey % 5 WHEN 0 THEN 'income' WHEN 1 THEN 'expense' WHEN 2 THEN 'transfer' WHEN 3 THEN 'liability' ELSE 'other' END AS kind,
 CASE l.l_partkey % 12 WHEN 0 THEN 'salary_gross' WHEN 1 THEN 'federal_tax' WHEN 2 THEN 'retirement_401k' WHEN 3 THEN 'dental' WHEN 4 THEN 'net_pay' WHEN 5 THEN 'Rent' WHEN 6 THEN 'owner_draw' WHEN 7 THEN 'prepaid_rent' WHEN 8 THEN 'medicare' ELSE 'misc' END AS code,
 CASE WHEN l.l_suppkey % 3 = 0 THEN 'Property tax' ELSE 'Other' END AS label, CAST(CASE WHEN l.l_suppkey % 5 = 0 THEN l.l_extendedprice ELSE -l.l_extendedprice END AS DECIMAL(18,2)) AS amount, l.l_partkey % 3 > 0 AS is_cash, l.l_linenumber = 5 AS excluded
 FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey""",
}
_BASE = ("customer", "orders", "part", "lineitem", "events", "supplier")


@dataclass
class Ledger:
    """The views of one folder, made when asked for."""

    spark: SparkSession
    sf_dir: str
    _made: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._made:
            used = {b: self.spark.read.parquet(f"{self.sf_dir}/{b}.parquet") for b in _BASE if f"{{{b}}}" in VIEWS[name]}
            self._made[name] = self.spark.sql(VIEWS[name], **used)
        return self._made[name]


def oracle(sql: str, *names: str) -> str:
    """``sql`` after the named views, for the oracle, where base tables are views themselves."""
    parts = [f"{n} AS ({VIEWS[n].format(**{b: b for b in _BASE})})" for n in names]
    body = sql.strip()
    start = "WITH RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else "WITH "
    head = start + ",\n".join(parts)
    return f"{head},\n{body[len(start) :].strip()}" if body.upper().startswith("WITH ") else f"{head}\n{body}"
