"""Queries over documents that are written as JSON from the tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from talliver.plans.queries import query
from talliver.sources import documents

_DOCS = """d AS (SELECT n, account_id, day, pay, lacks, CAST(coalesce(sum(amount) FILTER (NOT excluded), 0) + off AS DECIMAL(18,2)) AS net, coalesce(sum(amount) FILTER (NOT excluded), 0) AS total FROM order_lines GROUP BY n, account_id, day, pay, lacks, off),
r AS (SELECT *, CASE WHEN lacks = 0 THEN 'kind' WHEN lacks = 1 THEN 'day' WHEN lacks = 2 THEN 'net amount' WHEN lacks = 3 AND NOT pay THEN 'property' WHEN abs(total - net) > 0.02 THEN 'net sum' END AS reason FROM d)"""


def _raw(led):
    line = F.struct("kind", "code", "label", F.col("amount").cast("string").alias("amount"), "is_cash", F.col("excluded").alias("excluded_from_net_sum"))
    docs = led.order_lines.groupBy("n", "account_id", "day", "pay", "lacks", "off").agg(F.coalesce(F.sum(F.when(~F.col("excluded"), F.col("amount"))), F.lit(0)).cast("decimal(38,2)").alias("net"), F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    net = F.when(F.col("lacks") != 2, (F.col("net") + F.col("off")).cast("string"))
    body = F.struct(
        F.when(F.col("lacks") == 0, "memo").when(F.col("pay"), "Payroll").otherwise("rental_statement").alias("document_type"), F.when(F.col("pay"), F.concat(F.lit("Employer "), F.col("account_id").cast("string"))).alias("employer"), F.when((F.col("lacks") != 3) & ~F.col("pay"), "oak").alias("property_code"),
        F.col("n").cast("string").alias("reference"), F.when((F.col("lacks") != 1) & ~F.col("pay"), F.col("day").cast("string")).alias("statement_date"), F.when((F.col("lacks") != 1) & F.col("pay"), F.date_format("day", "MM/dd/yyyy")).alias("pay_date"), F.when(F.col("pay"), net).alias("net_pay"), F.when(~F.col("pay"), net).alias("net_bank_deposit"), "lines",
    )
    return docs.select("account_id", F.to_json(body).alias("json"))


@query(f"WITH {_DOCS} SELECT coalesce(reason, 'read') AS outcome, CASE WHEN reason IS NULL THEN CASE WHEN pay THEN 'payroll' ELSE 'rental_statement' END END AS document_type, account_id, count(*) AS n, CAST(sum(CASE WHEN reason IS NULL THEN net END) AS DECIMAL(38,2)) AS net FROM r GROUP BY ALL", "order_lines")
def i11_read_documents(led):
    found = documents.read_documents(_raw(led))
    good = found["documents"].select(F.lit("read").alias("outcome"), "document_type", "account_id", F.col("net_amount").alias("net"))
    bad = found["quarantine"].select(F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("document_type"), "account_id", F.lit(None).cast("decimal(18,2)").alias("net"))
    return good.unionAll(bad).groupBy("outcome", "document_type", "account_id").agg(F.count("*").alias("n"), F.sum("net").cast("decimal(38,2)").alias("net"))


@query(
    f"""WITH {_DOCS} SELECT account_id, day, CASE WHEN pay THEN concat('Payroll Employer ', account_id, ' ', day) ELSE concat('Rental operating oak ', day) END AS description, CAST(net AS DECIMAL(18,2)) AS amount, CASE WHEN pay THEN 'payroll_income' ELSE 'rental_income' END AS event_type, CAST(net AS DECIMAL(38,2)) AS split_sum
 FROM r WHERE reason IS NULL AND NOT EXISTS (SELECT 1 FROM order_lines o WHERE o.n = r.n AND NOT o.pay AND o.kind = 'liability' AND NOT o.is_cash AND NOT o.excluded)""",
    "order_lines",
)
def i17_apply_documents(led):
    """Ledger rows of documents whose splits sum to the row: those without a liability that is no cash but counts in the sum."""
    found = documents.read_documents(_raw(led))
    made = documents.apply_documents(found["documents"], found["lines"])
    sums = made["splits"].groupBy("txn_id").agg(F.sum("amount").cast("decimal(38,2)").alias("split_sum"))
    return made["transactions"].join(sums, "txn_id").filter("split_sum = amount").select("account_id", "day", "description", "amount", "event_type", "split_sum")


_EVENT = """CASE WHEN pay THEN CASE WHEN excluded AND amount > 0 THEN 'employer_benefit' WHEN code = 'salary_gross' THEN 'payroll_income' WHEN code IN ('federal_tax', 'medicare') THEN 'tax_payment' WHEN code = 'retirement_401k' THEN 'investment_contribution' WHEN code = 'dental' THEN 'fee'
 WHEN code = 'net_pay' THEN 'external_income' WHEN kind = 'income' THEN 'payroll_income' WHEN kind = 'expense' THEN CASE WHEN contains(lower(label), 'tax') THEN 'tax_payment' ELSE 'fee' END ELSE 'payroll_income' END
 ELSE CASE WHEN kind = 'income' OR lower(code) = 'rent' THEN 'rental_income' WHEN kind = 'expense' THEN 'rental_expense' WHEN kind = 'transfer' OR code = 'owner_draw' THEN 'owner_distribution' WHEN kind = 'liability' OR contains(code, 'prepaid') THEN 'deferred_rent_liability' ELSE 'rental_expense' END END"""


@query(
    f"""WITH {_DOCS}, e AS (SELECT o.*, {_EVENT} AS event_type FROM order_lines o WHERE EXISTS (SELECT 1 FROM r WHERE r.n = o.n AND reason IS NULL)),
s AS (SELECT account_id, event_type, CASE WHEN pay AND event_type = 'tax_payment' THEN 'tax' WHEN (pay AND event_type = 'fee') OR event_type = 'rental_expense' THEN 'fixed_core' END AS spend_type, pay AND code = 'retirement_401k' AS to_pension, CASE WHEN excluded OR (NOT pay AND kind = 'liability' AND NOT is_cash) THEN 0 ELSE amount END AS amount FROM e)
SELECT account_id, event_type, spend_type, to_pension, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM s GROUP BY ALL""",
    "order_lines",
)
def x15_document_events(led):
    """Splits of all documents by account and event."""
    found = documents.read_documents(_raw(led))
    made = documents.apply_documents(found["documents"], found["lines"])
    rows = made["splits"].join(made["transactions"].select("txn_id", "account_id"), "txn_id")
    return rows.groupBy("account_id", "event_type", "spend_type", "to_pension").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(38,2)").alias("amount"))


@query(
    """SELECT paycheck_id AS txn_id, component, CAST(amount AS DECIMAL(18,2)) AS amount, CASE component WHEN 'salary_gross' THEN 'payroll_income' WHEN 'payroll_tax' THEN 'tax_payment' WHEN 'pension_contribution_employee' THEN 'investment_contribution' WHEN 'health_benefit' THEN 'employer_benefit' ELSE 'external_income' END AS event_type,
 CASE WHEN component = 'payroll_tax' THEN 'tax' END AS spend_type, component = 'payroll_tax' AS counts_as_spend, component = 'pension_contribution_employee' AS to_pension
 FROM (SELECT paycheck_id, unnest(['salary_gross', 'payroll_tax', 'pension_contribution_employee', 'health_benefit', 'bonus']) AS component, unnest([gross, -taxes, -retirement, benefits, 1]) AS amount FROM paychecks)""",
    "paychecks",
)
def x16_payroll_components(led):
    parts = {"salary_gross": F.col("gross"), "payroll_tax": -F.col("taxes"), "pension_contribution_employee": -F.col("retirement"), "health_benefit": F.col("benefits"), "bonus": F.lit(1)}
    cells = [x for name, c in parts.items() for x in (F.lit(name), c.cast("decimal(18,2)"))]
    return documents.payroll_components(led.paychecks.select(F.col("paycheck_id").alias("txn_id"), F.create_map(*cells).alias("components")))


@query(
    "SELECT CAST(pay_date AS DATE) AS pay_date, CAST(gross AS DECIMAL(18,2)) AS gross_pay, CAST(gross - taxes AS DECIMAL(18,2)) AS net_pay, CAST(taxes AS DECIMAL(18,2)) AS federal_tax, CAST(CASE WHEN paycheck_id % 3 = 0 THEN 0 ELSE retirement END AS DECIMAL(18,2)) AS retirement_401k, CASE WHEN paycheck_id % 4 > 0 THEN concat('E', account_id) END AS employer FROM paychecks WHERE paycheck_id % 5 > 0",
    "paychecks",
)
def i10_read_paychecks(led):
    """Pay stubs written as cells and read back; every fifth lacks its net amount."""
    n = F.col("paycheck_id")
    rows = led.paychecks.select(
        F.date_format("pay_date", "dd/MM/yyyy").alias("Check Date "), F.concat(F.lit("$"), F.format_number(F.col("gross"), 2)).alias("GROSS earnings"), F.when(n % 5 > 0, (F.col("gross") - F.col("taxes")).cast("string")).otherwise("n/a").alias("Take home"), F.col("taxes").cast("string").alias("Fed Tax"),
        F.when(n % 3 == 0, "").otherwise(F.col("retirement").cast("string")).alias("401(k)"), F.when(n % 4 > 0, F.concat(F.lit(" E"), F.col("account_id").cast("string"))).otherwise(" ").alias("Company"),
    )
    return documents.read_paychecks(rows).select("pay_date", "gross_pay", "net_pay", "federal_tax", "retirement_401k", "employer")
