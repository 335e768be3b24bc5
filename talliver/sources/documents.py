"""Payroll and rental documents: nested JSON to headers, numbered lines, one ledger row with its splits, and what can't be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talliver.operators.ledger_jobs import parse_amount
from talliver.sources.statements import parse_date

MONEY = "decimal(18,2)"
# Kinds of documents, the slack of their net sum, and names of fields.
KINDS = ("payroll", "rental_statement")
SLACK = "0.02"
SPAN = "struct<start: string, end: string>"
LINE = "struct<kind: string, label: string, code: string, amount: string, currency: string, is_cash: boolean, excluded_from_net_sum: boolean>"
SHAPE = f"document_type string, currency string, employer string, counterparty string, property_code string, reference string, statement_date string, pay_date string, period_start string, period_end string, pay_period {SPAN}, period {SPAN}, net_pay string, net_bank_deposit string, lines array<{LINE}>, bad string"
# Codes of payroll lines by event; any code with "tax", "401" or "pension" belongs with its own.
GROSS = ("salary_gross", "gross", "gross_pay")
TAXES = ("federal_tax", "state_tax", "local_tax", "social_security", "medicare", "fica")
SAVINGS = ("retirement_401k", "401k_employee")
BENEFITS = ("health_insurance", "dental", "vision", "hsa", "health")
NETS = ("net_pay", "net_salary", "net_salary_cash")
RENTS, DRAWS = ("rent", "rental_income", "late_fee_income"), ("owner_draw", "distribution")
# Events and spend types of named pay components.
COMPONENTS = {
    "salary_gross": ("payroll_income", None), "payroll_tax": ("tax_payment", "tax"), "pension_contribution_employee": ("investment_contribution", None), "pension_contribution_employer": ("employer_benefit", None),
    "health_benefit": ("employer_benefit", None), "wellbeing_benefit": ("employer_benefit", None), "other_deduction": ("fee", "fixed_core"), "net_salary_cash": ("external_income", None),
}
# Column names that hint at the fields of a pay stub.
STUB_HINTS = {
    "pay_date": ("pay date", "check date", "payment date", "date"), "period_start": ("period start", "pay period start", "start date", "begin"), "period_end": ("period end", "pay period end", "end date"),
    "gross_pay": ("gross pay", "gross", "gross earnings", "total earnings"), "net_pay": ("net pay", "net", "take home", "net earnings"), "federal_tax": ("federal tax", "federal", "fed tax", "federal withholding"),
    "state_tax": ("state tax", "state", "state withholding"), "local_tax": ("local tax", "local", "city tax"), "social_security": ("social security", "fica", "ss", "oasdi"), "medicare": ("medicare", "med tax"),
    "retirement_401k": ("401k", "401(k)", "retirement", "pension"), "health_insurance": ("health", "medical", "health insurance"), "dental_insurance": ("dental", "dental insurance"), "vision_insurance": ("vision", "vision insurance"),
    "hsa_contribution": ("hsa", "health savings"), "employer": ("employer", "company"),
}


def _day(text: Column) -> Column:
    """A day in ISO form (a time after it is ignored) or as month/day/year."""
    bare = F.trim(text)
    iso = F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), F.try_to_timestamp(F.substring(bare, 1, 10), F.lit("yyyy-MM-dd")))
    return F.coalesce(iso, F.try_to_timestamp(F.substring(bare, 1, 10), F.lit("M/d/yyyy"))).cast("date")


def _blank(column: str) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def read_documents(raw: DataFrame) -> dict[str, DataFrame]:
    """``documents``, ``lines`` and ``quarantine`` of (account_id, json) rows.

    A document's id is the SHA-256 of its natural key (account, kind, day,
    reference, party, net), so a document that arrives again is the same one.
    In quarantine, with the first reason that holds: no object, an unknown
    kind, no day, no net amount, a rental statement without property, a line
    without a readable amount, lines that don't sum to the net amount within
    0.02 (lines marked as excluded aside).  A document without lines has a sum
    of 0.  Missing amounts are 0, currencies the document's (USD without one).
    """
    d = F.from_json("json", SHAPE, {"columnNameOfCorruptRecord": "bad"})
    docs = raw.select("account_id", "json", d.alias("d")).select("account_id", "json", "d.*")
    kind = F.lower(F.coalesce("document_type", F.lit("")))
    docs = docs.withColumns({
        "kind": kind,
        "currency": F.coalesce("currency", F.lit("USD")),
        "day": F.coalesce(_day(_blank("statement_date")), F.when(_blank("statement_date").isNull(), _day(_blank("pay_date")))),
        "start": F.coalesce(_day(F.coalesce(_blank("period_start"), _blank("pay_period.start"))), _day(F.col("period.start"))),
        "end": F.coalesce(_day(F.coalesce(_blank("period_end"), _blank("pay_period.end"))), _day(F.col("period.end"))),
        "party": F.coalesce(_blank("employer"), _blank("counterparty")),
        "net": F.when(kind == "payroll", F.col("net_pay")).otherwise(F.col("net_bank_deposit")).try_cast(MONEY),
        "lines": F.coalesce("lines", F.array().cast(f"array<{LINE}>")),
    })
    cents = F.transform("lines", lambda x: F.coalesce(x["amount"], F.lit("0")).try_cast(MONEY))
    counted = F.filter(F.arrays_zip(cents.alias("amount"), F.transform("lines", lambda x: F.coalesce(x["excluded_from_net_sum"], F.lit(False))).alias("excluded")), lambda x: ~x["excluded"])
    total = F.aggregate(F.transform(counted, lambda x: x["amount"]), F.lit(0).cast("decimal(38,2)"), lambda s, x: (s + x).cast("decimal(38,2)"))
    reason = (
        F.when(F.col("document_type").isNull() & (F.col("bad").isNotNull() | F.col("json").isNull() | ~F.trim("json").startswith("{")), "no object").when(~F.col("kind").isin(*KINDS), "kind").when(F.col("day").isNull(), "day").when(F.col("net").isNull(), "net amount")
        .when((F.col("kind") == "rental_statement") & _blank("property_code").isNull(), "property").when(F.exists(cents, lambda x: x.isNull()), "line amount").when(F.abs(total - F.col("net")) > F.lit(SLACK).cast(MONEY), "net sum")
    )
    docs = docs.withColumn("reason", reason)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = F.sha2(F.concat_ws("\u001f", *[text(c) for c in ("account_id", "kind", "day", "reference", "party", "property_code", "net")]), 256)
    good = docs.filter("reason is null").withColumn("document_id", key).dropDuplicates(["document_id"])
    head = good.select("document_id", "account_id", F.col("kind").alias("document_type"), F.col("day").alias("statement_date"), F.col("start").alias("period_start"), F.col("end").alias("period_end"), "currency", "reference", F.col("party").alias("employer_or_counterparty"), "property_code", F.col("net").alias("net_amount"))
    each = good.select("document_id", F.col("currency").alias("of"), F.posexplode("lines").alias("line_no", "line"))
    lines = each.select(
        "document_id", "line_no", F.lower(F.coalesce("line.kind", F.lit("income"))).alias("kind"), "line.code", F.coalesce("line.label", "line.code", F.lit("")).alias("label"), F.coalesce("line.amount", F.lit("0")).try_cast(MONEY).alias("amount"),
        F.coalesce("line.currency", "of").alias("currency"), F.coalesce("line.is_cash", F.lit(True)).alias("is_cash"), F.coalesce("line.excluded_from_net_sum", F.lit(False)).alias("excluded"),
    )
    return {"documents": head, "lines": lines, "quarantine": docs.filter("reason is not null").select("account_id", "json", "reason")}


def line_event(document_type: Column) -> Column:
    """Economic event of a line (kind, code, label, amount, excluded)."""
    code, kind = F.lower(F.coalesce("code", F.lit(""))), F.col("kind")
    pay = (
        F.when(F.col("excluded") & (F.col("amount") > 0), "employer_benefit").when(code.isin(*GROSS), "payroll_income").when(code.contains("tax") | code.isin(*TAXES), "tax_payment")
        .when(code.contains("401") | code.contains("pension") | code.isin(*SAVINGS), "investment_contribution").when(code.isin(*BENEFITS), "fee").when(code.isin(*NETS), "external_income").when(kind == "income", "payroll_income")
        .when((kind == "expense") & F.lower("label").contains("tax"), "tax_payment").when(kind == "expense", "fee").otherwise("payroll_income")
    )
    rent = (
        F.when((kind == "income") | code.isin(*RENTS), "rental_income").when(kind == "expense", "rental_expense").when((kind == "transfer") | code.isin(*DRAWS), "owner_distribution")
        .when((kind == "liability") | code.contains("prepaid"), "deferred_rent_liability").otherwise("rental_expense")
    )
    return F.when(document_type == "payroll", pay).otherwise(rent)


def apply_documents(documents: DataFrame, lines: DataFrame) -> dict[str, DataFrame]:
    """``transactions`` (one row of the net amount for each document) and ``splits`` (one for each line).

    Splits of excluded lines, and of liabilities that are no cash, are 0, so
    the splits of a row sum to its amount.  Taxes, fees and rental expenses
    count as spend; contributions to a pension are marked for their account.
    """
    party = F.when(F.col("document_type") == "payroll", F.concat(F.lit("Payroll "), F.coalesce("employer_or_counterparty", F.lit("deposit")))).otherwise(F.concat(F.lit("Rental operating "), F.col("property_code")))
    row = F.sha2(F.concat(F.lit("row\u001f"), F.col("document_id")), 256)
    txns = documents.select(row.alias("txn_id"), "document_id", "account_id", F.col("statement_date").alias("day"), F.substring(F.concat(party, F.lit(" "), F.col("statement_date").cast("string")), 1, 500).alias("description"), F.col("net_amount").alias("amount"), "currency", F.when(F.col("document_type") == "payroll", "payroll_income").otherwise("rental_income").alias("event_type"))
    all_lines = lines.join(documents.select("document_id", "document_type", F.col("currency").alias("of")), "document_id").withColumn("event_type", line_event(F.col("document_type")))
    pay = F.col("document_type") == "payroll"
    spend = F.when(pay & (F.col("event_type") == "tax_payment"), "tax").when(pay & (F.col("event_type") == "fee"), "fixed_core").when(~pay & (F.col("event_type") == "rental_expense"), "fixed_core")
    nothing = F.col("excluded") | (~pay & (F.col("kind") == "liability") & ~F.col("is_cash"))
    code = F.lower(F.coalesce("code", F.lit("")))
    splits = all_lines.withColumn("spend_type", spend).select(
        row.alias("txn_id"), F.col("line_no").alias("split_no"), F.when(nothing, F.lit(0)).otherwise(F.col("amount")).cast(MONEY).alias("amount"), F.col("of").alias("currency"), "event_type", "spend_type", F.col("spend_type").isNotNull().alias("counts_as_spend"),
        (pay & (code.contains("401") | code.contains("pension"))).alias("to_pension"), F.coalesce("code", "label").alias("notes"),
    )
    return {"transactions": txns, "splits": splits}


def payroll_components(rows: DataFrame) -> DataFrame:
    """(txn_id, component, amount, event_type, spend_type, counts_as_spend, to_pension) of (txn_id, components map<string,decimal>); unknown components are income from outside."""
    each = rows.select("txn_id", F.explode("components").alias("component", "amount"))
    pick = lambda i: F.coalesce(*[F.when(F.col("component") == c, F.lit(v[i])) for c, v in COMPONENTS.items() if v[i]])
    each = each.withColumns({"event_type": F.coalesce(pick(0), F.lit("external_income")), "spend_type": pick(1)})
    return each.select("txn_id", "component", F.col("amount").cast(MONEY).alias("amount"), "event_type", "spend_type", F.col("spend_type").isNotNull().alias("counts_as_spend"), F.col("component").startswith("pension_contribution").alias("to_pension"))


def paycheck_columns(names: list[str]) -> dict[str, str]:
    """Field to column of a pay stub file: the leftmost column that is or holds one of the field's hints."""
    found = {}
    for field, hints in STUB_HINTS.items():
        fits = [n for n in names if any(h in n.lower().strip() for h in hints)]
        if fits:
            found[field] = fits[0]
    return found


def read_paychecks(rows: DataFrame, day_first: bool = True) -> DataFrame:
    """Pay stubs of a file's rows (all cells text); rows without a day, a gross or a net amount go, other amounts are 0 where they can't be read."""
    where = paycheck_columns(rows.columns)
    cell = lambda f: F.col(f"`{where[f]}`") if f in where else F.lit(None).cast("string")
    out = {f: parse_date(cell(f), day_first) for f in ("pay_date", "period_start", "period_end")} | {f: parse_amount(cell(f)) for f in ("gross_pay", "net_pay")}
    out |= {f: F.coalesce(parse_amount(cell(f)), F.lit(0)).cast(MONEY) for f in STUB_HINTS if f not in (*out, "employer")} | {"employer": F.nullif(F.trim(cell("employer")), F.lit(""))}
    return rows.select(*[c.alias(f) for f, c in out.items()]).filter("pay_date is not null and gross_pay is not null and net_pay is not null")


def read_document_files(spark: SparkSession, path: str, account_id: int) -> dict[str, DataFrame]:
    """``read_documents`` of a folder of JSON files, one document a file."""
    return read_documents(spark.read.text(path, wholetext=True).select(F.lit(account_id).cast("long").alias("account_id"), F.col("value").alias("json")))
