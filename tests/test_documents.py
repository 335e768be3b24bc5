"""Documents from planted files: two kinds, what goes to quarantine, splits that sum to the net amount."""

import datetime as dt
import json
from decimal import Decimal as D

from talliver.sources import documents

PAY = {
    "document_type": "PAYROLL", "currency": "EUR", "employer": "Works", "pay_date": "2024-02-29", "pay_period": {"start": "2024-02-01", "end": "02/29/2024"}, "reference": "p1", "net_pay": 700.01,
    "lines": [
        {"kind": "Income", "code": "gross", "label": "Gross", "amount": 1000}, {"kind": "expense", "code": "city_tax", "amount": -200.5, "is_cash": False}, {"kind": "expense", "label": "Wage TAX", "amount": "-49.5"}, {"kind": "expense", "code": "pension_own", "amount": -50, "x": 1},
        {"kind": "income", "code": "match_401k", "amount": 30, "excluded_from_net_sum": True}, {"kind": "other"},
    ],
}
RENT = {
    "document_type": "rental_statement", "property_code": "elm", "statement_date": "2024-03-31T10:00:00", "period": {"start": "2024-03-01", "end": "2024-03-31"}, "counterparty": "Agents", "net_bank_deposit": "300",
    "lines": [{"kind": "income", "code": "rent", "amount": 500}, {"kind": "expense", "amount": -100}, {"kind": "transfer", "amount": -100}, {"kind": "liability", "code": "prepaid", "amount": 60, "is_cash": False, "excluded_from_net_sum": True}],
}


def test_documents(spark, tmp_path):
    bad = [{"document_type": "memo"}, PAY | {"pay_date": "someday"}, PAY | {"net_pay": None}, RENT | {"property_code": " "}, PAY | {"lines": [{"amount": "many"}]}, PAY | {"net_pay": 700.04}, RENT | {"lines": []}]
    for i, doc in enumerate([PAY, RENT, PAY, *bad]):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "x.json").write_text("[1, 2]")
    (tmp_path / "y.json").write_text('{"document_type": ')
    found = documents.read_document_files(spark, str(tmp_path), 7)
    heads = {r["document_type"]: r for r in found["documents"].collect()}
    assert len(heads) == 2 and found["documents"].count() == 2  # a document that arrives again is the same one
    pay, rent = heads["payroll"], heads["rental_statement"]
    assert (pay["account_id"], pay["statement_date"], pay["period_start"], pay["period_end"], pay["currency"], pay["employer_or_counterparty"], pay["net_amount"]) == (7, dt.date(2024, 2, 29), dt.date(2024, 2, 1), dt.date(2024, 2, 29), "EUR", "Works", D("700.01"))
    assert (rent["statement_date"], rent["period_end"], rent["currency"], rent["property_code"], rent["employer_or_counterparty"]) == (dt.date(2024, 3, 31), dt.date(2024, 3, 31), "USD", "elm", "Agents")
    lines = sorted((r["line_no"], r["kind"], r["code"], r["label"], r["amount"], r["is_cash"], r["excluded"]) for r in found["lines"].filter(found["lines"]["document_id"] == pay["document_id"]).collect())
    assert lines[1:3] == [(1, "expense", "city_tax", "city_tax", D("-200.50"), False, False), (2, "expense", None, "Wage TAX", D("-49.50"), True, False)] and lines[5][1:] == ("other", None, "", D("0.00"), True, False)
    assert sorted(r["reason"] for r in found["quarantine"].collect()) == ["day", "kind", "line amount", "net amount", "net sum", "net sum", "no object", "no object", "property"]
    made = documents.apply_documents(found["documents"], found["lines"])
    rows = {r["document_id"]: r for r in made["transactions"].collect()}
    assert rows[pay["document_id"]]["description"] == "Payroll Works 2024-02-29" and rows[rent["document_id"]]["event_type"] == "rental_income"
    splits = {k: sorted((r["split_no"], r["amount"], r["event_type"], r["spend_type"], r["to_pension"]) for r in made["splits"].collect() if r["txn_id"] == rows[d["document_id"]]["txn_id"]) for k, d in (("pay", pay), ("rent", rent))}
    assert splits["pay"] == [
        (0, D("1000.00"), "payroll_income", None, False), (1, D("-200.50"), "tax_payment", "tax", False), (2, D("-49.50"), "tax_payment", "tax", False), (3, D("-50.00"), "investment_contribution", None, True), (4, D("0.00"), "employer_benefit", None, True), (5, D("0.00"), "payroll_income", None, False)]
    assert splits["rent"] == [(0, D("500.00"), "rental_income", None, False), (1, D("-100.00"), "rental_expense", "fixed_core", False), (2, D("-100.00"), "owner_distribution", None, False), (3, D("0.00"), "deferred_rent_liability", None, False)]
    assert abs(sum(s[1] for s in splits["pay"]) - D("700.01")) <= D("0.02") and sum(s[1] for s in splits["rent"]) == D("300.00")


def test_paychecks(spark):
    assert documents.paycheck_columns(["Start date", "Pay Date", "Net", "Gross", "State"]) == {"pay_date": "Start date", "period_start": "Start date", "gross_pay": "Gross", "net_pay": "Net", "state_tax": "State", "social_security": "Gross"}
    rows = spark.createDataFrame([("05/02/2024", "1,000.00", "(7)", "x", ""), ("never", "1", "1", "1", "a"), ("05/02/2024", "", "1", "1", "a")], ["Pay Date", "Gross", "Net", "HSA", "Company"])
    got = [r.asDict() for r in documents.read_paychecks(rows).collect()]
    assert len(got) == 1 and (got[0]["pay_date"], got[0]["gross_pay"], got[0]["net_pay"], got[0]["hsa_contribution"], got[0]["medicare"], got[0]["employer"]) == (dt.date(2024, 2, 5), D("1000.00"), D("-7.00"), D(0), D(0), None)
