import datetime as dt
from decimal import Decimal

from talliver.sources import statements


def test_columns_are_found_by_name_then_by_part(spark):
    names = [("a", 0, "Posting Date"), ("a", 1, "Memo text"), ("a", 2, "Payee"), ("a", 3, "Amt (USD)"), ("b", 0, "Value date"), ("b", 1, "Debit"), ("b", 2, "CREDIT "), ("b", 3, "other")]
    got = {(r["file"], r["role"]): r["name"] for r in statements.detect_columns(spark.createDataFrame(names, "file string, position int, name string")).collect()}
    assert got == {("a", "date"): "Posting Date", ("a", "description"): "Payee", ("a", "amount"): "Amt (USD)", ("b", "date"): "Value date", ("b", "debit"): "Debit", ("b", "credit"): "CREDIT "}


def test_files_are_read_and_rows_parsed(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Date,Details,Debit,Credit\n31/01/2024,Shop,"1,200.50",\n2024-02-03, Pay ,,£20\nsoon,Lost,1,\n01/02/2024,,1,\n02/02/2024,None,,\n')
    rows = statements.read_ledger_files(spark, str(tmp_path))
    got = statements.normalise_rows(rows, {"date": "Date", "description": "Details", "debit": "Debit", "credit": "Credit"}).collect()
    assert sorted((r["day"], r["text"], r["parsed"]) for r in got) == [(dt.date(2024, 1, 31), "Shop", Decimal("-1200.50")), (dt.date(2024, 2, 3), "Pay", Decimal("20.00"))]
    assert all(r["file"].endswith("x.csv") for r in got)


def test_month_first_and_broken_cells(spark):
    df = spark.createDataFrame([("01/31/2024", "x", "(5)"), ("31/01/2024", "x", "5"), ("01/02/2024", "x", "12abc"), (None, None, None)], "d string, t string, a string")
    got = statements.normalise_rows(df, {"date": "d", "description": "t", "amount": "a"}, day_first=False).collect()
    assert [(r["day"], r["parsed"]) for r in got] == [(dt.date(2024, 1, 31), Decimal("-5.00"))]
