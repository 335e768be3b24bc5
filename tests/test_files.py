"""Header rows, date orders, routing, sectioned and grant reports, from planted files and rows."""

import datetime as dt
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talliver.sources import files


@pytest.fixture
def folder(tmp_path):
    def write(**texts):
        for name, text in texts.items():
            (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
        return str(tmp_path)

    return write


def name(column="file"):
    return F.regexp_extract(column, r"([^/\x1f]+)\.csv", 1)


def test_header_rows(spark, folder):
    path = folder(
        plain="Date,Description,Amount\n2024-01-01,x,1\n", late="My bank\n,,\nExported,today\n \"Posting Date\" , Memo ,Value\n1,2,3\n", partly="x,y\nBooking date,Some amount\n", one="Date\nDate,only one\n",
        beyond="a,b\n" * 30 + "Date,Amount\n", same="date,balance\ndate,balance\n",
    )
    got = files.find_header_rows(files.numbered(files.read_lines(spark, path))).withColumn("file", name()).collect()
    assert {r["file"]: r["header"] for r in got} == {"plain": 0, "late": 3, "partly": 1, "one": None, "beyond": None, "same": 0}


def test_date_orders(spark):
    cases = {
        "named": (["04 Mar 2025", "Mar 05, 2025", None, " "], (False, "high", "named month")),
        "iso": (["2025-03-04", "2025/03/05"], (False, "high", "year first")),
        "day": (["13/01/2024", "02/01/2024"], (True, "high", "part above 12")),
        "month": (["01/13/2024", "01.02.2024"], (False, "high", "part above 12")),
        "both": (["13/01/2024", "01/14/2024", "15/02/2024"], (True, "medium", "parts above 12")),
        "tied": (["13/01/2024", "01/14/2024"], (True, "medium", "parts above 12")),
        "rising": (["01/02/2024", "05/02/2024", "09/02/2024", "02/03/2024", "04/03/2024"], (True, "medium", "order")),
        "falling": (["02/01/2024", "02/05/2024", "02/09/2024", "03/02/2024"], (False, "medium", "order")),
        "distinct": (["05/03/24", "05/03/24", "04/03/24", "05/03/24", "04/03/24"], (True, "low", "distinct numbers")),
        "equal": (["03/03/2024", "04/04/2024"], (True, "low", "default")),
        "words": (["soon", "x"], (False, "high", "named month")),
        "none": ([None, ""], (True, "low", "no value")),
        "odd": (["1 2", "n/a"], (True, "low", "no numeric value")),
    }
    cases["words"] = (["soon", "later"], cases["words"][1])
    rows = [(f, i, v) for f, (values, _) in cases.items() for i, v in enumerate(values)]
    got = files.detect_date_order(spark.createDataFrame(rows, "file string, row int, value string").repartition(4)).collect()
    assert {r["file"]: tuple(r)[1:] for r in got} == {f: want for f, (_, want) in cases.items()}


def test_routing(spark):
    accounts = spark.createDataFrame(
        [(1, 10, "Chase Sapphire Card", "Chase"), (1, 11, "Barclays Current", "Barclays"), (1, 12, "Joint savings pot", None), (1, 14, "Joint savings box", None), (2, 13, "Chase Sapphire Card", "Chase"), (3, 15, "", None)],
        "user_id long, account_id long, name string, institution string",
    )
    rows = [("a", 1, "chase-2024.csv date,amount"), ("b", 1, "mybarclaysbank export"), ("c", 1, "joint savings"), ("d", 1, "unknown"), ("e", 2, "SAPPHIRE"), ("f", 1, None), ("g", 3, "chase"), ("h", 9, "chase"), ("i", 1, "Chase and Barclays")]
    got = files.route_files(spark.createDataFrame(rows, "file string, user_id long, text string"), accounts).collect()
    found = {r["file"]: (r["account_id"], round(r["score"], 6), r["verdict"]) for r in got}
    assert found == {"a": (10, 1.0, "routed"), "b": (None, 0.2, "none"), "c": (None, round(2 / 3 + 0.2, 6), "ambiguous"), "d": (None, 0.0, "none"), "e": (13, round(1 / 3 + 0.2, 6), "routed"), "f": (None, 0.0, "none"), "g": (None, 0.0, "none"), "h": (None, 0.0, "none"), "i": (None, 1.0, "ambiguous")}


def test_routing_of_repeated_files_and_names(spark):
    """Equal texts and names meet once: 30,000 files and 30,000 accounts of a user are no 900 million pairs; rows of one file are looked at together."""
    same = spark.range(30_000).select(F.lit(1).alias("user_id"), F.col("id").alias("account_id"), F.lit("Green bolt").alias("name"), F.lit(None).cast("string").alias("institution"))
    other = spark.createDataFrame([(2, 7, "Joint savings pot", None), (2, 6, "cup", "cupboard"), (2, 5, "Blue", "Red ring"), (2, 4, "RED-RING!", None)], same.schema)
    rows = [("a", 2, "joint"), ("a", 2, "joint"), ("a", 3, "joint savings pot"), ("b", 2, "Joint savings"), ("b", 2, "xcupboards"), ("c", 2, "ring, red"), ("d", 2, "blue"), ("d", None, "red ring"), ("e", 2, "xcupboards")]
    named = spark.range(30_000).select(F.concat(F.lit("f"), "id").alias("file"), F.lit(1).alias("user_id"), F.concat(F.lit("2024 "), F.when(F.col("id") % 2 == 0, "green bolt").otherwise("boltgreens")).alias("text"))
    start = time.time()
    got = files.route_files(named.unionAll(spark.createDataFrame(rows, "file string, user_id int, text string")), same.unionAll(other)).collect()
    assert time.time() - start < 60
    found = Counter((r["file"] if r["user"] == 2 else int(r["file"][1:]) % 2, r["account_id"], round(r["score"], 6), r["verdict"]) for r in ({**r.asDict(), "user": 1 if r["file"][1:] else 2} for r in got))
    assert found == {
        (0, None, 1.0, "ambiguous"): 15_000, (1, None, 0.2, "none"): 15_000, ("a", 7, round(1 / 3 + 0.2, 6), "routed"): 3, ("b", 7, round(2 / 3 + 0.2, 6), "routed"): 2,
        ("c", None, 1.0, "ambiguous"): 1, ("d", 5, 1.0, "routed"): 2, ("e", None, 0.2, "none"): 1,
    }


REPORT = """Statement,Header,Field Name,Field Value
Statement,Data,Period,"March 3, 2024 - April 2, 2024"
Account Information,Data,Account,U77
Account Information,Data,Base Currency,EUR
Net Asset Value,Header,Asset Class,Prior Total,Current Total
Net Asset Value,Data,Cash,1,2
Net Asset Value,Data,Total,1,"12,345.5"
Trades,Header,DataDiscriminator,Asset Category,Currency,Symbol,Date/Time,Quantity,T. Price,Proceeds,Comm/Fee,Realized P/L
Trades,Data,Order,Stocks,USD,AAA,"2024-03-04, 09:30:00","1,000",2.5,-2500,-1,0
Dividends,Header,Currency,Date,Description,Amount
Trades,Data,Order,Stocks,,BBB,2024-03-05,-5,10,50,(1.5),--
Dividends,Data,USD,2024-03-07,AAA(US01) Cash Dividend,3.25
Dividends,Data,Total,,,3.25
Dividends,Data,USD,,Total in USD,3.25
Dividends,Data,USD,never,BBB(US02) Cash Dividend,4
Trades,Data,Trade,Stocks,USD,AAA,2024-03-04,1,1,1,1,1
Trades,Data,Order,Forex,USD,EUR.USD,2024-03-04,1,1,1,1,1
Trades,Data,Order,Stocks,USD,CCC,someday,1,1,1,1,1
Trades,SubTotal,,Stocks,USD,AAA,,1000,,,,
Trades,Header,DataDiscriminator,Symbol,Asset Category,Quantity
Trades,Data,Order,DDD,Equity and Index,7
Open Positions,Data,Summary,lost
Open Positions,Header,DataDiscriminator,Symbol,Quantity,Value
Open Positions,Data,Summary,AAA,"1,000","2,600.00"
Open Positions,Data,Lot,AAA,500,1
Financial Instrument Information,Header,Symbol,Description,Security ID,Listing Exch
Financial Instrument Information,Data,AAA,"Alpha, Inc. ""A""\",US01,NYSE
Mark-to-Market Performance Summary,Header,Symbol,Prior Quantity,Prior Price
Mark-to-Market Performance Summary,Data,AAA,10,--

"""


def test_sectioned_report(spark, folder):
    path = folder(one="\ufeff" + REPORT, two="Trades,Data,Order,Stocks,USD,X,2024-01-01,1\n")
    found = {k: [r.asDict() for r in df.withColumn("file", name()).collect()] for k, df in files.read_sectioned_report(files.read_lines(spark, path)).items()}
    assert found["info"] == [{"file": "one", "base_currency": "EUR", "account": "U77", "period_start": dt.date(2024, 3, 3), "period_end": dt.date(2024, 4, 2)}]
    assert found["nav"] == [{"file": "one", "nav_total": 12345.5}]
    trades = sorted((r["symbol"], r["currency"], r["trade_date"], r["quantity"], r["commission"], r["realized_pnl"]) for r in found["trades"])
    assert trades == [("AAA", "USD", dt.datetime(2024, 3, 4, 9, 30), 1000.0, -1.0, 0.0), ("BBB", "USD", dt.datetime(2024, 3, 5), -5.0, -1.5, 0.0)]
    assert [(r["symbol"], r["pay_date"], r["amount"]) for r in found["dividends"]] == [("AAA", dt.date(2024, 3, 7), 3.25)]
    assert [(r["symbol"], r["quantity"], r["value"]) for r in found["positions"]] == [("AAA", 1000.0, 2600.0)]
    assert [(r["symbol"], r["name"], r["isin"], r["currency"]) for r in found["instruments"]] == [("AAA", 'Alpha, Inc. "A"', "US01", "USD")]
    assert [(r["prior_qty"], r["prior_price"]) for r in found["prior_positions"]] == [(10.0, 0.0)]
    assert sorted((r["file"], r["section"], r["reason"]) for r in found["quarantine"]) == [("one", "Dividends", "dividend date"), ("one", "Open Positions", "no header"), ("one", "Trades", "trade date"), ("one", "Trades", "trade date"), ("two", "Trades", "no header")]


GRANTS = """"My Awards"
"Stock Symbol","xyz",
"Stock Price","$1,061.50"
"Stock Price as of date",3/09/2026,
,,,,,,,"01/01/2020","5","5",,"0"
"Award date","Award type/code","Next Vest Date","Awarded Units","Units unvested","Value","Units vested"
"02/13/2026","Stock Units / A1/2","02/15/2027","2,000","1,500","$1.00","500"
,,,,,,,"Vesting date","Units vesting","Units unvested","Value","Units vested"
,,,,,,,"02/15/2027","1,000","500","$1.00","500"
,,,,,,,"13/45/2027","1","1",,"0"
,,,,,,,"02/15/2028","1,000","1,000","$1.00",""
"02/15/2024","Other / B","",30,0,,30
,,,,,,,"02/15/2025",30,0,,30
"""


def test_grant_report(spark, folder):
    path = folder(a=GRANTS + '"Total",,,"2,030","1,500",,"530"\n', b='"Restricted Stock Units","Awarded Units","Units unvested","Value","Units vested"\n,"3,000","2,000","$1.00","1,000"\n')
    found = {k: [r.asDict() for r in df.withColumn("file", name()).collect()] for k, df in files.read_grant_report(files.read_lines(spark, path)).items()}
    assert [(r["grant_no"], r["award_date"], r["award_type"], r["award_code"], r["awarded"], r["unvested"], r["vested"]) for r in sorted(found["grants"], key=lambda r: r["grant_no"])] == [
        (1, dt.date(2026, 2, 13), "Stock Units", "A1/2", 2000.0, 1500.0, 500.0), (2, dt.date(2024, 2, 15), "Other", "B", 30.0, 0.0, 30.0)]
    assert sorted((r["grant_no"], r["vest_date"], r["units"], r["unvested"], r["vested"]) for r in found["vests"] if r["vested"] is not None) == [(1, dt.date(2027, 2, 15), 1000.0, 500.0, 500.0), (2, dt.date(2025, 2, 15), 30.0, 0.0, 30.0)]
    assert [(r["vest_date"], r["vested"]) for r in found["vests"] if r["vested"] is None] == [(dt.date(2028, 2, 15), None)]
    totals = {r.pop("file"): r for r in found["totals"]}
    assert totals["a"] == {"symbol": "XYZ", "stock_price": 1061.5, "price_date": dt.date(2026, 3, 9), "awarded": 2030.0, "unvested": 1500.0, "vested": 530.0}
    assert (totals["b"]["awarded"], totals["b"]["unvested"], totals["b"]["vested"]) == (3000.0, 2000.0, 1000.0)
    assert sorted(r["reason"] for r in found["quarantine"]) == ["no grant above", "vest date"]


def test_headers_are_carried_over_blocks(spark):
    """What a line inherits comes from an earlier block where its own has none."""
    rows = [("f", 0, 1, "h"), ("f", 0, 2, None), ("f", 64, 3, None), ("f", 128, 9, None), ("f", 128, 10, "k"), ("f", 192, 11, None), ("g", 0, 4, None)]
    got = files.carried(spark.createDataFrame(rows, "file string, block long, seq long, x string").repartition(3), "x").collect()
    assert sorted((r["file"], r["seq"], r["x"]) for r in got) == [("f", 1, "h"), ("f", 2, "h"), ("f", 3, "h"), ("f", 9, "h"), ("f", 10, "k"), ("f", 11, "k"), ("g", 4, None)]
