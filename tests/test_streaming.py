from decimal import Decimal

from talliver.sources.views import Ledger
from talliver.streaming import imports


def test_files_are_imported_once_and_late_rows_count(spark, tmp_path):
    source, ledger, checkpoint = (str(tmp_path / x) for x in ("source", "ledger", "checkpoint"))
    feed = Ledger(spark, "/root/testdata/sf0.001").feed.select(*imports.FEED.names)
    feed = spark.createDataFrame(feed.collect(), imports.FEED)
    deleted = feed.filter("txn_id % 10 = 3")
    keys = ["account_id", "ts", "description", "amount"]

    def run(part):
        part.coalesce(1).write.mode("append").parquet(source)
        imports.stream_import(spark, source, ledger, checkpoint, deleted).start().awaitTermination()
        return spark.read.parquet(ledger)

    first = run(feed.filter("txn_id % 2 = 0"))
    n = first.count()
    assert 0 < n <= feed.filter("txn_id % 2 = 0").count()
    both = run(feed.filter("txn_id % 4 = 0").unionByName(feed.filter("txn_id % 2 = 1")))
    assert both.groupBy("txn_id").count().filter("count > 1").count() == 0
    assert both.join(deleted.select("txn_id"), "txn_id", "left_semi").count() == 0
    assert both.select(*keys).exceptAll(feed.select(*keys)).count() == 0

    # Running a batch again leaves the ledger as it was.
    before = sorted(r["txn_id"] for r in both.select("txn_id").collect())
    imports.import_batch(feed.filter("txn_id % 4 = 0").unionByName(feed.filter("txn_id % 2 = 1")), 1, ledger, deleted)
    both = spark.read.parquet(ledger)
    assert sorted(r["txn_id"] for r in both.select("txn_id").collect()) == before

    account = both.first()["account_id"]
    total = imports.touched_balances(both, both.filter(f"account_id = {account}").limit(1)).first()
    assert total["total"] == sum((r["amount"] for r in both.filter(f"account_id = {account}").collect()), Decimal(0))


def test_a_row_in_another_case_or_order_is_not_imported_again(spark, tmp_path):
    """The hash of the raw row, the text in any case and a near wording each know a row; rows without raw data are told apart."""
    import datetime as dt

    day = lambda n, h=0: dt.datetime(2024, 1, n, h)
    row = lambda i, d, amount, text, raw: (i, 1, d, Decimal(amount), text, 0, raw)
    first = [row(1, day(5), "9.00", "Coffee Shop London", '{"a": "1", "b": " 2"}'), row(2, day(6), "-500.00", "Rent", None), row(3, day(6), "-1.00", "x", "[1]")]
    second = [
        row(11, day(5, 3), "9.00", "other words", '{"b": "2", "a ": "1"}'), row(12, day(6, 9), "-500.00", "  RENT ", None), row(13, day(5), "9.00", "COFFEE SHOP LONDON 05/01/2024", '{"c": "1"}'),
        row(14, day(5), "8.00", "Coffee Shop London", None), row(15, day(7), "-500.00", "Rent", ""), row(16, day(6), "-2.00", "x", "[1]"), row(17, day(8), "3.00", "gone", None),
    ]
    deleted = spark.createDataFrame([row(99, day(8), "3.00", "Gone", None)], imports.FEED)
    path = str(tmp_path / "ledger")
    for n, rows in enumerate((first, second, second)):
        imports.import_batch(spark.createDataFrame(rows, imports.FEED), min(n, 1), path, deleted)
    assert sorted(r["txn_id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3, 14, 15, 16]


def test_markers_follow_the_whole_ledger(spark, tmp_path):
    """After each batch, and after a batch is run again, the markers are those of the whole ledger; late rows move them."""
    import random

    from pyspark.sql import functions as F

    from talliver.operators.balances import marker_balance

    led = Ledger(spark, "/root/testdata/sf0.001")
    rows = led.transactions.select("txn_id", "account_id", "ts", "amount").join(led.running.select("txn_id", F.col("balance_after").cast("decimal(18,2)").alias("balance_after")), "txn_id")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("amount", F.col("amount").cast("decimal(18,2)")).select(*imports.BALANCES.names).orderBy("txn_id").collect()[:500]
    random.Random(2).shuffle(rows)
    source, ledger, markers, checkpoint = (str(tmp_path / x) for x in ("source", "ledger", "markers", "checkpoint"))

    def agrees():
        whole = spark.read.parquet(ledger)
        want = marker_balance(whole, whole.select("txn_id", "balance_after"), whole.agg(F.to_date(F.max("ts")).alias("as_of"))).select("account_id", "marker", "marker_day")
        got = imports.current_markers(spark, markers)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        return got.count()

    for n in range(3):
        part = rows[n * 150 : n * 150 + 200]
        part = [r for r in part if n == 0 or r not in rows[: n * 150 + 50]]
        spark.createDataFrame(part, imports.BALANCES).coalesce(1).write.mode("append").parquet(source)
        imports.stream_markers(spark, source, ledger, markers, checkpoint).start().awaitTermination()
        assert agrees() > 10
    whole = spark.read.parquet(ledger)
    imports.mark_batch(whole.filter("batch = 1"), 1, whole, whole.select("txn_id", "balance_after"), markers)
    imports.mark_batch(whole.filter("batch = 2"), 2, whole, whole.select("txn_id", "balance_after"), markers)
    agrees()
