"""Wording, transfer scores, categories, schedules and interest by hand, and against plain loops."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from talliver.functions import text
from talliver.operators import categorise, ledger_jobs, pairs, settle
from talliver.sources.views import Ledger

DIR = "/root/testdata/sf0.001"


def column(spark, rows, names, expr):
    return [r[0] for r in spark.createDataFrame(rows, names).coalesce(1).select(expr).collect()]


def test_similarity_is_the_sequence_ratio(spark):
    rows = [("Faster Payment A", "faster payment b"), ("RegularPayment-(Due06/01/2026)", "Payments Irregular"), ("", ""), (None, "x"), ("same", "same")]
    got = column(spark, rows, "a string, b string", text.text_similarity(F.col("a"), F.col("b")))
    keys = column(spark, rows, "a string, b string", F.array(text.comparison_key(F.col("a")), text.comparison_key(F.col("b"))))
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    assert got == pytest.approx([max(ratio((a or "").lower(), (b or "").lower()), ratio(*k)) for (a, b), k in zip(rows, keys, strict=True)])


def test_wording(spark):
    rows = [
        ("faster payment ipbinb4001744", "faster payment ipbinb4001743", False),  # references decide
        ("payment thank you bill pay service", "payment thank you bill pa", True),  # cut off
        ("withdrawalachmission fcu", "mission fcu", True),  # contained
        ("uber", "uber eats", False),  # too short to be contained
        ("coffee shop london", "coffee shop londom", True),  # alike
        ("", "anything at all", False),
        ("faster payment ipbinb4001744", "faster payment", True),
    ]
    assert column(spark, rows, "a string, b string, want boolean", text.wording_matches(F.col("a"), F.col("b"))) == [r[2] for r in rows]
    assert column(spark, [(b, a, w) for a, b, w in rows if b and a], "a string, b string, want boolean", text.wording_matches(F.col("a"), F.col("b"))) == [r[2] for r in rows if r[0]]


def test_patterns(spark):
    rows = [("LIDL  GB 2024-01-02 £3 $12.50 #77 ref 123456 IPB2603183152823",), (None,), ("word " * 20,), ("x" * 70,)]
    assert column(spark, rows, "d string", text.extract_pattern(F.col("d"))) == ["lidl gb £3 ref", "", " ".join(["word"] * 12), "x" * 60]


def test_row_hash_ignores_the_order_of_keys(spark):
    rows = spark.createDataFrame([(1, 7, '{"a": "1", "b": "2"}'), (2, 8, '{"b": "2", "a": "1"}'), (3, 7, "no json")], "txn_id long, account_id long, raw_data string")
    same = {r["txn_id"]: r["hash"] for r in ledger_jobs.fingerprints(rows.withColumn("account_id", F.lit(7))).collect()}
    assert len(set(same.values())) == 3  # the second copy of a row has a repeat of its own
    lone = [ledger_jobs.fingerprints(rows.filter(f"txn_id = {i}").withColumn("account_id", F.lit(7))).first()["hash"] for i in (1, 2, 3)]
    assert lone[0] == lone[1] != lone[2]


def test_transfer_scores(spark):
    kind = "txn_id long, account_id long, owner long, amount decimal(18,2), description string, ts timestamp, is_transfer boolean"
    import datetime as dt
    from decimal import Decimal as D

    day = dt.datetime(2024, 1, 5)
    rows = [(1, 1, 1, D("-50.00"), "Zelle out", day, False), (2, 2, 1, D("50.00"), "plain", day, True), (3, 3, 1, D("50.01"), None, day + dt.timedelta(2), False), (4, 2, 9, D("50.00"), "other owner", day, False)]
    df = spark.createDataFrame(rows, kind)
    got = {(r["out_id"], r["in_id"]): r["score"] for r in pairs.detect_transfers(df, "owner").collect()}
    assert got == {(1, 2): pytest.approx(0.873), (1, 3): pytest.approx(0.573)}  # 0.3 + 0.4 + 0.15 * 0.15 + 0.15, and 0.15 + 0.4 + 0.0225
    learned = spark.createDataFrame([("plain",)], "token string")
    got = {r["in_id"]: r["score"] for r in pairs.detect_transfers(df, "owner", learned=learned).collect()}
    assert got[2] == pytest.approx(0.903) and got[3] == pytest.approx(0.573)
    assert pairs.detect_transfers(df, "owner", linked=spark.createDataFrame([(2,)], "txn_id long")).count() == 1
    assert pairs.detect_transfers(df, "owner", dismissed=spark.createDataFrame([(1, 3)], "out_id long, in_id long")).count() == 1


@pytest.mark.parametrize("rows,flip", [
    ([("payment", 5), ("shop", -3)], False), ([("payment", -5), ("shop", 3)], True), ([("payment", 5), ("shop", 3), ("shop", 4)], True), ([("shop", -3)], False), ([("shop", 3), ("shop", -3)], True), ([("thank you", 0)], True),
])
def test_sign_of_a_liability_file(spark, rows, flip):
    df = spark.createDataFrame([(1, d, float(a)) for d, a in rows], "import_batch_id long, description string, amount double")
    assert ledger_jobs.liability_sign_flip(df).first()["flip"] is flip


def test_near_duplicates_against_a_plain_loop(spark):
    rows = Ledger(spark, DIR).moves.collect()
    key = dict(zip([r["txn_id"] for r in rows], column(spark, [(r["txn_id"], r["description"]) for r in rows], "i long, d string", text.comparison_key(F.col("d"))), strict=True))
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    want = set()
    for a in rows:
        for b in rows:
            gap = (b["ts"].date() - a["ts"].date()).days
            if a["account_id"] == b["account_id"] and a["amount"] == b["amount"] and a["import_batch_id"] != b["import_batch_id"] and 1 <= gap <= 3:
                if max(ratio(a["description"].lower(), b["description"].lower()), ratio(key[a["txn_id"]], key[b["txn_id"]])) >= 0.85:
                    want.add((a["txn_id"], b["txn_id"]))
    assert {(r["a"], r["b"]) for r in pairs.near_duplicates(Ledger(spark, DIR).moves).collect()} == want


def test_rules_match_by_words_and_never_when_blank(spark):
    texts = spark.createDataFrame([("electronic payment ipb2603 mohammed khamal udd",), ("uber eats",), ("",)], "norm string")
    rules = spark.createDataFrame([("electronic payment mohammed khamal", 1, 5, 2), ("ber e", 1, 6, 9), ("", 1, 7, 99), ("uber eats extra words", 1, 8, 99)], "pattern string, user_id long, category_id long, hits long")
    assert {r["norm"]: r["category_id"] for r in categorise.rule_category(texts, rules).collect()} == {"electronic payment ipb2603 mohammed khamal udd": 5, "uber eats": 6}


def test_amount_and_date_scores(spark):
    rows = [(-100.0, -100.0, False), (100.0, -100.0, False), (100.0, -100.0, True), (-107.75, -100.0, False), (-120.0, -100.0, False), (0.0, 0.0, False)]
    assert column(spark, rows, "a double, d double, l boolean", settle.amount_score(F.col("a"), F.col("d"), F.col("l"))) == pytest.approx([1, 0, 1, 0.5, 0, 1])
    assert column(spark, [(0,), (1,), (2,), (12,)], "g int", settle.date_score(F.col("g"))) == pytest.approx([1, 1, 10 / 11, 0])


def test_interest_compounds_and_skips_posted_months(spark):
    import datetime as dt
    from decimal import Decimal as D

    txns = spark.createDataFrame([(1, D("-1000.00"), dt.datetime(2024, 1, 10)), (1, D("100.00"), dt.datetime(2024, 3, 1)), (2, D("0.20"), dt.datetime(2024, 1, 1))], "account_id long, amount decimal(18,2), ts timestamp")
    rates = spark.createDataFrame([(1, D("0.01")), (2, D("0.01"))], "account_id long, monthly_rate decimal(12,10)")
    posted = spark.createDataFrame([(1, dt.date(2024, 2, 1))], "account_id long, month date")
    got = {(r["account_id"], r["month"].month): r["interest"] for r in settle.accrue_interest(txns, rates, "2024-04-15", posted).collect()}
    assert got == {(1, 1): D("-10.00"), (1, 3): D("-9.10")}
