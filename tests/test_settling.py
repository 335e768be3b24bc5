"""Schedules settled in passes, and one batch's rows in the order of their time, against plain loops."""

import calendar
import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from talliver.operators import settle

TXN = "txn_id long, account_id long, ts timestamp_ntz, amount decimal(18,2), description string, is_asset boolean"
DUE = "payment_id long, account_id long, description string, amount decimal(18,2), frequency string, next_due date, day_of_month int, last_matched long, last_matched_on date"
ALIKE = lambda a, b: F.when(a == b, 1.0).when(F.substring(a, 1, 1) == F.substring(b, 1, 1), 0.5).otherwise(0.0)


def like(a, b):
    return 1.0 if a == b else 0.5 if a[:1] == b[:1] else 0.0


def after(day, frequency, dom):
    if frequency in ("weekly", "biweekly"):
        return day + dt.timedelta(7 if frequency == "weekly" else 14)
    n = {"monthly": 1, "quarterly": 3, "annually": 12}.get(frequency)
    if n is None:
        return day
    y, m = divmod(day.year * 12 + day.month - 1 + n, 12)
    return dt.date(y, m + 1, min(dom or day.day, calendar.monthrange(y, m + 1)[1]))


def key(text):
    return " ".join("".join(c if c.isalpha() else " " for c in text if not c.isdigit()).lower().split())


def backlog(txns, dues, passes=24):
    """The rule as it is told, one row and schedule after the other."""
    texts = {t[0]: t[4] for t in txns}
    pay = [dict(zip(("id", "acc", "text", "amount", "freq", "due", "dom", "row", "on"), d, strict=True)) for d in dues]
    claimed = {p["row"] for p in pay if p["row"] is not None}
    settled, proposed = [], {}
    for n in range(1, passes + 1):
        used, any_ = set(), False
        for t in sorted(txns, key=lambda t: (t[2], t[0])):
            if t[0] in claimed:
                continue
            best = None
            for p in sorted(pay, key=lambda p: p["id"]):
                if p["acc"] != t[1] or p["id"] in used or p.get("gone") or (p["on"] and t[2].date() <= p["on"]):
                    continue
                gap = abs((t[2].date() - p["due"]).days)
                if gap >= 12:
                    continue
                a, d = float(t[3]), float(p["amount"])
                off = abs(a - d) / abs(d)
                off = off if t[5] else min(off, abs(a + d) / abs(d))
                amount = 1.0 if off <= 0.005 else 0.0 if off >= 0.15 else 1.0 - (off - 0.005) / 0.145
                date = 1.0 if gap <= 1 else 1.0 - (gap - 1) / 11.0
                history = float(p["row"] is not None and key(texts.get(p["row"], "-1-")) == key(t[4]))
                score = round(0.5 * amount + 0.25 * date + 0.15 * like(t[4], p["text"]) + 0.1 * history, 6)
                if score >= 0.55 and (best is None or score > best[0]):
                    best = (score, p)
            if best is None:
                continue
            score, p = best
            if score >= 0.8:
                settled.append((n, t[0], p["id"], p["due"], score, "settles"))
                p |= {"row": t[0], "on": t[2].date(), "due": after(t[2].date(), p["freq"], p["dom"]), "gone": p["freq"] == "once"}
                used.add(p["id"])
                claimed.add(t[0])
                any_ = True
            else:
                proposed.setdefault((t[0], p["id"]), (n, t[0], p["id"], p["due"], score, "proposed"))
        if not any_:
            break
    return settled + list(proposed.values())


def random_ledger(seed, rows=900):
    r = random.Random(seed)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    texts = ["rent flat 9", "rent flat", "gym", "gas bill", "ref 1234", "ref 99", "insurance"]
    dues = [(i, r.randrange(3), r.choice(texts), D(r.choice([-100, -50, -52, -1200])), r.choice(["weekly", "biweekly", "monthly", "quarterly", "annually", "once"]), day(r.randrange(60)), r.choice([None, 31, 5]), None, None) for i in range(14)]
    txns = [(100 + i, r.randrange(4), dt.datetime.combine(day(r.randrange(200)), dt.time(r.randrange(24))), D(r.choice([-100, -50, -53, -1200, -1290, 100, 50, 7])) + D(r.randrange(0, 3)) / 10, r.choice(texts), r.randrange(3) > 0) for i in range(rows)]
    owner = {a: a != 1 for a in range(4)}
    txns = [(*t[:5], owner[t[1]]) for t in txns]
    first = txns[0]
    dues[0] = (0, first[1], first[4], first[3], "monthly", dues[0][5], None, first[0], first[2].date())
    return txns, dues


@pytest.mark.parametrize("seed", [1, 3])
def test_backlog_against_a_plain_loop(spark, seed):
    txns, dues = random_ledger(seed)
    got = settle.settle_backlog(spark.createDataFrame(txns, TXN).repartition(3), spark.createDataFrame(dues, DUE), "2023-12-01", similarity=ALIKE).collect()
    want = backlog(txns, dues)
    assert sorted(map(tuple, got)) == sorted(want)
    assert max(w[0] for w in want) > 3 and {w[5] for w in want} == {"settles", "proposed"}


def test_a_late_payment_settles_the_next_occurrence(spark):
    """A monthly schedule months behind is walked up by its payments, a liability's with their sign turned; rows without amount or date stay."""
    at = lambda m, d: dt.datetime(2024, m, d, 9)
    txns = [(1, 1, at(1, 6), D("850.00"), "mortgage", False), (2, 1, at(2, 9), D("850.00"), "mortgage", False), (3, 1, at(3, 8), D("850.00"), "mortgage", False), (4, 1, at(3, 9), None, "mortgage", False), (5, 1, at(7, 1), D("850.00"), "mortgage", False)]
    dues = [(7, 1, "mortgage", D("-850.00"), "monthly", dt.date(2024, 1, 5), 5, None, None), (8, 1, "mortgage", None, "monthly", dt.date(2024, 1, 5), 5, None, None)]
    got = settle.settle_backlog(spark.createDataFrame(txns, TXN), spark.createDataFrame(dues, DUE), "2023-01-01", similarity=ALIKE).collect()
    assert sorted((r["pass"], r["txn_id"], r["due"].month, r["decision"]) for r in got) == [(1, 1, 1, "settles"), (2, 2, 2, "settles"), (3, 3, 3, "settles")]
    none = spark.createDataFrame([], DUE)
    assert settle.settle_backlog(spark.createDataFrame(txns, TXN), none, "2023-01-01", similarity=ALIKE).collect() == []


def test_a_batch_settles_each_schedule_once(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    txns = [(1, 1, at(6), D("-50.00"), "gym", True), (2, 1, at(4), D("-50.00"), "gym", True), (3, 1, at(5), D("-50.00"), "zzz", True), (4, 1, at(5), D("-80.00"), "gym", True)]
    dues = [(9, 1, "gym", D("-50.00"), dt.date(2024, 1, 4), False), (8, 1, "gym", D("-50.00"), dt.date(2024, 1, 8), False), (7, 1, "other", D("-50.00"), dt.date(2024, 1, 5), True)]
    frame = spark.createDataFrame(dues, "payment_id long, account_id long, description string, amount decimal(18,2), next_due date, variable boolean")
    got = settle.gated_matches(spark.createDataFrame(txns, TXN), frame, ALIKE).collect()
    assert sorted((r["txn_id"], r["payment_id"], r["gap"], round(r["score"], 6)) for r in got) == [(1, 8, 2, round(4 / 6, 6)), (2, 9, 0, 1.0), (3, 7, 0, 0.4)]
