"""Queries that SQL can't express, against plain loops over the same rows."""

from talliver.operators import pairs
from talliver.plans.queries import QUERIES
from talliver.sources.views import Ledger

DIR = "/root/testdata/sf0.001"


def greedy(rows):
    """Rows (order, a, b) in order, each a and each b once."""
    left, right, out = set(), set(), []
    for _, a, b in sorted(rows):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.append((a, b))
    return sorted(out)


def test_links_are_resolved_in_the_order_of_their_score(spark):
    rows = pairs.detect_transfers(Ledger(spark, DIR).feed, "household_id").filter("score >= 0.7").collect()
    want = greedy([((-r["score"], r["gap"], r["out_id"], r["in_id"]), r["out_id"], r["in_id"]) for r in rows])
    assert want and sorted((r["out_id"], r["in_id"]) for r in QUERIES["j8_resolve_links"](spark, DIR).collect()) == want


def test_suggestions_take_the_nearest_free_partner(spark):
    rows = pairs.detect_transfers(Ledger(spark, DIR).feed, "household_id").filter("out_id % 11 <> 0 and in_id % 11 <> 0").collect()
    want = greedy([((r["gap"], r["out_id"], r["in_id"]), r["out_id"], r["in_id"]) for r in rows])
    assert want and sorted((r["out_id"], r["in_id"]) for r in QUERIES["j7_suggest_reconciliation"](spark, DIR).collect()) == want


def test_placeholders_give_way_to_the_nearest_bank_row(spark):
    rows = [(r["txn_id"], r["account_id"], r["amount"], r["ts"].date()) for r in Ledger(spark, DIR).feed.select("txn_id", "account_id", "amount", "ts").collect()]
    near = []
    for p in rows:
        if p[0] % 9 == 0:
            near += [((abs((t[3] - p[3]).days), p[0], t[0]), p[0], t[0]) for t in rows if t[0] % 9 and t[1:3] == p[1:3] and abs((t[3] - p[3]).days) <= (3 if p[0] % 2 else 7)]
    want = greedy(near)
    assert want and sorted((r["placeholder_id"], r["txn_id"]) for r in QUERIES["j11_reconcile_placeholders"](spark, DIR).collect()) == want


def test_a_chain_of_pairs_is_matched_to_its_end(spark):
    # Each pair is better than the next and shares a row with it: one match settles in a round.
    chain = [(i // 2, 100 + (i + 1) // 2, 1.0 - i / 100, 1) for i in range(20)]
    df = spark.createDataFrame(chain, "a int, b int, score double, gap int")
    got = sorted((r["a"], r["b"]) for r in pairs.one_to_one(df, "a", "b").collect())
    assert got == greedy([((-s, g, a, b), a, b) for a, b, s, g in chain]) and len(got) == 10
    assert pairs.one_to_one(df.limit(0), "a", "b").collect() == []
