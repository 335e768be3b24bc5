"""What a ledger asks of its owner: likely duplicates by confidence, open tasks, statements that don't add up, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.functions.text import text_similarity

MONEY = "decimal(38,2)"
# Days without rows, days ahead, account types that have rows, and the confidence below which rows of one batch are no duplicates.
STALE_DAYS, SOON_DAYS = 30, 30
TRANSACTIONAL = ("checking", "savings", "credit_card", "loan", "mortgage", "brokerage")
COINCIDENCE = 0.5
KEY = ["account_id", "day", "amount"]


def duplicate_confidence(rows: DataFrame, dismissed: DataFrame | None = None, similarity=text_similarity) -> DataFrame:
    """(account_id, day, amount, n, n_batches, cross_batch, confidence) of groups of equal account, day and amount.

    Confidence is the weakest likeness of two texts of the group, 1 where all
    are equal; texts that are equal are compared once.  Groups of one batch
    below 0.5 are coincidences and go, so do ``dismissed`` keys.  A null text
    is empty; a missing batch is a batch of its own.
    """
    shaped = rows.select("account_id", F.to_date("ts").alias("day"), "amount", F.coalesce("description", F.lit("")).alias("text"), F.coalesce("import_batch_id", F.lit(-1)).alias("batch"))
    groups = shaped.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct("batch").alias("n_batches")).filter("n > 1")
    if dismissed is not None:
        groups = groups.join(dismissed.select(*KEY).distinct(), KEY, "left_anti")
    texts = shaped.join(groups.select(*KEY), KEY, "left_semi").select(*KEY, "text").distinct()
    pairs = texts.join(texts.withColumnRenamed("text", "other"), KEY).filter("text < other")
    weakest = pairs.groupBy(*KEY).agg(F.min(similarity(F.col("text"), F.col("other"))).alias("confidence"))
    out = groups.join(weakest, KEY, "left").withColumns({"cross_batch": F.col("n_batches") > 1, "confidence": F.coalesce("confidence", F.lit(1.0))})
    return out.filter(F.col("cross_batch") | (F.col("confidence") >= COINCIDENCE)).withColumn("confidence", F.round("confidence", 3))


def ranked_duplicates(found: DataFrame, top: int) -> DataFrame:
    """The first groups: those of several batches, then by confidence, then by key."""
    order = [F.desc("cross_batch"), F.desc("confidence"), *KEY]
    best = found.orderBy(*order).limit(top)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most ``top`` rows


def undismissed_pairs(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Pairs (a, b) of which the owner has not said, in either order, that they are two events."""
    said = dismissed.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()
    return pairs.withColumns({"_a": F.least("a", "b"), "_b": F.greatest("a", "b")}).join(said, ["_a", "_b"], "left_anti").drop("_a", "_b")


def statement_differences(statements: DataFrame, rows: DataFrame) -> DataFrame:
    """(batch_id, moved, expected, matches): what a batch's rows should sum to by its statement.

    Expected is the new balance less the previous one and the instalment that
    fell due (0 where there is none); either sign of the sum will do, within 1
    or a thousandth of the new balance.  Statements without a previous balance
    are left out; a batch without rows moved 0.
    """
    sums = rows.groupBy("batch_id").agg(F.sum("amount").cast(MONEY).alias("moved"))
    out = statements.filter("previous is not null and balance is not null").join(sums, "batch_id", "left")
    moved, expected = F.coalesce("moved", F.lit(0)).cast(MONEY), (F.col("balance") - F.col("previous") - F.coalesce("instalment", F.lit(0))).cast(MONEY)
    slack = F.greatest(F.lit(1).cast("decimal(38,5)"), (F.abs("balance") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(38,5)"))
    off = F.least(F.abs(moved - expected), F.abs(moved + expected))
    return out.select("batch_id", moved.alias("moved"), expected.alias("expected"), (off <= slack).alias("matches"))


def readiness(counters: DataFrame) -> DataFrame:
    """(blockers, warnings, score): 100 less 20 for each blocker and 5 for each warning of the nine counters, not below 0."""
    sums = counters.agg(F.sum("blockers").cast("long").alias("blockers"), F.sum("warnings").cast("long").alias("warnings"))
    return sums.withColumn("score", F.greatest(F.lit(0).cast("long"), 100 - 20 * F.col("blockers") - 5 * F.col("warnings")))


def task_list(accounts: DataFrame, txns: DataFrame, links: DataFrame, duplicates: DataFrame, schedules: DataFrame, suppressed: DataFrame, as_of: str) -> DataFrame:
    """(user_id, task, account_id, level, n, outflow, inflow, detail): the open tasks of every user.

    stale: open accounts with rows of their own but none for 30 days.
    transfers: links (txn_id, confirmed) that nobody confirmed.  categories:
    rows without a category that are no transfers, with the three accounts that
    have most.  duplicates: groups, by whether several batches hold them.
    overdue: schedules (with level) that are not suppressed; due: those of the
    next 30 days by account and level, with what goes out and comes in.  Tasks
    with nothing to do are left out.
    """
    day = F.lit(as_of).cast("date")
    none = lambda kind: F.lit(None).cast(kind)
    owner = accounts.select("account_id", "user_id")
    task = lambda df, name, n=F.count("*"), account=None, level=None, out=None, come=None, detail=None: df.agg(
        F.lit(name).alias("task"), (account if account is not None else none("long")).alias("account_id"), (level if level is not None else none("string")).alias("level"), n.alias("n"), (out if out is not None else none(MONEY)).alias("outflow"), (come if come is not None else none(MONEY)).alias("inflow"), (detail if detail is not None else none("string")).alias("detail")
    )
    last = txns.groupBy("account_id").agg(F.to_date(F.max("ts")).alias("last"))
    kept = accounts.filter(F.col("account_type").isin(*TRANSACTIONAL) & F.col("closed_at").isNull()).join(last, "account_id", "left")
    stale = task(kept.filter(F.col("last").isNull() | (F.datediff(day, "last") > STALE_DAYS)).groupBy("user_id"), "stale")
    open_links = task(links.filter("not confirmed").join(txns.select("txn_id", "account_id"), "txn_id").join(owner, "account_id").groupBy("user_id"), "transfers")
    counts = txns.filter("category_id is null and not is_transfer").groupBy("account_id").agg(F.count("*").alias("c")).join(owner, "account_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("c"), "account_id"))
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", F.concat(F.col("account_id").cast("string"), F.lit(" ("), F.col("c").cast("string"), F.lit(")")).alias("t"))))), lambda x: x["t"]), ", ")
    bare = task(counts.withColumn("place", place).groupBy("user_id"), "categories", F.sum("c"), detail=named)
    twice = duplicates.join(owner, "account_id").withColumn("kind", F.when(F.col("cross_batch"), "cross").otherwise("same"))
    twice = task(twice.groupBy("user_id", "kind"), "duplicates", level=F.first("kind")).drop("kind")
    dues = schedules.join(suppressed.select("payment_id"), "payment_id", "left_anti").join(owner, "account_id")
    late = task(dues.filter(F.col("next_due") < day).groupBy("user_id"), "overdue")
    money = lambda sign: F.sum(F.greatest(F.lit(0), sign * F.col("amount"))).cast(MONEY)
    soon = dues.filter(F.col("next_due").between(day, F.date_add(day, SOON_DAYS))).withColumns({"of": F.col("account_id"), "at": F.col("level")})
    soon = task(soon.groupBy("user_id", "of", "at"), "due", account=F.first("of"), level=F.first("at"), out=money(-1), come=money(1))
    out = stale
    for part in (open_links, bare, twice, late, soon):
        out = out.unionByName(part.select(*stale.columns))
    return out


def merge_rules(held: DataFrame, learned: DataFrame) -> DataFrame:
    """(pattern, user_id, category_id, hits): rules already held after new corrections: the new category, the hits of both; blank patterns are refused."""
    old = held.filter("trim(pattern) <> ''").groupBy("pattern", "user_id").agg(F.max_by("category_id", F.struct("hits", "category_id")).alias("_category"), F.max("hits").alias("_hits"))
    both = old.join(learned.filter("trim(pattern) <> ''"), ["pattern", "user_id"], "full")
    return both.select("pattern", "user_id", F.coalesce("category_id", "_category").alias("category_id"), (F.coalesce("_hits", F.lit(0)) + F.coalesce("hits", F.lit(0))).alias("hits"))
