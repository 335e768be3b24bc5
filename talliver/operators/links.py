"""Links between rows: transfers resolved one to one, placeholders, carried balances, payment components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.operators.pairs import duplicate_groups, one_to_one
from talliver.operators.settle import in_date_order

MONEY = "decimal(38,2)"
COMPONENTS = ("principal", "interest", "escrow")
KEY = ["account_id", "day", "amount"]


def resolve_links(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """(out_id, in_id, gap, score): candidates of at least ``least``, best first, each row in one link."""
    return one_to_one(pairs.filter(F.col("score") >= least), "out_id", "in_id")


def suggest_reconciliation(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Nearest partner of each row, each row once; rows that are in a group (``txn_id``) already take no part."""
    held = grouped.select("txn_id").distinct()
    free = pairs.join(held.withColumnRenamed("txn_id", "out_id"), "out_id", "left_anti").join(held.withColumnRenamed("txn_id", "in_id"), "in_id", "left_anti")
    return one_to_one(free.withColumn("score", -F.col("gap").cast("double")), "out_id", "in_id").select("out_id", "in_id", "gap")


def reconcile_placeholders(placeholders: DataFrame, ledger: DataFrame, days: int = 3, confirmed_days: int = 7) -> DataFrame:
    """(placeholder_id, txn_id, gap): the nearest bank row of equal account and amount replaces a placeholder, each once.

    A placeholder is within ``days`` of its bank row, or within
    ``confirmed_days`` if it is a confirmed occurrence of a schedule (a column
    ``confirmed``, if it is there).  Day blocks with their neighbours make the band an equi-join.
    """
    shape = lambda df, name, *more: df.select("account_id", "amount", F.to_date("ts").alias(f"{name}_day"), F.col("txn_id").alias(name), *more)
    reach = F.when(F.col("confirmed"), confirmed_days).otherwise(days) if "confirmed" in placeholders.columns else F.lit(days)
    block = lambda c: F.floor(F.unix_date(c) / (max(days, confirmed_days) + 1))
    left = shape(placeholders, "placeholder_id", reach.alias("reach")).withColumn("block", F.explode(F.sequence(block("placeholder_id_day") - 1, block("placeholder_id_day") + 1)))
    right = shape(ledger, "txn_id").withColumn("block", block("txn_id_day"))
    gap = F.abs(F.datediff("txn_id_day", "placeholder_id_day"))
    near = left.join(right, ["account_id", "amount", "block"]).withColumn("gap", gap).filter(F.col("gap") <= F.col("reach"))
    return one_to_one(near.select("placeholder_id", "txn_id", "gap", F.lit(0.0).alias("score")), "placeholder_id", "txn_id").drop("score")


def carry_balance(dups: DataFrame, ledger: DataFrame) -> DataFrame:
    """(txn_id, from_id, balance_after): the n-th rejected duplicate of a key gives its balance to the n-th ledger row of that key without one."""
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("txn_id"))
    keyed = lambda df: df.withColumn("day", F.to_date("ts")).withColumn("n", nth)
    give = keyed(dups.filter("balance_after is not null")).select(*KEY, "n", F.col("txn_id").alias("from_id"), "balance_after")
    return keyed(ledger.filter("balance_after is null")).drop("balance_after").join(give, [*KEY, "n"]).select("txn_id", "from_id", "balance_after")


def dismissed_groups(rows: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Dismissed duplicate keys that two rows or more still hold."""
    return duplicate_groups(rows).join(dismissed.select(*KEY), KEY, "left_semi")


def training_pairs(deleted: DataFrame, ledger: DataFrame, dismissed: DataFrame, limit: int | None = None) -> DataFrame:
    """(a, b, same): each deleted row with its first surviving twin, and the ends of each dismissed group; the newest ``limit`` of each class, if it is given."""
    twins = ledger.groupBy("account_id", F.to_date("ts").alias("day"), "amount").agg(F.min("txn_id").alias("b"))
    same = deleted.withColumn("day", F.to_date("ts")).join(twins, KEY).select(F.col("txn_id").alias("a"), "b", F.lit(True).alias("same"))
    other = dismissed_groups(ledger, dismissed).select(F.col("first_id").alias("a"), F.col("last_id").alias("b"), F.lit(False).alias("same"))
    if limit is not None:
        same, other = (df.orderBy(F.desc("a"), "b").limit(limit) for df in (same, other))
    return same.unionByName(other)


def payments_with_components(payments: DataFrame, components: DataFrame) -> DataFrame:
    """Each payment with its principal, interest and escrow; ``n_components`` is 0 where it has none."""
    sums = [F.sum(F.when(F.col("component") == c, F.col("part"))).cast(MONEY).alias(c) for c in COMPONENTS]
    parts = components.groupBy("txn_id").agg(*sums, F.count("*").alias("n_components"))
    zero = F.lit(0).cast(MONEY)
    out = payments.join(parts, "txn_id", "left")
    return out.select("txn_id", "account_id", "ts", "amount", *[F.coalesce(c, zero).alias(c) for c in COMPONENTS], F.coalesce("n_components", F.lit(0).cast("long")).alias("n_components"))


def validate_decomposition(found: DataFrame) -> DataFrame:
    """(txn_id, parts, valid): the components of a payment against its amount, in size, within a cent."""
    parts = (F.col("principal") + F.col("interest") + F.col("escrow")).cast(MONEY)
    off = F.abs(F.abs(parts) - F.abs("amount"))
    return found.filter("n_components > 0").select("txn_id", parts.alias("parts"), (off <= F.lit("0.01").cast(MONEY)).alias("valid"))


def payment_breakdown(found: DataFrame, since: str) -> DataFrame:
    """(account_id, n, principal, interest, escrow) of the payments since a day."""
    rows = found.filter(F.to_date("ts") >= F.lit(since).cast("date"))
    return rows.groupBy("account_id").agg(F.count("*").alias("n"), *[F.sum(c).cast(MONEY).alias(c) for c in COMPONENTS])


def interest_to_date(found: DataFrame, as_of: str) -> DataFrame:
    """(account_id, interest) paid since 1 January of the year of a day."""
    day = F.lit(as_of).cast("date")
    rows = found.filter(F.to_date("ts").between(F.trunc(day, "year"), day))
    return rows.groupBy("account_id").agg(F.sum("interest").cast(MONEY).alias("interest"))


# Rows of a loan's batch that are looked at, days on either side, and how far sums may be apart.
LOAN_ROWS, LOAN_DAYS, LOAN_SLACK = 10, 5, "1.00"


def group_loan_payments(txns: DataFrame, grouped: DataFrame) -> DataFrame:
    """(batch_id, loan_id, txn_id, role, amount): the newest rows of a loan's batch and the one outflow that paid them.

    ``txns`` has owner, is_loan, import_batch_id; ``grouped`` the txn_id of rows
    that are in a group already.  The up to ten newest rows of a batch on a
    loan meet an outflow of another account of the owner within five days of
    them and 1.00 of minus their sum.  Batches choose in their order (then by
    account): the least difference, then the smaller txn_id; an outflow is
    taken once.  Batches without an outflow make no group.
    """
    money = "decimal(38,2)"
    newest = F.row_number().over(Window.partitionBy("owner", "account_id", "import_batch_id").orderBy(F.desc("ts"), F.desc("txn_id")))
    side = txns.filter("is_loan and amount is not null").withColumn("n", newest).filter(F.col("n") <= LOAN_ROWS).drop("n")
    day = F.to_date("ts")
    sums = side.groupBy("owner", "account_id", "import_batch_id").agg(F.sum("amount").cast(money).alias("total"), F.date_sub(F.min(day), LOAN_DAYS).alias("low"), F.date_add(F.max(day), LOAN_DAYS).alias("high"))
    whole = lambda c: F.floor(c).cast("long")
    wanted = sums.withColumn("unit", F.explode(F.sequence(whole(-F.col("total")) - 1, whole(-F.col("total")) + 1)))
    free = txns.filter("amount is not null").join(grouped.select("txn_id"), "txn_id", "left_anti").select("owner", F.col("account_id").alias("bank_id"), F.col("txn_id").alias("payment_id"), day.alias("day"), F.col("amount").alias("paid"), whole(F.col("amount")).alias("unit"))
    off = F.abs(F.col("paid") + F.col("total"))
    pairs = wanted.join(free, ["owner", "unit"]).filter((F.col("bank_id") != F.col("account_id")) & F.col("day").between(F.col("low"), F.col("high")) & (off <= F.lit(LOAN_SLACK).cast(money)))
    # in_date_order takes the rows of an owner in order and gives each its best free partner.
    batch = F.struct("import_batch_id", "account_id")
    found = pairs.select(F.col("owner").alias("account_id"), batch.alias("ts"), F.xxhash64("import_batch_id", "account_id").alias("txn_id"), "payment_id", (-off).cast("double").alias("score"), "paid")
    taken = in_date_order(found, float("-inf")).select(F.col("account_id").alias("owner"), "ts.import_batch_id", "ts.account_id", "payment_id", "paid")
    members = side.join(taken.select("owner", "import_batch_id", "account_id"), ["owner", "import_batch_id", "account_id"])
    key = lambda *rest: [F.col("import_batch_id").alias("batch_id"), F.col("account_id").alias("loan_id"), *rest]
    inflow = members.select(*key("txn_id", F.lit("loan_inflow").alias("role"), F.col("amount").cast(money).alias("amount")))
    return inflow.unionAll(taken.select(*key(F.col("payment_id").alias("txn_id"), F.lit("bank_outflow").alias("role"), F.col("paid").cast(money).alias("amount"))))
