"""Pairs of rows: duplicates, transfers, flows, one-to-one resolution."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.functions.text import text_similarity

MONEY = "decimal(38,2)"
# Words that point to a transfer.
TRANSFER_WORDS = (
    "transfer", "xfer", "trf", "ach", "wire", "zelle", "venmo", "paypal", "internal", "payment", "pymt", "pmt", "autopay", "auto pay", "credit", "thank you", "online pmt", "direct debit", "standing order",
)
# Words that are never learned.
STOP_WORDS = ("the", "and", "for", "from", "that", "this", "with", "are", "was")


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """(account, day, amount) held by two rows or more, with batches and the rows' ids in order."""
    day = F.to_date("ts").alias("day")
    found = rows.groupBy("account_id", day, "amount").agg(F.count("*").alias("n"), F.count_distinct("import_batch_id").alias("n_batches"), F.min("txn_id").alias("first_id"), F.max("txn_id").alias("last_id"))
    return found.filter("n >= 2").withColumn("cross_batch", F.col("n_batches") > 1)


def not_dismissed(groups: DataFrame, dismissed: DataFrame, keys: list[str]) -> DataFrame:
    return groups.join(dismissed, keys, "left_anti")


def near_duplicates(rows: DataFrame, days: int = 3, least: float = 0.85, similarity=text_similarity) -> DataFrame:
    """(a, b, gap, score): equal account and amount, other batch, 1 to ``days`` days apart, alike in wording.

    Day blocks with their neighbours make the band an equi-join;
    ``similarity`` compares two texts.
    """
    r = rows.select("txn_id", "account_id", "amount", "import_batch_id", "description", F.to_date("ts").alias("day"))
    batches = r.groupBy("account_id", "amount").agg(F.count_distinct("import_batch_id").alias("nb")).filter("nb > 1").drop("nb")
    r = r.join(batches, ["account_id", "amount"], "left_semi").withColumn("block", F.floor(F.unix_date("day") / days))
    left = r.toDF(*[c if c in ("account_id", "amount", "block") else f"{c}_a" for c in r.columns])
    right = r.withColumn("block", F.explode(F.array(F.col("block"), F.col("block") - 1)))
    right = right.toDF(*[c if c in ("account_id", "amount", "block") else f"{c}_b" for c in r.columns])
    pairs = left.join(right, ["account_id", "amount", "block"])
    # Each unordered pair once: the earlier row on the left.
    gap = F.datediff("day_b", "day_a")
    pairs = pairs.filter((gap >= 1) & (gap <= days) & (F.col("import_batch_id_a") != F.col("import_batch_id_b")))
    score = similarity(F.col("description_a"), F.col("description_b"))
    return pairs.select(F.col("txn_id_a").alias("a"), F.col("txn_id_b").alias("b"), gap.alias("gap"), score.alias("score")).filter(F.col("score") >= least)


def description_score(a, b, learned):
    """0.15 for each transfer word in either text and 0.20 if a word was learned, at most 0.5."""
    total = F.lit(0)
    for w in TRANSFER_WORDS:
        total = total + F.lower(a).contains(w).cast("int") + F.lower(b).contains(w).cast("int")
    return F.least(F.lit(0.5), total * 0.15 + F.when(learned, 0.2).otherwise(0.0))


def transfer_score(gap, off, text, n_flagged, days: int):
    """0.30 for the day, 0.40 for the amount, 0.15 for the text and 0.15 for each side flagged as a transfer, at most 1."""
    date = F.greatest(F.lit(0.0), 1 - gap / (days + 1.0))
    amount = F.when(off <= 0.01, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - off.cast("double")))
    total = F.least(F.lit(1.0), 0.30 * date + 0.40 * amount + 0.15 * text + 0.15 * n_flagged)
    return F.round(total.cast("decimal(12,9)"), 3).cast("double")  # halves are told from binary noise first


def detect_transfers(rows: DataFrame, owner: str, days: int = 3, tolerance: float = 0.01, learned: DataFrame | None = None, linked: DataFrame | None = None, dismissed: DataFrame | None = None) -> DataFrame:
    """(out_id, in_id, gap, score): an outflow and an inflow of one owner, other account, amounts within tolerance, days within a window.

    ``learned`` (token) has words of confirmed transfers, ``linked`` (txn_id)
    the rows that are in a link, ``dismissed`` (out_id, in_id) pairs that are
    none.  Rows may have ``is_transfer``.  The equi-join is on owner, cents and
    day blocks; cents within the tolerance are spread over their neighbours.
    """
    if linked is not None:
        rows = rows.join(linked.select("txn_id").distinct(), "txn_id", "left_anti")
    cents = F.abs(F.round(F.col("amount") * 100)).cast("long")
    flag = F.coalesce(F.col("is_transfer"), F.lit(False)) if "is_transfer" in rows.columns else F.lit(False)
    r = rows.select("txn_id", "account_id", owner, "amount", F.coalesce("description", F.lit("")).alias("description"), F.to_date("ts").alias("day"), cents.alias("cents"), flag.cast("int").alias("flag"))
    if learned is not None:
        r = r.join(shared_tokens(rows, learned), "txn_id", "left").withColumn("known", F.col("n_shared").isNotNull()).drop("n_shared")
    else:
        r = r.withColumn("known", F.lit(False))
    r = r.withColumn("block", F.floor(F.unix_date("day") / (days + 1)))
    near = int(round(tolerance * 100))
    out = r.filter("amount < 0").withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    out = out.withColumn("cents", F.explode(F.sequence(F.col("cents") - near, F.col("cents") + near)))
    out = out.select(owner, "cents", "block", *[F.col(c).alias(f"o_{c}") for c in ("txn_id", "account_id", "description", "day", "amount", "flag", "known")])
    pairs = out.join(r.filter("amount > 0"), [owner, "cents", "block"]).filter("o_account_id <> account_id")
    gap = F.abs(F.datediff("day", "o_day"))
    off = F.abs(F.col("amount") + F.col("o_amount"))
    pairs = pairs.filter((gap <= days) & (off <= F.lit(tolerance)))
    text = description_score(F.col("o_description"), F.col("description"), F.col("o_known") | F.col("known"))
    found = pairs.select(F.col("o_txn_id").alias("out_id"), F.col("txn_id").alias("in_id"), gap.alias("gap"), transfer_score(gap, off, text, F.col("o_flag") + F.col("flag"), days).alias("score"))
    return found if dismissed is None else found.join(dismissed.select("out_id", "in_id").distinct(), ["out_id", "in_id"], "left_anti")


def stored(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the folder that the session names; a local folder only where it names none and Spark runs in one process."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def one_to_one(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Mutual-best matching by (score desc, gap, ids) until no pair is open; after each round the matched rows leave.

    The best open pair is always taken, so every round makes progress and the
    result is that of taking pairs in this order.
    """
    best = F.struct((-F.col("score")).alias("s"), "gap", left, right)
    rest = stored(pairs.select(*pairs.columns, best.alias("_best")))
    taken = rest.limit(0)
    while not rest.isEmpty():
        mine = rest.groupBy(left).agg(F.min("_best").alias("_best"))
        yours = rest.groupBy(right).agg(F.min("_best").alias("_best"))
        won = rest.dropDuplicates([left, right, "_best"]).join(mine, [left, "_best"], "left_semi").join(yours, [right, "_best"], "left_semi")
        won = stored(won.select(*rest.columns))
        taken = taken.unionByName(won)
        rest = stored(rest.join(won.select(left), left, "left_anti").join(won.select(right), right, "left_anti").select(*rest.columns))
    return taken.drop("_best")


def group_members(rows: DataFrame, groups: DataFrame, near: DataFrame) -> DataFrame:
    """(txn_id) of the rows that are in a duplicate group or in a near pair."""
    keys = ["account_id", "day", "amount"]
    members = rows.withColumn("day", F.to_date("ts")).join(groups.select(*keys), keys, "left_semi").select("txn_id")
    return members.union(near.select("a")).union(near.select("b")).distinct()


def ranked_groups(groups: DataFrame) -> DataFrame:
    """``place`` of a duplicate group in its account: those of several batches first, then by rows."""
    order = Window.partitionBy("account_id").orderBy(F.desc("cross_batch"), F.desc("n"), "first_id")
    return groups.withColumn("place", F.row_number().over(order))


def transfer_flows(links: DataFrame, rows: DataFrame) -> DataFrame:
    """(from_account, to_account, n, total) over linked rows."""
    a = rows.select(F.col("txn_id").alias("out_id"), F.col("account_id").alias("from_account"), F.abs("amount").alias("moved"))
    b = rows.select(F.col("txn_id").alias("in_id"), F.col("account_id").alias("to_account"))
    return links.join(a, "out_id").join(b, "in_id").groupBy("from_account", "to_account").agg(F.count("*").alias("n"), F.sum("moved").cast(MONEY).alias("total"))


def net_flows(flows: DataFrame) -> DataFrame:
    """Reciprocal flows netted to the larger direction; pairs that cancel go."""
    lo, hi = F.least("from_account", "to_account"), F.greatest("from_account", "to_account")
    signed = F.when(F.col("from_account") == lo, F.col("total")).otherwise(-F.col("total"))
    net = flows.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.sum(signed).cast(MONEY).alias("net")).filter("net <> 0")
    return net.select(F.when(F.col("net") > 0, F.col("lo")).otherwise(F.col("hi")).alias("from_account"), F.when(F.col("net") > 0, F.col("hi")).otherwise(F.col("lo")).alias("to_account"), F.abs("net").alias("net"))


def account_flows(flows: DataFrame) -> DataFrame:
    """(account_id, money_in, money_out, net)."""
    ins = flows.select(F.col("to_account").alias("account_id"), F.col("total").alias("i"), F.lit(0).cast(MONEY).alias("o"))
    outs = flows.select(F.col("from_account").alias("account_id"), F.lit(0).cast(MONEY).alias("i"), F.col("total").alias("o"))
    return ins.union(outs).groupBy("account_id").agg(F.sum("i").cast(MONEY).alias("money_in"), F.sum("o").cast(MONEY).alias("money_out"), (F.sum("i") - F.sum("o")).cast(MONEY).alias("net"))


def shared_tokens(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """(txn_id, n_shared): words of four letters or more that a row shares with the learned ones."""
    words = rows.select("txn_id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("description"), r"[^a-z0-9\s]", " "), r"\s+"))).alias("token")).filter((F.length("token") >= 4) & ~F.col("token").isin(*STOP_WORDS))
    return words.join(learned.distinct(), "token").groupBy("txn_id").agg(F.count("*").alias("n_shared"))
