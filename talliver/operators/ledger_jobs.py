"""Ingest, loans, holdings and quality jobs over ledger tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.functions.rules import PAYMENT_WORDS, classify_event, has_any, spend_metadata
from talliver.functions.text import canonical_row, comparison_key, sequence_ratio, source_hash, wording_matches

MONEY = "decimal(38,2)"


def repeat_index(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``repeat``: how many equal rows came before, so that each copy gets a hash of its own."""
    return rows.withColumn("repeat", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def fingerprints(rows: DataFrame) -> DataFrame:
    """(txn_id, repeat, hash) of raw rows."""
    counted = repeat_index(rows.withColumn("raw_data", canonical_row(F.col("raw_data"))), ["account_id", "raw_data"], "txn_id")
    return counted.select("txn_id", "repeat", source_hash(F.col("account_id"), F.col("raw_data"), F.col("repeat")).alias("hash"))


def dedupe_by_layers(new: DataFrame, ledger: DataFrame, deleted: DataFrame, ratio=sequence_ratio) -> DataFrame:
    """(txn_id, account_id, outcome) of new rows: the first layer that knows them.

    same_row: the hash of account, raw row and repeat is in the ledger;
    duplicate: its day, text (stripped, in lower case) and amount are;
    near_duplicate: its day and amount are, in a wording that matches;
    deleted_row, deleted and near_deleted: the same among the deleted rows;
    else imported.  A row without a raw row has no hash and is never same_row.
    Hashes that a table holds already (``hash``) are taken as they are.  Equal
    texts of a day and amount are compared once.
    """
    keys = ["account_id", "day", "amount"]
    plain = F.lower(F.regexp_replace(F.coalesce("description", F.lit("")), r"^\s+|\s+$", ""))
    shaped = lambda df: df.withColumns({"day": F.to_date("ts"), "key": comparison_key(F.col("description")), "plain": plain})
    rows = shaped(new.drop("hash")).join(fingerprints(new).select("txn_id", "hash"), "txn_id")
    outcome = F.lit("imported")
    for name, known in (("deleted", deleted), ("ledger", ledger)):
        held = shaped(known)
        hashes = known if "hash" in known.columns else fingerprints(known)
        hashes = hashes.select("hash").dropna().distinct().withColumn(f"{name}_hash", F.lit(True))
        exact = held.select(*keys, "plain").distinct().withColumn(f"{name}_exact", F.lit(True))
        pairs = rows.select(*keys, "key").distinct().join(held.select(*keys, F.col("key").alias("other")).distinct(), keys)
        near = pairs.filter(wording_matches(F.col("key"), F.col("other"), ratio)).select(*keys, "key").distinct().withColumn(f"{name}_near", F.lit(True))
        rows = rows.join(hashes, "hash", "left").join(exact, [*keys, "plain"], "left").join(near, [*keys, "key"], "left")
        said = ("same_row", "duplicate", "near_duplicate") if name == "ledger" else ("deleted_row", "deleted", "near_deleted")
        for layer, word in zip(("near", "exact", "hash"), (said[2], said[1], said[0]), strict=True):
            outcome = F.when(F.col(f"{name}_{layer}"), word).otherwise(outcome)
    return rows.select("txn_id", "account_id", outcome.alias("outcome"))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per natural key: the one with the greatest ``order``."""
    both = old.unionByName(new)
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def replace_by_owner(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New detail rows replace all old ones of their owner."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def dedupe_against_ledger(new: DataFrame, ledger: DataFrame, deleted: DataFrame) -> DataFrame:
    """``outcome`` of each new row: duplicate (exact day, text and amount in the ledger), deleted (in the tombstones), or imported."""
    keys = ["account_id", "day", "description", "amount"]
    on = lambda df: df.withColumn("day", F.to_date("ts")).select(*keys).distinct()
    rows = new.withColumn("day", F.to_date("ts"))
    rows = rows.join(on(ledger).withColumn("in_ledger", F.lit(True)), keys, "left").join(on(deleted).withColumn("in_deleted", F.lit(True)), keys, "left")
    outcome = F.when(F.col("in_ledger"), "duplicate").when(F.col("in_deleted"), "deleted").otherwise("imported")
    return rows.select("txn_id", "account_id", outcome.alias("outcome"))


def recover_deleted(deleted: DataFrame, ledger: DataFrame) -> DataFrame:
    return deleted.join(ledger.select("txn_id"), "txn_id", "left_anti")


# Words of money paid towards a debt.
TOWARDS_DEBT = ("payment", "autopay", "auto pay", "thank you", "pymt", "online pmt", "direct debit", "bill pay")


def liability_sign_flip(rows: DataFrame) -> DataFrame:
    """(import_batch_id, paid_in, paid_out, charged_in, charged_out, flip) of each batch of a liability.

    Payments must come out positive and charges negative.  Payment rows decide
    if the charges don't point the other way, then charges alone; a batch
    without evidence is flipped.
    """
    paid = has_any(F.lower(F.coalesce("description", F.lit(""))), TOWARDS_DEBT)
    count = lambda is_paid, sign: F.count_if((paid if is_paid else ~paid) & (sign * F.col("amount") > 0))
    n = rows.groupBy("import_batch_id").agg(count(True, 1).alias("paid_in"), count(True, -1).alias("paid_out"), count(False, 1).alias("charged_in"), count(False, -1).alias("charged_out"))
    keep = F.expr("(paid_in > paid_out and charged_out >= charged_in)")
    turn = F.expr("(paid_out > paid_in and charged_in >= charged_out)")
    return n.withColumn("flip", F.when(keep, False).when(turn, True).otherwise(F.expr("charged_out <= charged_in")))


def parse_amount(text):
    """Amount of a statement cell: currency symbols and commas go, parentheses turn the sign; other text makes it null."""
    bare = F.trim(F.regexp_replace(text, r"\p{Sc}|kr|Fr|zł|,", ""))
    value = F.trim(F.regexp_replace(bare, r"^\((.*)\)$", "$1")).try_cast("decimal(18,2)")
    return F.when(bare.rlike(r"^\(.*\)$"), -value).otherwise(value)


def classify_all(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """(txn_id, event_type, spend_type, counts_as_spend) of every row."""
    rows = txns.join(accounts.select("account_id", "account_type"), "account_id")
    event = classify_event(F.col("amount"), F.col("description"), F.col("account_type"), F.col("is_transfer"), F.lit(""))
    rows = rows.withColumn("event_type", event)
    kind, counts = spend_metadata(F.col("event_type"))
    return rows.select("txn_id", "account_id", "ts", "amount", "event_type", kind.alias("spend_type"), counts.alias("counts_as_spend"))


def unsplit(txns: DataFrame, splits: DataFrame) -> DataFrame:
    return txns.join(splits.select("txn_id"), "txn_id", "left_anti")


def default_splits(classified: DataFrame, splits: DataFrame) -> DataFrame:
    """One mirror split per row that has none."""
    return unsplit(classified, splits).select("txn_id", F.lit(1).alias("split_no"), "amount", "spend_type", "counts_as_spend")


def validate_splits(txns: DataFrame, splits: DataFrame) -> DataFrame:
    """(txn_id, n_splits, split_sum, residual, valid): splits must sum to their row within a cent."""
    sums = splits.groupBy("txn_id").agg(F.count("*").alias("n_splits"), F.sum("amount_native").cast(MONEY).alias("split_sum"))
    out = txns.join(sums, "txn_id", "left").withColumn("split_sum", F.coalesce("split_sum", F.lit(0)).cast(MONEY))
    residual = (F.col("amount") - F.col("split_sum")).cast(MONEY)
    return out.select("txn_id", F.coalesce("n_splits", F.lit(0).cast("long")).alias("n_splits"), "split_sum", residual.alias("residual"), (F.abs(residual) <= F.lit(0.01).cast("decimal(3,2)")).alias("valid"))


def statement_rollforward(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account_id, moved, expected, matches): the statement balance against the sum of rows, in either sign, within max(1, 0.1 %)."""
    sums = txns.groupBy("account_id").agg(F.sum("amount").cast(MONEY).alias("moved"))
    out = accounts.join(sums, "account_id").withColumn("expected", F.col("statement_balance").cast(MONEY))
    slack = F.greatest(F.lit(1).cast(MONEY), (F.abs("expected") / 1000).cast(MONEY))
    off = F.least(F.abs(F.col("moved") - F.col("expected")), F.abs(F.col("moved") + F.col("expected")))
    return out.select("account_id", "moved", "expected", (off <= slack).alias("matches"))


def positions(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Per account and instrument: quantity, proceeds, value at the price (rounded to cents) and gain."""
    held = trades.groupBy("account_id", "instrument_id").agg(F.sum("quantity").cast("decimal(38,6)").alias("quantity"), F.sum(F.when(F.col("quantity") > 0, F.col("proceeds")).otherwise(-F.col("proceeds"))).cast(MONEY).alias("cost"))
    value = F.round(F.col("quantity").cast("decimal(18,2)") * F.col("price").cast("decimal(18,2)"), 2).cast(MONEY)
    out = held.join(prices, "instrument_id").withColumn("value", value)
    return out.select("account_id", "instrument_id", "quantity", "cost", "value", (F.col("value") - F.col("cost")).cast(MONEY).alias("gain"))


def portfolio_totals(held: DataFrame) -> DataFrame:
    return held.groupBy("account_id").agg(F.count("*").alias("n"), F.sum("value").cast(MONEY).alias("value"), F.sum("cost").cast(MONEY).alias("cost"), F.sum("gain").cast(MONEY).alias("gain"))


def holdings_history(trades: DataFrame) -> DataFrame:
    """Quantity held after each trading day of an account and instrument."""
    daily = trades.groupBy("account_id", "instrument_id", F.to_date("trade_ts").alias("day")).agg(F.sum("quantity").cast("decimal(38,6)").alias("change"))
    w = Window.partitionBy("account_id", "instrument_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("held", F.sum("change").over(w).cast("decimal(38,6)"))


def return_stats(values: DataFrame, key: str, month: str, value: str) -> DataFrame:
    """Mean and population deviation of log returns of a monthly series; three returns are needed."""
    w = Window.partitionBy(key).orderBy(month)
    back = values.withColumn("r", F.log(F.col(value).cast("double") / F.lag(value).over(w).cast("double"))).filter("r is not null")
    return back.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg("r"), 9).alias("mean"), F.round(F.stddev_pop("r"), 9).alias("deviation")).filter("n >= 3")


def amortise(loans: DataFrame, months: int) -> DataFrame:
    """(account_id, month, balance): closed form of a loan with fixed payments while the payment exceeds the interest; without a rate, payments alone."""
    rows = loans.filter(F.col("payment") > F.col("principal") * F.col("rate")).withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(months))))
    grow = F.pow(1 + F.col("rate"), F.col("month"))
    paid = F.when(F.col("rate") == 0, F.col("payment") * F.col("month")).otherwise(F.col("payment") * F.try_divide(grow - 1, F.col("rate")))
    left = F.col("principal") * grow - paid
    return rows.select("account_id", "month", F.greatest(F.lit(0.0), F.round(left, 4)).alias("balance"))


def data_quality(txns: DataFrame, splits: DataFrame, accounts: DataFrame, as_of: str) -> DataFrame:
    """(check, severity, n): one aggregate per check."""
    day = F.lit(as_of).cast("date")
    checks = [
        ("future_dated", "blocker", txns.filter(F.to_date("ts") > day)),
        ("without_account", "blocker", txns.join(accounts, "account_id", "left_anti")),
        ("unsplit", "warning", unsplit(txns, splits)),
        ("zero_amount", "warning", txns.filter("amount = 0")),
        ("empty_description", "warning", txns.filter("coalesce(description, '') = ''")),
        ("statement_stale", "warning", accounts.filter(F.datediff(day, "statement_balance_as_of") > 45)),
    ]
    out = None
    for name, severity, rows in checks:
        one = rows.agg(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


def quality_score(checks: DataFrame) -> DataFrame:
    """100 less 20 for each failing blocker and 5 for each failing warning, not below 0."""
    lost = F.sum(F.when(F.col("n") > 0, F.when(F.col("severity") == "blocker", 20).otherwise(5)).otherwise(0))
    return checks.agg(F.count_if((F.col("n") > 0) & (F.col("severity") == "blocker")).alias("blockers"), F.count_if((F.col("n") > 0) & (F.col("severity") == "warning")).alias("warnings"), F.greatest(F.lit(0), 100 - lost).cast("long").alias("score"))


def stale_accounts(accounts: DataFrame, txns: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    last = txns.groupBy("account_id").agg(F.to_date(F.max("ts")).alias("last"))
    return accounts.select("account_id").join(last, "account_id").filter(F.datediff(F.lit(as_of).cast("date"), "last") > days)


def learn_rules(corrections: DataFrame) -> DataFrame:
    """One rule per (pattern, user): the latest category and how often it was given."""
    return corrections.filter("pattern <> ''").groupBy("pattern", "user_id").agg(F.max_by("category_id", F.struct("ts", "txn_id")).alias("category_id"), F.count("*").alias("hits"))


def flag_payment_rows(txns: DataFrame, accounts: DataFrame, words: tuple[str, ...] = PAYMENT_WORDS) -> DataFrame:
    """(txn_id, account_id, is_transfer): money that arrives on a liability under a payment word counts as a transfer."""
    rows = txns.join(accounts.select("account_id", "is_asset"), "account_id")
    paid = (F.col("amount") > 0) & ~F.col("is_asset") & has_any(F.lower(F.coalesce("description", F.lit(""))), words)
    return rows.select("txn_id", "account_id", (F.col("is_transfer") | paid).alias("is_transfer"))


def index_growth(values: DataFrame, key: str, day: str, value: str, years: int = 10, least_years: int = 3) -> DataFrame:
    """Compound yearly growth of each series over its last ``years`` years; series that are shorter than ``least_years`` or don't begin above 0 are left out."""
    last = values.groupBy(key).agg(F.max(day).alias("_end"))
    rows = values.join(last, key).filter(F.col(day) > F.date_sub("_end", 365 * years))
    ends = rows.groupBy(key).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.min_by(value, day).cast("double").alias("a"), F.max_by(value, day).cast("double").alias("b"))
    span = F.datediff("last", "first")
    return ends.filter((span >= 365 * least_years) & (F.col("a") > 0) & (F.col("b") >= 0)).select(key, "first", "last", F.round(F.pow(F.try_divide("b", "a"), F.try_divide(F.lit(365.25), span)) - 1, 9).alias("growth"))
