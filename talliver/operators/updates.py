"""Changes to ledger tables: each gives the new rows of a table from the old ones and a set of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talliver.functions.rules import spend_metadata, step_date

MONEY = "decimal(38,2)"


def import_counts(outcomes: DataFrame) -> DataFrame:
    """(outcome, n) of an import."""
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def upsert_dimension(known: DataFrame, seen: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Known rows with their missing fields filled, and the rows seen for the first time."""
    new = seen.groupBy(key).agg(*[F.min(f).alias(f"_{f}") for f in fields])
    return known.join(new, key, "full").select(key, *[F.coalesce(f, f"_{f}").alias(f) for f in fields])


def sync_current_value(accounts: DataFrame, valuations: DataFrame) -> DataFrame:
    """(account_id, current_value, value_as_of): the newest valuation, else the value the account had."""
    newest = valuations.groupBy("account_id").agg(F.max(F.struct("val_date", "valuation_id", "value")).alias("v"))
    out = accounts.select("account_id", "current_value").join(newest, "account_id", "left")
    return out.select("account_id", F.coalesce("v.value", "current_value").alias("current_value"), F.col("v.val_date").alias("value_as_of"))


def keyword_category(description: Column, amount: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Category of the first rule (keyword, sign, category) that fits; rules bound to a sign come before the others."""
    text = F.lower(F.coalesce(description, F.lit("")))
    sign = {"in": amount >= 0, "out": amount < 0, "any": F.lit(True)}
    return F.coalesce(*[F.when(text.contains(word) & sign[way], category) for word, way, category in sorted(rules, key=lambda r: r[1] == "any")])


def rule_hits(rules: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Rules with their hits grown by the rows they matched."""
    grown = matched.groupBy(*keys).agg(F.count("*").alias("_n"))
    return rules.join(grown, keys, "left").withColumn("hits", F.col("hits") + F.coalesce("_n", F.lit(0))).drop("_n")


def post_occurrences(occurrences: DataFrame, posted: DataFrame) -> DataFrame:
    """Confirmed occurrences that no ledger row stands for yet."""
    return occurrences.dropDuplicates(["payment_id", "due"]).join(posted, ["payment_id", "due"], "left_anti")


def advance(schedules: DataFrame, posted: DataFrame) -> DataFrame:
    """(payment_id, next_due): one period after the last posted date, but never back."""
    last = posted.groupBy("payment_id").agg(F.max("due").alias("last"))
    after = step_date(F.col("last"), F.col("frequency"), F.lit(1))
    return schedules.join(last, "payment_id", "left").select("payment_id", F.greatest("next_due", after).alias("next_due"))


def resolve_proposals(proposed: DataFrame, decided: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, still open): ``decided`` holds the pair and ``accepted``; decided pairs are never offered again."""
    yes = decided.filter("accepted").select(*keys).distinct()
    return proposed.join(yes, keys, "left_semi"), proposed.join(decided.select(*keys), keys, "left_anti")


def statement_schedules(statements: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(account_id, amount, next_due): one per account, from its newest statement, unless the account dismissed it."""
    newest = statements.groupBy("account_id").agg(F.max(F.struct("due", "statement_id", "amount")).alias("s"))
    return newest.join(dismissed.select("account_id"), "account_id", "left_anti").select("account_id", F.col("s.amount").alias("amount"), F.col("s.due").alias("next_due"))


def replace_splits(splits: DataFrame, manual: DataFrame) -> DataFrame:
    """Splits after manual rows replaced those of their transaction; splits linked to a document stay."""
    touched = manual.select("txn_id").distinct().withColumn("_touched", F.lit(True))
    kept = splits.join(touched, "txn_id", "left").filter("_touched is null or linked").drop("_touched")
    return kept.unionByName(manual.withColumn("linked", F.lit(False)))


def cascade_event(splits: DataFrame, changed: DataFrame) -> DataFrame:
    """Splits whose transaction changed its event take its spend type, but for those linked to a document."""
    kind, counts = spend_metadata(F.col("event_type"))
    new = changed.select("txn_id", kind.alias("_kind"), counts.alias("_counts"))
    takes = ~F.col("linked") & F.col("_kind").isNotNull()
    out = splits.join(new, "txn_id", "left")
    out = out.withColumn("spend_type", F.when(takes, F.col("_kind")).otherwise(F.col("spend_type")))
    return out.withColumn("counts_as_true_spend", F.when(takes, F.col("_counts")).otherwise(F.col("counts_as_true_spend"))).drop("_kind", "_counts")


def flag_closed(schedules: DataFrame, closed: DataFrame) -> DataFrame:
    """Schedules with ``active``; those of closed accounts lose their due date."""
    shut = closed.select("account_id").distinct().withColumn("_shut", F.lit(True))
    out = schedules.join(shut, "account_id", "left").withColumn("active", F.col("_shut").isNull())
    return out.withColumn("next_due", F.when(F.col("active"), F.col("next_due"))).drop("_shut")


def dividends_to_date(pays: DataFrame, calendar: DataFrame) -> DataFrame:
    """(account_id, day, received): dividends up to each calendar day, those paid between two of them included."""
    events = pays.groupBy("account_id", "day").agg(F.sum("amount").cast(MONEY).alias("paid")).withColumn("shown", F.lit(False))
    days = calendar.select("account_id", "day", F.lit(0).cast(MONEY).alias("paid"), F.lit(True).alias("shown")).distinct()
    both = events.unionByName(days).groupBy("account_id", "day").agg(F.sum("paid").cast(MONEY).alias("paid"), F.max("shown").alias("shown"))
    w = Window.partitionBy("account_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("received", F.sum("paid").over(w).cast(MONEY)).filter("shown").select("account_id", "day", "received")
