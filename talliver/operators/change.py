"""What moved net worth between two days: markets and exchange rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliver.operators.fx import asof_join, rate_nearest


def _cents(value, rate):
    return F.round(value.cast("double") * rate * 100).cast("long")


def valuation_in_base(accounts: DataFrame, valuations: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """(account_id, value, val_date, fx_rate, cents): the newest valuation at the rate of its own day; unconverted where there is none."""
    newest = valuations.groupBy("account_id").agg(F.max(F.struct("val_date", "valuation_id", "value")).alias("v")).select("account_id", "v.val_date", "v.value")
    rows = accounts.select("account_id", "currency").join(newest, "account_id").withColumn("base", F.lit(base))
    rows = rate_nearest(rows, rates, "currency", "base", "val_date")
    return rows.select("account_id", "value", "val_date", "fx_rate", _cents(F.col("value"), F.coalesce("fx_rate", F.lit(1.0))).alias("cents"))


def market_movement(accounts: DataFrame, valuations: DataFrame, rates: DataFrame, start: str, end: str, base: str = "USD") -> DataFrame:
    """(user_id, moved, n_used, n_skipped, confidence): change of the marks of asset accounts, in cents of base.

    An account without a mark or a rate on either day is skipped.
    """
    rows = accounts.filter("is_asset").select("account_id", "user_id", "currency", F.lit(base).alias("base"))
    for name, day in (("start", start), ("end", end)):
        rows = rows.withColumn("day", F.lit(day).cast("date"))
        rows = asof_join(rows, valuations, "account_id", "day", "val_date", "valuation_id", "value", "mark")
        rows = rate_nearest(rows, rates, "currency", "base", "day")
        rows = rows.withColumn(name, _cents(F.col("mark"), F.col("fx_rate"))).drop("day", "mark", "mark_day", "fx_rate")
    moved = F.col("end") - F.col("start")
    used, skipped = F.count(moved), F.count_if(moved.isNull())
    confidence = F.when(skipped > used, 0.6).otherwise(0.75)
    return rows.groupBy("user_id").agg(F.coalesce(F.sum(moved), F.lit(0)).alias("moved"), used.alias("n_used"), skipped.alias("n_skipped"), confidence.alias("confidence"))


def fx_translation(accounts: DataFrame, txns: DataFrame, rates: DataFrame, start: str, end: str, base: str = "USD") -> DataFrame:
    """(user_id, moved, n_used, confidence): balances of foreign accounts at the end, valued at the change of their rate, in cents."""
    held = txns.filter(F.to_date("ts") <= F.lit(end).cast("date")).groupBy("account_id").agg(F.sum("amount").alias("total"))
    # A rate depends on the currency alone, so it is looked up once for each.
    pairs = accounts.filter(F.col("currency") != base).select("currency").distinct().withColumn("base", F.lit(base))
    for name, day in (("start", start), ("end", end)):
        pairs = rate_nearest(pairs.withColumn("day", F.lit(day).cast("date")), rates, "currency", "base", "day").withColumnRenamed("fx_rate", name).drop("day")
    rows = accounts.join(held, "account_id").join(pairs.filter("start is not null and end is not null"), "currency")
    n = F.count("*")
    moved = F.sum(_cents(F.col("total"), F.col("end") - F.col("start")))
    return rows.groupBy("user_id").agg(moved.alias("moved"), n.alias("n_used"), F.least(F.lit(85), 45 + 5 * n).cast("int").alias("confidence_pct"))
