"""Schedules: recurring streams, due dates, running balances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.functions.rules import DAY_STEPS, MONTH_STEPS, step_date
from talliver.functions.text import grouping_key

# Frequency, ideal interval and tolerance in days.
BUCKETS = (("weekly", 7, 3), ("biweekly", 14, 4), ("monthly", 30, 8), ("quarterly", 91, 12), ("annually", 365, 20))
# The knobs of recurring detection.
STALE_DAYS, LEAST_ROWS, LEAST_CONFIDENCE, LEAST_CONSISTENCY, FIXED_CONSISTENCY = 120, 3, 0.50, 0.30, 0.85
MONEY = "decimal(38,2)"


def detect_recurring(txns: DataFrame, as_of: str) -> DataFrame:
    """One row per (account, grouping key) that repeats on a rhythm: frequency, confidence, kind, last day, next due.

    Only two windows over a stream's own rows; medians and deviations are
    aggregates.
    """
    key = ["account_id", "stream"]
    rows = txns.select("account_id", grouping_key(F.col("description")).alias("stream"), F.to_date("ts").alias("day"), F.col("amount").cast("double").alias("amount")).filter("stream <> ''")
    w = Window.partitionBy(*key).orderBy("day")
    rows = rows.withColumn("gap", F.datediff("day", F.lag("day").over(w)))
    mid = rows.groupBy(*key).agg(F.percentile("gap", 0.5).alias("median"), F.count("*").alias("n"), F.max("day").alias("last"), F.avg("amount").alias("mean"), F.stddev_samp("amount").alias("sd"), F.count_distinct("amount").alias("kinds")).filter(F.col("n") >= LEAST_ROWS)
    freq, tol = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, ideal, slack in reversed(BUCKETS):
        hit = F.abs(F.col("median") - ideal) <= slack
        freq, tol = F.when(hit, name).otherwise(freq), F.when(hit, slack).otherwise(tol)
    mid = mid.withColumn("frequency", freq).withColumn("tol", tol).filter("frequency is not null")
    near = rows.filter("gap is not null").join(mid.select(*key, "median", "tol"), key)
    regular = near.groupBy(*key).agg((F.count_if(F.abs(F.col("gap") - F.col("median")) <= F.col("tol")) / F.count("*")).alias("regularity"))
    out = mid.join(regular, key)
    even = F.when(F.col("kinds") == 1, 1.0).when(F.col("mean") == 0, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.col("sd") / F.abs("mean")))
    out = out.withColumn("consistency", F.round(even, 6))
    fixed = F.col("consistency") >= FIXED_CONSISTENCY
    out = out.withColumn("amount_type", F.when(fixed, "fixed").otherwise("variable")).withColumn("confidence", F.round(F.col("regularity") * F.when(fixed, F.col("consistency")).otherwise(0.85), 3))
    out = out.filter((F.col("consistency") >= LEAST_CONSISTENCY) & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.datediff(F.lit(as_of).cast("date"), "last") <= STALE_DAYS))
    return out.select(*key, "n", "frequency", "amount_type", "confidence", F.col("last").alias("last_seen"), next_due(F.col("last"), F.col("frequency"), F.lit(as_of).cast("date")).alias("next_due"))


def next_due(last, frequency, today):
    """First date after ``last`` on its rhythm that is today or later."""
    out = last
    gap = F.datediff(today, last)
    for name, days in DAY_STEPS.items():
        out = F.when(frequency == name, F.date_add(last, (F.greatest(F.lit(1), F.ceil(gap / days)) * days).cast("int"))).otherwise(out)
    for name, months in MONTH_STEPS.items():
        guess = F.greatest(F.lit(1), F.floor(F.months_between(today, last) / months).cast("int"))
        first, second = F.add_months(last, guess * months), F.add_months(last, (guess + 1) * months)
        out = F.when(frequency == name, F.when(first >= today, first).otherwise(second)).otherwise(out)
    return out


def project_schedule(schedules: DataFrame, until: str) -> DataFrame:
    """(payment_id, account_id, due, amount): every due date up to a day; month steps keep the first due day."""
    end = F.lit(until).cast("date")
    span = F.datediff(end, "next_due")
    steps = F.lit(0)
    for name, days in DAY_STEPS.items():
        steps = F.when(F.col("frequency") == name, F.floor(span / days)).otherwise(steps)
    for name, months in MONTH_STEPS.items():
        steps = F.when(F.col("frequency") == name, F.floor(span / (28 * months))).otherwise(steps)
    rows = schedules.filter(span >= 0).withColumn("i", F.explode(F.sequence(F.lit(0), steps.cast("int"))))
    return rows.withColumn("due", step_date(F.col("next_due"), F.col("frequency"), F.col("i"))).filter(F.col("due") <= end).select("payment_id", "account_id", "due", "amount")


def running_balance(events: DataFrame, opening: DataFrame) -> DataFrame:
    """(account_id, due, balance, below_zero): opening value plus all events up to each date, one row a date."""
    daily = events.groupBy("account_id", "due").agg(F.sum("amount").cast(MONEY).alias("delta"))
    w = Window.partitionBy("account_id").orderBy("due").rowsBetween(Window.unboundedPreceding, 0)
    total = (F.coalesce(F.col("opening"), F.lit(0)).cast(MONEY) + F.sum("delta").over(w)).cast(MONEY)
    out = daily.join(opening, "account_id", "left").withColumn("balance", total)
    return out.select("account_id", "due", "balance", (F.col("balance") < 0).alias("below_zero"))


def first_occurrence(events: DataFrame) -> DataFrame:
    return events.groupBy("payment_id").agg(F.min("due").alias("first_due"))


def next_payment_due(accounts: DataFrame, schedules: DataFrame) -> DataFrame:
    """Liabilities' earliest schedule date."""
    due = schedules.groupBy("account_id").agg(F.min("next_due").alias("due"))
    return accounts.filter("not is_asset").select("account_id").join(due, "account_id", "left")


def suppressed_sources(schedules: DataFrame, accounts: DataFrame) -> DataFrame:
    """Asset-side schedules with a liability-side one of equal frequency and size to a cent."""
    cents = F.abs(F.round(F.col("amount") * 100)).cast("long")
    rows = schedules.join(accounts.select("account_id", "is_asset"), "account_id").withColumn("cents", cents)
    owed = rows.filter("not is_asset").select("frequency", F.explode(F.array(F.col("cents") - 1, F.col("cents"), F.col("cents") + 1)).alias("cents"))
    return rows.filter("is_asset").join(owed, ["frequency", "cents"], "left_semi").select("payment_id", "account_id", "frequency", "amount")


def new_suggestions(found: DataFrame, held: DataFrame) -> DataFrame:
    """Detected streams whose (account, stream) is neither scheduled nor dismissed."""
    return found.join(held.select("account_id", "stream").distinct(), ["account_id", "stream"], "left_anti")
