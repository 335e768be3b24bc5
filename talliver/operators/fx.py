"""Exchange rates: three named modes, and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days either side of a date within which a nearest rate counts.
REACH = 30


def both_ways(rates: DataFrame) -> DataFrame:
    """(base, quote, rate_date, rate double, direct): each rate and its inverse."""
    direct = rates.select(F.col("base_currency").alias("base"), F.col("quote_currency").alias("quote"), "rate_date", F.col("rate").cast("double").alias("rate"), F.lit(True).alias("direct"))
    turned = direct.filter("rate <> 0").select(F.col("quote").alias("base"), F.col("base").alias("quote"), "rate_date", (1 / F.col("rate")).alias("rate"), F.lit(False).alias("direct"))
    return direct.unionByName(turned)


def rate_nearest(df: DataFrame, rates: DataFrame, base: str, quote: str, day: str, out: str = "fx_rate") -> DataFrame:
    """The rate nearest in time within ``REACH`` days: direct ones first, the later of two equally near; same currency 1, else null.

    Each distinct (base, quote, day) is looked up once, in blocks of ``REACH``
    days with their neighbours, and the best rate is a pre-aggregated minimum.
    """
    probes = df.select(F.col(base).alias("base"), F.col(quote).alias("quote"), F.col(day).cast("date").alias("day")).distinct()
    block = lambda c: F.floor(F.unix_date(c) / REACH)
    near = probes.withColumn("block", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: block(F.col("day")) + d)))
    found = near.join(both_ways(rates).withColumn("block", block(F.col("rate_date"))), ["base", "quote", "block"])
    gap = F.abs(F.datediff("day", "rate_date"))
    best = found.filter(gap <= REACH).groupBy("base", "quote", "day").agg(F.min(F.struct((~F.col("direct")).alias("inverse"), gap.alias("gap"), (-F.unix_date("rate_date")).alias("late"), "rate")).alias("b"))
    best = best.select(F.col("base").alias(base), F.col("quote").alias(quote), F.col("day").alias("_day"), F.col("b.rate").alias("_rate"))
    joined = df.withColumn("_day", F.col(day).cast("date")).join(best, [base, quote, "_day"], "left")
    return joined.withColumn(out, F.when(F.col(base) == F.col(quote), 1.0).otherwise(F.col("_rate"))).drop("_day", "_rate")


def rate_asof(df: DataFrame, rates: DataFrame, base: str, quote: str, day: str, out: str = "fx_rate") -> DataFrame:
    """The last rate on or before the day, from direct and inverse rates in one history (direct first on a day); the earliest if none is older."""
    history = both_ways(rates).groupBy("base", "quote", "rate_date").agg(F.max(F.struct("direct", "rate"))["rate"].alias("rate"))
    probes = df.select(F.col(base).alias("base"), F.col(quote).alias("quote"), F.col(day).cast("date").alias("day")).distinct()
    first = history.groupBy("base", "quote").agg(F.min_by("rate", "rate_date").alias("first_rate"))
    line = history.withColumnRenamed("rate_date", "day").withColumn("probe", F.lit(False)).unionByName(probes.withColumn("rate", F.lit(None).cast("double")).withColumn("probe", F.lit(True)))
    order = Window.partitionBy("base", "quote").orderBy("day", "probe").rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("last", F.last("rate", ignorenulls=True).over(order)).filter("probe").join(first, ["base", "quote"], "left")
    seen = seen.select(F.col("base").alias(base), F.col("quote").alias(quote), F.col("day").alias("_day"), F.coalesce("last", "first_rate").alias("_rate"))
    joined = df.withColumn("_day", F.col(day).cast("date")).join(seen, [base, quote, "_day"], "left")
    return joined.withColumn(out, F.when(F.col(base) == F.col(quote), 1.0).otherwise(F.col("_rate"))).drop("_day", "_rate")


def rate_latest(rates: DataFrame, quote: str) -> DataFrame:
    """(base, fx_rate, fx_date): newest direct rate to ``quote``, else the newest inverse."""
    newest = both_ways(rates).filter(F.col("quote") == quote).groupBy("base", "direct").agg(F.max(F.struct("rate_date", "rate")).alias("r"))
    best = newest.groupBy("base").agg(F.max(F.struct("direct", "r")).alias("b"))
    return best.select("base", F.col("b.r.rate").alias("fx_rate"), F.col("b.r.rate_date").alias("fx_date"))


def convert(amount: Column, rate: Column, exact: bool = False) -> Column:
    """Amount times rate; ``exact`` rounds half to even to cents, as the nearest mode does."""
    if exact:
        return F.bround(amount.cast("decimal(18,2)") * rate.cast("decimal(18,9)"), 2)
    return amount.cast("double") * rate


def asof_join(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, order: str, value: str, out: str) -> DataFrame:
    """For each left row the value of the newest right row of its key on or before its day (ties: largest ``order``)."""
    facts = right.groupBy(key, right_day).agg(F.max(F.struct(order, value)).alias("_f"))
    facts = facts.select(key, F.col(right_day).alias("_day"), F.struct(F.col(right_day).alias("day"), F.col(f"_f.{value}").alias("v")).alias("_fact"))
    probes = left.select(key, F.col(left_day).alias("_day")).distinct().withColumn("_fact", F.lit(None).cast(facts.schema["_fact"].dataType)).withColumn("_probe", F.lit(True))
    w = Window.partitionBy(key).orderBy("_day", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    line = facts.withColumn("_probe", F.lit(False)).unionByName(probes).withColumn("_last", F.last("_fact", ignorenulls=True).over(w)).filter("_probe")
    seen = line.select(key, F.col("_day").alias(left_day), F.col("_last.v").alias(out), F.col("_last.day").alias(f"{out}_day"))
    return left.join(seen, [key, left_day], "left")
