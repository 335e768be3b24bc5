"""Values of funds and unvested units, returns of a series, values carried by an index, breakdowns, closed accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.functions.rules import classify_event

MONEY = "decimal(38,2)"
# Least returns of a fit, least variance, and confidences of a classification.
LEAST_RETURNS, LEAST_VARIANCE = 3, 1e-10
CONFIDENCE = {"inferred": 0.6, "user_confirmed": 1.0, "imported": 1.0, "rule_derived": 1.0}


def fund_value(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """(account_id, n_funds, value, as_of): units times the newest price of each fund, in cents; funds without a price are left out.

    ``lots`` has account_id, instrument_id, quantity; ``prices`` instrument_id,
    day, price.  Accounts without a priced fund are left out.
    """
    newest = prices.groupBy("instrument_id").agg(F.max(F.struct("day", "price")).alias("p"))
    rows = lots.join(newest, "instrument_id").withColumn("v", F.bround(F.col("quantity").cast("decimal(18,6)") * F.col("p.price").cast("decimal(18,6)"), 2).cast(MONEY))
    return rows.groupBy("account_id").agg(F.count_distinct("instrument_id").alias("n_funds"), F.sum("v").cast(MONEY).alias("value"), F.max("p.day").alias("as_of"))


def unvested_value(vests: DataFrame, prices: DataFrame, as_of: str) -> DataFrame:
    """(account_id, units, value): units that have not vested, at the newest price; 0 without a price.

    ``vests`` has account_id, instrument_id, vest_date, units, unvested: the
    unvested units if they are given, else the units of later days.
    """
    newest = prices.groupBy("instrument_id").agg(F.max_by("price", "day").alias("price"))
    units = F.coalesce(F.col("unvested"), F.when(F.col("vest_date") > F.lit(as_of).cast("date"), F.col("units")), F.lit(0)).cast("decimal(18,6)")
    sums = vests.groupBy("account_id", "instrument_id").agg(F.sum(units).cast("decimal(18,6)").alias("u")).join(newest, "instrument_id", "left")
    value = F.coalesce(F.bround(F.col("u") * F.col("price").cast("decimal(18,6)"), 2), F.lit(0)).cast(MONEY)
    return sums.withColumn("v", value).groupBy("account_id").agg(F.sum("u").cast("decimal(28,6)").alias("units"), F.sum("v").cast(MONEY).alias("value"))


def annual_returns(values: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """(key, n, return_pct, volatility_pct) of a series' log returns from month to month.

    The last value of a month counts; pairs with a value that isn't positive
    give no return.  Three returns are needed; the variance is 1e-10 at least.
    """
    monthly = values.groupBy(key, F.date_trunc("month", day).alias("month")).agg(F.max_by(value, day).cast("double").alias("v"))
    before = F.lag("v").over(Window.partitionBy(key).orderBy("month"))
    back = monthly.withColumn("p", before).filter("p > 0 and v > 0").withColumn("r", F.log(F.try_divide("v", "p")))
    fit = back.groupBy(key).agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.sqrt(F.greatest(F.var_pop("r"), F.lit(LEAST_VARIANCE))).alias("s")).filter(F.col("n") >= LEAST_RETURNS)
    return fit.select(key, "n", F.round((F.exp(F.col("m") * 12) - 1) * 100, 2).alias("return_pct"), F.round(F.col("s") * F.sqrt(F.lit(12.0)) * 100, 2).alias("volatility_pct"))


def indexed_value(bases: DataFrame, index: DataFrame) -> DataFrame:
    """(property_id, value, growth_pct): a value of some day carried to the newest index of its series, to a thousand.

    ``bases`` has property_id, series, day, value; ``index`` series, day, level.
    The index of the base is the last one on or before its day; without one,
    or where it is 0, there is no value.
    """
    newest = index.groupBy("series").agg(F.max_by("level", "day").cast("double").alias("now"))
    line = index.select("series", "day", F.col("level").cast("double").alias("level"), F.lit(0).alias("probe")).unionByName(bases.select("series", "day").distinct().withColumns({"level": F.lit(None).cast("double"), "probe": F.lit(1)}))
    w = Window.partitionBy("series").orderBy("day", "probe").rowsBetween(Window.unboundedPreceding, 0)
    at = line.withColumn("then", F.last("level", ignorenulls=True).over(w)).filter("probe = 1").select("series", "day", "then")
    ratio = F.try_divide("now", "then")
    return bases.join(at, ["series", "day"]).join(newest, "series").withColumn("ratio", ratio).filter("ratio is not null").select("property_id", F.round(F.col("value").cast("double") * F.col("ratio"), -3).alias("value"), F.round((F.col("ratio") - 1) * 100, 4).alias("growth_pct"))


def essential_breakdown(totals: DataFrame, overrides: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """(part, category, total, pct): each category's share of the grand total, and the two subtotals.

    ``part`` is essential or discretionary: what the owner said (category,
    is_essential), else whether a word is in the name.  A row without a
    category is the subtotal of its part.  A total of 0 makes all shares 0.
    """
    named = F.lit(False)
    for w in words:
        named = named | F.lower("category").contains(w)
    rows = totals.join(overrides.select("category", "is_essential"), "category", "left")
    rows = rows.withColumn("part", F.when(F.coalesce("is_essential", named), "essential").otherwise("discretionary"))
    grand = rows.agg(F.sum("total").cast(MONEY).alias("grand"))
    share = F.round(F.coalesce(F.try_divide(F.col("total").cast("double") * 100, F.col("grand").cast("double")), F.lit(0.0)), 1)
    each = rows.select("part", "category", F.col("total").cast(MONEY).alias("total"))
    sums = each.groupBy("part").agg(F.sum("total").cast(MONEY).alias("total")).select("part", F.lit(None).cast("string").alias("category"), "total")
    return each.unionByName(sums).crossJoin(F.broadcast(grand)).select("part", "category", "total", share.alias("pct"))  # one row


def confirmed_flows(links: DataFrame, txns: DataFrame, rates: DataFrame, base: str) -> DataFrame:
    """(from_id, to_id, n, cents, n_unconverted, native): confirmed links by pair of accounts, what left converted at the day's nearest rate.

    ``links`` has out_id, in_id, confirmed; ``txns`` txn_id, account_id, ts,
    amount, currency.  ``native`` lists the sums by currency.  Amounts without a
    rate are counted apart and add nothing.
    """
    from talliver.operators.fx import rate_nearest

    side = lambda name: txns.select(F.col("txn_id").alias(f"{name}_id"), F.col("account_id").alias(f"{name}_account"), F.to_date("ts").alias("day"), "amount", "currency")
    rows = links.filter("confirmed").join(side("out"), "out_id").join(side("in").select("in_id", "in_account"), "in_id")
    cells = rows.groupBy("out_account", "in_account", "currency", "day").agg(F.count("*").alias("c"), F.sum(F.abs("amount")).cast(MONEY).alias("moved")).withColumn("base", F.lit(base))
    rated = rate_nearest(cells, rates, "currency", "base", "day")
    cents = F.round(F.col("moved").cast("double") * F.col("fx_rate") * 100).cast("long")
    by_currency = rated.groupBy("out_account", "in_account", "currency").agg(F.sum("c").alias("c"), F.sum("moved").cast(MONEY).alias("moved"), F.sum(cents).alias("cents"), F.sum(F.when(F.col("fx_rate").isNull(), F.col("c")).otherwise(0)).alias("u"))
    native = F.array_join(F.array_sort(F.collect_list(F.concat("currency", F.lit(" "), F.col("moved").cast("string")))), ", ")
    return by_currency.groupBy(F.col("out_account").alias("from_id"), F.col("in_account").alias("to_id")).agg(F.sum("c").alias("n"), F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.sum("u").alias("n_unconverted"), native.alias("native"))


def classify_open(txns: DataFrame, accounts: DataFrame, provenance: str = "inferred") -> DataFrame:
    """(txn_id, event_type, provenance, confidence) of the rows without an event, or with ``unclassified``; rows of unknown accounts stay out."""
    rows = txns.filter("event_type is null or event_type = 'unclassified'").join(accounts.select("account_id", "account_type"), "account_id")
    event = classify_event(F.col("amount"), F.col("description"), F.col("account_type"), F.col("is_transfer"), F.lit(""))
    return rows.select("txn_id", event.alias("event_type"), F.lit(provenance).alias("provenance"), F.lit(CONFIDENCE[provenance]).alias("confidence"))


def close_accounts(accounts: DataFrame, closing: DataFrame) -> DataFrame:
    """Accounts after closing: ``closing`` has account_id, closed_at, reason, zero_balance.

    A closed account loses its payment due date; if its balance is settled, its
    statement balance and value become 0 as of the closing day.  Blank reasons
    are null, long ones cut at 200 characters.  Other accounts stay as they are.
    """
    say = closing.select("account_id", F.col("closed_at").alias("_at"), F.substring(F.nullif(F.trim("reason"), F.lit("")), 1, 200).alias("_reason"), F.coalesce("zero_balance", F.lit(False)).alias("_zero"))
    out = accounts.join(say, "account_id", "left")
    shut, zero = F.col("_at").isNotNull(), F.coalesce("_zero", F.lit(False))
    out = out.withColumns({
        "statement_balance": F.when(zero, F.lit(0)).otherwise(F.col("statement_balance")).cast("decimal(18,2)"), "current_value": F.when(zero, F.lit(0)).otherwise(F.col("current_value")).cast("decimal(18,2)"),
        "statement_balance_as_of": F.when(zero, F.col("_at")).otherwise(F.col("statement_balance_as_of")), "payment_due_date": F.when(~shut, F.col("payment_due_date")), "closed_at": F.coalesce("_at", "closed_at"), "closed_reason": F.when(shut, F.col("_reason")).otherwise(F.col("closed_reason")),
    })
    return out.drop("_at", "_reason", "_zero")
