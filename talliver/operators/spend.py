"""Spending from split allocations and from rows; listings and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"


def money(total: Column) -> Column:
    return total.cast(MONEY)


def mean(total: Column, n: Column) -> Column:
    """A mean of exact sums, as a double."""
    return total.cast(MONEY).cast("double") / n.cast("double")


def lookback(df: DataFrame, as_of: str, months: int, ts: str = "ts") -> DataFrame:
    """Rows of the last ``months`` times 30 days before ``as_of``."""
    end = F.lit(as_of).cast("date")
    return df.filter((F.to_date(ts) > F.date_sub(end, months * 30)) & (F.to_date(ts) <= end))


def preset_start(as_of: str, preset: str) -> Column:
    """First day of a named range; null for all."""
    end = F.lit(as_of).cast("date")
    return {"ytd": F.trunc(end, "year"), "mtd": F.trunc(end, "month"), "1y": F.date_sub(end, 365), "2y": F.date_sub(end, 730), "all": F.lit(None).cast("date")}[preset]


def filter_transactions(df: DataFrame, account=None, category=None, date_from=None, date_to=None, text=None, is_transfer=None, least=None, most=None, currency=None) -> DataFrame:
    """Rows that meet every condition given; text is found in any case."""
    tests = [
        account is not None and (F.col("account_id") == account),
        category is not None and (F.col("category_id") == category),
        date_from is not None and (F.to_date("ts") >= F.lit(date_from).cast("date")),
        date_to is not None and (F.to_date("ts") <= F.lit(date_to).cast("date")),
        text is not None and F.lower("description").contains(text.lower()),
        is_transfer is not None and (F.col("is_transfer") == is_transfer),
        least is not None and (F.col("amount") >= least),
        most is not None and (F.col("amount") <= most),
        currency is not None and (F.col("currency") == currency),
    ]
    for test in tests:
        if test is not False:
            df = df.filter(test)
    return df


def owned_by(df: DataFrame, accounts: DataFrame, user: int) -> DataFrame:
    return df.join(accounts.filter(F.col("user_id") == user), "account_id", "left_semi")


def true_spend(splits: DataFrame, txns: DataFrame) -> DataFrame:
    """(month, spend_type, category_id, total, n) by grouping sets over the splits that count: total, type, category, month with type.

    ``level`` names the set; the sign is turned, so spend is positive.
    """
    rows = splits.filter("counts_as_true_spend").join(txns.select("txn_id", F.date_format("ts", "yyyy-MM").alias("month")), "txn_id")
    sets = rows.groupingSets([[], ["spend_type"], ["category_id"], ["month", "spend_type"]], "month", "spend_type", "category_id")
    out = sets.agg(money(-F.sum("amount_native")).alias("total"), F.count("*").alias("n"), F.grouping_id("month", "spend_type", "category_id").alias("g"))
    level = F.when(F.col("g") == 7, "total").when(F.col("g") == 5, "type").when(F.col("g") == 6, "category").otherwise("month_type")
    return out.select(level.alias("level"), "month", "spend_type", "category_id", "total", "n")


def spend_by_category(txns: DataFrame) -> DataFrame:
    rows = txns.filter("amount < 0").groupBy("category_id").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))
    return rows.withColumn("mean", mean(F.col("total"), F.col("n")))


def monthly_cashflow(events: DataFrame) -> DataFrame:
    """Spending and income by month; transfers and card settlements out, a null event in; refunds net against spending."""
    kept = events.filter("event_type is null or event_type not in ('internal_transfer', 'card_payment_settlement')")
    back = (F.col("amount") < 0) | F.coalesce(F.col("event_type").isin("merchant_refund", "card_credit"), F.lit(False))
    return kept.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(money(F.coalesce(-F.sum(F.when(back, F.col("amount"))), F.lit(0))).alias("spending"), money(F.coalesce(F.sum(F.when(~back, F.col("amount"))), F.lit(0))).alias("income"))


def top_merchants(txns: DataFrame, n: int) -> DataFrame:
    rows = txns.filter("amount < 0").groupBy("description").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"), F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    rows = rows.withColumn("mean", mean(F.col("total"), F.col("n"))).withColumn("recurring", F.col("n") >= 3)
    return rows.orderBy("total", "description").limit(n)


def recurring_expenses(txns: DataFrame, as_of: str) -> DataFrame:
    """Descriptions seen three times or more in 90 days: total and a third of it."""
    rows = lookback(txns, as_of, 3).filter("amount < 0").groupBy("description").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))
    return rows.filter("n >= 3").withColumn("monthly", mean(F.col("total"), F.lit(3)))


def category_stats(categories: DataFrame, txns: DataFrame) -> DataFrame:
    """(category_id, name, n, total) of every category; rows are summed by category before they meet its name."""
    sums = txns.groupBy("category_id").agg(F.count("txn_id").alias("c"), F.sum("amount").alias("s"))
    named = categories.select("category_id", "name").join(sums, "category_id", "left")
    return named.groupBy("category_id", "name").agg(F.coalesce(F.sum("c"), F.lit(0).cast("long")).alias("n"), money(F.coalesce(F.sum("s"), F.lit(0))).alias("total"))


def category_totals(txns: DataFrame, categories: DataFrame) -> DataFrame:
    """All-time count and sum by category name, with one row for rows without category."""
    named = txns.join(categories, "category_id", "left")
    return named.groupBy(F.coalesce("name", F.lit("Uncategorized")).alias("category")).agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))


def category_breakdown(totals: DataFrame, essential_words: tuple[str, ...]) -> DataFrame:
    """Share of the grand total (null where the totals cancel out), and the essential flag by keyword."""
    found = F.lit(False)
    for w in essential_words:
        found = found | F.lower("category").contains(w)
    share = F.try_divide(F.col("total").cast("double") * 100.0, F.sum("total").over(Window.partitionBy()).cast("double"))
    return totals.withColumn("share", share).withColumn("essential", found)


def account_category_month(txns: DataFrame, categories: list[int]) -> DataFrame:
    """Month by category matrix per account; categories are a fixed list."""
    month = F.date_format("ts", "yyyy-MM")
    cells = [money(F.coalesce(F.sum(F.when(F.col("category_id") == c, F.col("amount"))), F.lit(0))).alias(f"c{c}") for c in categories]
    return txns.groupBy("account_id", month.alias("month")).agg(*cells)


def uncategorised(txns: DataFrame, splits: DataFrame) -> DataFrame:
    return txns.filter("category_id is null").join(splits.filter("category_id is not null"), "txn_id", "left_anti")


def future_dated(txns: DataFrame, as_of: str) -> DataFrame:
    return txns.filter(F.to_date("ts") > F.lit(as_of).cast("date")).groupBy("account_id").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    return df.orderBy(F.desc("ts"), F.desc("txn_id")).offset(offset).limit(limit)


def largest_expenses(txns: DataFrame, as_of: str, n: int) -> DataFrame:
    return lookback(txns, as_of, 1).filter("amount < 0 and not is_transfer").orderBy("amount", "txn_id").limit(n)


def recent(df: DataFrame, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("txn_id"))
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def spend_chart(txns: DataFrame, accounts: DataFrame, rates: DataFrame, base: str) -> DataFrame:
    """Month by category spend in cents of ``base``: buckets by currency are converted at month end, then merged; unconverted ones are counted."""
    from talliver.operators.fx import rate_nearest

    rows = txns.filter("amount < 0 and not is_transfer").join(accounts.select("account_id", "currency"), "account_id")
    cells = rows.groupBy(F.last_day(F.to_date("ts")).alias("month_end"), "category_id", "currency").agg(money(-F.sum("amount")).alias("spent")).withColumn("base", F.lit(base))
    rated = rate_nearest(cells, rates, "currency", "base", "month_end")
    cents = F.round(F.col("spent").cast("double") * F.coalesce("fx_rate", F.lit(1.0)) * 100).cast("long")
    return rated.groupBy("month_end", "category_id").agg(F.sum(cents).alias("cents"), F.count_if(F.col("fx_rate").isNull()).alias("n_unconverted"))


def effective_amount():
    """The amount in base if there is one, else the native one."""
    return F.coalesce("amount_base", "amount_native")


def page_with_total(txns: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the rows, newest first, each with the number of all rows."""
    total = txns.agg(F.count("*").alias("total"))
    return page(txns, offset, limit).crossJoin(F.broadcast(total))  # one row


# Words of loan payments that count as spend though they are transfers, and of balance markers that never do.
LOAN_WORDS = ("mortgage", "mortgagemain", "mtg", "blackhorse", "black horse")
BALANCE_MARKERS = ("brought forward", "carried forward", "opening balance")


def income_and_spend(txns: DataFrame, accounts: DataFrame, categories: DataFrame, rates: DataFrame, base: str, since: str) -> DataFrame:
    """(side, month_end, category, cents, n_unconverted) in cents of ``base``; spend is negative.

    Spend: amounts below 0 that are no balance markers and no transfers, unless
    they pay a loan.  Income: amounts above 0 on asset accounts that are no
    transfers.  Rows of a transfer category (category_type) are neither; rows
    without a category are ``Uncategorized``.  Sums by currency are converted
    at the month's end; those without a rate stay as they are and are counted.
    """
    from talliver.operators.fx import rate_nearest

    text = F.lower(F.coalesce("description", F.lit("")))
    has = lambda words: F.greatest(*[text.contains(w) for w in words])
    rows = txns.filter(F.to_date("ts") >= F.lit(since).cast("date")).drop("is_asset", "currency").join(accounts.select("account_id", "currency", "is_asset"), "account_id").join(categories.select("category_id", F.col("name").alias("category"), "category_type"), "category_id", "left")
    rows = rows.filter("category_type is null or category_type <> 'transfer'")
    spent = (F.col("amount") < 0) & ~has(BALANCE_MARKERS) & (~F.col("is_transfer") | has(LOAN_WORDS))
    earned = (F.col("amount") > 0) & ~F.col("is_transfer") & F.col("is_asset")
    rows = rows.withColumn("side", F.when(spent, "spend").when(earned, "income")).filter("side is not null")
    currency = F.upper(F.coalesce("currency", F.lit(base)))
    cells = rows.groupBy("side", F.last_day(F.to_date("ts")).alias("month_end"), F.coalesce("category", F.lit("Uncategorized")).alias("category"), currency.alias("currency")).agg(money(F.sum("amount")).alias("total")).withColumn("base", F.lit(base))
    rated = rate_nearest(cells, rates, "currency", "base", "month_end")
    cents = F.round(F.col("total").cast("double") * F.coalesce("fx_rate", F.lit(1.0)) * 100).cast("long")
    return rated.groupBy("side", "month_end", "category").agg(F.sum(cents).alias("cents"), F.count_if(F.col("fx_rate").isNull()).alias("n_unconverted"))


def account_category_summary(txns: DataFrame, categories: DataFrame) -> DataFrame:
    """(account_id, month, category, n, total) of every account: by category and month, and for all months where month is null; rows without a category are ``Uncategorized``."""
    named = txns.join(categories.select("category_id", "name"), "category_id", "left").select("account_id", F.date_format("ts", "yyyy-MM").alias("month"), F.coalesce("name", F.lit("Uncategorized")).alias("category"), "amount")
    months = named.groupBy("account_id", "month", "category").agg(F.count("*").alias("n"), money(F.sum("amount")).alias("total"))
    whole = months.groupBy("account_id", "category").agg(F.sum("n").alias("n"), money(F.sum("total")).alias("total")).withColumn("month", F.lit(None).cast("string"))
    return months.unionByName(whole)
