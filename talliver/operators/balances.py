"""Balances with their source, age and confidence, and net worth from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talliver.functions.rules import type_group
from talliver.operators.fx import rate_asof

MONEY = "decimal(38,2)"


def txn_sum(txns: DataFrame, as_of=None) -> DataFrame:
    """(account_id, total, n_rows) of the rows up to a day."""
    rows = txns if as_of is None else txns.filter(F.to_date("ts") <= F.lit(as_of))
    return rows.groupBy("account_id").agg(F.sum("amount").cast(MONEY).alias("total"), F.count("*").alias("n_rows"))


def closing_rows(rows: DataFrame) -> DataFrame:
    """(account_id, day, value) of the rows (txn_id, account_id, day, amount, balance_after) that close their day.

    The closing row is the one that no other row of the day follows, i.e.
    whose balance is no other row's balance before its amount; else the one
    with the highest id.
    """
    held = rows.filter("balance_after is not null")
    before = held.select("account_id", "day", (F.col("balance_after") - F.col("amount")).cast(MONEY).alias("closing"), F.col("txn_id").alias("next_id"))
    closing = held.withColumn("closing", F.col("balance_after").cast(MONEY)).join(before, ["account_id", "day", "closing"], "left").filter("next_id is null or next_id <> txn_id")
    ends = closing.groupBy("account_id", "day", "txn_id", "balance_after").agg(F.count("next_id").alias("followers"))
    ends = ends.groupBy("account_id", "day").agg(F.max(F.struct((F.col("followers") == 0).alias("last"), "txn_id", "balance_after")).alias("c"))
    return ends.select("account_id", "day", F.col("c.balance_after").cast(MONEY).alias("value"))


def account_states(probes: DataFrame, anchors: DataFrame, txns: DataFrame, running: DataFrame, valuations: DataFrame | None = None) -> DataFrame:
    """(account_id, as_of, total, at_anchor, marker, marker_day, mark, mark_day) for each (account_id, as_of) of ``probes``.

    The sum of the rows up to the day and up to the account's anchor (account_id,
    day); the balance of the last closing row with what came after it without a
    balance; the newest valuation.  Day sums, closing rows, valuations, anchors
    and probes are one line per account, so all of it is one shuffle of days
    and one sort.
    """
    rows = txns.select("txn_id", "account_id", F.to_date("ts").alias("day"), "amount").join(running.select("txn_id", "balance_after", F.lit(True).alias("known")), "txn_id", "left")
    kinds = {"day_sum": MONEY, "loose": MONEY, "value": MONEY, "marked": f"struct<day: date, v: {MONEY}>", "anchor": "boolean", "probe": "boolean"}
    shape = lambda df: df.select("account_id", "day", *[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])
    line = shape(rows.groupBy("account_id", "day").agg(F.sum("amount").cast(MONEY).alias("day_sum"), F.sum(F.when(F.col("known") & F.col("balance_after").isNull(), F.col("amount"))).cast(MONEY).alias("loose")))
    line = line.unionAll(shape(closing_rows(rows.filter("known")))).unionAll(shape(anchors.dropna().withColumn("anchor", F.lit(True)))).unionAll(shape(probes.select("account_id", F.col("as_of").alias("day"), F.lit(True).alias("probe"))))
    if valuations is not None:
        newest = valuations.groupBy("account_id", F.col("val_date").alias("day")).agg(F.max(F.struct("valuation_id", "value")).alias("m"))
        line = line.unionAll(shape(newest.select("account_id", "day", F.struct("day", F.col("m.value").alias("v")).alias("marked"))))
    # Rows of a day are peers, so their order within it makes no difference.
    upto = Window.partitionBy("account_id").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast(MONEY)
    line = line.withColumns({"total": F.sum("day_sum").over(upto).cast(MONEY), "tail": F.coalesce(F.sum("loose").over(upto), zero).cast(MONEY), "marked": F.last("marked", ignorenulls=True).over(upto)})
    closes = F.when(F.col("value").isNotNull(), F.struct("day", "value", "tail"))
    line = line.withColumns({"m": F.last(closes, ignorenulls=True).over(upto), "at_anchor": F.max(F.when(F.col("anchor"), F.col("total"))).over(Window.partitionBy("account_id"))})
    marker = (F.col("m.value") + F.col("tail") - F.col("m.tail")).cast(MONEY)
    return line.filter("probe").select("account_id", F.col("day").alias("as_of"), "total", "at_anchor", marker.alias("marker"), F.col("m.day").alias("marker_day"), F.col("marked.v").alias("mark"), F.col("marked.day").alias("mark_day"))


def marker_balance(txns: DataFrame, running: DataFrame, dates: DataFrame) -> DataFrame:
    """(account_id, as_of, marker, marker_day) for each as-of day of ``dates``, of accounts that have a marker by then.

    The day is the last one with a running balance; rows after it that carry no
    balance are added to its closing row's.
    """
    probes = txns.select("account_id").distinct().crossJoin(F.broadcast(dates))  # dates: the as-of days asked for
    none = txns.select("account_id", F.to_date("ts").alias("day")).limit(0)
    return account_states(probes, none, txns, running).filter("marker is not null").select("account_id", "as_of", "marker", "marker_day")


def balances(accounts: DataFrame, txns: DataFrame, running: DataFrame, valuations: DataFrame, rates: DataFrame, dates: DataFrame, base: str = "USD") -> DataFrame:
    """One row per account and as-of day: value, currency, balance_as_of, source_used, confidence, stale, value_base.

    ``dates`` (as_of) is the short list of days asked for.  A running-balance
    marker comes before anchored statements and sums; statements age after 45
    days, valuations after 90.
    """
    probes = accounts.select("account_id").crossJoin(F.broadcast(dates))
    anchors = accounts.select("account_id", F.col("statement_balance_as_of").alias("day"))
    states = account_states(probes, anchors, txns, running, valuations).withColumnRenamed("total", "txn_total")
    grid = states.join(accounts, "account_id")
    zero = F.lit(0).cast(MONEY)

    kind = F.col("balance_truth_source")
    since = (F.coalesce("txn_total", zero) - F.coalesce("at_anchor", zero)).cast(MONEY)
    anchored = F.when(F.col("is_asset"), F.col("statement_balance") + since).otherwise(F.col("statement_balance") - since)
    old_statement = F.datediff("as_of", "statement_balance_as_of") > 45
    old_mark = F.datediff("as_of", "mark_day") > 90
    total = F.coalesce("txn_total", zero)
    led = kind.isin("transaction_sum", "hybrid") & F.col("marker").isNotNull()
    marked = kind.isin("latest_valuation", "manual_mark") & F.col("mark").isNotNull()
    value = (
        F.when(led, F.col("marker"))
        .when(kind == "transaction_sum", F.when(total != 0, total).otherwise(F.col("current_value")))
        .when(kind == "hybrid", anchored)
        .when(kind.isin("latest_statement", "liability_balance"), F.coalesce("statement_balance", "current_value"))
        .when(marked, F.col("mark"))
        .otherwise(F.col("current_value"))
    )
    source = (
        F.when(led, "running_balance").when((kind == "transaction_sum") & (total != 0), "transaction_sum").when(kind == "hybrid", "statement_anchored")
        .when(kind.isin("latest_statement", "liability_balance"), "statement").when(marked, "valuation").otherwise("current_value")
    )
    stale = (
        F.when(led | ((kind == "transaction_sum") & (total != 0)), False)
        .when(kind.isin("hybrid", "latest_statement", "liability_balance"), old_statement)
        .when(marked, old_mark)
        .otherwise(True)
    )
    confidence = (
        F.when(led, 0.92)
        .when(kind == "transaction_sum", F.when(total != 0, 0.8).otherwise(0.3))
        .when(kind.isin("hybrid"), F.when(stale, 0.6).otherwise(0.9))
        .when(kind == "latest_statement", F.when(stale, 0.5).otherwise(0.9))
        .when(kind == "liability_balance", F.when(stale, 0.4).otherwise(0.85))
        .when(kind == "latest_valuation", F.when(~marked, 0.3).when(stale, 0.4).otherwise(0.85))
        .otherwise(F.when(marked & ~stale, 0.5).otherwise(0.2))
    )
    seen = F.when(led, F.col("marker_day")).when(kind.isin("hybrid", "latest_statement", "liability_balance"), F.col("statement_balance_as_of")).when(marked, F.col("mark_day"))
    out = grid.select("account_id", "user_id", "account_type", "is_asset", "as_of", "currency", value.cast(MONEY).alias("value"), seen.alias("balance_as_of"), source.alias("source_used"), confidence.cast("double").alias("confidence"), stale.alias("stale"), F.lit(base).alias("base"))
    out = rate_asof(out, rates, "currency", "base", "as_of")
    return out.withColumn("value_base", F.when(F.col("value") == 0, 0.0).otherwise(F.col("value").cast("double") * F.col("fx_rate"))).drop("base")


def month_ends(spark, last: str, months: int) -> DataFrame:
    """(as_of): the ends of ``months`` months, the last one cut at ``last``."""
    first = F.add_months(F.trunc(F.lit(last).cast("date"), "month"), -(months - 1))
    return spark.range(months).select(F.least(F.last_day(F.add_months(first, F.col("id").cast("int"))), F.lit(last).cast("date")).alias("as_of"))


def net_worth(found: DataFrame, sign_mode: str = "signed") -> DataFrame:
    """(user_id, as_of, assets, liabilities, net, n_accounts, n_stale); in cents of base, each balance rounded once.

    ``signed`` subtracts liabilities as they stand, so a card in credit adds;
    ``absolute`` takes their size.
    """
    cents = F.coalesce(F.round(F.col("value_base") * 100), F.lit(0.0)).cast("long")
    owed = F.abs(cents) if sign_mode == "absolute" else cents
    return found.groupBy("user_id", "as_of").agg(
        F.sum(F.when(F.col("is_asset"), cents).otherwise(0)).alias("assets"),
        F.sum(F.when(~F.col("is_asset"), owed).otherwise(0)).alias("liabilities"),
        F.sum(F.when(F.col("is_asset"), cents).otherwise(-owed)).alias("net"),
        F.count("*").alias("n_accounts"),
        F.count_if("stale").alias("n_stale"),
    )


def net_worth_by_group(found: DataFrame) -> DataFrame:
    """Signed cents of base per display group and day."""
    cents = F.coalesce(F.round(F.col("value_base") * 100), F.lit(0.0)).cast("long")
    return found.groupBy("as_of", type_group(F.col("account_type")).alias("type_group")).agg(F.sum(F.when(F.col("is_asset"), cents).otherwise(-cents)).alias("net"))


def household_snapshot(found: DataFrame) -> DataFrame:
    """Per user and day: accounts, stale ones, low-confidence ones, and the share that is neither."""
    low = F.count_if(F.col("confidence") < 0.5)
    stale, n = F.count_if("stale"), F.count("*")
    return found.groupBy("user_id", "as_of").agg(n.alias("n_accounts"), stale.alias("n_stale"), low.alias("n_low"), F.greatest(F.lit(0.0), (n - stale - low) / n).alias("confidence"))


def balance_sheet(found: DataFrame) -> DataFrame:
    """(as_of, side, type_group, n, total): absolute cents of base by side and display group; a null group is the side's total."""
    cents = F.coalesce(F.round(F.col("value_base") * 100), F.lit(0.0)).cast("long")
    rows = found.select("as_of", F.when(F.col("is_asset"), "asset").otherwise("liability").alias("side"), type_group(F.col("account_type")).alias("type_group"), cents.alias("cents"))
    sums = rows.groupBy("as_of", "side", "type_group").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    sides = sums.groupBy("as_of", "side").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents")).withColumn("type_group", F.lit(None).cast("string"))
    return sums.unionByName(sides).select("as_of", "side", "type_group", "n", F.abs("cents").alias("total"))


def household_totals(found: DataFrame) -> DataFrame:
    """``household_snapshot`` with assets, liabilities and net, in cents of base."""
    return net_worth(found).drop("n_accounts", "n_stale").join(household_snapshot(found), ["user_id", "as_of"])


# The names under which a source row holds the day it was posted, its formats, and the most days between.
POST_KEYS = ("Post Date", "Posted Date", "Posting Date", "Settlement Date", "post_date", "posted_date", "posting_date")
POST_FORMATS = ("M/d/yyyy", "d/M/yyyy", "yyyy-M-d", "M/d/yy", "d/M/yy")
POST_DAYS = 14


def posted_after(raw: Column, ts: Column) -> Column:
    """Whether the source row (a JSON object) says that it was posted after its own day.

    The first name that holds a text counts.  Its order of day and month isn't
    known, so all readings are tried, and the least one within 0 to 14 days
    decides; without any, or without a source row, false.
    """
    held = F.from_json(raw, "map<string,string>")
    text = F.coalesce(*[F.nullif(F.trim(held[k]), F.lit("")) for k in POST_KEYS])
    lags = F.array(*[F.datediff(F.try_to_timestamp(text, F.lit(f)).cast("date"), F.to_date(ts)) for f in POST_FORMATS])
    return F.coalesce(F.array_min(F.filter(lags, lambda d: d.between(0, POST_DAYS))) > 0, F.lit(False))


def anchored_balance(accounts: DataFrame, txns: DataFrame) -> DataFrame:
    """(account_id, value, later): the statement's balance and the rows that aren't on it: those of later days, and those of its own day that were posted later."""
    rows = txns.join(accounts.select("account_id", "statement_balance_as_of"), "account_id").withColumn("day", F.to_date("ts"))
    same = (F.col("day") == F.col("statement_balance_as_of")) & posted_after(F.col("raw_data"), F.col("ts"))
    zero = F.lit(0).cast(MONEY)
    sums = rows.filter((F.col("day") > F.col("statement_balance_as_of")) | same).groupBy("account_id").agg(F.sum("amount").cast(MONEY).alias("since"), F.count_if(same).alias("later"))
    out = accounts.filter("statement_balance is not null").join(sums, "account_id", "left")
    since = F.coalesce("since", zero)
    value = F.when(F.col("is_asset"), F.col("statement_balance") + since).otherwise(F.col("statement_balance") - since)
    return out.select("account_id", value.cast(MONEY).alias("value"), F.coalesce("later", F.lit(0).cast("long")).alias("later"))
