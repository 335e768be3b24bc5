"""Reports over the ledger: groups that must net to zero, quality, what moved net worth, statements, pay and property documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.operators.balances import net_worth
from talliver.operators.fx import asof_join, both_ways, convert, rate_nearest

MONEY = "decimal(38,2)"
# Ages in days, shares and counts beyond which a check warns or blocks.
STATEMENT_DAYS, MARK_DAYS, RATE_DAYS, LIABILITY_DAYS = 45, 90, 7, 60
UNCATEGORISED_BLOCKS, UNCATEGORISED_WARNS, OPEN_TRANSFERS_BLOCK, LOW_CONFIDENCE = 0.5, 0.1, 10, 0.5
# Treatments that allow a member to be converted at the group's day.
CONVERTS = ("spot_on_group_date", "member_rates")
# Event types of each part of a change in net worth.
PARTS = {
    "contributions": ("external_income", "payroll_income", "employer_benefit"),
    "investment_flows": ("investment_contribution", "investment_withdrawal", "investment_flow"),
    "fees_and_interest": ("fee", "mortgage_interest"),
    "principal_paydown": ("mortgage_principal",),
    "tax_payments": ("tax_payment",),
    "spending": ("lifestyle_expense",),
}


def validate_groups(groups: DataFrame, members: DataFrame, rates: DataFrame) -> DataFrame:
    """(group_id, net, n_converted, n_missing, n_currencies, balanced): the members of a group, in its base currency, must net to zero.

    A stored base amount counts first, then an amount in the base currency,
    then the nearest rate of the group's day if its treatment allows it.  Fee
    legs are left out where the group says so.  A group without members nets to zero.
    """
    rows = members.join(groups.select("group_id", "base_currency", "fx_treatment", "excludes_fees", F.col("as_of").alias("day")), "group_id")
    currencies = F.size(F.collect_set("currency")).cast("long").alias("n_currencies")
    kinds = members.groupBy("group_id").agg(currencies)
    rows = rate_nearest(rows.filter("not (excludes_fees and is_fee)"), rates, "currency", "base_currency", "day")
    own = F.when(F.col("currency") == F.col("base_currency"), F.col("amount")).when(F.col("fx_treatment").isin(*CONVERTS), convert(F.col("amount"), F.col("fx_rate"), exact=True))
    rows = rows.withColumn("base", F.coalesce("amount_base", own).cast(MONEY))
    sums = rows.groupBy("group_id").agg(F.sum("base").cast(MONEY).alias("net"), F.count("base").alias("n_converted"), F.count_if(F.col("base").isNull()).alias("n_missing"))
    out = groups.select("group_id", "tolerance").join(sums, "group_id", "left").join(kinds, "group_id", "left")
    out = out.withColumn("net", F.coalesce("net", F.lit(0)).cast(MONEY)).fillna(0, ["n_converted", "n_missing", "n_currencies"])
    return out.select("group_id", "net", "n_converted", "n_missing", "n_currencies", (F.abs("net") <= F.col("tolerance")).alias("balanced"))


def account_ages(accounts: DataFrame, valuations: DataFrame, rates: DataFrame, as_of: str, base: str = "USD") -> DataFrame:
    """(account_id, stale, rate_stale, aged): whether an account's balance, its newest rate (either way) and a liability's statement are too old."""
    day = F.lit(as_of).cast("date")
    marks = valuations.groupBy("account_id").agg(F.max("val_date").alias("marked"))
    newest = both_ways(rates).filter(F.col("quote") == base).groupBy(F.col("base").alias("currency")).agg(F.max("rate_date").alias("rated"))
    rows = accounts.join(marks, "account_id", "left").join(newest, "currency", "left")
    kind, age = F.col("balance_truth_source"), lambda c: F.datediff(day, c)
    old = (
        F.when(kind.isin("latest_statement", "hybrid", "liability_balance"), F.coalesce(age("statement_balance_as_of") > STATEMENT_DAYS, F.lit(False)))
        .when(kind == "manual_mark", F.coalesce(age("value_as_of") > MARK_DAYS, F.lit(True)))
        .when(kind == "latest_valuation", F.coalesce(age("marked") > MARK_DAYS, F.lit(True)))
        .otherwise(False)
    )
    rate_old = (F.col("currency") != base) & F.coalesce(age("rated") > RATE_DAYS, F.lit(True))
    empty = F.col("statement_balance").isNull() & F.col("current_value").isNull()
    aged = ~F.col("is_asset") & (empty | F.coalesce(age("statement_balance_as_of") > LIABILITY_DAYS, F.lit(False)))
    return rows.select("account_id", old.alias("stale"), rate_old.alias("rate_stale"), aged.alias("aged"))


def quality_counters(txns: DataFrame, splits: DataFrame, components: DataFrame, ages: DataFrame, groups: DataFrame) -> DataFrame:
    """(check, n, blockers, warnings) of nine counters and of the age of liabilities.

    ``txns`` has category_id, event_type, confidence, is_transfer and linked;
    ``ages`` is of ``account_ages``, ``groups`` of ``validate_groups``.  Rows are read once.
    """
    held = lambda df, name: df.select("txn_id").distinct().withColumn(name, F.lit(True))
    rows = txns.join(held(splits, "split"), "txn_id", "left").join(held(components, "parts"), "txn_id", "left")
    debt = F.col("event_type").isin("liability_payment", "mortgage_payment")
    counts = rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("category_id").isNull()).alias("uncategorized"),
        F.count_if(F.coalesce(F.col("event_type") == "unclassified", F.lit(True))).alias("unclassified"),
        F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_confidence"),
        F.count_if(F.col("is_transfer") & ~F.col("linked")).alias("unresolved_reconciliation"),
        F.count_if(F.col("split").isNull()).alias("unsplit"),
        F.count_if(debt & F.col("parts").isNull()).alias("without_decomposition"),
    )
    of_accounts = ages.agg(F.count_if("stale").alias("stale_valuation"), F.count_if("rate_stale").alias("missing_fx"), F.count_if("aged").alias("aged_liability"))
    of_groups = groups.agg(F.count_if((F.col("n_currencies") > 1) & (F.col("n_missing") > 0)).alias("reconciliation_fx_gap"))
    one = counts.crossJoin(of_accounts).crossJoin(of_groups)  # three frames of one row each
    c, some = F.col, lambda name: (F.col(name) > 0).cast("long")
    zero, share = F.lit(0).cast("long"), F.try_divide("uncategorized", "total")
    many, few = (c("unresolved_reconciliation") > OPEN_TRANSFERS_BLOCK).cast("long"), c("unresolved_reconciliation").between(1, OPEN_TRANSFERS_BLOCK).cast("long")
    blocks = F.coalesce(share > UNCATEGORISED_BLOCKS, F.lit(True)).cast("long")
    warns = F.coalesce((share > UNCATEGORISED_WARNS) & (share <= UNCATEGORISED_BLOCKS), F.lit(False)).cast("long")
    levels = {"uncategorized": (blocks, warns), "unresolved_reconciliation": (many, few), "reconciliation_fx_gap": (c("reconciliation_fx_gap"), zero)}
    levels |= {n: (zero, some(n)) for n in ("unclassified", "low_confidence", "unsplit", "without_decomposition")}
    levels |= {n: (zero, c(n)) for n in ("stale_valuation", "missing_fx", "aged_liability")}
    checks = F.array(*[F.struct(F.lit(n).alias("check"), c(n).alias("n"), b.alias("blockers"), w.alias("warnings")) for n, (b, w) in levels.items()])
    return one.select(F.inline(checks))


def attribute_change(found: DataFrame, classified: DataFrame, owners: DataFrame, market: DataFrame, fx: DataFrame, start: str, end: str) -> DataFrame:
    """Per user, in cents: net worth on both days, its change, the sums of its parts, and what they leave unexplained.

    ``found`` holds balances of both days, ``classified`` rows with event
    types, ``market`` and ``fx`` what the marks and the rates moved.
    """
    net = net_worth(found).groupBy("user_id")
    ends = net.agg(F.sum(F.when(F.col("as_of") == F.lit(start).cast("date"), F.col("net"))).alias("nw_start"), F.sum(F.when(F.col("as_of") == F.lit(end).cast("date"), F.col("net"))).alias("nw_end"))
    rows = classified.filter(F.to_date("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    by_account = rows.groupBy("account_id").agg(*[F.sum(F.when(F.col("event_type").isin(*kinds), F.col("amount"))).alias(part) for part, kinds in PARTS.items()])
    sums = by_account.join(owners.select("account_id", "user_id"), "account_id").groupBy("user_id").agg(*[(F.sum(p) * 100).cast("long").alias(p) for p in PARTS])
    out = ends.join(sums, "user_id", "left").join(market.select("user_id", F.col("moved").alias("market_movement"), F.col("confidence").alias("market_confidence")), "user_id", "left")
    out = out.join(fx.select("user_id", F.col("moved").alias("fx_movement"), F.col("confidence_pct").alias("fx_confidence_pct")), "user_id", "left")
    names = [*PARTS, "market_movement", "fx_movement"]
    out = out.fillna(0, [*names, "market_confidence", "fx_confidence_pct"]).withColumn("change", F.col("nw_end") - F.col("nw_start"))
    explained = F.lit(0)
    for name in names:
        explained = explained + F.col(name)
    return out.select("user_id", "nw_start", "nw_end", "change", *names, "market_confidence", "fx_confidence_pct", (F.col("change") - explained).alias("unexplained"))


def statement_balances(accounts: DataFrame, snapshots: DataFrame, as_of: str) -> DataFrame:
    """(account_id, value, balance_as_of, confidence, stale) of accounts that follow statements.

    The newest snapshot on or before the day, else the statement balance, else
    the current value; a balance of 0 on the account counts as none.
    """
    rows = accounts.filter("balance_truth_source = 'latest_statement'").withColumn("as_of", F.lit(as_of).cast("date"))
    rows = asof_join(rows, snapshots, "account_id", "as_of", "statement_date", "snapshot_id", "balance", "snap")
    has = F.col("snap").isNotNull()
    seen = F.when(has, F.col("snap_day")).otherwise(F.col("statement_balance_as_of"))
    stale = F.coalesce(F.datediff("as_of", seen) > STATEMENT_DAYS, F.lit(False))
    nonzero = lambda c: F.nullif(F.col(c), F.lit(0).cast("decimal(18,2)"))
    value = F.coalesce("snap", nonzero("statement_balance"), nonzero("current_value"), F.lit(0))
    return rows.select("account_id", value.cast(MONEY).alias("value"), F.coalesce(seen, "as_of").alias("balance_as_of"), F.when(stale, 0.5).when(has, 0.95).otherwise(0.9).alias("confidence"), stale.alias("stale"))


def liability_balances(accounts: DataFrame, as_of: str) -> DataFrame:
    """(account_id, value, confidence, stale): principal where ``balance_from`` asks for it and it is not 0, else the statement, else the current value."""
    day = F.lit(as_of).cast("date")
    principal = F.when((F.col("balance_from") == "imported_principal_balance") & (F.col("principal") != 0), F.col("principal"))
    stale = F.coalesce(F.col("flagged_stale"), F.lit(False)) | F.coalesce(F.datediff(day, "statement_balance_as_of") > STATEMENT_DAYS, F.lit(False))
    rows = accounts.filter("balance_truth_source = 'liability_balance'")
    return rows.select("account_id", F.coalesce(principal, "statement_balance", "current_value", F.lit(0)).cast(MONEY).alias("value"), F.when(stale, 0.4).otherwise(0.85).alias("confidence"), stale.alias("stale"))


def liability_history(accounts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(account_id, statement_date, balance, change) of liabilities, one row a statement date (the last snapshot of it)."""
    rows = snapshots.join(accounts.filter("not is_asset").select("account_id"), "account_id")
    rows = rows.groupBy("account_id", "statement_date").agg(F.max_by("balance", "snapshot_id").alias("balance"))
    before = F.lag("balance").over(Window.partitionBy("account_id").orderBy("statement_date"))
    return rows.withColumn("change", (F.col("balance") - before).cast(MONEY))


def fx_finish(found: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """(account_id, as_of, fx_pair, fx_rate_date, fx_stale): the rate a balance was converted at; none where it needs none.

    The day is that of the last rate on or before, else of the earliest; a
    rate over a week old, or none, is stale.
    """
    history = both_ways(rates).filter(F.col("quote") == base).select(F.col("base").alias("currency"), "rate_date").distinct()
    first = history.groupBy("currency").agg(F.min("rate_date").alias("first"))
    probes = found.select("currency", "as_of").distinct()
    seen = asof_join(probes, history.withColumn("o", F.lit(0)).withColumn("d", F.col("rate_date")), "currency", "as_of", "rate_date", "o", "d", "last").join(first, "currency", "left")
    seen = seen.select("currency", "as_of", F.coalesce("last", "first").alias("at"))
    asked = (F.col("currency") != base) & (F.col("value") != 0)
    late = F.coalesce(F.datediff("as_of", "at") > RATE_DAYS, F.lit(True))
    rows = found.join(seen, ["currency", "as_of"], "left")
    return rows.select("account_id", "as_of", F.when(asked, F.concat("currency", F.lit(f"/{base}"))).alias("fx_pair"), F.when(asked, F.col("at")).alias("fx_rate_date"), (asked & late).alias("fx_stale"))


def decompose_statement_payments(txns: DataFrame, components: DataFrame, meta: DataFrame, phrase: str = "regular payment") -> DataFrame:
    """(txn_id, component, amount, confidence) for payment rows of a batch that have no components yet.

    ``meta`` gives principal, interest, escrow and confidence of an account's
    batch; both of the first two must be there, escrow only counts above 0.
    """
    rows = txns.filter(F.col("description").ilike(f"%{phrase}%")).join(components.select("txn_id"), "txn_id", "left_anti")
    rows = rows.select("txn_id", "account_id", "import_batch_id").join(meta.filter("principal is not null and interest is not null"), ["account_id", "import_batch_id"])
    parts = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).cast(MONEY).alias("amount")) for c in ("principal", "interest", "escrow")])
    return rows.select("txn_id", "confidence", F.inline(parts)).filter("component <> 'escrow' or amount > 0").select("txn_id", "component", "amount", "confidence")


def paycheck_summary(paychecks: DataFrame, year: int | None = None) -> DataFrame:
    """(account_id, n, gross, net, taxes, retirement, benefits), of one year if given."""
    rows = paychecks if year is None else paychecks.filter(F.col("pay_date").between(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date")))
    return rows.groupBy("account_id").agg(F.count("*").alias("n"), *[F.sum(c).cast(MONEY).alias(c) for c in ("gross", "net", "taxes", "retirement", "benefits")])


def document_series(documents: DataFrame, n: int, key: str = "account_id", day: str = "pay_date", order: str = "paycheck_id") -> DataFrame:
    """The newest ``n`` documents of each key, with their place."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(day), F.desc(order)))
    return documents.withColumn("place", place).filter(F.col("place") <= n)


def property_pnl(lines: DataFrame) -> DataFrame:
    """(document_id, income, expense, owner_draw, liability_adjustment, net_operating_income): income counts above 0, expenses and draws below."""
    kind, amount, zero = F.col("kind"), F.col("amount"), F.lit(0).cast(MONEY)
    total = lambda k, v: F.coalesce(F.sum(F.when(kind == k, v)), zero).cast(MONEY)
    spent = F.abs(F.least(amount, zero))
    out = lines.groupBy("document_id").agg(
        total("income", F.greatest(amount, zero)).alias("income"), total("expense", spent).alias("expense"),
        total("transfer", spent).alias("owner_draw"), total("liability", amount).alias("liability_adjustment"),
    )
    return out.withColumn("net_operating_income", (F.col("income") - F.col("expense")).cast(MONEY))


def lot_positions(lots: DataFrame, prices: DataFrame) -> DataFrame:
    """Per account and instrument: quantity, cost, average cost, value at the price, unrealised gain and its share of the cost."""
    held = lots.groupBy("account_id", "instrument_id").agg(F.sum("quantity").cast("decimal(38,6)").alias("quantity"), F.sum("cost").cast(MONEY).alias("cost"))
    out = held.join(prices.select("instrument_id", "price"), "instrument_id", "left")
    out = out.withColumn("value", F.round(F.col("quantity").cast("decimal(18,2)") * F.col("price").cast("decimal(18,2)"), 2).cast(MONEY)).withColumn("gain", (F.col("value") - F.col("cost")).cast(MONEY))
    d = lambda c: F.col(c).cast("double")
    average = F.when(F.col("quantity") != 0, d("cost") / d("quantity"))
    share = F.when(F.col("cost") != 0, d("gain") / d("cost") * 100)
    return out.select("account_id", "instrument_id", "quantity", "cost", average.alias("average_cost"), "value", "gain", share.alias("gain_pct"))


def amortisation(loans: DataFrame, months: int, cap: int = 480) -> DataFrame:
    """(account_id, month, interest, principal, balance, payoff_month) while a loan runs; loans whose payment doesn't exceed the first interest are left out.

    The last payment pays what is left; a payoff beyond ``cap`` months is null.
    A loan without a rate is paid off in equal payments.
    """
    rate, paid, owed = F.col("rate"), F.col("payment"), F.col("owed")
    rows = loans.withColumnRenamed("principal", "owed").filter(paid > owed * rate)
    grown = lambda m: F.when(rate == 0, F.lit(1.0) * m).otherwise(F.try_divide(F.pow(1 + rate, m) - 1, rate))
    after = lambda m: owed * F.pow(1 + rate, m) - paid * grown(m)
    payments = F.when(rate == 0, owed / paid).otherwise(F.try_divide(-F.log(1 - owed * rate / paid), F.log(1 + rate)))
    payoff = F.ceil(F.round(payments, 9)).cast("int")
    rows = rows.withColumn("payoff", payoff).withColumn("month", F.explode(F.sequence(F.lit(1), F.least(F.lit(months), "payoff"))))
    before = F.greatest(F.lit(0.0), after(F.col("month") - 1))
    left = F.greatest(F.lit(0.0), after(F.col("month")))
    return rows.select("account_id", "month", F.round(before * rate, 4).alias("interest"), F.round(before - left, 4).alias("principal"), F.round(left, 4).alias("balance"), F.when(F.col("payoff") <= cap, F.col("payoff")).alias("payoff_month"))


def write_snapshots(found: DataFrame, folder: str) -> None:
    """Balances as Parquet by day; writing a day again replaces that day alone."""
    found.repartition("as_of").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(folder)
