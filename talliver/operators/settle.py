"""Rows that settle scheduled payments, and interest that accrues month by month."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from talliver.functions.rules import MONTH_STEPS, step_date
from talliver.functions.text import comparison_key, grouping_key, text_similarity
from talliver.operators.pairs import stored

# Scores that settle and that propose, days beyond which a date says nothing, and weights.
SETTLES, PROPOSES, WINDOW = 0.80, 0.55, 12
WEIGHTS = {"amount": 0.50, "date": 0.25, "text": 0.15, "history": 0.10}
# Fixed values of the gate: days, share of the amount, likeness.
GATE_DAYS, GATE_SHARE, GATE_TEXT = 5, 0.05, 0.40


def amount_score(amount: Column, due: Column, liability: Column) -> Column:
    """1 up to half a percent off, down to 0 at 15 %; a liability may have either sign."""
    a, d = amount.cast("double"), due.cast("double")
    direct = F.abs(a - d) / F.abs(d)
    off = F.when(liability, F.least(direct, F.abs(a + d) / F.abs(d))).otherwise(direct)
    return F.when(d == 0, F.when(F.abs(a) < 0.01, 1.0).otherwise(0.0)).when(off <= 0.005, 1.0).when(off >= 0.15, 0.0).otherwise(1.0 - (off - 0.005) / 0.145)


def date_score(gap: Column) -> Column:
    return F.when(gap <= 1, 1.0).when(gap >= WINDOW, 0.0).otherwise(1.0 - (gap - 1) / (WINDOW - 1.0))


def near_dues(txns: DataFrame, schedules: DataFrame, days: int) -> DataFrame:
    """Rows beside the schedules of their account that fall due within so many days; blocks make the band an equi-join."""
    block = lambda c: F.floor(F.unix_date(c) / (days + 1))
    rows = txns.select("txn_id", "account_id", "ts", F.to_date("ts").alias("day"), "amount", "description", "is_asset").withColumn("block", block("day"))
    dues = schedules.select("payment_id", "account_id", "next_due", F.col("amount").alias("due"), F.col("description").alias("due_text"), *[c for c in ("last_text", "variable") if c in schedules.columns])
    dues = dues.withColumn("block", F.explode(F.sequence(block("next_due") - 1, block("next_due") + 1)))
    return rows.join(dues, ["account_id", "block"]).drop("block").withColumn("gap", F.abs(F.datediff("day", "next_due"))).filter(F.col("gap") <= days)


def match_scores(txns: DataFrame, schedules: DataFrame, similarity=text_similarity) -> DataFrame:
    """(txn_id, payment_id, amount_score, date_score, text_score, history, score, decision) of all pairs that reach PROPOSES.

    ``last_text`` of a schedule is the text of the row that settled it last.
    Texts are compared only where the rest can still reach the threshold.
    """
    found = near_dues(txns, schedules, WINDOW).withColumn("amount_score", amount_score(F.col("amount"), F.col("due"), ~F.col("is_asset"))).withColumn("date_score", date_score(F.col("gap")))
    w = WEIGHTS
    found = found.filter(F.round(w["amount"] * F.col("amount_score") + w["date"] * F.col("date_score") + w["text"] + w["history"], 6) >= PROPOSES)
    history = F.coalesce(grouping_key(F.col("last_text")) == grouping_key(F.col("description")), F.lit(False)).cast("int").cast("double") if "last_text" in found.columns else F.lit(0.0)
    found = found.withColumn("text_score", similarity(F.col("description"), F.col("due_text"))).withColumn("history", history)
    total = F.round(sum(w[c] * F.col(f"{c}_score") for c in ("amount", "date", "text")) + w["history"] * F.col("history"), 6)
    found = found.withColumn("score", total).filter(F.col("score") >= PROPOSES)
    return found.select("txn_id", "payment_id", "amount_score", "date_score", "text_score", "history", "score", F.when(F.col("score") >= SETTLES, "settles").otherwise("proposed").alias("decision"))


def _row_by_row(auto: float):
    """Rows sorted by account, row and falling score: each row takes its best schedule that no earlier row of the account took.

    A choice below ``auto`` is only proposed and leaves its schedule free.  A
    task holds the taken schedules of one account, not its rows.
    """

    def run(batches):
        account, taken, row = None, set(), None
        for batch in batches:
            keep, free = [], []
            for i, (of, txn, payment, score) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("account_id", "txn_id", "payment_id", "score")), strict=True)):
                if of != account:
                    account, taken, row = of, set(), None
                if txn == row or payment in taken:
                    continue
                row = txn
                keep.append(i)
                free.append("settles" if score >= auto else "proposed")
                if score >= auto:
                    taken.add(payment)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(keep, pa.int64())).columns, pa.array(free, pa.string())], [*batch.schema.names, "decision"])

    return run


def in_date_order(found: DataFrame, auto: float) -> DataFrame:
    """``found`` (txn_id, account_id, ts, payment_id, score, ...) cut to each row's choice, with its ``decision``; ties go to the smaller payment_id."""
    order = ["account_id", "ts", "txn_id", F.desc("score"), "payment_id"]
    kind = StructType([*found.schema.fields, StructField("decision", StringType())])
    return found.repartition("account_id").sortWithinPartitions(*order).mapInArrow(_row_by_row(auto), kind)


def gated_matches(txns: DataFrame, schedules: DataFrame, similarity=text_similarity) -> DataFrame:
    """(txn_id, payment_id, gap, score): rows of a batch within the gates of days, amount and wording of a schedule.

    The score is the likeness less a sixth for each day; ``variable`` schedules
    (a column of ``schedules``, if it is there) have the gate's likeness at
    least.  Rows choose in the order of their time; a schedule is settled once.
    """
    d = F.abs(F.col("due").cast("double"))
    off = lambda x: F.abs(x.cast("double")) / d
    fits = (off(F.col("amount") - F.col("due")) <= GATE_SHARE) | (~F.col("is_asset") & (off(F.col("amount") + F.col("due")) <= GATE_SHARE))
    fits = F.when(F.col("due") == 0, F.abs("amount") <= GATE_SHARE).otherwise(fits)
    found = near_dues(txns, schedules, GATE_DAYS).filter(fits)
    like = similarity(F.col("description"), F.col("due_text"))
    if "variable" in schedules.columns:
        like = F.when(F.col("variable"), F.greatest(like, F.lit(GATE_TEXT))).otherwise(like)
    found = found.withColumn("like", like).filter(F.col("like") >= GATE_TEXT).withColumn("score", F.col("like") * (1.0 - F.col("gap") / (GATE_DAYS + 1.0)))
    return in_date_order(found.select("txn_id", "account_id", "ts", "payment_id", "gap", "score"), 0.0).select("txn_id", "payment_id", "gap", "score")


def settle_backlog(txns: DataFrame, schedules: DataFrame, since: str, passes: int = 24, similarity=text_similarity) -> DataFrame:
    """(pass, txn_id, payment_id, due, score, decision): rows since a day against schedules that fall behind.

    In each pass a schedule is due once: rows choose in the order of their time
    among the schedules within the window of days, a choice that reaches
    SETTLES settles the schedule, whose next date follows from the row's; one
    that reaches PROPOSES is proposed (once for a row and schedule).  Passes
    are repeated until none settles.  A row settles one schedule at most, and
    none that was settled on its day or later.  Schedules have payment_id,
    account_id, description, amount, frequency, next_due, and if they are
    there day_of_month, last_matched (a row) and last_matched_on.  Schedules
    without a date or amount take no part.

    Pairs whose amounts are too far apart for any score are never made; those
    left are written once, with their likeness, and each pass joins them with
    the schedules' dates.
    """
    spark = txns.sparkSession
    has = lambda c, kind: F.col(c) if c in schedules.columns else F.lit(None).cast(kind)
    dues = schedules.filter("next_due is not null and amount is not null").withColumns({"day_of_month": has("day_of_month", "int"), "last_matched": has("last_matched", "long"), "last_matched_on": has("last_matched_on", "date")})
    texts = txns.select(F.col("txn_id").alias("last_matched"), grouping_key(F.col("description")).alias("last_key"))
    state = dues.join(texts, "last_matched", "left").select("payment_id", "frequency", "day_of_month", "next_due", "last_matched", "last_matched_on", "last_key")
    # Amounts within 15 % of each other lie in equal or neighbouring blocks of their logarithms.
    block = lambda c: F.floor(F.log(F.greatest(F.abs(c.cast("double")), F.lit(0.01))) / 0.17)
    rows = txns.filter((F.to_date("ts") >= F.lit(since).cast("date")) & F.col("amount").isNotNull()).withColumn("block", block(F.col("amount")))
    owed = dues.select("payment_id", "account_id", F.col("amount").alias("due"), F.col("description").alias("due_text"), F.explode(F.sequence(block(F.col("amount")) - 1, block(F.col("amount")) + 1)).alias("block"))
    pairs = rows.join(owed, ["account_id", "block"]).withColumn("amount_score", amount_score(F.col("amount"), F.col("due"), ~F.col("is_asset")))
    rest = 1.0 - WEIGHTS["amount"]
    pairs = pairs.filter(F.round(WEIGHTS["amount"] * F.col("amount_score") + rest, 6) >= PROPOSES)
    pairs = stored(pairs.select("txn_id", "account_id", "ts", "payment_id", "amount_score", similarity(F.col("description"), F.col("due_text")).alias("text_score"), grouping_key(F.col("description")).alias("key")))
    done = state.filter("last_matched is not null").select(F.col("last_matched").alias("txn_id"))
    out = None
    for n in range(1, passes + 1):
        state = stored(state)
        open_rows = pairs.join(done, "txn_id", "left_anti").join(state.drop("frequency", "day_of_month", "last_matched"), "payment_id")
        day = F.to_date("ts")
        gap = F.abs(F.datediff(day, "next_due"))
        open_rows = open_rows.filter((gap < WINDOW) & (F.col("last_matched_on").isNull() | (day > F.col("last_matched_on"))))
        history = F.coalesce((F.col("last_key") == F.col("key")), F.lit(False)).cast("int")
        score = F.round(WEIGHTS["amount"] * F.col("amount_score") + WEIGHTS["date"] * date_score(gap) + WEIGHTS["text"] * F.col("text_score") + WEIGHTS["history"] * history, 6)
        found = open_rows.withColumn("score", score).filter(F.col("score") >= PROPOSES)
        made = stored(in_date_order(found.select("txn_id", "account_id", "ts", "payment_id", "key", F.col("next_due").alias("due"), "score"), SETTLES)).withColumn("pass", F.lit(n))
        out = made if out is None else out.unionByName(made)
        settled = made.filter("decision = 'settles'")
        if not settled.take(1):
            break
        done = out.filter("decision = 'settles'").select("txn_id").unionAll(dues.filter("last_matched is not null").select("last_matched"))
        new = settled.select("payment_id", F.col("txn_id").alias("new_row"), F.to_date("ts").alias("on"), F.col("key").alias("new_key"))
        moved = state.join(new, "payment_id", "left")
        months = step_date(F.col("on"), F.col("frequency"), F.lit(1))
        # The schedule's own day of the month, clamped to the month's end.
        months = F.when(F.col("frequency").isin(*MONTH_STEPS) & F.col("day_of_month").isNotNull(), F.least(F.date_add(F.trunc(months, "month"), F.col("day_of_month") - 1), F.last_day(months))).otherwise(months)
        state = moved.filter("new_row is null or frequency <> 'once'").select(
            "payment_id", "frequency", "day_of_month", F.when(F.col("new_row").isNull(), F.col("next_due")).otherwise(months).alias("next_due"),
            F.coalesce("new_row", "last_matched").alias("last_matched"), F.coalesce("on", "last_matched_on").alias("last_matched_on"), F.coalesce("new_key", "last_key").alias("last_key"),
        )
    settled = out.filter("decision = 'settles'")
    # A proposal is kept from the first pass that made it.
    first = out.filter("decision = 'proposed'").groupBy("txn_id", "payment_id").agg(F.min_by(F.struct("pass", "due", "score", "decision"), "pass").alias("p")).select("p.pass", "txn_id", "payment_id", "p.due", "p.score", "p.decision")
    return settled.select("pass", "txn_id", "payment_id", "due", "score", "decision").unionByName(first)


def _interest_on(balance: Column, rate: Column) -> Column:
    """A month's interest in cents, rounded half away from zero, with the sign of the balance."""
    return (F.round(F.abs(balance).cast("decimal(24,2)") * rate.cast("decimal(12,10)"), 2) * F.signum(balance.cast("double")).cast("int")).cast("decimal(38,2)")


def accrue_interest(txns: DataFrame, rates: DataFrame, through: str, posted: DataFrame) -> DataFrame:
    """(account_id, month, interest): monthly interest on the balance at each month's end, earlier interest included.

    ``rates`` has account_id and monthly_rate.  Interest is rounded half up to
    cents, away from zero, has the sign of the balance, and is not posted for
    the months of ``posted`` (account_id, month), nor where it is zero.  The
    months of an account, not its rows, are folded in one row.
    """
    month = F.date_trunc("month", "ts").cast("date")
    sums = txns.join(rates.filter("monthly_rate > 0"), "account_id").groupBy("account_id", "monthly_rate", month.alias("month")).agg(F.sum("amount").cast("decimal(38,2)").alias("moved"))
    sums = sums.filter(F.last_day("month") <= F.lit(through).cast("date"))
    spans = sums.groupBy("account_id", "monthly_rate").agg(F.min("month").alias("first"))
    last = F.when(F.last_day(F.lit(through).cast("date")) == F.lit(through).cast("date"), F.lit(through).cast("date")).otherwise(F.add_months(F.lit(through).cast("date"), -1))
    grid = spans.filter(F.col("first") <= last).select("account_id", "monthly_rate", F.explode(F.sequence("first", F.trunc(last, "month"), F.expr("interval 1 month"))).alias("month"))
    grid = grid.join(sums.select("account_id", "month", "moved"), ["account_id", "month"], "left").join(posted.select("account_id", "month", F.lit(True).alias("done")).distinct(), ["account_id", "month"], "left")
    folded = grid.groupBy("account_id", "monthly_rate").agg(F.array_sort(F.collect_list(F.struct("month", F.coalesce("moved", F.lit(0)).cast("decimal(38,2)").alias("moved"), F.coalesce("done", F.lit(False)).alias("done")))).alias("months"))
    money = "decimal(38,2)"
    start = F.struct(F.lit(0).cast(money).alias("balance"), F.array().cast(f"array<struct<month:date,interest:{money}>>").alias("out"))

    def step(acc, m):
        balance = (acc["balance"] + m["moved"]).cast(money)
        interest = F.when(m["done"], F.lit(0).cast(money)).otherwise(_interest_on(balance, F.col("monthly_rate")))
        return F.struct((balance + interest).cast(money).alias("balance"), F.concat(acc["out"], F.array(F.struct(m["month"].alias("month"), interest.alias("interest")))).alias("out"))

    rows = folded.select("account_id", F.explode(F.aggregate("months", start, step)["out"]).alias("r"))
    return rows.select("account_id", "r.month", "r.interest").filter("interest <> 0")


def resync_interest(txns: DataFrame, accounts: DataFrame, through: str) -> DataFrame:
    """(account_id, from_month, action, txn_id, day, amount): what makes posted interest agree with the rows it was charged on.

    ``txns`` has is_interest, ``accounts`` monthly_rate and balance_truth_source.
    Only accounts whose ledger is their balance and that accrue already are
    looked at.  A month is wrong if it has two postings or more, or if its
    posting isn't the interest on the balance at its end without it; from the
    first wrong month on all postings go (``remove``) and the run is posted
    again (``post``).  Later months rest on earlier postings as they stand, so
    the first wrong month follows from running sums; only the new run is folded.
    """
    month, money = F.trunc(F.to_date("ts"), "month"), "decimal(38,2)"
    own = accounts.filter("monthly_rate > 0 and balance_truth_source in ('transaction_sum', 'hybrid')").select("account_id", "monthly_rate")
    rows = txns.join(own, "account_id").withColumn("month", month)
    sums = rows.groupBy("account_id", "monthly_rate", "month").agg(
        F.coalesce(F.sum(F.when(~F.col("is_interest"), F.col("amount"))), F.lit(0)).cast(money).alias("moved"), F.coalesce(F.sum(F.when(F.col("is_interest"), F.col("amount"))), F.lit(0)).cast(money).alias("posted"), F.count_if("is_interest").alias("n")
    )
    end = F.lit(through).cast("date")
    last = F.when(F.last_day(end) == end, F.trunc(end, "month")).otherwise(F.add_months(F.trunc(end, "month"), -1))
    spans = sums.groupBy("account_id", "monthly_rate").agg(F.min("month").alias("first"), F.sum("n").alias("all")).filter((F.col("all") > 0) & (F.col("first") <= last))
    grid = spans.select("account_id", "monthly_rate", F.explode(F.sequence("first", last, F.expr("interval 1 month"))).alias("month")).join(sums.drop("monthly_rate"), ["account_id", "month"], "left").fillna(0, ["n"])
    run = Window.partitionBy("account_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(run), F.lit(0)).cast(money)
    balance = (total("moved") + total("posted") - F.coalesce("posted", F.lit(0))).cast(money)
    grid = grid.withColumn("expected", _interest_on(balance, F.col("monthly_rate")))
    wrong = grid.filter((F.col("n") > 1) | (F.coalesce("posted", F.lit(0)).cast(money) != F.col("expected"))).groupBy("account_id").agg(F.min("month").alias("from_month"))
    wrong = stored(wrong)
    touched = txns.join(wrong, "account_id").withColumn("month", month)
    gone = F.col("is_interest") & (F.col("month") >= F.col("from_month"))
    removed = touched.filter(gone).select("account_id", "from_month", F.lit("remove").alias("action"), "txn_id", F.to_date("ts").alias("day"), F.col("amount").cast(money).alias("amount"))
    left = touched.filter(~gone)
    posted = left.filter("is_interest").select("account_id", "month")
    again = accrue_interest(left, own, through, posted).join(wrong, "account_id").filter("month >= from_month")
    return removed.unionAll(again.select("account_id", "from_month", F.lit("post"), F.lit(None).cast("long"), F.last_day("month"), "interest"))


def trailing_average(payments: DataFrame, txns: DataFrame, as_of: str, months: int = 6, similarity=text_similarity, least: float = 0.6) -> DataFrame:
    """(payment_id, n, amount): the mean of an account's rows of a payment's sign that look like it, over the last months; its own amount if fewer than two do.

    A row looks like a payment if their keys are equal or their texts are
    alike.  Rows meet as sums of equal texts, so repeated texts are compared
    once; texts whose lengths alone keep them below ``least`` are not compared.
    """
    day = F.lit(as_of).cast("date")
    rows = txns.filter((F.to_date("ts") >= F.date_sub(day, int(months * 30.5))) & ~F.col("is_transfer") & (F.col("amount") != 0))
    rows = rows.withColumn("up", F.col("amount") > 0).withColumn("text", F.lower(F.coalesce("description", F.lit(""))))
    sums = rows.groupBy("account_id", "up", "text").agg(F.sum("amount").alias("total"), F.count("*").alias("c"))
    owed = payments.select("payment_id", "account_id", F.col("amount").alias("due"), (F.coalesce("amount", F.lit(0)) >= 0).alias("up"), F.lower(F.coalesce("description", F.lit(""))).alias("due_text"))
    pairs = owed.join(sums, ["account_id", "up"])
    same = grouping_key(F.col("text")) == grouping_key(F.col("due_text"))
    # No ratio of two texts exceeds twice the shorter length over both lengths.
    bound = lambda a, b: F.coalesce(F.try_divide(2.0 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)), F.lit(1.0))
    close = F.greatest(bound(F.col("text"), F.col("due_text")), bound(comparison_key(F.col("text")), comparison_key(F.col("due_text"))))
    pairs = pairs.filter(same | (close >= least))
    alike = pairs.withColumn("same", same).withColumn("like", F.when(F.col("same"), 1.0).otherwise(similarity(F.col("text"), F.col("due_text")))).filter(F.col("like") >= least)
    means = alike.groupBy("payment_id").agg(F.sum("c").alias("n"), F.sum("total").alias("total"))
    out = payments.select("payment_id", "amount").join(means, "payment_id", "left")
    mean = F.round(F.col("total").cast("double") / F.col("n"), 2).cast("decimal(38,2)")
    return out.select("payment_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.when(F.col("n") >= 2, mean).otherwise(F.col("amount").cast("decimal(38,2)")).alias("amount"))
