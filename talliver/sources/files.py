"""Statement files as lines: header rows, order of day and month, the account a file belongs to, sectioned and grant reports.

Lines keep the place they have in their file (block of the file, then order in
the block), so large files are read in blocks.  What a line inherits from the
lines above it is carried first inside its block, then from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talliver.sources.statements import ROLE_NAMES

# Cells of a header row, parts of such cells, and lines in which one is looked for.
HEADER_CELLS = tuple(sorted({w for role in ("date", "description", "amount", "balance", "currency") for w in ROLE_NAMES[role]} | {"debit", "credit", "type", "category", "status", "check number"}))
HEADER_PARTS = ("date", "desc", "amount", "balance", "narr", "memo")
HEADER_LINES = 30
# Shares and margins of the order of day and month.
NAMED, ORDERED = 0.8, 0.15
# What a long token adds, the score that is accepted, and the share of it that a runner-up must stay below.
LONG_TOKEN, VERBATIM, ACCEPTED, RUNNER_UP = 5, 0.2, 0.4, 0.85


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, line): the lines of text files; block and seq order the lines of a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    return rows.withColumn("seq", F.monotonically_increasing_id()).withColumn("line", F.regexp_replace("line", "^﻿|\r$", ""))


def carried(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows with the last value of each column at or above them in their file, where the own is null."""
    inside = Window.partitionBy("file", "block").orderBy("seq")
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    ends = rows.groupBy("file", "block").agg(*[F.max_by(c, "seq").alias(f"_{c}") for c in columns])
    above = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("file").alias("_file"), F.col("block").alias("_block"), *[F.last(f"_{c}", ignorenulls=True).over(above).alias(f"_{c}") for c in columns])
    out = rows.join(ends, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_file", "_block", *[f"_{c}" for c in columns])


def csv_cells(line: Column) -> Column:
    """Trimmed cells of a CSV line; quoted cells may hold commas and doubled quotes."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(?:\s*"((?:[^"]|"")*)"\s*(?=,|$)|([^,]*))'), 0)
    return F.transform(cells, lambda c: F.trim(F.replace(F.regexp_replace(F.trim(F.substring(c, 2, 1 << 30)), '^"(.*)"$', "$1"), F.lit('""'), F.lit('"'))))


# ---- I2


def find_header_rows(lines: DataFrame, line_no: str = "line_no") -> DataFrame:
    """(file, header): number of the first of the first HEADER_LINES lines (from 0) that looks like a header; null if none does.

    It does with two cells that are known, or, if fewer are, with two known or
    partly known ones.
    """
    first = lines.filter(F.col(line_no) < HEADER_LINES)
    cells = F.filter(F.transform(F.split(F.lower("line"), ","), lambda c: F.trim(F.regexp_replace(F.trim(c), '^"+|"+$', ""))), lambda c: c != "")
    rows = first.select("file", F.col(line_no).alias("n"), cells.alias("cells"))
    known = F.size(F.filter("cells", lambda c: c.isin(*HEADER_CELLS)))
    partly = F.size(F.filter("cells", lambda c: c.rlike("|".join(HEADER_PARTS)) & ~c.isin(*HEADER_CELLS)))
    fits = (F.size("cells") >= 2) & ((known >= 2) | (known + partly >= 2))
    return rows.groupBy("file").agg(F.min(F.when(fits, F.col("n"))).alias("header"))


def numbered(lines: DataFrame) -> DataFrame:
    """The first lines of each file with their number (from 0): what a header is looked for in."""
    w = Window.partitionBy("file").orderBy("block", "seq")
    return lines.withColumn("line_no", F.row_number().over(w) - 1).filter(F.col("line_no") < HEADER_LINES)


# ---- I4


def detect_date_order(values: DataFrame, default_day_first: bool = True) -> DataFrame:
    """(file, day_first, confidence, evidence) from (file, row, value): every value of a file is looked at.

    Named months or years first in over 80 %: not day first, high.  A part
    above 12 in one place only names the day, high; in both, the more frequent
    place, medium.  Else the reading under which more neighbours are in order,
    if they differ by over 0.15, medium; else the place with more distinct
    numbers, low; else the default, low.  Files without a value take the
    default, too; a null or blank value doesn't count.
    """
    rows = values.withColumn("value", F.trim("value"))
    part = lambda i: F.regexp_extract("value", r"^(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{2,4})", i)
    parts = rows.filter("value <> ''").select("file", "row", "value", *[F.when(part(1) != "", part(i).cast("int")).alias(c) for i, c in ((1, "a"), (2, "b"), (3, "c"))])
    parts = parts.withColumns({x: F.when(F.col("a") <= 31, F.col(x)) for x in ("b", "c", "a")})
    # Neighbours are the numeric values of a file, in order of their rows.
    numeric = parts.filter("a is not null")
    w = Window.partitionBy("file").orderBy("row")
    readings = {"dmy": F.struct("c", "b", "a"), "mdy": F.struct("c", "a", "b")}
    ordered = numeric.select("file", "a", "b", *[(x >= F.lag(x).over(w)).alias(k) for k, x in readings.items()])
    by_file = ordered.groupBy("file").agg(
        F.count_if(F.col("a") > 12).alias("a12"), F.count_if(F.col("b") > 12).alias("b12"), F.count_if("dmy").alias("dmy"), F.count_if("mdy").alias("mdy"), F.greatest(F.count("*") - 1, F.lit(1)).alias("pairs"),
        F.count_distinct("a").alias("ua"), F.count_distinct("b").alias("ub"),
    )
    shapes = parts.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("value").rlike("[A-Za-z]{3,}")).alias("named"), F.count_if(F.col("value").rlike(r"^\d{4}[/\-]")).alias("iso"))
    files = values.select("file").distinct().join(shapes, "file", "left").join(by_file, "file", "left")
    apart = (F.col("dmy") - F.col("mdy")) / F.col("pairs")
    cases = [
        ("no value", F.col("n").isNull(), F.lit(default_day_first), "low"),
        ("named month", F.col("named") > NAMED * F.col("n"), F.lit(False), "high"),
        ("year first", F.col("iso") > NAMED * F.col("n"), F.lit(False), "high"),
        ("no numeric value", F.col("a12").isNull(), F.lit(default_day_first), "low"),
        ("part above 12", (F.col("a12") > 0) != (F.col("b12") > 0), F.col("a12") > 0, "high"),
        ("parts above 12", (F.col("a12") > 0) & (F.col("b12") > 0), F.col("a12") >= F.col("b12"), "medium"),
        ("order", F.abs(apart) > ORDERED, apart > 0, "medium"),
        ("distinct numbers", F.col("ua") != F.col("ub"), F.col("ua") > F.col("ub"), "low"),
    ]
    found = F.struct(F.lit(default_day_first).alias("day_first"), F.lit("low").alias("confidence"), F.lit("default").alias("evidence"))
    for name, holds, day_first, confidence in reversed(cases):
        found = F.when(holds, F.struct(day_first.alias("day_first"), F.lit(confidence).alias("confidence"), F.lit(name).alias("evidence"))).otherwise(found)
    return files.select("file", found.alias("f")).select("file", "f.*")


# ---- I7


def tokens(text: Column) -> Column:
    """Distinct tokens of three or more ASCII letters and digits, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))


def route_files(files: DataFrame, accounts: DataFrame) -> DataFrame:
    """(file, account_id, score, verdict) for each of ``files`` (file, user_id, text) against its user's ``accounts`` (account_id, user_id, name, institution).

    An account scores the greatest share of a phrase's (name's, institution's)
    tokens that the file holds, 0.2 more if a token of five or more letters
    stands in the text, 1 at most.  The best account is taken at 0.4 or more,
    unless another reaches 85 % of it: ``ambiguous``.  ``none``: below that.
    Ties go to the smaller account_id.  The text holds the file's name.

    Equal phrases of a user are one, with the two accounts that can matter; so
    are texts with equal tokens.  Words meet tokens by equality, or, to be
    found inside them, by the token's first five letters, once for a user's
    distinct words; no phrase is compared with a text that has neither.
    """
    phrases = accounts.select("user_id", "account_id", F.explode(F.array("name", "institution")).alias("words")).withColumn("own", F.array_sort(tokens(F.col("words")))).filter(F.size("own") > 0)
    # The best account of a phrase is its smallest; whichever account is taken, one of the two is another, if there is any.
    phrases = phrases.groupBy("user_id", "own").agg(F.min("account_id").alias("low"), F.max("account_id").alias("high"))
    parts = phrases.withColumn("token", F.explode("own"))
    named = files.select("file", "user_id", F.array_join(F.array_sort(tokens(F.col("text"))), " ").alias("held"))
    texts = named.select("user_id", "held").distinct().withColumn("word", F.explode(F.split("held", " ")))
    known = parts.select("user_id", "token").distinct()
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("word") - LONG_TOKEN + 1), lambda i: F.substring("word", i, F.lit(LONG_TOKEN))))
    starts = texts.filter(F.length("word") >= LONG_TOKEN).select("user_id", "word").distinct().withColumn("gram", F.explode(grams))
    long = known.filter(F.length("token") >= LONG_TOKEN).withColumn("gram", F.substring("token", 1, LONG_TOKEN))
    verbatim = starts.join(long, ["user_id", "gram"]).filter(F.contains("word", "token")).select("user_id", "word", "token", (F.col("word") == F.col("token")).cast("long").alias("c"), F.lit(1).alias("inside"))
    short = known.filter(F.length("token") < LONG_TOKEN).select("user_id", F.col("token").alias("word"), "token", F.lit(1).cast("long").alias("c"), F.lit(0).alias("inside"))
    hits = texts.join(verbatim.unionByName(short), ["user_id", "word"]).join(parts, ["user_id", "token"])
    share = hits.groupBy("user_id", "held", "own", "low", "high").agg((F.sum("c") / F.size("own") + VERBATIM * F.max("inside")).alias("s"))
    scores = share.select("user_id", "held", F.explode(F.array_distinct(F.array("low", "high"))).alias("account_id"), F.least(F.lit(1.0), F.round("s", 9)).alias("score"))
    # The best two accounts of a text, then of a file, which may have several rows.
    top = _best_two(scores, "user_id", "held").groupBy("user_id", "held").agg(F.collect_list(F.struct("account_id", "score")).alias("top"))
    best = _best_two(named.join(top, ["user_id", "held"]).select("file", F.inline("top")), "file")
    best = best.groupBy("file").agg(*[F.max(F.when(F.col("n") == n, F.col(c))).alias(name) for n, c, name in ((1, "account_id", "account_id"), (1, "score", "score"), (2, "score", "second"))])
    out = files.select("file").join(best, "file", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    verdict = F.when(F.col("score") < ACCEPTED, "none").when(F.coalesce(F.col("second") >= RUNNER_UP * F.col("score"), F.lit(False)), "ambiguous").otherwise("routed")
    return out.withColumn("verdict", verdict).select("file", F.when(F.col("verdict") == "routed", F.col("account_id")).alias("account_id"), "score", "verdict")


def _best_two(scores: DataFrame, *keys: str) -> DataFrame:
    """The two accounts of each key with the highest scores, numbered in ``n``; ties go to the smaller account_id."""
    own = scores.groupBy(*keys, "account_id").agg(F.max("score").alias("score"))
    return own.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "account_id"))).filter("n <= 2")


# ---- I8, I9


def number(text: Column) -> Column:
    """A cell's number without thousands' commas, currency signs and blanks; parentheses turn the sign, dashes and other text are null."""
    bare = F.regexp_replace(text, r"[,$\s]", "")
    value = F.regexp_replace(bare, r"^\((.*)\)$", "-$1")
    return F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.cast("double"))


def section_rows(lines: DataFrame) -> DataFrame:
    """(file, block, seq, section, kind, cells, header): rows of a sectioned report; Data rows carry the last Header row of their section above."""
    cells = csv_cells(F.col("line"))
    rows = lines.filter(F.trim("line") != "").withColumn("cells", cells).filter(F.size("cells") >= 3)
    rows = rows.select("file", "block", "seq", F.col("cells")[0].alias("section"), F.col("cells")[1].alias("kind"), F.slice("cells", 3, 1 << 30).alias("cells")).filter("section <> ''")
    # Sections may be interleaved, so each of a file's sections carries its own header.
    keyed = rows.withColumn("of", F.col("file")).withColumn("file", F.concat_ws("\u001f", "file", "section"))
    keyed = keyed.withColumn("header", F.when(F.col("kind") == "Header", F.col("cells")))
    return carried(keyed, "header").withColumn("file", F.col("of")).drop("of")


def read_sectioned_report(lines: DataFrame) -> dict[str, DataFrame]:
    """Typed tables of sectioned brokerage files: info, nav, instruments, positions, prior_positions, trades, dividends, quarantine.

    Rows that belong to a table but can't be read (a trade or dividend whose
    date doesn't parse, a Data row without a header above) are in quarantine,
    with the reason.
    """
    rows = section_rows(lines)
    data = rows.filter("kind = 'Data'")
    placed = data.filter("header is not null")
    cell = lambda name: F.nullif(F.get("cells", F.array_position("header", name).cast("int") - 1), F.lit(""))
    named = lambda section: placed.filter(F.col("section") == section)
    day = lambda text, *formats: F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    currency = F.coalesce(cell("Currency"), F.lit("USD")).alias("currency")
    symbol = cell("Symbol").alias("symbol")
    numbers = lambda *pairs: [F.coalesce(number(cell(c)), F.lit(0.0)).alias(a) for a, c in pairs]
    facts = rows.filter("section in ('Statement', 'Account Information') and size(cells) >= 2").select("file", "section", F.col("cells")[0].alias("key"), F.col("cells")[1].alias("value"), "block", "seq")
    # The later section decides, as it does for a file read from top to bottom.
    latest = lambda *keys: F.max_by(F.when(F.col("key").isin(*keys), F.col("value")), F.when(F.col("key").isin(*keys), F.struct((F.col("section") == "Account Information"), "block", "seq")))
    period = F.split(latest("Period"), " - ")
    when = lambda t: F.coalesce(F.try_to_timestamp(F.trim(t), F.lit("MMMM d, yyyy")), F.try_to_timestamp(F.trim(t), F.lit("yyyy-MM-dd"))).cast("date")
    info = facts.groupBy("file").agg(
        F.coalesce(latest("Base Currency", "Base Cur."), F.lit("USD")).alias("base_currency"), latest("Account").alias("account"), when(F.element_at(period, 1)).alias("period_start"), when(F.element_at(period, -1)).alias("period_end")
    )
    nav = named("Net Asset Value").filter(F.lower(cell("Asset Class")) == "total").groupBy("file").agg(F.min_by(F.coalesce(number(cell("Current Total")), F.lit(0.0)), F.struct("block", "seq")).alias("nav_total"))
    stock = F.coalesce(cell("Asset Category"), F.lit("")).rlike("Stocks|Equity")
    orders = named("Trades").filter((cell("DataDiscriminator") == "Order") & stock & cell("Symbol").isNotNull()).withColumn("at", day(F.replace(cell("Date/Time"), F.lit('"'), F.lit("")), "yyyy-MM-dd, HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"))
    text = F.coalesce(cell("Description"), F.lit(""))
    paid = named("Dividends").filter((text != "") & ~F.lower(text).startswith("total")).withColumn("of", F.regexp_extract(text, r"^([A-Z0-9.]+)\(", 1)).filter("of <> ''").withColumn("at", day(cell("Date"), "yyyy-MM-dd", "MM/dd/yyyy"))
    bad = lambda df, reason: df.select("file", "section", "cells", F.lit(reason).alias("reason"))
    return {
        "info": info,
        "nav": nav,
        "instruments": named("Financial Instrument Information").filter(cell("Symbol").isNotNull()).select("file", symbol, cell("Description").alias("name"), cell("Security ID").alias("isin"), cell("Listing Exch").alias("exchange"), currency),
        "positions": named("Open Positions").filter((cell("DataDiscriminator") == "Summary") & cell("Symbol").isNotNull()).select("file", symbol, currency, *numbers(("quantity", "Quantity"), ("cost_price", "Cost Price"), ("cost_basis", "Cost Basis"), ("close_price", "Close Price"), ("value", "Value"), ("unrealized_pnl", "Unrealized P/L"))),
        "prior_positions": named("Mark-to-Market Performance Summary").filter(cell("Symbol").isNotNull()).select("file", symbol, *numbers(("prior_qty", "Prior Quantity"), ("prior_price", "Prior Price"))),
        "trades": orders.filter("at is not null").select("file", symbol, currency, F.col("at").alias("trade_date"), *numbers(("quantity", "Quantity"), ("price", "T. Price"), ("proceeds", "Proceeds"), ("commission", "Comm/Fee"), ("realized_pnl", "Realized P/L"))),
        "dividends": paid.filter("at is not null").select("file", F.col("of").alias("symbol"), currency, F.col("at").cast("date").alias("pay_date"), *numbers(("amount", "Amount")), text.alias("description")),
        "quarantine": bad(orders.filter("at is null"), "trade date").unionAll(bad(paid.filter("at is null"), "dividend date")).unionAll(bad(data.filter("header is null and section not in ('Statement', 'Account Information')"), "no header")),
    }


GRANT_DAY = r"^\d{1,2}/\d{1,2}/\d{4}$"


def grant_day(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date")


def read_grant_report(lines: DataFrame) -> dict[str, DataFrame]:
    """Grants, vests and totals of files in which a grant's row is followed by vest rows with blank leading cells; and the lines in quarantine.

    ``grant_no`` numbers the grants of a file by their place.  A vest row takes
    the grant above it; one without a grant above, or with a date that isn't a
    day, is in quarantine.
    """
    rows = lines.withColumn("cells", csv_cells(F.col("line")))
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    key = F.lower(cell(0))
    grant = cell(0).rlike(GRANT_DAY) & cell(1).contains("/")
    # A grant is known by its place; its vests carry that place.
    rows = rows.withColumn("grant", F.when(grant, F.struct("block", "seq")))
    rows = carried(rows, "grant")
    units = lambda i: F.coalesce(number(cell(i)), F.lit(0.0))
    heads = rows.filter(grant)
    number_of = F.row_number().over(Window.partitionBy("file").orderBy("block", "seq"))
    grants = heads.select("file", "grant", number_of.alias("grant_no"), grant_day(cell(0)).alias("award_date"), F.trim(F.substring_index(cell(1), "/", 1)).alias("award_type"), F.trim(F.regexp_replace(cell(1), "^[^/]*/", "")).alias("award_code"), number(cell(3)).alias("awarded"), number(cell(4)).alias("unvested"), number(cell(6)).alias("vested"))
    below = rows.filter((cell(0) == "") & cell(7).rlike(GRANT_DAY))
    good = below.filter(F.col("grant").isNotNull() & grant_day(cell(7)).isNotNull())
    vests = good.select("file", "grant", grant_day(cell(7)).alias("vest_date"), units(8).alias("units"), number(cell(9)).alias("unvested"), number(cell(11)).alias("vested")).join(grants.select("file", "grant", "grant_no"), ["file", "grant"])
    last = lambda name, value: F.max_by(F.when(key == name, value), F.when((key == name) & value.isNotNull(), F.struct("block", "seq"))).alias
    # Where there is no total, the row below the units' own header has it.
    above = Window.partitionBy("file", "block").orderBy("seq")
    rows = rows.withColumn("under", F.coalesce(F.lag((key == "restricted stock units") & (F.lower(cell(1)) == "awarded units")).over(above), F.lit(False)))
    under = lambda i: F.max(F.when(F.col("under"), number(cell(i))))
    total = lambda i, j: F.when(F.max(key == "total"), F.max_by(F.nullif(number(cell(i)), F.lit(0.0)), F.when((key == "total") & (number(cell(i)) != 0), F.struct("block", "seq")))).otherwise(under(j)).alias
    totals = rows.groupBy("file").agg(
        last("stock symbol", F.nullif(F.upper(cell(1)), F.lit("")))("symbol"), last("stock price", number(cell(1)))("stock_price"), last("stock price as of date", grant_day(cell(1)))("price_date"),
        total(3, 1)("awarded"), total(4, 2)("unvested"), total(6, 4)("vested"),
    )
    quarantine = below.filter(F.col("grant").isNull() | grant_day(cell(7)).isNull()).select("file", "line", F.when(F.col("grant").isNull(), "no grant above").otherwise("vest date").alias("reason"))
    return {"grants": grants.drop("grant"), "vests": vests.drop("grant"), "totals": totals, "quarantine": quarantine}
