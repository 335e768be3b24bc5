"""Statement files: read as text, find what each column means, turn cells into ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talliver.operators.ledger_jobs import parse_amount

# The column names of each role, and the parts of a name that hint at one.
ROLE_NAMES = {
    "date": ("date", "transaction date", "posted", "posting date", "trans date", "trade date", "settlement date"),
    "description": ("description", "memo", "narrative", "details", "payee", "transaction description", "name", "reference"),
    "amount": ("amount", "value", "sum", "transaction amount", "debit/credit", "net amount"),
    "balance": ("balance", "running balance", "balance after", "available"),
    "currency": ("currency", "ccy", "cur", "currency code"),
    "debit": ("debit", "withdrawal", "debit amount", "withdrawals", "dr"),
    "credit": ("credit", "deposit", "credit amount", "deposits", "cr"),
}
ROLE_PARTS = {"date": ("date",), "description": ("desc", "memo", "narr"), "amount": ("amount", "amt")}
# Date formats that are tried in order; the first pair of each list depends on the order of day and month.
DAY_FIRST = ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd MMM yyyy", "dd.MM.yyyy")
MONTH_FIRST = ("MM/dd/yyyy", "MM-dd-yyyy", "yyyy-MM-dd", "MMM dd, yyyy", "MM.dd.yyyy")


def read_ledger_files(spark: SparkSession, path: str) -> DataFrame:
    """CSV exports with all cells as text, and the file each row came from."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).withColumn("file", F.col("_metadata.file_path"))


def detect_columns(names: DataFrame) -> DataFrame:
    """(file, role, name) from (file, position, name): a known name first, then a part of one, the leftmost of equals."""
    low = F.lower(F.trim("name"))
    fits = [F.when(low.isin(*words), F.struct(F.lit(role).alias("role"), F.lit(0).alias("rank"))) for role, words in ROLE_NAMES.items()]
    for role, parts in ROLE_PARTS.items():
        fits.append(F.when(low.rlike("|".join(parts)), F.struct(F.lit(role).alias("role"), F.lit(1).alias("rank"))))
    found = names.select("file", "position", "name", F.explode(F.array_compact(F.array(*fits))).alias("f"))
    return found.groupBy("file", F.col("f.role").alias("role")).agg(F.min_by("name", F.struct("f.rank", "position")).alias("name"))


def parse_date(text: Column, day_first: bool = True) -> Column:
    """Day of a cell by the first format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in (DAY_FIRST if day_first else MONTH_FIRST)])


def normalise_rows(rows: DataFrame, roles: dict[str, str], day_first: bool = True) -> DataFrame:
    """The rows with day, amount and text parsed by ``roles`` (role to column); rows that lack one of them go.

    Without an amount column the amount is credit less debit, each by its size.
    """
    if "amount" in roles:
        amount = parse_amount(F.col(roles["amount"]))
    else:
        size = lambda role: F.abs(parse_amount(F.col(roles[role])))
        amount = F.when(F.coalesce(size("debit"), F.lit(0)) != 0, -size("debit")).otherwise(size("credit"))
    text = F.trim(roles["description"])
    out = rows.withColumns({"day": parse_date(F.col(roles["date"]), day_first), "parsed": amount, "text": text})
    return out.filter("day is not null and parsed is not null and text <> ''")
