"""Incremental import: new files against the ledger, and balances kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from talliver.functions.text import sequence_ratio
from talliver.operators.balances import marker_balance
from talliver.operators.ledger_jobs import dedupe_by_layers, fingerprints

# Fixed schema of the files of a feed.
FEED = T.StructType(
    [
        T.StructField("txn_id", T.LongType()),
        T.StructField("account_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("amount", T.DecimalType(18, 2)),
        T.StructField("description", T.StringType()),
        T.StructField("import_batch_id", T.LongType()),
        T.StructField("raw_data", T.StringType()),
    ]
)

# Fixed schema of rows with the bank's running balance.
BALANCES = T.StructType([f for f in FEED.fields if f.name in ("txn_id", "account_id", "ts", "amount")] + [T.StructField("balance_after", T.DecimalType(18, 2))])


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table, or no rows before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


#: Parts of a batch's folder, so that a batch reads the parts of its own accounts only.
PARTS = 64


def import_batch(batch: DataFrame, batch_id: int, ledger_path: str, deleted: DataFrame, ratio=sequence_ratio) -> None:
    """Append the rows of a batch that no layer of the ledger or of the deleted rows knows (see ``dedupe_by_layers``).

    A batch writes its own folder and replaces it when it is run again, and it
    compares with the folders of the other batches only, so a retry after a
    failure leaves the same ledger.  Of the ledger it reads the parts and days
    of its own accounts and rows; stored hashes are matched as they are.
    """
    spark = batch.sparkSession
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FEED.fields) + ", hash string, batch long, part int"
    # Rows without id are rows of their own.
    rows = batch.filter("txn_id is not null").dropDuplicates(["txn_id"])
    nameless = batch.filter("txn_id is null").withColumn("txn_id", F.expr("-abs(xxhash64(account_id, ts, description, amount, raw_data)) - 1"))
    rows = rows.unionByName(nameless).withColumn("part", F.pmod("account_id", F.lit(PARTS)).cast("int"))
    seen = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.collect_set("part").alias("parts")).first()
    near = (F.col("ts") >= F.date_trunc("day", F.lit(seen["first"]))) & (F.col("ts") < F.date_trunc("day", F.lit(seen["last"])) + F.expr("interval 1 day"))
    ledger = _stored(spark, ledger_path, kind).filter((F.col("batch") != batch_id) & F.col("part").isin(seen["parts"]) & near)
    ledger = ledger.join(rows.select("account_id").distinct(), "account_id", "left_semi")
    fresh = dedupe_by_layers(rows, ledger, deleted, ratio).filter("outcome = 'imported'").select("txn_id")
    out = rows.join(fresh, "txn_id", "left_semi").join(fingerprints(rows).select("txn_id", "hash"), "txn_id")
    out.select(*FEED.names, "hash", "part").write.mode("overwrite").partitionBy("part").parquet(f"{ledger_path}/batch={batch_id}")


def stream_import(spark: SparkSession, source: str, ledger_path: str, checkpoint: str, deleted: DataFrame) -> DataStreamWriter:
    """A writer that imports each new Parquet file of ``source`` once; start it with ``.start()``."""
    rows = spark.readStream.schema(FEED).parquet(source)
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: import_batch(df, i, ledger_path, deleted)).trigger(availableNow=True)


MARKERS = "account_id long, marker decimal(38,2), marker_day date, version long"


def mark_batch(batch: DataFrame, batch_id: int, ledger: DataFrame, running: DataFrame, markers_path: str) -> None:
    """Write the markers (closing balance and what follows it) of the accounts that a batch touches, from all their rows.

    Only touched accounts are read and written; a late row counts, since it may
    change which row closes its day.  A batch replaces its own version when it
    is run again.
    """
    touched = batch.select("account_id").dropna().distinct()
    rows = ledger.join(touched, "account_id", "left_semi")
    end = rows.agg(F.to_date(F.max("ts")).alias("as_of"))
    found = touched.join(marker_balance(rows, running, end).select("account_id", "marker", "marker_day"), "account_id", "left")
    found.write.mode("overwrite").parquet(f"{markers_path}/version={batch_id}")


def current_markers(spark: SparkSession, markers_path: str) -> DataFrame:
    """(account_id, marker, marker_day): the newest version of each account; accounts that never had a balance are left out."""
    held = _stored(spark, markers_path, MARKERS)
    newest = held.groupBy("account_id").agg(F.max_by(F.struct("marker", "marker_day"), "version").alias("m"))
    return newest.select("account_id", "m.marker", "m.marker_day").filter("marker is not null")


def stream_markers(spark: SparkSession, source: str, ledger_path: str, markers_path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps markers up to date as files of rows with running balances arrive (columns of BALANCES)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}")
        ledger = spark.read.parquet(ledger_path)
        mark_batch(batch, batch_id, ledger, ledger.select("txn_id", "balance_after"), markers_path)

    return spark.readStream.schema(BALANCES).parquet(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True)


def touched_balances(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """(account_id, total, n_rows, last) of the accounts that a batch touches, from all their rows, so late rows count."""
    rows = ledger.join(batch.select("account_id").distinct(), "account_id", "left_semi")
    return rows.groupBy("account_id").agg(F.sum("amount").cast("decimal(38,2)").alias("total"), F.count("*").alias("n_rows"), F.max("ts").alias("last"))
