"""A training corpus from the documents table: identify, join copies, decontaminate, mask secrets, encode.

Each stage takes (spark, docs, sf_dir), calls one operator of talliver.llm and
lets its decision take effect; all but the last return the columns of
documents.  Its result is written as Parquet and read again for the next one.
A stage sets the batch sizes of its session, as its result may be written by its caller.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talliver.llm.byte_bpe import token_digests
from talliver.llm.common import cut, node_filter, only, table
from talliver.llm.decontaminate import contamination
from talliver.llm.language_id import language_of, train
from talliver.llm.ngram_join import jaccard_components
from talliver.llm.secret_scan import scan_secrets

#: What stands in for a secret.
MASK = "[secret]"
#: Whole documents go through Parquet readers and Arrow in batches of bounded rows and, in Arrow, bytes; Spark's own sizes take 10,000 texts at once.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "1024"}


def in_batches(stage: Callable) -> Callable:
    """A stage whose session has the sizes of ``BATCHES`` from then on: its result runs when it is written, not when it is made."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        return stage(spark, docs, sf_dir)

    return run


@in_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null text, no letter) go."""
    return docs.filter(language_of(F.col("text"), train(docs))["lang_pred"] != "und")


@in_batches
def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays: that of the smallest id, and of its smallest text hash; rows without id stay.

    A row is known by its id and the hash of its text, so rows that share an
    id but not their text are judged apart; of rows that share both one stays.
    Only documents that a fixed-size bit filter can't clear meet the list of
    the ones that go.
    """
    rows = cut(jaccard_components(docs, count=False).filter("doc_id is not null"), "components")
    own = F.struct("doc_id", "text_key")
    first = rows.filter("`group` is not null").groupBy("group").agg(F.min(own).alias("first"))
    copies = rows.join(first, "group", "left").groupBy("doc_id", "text_key").agg(F.count("*").alias("c"), F.min(F.coalesce(F.col("first") == own, F.lit(True))).alias("stays"))
    listed = cut(copies.filter("c > 1 or not stays").select("doc_id", "text_key", "stays"), "listed")
    bits = node_filter(listed, "doc_id")
    clear = docs.mapInArrow(only(bits, "doc_id", passing=False), docs.schema)
    # Both sides are one struct each, so that no column of the documents can clash with the list's.
    rows = docs.mapInArrow(only(bits, "doc_id"), docs.schema).select(F.struct("*").alias("row"))
    same = F.expr("row.doc_id = listed.doc_id and xxhash64(row.text) = listed.text_key")
    rest = rows.join(listed.select(F.struct("*").alias("listed")), same, "left").filter("coalesce(listed.stays, true)")
    once = rest.filter("listed.stays").select("row.*").dropDuplicates(["doc_id", "text"])
    return clear.unionByName(rest.filter("listed.stays is null").select("row.*")).unionByName(once)


@in_batches
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return contamination(docs, table(spark, sf_dir, "benchmark"), carry=True).filter("not contaminated").select("row.*")


@in_batches
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    found = scan_secrets(docs, mask=MASK, carry=True)
    text = F.col("masked")
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[changed.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


@in_batches
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left."""
    return token_digests(docs)


STAGES = [("language_id", language_id), ("ngram_join", ngram_join), ("decontamination", decontamination), ("secret_scan", secret_scan), ("byte_bpe", byte_bpe)]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
