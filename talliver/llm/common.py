"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only where none is set and Spark runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or os.path.join(tempfile.gettempdir(), "talliver-checkpoints")


#: While a table is written: shuffle files go when it ends, and Arrow batches of whole texts stay small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def cut(df: DataFrame, name: str, conf: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost nothing.

    ``conf`` holds while the table is written, besides WRITING.

    The write's own shuffle files are removed at its end; ``df`` should not be
    run again, or its shuffles are made anew.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/talliver/{uuid.uuid4().hex}/{name}"
    held = WRITING | (conf or {})
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.written = path
    return kept


def discard(*kept: DataFrame) -> None:
    """Delete what ``cut`` wrote for these tables; nothing may read them any more."""
    for df in kept:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(docs: DataFrame, id_col: str, text_col: str, carry: bool, extra: str) -> tuple[DataFrame, StructType]:
    """(doc_id and text or, if ``carry``, the whole input row as ``row``), and the schema of doc_id, row and ``extra``.

    A carried row holds the text already; ``with_text`` takes it from there.
    """
    own = F.struct("*").alias("row") if carry else F.col(text_col).alias("text")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), own)
    return texts, StructType([f for f in texts.schema if f.name != "text"] + StructType.fromDDL(extra).fields)


def with_text(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """Batches of ``texts_of`` with a column ``text``."""
    for batch in batches:
        if "text" not in batch.schema.names:
            batch = pa.record_batch([*batch.columns, pc.struct_field(batch.column("row"), text_col)], [*batch.schema.names, "text"])
        yield batch


FILTER_WORDS = 1 << 20


def node_filter(nodes: DataFrame, column: str):
    """A broadcast bit filter over a long column: 64 * FILTER_WORDS bits, 8 MB at any input size, less where few are set.

    Lets through every value of ``nodes`` and some others; what passes is
    always joined exactly afterwards.  Destroy it when its last reader is done.
    """
    slot = F.col(column).bitwiseAND(FILTER_WORDS * 64 - 1)
    packed = nodes.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({column} & 63L as int))")).alias("bits")).toArrow()
    at, bits = packed["w"].to_numpy(), packed["bits"].to_numpy().view(np.uint64)
    if 4 * len(at) < FILTER_WORDS:
        by = np.argsort(at)
        return nodes.sparkSession.sparkContext.broadcast((np.append(at[by], FILTER_WORDS), np.append(bits[by], np.uint64(0))))
    dense = np.zeros(FILTER_WORDS, np.uint64)
    dense[at] = bits
    return nodes.sparkSession.sparkContext.broadcast((None, dense))


def passes(bits: tuple[np.ndarray | None, np.ndarray], values: np.ndarray) -> np.ndarray:
    slot = values & (FILTER_WORDS * 64 - 1)
    words, held = bits
    if words is None:
        mine = held[slot >> 6]
    else:
        at = np.searchsorted(words, slot >> 6)
        mine = np.where(words[at] == slot >> 6, held[at], np.uint64(0))
    return (mine >> (slot & 63).astype(np.uint64)) & np.uint64(1) != 0


def only(bits, column: str, passing: bool = True):
    """For mapInArrow: the rows whose ``column`` passes the filter (null does not), or the others."""

    def run(batches):
        for batch in batches:
            values = batch.column(column)
            ok = passes(bits.value, np.asarray(values.fill_null(0))) & ~np.asarray(values.is_null())
            yield batch.filter(pa.array(ok if passing else ~ok))

    return run
