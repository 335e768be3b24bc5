"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

DataFrame operations only.  The rows' input partitions are the blocks.  From
the block sizes and the exact shard sizes, the number of rows that each block
sends to each shard is drawn (a matrix of at most ``MAX_BLOCKS`` by shards,
multivariate hypergeometric row by row, so every assignment is equally
likely).  Each block is permuted locally and cut by its row of the matrix; the
rows are exchanged, and each shard is permuted again, which gives the slots.

No task sorts a whole block or shard: both are split into ranges of the random
key, and the ranges' counts are summed up to offsets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talliver.llm.common import cut, table

MAX_BLOCKS = 4096
#: Rows of a range of the random key, on average.
RANGE_ROWS = 50_000


def communication_matrix(block_sizes: list[int], shard_sizes: list[int], seed: int) -> np.ndarray:
    """Counts by block and shard with these row and column sums."""
    rng = np.random.default_rng(seed)
    left = np.array(shard_sizes, np.int64)
    out = np.zeros((len(block_sizes), len(shard_sizes)), np.int64)
    for i, n in enumerate(block_sizes):
        rest = n
        total = int(left.sum())
        for j in range(len(left)):  # one colour after the other, which has no limit on the totals but 64 bits
            total -= int(left[j])
            take = min(rest, int(left[j])) if total == 0 else _hypergeometric(rng, int(left[j]), total, rest)
            out[i, j] = take
            rest -= take
        left -= out[i]
    return out


def _log_factorial(n: int) -> np.longdouble:
    """log(n!) by Stirling's series in extended precision."""
    if n < 256:
        return np.log(np.arange(1, n + 1, dtype=np.longdouble)).sum()
    x = np.longdouble(n)
    return x * np.log(x) - x + np.log(2 * np.longdouble(np.pi) * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows out of good + bad are good; the same law at every size."""
    n = good + bad
    if good == 0 or draws == 0:
        return 0
    if n < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    # Beyond the generator's range: rejection under a hat by the ratio of uniforms, over the rarer kind and the smaller draw.
    if good > bad:
        return draws - _hypergeometric(rng, bad, good, draws)
    if draws > n - draws:
        return good - _hypergeometric(rng, good, bad, n - draws)
    p = good / n
    deviation = ((n - draws) / (n - 1) * draws * p * (1 - p) + 0.5) ** 0.5
    mode = (draws + 1) * (good + 1) // (n + 2)
    # Fixed values of the hat: 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e).
    centre, width = draws * p + 0.5, 1.7155277699214135 * deviation + 0.8989161620588988

    def weight(k: int) -> np.longdouble:
        return -sum(_log_factorial(x) for x in (k, good - k, draws - k, bad - draws + k))

    top = weight(mode)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = int(np.floor(centre + width * (v - 0.5) / u))
        if 0 <= k <= min(good, draws) and 2 * np.log(u) <= weight(k) - top:
            return k


def _rank(rows: DataFrame, group: str, key: Column, ranges: int) -> DataFrame:
    """Add ``place``: the row's place from 0 in its group by ``key``, then ``uid``."""
    share = (key.cast("double") / F.lit(2.0**64) + 0.5) * ranges
    keyed = rows.withColumn("_key", key).withColumn("_range", F.least(F.floor(share), F.lit(ranges - 1)).cast("int"))
    counts = keyed.groupBy(group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = counts.select(group, "_range", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy("_key", "uid")) - 1
    return keyed.withColumn("_place", place).join(offsets, [group, "_range"]).withColumn("place", F.col("_place") + F.col("_before")).drop("_key", "_range", "_place", "_before")


def shard_rows(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each input row; counts differ by one at most.

    Nulls: a null text has size 16 and the checksum of no bytes; a null id is
    kept.  Repeated rows are rows of their own.  No rows give no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("uid"),
        F.pmod(F.spark_partition_id(), F.lit(MAX_BLOCKS)).alias("block"),
    )
    rows = cut(rows, "rows")
    sizes = [(r[0], r[1]) for r in rows.groupBy("block").count().orderBy("block").collect()]  # at most MAX_BLOCKS rows
    total = sum(n for _, n in sizes)
    shard_sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([n for _, n in sizes], shard_sizes, seed)
    bounds = spark.createDataFrame([(b, np.cumsum(row).tolist()) for (b, _), row in zip(sizes, matrix, strict=True)], "block int, bounds array<long>")
    ranges = max(1, -(-max((n for _, n in sizes), default=1) // RANGE_ROWS))
    sent = _rank(rows, "block", F.xxhash64(F.lit(seed), "uid"), ranges)
    # The matrix has MAX_BLOCKS rows of n_shards numbers at most.
    sent = sent.join(F.broadcast(bounds), "block").withColumn("shard", F.size(F.filter("bounds", lambda x: x <= F.col("place"))))
    sent = sent.select("doc_id", "size", "text_crc32", "uid", "shard")
    placed = _rank(sent, "shard", F.xxhash64(F.lit(seed + 1), "uid"), max(1, -(-total // (n_shards * RANGE_ROWS))))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("place").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
