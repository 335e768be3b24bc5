"""Exact top-k inner product search by exhaustive term-at-a-time accumulation.

A vector is a sparse row of integer weights, one term per component.  The
queries are a stated set and are taken in blocks of a fixed number of rows; a
block is broadcast.  Each task reads its candidates in small tiles and holds a
dense score array of queries by candidates: term after term, the postings of
the term (candidates with a weight there) are scattered into it, weighted by
the queries' rows.  A partition selects the k best of each query, and the
selections are merged.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.llm.common import cut, table

#: Queries in a broadcast block, queries and candidates of one dense score array.
BLOCK, TILE_QUERIES, TILE_ROWS = 4096, 256, 512
#: No score: less than every score that is allowed.
NONE = np.iinfo(np.int64).min


def weights(vectors: pa.Array, scale: int) -> np.ndarray:
    """Integer weights of vectors without nulls; shorter ones are padded by zeros."""
    size = np.asarray(pc.list_value_length(vectors))
    flat = np.floor(scale * np.asarray(vectors.flatten()))
    if len(flat) and np.abs(flat).max() >= 2.0**62:
        raise ArithmeticError("a component exceeds 62 bits")
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = flat.astype(np.int64)
    return out


def accumulate(queries: np.ndarray, rows: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Scores of all queries (n, terms) against all rows (m, terms), term at a time; NONE where ``skip`` holds."""
    terms = min(queries.shape[1], rows.shape[1])
    peak = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(terms, 1)
    # Where a sum might leave 64 bits, Python's integers take over, and only scores that do leave them are an error.
    kind = np.int32 if peak < 2**31 else np.int64 if peak < 2**63 else object
    scores = np.zeros((len(queries), len(rows)), kind)
    q, r = queries[:, :terms].astype(kind).T.copy(), rows[:, :terms].astype(kind).T.copy()
    for t in range(terms):
        posting = np.flatnonzero(r[t])
        if 2 * len(posting) > len(rows):
            scores += q[t][:, None] * r[t][None, :]
        elif len(posting):
            scores[:, posting] += q[t][:, None] * r[t][posting][None, :]
    if kind is object:
        scores[skip] = 0
        if any(abs(x) >= 2**63 for x in scores.ravel()):
            raise ArithmeticError("a score exceeds 64 bits")
    scores = scores.astype(np.int64)
    scores[skip] = NONE
    return scores


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row (ties to the smaller id) as (scores, ids); ids must ascend."""
    n, m = scores.shape
    if m <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    least = np.partition(scores, m - k, axis=1)[:, m - k, None]
    above, ties = scores > least, scores == least
    # Of those that tie at the end as many as there is room for, smallest ids first.
    chosen = above | (ties & (np.cumsum(ties, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    order = np.nonzero(chosen)[1].reshape(n, k)
    return np.take_along_axis(scores, order, 1), ids[order]


def _search(block, k: int, scale: int):
    def run(batches):
        q_ids, q = block.value
        best = np.full((len(q_ids), 0), NONE)
        best_id = np.zeros((len(q_ids), 0), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(start, TILE_ROWS)
                if not len(q_ids):
                    continue
                ids, rows = np.asarray(part.column("id")), weights(part.column("vector"), scale)
                by = np.argsort(ids, kind="stable")
                ids, rows = ids[by], rows[by]
                new, new_id = [], []
                for a in range(0, len(q_ids), TILE_QUERIES):
                    mine = q_ids[a : a + TILE_QUERIES]
                    s, i = select(accumulate(q[a : a + TILE_QUERIES], rows, mine[:, None] == ids[None, :]), ids, k)
                    new.append(s)
                    new_id.append(i)
                s, i = np.hstack([best, np.vstack(new)]), np.hstack([best_id, np.vstack(new_id)])
                order = np.lexsort((i, ~s), axis=1)[:, :k]
                best, best_id = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        r, c = np.nonzero(best > NONE)
        yield pa.record_batch([pa.array(q_ids[r]), pa.array(best_id[r, c]), pa.array(best[r, c])], ["query_id", "id", "score"])

    return run


def top_k(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank (from 1), id, score: the k best other rows of each row whose id is divisible by ``every``.

    Vectors that are null or hold a null or non-finite component, and rows
    without id, take no part.  Vectors of different lengths are padded by
    zeros.  Rows that share an id are never each other's results; a repeated
    query id is one query (its smallest vector).  A repeated candidate keeps
    its rows.  No rows give no results.  A score beyond 64 bits and a scaled
    component of 62 bits or more are errors.
    """
    spark = rows.sparkSession
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("id is not null and vector is not null")
    usable = vectors.filter(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    queries = usable.filter(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("vector").alias("vector"))
    n_blocks = max(1, -(-queries.count() // BLOCK))
    found = []
    for b in range(n_blocks):
        rows_b = queries.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).orderBy("id").toArrow().combine_chunks()
        block = spark.sparkContext.broadcast((rows_b["id"].to_numpy(), weights(rows_b["vector"].combine_chunks(), scale)))
        part = usable.mapInArrow(_search(block, k, scale), "query_id long, id long, score long")
        if n_blocks > 1:  # one block at a time
            part = cut(part, f"block_{b}")
            block.destroy()
        found.append(part)
    found = reduce(DataFrame.union, found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op4_exact_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
  CAST(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
