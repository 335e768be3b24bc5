"""Importance resampling towards a target: n-gram bucket weights, and an exact draw of the best keys.

1. Features are runs of one to three words, hashed into buckets by CRC-32.
   Tasks count them in dense arrays; the sums over the raw and the target texts
   give one gain per bucket, an array of fixed length.
2. Every text's weight is the sum of the gains of its features, looked up in
   that array; a seeded Gumbel term makes the draw.
3. The cutoff is found by weighted medians: every partition reports the median
   of its remaining keys, the median of these, weighted by how many keys
   remain, is the pivot, and a guaranteed quarter of the keys at least is
   discarded each round, until the key of the wanted rank itself is known.
4. Only the winners are sorted, by range; ranks come from their places in the
   sorted partitions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliver.llm.common import cut, discard, table
from talliver.llm.textkernels import ALNUM, LOWER, Words, slices

BUCKETS = 10_000
#: Words of the longest feature.
RUN = 3
#: So few keys are looked at by the driver itself.
FEW = 1 << 14
#: Longer words are hashed one by one.
LONG = 256

_CRC = np.zeros(256, np.uint32)
for _i in range(256):
    _c = _i
    for _ in range(8):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _CRC[_i] = _c
_shifts: list[np.ndarray] = []


def _shift_table() -> np.ndarray:
    """What appending n zero bytes (n up to LONG + 1) does to each byte of a CRC: (n, byte, value)."""
    if not _shifts:
        t = np.zeros((LONG + 2, 4, 256), np.uint32)
        t[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(1, LONG + 2):
            t[n] = _CRC[t[n - 1] & 255] ^ (t[n - 1] >> np.uint32(8))
        _shifts.append(t)
    return _shifts[0]


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32 is linear: crc(a + b) = shifted(crc(a), len(b)) ^ crc(b)."""
    t = _shift_table()
    n = n.copy()
    while True:
        step = np.minimum(n, LONG + 1)
        crc = t[step, 0, crc & 255] ^ t[step, 1, (crc >> 8) & 255] ^ t[step, 2, (crc >> 16) & 255] ^ t[step, 3, crc >> 24]
        n -= step
        if not n.any():
            return crc


def word_crcs(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word, a byte of all words at a time."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    begin, size = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    far = int(np.searchsorted(-size, -LONG, side="left"))  # words over LONG bytes
    for j in range(int(size[far]) if far < len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))
        part = crc[far:n]
        crc[far:n] = _CRC[(part ^ low[begin[far:n] + j]) & 255] ^ (part >> np.uint32(8))
    crc = ~crc
    for i in range(far):
        crc[i] = zlib.crc32(low[begin[i] : begin[i] + size[i]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def feature_crcs(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... RUN words: the CRC-32 of each (joined by one space) and its text."""
    size = words.end - words.start
    one = word_crcs(LOWER[words.raw], words.start, words.end)
    spaced = shifted(np.full(len(one), zlib.crc32(b" "), np.uint32), size) ^ one
    out, crc = [(one, words.doc)], one
    for k in range(1, RUN):
        if len(one) <= k:
            break
        crc = shifted(crc[:-1], size[k:] + 1) ^ spaced[k:]
        inside = words.doc[:-k] == words.doc[k:]
        out.append((crc[inside], words.doc[:-k][inside]))
    return out


def _counted(batches):
    counts = np.zeros(BUCKETS, np.int64)
    for whole in batches:
        for batch in slices(whole):
            for crc, _ in feature_crcs(Words(batch.column("text"), ALNUM, lower=True)):
                counts += np.bincount(crc % BUCKETS, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "c"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    sums = texts.select("text").mapInArrow(_counted, "bucket int, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[sums["bucket"].to_numpy()] = sums["c"].to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _weighed(gains: np.ndarray):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                words = Words(batch.column("text"), ALNUM, lower=True)
                n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                for crc, doc in feature_crcs(words):
                    sums = np.concatenate([[0], np.cumsum(gains[crc % BUCKETS])])
                    edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                    n += np.diff(edges)
                    weight += np.diff(sums[edges])
                yield pa.record_batch([batch.column("doc_id"), pa.array(words.counts().astype(np.int64)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return run


def _before(a: np.ndarray, b: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    return (a < key[0]) | ((a == key[0]) & (b < key[1]))


def _median(a: np.ndarray, b: np.ndarray) -> list[int]:
    if not len(a):
        return [0, 0]
    at = np.lexsort((b, a))[(len(a) - 1) // 2]
    return [int(a[at]), int(b[at])]


def _halves(pivot: tuple[int, int] | None):
    """One row per partition: keys before, at and behind the pivot, and the medians of those before and behind."""

    def run(batches):
        parts = [(np.asarray(x.column("a")), np.asarray(x.column("b"))) for x in batches]
        a, b = (np.concatenate([p[i] for p in parts] + [np.zeros(0, np.int64)]) for i in (0, 1))
        first = np.ones(len(a), bool) if pivot is None else _before(a, b, pivot)
        same = np.zeros(len(a), bool) if pivot is None else (a == pivot[0]) & (b == pivot[1])
        last = ~first & ~same
        row = [int(first.sum()), int(same.sum()), int(last.sum()), *_median(a[first], b[first]), *_median(a[last], b[last])]
        yield pa.record_batch([pa.array([x], pa.int64()) for x in row], ["n0", "n", "n1", "a0", "b0", "a1", "b1"])

    return run


def cutoff_key(keys: DataFrame, rank: int) -> tuple[int, int]:
    """The key (a, b) of the given rank (from 1) in ascending order of the long columns ``a`` and ``b``.

    Keys are read from a table that is written anew whenever half of it is
    discarded; a task holds the keys of its partition, the driver one row per
    partition.
    """
    kept = stored = cut(keys.select("a", "b"), "keys")
    held = left = kept.count()
    if not 1 <= rank <= left:
        raise ValueError(f"rank {rank} of {left} keys")
    pivot = None
    while left > FEW:
        sums = kept.mapInArrow(_halves(pivot), "n0 long, n long, n1 long, a0 long, b0 long, a1 long, b1 long").toArrow()
        n = {c: sums[c].to_numpy() for c in sums.column_names}
        before, same = int(n["n0"].sum()), int(n["n"].sum())
        if before < rank <= before + same:
            break
        side = "0" if rank <= before else "1"
        if pivot is not None:
            a, b = pivot
            kept = kept.filter((F.col("a") < a) | ((F.col("a") == a) & (F.col("b") < b)) if side == "0" else (F.col("a") > a) | ((F.col("a") == a) & (F.col("b") > b)))
            if side == "1":
                rank -= before + same
        weights = n["n" + side]
        left = int(weights.sum())
        # Half of the remaining weight lies at or before the median of medians, half at or behind it.
        order = np.lexsort((n["b" + side], n["a" + side]))
        order = order[weights[order] > 0]
        middle = order[np.searchsorted(np.cumsum(weights[order]) * 2, left)]
        pivot = (int(n["a" + side][middle]), int(n["b" + side][middle]))
        if 2 * left <= held:
            new = cut(kept, "keys")
            discard(stored)
            kept, stored, held = new, new, left
    else:
        rows = kept.toArrow()
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        at = np.lexsort((b, a))[rank - 1]
        pivot = (int(a[at]), int(b[at]))
    discard(stored)
    return pivot


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each input row; rank (from 1) is null where it isn't drawn.

    Of the rows with ``least_words`` words or more, ``percent`` percent (rounded
    down) are drawn by the highest scores, ties to the smaller id, then the
    fewer features, then the smaller weight.  A null or empty text has no
    features and weight 0.  A row without id has no score, isn't drawn and
    doesn't count among those drawn from, but its text counts in the sums.
    Repeated rows are rows of their own with equal scores.  Other columns are
    never read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gains = bucket_gains(bucket_counts(texts), bucket_counts(target.select(F.col(target_col).alias("text"))))
    weighed = texts.mapInArrow(_weighed(gains), "doc_id long, n_words long, n_features long, weight long")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = cut(weighed.withColumn("score", F.col("weight") + noise), "scored")
    usable = F.coalesce((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull(), F.lit(False))
    wanted = percent * scored.filter(usable).count() // 100
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    a, b = cutoff_key(scored.filter(usable).select((-F.col("score")).alias("a"), F.col("doc_id").alias("b")), wanted)
    within = usable & ((F.col("score") > -a) | ((F.col("score") == -a) & (F.col("doc_id") <= b)))
    winners = scored.filter(within).orderBy(F.desc("score"), "doc_id", "n_features", "weight").withColumn("place", F.monotonically_increasing_id())
    winners = cut(winners, "winners").withColumn("part", F.shiftright("place", 33))
    # A row per partition of the sort: where its ranks begin.
    sizes = sorted(tuple(r) for r in winners.groupBy("part").count().collect())
    begins = np.cumsum([0] + [n for _, n in sizes]).tolist()
    offsets = docs.sparkSession.createDataFrame([(p, x) for (p, _), x in zip(sizes, begins, strict=False)], "part long, begin long")
    rank = F.col("begin") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    # Rows that equal the cutoff row share its key; those beyond the wanted number aren't drawn.
    drawn = winners.join(offsets, "part").select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionAll(scored.filter(~within).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_STEP = "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"  # the polynomial of CRC-32
_FEATURES = " UNION ALL ".join(f"SELECT rid, unnest(list_transform(range(len(ws) - {k - 1}), lambda i: array_to_string(ws[i + 1 : i + {k}], ' '))) AS f FROM {{0}} WHERE len(ws) >= {k}" for k in range(1, RUN + 1))
ORACLE = f"""WITH crc AS MATERIALIZED (SELECT list(list_reduce(range(8), {_STEP}, i) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS MATERIALIZED (SELECT row_number() OVER () AS rid, {_WORDS} AS ws FROM benchmark),
df AS MATERIALIZED ({_FEATURES.format("d")}), bf AS MATERIALIZED ({_FEATURES.format("b")}),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
k AS MATERIALIZED (SELECT f, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1 : 2 * i + 2] AS BIGINT)), lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM h CROSS JOIN crc),
s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + {BUCKETS}) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT rid, count(*) AS n_features, sum(gain) AS weight FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY rid),
r AS (SELECT d.*, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST('0x' || sha256('42:' || doc_id)[1:8] AS BIGINT) AS u FROM d LEFT JOIN w USING (rid)),
c AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, len(ws) >= 20 AND doc_id IS NOT NULL AS usable FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY usable ORDER BY score DESC, doc_id, n_features, weight) AS place, count(*) FILTER (usable) OVER () AS n FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN usable AND place <= 5 * n // 100 THEN place END AS rank FROM p"""
