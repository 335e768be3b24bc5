"""URL filters by a cascade of Bloom filters.

The keys of a url are its host and parent domains that have as many labels as
some rule's host, each with the prefixes of its path that have the length of
some rule's path.  All keys of the corpus are
the universe.  Level 0 of a cascade encodes the listed keys; level 1 encodes
the other keys of the universe that level 0 lets through; level 2 the listed
keys that level 1 lets through; and so on until a level has no false positive.
Then the depth at which a key of the universe drops out tells its membership
exactly, by bit look-ups alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talliver.llm.common import cut, table
from talliver.llm.textkernels import mix

# Fixed values of the contract: verdict and key (host and path) of each rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

PROBES, BITS_PER_KEY = 3, 12
#: Bits of one level at most (64 MB); larger lists are looked up by a join.
MAX_BITS = 1 << 29
MAX_LEVELS = 40


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def keys_of(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys of a url: domain suffixes of these label counts times path prefixes of these lengths.

    Only counts and lengths that some rule has can fit, so a host of any
    length has few keys.
    """
    n_labels = F.size(F.split(host, r"\."))
    suffixes = F.array_compact(F.array(*[F.when(n_labels >= n, F.substring_index(host, ".", -n)) for n in labels]).cast("array<string>"))
    heads = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]).cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda h: F.concat(s, h)))))


@dataclass
class Cascade:
    """Bit arrays by level."""

    levels: list[np.ndarray]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """Membership of hashed keys (int64) of the universe."""
        inside = np.ones(len(keys), bool)
        answer = np.zeros(len(keys), bool)
        for depth, bits in enumerate(self.levels):
            passed = _probe(bits, keys, depth)
            dropped = inside & ~passed
            answer[dropped] = depth % 2 == 1
            inside &= passed
        answer[inside] = len(self.levels) % 2 == 1
        return answer


def _slots(keys: np.ndarray, depth: int, n_bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salt = np.arange(1, PROBES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(depth)
        return mix(keys.view(np.uint64)[:, None] ^ mix(salt)[None, :]) & np.uint64(n_bits - 1)


def _probe(bits: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    slots = _slots(keys, depth, len(bits) * 64)
    return ((bits[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) != 0).all(axis=1)


def _level(keys: DataFrame, n: int, depth: int) -> np.ndarray:
    """One Bloom filter of (key hash); tasks set bits, and only the words of the bit array reach the driver."""
    n_bits = max(64, 1 << (n * BITS_PER_KEY - 1).bit_length())

    def run(batches):
        for batch in batches:
            slots = _slots(np.asarray(batch.column("h")), depth, n_bits).ravel().astype(np.int64)
            yield pa.record_batch([pa.array(slots >> 6), pa.array(np.left_shift(np.uint64(1), (slots & 63).astype(np.uint64)).view(np.int64))], ["w", "b"])

    words = keys.select("h").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    return bits


def build_cascade(universe: DataFrame) -> Cascade | None:
    """A cascade for ``universe`` (h long, listed boolean), distinct keys; None if a level would exceed MAX_BITS."""
    spark = universe.sparkSession
    levels: list[np.ndarray] = []
    side = universe.filter("listed").select("h")
    other = universe.filter("not listed").select("h")
    for depth in range(MAX_LEVELS):
        n = side.count()
        if n == 0:
            return Cascade(levels)
        if n * BITS_PER_KEY > MAX_BITS:
            return None
        bits = _level(side, n, depth)
        levels.append(bits)
        shared = spark.sparkContext.broadcast(bits)

        def false_positives(batches, shared=shared, depth=depth):
            for batch in batches:
                yield batch.filter(pa.array(_probe(shared.value, np.asarray(batch.column("h")), depth)))

        # What this level lets through wrongly is what the next one encodes, against this level's keys.
        wrong = cut(other.mapInArrow(false_positives, "h long"), f"level_{depth}")
        side, other = wrong, side
    raise RuntimeError("keys with equal hashes on both sides")


def _decide(cascades):
    def run(batches):
        for batch in batches:
            n = np.asarray(pa.compute.list_value_length(batch.column("hs")))
            flat = np.asarray(batch.column("hs").flatten())
            keys = batch.column("keys").flatten().to_pylist()
            verdicts = [(v, c.contains(flat)) for v, c in cascades.value]
            rule, verdict, at = [], [], 0
            for size in n:
                hits = [(len(keys[i]), keys[i], v) for v, found in verdicts for i in at + np.flatnonzero(found[at : at + size])]
                best = max(hits, default=(0, None, None))
                rule.append(best[1])
                verdict.append(best[2])
                at += size
            yield pa.record_batch([*[batch.column(c) for c in ("page_id", "host", "path")], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict per input row; ``rules`` has verdict and key (host and path).

    The longest fitting rule wins (ties: the larger key); a url without one
    gets ``default``.  Null urls and urls without ``://`` have empty host and
    path.  Null rules are ignored; a key listed with two verdicts counts with
    the larger one; a key without ``/`` fits every path of its hosts.  Repeated
    rows are judged each.
    """
    spark = pages.sparkSession
    listed = rules.select("verdict", "key").dropna().groupBy("key").agg(F.max("verdict").alias("verdict"))
    slash = F.instr("key", "/")
    rule_host = F.when(slash > 0, F.substring("key", F.lit(1), slash - 1)).otherwise(F.col("key"))
    lengths = sorted(r[0] for r in listed.select(F.length("key") - F.length(rule_host)).distinct().collect())
    labels = sorted(r[0] for r in listed.select(F.size(F.split(rule_host, r"\."))).distinct().collect())
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("keys", keys_of(F.col("host"), F.col("path"), labels, lengths))
    universe = urls.select("host", "path", "keys").select(F.explode("keys").alias("key")).distinct()
    universe = universe.join(listed, "key", "left").select(F.xxhash64("key").alias("h"), "verdict")
    universe = cut(universe, "universe")
    names = [r[0] for r in listed.select("verdict").distinct().orderBy("verdict").collect()]
    cascades = [(v, build_cascade(universe.select("h", F.coalesce(F.col("verdict") == v, F.lit(False)).alias("listed")))) for v in names]
    if any(c is None for _, c in cascades):  # too long a list for bit arrays
        hit = urls.withColumn("uid", F.monotonically_increasing_id())
        hit = cut(hit, "urls")
        best = hit.select("uid", F.explode("keys").alias("key")).join(listed, "key").groupBy("uid").agg(F.max(F.struct(F.length("key"), "key", "verdict")).alias("r"))
        return hit.join(best, "uid", "left").select("page_id", "host", "path", F.col("r.key").alias("rule"), F.coalesce("r.verdict", F.lit(default)).alias("verdict"))
    urls = urls.withColumn("hs", F.transform("keys", lambda k: F.xxhash64(k)))
    out = urls.mapInArrow(_decide(spark.sparkContext.broadcast(cascades)), "page_id long, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(list(RULES), "verdict string, key string"))


_RULE_ROWS = ", ".join(f"('{v}', '{k[: k.index('/')]}', '{k[k.index('/') :]}', '{k}')" for v, k in RULES)
ORACLE = f"""
WITH r(verdict, rhost, rpath, rule) AS (VALUES {_RULE_ROWS}),
u AS (SELECT row_number() OVER () AS uid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT uid, page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, rest FROM u),
p AS (SELECT uid, page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw_host) + 1), '^([^?#]*)', 1) AS path FROM h),
m AS (SELECT uid, rule, verdict, row_number() OVER (PARTITION BY uid ORDER BY length(rule) DESC, rule DESC) AS n
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m ON p.uid = m.uid AND m.n = 1
"""
