"""Benchmark decontamination by a distributed positional inverted index.

The index is split by documents: each slice of a task is one shard and stores,
for every term of the test items, the sorted positions of that term over the
shard's texts (texts are spaced apart, so no list runs over a text's end).  A
window of test words is answered by its rarest terms first: the posting lists,
each shifted by the term's offset in the window, are intersected until they
are empty or all terms are used, which leaves exact phrase matches.
Proximity matches take the same lists without the offsets: all words of a
window within a run of some more words.

The test items are a stated query set.  They are read in blocks of a fixed
number of bytes, and each block is broadcast, so any number of items works.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliver.llm.common import cut, table, texts_of, with_text
from talliver.llm.textkernels import ALNUM, Words, slices

#: Bytes of test items in one block, which is collected and broadcast.
BLOCK_BYTES = 8 << 20
#: Further words among which the words of a window may lie for a proximity match.
SLOP = 7


class Windows:
    """The distinct windows of a block of items: term numbers by offset, and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], k: int):
        words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM, lower=True)
        self.terms, number = np.unique(words.hash, return_inverse=True)
        owners: dict[tuple[int, ...], set[str]] = {}
        for i, (name, _) in enumerate(items):
            seq = number[words.first[i] : words.first[i + 1]].tolist()
            for j in range(max(0, len(seq) - k) + 1 if seq else 0):
                owners.setdefault(tuple(seq[j : j + k]), set()).add(name)
        windows = sorted(owners, key=lambda w: (len(w), w))
        self.names = sorted({n for names in owners.values() for n in names})
        place = {n: i for i, n in enumerate(self.names)}
        self.owners = [np.array(sorted(place[n] for n in owners[w]), np.int64) for w in windows]
        #: (number of the first window, terms by window and offset) for each length of windows.
        self.by_length: list[tuple[int, np.ndarray]] = []
        lengths = np.array([len(w) for w in windows])
        for n in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == n)
            self.by_length.append((int(mine[0]), np.array([windows[i] for i in mine], np.int64)))


class Shard:
    """Posting lists of the known terms over the texts of one slice, as one sorted array of (term, position)."""

    def __init__(self, column: pa.Array, terms: np.ndarray, gap: int):
        self.words = Words(column, ALNUM, lower=True)
        at = np.searchsorted(terms, self.words.hash)
        at = np.minimum(at, max(len(terms) - 1, 0))
        known = np.flatnonzero(terms[at] == self.words.hash) if len(terms) else np.zeros(0, np.int64)
        rows = len(self.words.first) - 1
        #: Position of each text's first word; texts are ``gap`` apart, so no list runs over a text's end.
        self.base = self.words.first[:-1] + (np.arange(rows) + 1) * gap
        self.length = len(self.words.hash) + (rows + 2) * gap
        self.keys = np.sort(at[known] * self.length + known + (self.words.doc[known] + 1) * gap)
        self.edges = np.searchsorted(self.keys, np.arange(len(terms) + 1) * self.length)

    def rarest(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows all of whose terms occur here, and their offsets from the rarest term on."""
        sizes = np.diff(self.edges)[windows]
        alive = np.flatnonzero(sizes.all(axis=1))
        return alive, np.argsort(sizes[alive], axis=1, kind="stable")

    def first(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which term, position) for all postings of these terms."""
        lo, n = self.edges[terms], self.edges[terms + 1] - self.edges[terms]
        which = np.repeat(np.arange(len(terms)), n)
        return which, self.keys[np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)] - terms[which] * self.length

    def exact(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) where a window's words follow each other: lists shifted by offset, intersected from the rarest on."""
        alive, order = self.rarest(windows)
        if not len(alive):
            return alive, alive
        terms = np.take_along_axis(windows[alive], order, 1)
        which, at = self.first(terms[:, 0])
        at = at - order[which, 0]
        for i in range(1, windows.shape[1]):
            key = terms[which, i] * self.length + at + order[which, i]
            found = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
            which, at = which[found], at[found]
        return alive[which], at

    def near(self, windows: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, text) where all words of a window lie within ``span`` consecutive words."""
        alive, order = self.rarest(windows)
        if not len(alive):
            return alive, alive
        terms = np.take_along_axis(windows[alive], order, 1)
        which, at = self.first(terms[:, 0])
        for i in range(1, windows.shape[1]):
            key = terms[which, i] * self.length + at
            found = np.searchsorted(self.keys, key + span) > np.searchsorted(self.keys, key - span + 1)
            which, at = which[found], at[found]
        doc = np.searchsorted(self.base, at, side="right") - 1
        done: dict[tuple[int, int], bool] = {}
        for w, d, p in zip(which.tolist(), doc.tolist(), at.tolist(), strict=True):
            if not done.get((w, d)):
                lists = []
                for t in set(terms[w].tolist()):
                    a, b = np.searchsorted(self.keys, [t * self.length + p - span + 1, t * self.length + p + span])
                    lists.append(self.keys[a:b] - t * self.length)
                # Some run of ``span`` words that begins at a word of the window holds them all.
                begins = np.concatenate(lists)
                inside = [np.searchsorted(x, begins + span) > np.searchsorted(x, begins) for x in lists]
                done[w, d] = bool(np.logical_and.reduce(inside).any())
        hits = [x for x, ok in done.items() if ok]
        return alive[[w for w, _ in hits]], np.array([d for _, d in hits], np.int64)


def _items(pairs: np.ndarray, wanted: Windows, rows: int) -> list[list[str]]:
    """The items of each text, from its distinct (text, window) pairs."""
    out: list[list[str]] = [[] for _ in range(rows)]
    edges = np.searchsorted(pairs[:, 0], np.arange(rows + 1))
    for d in np.unique(pairs[:, 0]).tolist():
        found = np.concatenate([wanted.owners[w] for w in pairs[edges[d] : edges[d + 1], 1]])
        out[d] = [wanted.names[i] for i in np.unique(found)]
    return out


def _match(block, k: int, slop: int | None, text_col: str):
    def run(batches):
        wanted: Windows = block.value
        for whole in with_text(batches, text_col):
            for batch in slices(whole):
                rows = batch.num_rows
                shard = Shard(batch.column("text"), wanted.terms, k + 2 * (k + (slop or 0)))
                counts = shard.words.counts()
                cover = np.zeros(shard.length + k + 1, np.int64)
                exact, close = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
                for number, windows in wanted.by_length:
                    which, at = shard.exact(windows)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + windows.shape[1], -1)
                    exact.append(np.stack([np.searchsorted(shard.base, at, side="right") - 1, number + which], axis=1))
                    if slop is not None:
                        which, doc = shard.near(windows, k + slop)
                        close.append(np.stack([doc, number + which], axis=1))
                covered = np.cumsum(cover) > 0
                hit = np.concatenate([[0], np.cumsum(covered)])
                n_hit = hit[shard.base + counts] - hit[shard.base]
                spans: list[list[dict[str, int]]] = [[] for _ in range(rows)]
                for d in np.flatnonzero(n_hit):
                    step = np.diff(np.concatenate([[0], covered[shard.base[d] : shard.base[d] + counts[d]].astype(np.int8), [0]]))
                    spans[d] = [{"s": int(a), "e": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                items, near = (_items(np.unique(np.concatenate(x), axis=0), wanted, rows) for x in (exact, close))
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.record_batch(
                    [*[batch.column(c) for c in keep], pa.array(counts.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array(items, pa.list_(pa.string())), pa.array(spans, SPANS), pa.array(near, pa.list_(pa.string()))],
                    [*keep, "n_words", "n_hit", "items", "spans", "near_items"],
                )

    return run


SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_ADDED = "n_words long, n_hit long, items array<string>, spans array<struct<s:int,e:int>>, near_items array<string>"


def phrase_matches(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 13, slop: int | None = None, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items, spans (word spans hit), near_items
    (and the row itself as a struct, if ``carry``).

    Null or wordless texts have no words and no hits; null or wordless items
    have no window; items of fewer than ``k`` words are one window.  Items that
    share an id are one item; items whose id is null are one item, listed as
    an empty string.  ``near_items`` are the items with a window all of whose
    words lie within ``k + slop`` consecutive words of the text; it is empty if
    no slop is given.
    """
    spark = docs.sparkSession
    texts, schema = texts_of(docs, id_col, text_col, carry, _ADDED)
    named = tests.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")).dropna()
    total = named.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_blocks = max(1, -(-total // BLOCK_BYTES))

    def matched(rows: DataFrame, b: int, kind) -> DataFrame:
        items = named.filter(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == b)
        block = Windows(sorted((r[0], r[1]) for r in items.collect()), k)
        return rows.mapInArrow(_match(spark.sparkContext.broadcast(block), k, slop, text_col), kind)

    if n_blocks == 1:
        return matched(texts, 0, schema)
    # Several blocks: the hits of equal texts are equal, so they meet by the text's hash.
    text = F.col("row")[text_col] if carry else F.col("text")
    hashed = texts.withColumn("fp", F.xxhash64(text))
    same = hashed.select("fp", text.alias("text"))
    parts = [cut(matched(same, b, f"fp long, {_ADDED}").dropDuplicates(["fp"]), f"block_{b}") for b in range(n_blocks)]
    many = parts[0]
    for part in parts[1:]:
        many = many.union(part)
    hit_words = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("spans")), lambda x: F.sequence(x["s"], x["e"] - 1))))
    merged = many.groupBy("fp").agg(
        F.max("n_words").alias("n_words"),
        F.size(hit_words).cast("long").alias("n_hit"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
    )
    return hashed.drop("text").join(cut(merged, "merged"), "fp", "left").drop("fp")


def contamination(docs: DataFrame, tests: DataFrame, **options) -> DataFrame:
    """``phrase_matches`` with the contract's columns and n_near (the number of near items).

    Contaminated: exactly hit words are a twentieth of the text or more.
    """
    found = phrase_matches(docs, tests, **options)
    return found.select(
        *[c for c in ("doc_id", "row") if c in found.columns],
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=SLOP)
