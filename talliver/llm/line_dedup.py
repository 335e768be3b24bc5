"""Drops lines that an earlier document holds, by two Bloom filters and an exact confirmation of what they suspect.

1. Tasks hash the key of every line (stripped, A-Z lower-cased) and note the
   slots that one document, and those that two documents or more, have set in
   a once-seen and a twice-seen filter.  The parts are merged by chunks of the
   filter: a slot that two parts have seen once has been seen twice.
2. Only keys that the twice-seen filter holds are suspected.  They are shuffled
   with the document, pre-aggregated to the smallest; keys are compared whole.
   Hence one row per suspected key, however many lines hold it.
3. A document keeps the suspected keys that it is the first to hold; its other
   suspected lines go.  Documents that are first for no suspected key meet no
   list at all.

The filters have a fixed size at any input; once they fill up more keys are
suspected and shuffled, and the result stays the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliver.llm.common import cut, node_filter, only, table
from talliver.llm.textkernels import SPACE, KeyLines, mix, slices

#: Bits of each of the two probes of a filter, and bits of a chunk (its slots fit 16 bits).
PROBE_BITS, CHUNK_BITS = 1 << 27, 1 << 16
PROBES = 2
#: Slots that a task holds before it sends them.
HELD = 1 << 22


@dataclass(frozen=True)
class Filter:
    """Layout of a filter: bits of each probe's part, and of a chunk."""

    probe: int
    chunk: int

    def slots(self, h: np.ndarray) -> np.ndarray:
        """A slot per probe for each key."""
        with np.errstate(over="ignore"):
            return np.concatenate([(mix(h ^ np.uint64(0xD1B54A32D192ED03 * (p + 1) & (2**64 - 1))) % np.uint64(self.probe)).astype(np.int64) + p * self.probe for p in range(PROBES)])


def distinct_pairs(h: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((other, h))
    h, other = h[by], other[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (other[1:] != other[:-1])
    return h[new], other[new]


def _seen(least: int, layout: Filter, most: int):
    """(chunk, once, twice): slots within the chunk as little-endian 16-bit numbers, of one document and of two or more."""

    def packed(held: list[tuple[np.ndarray, np.ndarray]]):
        h, _ = distinct_pairs(*map(np.concatenate, zip(*held, strict=True)))
        h, n = np.unique(h, return_counts=True)
        single, double = np.unique(layout.slots(h)), np.unique(layout.slots(h[n > 1]))
        numbers, edge = np.unique(single // layout.chunk, return_index=True)
        edge = np.append(edge, len(single))
        both = np.append(np.searchsorted(double // layout.chunk, numbers), len(double))
        low16 = lambda x, at: pa.array([(x[a:b] % layout.chunk).astype("<u2").tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
        return pa.record_batch([pa.array(numbers.astype(np.int32)), low16(single, edge), low16(double, both)], ["chunk", "once", "twice"])

    def run(batches):
        held, total = [], 0
        for whole in batches:
            for batch in slices(whole):
                lines = KeyLines(batch.column("text"), SPACE)
                ids = np.asarray(batch.column("doc_id"))[lines.doc]
                use = lines.length >= least
                # One key of one document counts once, in however many rows and lines.
                held.append(distinct_pairs(lines.hash[use], ids[use]))
                total += len(held[-1][0])
                if total >= most:
                    yield packed(held)
                    held, total = [], 0
        if total:
            yield packed(held)

    return run


def _merge(bits: int):
    """For rows of ``_seen`` in order of their chunk: one row per chunk with the bits of the slots that were seen twice."""

    def run(batches):
        chunk, once, twice = None, None, None

        def done():
            some = chunk is not None and bool(twice.any())
            return pa.record_batch([pa.array([chunk] * some, pa.int32()), pa.array([np.packbits(twice, bitorder="little").tobytes()] if some else [], pa.binary())], ["chunk", "bits"])

        for batch in batches:
            for number, a, b in zip(batch.column("chunk").to_pylist(), batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
                if number != chunk:
                    yield done()
                    chunk, once, twice = number, np.zeros(bits, bool), np.zeros(bits, bool)
                slots = np.frombuffer(a, "<u2")
                twice[slots[once[slots]]] = True
                once[slots] = True
                twice[np.frombuffer(b, "<u2")] = True
        yield done()

    return run


class TwiceSeen:
    """The twice-seen filter; only chunks with a set bit are held."""

    def __init__(self, layout: Filter, chunks: np.ndarray, bits: list[bytes]):
        self.layout = layout
        self.row = np.full(PROBES * layout.probe // layout.chunk, -1, np.int32)
        self.row[chunks] = np.arange(len(chunks))
        self.bits = np.frombuffer(b"".join([*bits, bytes(layout.chunk // 8)]), np.uint8).reshape(-1, layout.chunk // 8)

    def suspects(self, h: np.ndarray) -> np.ndarray:
        slots = self.layout.slots(h).reshape(PROBES, -1)
        low = slots % self.layout.chunk
        return ((self.bits[self.row[slots // self.layout.chunk], low >> 3] >> (low & 7)) & 1 != 0).all(axis=0)


def twice_seen(named: DataFrame, least: int) -> TwiceSeen:
    """The twice-seen filter of all keys of (doc_id, text); the once-seen one is needed for the merge alone."""
    layout = Filter(PROBE_BITS, CHUNK_BITS)
    parts = named.mapInArrow(_seen(least, layout, HELD), "chunk int, once binary, twice binary")
    chunks = parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_merge(CHUNK_BITS), "chunk int, bits binary").toArrow()
    return TwiceSeen(layout, chunks["chunk"].to_numpy(), chunks["bits"].to_pylist())


def _suspected(seen, least: int):
    """(key, h, doc_id) of suspected lines, a key once per text."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                lines = KeyLines(batch.column("text"), SPACE)
                use = np.flatnonzero((lines.length >= least) & seen.value.suspects(lines.hash))
                by = np.lexsort((use, lines.hash[use], lines.doc[use]))
                use = use[by]
                new = np.ones(len(use), bool)
                new[1:] = (lines.hash[use[1:]] != lines.hash[use[:-1]]) | (lines.doc[use[1:]] != lines.doc[use[:-1]])
                use = use[new]
                ids = np.asarray(batch.column("doc_id"))[lines.doc[use]]
                yield pa.record_batch([pa.array([lines.key(i) for i in use], pa.binary()), pa.array(lines.hash[use].view(np.int64)), pa.array(ids)], ["key", "h", "doc_id"])

    return run


def _kept(seen, least: int, judged: bool):
    """n_lines, n_dropped, kept of texts; ``keeps`` lists the suspected keys that stay (none without the column)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                lines = KeyLines(batch.column("text"), SPACE)
                keep = np.ones(len(lines.hash), bool)
                if judged:
                    use = np.flatnonzero((lines.length >= least) & seen.value.suspects(lines.hash))
                    keep[use] = False
                    if "keeps" in batch.schema.names:
                        lists = batch.column("keeps")
                        row = np.repeat(np.arange(batch.num_rows), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
                        listed = {*zip(row.tolist(), np.asarray(lists.flatten()).tolist(), strict=True)}
                        mine = zip(lines.doc[use].tolist(), lines.hash[use].view(np.int64).tolist(), strict=True)
                        keep[use] = [x in listed for x in mine]
                texts = [lines.kept(i, keep) for i in range(batch.num_rows)]
                edges = lines.first
                n = np.diff(edges)
                left = np.diff(np.concatenate([[0], np.cumsum(keep)])[edges])
                yield pa.record_batch([batch.column("doc_id"), pa.array(n.astype(np.int64)), pa.array((n - left).astype(np.int64)), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept"])

    return run


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (the text without the dropped lines) for each input row.

    A line's key is the line stripped of ASCII white space, A-Z in lower case.
    A key of ``least`` code points or more that documents with two or more ids
    hold stays in the one with the smallest id, in all its lines and rows, and
    goes from the others.  A null or empty text is one empty line.  A row
    without id keeps its lines and doesn't count; repeated rows are judged
    each, and share their id's lines.  Other columns are never read.  Keys are
    confirmed whole; a text's own lines are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = texts.filter("doc_id is not null")
    seen = spark.sparkContext.broadcast(twice_seen(named, least))
    held = named.mapInArrow(_suspected(seen, least), "key binary, h long, doc_id long")
    firsts = held.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("h").alias("h"))
    keeps = cut(firsts.groupBy("doc_id").agg(F.collect_list("h").alias("keeps")), "keeps")
    bits = node_filter(keeps, "doc_id")
    kind = "doc_id long, n_lines long, n_dropped long, kept string"
    first = named.mapInArrow(only(bits, "doc_id"), named.schema).join(keeps, "doc_id", "left").select("doc_id", "text", "keeps")
    others = named.mapInArrow(only(bits, "doc_id", passing=False), named.schema)
    done = first.mapInArrow(_kept(seen, least, True), kind).unionAll(others.mapInArrow(_kept(seen, least, True), kind))
    return done.unionAll(texts.filter("doc_id is null").mapInArrow(_kept(None, least, False), kind))


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    found = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_LOWER = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (SELECT rid, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS MATERIALIZED (SELECT rid, doc_id, line, i, regexp_replace({_LOWER}, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE doc_id IS NOT NULL AND length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
g AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (first < doc_id) AS n_dropped, string_agg(line, chr(10) ORDER BY i) FILTER (coalesce(first = doc_id, TRUE) OR doc_id IS NULL) AS kept FROM k LEFT JOIN f USING (key) GROUP BY rid)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN g USING (rid)"""
