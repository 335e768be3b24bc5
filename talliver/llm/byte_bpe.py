"""Byte-level BPE encoding and decoding with overlapping chunks.

A text is cut into chunks that overlap.  Chunks are pre-tokenised in
parallel, as rows of their own; where two neighbours agree on a pre-token
boundary in their overlap, the later one has resynchronised, and the text is
split there into pieces.  A boundary is used only if the earlier chunk was
itself in step.  Where an overlap holds no common boundary, the two chunks stay
one piece.  Pieces are encoded, ids are joined in order, and decoding joins the
raw bytes of the ids.  A text of one chunk is one piece.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.llm.common import cut, table
from talliver.llm.textkernels import slices

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Code points of a chunk, and of the part that it shares with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: A boundary so close to a chunk's end may hang on text that the chunk lacks.
MARGIN = 8


#: Characters without a change between blank and other ones from which on a text is pre-tokenised here.
RUN = 1 << 14
LONG_RUN = regex.compile(rf"\s{{{RUN}}}|\S{{{RUN}}}")


@cache
def ranks_of(path: str) -> dict[bytes, int]:
    """A rank file's tokens; ``path`` must be readable on every executor."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@cache
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Where pre-tokens of ``text`` end."""
    return [m.end() for m in regex.finditer(pattern, text)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of the lowest rank is joined, leftmost first, until none has a rank."""
    n = len(piece)
    end, prev, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != stop:
            continue
        live[end[i]] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def ids_of(text: str, path: str, pattern: str) -> list[int]:
    """Ids of a text.  The library's matcher fails on runs of very many blanks; texts with long runs are pre-tokenised here."""
    enc = encoding(path, pattern)
    if len(text) <= RUN or not LONG_RUN.search(text):
        return enc.encode_ordinary(text)
    out: list[int] = []
    for m in regex.finditer(pattern, text):
        out += enc.encode_ordinary(m[0]) if len(m[0]) <= RUN else merged(m[0].encode(), ranks_of(path))
    return out


def _edges(pattern: str, overlap: int, chunk: int):
    """Boundaries of a chunk inside the part shared with the previous (head) and with the next one (tail)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                heads, tails = [], []
                for text in batch.column("text").to_pylist():
                    found = boundaries(text, pattern)
                    heads.append([x for x in found if x <= overlap])
                    tails.append([x - chunk for x in found if chunk < x <= len(text) - MARGIN])
                yield pa.record_batch([*[batch.column(c) for c in ("fp", "i", "text")], pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["fp", "i", "text", "head", "tail"])

    return run


def _encode(path: str, pattern: str):
    def run(batches):
        enc = encoding(path, pattern)
        for whole in batches:
            for batch in slices(whole):
                ids, raw = [], []
                for text in batch.column("text").to_pylist():
                    got = ids_of(text or "", path, pattern)
                    ids.append(np.array(got, "<u4").tobytes())
                    raw.append(enc.decode_bytes(got))
                keep = [c for c in batch.schema.names if c != "text"]
                yield pa.record_batch([*[batch.column(c) for c in keep], pa.array(ids, pa.binary()), pa.array(raw, pa.binary())], [*keep, "ids", "raw"])

    return run


def _digest(path: str, pattern: str):
    def run(batches):
        enc = encoding(path, pattern)
        for whole in batches:
            for batch in slices(whole):
                n, a, b = [], [], []
                for text in batch.column("text").to_pylist():
                    got = ids_of(text or "", path, pattern)
                    n.append(len(got))
                    a.append(hashlib.sha256(np.array(got, "<u4").tobytes()).hexdigest())
                    b.append(hashlib.sha256(enc.decode_bytes(got)).hexdigest())
                yield pa.record_batch([batch.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def pieces(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(fp, at, text): the long texts of (fp, text) in pieces that can be encoded on their own."""
    n_chunks = F.greatest(F.lit(1), F.ceil((F.char_length("text") - overlap) / chunk)).cast("int")
    cuts = texts.select("fp", F.posexplode(F.transform(F.sequence(F.lit(0), n_chunks - 1), lambda i: F.substring("text", i * chunk + 1, chunk + overlap))).alias("i", "text"))
    cuts = cuts.repartition("fp", "i").mapInArrow(_edges(pattern, overlap, chunk), "fp long, i int, text string, head array<int>, tail array<int>")
    near = Window.partitionBy("fp").orderBy("i")
    # Only boundary lists and lengths are sorted by text; the chunks' own texts join them again.
    cuts = cut(cuts, "chunks")
    lists = cuts.select("fp", "i", "head", F.lag("tail").over(near).alias("before"))
    lists = lists.withColumn("sync", F.when(F.col("i") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "before"))))
    # After a chunk that found no common boundary nothing later is trusted: the rest of the text is one piece.
    lists = lists.withColumn("sync", F.when(F.max(F.col("sync").isNull()).over(near), None).otherwise(F.col("sync")))
    lists = lists.withColumn("at", F.count("sync").over(near))
    parts = cuts.select("fp", "i", "text").join(lists.select("fp", "i", "sync", "at"), ["fp", "i"])
    last = F.max("i").over(Window.partitionBy("fp"))
    own = F.when(F.col("i") == F.col("last"), F.col("text")).otherwise(F.substring("text", 1, chunk))
    parts = parts.withColumn("last", last).withColumn("own", own)
    sync = F.coalesce("sync", F.lit(0))
    head = F.struct((F.col("at") - F.when(F.col("sync").isNull(), 0).otherwise(1)).alias("at"), F.substring("own", F.lit(1), sync).alias("t"))
    rest = F.struct(F.col("at"), F.expr("substring(own, coalesce(sync, 0) + 1)").alias("t"))
    parts = parts.select("fp", "i", F.explode(F.array(head, rest)).alias("p")).filter("p.t <> ''")
    return parts.groupBy("fp", F.col("p.at").alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p.t"))), lambda x: x["t"]), "").alias("text"))


def token_rows(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of (id, text), the short texts in one go, the long ones by pieces."""
    small = F.coalesce(F.octet_length("text"), F.lit(0)) <= chunk + overlap
    short = texts.filter(small).mapInArrow(_digest(path, pattern), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    keyed = texts.filter(~small).select("id", F.xxhash64("text").alias("fp"), "text")
    long = _joined(keyed, path, pattern, chunk, overlap).select("id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
    return short.union(long)


def _joined(keyed: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(id, n_tokens, ids, raw) of long texts (id, fp, text), a row per input row; equal texts are encoded once."""
    once = keyed.groupBy("fp").agg(F.first("text").alias("text"))
    done = pieces(once, pattern, chunk, overlap).mapInArrow(_encode(path, pattern), "fp long, at long, ids binary, raw binary")
    done = done.groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("at", "ids", "raw"))).alias("p"))
    glue = lambda c: F.aggregate(F.transform("p", lambda x: x[c]), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
    done = cut(done.select("fp", glue("ids").alias("ids"), glue("raw").alias("raw")), "encoded")
    return keyed.select("id", "fp").join(done, "fp").select("id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "raw")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids, raw): ids as little-endian uint32 bytes and the decoded bytes, a row per input row; null is empty."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    small = F.octet_length("text") <= chunk + overlap
    short = texts.filter(small).mapInArrow(_encode(path, pattern), "id long, ids binary, raw binary")
    short = short.select("id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "raw")
    long = _joined(texts.filter(~small).select("id", F.xxhash64("text").alias("fp"), "text"), path, pattern, chunk, overlap)
    return short.union(long).withColumnRenamed("id", "doc_id")


def decode(encoded: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); bytes that are no UTF-8 become replacement characters; null ids give null."""

    def run(batches):
        enc = encoding(path, pattern)
        for batch in batches:
            out = [None if x is None else enc.decode_bytes(np.frombuffer(x, "<u4").tolist()).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, pattern: str = public_tokenizers.PATTERN, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``encode`` without its bytes: doc_id, n_tokens, ids_sha256, decoded_sha256, a row per input row; null is empty."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return token_rows(texts, path, pattern, chunk, overlap).withColumnRenamed("id", "doc_id")


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))
