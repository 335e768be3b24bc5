"""Exact removal of long repeated word sequences by a compacted De Bruijn graph.

Edges are token k-mers (windows of ``k`` words).  They are not shuffled one by
one: all consecutive windows of a text that share a minimizer (the smallest
hash among their ``M``-word parts) form one block, a path that is stored once.

1. Minimizers that occur in two texts or more are found by a pre-aggregated
   count; other windows cannot repeat.  Equal texts are one text throughout.
2. Texts with such minimizers give their blocks: hash, source coordinates,
   next block.  Blocks are grouped; each learns the smallest document that has
   it, with the coordinates there.
3. A block that always follows one and the same block, which is always followed
   by it, is inside a nonbranching path.  A self-join of the block table finds
   these links, and joins by pointer doubling compact each path to its first
   block.  Only that block gives spans, as long as its path.
4. Blocks that differ but share a minimizer may share single windows.  Those
   windows, of one text per distinct block, are compared on their own, and
   neighbours with neighbouring sources are compacted to one span.
5. Every span names a place in its source document.  The words there are read
   and digested; a span is cut only if the text's own words give that digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.llm.common import cut, discard, node_filter, only, passes, table
from talliver.llm.textkernels import SPACE, Words, mix, slices, windows

#: Words of a minimizer.
M = 5
#: Texts that a task remembers, so as not to send exact copies twice.
REMEMBERED = 1 << 20
_TOP = np.uint64(2**64 - 1)


def _minimizers(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window hash, index of its first word, its minimizer) for all windows of a batch."""
    h, at = windows(words, k)
    part = np.full(len(words.hash), _TOP, np.uint64)
    sub, sub_at = windows(words, M)
    part[sub_at] = sub
    small = part[at]
    for j in range(1, k - M + 1):
        small = np.minimum(small, part[at + j])
    return h, at, small


def _info():
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                counts, hashes = [], []
                for text in batch.column("text"):
                    words = (text.as_py() or "").encode().split()
                    counts.append(len(words))
                    hashes.append(hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.record_batch([batch.column("id"), batch.column("fp"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string())], ["id", "fp", "n_words", "sha"])

    return run


def _posted(k: int, shared=None):
    """The minimizers of each text; with a filter, those that pass it."""

    def run(batches):
        seen: set[int] = set()
        for whole in batches:
            for batch in slices(whole):
                fps = batch.column("fp").to_pylist()
                if len(seen) >= REMEMBERED:
                    seen.clear()
                fresh = [i for i, fp in enumerate(fps) if fp not in seen and not seen.add(fp)]
                batch = batch.take(pa.array(fresh, pa.int64()))
                words = Words(batch.column("text"), SPACE, lower=False)
                _, at, small = _minimizers(words, k)
                if not len(at):
                    continue
                doc = words.doc[at]
                new = np.ones(len(at), bool)
                new[1:] = (small[1:] != small[:-1]) | (doc[1:] != doc[:-1])
                small, doc = small[new], doc[new]
                by = np.lexsort((small, doc))  # a minimizer once per text
                small, doc = small[by], doc[by]
                new = np.ones(len(doc), bool)
                new[1:] = (small[1:] != small[:-1]) | (doc[1:] != doc[:-1])
                small, doc = small[new].view(np.int64), doc[new]
                if shared is not None:
                    use = passes(shared.value, small)
                    small, doc = small[use], doc[use]
                yield pa.record_batch([pa.array(small), pa.array(np.asarray(batch.column("fp"))[doc])], ["m", "fp"])

    return run


def _blocks(k: int):
    """Blocks of the windows whose minimizer is in the row's list ``ms``."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                words = Words(batch.column("text"), SPACE, lower=False)
                h, at, small = _minimizers(words, k)
                doc = words.doc[at]
                ids, fps = np.asarray(batch.column("id")), np.asarray(batch.column("fp"))
                edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                cols: dict[str, list] = {c: [] for c in ("m", "bh", "id", "fp", "s", "nw", "nb", "hs")}
                for i in range(batch.num_rows):
                    lo, hi = edges[i], edges[i + 1]
                    ms = np.sort(np.frombuffer(batch.column("ms")[i].values.buffers()[1], np.int64)[batch.column("ms")[i].values.offset :][: len(batch.column("ms")[i])].view(np.uint64))
                    mine = small[lo:hi]
                    hit = ms[np.minimum(np.searchsorted(ms, mine), len(ms) - 1)] == mine
                    if not hit.any():
                        continue
                    new = np.ones(hi - lo, bool)
                    new[1:] = mine[1:] != mine[:-1]
                    first = np.flatnonzero(new)
                    length = np.diff(np.append(first, hi - lo))
                    own = h[lo:hi]
                    up = np.arange(hi - lo, dtype=np.uint64) - np.repeat(first, length).astype(np.uint64)
                    with np.errstate(over="ignore"):
                        bh = mix(np.add.reduceat(own * (up * np.uint64(2) + np.uint64(1)), first) + length.astype(np.uint64))
                    follow = np.zeros(len(first), np.uint64)
                    follow[:-1] = np.where(hit[first[1:]], bh[1:], 0)
                    use = np.flatnonzero(hit[first])
                    cols["m"].append(mine[first[use]].view(np.int64))
                    cols["bh"].append(bh[use].view(np.int64))
                    cols["id"].append(np.full(len(use), ids[i], np.int64))
                    cols["fp"].append(np.full(len(use), fps[i], np.int64))
                    cols["s"].append((at[lo + first[use]] - words.first[i]).astype(np.int32))
                    cols["nw"].append(length[use].astype(np.int32))
                    cols["nb"].append(follow[use].view(np.int64))
                    cols["hs"].append([own[a : a + n].tobytes() for a, n in zip(first[use], length[use], strict=True)])
                if cols["m"]:
                    yield pa.record_batch([pa.array(np.concatenate(v)) if c != "hs" else pa.array([x for y in v for x in y], pa.binary()) for c, v in cols.items()], list(cols))

    return run


def _windows_of():
    def run(batches):
        for batch in batches:
            hs = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("hs")]
            if not hs:
                continue
            n = [len(x) for x in hs]
            pos = np.concatenate([np.arange(x, dtype=np.int32) for x in n]) + np.repeat(np.asarray(batch.column("s")), n)
            yield pa.record_batch([pa.array(np.concatenate(hs)), pa.array(np.repeat(np.asarray(batch.column("id")), n)), pa.array(np.repeat(np.asarray(batch.column("fp")), n)), pa.array(pos.astype(np.int32))], ["h", "id", "fp", "s"])

    return run


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _source_words():
    """(src_fp, src_s, n, digest) of the places that the row's list ``wants``."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                fps, starts, sizes, digests = [], [], [], []
                for fp, text, wants in zip(batch.column("fp").to_pylist(), batch.column("text"), batch.column("wants").to_pylist(), strict=True):
                    words = text.as_py().encode().split()
                    for w in wants:
                        fps.append(fp)
                        starts.append(w["s"])
                        sizes.append(w["n"])
                        digests.append(_digest(words[w["s"] : w["s"] + w["n"]]))
                yield pa.record_batch([pa.array(fps, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary())], ["src_fp", "src_s", "n", "digest"])

    return run


def _kept():
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                removed, hashes, texts = [], [], []
                for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                    words = text.as_py().encode().split()
                    gone = np.zeros(len(words) + 1, np.int64)
                    for s in spans:
                        if _digest(words[s["s"] : s["s"] + s["n"]]) == s["digest"]:
                            gone[s["s"]] += 1
                            gone[s["s"] + s["n"]] -= 1
                    keep = np.cumsum(gone)[:-1] == 0
                    left = b" ".join([w for w, ok in zip(words, keep.tolist(), strict=True) if ok])
                    removed.append(len(words) - int(keep.sum()))
                    hashes.append(hashlib.sha256(left).hexdigest())
                    texts.append(left.decode())
                yield pa.record_batch([batch.column("id"), batch.column("fp"), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], ["id", "fp", "cut_words", "cut_sha", "kept"])

    return run


def compact_paths(blocks: DataFrame) -> DataFrame:
    """(bh, src, path): blocks that occur twice or more, their first occurrence (id, fp, s), and the windows of
    the nonbranching path that begins with them; null inside a path.

    Along a path every occurrence of a block is followed by the next block and
    counts are equal, so all occurrences of the first block begin whole paths.
    The source must run on as well, which also breaks cycles.
    """
    graph = blocks.groupBy("bh").agg(F.min(F.struct("id", "fp", "s")).alias("src"), F.count("*").alias("c"), F.min("nb").alias("n0"), F.max("nb").alias("n1"), F.first("nw").alias("nw"))
    graph = cut(graph.filter("c > 1"), "graph")
    before = graph.filter("n0 = n1 and n0 <> 0").select(F.col("n0").alias("bh"), "c", F.col("bh").alias("up"), F.col("src").alias("up_src"), F.col("nw").alias("off"))
    runs_on = "up_src.id = src.id and up_src.fp = src.fp and up_src.s + off = src.s"
    inner = graph.select("bh", "c", "src", "nw").join(before, ["bh", "c"]).filter(runs_on)
    links = cut(inner.select("bh", "up", "off", "nw"), "links")
    while True:
        above = links.select(F.col("bh").alias("up"), F.col("up").alias("top"), F.col("off").alias("more"))
        step = links.join(above, "up", "left").select("bh", F.coalesce("top", "up").alias("up"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), "nw", F.col("top").isNotNull().alias("moved"))
        step = cut(step, "links")
        discard(links)
        links = step
        if not links.filter("moved").take(1):
            break
    reach = links.groupBy(F.col("up").alias("bh")).agg(F.max(F.col("off") + F.col("nw")).cast("int").alias("reach"))
    inside = links.select("bh", F.lit(True).alias("inside"))
    paths = graph.select("bh", "src", "nw").join(reach, "bh", "left").join(inside, "bh", "left")
    paths = cut(paths.select("bh", "src", F.when(F.col("inside").isNull(), F.coalesce("reach", "nw")).alias("path")), "paths")
    discard(graph, links)
    return paths


def repeated_spans(texts: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(id, fp, s, n, src_fp, src_s): runs of n words of distinct texts whose windows all start in a smaller document, and a place where they do.

    ``texts`` has id, fp, text; ``reps`` the smallest id of each fp.
    """
    counted = texts.select("fp", "text").mapInArrow(_posted(k), "m long, fp long")
    shared = cut(counted.groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").select("m"), "shared")
    bits = node_filter(shared, "m")
    rows = texts.select("fp", "text").mapInArrow(_posted(k, bits), "m long, fp long")
    hits = rows.join(shared, "m").distinct().groupBy("fp").agg(F.collect_set("m").alias("ms"))
    hits = cut(hits.join(reps, "fp"), "hits")
    bits.destroy()
    found = texts.mapInArrow(only(node_filter(hits, "id"), "id"), texts.schema).join(hits, ["fp", "id"]).select("id", "fp", "text", "ms")
    blocks = cut(found.mapInArrow(_blocks(k), "m long, bh long, id long, fp long, s int, nw int, nb long, hs binary"), "blocks")
    discard(shared, hits)
    paths = compact_paths(blocks)
    whole = blocks.select("bh", "id", "fp", "s").join(paths.filter("path is not null"), "bh").filter("src.id < id")
    whole = whole.select("id", "fp", "s", (F.col("path") + k - 1).alias("n"), F.col("src.fp").alias("src_fp"), F.col("src.s").alias("src_s"))

    forks = cut(blocks.select("m", "bh").distinct().groupBy("m").agg(F.count("*").alias("c")).filter("c > 1").select("m"), "forks")
    single = blocks.select("m", "bh", "id", "fp", "s", "hs").join(forks, "m").join(paths.select("bh", F.col("src.id").alias("src_id")), "bh", "left").filter("coalesce(src_id, id) >= id")
    single = cut(single.select("hs", "id", "fp", "s").mapInArrow(_windows_of(), "h long, id long, fp long, s int"), "single")
    least = cut(single.groupBy("h").agg(F.min(F.struct("id", "fp", "s")).alias("src"), F.max("id").alias("hi")).filter("src.id < hi").drop("hi"), "least")
    single = single.join(least, "h").filter("src.id < id").select("id", "fp", "s", F.col("src.fp").alias("src_fp"), (F.col("s") - F.col("src.s")).alias("shift"))
    # Windows that follow each other in the text and in one source; a group is part of one text.
    place = F.dense_rank().over(Window.partitionBy("id", "fp", "src_fp", "shift").orderBy("s"))
    single = single.withColumn("run", F.col("s") - place).groupBy("id", "fp", "src_fp", "shift", "run").agg(F.min("s").alias("s"), F.max("s").alias("last"))
    single = single.select("id", "fp", "s", (F.col("last") - F.col("s") + k).alias("n"), "src_fp", (F.col("s") - F.col("shift")).alias("src_s"))
    return cut(whole.union(single), "runs")


def verified_spans(texts: DataFrame, reps: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, fp, spans): the runs of each text with the digest of the words at their source."""
    wants = runs.select(F.col("src_fp").alias("fp"), F.col("src_s").alias("s"), "n").distinct().groupBy("fp").agg(F.collect_list(F.struct("s", "n")).alias("wants"))
    wants = cut(wants.join(reps, "fp"), "wants")
    sources = texts.mapInArrow(only(node_filter(wants, "id"), "id"), texts.schema).join(wants, ["fp", "id"]).dropDuplicates(["fp", "id"])
    digests = cut(sources.select("fp", "text", "wants").mapInArrow(_source_words(), "src_fp long, src_s int, n int, digest binary"), "digests")
    spans = runs.join(digests, ["src_fp", "src_s", "n"]).groupBy("id", "fp").agg(F.collect_list(F.struct("s", "n", "digest")).alias("spans"))
    return cut(spans, "spans")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, kept (null where nothing or everything went).

    A null text has no words; texts shorter than ``k`` words stay.  Of equal
    texts only the one with the smallest id can keep words; rows that share an
    id do not remove each other.  A row whose id is null keeps its words.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"))
    info = cut(texts.mapInArrow(_info(), "id long, fp long, n_words long, sha string"), "info")
    reps = cut(info.filter(F.col("n_words") >= k).groupBy("fp").agg(F.min("id").alias("id")).dropna(), "reps")
    spans = verified_spans(texts, reps, repeated_spans(texts, reps, k))
    some = texts.mapInArrow(only(node_filter(spans, "id"), "id"), texts.schema)
    done = some.join(spans, ["fp", "id"]).dropDuplicates(["fp", "id"]).select("id", "fp", "text", "spans").mapInArrow(_kept(), "id long, fp long, cut_words long, cut_sha string, kept string")
    out = info.join(reps.withColumnRenamed("id", "rep"), "fp", "left").join(done, ["fp", "id"], "left")
    gone = (F.col("n_words") >= k) & (F.col("rep") < F.col("id"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("cut_words", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        F.when(~F.coalesce(gone, F.lit(False)), F.col("kept")).alias("kept"),
    )


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
