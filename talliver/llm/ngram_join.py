"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact check.

1. Every text becomes a sorted array of 64-bit shingle hashes; equal arrays
   form one class (a node), so exact copies never meet each other again.
2. A node posts its rarest shingles (prefix filter): two sets that reach the
   threshold share a posted one.  Rare means: not among the frequent shingles
   that some task saw often; the order changes the cost only, never the result.
3. Candidates.  Nodes of a shingle that few post are paired, each pair once.
   Nodes of a wide shingle are paired with a leader of their size band; those
   that are still apart then meet in size-banded tiles of bounded size.  A pair
   stays if the bit counts of its parity bitmaps, which bound its overlap from
   above, allow the threshold.  Only the groups that candidates connect go on,
   and a tile reports no more edges than it has nodes.
4. Groups.  Every link lies within a group.  The nodes of a group meet once, in
   a tile of their own or, if there are many, in size-banded tiles of blocks.
   What the bitmaps leave there is verified by intersecting the sorted arrays.
   A tile adds up the links of each node and reports edges that connect what
   its links connect, so its output is linear in its nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliver.llm.common import cut, discard, node_filter, passes, table
from talliver.llm.graph import connected_components
from talliver.llm.textkernels import SPACE, Words, sequence_hash, slices, trim, windows

#: Order of posted shingles only: at most so many frequent shingles are ranked, and so often a task must see one.
FREQUENT, SEEN = 500_000, 3
#: Counts from here on are one step of their histogram.
STEPS = 1 << 15
#: Tokens that a task counts at once when it looks for frequent shingles.
COUNTED = 500_000
#: Nodes that a task remembers, so as not to send exact copies twice.
REMEMBERED = 1 << 20
#: A shingle that more nodes post is wide.
WIDE = 16
#: How often (at least once) the nodes of a wide shingle are paired with a leader; each round joins what the one before left apart.
ROUNDS = 2
#: Nodes and shingles on one side of a tile.
TILE, TILE_TOKENS = 1024, 1 << 20
#: Bits of a signature: four a shingle up to this many.
MOST_BITS = 1 << 13

def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); fewer words than k are one shingle, none give an empty set."""
    words = Words(batch.column("text"), SPACE, lower=True)
    hashes, _ = windows(words, k)
    counts = words.counts()
    ends = np.cumsum(np.maximum(counts - k + 1, 0))
    for i, n in enumerate(counts):
        if n >= k:
            yield i, np.unique(hashes[ends[i] - (n - k + 1) : ends[i]])
        elif n:
            yield i, np.array([sequence_hash(words.hash[words.first[i] : words.first[i] + n])], np.uint64)
        else:
            yield i, np.zeros(0, np.uint64)


def node_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def bits_of(n: int) -> int:
    """Bits of the signature of n values: a power of two, at least four a value, but no more than MOST_BITS."""
    return min(MOST_BITS, max(64, 1 << max(4 * n - 1, 0).bit_length()))


def signature(tokens: np.ndarray, m: int | None = None) -> bytes:
    """Parity bitmap: bit h mod m flips for each h."""
    m = m or bits_of(len(tokens))
    odd = np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(signatures: list[bytes], size: int) -> np.ndarray:
    """Signatures as rows of uint64, folded to ``size`` bytes; folding keeps parity."""
    out = np.zeros((len(signatures), size // 8), np.uint64)
    for i, s in enumerate(signatures):
        a = np.frombuffer(s, np.uint64)
        out[i] = np.bitwise_xor.reduce(a.reshape(-1, size // 8), axis=0)
    return out


def _profile(k: int):
    def run(batches):
        seen: set[int] = set()
        waiting: list[np.ndarray] = []
        total = 0

        def frequent():
            tokens, counts = np.unique(np.concatenate(waiting), return_counts=True)
            often = counts >= SEEN
            n = int(often.sum())
            zeros = np.zeros(n, np.int64)
            return pa.record_batch([pa.array(np.ones(n, np.int32)), pa.array(zeros), pa.array(zeros), pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64)), pa.array([b""] * n, pa.binary())], PROFILE.names)

        for whole in batches:
            for batch in slices(whole):
                nodes, sizes, bits = [], [], []
                for _, tokens in shingle_sets(batch, k):
                    nodes.append(node := node_of(tokens))
                    sizes.append(len(tokens))
                    bits.append(signature(tokens))
                    if len(tokens) and node not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(node)
                        waiting.append(tokens)
                        total += len(tokens)
                n = len(nodes)
                yield pa.record_batch([pa.array(np.zeros(n, np.int32)), batch.column("id").cast(pa.int64()), batch.column("text_key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], PROFILE.names)
                if total >= COUNTED:
                    yield frequent()
                    waiting, total = [], 0
        if waiting:
            yield frequent()

    return run


PROFILE = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])


def _rarest(tokens: np.ndarray, probe: int, weights) -> np.ndarray:
    """The first ``probe`` tokens by (weight, token); ``tokens`` are sorted."""
    weight = weights(tokens)
    rare = tokens[weight == 0]
    if len(rare) >= probe:
        return rare[:probe]
    common = np.flatnonzero(weight)
    return np.concatenate([rare, tokens[common[np.argsort(weight[common], kind="stable")]]])[:probe]


def _weights(known: np.ndarray, counts: np.ndarray):
    """A function from tokens to their counts, 0 if unknown; a bit table answers for most unknown ones."""
    mask = np.uint64((1 << 24) - 1)
    table = np.zeros(1 << 24, bool)
    table[(known & mask).astype(np.int64)] = True

    def of(tokens: np.ndarray) -> np.ndarray:
        out = np.zeros(len(tokens), np.int64)
        maybe = np.flatnonzero(table[(tokens & mask).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(known, tokens[maybe]), len(known) - 1)
            out[maybe] = np.where(known[at] == tokens[maybe], counts[at], 0)
        return out

    return of


def _posted_by(batches, k: int, num: int, den: int, weights) -> Iterator[list[tuple[np.ndarray, int, int, int]]]:
    """(posted shingles, node, n, length of the index prefix) of the nodes of each slice."""
    seen: set[int] = set()
    for whole in batches:
        for batch in slices(whole):
            parts = []
            for _, tokens in shingle_sets(batch, k):
                n = len(tokens)
                if not n or (node := node_of(tokens)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                probe = n - -(-num * n // den) + 1
                index = n - -(-2 * num * n // (num + den)) + 1
                parts.append((_rarest(tokens, probe, weights), node, n, index))
            if parts:
                yield parts


def _tokens(k: int, num: int, den: int, order):
    """The posted shingles alone."""

    def run(batches):
        for parts in _posted_by(batches, k, num, den, _weights(*order.value)):
            yield pa.record_batch([pa.array(np.concatenate([p[0] for p in parts]).view(np.int64))], ["token"])

    return run


def _postings(k: int, num: int, den: int, order, shared):
    """The posted shingles of each node that pass the filter ``shared``; ``small``: in the prefix that meets larger sets."""

    def run(batches):
        bits = shared.value
        for parts in _posted_by(batches, k, num, den, _weights(*order.value)):
            lens = [len(p[0]) for p in parts]
            token = np.concatenate([p[0] for p in parts]).view(np.int64)
            use = passes(bits, token)
            small = np.concatenate([np.arange(len(p[0])) < p[3] for p in parts])
            node, n = (np.repeat(np.array([p[c] for p in parts], np.int64), lens) for c in (1, 2))
            yield pa.record_batch([pa.array(token[use]), pa.array(node[use]), pa.array(n[use].astype(np.int32)), pa.array(small[use])], ["token", "node", "n", "small"])

    return run


def may_reach(n, m, apart, num: int, den: int):
    """Whether sets of n and m values whose signatures differ in ``apart`` bits can reach the threshold."""
    return (num + den) * ((n + m - apart) // 2) >= num * (n + m)


def _bounded(num: int, den: int):
    """Keep the pairs whose overlap may reach the threshold by their bit counts."""

    def run(batches):
        for batch in batches:
            n, m = (np.asarray(batch.column(c)).astype(np.int64) for c in ("n_a", "n_b"))
            apart = np.zeros(len(n), np.int64)
            for r, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)):
                x, y = folded([x, y], min(len(x), len(y)))
                apart[r] = np.bitwise_count(x ^ y).sum()
            yield batch.filter(pa.array(may_reach(n, m, apart, num, den))).select(["a", "b"])

    return run


def _runs(batches, key: list[str], names: list[str]):
    """Sorted rows as columns (lists) of each run of equal keys."""
    at, rows = None, {c: [] for c in names}
    for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
        keys = list(zip(*[batch.column(c).to_pylist() for c in key], strict=True))
        cols = {c: batch.column(c).to_pylist() for c in names}
        start = 0
        for r in range(1, len(keys) + 1):
            if r < len(keys) and keys[r] == keys[start]:
                continue
            if keys[start] != at:
                if at is not None:
                    yield rows
                at, rows = keys[start], {c: [] for c in names}
            for c in names:
                rows[c] += cols[c][start:r]
            start = r
    if at is not None:
        yield rows


class Labels:
    """Components of the nodes of one tile; ``link`` notes one edge for each component that it adds."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        found, first = np.unique(self.label[others], return_index=True)
        own = self.label[i]
        add = found != own
        if add.any():
            self.edges += [(i, int(j)) for j in others[first[add]]]
            self.label[np.isin(self.label, found[add])] = own


def _smaller(n: np.ndarray, node: np.ndarray, i: int, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """The rows of ``right`` that are larger than row i (by n, then node), but not too large."""
    x, y = n[i], n[right]
    return ((x < y) | ((x == y) & (node[i] < node[right]))) & (den * x >= num * y)


def _token_tiles(num: int, den: int):
    """Each run of equal (token, band, i, j) is one tile; edges by which bit counts may connect its components."""

    def run(batches):
        for rows in _runs(batches, ["token", "band", "i", "j"], ["comp", "n", "node", "small", "lower", "bits"]):
            comp, n, node = (np.array(rows[c], np.int64) for c in ("comp", "n", "node"))
            lower = np.array(rows["lower"], bool)
            left, right = np.flatnonzero(lower & np.array(rows["small"], bool)), np.flatnonzero(~lower)
            if not len(left) or not len(right) or (comp == comp[0]).all():
                continue
            sig = folded(rows["bits"], min(len(x) for x in rows["bits"]))
            tile = Labels(np.unique(comp, return_inverse=True)[1])
            for i in left.tolist():
                js = right[_smaller(n, node, i, right, num, den) & (tile.label[right] != tile.label[i])]
                if len(js):
                    apart = np.bitwise_count(sig[js] ^ sig[i]).sum(axis=1, dtype=np.int64)
                    tile.link(i, js[may_reach(n[i], n[js], apart, num, den)])
            if tile.edges:
                a, b = node[np.array(tile.edges)].T
                yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _exact_sets(k: int, ids, wanted):
    """(node, tokens) of the nodes that pass ``wanted``; texts whose id doesn't pass ``ids`` hold none of them, those without id may."""

    def run(batches):
        bits, seen = wanted.value, set()
        for whole in batches:
            column = whole.column("id")
            whole = whole.filter(pa.array(passes(ids.value, np.asarray(column.fill_null(0))) | np.asarray(column.is_null())))
            for batch in slices(whole):
                nodes, sets = [], []
                for _, tokens in shingle_sets(batch, k):
                    node = node_of(tokens) if len(tokens) else None
                    if node is None or node in seen:
                        continue
                    if passes(bits, np.array([node]))[0]:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(node)
                        nodes.append(node)
                        sets.append(tokens.tobytes())
                if nodes:
                    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "tokens"])

    return run


def _limits(num: int, den: int) -> list[int]:
    """Size bands by integer limits: a set's partners, up to den/num times as large, are in its own band or the next."""
    limits = [1]
    while limits[-1] < 1 << 31:
        limits.append(den * limits[-1] // num + 1)
    return limits


def _band(limits: list[int]):
    return F.size(F.filter(F.lit(limits), lambda x: x <= F.col("n")))


def _dealt(rows: DataFrame, key: str, wide: bool) -> DataFrame:
    """Rows of (key, own, node, n, ...) as sides of tiles (key, band, i, j), each pair of near bands and blocks once.

    A row is on the lower side of its own band, and on the higher side of its
    own band and the one below.  Sides of at most TILE nodes (and, if ``wide``,
    TILE_TOKENS shingles) are one block.
    """
    roles = F.array(F.struct(F.lit(True).alias("lower"), F.col("own").alias("band")), *[F.struct(F.lit(False).alias("lower"), (F.col("own") - d).alias("band")) for d in range(2)])
    sides = rows.select("*", F.explode(roles).alias("role")).select("*", "role.*").drop("role")

    def blocks(side):
        nodes, tokens = F.count_if(side) / TILE, F.sum(F.when(side, F.col("n")).otherwise(0)) / TILE_TOKENS
        return F.ceil(F.greatest(nodes, tokens) if wide else nodes).cast("int")

    dealt = sides.groupBy(key, "band").agg(blocks(F.col("lower")).alias("n_low"), blocks(~F.col("lower")).alias("n_high")).filter("n_low > 0 and n_high > 0")
    low, high = (F.when(F.col("lower"), F.col(a)).otherwise(F.col(b)) for a, b in (("n_low", "n_high"), ("n_high", "n_low")))
    sides = sides.join(cut(dealt, "blocks"), [key, "band"]).withColumn("mine", F.pmod(F.xxhash64("node"), low).cast("int"))
    sides = sides.withColumn("other", F.explode(F.sequence(F.lit(0), high - 1)))
    i, j = (F.when(F.col("lower"), F.col(a)).otherwise(F.col(b)) for a, b in (("mine", "other"), ("other", "mine")))
    return sides.withColumns({"i": i, "j": j}).drop("mine", "other", "n_low", "n_high")


def common_counts(sets: list[np.ndarray]):
    """A function (i, rows) to the number of values that set i has in common with each of ``rows``."""
    size = np.array([len(x) for x in sets], np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    end = np.cumsum(size)
    mark = np.zeros(len(values), bool)

    def of(i: int, rows: np.ndarray) -> np.ndarray:
        own = at[end[i] - size[i] : end[i]]
        mark[own] = True
        total = size[rows].sum()
        where = np.arange(total) + np.repeat(end[rows] - size[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows])
        both = np.add.reduceat(mark[at[where]].astype(np.int64), np.cumsum(size[rows]) - size[rows])
        mark[own] = False
        return both

    return of


def _group_tiles(num: int, den: int, count: bool):
    """Each run of equal (comp, band, i, j) is one tile: (node a, links c) and edges (a, b) of what its links connect.

    ``lower`` is null for rows of both sides.  Without ``count``, pairs that
    are already connected are not looked at.
    """

    def run(batches):
        for rows in _runs(batches, ["comp", "band", "i", "j"], ["node", "weight", "lower", "tokens"]):
            left = np.array([r for r, x in enumerate(rows["lower"]) if x is not False])
            right = np.array([r for r, x in enumerate(rows["lower"]) if not x])
            if not len(left) or not len(right):
                continue
            node, weight = np.array(rows["node"], np.int64), np.array(rows["weight"], np.int64)
            sets = [np.frombuffer(x, np.uint64) for x in rows["tokens"]]
            n = np.array([len(x) for x in sets], np.int64)
            bits = bits_of(int(n.max()))
            sig = np.array([np.frombuffer(signature(x, bits), np.uint64) for x in sets])
            common, sums, tile = common_counts(sets), np.zeros(len(node), np.int64), Labels(np.arange(len(node)))
            same = rows["lower"][0] is not None  # a node may be on both sides; it is one row a side then
            if same:
                tile.label = np.unique(node, return_inverse=True)[1]
            for i in left.tolist():
                js = right[_smaller(n, node, i, right, num, den)]
                if not count:
                    js = js[tile.label[js] != tile.label[i]]
                if len(js):
                    apart = np.bitwise_count(sig[js] ^ sig[i]).sum(axis=1, dtype=np.int64)
                    js = js[may_reach(n[i], n[js], apart, num, den)]
                if len(js):
                    both = common(i, js)
                    js = js[den * both >= num * (n[i] + n[js] - both)]
                if len(js):
                    sums[i] += weight[js].sum()
                    sums[js] += weight[i]
                    tile.link(i, js)
            has = np.flatnonzero(sums)
            if len(has):
                a, b = node[np.array(tile.edges)].T
                none = pa.nulls(len(has), pa.int64())
                yield pa.record_batch([pa.array(node[has]), none, pa.array(sums[has])], ["a", "b", "c"])
                yield pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "c"])

    return run


def _candidates(members: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose bit counts allow the threshold, which connect all nodes that links connect."""
    near = lambda x, y: f"{den}L * least({x}.n, {y}.n) >= {num}L * greatest({x}.n, {y}.n)"
    used = cut(members.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token", (F.col("c") > WIDE).alias("wide")), "used")
    mine = members.join(used, "token")
    few, many = mine.filter("not wide").drop("wide"), cut(mine.filter("wide").drop("wide"), "wide")
    pairs = few.filter("small").alias("l").join(few.alias("r"), F.expr(f"l.token = r.token and (l.n < r.n or l.n = r.n and l.node < r.node) and {near('l', 'r')}"))
    pairs = pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()

    def bounded(pairs: DataFrame) -> DataFrame:
        ends = [sigs.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab"]
        both = pairs.join(ends[0], "a").join(ends[1], "b")
        return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_bounded(num, den), "a long, b long")

    edges, here = None, many.withColumn("comp", F.col("node"))
    for turn in range(ROUNDS):
        # Leaders in an order of this turn's own: one that led last time, and was alike to few, gives way.
        lead = F.min(F.struct(F.xxhash64(F.lit(turn), "comp").alias("order"), "comp", "node", "n")).alias("lead")
        leads = here.groupBy("token", "own").agg(lead)
        led = here.alias("l").join(leads, ["token", "own"]).filter(f"comp != lead.comp and {near('l', 'lead')}")
        pairs = pairs.union(led.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()) if edges is None else led.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct()
        found = bounded(pairs)
        edges = cut(found if edges is None else edges.union(found), "edges")
        comps = connected_components(edges)
        here = many.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        open_keys = here.groupBy("token").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("token")
        here = cut(here.join(open_keys, "token"), "open")
    tiles = _dealt(here, "token", False).join(sigs.select("node", "bits"), "node").repartition("token", "band", "i", "j").sortWithinPartitions("token", "band", "i", "j")
    tiles = tiles.select("token", "band", "i", "j", "comp", "n", "node", "small", "lower", "bits")
    more = cut(tiles.mapInArrow(_token_tiles(num, den), "a long, b long"), "tile_edges")
    groups = connected_components(edges.union(more)) if more.take(1) else comps
    discard(used, many, edges, here, more)
    return groups


def _most_frequent(seen: DataFrame) -> DataFrame:
    """(node, c): shingles with the greatest counts, FREQUENT at most.

    A histogram of the counts gives the least one that is taken, so only
    shingles that are taken leave their tasks.  Which of them are known
    changes the order of a text's shingles and nothing else.
    """
    counts = cut(seen.groupBy("node").agg(F.sum("n").alias("c")), "counts")
    sizes = sorted(((r["c"], r["rows"]) for r in counts.groupBy(F.least("c", F.lit(STEPS)).alias("c")).agg(F.count("*").alias("rows")).collect()), reverse=True)
    total, least = 0, STEPS
    for c, rows in sizes:
        total += rows
        if total > FREQUENT:
            break
        least = c
    return counts.filter(F.col("c") >= least).limit(FREQUENT)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """(profile, classes).

    ``profile`` has one row per input row: id, text_key (hash of the text),
    node (class of equal sets), n.  ``classes`` has one row for each node with
    shingles: node, n, weight (its rows), low (its smallest id), comp (smallest
    node reachable by links), component_id and, if ``count``, links (rows of
    other nodes that reach the threshold with it).
    Nulls and texts without words have an empty set and are in no link.  Rows
    with equal text fall into one node; a repeated id keeps all its rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    found = cut(keyed.mapInArrow(_profile(k), "kind int, id long, text_key long, node long, n long, bits binary"), "profile")
    profile = found.filter("kind = 0").select("id", "text_key", "node", "n")
    sigs = cut(found.filter("kind = 0 and n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("weight"), F.min("id").alias("low")), "signatures")
    often = _most_frequent(found.filter("kind = 1")).toArrow()
    tokens = often["node"].to_numpy().view(np.uint64)
    by = np.argsort(tokens)
    order = spark.sparkContext.broadcast((tokens[by], often["c"].to_numpy()[by]))
    del often, tokens, by
    trim()

    posted = texts.mapInArrow(_tokens(k, num, den, order), "token long")
    shared = cut(posted.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"), "shared")
    bits = node_filter(shared, "token")
    members = texts.mapInArrow(_postings(k, num, den, order, bits), "token long, node long, n int, small boolean").join(shared, "token").distinct()
    members = cut(members.withColumn("own", _band(_limits(num, den))), "members")
    discard(shared)
    order.destroy()
    bits.destroy()
    groups = _candidates(members, sigs, num, den)
    discard(members)

    many = groups.groupBy("comp").agg(F.count("*").alias("nodes"))
    near = cut(groups.join(many.filter("nodes > 1"), "comp").join(sigs.drop("bits"), "node"), "near")
    wanted, ids = node_filter(near, "node"), node_filter(near.select(F.col("low").alias("id")).dropna(), "id")
    sets = texts.mapInArrow(_exact_sets(k, ids, wanted), "node long, tokens binary").join(near.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = cut(sets, "sets")
    wanted.destroy()
    ids.destroy()
    total = cut(near.groupBy("comp").agg(((F.count("*") <= TILE) & (F.sum("n") <= TILE_TOKENS)).alias("whole")), "groups")
    near = near.join(total, "comp").select("comp", "node", "weight", "n", "whole")
    once = near.filter("whole").drop("whole").withColumns({"band": F.lit(0), "lower": F.lit(None).cast("boolean"), "i": F.lit(0), "j": F.lit(0)})
    spread = _dealt(near.filter("not whole").drop("whole").withColumn("own", _band(_limits(num, den))), "comp", True)
    tiles = once.unionByName(spread.select(once.columns)).join(sets, "node").repartition("comp", "band", "i", "j").sortWithinPartitions("comp", "band", "i", "j")
    linked = cut(tiles.select("comp", "band", "i", "j", "node", "weight", "lower", "tokens").mapInArrow(_group_tiles(num, den, count), "a long, b long, c long"), "linked")
    discard(sets)
    heads = sigs.drop("bits").join(connected_components(linked.select("a", "b")), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    if count:
        sums = linked.filter("c is not null").groupBy(F.col("a").alias("node")).agg(F.sum("c").alias("links"))
        heads = heads.join(sums, "node", "left").fillna(0, ["links"])
    heads = cut(heads, "heads")
    classes = cut(heads.join(heads.groupBy("comp").agg(F.min("low").alias("component_id")), "comp"), "classes")
    discard(sigs, linked, heads)
    return profile, classes


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 75, den: int = 100, count: bool = True) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links), text_key, group and n_links.

    ``text_key`` is a hash of the text; ``group`` is the same for the rows of
    one component and null without shingles.  ``n_links`` (if ``count``) is the
    number of other rows that reach the threshold with this one, rows of equal
    text among them; it takes all pairs of a group, the components don't.
    """
    profile, classes = near_groups(docs, id_col, text_col, k, num, den, count)
    out = profile.join(classes.select("node", "comp", "component_id", *[(F.col("weight") - 1 + F.col("links")).alias("n_links")] * count), "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    links = [F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links")] * count
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"), "text_key", F.when(F.col("n") > 0, F.col("comp")).alias("group"), *links)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")
