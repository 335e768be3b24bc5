"""Phrase collocations per language, counted in weighted acyclic automata.

1. Counts of hashed words, pairs and triples, pre-aggregated by tasks, tell
   which may reach the wanted count; a phrase is looked at only if all its
   triples may.  Bit filters of fixed size hold what passed; they let some
   others through, which the exact counts below remove.
2. Every shard (a bounded number of phrases of one task) sorts its phrases, as
   (language, word, word, ...), and builds minimal acyclic transducers of their
   counts incrementally.  The path of a language alone counts all its words.
3. Transducers are united by prefix range: split points are drawn from their
   first phrases, each range also gets the prefixes of its lower end, and a
   task merges sorted transducers, sums weights and builds the range's own.
   Many shards are united in groups first, so few transducers are open at once.
4. A phrase composed with the united transducer passes through all its first
   parts, whose counts lie on its path.  The same union over reversed phrases
   gives its last parts.  No part is looked up by a join, so a part that very
   many phrases share is no hot key.

Phrases of one shard are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talliver.llm.common import FILTER_WORDS, cut, discard, node_filter, passes, table
from talliver.llm.textkernels import LOWER, Words, mix, separator_table, slices, windows

#: Piece separators, and all separators of words.
PIECES = separator_table(b".,;:!?\n\v\f\r")
WORDS = separator_table(b" \t.,;:!?\n\v\f\r")
#: Hashes that a task sums up before it sends them, rows that it sends together, and bytes of text that it looks at together.
HELD, SENT, SLICE = 1 << 20, 1 << 16, 1 << 19
#: Texts and transducers go through Parquet readers and Arrow in small batches; thousands of transducers are hundreds of MB.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "64"}
#: Ranges at most, and first phrases that the driver draws split points from.
RANGES, DRAWN = 4096, 20_000
#: Words of the longest runs that are counted beforehand.
BEFORE = 3

Key = tuple[str, ...]


@dataclass(frozen=True)
class Sizes:
    """Phrases of one transducer, of a shard and of a range of the union, and shards that one union takes."""

    block: int = 1 << 12
    shard: int = 1 << 18
    span: int = 1 << 16
    fan: int = 256


SIZES = Sizes()


class Builder:
    """A minimal acyclic transducer, built by adding sorted keys one after the other.

    Weights add up along a path and are pushed towards the root, so equal
    tails with equal remaining weights are one state.
    """

    def __init__(self):
        self.register: dict[tuple, int] = {}
        self.states: list[tuple] = []  # (final weight or -1, ((label, target, weight), ...))
        self.path: list[list] = [[-1, []]]  # states that may still change: final weight, [label, target, weight]
        self.last: Key = ()

    def _freeze(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            final, arcs = self.path.pop()
            state = (final, tuple(map(tuple, arcs)))
            number = self.register.get(state)
            if number is None:
                number = self.register[state] = len(self.states)
                self.states.append(state)
            self.path[-1][1][-1][1] = number

    def add(self, key: Key, weight: int) -> None:
        same = 0
        for a, b in zip(self.last, key, strict=False):
            if a != b:
                break
            same += 1
        self._freeze(same)
        for i in range(same):
            arc = self.path[i][1][-1]
            rest = arc[2] - weight
            if rest > 0:  # less than what the arc carries: the difference moves on to the next state
                arc[2] = weight
                node = self.path[i + 1]
                for x in node[1]:
                    x[2] += rest
                if node[0] >= 0:
                    node[0] += rest
                weight = 0
            else:
                weight -= arc[2]
        for label in key[same:]:
            self.path[-1][1].append([label, -1, weight])
            self.path.append([-1, []])
            weight = 0
        self.path[-1][0] = weight
        self.last = key

    def done(self) -> Transducer:
        self._freeze(0)
        states = [*self.states, (self.path[0][0], tuple(map(tuple, self.path[0][1])))]
        labels = sorted({arc[0] for _, arcs in states for arc in arcs})
        number = {x: i for i, x in enumerate(labels)}
        arcs = np.array([(number[a], t, w) for _, own in states for a, t, w in own], np.int64).reshape(-1, 3)
        nodes = np.array([(final, len(own)) for final, own in states], np.int64)
        return Transducer(labels, nodes, arcs)


class Transducer:
    """States in the order of their completion, the root last; ``nodes`` (final weight or -1, arcs), ``arcs`` (label, target, weight)."""

    def __init__(self, labels: list[str], nodes: np.ndarray, arcs: np.ndarray):
        self.labels, self.nodes, self.arcs = labels, nodes, arcs

    def paths(self) -> Iterator[tuple[Key, list[int | None]]]:
        """Each key in order, with the weights of its first 1, 2, ... symbols (None where these are no key)."""
        finals, edges = array("q", self.nodes[:, 0].tobytes()), array("q", np.concatenate([[0], np.cumsum(self.nodes[:, 1])]).tobytes())
        labels, states, weights = (array("q", self.arcs[:, i].tobytes()) for i in range(3))  # lists would take eight times the room
        key: list[str] = []
        found: list[int | None] = []
        root = len(finals) - 1
        stack = [(edges[root], edges[root + 1], 0)]
        while stack:
            at, end, total = stack.pop()
            if at == end:
                if key:
                    key.pop()
                    found.pop()
                continue
            stack.append((at + 1, end, total))
            state, weight = states[at], weights[at]
            key.append(self.labels[labels[at]])
            found.append(total + weight + finals[state] if finals[state] >= 0 else None)
            if found[-1] is not None:
                yield tuple(key), list(found)
            stack.append((edges[state], edges[state + 1], total + weight))

    def compose(self, key: Key) -> list[int | None]:
        """The weights of the key's first 1, 2, ... symbols; shorter where its path ends."""
        edges = np.concatenate([[0], np.cumsum(self.nodes[:, 1])])
        state, total, out = len(self.nodes) - 1, 0, []
        for symbol in key:
            own = self.arcs[edges[state] : edges[state + 1]]
            hit = [a for a in own.tolist() if self.labels[a[0]] == symbol]
            if not hit:
                break
            state, total = hit[0][1], total + hit[0][2]
            out.append(total + int(self.nodes[state, 0]) if self.nodes[state, 0] >= 0 else None)
        return out


BLOCK_KIND = "grp long, rng int, first array<string>, labels array<string>, nodes binary, arcs binary"


def _blocks(entries: Iterator[tuple[Key, int]], group: int, rng: int, size: int) -> Iterator[tuple]:
    """Rows of BLOCK_KIND for sorted (key, weight)."""
    builder, first, n = Builder(), None, 0
    for key, weight in entries:
        builder.add(key, weight)
        first, n = first or key, n + 1
        if n == size:
            t = builder.done()
            yield group, rng, list(first), t.labels, t.nodes.tobytes(), t.arcs.tobytes()
            builder, first, n = Builder(), None, 0
    if n:
        t = builder.done()
        yield group, rng, list(first), t.labels, t.nodes.tobytes(), t.arcs.tobytes()


_STRINGS = pa.list_(pa.string())
_COLUMNS = [("grp", pa.int64()), ("rng", pa.int32()), ("first", _STRINGS), ("labels", _STRINGS), ("nodes", pa.binary()), ("arcs", pa.binary())]


def _batch(rows: list[tuple], columns) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(x), kind) for x, (_, kind) in zip(zip(*rows, strict=True) if rows else [()] * len(columns), columns, strict=True)], [c for c, _ in columns])


def _batches(rows: Iterator[tuple], columns, size: int) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, columns)
            held = []
    if held:
        yield _batch(held, columns)


def _loaded(row: dict) -> Transducer:
    return Transducer(row["labels"], np.frombuffer(row["nodes"], np.int64).reshape(-1, 2), np.frombuffer(row["arcs"], np.int64).reshape(-1, 3))


# ---- 1. what may reach the wanted count


def _runs_of(batch: pa.RecordBatch, filters: list, longest: int) -> tuple[Words, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """For k = 1, ... ``longest`` the hashes (with the language) and first words of the runs of k words inside a piece all of whose shorter parts pass."""
    words = Words(batch.column("text"), WORDS, lower=True)
    lang = batch.column("lang").dictionary_encode()
    salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in lang.dictionary.to_pylist()] or [0], np.uint64)
    salt = salt[np.asarray(lang.indices)][words.doc]
    ends = np.concatenate([[0], np.cumsum(PIECES[words.raw], dtype=np.int64)])
    text = words.doc
    words.doc = text + ends[words.start]  # equal within a piece only
    found = {}
    for k in range(1, longest + 1):
        h, at = windows(words, k)
        if k > 1 and len(filters) >= 1:
            # A run of k words passes if its two runs of k - 1 words did; beyond the filters, every run of their length has to.
            ok = np.zeros(len(words.hash) + 1, bool)
            ok[found[k - 1][1]] = True
            use = ok[at] & ok[at + 1]
            h, at = h[use], at[use]
        h = mix(h ^ salt[at])
        if k <= len(filters):
            use = passes(filters[k - 1], h.view(np.int64))
            h, at = h[use], at[use]
        found[k] = h, at
    words.doc = text
    return words, found


def _dense(filters: list) -> list:
    """The filters as whole bit arrays: every word of a text is looked up."""
    out = []
    for shared in filters:
        at, bits = shared.value
        if at is not None:
            whole = np.zeros(FILTER_WORDS, np.uint64)
            whole[at[:-1]] = bits[:-1]
            bits = whole
        out.append((None, bits))
    return out


def _hash_counts(k: int, filters: list):
    """(h, c) of the runs of k words, summed by the task."""

    def summed(held):
        h, c = np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held])
        by = np.argsort(h, kind="stable")
        h, c = h[by], c[by]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[at], np.add.reduceat(c, at) if len(at) else c

    def sent(h, c):
        for i in range(0, len(h), SENT):
            yield pa.record_batch([pa.array(h[i : i + SENT].view(np.int64)), pa.array(c[i : i + SENT])], ["h", "c"])

    def run(batches):
        held, total, bits = [], 0, _dense(filters)
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                _, found = _runs_of(batch, bits, k)
                held.append(np.unique(found[k][0], return_counts=True))
                total += len(held[-1][0])
                if total > HELD:
                    held = [summed(held)]
                    total = len(held[0][0])
                    if total > HELD // 2:
                        yield from sent(*held[0])
                        held, total = [], 0
        if held:
            yield from sent(*summed(held))

    return run


def frequent_runs(texts: DataFrame, least: int) -> list:
    """Broadcast bit filters of the hashed runs of 1 to BEFORE words with ``least`` occurrences or more."""
    filters: list = []
    for k in range(1, BEFORE + 1):
        counts = texts.mapInArrow(_hash_counts(k, filters), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
        often = cut(counts.filter(F.col("c") >= least).select("h"), "often", SMALL)
        filters.append(node_filter(often, "h"))
        discard(often)
    return filters


# ---- 2. the shards' transducers


class Shard:
    """Phrases of a task with their counts, by the order of their hashes; words are held once."""

    def __init__(self):
        self.seen, self.counts, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.phrases: list[Key] = []
        self.totals: dict[str, int] = {}
        self.names: dict[bytes, str] = {}

    def add(self, h: np.ndarray, count: np.ndarray, phrase) -> None:
        """Counts of distinct sorted hashes; ``phrase(j)`` gives the phrase of h[j], if it is new."""
        place = np.searchsorted(self.seen, h)
        new = np.append(self.seen, 0)[place] != h
        new[place == len(self.seen)] = True
        self.counts[place[~new]] += count[~new]
        at, n = place[new], len(self.phrases)
        self.phrases.extend(map(phrase, np.flatnonzero(new).tolist()))
        self.seen, self.counts = np.insert(self.seen, at, h[new]), np.insert(self.counts, at, count[new])
        self.places = np.insert(self.places, at, np.arange(n, len(self.phrases)))

    def name(self, word: bytes) -> str:
        found = self.names.get(word)
        if found is None:
            found = self.names[word] = word.decode()
        return found

    def entries(self) -> list[tuple[Key, int]]:
        found = [(self.phrases[i], n) for i, n in zip(self.places.tolist(), self.counts.tolist(), strict=True)]
        return sorted([*found, *(((lang,), n) for lang, n in self.totals.items())])


def _shards(longest: int, filters: list, sizes: Sizes):
    def run(batches):
        task, bits = TaskContext.get().partitionId() << 20, _dense(filters)
        shard = Shard()

        def out():
            return _batches(_blocks(iter(shard.entries()), task, 0, sizes.block), _COLUMNS, 16)

        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                words, found = _runs_of(batch, bits, longest)
                langs, low = batch.column("lang").to_pylist(), LOWER[words.raw].tobytes()
                for i, n in enumerate(words.counts().tolist()):
                    if n:
                        shard.totals[langs[i]] = shard.totals.get(langs[i], 0) + n
                start, end, doc = words.start, words.end, words.doc
                for k, (h, at) in found.items():
                    unique, first, count = np.unique(h, return_index=True, return_counts=True)
                    part = at[first]

                    def phrase(j, k=k, part=part):
                        i = int(part[j])
                        return (langs[doc[i]], *(shard.name(low[a:b]) for a, b in zip(start[i : i + k].tolist(), end[i : i + k].tolist(), strict=True)))

                    shard.add(unique, count, phrase)
                if len(shard.phrases) >= sizes.shard:
                    yield from out()
                    shard, task = Shard(), task + 1
        yield from out()

    return run


# ---- 3. unions by prefix range


def _ranged(splits: list[Key], groups: int, sizes: Sizes):
    """Every transducer goes to the ranges that its keys lie in; prefixes of a range's lower end go there too."""
    ahead: dict[Key, list[int]] = {}
    for r, low in enumerate(splits):
        for n in range(1, len(low)):
            ahead.setdefault(low[:n], []).append(r + 1)

    def parts(row: dict):
        low = splits[row["rng"] - 1] if row["rng"] else ()  # prefixes of the end of a range it was dealt to before are at home elsewhere
        own: dict[int, list] = {}
        for key, found in _loaded(row).paths():
            if key < low:
                continue
            r, weight = bisect_right(splits, key), found[-1]
            own.setdefault(r, []).append((key, weight))
            for later in ahead.get(key, ()):
                if later != r:
                    own.setdefault(later, []).append((key, weight))
        for r, mine in own.items():
            mine.sort()
            yield from _blocks(iter(mine), hash((row["grp"], 7)) % groups if groups > 1 else 0, r, sizes.block)

    def run(batches):
        for batch in batches:
            yield from _batches((x for row in batch.to_pylist() for x in parts(row)), _COLUMNS, 64)

    return run


def _merged(rows: Iterator[dict]) -> Iterator[tuple[int, int, Iterator[tuple[Key, int]]]]:
    """(group, range, sorted entries with summed weights) of rows sorted by group, range and first key."""
    row = next(rows, None)
    while row is not None:
        group, rng = row["grp"], row["rng"]

        def entries():
            nonlocal row
            heap: list = []
            number = 0
            key, total = None, 0
            while True:
                # Open every transducer that begins before the smallest key at hand.
                while row is not None and (row["grp"], row["rng"]) == (group, rng) and (not heap or tuple(row["first"]) <= heap[0][0]):
                    walk = _loaded(row).paths()
                    start = next(walk, None)
                    if start is not None:
                        heapq.heappush(heap, (start[0], number, start[1][-1], walk))
                        number += 1
                    row = next(rows, None)
                if not heap:
                    break
                at, i, weight, walk = heap[0]
                if at != key:
                    if key is not None:
                        yield key, total
                    key, total = at, 0
                total += weight
                step = next(walk, None)
                if step is None:
                    heapq.heappop(heap)
                else:
                    heapq.heapreplace(heap, (step[0], i, step[1][-1], walk))
            if key is not None:
                yield key, total

        yield group, rng, entries()


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _grouped(sizes: Sizes):
    """Unions of groups of shards: transducers again."""

    def run(batches):
        for group, rng, entries in _merged(_rows(batches)):
            yield from _batches(_blocks(entries, group, rng, sizes.block), _COLUMNS, 16)

    return run


_PATHS = [("rng", pa.int32()), ("key", _STRINGS), ("weights", pa.list_(pa.int64()))]


def _united(splits: list[Key], least: int, sizes: Sizes):
    """The last union: keys with ``least`` or more, and the weights of their first parts, off the range's transducers."""

    def frequent(entries):
        for key, weight in entries:
            if weight >= least or len(key) == 1:
                yield key, weight

    def composed(rng: int, entries):
        # Each transducer begins with the prefixes of its first key, so that a path holds all first parts.
        low = splits[rng - 1] if rng else ()
        open_: list[tuple[Key, int]] = []
        block: list[tuple[Key, int]] = []
        given: list[tuple[Key, int]] = []

        def out():
            builder = Builder()
            for key, weight in [*given, *block]:
                builder.add(key, weight)
            fresh = {key for key, _ in given}
            for key, weights in builder.done().paths():
                if key not in fresh and key >= low:
                    yield rng, list(key), weights

        for key, weight in entries:
            while open_ and key[: len(open_[-1][0])] != open_[-1][0]:
                open_.pop()
            if len(block) >= sizes.block:
                yield from out()
                block, given = [], list(open_)
            block.append((key, weight))
            open_.append((key, weight))
        yield from out()

    def run(batches):
        for _, rng, entries in _merged(_rows(batches)):
            yield from _batches(composed(rng, frequent(entries)), _PATHS, 4096)

    return run


def united_paths(blocks: DataFrame, least: int, sizes: Sizes) -> DataFrame:
    """(key, weights): the sums of all keys over all transducers of ``blocks`` that reach ``least`` (keys of one
    symbol always), and the weights of all first parts of each."""
    spark = blocks.sparkSession
    n = blocks.count()
    shards = blocks.select("grp").distinct().count()
    firsts = blocks.select("first").sample(min(1.0, DRAWN / max(n, 1)), seed=1).limit(2 * DRAWN).toArrow()["first"].to_pylist()
    firsts = sorted({tuple(x) for x in firsts})
    wanted = max(1, min(RANGES, n * sizes.block // sizes.span, len(firsts)))
    splits = sorted({firsts[len(firsts) * i // wanted] for i in range(1, wanted)})
    partitions = max(len(splits) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(partitions, "grp", "rng").sortWithinPartitions("grp", "rng", "first")

    while True:
        groups = -(-shards // sizes.fan)
        ranged = dealt(blocks.mapInArrow(_ranged(splits, groups, sizes), BLOCK_KIND))
        if groups <= 1:
            return ranged.mapInArrow(_united(splits, least, sizes), "rng int, key array<string>, weights array<long>").drop("rng")
        blocks = cut(ranged.mapInArrow(_grouped(sizes), BLOCK_KIND), "groups", SMALL)
        shards = groups


# ---- 4. scores


def _reversed(sizes: Sizes):
    """Transducers of the reversed phrases of a task."""

    def run(batches):
        task = TaskContext.get().partitionId() << 20
        held: list = []
        names: dict[str, str] = {}
        for batch in batches:
            for key, weights in zip(batch.column("key").to_pylist(), batch.column("weights").to_pylist(), strict=True):
                held.append((tuple(names.setdefault(x, x) for x in (key[0], *key[:0:-1])), weights[-1]))
            if len(held) >= sizes.shard:
                yield from _batches(_blocks(iter(sorted(held)), task, 0, sizes.block), _COLUMNS, 16)
                held, names, task = [], {}, task + 1
        yield from _batches(_blocks(iter(sorted(held)), task, 0, sizes.block), _COLUMNS, 16)

    return run


def phrase_parts(texts: DataFrame, least: int, longest: int, sizes: Sizes) -> DataFrame:
    """lang, words, a, n, heads, tails: phrases of 2 to ``longest`` words with ``least`` occurrences or more; the
    counts of their first 1, 2, ... and of their last 1, 2, ... words.  ``texts`` has text and lang, neither null."""
    filters = frequent_runs(texts, least)
    shards = cut(texts.mapInArrow(_shards(longest, filters, sizes), BLOCK_KIND), "shards", SMALL)
    for f in filters:
        f.destroy()
    counted = cut(united_paths(shards, least, sizes), "counted", SMALL)
    back = cut(counted.mapInArrow(_reversed(sizes), BLOCK_KIND), "reversed", SMALL)
    tails = united_paths(back, 0, sizes).select(F.col("key")[0].alias("lang"), F.reverse(F.slice("key", 2, longest)).alias("words"), F.slice("weights", 2, longest).alias("tails")).filter("size(words) > 1")
    heads = counted.select(F.col("key")[0].alias("lang"), F.slice("key", 2, longest).alias("words"), F.element_at("weights", -1).alias("a"), F.col("weights")[0].alias("n"), F.slice("weights", 2, longest).alias("heads")).filter("size(words) > 1")
    found = cut(heads.join(tails, ["lang", "words"]), "parts", SMALL)
    discard(shards, counted, back)
    return found


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, absorbed: int = 100, sizes: Sizes = SIZES, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by their lowest-scoring cut.

    Words are runs of other characters than blank and tab inside pieces that
    punctuation and line ends bound, A-Z in lower case.  A phrase of 2 to
    ``longest`` words with a >= ``least`` occurrences is a candidate; cut after
    k words it scores floor(1000 a n / (l r)), the lowest score counts, ties to
    the smallest k.  A candidate inside a longer one that occurs ``absorbed``
    percent as often or more goes.  Ties in rank go to the larger a, then the
    smaller phrase in byte order.  A null text is empty, a null language is
    ``und``.  Repeated rows count each; other columns are never read.
    Products beyond 38 digits are an error.
    """
    texts = docs.select(F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(lang_col, F.lit("und")).alias("lang"))
    parts = phrase_parts(texts, least, longest, sizes)
    inner = "flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))"
    longer = parts.filter("size(words) > 2").select("lang", F.explode(F.expr(inner)).alias("words"), "a").groupBy("lang", "words").agg(F.max("a").alias("longer"))
    left = parts.join(longer, ["lang", "words"], "left").filter(F.coalesce(100 * F.col("longer") < absorbed * F.col("a"), F.lit(True)))
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = f"transform(sequence(1, size(words) - 1), k -> struct((1000 * {wide('a')} * {wide('n')}) div ({wide('heads[k - 1]')} * {wide('tails[size(words) - k - 1]')}) as score, k as k, heads[k - 1] as l, tails[size(words) - k - 1] as r))"
    scored = left.select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", F.expr(f"array_min({cuts})").alias("best"))
    scored = scored.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # A language's candidates are thinned in 64 parts before they meet.
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS MATERIALIZED (SELECT lang, k, array_to_string(words, ' ') AS phrase, any_value(words) AS words, count(*) AS f
  FROM (SELECT lang, k, ws[i + 1 : i + k] AS words FROM (SELECT lang, ws, k, unnest(range(len(ws) - k + 1)) AS i FROM w CROSS JOIN range(1, 6) t(k) WHERE len(ws) >= k)) GROUP BY lang, k, array_to_string(words, ' ')),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM g WHERE k > 1 AND f >= 100),
inside AS (SELECT lang, array_to_string(words[i + 1 : i + m], ' ') AS phrase, max(f) AS longer FROM (SELECT lang, words, f, m, unnest(range(k - m + 1)) AS i FROM c CROSS JOIN range(2, 5) t(m) WHERE m < k) GROUP BY 1, 2),
cuts AS (SELECT lang, phrase, f, j, array_to_string(words[1 : j], ' ') AS head, array_to_string(words[j + 1 : k], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * cuts.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, j
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = head JOIN g y ON y.lang = cuts.lang AND y.phrase = tail JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s LEFT JOIN inside USING (lang, phrase) WHERE coalesce(100 * longer < 100 * a, TRUE) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000"""
