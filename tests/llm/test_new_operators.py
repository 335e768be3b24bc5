"""Line dedup, collocations and resampling on nulls, empty and long texts, ties, repeats, no rows and clashing columns, against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talliver.llm import collocations, common, line_dedup, resampling
from tests.llm import brute

KIND = "doc_id long, text string, lang string, key string, h long, keeps int, rank int, score int, a int, words string, part int"
CLASH = ("k", 1, 2, 3, 4, 5, "w", 6)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(d, t, lang, *CLASH) for d, t, lang in rows], KIND).repartition(parts)


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def line_rows():
    r = random.Random(3)
    pool = ["A line that many hold", "  a LINE that many hold\t", "short", "über zehn Zeichen", "éééééééééé", "ééééééééé", "", "   ", "tab\tinside a line", "\x0bvertical tab ends\x0c", "crlf line here\r", "crlf line here"]
    rows = [(0, None, "en"), (1, "", "en"), (2, "\n\n", "en"), (None, "A line that many hold\nown line of no id", "en"), (3, "x" * 200_000 + "\nA line that many hold", "en")]
    for i in range(4, 60):
        rows.append((i, "\n".join(r.choice(pool) if r.random() < 0.5 else f"own line {i} {r.randrange(9)}" for _ in range(r.randrange(1, 12))), "en"))
    rows += [(60, "twice in one\ntwice in one", "en"), (61, "same id first", "en"), (61, "same id first", "en"), (61, "same id first\nand another text", "en"), (62, "same id first\nand another text", "en")]
    return rows


@pytest.mark.parametrize("bits,held", [(1 << 27, 1 << 22), (1 << 16, 8), (1 << 8, 3)])
def test_line_dedup(spark, monkeypatch, bits, held):
    """Wide filters, and filters so full that every key is suspected."""
    monkeypatch.setattr(line_dedup, "PROBE_BITS", bits)
    monkeypatch.setattr(line_dedup, "CHUNK_BITS", min(bits, 1 << 16))
    monkeypatch.setattr(line_dedup, "HELD", held)
    rows = line_rows()
    got = line_dedup.drop_repeated_lines(frame(spark, rows)).withColumn("sha", F.sha2("kept", 256)).collect()
    want = brute.without_repeated_lines([r[:2] for r in rows])
    same([(r["doc_id"], r["n_lines"], r["n_dropped"], r["sha"]) for r in got], [(d, *x) for (d, *_), x in zip(rows, want, strict=True)])
    assert sum(x[1] for x in want) > 50


def test_line_dedup_of_no_rows(spark):
    none = frame(spark, []).limit(0)
    assert line_dedup.drop_repeated_lines(none).collect() == []
    only_nulls = spark.createDataFrame([(1, None), (None, None)], "doc_id long, text string")
    same([tuple(r) for r in line_dedup.drop_repeated_lines(only_nulls).collect()], [(1, 1, 0, ""), (None, 1, 0, "")])


def test_twice_seen_filter_misses_no_repeated_key(spark):
    """Two parts that have a key once each make it twice-seen; keys of one document stay once-seen."""
    rows = [(i, f"line number {i % 40} of all\nline of {i} alone", "en") for i in range(60)]
    df = frame(spark, rows, 7).select("doc_id", "text")
    seen = line_dedup.twice_seen(df, 10)
    import pyarrow as pa

    keys = line_dedup.KeyLines(pa.array([f"line number {i} of all" for i in range(40)] + [f"line of {i} alone" for i in range(60)]), line_dedup.SPACE)
    suspected = seen.suspects(keys.hash)
    assert suspected[:20].all() and not suspected[20:].any()


def phrase_rows():
    r = random.Random(8)
    vocab = ["a", "b", "The", "the", "c\x01", "c", "été", "x\x00", "zz"]
    rows = [(0, None, "en"), (1, "", None), (2, " \t ", "en"), (3, "a a a a a a a a a a", "en"), (None, "no id counts too", "en"), (4, "one two. three", "x")]
    for i in range(5, 120):
        words = [r.choice(vocab) for _ in range(r.randrange(0, 30))]
        text = "".join(w + r.choice([" ", " ", " ", "\t", ". ", ",", "\n", "  "]) for w in words)
        rows.append((i, "in the very same words " + text if i % 3 else text, r.choice(["en", "en", "de", None])))
    return rows + [rows[20]] * 3 + [(200, " ".join(r.choice(vocab) for _ in range(9000)), "en")]


@pytest.mark.parametrize("sizes", [collocations.SIZES, collocations.Sizes(3, 40, 12, 2), collocations.Sizes(7, 15, 7, 3)])
def test_collocations(spark, sizes):
    """One range, and many ranges with unions of groups of shards."""
    rows = phrase_rows()
    for least, absorbed in ((4, 100), (9, 60))[: 2 if sizes is collocations.SIZES else 1]:
        got = collocations.collocations(frame(spark, rows), least=least, absorbed=absorbed, top=300, sizes=sizes).collect()
        want = brute.collocations([(lang, t) for _, t, lang in rows], least, absorbed=absorbed, top=300)
        assert len(want) > 100 and len({w[0] for w in want}) == 3
        same(got, want)


def test_collocations_of_few_rows(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).collect() == []
    few = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    assert collocations.collocations(few).collect() == []
    same(collocations.collocations(few, least=1).collect(), [("en", 1, "a b", 1, 1, 1, 2, 2000)])


def test_counts_leave_a_task_in_small_batches():
    """What a task sends at once, and what of it lies in memory that Arrow takes, doesn't grow with its words."""
    text = " ".join(f"w{i}" for i in range(150_000))
    batch = pa.record_batch([pa.array([text, "w1"]), pa.array(["en", "en"])], ["text", "lang"])
    sent = list(collocations._hash_counts(1, [])(iter([batch])))
    assert max(x.num_rows for x in sent) <= 1 << 16
    assert sorted(n for x in sent for n in x.column("c").to_pylist()) == [1] * 149_999 + [2]


def test_transducers_are_read_in_small_batches(spark):
    """Rows as large as transducers reach a task by 2 MB or so, not by thousands."""
    large = common.cut(spark.range(0, 120, 1, 1).select(F.expr("repeat(cast(id % 10 as string), 100000)").alias("x")), "large")
    seen = common.cut(large.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n long"), "seen", collocations.SMALL)
    found = [r["n"] for r in seen.collect()]
    assert sum(found) >= 12_000_000 and max(found) <= 4_000_000
    common.discard(large, seen)


def test_exact_scores_beyond_64_bits(spark, monkeypatch):
    """Counts near 2^40: the products need more than 64 bits."""
    parts = spark.createDataFrame([("en", ["p", "q", "r"], 10**12 + 7, 10**13 + 9, [10**12 + 11, 10**12 + 9], [10**12 + 13, 10**12 + 21])], "lang string, words array<string>, a long, n long, heads array<long>, tails array<long>")
    monkeypatch.setattr(collocations, "phrase_parts", lambda *_: parts)
    got = collocations.collocations(spark.createDataFrame([("", "en")], "text string, lang string")).first()
    a, n = 10**12 + 7, 10**13 + 9
    cuts = [(1000 * a * n // ((10**12 + 11) * (10**12 + 21)), 1), (1000 * a * n // ((10**12 + 9) * (10**12 + 13)), 2)]
    assert (got["score"], got["l"]) == (min(cuts)[0], [10**12 + 11, 10**12 + 9][min(cuts)[1] - 1])


def test_transducers_are_minimal_and_keep_their_weights():
    r = random.Random(2)
    for _ in range(30):
        keys = sorted({tuple(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(1, 80))})
        weights = {k: r.randrange(0, 6) for k in keys}
        builder = collocations.Builder()
        for k in keys:
            builder.add(k, weights[k])
        t = builder.done()
        walked = list(t.paths())
        assert [(k, w[-1]) for k, w in walked] == [(k, weights[k]) for k in keys]
        assert all(w == [weights.get(k[: i + 1]) for i in range(len(k))] == t.compose(k) for k, w in walked)
        edges = np.concatenate([[0], np.cumsum(t.nodes[:, 1])])
        states = [(int(f), t.arcs[a:b].tolist()) for (f, _), a, b in zip(t.nodes.tolist(), edges, edges[1:], strict=False)]
        assert len({str(s) for s in states}) == len(states)  # no two states are alike
    shared = collocations.Builder()
    for k in sorted((a, b, c) for a in "pqrs" for b in "xy" for c in "zw"):
        shared.add(k, 5)
    assert len(shared.done().nodes) == 4


def resample_rows():
    r = random.Random(6)
    vocab = ["alpha", "Beta", "gamma9", "über", "delta", "x", "y1", "omega"]
    rows = [(0, None, "en"), (1, "", "en"), (2, "!!! ---", "en"), (None, " ".join(["alpha"] * 30), "en"), (3, "word", "en"), (4, "two words", "en"), (5, "l" * 5000 + " " + "m" * 300 + " n", "en")]
    rows += [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(5, 60))), "en") for i in range(6, 300)]
    return rows + [rows[50]] * 40 + [(9, " ".join(["beta"] * 25), "en")]


@pytest.mark.parametrize("few", [1 << 14, 1])
def test_resampling(spark, monkeypatch, few):
    monkeypatch.setattr(resampling, "FEW", few)
    rows = resample_rows()
    items = ["alpha beta gamma9 alpha beta", None, "omega", ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    for percent in (5, 30)[: 2 if few > 1 else 1]:
        got = resampling.resample(frame(spark, rows), target, percent=percent).select("doc_id", "n_features", "weight", "score", "rank").collect()
        same(got, brute.resampled([r[:2] for r in rows], items, percent))


def test_resampling_of_few_rows(spark):
    none = frame(spark, []).limit(0)
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(none, target).collect() == []
    rows = [(1, "a " * 30, "en"), (2, None, "en")]
    got = resampling.resample(frame(spark, rows), target.limit(0)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    same(got, brute.resampled([r[:2] for r in rows], []))
    assert all(r["rank"] is None for r in got)


def test_cutoff_by_weighted_medians(spark, monkeypatch):
    """Every rank's key, with ties, uneven partitions and as many rounds as it takes."""
    monkeypatch.setattr(resampling, "FEW", 1)
    r = random.Random(4)
    keys = [(r.randrange(-5, 6), r.randrange(40)) for _ in range(200)] + [(0, 7)] * 60 + [(-(2**62), 1), (2**62, 1)]
    df = spark.createDataFrame(keys, "a long, b long").repartitionByRange(6, "a")
    for rank in (1, 77, 131, 262):
        assert resampling.cutoff_key(df, rank) == sorted(keys)[rank - 1]
    with pytest.raises(ValueError, match="rank"):
        resampling.cutoff_key(df, 263)


def test_crc_of_runs_equals_zlib():
    import re
    import zlib

    import pyarrow as pa

    r = random.Random(1)
    texts = [" ".join("".join(r.choice("abcDEFé9") for _ in range(r.choice([1, 2, 5, 9, 300, 700]))) for _ in range(r.randrange(0, 9))) for _ in range(60)] + [None, ""]
    words = resampling.Words(pa.array(texts, pa.string()), resampling.ALNUM, lower=True)
    got = [(int(d), int(c)) for crc, doc in resampling.feature_crcs(words) for c, d in zip(crc, doc, strict=True)]
    want = []
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(brute.LOW))
        want += [(i, zlib.crc32(" ".join(w[j : j + k]).encode())) for k in (1, 2, 3) for j in range(len(w) - k + 1)]
    assert Counter(got) == Counter(want)
