"""Language identification by a linear-chain conditional random field.

Every word is labelled; the emission features are affixes (up to three bytes at
either end), byte trigrams and lexicon membership, the transitions are
learned.  Forward-backward over the whole text gives a posterior per word, so
code-switched texts get a label per word; a document's language is the one
with the largest mean posterior over its words with letters.

The model is fitted on a bounded sample of labelled rows (``per_label`` texts
of each label at most in expectation, ``MAX_SAMPLE`` and ``SAMPLE_BYTES`` in all); training
sequences splice runs of words of different texts, so switches occur in them.
Everything else runs over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talliver.llm.common import table
from talliver.llm.textkernels import ALNUM, Words, mix, slices, trim

#: Texts of the sample: of each label, and in all; bytes of their texts in all (a text of over a 64th of that is not taken).
PER_LABEL, MAX_SAMPLE, SAMPLE_BYTES = 250, 4000, 64 << 20
#: Hashed features, and steps of the fit.
FEATURES, STEPS, BATCH, LENGTH = 1 << 16, 250, 256, 24
#: A word is in a label's lexicon if it was seen so often, and with this label in such a share.
LEXICON_SEEN, LEXICON_SHARE = 4, 0.8
#: Words whose scores a task holds, and words of a segment of forward-backward.
REMEMBERED, SEGMENT = 1 << 17, 128


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # FEATURES + labels (lexicon) by labels
    transitions: np.ndarray
    start: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    entry: np.ndarray  # label of each


def _features(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of words, flat, and where each word's begin (n + 1)."""
    size = end - start
    first = np.concatenate([[0], np.cumsum(size + 1)])
    buf = np.zeros(first[-1] + 2, np.uint64)  # words with a zero byte before each
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    low = raw[np.repeat(start, size) + at].astype(np.uint64)
    low += np.where((low >= 65) & (low <= 90), 32, 0).astype(np.uint64)
    buf[np.repeat(first[:-1] + 1, size) + at] = low
    here = np.repeat(first[:-1] + 1, size) + at
    grams = (buf[here - 1] << np.uint64(16)) | (buf[here] << np.uint64(8)) | buf[here + 1]
    affixes = []
    for n in (1, 2, 3):
        pre, suf = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
        for j in range(n):
            pre = (pre << np.uint64(8)) | buf[first[:-1] + 1 + np.minimum(j, size - 1)]
            suf = (suf << np.uint64(8)) | buf[first[1:] - 1 - np.minimum(j, size - 1)]
        affixes += [pre | np.uint64((2 * n) << 32), suf | np.uint64((2 * n + 1) << 32)]
    count = size + len(affixes)
    edges = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(edges[-1], np.uint64)
    out[np.repeat(edges[:-1], size) + at] = grams
    for j, a in enumerate(affixes):
        out[edges[:-1] + size + j] = a
    return (mix(out + np.uint64(0x51ED270B)) & np.uint64(FEATURES - 1)).astype(np.int64), edges


def _lexicon_of(model_lexicon: np.ndarray, entry: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Label whose lexicon holds a word, else -1."""
    if not len(model_lexicon):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(model_lexicon, hashes), len(model_lexicon) - 1)
    return np.where(model_lexicon[at] == hashes, entry[at], -1)


def _lettered(words: Words, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a word has a letter: a-z, or any byte beyond ASCII."""
    raw = words.raw
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    sums = np.concatenate([[0], np.cumsum(letter)])
    return sums[end] > sums[start]


def _emissions(weights: np.ndarray, feats: np.ndarray, edges: np.ndarray, lex: np.ndarray) -> np.ndarray:
    if len(edges) < 2:
        return np.zeros((0, weights.shape[1]), weights.dtype)
    out = np.add.reduceat(weights[feats], edges[:-1], axis=0)
    known = lex >= 0
    out[known] += weights[FEATURES + lex[known]]
    return out


def _marginals(potential: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (batch, time, label) and expected transitions of equally long sequences."""
    b, t, n = potential.shape
    e = np.exp(potential - potential.max(axis=2, keepdims=True))
    a = np.exp(trans)
    alpha = np.zeros_like(e)
    beta = np.ones_like(e)
    alpha[:, 0] = e[:, 0] * np.exp(start)
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, t):
        alpha[:, i] = (alpha[:, i - 1] @ a) * e[:, i]
        alpha[:, i] /= alpha[:, i].sum(axis=1, keepdims=True)
    for i in range(t - 2, -1, -1):
        beta[:, i] = (beta[:, i + 1] * e[:, i + 1]) @ a.T
        beta[:, i] /= beta[:, i].sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= post.sum(axis=2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (e[:, 1:] * beta[:, 1:])[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return post, pair.sum(axis=(0, 1))


def fit(texts: list[str], langs: list[str], seed: int = 3) -> Model:
    """Fit by stochastic gradient ascent (Adagrad) of the sequences' log-likelihood."""
    labels = sorted(set(langs))
    n = len(labels)
    words = Words(pa.array(texts, pa.large_string()), ALNUM, lower=True)
    y_doc = np.array([labels.index(x) for x in langs], np.int64)
    keep = np.flatnonzero(_lettered(words, words.start, words.end))
    y = y_doc[words.doc[keep]]
    unique, where, number = np.unique(words.hash[keep], return_index=True, return_inverse=True)
    counts = np.zeros((len(unique), n))
    np.add.at(counts, (number, y), 1)
    seen = counts.sum(axis=1)
    sure = (seen >= LEXICON_SEEN) & (counts.max(axis=1, initial=0) >= LEXICON_SHARE * seen)
    lexicon, entry = unique[sure], counts[sure].argmax(axis=1) if n else np.zeros(0, int)
    feats, edges = _features(words.raw, words.start[keep][where], words.end[keep][where])
    lex = _lexicon_of(lexicon, entry, unique)
    model = Model(labels, np.zeros((FEATURES + n, n), np.float32), np.zeros((n, n)), np.zeros(n), lexicon, entry)
    if n < 2 or len(keep) < LENGTH:
        return model
    rng = np.random.default_rng(seed)
    sums = [np.full_like(p, 1e-6, dtype=np.float64) for p in (model.weights, model.transitions, model.start)]
    half = LENGTH // 2
    by_label = [np.flatnonzero(y[: len(y) - half] == c) for c in range(n)]
    by_label = [x for x in by_label if len(x)]
    for _ in range(STEPS):
        # Two runs per sequence, each from a label drawn evenly; the second often switches the language.
        pick = lambda: np.array([by_label[c][rng.integers(len(by_label[c]))] for c in rng.integers(len(by_label), size=BATCH)])
        left, right = pick(), pick()
        right = np.where(rng.random(BATCH) < 0.5, np.minimum(left + half, len(y) - half), right)
        idx = np.concatenate([left[:, None] + np.arange(half), right[:, None] + np.arange(half)], axis=1)
        used, back = np.unique(number[idx], return_inverse=True)
        spans = edges[used + 1] - edges[used]
        flat = np.repeat(edges[used] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        own_edges = np.concatenate([[0], np.cumsum(spans)])
        emit = _emissions(model.weights, feats[flat], own_edges, lex[used])
        potential = emit[back.reshape(idx.shape)].astype(np.float64)
        post, pairs = _marginals(potential, model.transitions, model.start)
        gold = np.eye(n)[y[idx]]
        diff = gold - post
        per_word = np.zeros((len(used), n))
        np.add.at(per_word, back.ravel(), diff.reshape(-1, n))
        grad_w = np.zeros((FEATURES + n, n))
        np.add.at(grad_w, feats[flat], np.repeat(per_word, spans, axis=0))
        known = lex[used] >= 0
        np.add.at(grad_w, FEATURES + lex[used][known], per_word[known])
        true_pairs = np.zeros((n, n))
        np.add.at(true_pairs, (y[idx][:, :-1].ravel(), y[idx][:, 1:].ravel()), 1)
        for p, s, g in zip((model.weights, model.transitions, model.start), sums, (grad_w, true_pairs - pairs, diff[:, 0].sum(axis=0)), strict=True):
            g = g / BATCH
            s += g * g
            p += (0.15 * g / np.sqrt(s)).astype(p.dtype)
    return model


class Emissions:
    """Emission scores of words, and whether they have a letter; a task computes those of its frequent words once."""

    def __init__(self, model: Model):
        self.model = model
        self.hash, self.lettered = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.score = np.zeros((0, len(model.labels)))

    def of(self, words: Words, unique: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words with sorted hashes ``unique``, first seen at ``where``."""
        at = np.searchsorted(self.hash, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == unique[inside]
        new = np.flatnonzero(~known)
        start, end = words.start[where[new]], words.end[where[new]]
        lettered = _lettered(words, start, end)
        feats, edges = _features(words.raw, start, end)
        score = _emissions(self.model.weights, feats, edges, _lexicon_of(self.model.lexicon, self.model.entry, unique[new])).astype(np.float64)
        score[~lettered] = 0
        if len(self.hash) + len(new) > REMEMBERED:  # begin anew with what is at hand
            keep = np.flatnonzero(np.isin(self.hash, unique[known]))
            self.hash, self.score, self.lettered = self.hash[keep], self.score[keep], self.lettered[keep]
        place = np.searchsorted(self.hash, unique[new])
        self.hash = np.insert(self.hash, place, unique[new])
        self.score = np.insert(self.score, place, score, axis=0)
        self.lettered = np.insert(self.lettered, place, lettered)
        at = np.searchsorted(self.hash, unique)
        return self.score[at], self.lettered[at]


def word_posteriors(model: Model, words: Words, held: Emissions | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(posterior by word and label, whether the word has a letter), by forward-backward over each whole text."""
    n = len(model.labels)
    unique, where, number = np.unique(words.hash, return_index=True, return_inverse=True)
    emit, lettered = (held or Emissions(model)).of(words, unique, where)
    e = np.exp(emit - emit.max(axis=1, keepdims=True))[number] if len(emit) else np.zeros((0, n))
    post = np.multiply(*_forward_backward(e, np.exp(model.transitions - model.transitions.max()), np.exp(model.start), words.first))
    return post / post.sum(axis=1, keepdims=True), lettered[number]


def _forward_backward(e: np.ndarray, a: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward and backward vectors of the words of all texts (text i: words first[i] to first[i + 1]).

    Texts are cut into segments that go side by side.  A segment is a linear
    map of the vector before it: the products of its words' matrices carry
    both vectors over whole segments, so a long text takes few steps.
    """
    n = len(a)
    lengths = np.diff(first)
    size = SEGMENT if n <= 16 else max(int(lengths.max(initial=1)), 1)
    pieces = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), pieces)
    place = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)  # number of the segment in its text
    begin = first[:-1][text] + place * size
    long = np.minimum(lengths[text] - place * size, size)
    order = np.argsort(-long, kind="stable")
    active = np.searchsorted(-long[order], -np.arange(size), side="left")  # segments longer than t

    def scaled(x: np.ndarray) -> np.ndarray:
        return x / x.sum(axis=-1, keepdims=True)

    before, behind = np.tile(start, (len(text), 1)), np.ones((len(text), n))
    if (pieces > 1).any():
        product = np.tile(np.eye(n), (len(text), 1, 1))
        for t in range(size):
            some = order[: active[t]]
            # The first word of a text has no transition before it.
            x = np.where((place[some] > 0)[:, None, None] | (t > 0), product[some] @ a, product[some])
            x *= e[begin[some] + t][:, None, :]
            product[some] = x / x.sum(axis=(1, 2), keepdims=True)
        by_place = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[by_place], np.arange(int(pieces.max()) + 1))
        for k in range(1, int(pieces.max())):
            here = by_place[edges[k] : edges[k + 1]]
            before[here] = scaled(np.einsum("si,sij->sj", before[here - 1], product[here - 1]))
        for k in range(int(pieces.max()) - 1, 0, -1):
            here = by_place[edges[k] : edges[k + 1]]
            behind[here - 1] = scaled(np.einsum("sij,sj->si", product[here], behind[here]))
    alpha, beta = np.zeros_like(e), np.ones_like(e)
    for t in range(int(long.max(initial=0))):
        some = order[: active[t]]
        at = begin[some] + t
        came = before[some] if t == 0 else alpha[at - 1] @ a
        if t == 0:
            came = np.where(place[some][:, None] > 0, came @ a, came)
        alpha[at] = scaled(e[at] * came)
    beta[begin + long - 1] = behind
    for t in range(int(long.max(initial=0)) - 2, -1, -1):
        at = begin[order[: active[t + 1]]] + t
        beta[at] = scaled((beta[at + 1] * e[at + 1]) @ a.T)
    return alpha, beta


def _judge(model: Model, column: pa.Array, held: Emissions) -> tuple[list[str], np.ndarray]:
    """Label and score of each text."""
    n, rows = len(model.labels), len(column)
    words = Words(column, ALNUM, lower=True)
    label, score = ["und"] * rows, np.zeros(rows)
    raw = words.raw
    ascii_letter = np.concatenate([[0], np.cumsum(((raw | 32) >= 97) & ((raw | 32) <= 122))])
    beyond = np.concatenate([[0], np.cumsum(raw >= 128)])
    lo, hi = words.offsets[:-1], words.offsets[1:]
    letters = ascii_letter[hi] > ascii_letter[lo]
    for i in np.flatnonzero(~letters & (beyond[hi] > beyond[lo])):
        letters[i] = any(c.isalpha() for c in column[int(i)].as_py())
    sums = np.zeros((rows, n))
    if n:
        post, lettered = word_posteriors(model, words, held)
        doc = words.doc[lettered]
        for c in range(n):
            sums[:, c] = np.bincount(doc, post[lettered, c], rows)
    total = sums.sum(axis=1)
    for i in np.flatnonzero(letters) if n else ():
        share = sums[i] / total[i] if total[i] > 0 else np.full(n, 1 / n)
        best = int(share.argmax())
        label[i], score[i] = model.labels[best], min(1.0, float(share[best]))
    return label, score


def _predict(shared):
    def run(batches):
        held = Emissions(shared.value)
        for whole in batches:
            for batch in slices(whole):
                label, score = _judge(shared.value, batch.column("text"), held)
                yield pa.record_batch([batch.column("doc_id"), pa.array(label, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return run


def language_of(text: Column, model: Model) -> Column:
    """(lang_pred, score) of a text column, beside the row's other columns, which stay where they are."""
    shared = SparkSession.active().sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = Emissions(shared.value)
        for whole in batches:
            label, score = [], []
            for batch in slices(pa.record_batch([whole], ["text"])):
                x, y = _judge(shared.value, batch.column("text"), held)
                label += x
                score.append(y)
            yield pa.StructArray.from_arrays([pa.array(label, pa.string()), pa.array(np.concatenate([*score, np.zeros(0)]))], ["lang_pred", "score"])

    return F.arrow_udf(judge, "lang_pred string, score double")(text)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_label: int = PER_LABEL) -> Model:
    """Fit on labelled rows whose crc32(id) mod 3 is not 1.

    Distinct rows are sampled by a hash of id, text and label: ``per_label`` a
    label in expectation, MAX_SAMPLE rows and SAMPLE_BYTES of text in all.
    Where every drawn text is too long, the shortest text of each label is
    taken; it is an error if labelled rows exist but none fits.
    """
    side = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    rows = docs.filter((side != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumns({"n": F.octet_length("text"), "draw": F.xxhash64("id", "text", "lang")})
    sizes = {r[0]: r[1:] for r in rows.groupBy("lang").agg(F.count("*").alias("c"), F.min(F.struct("n", "draw")).alias("least")).orderBy(F.desc("c"), "lang").limit(MAX_SAMPLE).collect()}
    wanted = min(per_label, max(1, MAX_SAMPLE // max(len(sizes), 1)))
    draw = F.pmod("draw", F.lit(1 << 30)).cast("double") / float(1 << 30)
    share = F.coalesce(*[F.when(F.col("lang") == c, F.lit(min(1.0, wanted / n))) for c, (n, _) in sizes.items()]) if sizes else F.lit(0.0)
    # Lengths first, so that what is fetched is bounded by rows and by bytes.
    drawn = rows.filter((draw < share) & (F.col("n") <= SAMPLE_BYTES // 64)).select("draw", "n").distinct().orderBy("draw").limit(MAX_SAMPLE).toArrow()
    taken = drawn["draw"].to_numpy()[np.cumsum(drawn["n"].to_numpy()) <= SAMPLE_BYTES].tolist()
    if not taken:
        shortest = sorted(least for _, least in sizes.values())
        taken = [x["draw"] for x, total in zip(shortest, np.cumsum([x["n"] for x in shortest]), strict=True) if total <= SAMPLE_BYTES]
    if sizes and not taken:
        raise ValueError(f"labelled rows exist, but no text of them has at most {SAMPLE_BYTES} bytes")
    sample = rows.filter(F.col("draw").isin(taken)).select("id", "text", "lang").dropDuplicates(["id", "text", "lang"]).collect() if taken else []
    sample.sort(key=lambda r: (r["lang"], r["id"] is None, r["id"], r["text"]))
    model = fit([r["text"] for r in sample], [r["lang"] for r in sample])
    del sample
    trim()  # the driver lives on with the model alone
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for each input row.

    A null text or one without a letter is ``und`` with score 0; so is every
    text if the model has no label.  Ties go to the smaller label.  Repeated
    rows are judged each; other columns are never read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
