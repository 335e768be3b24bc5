"""Secret scan by a trigram inverted index.

Each rule's regex is turned into a Boolean trigram query.  Every shard of
texts (one slice of a task) gets an inverted index of the trigrams that the
queries name; posting lists are document bitmaps, which the query intersects
and unites.  Only the candidates are matched with the regex.  A rule whose
regex has no mandatory trigram scans every text of the shard.

Shards are cut by rows inside the tasks, so nothing is shuffled and no key can
be hot; one text is never split.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import product
from re import _constants as _op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talliver.llm.common import table, texts_of, with_text
from talliver.llm.textkernels import slices, text_buffer


@dataclass(frozen=True)
class Rule:
    """A named pattern; a match counts if its ``group`` has at least ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# Fixed values of the contract: the three base rules, in the order of their kinds.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]+", 0, 16, True),
)
# Further credential formats that their issuers publish.
MORE_RULES = (
    # The body goes with its header: to the END line, or to the text's end where there is none.
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]{0,24}PRIVATE KEY-----|[\s\S]*)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("dburl", r"(?:postgres|postgresql|mysql|mongodb|redis|amqp)(?:\+[a-z]+)?://[^\x00-\x20:/@]*:[^\x00-\x20/@]+@[^\x00-\x20/@]+"),
)
ALL_RULES = BASE_RULES + MORE_RULES

#: A set of strings is kept exactly up to so many members, then becomes trigrams.
EXACT = 16


def _needs(strings: frozenset[str]) -> frozenset | None:
    """An OR of ANDs of trigrams that each text with one of the strings has; None if nothing is mandatory."""
    if not strings or any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a, b):
    if a is None or b is None:
        return b if a is None else a
    out = frozenset(x | y for x, y in product(a, b))
    return out if len(out) <= 64 else a


def _either(parts):
    return None if any(p is None for p in parts) else frozenset().union(*parts)


def _walk(tree) -> tuple[frozenset[str] | None, frozenset | None]:
    """(exact strings if few, Boolean query) of a parsed regex; letters in lower case."""
    exact, query = frozenset([""]), None

    def close():
        nonlocal exact, query
        query, exact = _both(query, _needs(exact)), frozenset([""])

    for kind, arg in tree:
        if kind is _op.LITERAL:
            got, sub = frozenset([chr(arg).lower()]), None
        elif kind is _op.SUBPATTERN:
            got, sub = _walk(arg[3])
        elif kind is _op.BRANCH:
            branches = [_walk(b) for b in arg[1]]
            if all(e is not None for e, _ in branches):
                got, sub = frozenset().union(*[e for e, _ in branches]), None
            else:
                got, sub = None, _either([_both(q, _needs(e) if e is not None else None) for e, q in branches])
        elif kind in (_op.MAX_REPEAT, _op.MIN_REPEAT) and arg[:2] == (0, 1):
            inner, _ = _walk(arg[2])
            got, sub = (inner | {""} if inner is not None else None), None
        elif kind in (_op.MAX_REPEAT, _op.MIN_REPEAT) and arg[0] >= 1:
            _, sub = _walk(arg[2])
            got = None
        elif kind is _op.IN and all(k is _op.LITERAL for k, _ in arg):
            got, sub = frozenset(chr(c).lower() for _, c in arg), None
        elif kind is _op.AT:
            continue
        else:
            got, sub = None, None
        if got is None:
            close()
            query = _both(query, sub)
        else:
            joined = frozenset(a + b for a, b in product(exact, got))
            if len(joined) > EXACT:
                close()
                joined = got
            exact = joined
    if query is None:
        return exact, None
    close()
    return None, query


def trigram_query(pattern: str) -> frozenset | None:
    """OR over AND-sets of lower-case trigrams that a match must contain; None: the rule scans fully."""
    exact, query = _walk(_parser.parse(pattern))
    return _both(query, _needs(exact)) if exact is not None else query


class Index:
    """Posting bitmaps of the wanted trigrams over the texts of one shard."""

    def __init__(self, wanted: list[str]):
        self.wanted = {t: i for i, t in enumerate(sorted(wanted))}
        self.codes = np.array([(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2]) for t in sorted(wanted)], np.int32)
        self.known = np.zeros(1 << 24, np.int16)
        self.known[self.codes] = np.arange(1, len(self.codes) + 1)
        self.fold = np.arange(256, dtype=np.int32)
        self.fold[65:91] += 32

    def post(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A Boolean matrix, trigrams by texts."""
        n = len(offsets) - 1
        out = np.zeros((len(self.codes), n), bool)
        if len(raw) < 3:
            return out
        low = self.fold[raw]
        which = self.known[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(which)
        doc = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[doc + 1]
        out[which[at[inside]] - 1, doc[inside]] = True
        return out

    def candidates(self, query, postings: np.ndarray) -> np.ndarray:
        if query is None:
            return np.ones(postings.shape[1], bool)
        found = np.zeros(postings.shape[1], bool)
        for grams in query:
            found |= np.logical_and.reduce(postings[[self.wanted[g] for g in grams]])
        return found


def _runs(raw: np.ndarray, offsets: np.ndarray, members: np.ndarray, least: int) -> np.ndarray:
    """Which texts hold a run of ``least`` bytes of one class: a full scan of the shard."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = members[raw]
    step = np.diff(inside.view(np.int8), prepend=0)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = end - start >= least  # a run over a text's end is cut there by the exact match
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, start[long], side="right") - 1] = True
    for s, e in zip(start[long], end[long], strict=True):
        a, b = np.searchsorted(offsets, [s, e - 1], side="right") - 1
        out[a : b + 1] = True
    return out


def _scan(rules: tuple[Rule, ...], mask: str | None, text_col: str):
    def run(batches):
        compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        classes: list[np.ndarray | None] = []
        for r in rules:  # a full scan over a byte class is done on the buffer
            m = re.fullmatch(r"(\[[^\]]+\])\+", r.pattern)
            classes.append(np.array([b < 128 and re.match(m[1], chr(b)) is not None for b in range(256)]) if m else None)
        index = Index(sorted({g for q in queries if q for grams in q for g in grams}))
        for whole in with_text(batches, text_col):
            for batch in slices(whole):
                raw, offsets = text_buffer(batch.column("text"))
                postings = index.post(raw, offsets)
                hits = [_runs(raw, offsets, c, r.least) if q is None and c is not None else index.candidates(q, postings) for r, q, c in zip(rules, queries, classes, strict=True)]
                todo = np.logical_or.reduce(hits)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
                texts = batch.column("text")
                for i in np.flatnonzero(todo):
                    text = texts[int(i)].as_py() or ""
                    for kind, rule in enumerate(rules):
                        if hits[kind][i]:
                            found[i] += [(m.start(), kind, m.end()) for m in compiled[kind].finditer(text) if len(m[rule.group]) >= rule.least]
                out = {c: [] for c in ("n", "base", "all", "kinds", "masked")}
                for i, spans in enumerate(found):
                    spans.sort()
                    name = lambda s: f"{rules[s[1]].name}:{s[0]}:{s[2]}"
                    base = [s for s in spans if rules[s[1]].base]
                    out["n"].append([sum(s[1] == k for s in spans) for k in range(len(rules))])
                    out["base"].append(hashlib.sha256(",".join(map(name, base)).encode()).hexdigest())
                    out["all"].append(",".join(map(name, spans)))
                    out["kinds"].append(",".join(sorted({rules[s[1]].name for s in spans})))
                    text = texts[i].as_py() if mask is not None else None
                    if mask is not None and spans:
                        parts, done = [], 0
                        for a, _, b in spans:
                            if b > done:
                                parts += [text[done:a], mask] if a >= done else []
                                done = b
                        text = "".join(parts) + text[done:]
                    out["masked"].append(text)
                yield pa.record_batch(
                    [*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array(out["n"], pa.list_(pa.int64())), pa.array(out["base"]), pa.array(out["all"]), pa.array(out["kinds"]), pa.array(out["masked"], pa.string())],
                    [*[c for c in batch.schema.names if c != "text"], "counts", "base_sha256", "spans", "kinds", "masked"],
                )

    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = ALL_RULES, mask: str | None = None, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, counts (by rule), base_sha256, spans, kinds, masked
    (and the row itself as a struct, if ``carry``).

    Spans are ``name:start:end`` in code points, by start, then rule order.
    ``masked`` is the text with every span replaced by ``mask`` (overlapping
    spans once); null if no mask is asked for or the text is null.  A null or
    empty text has no spans.  Repeated rows give repeated results.
    """
    texts, schema = texts_of(docs, id_col, text_col, carry, "counts array<long>, base_sha256 string, spans string, kinds string, masked string")
    return texts.mapInArrow(_scan(rules, mask, text_col), schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    named = [F.col("counts")[i].alias(f"n_{r.name}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *named, "base_sha256", "spans")
