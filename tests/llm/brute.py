"""Plain restatements of the contracts, for small tables."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def components(rows):
    """[(n_shingles, component)] of rows (id, text), each row a vertex."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(len(s), low.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


RULES = [("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]


def secrets(text):
    spans = sorted((m.start(), k, m.end()) for k, (_, rx, g, least) in enumerate(RULES) for m in re.finditer(rx, text or "", re.A) if len(m[g]) >= least)
    return [sum(s[1] == k for s in spans) for k in range(3)], sha(",".join(f"{RULES[k][0]}:{a}:{b}" for a, k, b in spans))


def without_repeats(rows):
    """[(n_words, n_removed, sha)] of rows (id, text)."""
    low = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - 12):
            if d is not None:
                key = tuple(w[j : j + 13])
                low[key] = min(low.get(key, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if d is not None and low[tuple(w[j : j + 13])] < d:
                gone[j : j + 13] = [True] * 13
        out.append((len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def contaminated(rows, items):
    """[(n_words, n_hit, n_items, sha, contaminated)]."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for name, t in items:
        w = split(t)
        for j in range(max(0, len(w) - 13) + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(str(name))
    sizes = {len(k) for k in windows}
    out = []
    for _, t in rows:
        w = split(t)
        hit, found = [0] * len(w), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if names := windows.get(tuple(w[j : j + n])):
                    found |= names
                    hit[j : j + n] = [1] * n
        n = sum(hit)
        out.append((len(w), n, len(found), sha(",".join(sorted(found))), n > 0 and 20 * n >= len(w)))
    return out


def n_links(rows):
    """For each row the number of other rows that reach the threshold with it."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return [sum(i != j and bool(a) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]


def near_items(rows, items, k, span):
    """{id: items with a window all of whose words lie within ``span`` consecutive words}."""
    out = {}
    for d, t in rows:
        w, found = t.split(), set()
        for name, x in items:
            x = x.split()
            windows = [set(x[j : j + k]) for j in range(max(0, len(x) - k) + 1 if x else 0)]
            if any(n <= set(w[i : i + span]) for n in windows for i in range(max(1, len(w) - span + 1))):
                found.add(str(name))
        out[d] = found
    return out


def without_repeated_lines(rows, least=10):
    """[(n_lines, n_dropped, sha)] of rows (id, text)."""
    first, docs = {}, {}
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOW)
    for d, t in rows:
        for line in (t or "").split("\n"):
            k = key(line)
            if d is not None and len(k) >= least:
                docs.setdefault(k, set()).add(d)
    first = {k: min(v) for k, v in docs.items() if len(v) > 1}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if d is None or first.get(key(x), d) == d]
        out.append((len(lines), len(lines) - len(left), sha("\n".join(left))))
    return out


def collocations(rows, least, longest=5, top=2000, absorbed=100):
    """[(lang, rank, phrase, a, l, r, n, score)] of rows (lang, text)."""
    f, n = {}, {}
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] = n.get(lang or "und", 0) + len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    key = (lang or "und", *w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    cands = {k: a for k, a in f.items() if len(k) > 2 and a >= least}
    gone = set()
    for k, a in cands.items():
        w = k[1:]
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= absorbed * f[(k[0], *w[i : i + m])]:
                    gone.add((k[0], *w[i : i + m]))
    out = {}
    for k, a in cands.items():
        if k not in gone:
            cuts = [(1000 * a * n[k[0]] // (f[k[: j + 1]] * f[(k[0], *k[j + 1 :])]), j) for j in range(1, len(k) - 1)]
            score, j = min(cuts)
            out.setdefault(k[0], []).append((-score, -a, " ".join(k[1:]).encode(), f[k[: j + 1]], f[(k[0], *k[j + 1 :])]))
    return [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top])]


def resampled(rows, items, percent=5, least=20, buckets=10_000):
    """[(id, n_features, weight, score, rank)] of rows (id, text)."""
    import math
    import zlib

    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    own, target = [features(t) for _, t in rows], [features(t) for t in items]
    s, t = [0] * buckets, [0] * buckets
    for side, found in ((s, own), (t, target)):
        for _, buckets_of in found:
            for b in buckets_of:
                side[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for (d, _), (_, b) in zip(rows, own, strict=True):
        weight = sum(gain[x] for x in b)
        u = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(b), weight, None if d is None else weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None])
    usable = sorted((-x[3], x[0], x[1], x[2], i) for i, (x, (n, _)) in enumerate(zip(out, own, strict=True)) if n >= least and x[0] is not None)
    for rank, (*_, i) in enumerate(usable[: percent * len(usable) // 100]):
        out[i][4] = rank + 1
    return [tuple(x) for x in out]
