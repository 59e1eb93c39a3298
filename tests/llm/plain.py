"""Brute-force versions of the operators, in plain Python."""

import collections
import fractions
import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(LOWER)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingle_set(text):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(rows):
    """doc_id -> (set size, component), by an index of runs; ids are unique."""
    sets, holders, links = {i: shingle_set(t) for i, t in rows}, collections.defaultdict(list), []
    for i in sorted(sets):
        shared = collections.Counter()
        for s in sets[i]:
            shared.update(holders[s])
            holders[s].append(i)
        links += [(i, j) for j, c in shared.items() if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c)]
    found = components(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def vector_links(rows, least=0.95):
    good = {i: np.array(v, float) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids, links = sorted(good), []
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = good[i], good[j]
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links.append((i, j))
    count = collections.Counter(x for pair in links for x in pair)
    found = components([i for i, _ in rows], links)
    return {i: (count[i], found[i]) for i, _ in rows}


def line_dedup(rows):
    """doc_id -> (lines, dropped, sha256 of the rest)."""
    strip = " \t\n\v\f\r"
    first = {}
    for i, t in sorted(rows):
        for line in (t or "").split("\n"):
            key = lower(line.strip(strip))
            if len(key) >= 10:
                first.setdefault(key, i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(lower(x.strip(strip)), i) == i]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def mix_targets(sizes):
    """source -> target words; sizes: source (or None) -> words."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def hard_negatives(rows, is_anchor, scale=256, positives=5, negatives=5, low=80, high=100):
    """(anchor, positive, rank, negative, scores) by a full sort of each anchor; rows: (id, label, vector)."""
    good = [
        (i, label, [int(np.floor(scale * float(x))) for x in v])
        for i, label, v in rows
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for k, (i, label, v) in enumerate(good):
        if not is_anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, m == label) for n, (j, m, w) in enumerate(good) if n != k and len(w) == len(v)]
        scored.sort(key=lambda x: x[:2])
        for s, j, _ in [x for x in scored if x[2]][:positives]:
            found = [x for x in scored if not x[2] and low * -s <= high * -x[0] and -x[0] <= -s][:negatives]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(found, 1)]
    return sorted(out)


def runs(words, least=24, periods=3):
    """(start, length, period) of every run, by trying all periods."""
    number = {}
    x = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    found = {}
    for q in range(1, len(x) // periods + 1):
        ends = np.concatenate([[-1], np.flatnonzero(x[q:] != x[:-q]), [len(x) - q]])
        for k in np.flatnonzero(np.diff(ends) - 1 + q >= max(least, periods * q)):
            found.setdefault((int(ends[k]) + 1, int(ends[k + 1]) + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(doc_id, text):
    """The row of a document: n_runs, the greatest run, exponent in thousandths and the two digests."""
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(found, key=lambda r: (r[0], r[2])))
    best = min(found, key=lambda r: (-fractions.Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    milli = 1000 * best[1] // best[2] if found else None
    return (len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
