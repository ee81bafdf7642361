"""Plain versions of operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

BLANKS = b" \t\n\r\x0b\x0c"


def words(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()


def shingle_set(text):
    w = words(text)
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def components(rows, percent=85):
    """doc_id -> (set size, smallest reachable id), by comparing all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        both = len(s & t)
        if s and t and 100 * both >= percent * (len(s) + len(t) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def long_matches(rows, length=200):
    """Sorted (doc_id, bytes, removed, spans, hash, kept) by counting every window."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[k : k + length] for _, d in data for k in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[4]))


def pieces(text, window=8):
    """Words with the white space behind them, in pieces; a sentence is cut before the smallest hash of every window."""
    import re

    found = re.findall(rb"[^ \t-\r]+[ \t-\r]*", (text or "").encode())
    sentences = []
    for i, g in enumerate(found):
        if i == 0 or b"\n" in found[i - 1] or re.search(rb"[.!?][ \t-\r]+$", found[i - 1]):
            sentences.append([])
        sentences[-1].append(g)
    out = []
    for s in sentences:
        key = [hashlib.md5(g.strip(BLANKS)).digest()[:8] for g in s]
        cuts = {0, len(s)}
        if len(s) > window:
            cuts |= {min(range(i, i + window), key=lambda k: (key[k], k)) for i in range(len(s) - window + 1)}
        cuts = sorted(cuts)
        out += [s[i:j] for i, j in zip(cuts, cuts[1:])]
    return out


def spans(rows, span=3):
    """Sorted (doc_id, removed, text): every run of so many pieces that is not the first of its words goes."""
    def place(i, t):
        return (i is not None, i or 0, int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16))

    runs = {}
    cut = {place(i, t): pieces(t) for i, t in rows}
    for p, ps in cut.items():
        own = [(a, a + span) for a in range(len(ps) - span + 1)]
        for a, b in own:
            runs.setdefault(tuple(g.strip(BLANKS) for x in ps[a:b] for g in x), []).append((p, a, b))
    gone = {p: set() for p in cut}
    for places in runs.values():
        first = min((p, a) for p, a, _ in places)
        for p, a, b in places:
            if (p, a) != first:
                gone[p] |= set(range(a, b))
    out = []
    for i, t in rows:
        p = place(i, t)
        lead = (t or "").encode()
        lead = lead[: len(lead) - len(lead.lstrip(BLANKS))]
        left = (lead + b"".join(b"".join(x) for k, x in enumerate(cut[p]) if k not in gone[p])).decode() if gone[p] else t
        out.append((i, len(gone[p]), left))
    return sorted(out, key=repr)
