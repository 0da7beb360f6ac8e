"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeats(texts, length):
    data = {i: (t or "").encode() for i, t in texts.items()}
    count = Counter(b[p : p + length] for b in data.values() for p in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def shared(texts, window):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingles(text, size):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def near(texts, size, percent=80):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverted[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def exact(texts):
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in texts.items()}
    groups = defaultdict(list)
    for i, n in norm.items():
        groups[n].append(i)
    keep = {n: min(g, key=lambda i: (-len(texts[i] or ""), i)) for n, g in groups.items()}
    return {i: (keep[n], len(groups[n]), keep[n] == i, sha(n)) for i, n in norm.items()}


def contaminated(texts, items, span=11, window=20, agree=0.8):
    """(document, item) -> words that agree and length of the best window, over all alignments."""
    from math import ceil

    import numpy as np

    code = {}
    coded = lambda t: np.array([code.setdefault(w, len(code)) for w in WORD.findall((t or "").lower())], dtype=int)
    docs, held = {i: coded(t) for i, t in texts.items()}, {i: coded(t) for i, t in items.items()}
    out = {}
    for j, b in held.items():
        if not len(b):
            continue
        for i, a in docs.items():
            if not np.isin(b, a).any():
                continue
            best = (0, 0)
            for shift in range(1 - len(b), len(a)):
                x = a[max(shift, 0) : shift + len(b)]
                flags = (x == b[max(-shift, 0) : max(-shift, 0) + len(x)]).astype(int)
                n = min(window, len(flags))
                if n < min(span, len(b)) or flags.sum() < n * agree:
                    continue
                most = int(np.convolve(flags, np.ones(n, dtype=int), "valid").max())
                if most >= (n if n < span else ceil(n * agree)):
                    best = max(best, (most, n))
            if best[0]:
                out[i, j] = best
    return out
