"""Plain re-statements of the contracts, for small tables."""

import hashlib
import re
from collections import defaultdict

SPACES = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t: str) -> bytes:
    return (t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def shingles(text, width=5):
    w = SPACES.findall(lower(text)) if text else []
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard_components(docs, percent=75):
    """{doc_id: smallest doc_id reachable} over (doc_id, text)."""
    sets = defaultdict(list)
    for d, t in docs:
        if d is not None:
            sets[d].append(shingles(t))
    ids, up = sorted(sets), {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                r, s = sorted((find(a), find(b)))
                up[s] = r
    return {d: find(d) for d in ids}


def substring_dedup(docs, window=50):
    """(words, kept words) of every (doc_id, text)."""
    first = {}
    for d, t in docs:
        w = SPACES.findall((t or "").encode())
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w = SPACES.findall((t or "").encode())
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def decontaminate(docs, items, window=13):
    """(n_words, n_hit, items) of every text."""
    wins = set()
    for i, t in items:
        w = ALNUM.findall(lower(t))
        size = min(window, len(w))
        wins |= {(str(i) if i is not None else "null", tuple(w[j : j + size])) for j in range(len(w) - size + 1) if size}
    out = []
    for t in docs:
        w = ALNUM.findall(lower(t))
        hit, found = set(), set()
        for i, k in wins:
            for p in range(len(w) - len(k) + 1):
                if tuple(w[p : p + len(k)]) == k:
                    hit.update(range(p, p + len(k)))
                    found.add(i)
        out.append((len(w), len(hit), sorted(found)))
    return out


def sha(words):
    return hashlib.sha256(b" ".join(words)).hexdigest()
