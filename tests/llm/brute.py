"""Straightforward versions of the operators, for small tables: rows are plain tuples, nothing is hashed or sampled."""

import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np

SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"]))


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def licenses(docs):
    """``{doc_id: (n_words, n_base, first_word, last_word, base_labels)}``."""
    out = {}
    for d, t in docs:
        w = LICENSE_WORD.findall(ascii_lower(t or ""))
        hits = [(i, label) for label, p in PHRASES for i in range(len(w)) if w[i : i + len(p)] == p]
        at = [i for i, _ in hits]
        out[d] = (len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))
    return out


def exact(docs):
    """``[(doc_id, keep_id, group_size, kept, text_sha256)]``."""
    t = [(d, SPACE.sub(" ", x or "")) for d, x in docs]
    groups = defaultdict(list)
    for d, x in t:
        groups[x].append(d)
    return [(d, min(groups[x]), len(groups[x]), d == min(groups[x]), sha256(x.encode()).hexdigest()) for d, x in t]


def repeats(docs, length=20):
    """``{doc_id: (n_words, n_removed, kept_sha256)}`` for unique ids."""
    first, out = {}, {}
    split = {d: WORD.findall(t or "") for d, t in docs}
    for d in sorted(split):
        w = split[d]
        for s in range(len(w) - length + 1):
            first.setdefault(tuple(w[s : s + length]), (d, s))
    for d, w in split.items():
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if first[tuple(w[s : s + length])] < (d, s):
                gone[s : s + length] = [True] * length
        out[d] = (len(w), sum(gone), sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def near(docs, shingle=3, threshold=85):
    """``{doc_id: (n_shingles, component_id)}`` for unique ids, from an inverted index of the shingles themselves."""
    sets = {}
    for d, t in docs:
        w = WORD.findall(ascii_lower(t or ""))
        sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    held = defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            held[s].append(d)
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d in sets:
        shared = Counter(e for s in sets[d] for e in held[s] if e < d)
        for e, n in shared.items():
            if 100 * n >= threshold * (len(sets[d]) + len(sets[e]) - n):
                a, b = root(d), root(e)
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def neighbours(vectors, k=20, every=20):
    """``{query_id: [(vec_id, score)]}``, nearest first."""
    good = [(i, np.asarray(v, np.float64)) for i, v in vectors if v is not None and len(v) and None not in v and np.isfinite(np.asarray(v, np.float64)).all() and np.any(v)]
    out = {}
    for q, x in good:
        if q % every == 0:
            scores = [(-float((y * x).sum()), i) for i, y in good if i != q and len(y) == len(x)]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def crc_of(ids):
    return crc32(np.asarray(ids, "<u4").tobytes())
