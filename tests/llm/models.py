"""Brute-force versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import regex


def words(text):
    return regex.sub(r"[^\p{L}\p{N}\p{M}]+", " ", (text or "").lower()).split()


def shingles(text, k=5, short=True):
    w = words(text)
    if len(w) < k:
        return frozenset([tuple(w)] if w and short else [])
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def classes(docs, alike=0.8):
    """[(doc_id, text)] -> sorted (doc_id, class_id, n_links, n_texts, n_copies)."""
    by_words = defaultdict(list)
    for doc_id, text in docs:
        by_words[" ".join(words(text))].append(doc_id)
    names = list(by_words)
    sets = [shingles(n) for n in names]
    above = list(range(len(names)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    linked = defaultdict(set)
    for i in range(len(names)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= alike:
                linked[i].add(j)
                linked[j].add(i)
                above[top(i)] = top(j)
    members = defaultdict(list)
    for i, n in enumerate(names):
        members[top(i)] += by_words[n]
    out = []
    for i, n in enumerate(names):
        ids = [d for d in members[top(i)] if d is not None]
        for doc_id in by_words[n]:
            out.append((doc_id, min(ids) if ids else None,
                        sum(len(by_words[names[j]]) for j in linked[i]) + len(by_words[n]) - 1,
                        len(linked[i]), len(by_words[n])))
    return sorted(out, key=repr)


def without_repeats(texts, size):
    """[text] -> [(n_bytes, n_removed, n_spans, kept)]."""
    data = [(t or "").encode() for t in texts]
    often = Counter(b[i:i + size] for b in data for i in range(len(b) - size + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - size + 1):
            if often[b[i:i + size]] > 1:
                gone[i:i + size] = [True] * size
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, bytes(c for c, g in zip(b, gone) if not g)))
    return out


def winnow(text, units, hash_of, k, w):
    """Kept (position, gram) pairs of a list of units, by the definition."""
    if not units:
        return []
    grams = [tuple(units[i:i + k]) for i in range(len(units) - k + 1)] or [tuple(units)]
    h = [hash_of(g) for g in grams]
    spans = [range(i, i + w) for i in range(len(h) - w + 1)] or [range(len(h))]
    return sorted({max(s, key=lambda i: (-h[i], i)) for s in spans})


def digest(data):
    return hashlib.sha256(data).hexdigest()
