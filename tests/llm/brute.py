"""Plain versions of the operators, for small inputs: one document at a time, all pairs, no hashing tricks."""

from __future__ import annotations

import re
from collections import Counter
from hashlib import sha256

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in lines:
        repeated += line in seen
        seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def fingerprint(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(lower)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_components(rows):
    """doc_id -> (fingerprint, component) over all pairs."""
    prints = [(d, fingerprint(t)) for d, t in rows]
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for k in range(i):
            if bin(prints[i][1] ^ prints[k][1]).count("1") <= 3:
                a, b = group[i], group[k]
                group = [b if g == a else g for g in group]
    least = {g: min((d for (d, _), h in zip(prints, group) if h == g and d is not None), default=None) for g in group}
    return sorted(((d, f"{f:016x}", least[g]) for (d, f), g in zip(prints, group)), key=str)


def without_repeats(rows, window=50):
    """(doc_id, words, kept words) by comparing every window with all smaller documents."""
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None:
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if d is not None and first[key] < d:
                gone |= set(range(i, i + window))
        out.append((d, w, [x for i, x in enumerate(w) if i not in gone]))
    return out


def repeat_rows(rows):
    return sorted(((d, len(w), len(w) - len(k), sha256(" ".join(k).encode()).hexdigest()) for d, w, k in without_repeats(rows)), key=str)


def contained(documents, items, share=(8, 10)):
    def parts(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = []
    for d, t in documents:
        for item, text in items:
            n = min(5, len(parts(text)))
            own = grams(parts(text), n) if n else set()
            held = len(own & grams(parts(t), n)) if n else 0
            if own and held * share[1] >= len(own) * share[0]:
                out.append((d, item, held, len(own)))
    return sorted(out, key=str)
