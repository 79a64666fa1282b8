"""Plain Python versions of the operators, over lists of rows."""

import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def join(docs, k, num, den):
    """doc_id -> (n_shingles, component_id)"""
    sets = [(d, shingles(t, k)) for d, t in docs]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_word = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            by_word.setdefault(x, []).append(i)
    seen = set()
    for at in by_word.values():
        for a in at:
            for b in at:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    x, y = sets[a][1], sets[b][1]
                    if den * len(x & y) >= num * len(x | y):
                        root[find(b)] = find(a)
    low = {}
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(s), low[find(i)]) for i, (d, s) in enumerate(sets)}


def substrings(docs, length=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)"""
    data = [(d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, b in data:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def unigrams(docs):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score)"""
    counts = {}
    for d, t in docs:
        if not held(d, 7, 2):
            for w in [*words(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    out = {}
    for d, t in docs:
        tokens = [*words(t), None]
        out[d] = (held(d, 7, 2), len(tokens), sum(w in counts for w in tokens), n, sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens))
    return out


def word_runs(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, window=10):
    wins = {}
    for k, t in items:
        w = word_runs(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(k))
    lengths = {len(x) for x in wins}
    out = {}
    for d, t in docs:
        w = word_runs(t)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (s := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    found |= wins[s]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
