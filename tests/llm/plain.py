"""Plain versions of the operators, on Python lists: rows are (id, text)."""

import hashlib
import math
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ENDS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def base(text):
    w = words(text)
    windows = list(zip(w, w[1:], w[2:], strict=False))
    often, covered = Counter(windows), set()
    for k, window in enumerate(windows):
        if often[window] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def bucket(parts, buckets):
    seed = 42
    for part in parts:
        seed = xxhash.xxh64(part.encode(), seed=seed).intdigest()
    return (seed - (1 << 64) if seed >> 63 else seed) % buckets


def quality(rows, good, buckets, prior, threshold):
    grams = [[bucket((x,), buckets) for x in w] + [bucket(x, buckets) for x in zip(w, w[1:], strict=False)] for w in (words(t) for _, t in rows)]
    raw, trusted = Counter(), Counter()
    for (key, _), g in zip(rows, grams, strict=True):
        raw.update(g)
        if key in good:
            trusted.update(g)
    n, m = sum(raw.values()), sum(trusted.values())
    p = {b: (raw[b] + 1) / (n + buckets) for b in range(buckets)}
    ratio = {b: math.log((trusted[b] + prior * buckets * p[b]) / (m + prior * buckets)) - math.log(p[b]) for b in p}
    scores = [sum(ratio[b] for b in g) / len(g) if g else 0.0 for g in grams]
    return [(key, *base(text), score, not base(text)[5] and score >= threshold) for (key, text), score in zip(rows, scores, strict=True)]


def line_dedup(rows):
    keys, top = {}, {}
    for key, text in rows:
        for line in (text or "").split("\n"):
            k = line.strip(ENDS).translate(LOWER)
            if len(k) >= 20:
                keys.setdefault(k, set()).add(key)
    for k, ids in keys.items():
        top[k] = max((i for i in ids if i is not None), default=None)
    out = []
    for key, text in rows:
        lines = (text or "").split("\n")
        norm = [x.strip(ENDS).translate(LOWER) for x in lines]
        kept = [x for x, k in zip(lines, norm, strict=True) if k not in keys or len(keys[k]) < 3 or top[k] == key]
        out.append((key, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def shingles(text):
    w = words((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), key), key)
    return [(key, len(s), least[find(k)]) for k, ((key, _), s) in enumerate(zip(rows, sets, strict=True))]


def leaks(rows, items):
    out = set()
    tests = [(i, shingles(t)) for i, t in items]
    for key, text in rows:
        has = shingles(text)
        for item, s in tests:
            if s and 5 * len(s & has) >= 4 * len(s):
                out.add((key, item, len(s), len(s & has)))
    return sorted(out, key=str)


def repeats(texts, length=400):
    seen = Counter(b[k : k + length] for b in ((t or "").encode() for t in texts) for k in range(len(b) - length + 1))
    out = []
    for b in ((t or "").encode() for t in texts):
        covered = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                covered[k : k + length] = b"\x01" * length
        runs = sum(1 for k in range(len(b)) if covered[k] and (k == 0 or not covered[k - 1]))
        out.append((len(b), sum(covered), runs, sha(bytes(x for x, c in zip(b, covered, strict=True) if not c))))
    return out
