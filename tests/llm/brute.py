"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}


def words(text, lower=False):
    found = WORD.findall(text or "")
    return [w.translate(UPPER) for w in found] if lower else found


def shingles(text, n=5):
    w = words(text, lower=True)
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)}


def components(rows, percent=80):
    """rows: (doc_id, text); returns (doc_id, n_shingles, component_id) in the same order."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    posting = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            posting[x].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in posting[x] if j < i)
        for j, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


def stripped_words(rows, width=35):
    """rows: (doc_id, text); returns (doc_id, n_words, n_removed, kept text)."""
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def stripped_bytes(rows, width=400):
    """rows: (doc_id, text); returns (doc_id, n_bytes, n_removed, starts, ends, kept bytes)."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + width] for b in texts for i in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(rows, texts):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        starts = [i for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])]
        ends = [i + 1 for i in range(len(b)) if gone[i] and (i + 1 == len(b) or not gone[i + 1])]
        out.append((d, len(b), sum(gone), starts, ends, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def exact_groups(rows):
    """rows: (doc_id, text); returns a bag of (doc_id, keep_id, group_size, kept, sha256)."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(UPPER)].append(d)
    out = []
    for t, ids in groups.items():
        best = max((d for d in ids if d is not None), default=None)
        first = True
        for d in ids:
            kept = d == best and first
            first = first and not kept
            out.append((d, best, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return out


def repeated_words(w):
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})


def best_fit(lengths, capacity):
    """Remaining capacities after best-fit decreasing, one item at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)
