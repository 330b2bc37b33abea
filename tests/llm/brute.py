"""Plain versions of the numbered operators for small inputs, and small inputs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text):
    return (text or "").encode().split()


def corpus(n=120, seed=3):
    """(doc_id, text): copies, near copies, shared passages, empty and null texts, one very long text."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünï", "don't", "x\x1cy", "a b"]
    prose = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passage, texts = prose(60), []
    for k in range(n):
        kind = k % 8
        if kind < 3 or not texts:
            texts.append(prose(r.randint(1, 120)))
        elif kind == 3:
            texts.append(r.choice(texts))
        elif kind == 4:
            w = (r.choice(texts) or "x").split(" ")
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w).upper() if r.random() < 0.2 else " ".join(w))
        elif kind == 5:
            texts.append(f"{prose(r.randint(0, 20))}\n\t{passage} {prose(5)}")
        elif kind == 6:
            texts.append(r.choice(["", None, "   ", "one", "one two three four", "same " * 40]))
        else:
            texts.append(passage)
    texts.append(prose(30_000) + " " + passage)
    return list(enumerate(texts))


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def near(rows, percent=80):
    sets = {}
    for i, t in rows:
        w = words((t or "").encode().translate(LOWER).decode())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    lists, pairs = defaultdict(list), []
    for i, s in sets.items():
        c = Counter()
        for g in s:
            c.update(lists[g])
            lists[g].append(i)
        pairs += [(i, j) for j, k in c.items() if 100 * k >= percent * (len(s) + len(sets[j]) - k)]
    component = union(pairs, sets)
    return {i: (len(s), component[i]) for i, s in sets.items()}


def repeats(rows, n=13):
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
