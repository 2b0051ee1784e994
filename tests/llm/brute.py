"""Plain versions of what the operators compute."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import combinations

GAPS = "[ \t\n\x0b\f\r]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in re.split(GAPS, lower(text)) if w]


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def near_classes(rows, threshold=0.8):
    """key to (least key of its class, number of links) by all pairs."""
    nodes = {}
    for key, text in rows:
        nodes.setdefault(tuple(words(text)), []).append(key)
    seqs = list(nodes)
    sets = [shingles(" ".join(s)) for s in seqs]
    parent, links = list(range(len(seqs))), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(seqs)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both >= (threshold - 1e-12) * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            parent[find(b)] = find(a)
    least = {}
    for i, s in enumerate(seqs):
        least[find(i)] = min(least.get(find(i), math.inf), min(nodes[s]))
    return {k: (least[find(i)], links[i]) for i, s in enumerate(seqs) for k in nodes[s]}


def leaks(docs, items, least=0.8):
    out = set()
    for key, text in items:
        w = words(text)
        if not w:
            continue
        n = min(5, len(w))
        own = shingles(text, n)
        for doc, body in docs:
            b = words(body)
            shared = len(own & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)})
            if shared >= least * len(own) - 1e-9:
                out.add((doc, key, shared, len(own)))
    return out
