"""Plain versions of graph operators, for comparison on small graphs."""

from __future__ import annotations

from collections import defaultdict


def simple_paths(edges: set, seed: str, max_hops: int) -> dict:
    """address -> (fewest hops, number of simple paths)."""
    out = defaultdict(list)
    for s, d in edges:
        out[s].append(d)
    found: dict = {}

    def go(path):
        if len(path) > max_hops:
            return
        for d in out[path[-1]]:
            if d not in path:
                hop, n = found.get(d, (len(path), 0))
                found[d] = (min(hop, len(path)), n + 1)
                go([*path, d])

    go([seed])
    return found


def components(pairs: list) -> dict:
    """address -> smallest address of its component."""
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    return {a: root(a) for a in parent}
