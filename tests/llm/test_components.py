"""Components against union-find, over paths, stars, loops and random graphs."""

from __future__ import annotations

import random

import pytest

components = pytest.importorskip("tessera.llm.components")


def plain(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    return {x: root(x) for x in list(up)}


def test_components(spark):
    rng = random.Random(5)
    path = [(k, k + 1) for k in range(200)]
    rng.shuffle(path)
    edges = path + [(1000, k) for k in range(1001, 1060)] + [(5000, 5000), (None, 7), (-3, 9000), (9000, -3), (-3, 9000)]
    edges += [(2000 + rng.randrange(90), 2000 + rng.randrange(90)) for _ in range(70)]
    found = components.connected(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len({r.u for r in found}) and {r.u: r.root for r in found} == plain(edges)
    assert components.connected(spark.createDataFrame([], "u long, v long")).collect() == []
