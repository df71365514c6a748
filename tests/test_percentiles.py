"""Percentiles by narrowing histograms against Spark's own aggregate."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from tessera.operators import impact, percentiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    shapes = {"flat": rng.random, "few": lambda: rng.choice((0.1, 0.5)), "long tail": lambda: rng.paretovariate(0.5), "one": lambda: 7.0, "negative": lambda: -rng.expovariate(1), "gap": lambda: rng.choice((0.0, 1e9)) + rng.random()}
    out = [(t, rng.choice(("a", "b", None)), None if rng.random() < 0.05 else f()) for t, f in shapes.items() for _ in range(500)]
    return spark.createDataFrame(out + [("lone", "a", 3.5), ("none", "a", None), (None, "a", 1.5)], "topic string, age string, score double").repartition(5)


@pytest.mark.parametrize("distinct, bins", [(50_000, 4_096), (20, 8), (3, 2)])
@pytest.mark.parametrize("q", [0.99, 0.5, 0.0, 1.0])
def test_equal_the_aggregate(rows, monkeypatch, distinct, bins, q):
    if q != 0.99 and distinct == 3:
        pytest.skip("many rounds")
    monkeypatch.setattr(percentiles, "DISTINCT", distinct)
    monkeypatch.setattr(percentiles, "BINS", bins)
    sets = [["topic", "age"], ["age"], []]
    got = {(r.g.level, r.g.topic, r.g.age): (r.n, r.q) for r in percentiles.percentiles(rows, sets, "score", q).collect()}
    wanted = {}
    for level, s in enumerate(sets):
        for r in rows.groupBy(*s).agg(F.count("*").alias("n"), F.percentile("score", q).alias("q")).collect():
            wanted[level, r.topic if "topic" in s else None, r.age if "age" in s else None] = (r.n, r.q)
    assert got.keys() == wanted.keys() and ("none", "a") == next(k[1:] for k in got if k[1] == "none")
    for k, (n, v) in wanted.items():
        assert got[k][0] == n and (got[k][1] is None if v is None else got[k][1] == pytest.approx(v, rel=1e-12))


def test_no_rows(rows):
    assert percentiles.percentiles(rows.limit(0), [["topic"], []], "score", 0.5).collect() == []
    # a history without rows leaves the default
    got = impact.thresholds(rows, "score", "topic", "age", history=rows.limit(0)).select("bucket", "threshold").distinct().collect()
    assert [tuple(r) for r in got] == [("default", impact.DEFAULT)]
