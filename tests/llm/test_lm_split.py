"""Words are split, counted and numbered a chunk at once, not one by one; the unit works on tables without gaps."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

lm = pytest.importorskip("tessera.llm.lm")

ODD = [b"", b" ", b"A", b" \x0bB\x0c", b"x" * 64, b"Y" * 65 + b" z", b"\xc2\xa0 \xff\x1f\x85\xc3\x84", b"\n\r\t", b"q " * 3, b"x" * 70]


def plain(text: bytes) -> list[bytes]:
    return [w if len(w) <= 64 else b" " + hashlib.md5(w).hexdigest().encode() for w in text.lower().split()]


@pytest.mark.parametrize("texts", [ODD, ODD[::-1], [b""], []])
def test_split_and_numbers(texts):
    words, per = lm.split(texts)
    assert words.to_pylist() == [w for t in texts for w in plain(t)] and per.tolist() == [len(plain(t)) for t in texts]
    table = lm.Table([b"q", lm.END, b"a"], [3, 2, 1], 9, 5)
    number = {b"q": 0, lm.END: 1, b"a": 2}
    assert table.numbers(words, per).tolist() == [number.get(w, 3) for t in texts for w in [*plain(t), lm.END]]


def test_counts_in_parts(spark, monkeypatch):
    """Partial counts handed on early, and chunks of a text each, sum to the same."""
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices("ab cd E é fgh".split(), k=k % 9)) + f" w{k}") for k in range(300)] + [(None, None)]
    want = Counter(w for k, t in rows if lm.fold(k) != lm.HELD_OUT for w in [*plain((t or "").encode()), lm.END])
    monkeypatch.setattr(lm, "COUNTED_BYTES", 30)
    for most in (10, 200_000):
        monkeypatch.setattr(lm, "KEPT_COUNTS", most)
        found = lm.count_words(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
        assert len(found) == len(want) and {bytes(r.word): r.n for r in found} == want


def test_words_cost_less_than_one_by_one():
    """What the words of a text cost in CPU seconds, beside a look-up of each in a dictionary."""
    rng = random.Random(2)
    known = [b"word%d" % k for k in range(50_000)]
    texts = [b" ".join(rng.choices(known, k=500)) for _ in range(800)]
    table, number, took = lm.Table(known, [1] * len(known), len(known), len(known)), {w: k for k, w in enumerate(known)}, [[], []]
    for _ in range(5):
        for k, way in enumerate((lambda: table.numbers(*lm.split(texts)), lambda: [np.array([number.get(w, -1) for w in plain(t)]) for t in texts])):
            start = time.process_time()
            way()
            took[k].append(time.process_time() - start)
    assert min(took[0]) < 0.8 * min(took[1])


def test_unit_is_the_plain_step():
    rng, n = np.random.default_rng(3), lm.HIDDEN
    model = lm.Model(np.full(lm.VOCABULARY, 1 / lm.VOCABULARY))
    model.load(model.flat() + rng.normal(0, 0.5, model.flat().shape).astype(np.float32))
    x, h = rng.normal(0, 3, (7, 3 * n)).astype(np.float32), rng.normal(size=(7, n)).astype(np.float32)
    x[0, 0], x[1, n] = -500, -500  # beyond what a float32 exponential holds
    r = h @ model.rec
    z, g = (1 / (1 + np.exp(-(x + r).astype(float)[:, k * n : (k + 1) * n])) for k in range(2))
    want = h + z * (np.tanh(x[:, 2 * n :] + g * r[:, 2 * n :]) - h)
    tables, given = lm.by_gate(x), np.empty((3, 7, n), np.float32)
    with np.errstate(over="raise"):
        got = lm.unit(tables, h, lm.by_gate(model.rec), given)
    assert np.allclose(got, want, atol=1e-5) and np.allclose(tables[0], z, atol=1e-5) and np.allclose(tables[1], g, atol=1e-5)
