"""Texts are turned into entries once; training, the choice of how far to go and scores read those."""

from __future__ import annotations

import numpy as np
import pytest

lm = pytest.importorskip("tessera.llm.lm")


def test_texts_are_split_once_for_training_and_scores(spark, monkeypatch):
    kept, passes, write, take = {}, [], lm.written, lm.id_and_text
    monkeypatch.setattr(lm, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    monkeypatch.setattr(lm, "id_and_text", lambda *a: passes.append(a) or take(*a))
    rows = [(k, f"Words of {k % 7} and more " * (k % 5)) for k in range(120)] + [(3, None), (None, "x y")]
    found = lm.annotate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.count() == len(rows) and len(passes) == 2  # to count, and to read
    read = kept["read"].collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in read) == sorted((d is None, d or 0, len((t or "").split()) + 1) for d, t in rows)
    assert all(len(r.entries) == 2 * r.n_tokens for r in read)
    assert kept["shards"].count() == sum(not r.held_out for r in read)


def test_chunks_of_entries_do_not_change_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words {k % 11} of a text " * (k % 9)) for k in range(60)], "doc_id long, text string")
    whole = {r.doc_id: r.score for r in lm.annotate(docs).collect()}
    monkeypatch.setattr(lm, "CHUNK_ENTRIES", 40)
    parts = {r.doc_id: r.score for r in lm.annotate(docs).collect()}
    assert whole.keys() == parts.keys() and np.allclose([whole[k] for k in whole], [parts[k] for k in whole], rtol=1e-5)
