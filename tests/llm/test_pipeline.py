"""The corpus pipeline, stage by stage, on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
import pytest
from tessera.llm import decontam, repetition, simhash
from tessera.llm.common import written


@pytest.fixture(scope="module")
def stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = {"": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, data), name)
        out[name] = docs
    return out


def test_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(stages[n].schema == stages[""].schema for n in names[:-1])


def test_decisions(stages, spark, data):
    kept = {r.doc_id for r in repetition.annotate(stages[""]).where("kept").collect()}
    assert {r.doc_id for r in stages["quality"].collect()} == kept
    first = {r.component_id for r in simhash.classes(stages["quality"]).collect()}
    assert {r.doc_id for r in stages["near_duplicates"].collect()} == first
    marked = decontam.annotate(stages["near_duplicates"], spark.read.parquet(f"{data}/benchmark.parquet"))
    assert {r.doc_id for r in stages["decontaminate"].collect()} == {r.doc_id for r in marked.where("NOT contaminated").collect()}
    assert stages["tokens"].count() == stages["mix"].count()
    assert {r.doc_id for r in stages["mix"].collect()} <= {r.doc_id for r in stages["decontaminate"].collect()}
    ends = sorted((r.start, r.n_tokens) for r in stages["tokens"].collect())
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


ODD = "doc_id long, text string, source string, `row` string, words string, kept boolean, fp long, component_id long, size string, key string, part string"


def odd_rows():
    good = " ".join(f"word{k} of the {k * 7 % 31} story" for k in range(60))
    more = ("r", "w", False, 1, 2, "s", "k", "p")
    rows = [(k, f"{good} number{k} " + " ".join(f"x{k}y{j}" for j in range(40)), ["a", "b", None][k % 3], *more) for k in range(12)]
    rows += [(20, None, "a", *more), (21, "", "b", *more), (22, " \n\t", None, *more), (None, good + " without an id", "a", *more), (None, good + " without an id", "a", *more), rows[3], rows[3]]
    rows.append((30, " ".join(f"long{k}" for k in range(60_000)), "b", *more))
    return rows


def test_stages_take_odd_rows_and_pass_all_columns_on(spark, data):
    docs = spark.createDataFrame(odd_rows(), ODD).repartition(3)
    held = {"": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, data), name)
        held[name] = docs
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(held[n].columns == held[""].columns for n in names[:-1])
    kept = [r.doc_id for r in held["quality"].collect()]
    assert not {20, 21, 22} & set(kept) and 30 in kept and kept.count(3) == 3 and kept.count(None) == 2
    alone = [r.doc_id for r in held["near_duplicates"].collect()]
    assert alone.count(3) <= 1 and alone.count(None) == 2 and 30 in alone
    assert held["decontaminate"].count() == len(alone)
    tokens = held["tokens"].collect()
    assert len(tokens) == held["mix"].count() and all(r.n_tokens > 1 for r in tokens)


def test_stages_take_empty_tables(spark, data):
    docs = spark.createDataFrame([], ODD)
    for name, f in corpus_pipeline.STAGES:
        docs = written(f(spark, docs, data), name)
        assert docs.count() == 0


def test_copies_of_a_document_stand_apart(spark, data):
    """Token files keep the mix's order, in which copies of a document aren't neighbours."""
    rows = [(k, " ".join(f"{s}{k}w{j}" for j in range(20)), s) for s, n in (("a", 40), ("b", 400)) for k in range(n)]
    rows = [(1000 * (s == "b") + k, t, s) for k, t, s in rows]
    mixed = written(corpus_pipeline.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), data), "mix")
    order = [r.doc_id for r in corpus_pipeline.tokens(spark, mixed, data).orderBy("start").collect()]
    copies = sum(order.count(d) > 1 for d in set(order))
    assert copies > 30 and sum(a == b for a, b in zip(order, order[1:], strict=False)) <= copies // 5
