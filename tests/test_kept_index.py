"""The kept inverted index against a search over all texts, through updates, deletions, killed runs and compaction."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from tessera.functions import english
from tessera.operators import inverted
from tessera.operators.inverted import InvertedIndex
from tessera.sources import folders

WORDS = "engine engines running run world noise quick foxes fox lasers cool molecules the of and quantum state".split()


def plain(texts, query, nearness=False):
    wanted = sorted(english.lexeme_places(query))
    out = {}
    for key, text in texts.items():
        places = english.lexeme_places(text or "")
        if wanted and all(w in places for w in wanted):
            out[key] = round((english.nearness if nearness else english.cover_density)([places[w] for w in wanted]), 9)
    return out


@pytest.fixture
def index(spark, tmp_path):
    return InvertedIndex(spark, f"file://{tmp_path}/index", "k", LongType(), buckets=8)


def put(spark, index, texts, gone=()):
    return index.update(spark.createDataFrame(list(texts.items()), "k long, body string"), "body", spark.createDataFrame([(x,) for x in gone], "k long") if gone else None)


def check(index, texts):
    for query in ("engines RUN", "the world", "of the", "quick foxes lasers", "nowhere", "state"):
        for nearness in (False, True):
            assert {r.k: r.rank for r in index.search(query, nearness).collect()} == pytest.approx(plain(texts, query, nearness))


def test_updates_and_deletions(spark, index):
    rng = random.Random(7)
    some = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))
    texts = {k: some() for k in range(60)} | {60: None, 61: "", 62: "of the"}
    assert put(spark, index, texts) == len(texts)
    check(index, texts)
    assert put(spark, index, texts) == 0 and index.generations() == [1]
    # some change, some come, some go, one comes back
    for step in range(4):
        changes = {k: some() for k in rng.sample(range(70), 9)}
        gone = [k for k in rng.sample(range(70), 6) if k not in changes]
        before = dict(texts)
        texts = {k: v for k, v in (texts | changes).items() if k not in gone}
        changed = sum(k not in before or before[k] != v for k, v in changes.items()) + sum(k in before for k in gone)
        assert put(spark, index, changes, gone) == changed
        check(index, texts)
    index.compact()
    assert len(index.generations()) == 1 and folders.below(spark, f"{index.path}/postings") == [f"gen={index.generations()[0]}"]
    assert index.table("gone").count() == 0
    check(index, texts)
    put(spark, index, {3: "engine run"})
    check(index, texts | {3: "engine run"})


def test_killed_updates_leave_nothing(spark, index, monkeypatch):
    texts = {1: "engine run", 2: "quick fox"}
    put(spark, index, texts)
    real = InvertedIndex.write

    def dies(self, df, what, number, order):
        real(self, df, what, number, order)
        if what == "postings":
            raise KeyboardInterrupt

    monkeypatch.setattr(InvertedIndex, "write", dies)
    with pytest.raises(KeyboardInterrupt):
        put(spark, index, {1: "state", 3: "world"})
    monkeypatch.undo()
    assert index.generations() == [1]
    check(index, texts)
    # run again, in a generation of its own
    assert put(spark, index, {1: "state", 3: "world"}) == 2 and index.generations() == [1, 3]
    check(index, {1: "state", 2: "quick fox", 3: "world"})
    index.compact()
    assert folders.below(spark, f"{index.path}/postings") == ["gen=4"]


def test_generations_are_bounded(spark, index, monkeypatch):
    monkeypatch.setattr(inverted, "MOST_GENERATIONS", 2)
    texts = {}
    for k in range(5):
        texts[k] = f"engine run {WORDS[k]}"
        put(spark, index, {k: texts[k]})
        assert len(index.generations()) <= 2
    check(index, texts)


def test_a_query_reads_its_buckets_alone(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(300))) for k in range(300)]
    texts = spark.createDataFrame(rows, "k long, body string")
    index = InvertedIndex(spark, f"file://{tmp_path}/index", "k", LongType(), buckets=256)
    index.update(texts, "body")
    found = index.postings(["waa", "wzz"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket") or "bucket" in plan.split("PartitionFilters")[1][:200]
    assert "PushedFilters: [In(lexeme" in plan
    assert index.share_read(["waa", "wzz"], texts, "body") < 0.05
    at = {r.bucket for r in found.join(index.table("postings").select("lexeme", "bucket").distinct(), "lexeme").select("bucket").distinct().collect()}
    assert len(at) <= 2


def test_empty_index(spark, index):
    assert index.search("engine").collect() == [] and index.generations() == []
    index.compact()
    assert index.update(spark.createDataFrame([], "k long, body string"), "body") == 0
    assert index.search("engine").count() == 0
    assert isinstance(index.bucket(F.lit("x")), type(F.lit(1)))
