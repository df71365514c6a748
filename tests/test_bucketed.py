"""Key-bucketed tables: a batch rewrites its own buckets; batches run twice and killed runs lose and double nothing."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tessera.operators.merge import ITEM_ORDER, item_policy, upsert_items
from tessera.sources import folders
from tessera.streaming import bucketed, ingest
from tessera.streaming.bucketed import BucketedTable

DAY = datetime(2024, 1, 1)
SUM = {"n": lambda old, new: old + new}


def schema(**fields):
    out = StructType()
    for name, kind in fields.items():
        out.add(name, kind)
    return out


SIGHTINGS = schema(k="long", n="long")
ITEMS = schema(
    id="string", source_id="long", title="string", content_type="string", published_at="timestamp", fetched_at="timestamp", arxiv_id="string", author="string", full_text="string", full_text_status="string",
)


def sightings(spark, tmp_path, buckets=16):
    return BucketedTable(spark, f"file://{tmp_path}/t", SIGHTINGS, ["k"], SUM, buckets=buckets)


def rows(table):
    return {r.k: r.n for r in table.read().collect()}


def files(tmp_path):
    return {p.name: {f.name for f in p.glob("*.parquet")} for p in Path(f"{tmp_path}/t/table").glob("bucket=*")}


def test_a_batch_rewrites_its_own_buckets(spark, tmp_path):
    table = sightings(spark, tmp_path)
    assert rows(table) == {}
    table.upsert(spark.range(500).selectExpr("id AS k", "1L AS n"), number=0)
    before = files(tmp_path)
    assert len(before) == 16
    touched = table.upsert(spark.createDataFrame([(3, 10), (4, 10), (900, 10)], SIGHTINGS), number=1)
    after = files(tmp_path)
    assert 1 <= len(touched) <= 3
    assert {b for b in after if after[b] != before[b]} == {f"bucket={x}" for x in touched}
    assert rows(table) == {k: 1 for k in range(500)} | {3: 11, 4: 11, 900: 10}
    assert table.upsert(spark.createDataFrame([], SIGHTINGS), number=2) == [] and files(tmp_path) == after


def test_batches_run_again_count_once(spark, tmp_path):
    table = sightings(spark, tmp_path)
    batches = [[(1, 1), (2, 1)], [(1, 5), (3, 5)], [(2, 7)]]
    for number in (0, 0, 1, 1, 0, 2, 1, 2):
        table.upsert(spark.createDataFrame(batches[number], SIGHTINGS), "s", number)
    assert rows(table) == {1: 6, 2: 8, 3: 5}
    # another stream is not a batch run again
    table.upsert(spark.createDataFrame([(3, 1)], SIGHTINGS), "other", 0)
    assert rows(table)[3] == 6


@pytest.mark.parametrize("where", ["before any bucket", "between buckets", "within pending"])
def test_killed_runs(spark, tmp_path, monkeypatch, where):
    table = sightings(spark, tmp_path)
    table.upsert(spark.range(40).selectExpr("id AS k", "1L AS n"), "s", 0)
    batch = spark.range(30, 50).selectExpr("id AS k", "2L AS n")
    real = BucketedTable.overwrite

    def dies(self, df, to):
        if where == "between buckets":
            real(self, df.where("bucket % 2 = 0"), to)
        raise KeyboardInterrupt

    monkeypatch.setattr(BucketedTable, "overwrite", dies)
    with pytest.raises(KeyboardInterrupt):
        table.upsert(batch, "s", 1)
    monkeypatch.undo()
    if where == "within pending":
        Path(f"{tmp_path}/t/pending/_SUCCESS").unlink()
    wanted = {k: 1 for k in range(40)} | {k: 2 + (k < 40) for k in range(30, 50)}
    again = sightings(spark, tmp_path)
    # a whole pending is finished by whoever reads next, half a one counts for nothing
    assert rows(again) == ({k: 1 for k in range(40)} if where == "within pending" else wanted)
    again.upsert(batch, "s", 1)
    assert rows(again) == wanted
    assert folders.below(spark, f"file://{tmp_path}/t") == ["table"]


def items(spark, tmp_path):
    return BucketedTable(spark, f"file://{tmp_path}/t", ITEMS, ["id"], item_policy(ITEMS.names), [F.col(c).desc() for c in ITEM_ORDER], buckets=8)


def some_items(rng, step):
    def row():
        may = lambda x: rng.choice((None, x))
        at = DAY + timedelta(hours=24 * step + rng.randrange(24))
        return (f"k{rng.randrange(25)}", rng.randrange(3), f"t{rng.random()}", "news", may(at), at, may("2401.00001"), may("An Author"), may("text"), may("failed"))

    return [row() for _ in range(12)]


def test_a_stream_is_batch_after_batch(spark, tmp_path):
    """Restarts, a step without files, and a stream begun anew over all files."""
    rng, wanted, seen = random.Random(5), spark.createDataFrame([], ITEMS), []
    table = items(spark, tmp_path)
    run = lambda ck: table.ingest(ingest.read_items(spark, f"{tmp_path}/in/*", ITEMS), f"{tmp_path}/{ck}", done=seen.append).awaitTermination()
    got = lambda: sorted(map(tuple, table.read().collect()), key=str)
    for step in range(3):
        batch = some_items(rng, step)
        spark.createDataFrame(batch, ITEMS).coalesce(1).write.parquet(f"{tmp_path}/in/{step}")
        wanted = spark.createDataFrame(upsert_items(wanted, spark.createDataFrame(batch, ITEMS)).collect(), ITEMS)
        run("one")
    run("one")
    assert got() == sorted(map(tuple, wanted.collect()), key=str)
    assert len(seen) == 3
    keys = {r[0] for r in got()}
    run("two")
    assert len(seen) > 3 and sorted(r[0] for r in got()) == sorted(keys)


def test_item_policies(spark):
    """An item stays with its first source; author, dates and ids fill in; the text's status follows the text."""
    old = [("a", 1, "one", "news", None, DAY, None, None, "text", "pending"), ("b", 1, "two", "news", DAY, DAY, "x", "Ann", " ", "paywalled"), ("c", 1, "three", "news", None, DAY, None, None, None, None)]
    new = [(k, 2, f"{t}!", "report", DAY + timedelta(1), DAY + timedelta(1), "y", "Bob", "other", s) for k, t, s in (("a", "one", "failed"), ("b", "two", "failed"), ("c", "three", None))]
    got = {r.id: r for r in upsert_items(spark.createDataFrame(old, ITEMS), spark.createDataFrame(new, ITEMS)).collect()}
    assert {(r.source_id, r.content_type) for r in got.values()} == {(1, "report")}
    assert [got[k].author for k in "abc"] == ["Bob", "Ann", "Bob"] and [got[k].arxiv_id for k in "abc"] == ["y", "x", "y"]
    assert [got[k].full_text_status for k in "abc"] == ["ok", "paywalled", "pending"]
    assert [got[k].full_text for k in "abc"] == ["text", " ", None]


def test_log_by_day(spark, tmp_path):
    where = f"file://{tmp_path}/log"
    log = spark.createDataFrame([(k, DAY + timedelta(hours=8 * k)) for k in range(9)] + [(99, None)], "k long, at timestamp")
    bucketed.append_by_day(log, where, "at")
    bucketed.append_by_day(log.where("k = 8").withColumn("k", F.lit(100).cast("long")), where, "at")
    assert bucketed.drop_days(spark, where, "2024-01-03") == ["2024-01-01", "2024-01-02"]
    assert {r.k for r in spark.read.parquet(where).collect()} == {6, 7, 8, 99, 100}
    assert bucketed.drop_days(spark, where, "2024-01-03") == []
