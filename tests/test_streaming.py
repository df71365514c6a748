"""Streams give what batches give."""

from __future__ import annotations

from datetime import datetime, timedelta

from tessera.operators import clustering
from tessera.operators.merge import upsert_items
from tessera.streaming import ingest, windows

ITEMS = "id string, source_id long, title string, content_type string, published_at timestamp, fetched_at timestamp, arxiv_id string, image_url string"


def test_upsert_stream_is_batch(spark, tmp_path):
    day = datetime(2024, 1, 1)
    first = [("a", 1, "one", "news", None, day, None, None), ("b", 1, "two", "news", day, day, None, "i")]
    second = [("a", 1, "one!", "report", day, day + timedelta(1), "2401.00001", None), ("c", 2, "three", "news", None, day, None, None)]
    folder = f"{tmp_path}/in"
    spark.createDataFrame(first, ITEMS).coalesce(1).write.parquet(f"{folder}/1")
    schema = spark.createDataFrame([], ITEMS).schema
    run = lambda: ingest.ingest(ingest.read_items(spark, f"{folder}/*", schema), f"{tmp_path}/table", f"{tmp_path}/ck").awaitTermination()
    run()
    spark.createDataFrame(second, ITEMS).coalesce(1).write.parquet(f"{folder}/2")
    run()
    run()  # nothing new
    got = sorted(map(tuple, ingest.current(spark, f"{tmp_path}/table", schema).collect()), key=str)
    wanted = upsert_items(spark.createDataFrame(first, ITEMS), spark.createDataFrame(second, ITEMS))
    assert got == sorted(map(tuple, wanted.collect()), key=str)
    assert {r[0]: r[2] for r in got} == {"a": "one!", "b": "two", "c": "three"}


def test_fresh_checkpoint_over_an_existing_table(spark, tmp_path):
    """A stream begun anew replays all files; nothing is lost or doubled, and old versions go."""
    day = datetime(2024, 1, 1)
    schema = spark.createDataFrame([], ITEMS).schema
    run = lambda ck: ingest.ingest(ingest.read_items(spark, f"{tmp_path}/in/*", schema), f"{tmp_path}/table", f"{tmp_path}/{ck}").awaitTermination()
    for k in range(4):
        spark.createDataFrame([(f"k{k}", 1, f"t{k}", "news", None, day + timedelta(k), None, None), ("same", k, f"s{k}", "news", None, day + timedelta(k), None, None)], ITEMS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        run("one")
    before = sorted(map(tuple, ingest.current(spark, f"{tmp_path}/table", schema).collect()), key=str)
    assert {r[0]: r[2] for r in before} == {"k0": "t0", "k1": "t1", "k2": "t2", "k3": "t3", "same": "s3"}
    run("two")
    assert sorted(map(tuple, ingest.current(spark, f"{tmp_path}/table", schema).collect()), key=str) == before
    assert len(ingest.versions(spark, f"{tmp_path}/table")) <= ingest.KEPT


def test_atom_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>An atom</title><link rel="self" href="https://x.example/self"/><link rel="alternate" href=" https://x.example/a?utm_id=1 "/>'
        '<link rel="enclosure" type="image/png" href="https://x.example/i.png"/><summary>short</summary><updated>2024-02-03T04:05:06Z</updated></entry></feed>'
    )
    rows = ingest.read_atom(spark, str(tmp_path))
    r = rows.first()
    assert (r.link, r.title, r.image) == ("https://x.example/a?utm_id=1", "An atom", "https://x.example/i.png")
    p = ingest.parse_entries(rows).first()
    assert (p.url, p.published_at) == ("https://x.example/a", datetime(2024, 2, 3, 4, 5, 6))


def test_windows(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = [(k, k % 2, day + timedelta(seconds=20 * k)) for k in range(12)] + [(99, 0, day + timedelta(hours=1))]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(f"{tmp_path}/e")
    q = windows.rate_windows(stream, limit=1).writeStream.format("memory").queryName("rate").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n), count_if(over) FROM rate").first() == (12, 4)


def test_state_expires(spark, tmp_path):
    """A key seen again after its window counts anew; windows are final once the watermark has passed."""
    day = datetime(2024, 1, 1)
    rows = [("a", day), ("a", day + timedelta(minutes=5)), ("a", day + timedelta(hours=2)), ("b", day + timedelta(hours=5))]
    spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema("key string, ts timestamp").parquet(f"{tmp_path}/e")
    ingest.expire(stream, "ts", "1 hour").writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {(r.key, r.window_start.hour, r.n) for r in spark.table("seen").collect()} == {("a", 0, 2), ("a", 2, 1)}


def test_feed_entries(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        '<rss><channel><item><title>AI  model improves</title><link>https://example.com/story?utm_source=test</link><description><![CDATA[<p>See arXiv 2401.01234 &amp; more</p>]]></description><pubDate>Mon, 1 Jan 2024 10:00:00 +0000</pubDate></item></channel></rss>'
    )
    r = ingest.parse_entries(ingest.read_rss(spark, str(tmp_path))).first()
    assert (r.url, r.title, r.snippet, r.arxiv_id, r.published_at) == ("https://example.com/story", "AI model improves", "See arXiv 2401.01234 & more", "2401.01234", datetime(2024, 1, 1, 10))


def model(rows):
    import pandas as pd

    return clustering.assign(pd.DataFrame(rows, columns=["item_id", "at", "source_id", "ident", "tokens"]).assign(founder=False, words=[r[4] for r in rows]))


def test_greedy_clusters_equal_the_plain_loop(spark):
    import random

    rng = random.Random(4)
    words = ["model", "weather", "quantum", "protein", "galaxy", "vaccine", "climate"]
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(400)), f"s{rng.randrange(3)}", " ".join(rng.sample(words, rng.randrange(1, 5))), f"i{rng.randrange(8)}" if rng.random() < 0.1 else None) for k in range(120)]
    df = spark.createDataFrame(rows, "item_id long, at timestamp, source_id string, title string, ident string")
    got = {r.item_id: (r.cluster_id, r.decision) for r in clustering.cluster(df.repartition(3)).collect()}
    plain = model([(k, at.timestamp() - datetime(1970, 1, 1).timestamp(), s, i, list(dict.fromkeys(t.split()))) for k, at, s, t, i in rows])
    assert got == {r.item_id: (r.cluster_id, r.decision) for r in plain.itertuples()}
    assert len({c for c, _ in got.values()}) < len(got)


def test_greedy_clusters_read_whole_titles(spark, tmp_path):
    from tessera.plans import catalog

    catalog.load()
    same = " ".join(f"shared{k}" for k in range(40))  # over 200 characters
    texts = [f"{same} alpha beta\nx", f"{same} gamma delta\ny", f"{same} beta alpha\nz"]
    spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    # an identifier for every 40th document; none of these shares one
    got = {r.item_id: (r.cluster_id, r.decision) for r in catalog.QUERIES["greedy_clusters"](spark, str(tmp_path)).collect()}
    assert got == {0: (0, "new"), 1: (1, "new"), 2: (0, "attached")}


def test_greedy_clusters_over_many_candidates(spark):
    import random

    rng = random.Random(8)
    words = [f"word{k}" for k in range(14)]
    rows = []
    for k in range(700):
        n = rng.choice((2, 2, 3, 4, 9, 12, 13, 14))
        rows.append((k, datetime(2024, 1, 1) + timedelta(hours=rng.randrange(900)), f"s{rng.randrange(3)}", " ".join([*rng.sample(words[:5], min(n, 3)), *rng.sample(words[5:], max(n - 5, 0))]), f"i{rng.randrange(30)}" if rng.random() < 0.05 else None))
    df = spark.createDataFrame(rows, "item_id long, at timestamp, source_id string, title string, ident string")
    got = {r.item_id: (r.cluster_id, r.decision) for r in clustering.cluster(df.repartition(3)).collect()}
    plain = model([(k, at.timestamp() - datetime(1970, 1, 1).timestamp(), s, i, list(dict.fromkeys(t.split()))) for k, at, s, t, i in rows])
    assert got == {r.item_id: (r.cluster_id, r.decision) for r in plain.itertuples()}
