"""Odd inputs in which queries once differed from their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from tessera.operators import editorial, feeds, governance, graph, ingest

DAY = datetime(2024, 1, 1)


def test_cards_of_clusters_without_members(spark):
    clusters = spark.createDataFrame([(1, "One"), (2, "Two")], "id long, canonical_title string")
    topics = spark.createDataFrame([(1, 11, 0.5)], "cluster_id long, topic_id long, score double")
    names = spark.createDataFrame([(11, "Cells")], "id long, name string")
    badges = spark.createDataFrame([(1, ["news"])], "cluster_id long, content_types array<string>")
    images = spark.createDataFrame([(1, "a.png")], "cluster_id long, image_url string")
    got = {r.id: (r.topics, r.content_types, r.image_url) for r in feeds.cards(clusters, topics, names, badges, images).collect()}
    assert got == {1: (["Cells"], ["news"], "a.png"), 2: (None, [], None)}


def test_featured_images_by_whole_times(spark):
    """Newest by fractions of a second; a missing time of fetching comes last."""
    members = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e"), (3, "f")], "cluster_id long, item_id string")
    late = datetime(2024, 1, 1, 0, 0, 0, 500)
    rows = [("a", DAY, DAY), ("b", late, DAY), ("c", DAY, None), ("d", DAY, DAY), ("e", None, late), ("f", datetime(1960, 1, 1), DAY)]
    items = spark.createDataFrame([(i, "news", p, f, f"{i}.png", "T") for i, p, f in rows], "id string, content_type string, published_at timestamp, fetched_at timestamp, image_url string, title string")
    assert {r.cluster_id: r.image_url for r in feeds.featured_image(members, items).collect()} == {1: "b.png", 2: "d.png", 3: "f.png"}


def test_feeds_of_one_id_stay_single_rows(spark):
    rows = [(1, "x", 2), (1, "y", None), (2, "z", 3), (3, "w", 4)]
    own = spark.createDataFrame(rows, "id long, feed_url string, error_streak long")
    results = spark.createDataFrame([(1, False, "503"), (1, False, "503"), (2, False, "500"), (2, True, "200")], "id long, ok boolean, status string")
    found = ingest.feed_health(own, results).collect()
    got = {r.feed_url: (r.error_streak, r.last_status) for r in found}
    assert len(found) == 4 and got == {"x": (3, "503"), "y": (1, "503"), "z": (0, "200"), "w": (4, None)}


def test_ids_of_more_digits_are_filled(spark):
    rows = [(1, "see arXiv:2401.100000v2 now"), (2, "see arXiv:2401.10000v2"), (3, "1999.123456 of them"), (4, "arXiv:2401.1234567"), (5, "hep-th/0000002")]
    items = spark.createDataFrame(rows, "id long, title string").selectExpr("*", "CAST(NULL AS string) AS arxiv_id", "CAST(NULL AS string) AS doi")
    got = {r.id: r.arxiv_id for r in editorial.with_ids(items, F.col("title"), F.lit("https://site.example/")).collect()}
    assert got == {1: "2401.100000v2", 2: "2401.10000v2", 3: None, 4: "2401.1234567", 5: "hep-th/0000002"}


def test_lineage_is_cut_alike(spark):
    """Edges between the same nodes are told apart by relation, in whatever order they come."""
    nodes = spark.createDataFrame([(1, [7]), (2, [7])], "id long, topic_ids array<int>")
    edges = [(1, 2, "contradicts"), (1, 2, "builds_on"), (1, 2, "contradicts")]
    for given in (edges, edges[::-1], edges[1:] + edges[:1]):
        found = graph.lineage(nodes, spark.createDataFrame(given, "from_id long, to_id long, relation string").coalesce(1), 7, most_edges=2)["edges"]
        assert [r.relation for r in found.collect()] == ["builds_on", "contradicts"]


def test_split_counts_its_two_parts_alone(spark):
    clusters = spark.createDataFrame([(1, "active"), (9, "active")], "id long, status string")
    members = spark.createDataFrame([(1, "a", 5, "primary", DAY), (1, "b", 5, "primary", DAY), (1, "c", 6, None, DAY), (9, "z", 7, "primary", DAY)], "cluster_id long, item_id string, source_id long, role string, added_at timestamp")
    out = governance.split_cluster(clusters, members, 1, 9, F.col("role") == "primary", F.lit(DAY))
    assert {r.cluster_id: (r.item_count, r.distinct_source_count) for r in out["counts"].collect()} == {9: (2, 1), 1: (1, 1)}
    assert out["members"].count() == 4
