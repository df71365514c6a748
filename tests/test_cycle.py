"""A cycle from feed entries to scored stories."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tessera.plans import pipeline

DAY = datetime(2024, 1, 10)


def test_cycle(spark):
    items = "id string, source_id long, title string, content_type string, published_at timestamp, fetched_at timestamp, arxiv_id string, image_url string"
    stored = [("a", 1, "Quantum lasers cool molecules quickly", "preprint", DAY, DAY, None, None), ("q", 1, "Hidden tale", "news", DAY, DAY, None, None)]
    entries = [
        ("b", 2, "Quantum lasers cool molecules", "peer_reviewed", DAY + timedelta(hours=2), DAY, None, None), ("c", 2, "Whales sing in arctic waters", "news", DAY + timedelta(hours=3), DAY, None, None),
        ("d", 3, "Whales sing in arctic waters", "report", DAY + timedelta(hours=4), DAY, None, None), ("a", 1, "Quantum lasers cool molecules quickly", "preprint", None, DAY, "2401.00001", None),
    ]
    clusters = "id string, canonical_title string, status string, updated_at timestamp, takeaway string, summary_intuition string, final_score double, provisional_score double"
    tables = {
        "items": spark.createDataFrame(stored, items),
        "clusters": spark.createDataFrame([("1", "Quantum lasers cool molecules quickly", "pending", DAY, "t", "s", 0.5, None), ("2", "Hidden tale", "quarantined", DAY, None, None, None, None)], clusters),
        "members": spark.createDataFrame([("1", "a", 1, DAY, "primary"), ("2", "q", 1, DAY, "primary")], "cluster_id string, item_id string, source_id long, added_at timestamp, role string"),
        "sources": spark.createDataFrame([(k, f"s{k}", "journal", "tier1") for k in (1, 2, 3)], "id long, name string, source_type string, reliability_tier string"),
        "cluster_topics": spark.createDataFrame([], "cluster_id string, topic_id long, score double, source string, locked boolean"),
    }
    aliases = spark.createDataFrame([(7, "lasers"), (8, "whales")], "id long, alias string")
    now = F.lit("2024-01-11 00:00:00").cast("timestamp")
    out = pipeline.run(tables, now, aliases, entries=spark.createDataFrame(entries, items))
    held = {(r.item_id, r.cluster_id) for r in out["members"].collect()}
    assert held == {("a", "1"), ("q", "2"), ("b", "1"), ("c", "nc"), ("d", "nc")}
    topics = {(r.cluster_id, r.topic_id) for r in out["cluster_topics"].collect()}
    assert topics == {("1", 7), ("nc", 8)}
    found = {r.id: r for r in out["clusters"].collect()}
    assert {k: r.status for k, r in found.items()} == {"1": "active", "2": "quarantined", "nc": "pending"}
    assert found["1"].in_focus_label and found["1"].item_count == 2 and found["1"].updated_at == datetime(2024, 1, 11)
    assert {r.summary for r in out["log"].collect()} == {"New evidence added: Quantum lasers cool molecules", "New evidence added: Whales sing in arctic waters"}
    assert {r.id: r.arxiv_id for r in out["items"].collect()}["a"] == "2401.00001"
