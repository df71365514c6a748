"""Queries on popular topics and shared identifiers make rows in proportion to their input, not groups squared."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F
from tessera.operators import clustering, feeds, notify, stories as story_pages

DAY = datetime(2024, 1, 1)


def most_rows(df):
    """The rows that the busiest operator of a collected plan gave."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if node.metrics().contains("numOutputRows"):
            found = max(found, node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return found


def stories(spark, n=2000):
    """n clusters, all on topic 11 and half of them on 12, a child of 11 too; the highest id is the newest."""
    clusters = spark.range(n).select("id", F.when(F.col("id") % 10 == 0, "pending").otherwise("active").alias("status"), (F.lit(DAY).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("id").cast("decimal(18,6)"))).alias("updated_at"))
    on = spark.range(n).selectExpr("id AS cluster_id", "11L AS topic_id").union(spark.range(0, n, 2).selectExpr("id AS cluster_id", "12L AS topic_id"))
    topics = spark.createDataFrame([(11, None), (12, 11)], "id long, parent_id long")
    return clusters, on, topics


def test_for_you_meets_each_users_first_places(spark):
    clusters, on, topics = stories(spark)
    follows = spark.range(400).selectExpr("id AS user_id", "11L + id % 2 AS topic_id")
    saves = spark.createDataFrame([(0, 5), (0, 1999), (500, 7), (500, 10)], "user_id long, cluster_id long")
    # user 1 has hidden all but the last of the stories of topic 12, user 2 the newest 30 of topic 11, user 500 none of the saved
    hides = spark.range(4, 2000, 2).selectExpr("1L AS user_id", "id AS cluster_id").union(spark.range(1970, 2000).selectExpr("2L AS user_id", "id AS cluster_id"))
    out = feeds.for_you(clusters, on, topics, follows, saves, hides.union(hides), size=20)
    found = {}
    for r in out.collect():
        found.setdefault(r.user_id, {})[r.rn] = r.cluster_id
    top = lambda wanted: dict(enumerate([c for c in range(1999, -1, -1) if c % 10 and wanted(c)][:20], 1))
    assert found[0] == top(lambda c: True) and found[1] == {1: 2} and found[2] == top(lambda c: c < 1970) and found[3] == top(lambda c: c % 2 == 0)
    assert found[500] == {1: 7} and len(found) == 401
    assert most_rows(out) < 40_000


def test_digests_meet_each_topics_newest(spark):
    clusters, on, _ = stories(spark)
    follows = spark.range(400).selectExpr("id AS user_id", "11L + id % 2 AS topic_id")
    out = notify.topic_digests(follows.union(follows), on, clusters, F.lit(DAY), F.lit(DAY + timedelta(days=1)), most=50)
    found = {r.user_id: (r.n, r.cluster_ids) for r in out.collect()}
    newest = [c for c in range(1999, -1, -1) if c % 10]
    assert found[0] == (50, newest[:50]) and found[1] == (50, [c for c in newest if c % 2 == 0][:50]) and len(found) == 400
    assert most_rows(out) < 40_000


def test_candidates_are_an_identifiers_newest(spark):
    """2000 items share an arXiv id, half of them a DOI too; a cluster each, in two of which an item lies twice."""
    clusters, _, _ = stories(spark)
    items = spark.range(2000).selectExpr("id", "'2401.00001' AS arxiv_id", "CASE WHEN id % 2 = 0 THEN '10.1/x' END AS doi")
    members = spark.range(2000).selectExpr("id AS item_id", "id AS cluster_id").union(spark.createDataFrame([(1999, 1999), (0, 1)], "item_id long, cluster_id long"))
    asked = items.where("id < 200").union(spark.createDataFrame([(5000, None, "10.1/x"), (5001, None, None)], "id long, arxiv_id string, doi string"))
    out = clustering.candidates_by_identifier(asked, items, members, clusters)
    found = {}
    for r in out.collect():
        found.setdefault(r.item_id, {})[r.rn] = r.cluster_id
    open_ = list(range(1999, -1, -1))
    assert found[0] == found[1] == dict(enumerate(open_[:10], 1)) and found[5000] == dict(enumerate([c for c in open_ if c % 2 == 0][:10], 1)) and len(found) == 201
    assert most_rows(out) < 10_000


def test_story_pages_join_items_once(spark):
    """Members meet items in one join, from which lists, numbers and image come; numbers are those of the SQL where items or sources are missing."""
    clusters = spark.createDataFrame([(1, "active"), (2, "active"), (3, "active")], "id long, status string")
    members = spark.createDataFrame([(1, "a", 7), (1, "b", 7), (1, "c", 99), (2, "gone", 8), (2, "gone", 9)], "cluster_id long, item_id string, source_id long")
    items = spark.createDataFrame([(i, "news", "T", DAY, DAY, f"{i}.png") for i in "abc"], "id string, content_type string, title string, published_at timestamp, fetched_at timestamp, image_url string")
    sources = spark.createDataFrame([(7, "Seven"), (8, "Eight")], "id long, name string")
    none = lambda schema: spark.createDataFrame([], schema)
    out = story_pages.pages(
        clusters, members, items, sources, none("cluster_id long, topic_id long, score double, locked boolean"), none("id long, name string, parent_id long"), none("id long, term string"),
        none("cluster_id long, term_id long, score double"),
    )
    found = {r.id: (r.n_items, r.n_sources, r.image_url, [i.item_id for k in r.evidence for i in k["items"]]) for r in out.collect()}
    assert found == {1: (2, 2, "a.png", ["a", "b"]), 2: (0, 2, None, []), 3: (0, 0, None, [])}
    joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x and "item_id" in x]
    assert len(joins) == 1
