"""The two-level taxonomy: roll-ups, lists, pages and assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.feeds import newest


def categories(cluster_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """(cluster_id, category, score, n_topics): the best score and number of a cluster's topics in each category."""
    parent = topics.select(F.col("id").alias("parent_id"), F.col("name").alias("category"))
    child = topics.where("parent_id IS NOT NULL").select(F.col("id").alias("topic_id"), "parent_id").join(parent, "parent_id")
    return cluster_topics.join(child, "topic_id").groupBy("cluster_id", "category").agg(F.max("score").alias("score"), F.count("*").alias("n_topics"))


def listed(topics: DataFrame) -> DataFrame:
    """Categories, then subtopics, each by name. The taxonomy is a small table, so one window orders it."""
    kind = F.when(F.col("parent_id").isNull(), "category").otherwise("subtopic")
    order = Window.orderBy(F.col("parent_id").isNotNull(), "name", "id")
    return topics.select("id", "name", kind.alias("topic_type"), F.row_number().over(order).cast("long").alias("place"))


def page(clusters: DataFrame, cluster_topics: DataFrame, topics: DataFrame, topic_id: int, size: int = 20) -> DataFrame:
    """The latest active clusters of a topic; one appears once for each of its topics that match."""
    wanted = topics.where((F.col("id") == topic_id) | (F.col("parent_id") == topic_id)).select(F.col("id").alias("topic_id"))
    met = clusters.where("status = 'active'").join(cluster_topics.join(wanted, "topic_id", "left_semi"), F.col("id") == F.col("cluster_id"))
    top = met.orderBy(newest("updated_at"), "id", "topic_id").limit(size)
    order = Window.orderBy(newest("updated_at"), "id", "topic_id")
    return top.select(F.row_number().over(order).cast("long").alias("rn"), "id", "topic_id")


def page_lists(clusters: DataFrame, cluster_topics: DataFrame, topics: DataFrame, topic_id: int, size: int = 20) -> DataFrame:
    """(list, rn, id, topic_id): the latest active clusters of a topic, and those of greatest impact."""
    latest = page(clusters, cluster_topics, topics, topic_id, size).select(F.lit("latest").alias("list"), "rn", "id", "topic_id")
    wanted = topics.where((F.col("id") == topic_id) | (F.col("parent_id") == topic_id)).select(F.col("id").alias("topic_id"))
    met = clusters.where("status = 'active'").join(cluster_topics.join(wanted, "topic_id", "left_semi"), F.col("id") == F.col("cluster_id"))
    order = F.col("impact_score").desc_nulls_last(), newest("updated_at"), F.col("id"), F.col("topic_id")
    top = met.orderBy(*order).limit(size)
    return latest.union(top.select(F.lit("impact"), F.row_number().over(Window.orderBy(*order)).cast("long"), "id", "topic_id"))


def match_aliases(texts: DataFrame, topics: DataFrame, key: str = "cluster_id", text: str = "search_text", most: int = 3, least: float = 0.6) -> DataFrame:
    """(key, topic_id, score): topics whose name or alias (column ``alias``, one word) a text holds.

    The score is the share of hits, 0.6 for one and up to 1; the best ``most`` stay.
    """
    words = texts.select(key, F.explode(F.split(F.lower(F.col(text)), "[^a-z0-9]+")).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
    met = words.join(topics.select(F.lower("alias").alias("word"), F.col("id").alias("topic_id")), "word")
    scored = met.groupBy(key, "topic_id").agg(F.least(F.lit(1.0), 0.5 + 0.1 * F.sum("n")).alias("score")).where(F.col("score") >= least)
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "topic_id")
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def parse_classification(response: Column, least: float = 0.6) -> Column:
    """Topics that a model's JSON answer names with enough confidence: array of (name, score), best first."""
    parsed = F.from_json(response, "topics array<struct<name:string,score:double>>")["topics"]
    kept = F.filter(parsed, lambda x: x["name"].isNotNull() & (x["score"] >= least))
    return F.slice(F.array_sort(kept, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(0)), 1, 3)


def replace_assignments(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Locked rows of current, and the wanted rows for the rest of the clusters named in wanted; other clusters stay as they are."""
    named = wanted.select("cluster_id").distinct()
    locked = current.where("locked")
    untouched = current.where("NOT locked").join(named, "cluster_id", "left_anti")
    fresh = wanted.join(locked, ["cluster_id", "topic_id"], "left_anti").select("cluster_id", "topic_id", "score", F.lit(False).alias("locked"))
    return locked.unionByName(untouched).unionByName(fresh)
