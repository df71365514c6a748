"""Tagging of stories: by a model's answer or by aliases, for what has no topics yet, for all after a new seed, and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import editorial, metrics, topics
from tessera.operators.enrichment import Model
from tessera.operators.feeds import newest
from tessera.operators.merge import merge

MOST_TOPICS, LEAST_TEXT = 3, 100


def by_model(texts: DataFrame, taxonomy: DataFrame, model: Model, most: int = MOST_TOPICS) -> DataFrame:
    """(cluster_id, topic_id, score): topics that a model names for texts (cluster_id, search_text), if the taxonomy (id, name) knows them; the best ``most``."""
    prompt = F.concat(F.lit("Name the topics of this story as JSON with scores.\n"), F.col("search_text"))
    said = texts.select("cluster_id", F.explode(topics.parse_classification(model(prompt))).alias("t")).select("cluster_id", F.lower(F.trim("t.name")).alias("name"), "t.score")
    known = taxonomy.select(F.col("id").alias("topic_id"), F.lower("name").alias("name"))
    best = said.join(known, "name").groupBy("cluster_id", "topic_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), "topic_id")
    return best.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def maintained(clusters: DataFrame, members: DataFrame, items: DataFrame, docs: DataFrame, cluster_topics: DataFrame, aliases: DataFrame, now: Column, least: int = LEAST_TEXT, most: int = 500) -> dict[str, DataFrame]:
    """Upkeep: short search texts (cluster_id, search_text, updated_at) built anew, stories without topics tagged, those that can't be quarantined."""
    short = editorial.short_search_texts(clusters, docs, least, most)
    fresh = metrics.search_text(clusters.join(short, "id", "left_semi"), members, items)
    new_docs = editorial.upsert_search_docs(docs, fresh, now)
    todo = editorial.taggable(clusters, new_docs, cluster_topics, least, most)
    tagged = editorial.assign(cluster_topics, topics.match_aliases(todo, aliases), todo, "auto", replace_all=True)
    out = editorial.quarantine_untaggable(editorial.touched(clusters, tagged["changed"], now), members, new_docs, tagged["cluster_topics"], now, least, most)
    return {"docs": new_docs, "cluster_topics": tagged["cluster_topics"], "clusters": out["clusters"], "reasons": out["reasons"]}


def backfilled(clusters: DataFrame, docs: DataFrame, cluster_topics: DataFrame, aliases: DataFrame, most: int = 10_000) -> dict[str, DataFrame]:
    """After a new seed: automatic assignments go, and open stories, newest first, are tagged again."""
    cleared = editorial.without_automatic(cluster_topics)
    scope = clusters.where(F.col("status").isin("active", "pending")).orderBy(newest("updated_at"), "id").limit(most).select(F.col("id").alias("cluster_id"))
    texts = docs.join(scope, "cluster_id", "left_semi").select("cluster_id", "search_text")
    return editorial.assign(cleared, topics.match_aliases(texts, aliases), scope, "auto", replace_all=True)


def described(topics_table: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows of a table patched by id: columns of patches that are not null replace, the others stay."""
    return merge(topics_table, patches, ["id"], dict.fromkeys([c for c in patches.columns if c != "id"], "overwrite_if_given"))
