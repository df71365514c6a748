"""What is still to be done: predicates, semi-joins and bounded lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.feeds import newest

PAPERS = ("preprint", "peer_reviewed")


def _first(df: DataFrame, most: int) -> DataFrame:
    return df.orderBy(newest("updated_at"), "id").limit(most)


def need_takeaways(clusters: DataFrame, members: DataFrame, most: int) -> DataFrame:
    open_ = clusters.where("status = 'active' AND takeaway IS NULL")
    return _first(open_.join(members, open_.id == members.cluster_id, "left_semi"), most)


def need_stage3(clusters: DataFrame, most: int | None = None) -> DataFrame:
    open_ = clusters.where("status = 'active' AND takeaway IS NOT NULL AND summary_intuition IS NULL AND skip_reason IS NULL")
    return _first(open_, most) if most else open_


def need_deep_dive(clusters: DataFrame, members: DataFrame, items: DataFrame, most: int) -> DataFrame:
    papers = members.join(items.where(F.col("content_type").isin(*PAPERS)), members.item_id == items.id, "left_semi")
    open_ = need_stage3(clusters)
    return _first(open_.join(papers, open_.id == papers.cluster_id, "left_semi"), most)


def unassigned(items: DataFrame, members: DataFrame) -> DataFrame:
    return items.join(members, items.id == members.item_id, "left_anti")


def without_embedding(clusters: DataFrame, embeddings: DataFrame, hashes: bool = False) -> DataFrame:
    """Clusters that have no embedding or, with hashes, one of another source_text_hash."""
    known = embeddings.select(F.col("cluster_id").alias("__c"), *([F.col("source_text_hash").alias("__h")] if hashes else []))
    same = F.col("id") == F.col("__c")
    return clusters.join(known, same & (F.col("source_text_hash") == F.col("__h")) if hashes else same, "left_anti")


def stale_impact(clusters: DataFrame) -> DataFrame:
    """Clusters never assessed, or assessed before their last update."""
    return clusters.where("assessed_at IS NULL OR assessed_at < updated_at")


def sufficient(search_text, least: int = 100):
    return F.length(F.trim(search_text)) >= least
