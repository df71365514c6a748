"""Velocity, trending, recency and impact of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators.feeds import newest


def counts(members: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Per cluster: item_count, distinct_source_count, distinct_source_type_count, velocity_6h, velocity_24h."""
    age = scores.seconds_between(now, F.col("added_at"))
    met = members.join(sources.select(F.col("id").alias("source_id"), "source_type"), "source_id")
    return met.groupBy("cluster_id").agg(
        F.count("*").alias("item_count"), F.countDistinct("source_id").alias("distinct_source_count"), F.countDistinct("source_type").alias("distinct_source_type_count"),
        F.count_if(age <= 6 * 3600).alias("velocity_6h"), F.count_if(age <= 24 * 3600).alias("velocity_24h"),
    )


def scored(clusters: DataFrame, now: Column, single: bool = False) -> DataFrame:
    """clusters (with counts) with recency_score, trending_score and impact_score.

    single: a lone cluster's update sets its time to now before it is scored, so it is fully recent.
    """
    age = F.lit(0.0) if single else scores.seconds_between(now, F.col("updated_at"))
    out = clusters.withColumn("recency_score", scores.recency(age))
    out = out.withColumn("trending_score", scores.trending(F.col("velocity_6h"), F.col("velocity_24h"), F.col("distinct_source_count"), F.col("recency_score")))
    return out.withColumn("impact_score", scores.impact(F.coalesce("final_score", "provisional_score"), F.col("velocity_6h"), F.col("velocity_24h"), F.col("distinct_source_count"), age))


def recompute_batch(clusters: DataFrame, members: DataFrame, sources: DataFrame, now: Column, single: bool = False) -> DataFrame:
    """Clusters that have members, with new metrics; clusters without keep their old ones and aren't returned."""
    c = counts(members, sources, now)
    return scored(clusters.join(c, clusters.id == c.cluster_id).drop("cluster_id"), now, single)


def recompute_impact(clusters: DataFrame, members: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """All active and pending clusters; those without members count 0."""
    c = counts(members, sources, now)
    out = clusters.where("status IN ('active', 'pending')").join(c, clusters.id == c.cluster_id, "left").drop("cluster_id")
    return scored(out.fillna(0, ["item_count", "distinct_source_count", "distinct_source_type_count", "velocity_6h", "velocity_24h"]), now)


def in_focus(clusters: DataFrame, share_of: int = 100) -> DataFrame:
    """Active clusters with in_focus_label: the first hundredth (one at least) by impact.

    The size comes from a count and the set from a bounded sort, so no window runs over all rows.
    """
    active = clusters.where("status = 'active'")
    n = active.count()
    k = max(1, -(-n // share_of))
    top = active.orderBy(newest("impact_score"), newest("updated_at"), F.col("id").desc()).limit(k).select(F.col("id").alias("__id"), F.lit(True).alias("__in"))
    return active.join(top, active.id == F.col("__id"), "left").withColumn("in_focus_label", F.coalesce("__in", F.lit(False))).drop("__id", "__in")


def representatives(members: DataFrame, items: DataFrame, sources: DataFrame, most: int = 50) -> DataFrame:
    """(cluster_id, item_id, title, score): of the newest members the best, the newer one at a tie."""
    i = items.select(F.col("id").alias("item_id"), "title", "content_type", F.coalesce("published_at", "fetched_at").alias("at"))
    met = members.select("cluster_id", "item_id", "source_id").join(i, "item_id").join(sources.select(F.col("id").alias("source_id"), "reliability_tier"), "source_id")
    recent = met.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy(newest("at"), "item_id"))).where(F.col("rn") <= most)
    recent = recent.withColumn("score", scores.representative(F.col("content_type"), F.col("reliability_tier"), F.col("title")))
    best = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), "rn")
    return recent.withColumn("place", F.row_number().over(best)).where("place = 1").select("cluster_id", "item_id", "title", "score")


def search_text(clusters: DataFrame, members: DataFrame, items: DataFrame, most: int = 8) -> DataFrame:
    """(cluster_id, search_text): the title and those of the newest members."""
    i = items.select(F.col("id").alias("item_id"), "title", F.coalesce("published_at", "fetched_at").alias("at"))
    met = members.select("cluster_id", "item_id").join(i, "item_id")
    top = met.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy(newest("at"), "item_id"))).where(F.col("rn") <= most)
    titles = top.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda x: x["title"]), " ").alias("titles"))
    out = clusters.join(titles, clusters.id == titles.cluster_id)
    return out.select("cluster_id", F.concat_ws(" ", "canonical_title", "titles").alias("search_text"))


def trust(members: DataFrame, items: DataFrame) -> DataFrame:
    """(cluster_id, types, sources, flags, badges): trust signals from evidence."""
    met = members.select("cluster_id", "item_id", "source_id").join(items.select(F.col("id").alias("item_id"), "content_type"), "item_id")
    per = met.groupBy("cluster_id").agg(F.array_sort(F.collect_set("content_type")).alias("types"), F.countDistinct("source_id").alias("sources"))
    return per.withColumn("flags", scores.anti_hype_flags(F.col("types"), F.col("sources"))).withColumn("badges", scores.method_badges(F.col("types")))


