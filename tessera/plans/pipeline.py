"""One cycle over the engine's tables: take in, fetch texts, cluster what is new, tag, promote, score, focus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import clustering, editorial, governance, hydration, metrics, topics
from tessera.operators.merge import merge, upsert_items


def run(tables: dict[str, DataFrame], now: Column, aliases: DataFrame, entries: DataFrame | None = None, fetched: DataFrame | None = None) -> dict[str, DataFrame]:
    """New versions of items, clusters, members and cluster_topics, and rows for the update log.

    tables: clusters, members, items, sources, cluster_topics (with source). Ids of clusters are strings. aliases: id, alias.
    entries: items as a feed gives them; fetched: results of fetching texts, by id. Each step is a lazy plan over
    the one before, but for clustering, whose rounds are written; a writer swaps the results in together.
    """
    clusters, members, items = tables["clusters"], tables["members"], tables["items"]
    if entries is not None:
        items = upsert_items(items, entries)
    if fetched is not None:
        items = hydration.write_back(items, fetched)
    found = clustering.kept(clustering.assign_to_stories(clusters, members, items))
    own = items.select(F.col("id").alias("item_id"), "source_id", "title", "content_type", F.coalesce("published_at", "fetched_at").alias("__at"))
    added = found.join(own, "item_id")
    first = added.where("decision = 'new'")
    blank = [F.lit(None).cast(t).alias(c) for c, t in clusters.dtypes if c not in ("id", "canonical_title", "status", "updated_at")]
    founded = first.select(F.col("cluster_id").alias("id"), F.col("title").alias("canonical_title"), F.lit("pending").alias("status"), F.col("__at").cast(dict(clusters.dtypes)["updated_at"]).alias("updated_at"), *blank)
    clusters = editorial.touched(clusters.unionByName(founded), added.where("decision = 'attached'"), now)
    kinds = dict(members.dtypes)
    members = members.unionByName(added.select("cluster_id", "item_id", "source_id", now.cast(kinds["added_at"]).alias("added_at"), F.when(F.col("decision") == "new", "primary").otherwise("supporting").alias("role")).select(*members.columns))
    texts = metrics.search_text(clusters, members, items)
    untagged = texts.join(tables["cluster_topics"], "cluster_id", "left_anti")
    tagged = editorial.assign(tables["cluster_topics"], topics.match_aliases(untagged, aliases), untagged, "auto")
    promoted = governance.promote_pending(editorial.touched(clusters, tagged["changed"], now), tagged["cluster_topics"])
    scored = metrics.recompute_impact(promoted, members, tables["sources"], now)
    focus = metrics.in_focus(scored).select("id", "in_focus_label")
    labelled = merge(scored.withColumn("in_focus_label", F.lit(False)), focus, ["id"])
    # clusters of other statuses stay as they are
    more = [F.lit(None).cast(t).alias(c) for c, t in labelled.dtypes if c not in promoted.columns]
    out = merge(promoted.select("*", *more), labelled, ["id"])
    return {"items": items, "clusters": out, "members": members, "cluster_topics": tagged["cluster_topics"], "log": editorial.evidence_log(added), "assigned": found}
