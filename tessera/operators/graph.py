"""One-hop questions to the lineage and entity graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lineage(nodes: DataFrame, edges: DataFrame, topic: int, most_nodes: int = 200, most_edges: int = 500) -> dict[str, DataFrame]:
    """The nodes that list a topic, and the edges with both ends among them, by their ends and then by relation, so that the limit cuts the same way each time."""
    own = nodes.where(F.array_contains("topic_ids", topic)).orderBy("id").limit(most_nodes)
    ids = own.select("id")
    inside = edges.join(ids, edges.from_id == ids.id, "left_semi").join(ids, edges.to_id == ids.id, "left_semi")
    return {"nodes": own, "edges": inside.orderBy("from_id", "to_id", "relation").limit(most_edges)}


def neighbours(edges: DataFrame, node: Column | None = None) -> DataFrame:
    """(node, neighbour) in either direction, once each. Two equi-shaped halves instead of a join on either end."""
    both = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("neighbour")).union(edges.select("to_id", "from_id"))
    return (both.where(node) if node is not None else both).distinct()


def find_entities(entities: DataFrame, aliases: DataFrame, q: str, size: int = 20) -> DataFrame:
    """Entities whose name, or an alias, holds q in either case."""
    pattern = "%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    by_alias = aliases.where(F.col("alias").ilike(pattern)).select(F.col("entity_id").alias("id"))
    hit = entities.where(F.col("name").ilike(pattern)).select("id").union(by_alias).distinct()
    return entities.join(hit, "id", "left_semi").orderBy("name", "id").limit(size)


def glossary(entries: DataFrame, term: str) -> DataFrame:
    """Entries by term in either case, or by an alias as written."""
    return entries.where((F.lower("term") == term.lower()) | F.array_contains("aliases", term)).orderBy("term").limit(1)
