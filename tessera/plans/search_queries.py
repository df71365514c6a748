"""Queries for stories: by identifier, by lexemes and by trigrams, in stages."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import search
from tessera.operators.clustering import kept
from tessera.operators.inverted import InvertedIndex
from tessera.plans.catalog import query
from tessera.sources import folders
from tessera.sources.tables import Relations

#: Texts in which "urgent" stands in several forms, so that SQL can count its places without a stemmer.
BODIES = "SELECT id AS cluster_id, concat(canonical_title, CASE WHEN id % 3 = 0 THEN ' urgently told, the most urgent' ELSE '' END) AS body FROM clusters"
URGENT = f"SELECT cluster_id AS id, len(regexp_extract_all(lower(body), 'urgent')) AS n FROM ({BODIES}) b WHERE lower(body) LIKE '%urgent%'"


def bodies(t: Relations, suffixes: bool = True) -> DataFrame:
    text = BODIES if suffixes else "SELECT id AS cluster_id, canonical_title AS body FROM clusters"
    return t.spark.sql(text.replace("FROM clusters", "FROM {clusters}"), clusters=t["clusters"])


def docs(t: Relations) -> DataFrame:
    return bodies(t).withColumnRenamed("body", "search_text")


def new_index(t: Relations, name: str) -> InvertedIndex:
    return InvertedIndex(t.spark, folders.shared(t.spark, name), "cluster_id", bodies(t).schema["cluster_id"].dataType)


def kept_index(t: Relations) -> InvertedIndex:
    """The index of the stories' texts, made by the first query that asks for it and kept for the others."""
    index = new_index(t, f"stories-{t.spark.sparkContext.applicationId}-{hashlib.md5(t.sf_dir.encode()).hexdigest()}")
    if not index.generations():
        index.update(bodies(t), "body")
    return index


@query(f"SELECT u.id, round(0.1 * n, 9) AS rank FROM ({URGENT}) u JOIN clusters c ON c.id = u.id WHERE status = 'active' ORDER BY rank DESC, updated_at DESC, u.id DESC LIMIT 50")
def search_full_text(t: Relations) -> DataFrame:
    """For one lexeme each place is a cover of its own. The query's stop words and ending don't matter."""
    return search.staged(docs(t), t["clusters"], t["items"], t["members"], "the Urgent", index=kept_index(t))


@query("""
    SELECT c.id, CAST(NULL AS double) AS rank FROM clusters c JOIN members m ON m.cluster_id = c.id JOIN items i ON i.id = m.item_id WHERE status = 'active' AND i.arxiv_id = (SELECT concat('2401.', 10000 + min(p_partkey)) FROM part WHERE p_partkey % 11 = 0 AND p_partkey > 0)
    ORDER BY updated_at DESC, c.id DESC LIMIT 50""")
def search_identifier_first(t: Relations) -> DataFrame:
    least = t["part"].where("p_partkey % 11 = 0 AND p_partkey > 0").agg(F.min("p_partkey")).first()[0]
    return search.staged(docs(t), t["clusters"], t["items"], t["members"], f" 2401.{10000 + least} ", index=kept_index(t))


def grams(column: str) -> str:
    """The set of trigrams of a column's words, each word with two spaces before it and one behind, in DuckDB."""
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({column}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda k: substr(concat('  ', w, ' '), k, 3)))))"


@query(f"""
    WITH g AS (SELECT cluster_id AS id, {grams("body")} AS g, (SELECT {grams("'urgemt story 77'")}) AS q FROM ({BODIES}) b),
    s AS (SELECT id, round(len(list_intersect(g, q)) * 1.0E0 / len(list_distinct(list_concat(g, q))), 6) AS rank FROM g)
    SELECT s.id, rank FROM s JOIN clusters c ON c.id = s.id WHERE status = 'active' AND rank >= 0.3 ORDER BY rank DESC, updated_at DESC, s.id DESC LIMIT 50""")
def search_trigrams_last(t: Relations) -> DataFrame:
    """A misspelt query that no text holds."""
    return search.staged(docs(t), t["clusters"], t["items"], t["members"], "urgemt story 77", index=kept_index(t))


@query(f"""
    WITH r AS (SELECT u.id, round(0.1 / 1.64493406685 * CASE n WHEN 1 THEN 1 WHEN 2 THEN 1.25 ELSE 1.0E0 + 0.25 + 1.0E0 / 9 END, 9) AS rank FROM ({URGENT}) u JOIN clusters c ON c.id = u.id WHERE status = 'active' ORDER BY rank DESC, u.id LIMIT 20)
    SELECT r.id, rank, count(DISTINCT i.id) AS n FROM r LEFT JOIN members m ON m.cluster_id = r.id LEFT JOIN items i ON i.id = m.item_id AND i.source_id IS NOT NULL GROUP BY r.id, rank""")
def search_enhanced(t: Relations) -> DataFrame:
    return search.enhanced(docs(t), t["clusters"], t["items"], t["members"], "urgent", index=kept_index(t))["clusters"]


@query("""
    WITH p AS (SELECT concat('2401.', 10000 + min(p_partkey)) AS a FROM part WHERE p_partkey % 11 = 0 AND p_partkey > 0)
    SELECT m.item_id, m.cluster_id, i.title AS item_title FROM members m JOIN items i ON i.id = m.item_id JOIN clusters c ON c.id = m.cluster_id, p WHERE status = 'active' AND i.arxiv_id = a ORDER BY m.item_id, m.cluster_id LIMIT 1""")
def search_enhanced_hit(t: Relations) -> DataFrame:
    least = t["part"].where("p_partkey % 11 = 0 AND p_partkey > 0").agg(F.min("p_partkey")).first()[0]
    return search.enhanced(docs(t), t["clusters"], t["items"], t["members"], f"arXiv:2401.{10000 + least}", index=kept_index(t))["hit"].select("item_id", "cluster_id", "item_title")


#: Ranks by covers of "urgent" and "stories". In "1-URGENT story 7 urgently told, the most urgent" they stand side by side, then with a word between;
#: the last "urgent" stands behind another one. Other priorities have only the second stretch.
SEVERAL = """
    SELECT cluster_id, rank FROM (SELECT id AS cluster_id, round((CASE WHEN canonical_title LIKE '%URGENT%' THEN 0.1 ELSE 0 END) + (CASE WHEN {changed} THEN 0.05 ELSE 0 END), 9) AS rank FROM clusters WHERE {there}) r WHERE rank > 0"""


@query(SEVERAL.format(changed="id % 3 = 0", there="true"))
def search_several_lexemes(t: Relations) -> DataFrame:
    """Every story with both words, in whatever form, from two buckets of the index."""
    return kept_index(t).search("the URGENT stories")


@query(SEVERAL.format(changed="id % 3 = 0", there="id % 7 <> 0"))
def search_after_changes(t: Relations) -> DataFrame:
    """An index of titles alone, in which a third of the texts change and a seventh go, then compacted."""
    index = new_index(t, f"changing-{uuid.uuid4().hex}")
    index.update(bodies(t, suffixes=False), "body")
    index.update(bodies(t).where("cluster_id % 2 = 0"), "body", gone=bodies(t).where("cluster_id % 7 = 0 AND cluster_id % 2 = 1"))
    index.update(bodies(t).where("cluster_id % 7 <> 0"), "body", gone=bodies(t).where("cluster_id % 7 = 0"))
    index.compact()
    found = kept(index.search("story urgent"))
    folders.remove(t.spark, index.path)
    return found


@query("""
    SELECT 1 AS step, count(*) AS changed FROM clusters UNION ALL SELECT 2, count(*) FROM clusters WHERE id % 3 = 0
    UNION ALL SELECT 3, 0 UNION ALL SELECT 4, count(*) FROM clusters WHERE id % 7 = 0""")
def index_upkeep(t: Relations) -> DataFrame:
    """How many documents each update took apart: all, those whose text changed, none, those that went."""
    index = new_index(t, f"upkept-{uuid.uuid4().hex}")
    steps = [index.update(bodies(t, suffixes=False), "body"), index.update(bodies(t), "body"), index.update(bodies(t), "body"), index.update(bodies(t).limit(0), "body", gone=bodies(t).where("cluster_id % 7 = 0"))]
    folders.remove(t.spark, index.path)
    return t.spark.createDataFrame([(k + 1, n) for k, n in enumerate(steps)], "step int, changed long")
