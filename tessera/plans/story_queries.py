"""Queries over whole stories: pages, reports, write-backs, the cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import stories
from tessera.plans.catalog import query
from tessera.sources.tables import Relations

PAGES = """
    WITH mi AS (SELECT m.cluster_id, m.item_id, m.source_id, s.name AS source_name, content_type, published_at, fetched_at, image_url FROM members m JOIN items i ON i.id = m.item_id JOIN sources s ON s.id = m.source_id),
    ty AS (SELECT cluster_id, content_type, count(*) AS n, string_agg(item_id || '@' || source_name, ',' ORDER BY published_at DESC NULLS LAST, fetched_at DESC, item_id) AS listed FROM mi GROUP BY cluster_id, content_type),
    nu AS (SELECT cluster_id, CAST(sum(n) AS bigint) AS n_items, string_agg(content_type || ':' || n, ',' ORDER BY content_type) AS content_types, string_agg(content_type || '=' || listed, ';' ORDER BY content_type) AS evidence FROM ty GROUP BY cluster_id),
    so AS (SELECT cluster_id, count(DISTINCT source_id) AS n_sources FROM members GROUP BY cluster_id),
    im AS (SELECT cluster_id, image_url FROM (SELECT cluster_id, image_url, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC NULLS LAST, fetched_at DESC, item_id) AS rn FROM mi WHERE image_url IS NOT NULL) WHERE rn = 1),
    tt AS (SELECT cluster_id, string_agg(name, ',' ORDER BY rn) AS topics FROM (SELECT cluster_id, topic_id, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, topic_id) AS rn FROM cluster_topics) x JOIN topics t ON t.id = x.topic_id WHERE rn <= 10 GROUP BY cluster_id),
    ca AS (SELECT cluster_id, string_agg(category || ':' || n, ',' ORDER BY score DESC, category) AS categories FROM (SELECT ct.cluster_id, p.name AS category, max(ct.score) AS score, count(*) AS n FROM cluster_topics ct JOIN topics t ON t.id = ct.topic_id JOIN topics p ON p.id = t.parent_id GROUP BY ct.cluster_id, p.name) GROUP BY cluster_id),
    gl AS (SELECT cluster_id, string_agg(term, ',' ORDER BY rn) AS glossary FROM (SELECT cluster_id, term, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term, term_id) AS rn FROM glossary_links l JOIN glossary_terms g ON g.id = l.term_id) WHERE rn <= 25 GROUP BY cluster_id),
    pg AS (SELECT c.id, canonical_title, takeaway, skip_reason, coalesce(n_items, 0) AS n_items, coalesce(n_sources, 0) AS n_sources, coalesce(content_types, '') AS content_types, coalesce(evidence, '') AS evidence, image_url, coalesce(topics, '') AS topic_names,
        coalesce(categories, '') AS categories, coalesce(glossary, '') AS glossary, CAST(NULL AS bigint) AS redirect_to
    FROM clusters c LEFT JOIN nu ON nu.cluster_id = c.id LEFT JOIN so ON so.cluster_id = c.id LEFT JOIN im ON im.cluster_id = c.id LEFT JOIN tt ON tt.cluster_id = c.id LEFT JOIN ca ON ca.cluster_id = c.id LEFT JOIN gl ON gl.cluster_id = c.id WHERE status = 'active')"""


#: What the written pages tell of an item.
TOLD = ("item_id", "source_name")


def written_out(pages: DataFrame) -> DataFrame:
    """Pages with their lists as text."""
    listed = lambda x: F.array_join(F.transform(x, lambda i: F.concat_ws("@", i["item_id"], i["source_name"])), ",")
    text = {
        "content_types": F.transform("content_types", lambda x: F.concat_ws(":", x["content_type"], x["n"].cast("string"))),
        "evidence": F.transform("evidence", lambda x: F.concat(x["content_type"], F.lit("="), listed(x["items"]))),
        "topics": F.transform("topics", lambda x: x["name"]), "categories": F.transform("categories", lambda x: F.concat_ws(":", x["category"], x["n_topics"].cast("string"))), "glossary": F.transform("glossary", lambda x: x["term"]),
    }
    names = {"topics": "topic_names"}
    joined = [F.array_join(v, ";" if c == "evidence" else ",").alias(names.get(c, c)) for c, v in text.items()]
    return pages.select("id", "canonical_title", "takeaway", "skip_reason", "n_items", "n_sources", "image_url", "redirect_to", *joined)


def story_parts(t: Relations) -> list[DataFrame]:
    return [t[n] for n in ("clusters", "members", "items", "sources", "cluster_topics", "topics", "glossary_terms", "glossary_links")]


@query(f"{PAGES} SELECT * FROM pg")
def story_pages(t: Relations) -> DataFrame:
    return written_out(stories.pages(*story_parts(t), shown=TOLD))


@query(f"""{PAGES}, asked AS (SELECT DISTINCT conv_id AS id FROM conversations), rd AS (SELECT from_id AS id, min(to_id) AS to_id FROM redirects GROUP BY from_id)
    SELECT pg.* FROM pg JOIN asked USING (id) WHERE id NOT IN (SELECT id FROM rd)
    UNION ALL SELECT id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, to_id FROM asked JOIN rd USING (id)""")
def story_pages_asked(t: Relations) -> DataFrame:
    """Pages of the clusters that conversations are about, redirects told."""
    asked = t["conversations"].select(F.col("conv_id").alias("cluster_id"))
    return written_out(stories.pages(*story_parts(t), asked=asked, redirects=t["redirects"], shown=TOLD))
