"""The engine's relations as views over the driver's tables.

Each view is one SQL text that Spark and DuckDB both run, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessera.session import importable

DRIVER_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

ITEM_ID = "concat_ws('|', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string), substr(cast(l_shipdate as string), 1, 10))"

VIEWS = {
    "sources": """
        SELECT s_suppkey AS id, s_name AS name, s_suppkey % 10 <> 0 AS active,
               CASE s_nationkey % 7 WHEN 0 THEN 'journal' WHEN 1 THEN 'preprint_server' WHEN 2 THEN 'university' WHEN 3 THEN 'government'
                                    WHEN 4 THEN 'lab' WHEN 5 THEN 'journalism' ELSE 'blog' END AS source_type,
               CASE s_suppkey % 3 WHEN 0 THEN 'tier1' WHEN 1 THEN 'tier2' END AS reliability_tier
        FROM supplier""",
    "feeds": """
        SELECT n_nationkey * 1000 + s_suppkey AS id, s_suppkey AS source_id, concat('https://feeds.example/', n_name, '/', s_name) AS feed_url,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 3 END AS error_streak, s_acctbal AS last_seconds
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "items": f"""
        SELECT {ITEM_ID} AS id, l_suppkey AS source_id, concat(p_name, ' ', p_type, ' ', p_brand) AS title,
               CASE l_linenumber % 5 WHEN 0 THEN 'peer_reviewed' WHEN 1 THEN 'preprint' WHEN 2 THEN 'report' WHEN 3 THEN 'press_release' ELSE 'news' END AS content_type,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END AS published_at, l_shipdate AS fetched_at,
               CASE WHEN l_partkey % 11 = 0 THEN concat('2401.', cast(10000 + l_partkey AS string)) END AS arxiv_id,
               CASE WHEN l_partkey % 4 = 0 THEN concat('https://img.example/', cast(l_partkey AS string), '.png') END AS image_url
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "clusters": """
        SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'pending' ELSE 'quarantined' END AS status,
               o_orderdate AS updated_at, concat(o_orderpriority, ' story ', cast(o_orderkey AS string)) AS canonical_title,
               CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 101) / 100.0E0 END AS final_score,
               CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 97) / 100.0E0 END AS provisional_score,
               CASE WHEN o_orderkey % 5 <> 0 THEN concat('takeaway ', cast(o_orderkey AS string)) END AS takeaway,
               CASE WHEN o_orderkey % 7 = 0 THEN concat('intuition ', cast(o_orderkey AS string)) END AS summary_intuition,
               CASE WHEN o_orderkey % 13 = 0 THEN 'no_source_text' END AS skip_reason, o_custkey AS custkey
        FROM orders""",
    "members": f"""
        SELECT l_orderkey AS cluster_id, {ITEM_ID} AS item_id, l_suppkey AS source_id, l_shipdate AS added_at,
               CASE l_linenumber % 3 WHEN 0 THEN 'primary' WHEN 1 THEN 'supporting' ELSE 'background' END AS role
        FROM lineitem""",
    "topics": """
        SELECT r_regionkey AS id, r_name AS name, CAST(NULL AS int) AS parent_id FROM region
        UNION ALL SELECT 100 + n_nationkey, n_name, n_regionkey FROM nation""",
    "cluster_topics": """
        SELECT o_orderkey AS cluster_id, 100 + c_nationkey AS topic_id, round((c_acctbal + 1000) / 12000, 4) AS score, o_orderkey % 9 = 0 AS locked
        FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL
        SELECT o_orderkey, 100 + (c_nationkey + 1 + o_orderkey % 24) % 25, round((o_orderkey % 100) / 100.0E0, 4), false
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0""",
    "follows": "SELECT DISTINCT user_id, 100 + event_id % 25 AS topic_id FROM events WHERE event_type = 'signup' AND event_id % 20 = 0",
    "saves": "SELECT user_id, event_id % 1500 AS cluster_id, min(ts) AS created_at FROM events WHERE event_type = 'purchase' GROUP BY user_id, event_id % 1500",
    "hides": "SELECT DISTINCT user_id, event_id % 1500 AS cluster_id FROM events WHERE event_type = 'error'",
    "watches": "SELECT user_id, event_id % 1500 AS cluster_id, min(ts) AS created_at FROM events WHERE event_type = 'click' GROUP BY user_id, event_id % 1500",
    "update_log": "SELECT conv_id AS cluster_id, turn AS seq, role AS change_type, text AS summary FROM conversations",
    "links": """
        SELECT page_id AS id, CASE page_id % 9 WHEN 0 THEN 'https://arxiv.org/abs/2401.00001' WHEN 1 THEN 'https://www.nature.com/articles/s41586-024-1' WHEN 2 THEN 'https://www.nature.com/articles/d41586-024-1'
               WHEN 3 THEN 'https://www.nejm.org/doi/1' WHEN 4 THEN 'http://news.mit.edu/2024/a' WHEN 5 THEN 'https://www.nasa.gov/x' ELSE url END AS url,
               CASE page_id % 5 WHEN 0 THEN 'journal' WHEN 1 THEN 'government' WHEN 2 THEN 'lab' WHEN 3 THEN 'blog' ELSE 'preprint_server' END AS source_type,
               CASE WHEN page_id % 11 = 0 THEN '2401.00001' END AS arxiv_id FROM pages""",
    "notices": """
        SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN concat('see arXiv:2401.', cast(10000 + doc_id AS string), 'v2 now') WHEN 1 THEN concat('doi:10.1038/s', cast(doc_id AS string), '-xThe rest')
               WHEN 2 THEN concat('old hep-th/', substr(cast(10000000 + doc_id AS string), 2, 7), ' and 10.5555/ab.', cast(doc_id AS string), '.') ELSE 'none' END AS text FROM documents""",
    "titles": "SELECT doc_id, source, split_part(text, chr(10), 1) AS title FROM documents",
    "requests": """
        SELECT event_id, ts, concat('/v1/', event_type, '/', cast(user_id AS string)) AS path, event_type AS method, value / 50 AS seconds,
               CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status FROM events""",
    "preferences": """
        SELECT user_id, CASE user_id % 4 WHEN 0 THEN 'UTC' WHEN 1 THEN 'America/New_York' WHEN 2 THEN 'Asia/Tokyo' ELSE 'Europe/Paris' END AS zone,
               CASE user_id % 3 WHEN 0 THEN 1320 WHEN 1 THEN 60 ELSE 480 END AS quiet_start, CASE user_id % 3 WHEN 0 THEN 480 WHEN 1 THEN 300 ELSE 480 END AS quiet_end,
               CAST(1 + user_id % 5 AS bigint) AS daily_limit, user_id % 7 <> 3 AS enabled FROM (SELECT DISTINCT user_id FROM events) u""",
    "papers": """
        SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'preprint' WHEN 1 THEN 'peer_reviewed' WHEN 2 THEN 'news' ELSE 'report' END AS content_type,
               CASE WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 3 = 1 THEN '  ' END AS full_text, CASE WHEN doc_id % 5 = 0 THEN 'error' ELSE 'pending' END AS full_text_status,
               CASE doc_id % 7 WHEN 0 THEN 'arxiv_pdf' WHEN 1 THEN 'crossref' WHEN 2 THEN 'landing_page' WHEN 3 THEN 'unheard of' END AS full_text_source,
               CASE doc_id % 6 WHEN 0 THEN 'Fulltext' WHEN 1 THEN 'abstract' END AS full_text_kind,
               CASE WHEN doc_id % 8 = 0 THEN NULL ELSE n_chars END AS published_at, n_chars % 1000 AS fetched_at, CASE WHEN doc_id % 2 = 0 THEN concat('https://img.example/', cast(doc_id AS string)) END AS image_url,
               CASE doc_id % 9 WHEN 1 THEN concat('2402.', cast(10000 + doc_id AS string)) WHEN 3 THEN ' ' END AS arxiv_id, CASE WHEN doc_id % 10 < 7 THEN concat('https://site.example/', cast(doc_id AS string)) END AS url,
               CASE WHEN doc_id % 10 < 3 THEN '' WHEN doc_id % 10 < 5 THEN concat('https://site.example/c/', cast(doc_id AS string)) END AS canonical_url, split_part(text, chr(10), 1) AS title, source AS source_name
        FROM documents""",
    "tries": """
        SELECT doc_id AS item_id, 'arxiv_html' AS source, 1 AS place, text AS text, (doc_id % 50) / 100.0E0 AS quality, CAST(NULL AS string) AS license, CAST(NULL AS string) AS status FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 'arxiv_pdf', 1, text, (doc_id % 41) / 100.0E0, NULL, NULL FROM documents WHERE doc_id % 4 = 0 AND doc_id % 3 > 0
        UNION ALL SELECT doc_id, 'arxiv_eprint', 1, CASE WHEN doc_id % 5 > 0 THEN text END, (doc_id % 37) / 100.0E0, NULL, NULL FROM documents WHERE doc_id % 8 = 0
        UNION ALL SELECT doc_id, 'arxiv_api', 1, split_part(text, chr(10), 1), 0.0E0, NULL, NULL FROM documents WHERE doc_id % 8 < 2
        UNION ALL SELECT doc_id, 'openalex_landing', 2, split_part(text, chr(10), 1), 0.9E0, 'cc-by', NULL FROM documents WHERE doc_id % 8 IN (3, 5)
        UNION ALL SELECT doc_id, 'openalex_landing', 1, split_part(text, chr(10), 1), 0.1E0, 'cc0', NULL FROM documents WHERE doc_id % 16 = 3
        UNION ALL SELECT doc_id, 'crossref', 1, '  ', 0.0E0, NULL, NULL FROM documents WHERE doc_id % 8 = 6
        UNION ALL SELECT doc_id, 'landing_page', 1, CASE WHEN doc_id % 3 = 0 THEN split_part(text, chr(10), 1) END, 0.0E0, NULL, CASE WHEN doc_id % 5 = 0 THEN 'paywalled' END FROM documents WHERE doc_id % 8 > 5""",
    "glossary_terms": "SELECT n_nationkey AS id, n_name AS term FROM nation",
    "glossary_links": "SELECT o_orderkey AS cluster_id, o_custkey % 25 AS term_id, (o_orderkey % 50) / 50.0E0 AS score FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, (o_custkey + 7) % 25, (o_custkey % 50) / 50.0E0 FROM orders WHERE o_orderkey % 3 < 2",
    "redirects": "SELECT o_orderkey AS from_id, o_orderkey - 1 AS to_id FROM orders WHERE o_orderkey % 17 = 5",
}

class Relations(dict):
    """Relations by name, made when first asked for: driver tables, then views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        importable(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            self[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            text = VIEWS[name]
            used = [t for t in DRIVER_TABLES if re.search(rf"\b{t}\b", text)]
            for t in used:
                text = re.sub(rf"\b((?:FROM|JOIN)\s+){t}\b", rf"\1{{{t}}}", text)
            self[name] = self.spark.sql(text, **{t: self[t] for t in used})
        return self[name]


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names put before it."""
    names = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if not head:
        return body
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
