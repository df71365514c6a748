"""Queries about fetching the texts of items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import hydration
from tessera.plans.catalog import query
from tessera.sources.tables import Relations


@query("SELECT id FROM papers WHERE content_type IN ('preprint', 'peer_reviewed') AND trim(coalesce(full_text, '')) = '' ORDER BY published_at DESC NULLS LAST, fetched_at DESC, id LIMIT 200")
def papers_due(r: Relations) -> DataFrame:
    return hydration.papers_due(r["papers"], 200).select("id")


@query("SELECT id FROM papers WHERE content_type NOT IN ('preprint', 'peer_reviewed') AND full_text_status = 'pending' AND trim(coalesce(full_text, '')) = '' ORDER BY published_at DESC NULLS LAST, fetched_at DESC, id LIMIT 200")
def articles_due(r: Relations) -> DataFrame:
    return hydration.articles_due(r["papers"], 200).select("id")


@query("""
    SELECT event_id, CASE WHEN user_id % 9 IN (0, 1, 2) THEN 'paywalled' WHEN user_id % 9 IN (3, 4) THEN 'error' WHEN event_type = 'click' THEN 'error' WHEN value >= 50 THEN 'ok' ELSE 'not_found' END AS status FROM events
""")
def article_status(r: Relations) -> DataFrame:
    """The user id stands for the answer's code, the event type for its content type, the value for its text."""
    code = F.element_at(F.array(*[F.lit(x).cast("int") for x in (401, 402, 403, 500, None, 200, 200, 200, 200)]), (F.col("user_id") % 9 + 1).cast("int"))
    kind = F.when(F.col("event_type") == "click", "application/pdf").otherwise("Text/HTML; charset=utf-8")
    return r["events"].select("event_id", hydration.article_status(code, kind, F.col("value") >= 50).alias("status"))


ANSWERS = """answers AS (SELECT n_nationkey AS id,
    concat('{"message":{"license":[', CASE n_nationkey % 3 WHEN 0 THEN '{"URL":" https://cc.example/by "}' WHEN 1 THEN '{"URL":" "}' ELSE '' END,
      '],"link":[{"URL":"https://p.example/', n_name, '.PDF","content-type":"unspecified"},{"URL":"https://x.example/', n_name, '","content-type":"', CASE WHEN n_nationkey % 2 = 0 THEN 'application/pdf' ELSE 'text/xml' END,
      '"},{"content-type":"application/pdf"}],"URL":"', CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE concat(' https://doi.example/', n_name) END, '"}}') AS crossref,
    concat('{"is_oa":', CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END, ',"open_access":{"license":', CASE WHEN n_nationkey % 3 = 0 THEN '"cc-by"' ELSE 'null' END,
      '},"best_oa_location":', CASE WHEN n_nationkey % 4 = 0 THEN 'null' ELSE concat('{"pdf_url":"https://b.example/', n_name, '.pdf"}') END,
      ',"primary_location":{"url_for_pdf":"","url":"https://q.example/', n_name, '"},"locations":[{"url_for_pdf":"https://l.example/', n_name, '","landing_page_url":"https://m.example/', n_name, '","url":"https://no.example"}]}') AS openalex
    FROM nation)"""


def answers(r: Relations) -> DataFrame:
    sql = f"WITH {ANSWERS} SELECT * FROM answers".replace("{", "{{").replace("}", "}}")
    return r.spark.sql(sql.replace("FROM nation", "FROM {nation}"), nation=r["nation"])


@query("""
    WITH places AS (
      SELECT n_nationkey AS id, n_name, n_nationkey % 3 = 0 AS is_open, CASE WHEN n_nationkey % 3 = 0 THEN 'https://cc.example/by' END AS license FROM nation)
    SELECT id, concat('https://p.example/', n_name, '.PDF') AS url, 'crossref_pdf' AS source, is_open, license FROM places
    UNION ALL SELECT id, concat('https://x.example/', n_name), 'crossref_pdf', is_open, license FROM places WHERE id % 2 = 0
    UNION ALL SELECT id, concat('https://doi.example/', n_name), 'crossref_landing', is_open, license FROM places WHERE id % 5 <> 0
""")
def crossref_places(r: Relations) -> DataFrame:
    found = answers(r).select("id", F.explode(hydration.crossref_places(F.col("crossref"))).alias("p"))
    return found.select("id", "p.url", "p.source", "p.is_open", "p.license")


@query("""
    WITH places AS (SELECT n_nationkey AS id, n_name, n_nationkey % 2 = 0 AS is_open, CASE WHEN n_nationkey % 3 = 0 THEN 'cc-by' END AS license FROM nation)
    SELECT id, concat('https://b.example/', n_name, '.pdf') AS url, 'openalex_pdf' AS source, is_open, license FROM places WHERE id % 4 <> 0
    UNION ALL SELECT id, concat('https://q.example/', n_name), 'openalex_landing', is_open, license FROM places
    UNION ALL SELECT id, concat('https://l.example/', n_name), 'openalex_pdf', is_open, license FROM places
    UNION ALL SELECT id, concat('https://m.example/', n_name), 'openalex_landing', is_open, license FROM places
""")
def openalex_places(r: Relations) -> DataFrame:
    found = answers(r).select("id", F.explode(hydration.openalex_places(F.col("openalex"))).alias("p"))
    return found.select("id", "p.url", "p.source", "p.is_open", "p.license")


@query("""
    SELECT n_nationkey AS id, concat_ws(' ',
      CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 4 <> 0 THEN concat('https://b.example/', n_name, '.pdf') END, CASE WHEN n_nationkey % 2 = 0 THEN concat('https://l.example/', n_name) END,
      concat('https://q.example/', n_name), concat('https://m.example/', n_name)) AS tried
    FROM nation
""")
def places_in_order(r: Relations) -> DataFrame:
    """Open PDFs before landing pages; a PDF that isn't open is left out."""
    tried = F.transform(hydration.in_order(hydration.openalex_places(F.col("openalex"))), lambda p: p["url"])
    return answers(r).select("id", F.array_join(tried, " ").alias("tried"))


@query("""
    WITH steps AS (
      SELECT *, CASE source WHEN 'arxiv_api' THEN 2 WHEN 'openalex_landing' THEN 6 WHEN 'crossref' THEN 9 WHEN 'landing_page' THEN 11 ELSE 1 END AS step,
             CASE source WHEN 'arxiv_html' THEN round(quality + 0.12, 6) WHEN 'arxiv_pdf' THEN round(quality + 0.08, 6) WHEN 'arxiv_eprint' THEN round(quality + 0.18, 6) ELSE 0 END AS score FROM tries),
    best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY step, score DESC, CASE source WHEN 'arxiv_html' THEN 0 WHEN 'arxiv_pdf' THEN 1 ELSE 2 END, place) AS rn FROM steps WHERE trim(coalesce(text, '')) <> ''),
    landed AS (SELECT item_id, coalesce(status, 'not_found') AS status FROM tries WHERE source = 'landing_page' AND trim(coalesce(text, '')) = '')
    SELECT d.doc_id AS item_id, b.text AS text, CASE WHEN b.item_id IS NOT NULL THEN 'ok' ELSE coalesce(l.status, 'not_found') END AS status,
           coalesce(b.source, CASE WHEN l.item_id IS NOT NULL THEN 'landing_page' END) AS source,
           CASE WHEN b.source IN ('arxiv_api', 'crossref', 'openalex') THEN 'abstract' WHEN b.item_id IS NOT NULL THEN 'fulltext' END AS kind, CASE WHEN b.step <= 2 THEN 'arxiv' ELSE b.license END AS license
    FROM documents d LEFT JOIN best b ON b.item_id = d.doc_id AND b.rn = 1 LEFT JOIN landed l ON l.item_id = d.doc_id
""")
def text_cascade(r: Relations) -> DataFrame:
    return hydration.cascade(r["documents"].select(F.col("doc_id").alias("item_id")), r["tries"], F.col("quality"))


@query("""
    SELECT id, CASE WHEN id % 10 = 3 THEN 'fetched' ELSE full_text END AS full_text, CASE WHEN id % 10 = 3 THEN 'ok' ELSE full_text_status END AS full_text_status,
           CASE WHEN id % 10 = 3 THEN coalesce(image_url, 'https://new.example/i.png') ELSE image_url END AS image_url FROM papers
""")
def hydration_write_back(r: Relations) -> DataFrame:
    stored = r["papers"].select("id", "full_text", "full_text_status", "image_url")
    ids = stored.where("id % 10 = 3").select("id").union(r.spark.range(-5, -1))
    fetched = ids.select("id", F.lit("fetched").alias("full_text"), F.lit("ok").alias("full_text_status"), F.lit("https://new.example/i.png").alias("image_url"))
    return hydration.write_back(stored, fetched)


@query("""
    SELECT id, CASE WHEN trim(coalesce(arxiv_id, '')) <> '' THEN 'arxiv' ELSE 'landing' END AS pass,
           CASE WHEN trim(coalesce(arxiv_id, '')) <> '' THEN concat('https://arxiv.org/html/', trim(arxiv_id)) ELSE coalesce(nullif(canonical_url, ''), url) END AS url
    FROM papers WHERE image_url IS NULL AND (trim(coalesce(arxiv_id, '')) <> '' OR coalesce(nullif(canonical_url, ''), url) IS NOT NULL)
    ORDER BY pass, published_at DESC NULLS LAST, id LIMIT 150
""")
def images_due(r: Relations) -> DataFrame:
    return hydration.images_due(r["papers"], 150)


@query("""
    SELECT event_id AS feed_id, epoch_us(ts) AS started_us, CASE WHEN event_type = 'error' OR user_id % 4 = 0 THEN 'error' ELSE 'success' END AS status, CAST(trunc(value) AS bigint) AS duration_ms, user_id % 7 AS items_seen FROM events
""")
def fetch_log(r: Relations) -> DataFrame:
    runs = r["events"].select(
        F.col("event_id").alias("feed_id"), F.col("ts").cast("timestamp").alias("started_at"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.floor("value") * 1000).cast("long")).alias("finished_at"),
        F.when(F.col("user_id") % 4 == 0, 503).otherwise(200).alias("http_status"), F.when(F.col("event_type") == "error", "timed out").alias("error_message"), (F.col("user_id") % 7).alias("items_seen"),
    )
    none = runs.withColumn("duration_ms", F.lit(0).cast("long")).withColumn("status", F.lit("")).limit(0)
    return hydration.fetch_log(none, runs).select("feed_id", F.unix_micros("started_at").alias("started_us"), "status", "duration_ms", "items_seen")
