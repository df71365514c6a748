"""Queries over ingestion, work lists, JSON payloads and small look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import payloads, scores, text, times
from tessera.operators import enrichment, feeds, governance, graph, impact, ingest, metrics, ops, topics, worklists
from tessera.plans.catalog import query
from tessera.sources.tables import Relations


@query("""
    SELECT f.id, f.feed_url FROM feeds f JOIN sources s ON s.id = f.source_id WHERE s.active AND coalesce((CASE WHEN source_id % 4 = 0 THEN NULL ELSE source_id % 120 END) >= 30, true)
    ORDER BY (CASE WHEN source_id % 4 = 0 THEN NULL ELSE source_id % 120 END) DESC NULLS FIRST, f.id LIMIT 25""")
def due_feeds(t: Relations) -> DataFrame:
    age = F.when(F.col("source_id") % 4 != 0, F.col("source_id") % 120)
    return ingest.due_feeds(t["feeds"], t["sources"], age, F.lit(30), 25).select("id", "feed_url")


@query("""SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN coalesce(error_streak, 0) + 1 ELSE error_streak END AS bigint) AS error_streak, CASE WHEN id % 3 = 0 THEN '200' WHEN id % 3 = 1 THEN '503' END AS last_status FROM feeds""")
def feed_health(t: Relations) -> DataFrame:
    results = t["feeds"].where("id % 3 IN (0, 1)").select("id", (F.col("id") % 3 == 0).alias("ok"), F.when(F.col("id") % 3 == 0, "200").otherwise("503").alias("status"))
    return ingest.feed_health(t["feeds"], results).select("id", F.col("error_streak").cast("long").alias("error_streak"), "last_status")


@query("""
    WITH s AS (SELECT doc_id % 200 AS item, doc_id AS place, CAST(round((doc_id * 37 % 101) / 200.0 + CASE doc_id % 4 WHEN 0 THEN 0.18 WHEN 1 THEN 0.12 WHEN 2 THEN 0.08 ELSE 0 END, 6) AS double) AS score FROM documents)
    SELECT item, place, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, place) AS rn FROM s) WHERE rn = 1""")
def best_candidate_text(t: Relations) -> DataFrame:
    c = t["documents"].select((F.col("doc_id") % 200).alias("item"), F.col("doc_id").alias("place"))
    origin = F.element_at(F.array(*map(F.lit, ("eprint", "html", "pdf", "other"))), (F.col("place") % 4 + 1).cast("int"))
    return ingest.best_text(c, "item", (F.col("place") * 37 % 101) / 200.0, origin).select("item", "place", "score")


@query("""SELECT doc_id, title AS text FROM titles WHERE title <> ''""")
def abstract_rebuilt(t: Relations) -> DataFrame:
    spread = t["titles"].where("title <> ''").select("doc_id", F.posexplode(F.split("title", " ")).alias("at", "word"))
    index = spread.groupBy("doc_id", "word").agg(F.collect_list("at").alias("positions"))
    return ingest.rebuild_text(index, "doc_id")


@query("""
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 2 = 0 THEN url || '.pdf:pdf,' || url || ':page' ELSE url || ':page,' || url || '2:page' END AS places FROM pages""")
def open_access_places(t: Relations) -> DataFrame:
    loc = lambda pdf, page: F.struct(pdf.alias("url_for_pdf"), page.alias("url_for_landing_page"))
    u, none, even = F.col("url"), F.lit(None).cast("string"), F.col("page_id") % 2 == 0
    best = loc(F.when(even, F.concat(u, F.lit(".pdf"))), u)
    answer = F.to_json(F.struct((F.col("page_id") % 3 != 0).alias("is_oa"), best.alias("best_oa_location"), F.array(loc(none, u), loc(none, F.when(~even, F.concat(u, F.lit("2"))))).alias("oa_locations")))
    return t["pages"].select("page_id", F.array_join(F.transform(ingest.open_access(answer), lambda x: F.concat_ws(":", x["url"], x["kind"])), ",").alias("places"))


@query("""SELECT doc_id, CASE WHEN trim(coalesce(CASE WHEN doc_id % 5 <> 0 THEN text END, '')) = '' THEN 'missing' WHEN doc_id % 3 = 0 THEN 'abstract' WHEN doc_id % 2 = 0 THEN 'abstract' ELSE 'fulltext' END AS kind FROM documents""")
def paper_text_kind(t: Relations) -> DataFrame:
    d = F.col("doc_id")
    return t["documents"].select("doc_id", enrichment.paper_kind(F.when(d % 5 != 0, F.col("text")), F.when(d % 3 == 0, " Abstract"), F.when(d % 2 == 0, F.when(d % 4 == 0, "arxiv_api").otherwise("unheard of")).otherwise("arxiv_pdf")).alias("kind"))


@query("""
    WITH a AS (SELECT DISTINCT id FROM items WHERE source_id % 2 = 0), b AS (SELECT id, count(*) AS n FROM items WHERE source_id % 3 = 0 GROUP BY id)
    SELECT CAST(sum(n) AS bigint) AS seen, count(*) FILTER (WHERE a.id IS NULL) AS inserted, count(*) FILTER (WHERE a.id IS NOT NULL) AS updated FROM b LEFT JOIN a ON a.id = b.id""")
def ingestion_totals(t: Relations) -> DataFrame:
    return ingest.run_totals(t["items"].where("source_id % 2 = 0"), t["items"].where("source_id % 3 = 0"), "id")


@query("""
    WITH q AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat('10.1000/x', cast(doc_id AS string)) WHEN 1 THEN 'arXiv:2401.01234v2' WHEN 2 THEN cast(10000000 + doc_id AS string) WHEN 3 THEN concat('PMID: ', cast(doc_id AS string)) ELSE 'weather model' END AS q FROM documents)
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'doi' WHEN 1 THEN 'arxiv' WHEN 2 THEN 'pmid' WHEN 3 THEN 'pmid' END AS kind FROM q""")
def identifier_kinds(t: Relations) -> DataFrame:
    d = F.col("doc_id")
    q = F.when(d % 5 == 0, F.concat(F.lit("10.1000/x"), d.cast("string"))).when(d % 5 == 1, "arXiv:2401.01234v2").when(d % 5 == 2, (d + 10000000).cast("string")).when(d % 5 == 3, F.concat(F.lit("PMID: "), d.cast("string"))).otherwise("weather model")
    return t["documents"].select("doc_id", text.identifier_kind(q).alias("kind"))


@query("""
    WITH n AS (SELECT cluster_id, count(*) AS n FROM members GROUP BY cluster_id), x AS (SELECT id, takeaway || CASE WHEN id % 4 = 0 THEN ' a Breakthrough' ELSE repeat(' and more', CAST(id % 30 AS int)) END AS w, coalesce(n, 0) AS n FROM clusters LEFT JOIN n ON cluster_id = id WHERE takeaway IS NOT NULL)
    SELECT id, round(CAST(greatest(0.0, least(1.0, 0.8 - CASE WHEN length(w) < 50 THEN 0.15 WHEN length(w) < 100 THEN 0.05 WHEN length(w) > 280 THEN 0.1 ELSE 0 END + CASE WHEN n >= 3 THEN 0.1 WHEN n = 1 THEN -0.1 ELSE 0 END
        - CASE WHEN contains(lower(w), 'breakthrough') THEN 0.1 ELSE 0 END)) AS double), 6) AS confidence FROM x""")
def takeaway_confidence(t: Relations) -> DataFrame:
    n = t["members"].groupBy("cluster_id").agg(F.count("*").alias("n"))
    w = F.concat("takeaway", F.when(F.col("id") % 4 == 0, " a Breakthrough").otherwise(F.repeat(F.lit(" and more"), (F.col("id") % 30).cast("int"))))
    x = t["clusters"].where("takeaway IS NOT NULL").join(n, F.col("id") == F.col("cluster_id"), "left")
    return x.select("id", F.round(scores.takeaway_confidence(w, F.coalesce("n", F.lit(0))), 6).alias("confidence"))


@query("""SELECT id, round(CAST(greatest(0.0, least(1.0, CASE WHEN final_score IS NULL THEN provisional_score ELSE (provisional_score * 0.4 + final_score * 0.6) / 1.0 END)) AS double), 6) AS score FROM clusters WHERE provisional_score IS NOT NULL""")
def blended_scores(t: Relations) -> DataFrame:
    return t["clusters"].where("provisional_score IS NOT NULL").select("id", F.round(scores.blend(F.col("provisional_score"), F.col("final_score")), 6).alias("score"))


@query("""
    WITH d AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE date_diff('day', date_trunc('day', ts), TIMESTAMP '2024-01-31') END AS n FROM events)
    SELECT event_id, CASE WHEN n IS NULL THEN '' WHEN n = 0 THEN 'Time since last update: Same day' WHEN n = 1 THEN 'Time since last update: Yesterday' WHEN n < 7 THEN 'Time since last update: ' || n || ' days ago'
        WHEN n < 30 THEN 'Time since last update: ' || (n // 7) || ' week(s) ago' ELSE 'Time since last update: ' || (n // 30) || ' month(s) ago' END AS phrase FROM d""")
def time_phrases(t: Relations) -> DataFrame:
    n = F.when(F.col("event_id") % 9 != 0, F.date_diff(F.lit("2024-01-31").cast("date"), F.col("ts").cast("date")))
    return t["events"].select("event_id", times.time_phrase(n).alias("phrase"))


@query("""SELECT cluster_id, seq FROM update_log WHERE change_type = 'assistant' ORDER BY seq DESC NULLS LAST, cluster_id LIMIT 20 OFFSET 20""")
def audit_log(t: Relations) -> DataFrame:
    kept = t["update_log"].where("change_type = 'assistant'")
    return feeds.page(kept, [feeds.newest("seq"), F.col("cluster_id")], 20, 2).select("cluster_id", "seq")


@query("SELECT n_name AS term FROM nation WHERE lower(n_name) = 'nation_7' OR CAST(n_nationkey AS varchar) = 'Nation_7'")
def glossary_lookup(t: Relations) -> DataFrame:
    entries = t["nation"].select(F.col("n_name").alias("term"), F.array(F.col("n_nationkey").cast("string")).alias("aliases"))
    return graph.glossary(entries, "Nation_7").select("term")


@query("""SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'resolved' ELSE 'new' END AS status, CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-01-31' END AS resolved_at, CAST(NULL AS timestamp) AS triaged_at FROM events""")
def feedback_triage(t: Relations) -> DataFrame:
    f = t["events"].select(F.col("event_id").alias("id"), "event_type", F.lit("new").alias("status"), F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("timestamp").alias("triaged_at"))
    out = governance.triage(f, F.col("event_type") == "error", "resolved", F.lit("2024-01-31").cast("timestamp"))
    return out.select("id", "status", F.col("resolved_at").cast("timestamp_ntz").alias("resolved_at"), F.col("triaged_at").cast("timestamp_ntz").alias("triaged_at"))


@query("""SELECT user_id, max(coalesce(CAST(json_extract_string(props, '$.k') AS int), 50)) AS k, 'UTC' AS zone FROM events GROUP BY user_id""")
def prefs_with_defaults(t: Relations) -> DataFrame:
    leaf = lambda path, default: F.coalesce(F.get_json_object("props", path), F.lit(default))
    return t["events"].groupBy("user_id").agg(F.max(leaf("$.k", "50").cast("int")).alias("k"), F.max(leaf("$.zone", "UTC")).alias("zone"))


@query("""
    WITH i AS (SELECT m.cluster_id, title, row_number() OVER (PARTITION BY m.cluster_id ORDER BY coalesce(published_at, fetched_at) DESC, m.item_id) AS rn FROM members m JOIN items x ON x.id = m.item_id),
    t AS (SELECT c.id AS cluster_id, canonical_title, concat_ws(' ', canonical_title, string_agg(title, ' ' ORDER BY rn)) AS fresh FROM clusters c JOIN i ON i.cluster_id = c.id WHERE rn <= 8 GROUP BY c.id, canonical_title)
    SELECT cluster_id FROM t WHERE fresh IS DISTINCT FROM CASE WHEN cluster_id % 2 = 0 THEN fresh END""")
def search_text_changed(t: Relations) -> DataFrame:
    fresh = metrics.search_text(t["clusters"], t["members"], t["items"])
    stored = F.when(F.col("cluster_id") % 2 == 0, F.col("search_text"))
    return fresh.where(~F.col("search_text").eqNullSafe(stored)).select("cluster_id")


@query("""SELECT id FROM clusters WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = id AND substr(sha256(canonical_title), 1, 16) = CASE WHEN vec_id % 3 = 0 THEN 'stale' ELSE substr(sha256(canonical_title), 1, 16) END)""")
def embeddings_due(t: Relations) -> DataFrame:
    c = t["clusters"].withColumn("source_text_hash", F.left(F.sha2("canonical_title", 256), F.lit(16)))
    e = t["embeddings"].select(F.col("vec_id").alias("cluster_id")).join(c.select(F.col("id").alias("cluster_id"), "source_text_hash"), "cluster_id")
    e = e.withColumn("source_text_hash", F.when(F.col("cluster_id") % 3 == 0, "stale").otherwise(F.col("source_text_hash")))
    return worklists.without_embedding(c, e, hashes=True).select("id")


@query("""SELECT id FROM clusters WHERE id % 4 = 0 OR updated_at - INTERVAL 1 DAY + to_days(CAST(id % 3 AS int)) < updated_at""")
def impact_due(t: Relations) -> DataFrame:
    at = F.when(F.col("id") % 4 != 0, F.col("updated_at") + F.make_dt_interval((F.col("id") % 3 - 1).cast("int")))
    return worklists.stale_impact(t["clusters"].withColumn("assessed_at", at)).select("id")


@query("""SELECT id, CASE WHEN id % 3 = 0 THEN '' WHEN id % 2 = 0 THEN 'physics:0.9,biology:0.7' ELSE 'biology:0.7' END AS topics FROM clusters""")
def classification_parsed(t: Relations) -> DataFrame:
    answer = F.when(F.col("id") % 3 == 0, "not json").when(F.col("id") % 2 == 0, '{"topics": [{"name": "biology", "score": 0.7}, {"name": "physics", "score": 0.9}, {"name": "law", "score": 0.2}]}').otherwise('{"topics": [{"name": "biology", "score": 0.7}, {"score": 0.9}]}')
    parsed = F.transform(topics.parse_classification(answer), lambda x: F.concat_ws(":", x["name"], x["score"].cast("string")))
    return t["clusters"].select("id", F.coalesce(F.array_join(parsed, ","), F.lit("")).alias("topics"))


@query("""
    SELECT id, CASE WHEN id % 2 = 0 THEN 'md ' || id ELSE 'plain ' || id END AS markdown, CASE WHEN id % 2 = 0 THEN 'twenty' END AS eli20, CAST(NULL AS varchar) AS eli5 FROM clusters""")
def explainer_fields(t: Relations) -> DataFrame:
    said = F.when(F.col("id") % 2 == 0, F.concat(F.lit(' {"markdown": "md '), F.col("id").cast("string"), F.lit('", "eli20": "twenty"} '))).otherwise(F.concat(F.lit("plain "), F.col("id").cast("string")))
    return t["clusters"].select("id", *[c.alias(k) for k, c in feeds.explainers(said).items()])


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'https://x.example/own' WHEN 1 THEN 'https://x.example/alt' WHEN 2 THEN 'https://x.example/bare' END AS url,
    CASE doc_id % 5 WHEN 0 THEN 'media' WHEN 1 THEN 'thumb' WHEN 2 THEN 'enclosed' WHEN 3 THEN 'field' END AS image FROM documents""")
def entry_links(t: Relations) -> DataFrame:
    d, none = F.col("doc_id"), F.lit(None).cast("string")
    link = lambda href, rel, kind=None: F.struct(F.lit(href).alias("href"), F.lit(rel).cast("string").alias("rel"), F.lit(kind).cast("string").alias("type"))
    links = F.array(link("https://x.example/self", "self"), F.when(d % 4 == 1, link(" https://x.example/alt ", "Alternate")).when(d % 4 == 2, link("https://x.example/bare", None)).otherwise(link("", "alternate")), F.when(d % 5 == 2, link("enclosed", "enclosure", "image/png")).otherwise(link("no", "enclosure", "audio/mp3")))
    media = lambda url, medium, kind: F.struct(F.lit(url).alias("url"), F.lit(medium).cast("string").alias("medium"), F.lit(kind).cast("string").alias("type"))
    content = F.array(media("video", "video", "video/mp4"), F.when(d % 5 == 0, media(" media", None, None)).otherwise(media(" ", "image", None)))
    thumbs = F.when(d % 5 == 1, F.array(media("thumb", None, None)))
    return t["documents"].select("doc_id", payloads.entry_url(F.when(d % 4 == 0, " https://x.example/own "), links).alias("url"), payloads.entry_image(content, thumbs, links, F.when(d % 5 == 3, "field").otherwise(none)).alias("image"))


@query("""SELECT c_custkey AS id, lower(c_name) AS mail, concat('search:', sha256(lower(c_name))) AS key, concat('W/"', c_custkey, '"') AS etag FROM customer""")
def lookup_keys(t: Relations) -> DataFrame:
    name = F.concat(F.lit("  "), "c_name", F.lit(" "))
    return t["customer"].select(F.col("c_custkey").alias("id"), payloads.mail_key(name).alias("mail"), payloads.cache_key(name).alias("key"), payloads.weak_etag(F.col("c_custkey").cast("string")).alias("etag"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('A & B > ', doc_id, ' é end') END AS said FROM documents""")
def cleaned_payloads(t: Relations) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, " <br/> ").otherwise(F.concat(F.lit("<p>A &amp; B</p>\n &gt; "), F.col("doc_id").cast("string"), F.lit(" &#233; <b x='1'>end")))
    return t["documents"].select("doc_id", payloads.clean(raw).alias("said"))


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN concat(n_name, '|x') ELSE '' END AS listed, CASE n_nationkey % 3 WHEN 0 THEN concat(n_name, '|a, b|q"t') WHEN 1 THEN '' ELSE n_name END AS members FROM nation""")
def lists_in_payloads(t: Relations) -> DataFrame:
    n, k = F.col("n_name"), F.col("n_nationkey")
    listed = F.when(k % 4 == 0, F.concat(F.lit('["'), n, F.lit('","x"]'))).when(k % 4 == 1, '{"a":1}').when(k % 4 == 2, "no json")
    text_ = F.when(k % 3 == 0, F.concat(F.lit("{"), n, F.lit(',"a, b","q\\"t",NULL}'))).when(k % 3 == 1, "{}").otherwise(F.concat(F.lit("{"), n, F.lit("}")))
    return t["nation"].select(k.alias("id"), F.array_join(payloads.json_list(listed), "|").alias("listed"), F.array_join(payloads.array_text(text_), "|").alias("members"))


@query("""SELECT n_nationkey AS id, n_name AS markdown, CASE n_nationkey % 3 WHEN 0 THEN 'then' ELSE '' END AS generated_at, CASE n_nationkey % 3 WHEN 0 THEN 7 ELSE 2 END AS source_count, CASE WHEN n_nationkey % 2 = 0 THEN 'new' WHEN n_nationkey % 3 = 0 THEN 'old' END AS eli20, CASE WHEN n_nationkey % 3 = 0 THEN 'old5' END AS eli5 FROM nation""")
def explainers_merged(t: Relations) -> DataFrame:
    k = F.col("n_nationkey")
    stored = F.when(k % 3 == 0, '{"markdown":"m","generated_at":"then","source_count":7,"eli20":"old","eli5":"old5"}').when(k % 3 == 1, "plain text").otherwise('{"source_count":0}')
    return t["nation"].select(k.alias("id"), payloads.merged_explainers(stored, F.col("n_name"), F.lit(2), F.when(k % 2 == 0, "new").otherwise(""), F.lit(None).cast("string")).alias("e")).select("id", "e.*")


@query("""
    WITH p AS (SELECT id FROM topics WHERE id = 1 OR parent_id = 1), m AS (SELECT c.*, topic_id FROM clusters c JOIN cluster_topics ct ON ct.cluster_id = c.id WHERE status = 'active' AND topic_id IN (SELECT id FROM p))
    SELECT * FROM (SELECT 'latest' AS list, row_number() OVER (ORDER BY updated_at DESC, id, topic_id) AS rn, id, topic_id FROM m) WHERE rn <= 20
    UNION ALL SELECT * FROM (SELECT 'impact' AS list, row_number() OVER (ORDER BY final_score DESC NULLS LAST, updated_at DESC, id, topic_id) AS rn, id, topic_id FROM m) WHERE rn <= 20""")
def topic_page_lists(t: Relations) -> DataFrame:
    return topics.page_lists(t["clusters"].withColumnRenamed("final_score", "impact_score"), t["cluster_topics"], t["topics"], 1)


@query("""
    WITH e AS (SELECT event_id, event_type AS topic, user_id % 3 AS age, round(value / 1000, 6) AS score, ts FROM events), h AS (SELECT * FROM e WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-01-20'),
    b1 AS (SELECT topic, age, count(*) AS n, quantile_cont(score, 0.99) AS q FROM h GROUP BY topic, age), b2 AS (SELECT age, count(*) AS n, quantile_cont(score, 0.99) AS q FROM h GROUP BY age), b3 AS (SELECT count(*) AS n, quantile_cont(score, 0.99) AS q FROM h)
    SELECT event_id, CASE WHEN b1.n >= 20 THEN 'topic_age' WHEN b2.n >= 20 THEN 'age_global' WHEN b3.n > 0 THEN 'global' ELSE 'default' END AS bucket, round(CASE WHEN b1.n >= 20 THEN b1.q WHEN b2.n >= 20 THEN b2.q WHEN b3.n > 0 THEN b3.q ELSE 0.95 END, 6) AS threshold
    FROM e LEFT JOIN b1 ON b1.topic = e.topic AND b1.age = e.age LEFT JOIN b2 ON b2.age = e.age, b3""")
def impact_thresholds_looked_back(t: Relations) -> DataFrame:
    rows = t["events"].select("event_id", F.col("event_type").alias("topic"), (F.col("user_id") % 3).alias("age"), F.round(F.col("value") / 1000, 6).alias("score"), F.col("ts").cast("timestamp").alias("ts"))
    recent = impact.looked_back(rows, "ts", F.lit("2024-01-20").cast("timestamp"), 7)
    return impact.thresholds(rows, "score", "topic", "age", 20, history=recent).select("event_id", "bucket", F.round("threshold", 6).alias("threshold"))


@query("""
    WITH c AS (SELECT method, concat('/v1/', event_type) AS endpoint, status, count(*) AS n FROM (SELECT event_type, CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'PUT' END AS method, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status FROM events) e GROUP BY ALL),
    h AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'PUT' END AS method, concat('/v1/', event_type) AS endpoint, value / 50 AS s, row_number() OVER (PARTITION BY user_id % 2, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    r AS (SELECT method, endpoint, s FROM h WHERE rn <= 1000), b AS (SELECT unnest([0.5, 2.5]) AS le)
    SELECT 'http_requests_total' AS metric, concat('app_http_requests_total{method="', method, '",endpoint="', endpoint, '",status="', status, '"} ', n) AS line FROM c
    UNION ALL SELECT 'http_request_duration_seconds', concat('app_http_request_duration_seconds_bucket{method="', method, '",endpoint="', endpoint, '",le="', le, '"} ', count(*) FILTER (WHERE s <= le)) FROM r, b GROUP BY method, endpoint, le
    UNION ALL SELECT 'http_request_duration_seconds', concat('app_http_request_duration_seconds_bucket{method="', method, '",endpoint="', endpoint, '",le="+Inf"} ', count(*)) FROM r GROUP BY method, endpoint
    UNION ALL SELECT 'http_request_duration_seconds', concat('app_http_request_duration_seconds_count{method="', method, '",endpoint="', endpoint, '"} ', count(*)) FROM r GROUP BY method, endpoint
    UNION ALL SELECT 'http_requests_total', '# TYPE app_http_requests_total counter' UNION ALL SELECT 'http_request_duration_seconds', '# TYPE app_http_request_duration_seconds histogram'""")
def metric_lines(t: Relations) -> DataFrame:
    """The sums are left out, whose last digit depends on the order of adding."""
    e = t["events"].select("event_id", "ts", F.when(F.col("user_id") % 2 == 0, "GET").otherwise("PUT").alias("method"), F.concat(F.lit("/v1/"), "event_type").alias("endpoint"), F.when(F.col("event_type") == "error", "500").otherwise("200").alias("status"), (F.col("value") / 50).alias("seconds"))
    counts = e.groupBy("method", "endpoint", "status").agg(F.count("*").alias("n"))
    out = ops.metric_lines(counts, ops.latency_histogram(e, ["method", "endpoint"], F.col("seconds"), (0.5, 2.5)), "app")
    return out.where("NOT contains(line, 'seconds_sum')")
