"""Queries that change tables, notify, and watch operations."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import times
from tessera.operators import governance, graph, merge, notify, ops, topics
from tessera.operators.clustering import kept
from tessera.plans.catalog import query
from tessera.plans.cluster_queries import now
from tessera.sources import folders
from tessera.sources.tables import Relations
from tessera.streaming.bucketed import BucketedTable, append_by_day, drop_days


def stamp() -> Column:
    return F.lit("2024-01-31 00:00:00").cast("timestamp")



UPSERTED = """
    WITH a AS (SELECT id, source_id, title, content_type, published_at, fetched_at, arxiv_id, image_url FROM items WHERE source_id % 2 = 0),
    b AS (SELECT id, source_id, title || ' (rev)' AS title, content_type, published_at, fetched_at, CAST(NULL AS varchar) AS arxiv_id, coalesce(image_url, 'https://img.example/none.png') AS image_url FROM items WHERE source_id % 3 = 0)
    SELECT coalesce(a.id, b.id) AS id, coalesce(b.title, a.title) AS title, coalesce(a.published_at, b.published_at) AS published_at, coalesce(a.arxiv_id, b.arxiv_id) AS arxiv_id, coalesce(a.image_url, b.image_url) AS image_url
    FROM a FULL JOIN b ON a.id = b.id"""


def stored_and_batch(t: Relations) -> tuple[DataFrame, DataFrame]:
    stored = t["items"].where("source_id % 2 = 0")
    batch = t["items"].where("source_id % 3 = 0").withColumns({"title": F.concat("title", F.lit(" (rev)")), "arxiv_id": F.lit(None).cast("string"), "image_url": F.coalesce("image_url", F.lit("https://img.example/none.png"))})
    return stored, batch


@query(UPSERTED)
def items_upsert(t: Relations) -> DataFrame:
    return merge.upsert_items(*stored_and_batch(t)).select("id", "title", "published_at", "arxiv_id", "image_url")


@query(UPSERTED)
def items_upserted_in_buckets(t: Relations) -> DataFrame:
    """The same over a table in key buckets; the first batch comes once more after the second and changes nothing."""
    stored, batch = stored_and_batch(t)
    where = folders.shared(t.spark, f"items-{uuid.uuid4().hex}")
    table = BucketedTable(t.spark, where, stored.schema, ["id"], merge.item_policy(stored.columns), [F.col(c).desc() for c in merge.ITEM_ORDER], buckets=16)
    for number, rows in ((0, stored), (1, batch), (0, stored)):
        table.upsert(rows, "feeds", number)
    found = kept(table.read().select("id", "title", "published_at", "arxiv_id", "image_url"))
    folders.remove(t.spark, where)
    return found


@query("SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE CAST(ts AS date) >= DATE '2024-01-17' GROUP BY event_type")
def events_kept_by_day(t: Relations) -> DataFrame:
    """A log in partitions of days, from which whole days are dropped."""
    where = folders.shared(t.spark, f"events-{uuid.uuid4().hex}")
    append_by_day(t["events"], where, "ts")
    drop_days(t.spark, where, "2024-01-17")
    found = kept(t.spark.read.parquet(where).groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")))
    folders.remove(t.spark, where)
    return found


@query("SELECT s.id, CASE WHEN s.id % 2 = 0 THEN s.name || ' Inc' ELSE s.name END AS name, CASE WHEN s.id % 2 = 0 THEN 'tier1' ELSE s.reliability_tier END AS reliability_tier, s.active FROM sources s UNION ALL SELECT 1000, 'new Inc', 'tier1', true")
def source_pack_upsert(t: Relations) -> DataFrame:
    pack = t["sources"].where("id % 2 = 0").select("id", F.concat("name", F.lit(" Inc")).alias("name"), F.lit("tier1").alias("reliability_tier"), F.lit(None).cast("boolean").alias("active"))
    pack = pack.union(t.spark.createDataFrame([(1000, "new Inc", "tier1", True)], pack.schema))
    return merge.merge(t["sources"].select("id", "name", "reliability_tier", "active"), pack, ["id"], {"active": "overwrite_if_given"})


@query("SELECT id AS key, id % 4 = 0 AS enabled, CASE WHEN id % 2 = 0 THEN 'v2' ELSE 'v1' END AS config FROM sources")
def flag_upsert(t: Relations) -> DataFrame:
    flags = t["sources"].select(F.col("id").alias("key"), (F.col("id") % 4 == 0).alias("enabled"), F.lit("v1").alias("config"))
    given = t["sources"].where("id % 2 = 0").select(F.col("id").alias("key"), F.lit(None).cast("boolean").alias("enabled"), F.lit("v2").alias("config"))
    return merge.merge(flags, given, ["key"], {"enabled": "overwrite_if_given", "config": "overwrite_if_given"})


@query("SELECT user_id, cluster_id, created_at FROM saves UNION ALL SELECT user_id, cluster_id, created_at FROM watches w WHERE NOT EXISTS (SELECT 1 FROM saves s WHERE s.user_id = w.user_id AND s.cluster_id = w.cluster_id)")
def insert_if_absent(t: Relations) -> DataFrame:
    return merge.insert_if_absent(t["saves"], t["watches"], ["user_id", "cluster_id"])


@query("SELECT user_id, cluster_id FROM watches w WHERE NOT EXISTS (SELECT 1 FROM hides h WHERE h.user_id = w.user_id AND h.cluster_id = w.cluster_id)")
def delete_by_key(t: Relations) -> DataFrame:
    return merge.delete(t["watches"], t["hides"], ["user_id", "cluster_id"]).select("user_id", "cluster_id")


@query("""
    WITH cur AS (SELECT cluster_id, topic_id, max(score) AS score, bool_or(locked) AS locked FROM cluster_topics GROUP BY ALL),
    want AS (SELECT DISTINCT cluster_id, 100 + (topic_id + 1) % 25 AS topic_id, 0.9E0 AS score FROM cur WHERE cluster_id % 3 = 0)
    SELECT cluster_id, topic_id, score, locked FROM cur WHERE locked
    UNION ALL SELECT cluster_id, topic_id, score, locked FROM cur WHERE NOT locked AND cluster_id % 3 <> 0
    UNION ALL SELECT cluster_id, topic_id, score, false FROM want w WHERE NOT EXISTS (SELECT 1 FROM cur c WHERE c.locked AND c.cluster_id = w.cluster_id AND c.topic_id = w.topic_id)""".replace("GROUP BY ALL", "GROUP BY cluster_id, topic_id"))
def assignment_replace(t: Relations) -> DataFrame:
    current = t["cluster_topics"].groupBy("cluster_id", "topic_id").agg(F.max("score").alias("score"), F.max("locked").alias("locked"))
    wanted = current.where("cluster_id % 3 = 0").select("cluster_id", (100 + (F.col("topic_id") + 1) % 25).alias("topic_id"), F.lit(0.9).alias("score")).distinct()
    return topics.replace_assignments(current, wanted)


@query("""
    WITH mv AS (SELECT DISTINCT coalesce(r.to_id, m.cluster_id) AS cluster_id, item_id, source_id FROM members m LEFT JOIN redirects r ON r.from_id = m.cluster_id)
    SELECT c.id, CASE WHEN r.from_id IS NOT NULL THEN 'merged' ELSE c.status END AS status, count(item_id) AS item_count, count(DISTINCT source_id) AS distinct_source_count
    FROM clusters c LEFT JOIN redirects r ON r.from_id = c.id LEFT JOIN mv ON mv.cluster_id = c.id GROUP BY c.id, r.from_id, c.status""")
def merge_cluster(t: Relations) -> DataFrame:
    out = governance.merge_clusters(t["clusters"], t["members"].distinct(), t["cluster_topics"], t["redirects"].limit(0), t["redirects"], now())
    return out["clusters"].select("id", "status", "item_count", "distinct_source_count")


@query("""SELECT CASE WHEN role = 'primary' THEN 999999 ELSE 5979 END AS cluster_id, count(*) AS item_count, count(DISTINCT source_id) AS distinct_source_count FROM members WHERE cluster_id = 5979 GROUP BY 1""")
def split_cluster(t: Relations) -> DataFrame:
    return governance.split_cluster(t["clusters"], t["members"], 5979, 999999, F.col("role") == "primary", now())["counts"].withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query("""SELECT cluster_id, topic_id FROM cluster_topics UNION SELECT cluster_id, 104 FROM cluster_topics WHERE topic_id = 103""")
def merge_topic(t: Relations) -> DataFrame:
    return governance.merge_topics(t["cluster_topics"].dropDuplicates(["cluster_id", "topic_id"]), t["redirects"], 103, 104)["cluster_topics"].select("cluster_id", "topic_id")


EDGES = "SELECT s_nationkey AS from_id, CAST((s_suppkey % 25) AS int) AS to_id, CASE WHEN s_suppkey % 2 = 0 THEN 'builds_on' ELSE 'contradicts' END AS relation FROM supplier"


@query(f"""WITH e AS ({EDGES}) SELECT DISTINCT CASE WHEN from_id = 3 THEN 4 ELSE from_id END AS from_id, CASE WHEN to_id = 3 THEN 4 ELSE to_id END AS to_id, relation FROM e
    WHERE (CASE WHEN from_id = 3 THEN 4 ELSE from_id END) <> (CASE WHEN to_id = 3 THEN 4 ELSE to_id END)""")
def merge_entity(t: Relations) -> DataFrame:
    links = t["supplier"].select(F.col("s_suppkey").alias("owner"), F.col("s_nationkey").alias("entity_id"))
    return governance.merge_entities(links, edges_of(t), 3, 4)["edges"]


def edges_of(t: Relations) -> DataFrame:
    return t.spark.sql(EDGES.replace("FROM supplier", "FROM {supplier}"), supplier=t["supplier"])


@query("""SELECT c.id, CASE WHEN status = 'pending' AND takeaway IS NOT NULL AND summary_intuition IS NOT NULL AND EXISTS (SELECT 1 FROM cluster_topics ct WHERE ct.cluster_id = c.id) THEN 'active' ELSE status END AS status FROM clusters c""")
def promote_pending(t: Relations) -> DataFrame:
    return governance.promote_pending(t["clusters"], t["cluster_topics"]).select("id", "status")


@query("""
    SELECT id, CASE WHEN n IS NULL THEN 'no_items' ELSE 'insufficient_content' END AS reason FROM clusters c LEFT JOIN (SELECT cluster_id, count(*) AS n FROM members GROUP BY cluster_id) m ON m.cluster_id = c.id
    WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM cluster_topics ct WHERE ct.cluster_id = c.id AND ct.locked) AND (n IS NULL OR length(trim(canonical_title)) < 20)""")
def quarantine_untaggable(t: Relations) -> DataFrame:
    texts = t["clusters"].select(F.col("id").alias("cluster_id"), F.col("canonical_title").alias("search_text"))
    return governance.untaggable(t["clusters"], t["members"], texts, t["cluster_topics"].where("locked"), least=20)


@query(f"""WITH e AS ({EDGES}), n AS (SELECT n_nationkey AS id, [n_regionkey, n_nationkey % 3] AS topic_ids FROM nation), o AS (SELECT id FROM n WHERE list_contains(topic_ids, 1) ORDER BY id LIMIT 200)
    SELECT from_id, to_id, relation FROM e WHERE from_id IN (SELECT id FROM o) AND to_id IN (SELECT id FROM o) ORDER BY from_id, to_id LIMIT 500""")
def lineage_graph(t: Relations) -> DataFrame:
    nodes = t["nation"].select(F.col("n_nationkey").alias("id"), F.array("n_regionkey", F.col("n_nationkey") % 3).alias("topic_ids"))
    return graph.lineage(nodes, edges_of(t), 1)["edges"]


@query(f"WITH e AS ({EDGES}) SELECT from_id AS node, to_id AS neighbour FROM e UNION SELECT to_id, from_id FROM e")
def entity_neighbours(t: Relations) -> DataFrame:
    return graph.neighbours(edges_of(t))


@query("SELECT c_custkey AS id, c_name AS name FROM customer c WHERE c_name ILIKE '%00012%' OR c_mktsegment ILIKE '%00012%' ORDER BY name, id LIMIT 20")
def entity_search(t: Relations) -> DataFrame:
    entities = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    aliases = t["customer"].select(F.col("c_custkey").alias("entity_id"), F.col("c_mktsegment").alias("alias"))
    return graph.find_entities(entities, aliases, "00012")


ZONED = "z AS (SELECT event_id, ts, zone, quiet_start, quiet_end, (ts AT TIME ZONE 'UTC') AT TIME ZONE zone AS lo FROM events JOIN preferences USING (user_id))"
QUIET = "CASE WHEN quiet_start = quiet_end THEN false WHEN quiet_start < quiet_end THEN m >= quiet_start AND m < quiet_end ELSE m >= quiet_start OR m < quiet_end END"


@query(f"""WITH {ZONED}, y AS (SELECT *, hour(lo) * 60 + minute(lo) AS m FROM z)
    SELECT event_id, {QUIET} AS quiet, CASE WHEN {QUIET} THEN ((date_trunc('day', lo) + CASE WHEN quiet_start > quiet_end AND m >= quiet_start THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END + to_minutes(quiet_end)) AT TIME ZONE zone) AT TIME ZONE 'UTC' ELSE ts END AS scheduled_for FROM y""")
def quiet_hours(t: Relations) -> DataFrame:
    rows = t["events"].join(t["preferences"], "user_id")
    ts, z, a, b = F.col("ts"), F.col("zone"), F.col("quiet_start"), F.col("quiet_end")
    return rows.select("event_id", times.in_quiet_hours(times.local(ts, z), a, b).alias("quiet"), times.schedule(ts, z, a, b).cast("timestamp_ntz").alias("scheduled_for"))


@query(f"""WITH {ZONED}, y AS (SELECT event_id, zone, event_id % 2 = 0 AS weekly, lo, lo - INTERVAL 8 HOUR AS sh FROM z),
    d AS (SELECT *, CASE WHEN weekly THEN date_trunc('week', sh) WHEN hour(lo) >= 8 THEN date_trunc('day', lo) END AS day FROM y)
    SELECT event_id, CASE WHEN weekly THEN strftime(day, '%G-W%V') ELSE strftime(day, '%Y-%m-%d') END AS key, ((CASE WHEN weekly THEN day + INTERVAL 8 HOUR - INTERVAL 7 DAY ELSE day + INTERVAL 8 HOUR - INTERVAL 1 DAY END) AT TIME ZONE zone) AT TIME ZONE 'UTC' AS period_begin FROM d""")
def digest_period(t: Relations) -> DataFrame:
    rows = t["events"].join(t["preferences"], "user_id")
    key, begin, _ = times.digest_period(F.col("ts"), F.col("zone"), F.when(F.col("event_id") % 2 == 0, "weekly").otherwise("daily"))
    return rows.select("event_id", key.alias("key"), begin.cast("timestamp_ntz").alias("period_begin"))


@query("""
    SELECT concat_ws(':', 'update', user_id, cluster_id, seq) AS dedupe_key, user_id, cluster_id, seq FROM (
        SELECT w.user_id, l.cluster_id, l.seq, daily_limit, row_number() OVER (PARTITION BY w.user_id ORDER BY l.cluster_id, l.seq) AS n
        FROM update_log l JOIN watches w ON w.cluster_id = l.cluster_id JOIN preferences p ON p.user_id = w.user_id WHERE enabled) WHERE n <= daily_limit""")
def notification_jobs(t: Relations) -> DataFrame:
    return notify.cluster_update_jobs(t["update_log"], t["watches"], t["preferences"], stamp()).select("dedupe_key", "user_id", "cluster_id", "seq")


@query("""
    SELECT user_id, count(*) AS n, string_agg(cluster_id, ',' ORDER BY rn) AS cluster_ids FROM (
        SELECT user_id, cluster_id, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, cluster_id) AS rn FROM (
            SELECT DISTINCT f.user_id, c.id AS cluster_id, c.updated_at FROM follows f JOIN cluster_topics ct ON ct.topic_id = f.topic_id JOIN clusters c ON c.id = ct.cluster_id
            WHERE status = 'active' AND updated_at >= TIMEstamp() '2000-01-01' AND updated_at < TIMEstamp() '2001-01-01')) WHERE rn <= 50 GROUP BY user_id""")
def topic_digests(t: Relations) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp")
    out = notify.topic_digests(t["follows"], t["cluster_topics"], t["clusters"], at("2000-01-01"), at("2001-01-01"))
    return out.select("user_id", "n", F.concat_ws(",", F.transform("cluster_ids", lambda x: x.cast("string"))).alias("cluster_ids"))


@query("""SELECT event_type, count(*) FILTER (WHERE ts < TIMEstamp() '2024-01-31' - INTERVAL 14 DAY) AS gone, count(*) FILTER (WHERE ts >= TIMEstamp() '2024-01-31' - INTERVAL 14 DAY) AS kept FROM events GROUP BY event_type""")
def retention_purge(t: Relations) -> DataFrame:
    return ops.purge_counts(t["events"], stamp(), 14, "event_type")


@query("""SELECT user_id, CAST(floor(epoch(ts) / 3600) * 3600 AS bigint) AS window_start, count(*) AS n, count(*) > 1 AS over FROM events GROUP BY 1, 2""")
def rate_limit_windows(t: Relations) -> DataFrame:
    return ops.rate_limits(t["events"], "user_id", 3600, 1)


LE = ", ".join(str(b) for b in ops.BUCKETS)


@query(f"""
    WITH r AS (SELECT method, seconds FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY ts DESC, event_id DESC) AS rn FROM requests) WHERE rn <= 1000), b AS (SELECT CAST(unnest([{LE}]) AS double) AS le)
    SELECT method, le, count(*) FILTER (WHERE seconds <= le) AS n, round(sum(seconds), 4) AS total, count(*) AS samples FROM r, b GROUP BY method, le""")
def latency_histogram(t: Relations) -> DataFrame:
    return ops.latency_histogram(t["requests"], ["method"], F.col("seconds")).withColumn("total", F.round("total", 4))


@query("""SELECT regexp_replace(path, '/[0-9]+$', '/{id}') AS endpoint, method, status, count(*) AS n FROM requests GROUP BY 1, 2, 3""")
def request_counts(t: Relations) -> DataFrame:
    return ops.request_counts(t["requests"], F.col("path"), F.col("method"), F.col("status"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS int)) AS bigint) AS k FROM events GROUP BY event_type")
def json_debug_extract(t: Relations) -> DataFrame:
    return t["events"].groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"))


