"""Queries about editors' work, logs, seeds, people's pages and notifications."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text, times
from tessera.operators import clustering, editorial, merge, notify, tagging, worklists
from tessera.plans.catalog import query
from tessera.sources.tables import Relations

NOW = "2024-02-01 12:00:00"
ASSIGNED = "SELECT cluster_id, topic_id, min(score) AS score, CASE WHEN topic_id % 3 = 0 THEN 'auto' WHEN topic_id % 3 = 1 THEN 'auto_llm' ELSE 'editor' END AS source, max(CAST(locked AS int)) = 1 AS locked FROM cluster_topics GROUP BY cluster_id, topic_id"
WANTED = "SELECT o_orderkey AS cluster_id, 100 + o_custkey % 25 AS topic_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 10) / 10.0E0 END AS score, CASE WHEN o_orderkey % 4 = 0 THEN false END AS locked FROM orders WHERE o_orderkey % 5 = 0"


def now():
    return F.lit(NOW).cast("timestamp")


def of(t: Relations, sql: str) -> DataFrame:
    names = ("cluster_topics", "orders", "clusters", "members", "customer", "documents", "events", "lineitem")
    used = {n: t[n] for n in names if f" {n}" in sql}
    for n in used:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return t.spark.sql(sql, **used)


def editor_oracle(replace: bool) -> str:
    gone = "WHERE cluster_id NOT IN (SELECT cluster_id FROM w)" if replace else ""
    return f"""
    WITH a AS ({ASSIGNED}), w AS ({WANTED}), b AS (SELECT * FROM a {gone})
    SELECT coalesce(b.cluster_id, w.cluster_id) AS cluster_id, coalesce(b.topic_id, w.topic_id) AS topic_id, CASE WHEN w.cluster_id IS NOT NULL THEN coalesce(w.score, 1) ELSE b.score END AS score,
           CASE WHEN w.cluster_id IS NOT NULL THEN 'editor' ELSE b.source END AS source, CASE WHEN w.cluster_id IS NOT NULL THEN coalesce(w.locked, true) ELSE b.locked END AS locked
    FROM b FULL JOIN w ON b.cluster_id = w.cluster_id AND b.topic_id = w.topic_id"""


@query(editor_oracle(False))
def editor_topics(t: Relations) -> DataFrame:
    return editorial.set_by_editor(of(t, ASSIGNED), of(t, WANTED), "topic_id")


@query(editor_oracle(True))
def editor_topics_replaced(t: Relations) -> DataFrame:
    return editorial.set_by_editor(of(t, ASSIGNED), of(t, WANTED), "topic_id", replace=True)


@query(f"SELECT cluster_id, topic_id AS entity_id, score, source, locked FROM ({editor_oracle(True)}) o")
def editor_entities(t: Relations) -> DataFrame:
    named = lambda df: df.withColumnRenamed("topic_id", "entity_id")
    return editorial.set_by_editor(named(of(t, ASSIGNED)), named(of(t, WANTED)), "entity_id", replace=True)


def assign_oracle(owned: str) -> str:
    return f"""
    WITH a AS ({ASSIGNED}), w AS ({WANTED}), s AS (SELECT DISTINCT cluster_id FROM w),
    j AS (SELECT coalesce(a.cluster_id, w.cluster_id) AS cluster_id, coalesce(a.topic_id, w.topic_id) AS topic_id, a.score, a.source, a.locked, w.score AS fresh, w.cluster_id IS NOT NULL AS asked, a.cluster_id IS NOT NULL AS there FROM a FULL JOIN w ON a.cluster_id = w.cluster_id AND a.topic_id = w.topic_id),
    k AS (SELECT *, cluster_id IN (SELECT cluster_id FROM s) AND there AND NOT locked AND NOT asked AND {owned} AS gone, asked AND NOT coalesce(locked, false) AS taken FROM j)"""


@query(assign_oracle("source = 'auto_llm'") + "SELECT cluster_id, topic_id, CASE WHEN taken THEN fresh ELSE score END AS score, CASE WHEN taken THEN 'auto_llm' ELSE source END AS source, coalesce(locked, false) AS locked FROM k WHERE NOT gone")
def topics_assigned(t: Relations) -> DataFrame:
    return editorial.assign(of(t, ASSIGNED), of(t, WANTED), of(t, WANTED), "auto_llm")["cluster_topics"]


@query(assign_oracle("true") + "SELECT c.id, CASE WHEN c.id IN (SELECT cluster_id FROM k WHERE gone OR taken) THEN DATE '2024-02-01' ELSE CAST(updated_at AS date) END AS updated FROM clusters c")
def topics_assigned_touch(t: Relations) -> DataFrame:
    """With replace_all, the clusters that change are touched."""
    changed = editorial.assign(of(t, ASSIGNED), of(t, WANTED), of(t, WANTED), "auto_llm", replace_all=True)["changed"]
    return editorial.touched(t["clusters"], changed, now()).select("id", F.to_date("updated_at").alias("updated"))


@query(f"SELECT * FROM ({ASSIGNED}) a WHERE locked OR source <> 'auto'")
def automatic_topics_cleared(t: Relations) -> DataFrame:
    return editorial.without_automatic(of(t, ASSIGNED))


PAIRS = "SELECT o_orderkey AS from_id, o_orderkey - 1 AS to_id FROM orders WHERE o_orderkey % 40 = 7"


@query(f"""WITH p AS ({PAIRS}) SELECT 'log' AS kind, to_id AS cluster_id, 'merge' AS what, concat('Merged cluster ', from_id, ' into this story.') AS said, concat('{{"from_cluster_id":"', from_id, '"}}') AS more FROM p
    UNION ALL SELECT 'action', to_id, 'merge_cluster', NULL, concat('{{"from_cluster_id":"', from_id, '"}}') FROM p""")
def merge_logs(t: Relations) -> DataFrame:
    out = editorial.merge_clusters(t["clusters"], t["members"], t["cluster_topics"], t["redirects"], of(t, PAIRS), now())
    log = out["log"].select(F.lit("log").alias("kind"), "cluster_id", F.col("change_type").alias("what"), F.col("summary").alias("said"), F.col("diff").alias("more"))
    return log.union(out["actions"].select(F.lit("action"), F.col("target_id").cast("long"), "action_type", "notes", "payload"))


@query("""WITH m AS (SELECT count(*) AS n FROM members WHERE cluster_id = 3 AND role = 'primary')
    SELECT 3 AS cluster_id, concat('Split out ', n, ' items into a new story.') AS said, 'active' AS status, 'Split cluster' AS title FROM m UNION ALL SELECT 999999999, 'Created from a split of 3.', 'active', 'Split cluster' FROM m""")
def split_logs(t: Relations) -> DataFrame:
    out = editorial.split_cluster(t["clusters"], t["members"], 3, 999999999, F.col("role") == "primary", now())
    new = out["clusters"].where("id = 999999999").select("status", F.col("canonical_title").alias("title"))
    return out["log"].select("cluster_id", F.col("summary").alias("said")).crossJoin(F.broadcast(new))


@query("""SELECT id, CASE WHEN id % 50 = 3 THEN 'quarantined' ELSE status END AS status, CASE WHEN id % 50 = 3 THEN 'spam' END AS said FROM clusters""")
def clusters_quarantined(t: Relations) -> DataFrame:
    ids = t["clusters"].where("id % 50 = 3").select(F.col("id").alias("cluster_id"))
    out = editorial.set_status(t["clusters"], ids, "quarantined", "quarantine", now(), "spam")
    return out["clusters"].join(out["log"].select(F.col("cluster_id").alias("id"), F.col("summary").alias("said")), "id", "left").select("id", "status", "said")


@query("""WITH f AS (SELECT DISTINCT user_id, event_id % 40 AS entity_id FROM events), o AS (SELECT DISTINCT user_id, CASE WHEN entity_id = 7 THEN 9 ELSE entity_id END AS entity_id FROM f)
    SELECT 'follow' AS kind, user_id AS a, entity_id AS b FROM o
    UNION ALL SELECT 'edge', CASE WHEN a = 7 THEN 9 ELSE a END, CASE WHEN b = 7 THEN 9 ELSE b END FROM (SELECT c_custkey % 40 AS a, c_nationkey AS b FROM customer) e
    UNION ALL SELECT 'redirect', from_id, to_id FROM redirects WHERE from_id <> 7 UNION ALL SELECT 'redirect', 7, 9""")
def entity_merged(t: Relations) -> DataFrame:
    follows = t["events"].select("user_id", (F.col("event_id") % 40).alias("entity_id")).distinct()
    edges = t["customer"].select((F.col("c_custkey") % 40).alias("from_id"), F.col("c_nationkey").alias("to_id"))
    links = follows.withColumnRenamed("user_id", "cluster_id")
    aliases = t["customer"].select(F.col("c_name").alias("alias"), (F.col("c_custkey") % 40).alias("entity_id"))
    out = editorial.merge_entity(follows, links, aliases, edges, t["redirects"], 7, 9)
    rows = out["follows"].select(F.lit("follow").alias("kind"), F.col("user_id").alias("a"), F.col("entity_id").alias("b"))
    return rows.union(out["edges"].select(F.lit("edge"), "from_id", "to_id")).union(out["redirects"].select(F.lit("redirect"), "from_id", "to_id"))


@query("""
    WITH u AS (SELECT id, updated_at, CASE WHEN n IS NULL THEN 'no_items' ELSE 'insufficient_content' END AS reason FROM clusters c LEFT JOIN (SELECT cluster_id, count(*) AS n FROM members GROUP BY cluster_id) m ON m.cluster_id = c.id
        WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM cluster_topics ct WHERE ct.cluster_id = c.id AND ct.locked) AND (n IS NULL OR length(trim(canonical_title)) < 20)),
    f AS (SELECT * FROM u ORDER BY updated_at DESC, id LIMIT 300)
    SELECT c.id, CASE WHEN f.id IS NOT NULL THEN 'quarantined' ELSE c.status END AS status, f.reason FROM clusters c LEFT JOIN f ON f.id = c.id""")
def untaggable_quarantined(t: Relations) -> DataFrame:
    texts = t["clusters"].select(F.col("id").alias("cluster_id"), F.col("canonical_title").alias("search_text"))
    out = editorial.quarantine_untaggable(t["clusters"], t["members"], texts, t["cluster_topics"].where("locked"), now(), least=20, most=300)
    return out["clusters"].join(out["reasons"].select(F.col("cluster_id").alias("id"), "reason"), "id", "left").select("id", "status", "reason")


@query("""SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'kept' WHEN doc_id % 4 = 0 THEN concat('2401.', 10000 + doc_id, CASE WHEN strlen(concat('', doc_id)) >= 0 THEN 'v2' END) WHEN doc_id % 4 = 2 THEN concat('hep-th/', substr(CAST(10000000 + doc_id AS string), 2, 7)) END AS arxiv_id FROM notices""")
def item_ids_filled(t: Relations) -> DataFrame:
    own = t["notices"].select("doc_id", "text", F.when(F.col("doc_id") % 8 == 0, "kept").alias("arxiv_id"), F.lit(None).cast("string").alias("doi"))
    return editorial.with_ids(own, F.col("text"), F.lit("https://site.example/")).select("doc_id", "arxiv_id")


@query("""SELECT c.id AS cluster_id, CASE WHEN c.id % 2 = 0 THEN concat('new ', canonical_title) ELSE 'old' END AS search_text, CASE WHEN c.id % 2 = 0 THEN DATE '2024-02-01' ELSE DATE '2020-01-01' END AS updated FROM clusters c WHERE c.id % 2 = 0 OR c.id % 3 = 0""")
def search_docs_upserted(t: Relations) -> DataFrame:
    ids = t["clusters"].select(F.col("id").alias("cluster_id"), F.concat(F.lit("new "), "canonical_title").alias("search_text"))
    stored = ids.where("cluster_id % 3 = 0").select("cluster_id", F.lit("old").alias("search_text"), F.lit("2020-01-01").cast("timestamp").alias("updated_at"))
    return editorial.upsert_search_docs(stored, ids.where("cluster_id % 2 = 0"), now()).select("cluster_id", "search_text", F.to_date("updated_at").alias("updated"))


@query("""SELECT m.cluster_id, concat('New evidence added: ', i.title) AS said, m.item_id AS supporting FROM members m JOIN items i ON i.id = m.item_id WHERE i.content_type IN ('peer_reviewed', 'preprint', 'report')""")
def evidence_log(t: Relations) -> DataFrame:
    added = t["members"].select("cluster_id", "item_id", "source_id").join(t["items"].select(F.col("id").alias("item_id"), "title", "content_type"), "item_id")
    return editorial.evidence_log(added).select("cluster_id", F.col("summary").alias("said"), F.element_at("supporting", 1).alias("supporting"))


@query("""SELECT c_custkey % 40 AS from_id, c_nationkey AS to_id, CASE WHEN c_custkey % 2 = 0 THEN 'extends' ELSE 'cites' END AS relation FROM customer""")
def lineage_edges_added(t: Relations) -> DataFrame:
    rows = t["customer"].select((F.col("c_custkey") % 40).alias("from_id"), F.col("c_nationkey").alias("to_id"), F.when(F.col("c_custkey") % 2 == 0, "extends").otherwise("cites").alias("relation"), F.array(F.col("c_custkey").cast("string")).alias("evidence"), "c_custkey")
    return editorial.add_lineage_edges(rows.where("c_custkey % 3 = 0").drop("c_custkey"), rows.where("c_custkey % 3 <> 0").drop("c_custkey"))["edges"].select("from_id", "to_id", "relation")


@query("""WITH h AS (SELECT event_id AS id, ts FROM events WHERE event_type = 'click' AND user_id % 5 = 2) SELECT id, (SELECT count(*) FROM h) AS total FROM h ORDER BY ts DESC, id LIMIT 15 OFFSET 10""")
def audit_page(t: Relations) -> DataFrame:
    log = t["events"].select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("action_type"), (F.col("user_id") % 5).cast("string").alias("target_id"))
    return editorial.audit_page(log, action_type="click", target="2", size=15, offset=10).select("id", "total")


@query("SELECT event_id AS id FROM events WHERE event_type = 'error' ORDER BY ts DESC, id LIMIT 20 OFFSET 20")
def feedback_page(t: Relations) -> DataFrame:
    reports = t["events"].select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("event_type").alias("status"))
    return editorial.feedback_page(reports, "error", 20, 2).select("id")


SEED = {
    "categories": [{"name": " Natural  Science ", "description_short": "of nature", "aliases": ["sci ", " "]}, {"name": "EUROPE"}, {"name": " "}],
    "subtopics": [{"name": "Optics", "category": "Natural Science", "aliases": [" light  waves"]}, {"name": "NATION_3", "category": "EUROPE"}, {"name": "Lost", "category": "Unknown"}, {"name": "", "category": "EUROPE"}],
}


@query("""
    WITH b AS (SELECT t.name, 'old' AS description, '' AS aliases, p.name AS parent FROM topics t LEFT JOIN topics p ON p.id = t.parent_id),
    s AS (SELECT 'Natural Science' AS name, 'of nature' AS description, 'sci' AS aliases, NULL AS parent UNION ALL SELECT 'EUROPE', NULL, '', NULL UNION ALL SELECT 'Optics', NULL, 'light waves', 'Natural Science' UNION ALL SELECT 'NATION_3', 'old', '', 'EUROPE')
    SELECT * FROM s UNION ALL SELECT * FROM b WHERE name NOT IN (SELECT name FROM s)""")
def topics_seeded(t: Relations) -> DataFrame:
    return seeded(t)["topics"].withColumn("aliases", F.array_join("aliases", "|"))


def seeded(t: Relations) -> dict[str, DataFrame]:
    names = t["topics"].select(F.col("id").alias("__p"), F.col("name").alias("parent"))
    stored = t["topics"].join(names, F.col("parent_id") == F.col("__p"), "left").select("name", F.lit("old").alias("description"), F.array().cast("array<string>").alias("aliases"), "parent")
    categories, subtopics = editorial.seed_rows(F.lit(json.dumps(SEED)))
    rows = lambda c: t.spark.range(1).select(F.inline(c))
    return editorial.seed_topics(stored, rows(categories), rows(subtopics))


@query("SELECT 'category' AS kind, 1 AS inserted, 1 AS updated UNION ALL SELECT 'subtopic', 1, 1")
def topics_seeded_counts(t: Relations) -> DataFrame:
    return seeded(t)["counts"]


@query("""
    WITH p AS (SELECT s_suppkey, s_name AS source, concat('https://feeds.example/', s_name, '/', x.k) AS url, CASE WHEN x.k = 1 THEN 'rss' ELSE 'atom' END AS kind FROM supplier, (SELECT 1 AS k UNION ALL SELECT 2) x WHERE s_suppkey % 3 = 0)
    SELECT source, url, kind FROM p UNION ALL SELECT s_name, concat('https://feeds.example/', s_name, '/2'), 'old' FROM supplier WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT s_name, concat('https://feeds.example/', s_name, '/9'), 'old' FROM supplier""")
def source_pack_feeds(t: Relations) -> DataFrame:
    name = F.col("s_name")
    url = lambda k: F.concat(F.lit("https://feeds.example/"), name, F.lit(f"/{k}"))
    pack = t["supplier"].where("s_suppkey % 3 = 0").select(name.alias("name"), F.lit("h").alias("homepage"), F.lit("blog").alias("source_type"), F.lit(None).cast("boolean").alias("active"), F.array(F.struct(url(1).alias("url"), F.lit(None).cast("string").alias("kind")), F.struct(url(2).alias("url"), F.lit("atom").alias("kind"))).alias("feeds"))
    sources = t["supplier"].select(name.alias("name"), F.lit("old").alias("homepage"), F.lit("lab").alias("source_type"), F.lit(False).alias("active"))
    feeds = t["supplier"].select(name.alias("source"), F.explode(F.array(url(2), url(9))).alias("url"), F.lit("old").alias("kind"))
    return editorial.import_pack(sources, feeds, pack)["feeds"]


@query("""SELECT c.id FROM clusters c LEFT JOIN (SELECT id AS cluster_id, canonical_title AS search_text FROM clusters WHERE id % 3 > 0) d ON d.cluster_id = c.id
    WHERE status IN ('active', 'pending') AND (search_text IS NULL OR length(search_text) < 14) ORDER BY updated_at DESC, c.id LIMIT 400""")
def short_search_texts(t: Relations) -> DataFrame:
    docs = t["clusters"].where("id % 3 > 0").select(F.col("id").alias("cluster_id"), F.col("canonical_title").alias("search_text"))
    return editorial.short_search_texts(t["clusters"], docs, 14, 400)


@query("""SELECT id AS cluster_id FROM clusters c WHERE status IN ('active', 'pending') AND NOT EXISTS (SELECT 1 FROM cluster_topics ct WHERE ct.cluster_id = c.id AND locked) AND length(canonical_title) >= 18 ORDER BY updated_at DESC, id LIMIT 500""")
def taggable_clusters(t: Relations) -> DataFrame:
    docs = t["clusters"].select(F.col("id").alias("cluster_id"), F.col("canonical_title").alias("search_text"))
    return editorial.taggable(t["clusters"], docs, t["cluster_topics"].where("locked"), 18).select("cluster_id")


@query("""SELECT c_custkey AS id, EXISTS (SELECT 1 FROM events e WHERE user_id = 1 AND event_id % 150 = c_custkey) AS is_followed FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_name ILIKE '%1%' OR c_custkey % 7 = 0) ORDER BY c_name, id LIMIT 8 OFFSET 8""")
def entity_page(t: Relations) -> DataFrame:
    entities = t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("entity_type"))
    aliases = entities.select(F.col("id").alias("entity_id"), F.when(F.col("id") % 7 == 0, "unit 1").otherwise("none").alias("alias"))
    follows = t["events"].select("user_id", (F.col("event_id") % 150).alias("entity_id"))
    return editorial.entity_page(entities, aliases, follows, 1, " 1", "BUILDING", 8, 2).select("id", "is_followed")


@query("""SELECT entity_id, cluster_id, rn FROM (SELECT custkey AS entity_id, id AS cluster_id, row_number() OVER (PARTITION BY custkey ORDER BY updated_at DESC, id) AS rn FROM clusters WHERE status = 'active') WHERE rn <= 20""")
def entity_stories(t: Relations) -> DataFrame:
    return editorial.entity_stories(t["clusters"], t["clusters"].select(F.col("custkey").alias("entity_id"), F.col("id").alias("cluster_id")))


@query("""SELECT user_id, c_custkey AS id, c_name AS name, row_number() OVER (PARTITION BY user_id ORDER BY c_name, c_custkey) AS rn FROM (SELECT DISTINCT user_id, event_id % 150 AS e FROM events) f JOIN customer ON c_custkey = e""")
def followed_entities(t: Relations) -> DataFrame:
    follows = t["events"].select("user_id", (F.col("event_id") % 150).alias("entity_id")).distinct()
    return editorial.followed_entities(follows, t["customer"].select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("""SELECT cluster_id, term, rn FROM (SELECT l_orderkey AS cluster_id, concat(p_name, ' ', p_partkey) AS term, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, concat(p_name, ' ', p_partkey), l_linenumber) AS rn FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE rn <= 3""")
def glossary_of_clusters(t: Relations) -> DataFrame:
    links = t["lineitem"].select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("entry_id"), F.col("l_quantity").alias("score"))
    entries = t["part"].select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("term"))
    return editorial.glossary_of(links, entries, 3)


DEFAULTS = {"email": {"enabled": True, "frequency": "daily", "limits": {"per_day": 3}}, "timezone": "UTC"}


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN false ELSE true END AS enabled, CASE event_id % 4 WHEN 1 THEN 'weekly' ELSE 'daily' END AS frequency, CASE event_id % 4 WHEN 2 THEN 7 ELSE 3 END AS per_day, CASE event_id % 4 WHEN 1 THEN 'Asia/Tokyo' ELSE 'UTC' END AS zone FROM events""")
def preferences_merged(t: Relations) -> DataFrame:
    given = ('{"email":{"enabled":false}}', '{"email":{"frequency":"weekly"},"timezone":"Asia/Tokyo"}', '{"email":{"limits":{"per_day":7},"extra":1}}', "{}")
    p = editorial.deep_defaults(F.element_at(F.array(*map(F.lit, given)), (F.col("event_id") % 4 + 1).cast("int")), DEFAULTS)
    return t["events"].select("event_id", p["email"]["enabled"].alias("enabled"), p["email"]["frequency"].alias("frequency"), p["email"]["limits"]["per_day"].alias("per_day"), p["timezone"].alias("zone"))


JOBS = """SELECT concat_ws(':', 'old', cast(event_id AS string)) AS dedupe_key, user_id, event_id % 1500 AS cluster_id, CAST(0 AS bigint) AS seq, ts AS scheduled_for, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'queued' ELSE 'sent' END AS status FROM events"""
LOCAL = "CAST((({} AT TIME ZONE 'UTC') AT TIME ZONE zone) AS date)"


@query(f"""SELECT j.user_id, {LOCAL.format("scheduled_for")} AS day, count(*) AS n FROM ({JOBS}) j JOIN preferences p ON p.user_id = j.user_id WHERE status IN ('queued', 'sending', 'sent') GROUP BY 1, 2""")
def notification_day_counts(t: Relations) -> DataFrame:
    return notify.day_counts(of(t, JOBS).withColumn("scheduled_for", F.col("scheduled_for").cast("timestamp")), t["preferences"])


@query(f"""
    WITH o AS (SELECT * FROM ({JOBS}) j UNION ALL SELECT concat_ws(':', 'update', w.user_id, w.cluster_id, 0), w.user_id, w.cluster_id, 0, TIMESTAMP '2024-01-20 03:00:00', 'sent' FROM watches w WHERE w.user_id % 3 = 0),
    z AS (SELECT p.*, {LOCAL.format("TIMESTAMP '2024-01-20 05:30:00'")} AS today, (TIMESTAMP '2024-01-20 05:30:00' AT TIME ZONE 'UTC') AT TIME ZONE zone AS lo FROM preferences p WHERE enabled),
    y AS (SELECT *, hour(lo) * 60 + minute(lo) AS m FROM z),
    q AS (SELECT *, CASE WHEN quiet_start = quiet_end THEN false WHEN quiet_start < quiet_end THEN m >= quiet_start AND m < quiet_end ELSE m >= quiet_start OR m < quiet_end END AS quiet FROM y),
    d AS (SELECT *, today + CASE WHEN quiet AND quiet_start > quiet_end AND m >= quiet_start THEN 1 ELSE 0 END AS day FROM q),
    had AS (SELECT o.user_id, {LOCAL.format("scheduled_for")} AS day, count(*) AS n FROM o JOIN preferences p ON p.user_id = o.user_id WHERE status IN ('queued', 'sending', 'sent') GROUP BY 1, 2),
    e AS (SELECT concat_ws(':', 'update', d.user_id, l.cluster_id, l.seq) AS dedupe_key, d.user_id, l.cluster_id, l.seq, d.day, daily_limit FROM update_log l JOIN watches w ON w.cluster_id = l.cluster_id JOIN d ON d.user_id = w.user_id),
    f AS (SELECT e.*, coalesce(had.n, 0) AS had, row_number() OVER (PARTITION BY e.user_id, e.day ORDER BY e.cluster_id, e.seq) AS n FROM e LEFT JOIN had ON had.user_id = e.user_id AND had.day = e.day WHERE e.dedupe_key NOT IN (SELECT dedupe_key FROM o))
    SELECT dedupe_key, user_id, cluster_id, seq FROM f WHERE had + n <= daily_limit""")
def notification_jobs_capped(t: Relations) -> DataFrame:
    """Jobs there already take places of their local day, whatever they were about; failed ones don't."""
    old = of(t, JOBS).withColumn("scheduled_for", F.col("scheduled_for").cast("timestamp"))
    sent = t["watches"].where("user_id % 3 = 0").select(
        F.concat_ws(":", F.lit("update"), "user_id", "cluster_id", F.lit("0")).alias("dedupe_key"), "user_id", "cluster_id", F.lit(0).cast("long").alias("seq"), F.lit("2024-01-20 03:00:00").cast("timestamp").alias("scheduled_for"), F.lit("sent").alias("status")
    )
    existing = old.unionByName(sent)
    out = notify.cluster_update_jobs(t["update_log"], t["watches"], t["preferences"], F.lit("2024-01-20 05:30:00").cast("timestamp"), existing)
    return out.join(existing.select("dedupe_key"), "dedupe_key", "left_anti").select("dedupe_key", "user_id", "cluster_id", "seq")


@query(f"""SELECT event_id, (CAST(CAST(ts AS date) AS timestamp) AT TIME ZONE zone) AT TIME ZONE 'UTC' AS begin, (CAST(CAST(ts AS date) + 1 AS timestamp) AT TIME ZONE zone) AT TIME ZONE 'UTC' AS "end" FROM events e JOIN preferences p ON p.user_id = e.user_id""")
def local_day_bounds(t: Relations) -> DataFrame:
    begin, end = notify.day_bounds(F.to_date("ts"), F.col("zone"))
    return t["events"].join(t["preferences"].select("user_id", "zone"), "user_id").select("event_id", begin.cast("timestamp_ntz").alias("begin"), end.cast("timestamp_ntz").alias("end"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 570 WHEN 1 THEN 1439 WHEN 2 THEN 480 WHEN 3 THEN 480 WHEN 4 THEN 480 ELSE 0 END AS m FROM events""")
def clock_minutes(t: Relations) -> DataFrame:
    given = F.element_at(F.array(*[F.lit(x) for x in ("09:30", " 23:59 ", "24:00", "10:61", "noon", "0:00")]), (F.col("event_id") % 6 + 1).cast("int"))
    return t["events"].select("event_id", times.minutes(given, 480).alias("m"))


@query(f"""WITH j AS ({JOBS}), due AS (SELECT dedupe_key FROM j WHERE status = 'queued' AND scheduled_for <= TIMESTAMP '2024-01-15 00:00:00' ORDER BY scheduled_for, dedupe_key LIMIT 40)
    SELECT dedupe_key, CASE WHEN dedupe_key IN (SELECT dedupe_key FROM due) THEN 'sent' ELSE status END AS status FROM j""")
def notifications_sent(t: Relations) -> DataFrame:
    return notify.send_due(of(t, JOBS), F.lit("2024-01-15 00:00:00").cast("timestamp"), 40).select("dedupe_key", "status")


@query("""SELECT id, CASE WHEN id % 9 = 1 THEN NULL ELSE takeaway END AS takeaway, CASE WHEN id % 9 = 1 THEN NULL ELSE summary_intuition END AS summary_intuition, CASE WHEN id % 9 = 1 THEN 'edited' ELSE canonical_title END AS canonical_title FROM clusters""")
def clusters_patched(t: Relations) -> DataFrame:
    """Setting the takeaway to null clears the explanation that rests on it; columns not named stay."""
    out = merge.patch(t["clusters"], F.col("id") % 9 == 1, {"takeaway": None, "canonical_title": "edited"}, {"takeaway": ["summary_intuition"]})
    return out.select("id", "takeaway", "summary_intuition", "canonical_title")


@query("""
    WITH x AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 50 AS string) END AS arxiv_id, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 40 AS string) END AS doi FROM documents),
    m AS (SELECT x.id, arxiv_id, doi, o.id AS cluster_id, updated_at FROM x JOIN clusters o ON o.id = x.id WHERE status IN ('active', 'pending')),
    p AS (SELECT a.id AS item_id, m.cluster_id, updated_at FROM x a JOIN m ON a.arxiv_id = m.arxiv_id UNION SELECT a.id, m.cluster_id, updated_at FROM x a JOIN m ON a.doi = m.doi)
    SELECT item_id, cluster_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY updated_at DESC, cluster_id) AS rn FROM p) WHERE rn <= 10""")
def identifier_candidates(t: Relations) -> DataFrame:
    d = F.col("doc_id")
    items = t["documents"].select(d.alias("id"), F.when(d % 3 == 0, (d % 50).cast("string")).alias("arxiv_id"), F.when(d % 4 == 0, (d % 40).cast("string")).alias("doi"))
    members = items.select(F.col("id").alias("item_id"), F.col("id").alias("cluster_id"))
    return clustering.candidates_by_identifier(items, items, members, t["clusters"])



@query("""
    WITH s AS (SELECT id AS cluster_id, unnest([id % 25, (id + 1) % 25, (id + 2) % 25]) AS n, unnest([0.9E0, 0.8E0, 0.7E0]) AS score FROM clusters),
    k AS (SELECT cluster_id, t.id AS topic_id, score FROM s JOIN topics t ON t.name = concat('NATION_', n))
    SELECT cluster_id, topic_id, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, topic_id) AS rn FROM k) WHERE rn <= 3""")
def topics_by_model(t: Relations) -> DataFrame:
    """The model answers with three subtopics, in lower case and with spaces."""
    n = F.element_at(F.split("search_text", " "), -1).cast("long")
    part = lambda k, s: F.concat(F.lit('{"name":" nation_'), ((n + k) % 25).cast("string"), F.lit(f'","score":{s}}}'))
    answer = F.concat(F.lit('{"topics":['), F.concat_ws(",", part(0, 0.9), part(1, 0.8), part(2, 0.7)), F.lit("]}"))
    texts = t["clusters"].select(F.col("id").alias("cluster_id"), F.col("canonical_title").alias("search_text"))
    return tagging.by_model(texts, t["topics"], lambda prompt: answer)


@query("""
    WITH d AS (SELECT id AS cluster_id, canonical_title FROM clusters), o AS (SELECT c.id FROM clusters c WHERE status IN ('active', 'pending')),
    w AS (SELECT cluster_id, unnest(regexp_split_to_array(lower(canonical_title), '[^a-z0-9]+')) AS word FROM d JOIN o ON o.id = d.cluster_id),
    m AS (SELECT cluster_id, CASE word WHEN 'urgent' THEN 101 WHEN 'low' THEN 102 END AS topic_id, least(1.0, 0.5 + 0.1 * count(*)) AS score FROM w WHERE word IN ('urgent', 'low') GROUP BY ALL),
    k AS (SELECT * FROM ({ASSIGNED}) a WHERE locked OR (source <> 'auto' AND cluster_id NOT IN (SELECT id FROM o)))
    SELECT coalesce(k.cluster_id, m.cluster_id) AS cluster_id, coalesce(k.topic_id, m.topic_id) AS topic_id, CASE WHEN m.cluster_id IS NOT NULL AND NOT coalesce(k.locked, false) THEN m.score ELSE k.score END AS score,
           CASE WHEN m.cluster_id IS NOT NULL AND NOT coalesce(k.locked, false) THEN 'auto' ELSE k.source END AS source, coalesce(k.locked, false) AS locked
    FROM k FULL JOIN m ON k.cluster_id = m.cluster_id AND k.topic_id = m.topic_id""".replace("{ASSIGNED}", ASSIGNED))
def topics_backfilled(t: Relations) -> DataFrame:
    docs = t["clusters"].select(F.col("id").alias("cluster_id"), F.col("canonical_title").alias("search_text"))
    aliases = t.spark.createDataFrame([(101, "urgent"), (102, "LOW")], "id int, alias string")
    return tagging.backfilled(t["clusters"], docs, of(t, ASSIGNED), aliases, 10_000_000)["cluster_topics"]


@query("""SELECT id, CASE WHEN id % 2 = 0 THEN concat('new ', name) ELSE name END AS name, source_type FROM sources""")
def sources_patched(t: Relations) -> DataFrame:
    """Columns that a patch leaves null stay."""
    patches = t["sources"].select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("new "), "name")).alias("name"), F.lit(None).cast("string").alias("source_type"))
    return tagging.described(t["sources"], patches).select("id", "name", "source_type")


@query("""SELECT doc_id, coalesce(length(trim(text)) >= 100, false) AS enough FROM documents""")
def texts_sufficient(t: Relations) -> DataFrame:
    return t["documents"].select("doc_id", F.coalesce(worklists.sufficient(F.col("text")), F.lit(False)).alias("enough"))

