"""Queries over feeds, topics, metrics and impact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators import feeds, impact, metrics, topics, worklists
from tessera.plans.catalog import query
from tessera.sources.tables import Relations

NOW = "2001-07-20 00:00:00"


def now() -> Column:
    """The fixed time of every query that is relative to one."""
    return F.lit(NOW).cast("timestamp")



RANK = "CASE content_type WHEN 'news' THEN 0 WHEN 'press_release' THEN 1 WHEN 'preprint' THEN 2 WHEN 'peer_reviewed' THEN 3 ELSE 4 END"
ROLE = "CASE role WHEN 'primary' THEN 0 WHEN 'supporting' THEN 1 ELSE 2 END"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("""
    SELECT i.id, i.title, i.content_type, i.source_id, s.name AS source_name FROM items i JOIN sources s ON s.id = i.source_id
    ORDER BY published_at DESC NULLS LAST, fetched_at DESC NULLS LAST, i.id LIMIT 20""")
def items_feed(t: Relations) -> DataFrame:
    return feeds.items_feed(t["items"], t["sources"]).select("id", "title", "content_type", "source_id", "source_name")


@query("""
    SELECT i.id, i.title, i.content_type, i.source_id, s.source_type FROM items i JOIN sources s ON s.id = i.source_id
    WHERE s.source_type = 'journal' AND i.content_type = 'preprint'
    ORDER BY published_at DESC NULLS LAST, fetched_at DESC NULLS LAST, i.id LIMIT 20 OFFSET 20""")
def items_feed_by_source_type(t: Relations) -> DataFrame:
    return feeds.items_feed(t["items"], t["sources"], source_type="journal", content_type="preprint", number=2).select("id", "title", "content_type", "source_id", "source_type")


@query("""
    SELECT s.id, s.name, string_agg(f.feed_url, ',' ORDER BY f.feed_url) AS feed_urls, count(f.id) AS n_feeds, CAST(coalesce(max(f.error_streak), 0) AS bigint) AS worst_streak
    FROM sources s LEFT JOIN feeds f ON f.source_id = s.id GROUP BY s.id, s.name""")
def sources_with_feeds(t: Relations) -> DataFrame:
    out = feeds.sources_with_feeds(t["sources"], t["feeds"])
    urls = F.nullif(F.array_join(F.transform("feeds", lambda x: x["feed_url"]), ","), F.lit(""))
    worst = F.coalesce(F.array_max(F.transform("feeds", lambda x: x["error_streak"])), F.lit(0)).cast("long")
    return out.select("id", "name", urls.alias("feed_urls"), F.size("feeds").cast("long").alias("n_feeds"), worst.alias("worst_streak"))


@query("SELECT id, canonical_title FROM clusters WHERE status = 'active' ORDER BY updated_at DESC NULLS LAST, id LIMIT 20")
def feed_latest(t: Relations) -> DataFrame:
    return feeds.feed(t["clusters"]).select("id", "canonical_title")


COUNTS = f"""
    cm AS (
        SELECT m.cluster_id, count(*) AS item_count, count(DISTINCT m.source_id) AS src, count(DISTINCT s.source_type) AS kinds,
               count(*) FILTER (WHERE m.added_at >= TIMESTAMP '{NOW}' - INTERVAL 6 HOUR) AS v6, count(*) FILTER (WHERE m.added_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS v24
        FROM members m JOIN sources s ON s.id = m.source_id GROUP BY m.cluster_id)"""
AGE = f"(epoch(TIMESTAMP '{NOW}') - epoch(updated_at))"
IMPACT = f"""
    greatest(0.0, least(1.0, (0.82 * coalesce(final_score, provisional_score, 0.0) + 0.18 * least(1.0, 0.55 * ln(1 + v6) / ln(6) + 0.30 * ln(1 + v24) / ln(12)
    + 0.15 * (least(src, 10) / 10.0))) * (0.90 + 0.10 * exp(-{AGE} / 432000.0))))"""
TREND = f"(v6 + 0.5 * v24 + least(src, 10) * 0.3) * exp(-{AGE} / 86400.0)"


@query(f"""
    WITH {COUNTS},
    types AS (SELECT m.cluster_id, list(DISTINCT content_type) AS ts FROM members m JOIN items i ON i.id = m.item_id GROUP BY m.cluster_id)
    SELECT c.id, c.canonical_title, item_count, src AS distinct_source_count, round({IMPACT}, 6) AS impact_score,
           array_to_string(list_filter(['news', 'press_release', 'preprint', 'peer_reviewed', 'report'], lambda x: list_contains(ts, x)), ',') AS badges
    FROM clusters c JOIN cm ON cm.cluster_id = c.id JOIN types ON types.cluster_id = c.id WHERE status = 'active'
    ORDER BY {IMPACT} DESC, updated_at DESC, c.id LIMIT 20""")
def feed_trending(t: Relations) -> DataFrame:
    scored = metrics.recompute_batch(t["clusters"], t["members"], t["sources"], now())
    top = feeds.feed(scored, by="impact_score")
    own = t["members"].join(top.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    badges = feeds.content_types(own, t["items"])
    out = top.join(badges, top.id == badges.cluster_id)
    return rounded(out.select("id", "canonical_title", "item_count", "distinct_source_count", "impact_score", F.array_join("content_types", ",").alias("badges")), "impact_score")


@query("""
    SELECT id, canonical_title FROM clusters c WHERE status = 'active' AND EXISTS (
        SELECT 1 FROM cluster_topics ct JOIN topics t ON t.id = ct.topic_id WHERE ct.cluster_id = c.id AND (t.id = 2 OR t.parent_id = 2))
    ORDER BY updated_at DESC, id LIMIT 20""")
def feed_by_topic(t: Relations) -> DataFrame:
    return feeds.feed(t["clusters"], on=feeds.on_topic(t["cluster_topics"], t["topics"], 2)).select("id", "canonical_title")


@query("""
    SELECT id, canonical_title FROM clusters c WHERE status = 'active' AND EXISTS (SELECT 1 FROM members m WHERE m.cluster_id = c.id AND m.source_id = 7)
    ORDER BY updated_at DESC, id LIMIT 20""")
def feed_by_source(t: Relations) -> DataFrame:
    return feeds.feed(t["clusters"], t["members"], source_id=7).select("id", "canonical_title")


@query("""
    SELECT id, canonical_title FROM clusters c WHERE status = 'active'
    AND EXISTS (SELECT 1 FROM members m JOIN items i ON i.id = m.item_id WHERE m.cluster_id = c.id AND i.content_type = 'report')
    AND EXISTS (SELECT 1 FROM members m JOIN sources s ON s.id = m.source_id WHERE m.cluster_id = c.id AND s.source_type = 'lab')
    ORDER BY updated_at DESC, id LIMIT 20""")
def feed_by_content_type(t: Relations) -> DataFrame:
    return feeds.feed(t["clusters"], t["members"], t["items"], t["sources"], content_type="report", source_type="lab").select("id", "canonical_title")


@query(f"""
    SELECT cluster_id, item_id, role, rn FROM (
        SELECT m.cluster_id, m.item_id, m.role, row_number() OVER (PARTITION BY m.cluster_id ORDER BY {ROLE}, published_at DESC NULLS LAST, m.item_id) AS rn
        FROM members m JOIN items i ON i.id = m.item_id) WHERE rn <= 10""")
def cluster_evidence(t: Relations) -> DataFrame:
    return feeds.evidence(t["members"], t["items"]).select("cluster_id", "item_id", "role", F.col("rn").cast("long").alias("rn"))


@query("SELECT m.cluster_id, content_type, count(*) AS n FROM members m JOIN items i ON i.id = m.item_id GROUP BY m.cluster_id, content_type")
def content_type_breakdown(t: Relations) -> DataFrame:
    return feeds.breakdown(t["members"], t["items"])


@query("""
    SELECT cluster_id, image_url FROM (
        SELECT m.cluster_id, image_url, row_number() OVER (PARTITION BY m.cluster_id ORDER BY published_at DESC NULLS LAST, fetched_at DESC, m.item_id) AS rn
        FROM members m JOIN items i ON i.id = m.item_id WHERE image_url IS NOT NULL) WHERE rn = 1""")
def featured_image(t: Relations) -> DataFrame:
    return feeds.featured_image(t["members"], t["items"])


@query("""
    WITH top AS (SELECT * FROM clusters WHERE status = 'active' ORDER BY updated_at DESC, id LIMIT 20),
    tt AS (SELECT cluster_id, string_agg(name, ',' ORDER BY rn) AS topic_names FROM (
        SELECT cluster_id, topic_id, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, topic_id) AS rn FROM cluster_topics) x JOIN topics t ON t.id = x.topic_id WHERE rn <= 5 GROUP BY cluster_id),
    ty AS (SELECT m.cluster_id, list(DISTINCT content_type) AS ts FROM members m JOIN items i ON i.id = m.item_id GROUP BY m.cluster_id),
    im AS (SELECT cluster_id, image_url FROM (SELECT m.cluster_id, image_url, row_number() OVER (PARTITION BY m.cluster_id ORDER BY published_at DESC NULLS LAST, fetched_at DESC, m.item_id) AS rn
           FROM members m JOIN items i ON i.id = m.item_id WHERE image_url IS NOT NULL) WHERE rn = 1)
    SELECT id, topic_names, array_to_string(list_filter(['news', 'press_release', 'preprint', 'peer_reviewed', 'report'], lambda x: list_contains(ts, x)), ',') AS badges, image_url
    FROM top LEFT JOIN tt ON tt.cluster_id = id LEFT JOIN ty ON ty.cluster_id = id LEFT JOIN im ON im.cluster_id = id""")
def cluster_cards(t: Relations) -> DataFrame:
    top = feeds.feed(t["clusters"])
    own = t["members"].join(top.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    out = feeds.cards(top, t["cluster_topics"], t["topics"], feeds.content_types(own, t["items"]), feeds.featured_image(own, t["items"]))
    return out.select("id", F.array_join("topics", ",").alias("topic_names"), F.array_join("content_types", ",").alias("badges"), "image_url")


@query("""
    SELECT user_id, cluster_id, canonical_title, rn FROM (
        SELECT k.user_id, k.cluster_id, canonical_title, row_number() OVER (PARTITION BY k.user_id ORDER BY created_at DESC, k.cluster_id) AS rn
        FROM saves k JOIN clusters c ON c.id = k.cluster_id WHERE status = 'active') WHERE rn <= 200""")
def saved_clusters(t: Relations) -> DataFrame:
    return feeds.kept_by(t["clusters"], t["saves"]).select("user_id", "cluster_id", "canonical_title", F.col("rn").cast("long").alias("rn"))


@query("""
    SELECT k.cluster_id, canonical_title FROM watches k JOIN clusters c ON c.id = k.cluster_id WHERE status = 'active' AND user_id = 7 ORDER BY created_at DESC, k.cluster_id LIMIT 200""")
def watched_clusters(t: Relations) -> DataFrame:
    return feeds.kept_by(t["clusters"], t["watches"], user_id=7).select("cluster_id", "canonical_title")


@query("""
    WITH followed AS (SELECT DISTINCT f.user_id, ct.cluster_id FROM follows f JOIN topics t ON t.id = f.topic_id OR t.parent_id = f.topic_id JOIN cluster_topics ct ON ct.topic_id = t.id),
    wanted AS (SELECT user_id, cluster_id FROM followed UNION SELECT user_id, cluster_id FROM saves)
    SELECT user_id, cluster_id, rn FROM (
        SELECT w.user_id, w.cluster_id, row_number() OVER (PARTITION BY w.user_id ORDER BY updated_at DESC, w.cluster_id) AS rn
        FROM wanted w JOIN clusters c ON c.id = w.cluster_id
        WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM hides h WHERE h.user_id = w.user_id AND h.cluster_id = w.cluster_id)) WHERE rn <= 20""")
def for_you(t: Relations) -> DataFrame:
    out = feeds.for_you(t["clusters"], t["cluster_topics"], t["topics"], t["follows"], t["saves"], t["hides"])
    return out.select("user_id", "cluster_id", F.col("rn").cast("long").alias("rn"))


@query("""
    SELECT cluster_id, seq, change_type FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY seq DESC NULLS LAST, change_type) AS rn FROM update_log) WHERE rn <= 3""")
def cluster_updates(t: Relations) -> DataFrame:
    return feeds.latest_per_cluster(t["update_log"], 3).select("cluster_id", "seq", "change_type")


@query("SELECT c.id, coalesce(r.to_id, c.id) AS resolved FROM clusters c LEFT JOIN redirects r ON r.from_id = c.id")
def redirects(t: Relations) -> DataFrame:
    return feeds.resolve(t["clusters"].select("id"), t["redirects"], "id")


@query("""
    SELECT cluster_id, name AS category, max(score) AS score, count(*) AS n_topics FROM (
        SELECT ct.cluster_id, p.name, ct.score FROM cluster_topics ct JOIN topics t ON t.id = ct.topic_id JOIN topics p ON p.id = t.parent_id) GROUP BY cluster_id, name""")
def cluster_categories(t: Relations) -> DataFrame:
    return topics.categories(t["cluster_topics"], t["topics"])


@query("""
    SELECT t.id, t.name, CASE WHEN t.parent_id IS NULL THEN 'category' ELSE 'subtopic' END AS topic_type, row_number() OVER (ORDER BY CASE WHEN t.parent_id IS NULL THEN 0 ELSE 1 END, t.name, t.id) AS place FROM topics t""")
def topic_list(t: Relations) -> DataFrame:
    return topics.listed(t["topics"])


@query("""
    SELECT rn, id, topic_id FROM (SELECT c.id, ct.topic_id, row_number() OVER (ORDER BY updated_at DESC, c.id, ct.topic_id) AS rn
        FROM clusters c JOIN cluster_topics ct ON ct.cluster_id = c.id JOIN topics t ON t.id = ct.topic_id
        WHERE status = 'active' AND (t.id = 1 OR t.parent_id = 1)) WHERE rn <= 20""")
def topic_page(t: Relations) -> DataFrame:
    return topics.page(t["clusters"], t["cluster_topics"], t["topics"], 1)


@query("""
    SELECT cluster_id, topic_id, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, topic_id) AS rn FROM cluster_topics) WHERE rn <= 5""")
def top_topics_per_cluster(t: Relations) -> DataFrame:
    order = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), "topic_id")
    return t["cluster_topics"].withColumn("rn", F.row_number().over(order).cast("long")).where("rn <= 5").select("cluster_id", "topic_id", "score", "rn")


METRICS = "item_count, src AS distinct_source_count, kinds AS distinct_source_type_count, v6 AS velocity_6h, v24 AS velocity_24h"
METRIC_NAMES = ("id", "item_count", "distinct_source_count", "distinct_source_type_count", "velocity_6h", "velocity_24h", "recency_score", "trending_score", "impact_score")


@query(f"""
    WITH {COUNTS} SELECT c.id, {METRICS}, round(exp(-{AGE} / 86400.0), 6) AS recency_score, round({TREND}, 6) AS trending_score, round({IMPACT}, 6) AS impact_score
    FROM clusters c JOIN cm ON cm.cluster_id = c.id WHERE updated_at <= TIMESTAMP '{NOW}'""")
def cluster_metrics_batch(t: Relations) -> DataFrame:
    out = metrics.recompute_batch(t["clusters"].where(F.col("updated_at") <= now()), t["members"], t["sources"], now())
    return rounded(out.select(*METRIC_NAMES), "recency_score", "trending_score", "impact_score")


@query(f"""
    WITH {COUNTS} SELECT c.id, {METRICS}, 1.0E0 AS recency_score, round(CAST(v6 + 0.5 * v24 + least(src, 10) * 0.3 AS double), 6) AS trending_score, round({IMPACT.replace(AGE, "0.0")}, 6) AS impact_score
    FROM clusters c JOIN cm ON cm.cluster_id = c.id""")
def cluster_metrics_single(t: Relations) -> DataFrame:
    out = metrics.recompute_batch(t["clusters"], t["members"], t["sources"], now(), single=True)
    return rounded(out.select(*METRIC_NAMES), "recency_score", "trending_score", "impact_score")


LEFT = f"""WITH {COUNTS}, scored AS (
    SELECT c.id, c.status, c.updated_at, coalesce(v6, 0) AS v6, coalesce(v24, 0) AS v24, coalesce(src, 0) AS src, final_score, provisional_score
    FROM clusters c LEFT JOIN cm ON cm.cluster_id = c.id WHERE status IN ('active', 'pending'))"""


@query(f"{LEFT} SELECT id, v6 AS velocity_6h, v24 AS velocity_24h, src AS distinct_source_count, round({IMPACT}, 6) AS impact_score FROM scored WHERE updated_at <= TIMESTAMP '{NOW}'")
def impact_recompute(t: Relations) -> DataFrame:
    out = metrics.recompute_impact(t["clusters"], t["members"], t["sources"], now()).where(F.col("updated_at") <= now())
    return rounded(out.select("id", "velocity_6h", "velocity_24h", "distinct_source_count", "impact_score"), "impact_score")


@query(f"""{LEFT}, ranked AS (SELECT id, round({IMPACT}, 6) AS s, updated_at FROM scored WHERE status = 'active'), r AS (
    SELECT id, row_number() OVER (ORDER BY s DESC, updated_at DESC, id DESC) AS rn, count(*) OVER () AS n FROM ranked)
    SELECT id, rn <= greatest(1, (n + 99) // 100) AS in_focus_label FROM r""")
def in_focus_top1pct(t: Relations) -> DataFrame:
    scored = rounded(metrics.recompute_impact(t["clusters"], t["members"], t["sources"], now()), "impact_score")
    return metrics.in_focus(scored).select("id", "in_focus_label")


@query("""
    WITH i AS (SELECT m.cluster_id, m.item_id, title, CASE content_type WHEN 'peer_reviewed' THEN 2.0E0 WHEN 'preprint' THEN 1.5E0 WHEN 'report' THEN 1.0E0 WHEN 'press_release' THEN 0.5E0 ELSE 0.0E0 END
        + CASE reliability_tier WHEN 'tier1' THEN 1.0E0 WHEN 'tier2' THEN 0.5E0 ELSE 0.0E0 END + CASE WHEN length(title) BETWEEN 30 AND 160 THEN 1.0E0 ELSE 0.0E0 END
        - CASE WHEN title = upper(title) AND title <> lower(title) THEN 1.0E0 ELSE 0.0E0 END AS score,
        row_number() OVER (PARTITION BY m.cluster_id ORDER BY coalesce(published_at, fetched_at) DESC, m.item_id) AS rn
        FROM members m JOIN items x ON x.id = m.item_id JOIN sources s ON s.id = m.source_id)
    SELECT cluster_id, item_id, title, score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, rn) AS p FROM i WHERE rn <= 50) WHERE p = 1""")
def representative_item(t: Relations) -> DataFrame:
    return metrics.representatives(t["members"], t["items"], t["sources"])


@query("""
    WITH i AS (SELECT m.cluster_id, title, row_number() OVER (PARTITION BY m.cluster_id ORDER BY coalesce(published_at, fetched_at) DESC, m.item_id) AS rn FROM members m JOIN items x ON x.id = m.item_id)
    SELECT c.id AS cluster_id, concat_ws(' ', canonical_title, string_agg(title, ' ' ORDER BY rn)) AS search_text FROM clusters c JOIN i ON i.cluster_id = c.id WHERE rn <= 8 GROUP BY c.id, canonical_title""")
def search_text(t: Relations) -> DataFrame:
    return metrics.search_text(t["clusters"], t["members"], t["items"])


TRUST = """tr AS (SELECT m.cluster_id, list_sort(list(DISTINCT content_type)) AS types, count(DISTINCT m.source_id) AS src FROM members m JOIN items i ON i.id = m.item_id GROUP BY m.cluster_id)"""
FLAGS = """concat_ws(',', CASE WHEN list_contains(types, 'preprint') AND NOT list_contains(types, 'peer_reviewed') THEN 'preprint_not_peer_reviewed' END,
    CASE WHEN list_contains(types, 'press_release') AND NOT list_contains(types, 'preprint') AND NOT list_contains(types, 'peer_reviewed') THEN 'press_release_only' END,
    CASE WHEN src = 1 THEN 'single_source' END)"""


@query(f"""WITH {TRUST} SELECT cluster_id, array_to_string(types, ',') AS types, {FLAGS} AS flags,
    concat_ws(',', CASE WHEN list_contains(types, 'preprint') OR list_contains(types, 'peer_reviewed') THEN 'observational' END, CASE WHEN list_contains(types, 'report') THEN 'benchmark' END) AS badges FROM tr""")
def trust_signals(t: Relations) -> DataFrame:
    out = metrics.trust(t["members"], t["items"])
    return out.select("cluster_id", *[F.array_join(c, ",").alias(c) for c in ("types", "flags", "badges")])


@query("SELECT id FROM clusters WHERE status = 'active' AND takeaway IS NULL AND EXISTS (SELECT 1 FROM members m WHERE m.cluster_id = id) ORDER BY updated_at DESC, id LIMIT 50")
def need_takeaways(t: Relations) -> DataFrame:
    return worklists.need_takeaways(t["clusters"], t["members"], 50).select("id")


@query("""SELECT id FROM clusters WHERE status = 'active' AND takeaway IS NOT NULL AND summary_intuition IS NULL AND skip_reason IS NULL ORDER BY updated_at DESC, id LIMIT 50""")
def need_stage3(t: Relations) -> DataFrame:
    return worklists.need_stage3(t["clusters"], 50).select("id")


@query("""SELECT id FROM clusters c WHERE status = 'active' AND takeaway IS NOT NULL AND summary_intuition IS NULL AND skip_reason IS NULL
    AND EXISTS (SELECT 1 FROM members m JOIN items i ON i.id = m.item_id WHERE m.cluster_id = c.id AND content_type IN ('preprint', 'peer_reviewed')) ORDER BY updated_at DESC, id LIMIT 50""")
def need_deep_dive(t: Relations) -> DataFrame:
    return worklists.need_deep_dive(t["clusters"], t["members"], t["items"], 50).select("id")


@query("SELECT i.id FROM items i WHERE NOT EXISTS (SELECT 1 FROM members m WHERE m.item_id = i.id AND m.cluster_id % 10 < 8)")
def unassigned_items(t: Relations) -> DataFrame:
    return worklists.unassigned(t["items"], t["members"].where("cluster_id % 10 < 8")).select("id")


CUES = {k: " + ".join(f"contains(x, '{c}')::int" for c in v) for k, v in {"nov": scores.NOVELTY_CUES, "weak": scores.TRANSLATION_CUES, "strong": scores.STRONG_CUES, "hedge": scores.HEDGE_CUES}.items()}
SCORED = f"""
    s1 AS (SELECT doc_id, lang, source, quality, toxic, lower(concat_ws(' ', source, text)) AS nt, lower(text) AS x, lower(source) AS title, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
    s2 AS (SELECT *, list_filter(regexp_split_to_array(nt, '[^a-z0-9]+'), lambda w: w <> '') AS ws, list_filter(regexp_split_to_array(x, '[^a-z0-9]+'), lambda w: w <> '') AS wx FROM s1),
    s3 AS (SELECT *, greatest(0.0, least(1.0, 0.44 + least(0.24, 0.06 * ({CUES["nov"].replace("x,", "nt,")})) + greatest(-0.04, least(0.10, (CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 0.0 END - 0.52) * 0.25))
        + CASE WHEN contains(title, 'first') OR contains(title, 'novel') THEN 0.05 ELSE 0.0 END - CASE WHEN contains(nt, 'review') OR contains(nt, 'survey') THEN 0.12 ELSE 0.0 END
        - CASE WHEN contains(nt, 'incremental') OR contains(nt, 'extension') THEN 0.08 ELSE 0.0 END - CASE WHEN contains(nt, 'replication') THEN 0.05 ELSE 0.0 END)) AS novelty,
      greatest(0.0, least(1.0, 0.34 + least(0.24, ({CUES["weak"]}) * 0.04) + least(0.26, ({CUES["strong"]}) * 0.10) + CASE WHEN len(list_filter(wx, lambda w: regexp_full_match(w, '[0-9]+'))) > 0 THEN 0.05 ELSE 0.0 END
        + CASE WHEN contains(x, 'patient') OR contains(x, 'clinical') OR contains(x, 'policy') THEN 0.06 ELSE 0.0 END - least(0.10, ({CUES["hedge"]}) * 0.03))) AS translation,
      greatest(0.0, least(1.0, 0.30 + CASE WHEN quality = 1 THEN 0.30 ELSE 0.0 END + CASE WHEN n_chars > 3000 THEN 0.14 ELSE 0.0 END + least(0.16, ln(1 + greatest(doc_id % 6, 0)) * 0.08)
        - CASE WHEN toxic = 1 THEN 0.05 ELSE 0.0 END - CASE WHEN toxic = 1 THEN 0.22 ELSE 0.0 END)) AS evidence FROM s2),
    scored AS (SELECT *, round(greatest(0.0, least(1.0, 0.45 * novelty + 0.40 * translation + 0.15 * evidence)), 6) AS score, n_chars > 3000 AS eligible,
      round(greatest(0.0, least(1.0, 0.62 + least(0.12, (doc_id % 6) * 0.03) + CASE WHEN n_chars > 3000 THEN 0.12 ELSE 0.0 END)), 6) AS confidence FROM s3)"""


def document_scores(t: Relations) -> DataFrame:
    """The impact model over documents: the source name stands for the title, labels for kinds of evidence."""
    docs = t["documents"].join(t["labels"], "doc_id", "left")
    types = F.when(F.col("quality") == 1, F.array(F.lit("peer_reviewed"))).otherwise(F.array().cast("array<string>"))
    flags = F.when(F.col("toxic") == 1, F.array(F.lit("press_release_only"))).otherwise(F.array().cast("array<string>"))
    src, full = F.col("doc_id") % 6, F.col("n_chars") > 3000
    out = docs.select("doc_id", "lang", "source", full.alias("eligible"), scores.novelty(F.col("source"), F.col("text")).alias("novelty"), scores.translation(F.col("text")).alias("translation"), scores.evidence(types, flags, src, full).alias("evidence"), F.round(scores.confidence(src, full), 6).alias("confidence"))
    return out.withColumn("score", F.round(scores.high_impact(F.col("novelty"), F.col("translation"), F.col("evidence")), 6))


@query(f"WITH {SCORED} SELECT doc_id, round(novelty, 6) AS novelty, round(CAST(translation AS double), 6) AS translation, round(evidence, 6) AS evidence, score, CAST(confidence AS double) AS confidence FROM scored")
def impact_scores(t: Relations) -> DataFrame:
    return rounded(document_scores(t), "novelty", "translation", "evidence").select("doc_id", "novelty", "translation", "evidence", "score", "confidence")


THRESHOLDS = """
    b1 AS (SELECT lang, source, count(*) AS n, quantile_cont(score, 0.99) AS q FROM scored GROUP BY lang, source), b2 AS (SELECT lang, count(*) AS n, quantile_cont(score, 0.99) AS q FROM scored GROUP BY lang), b3 AS (SELECT count(*) AS n, quantile_cont(score, 0.99) AS q FROM scored),
    thr AS (SELECT s.doc_id, CASE WHEN b1.n >= 30 THEN 'topic_age' WHEN b2.n >= 30 THEN 'age_global' WHEN b3.n > 0 THEN 'global' ELSE 'default' END AS bucket,
        CASE WHEN b1.n >= 30 THEN b1.q WHEN b2.n >= 30 THEN b2.q WHEN b3.n > 0 THEN b3.q ELSE 0.95 END AS threshold
        FROM scored s LEFT JOIN b1 ON b1.lang = s.lang AND b1.source = s.source LEFT JOIN b2 ON b2.lang = s.lang, b3)"""


@query(f"WITH {SCORED}, {THRESHOLDS} SELECT doc_id, bucket, round(threshold, 6) AS threshold FROM thr")
def impact_thresholds(t: Relations) -> DataFrame:
    return rounded(impact.thresholds(document_scores(t), "score", "source", "lang", 30).select("doc_id", "bucket", "threshold"), "threshold")


@query(f"""WITH {SCORED}, {THRESHOLDS}, q AS (SELECT count(*) AS n FROM scored WHERE eligible AND score >= 0.97 AND confidence >= 0.75 AND evidence >= 0.35)
    SELECT doc_id, eligible AND confidence >= 0.75 AND evidence >= 0.35 AND (score >= round(threshold, 6) OR (score >= 0.97 AND score >= round(threshold, 6) - 0.015) OR (n >= 2 AND score >= 0.97)) AS label
    FROM scored JOIN thr USING (doc_id), q""")
def impact_labels(t: Relations) -> DataFrame:
    return impact.labels(document_scores(t), "score", "source", "lang", 30).select("doc_id", "label")


@query(f"""WITH {SCORED}, {THRESHOLDS} SELECT doc_id, score, round(threshold - score, 6) AS gap FROM scored JOIN thr USING (doc_id) WHERE eligible AND score < round(threshold, 6) ORDER BY round(threshold - score, 6), doc_id LIMIT 25""")
def impact_near_misses(t: Relations) -> DataFrame:
    return impact.near_misses(document_scores(t), "score", "source", "lang", 30, 25).select("doc_id", "score", "gap")


@query("""WITH e AS (SELECT ts, value, event_type FROM events), w AS (SELECT unnest([7, 30]) AS days)
    SELECT CAST(days AS bigint) AS days, count(*) AS eligible, count(*) FILTER (WHERE value > 200) AS labelled, round(count(*) FILTER (WHERE value > 200) / count(*), 6) AS rate,
           round(count(*) FILTER (WHERE value > 200) / count(*), 6) BETWEEN 0.007 AND 0.013 AS in_band
    FROM e, w WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(days AS int)) GROUP BY days""")
def impact_rate_windows(t: Relations) -> DataFrame:
    rows = t["events"].select("ts", (F.col("value") > 200).alias("label"))
    return impact.rate_windows(rows, F.lit("2024-01-31 00:00:00").cast("timestamp"), (7, 30))
