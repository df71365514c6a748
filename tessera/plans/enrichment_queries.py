"""Queries about explanations by a language model; the mock model makes answers that SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import answers
from tessera.operators import enrichment
from tessera.plans.catalog import query
from tessera.sources.tables import Relations


@query(r"""
    WITH q AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN concat(' "', source, '" ') WHEN 1 THEN concat('''', source, '''') WHEN 2 THEN concat('"', source) WHEN 3 THEN '"' ELSE concat('"''', source, '''"') END AS raw, source FROM documents)
    SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN concat('"', source) WHEN 3 THEN '' ELSE source END AS clean FROM q
""")
def cleaned_answers(r: Relations) -> DataFrame:
    s = F.col("source")
    raw = F.element_at(F.array(F.concat(F.lit(' "'), s, F.lit('" ')), F.concat(F.lit("'"), s, F.lit("'")), F.concat(F.lit('"'), s), F.lit('"'), F.concat(F.lit("\"'"), s, F.lit("'\""))), (F.col("doc_id") % 5 + 1).cast("int"))
    return r["documents"].select("doc_id", answers.unquoted(raw).alias("clean"))


CUT = "CASE WHEN length({text}) <= 280 THEN {text} WHEN length({ends}) - 1 > 140 THEN {ends} ELSE concat(regexp_replace(substr({text}, 1, 280), '\\s+$', ''), '...') END"


@query("""
    WITH h AS (SELECT doc_id, text, length(text) AS n, substr(text, 1, 280) AS head FROM documents),
    e AS (SELECT *, regexp_extract(head, '(?s)^(.*[.?!])', 1) AS ends FROM h)
    SELECT doc_id, sha256(CASE WHEN n <= 280 THEN text WHEN length(ends) - 1 > 140 THEN ends ELSE concat(regexp_replace(head, '\\s+$', ''), '...') END) AS digest FROM e
""")
def cut_at_sentence(r: Relations) -> DataFrame:
    return r["documents"].select("doc_id", F.sha2(answers.cut_at_sentence(F.col("text"), 280), 256).alias("digest"))


@query("""
    SELECT doc_id, list_has_any(list_distinct(regexp_extract_all(text, '[0-9]')), list_filter(['0','1','2','3','4','5','6','7','8','9'], lambda x: strpos(split_part(text, chr(10), 1), x) = 0)) AS fresh FROM documents
""")
def new_digits(r: Relations) -> DataFrame:
    return r["documents"].select("doc_id", answers.new_digits(F.substring_index("text", "\n", 1), F.col("text")).alias("fresh"))


@query("""
    SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 < 5 THEN n_name END AS name, CASE WHEN n_nationkey % 6 < 5 THEN n_nationkey END AS n FROM nation
""")
def json_in_answers(r: Relations) -> DataFrame:
    """JSON bare, in a marked and in a plain fence, after other words, cut off, or none at all."""
    body = F.concat(F.lit('{"name":"'), F.col("n_name"), F.lit('","n":'), F.col("n_nationkey"), F.lit("}"))
    kinds = [body, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nDone")), F.concat(F.lit("```\n"), body, F.lit("```")), F.concat(F.lit("  "), body, F.lit("\n")), F.concat(F.lit("x ```json "), body, F.lit(" ``` y ```json {} ```")), F.concat(F.lit("["), body, F.lit("]"))]
    parsed = answers.json_object(F.element_at(F.array(*kinds), (F.col("n_nationkey") % 6 + 1).cast("int")), "name string, n int")
    return r["nation"].select(F.col("n_nationkey").alias("id"), parsed["name"].alias("name"), parsed["n"].alias("n"))


@query("""
    WITH s AS (SELECT doc_id, len(list_filter(string_split_regex(a, '\\s+'), lambda x: x <> '')) AS n, len(list_filter(string_split_regex(b, '\\s+'), lambda x: x <> '')) AS m
               FROM (SELECT doc_id, text AS a, split_part(text, chr(10), 1) AS b FROM documents))
    SELECT doc_id, round(least(1, greatest(0, 0.75 + CASE WHEN n BETWEEN 100 AND 150 THEN 0.1 WHEN n > 250 OR n < 50 THEN -0.1 ELSE 0 END + CASE WHEN m BETWEEN 60 AND 100 THEN 0.1 WHEN m > 250 OR m < 30 THEN -0.1 ELSE 0 END
      - CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0 END - CASE WHEN doc_id % 3 = 0 THEN 0.1 ELSE 0 END)), 6) AS confidence FROM s
""")
def intuition_confidence(r: Relations) -> DataFrame:
    c = answers.intuition_confidence(F.col("text"), F.substring_index("text", "\n", 1), F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0)
    return r["documents"].select("doc_id", F.round(c, 6).alias("confidence"))


@query("""
    WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN concat('## Overview of method ', text) ELSE text END AS m, doc_id % 4 AS k FROM documents),
    n AS (SELECT *, len(list_filter(string_split_regex(m, '\\s+'), lambda x: x <> '')) AS n FROM s)
    SELECT doc_id, CASE WHEN m IS NULL THEN 0 ELSE round(least(1, greatest(0, 0.7 + CASE WHEN n < 100 THEN -0.1 WHEN n > 300 THEN 0.1 ELSE 0 END
      + 0.05 * least(4, CAST(contains(lower(m), '##') AS int) + CAST(contains(lower(m), 'overview') AS int) + CAST(contains(lower(m), 'method') AS int) + CAST(contains(lower(m), 'result') AS int) + CAST(contains(lower(m), 'limitation') AS int))
      + CASE WHEN k >= 3 THEN 0.1 WHEN k = 1 THEN -0.05 ELSE 0 END)), 6) END AS confidence FROM n
""")
def deep_dive_confidence(r: Relations) -> DataFrame:
    m = F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 3 == 0, F.concat(F.lit("## Overview of method "), "text")).otherwise(F.col("text"))
    return r["documents"].select("doc_id", F.round(answers.deep_dive_confidence(m, F.col("doc_id") % 4), 6).alias("confidence"))


@query("""
    SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 4 THEN NULL ELSE n_nationkey % 5 < 3 END AS meaningful,
           CASE n_nationkey % 5 WHEN 0 THEN 'regulatory' WHEN 3 THEN 'not_meaningful' WHEN 4 THEN NULL ELSE 'follow_up' END AS update_type,
           CASE n_nationkey % 5 WHEN 0 THEN 'a|b' WHEN 1 THEN 'only' WHEN 4 THEN NULL ELSE '' END AS changes, CASE n_nationkey % 5 WHEN 0 THEN 0.9 WHEN 3 THEN 0.0 WHEN 4 THEN NULL ELSE 0.7 END AS confidence
    FROM nation
""")
def updates_found(r: Relations) -> DataFrame:
    texts = [
        '{"meaningful":true,"update_type":"regulatory","summary":"s","changes":["a","b"],"confidence":0.9}', '```json\n{"meaningful":true,"update_type":"odd","changes":"only"}\n```', '{"meaningful":true,"changes":{"a":1}}',
        '{"meaningful":false,"update_type":"regulatory"}', "no idea",
    ]
    u = answers.update_found(F.element_at(F.array(*map(F.lit, texts)), (F.col("n_nationkey") % 5 + 1).cast("int")))
    return r["nation"].select(F.col("n_nationkey").alias("id"), u["meaningful"].alias("meaningful"), u["update_type"].alias("update_type"), F.array_join(u["changes"], "|").alias("changes"), u["confidence"].alias("confidence"))


@query("""
    SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 3 THEN NULL ELSE n_nationkey % 4 = 0 END AS validated, CASE n_nationkey % 4 WHEN 0 THEN 0.8 WHEN 3 THEN NULL ELSE 0.5 END AS confidence,
           CASE n_nationkey % 4 WHEN 0 THEN 'hype' WHEN 1 THEN 'unsupported' WHEN 2 THEN 'overstatement,hype' END AS flags FROM nation
""")
def citations_checked(r: Relations) -> DataFrame:
    flag = lambda kind, issue="i": f'{{"type":"{kind}","claim":"c","issue":"{issue}"}}'
    texts = [
        f'{{"validated":true,"overall_confidence":0.8,"flags":[{flag("hype")},{flag("unsupported", "")}]}}', f'{{"validated":true,"flags":[{flag("strange")}]}}', f'{{"validated":true,"flags":[{flag("overstatement")},{flag("hype")}]}}', "[]",
    ]
    u = answers.citations_checked(F.element_at(F.array(*map(F.lit, texts)), (F.col("n_nationkey") % 4 + 1).cast("int")))
    return r["nation"].select(F.col("n_nationkey").alias("id"), u["validated"].alias("validated"), u["confidence"].alias("confidence"), F.array_join(u["flags"], ",").alias("flags"))


@query("""
    SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 WHEN 3 THEN 0.0 END AS novelty, CASE WHEN n_nationkey % 5 < 4 THEN 1.0 END AS translation, CASE WHEN n_nationkey % 5 < 4 THEN 0.0 END AS evidence FROM nation
""")
def impact_rated(r: Relations) -> DataFrame:
    value = F.element_at(F.array(*map(F.lit, ("0.25", "true", '"0.5"', '"high"', "3"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    text = F.concat(F.when(F.col("n_nationkey") % 5 == 4, "rating: ").otherwise(""), F.lit('{"novelty_score":'), value, F.lit(',"translation_score":7,"evidence_score":-2}'))
    u = enrichment.rated(text)
    return r["nation"].select(F.col("n_nationkey").alias("id"), u["novelty"].alias("novelty"), u["translation"].alias("translation"), u["evidence"].alias("evidence"))


STORIES = """
    stories AS (SELECT doc_id AS id, CASE WHEN doc_id % 40 = 1 THEN '' ELSE split_part(text, chr(10), 1) END AS canonical_title, CASE WHEN doc_id % 6 <> 0 THEN 'known' END AS takeaway, CASE WHEN doc_id % 11 = 0 THEN 'deep' END AS deep_dive
                FROM documents WHERE doc_id % 2 = 0),
    parts AS (SELECT doc_id - doc_id % 4 AS cluster_id, doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN 'primary' ELSE 'supporting' END AS role FROM documents),
    evidence AS (SELECT id AS item_id, split_part(title, chr(9), 1) AS title, CASE WHEN id % 3 = 0 THEN source_name ELSE concat(title, ' ', coalesce(full_text, '')) END AS snippet, full_text, full_text_kind, full_text_source, source_name, content_type, published_at FROM papers),
    kinds AS (SELECT *, content_type IN ('preprint', 'peer_reviewed') AS is_paper, CASE WHEN trim(coalesce(full_text, '')) = '' THEN 'missing' WHEN lower(full_text_kind) IN ('fulltext', 'abstract') THEN lower(full_text_kind)
              WHEN full_text_source IN ('arxiv_pdf', 'landing_page') THEN 'fulltext' ELSE 'abstract' END AS kind FROM evidence)"""


def stories(r: Relations) -> tuple[DataFrame, DataFrame, DataFrame]:
    sql = "WITH " + STORIES.replace("FROM documents", "FROM {documents}").replace("FROM papers", "FROM {papers}")
    of = lambda name: r.spark.sql(f"{sql} SELECT * FROM {name}", documents=r["documents"], papers=r["papers"])
    return of("stories"), of("parts"), of("evidence").withColumn("id", F.col("item_id")).drop("item_id")


@query(rf"""
    WITH {STORIES},
    n AS (SELECT s.id, s.canonical_title, count(p.item_id) AS items, coalesce(sum(length(coalesce(k.title, '')) + length(coalesce(k.snippet, ''))), 0) AS size,
                 string_agg(concat_ws(chr(10), k.title, concat('Source: ', k.source_name), concat('Summary: ', CASE WHEN length(k.snippet) > 300 THEN concat(substr(k.snippet, 1, 300), '...') ELSE k.snippet END)), '' ORDER BY p.role) AS all_text
          FROM stories s LEFT JOIN parts p ON p.cluster_id = s.id LEFT JOIN kinds k ON k.item_id = p.item_id GROUP BY s.id, s.canonical_title),
    g AS (SELECT *, CASE WHEN items = 0 THEN 'no_items' WHEN canonical_title = '' THEN 'no_title' WHEN size + length(canonical_title) < 80 THEN 'insufficient_content' END AS refusal FROM n)
    SELECT id, refusal, CASE WHEN refusal IS NULL THEN {CUT.format(text="t", ends="regexp_extract(substr(t, 1, 280), '(?s)^(.*[.?!])', 1)")} END AS takeaway FROM (SELECT *, regexp_replace(canonical_title, '^\s+|\s+$', '', 'g') AS t FROM g) h
""")
def takeaways(r: Relations) -> DataFrame:
    """The mock model answers with the title in quotes."""
    return enrichment.takeaways(*stories(r), enrichment.mock_model)


@query(rf"""
    WITH {STORIES},
    e AS (SELECT p.cluster_id, max(CAST(k.is_paper AS int)) AS paper, max(CAST(k.is_paper AND k.kind = 'fulltext' AS int)) AS full_papers, max(CAST(k.is_paper AND k.kind = 'abstract' AS int)) AS abstracts,
                 coalesce(sum(CASE WHEN trim(coalesce(k.full_text, '')) <> '' THEN length(regexp_replace(k.full_text, '^\s+|\s+$', '', 'g')) + CASE WHEN trim(coalesce(k.title, '')) <> '' THEN 5 + length(trim(k.title)) ELSE 0 END + 7 END), 7) - 7 AS article,
                 first(length(coalesce(regexp_replace(k.snippet, '^\s+|\s+$', '', 'g'), '')) ORDER BY p.role, k.published_at DESC NULLS LAST, p.item_id) AS snippet
          FROM parts p JOIN kinds k ON k.item_id = p.item_id GROUP BY p.cluster_id),
    a AS (SELECT s.id, s.deep_dive, e.*, CASE WHEN s.takeaway IS NULL THEN 'skip_no_takeaway' WHEN s.deep_dive IS NOT NULL THEN 'explain' WHEN e.full_papers = 1 THEN 'deep_dive' WHEN e.paper = 1 AND e.abstracts = 1 THEN 'abstracts'
                 WHEN e.paper = 1 THEN 'skip_no_fulltext' WHEN e.cluster_id IS NULL THEN 'skip_news_no_items' WHEN e.article >= 300 OR e.snippet >= 300 THEN 'news' ELSE 'skip_news_insufficient_context' END AS action,
                 CASE WHEN s.takeaway IS NULL THEN 'skip_no_takeaway' WHEN e.full_papers = 1 THEN 'deep_dive' WHEN e.paper = 1 AND e.abstracts = 1 THEN 'abstracts' WHEN e.paper = 1 THEN 'skip_no_fulltext' ELSE 'skip_no_papers' END AS deep_dive_action
          FROM stories s LEFT JOIN e ON e.cluster_id = s.id)
    SELECT id, action, deep_dive_action, CASE action WHEN 'abstracts' THEN 'abstract_only' WHEN 'skip_no_fulltext' THEN 'no_fulltext' WHEN 'skip_news_no_items' THEN 'news_no_items' WHEN 'skip_news_insufficient_context' THEN 'news_insufficient_context' END AS reason FROM a
""")
def enrichment_actions(r: Relations) -> DataFrame:
    clusters, members, items = stories(r)
    met = clusters.join(enrichment.evidence(members, items), F.col("id") == F.col("cluster_id"), "left")
    columns = F.col("takeaway"), F.col("deep_dive"), F.col("items")
    out = met.withColumn("action", enrichment.action(*columns)).withColumn("deep_dive_action", enrichment.action(*columns, mode="deep_dive"))
    return out.select("id", "action", "deep_dive_action", enrichment.skip_reason(F.col("action")).alias("reason"))


@query(rf"""
    WITH {STORIES},
    o AS (SELECT p.cluster_id, k.*, row_number() OVER (PARTITION BY p.cluster_id ORDER BY p.role, k.published_at DESC NULLS LAST, p.item_id) AS rn FROM parts p JOIN kinds k ON k.item_id = p.item_id)
    SELECT cluster_id, coalesce(string_agg(CASE WHEN is_paper AND kind = 'abstract' THEN concat('- ', trim(title), CASE WHEN trim(coalesce(source_name, '')) <> '' THEN concat(' [', trim(source_name), ']') ELSE '' END, chr(10), full_text) END, concat(chr(10), chr(10)) ORDER BY rn), '') AS abstracts,
           coalesce(string_agg(CASE WHEN trim(coalesce(full_text, '')) <> '' THEN concat(CASE WHEN trim(title) <> '' THEN concat('## ', trim(title), chr(10), chr(10)) ELSE '' END, regexp_replace(full_text, '^\s+|\s+$', '', 'g')) END, concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY rn), '') AS article
    FROM o GROUP BY cluster_id
""")
def explainer_contexts(r: Relations) -> DataFrame:
    _, members, items = stories(r)
    e = enrichment.evidence(members, items)
    none = F.lit("")
    return e.select("cluster_id", F.coalesce(enrichment.abstract_context(enrichment.abstract_papers(F.col("items"))), none).alias("abstracts"), F.coalesce(enrichment.combined_article(F.col("items")), none).alias("article"))


@query("""
    WITH t AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 250 AS long FROM documents)
    SELECT doc_id, CASE WHEN long THEN 'Revision instruction: shorten aggressively while preserving meaning.' ELSE 'short' END AS answer FROM t
""")
def shortened_answers(r: Relations) -> DataFrame:
    """A model that repeats a prompt's second part: texts of over 250 words are asked for again."""
    model = lambda prompt: F.when(prompt.endswith("meaning."), F.element_at(F.split(prompt, "\n"), -1)).otherwise(prompt)
    answer = enrichment.shortened(F.col("text"), model)
    return r["documents"].select("doc_id", F.when(answer.endswith("preserving meaning."), answer).otherwise("short").alias("answer"))


@query("""
    SELECT doc_id AS cluster_id, sha256(text) AS source_hash, 8 AS dimensions, 1.0 AS norm FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0
""")
def embeddings_changed(r: Relations) -> DataFrame:
    """Every third document has a vector, and every second one another text since."""
    texts = r["documents"].select(F.col("doc_id").alias("cluster_id"), "text")
    stored = texts.where("cluster_id % 3 = 0").select("cluster_id", F.sha2(F.when(F.col("cluster_id") % 2 == 0, "old").otherwise(F.col("text")), 256).alias("source_hash"))
    fresh = enrichment.embeddings_changed(texts, stored, enrichment.mock_embedding(8))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return fresh.select("cluster_id", "source_hash", F.size("embedding").alias("dimensions"), F.round(F.sqrt(norm), 6).alias("norm"))


@query("""
    WITH c AS (SELECT user_id AS target, event_id AS place, event_type <> 'error' AS connected, value AS confidence FROM events),
    f AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY place) AS rn FROM c WHERE connected)
    SELECT target, place, confidence, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, place) AS rank FROM f WHERE rn <= 5
""")
def lineage_connections(r: Relations) -> DataFrame:
    found = r["events"].select(F.col("user_id").alias("target"), F.col("event_id").alias("place"), (F.col("event_type") != "error").alias("connected"), F.col("value").alias("confidence"))
    return enrichment.connections(found).select("target", "place", "confidence", "rank")


@query("""
    WITH n AS (SELECT doc_id, text AS s, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n, split_part(text, chr(10), 1) AS src FROM documents)
    SELECT doc_id, round(0.70 + CASE WHEN n BETWEEN 30 AND 60 THEN 0.1 WHEN n > 100 OR n < 15 THEN -0.15 ELSE 0 END
      - CASE WHEN list_has_any(list_distinct(regexp_extract_all(s, '[0-9]')), list_filter(['0','1','2','3','4','5','6','7','8','9'], lambda x: strpos(src, x) = 0)) THEN 0.15 ELSE 0 END, 6) AS confidence FROM n
""")
def news_confidence(r: Relations) -> DataFrame:
    return r["documents"].select("doc_id", F.round(answers.news_confidence(F.col("text"), F.substring_index("text", "\n", 1)), 6).alias("confidence"))
