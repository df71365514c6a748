"""Queries over texts, urls, search and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import html, lines, papers, scores, text
from tessera.operators import clustering, search, topics
from tessera.plans.catalog import query
from tessera.sources.tables import Relations

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
SHORT = ", ".join(f"'{w}'" for w in text.SHORT_TOKENS)
TOKENS = f"list_filter(regexp_split_to_array(lower({{0}}), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains([{STOP}], w) AND (length(w) >= 3 OR list_contains([{SHORT}], w)))"


@query(f"SELECT DISTINCT title, array_to_string(list_sort(list_distinct({TOKENS.format('title')})), ' ') AS tokens FROM items")
def title_tokens(t: Relations) -> DataFrame:
    return t["items"].select("title").distinct().select("title", F.array_join(F.array_sort(text.title_tokens(F.col("title"))), " ").alias("tokens"))


@query("SELECT p_partkey AS id, sha256(trim(regexp_replace(lower(concat('  ', p_name, '  ', p_type)), '\\s+', ' ', 'g'))) AS title_hash FROM part")
def title_hash(t: Relations) -> DataFrame:
    return t["part"].select(F.col("p_partkey").alias("id"), text.title_key(F.concat(F.lit("  "), "p_name", F.lit("  "), "p_type")).alias("title_hash"))


@query(r"""
    WITH x AS (SELECT doc_id, nullif(regexp_extract(text, '(?i)\b\d{4}\.\d{4,5}(v\d+)?\b'), '') AS a1, nullif(regexp_extract(text, '(?i)\b[a-z-]+/\d{7}(v\d+)?\b'), '') AS a2,
        nullif(regexp_extract(text, '(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b'), '') AS d FROM notices)
    SELECT doc_id, coalesce(a1, a2) AS arxiv_id, d AS doi_raw, nullif(regexp_replace(coalesce(nullif(regexp_extract(d, '^(.*?[a-z0-9])[A-Z]', 1), ''), d), '[-_./]+$', ''), '') AS doi FROM x""")
def ids_extract(t: Relations) -> DataFrame:
    x = F.col("text")
    return t["notices"].select("doc_id", text.arxiv_id(x).alias("arxiv_id"), text.doi(x, trimmed=False).alias("doi_raw"), text.doi(x).alias("doi"))


TRACK = ", ".join(f"'{x}'" for x in text.TRACKING)
URL = rf"""
    u AS (SELECT page_id, trim(url) AS url, lower(coalesce(nullif(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), ''), 'https')) AS scheme, regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages),
    v AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', '') AS host, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/{{2,}}', '/', 'g') AS path,
          list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND NOT list_contains([{TRACK}], lower(split_part(p, '=', 1)))) AS q FROM u),
    w AS (SELECT page_id, scheme, CASE WHEN scheme = 'http' THEN regexp_replace(host, ':80$', '') WHEN scheme = 'https' THEN regexp_replace(host, ':443$', '') ELSE host END AS host,
          CASE WHEN path = '' THEN '/' WHEN path <> '/' THEN regexp_replace(path, '/$', '') ELSE path END AS path, array_to_string(list_sort(list_transform(q, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') AS q FROM v)"""


@query(f"WITH {URL} SELECT page_id, scheme || '://' || host || path || CASE WHEN q = '' THEN '' ELSE '?' || q END AS canonical_url, sha256(scheme || '://' || host || path || CASE WHEN q = '' THEN '' ELSE '?' || q END) AS canonical_hash FROM w")
def url_canonical(t: Relations) -> DataFrame:
    out = t["pages"].select("page_id", text.canonical_url(F.col("url")).alias("canonical_url"))
    return out.withColumn("canonical_hash", F.sha2("canonical_url", 256))


OWN = "CASE source_type WHEN 'preprint_server' THEN 'preprint' WHEN 'journal' THEN 'peer_reviewed' WHEN 'government' THEN 'report' WHEN 'lab' THEN 'press_release' WHEN 'university' THEN 'press_release' ELSE 'news' END"


@query(rf"""
    WITH h AS (SELECT *, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS host FROM links)
    SELECT id, CASE WHEN arxiv_id IS NOT NULL THEN 'preprint' WHEN host IN ('nature.com', 'www.nature.com') THEN CASE WHEN regexp_matches(url, '/articles/s') THEN 'peer_reviewed' ELSE {OWN} END
        WHEN host = 'arxiv.org' THEN 'preprint' WHEN host = 'www.nejm.org' THEN 'peer_reviewed' WHEN ends_with(host, '.edu') THEN 'press_release' WHEN ends_with(host, '.gov') THEN 'report' ELSE {OWN} END AS content_type FROM h""")
def content_type_guess(t: Relations) -> DataFrame:
    return t["links"].select("id", text.content_type(F.col("source_type"), F.col("url"), F.col("arxiv_id")).alias("content_type"))


UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"


@query(rf"""
    WITH s AS (SELECT page_id, nullif(trim(regexp_replace({UNESCAPE.format("regexp_replace(html, '<[^>]+>', '', 'g')")}, '[\t\n\v\f\r ]+', ' ', 'g')), '') AS s FROM pages)
    SELECT page_id, CASE WHEN length(s) > 500 THEN rtrim(substr(s, 1, 499)) || '…' ELSE s END AS snippet FROM s""")
def snippets(t: Relations) -> DataFrame:
    return t["pages"].select("page_id", text.snippet(F.col("html")).alias("snippet"))


@query(r"SELECT doc_id, length(text) >= 500 AND len(regexp_extract_all(text, '[^\t\n\v\f\r ]+')) >= 100 AS ok FROM documents")
def article_gate(t: Relations) -> DataFrame:
    return t["documents"].select("doc_id", text.article_ok(F.col("text")).alias("ok"))


N = lambda p, x="text": f"len(regexp_extract_all({x}, '{p}'))"
HITS = " + ".join(f"contains(lower(text), '{w}')::int" for w in text.SECTIONS)


QUALITY = rf"""
    WITH x AS (SELECT doc_id, text, lower(text) AS lo, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '') AS ls, {N("[^\\t\\n\\v\\f\\r ]+")} AS nw FROM documents),
    y AS (SELECT *, greatest(1, len(ls)) AS nl, list_position(list_transform(ls[1:260], lambda l: lower(l)), 'abstract') - 1 AS head FROM x)
    SELECT doc_id, round(CAST(CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE greatest(0.0, least(1.0, least(length(text) / 18000.0, 1.0) * 0.35 + least(nw / 2200.0, 1.0) * 0.35 + least(({HITS}) / 5.0, 1.0) * 0.30
        - least(({N("figure", "lo")} + {N("fig\\.", "lo")} + {N("table", "lo")}) / 120.0, 0.20) - least(len(list_filter(ls, lambda l: length(l) <= 2)) / nl * 1.8, 0.22)
        - least(len(list_filter(regexp_extract_all(text, '[\pL\pN_]+'), lambda w: regexp_full_match(w, '[A-Za-z]{{20,}}'))) / greatest(1, nw) * 8.0, 0.22) - least({N("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]")} / 40.0, 0.18)
        - least(len(list_filter(ls, lambda l: length(l) - length(replace(l, '|', '')) >= 2)) / nl * 1.5, 0.15) - least({N("Table \\(PDF p\\.")} / 20.0, 0.10)
        - CASE WHEN head > 10 AND len(list_filter(ls[1:head], lambda l: regexp_matches(l, '(?i)\b(department|university|institute|center|centre|observatory|fellow|preprint)\b|@|^\[?\d+\]?\s'))) >= 4 THEN 0.12 ELSE 0.0 END)) END AS double) + 1e-8, 5) AS score FROM y"""
#: Texts of which half have section names added.
SECTIONED = "(SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN concat(text, ' introduction methods results discussion references') ELSE text END AS text FROM documents)"


@query(QUALITY)
def fulltext_quality(t: Relations) -> DataFrame:
    return t["documents"].select("doc_id", F.round(text.fulltext_score(F.col("text")) + 1e-8, 5).alias("score"))


@query(f"""
    WITH s AS ({QUALITY.replace("FROM documents", f"FROM {SECTIONED} d")})
    SELECT s.doc_id, coalesce(score >= 0.4 AND length(text) >= 2500 AND {N("[^\\t\\n\\v\\f\\r ]+")} >= 400 AND {" + ".join(f"contains(lower(text), '{w}')::int" for w in text.GATE_SECTIONS)} >= 2, false) AS ok FROM s JOIN {SECTIONED} d ON d.doc_id = s.doc_id""")
def fulltext_gate(t: Relations) -> DataFrame:
    body = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" introduction methods results discussion references"))).otherwise(F.col("text"))
    return t["documents"].select("doc_id", text.fulltext_ok(body).alias("ok"))


@query(why="an HTML parser; tests hold it against expected texts")
def html_texts(t: Relations) -> DataFrame:
    return t["pages"].select("page_id", html.html_page("html", "url").alias("p")).select("page_id", "p.text", "p.image_url")


@query(why="an HTML parser and line repairs; tests hold it against expected texts")
def paper_texts(t: Relations) -> DataFrame:
    return t["pages"].select("page_id", html.html_paper("html").alias("text"))


@query(why="line joins in sequence; tests hold each against expected lines")
def pdf_texts(t: Relations) -> DataFrame:
    return t["documents"].select("doc_id", papers.pdf_cleaned("text").alias("text"))


@query("""
    SELECT n_nationkey AS id, CASE n_nationkey % 4 WHEN 0 THEN concat('Name | Key', chr(10), '--- | ---', chr(10), n_name, ' | ', n_nationkey) WHEN 1 THEN concat(n_name, ' | implementation | ', chr(10), '--- | --- | ---', chr(10), 'x |  | ', n_nationkey) END AS said FROM nation""")
def tables_as_rows(t: Relations) -> DataFrame:
    """A plain table, one with a torn word and short rows, one row alone, and prose torn into cells."""
    n, k, none = F.col("n_name"), F.col("n_nationkey").cast("string"), F.lit(None).cast("string")
    words = lambda *x: F.array(*map(F.lit, x))
    tables = [F.array(F.array(F.lit("Name"), F.lit(" Key ")), F.array(n, k)), F.array(F.array(n, F.lit("imple- mentation")), F.array(none, none), F.array(F.lit("x"), none, k)), F.array(F.array(n, k)), F.array(words("some", "text", "that", "was", "torn"), words("into", "little", "cells", "like", "this"))]
    table = F.when(F.col("n_nationkey") % 4 == 0, tables[0]).when(F.col("n_nationkey") % 4 == 1, tables[1]).when(F.col("n_nationkey") % 4 == 2, tables[2]).otherwise(tables[3])
    return t["nation"].select(F.col("n_nationkey").alias("id"), papers.pipe_rows(table).alias("said"))


@query(r"""SELECT n_nationkey AS id, concat('  ', n_name, '  kept 5\% ', chr(10), ' [MATH] ', chr(10), '[FIGURE]', chr(10), '  b ') AS said FROM nation""")
def tex_as_text(t: Relations) -> DataFrame:
    tex = F.concat(F.lit("\\section{"), F.col("n_name"), F.lit("} kept 5\\% % gone\n$x^2$\n\\begin{figure*}[t]\nall\n\\end{figure*}\n\\emph{b}"))
    return t["nation"].select(F.col("n_nationkey").alias("id"), F.regexp_replace(papers.tex_text(tex), r"\n\n+", "\n").alias("said"))


@query("""SELECT doc_id, concat('is < ', doc_id, ' here', chr(10), '> x') AS said FROM documents""")
def comparisons_joined(t: Relations) -> DataFrame:
    said = F.concat(F.lit("is <  \n "), F.col("doc_id").cast("string"), F.lit(" here\n> x"))
    return t["documents"].select("doc_id", papers.split_comparisons_joined(said).alias("said"))


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN concat('L0', chr(10), n_name, chr(10), 'L2', chr(10), chr(10), 'R0', chr(10), 'R1', chr(10), 'R2') ELSE concat('L0', chr(10), 'R0', chr(10), n_name, chr(10), 'R1', chr(10), 'L2', chr(10), 'R2') END AS said FROM nation""")
def columns_in_order(t: Relations) -> DataFrame:
    """Two columns with a gap between, and without one."""
    block = lambda x, y, s: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(y)).alias("y0"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(x + 80.0)).otherwise(F.lit(x + 115.0)).alias("x1"), F.lit(y + 5.0).alias("y1"), s.alias("text"))
    blocks = [block(110 * side, 10 * row, F.col("n_name") if side == 0 and row == 1 else F.lit(f"{'LR'[side]}{row}")) for side in (1, 0) for row in (2, 0, 1)]
    pages = t["nation"].select("n_nationkey", F.array(*blocks).alias("blocks"), F.lit(200.0).alias("width"))
    return pages.select(F.col("n_nationkey").alias("id"), papers.read_in_order("blocks", "width").alias("said"))

@query(why="line repairs in sequence; tests hold each against expected lines")
def clean_texts(t: Relations) -> DataFrame:
    return t["documents"].select("doc_id", lines.cleaned("text").alias("text"))


@query(f"""
    WITH a AS (SELECT item_id, list_distinct({TOKENS.format("text")}) AS x FROM benchmark), b AS (SELECT doc_id, list_distinct({TOKENS.format("text")}) AS y FROM documents)
    SELECT item_id, doc_id FROM a, b WHERE len(x) > 0 AND list_has_all(y, x)""")
def token_containment(t: Relations) -> DataFrame:
    items = t["benchmark"].select("item_id", text.title_tokens(F.col("text")).alias("tokens"))
    return search.contained(items, t["documents"].select("doc_id", text.title_tokens(F.col("text")).alias("tokens")))


@query(f"""
    WITH p AS (SELECT item_id, cluster_id, m.source_id, published_at, fetched_at, canonical_title, title, updated_at FROM members m JOIN items i ON i.id = m.item_id JOIN clusters c ON c.id = m.cluster_id),
    x AS (SELECT *, list_distinct({TOKENS.format("title")}) AS a, list_distinct({TOKENS.format("canonical_title || ' ' || title || ' extra'")}) AS b, abs(epoch(coalesce(published_at, fetched_at)) - epoch(updated_at)) / 86400.0 AS d FROM p)
    SELECT item_id, cluster_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard,
        round(CASE WHEN len(list_intersect(a, b)) >= 2 AND len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.42 THEN
            0.65 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 0.25 * exp(-d / 7) + 0.10 * least(len(list_intersect(a, b)) / 6.0, 1.0) + CASE WHEN source_id % 2 = 0 THEN 0.0 ELSE 0.04 END END, 6) AS score FROM x""")
def candidate_scores(t: Relations) -> DataFrame:
    # titles become tokens before they are joined, once each; the tokens of joined titles are the union of theirs
    i = t["items"].select(F.col("id").alias("item_id"), text.title_tokens(F.col("title")).alias("a"), F.coalesce("published_at", "fetched_at").alias("at"))
    c = t["clusters"].select(F.col("id").alias("cluster_id"), text.title_tokens(F.concat("canonical_title", F.lit(" extra"))).alias("c"), "updated_at")
    x = t["members"].select("item_id", "cluster_id", "source_id").join(i, "item_id").join(c, "cluster_id").withColumn("b", F.array_union("c", "a"))
    jac, overlap = scores.jaccard(F.col("a"), F.col("b")), F.size(F.array_intersect("a", "b"))
    score = scores.candidate(jac, overlap, scores.time_proximity(F.col("at"), F.col("updated_at")), F.col("source_id") % 2 == 0)
    return x.select("item_id", "cluster_id", F.round(jac, 6).alias("jaccard"), F.round(score, 6).alias("score"))


STEM = """CASE WHEN regexp_matches(w, '[^aeiou]ies$') AND length(w) > 4 THEN left(w, length(w) - 3) || 'y' WHEN regexp_matches(w, '(s|x|z|ch|sh)es$') AND length(w) > 4 THEN left(w, length(w) - 2)
    WHEN regexp_matches(w, '[^su]s$') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"""
LEX = f"list_transform(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains([{STOP}], w)), lambda w: {STEM})"


@query(f"""
    WITH l AS (SELECT doc_id, {LEX} AS l FROM documents), p AS (SELECT doc_id, len(l) AS size, unnest(l) AS x FROM l), q AS (SELECT doc_id, size, x, count(*) AS tf FROM p WHERE x IN ('on', 'rely', 'had') OR x IN ('ha', 'not') GROUP BY doc_id, size, x)
    SELECT doc_id, round(sum(1.0E0 - 1.0E0 / (1 + tf)) / (1 + ln(1 + max(size))), 6) AS rank FROM q WHERE x IN ('ha', 'rely') GROUP BY doc_id HAVING count(*) = 2
    ORDER BY rank DESC, doc_id LIMIT 50""")
def lexical_search(t: Relations) -> DataFrame:
    return search.match(search.postings(t["documents"], "doc_id", "text", "the HA of relies"), "doc_id", "the HA of relies")


@query("""SELECT c.id, canonical_title, i.id AS item_id FROM clusters c JOIN members m ON m.cluster_id = c.id JOIN items i ON i.id = m.item_id WHERE c.status = 'active' AND i.arxiv_id = '2401.10022'""")
def identifier_search(t: Relations) -> DataFrame:
    return search.by_identifier(t["items"], t["members"], t["clusters"], "arxiv_id", "2401.10022")


@query("""
    WITH g AS (SELECT doc_id, list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower(title), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS a FROM titles),
    q AS (SELECT list_distinct(flatten(list_transform(['the', 'and', 'that', 'er'], lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3))))) AS b)
    SELECT doc_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM g, q WHERE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) >= 0.2 ORDER BY similarity DESC, doc_id LIMIT 20""")
def trigram_search(t: Relations) -> DataFrame:
    return search.similar(t["titles"], "doc_id", "title", "The and, that er", least=0.2)


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS similarity FROM embeddings ORDER BY similarity DESC, vec_id LIMIT 10""")
def vector_topk(t: Relations) -> DataFrame:
    q = t["embeddings"].where("vec_id = 3").first().embedding
    return search.nearest(t["embeddings"], "vec_id", "embedding", q)


@query("""
    SELECT query, vec_id, similarity FROM (SELECT query, vec_id, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rn FROM (
        SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)) WHERE rn <= 5""")
def vector_neighbours(t: Relations) -> DataFrame:
    return search.nearest_to_each(t["embeddings"], t["embeddings"].where("vec_id % 50 = 0"), "vec_id", "embedding")


@query(why="an ordered greedy loop; a test holds it against a plain model")
def greedy_clusters(t: Relations) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600)
    ident = F.when(F.col("doc_id") % 40 == 0, F.concat(F.lit("id"), (F.col("doc_id") % 400).cast("string")))
    return clustering.cluster(t["titles"].select(F.col("doc_id").alias("item_id"), at.alias("at"), F.col("source").alias("source_id"), "title", ident.alias("ident")))


@query("""
    WITH al AS (SELECT * FROM (VALUES (1, 'the'), (2, 'of'), (3, 'der'), (4, 'les'), (5, 'las')) v(topic_id, word)),
    w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9]+')) AS word FROM documents),
    s AS (SELECT doc_id, topic_id, CAST(least(1.0, 0.5 + 0.1 * count(*)) AS double) AS score FROM w JOIN al USING (word) GROUP BY doc_id, topic_id)
    SELECT doc_id, topic_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, topic_id) AS rn FROM s WHERE score >= 0.6) WHERE rn <= 3""")
def alias_tagging(t: Relations) -> DataFrame:
    alias = t.spark.createDataFrame([(1, "The"), (2, "of"), (3, "der"), (4, "les"), (5, "las")], "id int, alias string")
    return topics.match_aliases(t["documents"], alias, "doc_id", "text").withColumn("score", F.round("score", 6))
