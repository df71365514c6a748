"""Search: identifiers first, then lexemes, trigrams as a fallback, and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import english, scores, text
from tessera.operators.clustering import kept
from tessera.operators.feeds import newest
from tessera.operators.inverted import InvertedIndex

PART_VECTORS, BLOCK_QUERIES = 20_000, 2_000


def stem(word: Column) -> Column:
    """Plurals dropped."""
    return (
        F.when(word.rlike("[^aeiou]ies$") & (F.length(word) > 4), F.concat(F.left(word, F.length(word) - 3), F.lit("y")))
        .when(word.rlike("(s|x|z|ch|sh)es$") & (F.length(word) > 4), F.left(word, F.length(word) - 2))
        .when(word.rlike("[^su]s$") & (F.length(word) > 3), F.left(word, F.length(word) - 1))
        .otherwise(word)
    )


def lexemes(body: Column) -> Column:
    """Stemmed words of a text in order, stop words dropped."""
    words = F.filter(F.split(F.lower(body), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*text.STOPWORDS))
    return F.transform(words, stem)


def query_lexemes(docs: DataFrame, query: str) -> list[str]:
    return [r.x for r in docs.sparkSession.range(1).select(F.explode(F.array_distinct(lexemes(F.lit(query)))).alias("x")).collect()]


def postings(docs: DataFrame, key: str, body: str, query: str | None = None) -> DataFrame:
    """The inverted index: (lexeme, key, tf, size); with a query only what it looks up.

    A text without the beginning of each lexeme (but for its last letter, which an ending may have changed) is passed over before it is taken apart.
    """
    wanted = query_lexemes(docs, query) if query is not None else []
    low = F.lower(F.col(body))
    for w in wanted:
        docs = docs.where(low.contains(w[:-1]))
    rows = docs.select(key, lexemes(F.col(body)).alias("l"))
    kept = F.filter("l", lambda w: w.isin(wanted)) if query is not None else F.col("l")
    return rows.select(key, F.size("l").alias("size"), F.explode(kept).alias("lexeme")).groupBy("lexeme", key, "size").agg(F.count("*").alias("tf"))


def match(index: DataFrame, key: str, query: str, most: int = 50) -> DataFrame:
    """(key, rank): documents with every lexeme of a query, best first.

    The rank saturates in each lexeme's frequency and
    falls with the logarithm of the document's length.
    """
    wanted = query_lexemes(index, query)
    if not wanted:
        return index.select(key, F.lit(0.0).alias("rank")).limit(0)
    hit = index.where(F.col("lexeme").isin(wanted))
    out = hit.groupBy(key).agg(F.countDistinct("lexeme").alias("n"), F.sum(1.0 - 1.0 / (1.0 + F.col("tf"))).alias("r"), F.max("size").alias("size"))
    rank = F.col("r") / (1.0 + F.log1p("size"))
    return out.where(F.col("n") == len(wanted)).select(key, F.round(rank, 6).alias("rank")).orderBy(F.col("rank").desc(), key).limit(most)


def search_docs(docs: DataFrame, key: str, body: str) -> DataFrame:
    """(key, search_text, lexemes): what full-text search looks up, kept with the documents as their text changes."""
    return docs.select(key, F.col(body).alias("search_text"), english.lexemes(F.col(body)).alias("lexemes"))


def full_text(docs: DataFrame, key: str, query: str, nearness: bool = False) -> DataFrame:
    """(key, rank): of search_docs those with every lexeme of a query.

    The query's lexemes are few and known on the driver; texts without them are filtered out where they lie, and only the places of these
    lexemes reach the rank. A query of stop words alone matches nothing.
    """
    wanted = sorted(english.lexeme_places(query))
    if not wanted:
        return docs.select(key, F.lit(0.0).alias("rank")).limit(0)
    own = F.transform(F.filter("lexemes", lambda x: x["lexeme"].isin(wanted)), lambda x: x["places"])
    hit = docs.select(key, own.alias("__places")).where(F.size("__places") == len(wanted))
    return hit.select(key, (english.rank_by_nearness if nearness else english.rank_by_covers)(F.col("__places")).alias("rank"))


def staged(docs: DataFrame, clusters: DataFrame, items: DataFrame, members: DataFrame, query: str, most: int = 50, few: int = 5, index: InvertedIndex | None = None) -> DataFrame:
    """(id, rank): active clusters for a query: by identifier where it is one, else by full text, else, where that finds few, by trigrams.

    Full text is looked up in ``index`` where one is kept, else in the lexemes of docs. What it finds is written once, as small as it is.

    Which stage answers depends on how many rows the one before found, at most ``few`` of which are looked at.
    """
    q = query.strip()
    active = clusters.where("status = 'active'").select("id", "updated_at")
    order = F.col("rank").desc(), newest("updated_at"), F.col("id").desc()
    kind = {"arxiv": "arxiv_id", "doi": "doi"}.get(text.identifier_of(q)[0] or "")
    if kind and kind in items.columns:
        own = items.where(F.col(kind) == q).select(F.col("id").alias("item_id"))
        met = members.join(own, "item_id", "left_semi").select(F.col("cluster_id").alias("id"), "item_id")
        found = active.join(met, "id").select("id", F.lit(None).cast("double").alias("rank"), "updated_at").orderBy(*order).limit(most)
        if not found.isEmpty():
            return found.select("id", "rank")
    ranked = (index.search(q) if index else full_text(docs, "cluster_id", q)).withColumnRenamed("cluster_id", "id")
    found = kept(active.join(ranked, "id").orderBy(*order).limit(most))
    if found.count() >= few or not q:
        return found.select("id", "rank")
    near = docs.select(F.col("cluster_id").alias("id"), F.round(scores.jaccard(text.trigrams(F.col("search_text")), text.trigrams(F.lit(q))), 6).alias("rank")).where("rank >= 0.3")
    return active.join(near, "id").orderBy(*order).limit(most).select("id", "rank")


def enhanced(docs: DataFrame, clusters: DataFrame, items: DataFrame, members: DataFrame, query: str, most: int = 20, index: InvertedIndex | None = None) -> dict[str, DataFrame]:
    """The first item that a query identifies (``hit``), and active clusters by nearness of its lexemes with their number of items (``clusters``)."""
    named, value = text.identifier_of(query)
    kind = {"arxiv": "arxiv_id", "doi": "doi", "pmid": "pmid"}.get(named or "")
    active = clusters.where("status = 'active'").select("id", "canonical_title", "updated_at")
    own = items.where(F.lower(kind) == value) if kind and kind in items.columns else items.limit(0)
    met = members.select("cluster_id", "item_id").join(own.select(F.col("id").alias("item_id"), F.col("title").alias("item_title")), "item_id").join(active.withColumnRenamed("id", "cluster_id"), "cluster_id")
    ranked = (index.search(query, nearness=True) if index else full_text(docs, "cluster_id", query, nearness=True)).withColumnRenamed("cluster_id", "id")
    first = active.join(ranked, "id").orderBy(F.col("rank").desc(), "id").limit(most)
    sized = members.select("cluster_id", "item_id").join(F.broadcast(first.select(F.col("id").alias("cluster_id"))), "cluster_id").join(items.where("source_id IS NOT NULL").select(F.col("id").alias("item_id")), "item_id")
    counts = sized.groupBy("cluster_id").agg(F.countDistinct("item_id").alias("n"))
    listed = first.join(counts, first.id == counts.cluster_id, "left").select("id", "rank", F.coalesce("n", F.lit(0)).alias("n"))
    return {"hit": met.orderBy("item_id", "cluster_id").limit(1), "clusters": listed}


def by_identifier(items: DataFrame, members: DataFrame, clusters: DataFrame, column: str, value: str, dedupe: bool = False) -> DataFrame:
    """Active clusters with an item of that identifier; once for each such item unless dedupe."""
    own = items.where(F.col(column) == value).select(F.col("id").alias("item_id"))
    met = members.join(own, "item_id", "left_semi").select("cluster_id", "item_id")
    out = clusters.where("status = 'active'").join(met, clusters.id == met.cluster_id).select("id", "canonical_title", "item_id")
    return out.dropDuplicates(["id"]) if dedupe else out


def similar(docs: DataFrame, key: str, body: str, query: str, least: float = 0.3, most: int = 20) -> DataFrame:
    """(key, similarity): texts by shared trigrams with a query."""
    q = text.trigrams(F.lit(query))
    s = scores.jaccard(text.trigrams(F.col(body)), q)
    return docs.select(key, F.round(s, 6).alias("similarity")).where(F.col("similarity") >= least).orderBy(F.col("similarity").desc(), key).limit(most)


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], most: int = 10) -> DataFrame:
    """(key, similarity): the vectors of greatest cosine with one query, exactly."""
    s = scores.cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, F.round(s, 6).alias("similarity")).orderBy(F.col("similarity").desc_nulls_last(), key).limit(most)


def nearest_to_each(vectors: DataFrame, queries: DataFrame, key: str, vector: str, most: int = 5) -> DataFrame:
    """(query, key, similarity): the nearest vectors of each of a stated set of queries, itself left out.

    A block join: vectors lie in parts and queries in blocks of bounded size, a task scores one block against one part as a product of
    matrices and keeps the ``most`` best of each query; these meet by query. Vectors without a norm have similarity 0.
    """
    parts, blocks = (max(1, -(-df.count() // n)) for df, n in ((vectors, PART_VECTORS), (queries, BLOCK_QUERIES)))
    numbered = lambda df, n, name: df.select(key, vector, F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(name))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = numbered(vectors, parts, "part").select("*", every(blocks, "block"))
    right = numbered(queries, blocks, "block").select("*", every(parts, "part"))
    kind = dict(vectors.dtypes)[key]

    def best(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if v.empty or q.empty:
            return pd.DataFrame({"query": [], key: [], "similarity": []})
        unit = lambda m: m / np.where((norm := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, norm)
        ids, asked = v[key].to_numpy(), q[key].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, all_vectors = ids[order], unit(np.array(v[vector].tolist(), np.float64))[order]
        found = []
        for at in range(0, len(asked), 256):
            near = np.round(unit(np.array(q[vector].tolist()[at : at + 256], np.float64)) @ all_vectors.T, 6)
            near[asked[at : at + 256, None] == ids[None, :]] = -np.inf
            # stable, so that of equal ones the least key comes first
            first = np.argsort(-near, axis=1, kind="stable")[:, :most]
            found.append(pd.DataFrame({"query": np.repeat(asked[at : at + 256], first.shape[1]), key: ids[first].ravel(), "similarity": np.take_along_axis(near, first, 1).ravel()}))
        out = pd.concat(found)
        return out[np.isfinite(out["similarity"])]

    scored = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInPandas(best, f"query {kind}, {key} {kind}, similarity double")
    order = Window.partitionBy("query").orderBy(F.col("similarity").desc(), key)
    return scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def contained(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id): items whose tokens a document all has. items: item_id, tokens; docs: doc_id, tokens.

    Items meet documents on their rarest token alone, then the rest is compared, so a common token
    never joins.
    """
    spread = docs.select("doc_id", F.explode("tokens").alias("token"))
    rarity = spread.groupBy("token").agg(F.count("*").alias("df"))
    own = items.select("item_id", F.explode("tokens").alias("token")).join(rarity, "token", "left")
    # a token that no document has rules the item out at once
    pick = own.groupBy("item_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("rare")).where("rare.df > 0")
    probe = pick.select("item_id", F.col("rare.token").alias("token"))
    pairs = probe.join(spread, "token").select("item_id", "doc_id")
    met = pairs.join(items.select("item_id", F.col("tokens").alias("wanted")), "item_id").join(docs.select("doc_id", "tokens"), "doc_id")
    return met.where(F.size(F.array_except("wanted", "tokens")) == 0).select("item_id", "doc_id").distinct()
