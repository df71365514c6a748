"""What editors do, and what it leaves behind: assignments, statuses, an update log, an audit log.

Logs are appended: an operator returns the rows to append. log: cluster_id, change_type, summary, diff (JSON), supporting (array of
item ids). actions: action_type, target_kind, target_id, notes, payload (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import governance
from tessera.operators.feeds import newest
from tessera.operators.merge import merge

NO_ITEMS = "array<string>"
EVIDENCE = ("peer_reviewed", "preprint", "report")


def action_rows(targets: DataFrame, action_type: str, kind: str, target: Column, payload: Column | None = None, notes: Column | None = None) -> DataFrame:
    """A row of the audit log for each row of targets."""
    return targets.select(F.lit(action_type).alias("action_type"), F.lit(kind).alias("target_kind"), target.cast("string").alias("target_id"), (notes if notes is not None else F.lit(None)).cast("string").alias("notes"), (payload if payload is not None else F.lit("{}")).alias("payload"))


def log_rows(rows: DataFrame, cluster: Column, change_type: str, summary: Column, diff: Column | None = None, supporting: Column | None = None) -> DataFrame:
    """A row of the update log for each row."""
    none = F.array().cast(NO_ITEMS)
    return rows.select(cluster.alias("cluster_id"), F.lit(change_type).alias("change_type"), summary.alias("summary"), (diff if diff is not None else F.lit("{}")).alias("diff"), (supporting if supporting is not None else none).alias("supporting"))


def json_of(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.cast("string").alias(k) for k, v in fields.items()]))


def set_by_editor(current: DataFrame, wanted: DataFrame, key: str, replace: bool = False) -> DataFrame:
    """Assignments (cluster_id, key, score, source, locked) with an editor's (cluster_id, key, score, locked; null: 1 and true) set.

    With replace the other assignments of the clusters named in wanted go.
    """
    own = wanted.select("cluster_id", key, F.coalesce("score", F.lit(1.0)).alias("score"), F.lit("editor").alias("source"), F.coalesce("locked", F.lit(True)).alias("locked"))
    base = current.join(wanted.select("cluster_id").distinct(), "cluster_id", "left_anti").select(*current.columns) if replace else current
    return merge(base, own, ["cluster_id", key])


def touched(clusters: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """clusters with updated_at set where their id is among ids (cluster_id)."""
    hit = ids.select(F.col("cluster_id").alias("__c")).distinct()
    return clusters.join(hit, clusters.id == F.col("__c"), "left").withColumn("updated_at", F.when(F.col("__c").isNotNull(), now.cast(dict(clusters.dtypes)["updated_at"])).otherwise(F.col("updated_at"))).drop("__c")


def assign(current: DataFrame, wanted: DataFrame, scope: DataFrame, source: str, replace_all: bool = False) -> dict[str, DataFrame]:
    """Automatic assignments of the clusters in scope (cluster_id): unlocked ones not wanted go (of this source alone unless replace_all),
    wanted ones are set where not locked. Returns them and the clusters that changed.
    """
    w = wanted.select("cluster_id", "topic_id", F.col("score").alias("__score"), F.lit(True).alias("__w"))
    s = scope.select("cluster_id", F.lit(True).alias("__s")).distinct()
    both = current.join(w, ["cluster_id", "topic_id"], "full").join(s, "cluster_id", "left")
    owned = F.lit(True) if replace_all else F.col("source") == source
    there, asked, mine = F.col("locked").isNotNull(), F.coalesce("__w", F.lit(False)), F.coalesce("__s", F.lit(False))
    gone = mine & there & ~F.col("locked") & ~asked & owned
    taken = mine & asked & ~F.coalesce("locked", F.lit(False))
    state = both.withColumn("__gone", F.coalesce(gone, F.lit(False))).withColumn("__set", taken)
    kept = state.where(~F.col("__gone") & (there | F.col("__set")))
    value = lambda c, new: F.when(F.col("__set"), new).otherwise(F.col(c)).alias(c)
    out = kept.select("cluster_id", "topic_id", value("score", F.col("__score")), value("source", F.lit(source)), F.coalesce("locked", F.lit(False)).alias("locked"))
    return {"cluster_topics": out, "changed": state.where(F.col("__gone") | F.col("__set")).select("cluster_id").distinct()}


def without_automatic(cluster_topics: DataFrame) -> DataFrame:
    """Assignments but for the automatic unlocked ones."""
    return cluster_topics.where(F.col("locked") | (F.col("source") != "auto"))


def merge_clusters(clusters: DataFrame, members: DataFrame, cluster_topics: DataFrame, redirects: DataFrame, pairs: DataFrame, now: Column) -> dict[str, DataFrame]:
    """governance.merge_clusters, and rows of both logs for each pair."""
    out = governance.merge_clusters(clusters, members, cluster_topics, redirects, pairs, now)
    summary = F.concat(F.lit("Merged cluster "), F.col("from_id").cast("string"), F.lit(" into this story."))
    moved = json_of(from_cluster_id=F.col("from_id"))
    return out | {"log": log_rows(pairs, F.col("to_id"), "merge", summary, moved), "actions": action_rows(pairs, "merge_cluster", "cluster", F.col("to_id"), moved)}


def split_cluster(clusters: DataFrame, members: DataFrame, source: int, new_id: int, chosen: Column, now: Column, title: str | None = None) -> dict[str, DataFrame]:
    """governance.split_cluster with the new cluster active under a title, and rows of both logs."""
    out = governance.split_cluster(clusters, members, source, new_id, chosen, now)
    own = F.col("id") == new_id
    named = out["clusters"].withColumn("status", F.when(own, "active").otherwise(F.col("status"))).withColumn("canonical_title", F.when(own, title or "Split cluster").otherwise(F.col("canonical_title")))
    moved = members.where((F.col("cluster_id") == source) & chosen).agg(F.count("*").alias("n"))
    first = log_rows(moved, F.lit(source), "split", F.concat(F.lit("Split out "), F.col("n").cast("string"), F.lit(" items into a new story.")), json_of(new_cluster_id=F.lit(new_id)))
    second = log_rows(moved, F.lit(new_id), "split", F.lit(f"Created from a split of {source}."), json_of(source_cluster_id=F.lit(source)))
    return out | {"clusters": named, "log": first.union(second), "actions": action_rows(moved, "split_cluster", "cluster", F.lit(source), json_of(new_cluster_id=F.lit(new_id)))}


def set_status(clusters: DataFrame, ids: DataFrame, status: str, change_type: str, now: Column, notes: str | None = None) -> dict[str, DataFrame]:
    """clusters with a status set for ids (cluster_id), and rows of both logs. change_type: quarantine or unquarantine."""
    hit = clusters.join(ids.select(F.col("cluster_id").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("cluster_id"))
    named = hit.select(F.col("cluster_id").alias("__h"))
    out = touched(clusters, hit, now).join(named, F.col("id") == F.col("__h"), "left").withColumn("status", F.when(F.col("__h").isNotNull(), status).otherwise(F.col("status"))).drop("__h")
    return {"clusters": out, "log": log_rows(hit, F.col("cluster_id"), change_type, F.lit(notes or change_type)), "actions": action_rows(hit, f"{change_type}_cluster", "cluster", F.col("cluster_id"), notes=F.lit(notes))}


def merge_entity(follows: DataFrame, links: DataFrame, aliases: DataFrame, edges: DataFrame, redirects: DataFrame, from_id: int, to_id: int) -> dict[str, DataFrame]:
    """One entity's follows, links and aliases moved to another, which keeps its own; its edges point there; it redirects."""

    def moved(table: DataFrame, key: str) -> DataFrame:
        own = F.col("entity_id") == from_id
        stay, come = table.where(~own), table.where(own).withColumn("entity_id", F.lit(to_id).cast(dict(table.dtypes)["entity_id"]))
        return stay.unionByName(come.join(stay, [key, "entity_id"], "left_anti").select(*table.columns))

    pointed = lambda c: F.when(F.col(c) == from_id, F.lit(to_id)).otherwise(F.col(c)).alias(c)
    row = redirects.sparkSession.createDataFrame([(from_id, to_id)], "from_id long, to_id long")
    return {
        "follows": moved(follows, "user_id"), "links": moved(links, "cluster_id"), "aliases": moved(aliases, "alias"),
        "edges": edges.select(*[pointed(c) if c in ("from_id", "to_id") else F.col(c) for c in edges.columns]), "redirects": merge(redirects, row, ["from_id"]),
    }


def quarantine_untaggable(clusters: DataFrame, members: DataFrame, texts: DataFrame, cluster_topics: DataFrame, now: Column, least: int = 100, most: int = 500) -> dict[str, DataFrame]:
    """The newest clusters that can't be tagged, quarantined, and their reasons."""
    found = governance.untaggable(clusters, members, texts, cluster_topics, least)
    first = found.join(clusters.select("id", "updated_at"), "id").orderBy(newest("updated_at"), "id").limit(most).select(F.col("id").alias("cluster_id"), "reason")
    return {"clusters": set_status(clusters, first, "quarantined", "quarantine", now)["clusters"], "reasons": first}


def with_ids(items: DataFrame, title: Column, url: Column) -> DataFrame:
    """items with arxiv_id and doi filled from their title and URL where missing."""
    both = F.concat_ws(" ", title, url)
    return items.withColumn("arxiv_id", F.coalesce("arxiv_id", text.arxiv_id(both, named=True))).withColumn("doi", F.coalesce("doi", text.doi(both, trimmed=False)))


def upsert_search_docs(stored: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Search texts (cluster_id, search_text, updated_at) replaced by fresh ones (cluster_id, search_text)."""
    return merge(stored, fresh.withColumn("updated_at", now.cast(dict(stored.dtypes)["updated_at"])), ["cluster_id"])


def evidence_log(added: DataFrame) -> DataFrame:
    """Rows of the update log for added members (cluster_id, item_id, title, content_type, source_id) that are evidence."""
    strong = added.where(F.col("content_type").isin(*EVIDENCE))
    diff = json_of(item_id=F.col("item_id"), content_type=F.col("content_type"), source_id=F.col("source_id"))
    return log_rows(strong, F.col("cluster_id"), "new_evidence", F.concat(F.lit("New evidence added: "), F.col("title")), diff, F.array(F.col("item_id").cast("string")))


def add_lineage_edges(edges: DataFrame, fresh: DataFrame) -> dict[str, DataFrame]:
    """edges with fresh ones (from_id, to_id, relation, evidence: array of item ids), and their actions; one without evidence is an error."""
    checked = fresh.withColumn("relation", F.when(F.coalesce(F.size("evidence"), F.lit(0)) > 0, F.col("relation")).otherwise(F.raise_error(F.lit("an edge needs evidence")).cast("string")))
    return {"edges": edges.unionByName(checked.select(*edges.columns)), "actions": action_rows(checked, "create_lineage_edge", "edge", F.concat_ws(">", "from_id", "to_id"), json_of(relation=F.col("relation")))}


def audit_page(log: DataFrame, action_type: str | None = None, kind: str | None = None, target: str | None = None, size: int = 20, offset: int = 0) -> DataFrame:
    """A page of the audit log, newest first, each row with the number of all that match."""
    hit = log
    for column, value in (("action_type", action_type), ("target_kind", kind), ("target_id", target)):
        hit = hit.where(F.col(column) == value) if value is not None else hit
    total = F.broadcast(hit.agg(F.count("*").alias("total")))
    shown = hit.orderBy(newest("created_at"), "id").offset(offset).limit(size)
    return shown.crossJoin(total)


def feedback_page(reports: DataFrame, status: str | None = None, size: int = 20, number: int = 1) -> DataFrame:
    hit = reports.where(F.col("status") == status) if status else reports
    return hit.orderBy(newest("created_at"), "id").offset((number - 1) * size).limit(size)


def seed_rows(seed: Column) -> tuple[Column, Column]:
    """Categories and subtopics of a seed's JSON, spaces collapsed, nameless ones dropped."""
    parsed = F.from_json(seed, "categories array<struct<name:string,description_short:string,aliases:array<string>>>, subtopics array<struct<name:string,category:string,aliases:array<string>>>")
    aliases = lambda x: F.filter(F.transform(F.coalesce(x["aliases"], F.array().cast("array<string>")), text.squeeze), lambda a: a != "")
    named = lambda x, *fields: F.forall(F.array(*[F.coalesce(text.squeeze(x[f]), F.lit("")) for f in fields]), lambda v: v != "")
    categories = F.transform(F.filter(parsed["categories"], lambda x: named(x, "name")), lambda x: F.struct(text.squeeze(x["name"]).alias("name"), text.squeeze(x["description_short"]).alias("description"), aliases(x).alias("aliases")))
    subtopics = F.transform(F.filter(parsed["subtopics"], lambda x: named(x, "name", "category")), lambda x: F.struct(text.squeeze(x["name"]).alias("name"), text.squeeze(x["category"]).alias("category"), aliases(x).alias("aliases")))
    return categories, subtopics


def seed_topics(topics: DataFrame, categories: DataFrame, subtopics: DataFrame) -> dict[str, DataFrame]:
    """Topics (name, description, aliases, parent: the category's name) with a seed upserted by name, and counts.

    Subtopics whose category the seed lacks are skipped; a subtopic keeps its description.
    """
    top = categories.select("name", "description", "aliases", F.lit(None).cast("string").alias("parent"))
    sub = subtopics.join(categories.select(F.col("name").alias("category")), "category", "left_semi").select("name", "aliases", F.col("category").alias("parent"))
    known = topics.select("name", F.lit(True).alias("known"))
    count = lambda rows, kind: rows.join(known, "name", "left").agg(F.lit(kind).alias("kind"), F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if(F.col("known").isNotNull()).alias("updated"))
    return {"topics": merge(merge(topics, top, ["name"]), sub, ["name"]), "counts": count(top, "category").union(count(sub, "subtopic"))}


def import_pack(sources: DataFrame, feeds: DataFrame, pack: DataFrame) -> dict[str, DataFrame]:
    """Sources (name, homepage, source_type, active) and feeds (source, url, kind) with a pack upserted: sources by name, feeds by both.

    pack: name, homepage, source_type, active, feeds (array of url, kind); a null active is true.
    """
    own = pack.select("name", "homepage", "source_type", F.coalesce("active", F.lit(True)).alias("active"))
    fed = pack.select(F.col("name").alias("source"), F.explode("feeds").alias("f")).select("source", F.col("f.url").alias("url"), F.coalesce(F.col("f.kind"), F.lit("rss")).alias("kind")).dropDuplicates(["source", "url"])
    return {"sources": merge(sources, own, ["name"]), "feeds": merge(feeds, fed, ["source", "url"])}


def short_search_texts(clusters: DataFrame, docs: DataFrame, least: int = 100, most: int = 1000) -> DataFrame:
    """(id): open clusters whose search text is missing or short, newest first."""
    open_ = clusters.where(F.col("status").isin("active", "pending"))
    met = open_.join(docs.select("cluster_id", "search_text"), open_.id == F.col("cluster_id"), "left")
    return met.where(F.col("search_text").isNull() | (F.length("search_text") < least)).orderBy(newest("updated_at"), "id").limit(most).select("id")


def taggable(clusters: DataFrame, docs: DataFrame, cluster_topics: DataFrame, least: int = 100, most: int = 500) -> DataFrame:
    """(cluster_id, search_text): open clusters without topics whose text is long enough, newest first."""
    open_ = clusters.where(F.col("status").isin("active", "pending")).join(cluster_topics, clusters.id == cluster_topics.cluster_id, "left_anti")
    met = open_.join(docs.where(F.length("search_text") >= least).select("cluster_id", "search_text"), open_.id == F.col("cluster_id"))
    return met.orderBy(newest("updated_at"), "id").limit(most).select("cluster_id", "search_text")


def entity_page(entities: DataFrame, aliases: DataFrame, follows: DataFrame, user_id: int, q: str | None = None, entity_type: str | None = None, size: int = 20, number: int = 1) -> DataFrame:
    """Entities of a type whose name or an alias holds q, by name, with whether the user follows them."""
    hit = entities.where(F.col("entity_type") == entity_type) if entity_type else entities
    if q:
        pattern = f"%{q.strip()}%"
        named = aliases.where(F.col("alias").ilike(pattern)).select(F.col("entity_id").alias("__e")).distinct()
        hit = hit.join(named, hit.id == F.col("__e"), "left").where(F.col("name").ilike(pattern) | F.col("__e").isNotNull()).drop("__e")
    own = follows.where(F.col("user_id") == user_id).select(F.col("entity_id").alias("__f")).distinct()
    return hit.join(own, hit.id == F.col("__f"), "left").withColumn("is_followed", F.col("__f").isNotNull()).drop("__f").orderBy("name", "id").offset((number - 1) * size).limit(size)


def entity_stories(clusters: DataFrame, cluster_entities: DataFrame, most: int = 20) -> DataFrame:
    """(entity_id, cluster_id, rn): the newest active clusters of each entity."""
    met = cluster_entities.select("entity_id", "cluster_id").join(clusters.where("status = 'active'").select(F.col("id").alias("cluster_id"), "updated_at"), "cluster_id")
    return met.withColumn("rn", F.row_number().over(Window.partitionBy("entity_id").orderBy(newest("updated_at"), "cluster_id"))).where(F.col("rn") <= most).select("entity_id", "cluster_id", "rn")


def followed_entities(follows: DataFrame, entities: DataFrame) -> DataFrame:
    """(user_id, id, name, rn): what each user follows, by name."""
    met = follows.join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    return met.select("user_id", F.col("entity_id").alias("id"), "name", F.row_number().over(Window.partitionBy("user_id").orderBy("name", "entity_id")).alias("rn"))


def glossary_of(links: DataFrame, entries: DataFrame, most: int = 25) -> DataFrame:
    """(cluster_id, term, rn): each cluster's entries by score, then term."""
    met = links.join(entries.select(F.col("id").alias("entry_id"), "term"), "entry_id")
    return met.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), "term"))).where(F.col("rn") <= most).select("cluster_id", "term", "rn")


def deep_defaults(settings: Column, defaults: dict) -> Column:
    """A struct of the defaults' shape: at each leaf what the JSON settings say, else the default."""
    kinds = {bool: "boolean", int: "int", float: "double", str: "string"}

    def at(path: str, value: object) -> Column:
        if isinstance(value, dict):
            return F.struct(*[at(f"{path}.{k}", v).alias(k) for k, v in value.items()])
        return F.coalesce(F.get_json_object(settings, path).try_cast(kinds[type(value)]), F.lit(value))

    return at("$", defaults)
