"""Lists of items and clusters: filters as semi-joins, order by with the id last, pages as limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Content types in the order in which they are shown. Fixed values.
CONTENT_TYPES = ("news", "press_release", "preprint", "peer_reviewed", "report")
ROLES = ("primary", "supporting", "background")
#: Shards in which a topic's list is ordered before it is ordered as one.
SHARDS = 64


def rank_of(value: Column, order: tuple[str, ...]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(order) for x in (name, k)]), value), F.lit(len(order)))


def page(df: DataFrame, order: list[Column], size: int, number: int = 1) -> DataFrame:
    df = df.orderBy(*order)
    return (df.offset((number - 1) * size) if number > 1 else df).limit(size)


def newest(col: str) -> Column:
    return F.col(col).desc_nulls_last()


def items_feed(items: DataFrame, sources: DataFrame, source_id: int | None = None, source_type: str | None = None, content_type: str | None = None, size: int = 20, number: int = 1) -> DataFrame:
    """Items with their source, newest first."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "source_type")
    for column, value in (("source_id", source_id), ("source_type", source_type)):
        s = s.where(F.col(column) == value) if value is not None else s
    kept = items.where(F.col("content_type") == content_type) if content_type else items
    return page(kept.join(s, "source_id"), [newest("published_at"), newest("fetched_at"), F.col("id")], size, number)


def sources_with_feeds(sources: DataFrame, feeds: DataFrame) -> DataFrame:
    """A row for each source, its feeds as a nested list by url."""
    per = feeds.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("feed_url", "id", "error_streak"))).alias("feeds"))
    out = sources.join(per, sources.id == per.source_id, "left").drop("source_id")
    return out.withColumn("feeds", F.coalesce("feeds", F.array().cast("array<struct<feed_url:string,id:bigint,error_streak:bigint>>")))


def on_topic(cluster_topics: DataFrame, topics: DataFrame, topic_id: int) -> DataFrame:
    """cluster_id of clusters on a topic or on a child of it."""
    wanted = topics.where((F.col("id") == topic_id) | (F.col("parent_id") == topic_id)).select(F.col("id").alias("topic_id"))
    return cluster_topics.join(wanted, "topic_id", "left_semi").select("cluster_id")


def member_items(members: DataFrame, items: DataFrame) -> DataFrame:
    """Members with what of their item filters and badges need."""
    i = items.select(F.col("id").alias("item_id"), "content_type", "published_at", "fetched_at", "image_url", "title")
    return members.join(i, "item_id")


def feed(clusters: DataFrame, members: DataFrame | None = None, items: DataFrame | None = None, sources: DataFrame | None = None, by: str = "updated_at", on: DataFrame | None = None, source_id: int | None = None, source_type: str | None = None, content_type: str | None = None, size: int = 20, number: int = 1) -> DataFrame:
    """Active clusters, filtered, by ``by`` (updated_at or impact_score), newest and then by id."""
    out = clusters.where("status = 'active'")
    if on is not None:
        out = out.join(on, out.id == on.cluster_id, "left_semi")
    if source_id is not None:
        own = members.where(F.col("source_id") == source_id)
        out = out.join(own, out.id == own.cluster_id, "left_semi")
    if source_type is not None:
        own = members.join(sources.where(F.col("source_type") == source_type), members.source_id == sources.id, "left_semi")
        out = out.join(own, out.id == own.cluster_id, "left_semi")
    if content_type is not None:
        own = members.join(items.where(F.col("content_type") == content_type), members.item_id == items.id, "left_semi")
        out = out.join(own, out.id == own.cluster_id, "left_semi")
    order = [newest("updated_at"), F.col("id")] if by == "updated_at" else [newest(by), newest("updated_at"), F.col("id")]
    return page(out, order, size, number)


def content_types(members: DataFrame, items: DataFrame) -> DataFrame:
    """(cluster_id, content_types): distinct types of a cluster in the order in which they are shown."""
    of = members.join(items.select(F.col("id").alias("item_id"), "content_type"), "item_id")
    ranked = F.array_sort(F.collect_set(F.struct(rank_of(F.col("content_type"), CONTENT_TYPES).alias("r"), F.col("content_type").alias("t"))))
    return of.groupBy("cluster_id").agg(F.transform(ranked, lambda x: x["t"]).alias("content_types"))


def breakdown(members: DataFrame, items: DataFrame) -> DataFrame:
    """(cluster_id, content_type, n)."""
    return members.join(items.select(F.col("id").alias("item_id"), "content_type"), "item_id").groupBy("cluster_id", "content_type").agg(F.count("*").alias("n"))


def evidence(members: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """The first members of each cluster by role, then newest, ``rn`` from 1."""
    order = Window.partitionBy("cluster_id").orderBy(rank_of(F.col("role"), ROLES), newest("published_at"), "item_id")
    return member_items(members, items).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def latest(col: str) -> tuple[Column, Column]:
    """A time as two fields that order it from the newest, null last."""
    return F.col(col).isNull().alias(f"no_{col}"), (-F.coalesce(F.unix_micros(F.col(col).cast("timestamp")), F.lit(0))).alias(f"minus_{col}")


def featured_image(members: DataFrame, items: DataFrame) -> DataFrame:
    """(cluster_id, image_url): that of the newest member that has one."""
    best = F.min_by("image_url", F.struct(*latest("published_at"), *latest("fetched_at"), "item_id"))
    return member_items(members, items).where("image_url IS NOT NULL").groupBy("cluster_id").agg(best.alias("image_url"))


def cards(clusters: DataFrame, cluster_topics: DataFrame, topics: DataFrame, badges: DataFrame, images: DataFrame, most: int = 5) -> DataFrame:
    """Clusters with top topics, badges and image, from pre-aggregated sides. A cluster without members has no badges, an empty list."""
    order = Window.partitionBy("cluster_id").orderBy(F.col("score").desc(), "topic_id")
    top = cluster_topics.join(clusters, cluster_topics.cluster_id == clusters.id, "left_semi").withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    named = top.join(topics.select(F.col("id").alias("topic_id"), "name"), "topic_id").groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]).alias("topics"))
    out = clusters
    for side in (named, badges, images):
        out = out.join(side.withColumnRenamed("cluster_id", "__c"), out.id == F.col("__c"), "left").drop("__c")
    return out.withColumn("content_types", F.coalesce("content_types", F.array().cast("array<string>")))


def kept_by(clusters: DataFrame, marks: DataFrame, user_id: int | None = None, most: int = 200) -> DataFrame:
    """Active clusters that a user has saved or watches, in the order of saving, newest first; each user's where none is given."""
    own = marks if user_id is None else marks.where(F.col("user_id") == user_id)
    met = own.join(clusters.where("status = 'active'").select(F.col("id").alias("cluster_id"), "canonical_title"), "cluster_id")
    order = Window.partitionBy("user_id").orderBy(newest("created_at"), "cluster_id")
    return met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def followed_topics(follows: DataFrame, topics: DataFrame) -> DataFrame:
    """(user_id, topic_id), once each: followed topics and their children."""
    wide = follows.join(topics.select("id"), follows.topic_id == F.col("id")).select("user_id", "topic_id")
    below = follows.select("user_id", F.col("topic_id").alias("parent_id")).join(topics.where("parent_id IS NOT NULL").select(F.col("id").alias("topic_id"), "parent_id"), "parent_id").select("user_id", "topic_id")
    return wide.union(below).distinct()


def for_you(clusters: DataFrame, cluster_topics: DataFrame, topics: DataFrame, follows: DataFrame, saves: DataFrame, hides: DataFrame, size: int = 20) -> DataFrame:
    """Each user's active clusters: on a followed topic (or a child of it) or saved, and not hidden; the first ``size``.

    Of a topic a user's page holds none but its newest ``size``, and one more for each that the user has hidden on it; so a user
    meets that many places of a topic's list, not all its clusters. Lists are cut in shards first, then whole.
    """
    active = clusters.where("status = 'active'").select(F.col("id").alias("cluster_id"), "updated_at")
    followed = followed_topics(follows, topics)
    hidden = hides.select("user_id", "cluster_id").distinct()
    listed = cluster_topics.select("topic_id", "cluster_id").join(active, "cluster_id").groupBy("topic_id", "cluster_id").agg(F.max("updated_at").alias("updated_at"))
    gone = hidden.join(listed.select("topic_id", "cluster_id"), "cluster_id").join(followed, ["user_id", "topic_id"], "left_semi").groupBy("user_id", "topic_id").agg(F.count("*").alias("gone"))
    wants = followed.join(gone, ["user_id", "topic_id"], "left").select("user_id", "topic_id", (F.coalesce("gone", F.lit(0)) + size).alias("most"))
    longest = wants.groupBy("topic_id").agg(F.max("most").alias("longest"))
    order = [newest("updated_at"), F.col("cluster_id")]
    shard = listed.join(longest, "topic_id").withColumn("shard", F.pmod(F.hash("cluster_id"), F.lit(SHARDS)))
    first = shard.withColumn("place", F.row_number().over(Window.partitionBy("topic_id", "shard").orderBy(*order))).where("place <= longest")
    places = first.withColumn("place", F.row_number().over(Window.partitionBy("topic_id").orderBy(*order))).where("place <= longest").select("topic_id", "place", "cluster_id")
    met = wants.select("user_id", "topic_id", F.explode(F.sequence(F.lit(1), F.col("most").cast("int"))).alias("place")).join(places, ["topic_id", "place"])
    wanted = met.select("user_id", "cluster_id").union(saves.select("user_id", "cluster_id")).distinct().join(hidden, ["user_id", "cluster_id"], "left_anti")
    mine = Window.partitionBy("user_id").orderBy(*order)
    return wanted.join(active, "cluster_id").withColumn("rn", F.row_number().over(mine)).where(F.col("rn") <= size)


def latest_per_cluster(log: DataFrame, most: int) -> DataFrame:
    """The newest entries of each cluster's log."""
    order = Window.partitionBy("cluster_id").orderBy(newest("seq"), "change_type")
    return log.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def resolve(rows: DataFrame, redirects: DataFrame, key: str) -> DataFrame:
    """rows with ``resolved``: where a redirect sends their key, one hop."""
    r = redirects.select(F.col("from_id").alias("__from"), F.col("to_id").alias("__to"))
    return rows.join(r, rows[key] == F.col("__from"), "left").withColumn("resolved", F.coalesce("__to", key)).drop("__from", "__to")


def explainers(text: Column) -> dict[str, Column]:
    """markdown, eli20 and eli5 of a deep dive that is JSON; plain text is the markdown."""
    whole = F.trim(text)
    is_json = whole.startswith("{") & whole.endswith("}")
    field = lambda name: F.when(is_json, F.nullif(F.trim(F.get_json_object(whole, f"$.{name}")), F.lit("")))
    return {"markdown": F.when(is_json, field("markdown")).otherwise(F.nullif(whole, F.lit(""))), "eli20": field("eli20"), "eli5": field("eli5")}
