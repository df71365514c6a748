"""Notification jobs: what to tell whom, when, and no more often than wanted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import times


#: Jobs that count against a user's day.
COUNTED = ("queued", "sending", "sent")


def day_counts(jobs: DataFrame, prefs: DataFrame) -> DataFrame:
    """(user_id, day, n): jobs that count, by the user's local day of their time."""
    met = jobs.where(F.col("status").isin(*COUNTED)).join(prefs.select("user_id", "zone"), "user_id")
    return met.groupBy("user_id", F.to_date(times.local(F.col("scheduled_for"), F.col("zone"))).alias("day")).agg(F.count("*").alias("n"))


def day_bounds(day: Column, zone: Column) -> tuple[Column, Column]:
    """The UTC times at which a local day begins and ends."""
    start = day.cast("timestamp_ntz").cast("timestamp")
    return F.to_utc_timestamp(start, zone), F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp_ntz").cast("timestamp"), zone)


def cluster_update_jobs(log: DataFrame, watches: DataFrame, prefs: DataFrame, now: Column, existing: DataFrame | None = None) -> DataFrame:
    """(dedupe_key, user_id, cluster_id, seq, scheduled_for, status): a job for each log entry of a watched cluster.

    prefs: user_id, zone, quiet_start, quiet_end (minutes), daily_limit, enabled. Users without prefs get none.
    A user's jobs of one local day, those there already (that are queued or sent) and the new ones by (cluster, seq), stay within
    ``daily_limit``; entries that have a job take no place. Returns existing with the new jobs.
    """
    met = log.select("cluster_id", "seq").join(watches.select("user_id", "cluster_id"), "cluster_id").join(prefs.where("enabled"), "user_id")
    key = F.concat_ws(":", F.lit("update"), "user_id", "cluster_id", "seq")
    jobs = met.withColumn("scheduled_for", times.schedule(now, F.col("zone"), F.col("quiet_start"), F.col("quiet_end"))).withColumn("dedupe_key", key)
    jobs = jobs.withColumn("day", F.to_date(times.local(F.col("scheduled_for"), F.col("zone"))))
    if existing is not None:
        jobs = jobs.join(existing.select("dedupe_key"), "dedupe_key", "left_anti").join(day_counts(existing, prefs).withColumnRenamed("n", "had"), ["user_id", "day"], "left")
    else:
        jobs = jobs.withColumn("had", F.lit(0))
    order = Window.partitionBy("user_id", "day").orderBy("cluster_id", "seq")
    kept = jobs.withColumn("n", F.row_number().over(order)).where(F.coalesce("had", F.lit(0)) + F.col("n") <= F.col("daily_limit"))
    fresh = kept.select("dedupe_key", "user_id", "cluster_id", "seq", "scheduled_for", F.lit("queued").alias("status"))
    return fresh if existing is None else existing.unionByName(fresh)


def topic_digests(follows: DataFrame, cluster_topics: DataFrame, clusters: DataFrame, begin: Column, end: Column, most: int = 50) -> DataFrame:
    """(user_id, n, cluster_ids): active clusters of followed topics (no roll-up) updated in the period, newest first.

    A topic gives a user its newest ``most`` at the most, so users meet those alone.
    """
    fresh = clusters.where((F.col("status") == "active") & (F.col("updated_at") >= begin) & (F.col("updated_at") < end)).select(F.col("id").alias("cluster_id"), "updated_at")
    listed = cluster_topics.select("topic_id", "cluster_id").join(fresh, "cluster_id").select("topic_id", "cluster_id", "updated_at").distinct()
    newest = Window.partitionBy("topic_id").orderBy(F.col("updated_at").desc(), "cluster_id")
    first = listed.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    met = follows.select("user_id", "topic_id").distinct().join(first, "topic_id").select("user_id", "cluster_id", "updated_at").distinct()
    order = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), "cluster_id")
    top = met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    return top.groupBy("user_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "cluster_id"))), lambda x: x["cluster_id"]).alias("cluster_ids"))


def send_due(jobs: DataFrame, now: Column, most: int) -> DataFrame:
    """jobs with the oldest queued ones that are due marked as sent."""
    due = jobs.where((F.col("status") == "queued") & (F.col("scheduled_for") <= now)).orderBy("scheduled_for", "dedupe_key").limit(most).select(F.col("dedupe_key").alias("__k"))
    out = jobs.join(due, jobs.dedupe_key == F.col("__k"), "left")
    return out.withColumn("status", F.when(F.col("__k").isNotNull(), "sent").otherwise(F.col("status"))).drop("__k")
