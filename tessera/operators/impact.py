"""Thresholds, labels and reports of the impact model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scores
from tessera.operators.percentiles import percentiles

DEFAULT = 0.95
LOOK_BACK = 180
RATE_BAND = (0.007, 0.013)


def age_bucket(days: Column) -> Column:
    return F.when(days <= 30, "0_30d").when(days <= 90, "31_90d").otherwise("91_365d")


def thresholds(rows: DataFrame, score: str, topic: str, age: str, least: int = 100, q: float = 0.99, history: DataFrame | None = None) -> DataFrame:
    """rows with threshold and bucket: the percentile of (topic, age) where it has enough rows, else of age, else of all.

    Percentiles are those of ``history`` where it is given (see ``looked_back``). They are exact, and found when this is called (see ``percentiles``).
    """
    found = percentiles(rows if history is None else history, [[topic, age], [age], []], score, q)
    of = lambda k, *keys: found.where(F.col("g.level") == k - 1).select(*[F.col(f"g.{c}").alias(c) for c in keys], F.col("n").alias(f"__n{k}"), F.col("q").alias(f"__q{k}"))
    # of all: one row or none, so this is a broadcast of a constant
    out = rows.join(of(1, topic, age), [topic, age], "left").join(of(2, age), age, "left").join(F.broadcast(of(3)), F.lit(True), "left")
    enough = [F.col("__n1") >= least, F.col("__n2") >= least, F.col("__n3") > 0]
    pick = lambda *x: F.when(enough[0], x[0]).when(enough[1], x[1]).when(enough[2], x[2]).otherwise(x[3])
    out = out.withColumn("threshold", pick(F.col("__q1"), F.col("__q2"), F.col("__q3"), F.lit(DEFAULT)))
    out = out.withColumn("bucket", pick(F.lit("topic_age"), F.lit("age_global"), F.lit("global"), F.lit("default")))
    return out.drop("__n1", "__q1", "__n2", "__q2", "__n3", "__q3")


def looked_back(rows: DataFrame, assessed: str, now: Column, days: int = LOOK_BACK) -> DataFrame:
    """Rows assessed within the days before now."""
    return rows.where((F.col(assessed) >= now.cast("timestamp") - F.make_dt_interval(F.lit(days))) & (F.col(assessed) <= now))


def labels(rows: DataFrame, score: str, topic: str, age: str, least: int = 100) -> DataFrame:
    """rows (with eligible, confidence, evidence) with threshold and label. All scores are computed before thresholds are."""
    final = F.when(F.col("eligible"), F.col(score))
    qualified = rows.agg(F.count_if(scores.absolute_high(final, F.col("confidence"), F.col("evidence"))).alias("__set"))
    out = thresholds(rows, score, topic, age, least).withColumn("threshold", F.round("threshold", 6)).crossJoin(F.broadcast(qualified))
    return out.withColumn("label", scores.passes_gates(final, F.col("confidence"), F.col("evidence"), F.col("threshold"), F.col("__set"))).drop("__set")


def near_misses(rows: DataFrame, score: str, topic: str, age: str, least: int, most: int) -> DataFrame:
    """Eligible rows below their threshold, the nearest first."""
    key = rows.columns[0]
    out = thresholds(rows, score, topic, age, least).where("eligible").withColumn("gap", F.round(F.col("threshold") - F.col(score), 6))
    return out.where(F.col(score) < F.round("threshold", 6)).orderBy("gap", key).limit(most)


def rate_windows(rows: DataFrame, now: Column, days: tuple[int, ...]) -> DataFrame:
    """For each look-back: eligible rows, labelled rows, their rate and whether it is in the guard band."""
    age = scores.seconds_between(now, F.col("ts"))
    wide = rows.select("label", F.explode(F.filter(F.array(*[F.lit(d).cast("long") for d in days]), lambda d: age <= d * 86400)).alias("days"))
    out = wide.groupBy("days").agg(F.count("*").alias("eligible"), F.count_if("label").alias("labelled"))
    out = out.withColumn("rate", F.round(F.col("labelled") / F.col("eligible"), 6))
    return out.withColumn("in_band", F.col("rate").between(*RATE_BAND))
