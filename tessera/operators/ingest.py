"""Around ingestion: which feeds are due, how they fare, which text of an item is best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a better origin of a text adds to its quality. Fixed values.
BONUS = {"eprint": 0.18, "html": 0.12, "pdf": 0.08}


def due_feeds(feeds: DataFrame, sources: DataFrame, age_minutes: Column, every: Column, most: int, force: bool = False) -> DataFrame:
    """Feeds of active sources not fetched within their interval, never fetched ones first, then the oldest."""
    own = feeds.join(sources.where("active").select(F.col("id").alias("__s")), feeds.source_id == F.col("__s"), "left_semi")
    if not force:
        own = own.where(F.coalesce(age_minutes >= every, F.lit(True)))
    return own.orderBy(age_minutes.desc_nulls_first(), "id").limit(most)


def feed_health(feeds: DataFrame, results: DataFrame) -> DataFrame:
    """feeds with the results (id, ok, status) of a run: a success resets the error streak, a failure adds to it.

    Each row of feeds stays one row: of an id's results one counts, a success before a failure, then the least status.
    """
    one = results.groupBy("id").agg(F.min(F.struct(F.when(F.col("ok"), 0).when(~F.col("ok"), 1).otherwise(2).alias("k"), "ok", "status")).alias("r"))
    r = one.select(F.col("id").alias("__id"), "r.ok", F.col("r.status").alias("__status"))
    out = feeds.join(r, feeds.id == F.col("__id"), "left")
    streak = F.when(F.col("ok"), 0).when(~F.col("ok"), F.coalesce("error_streak", F.lit(0)) + 1).otherwise(F.col("error_streak"))
    return out.withColumn("error_streak", streak).withColumn("last_status", F.col("__status")).drop("__id", "ok", "__status")


def best_text(candidates: DataFrame, key: str, quality: Column, origin: Column) -> DataFrame:
    """Of an item's texts (column place: the order of trying) the one of greatest quality and bonus, the first at a tie."""
    bonus = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in BONUS.items() for x in kv]), origin), F.lit(0.0))
    order = Window.partitionBy(key).orderBy(F.col("__score").desc(), "place")
    scored = candidates.withColumn("__score", F.round(quality + bonus, 6))
    return scored.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").withColumnRenamed("__score", "score").drop("__rn")


def rebuild_text(index: DataFrame, key: str) -> DataFrame:
    """(key, text) from an inverted index (key, word, positions): words by position."""
    places = index.select(key, "word", F.explode("positions").alias("at"))
    return places.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))


def open_access(answer: Column) -> Column:
    """array<struct<url, kind>> of a location service's JSON answer: the best location first, PDFs and pages, each once."""
    place = "struct<url_for_pdf:string,url_for_landing_page:string>"
    parsed = F.from_json(answer, f"is_oa boolean, best_oa_location {place}, oa_locations array<{place}>")
    every = F.concat(F.array(parsed["best_oa_location"]), F.coalesce(parsed["oa_locations"], F.array().cast(f"array<{place}>")))
    pair = lambda url, kind: F.struct(url.alias("url"), F.lit(kind).alias("kind"))
    flat = F.flatten(F.transform(every, lambda x: F.array(pair(x["url_for_pdf"], "pdf"), pair(x["url_for_landing_page"], "page"))))
    return F.when(parsed["is_oa"], F.array_distinct(F.filter(flat, lambda x: x["url"].isNotNull() & (x["url"] != "")))).otherwise(F.array().cast("array<struct<url:string,kind:string>>"))


def run_totals(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """One row: rows seen, keys inserted, keys updated."""
    keys = batch.groupBy(key).agg(F.count("*").alias("n"))
    known = stored.select(F.col(key).alias("__k")).distinct()
    met = keys.join(known, keys[key] == F.col("__k"), "left")
    total = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return met.agg(total(F.sum("n")).alias("seen"), F.count_if(F.col("__k").isNull()).alias("inserted"), F.count_if(F.col("__k").isNotNull()).alias("updated"))
