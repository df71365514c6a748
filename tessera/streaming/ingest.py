"""Feed items as a stream: each micro-batch is upserted into the item table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.functions import payloads, text
from tessera.operators.merge import upsert_items

#: Whole versions of a table that stay.
KEPT = 3


def read_items(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def versions(spark: SparkSession, table: str) -> list[int]:
    """Versions of a table: numbered folders, each whole."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(table)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def current(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    found = versions(spark, table)
    return spark.read.schema(schema).parquet(f"{table}/v{found[-1]}") if found else spark.createDataFrame([], schema)


def drop_version(spark: SparkSession, table: str, number: int) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/v{number}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def upsert_into(table: str, schema: StructType, kept: int = KEPT):
    """A foreachBatch function. Each batch writes the version after the last whole one, whatever its own number.

    An upsert that is run again changes nothing, so neither a batch run twice nor a stream begun anew over the same files (a fresh checkpoint)
    loses or doubles rows. The last ``kept`` versions stay for those who read them.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = versions(spark, table)
        upsert_items(current(spark, table, schema), batch).write.mode("overwrite").parquet(f"{table}/v{before[-1] + 1 if before else 0}")
        for old in before[: -(kept - 1)]:
            drop_version(spark, table, old)

    return run


def ingest(stream: DataFrame, table: str, checkpoint: str, available_now: bool = True, every: str = "180 seconds") -> StreamingQuery:
    """Start the upsert; available_now takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(upsert_into(table, stream.schema)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def parse_entries(entries: DataFrame) -> DataFrame:
    """Feed entries (link, title, summary, published) as items with canonical url, its hash as id, snippet and identifiers."""
    url = text.canonical_url(F.col("link"))
    body = F.concat_ws(" ", "title", "summary", "link")
    said = F.regexp_replace(F.regexp_replace(F.trim("published"), r"^[A-Za-z]{3},\s*", ""), r"\s(GMT|UTC?|Z)$", " +0000")
    formats = ("d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    published = F.coalesce(*[F.try_to_timestamp(said, F.lit(f)) for f in formats])
    return entries.where(F.coalesce(F.trim("link"), F.lit("")) != "").select(
        F.sha2(url, 256).alias("id"), url.alias("url"), text.squeeze(F.col("title")).alias("title"), text.title_key(F.col("title")).alias("title_hash"),
        text.snippet(F.col("summary")).alias("snippet"), text.arxiv_id(body).alias("arxiv_id"), text.doi(body).alias("doi"), published.alias("published_at"),
    )


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS files: link, title, summary, published."""
    rows = spark.read.format("xml").option("rowTag", "item").schema("link string, title string, description string, pubDate string").load(path)
    return rows.select(F.trim("link").alias("link"), "title", F.col("description").alias("summary"), F.col("pubDate").alias("published"))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files: link, title, summary, published, image."""
    link = "array<struct<_href:string,_rel:string,_type:string>>"
    rows = spark.read.format("xml").option("rowTag", "entry").option("valueTag", "_text").schema(f"title string, link {link}, summary string, content string, published string, updated string").load(path)
    links = F.transform("link", lambda x: F.struct(x["_href"].alias("href"), x["_rel"].alias("rel"), x["_type"].alias("type")))
    none = F.lit(None)
    image = payloads.entry_image(none.cast(f"array<{payloads.MEDIA}>"), none.cast(f"array<{payloads.MEDIA}>"), links, none.cast("string"))
    return rows.select(payloads.entry_url(none.cast("string"), links).alias("link"), "title", F.coalesce("summary", "content").alias("summary"), F.coalesce("published", "updated").alias("published"), image.alias("image"))


def expire(seen: DataFrame, at: str, keep: str) -> DataFrame:
    """A stream of sightings whose state lasts no longer than the watermark: one row a key and window, then forgotten."""
    return seen.withWatermark(at, keep).groupBy(F.window(at, keep), "key").agg(F.count("*").alias("n"), F.max(at).alias("last")).select("key", F.col("window.start").alias("window_start"), "n", "last")
