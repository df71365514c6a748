"""Upserts into key-bucketed partitions: a batch rewrites the buckets of its keys, not the table.

A table lies in ``bucket=B`` partitions by a hash of its key and is changed by dynamic partition overwrite. Spark replaces partitions one after
another, so a run that dies between two of them would leave the table half changed. Therefore the new contents of the touched buckets are
first written whole to ``pending`` beside the table; then they overwrite the buckets; then ``pending`` goes. Whoever opens the table next
first finishes a whole ``pending`` (overwriting a bucket twice gives the same) and discards one that isn't whole.

Each row keeps the stream and batch that wrote it last. A batch that is run again leaves rows alone that it or a later batch of its stream wrote, so
policies that aren't idempotent (a count of sightings) count once too. A stream begun anew over a fresh checkpoint is another stream.

There is one writer at a time. A reader should open the table through ``read``, which finishes what is pending.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.merge import Policy, last_per_key, merge
from tessera.sources import folders

BUCKETS = 64
STREAM, BATCH = "__stream", "__batch"


@dataclass
class BucketedTable:
    """A table below ``path``. ``buckets`` and ``keys`` never change for a path; ``order``: which of a batch's rows of a key wins, the first."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: list[str]
    policy: dict[str, Policy] = field(default_factory=dict)
    order: list[Column] = field(default_factory=list)
    buckets: int = BUCKETS

    @property
    def stored(self) -> StructType:
        return StructType([*self.schema.fields, *StructType.fromDDL(f"{STREAM} string, {BATCH} long, bucket int").fields])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def opened(self, where: str) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(where) if folders.below(self.spark, where) else self.spark.createDataFrame([], self.stored)

    def overwrite(self, df: DataFrame, where: str) -> None:
        # bucket is last, as partition columns are read
        dealt = df.select(*self.stored.names).hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.keys)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(where)

    def recover(self) -> bool:
        """Finish or discard what a killed run left; whether there was something to finish."""
        pending = f"{self.path}/pending"
        whole = folders.is_whole(self.spark, pending)
        if whole:
            self.overwrite(self.opened(pending), f"{self.path}/table")
        if whole or folders.exists(self.spark, pending):
            folders.remove(self.spark, pending)
        return whole

    def read(self, stamped: bool = False) -> DataFrame:
        self.recover()
        found = self.opened(f"{self.path}/table")
        return found if stamped else found.select(*self.schema.names)

    def prepare(self, batch: DataFrame, stream: str, number: int) -> list[int]:
        """Write the new contents of the batch's buckets to ``pending``: these buckets."""
        order = self.order or [F.lit(1)]
        rows = last_per_key(batch.select(*self.schema.names), self.keys, order).withColumns({STREAM: F.lit(stream), BATCH: F.lit(number).cast("long"), "bucket": self.bucket()})
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())
        if touched:
            now = self.read(stamped=True).where(F.col("bucket").isin(touched))
            done = now.where((F.col(STREAM) == stream) & (F.col(BATCH) >= number)).select(*self.keys)
            fresh = rows.join(done, self.keys, "left_anti")
            # the bucket follows from the keys, and the stamp of the batch wins
            merged = merge(now.drop("bucket"), fresh.drop("bucket"), self.keys, self.policy).withColumn("bucket", self.bucket())
            merged.select(*self.stored.names).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/pending")
        return touched

    def upsert(self, batch: DataFrame, stream: str = "batches", number: int = 0) -> list[int]:
        """Upsert a batch by key: the buckets that were rewritten, as many as the batch has keys at most."""
        touched = self.prepare(batch, stream, number)
        self.recover()
        return touched

    def ingest(self, stream: DataFrame, checkpoint: str, available_now: bool = True, every: str = "180 seconds", done: Callable[[list[int]], None] | None = None) -> StreamingQuery:
        """Start the upsert of a stream; available_now takes what is there and ends."""

        def run(batch: DataFrame, number: int) -> None:
            touched = self.upsert(batch, self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint, number)
            if done:
                done(touched)

        writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def append_by_day(df: DataFrame, where: str, at: str) -> None:
    """Append rows to a log whose partitions are days (``day=YYYY-MM-DD``) of a time column."""
    df.withColumn("day", F.to_date(at)).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(where)


def drop_days(spark: SparkSession, where: str, before: str) -> list[str]:
    """Delete whole days of such a log that lie before a day: their names. No row is read or written."""
    gone = [x[4:] for x in folders.below(spark, where) if x.startswith("day=") and x[4:] != "__HIVE_DEFAULT_PARTITION__" and x[4:] < before]
    for day in gone:
        folders.remove(spark, f"{where}/day={day}")
    return gone
