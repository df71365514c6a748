"""A kept inverted index: postings are written once, bucketed by lexeme, and a query reads its own lexemes' buckets.

Layout below a path. Each update is a generation, numbered in order: ``postings/gen=N/bucket=B`` (lexeme, key, places), sorted by lexeme,
so that within a bucket's files row groups of other lexemes are skipped; ``gone/gen=N`` (key, was): documents of earlier generations that this one replaces
or deletes; ``docs/gen=N/bucket=B`` (key, digest), bucketed by key, written last: a generation counts once that folder is whole. What a killed run left
behind is never read, and compaction removes it. There is one writer at a time.

An update looks at the digests in its keys' buckets alone and takes apart only the texts that changed. A query reads ``lexeme IN ...`` in ``bucket IN ...``, less what is
gone; texts are not read at all. ``compact`` folds all generations into one and drops postings that are gone; ``update`` does so itself
beyond MOST_GENERATIONS, so a query meets a bounded number of files.

A frequent lexeme fills its bucket; the rebalancing shuffle before a write cuts large buckets into several tasks and files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from tessera.functions import english
from tessera.sources import folders

BUCKETS = 64
MOST_GENERATIONS = 8


@dataclass(frozen=True)
class InvertedIndex:
    """The index below ``path``. ``key`` is the name and ``kind`` the type of the documents' key; ``buckets`` never changes for a path."""

    spark: SparkSession
    path: str
    key: str
    kind: DataType
    buckets: int = BUCKETS

    def bucket(self, of: Column) -> Column:
        return F.pmod(F.xxhash64(of), F.lit(self.buckets)).cast("int").alias("bucket")

    def generations(self) -> list[int]:
        """Whole generations since the last compaction."""
        numbers = lambda what: sorted(int(x[4:]) for x in folders.below(self.spark, f"{self.path}/{what}") if x.startswith("gen=") and folders.is_whole(self.spark, f"{self.path}/{what}/{x}"))
        base = max(numbers("base"), default=0)
        return [x for x in numbers("docs") if x >= base]

    def table(self, what: str) -> DataFrame:
        """``postings``, ``gone`` or ``docs`` of the generations that count."""
        own = {"postings": f"lexeme string, {self.key} {self.kind.simpleString()}, places array<int>", "gone": f"{self.key} {self.kind.simpleString()}, was int", "docs": f"{self.key} {self.kind.simpleString()}, digest string"}[what]
        schema = StructType.fromDDL(f"{own}, gen int" + ("" if what == "gone" else ", bucket int"))
        found = self.generations()
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/gen={x}" for x in found])

    def write(self, df: DataFrame, what: str, number: int, order: list[str]) -> None:
        dealt = df.hint("rebalance", "bucket").sortWithinPartitions("bucket", *order)
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{what}/gen={number}")

    def latest(self, keys: DataFrame) -> DataFrame:
        """(key, was, digest) of those keys that the index holds, from their buckets alone."""
        touched = [r.bucket for r in keys.select(self.bucket(F.col(self.key))).distinct().collect()]
        known = self.table("docs").where(F.col("bucket").isin(touched)).join(keys.select(self.key).distinct(), self.key, "left_semi")
        last = known.groupBy(self.key).agg(F.max_by(F.struct(F.col("gen").alias("was"), "digest"), "gen").alias("last"))
        return last.select(self.key, "last.*").where("digest IS NOT NULL")

    def update(self, rows: DataFrame, body: str, gone: DataFrame | None = None) -> int:
        """Put documents (key, body; a key stands once) into the index and take the keys of ``gone`` out: the number of documents that changed.

        A null body is an empty one. A document whose text is as it was is passed over.
        """
        staged = f"{self.path}/staged"
        given = rows.select(self.key, F.coalesce(F.col(body), F.lit("")).alias("body")).withColumn("digest", F.sha2("body", 256))
        if gone is not None:
            dropped = gone.select(self.key).distinct().join(rows.select(self.key), self.key, "left_anti")
            given = given.unionByName(dropped.select(self.key, F.lit(None).cast("string").alias("body"), F.lit(None).cast("string").alias("digest")))
        known = self.latest(given).withColumnRenamed("digest", "before")
        met = given.join(known, self.key, "left").where(~F.col("digest").eqNullSafe(F.col("before")))
        met.select(self.key, "body", "digest", "was").write.mode("overwrite").parquet(staged)
        changed = self.spark.read.parquet(staged)
        n = changed.count()
        if n:
            number = 1 + max([int(x[4:]) for what in ("postings", "docs") for x in folders.below(self.spark, f"{self.path}/{what}") if x.startswith("gen=")], default=0)
            taken_apart = changed.where("body IS NOT NULL").select(self.key, F.inline(english.lexemes(F.col("body"))))
            self.write(taken_apart.select("lexeme", self.key, "places", self.bucket(F.col("lexeme"))), "postings", number, ["lexeme", self.key])
            changed.where("was IS NOT NULL").select(self.key, "was").write.mode("overwrite").parquet(f"{self.path}/gone/gen={number}")
            self.write(changed.select(self.key, "digest", self.bucket(F.col(self.key))), "docs", number, [self.key])
        folders.remove(self.spark, staged)
        if len(self.generations()) > MOST_GENERATIONS:
            self.compact()
        return n

    def live(self, postings: DataFrame) -> DataFrame:
        """Postings less those of documents that a later generation replaced or deleted."""
        gone = self.table("gone").select(self.key, F.col("was").alias("gen"))
        return postings.join(gone, [self.key, "gen"], "left_anti")

    def postings(self, lexemes: list[str]) -> DataFrame:
        """(lexeme, key, places) of a query's few lexemes, read from their buckets."""
        at = [r.bucket for r in self.spark.createDataFrame([(x,) for x in lexemes], "lexeme string").select(self.bucket(F.col("lexeme"))).distinct().collect()]
        found = self.table("postings").where(F.col("bucket").isin(at) & F.col("lexeme").isin(lexemes))
        return self.live(found).select("lexeme", self.key, "places")

    def search(self, query: str, nearness: bool = False) -> DataFrame:
        """(key, rank) of the documents with every lexeme of a query; none for a query of stop words alone."""
        wanted = sorted(english.lexeme_places(query))
        if not wanted:
            return self.spark.createDataFrame([], StructType.fromDDL(f"{self.key} {self.kind.simpleString()}, rank double"))
        met = self.postings(wanted).groupBy(self.key).agg(F.sort_array(F.collect_list(F.struct("lexeme", "places"))).alias("own"))
        met = met.where(F.size("own") == len(wanted)).select(self.key, F.transform("own", lambda x: x["places"]).alias("places"))
        return met.select(self.key, (english.rank_by_nearness if nearness else english.rank_by_covers)(F.col("places")).alias("rank"))

    def compact(self) -> None:
        """All generations as one, without what is gone, and without the folders of generations before."""
        before = self.generations()
        if not before:
            return
        # a number that no generation had, not even one that a killed run began
        number = 1 + max(int(x[4:]) for what in ("postings", "docs") for x in folders.below(self.spark, f"{self.path}/{what}"))
        self.write(self.live(self.table("postings")).select("lexeme", self.key, "places", "bucket"), "postings", number, ["lexeme", self.key])
        docs = self.table("docs").groupBy(self.key).agg(F.max_by("digest", "gen").alias("digest")).where("digest IS NOT NULL")
        self.spark.createDataFrame([], f"{self.key} {self.kind.simpleString()}, was int").write.mode("overwrite").parquet(f"{self.path}/gone/gen={number}")
        self.write(docs.select(self.key, "digest", self.bucket(F.col(self.key))), "docs", number, [self.key])
        # from here on readers begin at this generation
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base/gen={number}")
        for what in ("postings", "gone", "docs", "base"):
            for x in folders.below(self.spark, f"{self.path}/{what}"):
                if int(x[4:]) < number:
                    folders.remove(self.spark, f"{self.path}/{what}/{x}")

    def share_read(self, lexemes: list[str], of: DataFrame, body: str) -> float:
        """Bytes of the buckets that a query may read, by bytes of the texts."""
        at = {r.bucket for r in self.spark.createDataFrame([(x,) for x in lexemes], "lexeme string").select(self.bucket(F.col("lexeme"))).collect()}
        read = sum(folders.n_bytes(self.spark, f"{self.path}/postings/gen={g}/bucket={b}") for g in self.generations() for b in at)
        return read / max(1, of.agg(F.sum(F.octet_length(body))).first()[0] or 0)
