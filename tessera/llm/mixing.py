"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Sources, ordered by code point with null last, weigh 5, 2, 1, repeating, and share
all words; a target stops at MOST times its source's size and the excess is shared again by
weight until none is above. A source with target t and size s takes every document floor(t / s)
times, and once more those first in a permutation fixed by md5 of id and text, until the rest is met;
and then the one further document whose size comes nearest to what is left.

Documents lie in blocks of their source, the leading hex digits of that md5; there are at least BLOCKS_A_SHARD blocks of a source for each
output shard. A block is taken once more wholly, not at all, or (one block of a source, and that of its last document)
document by document; rows that share id, size, source and md5 are counted as one group first, so a repeated row costs nothing.

Each (source, copy, block) is an entry. How many entries of each source an output shard gets is drawn exactly: the tree halves the
shards, and a node's entries go to its halves by a multivariate hypergeometric draw, seeded by the node. The driver draws the
upper TOP nodes only; tasks draw the subtrees below them and list their shards' runs of ranks. Shards thus take disjoint runs of each
source's permuted entries, a document is taken once for each shard that drew its block, and rows are shuffled within their shard.
Running sums and ranks go over leading digits first and then within them, so no window spans a source.

The driver holds one number for each source and each of TOP subtrees.

Defined results: null or empty texts have size 0 and are taken floor(t / s) times; a source of size 0 has
target 0 and is taken no times; null ids permute as the empty id; repeated rows are rows of their
own (where only some of a group of equal rows are taken once more, the further copies have the other columns of one of them); an empty
table gives an empty table; columns other than id, source and text are ignored (``taken``) or passed through (``mix``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import importable, n_words, written

WEIGHTS = (5, 2, 1)
MOST = 3
SEED = 20240229
SHARD_WORDS = 8_000_000
BLOCKS_A_SHARD = 16
DIGITS = (3, 7)  # of a block's name, at least and at most
TOP = 1024
PER_ROW = 1000  # copies that one row is multiplied by at once
BROADCAST_BLOCKS = 500_000
NUMPY_DRAW = 1_000_000_000  # numpy draws from fewer entries than this
GROUP = ["source", "block", "key", "doc_id", "size"]


def sized(df: DataFrame, id_col: str, source_col: str, text_col: str, *more: Column) -> DataFrame:
    """doc_id, source, size, key (md5 of id and text) and the columns ``more``."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).cast("string")))
    return df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), *more)


def targets(rows: DataFrame) -> DataFrame:
    """One row for each source: source_size, target, full (times every document is taken) and rest (words beyond).

    Water-filling in closed form over the source table: with sources ordered by MOST * size / weight,
    the first k are at their limit for the least k at which the next one stays within it.
    """
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (number % len(WEIGHTS) + 1).cast("int")).cast("double"))
    level = MOST * F.col("source_size") / F.col("weight")
    order = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", level)
    spent = F.coalesce(MOST * F.sum("source_size").over(before), F.lit(0))
    per = per.withColumn("share", (F.sum("source_size").over(everything) - spent) / F.sum("weight").over(rest))
    per = per.withColumn("open", F.when(F.col("share") <= F.col("level"), F.col("share")))
    per = per.withColumn("water", F.first("open", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least((MOST * F.col("source_size")).cast("double"), F.col("water") * F.col("weight"))
    per = per.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return per.select("source", "source_size", "target", full.alias("full")).withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))


def shards_for(rows: DataFrame) -> int:
    """Output shards for the words there are."""
    return max(1, -(-(rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n) // SHARD_WORDS))


def digits_for(shards: int) -> int:
    """Digits of a block's name, so that a source has BLOCKS_A_SHARD blocks for each shard."""
    return next((d for d in range(*DIGITS) if 16**d >= BLOCKS_A_SHARD * shards), DIGITS[1])


def running(df: DataFrame, keys: list[str], coarse: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of ``value`` over the rows of its keys that come before or with it: sums of coarse groups first, then within each."""
    df = df.withColumn("__c", coarse).withColumn("__v", value)
    groups = df.groupBy(*keys, "__c").agg(F.sum("__v").alias("__s"))
    before = F.sum("__s").over(Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__s")
    base = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__c").alias("__d"), before.alias("__b"))
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(base[f"__{k}"]) for k in keys], df["__c"] == base["__d"])
    within = Window.partitionBy(*keys, "__c").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = df.withColumn("__w", F.sum("__v").over(within)).join(base, same)
    return met.withColumn(name, F.col("__b") + F.col("__w")).drop("__c", "__v", "__d", "__b", "__w", *[f"__{k}" for k in keys])


class Plan:
    """What is taken: blocks (source, block, state, source_size, target, full, of) and the groups of listed blocks with their copies.

    state: 1 where all of a block's documents are taken once more, 0 where none is, None where groups say it. groups: GROUP, n rows
    of which m are taken once more. ``of``: the shards of a block's copies.
    """

    def __init__(self, slim: DataFrame, shards: int) -> None:
        digits = digits_for(shards)
        self.block = F.substring("key", 1, digits)
        rows = slim.withColumn("block", self.block)
        per = targets(slim)
        sums = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
        sums = running(sums, ["source"], F.substring("block", 1, DIGITS[0]), ["block"], F.col("block_size"), "upto")
        p = per.select(F.col("source").alias("s"), "source_size", "target", "full", "rest")
        sums = written(sums.join(p, sums.source.eqNullSafe(p.s)).drop("s").withColumn("before", F.col("upto") - F.col("block_size")), "blocks")
        # a block ends below the rest (all of it is taken), or begins above it (none is), or is cut
        cut = (F.col("before") <= F.col("rest")) & (F.col("upto") > F.col("rest"))
        groups = self.listed(rows, sums.where(cut))
        run = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        at = F.col("before") + F.sum(F.col("size") * F.col("n")).over(run) - F.col("size") * F.col("n")
        whole = F.when(F.col("size") > 0, F.greatest(F.lit(0), F.least(F.col("n"), F.floor((F.col("rest") - at) / F.col("size")))))
        groups = written(groups.withColumn("at", at).withColumn("m", F.coalesce(whole, F.lit(0)).cast("long")), "groups")
        # a group that doesn't fit ends the run: those behind it are not taken
        stop = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
        groups = groups.withColumn("m", F.when(F.coalesce(F.max(((F.col("m") < F.col("n")) & (F.col("size") > 0)).cast("int")).over(stop), F.lit(0)) == 1, 0).otherwise(F.col("m")))
        # the one further document of each source whose size comes nearest to what is left
        taken = groups.groupBy("source").agg(F.max("before").alias("before"), F.sum(F.col("size") * F.col("m")).alias("own"))
        gap = per.select(F.col("source").alias("s"), "rest").join(taken, F.col("s").eqNullSafe(F.col("source"))).select("s", (F.col("rest") - F.col("before") - F.col("own")).alias("gap"))
        state = F.when(cut, None).otherwise((F.col("upto") <= F.col("rest")).cast("int"))
        none = sums.where(state == 0).select(F.col("source").alias("t"), F.col("block").alias("b"))
        free = rows.join(none, rows.source.eqNullSafe(none.t) & (rows.block == none.b), "left_semi").select(*GROUP)
        free = free.union(groups.where("m < n").select(*GROUP)).where("size > 0")
        miss = F.abs(F.col("gap") - F.col("size"))
        near = free.join(F.broadcast(gap), F.col("source").eqNullSafe(F.col("s"))).where(miss < F.col("gap"))
        last = near.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "key", "doc_id", "size", "block")).alias("g")).select("source", "g.*")
        last = written(last.drop("miss"), "last")
        # the blocks of these documents are listed too
        more = self.listed(rows, sums.where(state == 0).join(last.select(F.col("source").alias("t"), F.col("block").alias("b")), F.col("source").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")), "left_semi"))
        both = groups.select(*GROUP, "n", "m").unionByName(more.select(*GROUP, "n", F.lit(0).cast("long").alias("m")))
        mark = last.select(*[F.col(c).alias(f"__{c}") for c in GROUP])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in GROUP])
        self.groups = written(both.join(F.broadcast(mark), same, "left").select(*GROUP, "n", (F.col("m") + F.col("__size").isNotNull().cast("long")).alias("m")), "groups")
        named = self.groups.select(F.col("source").alias("t"), F.col("block").alias("b")).distinct()
        blocks = sums.join(named, F.col("source").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")), "left")
        blocks = blocks.select("source", "block", F.when(F.col("b").isNotNull(), None).otherwise(state).alias("state"), "source_size", "target", "full")
        self.blocks = written(with_shards(written(blocks, "states"), shards), "drawn")
        self.small = self.blocks.count() <= BROADCAST_BLOCKS

    @staticmethod
    def listed(rows: DataFrame, blocks: DataFrame) -> DataFrame:
        """GROUP and n of the rows in these blocks, with the blocks' before and rest."""
        b = blocks.select(F.col("source").alias("t"), F.col("block").alias("b"), "before", "rest")
        return rows.join(b, rows.source.eqNullSafe(b.t) & (rows.block == b.b)).groupBy(*GROUP, "before", "rest").agg(F.count("*").alias("n"))

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows with their block's columns; blocks are broadcast up to BROADCAST_BLOCKS."""
        b = self.blocks.select(*[F.col(c).alias(f"__{c}") for c in self.blocks.columns])
        rows = rows.withColumn("block", self.block)
        return rows.join(F.broadcast(b) if self.small else b, rows.source.eqNullSafe(b["__source"]) & (rows.block == b["__block"]))


def with_shards(blocks: DataFrame, shards: int) -> DataFrame:
    """blocks with ``of``: the shard of each copy; there are ``full`` and, but for blocks of state 0, one more."""
    copies = F.col("full") + F.when(F.col("state") == 0, 0).otherwise(1)
    entries = blocks.select("source", "block", F.explode(F.slice(F.array(*map(F.lit, range(1, MOST + 2))), F.lit(1), copies.cast("int"))).alias("copy"))
    mixed = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.coalesce("source", F.lit("")), "block", F.col("copy").cast("string")))
    ranked = running(entries.withColumn("mixed", mixed), ["source"], F.substring("mixed", 1, DIGITS[0]), ["mixed", "block", "copy"], F.lit(1), "place")
    ranked = ranked.withColumn("rank", F.col("place") - 1)
    per = entries.groupBy("source").agg(F.count("*").alias("n")).orderBy(F.col("source").asc_nulls_last()).collect()
    number = {x.source: k for k, x in enumerate(per)}
    spark = blocks.sparkSession
    names = spark.createDataFrame([(s, k) for s, k in number.items()], "t string, number int")
    runs = tree_runs(spark, np.array([x.n for x in per], np.int64), shards)
    owned = ranked.join(F.broadcast(names), ranked.source.eqNullSafe(names.t)).select("source", "block", "copy", "number", "rank")
    owned = owned.join(runs.select("number", F.explode(F.sequence("begin", F.col("end") - 1)).alias("rank"), "shard"), ["number", "rank"])
    of = owned.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x.shard).alias("of"))
    of = of.select(F.col("source").alias("t"), F.col("block").alias("b"), "of")
    met = blocks.join(of, F.col("source").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")), "left").drop("t", "b")
    return met.withColumn("of", F.coalesce("of", F.array().cast("array<int>")))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` out of good and bad entries are good. Beyond numpy's bound by inversion, over all values within 12 deviations of the mean."""
    total = good + bad
    if total < NUMPY_DRAW:
        return int(rng.hypergeometric(good, bad, draws))
    mean = draws * (good / total)
    reach = 12 * (mean * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5 + 12
    lo, hi = max(0, draws - bad, int(mean - reach)), min(draws, good, int(mean + reach) + 1)
    k = np.arange(lo, hi, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(weight - weight.max()))
    return lo + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def halves(number: int, left: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Of the entries of node ``number``, which has shards lo to hi, those of its first half: a multivariate hypergeometric draw seeded by the node."""
    rng = np.random.Generator(np.random.Philox(key=[SEED, number]))
    rest = int(left.sum())
    draws = rest * ((lo + hi) // 2 - lo) // (hi - lo)
    first = np.zeros_like(left)
    for k, n in enumerate(left.tolist()):
        rest -= n
        first[k] = hypergeometric(rng, n, rest, draws) if draws else 0
        draws -= int(first[k])
    return first


def subtree(number: int, left: np.ndarray, start: np.ndarray, lo: int, hi: int, most: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, int]]:
    """The nodes of at most ``most`` shards below a node: number, entries of each source, their first ranks, and the shards."""
    stack = [(number, left, start, lo, hi)]
    while stack:
        number, left, start, lo, hi = node = stack.pop()
        if hi - lo <= most:
            yield node
            continue
        mid, first = (lo + hi) // 2, halves(number, left, lo, hi)
        stack += [(2 * number + 1, left - first, start + first, mid, hi), (2 * number, first, start, lo, mid)]


def split(counts: np.ndarray, shards: int) -> np.ndarray:
    """Entries of each source for each shard, [shard, source]: shard totals differ by one at most."""
    return np.array([left for _, left, _, _, _ in subtree(1, counts.astype(np.int64), np.zeros(len(counts), np.int64), 0, shards)])


RUNS = "number int, begin long, end long, shard int"


def tree_runs(spark: SparkSession, counts: np.ndarray, shards: int) -> DataFrame:
    """(number of the source, begin, end, shard): the runs of ranks that each shard takes. The driver draws TOP subtrees, tasks the rest."""
    importable(spark)
    tops = subtree(1, counts.astype(np.int64), np.zeros(len(counts), np.int64), 0, shards, -(-shards // TOP)) if len(counts) else ()
    rows = [(str(n), left.tolist(), start.tolist(), lo, hi) for n, left, start, lo, hi in tops]
    nodes = spark.createDataFrame(rows, "node string, entries array<long>, start array<long>, lo int, hi int")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                for _, left, start, shard, _ in subtree(int(r["node"]), np.array(r["entries"], np.int64), np.array(r["start"], np.int64), r["lo"], r["hi"]):
                    some = np.flatnonzero(left)
                    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(start[some]), pa.array((start + left)[some]), pa.array(np.full(len(some), shard, np.int32))], ["number", "begin", "end", "shard"])

    parts = min(max(1, len(rows)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return nodes.repartition(parts).mapInArrow(drawn, RUNS)


def taken(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken and the shards (comma-joined, by copy) for each row: a row is taken once for each shard that drew it."""
    slim = written(sized(df, id_col, source_col, text_col), "sized")
    plan = Plan(slim, shards or shards_for(slim))
    placed = plan.placed(slim)
    columns = ["doc_id", "size", "__source_size", "__target", "__full", "__of"]
    clear = placed.where("__state IS NOT NULL").select(*columns, F.when(F.col("size") > 0, F.col("__state")).otherwise(0).cast("long").alias("extra"))
    own = plan.placed(plan.groups)
    several = own.select(*columns, "m", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k")).select(*columns, (F.col("k") <= F.col("m")).cast("long").alias("extra"))
    drawn = F.slice("__of", F.lit(1), (F.col("__full") + F.col("extra")).cast("int"))
    return clear.union(several).select("doc_id", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("size") * F.size(drawn)).alias("taken"), F.array_join(drawn, ",").alias("shards"))


def mix(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """The rows of df that the mix takes, each as often as it is taken, dealt into shards and shuffled within them.

    There is a shard for SHARD_WORDS words, so one task's share doesn't grow with the corpus. Texts move once, to their shards.
    """
    names = df.columns
    slim = written(sized(df, id_col, source_col, text_col), "sized")
    shards = shards or shards_for(slim)
    plan = Plan(slim, shards)
    placed = plan.placed(sized(df, id_col, source_col, text_col, F.struct(*(F.col(c) for c in names)).alias("__row")))
    shards_of = lambda n: F.explode(F.slice("__of", F.lit(1), n.cast("int"))).alias("shard")
    clear = placed.where("__state IS NOT NULL").select("__row", "key", shards_of(F.col("__full") + F.when(F.col("size") > 0, F.col("__state")).otherwise(0)))
    g = plan.groups.select(*[F.col(c).alias(f"__g_{c}") for c in [*GROUP, "n", "m"]])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in GROUP])
    listed = placed.where("__state IS NULL").join(g, same)
    even = listed.select("__row", "key", shards_of(F.col("__full") + (F.col("__g_m") == F.col("__g_n")).cast("int")))
    # of at most two groups a source only some rows are taken once more; these copies come of one row
    part = listed.where("__g_m > 0 AND __g_m < __g_n")
    one = part.groupBy(*GROUP, "__g_m").agg(F.first("__row").alias("__row"), F.first(F.element_at("__of", -1)).alias("shard"))
    pieces = one.select("__row", "key", "shard", "__g_m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__g_m") - 1) / PER_ROW))).alias("piece"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    further = pieces.repartition(parts, "piece").select("__row", "key", "shard", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(PER_ROW).cast("long"), F.col("__g_m") - F.col("piece") * PER_ROW)))).select("__row", "key", "shard")
    # copies of a document stand apart: the order within a shard is that of a hash that differs from copy to copy
    order = F.xxhash64("key", F.monotonically_increasing_id(), F.lit(SEED)).alias("order")
    dealt = clear.union(even).union(further).select("__row", "shard", order).repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "order")
    return dealt.select(*(F.col(f"__row.`{c}`").alias(c) for c in names))
