"""Exact percentiles of groups of any size: histograms narrow down to the bin that holds a rank.

Rows are counted by (group, value) first. A group of more than DISTINCT values is then cut into BINS bins between its least and greatest value; the counts of bins tell
which one holds a wanted rank, and that bin is the next round's range, until a range holds DISTINCT values at most. Only these are sorted. So
a task orders BINS or DISTINCT rows of a group, whatever the group's size; a group of all rows is dealt over SALTS parts, and the driver holds one number a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.clustering import kept

DISTINCT, BINS, SALTS = 50_000, 4_096, 64


def within(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counted values that lie in the ranges of wanted, joined by group and salt."""
    salted = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = counted.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["g", "salt"])
    return met.where(F.col("v").between(F.col("lo"), F.col("hi"))).drop("salt")


def narrowed(counted: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted with the range of each rank cut down to the bin that holds it."""
    place = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("int")
    ranges = wanted.select("g", "lo", "hi").distinct()
    bins = within(counted, ranges).groupBy("g", "lo", "hi", place.alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("values"), F.min("v").alias("low"), F.max("v").alias("high"))
    # BINS rows a range at most
    under = F.sum("n").over(Window.partitionBy("g", "lo", "hi").orderBy("bin")) - F.col("n")
    met = bins.withColumn("under", under).join(wanted.select("g", "lo", "hi", "k", "below"), ["g", "lo", "hi"])
    inside = (F.col("k") - F.col("below") >= F.col("under")) & (F.col("k") - F.col("below") < F.col("under") + F.col("n"))
    return met.where(inside).select("g", "k", (F.col("below") + F.col("under")).alias("below"), F.col("low").alias("lo"), F.col("high").alias("hi"), "values")


def percentiles(rows: DataFrame, sets: list[list[str]], value: str, q: float) -> DataFrame:
    """(g, n, q) for every group of every set of columns: g has the set's place as ``level`` and the set's columns (others null), n its rows,
    and q the value at the place (n - 1) * q of its values in order, interpolated. Null values count as rows alone; values are not NaN."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    kinds = dict(rows.dtypes)

    def group(k: int, s: list[str]) -> Column:
        return F.struct(F.lit(k).alias("level"), *[(F.col(c) if c in s else F.lit(None).cast(kinds[c])).alias(c) for c in names])

    each = rows.groupBy(*names, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    spread = each.select(F.explode(F.array(*[group(k, s) for k, s in enumerate(sets)])).alias("g"), "v", "n")
    counted = kept(spread.groupBy("g", "v").agg(F.sum("n").alias("n")))

    real = F.when(F.col("v").isNotNull(), F.col("n"))
    sizes = counted.groupBy("g").agg(F.sum("n").alias("n"), F.sum(real).alias("real"), F.count("v").alias("values"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    sizes = sizes.withColumn("at", (F.col("real") - 1) * F.lit(q))
    ranks = F.array_distinct(F.array(F.floor("at").cast("long"), F.ceil("at").cast("long")))
    wanted = sizes.where("real > 0").select("g", F.explode(ranks).alias("k"), F.lit(0).cast("long").alias("below"), "lo", "hi", "values")
    while True:
        wanted = kept(wanted)
        if wanted.where(F.col("values") > DISTINCT).isEmpty():
            break
        wanted = wanted.where(F.col("values") <= DISTINCT).union(narrowed(counted, wanted.where(F.col("values") > DISTINCT)))

    upto = F.sum("n").over(Window.partitionBy("g", "k").orderBy("v"))
    last = within(counted, wanted).withColumn("upto", F.col("below") + upto)
    ends = last.where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n"))).groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    return sizes.join(ends, "g", "left").select("g", "n", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("q"))
