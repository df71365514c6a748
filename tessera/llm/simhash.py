"""SimHash near-duplicates, found by the bit counts of a fingerprint's segments.

A 64-bit fingerprint is mapped to the counts of set bits in its sixteen 4-bit segments, kept as
sixteen nibbles of one long. The Manhattan distance of two such vectors is at most the Hamming
distance of the fingerprints, so pairs within two bits lie within distance two in a grid with a
cell for every vector. Two vectors that near share a cell once each enters its own and those one
step away (33 at most), so the range join is an equi-join on the cell. What meets there is
verified exactly by the bits of the exclusive or. Joins of fingerprints are sort-merge joins by hint: their tables grow with
the input and are estimated too small (exploded rows, compressed files), so one would be sent through the driver.

Work is on distinct fingerprints, so exact copies cost one row each. A cell with over CROWDED
fingerprints (a large group of near copies) isn't paired up: each of its fingerprints enters the
65 bit patterns within one bit of itself, and all that enter one pattern are linked to the least
of them. They differ in at most two bits through that pattern, and any two that differ in two
bits or fewer meet in one, so this is exact too, with rows in proportion to fingerprints.

Defined results: a null or empty text has fingerprint zero and is linked like any other; repeated
rows and repeated ids are all returned; a null id is kept, and takes part in no minimum unless its
component has only null ids (then component_id is null); an empty table gives an empty table;
other columns are ignored, or passed through by ``keep_representatives``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.common import give_back, id_and_text, written
from tessera.llm.components import connected

SHINGLE = 3
CROWDED = 16
SEED = 42


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of one text: a bit is set where over half the shingle hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(flat, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    hashes = np.fromiter((xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    over = 2 * set_bits(hashes) > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, least bit first."""
    lanes = np.uint64(0x0101010101010101)
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 20):
        part = hashes[k : k + (1 << 20)]
        cuts = np.arange(0, len(part), 255)  # a byte counts to 255
        for bit in range(8):
            sums = np.add.reduceat((part >> np.uint64(bit)) & lanes, cuts)
            total[bit::8] += sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return total


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) for each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "fp"])
        give_back()

    return id_and_text(df, id_col, text_col).mapInArrow(rows, "doc_id long, fp long")


def segment_counts(fp: Column) -> Column:
    """Bit counts of the sixteen 4-bit segments, a nibble each."""
    halves = []
    for half in (fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)):
        pairs = half.bitwiseAND(F.lit(0x55555555)) + F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))
        halves.append(pairs.bitwiseAND(F.lit(0x33333333)) + F.shiftright(pairs, 2).bitwiseAND(F.lit(0x33333333)))
    return halves[0].bitwiseOR(F.shiftleft(halves[1], 32))


def cells(counts: Column) -> Column:
    """The grid cells at Manhattan distance 0 and 1 of a vector of segment counts (0 to 4 each)."""
    out = [counts]
    for j in range(16):
        step = F.lit(1 << 4 * j)
        value = F.shiftrightunsigned(counts, 4 * j).bitwiseAND(F.lit(15))
        out += [F.when(value < 4, counts + step), F.when(value > 0, counts - step)]
    return F.array_compact(F.array(*out))


def meetings(nodes: DataFrame) -> DataFrame:
    """(cell, fp, size) for each cell that ``size`` fingerprints enter, two or more."""
    # a table of fingerprints is small for its rows, and each becomes 33: deal it out first
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.repartition(parts, "fp").select("fp", F.explode(cells(segment_counts(F.col("fp")))).alias("cell"))
    shared = placed.groupBy("cell").agg(F.count("*").alias("size")).where("size > 1")
    # Spark takes exploded rows for as few as they came from, and would broadcast them
    return placed.hint("merge").join(shared, "cell")


def edges(met: DataFrame) -> DataFrame:
    """Edges (u, v) between the fingerprints of ``meetings``."""
    few = met.where(F.col("size") <= CROWDED).select("cell", "fp")
    pairs = few.select("cell", F.col("fp").alias("u")).hint("merge").join(few.select("cell", F.col("fp").alias("v")), "cell")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2
    pairs = pairs.where((F.col("u") > F.col("v")) & near).select("u", "v")
    many = met.where(F.col("size") > CROWDED).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit((1 << j) - ((1 << 64) if j == 63 else 0)) for j in range(64)))
    around = many.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("ball"))
    least = around.groupBy("ball").agg(F.min("fp").alias("v"), F.count("*").alias("size")).where("size > 1").select("ball", "v")
    stars = around.hint("merge").join(least, "ball").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def links(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints (distinct, column fp) within two bits of a chain."""
    return edges(written(meetings(nodes), "cells"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for each row: component_id is the least id reachable over links."""
    marked = written(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected(links(nodes.select("fp")))
    grouped = nodes.hint("merge").join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    component = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.hint("merge").join(component, "root").select("fp", "component_id")
    return marked.hint("merge").join(named, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose id is the least of their component.

    Of rows that share that id (repeated rows) one is kept.
    Rows with null ids stay, as nothing names them.
    """
    found = classes(df, id_col, text_col)
    first = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__kept_id")).agg(F.count("*").alias("__copies"))
    stay = df.hint("merge").join(first, df[id_col] == first["__kept_id"])
    alone = stay.where("__copies = 1").drop("__kept_id", "__copies")
    once = stay.where("__copies > 1").drop("__kept_id", "__copies").dropDuplicates([id_col])
    return alone.union(once).union(df.where(df[id_col].isNull()))
