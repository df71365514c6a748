"""Importance resampling towards a target: bucket-partitioned inverted postings.

Features (runs of 1 to ORDER words) are hashed into buckets. Tasks turn blocks of texts into inverted postings, (bucket, document, count) in
order of bucket, packed for each of GROUPS ranges of buckets, and add up how often each bucket occurs. Postings are dealt out by
(range of buckets, group of blocks) and co-grouped there with both corpora's counts of these buckets; each group computes its buckets'
gains, multiplies counts by them and emits a contribution for each of its documents; contributions are reduced by block of documents.

A block holds CHUNK_BYTES of text (or one longer text) and a group of blocks about BLOCKS of them, so a task's memory is bounded whatever the
table's size, and a document gets GROUPS contributions at most. Buckets of frequent words take a byte a document, as
those of rare ones do. Postings, counts and results are tables in the shared folder, so nothing is tokenised twice.

The draw adds Gumbel noise from a hash of the id, sorts all documents by score over all tasks and numbers them from the parts' sizes.

Defined results: a null or empty text has no features and weight 0; a document is a row, so repeated rows each have a result and count
each time; null ids are spelled "null" for the noise and come last among ties; equal scores go by id; an empty target or table counts
nothing; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_written, give_back, id_and_text, in_chunks, written

BUCKETS = 10_000
ORDER = 3
GROUPS = 16
CHUNK_BYTES = 4_000_000
BLOCKS = 64
PERCENT = 5
MIN_WORDS = 20
SEED = 42
#: Letters and digits below U+0080, letters lowered; every byte of other characters; all else parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

POSTINGS = "g int, block long, n_docs long, keys binary, counts binary, head binary, totals binary"
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
POSTINGS_ARROW = pa.schema([(n, KINDS[t]) for n, t in (x.split() for x in POSTINGS.split(", "))])


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from 0, seven bits a byte, low bits first; the high bit says that the number goes on."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 9):
        sizes += values >= 1 << 7 * k
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k in range(int(sizes.max(initial=0))):
        own = sizes > k
        out[starts[own] + k] = values[own] >> 7 * k & 127 | np.where(sizes[own] > k + 1, 128, 0)
    return out.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if len(ends) == len(raw):
        return raw.astype(np.int64)
    starts = np.append(0, ends[:-1] + 1)
    place = np.arange(len(raw)) - np.repeat(starts, ends + 1 - starts)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts)


def features(texts: list[bytes], order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every feature, and the number of words of every text."""
    split = [t.translate(WORD_BYTES).split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = [w for words in split for w in words]
    owner = np.repeat(np.arange(len(texts)), sizes)
    spaced = [b" " + w for w in flat]
    sums: list[int] = list(map(crc32, flat))
    found, of = [np.array(sums, np.int64) % buckets], [owner]
    for k in range(1, order):
        # the checksum of a run goes on from that of the run without its last word
        sums = list(map(crc32, spaced[k:], sums))
        inside = owner[k:] == owner[: max(0, len(owner) - k)]
        found.append((np.array(sums, np.int64) % buckets)[inside])
        of.append(owner[k:][inside])
    return np.concatenate(found), np.concatenate(of), sizes


def postings(df: DataFrame, id_col: str, text_col: str, order: int, buckets: int, counts_only: bool = False) -> DataFrame:
    """Rows of POSTINGS: for each block a head (ids, features, words) and the postings of each range of buckets; for each task the counts of all buckets."""
    source = id_and_text(df, id_col, text_col)
    width = -(-buckets // GROUPS)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block, totals = TaskContext.get().partitionId(), 0, np.zeros(buckets, np.int64)

        def of_block(ids: pa.Array, texts: list[bytes]) -> list[dict]:
            nonlocal totals
            bucket, doc, words = features(texts, order, buckets)
            totals += np.bincount(bucket, minlength=buckets)
            if counts_only:
                return []
            n, name = len(texts), task << 32 | block
            key = np.sort(bucket * n + doc)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            counts, key = np.diff(np.append(first, len(key))), key[first]
            cuts = np.searchsorted(key, np.arange(GROUPS + 1) * width * n)
            out = []
            for g, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if b > a:
                    out.append({"g": g, "block": name, "n_docs": n, "keys": packed(np.diff(key[a:b] - g * width * n, prepend=0)), "counts": packed(counts[a:b])})
            sizes = sum((np.maximum(words - k, 0) for k in range(order)), np.zeros(n, np.int64))
            head = pa.record_batch([ids, pa.array(sizes), pa.array(words)], ["doc_id", "n_features", "n_words"])
            out.append({"block": name, "n_docs": n, "head": head.serialize().to_pybytes()})
            return out

        held: list[tuple[pa.Array, list[bytes]]] = []
        size = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, block
            ids, texts = pa.concat_arrays([x for x, _ in held]), [t for _, own in held for t in own]
            held, size = [], 0
            for lo, hi in in_chunks([len(t) for t in texts], CHUNK_BYTES):
                yield pa.RecordBatch.from_pylist(of_block(ids.slice(lo, hi - lo), texts[lo:hi]), POSTINGS_ARROW)
                block += 1

        for b in batches:
            own = b.column(1).to_pylist()
            held.append((b.column(0), own))
            size += sum(map(len, own))
            if size >= CHUNK_BYTES:
                yield from blocks()
        if held:
            yield from blocks()
        give_back()
        yield pa.RecordBatch.from_pylist([{"totals": totals.tobytes()}], POSTINGS_ARROW)

    return source.mapInArrow(rows, POSTINGS)


def bucket_counts(found: DataFrame, name: str) -> DataFrame:
    """(bucket, name): the sum of the tasks' counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                own = np.frombuffer(x, np.int64)
                total = own + total if len(total) else own
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["bucket", "n"])

    return found.where("totals IS NOT NULL").select("totals").mapInArrow(rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gain(s: int, t: int, total_s: int, total_t: int, buckets: int) -> int:
    """A bucket's gain: 1000 times the smoothed log ratio of its shares of target and source."""
    return math.floor(1000 * math.log((t + 1.0) * float(total_s + buckets) / ((s + 1.0) * float(total_t + buckets))))


def noise(name: object, seed: int) -> int:
    """1000 times Gumbel noise that depends on seed and id alone."""
    h = int(hashlib.sha256(f"{seed}:{'null' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """A written table (doc_id, n_features, n_words, weight, score), a row for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = written(postings(docs, id_col, text_col, order, buckets), "postings")
    aimed = postings(target, target_text_col, target_text_col, order, buckets, counts_only=True)
    counts = bucket_counts(own, "s").join(bucket_counts(aimed, "t"), "bucket", "full")
    counts = written(counts.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "buckets")
    total_s, total_t = (x or 0 for x in counts.agg(F.sum("s"), F.sum("t")).first())
    width = -(-buckets // GROUPS)

    n_groups = max(1, -(-own.where("head IS NOT NULL").count() // BLOCKS))
    # one row for each range of buckets and group of blocks
    ranges = counts.groupBy(F.expr(f"bucket div {width}").cast("int").alias("g")).agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("buckets"))
    ranges = ranges.select("g", "buckets", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("h"))
    blocks = own.where("g IS NOT NULL").select("g", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int").alias("h"), "block", "n_docs", "keys", "counts")

    def contributions(left: pa.Table, right: pa.Table) -> pa.Table:
        gains = np.zeros(width)
        for row in right.column("buckets").to_pylist():
            for x in row:
                gains[x["bucket"] % width] = gain(x["s"], x["t"], total_s, total_t, buckets)
        out = []
        for k in range(left.num_rows):
            n, keys = left.column("n_docs")[k].as_py(), np.cumsum(unpacked(left.column("keys")[k].as_py()))
            counted = unpacked(left.column("counts")[k].as_py())
            # sums of whole numbers below 2**53 are exact
            out.append(np.bincount(keys % n, gains[keys // n] * counted, n).astype(np.int64).tobytes())
        return pa.table([left.column("block").combine_chunks(), pa.array(out, pa.binary()), pa.nulls(left.num_rows, pa.binary())], names=["block", "sums", "head"])

    emitted = blocks.groupBy("g", "h").cogroup(ranges.groupBy("g", "h")).applyInArrow(contributions, "block long, sums binary, head binary")
    heads = own.where("head IS NOT NULL").select("block", F.lit(None).cast("binary").alias("sums"), "head")
    schema = pa.schema([("doc_id", own.sparkSession.createDataFrame([], f"x {kind}").toArrow().schema.field(0).type), *[(x, pa.int64()) for x in ("n_features", "n_words", "weight", "score")]])

    def documents(parts: pa.Table) -> pa.Table:
        head = pa.ipc.read_record_batch(next(x for x in parts.column("head").to_pylist() if x is not None), pa.schema([("doc_id", schema.field(0).type), ("n_features", pa.int64()), ("n_words", pa.int64())]))
        total = np.zeros(head.num_rows, np.int64)
        for x in parts.column("sums").to_pylist():
            if x is not None:
                total += np.frombuffer(x, np.int64)
        score = total + np.array([noise(x, seed) for x in head.column(0).to_pylist()], np.int64)
        return pa.table([*head.columns, pa.array(total), pa.array(score)], schema=schema)

    out = written(emitted.union(heads).groupBy("block").applyInArrow(documents, f"doc_id {kind}, n_features long, n_words long, weight long, score long"), "weights")
    drop_written(own)
    drop_written(counts)
    return out


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, **more) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs: of those with min_words words or more, the best percent by score have a rank, the others null.

    All rows are sorted over all tasks; a row's number is its place in its part and the sizes of the parts before it. Only those sizes,
    one for each shuffle partition, reach the driver.
    """
    found = weights(docs, target, id_col, text_col, **more)
    drawn = found.where(F.col("n_words") >= min_words).count() * percent // 100
    placed = found.orderBy(F.col("n_words") < min_words, F.col("score").desc(), F.col("doc_id").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id())
    placed = written(placed, "placed")
    drop_written(found)
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    before, starts = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r.part, before))
        before += r.n
    base = F.broadcast(docs.sparkSession.createDataFrame(starts, "part long, base long"))
    ranked = placed.withColumn("part", part).join(base, "part").withColumn("rank", F.col("base") + within + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
