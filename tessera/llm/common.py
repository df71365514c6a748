"""What the operators of this package share: tokens, scratch tables, Arrow helpers.

A word is a maximal run of characters other than U+0020 and U+0009..U+000D. On UTF-8 bytes
that is exactly ``bytes.split()``, and ``bytes.lower()`` lowers exactly A-Z, so whole texts are
tokenised without decoding them.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_RE = r"[^\x20\x09-\x0D]+"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, one is made in local mode; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: it survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        where = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did.

    Arrow batches are held to 16 MB unless the session says otherwise than the default, as a batch is
    in memory in both the executor and its worker.
    """
    here, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH")]))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "64MB", "64m"):
        spark.conf.set(key, "16m")


def id_and_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Columns doc_id, text as bytes and ``more``; a null text is empty. Other columns are dropped."""
    importable(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *more)


def n_words(text: Column) -> Column:
    """Number of words of a string column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def give_back() -> None:
    """Return a worker's free memory to the system at the end of a task, as workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def as_bytes(column: pa.Array) -> pa.Array:
    """A string or binary Arrow column as binary, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).fill_null(b"")


def text_chunks(ids: pa.Array, texts: pa.Array, most: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts (binary, no nulls) of a batch as Python values, at most ``most`` bytes at once; a longer text stands alone."""
    for lo, hi in in_chunks(pc.binary_length(texts).to_pylist(), most):
        yield ids.slice(lo, hi - lo).to_pylist(), texts.slice(lo, hi - lo).to_pylist()


def in_chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to at most ``most``; a larger one stands alone."""
    start = total = 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield start, k
            start, total = k, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)
