"""From raw documents to token files: quality rules, near duplicates, decontamination, mixing, tokens.

Each stage reads what the one before wrote. ``run`` applies them to the documents table below a folder.

Defined results, in every stage: null or empty texts are documents without words (the quality rules reject them); rows with null ids stay
rows of their own, and the near-duplicate stage keeps them all; of repeated rows that stage keeps one; an empty table stays empty; all columns are
passed on, whatever their names, until the last stage, which has its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, mixing, rans, repetition, simhash
from tessera.llm.common import drop_written, scratch, written
from tessera.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return simhash.keep_representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, dealt into shards."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files, read back: doc_id, start, n_tokens, ids_crc32 of each document. Documents keep the order that the mix gave them."""
    path = scratch(spark, "rans")
    # the executors' heaps are as large as they get by now, so the workers' memory is kept small
    rans.write(docs, path, tokenizer_path(), kept=60_000, chunk=500_000, place=F.monotonically_increasing_id())
    return rans.read(spark, path)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL can't express the stages (suffix arrays, fingerprint components, spaced seeds, splitting tree, rANS); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        drop_written(before)
    return STAGES[-1][1](spark, docs, sf_dir)
