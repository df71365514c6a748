"""One query for each operator of this package, over its whole table, and the SQL that some have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, divergence, lm, mixing, pieces, pii, quotes, rans, repetition, resampling, secret_ledger, simhash, toxicity
from tessera.llm.common import scratch

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.annotate(table(spark, sf_dir, "documents"))


def op2_semicrf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.annotate(table(spark, sf_dir, "documents"))


def op3_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.annotate(table(spark, sf_dir, "documents"))


def op4_simhash_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link(table(spark, sf_dir, "conversations"))


def op6_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), scratch(spark, "ledger")
    secret_ledger.update(docs, ledger)
    found = secret_ledger.findings(docs, ledger)
    of = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in secret_ledger.BASE]))
    spans = secret_ledger.joined
    return found.select("doc_id", *[of(r.kind) for r in secret_ledger.BASE], F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"))


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op9_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "rans")
    rans.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return rans.read(spark, path)


def op11_bucket_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_path(PIECES)
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gated_lm": op1_gated_lm,
    "op2_semicrf_pii": op2_semicrf_pii,
    "op3_suffix_repetition": op3_suffix_repetition,
    "op4_simhash_segments": op4_simhash_segments,
    "op5_quotation_links": op5_quotation_links,
    "op6_blob_ledger": op6_blob_ledger,
    "op7_spaced_seeds": op7_spaced_seeds,
    "op8_source_mix": op8_source_mix,
    "op9_classifier_chain": op9_classifier_chain,
    "op10_rans_tokens": op10_rans_tokens,
    "op11_bucket_resampling": op11_bucket_resampling,
    "op12_source_divergence": op12_source_divergence,
    "op13_piece_codec": op13_piece_codec,
}

ORACLES: dict[str, str] = {"op12_source_divergence": divergence.ORACLE}
