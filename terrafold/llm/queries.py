"""One named query per operator over its whole table, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import bpe, decontamination, licenses, minhash, mixing, neighbours, packing, pii, quality, resampling, substrings, toxicity, whitening
from terrafold.llm.sql import SQL
from terrafold.llm.text import documents


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), shingle_words=4, share=80)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(documents(spark, sf_dir), k=20).drop("kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scored(documents(spark, sf_dir), held_out="crc32(cast(doc_id AS string)) % 7 = 2")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = "crc32(cast(doc_id AS string)) % 5 = 0"
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(f"NOT {fold}"))
    out = toxicity.scored(docs, model)
    return out.select("doc_id", F.expr(fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, size=2048)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    back = bpe.decoded(bpe.encoded(documents(spark, sf_dir), ranks, pattern), ranks, pattern)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=16)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), percent=25, buckets=10_000, least_words=20, seed=7)
    return out.drop("n_words")


QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_substrings, op3_mixing, op4_pii, op5_toxicity, op6_licenses, op7_quality, op8_packing, op9_bpe, op10_neighbours, op11_whitening, op12_decontamination, op13_resampling,
    )
}

__all__ = ["QUERIES", "SQL"]
