"""Documents to training sequences: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
All but the last return the columns of docs. Rows without a ``doc_id`` go through every stage; a null text fails the quality rules."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import minhash, packing, pii, quality, substrings
from terrafold.llm.text import documents
from terrafold.session import settle

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the counts or leave their language's perplexity bands go."""
    rows = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("whole_row"))
    return quality.judged(rows, keep=("whole_row",)).filter("kept").select("whole_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest ``doc_id`` stays; so does one of equal rows."""
    gone = minhash.near_duplicates(docs, shingle_words=5, share=80).filter("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    named = docs.filter("doc_id IS NOT NULL").join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a window of 20 words that starts earlier elsewhere go; a changed text is its words left, joined by blanks."""
    out = substrings.without_repeats(docs, k=20, carry=tuple(c for c in docs.columns if c != "text"))
    columns = {c: F.col("carried")[c] if c != "text" else F.col("kept") for c in docs.columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return out.select(*(c.alias(name) for name, c in columns.items()))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed spans are replaced by the name of their kind."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens: their ids (of the text that all stages left), digest and place in a sequence."""
    return packing.packed(docs, TOKENIZER, end_id=0, size=2048, with_ids=True)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_duplicates), ("substring dedup", repeated_passages), ("personal data", personal_data), ("packing", pack)]

#: Perplexity bands, MinHash buckets and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
    return docs
