"""Words, hashes and batches shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Rows of one batch are handled in runs of about this many bytes, so very long texts don't add up.
RUN_BYTES = 8 << 20

#: Lower-cases A-Z, keeps a-z, 0-9 and bytes of characters beyond ASCII, and makes a blank of every other byte.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * MIX_1
    h = (h ^ (h >> np.uint64(27))) * MIX_2
    return h ^ (h >> np.uint64(31))


def words(text: bytes) -> list[bytes]:
    """Maximal runs outside \\x20 and \\x09-\\x0D; ``bytes.split`` divides at exactly these six."""
    return text.split()


def hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` consecutive hashed words; of the whole sequence if it is shorter (none if empty)."""
    n = len(h)
    if not n:
        return h
    k_here = min(k, n)
    out = np.full(n - k_here + 1, np.uint64(k_here), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k_here):
            out = mix(out + h[j : n - k_here + 1 + j])
    return out


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], run_bytes: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut where their texts reach ``run_bytes``, each with its texts."""
    for batch in batches:
        rows = texts(batch.column("text"))
        start, size = 0, 0
        for i, t in enumerate(rows):
            size += len(t)
            if size >= run_bytes or i == len(rows) - 1:
                yield batch.slice(start, i + 1 - start), rows[start : i + 1]
                start, size = i + 1, 0


def per_text(df: DataFrame, schema: str, columns: Callable[[list[bytes]], list], run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per row of ``df``: its ``doc_id`` and what ``columns`` makes of a run of texts, one list or array per column of ``schema``.

    Reads only the two columns, so others may have any name. No shuffle."""
    spark_schema = f"doc_id long, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in runs(batches, run_bytes):
            made = columns(rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(x if isinstance(x, pa.Array) else pa.array(x) for x in made)], names=names)

    names = ["doc_id", *(part.split()[0] for part in schema.split(", "))]
    return two(df).mapInArrow(run, spark_schema)


def two(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and the end of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
