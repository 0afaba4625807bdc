"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are its distinct hashed n-grams. Each is scaled by the log of the ratio of its smoothed shares among toxic and
other labelled texts; a logistic regression on the scaled features gives the score. The fit takes a bounded sample of labelled rows
(``sample_rows``, picked by the hash of their ids), so its ids can be broadcast and texts aren't shuffled; scoring reads every text.
Only n-grams whose share differs most between the classes (chi-square) are features: at most ``features``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import text as tx
from terrafold.session import settle

SIZES = (3, 4, 5, 6)
BUCKETS, BLOCK = 1 << 20, 1 << 14
#: Bytes of text whose n-grams are held at a time.
RUN = 1 << 20


@dataclass(frozen=True)
class Model:
    """The weight of each bucket (0: no feature) and of every text."""

    weights: np.ndarray
    intercept: float


def ngrams(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every n-gram of the lower-cased texts, repeats included; a blank stands around each text."""
    chars = [np.frombuffer(f" {t.decode('utf-8', 'replace').lower()} ".encode("utf-32-le"), np.uint32) for t in rows]
    lengths = np.array([len(c) for c in chars])
    flat, row = np.concatenate(chars).astype(np.uint64), np.repeat(np.arange(len(rows), dtype=np.int64), lengths)
    flat = np.where((flat >= 9) & (flat <= 13), np.uint64(32), flat)
    out_row, out = [], []
    with np.errstate(over="ignore"):
        h = flat.copy()
        for n in range(2, max(SIZES) + 1):
            if len(flat) < n:
                break
            h = h[:-1] * np.uint64(0x100000001B3) + flat[n - 1 :]
            if n in SIZES:
                same = row[: len(h)] == row[n - 1 :]
                out_row.append(row[: len(h)][same])
                out.append(((tx.mix(h + np.uint64(n))) & np.uint64(BUCKETS - 1)).astype(np.int64)[same])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_row]), np.concatenate([none, *out])


def distinct(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row * BUCKETS + bucket)
    return key // BUCKETS, key % BUCKETS


def document_counts(train: DataFrame) -> np.ndarray:
    """2 x buckets: in how many other and toxic texts each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int32)
        for batch, rows in tx.runs(batches, RUN):
            row, bucket = distinct(*ngrams(rows))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)[row] == 1
            for k in (0, 1):
                counts[k] += np.bincount(bucket[toxic == k], minlength=BUCKETS).astype(np.int32)
        blocks = counts.reshape(2, -1, BLOCK)
        some = [(k, b) for k in (0, 1) for b in range(blocks.shape[1]) if blocks[k, b].any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([b for _, b in some], pa.int32()), pa.array([blocks[k, b].tobytes() for k, b in some], pa.binary())], names=["k", "block", "counts"])

    def add(key, table):  # noqa: ANN001, ANN202
        total = sum(np.frombuffer(x, np.int32) for x in table.column("counts").to_pylist())
        return pa.table({"k": [key[0].as_py()], "block": [key[1].as_py()], "counts": [total.tobytes()]}, schema=pa.schema([("k", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())]))

    summed = train.mapInArrow(run, "k int, block int, counts binary").groupBy("k", "block").applyInArrow(add, "k int, block int, counts binary")
    out = np.zeros((2, BUCKETS // BLOCK, BLOCK), np.int64)
    for r in summed.toLocalIterator():
        out[r["k"], r["block"]] = np.frombuffer(r["counts"], np.int32)
    return out.reshape(2, BUCKETS)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, features: int = 8192, least: int = 3, alpha: float = 0.5, penalty: float = 0.001) -> Model:
    """Learns from at most about ``sample_rows`` rows of ``labels`` (``doc_id``, ``toxic`` 0 or 1; null labels are no labels).

    Without rows of both classes every text gets the share of toxic labels, one half if there are none."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    total = usable.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(share * 1_000_003)).dropDuplicates(["doc_id"])
    train = settle(tx.two(docs).join(F.broadcast(picked), "doc_id"))
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    nothing = np.zeros(BUCKETS, np.float32)
    if len(n) < 2:
        p = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return Model(nothing, float(np.log(p / (1 - p))))
    other, toxic = document_counts(train)
    ratio = np.log((toxic + alpha) / (n[1] + 2 * alpha)) - np.log((other + alpha) / (n[0] + 2 * alpha))
    expected = (toxic + other) * n[1] / (n[0] + n[1])
    chi = np.where(toxic + other >= least, (toxic - expected) ** 2 / np.maximum(expected, 1e-9), 0.0)
    kept = np.sort(np.argsort(-chi, kind="stable")[:features])
    kept = kept[chi[kept] > 0]
    if not len(kept):
        return Model(nothing, float(np.log(n[1] / n[0])))
    spot = np.full(BUCKETS, -1, np.int32)
    spot[kept] = np.arange(len(kept))
    scale, held = ratio[kept], docs.sparkSession.sparkContext.broadcast(spot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in tx.runs(batches, RUN):
            row, bucket = ngrams(rows)
            at = held.value[bucket]
            row, at = distinct(row[at >= 0], at[at >= 0].astype(np.int64))
            ends = np.searchsorted(row, np.arange(1, len(rows) + 1))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), tx.lists(at.astype(np.int32), ends)], names=["toxic", "at"])

    vector = F.udf(lambda at: Vectors.sparse(len(scale), at, scale[at]), VectorUDT())
    # The rarer class counts more, by the square root of the ratio: midway between calibrated and balanced.
    weight = F.when(F.col("toxic") == 1, float(np.sqrt(n[0] / n[1]))).otherwise(1.0)
    rows = settle(train.mapInArrow(run, "toxic int, at array<int>")).select(F.col("toxic").cast("double").alias("label"), vector("at").alias("features"), weight.alias("weight"))
    found = LogisticRegression(maxIter=40, regParam=penalty, standardization=False, weightCol="weight").fit(rows)
    weights = nothing.copy()
    weights[kept] = found.coefficients.toArray() * scale
    return Model(weights, float(found.intercept))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` (0 to 1) per row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    Null and empty texts have no n-grams, so their score is that of the intercept. Null ids are passed on, repeated rows are scored
    alike. No rows give no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def columns(rows: list[bytes]) -> list:
        model = held.value
        row, bucket = ngrams(rows)
        some = np.flatnonzero(model.weights[bucket])
        row, bucket = distinct(row[some], bucket[some])
        total = model.intercept + np.bincount(row, model.weights[bucket], len(rows))
        return [1 / (1 + np.exp(-np.clip(total, -60, 60)))]

    return tx.per_text(docs, "score double", columns, RUN)
