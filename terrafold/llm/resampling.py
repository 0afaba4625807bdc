"""Importance resampling towards a target collection.

Words and pairs of neighbouring words fall into buckets; Spark counts the buckets of the documents and of the target texts, and the
logarithm of the ratio of the two smoothed shares is a bucket's gain. A document's weight is the mean gain of its features, read from one
array. Gumbel noise drawn from the document's id turns "the highest so many" into a draw without replacement by weight.

The cut is found without a sort of everything: a quantile sketch proposes a bracket of scores, exact counts above and inside it tell
whether the cut lies there (if not, the bracket grows and is counted again), and only the rows of the bracket are put in order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.text import FOLD, runs, two
from terrafold.session import settle

def features(text: bytes) -> tuple[np.ndarray, int]:
    """The CRC-32 of every word and of every two neighbouring words joined by a blank, and the number of words."""
    found = text.translate(FOLD).split()
    single = list(map(zlib.crc32, found))
    # A pair's checksum goes on from that of its first word.
    double = map(zlib.crc32, [b" " + w for w in found[1:]], single[:-1])
    n = len(found)
    out = np.empty(max(2 * n - 1, 0), np.int64)
    out[:n] = single
    out[n:] = np.fromiter(double, np.int64, max(n - 1, 0))
    return out, n


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts (column ``text``) fall into each bucket. Tasks count on their own; at most ``buckets`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(buckets, np.int64)
        for _, rows in runs(batches):
            for t in rows:
                own += np.bincount(features(t)[0] % buckets, minlength=buckets)
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], names=["bucket", "n"])

    counted = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(pool: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural logarithm of (share in the target / share in the pool), one added to every bucket, floored."""
    s, t, b = pool.astype(float), target.astype(float), len(pool)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def scored(docs: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in runs(batches):
            n_words, n_features, weight = (np.zeros(len(rows), np.int64) for _ in range(3))
            for i, t in enumerate(rows):
                found, n_words[i] = features(t)
                n_features[i] = len(found)
                weight[i] = int(gain[found % buckets].sum()) // len(found) if len(found) else 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    rows = two(docs).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0)))).cast("long")
    return rows.withColumn("score", F.col("weight") + noise)


def order() -> list[Column]:
    """Best first. Rows that agree in all of these are alike in every column that counts."""
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their place (from 1) by ``order``: slices of ranges, each in order, that start where the slices before them end."""
    # The id that Spark gives rows holds the slice in its upper bits and the place in the slice in the lower 33.
    sliced = settle(rows.repartitionByRange(*order()).sortWithinPartitions(*order()).withColumn("_at", F.monotonically_increasing_id()))
    split = sliced.withColumn("_slice", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = {r["_slice"]: r["n"] for r in split.groupBy("_slice").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    starts = F.array(*map(F.lit, before)) if before else F.array(F.lit(0))
    return split.withColumn(name, (F.get(starts, F.col("_slice").cast("int")) + F.col("_place") + 1).cast("long")).drop("_at", "_slice", "_place")


def cutoff(pool: DataFrame, wanted: int, accuracy: int = 1000) -> tuple | None:
    """``(score, doc_id, n_features)`` of the row at place ``wanted`` of ``pool`` (a settled table); None where nothing is wanted.

    The sketch's quantiles on both sides of the wanted share are the bracket. Exact counts tell whether place ``wanted`` lies in it."""
    total = pool.count()
    wanted = min(wanted, total)
    if wanted <= 0:
        return None
    share, reach = 1 - wanted / total, 2 / accuracy
    while True:
        # With the whole range asked for, the sketch is not needed: the bracket is everything.
        low, high = pool.agg(*(F.percentile_approx("score", F.lit(float(q)), F.lit(accuracy)) for q in (max(share - reach, 0.0), min(share + reach, 1.0)))).first() if reach < 1 else (None, None)
        inside = F.lit(True) if low is None else F.col("score").between(low, high)
        n_above, n_inside = pool.agg(F.count_if(F.lit(False) if low is None else F.col("score") > high), F.count_if(inside)).first()
        if n_above < wanted <= n_above + n_inside:
            row = numbered(pool.filter(inside), "place").filter(F.col("place") == wanted - n_above).first()
            return row["score"], row["doc_id"], row["n_features"]
        reach *= 4


def not_after(last: tuple) -> Column:
    """Whether a row stands at or before ``last`` in ``order``; never null."""
    score, doc_id, n = last
    ahead = F.col("doc_id").isNotNull() if doc_id is None else F.coalesce(F.col("doc_id") < doc_id, F.lit(False))
    level = F.col("doc_id").eqNullSafe(F.lit(doc_id)) & (F.col("n_features") <= n)
    return (F.col("score") > score) | ((F.col("score") == score) & (ahead | level))


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, buckets: int = 10_000, least_words: int = 20, seed: int = 7) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every row of ``docs`` (``doc_id``, ``text``). Of the N documents with at least ``least_words``
    words, ``floor(percent * N / 100)`` are drawn towards the texts of ``target`` (``text``): those of the highest score, ties to the smaller id. ``rank`` counts
    them from 1 and is null for the others.

    A null or empty text has no features and weight 0. Each row counts on its own: rows of one id share their noise, and where they tie, the one
    with fewer features comes first, an id's absence last. Without target texts every gain compares with an even spread; an empty ``docs`` gives no rows."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = settle(scored(docs, gain, seed))
    able = rows.filter(F.col("n_words") >= least_words)
    wanted = percent * able.count() // 100
    last = cutoff(able, wanted)
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    upto = not_after(last) & (F.col("n_words") >= least_words)
    ranked = numbered(rows.filter(upto), "rank").withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return ranked.unionByName(rows.filter(~upto).withColumn("rank", F.lit(None).cast("long")))
