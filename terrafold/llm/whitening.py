"""Whitening of embeddings by exact covariances.

Entries become integers, and every covariance comes from squares alone: with ``c`` the values centred by each dimension's rounded mean,
Spark adds up ``c_i ^ 2`` for every dimension and ``(c_i + c_j) ^ 2`` for every sum of two dimensions. Those sums are whole numbers without
rounding. The exact variance of a sum less those of its two parts is twice their covariance, and what the rounding of the mean left
over is taken off exactly too. Only ``d * (d + 1) / 2`` sums reach the driver, where the covariance matrix is put together for ``eigh``."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import settle

SCALE, SHIFT = 64, 1_000_000
#: Entries of one run of rows: bounds the memory of a task at any number of dimensions.
RUN_ENTRIES = 1 << 19
#: The largest size of a centred square that 64-bit sums are trusted with, and of one that a decimal of 38 digits holds over all rows.
SMALL, LARGE = 1 << 62, 10**37


@dataclass(frozen=True)
class Whitener:
    """What all rows share: ``n`` vectors of the fit list, their sums, and the components by falling variance (rows of ``axes``)."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    variances: np.ndarray
    axes: np.ndarray
    rank: int

    @property
    def explained(self) -> np.ndarray:
        total = float(np.trace(self.covariance))
        return self.variances / total if total > 0 else np.zeros(len(self.variances))


def kind_of(low: int, high: int) -> str:
    """The smallest integer type for all values."""
    return next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)


def coded(rows: DataFrame) -> tuple[DataFrame, int, int, int]:
    """``vec_id, x`` for the rows that take part, with the least and the largest value and the number of dimensions. ``x`` holds the
    integers less ``SHIFT`` in the smallest type that holds all of them, so equal vectors are equal bytes."""
    vector = F.col("embedding").cast("array<double>")
    sane = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).filter("v IS NOT NULL").filter(sane)
    facts = valid.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.max(F.size("v")).alias("width"), F.min(F.size("v")).alias("least")).first()
    width = facts["width"] or 0
    if not width:
        return valid.select("vec_id", F.lit(b"").alias("x")), 0, 0, 0
    if max(abs(facts["low"]), abs(facts["high"])) * SCALE >= 2**52:
        raise ValueError("entries from 2^46 on are too large for exact sums")
    low, high = math.floor(facts["low"] * SCALE), math.floor(facts["high"] * SCALE)
    if facts["least"] < width:
        low, high = min(low, 0), max(high, 0)
    kind = kind_of(low, high)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, RUN_ENTRIES // width)
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                column = batch.column("v")
                ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
                flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(kind)
                x = np.zeros((batch.num_rows, width), kind)
                lengths = np.diff(ends, prepend=0)
                row = np.repeat(np.arange(batch.num_rows), lengths)
                x[row, np.arange(len(flat)) - np.repeat(ends - lengths, lengths)] = flat
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "x"])

    return valid.mapInArrow(code, "vec_id long, x binary"), low, high, width


def matrices(batches: Iterator[pa.RecordBatch], width: int, kind: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, RUN_ENTRIES // width)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            yield batch, np.frombuffer(b"".join(batch.column("x").to_pylist()), kind).reshape(-1, width).astype(np.int64)


def totals(vectors: DataFrame, width: int, kind: str, part: Callable[[np.ndarray], dict[int, list[int]]]) -> dict[int, dict[int, int]]:
    """Whole-number sums over all rows, by group and place. Each task adds up its rows and gives one row per sum; Spark adds those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[int]] = {}
        for _, x in matrices(batches, width, kind):
            for group, values in part(x).items():
                own[group] = [a + b for a, b in zip(own[group], values, strict=True)] if group in own else values
        for group, values in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([group] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()), pa.array([str(v) for v in values])], names=["group", "place", "value"])

    added = vectors.select("x").mapInArrow(run, "group int, place int, value string").groupBy("group", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[int, dict[int, int]] = {}
    for r in added.collect():  # at most width * (width + 1) / 2 rows
        out.setdefault(r["group"], {})[r["place"]] = int(r["value"])
    return out


def fit(vectors: DataFrame, low: int, high: int, width: int, components: int = 16) -> Whitener:
    """The components of distinct coded vectors (``x``), by squares of single dimensions and of sums of two."""
    kind = kind_of(low, high)
    first = totals(vectors, width, kind, lambda x: {0: [len(x)], 1: x.sum(0).tolist()})
    n, sums = first[0][0], [first[1][j] for j in range(width)]
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    reach = 2 * (high - low + 1)
    if reach * reach * n >= LARGE:
        raise ValueError("entries too large, or too many, for exact sums")
    exact = np.int64 if reach * reach * max(1, RUN_ENTRIES // width) < SMALL else object

    def squares(x: np.ndarray) -> dict[int, list[int]]:
        c = (x - centre).astype(exact)
        out = {}
        for i in range(width):
            pair = c[:, i, None] + c[:, i + 1 :]
            # Place 0 of group i: the dimension itself; place k: its sum with dimension i + k.
            out[i] = [int((c[:, i] * c[:, i]).sum()), *(int(v) for v in (pair * pair).sum(0))]
        return out

    found = totals(vectors, width, kind, squares)
    # n^2 times each variance, whole numbers: the rounded centre leaves a rest in every dimension.
    rest = [s - n * int(m) for s, m in zip(sums, centre, strict=True)]
    alone = [n * found[i][0] - rest[i] ** 2 for i in range(width)]
    covariance = np.zeros((width, width))
    for i in range(width):
        covariance[i, i] = alone[i] / n**2
        for j in range(i + 1, width):
            together = n * found[i][j - i] - (rest[i] + rest[j]) ** 2
            covariance[i, j] = covariance[j, i] = (together - alone[i] - alone[j]) / (2 * n**2)
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    axes = columns[:, order].T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]
    variances = np.maximum(values[order], 0.0)
    rank = int((variances > width * np.finfo(float).eps * variances[0]).sum())
    return Whitener(n, tuple(sums), covariance, variances, axes, rank)


def centred(x: np.ndarray, model: Whitener, low: int, high: int) -> np.ndarray:
    """``n * x - sum`` of every entry, whole numbers."""
    exact = np.int64 if model.n * (high - low + 1) < SMALL and model.n * max(abs(low), abs(high)) < SMALL else object
    return x.astype(exact) * model.n - np.array(model.sums, exact)


def identity_error(vectors: DataFrame, model: Whitener, low: int, high: int, width: int) -> float:
    """The largest entry by which the covariance of the whitened fit list, taken from the list itself, misses the identity."""
    kind, k = kind_of(low, high), model.rank
    scale = (model.axes[:k] / np.sqrt(model.variances[:k])[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(k * k)
        for _, x in matrices(batches, width, kind):
            # The mean of a whitened column is that of x - sum / n, which is zero.
            w = (centred(x, model, low, high) / model.n).astype(float) @ scale
            own += (w.T @ w).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(own)], names=["place", "value"])

    added = vectors.select("x").mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    found = np.zeros(k * k)
    for r in added:
        found[r["place"]] = r["value"]
    return float(np.abs(found.reshape(k, k) / model.n - np.eye(k)).max()) if k else 0.0


def whitened(rows: DataFrame, components: int = 16) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: for every row of ``rows`` (``vec_id``, ``embedding``)
    whose vector is there and holds no null or non-finite entry, a row per component. An entry ``c`` counts as ``floor(64 * c) + 1000000``; each
    distinct vector of these integers counts once for mean, covariance and components. ``deviation`` is the sum of ``(n * x - sum)^2``, a decimal.

    Repeated rows and rows without an id get their rows too. Shorter vectors are filled with integers of a zero entry; vectors without any entry
    count as zeros, and if all are so, or no row is left, there are no rows. A component without variance (all vectors equal, or fewer vectors than
    dimensions) has a null ``whitened`` and takes no part in ``identity_error``. Entries of 2^46 and more raise a ``ValueError``."""
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    codes, low, high, width = coded(rows)
    if not width:
        return rows.sparkSession.createDataFrame([], schema)
    codes = settle(codes)
    vectors = settle(codes.select("x").distinct())
    model = fit(vectors, low, high, width, components)
    error, kind, k = identity_error(vectors, model, low, high, width), kind_of(low, high), len(model.variances)
    scale = np.where(np.arange(k) < model.rank, 1 / np.sqrt(np.maximum(model.variances, 1e-300)), np.nan)
    reach = (model.n * (high - low + 1)) ** 2 * width

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in matrices(batches, width, kind):
            c = centred(x, model, low, high)
            away = (c.astype(np.int64 if reach < SMALL else object) ** 2).sum(1)
            away = pa.array(away) if reach < SMALL else pa.array([str(v) for v in away], pa.string())
            w = ((c / model.n).astype(float) @ model.axes.T) * scale
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), away.take(pa.array(each)).cast(pa.decimal128(38, 0)),
                    pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
                ],
                schema=ARROW,
            )

    return codes.mapInArrow(give, schema)


ARROW = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
