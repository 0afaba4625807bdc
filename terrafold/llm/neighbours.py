"""Approximate nearest neighbours by stable projections.

Largest inner product is nearest Euclidean distance once every row gets one more coordinate that brings it to the largest norm M
(queries get 0): then ``|q - x|^2 = |q|^2 + M^2 - 2 q.x``. A few Gaussian (2-stable) projections keep distances up to a chi-square
factor: ``projected^2 / true^2`` is chi-square with as many degrees of freedom as projections.

Rows are dealt to tiles by the first splits of a kd-tree fitted on a bounded sample of projected rows, large cells to several tiles by
hash; each tile is a kd-tree of projected rows. A query opens a tile's leaves in the order of their projected distance and verifies
their rows on the original vectors, until a row at the next leaf's distance would have to be an outlier of the chi-square law to be
nearer than the k-th found (probability ``1 - certainty``). The k-th best of the sample is where every tile starts. Queries and tiles
meet in blocks; all rows are indexed, none is capped."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.session import settle

LEAF = 128


def chi_square(x: np.ndarray, m: int) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total += term
    return 1 - np.exp(-half) * total


def projected(vectors: np.ndarray, extra: np.ndarray, m: int) -> np.ndarray:
    lines = np.random.default_rng(20140901).standard_normal((vectors.shape[1] + 1, m))
    return vectors @ lines[:-1] + extra[:, None] * lines[-1]


def extra_coordinate(vectors: np.ndarray, top: float) -> np.ndarray:
    return np.sqrt(np.maximum(top - np.einsum("ij,ij->i", vectors, vectors), 0.0))


def leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: median splits of the widest coordinate."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        own = points[rows]
        axis = int(np.argmax(own.max(0) - own.min(0)))
        order = rows[np.argsort(own[:, axis], kind="stable")]
        todo += [order[: len(rows) // 2], order[len(rows) // 2 :]]
    return out


def splits(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Axis and value of every inner node of a complete kd-tree in heap order."""
    nodes, groups = [], [points]
    for _ in range(depth):
        below = []
        for own in groups:
            axis = int(np.argmax(own.max(0) - own.min(0))) if len(own) else 0
            value = float(np.median(own[:, axis])) if len(own) else 0.0
            nodes.append((axis, value))
            below += [own[own[:, axis] < value], own[own[:, axis] >= value]]
        groups = below
    return nodes


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, summed coordinate by coordinate: equal vectors get equal scores wherever they stand."""
    out, part = np.zeros((len(queries), len(rows))), np.empty((len(queries), len(rows)))
    for j in range(queries.shape[1]):
        np.multiply(queries[:, j, None], rows[None, :, j], out=part)
        out += part
    return out


def pair_products(queries: np.ndarray, rows: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 16384) -> np.ndarray:
    """``products`` of the pairs ``a[i], b[i]``, to the same bit."""
    out = np.zeros(len(a))
    for at in range(0, len(a), step):
        part = out[at : at + step]
        for own in (queries[a[at : at + step]] * rows[b[at : at + step]]).T:
            part += own
    return out


def lengths(rows: np.ndarray) -> np.ndarray:
    """At least the length of each row, without squares that leave the range of doubles."""
    return np.abs(rows).max(axis=1, initial=0.0) * np.sqrt(rows.shape[1])


def likely(queries: np.ndarray, rows: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose inner product may reach the query's ``floor`` (``slack`` below the score wanted): all that do, told by one matrix product."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.nonzero(~(queries @ rows.T < floor[:, None]))


def slack(query_lengths: np.ndarray, longest: float, width: int) -> np.ndarray:
    """By how much at most two ways to sum inner products with rows up to ``longest`` may differ: each is off by less than the width times half a
    unit of the product of the lengths."""
    return 4 * width * np.finfo(float).eps * query_lengths * longest + np.finfo(float).tiny


def best(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: largest score, then smallest id; an id counts once in a row."""
    order = np.lexsort((ident, -score, row))
    row, score, ident = row[order], score[order], ident[order]
    first = np.r_[True, (row[1:] != row[:-1]) | (ident[1:] != ident[:-1]) | (score[1:] != score[:-1])] if len(row) else np.zeros(0, bool)
    row, score, ident = row[first], score[first], ident[first]
    start = np.searchsorted(row, row)
    keep = np.arange(len(row)) - start < k
    return row[keep], score[keep], ident[keep]


def search(ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, top: float, k: int, m: int, certainty: float):
    """Query number, score and id of what one tile offers: for each query up to ``k`` rows of at least the score ``floor``."""
    points = projected(vectors, extra_coordinate(vectors, top), m)
    asked = projected(queries, np.zeros(len(queries)), m)
    leaf_rows = leaves(points, LEAF)
    low, high = np.array([points[r].min(0) for r in leaf_rows]), np.array([points[r].max(0) for r in leaf_rows])
    bound = np.zeros((len(queries), len(leaf_rows)))
    for j in range(m):
        bound += np.maximum(np.maximum(low[None, :, j] - asked[:, j, None], asked[:, j, None] - high[None, :, j]), 0.0) ** 2
    order = np.argsort(bound, axis=1)
    norms = np.einsum("ij,ij->i", queries, queries)
    q_lengths, longest = lengths(queries), lengths(vectors).max(initial=0.0)
    none = np.zeros(0)
    row, score, ident = none.astype(np.int64), none, none.astype(np.int64)
    kth, alive = floor.copy(), np.arange(len(queries))
    for turn in range(len(leaf_rows)):
        leaf = order[alive, turn]
        # The squared distance of the k-th best; without k rows yet there is no test.
        true = np.maximum(norms[alive] + top - 2 * kth[alive], 1e-300)
        going = ~(chi_square(bound[alive, leaf] / true, m) >= certainty) | np.isneginf(kth[alive])
        # Leaves come in order of distance, and the k-th only gets nearer: a stopped query stays stopped.
        alive, leaf = alive[going], leaf[going]
        if not len(alive):
            break
        met = []
        low_enough = kth - slack(q_lengths, longest, queries.shape[1])
        for one in np.unique(leaf):
            here, rows = alive[leaf == one], leaf_rows[one]
            a, b = likely(queries[here], vectors[rows], low_enough[here])
            met.append((here[a], rows[b]))
        a, b = (np.concatenate(x) for x in zip(*met, strict=True))
        s = pair_products(queries, vectors, a, b)
        keep = (s >= kth[a]) & (ids[b] != q_ids[a])
        new = [(row, score, ident), (a[keep], s[keep], ids[b[keep]])]
        row, score, ident = best(*(np.concatenate(x) for x in zip(*new, strict=True)), k)
        end = np.searchsorted(row, np.arange(len(queries)), side="right")
        n = end - np.searchsorted(row, np.arange(len(queries)))
        full = n >= k
        kth[full] = np.maximum(kth[full], score[end[full] - 1])
    return row, score, ident


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = x
    return out


def nearest(rows: DataFrame, every: int = 20, k: int = 20, m: int = 12, certainty: float = 0.98, tile_rows: int = 4096, block_rows: int = 1024, sample_rows: int = 16384) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``rows`` (``vec_id``, ``embedding``) whose id is divisible by ``every`` the ``k``
    rows with the largest inner product found, its own id left out; ties to the smaller id. ``score`` is the inner product of the
    original vectors in double precision.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do rows with a null id. Vectors
    of different lengths are compared as if the shorter were filled with zeros. A repeated row counts once; other rows of one id
    with another vector are candidates of their own. No rows give no rows; fewer rows than ``k`` give all. ``sample_rows`` bounds
    the rows on which the splits are fitted and first bounds are taken; every row is indexed."""
    spark = rows.sparkSession
    vector = F.col("embedding").cast("array<double>")
    sane = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = settle(rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(sane).distinct())
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = valid.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("top"), F.max(F.size("v")).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not facts["asked"]:
        return spark.createDataFrame([], schema)
    top, width = float(facts["top"]) * (1 + 1e-9), facts["width"]

    picked = valid.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / facts["n"]) * (1 << 30))).toArrow()
    sample_ids, sample = picked.column("vec_id").to_numpy(), _matrix(picked.column("v"), width)
    tree_points = projected(sample, extra_coordinate(sample, top), m)
    wanted_tiles = max(1, -(-facts["n"] // tile_rows))
    depth = max(0, min(10, wanted_tiles.bit_length() - 1)) if len(sample) else 0
    tree = splits(tree_points, depth)
    start = (sample_ids[:2048], sample[:2048])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column("v"), width)
            at, points = np.zeros(len(own), np.int64), projected(own, extra_coordinate(own, top), m)
            for level in range(depth):
                nodes = tree[2**level - 1 : 2 ** (level + 1) - 1]
                axes, values = np.array([a for a, _ in nodes]), np.array([v for _, v in nodes])
                at = 2 * at + (points[np.arange(len(own)), axes[at]] >= values[at])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(at)], names=["vec_id", "v", "cell"])

    placed = settle(valid.mapInArrow(place, "vec_id long, v binary, cell long"))
    # At most 1024 cells.
    sizes = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = {c: max(1, -(-n // tile_rows)) for c, n in sizes.items()}
    firsts = dict(zip(parts, np.cumsum([0, *parts.values()])[:-1].tolist(), strict=True))
    n_tiles, n_blocks = sum(parts.values()), -(-facts["asked"] // block_rows)
    cells = spark.createDataFrame([(c, firsts[c], parts[c]) for c in parts], "cell long, first long, parts long")
    tiled = placed.join(F.broadcast(cells), "cell").select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).alias("tile"))

    def pack(table):  # noqa: ANN001, ANN202
        return pa.table({"key": table.column("key")[:1], "ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()), "data": pa.array([b"".join(table.column("v").to_pylist())], pa.binary())})

    packed = "key long, ids binary, data binary"
    tiles = tiled.withColumnRenamed("tile", "key").groupBy("key").applyInArrow(pack, packed)
    queries = placed.filter(F.col("vec_id") % every == 0).select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).alias("key"))
    blocks = queries.groupBy("key").applyInArrow(pack, packed)
    # Every block meets every tile: the rows here are whole blocks and tiles.
    left = settle(tiles).select(F.col("key").alias("tile"), "ids", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    right = settle(blocks).select(F.col("key").alias("block"), "ids", "data", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_tiles - 1).cast("long"))).alias("tile"))

    def meet(key, tile, block):  # noqa: ANN001, ANN202
        names = ["query_id", "vec_id", "score"]
        if not tile.num_rows or not block.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        read = lambda t: (np.frombuffer(t.column("ids")[0].as_py(), np.int64), np.frombuffer(t.column("data")[0].as_py(), np.float64).reshape(-1, width))
        (ids, vectors), (q_ids, asked) = read(tile), read(block)
        # The k-th best of the first sample rows: no later result can be worse.
        floor = np.full(len(asked), -np.inf)
        if len(start[0]) >= k and len(np.unique(start[0])) == len(start[0]):
            with np.errstate(over="ignore", invalid="ignore"):
                s = np.where(start[0][None, :] == q_ids[:, None], -np.inf, asked @ start[1].T)
                floor = np.partition(s, -k, axis=1)[:, -k] - slack(lengths(asked), lengths(start[1]).max(), width)
            floor[np.isnan(s).any(axis=1) | np.isnan(floor)] = -np.inf
        row, score, ident = search(ids, vectors, q_ids, asked, floor, top, k, m, certainty)
        return pa.table([pa.array(q_ids[row]), pa.array(ident), pa.array(score)], names=names)

    offered = left.groupBy("tile", "block").cogroup(right.groupBy("tile", "block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = offered.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
