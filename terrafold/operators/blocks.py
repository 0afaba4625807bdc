"""Block analytics: frontage, building measures, fingerprints, suitability, matching, calibration and feedback."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions import geo, ids, rules, tags
from terrafold.operators import spatial
from terrafold.session import settle

# Fixed values.
MIN_EDGE_M = 1e-6
SAMPLE_M, RAY_M, HALF_SPAN_M, PROBE_M = 1.0, 25.0, 0.5, 0.1
EXEMPLAR_MIN_COVERAGE, EXEMPLAR_MIN_BUILDINGS = 0.70, 3
DEFAULT_IQR_SHARE, SPARSE_GAP_FACTOR = 0.2, 4.0
REFERENCE_RADIUS_M = CALIBRATION_RADIUS_M = STYLE_RADIUS_M = 500.0
CALIBRATION_MIN_BLOCKS, CALIBRATION_LOW, CALIBRATION_HIGH = 2, 0.5, 2.0
WATER_BUFFER_M, INFORMAL_WATER_M, INFORMAL_HEIGHT_M, SPARSE_BELOW = 20.0, 150.0, 2.0, 6.0
TWO_STOREY_SHARE, TWO_STOREY_EVIDENCE, LEVEL_HEIGHT_M = 0.3, 3, 3.0
STRENGTH = ["service", "unclassified", "residential", "tertiary", "secondary", "primary", "trunk", "motorway"]
GROUPS = {
    "service": "local", "unclassified": "local", "residential": "local", "tertiary": "collector", "secondary": "collector",
    "primary": "arterial", "trunk": "arterial", "motorway": "arterial",
}
# What a block without measured buildings is given, in metres and storeys.
# Each tuple: lot width, lot depth, setback, gap between neighbours, storeys.
DEFAULTS = {"local": (10.0, 12.0, 4.0, 3.0, 2.0), "collector": (14.0, 16.0, 2.0, 1.0, 3.0), "arterial": (18.0, 20.0, 1.0, 0.0, 5.0)}
INFORMAL_DEFAULTS = (6.0, 7.0, 0.5, 0.5, 1.0)
EXCLUDED_LANDUSE = ["forest", "farmland", "cemetery", "railway", "industrial", "park"]
MEASURES = ["width", "depth", "front_setback", "side_gap"]


# -- frontage -------------------------------------------------------------------------------------

def frontage_edges(rings: DataFrame) -> DataFrame:
    """``block_id, ring_index, edge_index, ax..by, length_m`` of buildable rings in local metres, without degenerate edges."""
    e = rings.select("block_id", "ring_index", F.posexplode(geo.steps("ring")).alias("edge_index", "s"))
    e = e.select("block_id", "ring_index", "edge_index", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    return e.withColumn("length_m", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).filter(F.col("length_m") > MIN_EDGE_M)


def _point_at(ring: Column, position: Column) -> Column:
    """The point of a ring at a distance along it."""
    start = F.struct(F.lit(0.0).alias("len"), ring[0].alias("p"))

    def step(acc, s):
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        length = F.hypot(dx, dy)
        t = F.coalesce(F.try_divide(position - acc["len"], length), F.lit(0.0))
        here = (position >= acc["len"]) & (position <= acc["len"] + length)
        return F.struct((acc["len"] + length).alias("len"), F.when(here, geo.point(s["a"]["x"] + t * dx, s["a"]["y"] + t * dy)).otherwise(acc["p"]).alias("p"))

    return F.aggregate(geo.steps(ring), start, step, lambda acc: acc["p"])


class _Rings:
    """Rings one behind the other (``xy`` from ``bounds[i]`` to ``bounds[i + 1]`` in points), walked all in one numpy step."""

    def __init__(self, xy: np.ndarray, bounds: np.ndarray):
        self.xy, self.first, self.n_edges = xy, bounds[:-1], np.diff(bounds) - 1
        steps = np.hypot(*np.diff(xy, axis=0).T)
        self.cum, self.length = np.zeros(len(xy)), np.zeros(len(self.first))
        for i, (low, n) in enumerate(zip(self.first.tolist(), self.n_edges.tolist(), strict=True)):
            own = steps[low : low + n]
            self.length[i] = own.sum()
            np.cumsum(own, out=self.cum[low + 1 : low + n + 1])

    def walk(self, ring: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Points at distances along rings, as ``np.interp`` gives them."""
        low, last = self.first[ring], self.first[ring] + self.n_edges[ring]
        # The rings' lengths one after the other give the place but for rounding; the exact one is next to it.
        before = np.cumsum(self.length) - self.length
        points = np.repeat(np.arange(len(self.first)), self.n_edges + 1)
        j = np.clip(np.searchsorted(before[points] + self.cum, before[ring] + at, "right") - 1, low, last - 1)
        while (back := (j > low) & (at < self.cum[j])).any():
            j -= back
        while (on := (j < last - 1) & (at >= self.cum[j + 1])).any():
            j += on
        part, size = at - self.cum[j], self.cum[j + 1] - self.cum[j]
        # Beyond the last corner by rounding is that corner.
        end = at >= self.cum[last]
        out = np.empty((len(at), 2))
        with np.errstate(divide="ignore", invalid="ignore"):
            for axis in (0, 1):
                c = self.xy[:, axis]
                out[:, axis] = np.where(end, c[last], (c[j + 1] - c[j]) / size * part + c[j])
        return out

    def inside(self, ring: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether points lie in their rings; rings of as many edges are one step."""
        out = np.zeros(len(p), bool)
        edges_of = self.n_edges[ring]
        for n in np.unique(edges_of):
            rows = np.flatnonzero(edges_of == n)
            for part in np.array_split(rows, len(rows) * n // STEP_PAIRS + 1):
                at = self.first[ring[part]][:, None] + np.arange(n)
                (ax, ay), (bx, by) = (self.xy[k].transpose(2, 0, 1) for k in (at, at + 1))
                x, y = p[part, 0:1], p[part, 1:2]
                spans = (ay > y) != (by > y)
                rise = np.where(by == ay, 1.0, by - ay)
                out[part] = (spans & (x < ax + (y - ay) / rise * (bx - ax))).sum(axis=1) % 2 == 1
        return out


def _points_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The points of a column of lists of x, y, one row after the other, and where each row's begin and end."""
    bounds = lists.offsets.to_numpy().astype("int64")
    xy = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(float, copy=False).reshape(-1, 2)
    return xy, (bounds - bounds[0]) // 2


def _samples_of(rings: _Rings) -> tuple[np.ndarray, ...]:
    """Samples of rings: their ring, number in it, how many it has, its spacing and length, and x, y, nx, ny (the normal into it)."""
    count = np.array([max(1, round(x / SAMPLE_M)) for x in rings.length.tolist()], "int64")
    ring, idx = _spread(count)
    length, n = rings.length[ring], count[ring]
    at = (idx + 0.5) * (length / n)
    p = rings.walk(ring, at)
    span = rings.walk(ring, (at + HALF_SPAN_M) % length) - rings.walk(ring, (at - HALF_SPAN_M) % length)
    norm = np.hypot(span[:, 0], span[:, 1])
    flat_spot = norm <= MIN_EDGE_M
    span[flat_spot], norm[flat_spot] = (1.0, 0.0), 1.0
    normal = np.column_stack([-span[:, 1], span[:, 0]]) / norm[:, None]
    normal[~rings.inside(ring, p + normal * PROBE_M)] *= -1
    return ring, idx.astype("int32"), n.astype("int32"), length / n, length, *(np.ascontiguousarray(c) for c in (*p.T, *normal.T))


def frontage_samples(rings: DataFrame) -> DataFrame:
    """Samples about every metre along each ring, half a step off its start, with the unit normal into the ring. Some rings at a time are one
    numpy step, whose samples leave the task as rows; rings are spread over the cluster as the frame is."""
    ring_m = geo.planar_length("ring")
    long = rings.withColumn("_m", ring_m).filter(F.col("_m") > MIN_EDGE_M)
    long = long.select("block_id", "ring_index", F.flatten(F.transform("ring", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))).alias("xy"), "_m")
    names = ["block_id", "ring_index", "idx", "n", "spacing", "length_m", "x", "y", "nx", "ny"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(batch.column("_m").to_numpy() / SAMPLE_M + 1)
            at = 0
            while at < len(upto):
                end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP_SAMPLES, "right")))
                some = batch.slice(at, end - at)
                ring, *columns = _samples_of(_Rings(*_points_of(some.column("xy"))))
                ring = pa.array(ring)
                yield pa.RecordBatch.from_arrays([some.column("block_id").take(ring), some.column("ring_index").take(ring), *map(pa.array, columns)], names=names)
                at = end

    kinds = [rings.schema["block_id"], rings.schema["ring_index"], *(T.StructField(c, T.IntegerType()) for c in ("idx", "n")), *(T.StructField(c, T.DoubleType()) for c in ("spacing", "length_m", "x", "y", "nx", "ny"))]
    return long.mapInArrow(run, T.StructType([T.StructField(k.name, k.dataType) for k in kinds]))


#: Side of the tiles of a block in which rays and footprints meet, and about how many footprints one task step takes.
TILE_M, STEP_FOOTPRINTS, STEP_PAIRS = 250.0, 2000, 500_000
#: Samples that leave a task at a time, those of one ring more at most.
STEP_SAMPLES = 50_000


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts per item: the item of each unit and the unit's number within it."""
    item = np.repeat(np.arange(len(count)), count)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)


def _tile_keys(block: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    return (block.astype("int64") << 42) + ((tx.astype("int64") + (1 << 20)) << 21) + ty.astype("int64") + (1 << 20)


def _distances(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, edges: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Along each ray the distance to its footprint (``n`` rows of ``edges`` from ``first``; 0 inside, infinite when missed)."""
    ray, k = _spread(n)
    ax, ay, bx, by = edges[first[ray] + k].T
    px, py, rx, ry = x[ray], y[ray], (nx * RAY_M)[ray], (ny * RAY_M)[ray]
    with np.errstate(divide="ignore", invalid="ignore"):
        dx, dy, ox, oy = bx - ax, by - ay, ax - px, ay - py
        det = rx * dy - ry * dx
        u, w = (ox * dy - oy * dx) / det, (ox * ry - oy * rx) / det
        met = (det != 0) & (u >= 0) & (u <= 1) & (w >= 0) & (w <= 1)
        crossed = ((ay > py) != (by > py)) & (px < ax + (py - ay) / dy * dx)
    start = np.cumsum(n) - n
    nearest = np.minimum.reduceat(np.where(met, u * RAY_M, np.inf), start)
    return np.where(np.add.reduceat(crossed.astype(int), start) % 2 == 1, 0.0, nearest)


def _first_met(keys: np.ndarray, x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, tiles: np.ndarray, foot: np.ndarray, box: np.ndarray, xy: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rays whose tile is ``keys`` (none where negative) the first footprint each one meets, -1 for none, and how far.

    ``tiles``: sorted tiles with the number ``foot`` of a footprint that reaches into each; the first of equal distances in a tile wins."""
    starts, n_edges = bounds[:-1], np.maximum(np.diff(bounds) - 1, 0)
    edges = np.hstack([xy[:-1], xy[1:]])
    rows = np.flatnonzero(keys >= 0)
    low = np.searchsorted(tiles, keys[rows], "left")
    many = np.searchsorted(tiles, keys[rows], "right") - low
    best, best_d = np.full(len(x), -1), np.full(len(x), np.nan)
    ex, ey = x + nx * RAY_M, y + ny * RAY_M
    upto, at = np.cumsum(many), 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP_PAIRS, "right")))
        pair, k = _spread(many[at:end])
        s, b = rows[at:end][pair], foot[low[at:end][pair] + k]
        near = (np.minimum(x, ex)[s] <= box[b, 2]) & (np.maximum(x, ex)[s] >= box[b, 0]) & (np.minimum(y, ey)[s] <= box[b, 3]) & (np.maximum(y, ey)[s] >= box[b, 1]) & (n_edges[b] > 0)
        s, b = s[near], b[near]
        at = end
        if not len(s):
            continue
        d = _distances(x[s], y[s], nx[s], ny[s], edges, starts[b], n_edges[b])
        s, b, d = s[d < np.inf], b[d < np.inf], d[d < np.inf]
        first = np.lexsort((d, s))
        first = first[np.r_[True, s[first][1:] != s[first][:-1]][: len(first)]]
        best[s[first]], best_d[s[first]] = b[first], d[first]
    return best, best_d


def _meet(samples: pa.Table, feet: pa.Table, hit_type: pa.DataType) -> pa.Table:
    """Samples of some tiles with the first footprint of ``feet`` that each one's ray meets."""
    number = lambda t, c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
    feet = feet.take(pc.sort_indices(feet, sort_keys=[("building_id", "ascending")], null_placement="at_start"))
    blocks_here = pc.unique(feet["block_id"])
    owner = lambda t: pc.fill_null(pc.index_in(t["block_id"], value_set=blocks_here), -1).to_numpy()
    # Buildings stay in the order of their ids within a tile, so the first of equal distances has the lowest.
    tiles = _tile_keys(owner(feet), number(feet, "_tx"), number(feet, "_ty"))
    order = np.argsort(tiles, kind="stable")
    box = np.column_stack([number(feet, c) for c in ("_x0", "_y0", "_x1", "_y1")]).astype(float)
    x, y, nx, ny = (number(samples, c).astype(float) for c in ("x", "y", "nx", "ny"))
    block, ok = owner(samples), np.isfinite(x) & np.isfinite(y) & np.isfinite(nx) & np.isfinite(ny)
    ok &= (block >= 0) & samples["ring_index"].is_valid().to_numpy() & samples["idx"].is_valid().to_numpy()
    keys = np.full(len(x), -1)
    keys[ok] = _tile_keys(block[ok], np.floor(x[ok] / TILE_M), np.floor(y[ok] / TILE_M))
    best, best_d = _first_met(keys, x, y, nx, ny, tiles[order], order, box, *_points_of(feet["_foot"].combine_chunks()))
    found = feet["building_id"].combine_chunks().take(pa.array(best, mask=best < 0)).cast(hit_type)
    return samples.append_column("building_id", found).append_column("hit_m", pa.array(best_d, mask=best < 0))


def ray_hits(samples: DataFrame, buildings: DataFrame) -> DataFrame:
    """Per sample the first building its 25 m inward ray meets (``building_id, hit_m``), NULL when none; the lowest id wins ties.

    ``buildings``: ``block_id, building_id, ring`` in the block's metres. A sample lies in one tile of its block, a footprint goes to every tile
    from which a ray may reach it. Some tiles at a time are one numpy step; samples are shuffled once."""
    e, g = F.col("e"), lambda c: F.floor(c / TILE_M).cast("int")
    b = buildings.filter("block_id IS NOT NULL").select("block_id", "building_id", "ring", geo.envelope("ring").alias("e"))
    reach = RAY_M * 1.001
    b = b.withColumn("_tx", F.explode(F.sequence(g(e["min_lon"] - reach), g(e["max_lon"] + reach))))
    b = b.withColumn("_ty", F.explode(F.sequence(g(e["min_lat"] - reach), g(e["max_lat"] + reach))))
    feet = settle(b.select(
        "block_id", "building_id", "_tx", "_ty", e["min_lon"].alias("_x0"), e["min_lat"].alias("_y0"), e["max_lon"].alias("_x1"), e["max_lat"].alias("_y1"),
        F.flatten(F.transform("ring", lambda p: F.array(p["x"], p["y"]))).alias("_foot"),
    ))
    steps = max(feet.count() // STEP_FOOTPRINTS, 4 * int(feet.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    step = lambda tx, ty: F.pmod(F.xxhash64("block_id", tx, ty), F.lit(steps)).cast("int").alias("_step")
    columns = samples.columns
    schema = T.StructType([*samples.schema.fields, T.StructField("building_id", buildings.schema["building_id"].dataType), T.StructField("hit_m", T.DoubleType())])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        return _meet(left.select(columns), right, right.schema.field("building_id").type)

    left = samples.select("*", step(g(F.col("x")), g(F.col("y")))).groupBy("_step")
    return left.cogroup(feet.select("*", step("_tx", "_ty")).groupBy("_step")).applyInArrow(met, schema)


def frontage_runs(hits: DataFrame) -> DataFrame:
    """Circular stretches of equal label along each ring: ``building_id`` (NULL for a gap), ``start_m, size_m, seq, n_runs`` in walk order from the
    first sample that differs from its predecessor. A ring's samples are bounded by its length in metres."""
    w = W.partitionBy("block_id", "ring_index").orderBy("idx")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    label = F.col("building_id")
    before = F.when(F.col("idx") == 0, F.last(label).over(whole)).otherwise(F.lag(label).over(w))
    m = hits.withColumn("_new", (~label.eqNullSafe(before)).cast("int"))
    m = m.withColumn("_cum", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_all", F.sum("_new").over(whole))
    # Samples before the first change belong to the last run, which wraps over the ring's start.
    m = m.withColumn("seq", F.when(F.col("_all") == 0, F.lit(1)).when(F.col("_cum") == 0, F.col("_all")).otherwise(F.col("_cum")))
    first = F.coalesce(F.min(F.when(F.col("_new") == 1, F.col("idx"))), F.lit(0))
    g = m.groupBy("block_id", "ring_index", "seq").agg(
        F.first("building_id").alias("building_id"), first.alias("_first"), F.count("*").alias("_size"), F.first("spacing").alias("spacing"),
        F.first("length_m").alias("length_m"), F.greatest(F.max("_all"), F.lit(1)).alias("n_runs"),
    )
    return g.select("block_id", "ring_index", "seq", "n_runs", "building_id", "length_m", (F.col("_first") * F.col("spacing")).alias("start_m"), (F.col("_size") * F.col("spacing")).alias("size_m"))


def run_gaps(runs: DataFrame) -> DataFrame:
    """``block_id, gap_m``: uncovered stretches between two different buildings, and 0 where two different buildings touch."""
    w = W.partitionBy("block_id", "ring_index").orderBy("seq")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    prev = F.when(F.col("seq") == 1, F.last("building_id").over(whole)).otherwise(F.lag("building_id").over(w))
    nxt = F.when(F.col("seq") == F.col("n_runs"), F.first("building_id").over(whole)).otherwise(F.lead("building_id").over(w))
    r = runs.withColumn("_p", prev).withColumn("_x", nxt)
    free = F.col("building_id").isNull() & (F.col("n_runs") > 2) & ~F.col("_p").eqNullSafe(F.col("_x"))
    touch = F.col("building_id").isNotNull() & F.col("_x").isNotNull() & (F.col("building_id") != F.col("_x"))
    return r.select("block_id", F.when(free, F.col("size_m")).when(touch, F.lit(0.0)).alias("gap_m")).filter("gap_m IS NOT NULL")


def _runs_of(ring: np.ndarray, idx: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...]:
    """What ``frontage_runs`` finds, for samples in the order of their ring and ``idx`` (labels below 0 are gaps): per run its ring's number in that
    order, its label, the ``idx`` it begins with and how many samples it has."""
    first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ring)]))
    last = np.r_[first[1:], len(ring)] - 1
    before = np.r_[label[:1], label[:-1]]
    before = np.where(idx == 0, label[last][of], before)
    new = label != before
    upto = np.cumsum(new)
    upto -= (upto - new)[first][of]
    total = upto[last]
    # Samples before the first change belong to the last run, which wraps over the ring's start.
    seq = np.where(total[of] == 0, 1, np.where(upto == 0, total[of], upto))
    n_runs = np.maximum(total, 1)
    run = (np.cumsum(n_runs) - n_runs)[of] + seq - 1
    run_label, begin = np.empty(n_runs.sum(), label.dtype), np.zeros(n_runs.sum(), "int64")
    run_label[run[::-1]] = label[::-1]
    begin[run[new][::-1]] = idx[new][::-1]
    return np.repeat(np.arange(len(first)), n_runs), run_label, begin, np.bincount(run, minlength=len(begin))


def _gaps_of(of: np.ndarray, label: np.ndarray, size_m: np.ndarray) -> np.ndarray:
    """What ``run_gaps`` finds, for runs in the order of their ring: the gap at each, NaN for none."""
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    n_runs = np.diff(np.r_[first, len(of)])
    at, head, n = np.arange(len(of)), np.repeat(first, n_runs), np.repeat(n_runs, n_runs)
    before, after = label[np.where(at == head, head + n, at) - 1], label[np.where(at == head + n - 1, head, at + 1)]
    free = (label < 0) & (n > 2) & (before != after)
    touch = (label >= 0) & (after >= 0) & (label != after)
    return np.where(free, size_m, np.where(touch, 0.0, np.nan))


def _quantiles(group: np.ndarray, values: np.ndarray, n_groups: int, shares: tuple[float, ...]) -> list[np.ndarray]:
    """Exact quantiles of each group's values, between two of them as ``percentile`` has them; NaN where there are none."""
    v = values[np.lexsort((values, group))]
    n = np.bincount(group, minlength=n_groups)
    start, out = np.cumsum(n) - n, []
    for share in shares:
        at = np.maximum(n - 1, 0) * share
        low, high = np.floor(at).astype("int64"), np.ceil(at).astype("int64")
        q = np.full(n_groups, np.nan)
        has = n > 0
        a, b = v[(start + low)[has]], v[(start + high)[has]]
        q[has] = np.where(a == b, a, (high - at)[has] * a + (at - low)[has] * b)
        q[has] = np.where((low == high)[has], a, q[has])
        out.append(q)
    return out


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins in sorted columns."""
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _least(count: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The least of each item's ``count`` values that stand one behind the other, infinite where there are none."""
    out, has = np.full(len(count), np.inf), count > 0
    if has.any():
        out[has] = np.minimum.reduceat(np.where(np.isnan(values), np.inf, values), (np.cumsum(count) - count)[has])
    return out


def _to_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``geo.point_to_segment`` of arrays."""
    d = b - a
    squared = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
    t = np.clip(((p[:, 0] - a[:, 0]) * d[:, 0] + (p[:, 1] - a[:, 1]) * d[:, 1]) / np.where(squared == 0, 1.0, squared), 0.0, 1.0)
    t = np.where(squared == 0, 0.0, t)
    return np.hypot(p[:, 0] - (a[:, 0] + t * d[:, 0]), p[:, 1] - (a[:, 1] + t * d[:, 1]))


def _touching(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """``geo.segments_touch`` of arrays."""

    def side(p, q, r):
        v = (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
        return np.where(np.abs(v) <= geo.COLLINEAR_EPS, 0, np.where(v > 0, 1, -1))

    def between(p, q, r):
        return ((r >= np.minimum(p, q)) & (r <= np.maximum(p, q))).all(axis=1)

    o1, o2, o3, o4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    proper = (o1 * o2 == -1) & (o3 * o4 == -1)
    return proper | ((o1 == 0) & between(a, b, c)) | ((o2 == 0) & between(a, b, d)) | ((o3 == 0) & between(c, d, a)) | ((o4 == 0) & between(c, d, b))


def _apart(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far lines ``i`` of ``one`` are from lines ``j`` of ``other``: 0 where they touch, NaN where a line has no points."""
    (axy, ab), (bxy, bb) = one, other
    out = np.empty(len(i))
    n, m = np.diff(ab)[i], np.diff(bb)[j]
    upto, at = np.cumsum(n * m), 0
    while at < len(i):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP_PAIRS, "right")))
        some = slice(at, end)
        fa, fb, na, nb = ab[:-1][i[some]], bb[:-1][j[some]], n[some], m[some]
        ea, eb = np.maximum(na - 1, 0), np.maximum(nb - 1, 0)

        def pairs(x, y):
            of, k = _spread(x * y)
            return of, fa[of] + k // y[of], fb[of] + k % y[of]  # noqa: B023

        _, p, q = pairs(na, eb)
        d = _least(na * eb, _to_segments(axy[p], bxy[q], bxy[np.minimum(q + 1, len(bxy) - 1)]))
        _, p, q = pairs(ea, nb)
        d = np.minimum(d, _least(ea * nb, _to_segments(bxy[q], axy[p], axy[np.minimum(p + 1, len(axy) - 1)])))
        of, p, q = pairs(ea, eb)
        d[of[_touching(axy[p], axy[p + 1], bxy[q], bxy[q + 1])]] = 0.0
        out[some] = np.where(d < np.inf, d, np.nan)
        at = end
    return out


def _feet_in_tiles(block: np.ndarray, xy: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted tiles from which a ray may reach a footprint, the footprints' numbers (in their order within a tile), and all their boxes."""
    n = np.diff(bounds)
    box = np.full((len(n), 4), np.nan)
    has = np.flatnonzero(n > 0)
    if len(has):
        low, high = np.fmin.reduceat(xy, bounds[:-1][has]), np.fmax.reduceat(xy, bounds[:-1][has])
        box[has] = np.hstack([low, high])
    has = np.flatnonzero(np.isfinite(box).all(axis=1))
    reach = RAY_M * 1.001
    tile = lambda v: np.floor(v / TILE_M).astype("int64")
    x0, y0, x1, y1 = tile(box[has, 0] - reach), tile(box[has, 1] - reach), tile(box[has, 2] + reach), tile(box[has, 3] + reach)
    of, k = _spread((x1 - x0 + 1) * (y1 - y0 + 1))
    wide = (x1 - x0 + 1)[of]
    keys = _tile_keys(block[has][of], x0[of] + k % wide, y0[of] + k // wide)
    order = np.argsort(keys, kind="stable")
    return keys[order], has[of][order], box


def _measured(rings: pa.Table, houses: pa.Table) -> pa.Table:
    """``measure_blocks`` for some whole blocks: rows of measures (``kind`` 0), of gaps (1) and of coverage (2)."""
    rings = rings.filter(pc.is_valid(rings["block_id"]))
    houses = houses.take(pc.sort_indices(houses, sort_keys=[("building_id", "ascending")], null_placement="at_start"))
    block_type, id_type, index_type, levels_type = rings["block_id"].type, houses["building_id"].type, rings["ring_index"].type, houses["levels"].type
    names = pc.unique(rings["block_id"])
    own = pc.index_in(rings["block_id"], value_set=names).to_numpy()
    houses = houses.filter(pc.is_in(houses["block_id"].cast(block_type), value_set=names))
    home = pc.index_in(houses["block_id"].cast(block_type), value_set=names).to_numpy()
    # Numbers for the houses' names, -1 for none: a house without a name is a gap.
    label = pc.fill_null(houses["building_id"].combine_chunks().dictionary_encode().indices, -1).to_numpy().astype("int64")
    index = rings["ring_index"].combine_chunks()
    place = pc.fill_null(index.dictionary_encode().indices, -1).to_numpy().astype("int64") + 1
    _, group = np.unique(own.astype("int64") * (len(rings) + 2) + place, return_inverse=True)
    index = index.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out_names = ["kind", "block_id", "building_id", "ring_index", "start_m", "width_m", "depth_m", "front_setback_m", "levels", "gap_m", "coverage"]
    out_types = [pa.int32(), block_type, id_type, index_type, *[pa.float64()] * 4, levels_type, pa.float64(), pa.float64()]

    def rows(kind: int, block: np.ndarray, **columns) -> pa.Table:
        given = {"kind": pa.array(np.full(len(block), kind, "int32")), "block_id": names.take(pa.array(block)), **columns}
        made = [given.get(c, None) for c in out_names]
        made = [pa.nulls(len(block), t) if c is None else c if isinstance(c, pa.Array | pa.ChunkedArray) else pa.array(c, from_pandas=True) for c, t in zip(made, out_types, strict=True)]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made], schema=pa.schema(list(zip(out_names, out_types, strict=True))))

    # Samples of the rings that have a length, in the order of ring and number.
    ring_xy, ring_bounds = _points_of(rings["xy"].combine_chunks())
    length = rings["_m"].combine_chunks().to_numpy(zero_copy_only=False).astype(float)
    walked = np.flatnonzero((np.diff(ring_bounds) >= 2) & np.isfinite(length))
    lines = rings["xy"].combine_chunks().take(pa.array(walked))
    walks = _Rings(*_points_of(lines))
    foot_xy, foot_bounds = _points_of(houses["xy"].combine_chunks())
    long = length[walked] > MIN_EDGE_M
    if long.any():
        kept = walks if long.all() else _Rings(*_points_of(lines.filter(pa.array(long))))
        ring, idx, _, spacing, ring_m, x, y, nx, ny = _samples_of(kept)
        ring = walked[long][ring]
        keys = np.full(len(x), -1)
        ok = np.isfinite(x) & np.isfinite(y) & np.isfinite(nx) & np.isfinite(ny) & (place[ring] > 0)
        keys[ok] = _tile_keys(own[ring[ok]], np.floor(x[ok] / TILE_M), np.floor(y[ok] / TILE_M))
        tiles, foot, box = _feet_in_tiles(home, foot_xy, foot_bounds)
        best, hit_m = _first_met(keys, x, y, nx, ny, tiles, foot, box, foot_xy, foot_bounds) if len(tiles) else (np.full(len(x), -1), np.full(len(x), np.nan))
        mine = np.where(best >= 0, label[best] if len(label) else -1, -1)
        # Rings that agree in block and number are one: their samples stand side by side.
        order = np.lexsort((idx, group[ring]))
        ring, idx, spacing, ring_m, mine, hit_m = (v[order] for v in (ring, idx, spacing, ring_m, mine, hit_m))
        of, run_label, begin, size = _runs_of(group[ring], idx, mine)
        at = _heads(group[ring])
        one, spacing, ring_m = ring[at], spacing[at], ring_m[at]
        start_m, size_m = begin * spacing[of], size * spacing[of]
        gap = _gaps_of(of, run_label, size_m)
        n_all, n_met = np.bincount(own[ring], minlength=len(names)), np.bincount(own[ring], mine >= 0, minlength=len(names))
        seen = np.flatnonzero(n_all)
        others = [rows(1, own[one[of[gap >= 0]]], gap_m=gap[gap >= 0]), rows(2, seen, coverage=n_met[seen] / n_all[seen])]
    else:
        others, one, of, ring_m = [], np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
        run_label, start_m, size_m, ring, mine, hit_m = of, ring_m, ring_m, of, of, ring_m
    # Per house and ring the longest run (the first of equal ones) and all of them together; per house the ring that has most of it.
    met = np.flatnonzero(run_label >= 0)
    met = met[np.lexsort((start_m[met], -size_m[met], run_label[met], of[met]))]
    head = _heads(of[met], run_label[met])
    total = np.add.reduceat(size_m[met], head) if len(head) else np.zeros(0)
    met = met[head]
    block = own[one[of[met]]]
    order = np.lexsort((index[one[of[met]]], -total, run_label[met], block))
    head = order[_heads(block[order], run_label[met][order])]
    met, block = met[head], block[head]
    key = lambda b, l: b.astype("int64") * (len(houses) + 1) + l + 1
    fronting = key(block, run_label[met])
    hit = np.flatnonzero(mine >= 0)
    (setback,) = _quantiles(np.searchsorted(fronting, key(own[ring[hit]], mine[hit])), hit_m[hit], len(fronting), (0.5,))
    # With every ring of that block and number and every house of that name.
    house_key = key(home, label)
    by_group, by_key = np.argsort(group, kind="stable"), np.argsort(house_key, kind="stable")

    def matches(sorted_keys, asked):
        low = np.searchsorted(sorted_keys, asked, "left")
        item, k = _spread(np.searchsorted(sorted_keys, asked, "right") - low)
        return item, low[item] + k

    c, k = matches(group[by_group], group[one[of[met]]])
    r = by_group[k]
    item, k = matches(house_key[by_key], fronting[c])
    c, r, h = c[item], r[item], by_key[k]
    width, along = size_m[met][c], ring_m[of[met]][c]
    pmod = lambda v, n: np.where(np.fmod(v, n) < 0, np.fmod(np.fmod(v, n) + n, n), np.fmod(v, n))
    middle = pmod(start_m[met][c] + width / 2, along)
    on = np.searchsorted(walked, r)
    sound = np.flatnonzero((on < len(walked)) & (walked[np.minimum(on, len(walked) - 1)] == r)) if len(walked) else np.zeros(0, "int64")
    cross = np.full((len(c), 2), np.nan)
    if len(sound):
        cross[sound] = walks.walk(on[sound], pmod(middle + HALF_SPAN_M, along)[sound]) - walks.walk(on[sound], pmod(middle - HALF_SPAN_M, along)[sound])
    norm = np.hypot(cross[:, 0], cross[:, 1])
    n_points = np.diff(foot_bounds)[h]
    point_of, k = _spread(n_points)
    p = foot_xy[foot_bounds[:-1][h[point_of]] + k]
    with np.errstate(divide="ignore", invalid="ignore"):
        across = (-p[:, 0] * cross[point_of, 1] + p[:, 1] * cross[point_of, 0]) / norm[point_of]
    extent = -_least(n_points, -across) - _least(n_points, across)
    depth = np.where(norm <= MIN_EDGE_M, 0.0, np.where(np.isfinite(extent), extent, np.nan))
    ring_index, levels, ids_of = rings["ring_index"].combine_chunks(), houses["levels"].combine_chunks(), houses["building_id"].combine_chunks()
    measures = rows(
        0, block[c], building_id=ids_of.take(pa.array(h)), ring_index=ring_index.take(pa.array(r)), start_m=start_m[met][c], width_m=width, depth_m=depth, front_setback_m=setback[c], levels=levels.take(pa.array(h)),
    )
    # Houses no ray reaches: the ring of their block that is nearest.
    inner = np.flatnonzero((label < 0) | ~np.isin(house_key, fronting))
    by_block = np.argsort(own, kind="stable")
    item, k = matches(own[by_block], home[inner])
    h, r = inner[item], by_block[k]
    far = _apart((foot_xy, foot_bounds), (ring_xy, ring_bounds), h, r)
    order = np.lexsort((np.where(np.isnan(index[r]), -np.inf, index[r]), np.where(np.isnan(far), -np.inf, far), house_key[h]))
    best = order[_heads(house_key[h][order])]
    h, r, far, zero = h[best], r[best], far[best], np.zeros(len(best))
    interior = rows(0, home[h], building_id=ids_of.take(pa.array(h)), ring_index=ring_index.take(pa.array(r)), start_m=zero, width_m=zero, depth_m=zero, front_setback_m=far, levels=levels.take(pa.array(h)))
    return pa.concat_tables([measures, interior, *others])


def measure_blocks(rings: DataFrame, buildings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(measures, gaps, coverage)`` of blocks' real buildings against their frontage.

    ``measures``: one row per building of a block with a frontage: ring, longest run, width, depth across the ring there, median setback, levels. A
    building no ray reaches has width and depth 0 and its distance to the nearest ring as setback.

    Samples, their rays' hits, runs and gaps are what the functions above give, but for some whole blocks at a time in one numpy step: only rings and
    footprints are shuffled, a block's samples (bounded by its length in metres) stay in the task. Rows without a block are left out."""
    numbers = F.flatten(F.transform("ring", lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))).alias("xy")
    r = rings.filter("block_id IS NOT NULL").select("block_id", "ring_index", numbers, geo.planar_length("ring").alias("_m"))
    b = buildings.filter("block_id IS NOT NULL").select("block_id", "building_id", numbers, "levels")
    metres = r.agg(F.sum(F.when(F.col("_m") < float("inf"), F.col("_m")))).first()[0] or 0.0
    steps = int(max(metres / SAMPLE_M // STEP_SAMPLES, b.count() // STEP_FOOTPRINTS, 4 * int(rings.sparkSession.conf.get("spark.sql.shuffle.partitions")))) + 1
    step = F.pmod(F.xxhash64(F.col("block_id").cast(rings.schema["block_id"].dataType)), F.lit(steps)).cast("int").alias("_step")
    kinds = [
        T.StructField("kind", T.IntegerType()), rings.schema["block_id"], buildings.schema["building_id"], rings.schema["ring_index"],
        *(T.StructField(c, T.DoubleType()) for c in ("start_m", "width_m", "depth_m", "front_setback_m")), buildings.schema["levels"], *(T.StructField(c, T.DoubleType()) for c in ("gap_m", "coverage")),
    ]
    schema = T.StructType([T.StructField(k.name, k.dataType) for k in kinds])
    met = r.select("*", step).groupBy("_step").cogroup(b.select("*", step).groupBy("_step")).applyInArrow(_measured, schema)
    all_rows = settle(met)
    of = lambda kind, *columns: all_rows.filter(F.col("kind") == kind).select(*columns)
    measures = of(0, "block_id", "building_id", "ring_index", "start_m", "width_m", "depth_m", "front_setback_m", "levels")
    return measures, of(1, "block_id", "gap_m"), of(2, "block_id", "coverage")


SHAPE = ("width", "depth", "front_setback")


def _fingerprints_of(measures: pa.Table, gaps: pa.Table) -> pa.Table:
    """``fingerprints`` of some whole blocks, without their coverage."""
    names = pc.unique(measures["block_id"])
    number = lambda t, c: t[c].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False)
    block = pc.index_in(measures["block_id"], value_set=names).to_numpy().astype("int64")
    has = lambda which: np.bincount(block, which, minlength=len(names)) > 0
    width = number(measures, "width_m")
    known = measures["width_m"].is_valid().to_numpy()
    front = known & (width > 0)
    use = front | (has(known) & ~has(front))[block]

    def quantiles(values, which, shares):
        which = which & ~np.isnan(values)
        return _quantiles(block[which], values[which], len(names), shares)

    columns = [np.bincount(block, minlength=len(names)), *quantiles(number(measures, "levels"), np.ones(len(block), bool), (0.5,))]
    for name in SHAPE:
        middle, low, high = quantiles(number(measures, f"{name}_m"), use, (0.5, 0.25, 0.75))
        columns += [middle, high - low]
    of = pc.fill_null(pc.index_in(gaps["block_id"].cast(names.type), value_set=names), -1).to_numpy().astype("int64")
    gap = number(gaps, "gap_m")
    mine = (of >= 0) & ~np.isnan(gap)
    middle, low, high = _quantiles(of[mine], gap[mine], len(names), (0.5, 0.25, 0.75))
    columns += [middle, high - low]
    labels = ["buildings", "median_levels", *(f"{n}_{k}" for n in (*SHAPE, "side_gap") for k in ("median", "iqr"))]
    return pa.Table.from_arrays([names, *(pa.array(c, from_pandas=True) for c in columns)], names=["block_id", *labels])


def fingerprints(measures: DataFrame, gaps: DataFrame, coverage: DataFrame, styles: DataFrame | None = None) -> DataFrame:
    """One row per block: median and IQR of width, depth, setback and side gap, median levels, coverage, style, building count. Interior buildings
    count for levels and for the number of buildings, not for the shape, unless there are no others.

    Quantiles are exact; those of some whole blocks are one numpy step."""
    steps = max(measures.count() // STEP_SAMPLES, 4 * int(measures.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    kind = measures.schema["block_id"].dataType
    step = F.pmod(F.xxhash64(F.col("block_id").cast(kind)), F.lit(steps)).cast("int").alias("_step")
    dealt = lambda df, *columns: df.filter("block_id IS NOT NULL").select("block_id", *columns, step).groupBy("_step")
    doubles = ["median_levels", *(f"{n}_{k}" for n in (*SHAPE, "side_gap") for k in ("median", "iqr"))]
    schema = T.StructType([T.StructField("block_id", kind), T.StructField("buildings", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in doubles)])
    of_measures = dealt(measures, "width_m", "depth_m", "front_setback_m", "levels")
    fp = of_measures.cogroup(dealt(gaps, "gap_m")).applyInArrow(_fingerprints_of, schema)
    out = fp.join(coverage, "block_id").fillna(0.0, ["side_gap_median", "side_gap_iqr"])
    return out if styles is None else out.join(styles, "block_id")


def exemplars(fingerprint_rows: DataFrame, eligible: DataFrame) -> DataFrame:
    """Fingerprints of eligible blocks covered to at least 70 % with at least three buildings."""
    ok = (F.col("coverage") >= EXEMPLAR_MIN_COVERAGE) & (F.col("buildings") >= EXEMPLAR_MIN_BUILDINGS)
    return fingerprint_rows.filter(ok).join(eligible.select("block_id"), "block_id", "left_semi")


# -- roads and styles -----------------------------------------------------------------------------

def block_road_classes(members: DataFrame, segments: DataFrame) -> DataFrame:
    return members.join(segments.select("area_id", "segment_id", "class"), ["area_id", "segment_id"]).select("block_id", "class").distinct()


def road_groups(blocks: DataFrame, classes: DataFrame) -> DataFrame:
    """Group of the strongest road bounding a block; local when none is known."""
    rank = tags.lookup(F.col("class"), {c: i for i, c in enumerate(STRENGTH)})
    best = classes.groupBy("block_id").agg(F.max_by("class", rank).alias("class"))
    return blocks.select("block_id").join(best, "block_id", "left").select("block_id", F.coalesce(tags.lookup(F.col("class"), GROUPS), F.lit("local")).alias("road_group"))


def settlement_style(near_low_water, road_density) -> Column:
    """informal near low water, then sparse under 6 km of road per square kilometre of land, else regular."""
    return F.when(F.coalesce(geo.col(near_low_water), F.lit(False)), "informal").when(F.coalesce(geo.col(road_density), F.lit(0.0)) < SPARSE_BELOW, "sparse").otherwise("regular")


def near_low_water(distance_m, height_above_m) -> Column:
    return (geo.col(distance_m) <= INFORMAL_WATER_M) & (geo.col(height_above_m) < INFORMAL_HEIGHT_M)


def road_density(centers: DataFrame, edges: DataFrame, land: DataFrame, radius_m: float = STYLE_RADIUS_M) -> DataFrame:
    """Road kilometres per square kilometre of land within a circle. ``centers``: ``center_id, c_lat, c_lon``; ``edges``: straight road
    pieces ``ax, ay, bx, by`` in degrees; ``land``: ``center_id, land_m2``. Pieces are clipped to the circle by their parameter range."""
    line = F.array(geo.point("ax", "ay"), geo.point("bx", "by"))
    near = spatial.lines_within_radius(centers, edges.withColumn("line", line), radius_m)
    kx = geo.meters_per_degree_lon("c_lat")
    x1, y1 = (F.col("ax") - F.col("c_lon")) * kx, (F.col("ay") - F.col("c_lat")) * geo.METERS_PER_DEGREE
    x2, y2 = (F.col("bx") - F.col("c_lon")) * kx, (F.col("by") - F.col("c_lat")) * geo.METERS_PER_DEGREE
    dx, dy = x2 - x1, y2 - y1
    a, b, c = dx * dx + dy * dy, x1 * dx + y1 * dy, x1 * x1 + y1 * y1 - radius_m * radius_m
    root = F.sqrt(F.greatest(b * b - a * c, F.lit(0.0)))
    t0, t1 = F.greatest(F.lit(0.0), F.try_divide(-b - root, a)), F.least(F.lit(1.0), F.try_divide(-b + root, a))
    part = F.greatest(t1 - t0, F.lit(0.0)) * F.sqrt(a)
    km = near.groupBy("center_id").agg((F.sum(part) / 1000.0).alias("km"))
    d = F.when(F.col("land_m2") > 0, F.coalesce("km", F.lit(0.0)) / (F.col("land_m2") / 1e6)).otherwise(F.lit(0.0))
    return land.join(km, "center_id", "left").select("center_id", d.alias("road_density"))


def suitability(points: DataFrame, water: DataFrame, landuse: DataFrame, slopes: DataFrame | None, cell_m2: float) -> tuple[DataFrame, DataFrame]:
    """``(zones, suitable)`` per block from lattice points of its buildable area (``block_id, area_id, lat, lon, point_id``).

    Each excluded reason counts on its own (water within 20 m, slope above 0.30, excluded land use); suitable is what no reason takes.
    ``slopes``: ``point_id, slope``."""
    c = points.select(F.col("point_id").alias("center_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    wet = spatial.rings_within_radius(c, water.select("ring"), WATER_BUFFER_M).select(F.col("center_id").alias("point_id"), F.lit("water").alias("reason"))
    used = spatial.points_in_rings(points, landuse.filter(F.col("kind").isin(EXCLUDED_LANDUSE)).select("ring")).select("point_id", F.lit("landuse").alias("reason"))
    flags = wet.unionByName(used)
    if slopes is not None:
        flags = flags.unionByName(slopes.filter("slope > 0.30").select("point_id", F.lit("steep").alias("reason")))
    flags = flags.distinct()
    tagged = points.select("block_id", "point_id").join(flags, "point_id")
    zones = tagged.groupBy("block_id", "reason").agg((F.count("*") * cell_m2).alias("zone_m2"))
    free = points.select("block_id", "point_id").join(flags.select("point_id").distinct(), "point_id", "left_anti")
    left = free.groupBy("block_id").agg((F.count("*") * cell_m2).alias("suitable_m2"))
    every = points.groupBy("block_id").agg((F.count("*") * cell_m2).alias("buildable_m2"))
    return zones, every.join(left, "block_id", "left").fillna(0.0, ["suitable_m2"])


# -- references -----------------------------------------------------------------------------------

def match_score(distance_m, group_a, group_b, area_a, area_b, style_a, style_b) -> Column:
    """How unlike two blocks are; 0 for twins at one place. Four terms add up: how much of the search radius lies between them, a
    whole unit each for another road group and another style, and by what factor their areas differ (natural log)."""
    differs = lambda a, b: F.when(geo.col(a) == geo.col(b), 0.0).otherwise(1.0)
    return geo.col(distance_m) / REFERENCE_RADIUS_M + differs(group_a, group_b) + F.abs(F.ln(geo.col(area_a) / geo.col(area_b))) + differs(style_a, style_b)


#: Score within which the first round of ``match_references`` looks.
FIRST_SCORE = 1 / 32


def match_references(subjects: DataFrame, exemplar_rows: DataFrame, first: float = FIRST_SCORE) -> DataFrame:
    """The best exemplar within 500 m per block (its own when it is one). Both frames: ``block_id, lat, lon, road_group, area_m2, style``.

    Pairs are not all compared: blocks of equal attributes are one, and unresolved ones look for exemplars of their road group and style
    in a box of place and ln area that holds every score up to ``first``, then twice that and so on up to 1. What has nothing there
    meets all within 500 m. Best is a ``min`` over (score, id), so it combines map-side."""
    attributes = ["lat", "lon", "road_group", "area_m2", "style"]
    s = subjects.select(F.col("block_id").alias("center_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.col("road_group").alias("sg"), F.col("area_m2").alias("sa"), F.col("style").alias("ss"))
    own_attributes = ["c_lat", "c_lon", "sg", "sa", "ss"]
    asked = settle(s.groupBy(*own_attributes).count().drop("count").withColumn("sid", F.monotonically_increasing_id()))
    known = settle(exemplar_rows.groupBy(*attributes).agg(F.min(F.struct("block_id")).alias("b")).select(*attributes, "b.block_id"))
    sound = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) < float("inf")), F.lit(False))
    score = match_score("distance_m", "sg", "road_group", "sa", "area_m2", "ss", "style")
    # Scores equal but for rounding noise are ties, decided by the id.
    least = lambda value: F.min(F.struct(F.round(value, 9).alias("_tie"), "block_id", value.alias("score"))).alias("b")
    everything = lambda of, among: spatial.within_radius(of.withColumnRenamed("sid", "center_id"), among, REFERENCE_RADIUS_M).groupBy(F.col("center_id").alias("sid")).agg(least(score))
    # Areas without a logarithm have no score, and that comes first: they are compared in full.
    found = [everything(asked, known.filter(~sound("area_m2"))), everything(asked.filter(~sound("sa")), known.filter(sound("area_m2")))]
    pending, targets, reach = asked.filter(sound("sa")), known.filter(sound("area_m2")), first
    while reach <= 1 and not pending.isEmpty():
        bin_of = lambda c: F.floor(c / reach)  # noqa: E731, B023
        log = F.ln("sa")
        left = pending.withColumn("_bin", F.explode(F.sequence(bin_of(log - reach * 1.000001), bin_of(log + reach * 1.000001)))).withColumnRenamed("sid", "center_id")
        left = left.withColumn("_kind", F.struct(F.col("sg").alias("g"), F.col("ss").alias("s"), F.col("_bin").alias("bin"))).drop("_bin")
        right = targets.withColumn("_kind", F.struct(F.col("road_group").alias("g"), F.col("style").alias("s"), bin_of(F.ln("area_m2")).alias("bin")))
        near = spatial.within_radius(left, right, REFERENCE_RADIUS_M * reach, on="_kind")
        best = near.groupBy(F.col("center_id").alias("sid")).agg(least(score)).filter(F.col("b._tie") < reach - 1e-6)
        best = settle(best)
        found.append(best)
        pending = settle(pending.join(best, "sid", "left_anti"))
        reach *= 2
    found.append(everything(pending, targets))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    best = best.groupBy("sid").agg(F.min("b").alias("b")).join(asked, "sid")
    same = lambda c: F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}"))
    matches = s.alias("s").join(best.alias("a"), [same(c) for c in own_attributes]).select("center_id", "b")
    # A block that is an exemplar is its own reference.
    twin = s.join(exemplar_rows.select("block_id", "lat", "lon"), F.col("center_id") == F.col("block_id")).filter(geo.haversine("c_lat", "c_lon", "lat", "lon") <= REFERENCE_RADIUS_M)
    twin = twin.groupBy("center_id", "block_id").agg(least(F.lit(-1.0))).select("center_id", "b")
    best = matches.unionByName(twin).groupBy("center_id").agg(F.min("b").alias("b"))
    return subjects.select("block_id").join(best, F.col("block_id") == F.col("center_id"), "left").select("block_id", F.col("b.block_id").alias("reference_id"), F.when(F.col("b.score") < 0, F.lit(None)).otherwise(F.col("b.score")).alias("score"))


def blocks_within(points: DataFrame, blocks: DataFrame, areas: DataFrame, radius_m: float = REFERENCE_RADIUS_M) -> DataFrame:
    """Blocks of other completed areas whose centroid lies within a radius of a point (``center_id, c_lat, c_lon, own_area``)."""
    b = blocks.join(rules.completed(areas).select("area_id"), "area_id", "left_semi")
    return spatial.within_radius(points, b, radius_m, unlike=("own_area", "area_id"))


def default_fingerprint(road_group, style) -> Column:
    """Struct of the default medians and IQRs by road group and style."""
    g, s = geo.col(road_group), geo.col(style)

    def of(i):
        by_group = tags.lookup(g, {k: v[i] for k, v in DEFAULTS.items()})
        return F.when(s == "informal", F.lit(INFORMAL_DEFAULTS[i])).otherwise(by_group)

    values = {name: of(i) for i, name in enumerate(MEASURES)}
    values["side_gap"] = F.when(s == "sparse", values["side_gap"] * SPARSE_GAP_FACTOR).otherwise(values["side_gap"])
    cols = [x for name, v in values.items() for x in (v.alias(f"{name}_median"), (v * DEFAULT_IQR_SHARE).alias(f"{name}_iqr"))]
    return F.struct(*cols, of(4).alias("median_levels"))


def calibration(subjects: DataFrame, feedback: DataFrame) -> DataFrame:
    """``block_id, factor``: reported over generated buildings of at least two feedback blocks of the same style within 500 m, kept in 0.5 to 2. ``subjects``: ``block_id,
    lat, lon, style``; ``feedback``: ``block_id, lat, lon, style, target, generated`` (feedback blocks of the previous run). Blocks with feedback get none."""
    s = subjects.join(feedback.select("block_id"), "block_id", "left_anti")
    s = s.select(F.col("block_id").alias("center_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), "style")
    if all(isinstance(feedback.schema[c].dataType, T.IntegralType) for c in ("target", "generated")):
        near = spatial.sums_within_radius(s, feedback, CALIBRATION_RADIUS_M, "style", ["target", "generated"])
        g = near.groupBy("center_id").agg(F.sum("n").alias("n"), F.sum("target").alias("t"), F.sum("generated").alias("g"))
    else:
        # Sums of fractions depend on how they are added: pair by pair.
        near = spatial.within_radius(s.withColumnRenamed("style", "c_style"), feedback, CALIBRATION_RADIUS_M).filter("style = c_style")
        g = near.groupBy("center_id").agg(F.count("*").alias("n"), F.sum("target").alias("t"), F.sum("generated").alias("g"))
    ratio = F.greatest(F.least(F.col("t") / F.col("g"), F.lit(CALIBRATION_HIGH)), F.lit(CALIBRATION_LOW))
    return g.filter((F.col("n") >= CALIBRATION_MIN_BLOCKS) & (F.col("g") > 0)).select(F.col("center_id").alias("block_id"), ratio.alias("factor"))


def effective_fingerprint(blocks: DataFrame, references: DataFrame, fingerprint_rows: DataFrame, factors: DataFrame, feedback: DataFrame) -> DataFrame:
    """What a block builds with: its reference's fingerprint or the defaults, lot widths divided by the calibration factor, default levels where
    none were observed, and where the count comes from. ``blocks``: ``block_id, road_group, style``."""
    names = [f"{m}_{k}" for m in MEASURES for k in ("median", "iqr")]
    fp = fingerprint_rows.select(F.col("block_id").alias("reference_id"), F.lit(True).alias("_ref"), *[F.col(n).alias(f"r_{n}") for n in names], F.col("median_levels").alias("r_levels"))
    j = blocks.join(references.select("block_id", "reference_id"), "block_id", "left").join(fp, "reference_id", "left").join(factors, "block_id", "left")
    j = j.join(feedback.select("block_id", F.lit(True).alias("_fb")).distinct(), "block_id", "left").withColumn("d", default_fingerprint("road_group", "style"))
    pick = lambda n: F.when(F.col("_ref"), F.col(f"r_{n}")).otherwise(F.col(f"d.{n}"))
    scaled = lambda n: (pick(n) / F.coalesce("factor", F.lit(1.0))) if n.startswith("width") else pick(n)
    source = F.when(F.col("_fb"), "feedback").when(F.col("_ref"), "reference").otherwise("default")
    return j.select(
        "block_id", F.when(F.col("_ref"), F.col("reference_id")).alias("reference_id"), *(scaled(n).alias(n) for n in names),
        F.coalesce("r_levels", "d.median_levels").alias("median_levels"), F.col("r_levels").isNotNull().alias("levels_observed"), source.alias("count_source"),
    )


# -- storeys, capacity, feedback ------------------------------------------------------------------

def storey_shares(buildings: DataFrame) -> DataFrame:
    """``block_id, area_id, share`` of two-storey buildings among those stating 1 or 2 levels: the block's with at least three of them, else the
    area's, else 0.3."""
    low = F.col("levels").isin(1, 2)
    count = lambda by, p: buildings.groupBy(*by).agg(F.count_if(low).alias(f"{p}n"), F.count_if(F.col("levels") == 2).alias(f"{p}t"))
    b, a = count(["area_id", "block_id"], "b"), count(["area_id"], "a")
    share = lambda p: F.when(F.col(f"{p}n") >= TWO_STOREY_EVIDENCE, F.col(f"{p}t") / F.col(f"{p}n"))
    j = b.join(a, "area_id")
    own = F.when(F.col("block_id").isNotNull(), share("b"))
    return j.select("area_id", "block_id", F.coalesce(own, share("a"), F.lit(TWO_STOREY_SHARE)).alias("share"))


def plan_levels(median_levels, observed, seed, share) -> Column:
    """``struct<levels, height_m>``: the rounded median, at least 1; a stable 1-or-2 draw where a low default was not observed."""
    n = F.coalesce(F.greatest(F.lit(1), F.bround(geo.col(median_levels), 0).cast("int")), F.lit(1))
    levels = F.when(~geo.col(observed) & (n <= 2), ids.draw_storeys(seed, share)).otherwise(n)
    return F.struct(levels.cast("int").alias("levels"), (levels * LEVEL_HEIGHT_M).alias("height_m"))


def lot_capacity(edges: DataFrame, fp: DataFrame) -> DataFrame:
    """Lots a block's frontage holds: per edge the number of median-width lots and gaps that fit past the corner setback."""
    j = edges.join(fp.select("block_id", "width_median", "side_gap_median", "front_setback_median"), "block_id")
    n = F.floor((F.col("length_m") - F.col("front_setback_median") + F.col("side_gap_median")) / (F.col("width_median") + F.col("side_gap_median")))
    return j.groupBy("block_id").agg(F.sum(F.greatest(n, F.lit(0))).cast("bigint").alias("capacity"))


def apply_feedback(capacity: DataFrame, feedback: DataFrame) -> DataFrame:
    """``kept`` lots and ``shortfall`` per block: a reported count keeps an even pick of the lots and reports what is missing."""
    f = feedback.select("block_id", rules.feedback_target("building_count", "no_buildings").alias("target"))
    j = capacity.join(f, "block_id", "left")
    return j.select(
        "block_id", "capacity", "target", F.coalesce(F.least("capacity", "target"), "capacity").cast("bigint").alias("kept"),
        F.greatest(F.coalesce(F.col("target") - F.col("capacity"), F.lit(0)), F.lit(0)).cast("bigint").alias("shortfall"),
    )


def stale_reasons(runs: DataFrame, current: DataFrame) -> DataFrame:
    """``area_id, reasons``: roads_changed and terrain_changed from stored and current hash and elevation version."""
    j = runs.join(current.select("area_id", F.col("hash").alias("now_hash"), F.col("version").alias("now_version")), "area_id", "left")
    roads = F.when(~F.col("hash").eqNullSafe(F.col("now_hash")), "roads_changed")
    ground = F.when(~F.col("version").eqNullSafe(F.col("now_version")), "terrain_changed")
    return j.select("area_id", F.array_compact(F.array(roads, ground)).alias("reasons"))


def run_summary(assignments: DataFrame) -> DataFrame:
    """Per area: eligible blocks, buildings, blocks with buildings, mean calibration (four decimals) and the blocks short of their feedback, listed
    as rows are (the list holds only blocks a person gave feedback on)."""
    short = F.array_join(F.array_sort(F.collect_list(F.when(F.col("shortfall") > 0, F.col("block_id")))), ",")
    return assignments.groupBy("area_id").agg(
        F.count("*").alias("eligible_blocks"), F.sum("kept").alias("buildings"), F.count_if(F.col("kept") > 0).alias("blocks_with_buildings"),
        F.bround(F.avg("factor"), 4).alias("calibration"), short.alias("shortfall_blocks"),
    )


def counts_per_block(blocks: DataFrame, buildings: DataFrame, generated: DataFrame) -> DataFrame:
    n = lambda df, name: df.filter("block_id IS NOT NULL").groupBy("block_id").agg(F.count("*").alias(name))
    j = blocks.select("block_id").join(n(buildings, "real_count"), "block_id", "left").join(n(generated, "generated_count"), "block_id", "left")
    return j.fillna(0, ["real_count", "generated_count"])


ASSIGNMENT = "map<string,struct<style:string,reference_block_id:string,lot_count:int,calibration_ratio:double>>"


def read_assignments(runs: DataFrame, column: str = "blocks") -> DataFrame:
    """A run's JSON document (block id to assignment) as rows."""
    parsed = runs.select("area_id", F.explode(F.from_json(F.col(column), ASSIGNMENT)).alias("block_id", "a"))
    return parsed.select("area_id", "block_id", "a.*")


def block_properties(blocks: DataFrame, counts: DataFrame, assignments: DataFrame, references: DataFrame, feedback: DataFrame) -> DataFrame:
    """Export properties of blocks: eligibility, counts, whether and from whom they learn, style, feedback."""
    e = rules.eligibility("is_clipped", "is_median", "buildable_m2")
    ref = references.select("block_id", F.lit(True).alias("_is_ref")).distinct()
    fb = feedback.select("block_id", F.struct("building_count", "no_buildings").alias("feedback"))
    j = blocks.withColumn("eligibility", e).join(counts, "block_id", "left").join(assignments.select("block_id", "style", "reference_block_id"), "block_id", "left")
    j = j.join(ref, "block_id", "left").join(fb, "block_id", "left")
    return j.withColumn("is_reference", F.coalesce("_is_ref", F.lit(False))).drop("_is_ref")
