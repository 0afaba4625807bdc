"""Spatial joins: within a radius, box tests, nearest, containment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.functions import geo, rules
from terrafold.operators import cells
from terrafold.session import settle


def _met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides that share a cell. Sides are derived from files that may be many times smaller than their rows, so a size estimate would
    have Spark hold one whole side in every task; both are shuffled and sorted instead, which spills."""
    return left.join(right.hint("merge"), keys)


def within_radius(centers: DataFrame, points: DataFrame, radius_m: float, on: str | None = None, unlike: tuple[str, str] | None = None) -> DataFrame:
    """Every (center, point) pair at most ``radius_m`` apart, with ``distance_m``.

    ``centers`` has ``center_id, c_lat, c_lon``; ``points`` has ``lat, lon``. ``on`` adds an equality key such as the
    area. ``unlike`` names a column of each whose values must differ: a center then goes only to cells with points of another value, and meets those
    of one value at a time, so pairs of equal values are never made. Only centers are replicated (to the cells of their disc); points keep one row."""
    if radius_m <= 0:
        raise ValueError(f"radius must be positive, got {radius_m}")
    size = max(radius_m, 1.0)
    left = cells.with_box_cells(centers, cells.disc_box("c_lat", "c_lon", radius_m), size)
    right = cells.with_point_cell(points, "lat", "lon", size)
    keys = ["_band", "_cell"] + ([on] if on else [])
    if unlike:
        own, other = unlike
        held = right.select(*keys, other).distinct()
        left = left.join(held.hint("merge"), keys).filter(F.col(own) != F.col(other))
        keys = [*keys, other]
    return (
        _met(left, right, keys)
        .withColumn("distance_m", geo.haversine("c_lat", "c_lon", "lat", "lon"))
        .filter(F.col("distance_m") <= radius_m)
        .drop("_band", "_cell")
    )


#: About how many rows a task step of ``sums_within_radius`` takes, and how many pairs it has at a time.
STEP_ROWS, STEP_PAIRS = 100_000, 500_000
#: Degrees within which a bound is not trusted: 0.1 mm.
UNSURE = 1e-9


def sums_within_radius(centers: DataFrame, points: DataFrame, radius_m: float, on: str, values: list[str]) -> DataFrame:
    """Per row of ``centers`` (``center_id, c_lat, c_lon, <on>``) how many points (``lat, lon, <on>``) of equal ``on`` lie at most ``radius_m`` away, as
    ``n``, and the sums of their whole-number columns ``values`` (null where all are null). Centers without any have no row.

    Pairs are not made: the points of a center's cell and the cells around it lie in strips of latitude, sorted by longitude. In a strip the points that are
    surely inside are one stretch, whose sum is the difference of two running sums; only those near the circle are measured. The more points there
    are, the thinner the strips, so a center costs about the square root of the points around it. Whole numbers make the sums exact."""
    if radius_m <= 0:
        raise ValueError(f"radius must be positive, got {radius_m}")
    size = max(radius_m, 1.0)
    sound = lambda df, *columns: df.filter(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(CAST(`{c}` AS DOUBLE))" for c in columns) + f" AND `{on}` IS NOT NULL")
    left = sound(centers, "c_lat", "c_lon").select("center_id", F.col("c_lat").cast("double").alias("c_lat"), F.col("c_lon").cast("double").alias("c_lon"), F.col(on).alias("_on"))
    right = sound(points, "lat", "lon").select(F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.col(on).cast(left.schema["_on"].dataType).alias("_on"), *(F.col(v).cast("long").alias(v) for v in values))
    steps = max(9 * right.count() // STEP_ROWS, left.count() // STEP_ROWS, 4 * int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    step = F.pmod(F.xxhash64("_on", "_band", "_cell"), F.lit(steps)).cast("int").alias("_step")
    left = cells.with_point_cell(left, "c_lat", "c_lon", size).select("*", step).groupBy("_step")
    right = cells.with_box_cells(right, cells.disc_box("lat", "lon", radius_m), size).select("*", step).groupBy("_step")
    schema = T.StructType([T.StructField("center_id", centers.schema["center_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("n", *values))])
    return left.cogroup(right).applyInArrow(lambda c, p: _sums_within(c, p, radius_m, values), schema)


def _runs(count: np.ndarray, most: int):
    """Slices of items whose counts add up to about ``most``, one item at least."""
    upto, at = np.cumsum(count), 0
    while at < len(count):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    item = np.repeat(np.arange(len(count)), count)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)


def _added(count: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each item's ``count`` rows of ``values``, which stand one behind the other."""
    upto = np.vstack([np.zeros((1, values.shape[1]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(count)
    return upto[ends] - upto[ends - count]


def _near(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """``geo.haversine`` of arrays."""
    a1, o1, a2, o2 = (np.radians(v) for v in (lat1, lon1, lat2, lon2))
    s1, s2 = np.sin((a2 - a1) / 2), np.sin((o2 - o1) / 2)
    return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(s1 * s1 + np.cos(a1) * np.cos(a2) * s2 * s2))


def _sums_within(c: pa.Table, p: pa.Table, radius_m: float, values: list[str]) -> pa.Table:
    """``sums_within_radius`` of some whole cells."""
    names = ["center_id", "n", *values]
    if not len(c) or not len(p):
        return pa.Table.from_arrays([c["center_id"].combine_chunks().slice(0, 0), *(pa.array([], pa.int64()) for _ in names[1:])], names=names)
    number = lambda t, k: t[k].combine_chunks().to_numpy(zero_copy_only=False)
    group = np.zeros(len(c) + len(p), "int64")
    for k in ("_on", "_band", "_cell"):
        code = pa.concat_arrays([c[k].combine_chunks(), p[k].combine_chunks()]).dictionary_encode().indices.to_numpy()
        group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)[1]
    gc, gp = group[: len(c)], group[len(c) :]
    n_groups = int(group.max()) + 1
    lat, lon, clat, clon = number(p, "lat"), number(p, "lon"), number(c, "c_lat"), number(c, "c_lon")
    reach = np.degrees(radius_m / geo.EARTH_RADIUS_M)
    height = reach / np.clip(np.sqrt(np.bincount(gp, minlength=n_groups)) / 4, 1, 1024)
    row = np.floor(lat / height[gp]).astype("int64")
    low, high = np.full(n_groups, np.iinfo("int64").max), np.full(n_groups, np.iinfo("int64").min)
    np.minimum.at(low, gp, row)
    np.maximum.at(high, gp, row)
    some = high >= low
    n_rows = np.where(some, high - np.where(some, low, 0) + 1, 0)
    first_row = np.cumsum(n_rows) - n_rows
    # Longitudes are counted from a point of the group, so the antimeridian is nowhere near.
    origin = np.zeros(n_groups)
    origin[gp] = lon
    from_origin = lambda v, g: np.mod(v - origin[g] + 180, 360) - 180
    x, strip = from_origin(lon, gp), first_row[gp] + row - low[gp]
    order = np.lexsort((x, strip))
    lat, lon, x, strip = lat[order], lon[order], x[order], strip[order]
    ranked = np.sort(x)
    place = strip * (len(x) + 1) + np.searchsorted(ranked, x, "left")
    columns = [p[v].combine_chunks() for v in values]
    # A count of one each, then per column the value and whether there is one.
    add = np.column_stack([np.ones(len(x), "int64"), *(a for v in columns for a in (v.fill_null(0).to_numpy(), v.is_valid().to_numpy(zero_copy_only=False).astype("int64")))])
    add[:, 1:] = add[order, 1:]
    upto = np.vstack([np.zeros((1, add.shape[1]), "int64"), np.cumsum(add, axis=0)])
    from_row = np.maximum(np.floor((clat - reach - UNSURE) / height[gc]).astype("int64"), np.where(some, low, 0)[gc])
    to_row = np.minimum(np.floor((clat + reach + UNSURE) / height[gc]).astype("int64"), np.where(some, high, -1)[gc])
    strips = np.where(some[gc], np.maximum(to_row - from_row + 1, 0), 0)
    total = np.zeros((len(c), add.shape[1]), "int64")
    half = lambda degrees: np.sin(np.radians(degrees) / 2) ** 2
    for part in _runs(strips, STEP_PAIRS // 2):
        of, k = _spread(strips[part])
        of += part.start
        g, own_lat, own_x = gc[of], clat[of], from_origin(clon[of], gc[of])
        r = from_row[of] + k
        south, north = r * height[g], (r + 1) * height[g]
        cos_s, cos_n, cos_c = (np.maximum(np.cos(np.radians(v)), 1e-12) for v in (south, north, own_lat))
        nearest = np.maximum(np.maximum(south - own_lat, own_lat - north) - UNSURE, 0.0)
        farthest = np.maximum(np.abs(own_lat - south), np.abs(own_lat - north)) + UNSURE
        widest = np.where((south < 0) & (north > 0), 1.0, np.maximum(cos_s, cos_n))
        wide = lambda room, cos: np.degrees(2 * np.arcsin(np.sqrt(np.clip(room / (cos_c * cos), 0, 1))))  # noqa: B023, E731
        outer = wide(half(reach) - half(nearest), np.minimum(cos_s, cos_n)) + UNSURE
        inner = wide(half(reach) - half(farthest), widest) - UNSURE
        around = np.abs(own_x) + outer >= 180
        outer, inner = np.where(around, 400.0, outer), np.where(around, -1.0, inner)
        base = (first_row[g] + r - low[g]) * (len(x) + 1)
        at = lambda v, side: np.searchsorted(place, base + np.searchsorted(ranked, v, side), "left")  # noqa: B023, E731
        a, z = at(own_x - outer, "left"), at(own_x + outer, "right")
        b, y = at(own_x - inner, "left"), at(own_x + inner, "right")
        b, y = np.where(inner < 0, z, b), np.where(inner < 0, z, y)
        found = upto[y] - upto[b]
        # Points between the two bounds, on both sides.
        for some_rows in _runs((b - a) + (z - y), STEP_PAIRS):
            for lower, upper in ((a, b), (y, z)):
                count = (upper - lower)[some_rows]
                item, j = _spread(count)
                j += lower[some_rows][item]
                own = of[some_rows][item]
                met = _near(clat[own], clon[own], lat[j], lon[j]) <= radius_m
                found[some_rows] += _added(count, add[j] * met[:, None])
        total[part] = _added(strips[part], found)
    has = np.flatnonzero(total[:, 0])
    total = total[has]
    sums = [pa.array(total[:, 1 + 2 * i], mask=total[:, 2 + 2 * i] == 0) for i in range(len(values))]
    return pa.Table.from_arrays([c["center_id"].combine_chunks().take(pa.array(has)), pa.array(total[:, 0]), *sums], names=names)


def rings_within_radius(centers: DataFrame, rings: DataFrame, radius_m: float, on: str | None = None) -> DataFrame:
    """(center, ring) pairs at most ``radius_m`` apart; a center inside a ring is at distance 0.

    ``rings`` has ``ring`` and any attributes. Both sides are exploded to cells; each pair survives in one cell only."""
    if radius_m <= 0:
        raise ValueError(f"radius must be positive, got {radius_m}")
    size = max(radius_m, 50.0)
    disc = cells.disc_box("c_lat", "c_lon", radius_m)
    left = centers.select("*", *(v.alias(f"_d_{k}") for k, v in disc.items()))
    left = cells.with_box_cells(left, cells.box_columns("_d_"), size)
    right = rings.withColumn("_e", geo.envelope("ring"))
    right = right.select("*", *(F.col(f"_e.{k}").alias(f"_e_{k}") for k in disc)).drop("_e")
    right = cells.with_box_cells(right, cells.box_columns("_e_"), size)
    keys = ["_band", "_cell"] + ([on] if on else [])
    once = cells.meets_here(cells.box_columns("_d_"), cells.box_columns("_e_"), size)
    inside = geo.point_in_ring("c_lon", "c_lat", "ring")
    out = left.join(right, keys).filter(once)
    out = out.withColumn(
        "distance_m", F.when(inside, F.lit(0.0)).otherwise(geo.metric_distance_to_line("c_lat", "c_lon", "ring"))
    )
    return out.filter(F.col("distance_m") <= radius_m).drop("_band", "_cell", *[f"_d_{k}" for k in disc], *[f"_e_{k}" for k in disc])


def points_in_boxes(points: DataFrame, boxes: DataFrame, strict: bool = False, size_m: float = 500.0, on: str | None = None) -> DataFrame:
    """(point, box) pairs with the point inside the box; ``strict`` leaves the edge out."""
    left = cells.with_point_cell(points, "lat", "lon", size_m)
    right = cells.with_box_cells(boxes, cells.box_columns(), size_m)
    lat, lon, b = F.col("lat"), F.col("lon"), cells.box_columns()
    inside = (
        (lat > b["min_lat"]) & (lat < b["max_lat"]) & (lon > b["min_lon"]) & (lon < b["max_lon"])
        if strict
        else rules.in_box("lat", "lon", b)
    )
    return left.join(right, ["_band", "_cell"] + ([on] if on else [])).filter(inside).drop("_band", "_cell")


def _rings_against_boxes(rings: DataFrame, boxes: DataFrame, size_m: float) -> DataFrame:
    b = cells.box_columns()
    left = rings.withColumn("_e", geo.envelope("ring"))
    left = left.select("*", *(F.col(f"_e.{k}").alias(f"_e_{k}") for k in b)).drop("_e")
    left = cells.with_box_cells(left, cells.box_columns("_e_"), size_m)
    right = cells.with_box_cells(boxes, b, size_m)
    return left.join(right, ["_band", "_cell"]).filter(cells.meets_here(cells.box_columns("_e_"), b, size_m))


def rings_in_boxes(rings: DataFrame, boxes: DataFrame, size_m: float = 500.0) -> DataFrame:
    """(ring, box) pairs with the whole ring inside the box; a box edge may be touched because the
    ring's interior still lies inside."""
    out = _rings_against_boxes(rings, boxes, size_m).filter(rules.covered_by("ring", cells.box_columns()))
    return out.drop("_band", "_cell", "_e_min_lat", "_e_min_lon", "_e_max_lat", "_e_max_lon")


def rings_meeting_boxes(rings: DataFrame, boxes: DataFrame, size_m: float = 500.0) -> DataFrame:
    """(ring, box) pairs that share at least a point."""
    box_ring = geo.bbox_ring("min_lat", "min_lon", "max_lat", "max_lon")
    whole = rules.covered_by("ring", cells.box_columns())
    out = _rings_against_boxes(rings, boxes, size_m).filter(whole | geo.rings_intersect(F.col("ring"), box_ring))
    return out.drop("_band", "_cell", "_e_min_lat", "_e_min_lon", "_e_max_lat", "_e_max_lon")


def points_in_rings(points: DataFrame, rings: DataFrame, on: str | None = None, size_m: float = 250.0, edge_counts: bool = True) -> DataFrame:
    """(point, ring) pairs with the point inside (or, with ``edge_counts``, on) the ring."""
    left = cells.with_point_cell(points, "lat", "lon", size_m)
    right = rings.withColumn("_e", geo.envelope("ring"))
    right = cells.with_box_cells(right, F.col("_e"), size_m).drop("_e")
    hit = geo.point_in_ring("lon", "lat", "ring")
    if edge_counts:
        hit = hit | geo.point_on_ring("lon", "lat", "ring")
    return left.join(right, ["_band", "_cell"] + ([on] if on else [])).filter(hit).drop("_band", "_cell")


def points_covered(points: DataFrame, rings: DataFrame, on: str, also: Column, size_m: float = 250.0) -> DataFrame:
    """Points inside or on a ring of equal ``on`` for which ``also`` holds. A point leaves at the first such ring, its box is looked at before its edges, and pairs
    are not made."""
    left = cells.with_point_cell(points, "lat", "lon", size_m)
    right = cells.with_box_cells(rings.withColumn("_e", geo.envelope("ring")), F.col("_e"), size_m)
    right = right.select("*", *(F.col(f"_e.{k}").alias(f"_e_{k}") for k in cells.box_columns())).drop("_e")
    # Wider than what counts as on the edge.
    lat, lon, near = F.col("lat"), F.col("lon"), 1e-6
    boxed = (lat >= F.col("_e_min_lat") - near) & (lat <= F.col("_e_max_lat") + near) & (lon >= F.col("_e_min_lon") - near) & (lon <= F.col("_e_max_lon") + near)
    hit = geo.point_in_ring("lon", "lat", "ring") | geo.point_on_ring("lon", "lat", "ring")
    keys = ["_band", "_cell", on]
    theirs = right.select(*(F.col(c).alias(f"_r{c}") if c in keys else F.col(c) for c in right.columns)).hint("merge")
    same = [F.col(c) == F.col(f"_r{c}") for c in keys]
    return left.join(theirs, [*same, boxed & F.coalesce(also, F.lit(False)) & hit], "left_semi").drop("_band", "_cell")


def lines_meeting_rings(lines: DataFrame, rings: DataFrame, on: str | None = None, size_m: float = 250.0) -> DataFrame:
    """(line, ring) pairs that share a point; lines in ``line``, rings in ``ring``."""
    left = lines.withColumn("_l", geo.envelope("line"))
    left = cells.with_box_cells(left, F.col("_l"), size_m)
    right = rings.withColumn("_r", geo.envelope("ring"))
    right = cells.with_box_cells(right, F.col("_r"), size_m)
    l, r = F.col("_l"), F.col("_r")
    out = left.join(right, ["_band", "_cell"] + ([on] if on else [])).filter(cells.meets_here(l, r, size_m))
    return out.filter(geo.line_intersects_ring("line", "ring")).drop("_l", "_r", "_band", "_cell")


def rings_meeting_rings(shapes: DataFrame, rings: DataFrame, on: str | None = None, size_m: float = 250.0) -> DataFrame:
    """(shape, ring) pairs that share a point; shapes in ``shape``, scope rings in ``ring``."""
    left = shapes.withColumn("_l", geo.envelope("shape"))
    left = cells.with_box_cells(left, F.col("_l"), size_m)
    right = rings.withColumn("_r", geo.envelope("ring"))
    right = cells.with_box_cells(right, F.col("_r"), size_m)
    out = left.join(right, ["_band", "_cell"] + ([on] if on else [])).filter(cells.meets_here(F.col("_l"), F.col("_r"), size_m))
    return out.filter(geo.rings_intersect("shape", "ring")).drop("_l", "_r", "_band", "_cell")


#: No two points are farther apart.
HALF_GLOBE_M = 20_015_200.0


def nearest(queries: DataFrame, targets: DataFrame, target_id: str, on: str | None = None, start_m: float = 250.0, shape: str | None = None) -> DataFrame:
    """The nearest target of every query point, ties by target id, as ``nearest_id`` and ``distance_m``.

    ``queries`` has ``query_id, q_lat, q_lon``. Targets are points (``lat, lon``) or, with ``shape``, lines in that
    column. The search disc starts at ``start_m`` and doubles for unresolved queries only (so a query meets few targets beyond its nearest); a hit counts once
    it lies within the searched radius, so nothing nearer can be missed. It goes on until the radius reaches around the globe."""
    if start_m <= 0:
        raise ValueError(f"the first radius must be positive, got {start_m}")
    radius, pending, found = start_m, queries, None
    keep = queries.columns
    while True:
        hits = _nearest_round(pending, targets, target_id, on, radius, shape)
        hits = settle(hits)
        done = hits.filter(F.col("nearest_id").isNotNull())
        found = done if found is None else found.unionByName(done)
        pending = hits.filter(F.col("nearest_id").isNull()).select(*keep)
        if pending.isEmpty():
            return found
        if radius >= HALF_GLOBE_M:
            break
        radius *= 2
    return found.unionByName(pending.select("*", F.lit(None).cast("string").alias("nearest_id"), F.lit(None).cast("double").alias("distance_m")))


def _nearest_round(queries, targets, target_id, on, radius, shape) -> DataFrame:
    size = max(radius, 1.0)
    left = cells.with_box_cells(queries, cells.disc_box("q_lat", "q_lon", radius), size)
    keys = ["_band", "_cell"] + ([on] if on else [])
    if shape is None:
        right = cells.with_point_cell(targets.select(target_id, "lat", "lon", *([on] if on else [])), "lat", "lon", size)
        dist: Column = geo.haversine("q_lat", "q_lon", "lat", "lon")
    else:
        right = targets.select(target_id, F.col(shape).alias("_shape"), *([on] if on else []))
        right = cells.with_box_cells(right.withColumn("_e", geo.envelope("_shape")), F.col("_e"), size).drop("_e")
        dist = geo.metric_distance_to_line("q_lat", "q_lon", "_shape")
    hits = _met(left, right, keys).select("query_id", F.col(target_id).alias("_t"), dist.alias("_d")).filter(F.col("_d") <= radius)
    # min over (distance, id) combines map-side, so a query in a hot cell never gathers its candidates.
    # Distances equal to a micrometre are ties (two streets meeting at the nearest corner), decided by the id.
    best = hits.groupBy("query_id").agg(F.min(F.struct(F.round("_d", 6).alias("_tie"), "_t", "_d")).alias("_b"))
    return queries.join(best, "query_id", "left").select(
        *queries.columns, F.col("_b._t").alias("nearest_id"), F.col("_b._d").alias("distance_m")
    )


def lines_within_radius(centers: DataFrame, lines: DataFrame, radius_m: float) -> DataFrame:
    """(center, line) pairs at most ``radius_m`` apart, lines in ``line``."""
    size = max(radius_m, 50.0)
    disc = cells.disc_box("c_lat", "c_lon", radius_m)
    left = centers.withColumn("_d", F.struct(*(v.alias(k) for k, v in disc.items())))
    left = cells.with_box_cells(left, F.col("_d"), size)
    right = lines.withColumn("_e", geo.envelope("line"))
    right = cells.with_box_cells(right, F.col("_e"), size)
    out = _met(left, right, ["_band", "_cell"]).filter(cells.meets_here(F.col("_d"), F.col("_e"), size))
    out = out.withColumn("distance_m", geo.metric_distance_to_line("c_lat", "c_lon", "line"))
    return out.filter(F.col("distance_m") <= radius_m).drop("_d", "_e", "_band", "_cell")
