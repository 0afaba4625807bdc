"""Scalar geometry as native column expressions.

A point is ``struct<x:double,y:double>`` (x = longitude, y = latitude, or local metres); a line or a
closed ring is an array of points. Everything stays in the JVM: no user function anywhere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the model.
EARTH_RADIUS_M = 6_371_000.0
METERS_PER_DEGREE = math.pi * EARTH_RADIUS_M / 180
COLLINEAR_EPS = 1e-15
ORIGIN_DECIMALS = 9


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def rounded(c, digits: int) -> Column:
    """``F.round(c, digits)`` of a double, up to 6 digits, without its decimal arithmetic wherever the scaled value is clear of a tie: there the
    nearest whole number is certain (the product is off by less than 2e-4 up to 1e12), and dividing it gives the double next to that decimal."""
    if not 0 <= digits <= 6:
        raise ValueError(f"digits must be from 0 to 6, got {digits}")
    x, scale = col(c), float(10**digits)
    scaled = x * scale
    low = F.floor(scaled)
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - low - 0.5) > 1e-3)
    return F.when(clear, F.floor(scaled + 0.5) / F.lit(scale)).otherwise(F.round(x, digits))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once per row, however often ``fn`` reads it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


# -- distances and angles -------------------------------------------------------------------------

def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres on the sphere."""
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    s1, s2 = F.sin((a2 - a1) / 2), F.sin((o2 - o1) / 2)
    h = s1 * s1 + F.cos(a1) * F.cos(a2) * s2 * s2
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def point_distance(p: Column, q: Column) -> Column:
    return haversine(p["y"], p["x"], q["y"], q["x"])


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    d = o2 - o1
    east = F.sin(d) * F.cos(a2)
    north = F.cos(a1) * F.sin(a2) - F.sin(a1) * F.cos(a2) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def turn_kind(incoming, outgoing) -> Column:
    """straight / right / left / u_turn from two bearings; exactly 135 degrees either way is a u_turn."""
    diff = F.pmod(col(outgoing) - col(incoming) + 180.0, F.lit(360.0)) - 180.0
    return (
        F.when(F.abs(diff) <= 45, "straight")
        .when((diff > 45) & (diff < 135), "right")
        .when((diff < -45) & (diff > -135), "left")
        .otherwise("u_turn")
    )


def ground_distance(lat1, lon1, lat2, lon2) -> Column:
    """Flat distance with the cosine taken at the middle latitude."""
    shrink = F.cos(F.radians((col(lat1) + col(lat2)) / 2))
    return F.hypot((col(lon1) - col(lon2)) * shrink, col(lat1) - col(lat2)) * METERS_PER_DEGREE


def meters_per_degree_lon(lat) -> Column:
    return F.cos(F.radians(col(lat))) * METERS_PER_DEGREE


# -- lines ----------------------------------------------------------------------------------------

def steps(line) -> Column:
    """Consecutive vertex pairs as ``struct<a,b>``; empty for fewer than two vertices."""
    line = col(line)
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def length_m(line) -> Column:
    return F.aggregate(steps(line), F.lit(0.0), lambda acc, s: acc + point_distance(s["a"], s["b"]))


def planar_length(line) -> Column:
    return F.aggregate(
        steps(line), F.lit(0.0), lambda acc, s: acc + F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])
    )


def point_to_segment(px, py, ax, ay, bx, by) -> Column:
    """Planar distance from a point to a segment (clamped projection)."""
    px, py, ax, ay, bx, by = (col(c) for c in (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    t = F.when(squared == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, squared)))
    )
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def distance_to_line(px, py, line) -> Column:
    """Planar distance to the nearest point of a line given in the same units as the point."""
    px, py = col(px), col(py)
    return F.array_min(
        F.transform(steps(line), lambda s: point_to_segment(px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))
    )


def metric_distance_to_line(lat, lon, line) -> Column:
    """Metres from a WGS84 point to a WGS84 line, measured on the plane tangent at the point."""
    lat, lon = col(lat), col(lon)
    kx = meters_per_degree_lon(lat)
    local = F.transform(col(line), lambda p: point((p["x"] - lon) * kx, (p["y"] - lat) * METERS_PER_DEGREE))
    return distance_to_line(F.lit(0.0), F.lit(0.0), local)


# -- rings ----------------------------------------------------------------------------------------

def close_ring(points) -> Column:
    points = col(points)
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    return F.when((F.size(points) == 0) | (first == last), points).otherwise(F.concat(points, F.array(first)))


def bbox_ring(min_lat, min_lon, max_lat, max_lon) -> Column:
    """Counter-clockwise closed ring from the south-west corner."""
    s, w, n, e = (col(c) for c in (min_lat, min_lon, max_lat, max_lon))
    return F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s))


def signed_area(ring) -> Column:
    """Shoelace area in the ring's own units squared; positive for counter-clockwise."""
    ring = col(ring)
    x0, y0 = ring[0]["x"], ring[0]["y"]
    return (
        F.aggregate(
            steps(ring),
            F.lit(0.0),
            lambda acc, s: acc + (s["a"]["x"] - x0) * (s["b"]["y"] - y0) - (s["b"]["x"] - x0) * (s["a"]["y"] - y0),
        )
        / 2
    )


def centroid(ring) -> Column:
    """Area-weighted centroid, rounded so that the same shape from another start gives the same origin."""
    ring = col(ring)
    x0, y0 = ring[0]["x"], ring[0]["y"]
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc, s):
        ax, ay = s["a"]["x"] - x0, s["a"]["y"] - y0
        bx, by = s["b"]["x"] - x0, s["b"]["y"] - y0
        cross = ax * by - bx * ay
        return F.struct(
            (acc["t"] + cross).alias("t"), (acc["x"] + (ax + bx) * cross).alias("x"), (acc["y"] + (ay + by) * cross).alias("y")
        )

    return F.aggregate(
        steps(ring),
        zero,
        add,
        lambda acc: point(
            F.round(x0 + F.try_divide(acc["x"], acc["t"] * 3), ORIGIN_DECIMALS),
            F.round(y0 + F.try_divide(acc["y"], acc["t"] * 3), ORIGIN_DECIMALS),
        ),
    )


def mean_vertex(ring) -> Column:
    """Mean of the vertices, the closing duplicate counted once."""
    ring = col(ring)
    closed = (F.size(ring) > 1) & (ring[0] == F.try_element_at(ring, F.lit(-1)))
    n = F.when(closed, F.size(ring) - 1).otherwise(F.size(ring))
    own = F.slice(ring, F.lit(1), n)
    total = lambda axis: F.aggregate(own, F.lit(0.0), lambda acc, p: acc + p[axis])
    return point(total("x") / n, total("y") / n)


def local_projection(ring) -> Column:
    """``struct<lat, lon, m_lat, m_lon>``: origin at the centroid and metres per degree there."""
    c = centroid(ring)
    return F.struct(
        c["y"].alias("lat"), c["x"].alias("lon"), F.lit(METERS_PER_DEGREE).alias("m_lat"), meters_per_degree_lon(c["y"]).alias("m_lon")
    )


def to_local(line, projection) -> Column:
    p = col(projection)
    return F.transform(col(line), lambda v: point((v["x"] - p["lon"]) * p["m_lon"], (v["y"] - p["lat"]) * p["m_lat"]))


def from_local(line, projection) -> Column:
    p = col(projection)
    return F.transform(col(line), lambda v: point(p["lon"] + v["x"] / p["m_lon"], p["lat"] + v["y"] / p["m_lat"]))


def ring_area_m2(ring) -> Column:
    """Unsigned area in square metres. The local projection is linear, so it is the shoelace area in
    square degrees times both scale factors at the centroid."""
    ring = col(ring)
    c = centroid(ring)
    return F.abs(signed_area(ring)) * METERS_PER_DEGREE * meters_per_degree_lon(c["y"])


def envelope(line) -> Column:
    line = col(line)
    axis = lambda fn, a: fn(F.transform(line, lambda p: p[a]))
    return F.struct(
        axis(F.array_min, "y").alias("min_lat"), axis(F.array_min, "x").alias("min_lon"),
        axis(F.array_max, "y").alias("max_lat"), axis(F.array_max, "x").alias("max_lon"),
    )


def point_in_ring(x, y, ring) -> Column:
    """Even-odd rule."""
    x, y = col(x), col(y)

    def crosses(s):
        a, b = s["a"], s["b"]
        # The ratio is only read when the edge spans y, so its denominator is never 0 there.
        at = a["x"] + F.try_divide(y - a["y"], b["y"] - a["y"]) * (b["x"] - a["x"])
        return ((a["y"] > y) != (b["y"] > y)) & (x < at)

    return F.size(F.filter(steps(ring), crosses)) % 2 == 1


def point_on_ring(x, y, ring, eps: float = COLLINEAR_EPS) -> Column:
    x, y = col(x), col(y)
    p = point(x, y)
    return F.exists(steps(ring), lambda s: (orientation(s["a"], s["b"], p, eps) == 0) & on_segment(s["a"], s["b"], p))


# -- intersection predicates ----------------------------------------------------------------------

def orientation(p: Column, q: Column, r: Column, eps: float = COLLINEAR_EPS) -> Column:
    v = (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    return F.when(F.abs(v) <= eps, 0).when(v > 0, 1).otherwise(-1)


def on_segment(p: Column, q: Column, r: Column) -> Column:
    """Whether r, known to be collinear with p-q, lies between them."""
    return r["x"].between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & r["y"].between(
        F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"])
    )


def segments_touch(a: Column, b: Column, c: Column, d: Column) -> Column:
    o1, o2, o3, o4 = orientation(a, b, c), orientation(a, b, d), orientation(c, d, a), orientation(c, d, b)
    proper = (o1 * o2 == -1) & (o3 * o4 == -1)
    return (
        proper
        | ((o1 == 0) & on_segment(a, b, c))
        | ((o2 == 0) & on_segment(a, b, d))
        | ((o3 == 0) & on_segment(c, d, a))
        | ((o4 == 0) & on_segment(c, d, b))
    )


def lines_touch(line1, line2) -> Column:
    return F.exists(
        steps(line1), lambda s: F.exists(steps(line2), lambda t: segments_touch(s["a"], s["b"], t["a"], t["b"]))
    )


def rings_intersect(r1, r2) -> Column:
    """Two simple rings share a point: their edges touch, or one holds a vertex of the other."""
    r1, r2 = col(r1), col(r2)
    return lines_touch(r1, r2) | point_in_ring(r1[0]["x"], r1[0]["y"], r2) | point_in_ring(r2[0]["x"], r2[0]["y"], r1)


def line_intersects_ring(line, ring) -> Column:
    line = col(line)
    return lines_touch(line, ring) | point_in_ring(line[0]["x"], line[0]["y"], ring)


def self_intersects(ring) -> Column:
    """Edges that cross, touch, or (for neighbours) fold back onto each other."""
    ring = col(ring)
    # One array of (edge number, edge); every later edge is tested against every earlier one.
    numbered = F.transform(steps(ring), lambda s, i: F.struct(i.alias("i"), s["a"].alias("a"), s["b"].alias("b")))
    last = F.size(ring) - 2

    def folds(far1, shared, far2):
        return (orientation(far1, shared, far2) == 0) & (on_segment(far1, shared, far2) | on_segment(shared, far2, far1))

    def clash(s, t):
        nxt, wrap = t["i"] == s["i"] + 1, (s["i"] == 0) & (t["i"] == last)
        return (t["i"] > s["i"]) & (
            F.when(nxt, folds(s["a"], s["b"], t["b"]))
            .when(wrap, folds(s["b"], s["a"], t["a"]))
            .otherwise(segments_touch(s["a"], s["b"], t["a"], t["b"]))
        )

    return F.exists(numbered, lambda s: F.exists(numbered, lambda t: clash(s, t)))


# -- constructions --------------------------------------------------------------------------------

def canonical_ring(ring) -> Column:
    """The same closed ring started at its lowest (x, y) vertex; order kept."""
    ring = col(ring)
    own = F.slice(ring, F.lit(1), F.size(ring) - 1)
    start = F.array_position(own, F.array_min(own)).cast("int")
    turned = F.concat(F.slice(own, start, F.size(own)), F.slice(own, F.lit(1), start - 1))
    return F.concat(turned, F.array(turned[0]))


def polygon(outer, holes=None) -> Column:
    """``struct<outer, holes>``: a closed ring and the closed rings of its holes."""
    none = F.slice(F.array(col(outer)), F.lit(1), F.lit(0))
    return F.struct(col(outer).alias("outer"), (none if holes is None else F.coalesce(col(holes), none)).alias("holes"))


def canonical_polygon(poly) -> Column:
    """Every ring started at its lowest vertex, the holes in the order of these vertices."""
    poly = col(poly)
    return F.struct(canonical_ring(poly["outer"]).alias("outer"), F.array_sort(F.transform(poly["holes"], canonical_ring)).alias("holes"))


def polygon_rings(poly) -> Column:
    """All rings, the outer one first."""
    poly = col(poly)
    return F.concat(F.array(poly["outer"]), poly["holes"])


def polygon_area_m2(poly) -> Column:
    """Square metres of the outer ring less those of the holes, all on the plane of the outer ring's centroid."""
    poly = col(poly)
    holes = F.aggregate(F.transform(poly["holes"], lambda r: F.abs(signed_area(r))), F.lit(0.0), lambda acc, a: acc + a)
    return (F.abs(signed_area(poly["outer"])) - holes) * METERS_PER_DEGREE * meters_per_degree_lon(centroid(poly["outer"])["y"])


def multi_area_m2(polygons) -> Column:
    """Square metres of all parts of an array of polygons."""
    return F.aggregate(F.transform(col(polygons), polygon_area_m2), F.lit(0.0), lambda acc, a: acc + a)


def point_in_polygon(x, y, poly) -> Column:
    """Even-odd rule over all rings: a point in a hole is outside."""
    poly = col(poly)
    return point_in_ring(x, y, poly["outer"]) & ~F.exists(poly["holes"], lambda r: point_in_ring(x, y, r))


def circle_ring(x, y, radius, segments: int = 16) -> Column:
    """Regular closed polygon whose area equals the circle's."""
    fit = math.sqrt(math.pi / ((segments / 2) * math.sin(2 * math.pi / segments)))
    x, y, radius = col(x), col(y), col(radius)
    angle = lambda i: (i % segments) * (2 * math.pi / segments)
    return F.transform(
        F.sequence(F.lit(0), F.lit(segments)),
        lambda i: point(x + radius * fit * F.cos(angle(i)), y + radius * fit * F.sin(angle(i))),
    )


def edge_rectangle(ax, ay, bx, by, radius) -> Column:
    """Closed rectangle of half width ``radius`` along an edge; NULL for a zero-length edge."""
    ax, ay, bx, by, radius = (col(c) for c in (ax, ay, bx, by, radius))
    length = F.hypot(bx - ax, by - ay)
    nx, ny = F.try_divide(-(by - ay), length) * radius, F.try_divide(bx - ax, length) * radius
    return F.when(
        length > 0,
        F.array(point(ax + nx, ay + ny), point(bx + nx, by + ny), point(bx - nx, by - ny), point(ax - nx, ay - ny), point(ax + nx, ay + ny)),
    )


def clip_ring_rect(ring, min_x, min_y, max_x, max_y) -> Column:
    """A ring cut to a rectangle, one half-plane after the other; empty when nothing is left."""
    own = F.slice(col(ring), F.lit(1), F.size(col(ring)) - 1)
    for axis, bound, keep_above in (("x", min_x, True), ("x", max_x, False), ("y", min_y, True), ("y", max_y, False)):
        own = let(own, _half_plane(axis, col(bound), keep_above))
    return let(own, lambda p: F.when(F.size(p) >= 3, F.concat(p, F.slice(p, F.lit(1), F.lit(1)))).otherwise(F.slice(p, F.lit(1), F.lit(0))))


def _half_plane(axis: str, bound: Column, keep_above: bool):
    return lambda points: _cut_half_plane(points, axis, bound, keep_above)


def _cut_half_plane(points: Column, axis: str, bound: Column, keep_above: bool) -> Column:
    other = "y" if axis == "x" else "x"
    inside = (lambda p: p[axis] >= bound) if keep_above else (lambda p: p[axis] <= bound)

    def crossing(a, b):
        along = a[other] + (b[other] - a[other]) * F.try_divide(bound - a[axis], b[axis] - a[axis])
        return point(bound, along) if axis == "x" else point(along, bound)

    n = F.size(points)
    before = F.concat(F.slice(points, n, F.lit(1)), F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))))
    empty = F.slice(points, F.lit(1), F.lit(0))
    pieces = F.zip_with(
        before,
        points,
        lambda a, b: F.when(inside(b) & ~inside(a), F.array(crossing(a, b), b))
        .when(inside(b), F.array(b))
        .when(inside(a), F.array(crossing(a, b)))
        .otherwise(empty),
    )
    return F.when(n == 0, points).otherwise(F.flatten(pieces))


def clip_edge_rect(ax, ay, bx, by, min_x, min_y, max_x, max_y) -> Column:
    """``struct<t0,t1>``: the part of a segment inside a rectangle as parameters, NULL when none."""
    ax, ay, bx, by = (col(c) for c in (ax, ay, bx, by))
    lo, hi = [F.lit(0.0)], [F.lit(1.0)]
    possible = F.lit(True)
    for a, d, low, high in ((ax, bx - ax, col(min_x), col(max_x)), (ay, by - ay, col(min_y), col(max_y))):
        t1, t2 = F.try_divide(low - a, d), F.try_divide(high - a, d)
        lo.append(F.when(d == 0, 0.0).otherwise(F.least(t1, t2)))
        hi.append(F.when(d == 0, 1.0).otherwise(F.greatest(t1, t2)))
        possible = possible & ((d != 0) | a.between(low, high))
    t0, t1 = F.greatest(*lo), F.least(*hi)
    return F.when(possible & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def even_pick(n, k) -> Column:
    """k of n indices spread evenly, all of them when k >= n."""
    n, k = col(n), col(k)
    some = F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: F.floor((i + 0.5) * n / k).cast("int"))
    every = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))).cast("array<int>")
    none = F.array().cast("array<int>")
    return F.when((n <= 0) | (k <= 0), none).when(k >= n, every).otherwise(some)


# -- web mercator ---------------------------------------------------------------------------------

ZOOM = 15
TILE_SIZE = 256
MAX_MERCATOR_LATITUDE = 85.05112878
WORLD_PIXELS = TILE_SIZE * 2**ZOOM


def mercator_pixel(lat, lon) -> Column:
    """Position in the zoom-15 world pixel grid, x east and y south."""
    lat = F.least(F.greatest(col(lat), F.lit(-MAX_MERCATOR_LATITUDE)), F.lit(MAX_MERCATOR_LATITUDE))
    s = F.sin(F.radians(lat))
    x = (col(lon) + 180.0) / 360.0
    y = F.lit(0.5) - F.ln((1 + s) / (1 - s)) / (4 * math.pi)
    return point(x * WORLD_PIXELS, y * WORLD_PIXELS)


def tiles_for(min_lat, min_lon, max_lat, max_lon) -> Column:
    """Array of ``struct<tile_y, tile_x>`` touching a box, one pixel of margin included."""
    sw, ne = mercator_pixel(min_lat, min_lon), mercator_pixel(max_lat, max_lon)

    def span(a, b):
        low = F.greatest(F.floor(F.least(a, b)) - 1, F.lit(0))
        high = F.least(F.floor(F.greatest(a, b)) + 1, F.lit(WORLD_PIXELS - 1))
        return F.sequence(F.floor(low / TILE_SIZE), F.floor(high / TILE_SIZE))

    return F.flatten(
        F.transform(
            span(sw["y"], ne["y"]),
            lambda ty: F.transform(span(sw["x"], ne["x"]), lambda tx: F.struct(ty.alias("tile_y"), tx.alias("tile_x"))),
        )
    )
