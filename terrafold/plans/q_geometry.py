"""Scalar geometry, hashing and projection over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geo, ids
from terrafold.plans import oracle as o
from terrafold.plans.registry import query
from terrafold.plans.views import Views

PAIRS = "SELECT k, lat AS lat1, lon AS lon1, lat + 0.001 * (k % 17 - 8) AS lat2, lon + 0.001 * (k % 23 - 11) AS lon2 FROM {ping}"
PAIRS_SQL = f"(SELECT k, lat1, lon1, CAST(lat2 AS DOUBLE) AS lat2, CAST(lon2 AS DOUBLE) AS lon2 FROM ({PAIRS.format(ping='ping_v')}) p0) p"


def pairs(v: Views):
    return v.spark.sql(PAIRS, ping=v.ping)


@query(
    "distances_and_bearings",
    f"""SELECT k, {o.r6(o.hav('lat1','lon1','lat2','lon2'))} AS haversine_m, {o.r6(o.bearing('lat1','lon1','lat2','lon2'))} AS bearing_deg,
       {o.r6(f"sqrt(power((lon1 - lon2) * cos(radians((lat1 + lat2) / 2)), 2) + power(lat1 - lat2, 2)) * {o.MPD}")} AS ground_m,
       {o.r6(f"cos(radians(lat1)) * {o.MPD}")} AS m_per_lon FROM {PAIRS_SQL}""",
    ["ping"],
)
def distances_and_bearings(v: Views):
    p = pairs(v)
    args = ("lat1", "lon1", "lat2", "lon2")
    return p.select(
        "k", F.round(geo.haversine(*args), 6).alias("haversine_m"), F.round(geo.bearing(*args), 6).alias("bearing_deg"),
        F.round(geo.ground_distance(*args), 6).alias("ground_m"), F.round(geo.meters_per_degree_lon("lat1"), 6).alias("m_per_lon"),
    )


@query("turn_kinds", f"SELECT k, {o.turn('b1', 'b2')} AS kind FROM (SELECT k, CAST(k % 360 AS DOUBLE) AS b1, CAST((k * 45) % 360 AS DOUBLE) AS b2 FROM ping_v) t", ["ping"])
def turn_kinds(v: Views):
    d = lambda c: (c % 360).cast("double")
    return v.ping.select("k", geo.turn_kind(d(F.col("k")), d(F.col("k") * 45)).alias("kind"))


CROSS = "(({a}.x - ring[1].x) * ({b}.y - ring[1].y) - ({b}.x - ring[1].x) * ({a}.y - ring[1].y))"
TWICE = o.steps_sum("ring", CROSS)
SUM_X = o.steps_sum("ring", f"(({{a}}.x - ring[1].x) + ({{b}}.x - ring[1].x)) * {CROSS}")
SUM_Y = o.steps_sum("ring", f"(({{a}}.y - ring[1].y) + ({{b}}.y - ring[1].y)) * {CROSS}")
CX = f"round(ring[1].x + {SUM_X} / (3 * {TWICE}), 9)"
CY = f"round(ring[1].y + {SUM_Y} / (3 * {TWICE}), 9)"
RING_M2 = f"(abs({TWICE} / 2) * {o.MPD} * {o.MPD} * cos(radians({CY})))"


@query(
    "ring_measures",
    f"""SELECT source_id, {o.rn(CX, 9)} AS cx, {o.rn(CY, 9)} AS cy, {o.rn(RING_M2, 4)} AS area_m2,
       {o.r6(o.steps_sum('ring', o.hav('{a}.y', '{a}.x', '{b}.y', '{b}.x')))} AS perimeter_m,
       {o.rn("list_sum(list_transform(ring[1:4], lambda p: p.x)) / 4", 8)} AS mean_x,
       {o.rn("list_sum(list_transform(ring[1:4], lambda p: p.y)) / 4", 8)} AS mean_y,
       {o.rn("list_min(list_transform(ring, lambda p: p.x))", 8)} AS min_x, {o.rn("list_max(list_transform(ring, lambda p: p.y))", 8)} AS max_y
       FROM building_v""",
    ["building"],
)
def ring_measures(v: Views):
    c, m, e = geo.centroid("ring"), geo.mean_vertex("ring"), geo.envelope("ring")
    return v.building.select(
        "source_id", c["x"].alias("cx"), c["y"].alias("cy"), F.round(geo.ring_area_m2("ring"), 4).alias("area_m2"),
        F.round(geo.length_m("ring"), 6).alias("perimeter_m"), F.round(m["x"], 8).alias("mean_x"), F.round(m["y"], 8).alias("mean_y"),
        F.round(e["min_lon"], 8).alias("min_x"), F.round(e["max_lat"], 8).alias("max_y"),
    )


@query(
    "local_coordinates",
    f"""SELECT source_id, pos, {o.r6(f"(p.x - cx) * {o.MPD} * cos(radians(cy))")} AS x_m, {o.r6(f"(p.y - cy) * {o.MPD}")} AS y_m,
       {o.rn('p.x', 9)} AS back_x, {o.rn('p.y', 9)} AS back_y
       FROM (SELECT source_id, CAST(pos AS BIGINT) AS pos, ring[pos + 1] AS p, cx, cy FROM (SELECT source_id, ring, {CX} AS cx, {CY} AS cy, unnest(range(0, 5)) AS pos FROM building_v) u) w""",
    ["building"],
)
def local_coordinates(v: Views):
    b = v.building.withColumn("proj", geo.local_projection("ring"))
    b = b.withColumn("loc", geo.to_local("ring", "proj")).withColumn("back", geo.from_local("loc", "proj"))
    e = b.select("source_id", F.posexplode(F.arrays_zip("loc", "back")).alias("pos", "z"))
    return e.select(
        "source_id", F.col("pos").cast("bigint").alias("pos"), F.round("z.loc.x", 6).alias("x_m"), F.round("z.loc.y", 6).alias("y_m"),
        F.round("z.back.x", 9).alias("back_x"), F.round("z.back.y", 9).alias("back_y"),
    )


@query(
    "point_to_segment",
    f"SELECT k, {o.r6(o.seg_dist('px', 'py', 'ax', 'ay', 'x2', 'y2'))} AS d FROM (SELECT k, CAST(k % 37 AS DOUBLE) AS px, CAST(k % 41 AS DOUBLE) AS py, "
    "CAST(k % 13 AS DOUBLE) AS ax, CAST(k % 7 AS DOUBLE) AS ay, CAST(k % 11 + k % 2 * 2 AS DOUBLE) AS x2, CAST(k % 7 + k % 3 AS DOUBLE) AS y2 FROM ping_v) t",
    ["ping"],
)
def point_to_segment(v: Views):
    m = lambda n: (F.col("k") % n).cast("double")
    return v.ping.select("k", F.round(geo.point_to_segment(m(37), m(41), m(13), m(7), m(11) + m(2) * 2, m(7) + m(3)), 6).alias("d"))


@query(
    "ring_self_intersections",
    "SELECT boundary_id, name = 'tie' AS crosses FROM boundary_v WHERE name IN ('ell', 'tie', 'out')",
    ["boundary"],
)
def ring_self_intersections(v: Views):
    return v.boundary.filter(F.col("name").isin("ell", "tie", "out")).select("boundary_id", geo.self_intersects("ring").alias("crosses"))




@query(
    "brush_pieces",
    """SELECT source_id, round(pi() * r * r, 4) + 0.0 AS circle_m2, round(2 * r * len, 4) + 0.0 AS rectangle_m2, 17 AS circle_points
       FROM (SELECT source_id, CAST(5 + k % 20 AS DOUBLE) AS r, sqrt(power(k % 30, 2) + power(k % 7, 2)) AS len FROM building_v) b WHERE len > 0""",
    ["building"],
)
def brush_pieces(v: Views):
    r, x, y = (5 + F.col("k") % 20).cast("double"), (F.col("k") % 30).cast("double"), (F.col("k") % 7).cast("double")
    b = v.building.select("source_id", geo.circle_ring(F.lit(3.0), F.lit(4.0), r).alias("c"), geo.edge_rectangle(F.lit(0.0), F.lit(0.0), x, y, r).alias("r"))
    area = lambda c: F.round(F.abs(geo.signed_area(c)), 4)
    return b.filter(F.col("r").isNotNull()).select(
        "source_id", area("c").alias("circle_m2"), area("r").alias("rectangle_m2"), F.size("c").alias("circle_points")
    )


@query(
    "clipped_squares",
    """SELECT source_id, round(greatest(0, least(x + hx, mx) - greatest(x - hx, nx)) * greatest(0, least(y + hy, my) - greatest(y - hy, ny)), 2) + 0.0 AS kept_m2,
       len FROM (SELECT source_id, x, y, hx, hy, 0 AS nx, 0 AS ny, 30 AS mx, 20 AS my, 0 AS len FROM
       (SELECT source_id, CAST(k % 41 - 5 AS DOUBLE) AS x, CAST(k % 29 - 4 AS DOUBLE) AS y, CAST(3 + k % 4 AS DOUBLE) AS hx, CAST(2 + k % 3 AS DOUBLE) AS hy FROM building_v) a) b""",
    ["building"],
)
def clipped_squares(v: Views):
    k = F.col("k")
    x, y, hx, hy = ((e).cast("double") for e in (k % 41 - 5, k % 29 - 4, 3 + k % 4, 2 + k % 3))
    ring = geo.bbox_ring(y - hy, x - hx, y + hy, x + hx)
    cut = geo.clip_ring_rect(ring, F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(20.0))
    area = F.when(F.size("cut") > 0, F.abs(geo.signed_area("cut"))).otherwise(F.lit(0.0))
    return v.building.withColumn("cut", cut).select("source_id", F.round(area, 2).alias("kept_m2"), F.lit(0).alias("len"))


@query(
    "canonical_rings",
    """SELECT source_id, round(list_min(list_transform(ring, lambda p: p.x)), 9) + 0.0 AS x, round(list_min(list_transform(ring, lambda p: p.y)), 9) + 0.0 AS y,
       5 AS n, TRUE AS closed FROM building_v""",
    ["building"],
)
def canonical_rings(v: Views):
    # The ring is started elsewhere first, so the rule has something to undo.
    opened = F.slice("ring", 1, 4)
    turned = geo.close_ring(F.concat(F.slice(opened, F.col("k").cast("int") % 4 + 1, F.lit(4)), F.slice(opened, F.lit(1), F.col("k").cast("int") % 4)))
    b = v.building.withColumn("t", turned).withColumn("c", geo.canonical_ring("t"))
    return b.select("source_id", F.round(F.col("c")[0]["x"], 9).alias("x"), F.round(F.col("c")[0]["y"], 9).alias("y"), F.size("c").alias("n"), (F.col("c")[0] == F.col("c")[4]).alias("closed"))


@query(
    "even_picks",
    """SELECT k, count(i) AS n, coalesce(sum(CASE WHEN kk >= n THEN i ELSE CAST(floor((i + 0.5) * n / kk) AS BIGINT) END), 0)::BIGINT AS total
       FROM (SELECT k, k % 23 AS n, k % 11 AS kk FROM ping_v) p LEFT JOIN range(0, 23) r(i) ON i < least(n, kk) GROUP BY k""",
    ["ping"],
)
def even_picks(v: Views):
    p = v.ping.select("k", geo.even_pick((F.col("k") % 23).cast("int"), (F.col("k") % 11).cast("int")).alias("a"))
    return p.select("k", F.size("a").cast("bigint").alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("total"))




def unit_sql(seed: str) -> str:
    """FNV-1a then the 32-bit finalizer with 128-bit products, over ASCII seeds."""
    m = lambda a, f: f"CAST((CAST({a} AS HUGEINT) * {f}) % 4294967296 AS BIGINT)"
    fnv = f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({seed}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {m('xor(a, b)', 16777619)})"
    s1 = f"(SELECT xor(h, h >> 16) FROM (SELECT {fnv} AS h) q1)"
    s2 = f"(SELECT xor(h, h >> 13) FROM (SELECT {m(s1, 2246822507)} AS h) q2)"
    s3 = f"(SELECT xor(h, h >> 16) FROM (SELECT {m(s2, 3266489909)} AS h) q3)"
    return f"(CAST({s3} AS DOUBLE) / 4294967296.0::DOUBLE)"


@query(
    "stable_units",
    f"SELECT source_id, round(u, 9) + 0.0 AS unit, CASE WHEN u < 0.3::DOUBLE THEN 2 ELSE 1 END AS storeys FROM (SELECT source_id, {unit_sql('source_id')} AS u FROM building_v) b",
    ["building"],
)
def stable_units(v: Views):
    return v.building.select("source_id", F.round(ids.stable_unit("source_id"), 9).alias("unit"), ids.draw_storeys("source_id", F.lit(0.3)).alias("storeys"))


def uuid5_sql(namespace: str, name: str) -> str:
    ns = namespace.replace("-", "")
    h = f"sha1(unhex('{ns}') || encode({name}))"
    return (
        f"(SELECT concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', CAST((position(h[17] in '0123456789abcdef') - 1) % 4 + 1 AS BIGINT), 1), h[18:20], '-', h[21:32]) FROM (SELECT {h} AS h) hh)"
    )


@query(
    "derived_ids",
    f"SELECT node_id, {uuid5_sql(ids.STREET_NAMESPACE, 's')} AS street_id, {uuid5_sql(ids.BLOCK_NAMESPACE, 's')} AS block_id FROM (SELECT node_id, concat(area_id, ':', node_id) AS s FROM node_v) n",
    ["node"],
)
def derived_ids(v: Views):
    name = F.concat_ws(":", "area_id", "node_id")
    return v.node.select("node_id", ids.uuid5(ids.STREET_NAMESPACE, name).alias("street_id"), ids.uuid5(ids.BLOCK_NAMESPACE, name).alias("block_id"))


PIX_Y = "(0.5 - ln((1 + sin(radians({lat}))) / (1 - sin(radians({lat})))) / (4 * pi())) * 8388608"
PIX_X = "({lon} + 180.0::DOUBLE) / 360.0::DOUBLE * 8388608"


@query(
    "mercator_pixels",
    f"SELECT node_id, {o.rn(PIX_X.format(lon='lon'), 4)} AS px, {o.rn(PIX_Y.format(lat='lat'), 4)} AS py FROM node_v",
    ["node"],
)
def mercator_pixels(v: Views):
    p = geo.mercator_pixel("lat", "lon")
    return v.node.select("node_id", F.round(p["x"], 4).alias("px"), F.round(p["y"], 4).alias("py"))


@query(
    "terrain_tiles",
    f"""SELECT area_id, CAST(ty AS BIGINT) AS tile_y, CAST(tx AS BIGINT) AS tile_x FROM (
        SELECT area_id, unnest(range(CAST(floor((floor({PIX_X.format(lon='min_lon')}) - 1) / 256) AS BIGINT), CAST(floor((floor({PIX_X.format(lon='max_lon')}) + 1) / 256) AS BIGINT) + 1)) AS tx, y0, y1
        FROM (SELECT *, CAST(floor((floor({PIX_Y.format(lat='max_lat')}) - 1) / 256) AS BIGINT) AS y0, CAST(floor((floor({PIX_Y.format(lat='min_lat')}) + 1) / 256) AS BIGINT) AS y1 FROM town_v) t) x,
        LATERAL (SELECT unnest(range(y0, y1 + 1)) AS ty) yy""",
    ["town"],
)
def terrain_tiles(v: Views):
    t = v.town.select("area_id", F.explode(geo.tiles_for("min_lat", "min_lon", "max_lat", "max_lon")).alias("t"))
    return t.select("area_id", "t.tile_y", "t.tile_x")
