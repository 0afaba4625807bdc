"""Clip mode over all layers of the towns, at a concave boundary and at a box; polygons with holes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import clip, mapdata
from terrafold.plans import oracle as o
from terrafold.plans.q_spatial import LANES_SQL, lattice_edges
from terrafold.plans.registry import query
from terrafold.plans.views import Views

# A "U" in every town, open to the north: its corners from the box's south-west corner, in degrees.
X1, X2, X3, X4 = 0.001203, 0.003107, 0.005611, 0.007809
Y1, Y2, Y4 = 0.001301, 0.004207, 0.007703

#: layer, node filter, offsets of the south-west corner, width, height, side of a centred hole (0: none).
SHAPES = [
    ("blocks", "lrow <= 8 AND lcol <= 8", 0.000101, 0.000101, 0.000802, 0.000802, 0.0),
    ("block_buildable_areas", "lrow <= 8 AND lcol <= 8", 0.000201, 0.000201, 0.000602, 0.000602, 0.0002),
    ("area_features", "k % 7 = 0", -0.001001, -0.000901, 0.003002, 0.002602, 0.0012),
    ("generated_buildings", "lrow <= 8 AND lcol <= 8 AND k % 3 = 0", 0.000303, 0.000407, 0.000104, 0.000096, 0.0),
]


def _f(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


SIGNED = " UNION ALL ".join(
    f"SELECT '{layer}' AS layer, area_id, concat('{layer}/', k) AS id, sign, lon + {_f(dx)} + inset * {_f((w - h) / 2)} AS w, lat + {_f(dy)} + inset * {_f((hh - h) / 2)} AS s,"
    f" lon + {_f(dx + w)} - inset * {_f((w - h) / 2)} AS e, lat + {_f(dy + hh)} - inset * {_f((hh - h) / 2)} AS n FROM node_v, (VALUES (1, 0){', (-1, 1)' if h else ''}) v(sign, inset) WHERE {where}"
    for layer, where, dx, dy, w, hh, h in SHAPES
)
# Zones are two rectangles of one entity; the touching squares end exactly on the west edge of the "U".
PARTS = f"""{SIGNED}
  UNION ALL SELECT 'generation_zones', area_id, concat('z/', k), 1, lon + i * {_f(0.0005)}, lat, lon + i * {_f(0.0005)} + {_f(0.0003)}, lat + {_f(0.0006)} FROM node_v, range(0, 2) r(i) WHERE k % 2 = 0
  UNION ALL SELECT 'touching', area_id, concat('t/', area_id), 1, min_lon + {_f(X1)} - {_f(0.0004)}, min_lat + {_f(0.002)}, min_lon + {_f(X1)}, min_lat + {_f(0.0025)} FROM town_v
  UNION ALL SELECT 'buildings', area_id, source_id, 1, lon - hx, lat - hy, lon + hx, lat + hy FROM building_v"""
RECTS = f"""
  SELECT concat('U-', area_id) AS scope_id, area_id, min_lon + {_f(X1)} AS x1, min_lat + {_f(Y1)} AS y1, min_lon + {_f(X4)} AS x2, min_lat + {_f(Y2)} AS y2 FROM town_v
  UNION ALL SELECT concat('U-', area_id), area_id, min_lon + {_f(X1)}, min_lat + {_f(Y2)}, min_lon + {_f(X2)}, min_lat + {_f(Y4)} FROM town_v
  UNION ALL SELECT concat('U-', area_id), area_id, min_lon + {_f(X3)}, min_lat + {_f(Y2)}, min_lon + {_f(X4)}, min_lat + {_f(Y4)} FROM town_v
  UNION ALL SELECT area_id, area_id, min_lon, min_lat, max_lon, max_lat FROM town_v"""
SPAN = "greatest(0, CASE WHEN x2 = ax THEN 0 ELSE least((r.x1 - ax) / (x2 - ax), (r.x2_ - ax) / (x2 - ax)) END, CASE WHEN y2 = ay THEN 0 ELSE least((r.y1 - ay) / (y2 - ay), (r.y2_ - ay) / (y2 - ay)) END)"
TO = "least(1, CASE WHEN x2 = ax THEN 1 ELSE greatest((r.x1 - ax) / (x2 - ax), (r.x2_ - ax) / (x2 - ax)) END, CASE WHEN y2 = ay THEN 1 ELSE greatest((r.y1 - ay) / (y2 - ay), (r.y2_ - ay) / (y2 - ay)) END)"


def towns_u(v: Views) -> DataFrame:
    at = lambda x, y: geo.point(F.col("min_lon") + F.lit(x), F.col("min_lat") + F.lit(y))
    ring = F.array(*(at(x, y) for x, y in [(X1, Y1), (X4, Y1), (X4, Y4), (X3, Y4), (X3, Y2), (X2, Y2), (X2, Y4), (X1, Y4), (X1, Y1)]))
    return v.town.select(F.concat(F.lit("U-"), "area_id").alias("boundary_id"), "area_id", ring.alias("ring"))


def town_layers(v: Views) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(feature layers, network layers) of the towns."""
    box = lambda s, w, n, e: geo.bbox_ring(s, w, n, e)
    lat, lon = F.col("lat"), F.col("lon")
    layers = {"buildings": v.building.select("area_id", "source_id", "ring"), "pois": v.building.select("area_id", "source_id", "lat", "lon")}
    for layer, where, dx, dy, w, h, hole in SHAPES:
        ix, iy = (w - hole) / 2, (h - hole) / 2
        outer = box(lat + dy, lon + dx, lat + (dy + h), lon + (dx + w))
        holes = F.array(box(lat + dy + iy, lon + dx + ix, lat + (dy + h) - iy, lon + (dx + w) - ix)) if hole else None
        layers[layer] = v.node.filter(where).select("area_id", F.concat(F.lit(f"{layer}/"), "k").alias("source_id"), geo.polygon(outer, holes).alias("polygon"))
    two = F.transform(F.array(F.lit(0), F.lit(1)), lambda i: geo.polygon(box(lat, lon + i * 0.0005, lat + 0.0006, lon + i * 0.0005 + 0.0003)))
    layers["generation_zones"] = v.node.filter("k % 2 = 0").select("area_id", F.concat(F.lit("z/"), "k").alias("source_id"), two.alias("polygons"))
    west = F.col("min_lon") + F.lit(X1)
    layers["touching"] = v.town.select("area_id", F.concat(F.lit("t/"), "area_id").alias("source_id"), box(F.col("min_lat") + 0.002, west - 0.0004, F.col("min_lat") + 0.0025, west).alias("ring"))
    return layers, {"segments": lattice_edges(v), "nodes": v.node.select("area_id", "node_id", "lat", "lon")}


@query(
    "map_data_clip",
    f"""WITH {LANES_SQL}, rects AS ({RECTS}), r AS (SELECT scope_id, area_id, x1, y1, x2 AS x2_, y2 AS y2_ FROM rects), parts AS ({PARTS}),
        cut AS (SELECT scope_id, segment_id, sqrt(power(x2 - ax, 2) + power(y2 - ay, 2)) AS len, {SPAN} AS t0, {TO} AS t1 FROM edge e JOIN r USING (area_id)
          WHERE (x2 <> ax OR ax BETWEEN r.x1 AND r.x2_) AND (y2 <> ay OR ay BETWEEN r.y1 AND r.y2_)),
        seg AS (SELECT *, lag(t1) OVER (PARTITION BY scope_id, segment_id ORDER BY t0) AS before FROM cut WHERE t1 > t0)
        SELECT scope_id, layer, id, {o.rn('sum(sign * greatest(0, least(e, x2_) - greatest(w, r.x1)) * greatest(0, least(n, y2_) - greatest(s, r.y1))) * 100000000', 1)} AS size, 0 AS parts
          FROM parts JOIN r USING (area_id) GROUP BY scope_id, layer, id HAVING sum(sign * greatest(0, least(e, x2_) - greatest(w, r.x1)) * greatest(0, least(n, y2_) - greatest(s, r.y1))) > 1e-14
        UNION ALL SELECT scope_id, 'segments', segment_id, {o.rn('sum((t1 - t0) * len) * 100000', 3)}, CAST(count(*) FILTER (WHERE before IS NULL OR t0 > before + 1e-9) AS INT) FROM seg GROUP BY scope_id, segment_id
        UNION ALL SELECT DISTINCT scope_id, 'nodes', node_id, 0, 1 FROM node_v JOIN r USING (area_id) WHERE lon BETWEEN r.x1 AND x2_ AND lat BETWEEN r.y1 AND y2_
        UNION ALL SELECT DISTINCT scope_id, 'pois', source_id, 0, 1 FROM building_v JOIN r USING (area_id) WHERE lon BETWEEN r.x1 AND x2_ AND lat BETWEEN r.y1 AND y2_""",
    ["node", "town", "building"],
)
def map_data_clip(v: Views):
    features, network = town_layers(v)
    towns = v.town.withColumn("status", F.lit("completed"))
    scopes = clip.scopes_of(towns).unionByName(clip.scopes_of(towns, towns_u(v)))
    hole_area = lambda p: F.aggregate(p["holes"], F.lit(0.0), lambda acc, h: acc + F.abs(geo.signed_area(h)))
    out = None
    for name, df in clip.map_data_clip(features, network, towns, scopes).items():
        key = {"segments": "segment_id", "nodes": "node_id"}.get(name, "source_id")
        size, parts = F.lit(0.0), F.lit(1)
        if "polygons" in df.columns:
            size = F.round(F.aggregate("polygons", F.lit(0.0), lambda acc, p: acc + F.abs(geo.signed_area(p["outer"])) - hole_area(p)) * 1e8, 1)
            parts = F.lit(0)
        elif "parts" in df.columns:
            size, parts = F.round(F.aggregate("parts", F.lit(0.0), lambda acc, line: acc + geo.planar_length(line)) * 100000, 3), F.size("parts")
        rows = df.select("scope_id", F.lit(name).alias("layer"), F.col(key).alias("id"), size.alias("size"), parts.alias("parts"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "map_data_filter",
    f"""WITH {LANES_SQL}, r AS (SELECT scope_id, area_id, x1, y1, x2 AS x2_, y2 AS y2_ FROM ({RECTS}) rects WHERE scope_id <> area_id), parts AS ({PARTS}),
        seg AS (SELECT DISTINCT scope_id, area_id, segment_id FROM (SELECT scope_id, e.area_id, segment_id, {SPAN} AS t0, {TO} AS t1 FROM edge e JOIN r USING (area_id)
          WHERE (x2 <> ax OR ax BETWEEN r.x1 AND r.x2_) AND (y2 <> ay OR ay BETWEEN r.y1 AND r.y2_)) c WHERE t1 >= t0)
        SELECT DISTINCT layer, scope_id, id FROM parts JOIN r USING (area_id) WHERE sign = 1 AND e >= r.x1 AND w <= x2_ AND n >= r.y1 AND s <= y2_
        UNION ALL SELECT 'segments', scope_id, segment_id FROM seg
        UNION ALL SELECT DISTINCT 'pois', scope_id, source_id FROM building_v JOIN r USING (area_id) WHERE lon BETWEEN r.x1 AND x2_ AND lat BETWEEN r.y1 AND y2_
        UNION ALL SELECT DISTINCT 'nodes', NULL, node_id FROM (SELECT node_id FROM node_v JOIN r USING (area_id) WHERE lon BETWEEN r.x1 AND x2_ AND lat BETWEEN r.y1 AND y2_
          UNION ALL SELECT unnest([split_part(segment_id, '-', 1), split_part(segment_id, '-', 2)]) FROM seg) n""",
    ["node", "town", "building"],
)
def map_data_filter(v: Views):
    features, network = town_layers(v)
    network["segments"] = network["segments"].withColumnRenamed("a", "from_node").withColumnRenamed("b", "to_node")
    m = mapdata.map_data(features, network, v.town.withColumn("status", F.lit("completed")), towns_u(v))
    out = m["nodes"].select(F.lit("nodes").alias("layer"), F.lit(None).cast("string").alias("scope_id"), F.col("node_id").alias("id"))
    for name in [*features, "segments"]:
        out = out.unionByName(m[name].select(F.lit(name).alias("layer"), F.col("boundary_id").alias("scope_id"), F.col("segment_id" if name == "segments" else "source_id").alias("id")))
    return out


# Two polygons at every node: a square with two holes and a plain one.
@query(
    "multi_areas",
    f"""SELECT k, {o.rn(f"(0.0016::DOUBLE * 0.0016::DOUBLE - 0.0002::DOUBLE * 0.0002::DOUBLE - 0.0003::DOUBLE * 0.0003::DOUBLE) * {o.MPD} * {o.MPD} * cos(radians(round(lat + 0.0008::DOUBLE, 9))) + 0.0005::DOUBLE * 0.0005::DOUBLE * {o.MPD} * {o.MPD} * cos(radians(round(lat + 0.00025::DOUBLE, 9)))", 2)} AS area_m2 FROM node_v""",
    ["node"],
)
def multi_areas(v: Views):
    return holed(v).select("k", F.round(geo.multi_area_m2("polygons"), 2).alias("area_m2"))


@query(
    "canonical_polygons",
    """SELECT k, round(lon, 6) + 0.0 AS x, round(lat, 6) + 0.0 AS y, 2 AS n_holes, round(lon + 0.0001::DOUBLE, 6) + 0.0 AS first_hole, round(lon + 0.001::DOUBLE, 6) + 0.0 AS second_hole FROM node_v""",
    ["node"],
)
def canonical_polygons(v: Views):
    p = holed(v).select("k", geo.canonical_polygon(F.col("polygons")[0]).alias("p"))
    at = lambda c: F.round(c, 6)
    return p.select("k", at(F.col("p.outer")[0]["x"]).alias("x"), at(F.col("p.outer")[0]["y"]).alias("y"), F.size("p.holes").alias("n_holes"), at(F.col("p.holes")[0][0]["x"]).alias("first_hole"), at(F.col("p.holes")[1][0]["x"]).alias("second_hole"))


def holed(v: Views) -> DataFrame:
    """Rings that start at a corner by the node's number, holes from east to west."""
    lat, lon = F.col("lat"), F.col("lon")

    def turned(ring):
        start = (F.col("k") % 4 + 1).cast("int")
        own = F.concat(F.slice(ring, start, 5 - start), F.slice(ring, F.lit(1), start - 1))
        return F.concat(own, F.slice(own, F.lit(1), F.lit(1)))

    square = lambda x, y, w: turned(geo.bbox_ring(lat + y, lon + x, lat + (y + w), lon + (x + w)))
    one = geo.polygon(square(0.0, 0.0, 0.0016), F.array(square(0.001, 0.0002, 0.0003), square(0.0001, 0.0007, 0.0002)))
    return v.node.select("k", F.array(one, geo.polygon(square(0.002, 0.0, 0.0005))).alias("polygons"))
