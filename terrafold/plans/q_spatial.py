"""Radius, box, nearest and containment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import spatial
from terrafold.plans import oracle as o
from terrafold.plans.registry import query
from terrafold.plans.views import Views


def outer_centers(v: Views):
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2
    return v.area.filter("parent_id IS NULL").select(
        "area_id", F.col("area_id").alias("center_id"), mid("min_lat", "max_lat").alias("c_lat"), mid("min_lon", "max_lon").alias("c_lon")
    )


CENTERS = "centers AS (SELECT area_id, (min_lat + max_lat) / 2 AS c_lat, (min_lon + max_lon) / 2 AS c_lon FROM area_v WHERE parent_id IS NULL)"


@query(
    "pois_within_radius",
    f"""WITH {CENTERS}
    SELECT c.area_id, count(*) AS n_pois, {o.rn('sum(' + o.hav('c_lat', 'c_lon', 'p.lat', 'p.lon') + ')', 3)} AS sum_distance_m
    FROM centers c JOIN poi_v p ON p.area_id = c.area_id AND {o.hav('c_lat', 'c_lon', 'p.lat', 'p.lon')} <= 500
    GROUP BY c.area_id""",
    ["area", "poi"],
)
def pois_within_radius(v: Views):
    hits = spatial.within_radius(outer_centers(v), v.poi, 500.0, on="area_id")
    return hits.groupBy("area_id").agg(F.count("*").alias("n_pois"), F.round(F.sum("distance_m"), 3).alias("sum_distance_m"))


def centers_of(df, key: str):
    return df.select(F.col(key).alias("center_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))


@query(
    "nodes_within_radius",
    f"""SELECT source_id AS center_id, node_id, {o.rn('d', 4)} AS distance_m FROM (SELECT p.source_id, n.node_id, {o.hav('p.lat', 'p.lon', 'n.lat', 'n.lon')} AS d
        FROM poi_v p JOIN node_v n ON abs(p.lat - n.lat) < 0.003 AND abs(p.lon - n.lon) < 0.003) t WHERE d <= 150""",
    ["poi", "node"],
)
def nodes_within_radius(v: Views):
    return spatial.within_radius(centers_of(v.poi, "source_id"), v.node, 150.0).select("center_id", "node_id", F.round("distance_m", 4).alias("distance_m"))


LOCAL_RING = f"list_transform(ring, lambda p: {{'x': (p.x - c_lon) * {o.MPD} * cos(radians(c_lat)), 'y': (p.y - c_lat) * {o.MPD}}})"
LINE_DIST = f"list_min(list_transform(range(1, len(loc)), lambda i: {o.seg_dist('0', '0', 'loc[i].x', 'loc[i].y', 'loc[i+1].x', 'loc[i+1].y')}))"


@query(
    "buildings_within_radius",
    f"""SELECT center_id, source_id, {o.rn('d', 3)} AS distance_m FROM (
        SELECT center_id, source_id, CASE WHEN {o.in_ring('c_lon', 'c_lat', 'ring')} THEN 0 ELSE {LINE_DIST} END AS d
        FROM (SELECT n.node_id AS center_id, b.source_id, ring, n.lat AS c_lat, n.lon AS c_lon, {LOCAL_RING.replace('c_lon', 'n.lon').replace('c_lat', 'n.lat')} AS loc
              FROM node_v n JOIN building_v b ON abs(n.lat - b.lat) < 0.002 AND abs(n.lon - b.lon) < 0.002) j) t WHERE d <= 60""",
    ["node", "building"],
)
def buildings_within_radius(v: Views):
    hits = spatial.rings_within_radius(centers_of(v.node, "node_id"), v.building.select("source_id", "ring"), 60.0)
    return hits.select("center_id", "source_id", F.round("distance_m", 3).alias("distance_m"))


def inner_boxes(v: Views):
    return v.area.filter("parent_id IS NOT NULL").select(F.col("area_id").alias("box_id"), "min_lat", "min_lon", "max_lat", "max_lon")


@query(
    "pois_in_boxes",
    "SELECT a.area_id AS box_id, p.source_id FROM area_v a JOIN poi_v p ON p.lat BETWEEN min_lat AND max_lat AND p.lon BETWEEN min_lon AND max_lon WHERE a.parent_id IS NOT NULL",
    ["area", "poi"],
)
def pois_in_boxes(v: Views):
    return spatial.points_in_boxes(v.poi.drop("area_id"), inner_boxes(v)).select("box_id", "source_id")


@query(
    "pois_strictly_in_boxes",
    "SELECT a.area_id AS box_id, p.source_id FROM area_v a JOIN poi_v p ON p.lat > min_lat AND p.lat < max_lat AND p.lon > min_lon AND p.lon < max_lon WHERE a.parent_id IS NOT NULL",
    ["area", "poi"],
)
def pois_strictly_in_boxes(v: Views):
    return spatial.points_in_boxes(v.poi.drop("area_id"), inner_boxes(v), strict=True).select("box_id", "source_id")


SMALL = "SELECT area_id AS box_id, min_lat, min_lon, min_lat + CAST(0.0041 AS DOUBLE) AS max_lat, min_lon + CAST(0.0052 AS DOUBLE) AS max_lon FROM {town}"
BOX_CASE = "lat - hy {ge} min_lat AND lat + hy {le} max_lat AND lon - hx {ge} min_lon AND lon + hx {le} max_lon"


@query(
    "buildings_in_boxes",
    f"SELECT box_id, source_id FROM ({SMALL.format(town='town_v')}) t JOIN building_v b ON {BOX_CASE.format(ge='>=', le='<=')}",
    ["town", "building"],
)
def buildings_in_boxes(v: Views):
    return spatial.rings_in_boxes(v.building.select("source_id", "ring"), v.spark.sql(SMALL, town=v.town)).select("box_id", "source_id")


@query(
    "buildings_meeting_boxes",
    f"SELECT box_id, source_id FROM ({SMALL.format(town='town_v')}) t JOIN building_v b ON lat + hy >= min_lat AND lat - hy <= max_lat AND lon + hx >= min_lon AND lon - hx <= max_lon",
    ["town", "building"],
)
def buildings_meeting_boxes(v: Views):
    return spatial.rings_meeting_boxes(v.building.select("source_id", "ring"), v.spark.sql(SMALL, town=v.town)).select("box_id", "source_id")


@query(
    "pois_in_boundaries",
    f"SELECT boundary_id, source_id FROM boundary_v b JOIN poi_v p USING (area_id) WHERE name = 'ell' AND {o.in_ring('p.lon', 'p.lat', 'ring')}",
    ["boundary", "poi"],
)
def pois_in_boundaries(v: Views):
    rings = v.boundary.filter("name = 'ell'").select("boundary_id", "area_id", "ring")
    return spatial.points_in_rings(v.poi, rings, on="area_id", edge_counts=False).select("boundary_id", "source_id")


@query(
    "nearest_node",
    f"""SELECT source_id AS query_id, arg_min(node_id, (round(d, 6), node_id)) AS nearest_id, {o.rn('min(d)', 4)} AS distance_m FROM
        (SELECT p.source_id, n.node_id, {o.hav('p.lat', 'p.lon', 'n.lat', 'n.lon')} AS d FROM poi_v p, node_v n) t GROUP BY source_id""",
    ["poi", "node"],
)
def nearest_node(v: Views):
    q = v.poi.select(F.col("source_id").alias("query_id"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))
    return spatial.nearest(q, v.node, "node_id").select("query_id", "nearest_id", F.round("distance_m", 4).alias("distance_m"))


LANES_SQL = """edge AS (SELECT a.area_id, concat(a.node_id, '-', b.node_id) AS segment_id, a.lon AS ax, a.lat AS ay, b.lon AS x2, b.lat AS y2 FROM node_v a JOIN node_v b
  ON a.area_id = b.area_id AND ((b.lrow = a.lrow AND b.lcol = a.lcol + 1) OR (b.lcol = a.lcol AND b.lrow = a.lrow + 1)))"""


def lattice_edges(v: Views):
    """Straight street pieces between neighbouring lattice nodes."""
    from terrafold.functions import geo

    a = v.node.select("area_id", F.col("node_id").alias("a"), F.col("lrow").alias("r"), F.col("lcol").alias("c"), F.col("lon").alias("ax"), F.col("lat").alias("ay"))
    nxt = a.select("area_id", "a", "ax", "ay", F.explode(F.array(F.struct(F.col("r").alias("r2"), (F.col("c") + 1).alias("c2")), F.struct((F.col("r") + 1).alias("r2"), F.col("c").alias("c2")))).alias("t"))
    nxt = nxt.select("area_id", "a", "ax", "ay", "t.r2", "t.c2")
    b = v.node.select("area_id", F.col("node_id").alias("b"), F.col("lrow").alias("r2"), F.col("lcol").alias("c2"), F.col("lon").alias("bx"), F.col("lat").alias("by"))
    # By the size of its file alone the table of nodes would be held whole in every task.
    e = nxt.join(b.hint("merge"), ["area_id", "r2", "c2"])
    return e.select("area_id", F.concat_ws("-", "a", "b").alias("segment_id"), "a", "b", F.array(geo.point("ax", "ay"), geo.point("bx", "by")).alias("line"))


@query(
    "nearest_segment",
    f"""WITH {LANES_SQL} SELECT query_id, arg_min(segment_id, (round(d, 6), segment_id)) AS nearest_id, {o.rn('min(d)', 4)} AS distance_m FROM
        (SELECT b.source_id AS query_id, segment_id, {o.seg_dist('0', '0', f'(ax - b.lon) * {o.MPD} * cos(radians(b.lat))', f'(ay - b.lat) * {o.MPD}', f'(x2 - b.lon) * {o.MPD} * cos(radians(b.lat))', f'(y2 - b.lat) * {o.MPD}')} AS d
         FROM building_v b JOIN edge e ON b.area_id = e.area_id) t GROUP BY query_id""",
    ["node", "building"],
)
def nearest_segment(v: Views):
    q = v.building.select(F.col("source_id").alias("query_id"), "area_id", F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))
    q = q.join(v.town.select("area_id"), "area_id")
    out = spatial.nearest(q, lattice_edges(v), "segment_id", on="area_id", start_m=120.0, shape="line")
    return out.select("query_id", "nearest_id", F.round("distance_m", 4).alias("distance_m"))


@query(
    "segments_near_buildings",
    f"""WITH {LANES_SQL} SELECT segment_id, count(*) AS n FROM (SELECT e.segment_id, {o.seg_dist('0', '0', f'(ax - b.lon) * {o.MPD} * cos(radians(b.lat))', f'(ay - b.lat) * {o.MPD}', f'(x2 - b.lon) * {o.MPD} * cos(radians(b.lat))', f'(y2 - b.lat) * {o.MPD}')} AS d
        FROM building_v b JOIN edge e ON b.area_id = e.area_id) t WHERE d <= 40 GROUP BY segment_id""",
    ["node", "building"],
)
def segments_near_buildings(v: Views):
    c = v.building.select(F.col("source_id").alias("center_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    return spatial.lines_within_radius(c, lattice_edges(v), 40.0).groupBy("segment_id").agg(F.count("*").alias("n"))
