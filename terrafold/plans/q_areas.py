"""Nested areas, ownership, feedback and area lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geo, ids, rules
from terrafold.operators import compose
from terrafold.plans import oracle as o
from terrafold.plans.q_geometry import uuid5_sql
from terrafold.plans.registry import query
from terrafold.plans.views import Views
from terrafold.sources import osm

PAIRS = """pairs AS (SELECT a.area_id AS outer_id, a.status AS outer_status, b.area_id AS inner_id, b.status AS inner_status, b.min_lat, b.min_lon FROM area_v a JOIN area_v b
  ON a.area_id <> b.area_id AND b.min_lat >= a.min_lat AND b.min_lon >= a.min_lon AND b.max_lat <= a.max_lat AND b.max_lon <= a.max_lon)"""
INNER = PAIRS + ", inn AS (SELECT outer_id, inner_id, row_number() OVER (PARTITION BY outer_id ORDER BY min_lat, min_lon, inner_id) AS rank FROM pairs WHERE inner_status = 'completed')"
OWNERS = INNER + ", own AS (SELECT area_id AS outer_id, area_id AS owner_id, 0 AS rank FROM area_v WHERE status = 'completed' UNION ALL SELECT outer_id, inner_id, rank FROM inn)"
# Features held by several owners: a customer's point of interest belongs to its outer area and, inside an inner box, to that too.
OWNED = "owned AS (SELECT source_id, area_id, kind, lat, lon FROM poi_v UNION ALL SELECT source_id, a.area_id, concat(kind, '*'), lat, lon FROM poi_v p JOIN area_v a ON a.parent_id = p.area_id WHERE p.lat BETWEEN min_lat AND max_lat AND p.lon BETWEEN min_lon AND max_lon AND k % 3 <> 0)"


def owned_pois(v: Views):
    from terrafold.operators import spatial

    own = v.poi.select("source_id", "area_id", "kind", "lat", "lon")
    boxes = v.area.filter("parent_id IS NOT NULL").select(F.col("area_id").alias("inner"), F.col("parent_id").alias("area_id"), *compose.BOX)
    inside = spatial.points_in_boxes(v.poi.filter("k % 3 <> 0"), boxes, on="area_id")
    return own.unionByName(inside.select("source_id", F.col("inner").alias("area_id"), F.concat("kind", F.lit("*")).alias("kind"), "lat", "lon"))


@query("areas_covered_by", f"WITH {INNER} SELECT outer_id, inner_id, CAST(rank AS INT) AS rank FROM inn", ["area"])
def areas_covered_by(v: Views):
    return compose.areas_covered_by(v.area)


@query("areas_covering", f"WITH {PAIRS} SELECT inner_id, outer_id FROM pairs WHERE outer_status IN ('completed', 'importing')", ["area"])
def areas_covering(v: Views):
    return compose.areas_covering(v.area)


@query("deletable_areas", f"WITH {PAIRS} SELECT area_id FROM area_v WHERE area_id NOT IN (SELECT inner_id FROM pairs WHERE outer_status IN ('completed', 'importing'))", ["area"])
def deletable_areas(v: Views):
    return compose.deletable(v.area).select("area_id")


@query("completed_areas", "SELECT area_id FROM area_v WHERE status = 'completed'", ["area"])
def completed_areas(v: Views):
    return rules.completed(v.area).select("area_id")


@query(
    "composed_pois",
    f"WITH {OWNERS}, {OWNED} SELECT outer_id, source_id, area_id, kind FROM (SELECT outer_id, source_id, area_id, kind, row_number() OVER (PARTITION BY outer_id, source_id ORDER BY rank) AS rn FROM owned JOIN own ON owner_id = area_id) t WHERE rn = 1",
    ["area", "poi"],
)
def composed_pois(v: Views):
    return compose.compose_by_source_id(owned_pois(v), compose.owners(v.area)).select("outer_id", "source_id", "area_id", "kind")


@query(
    "shadowed_pois",
    f"WITH {OWNERS}, {OWNED} SELECT outer_id, source_id, area_id FROM (SELECT outer_id, source_id, area_id, row_number() OVER (PARTITION BY outer_id, source_id ORDER BY rank) AS rn FROM owned JOIN own ON owner_id = area_id) t WHERE rn > 1",
    ["area", "poi"],
)
def shadowed_pois(v: Views):
    return compose.shadowed(owned_pois(v), compose.owners(v.area)).select("outer_id", "source_id", "area_id")


@query(
    "pois_outside_inner_areas",
    f"WITH {INNER} SELECT source_id FROM poi_v p WHERE NOT EXISTS (SELECT 1 FROM inn JOIN area_v a ON a.area_id = inner_id WHERE outer_id = p.area_id AND p.lat BETWEEN a.min_lat AND a.max_lat AND p.lon BETWEEN a.min_lon AND a.max_lon)",
    ["area", "poi"],
)
def pois_outside_inner_areas(v: Views):
    return compose.without_covered(v.poi, v.area).select("source_id")




@query(
    "squares_outside_inner_areas",
    f"""WITH {INNER} SELECT source_id FROM poi_v p WHERE NOT EXISTS (SELECT 1 FROM inn JOIN area_v a ON a.area_id = inner_id WHERE outer_id = p.area_id
        AND p.lat - CAST(0.0003 AS DOUBLE) >= a.min_lat AND p.lat + CAST(0.0003 AS DOUBLE) <= a.max_lat AND p.lon - CAST(0.0003 AS DOUBLE) >= a.min_lon AND p.lon + CAST(0.0003 AS DOUBLE) <= a.max_lon)""",
    ["area", "poi"],
)
def squares_outside_inner_areas(v: Views):
    h = F.lit(0.0003)
    sq = v.poi.withColumn("line", geo.bbox_ring(F.col("lat") - h, F.col("lon") - h, F.col("lat") + h, F.col("lon") + h))
    return compose.without_covered(sq, v.area, line="line").select("source_id")


@query(
    "feedback_status",
    "SELECT k, k % 100 > 40 AND k % 3 = 0 AS orphaned FROM node_v",
    ["node"],
)
def feedback_status(v: Views):
    f = v.node.select("k", F.col("node_id").alias("block_id"))
    blocks = v.node.filter("NOT (k % 100 > 40 AND k % 3 = 0)").select(F.col("node_id").alias("block_id"))
    return compose.feedback_status(f, blocks).select("k", "orphaned")


@query("areas_without_elevation", "SELECT area_id FROM area_v WHERE status = 'completed' AND root % 2 = 1", ["area"])
def areas_without_elevation(v: Views):
    return compose.without_elevation(v.area, v.area.filter("root % 2 = 0")).select("area_id")


@query("areas_without_place", "SELECT area_id FROM area_v WHERE place_name IS NULL", ["area"])
def areas_without_place(v: Views):
    return compose.without_place(v.area).select("area_id")


@query("find_area", "SELECT area_id AS request_id, area_id FROM area_v WHERE root <> 2", ["area"])
def find_area(v: Views):
    shift = F.when(F.col("root") == 2, 0.001).otherwise(0.0)
    req = v.area.select(F.col("area_id").alias("request_id"), "provider", (F.col("min_lat") - shift).alias("min_lat"), *compose.BOX[1:])
    return compose.find_area(req, v.area).select("request_id", "area_id")


@query(
    "recent_areas",
    """SELECT area_id, coalesce((SELECT count(*) FROM poi_v p WHERE p.area_id = a.area_id), 0) AS block_count FROM area_v a
       ORDER BY coalesce(imported_day, created_day) DESC, area_id LIMIT 12""",
    ["area", "poi"],
)
def recent_areas(v: Views):
    return osm.newest_first(v.area, limit=12, blocks=v.poi).select("area_id", "block_count")


@query(
    "search_areas",
    "SELECT area_id FROM area_v WHERE contains(lower(concat(coalesce(place_name, ''), ' ', status)), 'nation_1') AND contains(lower(concat(coalesce(place_name, ''), ' ', status)), 'complete')",
    ["area"],
)
def search_areas(v: Views):
    hay = F.concat_ws(" ", F.coalesce("place_name", F.lit("")), "status")
    return compose.search_areas(v.area, "  Nation_1 complete ", hay, "size").select("area_id")


@query(
    "featured_area",
    "SELECT area_id FROM area_v WHERE status = 'completed' AND area_id IN ('N3', 'N5', 'N8') ORDER BY area_id LIMIT 1",
    ["area"],
)
def featured_area(v: Views):
    wanted = v.area.filter(F.col("area_id").isin("N3", "N5", "N8")).select("area_id", F.substring("area_id", 2, 5).cast("int").alias("rank"))
    return compose.pick_featured(v.area, wanted).select("area_id")


@query(
    "place_updates",
    "SELECT area_id, CASE WHEN root % 2 = 0 THEN concat('New ', area_id) ELSE place_name END AS place_name FROM area_v",
    ["area"],
)
def place_updates(v: Views):
    answers = v.area.select("area_id", F.when(F.col("root") % 2 == 0, F.concat(F.lit("New "), "area_id")).alias("place_name"))
    return compose.set_place(v.area, answers).select("area_id", "place_name")


@query(
    "area_status_after_batch",
    """SELECT area_id, CASE root WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'importing' ELSE status END AS status,
       CASE WHEN root = 0 THEN 99 ELSE imported_day END AS imported_day FROM area_v""",
    ["area"],
)
def area_status_after_batch(v: Views):
    outcome = F.when(F.col("root") == 0, "ok").when(F.col("root") == 1, "failed").when(F.col("root") == 2, "started")
    return compose.area_status(v.area, v.area.filter("root < 3").select("area_id", outcome.alias("outcome"), F.lit(99).alias("day"))).select("area_id", "status", "imported_day")


@query("dropped_area_rows", "SELECT count(*) AS n FROM poi_v WHERE area_id NOT IN ('R1', 'R3')", ["poi", "area"])
def dropped_area_rows(v: Views):
    gone = v.area.filter(F.col("area_id").isin("R1", "R3"))
    return compose.drop_area({"pois": v.poi}, gone)["pois"].agg(F.count("*").alias("n"))


@query(
    "block_area_hash",
    "SELECT area_id, sha256(string_agg(id, chr(10) ORDER BY id)) AS hash FROM (SELECT area_id, " + uuid5_sql(ids.BLOCK_NAMESPACE, "concat(area_id, ':', node_id)") + " AS id FROM node_v) t GROUP BY area_id",
    ["node"],
)
def block_area_hash(v: Views):
    blocks = v.node.select("area_id", ids.uuid5(ids.BLOCK_NAMESPACE, F.concat_ws(":", "area_id", "node_id")).alias("block_id"))
    return compose.road_graph_hash(blocks)


COMPOSABLE = f"""sq AS (SELECT concat('O', k) AS block_id, concat('R', k % 5) AS area_id, lat, lon, CAST(0.0007 AS DOUBLE) AS h, k % 4 = 0 AS is_clipped FROM poi_v WHERE k % 3 = 0
   UNION ALL SELECT concat('I', k), a.area_id, lat, lon, CAST(0.0002 AS DOUBLE), k % 7 = 0 FROM poi_v p JOIN area_v a ON a.parent_id = p.area_id WHERE lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon)"""


@query(
    "composable_blocks",
    f"""WITH {INNER}, {COMPOSABLE} SELECT i.outer_id, s.block_id FROM sq s JOIN inn i ON i.inner_id = s.area_id WHERE NOT s.is_clipped
        AND NOT EXISTS (SELECT 1 FROM sq b WHERE b.area_id = i.outer_id AND abs(b.lat - s.lat) <= b.h AND abs(b.lon - s.lon) <= b.h)""",
    ["area", "poi"],
)
def composable_blocks(v: Views):
    from terrafold.operators import spatial

    def square(df, prefix, half, clip):
        h = F.lit(half)
        ring = geo.bbox_ring(F.col("lat") - h, F.col("lon") - h, F.col("lat") + h, F.col("lon") + h)
        return df.select(F.concat(F.lit(prefix), "k").alias("block_id"), "area_id", "lat", "lon", ring.alias("ring"), (F.col("k") % clip == 0).alias("is_clipped"))

    outer = square(v.poi.filter("k % 3 = 0").withColumn("area_id", F.concat(F.lit("R"), F.col("k") % 5)), "O", 0.0007, 4)
    boxes = v.area.filter("parent_id IS NOT NULL").select(F.col("area_id").alias("inner"), F.col("parent_id").alias("area_id"), *compose.BOX)
    held = spatial.points_in_boxes(v.poi, boxes, on="area_id").withColumn("area_id", F.col("inner"))
    return compose.composable_blocks(outer.unionByName(square(held, "I", 0.0002, 7)), v.area).select("outer_id", "block_id")
