"""Import and road-network queries over the towns."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geo, tags
from terrafold.operators import compose, ingest, network
from terrafold.plans import oracle as o
from terrafold.plans.elements import Imported
from terrafold.plans.q_tags import CATEGORY, CLASS, HEIGHT, KIND_LIST, LANE_TYPE, LANE_WIDTH, LEVELS, ONEWAY, ONEWAY_TAG, split_sql
from terrafold.plans.registry import query
from terrafold.plans.views import Views
from terrafold.sources import osm

ROADS = f"""wr AS (SELECT way_id, area_id, {CLASS.format(h='highway')} AS class, {ONEWAY.format(v='ow')} AS dir, name, lanes, lanes_forward, CAST(NULL AS VARCHAR) AS lanes_backward, n
     FROM (SELECT *, {ONEWAY_TAG.format(p='')} AS ow, count(*) OVER (PARTITION BY way_id) AS n FROM way_v) t WHERE pos = 0),
  road AS ({split_sql("wr WHERE class IS NOT NULL AND n >= 2", "way_id, area_id, class, dir, name")}),
  rnode AS (SELECT w.way_id, w.area_id, w.pos, w.node_id, w.lat, w.lon, max(w.pos) OVER (PARTITION BY w.way_id) AS last FROM way_v w JOIN road USING (way_id)),
  rr AS (SELECT r.* FROM restriction_v r WHERE kind IN ({KIND_LIST}) AND from_way IN (SELECT way_id FROM road) AND to_way IN (SELECT way_id FROM road)),
  nav AS (SELECT area_id, node_id FROM rnode GROUP BY area_id, node_id HAVING count(*) > 1
          UNION SELECT area_id, node_id FROM rnode WHERE pos = 0 OR pos = last UNION SELECT area_id, via_node FROM rr)"""
SEGMENTS = ROADS + f""",
  step AS (SELECT *, {o.hav('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS d, {o.bearing('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS fb,
                  {o.bearing('lead(lat) OVER w', 'lead(lon) OVER w', 'lat', 'lon')} AS rb FROM rnode WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
  bp AS (SELECT way_id, area_id, pos AS p0, node_id AS a, lead(pos) OVER (PARTITION BY way_id ORDER BY pos) AS p1, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS b
         FROM rnode JOIN nav USING (area_id, node_id)),
  piece AS (SELECT bp.*, sum(d) AS dist, max(CASE WHEN s.pos = p0 THEN fb END) AS f_out, max(CASE WHEN s.pos = p1 - 1 THEN fb END) AS f_in,
                   max(CASE WHEN s.pos = p1 - 1 THEN rb END) AS r_out, max(CASE WHEN s.pos = p0 THEN rb END) AS r_in
            FROM bp JOIN step s ON s.way_id = bp.way_id AND s.pos >= p0 AND s.pos < p1 WHERE p1 IS NOT NULL GROUP BY ALL),
  seg AS (SELECT area_id, concat(way_id, '>', a, '>', b) AS segment_id, way_id AS road_id, class, a AS from_node, b AS to_node, dist, f_in AS b_in, f_out AS b_out, forward AS lanes
          FROM piece JOIN road USING (way_id, area_id) WHERE dir >= 0
          UNION ALL SELECT area_id, concat(way_id, '>', b, '>', a), way_id, class, b, a, dist, r_in, r_out, backward FROM piece JOIN road USING (way_id, area_id) WHERE dir <= 0)"""
TURNS = SEGMENTS + f""",
  turn AS (SELECT i.area_id, i.to_node AS node_id, i.segment_id AS incoming, u.segment_id AS outgoing, {o.turn('i.b_in', 'u.b_out')} AS movement
           FROM seg i JOIN seg u ON i.area_id = u.area_id AND i.to_node = u.from_node)"""
RESOLVED = TURNS + """,
  res AS (SELECT r.*, (SELECT count(*) FROM seg s WHERE s.area_id = r.area_id AND s.road_id = r.from_way AND s.to_node = r.via_node) AS n_in,
                 (SELECT count(*) FROM seg s WHERE s.area_id = r.area_id AND s.road_id = r.to_way AND s.from_node = r.via_node) AS n_out,
                 (SELECT min(segment_id) FROM seg s WHERE s.area_id = r.area_id AND s.road_id = r.from_way AND s.to_node = r.via_node) AS incoming,
                 (SELECT min(segment_id) FROM seg s WHERE s.area_id = r.area_id AND s.road_id = r.to_way AND s.from_node = r.via_node) AS outgoing FROM rr r)"""
APPLIED = RESOLVED + """,
  eff AS (SELECT area_id, incoming, outgoing, ord, kind, starts_with(kind, 'only_') AS allowed FROM res WHERE n_in = 1 AND n_out = 1
          UNION ALL SELECT t.area_id, t.incoming, t.outgoing, ord, kind, FALSE FROM res r JOIN turn t ON t.area_id = r.area_id AND t.incoming = r.incoming AND t.outgoing <> r.outgoing
          WHERE n_in = 1 AND n_out = 1 AND starts_with(kind, 'only_')),
  leff AS (SELECT area_id, incoming, outgoing, arg_max(allowed, ord) AS allowed, arg_max(kind, ord) AS kind FROM eff GROUP BY area_id, incoming, outgoing),
  applied AS (SELECT t.*, coalesce(e.allowed, TRUE) AS allowed, coalesce(e.kind, 'none') AS restriction FROM turn t LEFT JOIN leff e USING (area_id, incoming, outgoing))"""
NET_VIEWS = ["node", "way", "restriction"]


@query(
    "payload_elements",
    """SELECT area_id, type, count(*) AS n, sum(vertices)::BIGINT AS vertices FROM (
       SELECT area_id, 'node' AS type, 0 AS vertices FROM node_v WHERE k % 29 <> 28 UNION ALL SELECT area_id, 'way', count(*) FROM way_v GROUP BY area_id, way_id
       UNION ALL SELECT area_id, 'node', 0 FROM building_v, range(0, 4) UNION ALL SELECT area_id, 'way', CASE WHEN k % 37 = 0 THEN 4 ELSE 5 END FROM building_v
       UNION ALL SELECT area_id, 'relation', 0 FROM restriction_v) e GROUP BY area_id, type""",
    [*NET_VIEWS, "building"],
)
def payload_elements(v: Views):
    # Elements packed into payload texts (several per area) and read back through the payload source.
    e = Imported(v).elements
    packed = e.groupBy("area_id", (F.col("element_pos") % 16).alias("part")).agg(
        F.collect_list(F.struct(*[c for c in e.columns if c not in {"area_id", "element_pos"}])).alias("elements")
    )
    texts = packed.select("area_id", F.to_json(F.struct("elements")).alias("payload"))
    complete, _ = osm.complete_payloads(osm.parse_payloads(texts))
    return osm.explode_elements(complete).groupBy("area_id", "type").agg(
        F.count("*").alias("n"), F.sum(F.coalesce(F.greatest(F.size("nodes"), F.lit(0)), F.lit(0))).alias("vertices")
    )


@query(
    "incomplete_payloads",
    "SELECT area_id, CASE WHEN town % 5 = 2 THEN 'no elements list' ELSE 'incomplete: timed out' END AS reason FROM town_v WHERE town % 3 = 1 OR town % 5 = 2",
    ["town"],
)
def incomplete_payloads(v: Views):
    remark = F.when(F.col("town") % 3 == 1, F.lit("timed out"))
    elements_text = F.when(F.col("town") % 5 != 2, F.lit("[]"))
    text = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"remark":"'), remark, F.lit('"')), F.concat(F.lit('"elements":'), elements_text)), F.lit("}"))
    return osm.complete_payloads(osm.parse_payloads(v.town.select("area_id", text.alias("payload"))))[1]


@query(
    "filled_way_nodes",
    f"""SELECT node_id, {o.rn('lat', 8)} AS lat, {o.rn('lon', 8)} AS lon FROM node_v
        UNION ALL SELECT concat('b', k, '_', i), {o.rn('ring[i + 1].y', 8)}, {o.rn('ring[i + 1].x', 8)} FROM building_v, range(0, 4) r(i)""",
    ["node", "building"],
)
def filled_way_nodes(v: Views):
    return Imported(v).nodes.select("node_id", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"))


SHAPE_ROLE = "CASE WHEN k % 6 < 4 THEN 'building' WHEN k % 6 = 4 THEN 'poi' WHEN k % 4 IN (1, 3) THEN 'area' END"


@query(
    "classified_ways",
    f"""SELECT way_id, CASE WHEN {CLASS.format(h='highway')} IS NOT NULL THEN 'road' END AS role, FALSE AS ring_ok FROM way_v WHERE pos = 0
        UNION ALL SELECT source_id, {SHAPE_ROLE}, k % 37 <> 0 FROM building_v""",
    ["node", "way", "building"],
)
def classified_ways(v: Views):
    return Imported(v).classified.select("way_id", "role", "ring_ok")


@query("skipped_features", f"SELECT source_id, {SHAPE_ROLE} AS role FROM building_v WHERE k % 37 = 0 AND k % 6 <> 4 AND ({SHAPE_ROLE}) IS NOT NULL", ["building"])
def skipped_features(v: Views):
    return ingest.skipped_features(Imported(v).classified).select("source_id", "role")


@query(
    "skip_report",
    f"""SELECT area_id, count(*) AS skipped_features, (SELECT count(*) FROM restriction_v r WHERE r.area_id = b.area_id AND kind NOT IN ({KIND_LIST})) AS malformed_restrictions
        FROM building_v b WHERE k % 37 = 0 AND k % 6 <> 4 AND ({SHAPE_ROLE}) IS NOT NULL GROUP BY area_id""",
    [*NET_VIEWS, "building"],
)
def skip_report(v: Views):
    i = Imported(v)
    skipped = compose.count_per(ingest.skipped_features(i.classified), "skipped_features")
    bad = compose.count_per(i.restrictions.filter("outcome = 'malformed'"), "malformed_restrictions")
    return skipped.join(bad, "area_id", "left").select("area_id", "skipped_features", F.coalesce("malformed_restrictions", F.lit(0)).alias("malformed_restrictions"))


@query(
    "road_attributes",
    f"WITH {ROADS} SELECT way_id AS source_id, class, dir AS direction, name, forward AS forward_lanes, backward AS backward_lanes FROM road",
    NET_VIEWS,
)
def road_attributes(v: Views):
    return Imported(v).roads.select("source_id", "class", "direction", "name", "forward_lanes", "backward_lanes")


@query(
    "imported_buildings",
    f"""SELECT source_id, {CATEGORY.format(b='lower(trim(building))')} AS category, {o.rn(HEIGHT('height'), 4)} AS height_m, {LEVELS('building_levels')} AS n_levels,
        {o.rn(o.steps_sum('ring', o.hav('{a}.y', '{a}.x', '{b}.y', '{b}.x')), 5)} AS perimeter_m FROM building_v WHERE k % 6 < 4 AND k % 37 <> 0""",
    ["building"],
)
def imported_buildings(v: Views):
    i = Imported(v)
    b = i.buildings
    return b.select("source_id", "category", F.round("height_meters", 4).alias("height_m"), F.col("levels").alias("n_levels"), F.round(geo.length_m("line"), 5).alias("perimeter_m"))


@query("imported_area_features", "SELECT source_id, CASE WHEN k % 4 = 1 THEN 'park' ELSE 'water' END AS kind FROM building_v WHERE k % 6 = 5 AND k % 4 IN (1, 3) AND k % 37 <> 0", ["building"])
def imported_area_features(v: Views):
    return ingest.area_features(Imported(v).classified).select("source_id", "kind")


@query(
    "missing_references",
    f"WITH {ROADS} SELECT DISTINCT way_id AS source_id, node_id FROM rnode JOIN node_v USING (node_id) WHERE k % 29 = 28",
    NET_VIEWS,
)
def missing_references(v: Views):
    i = Imported(v)
    return ingest.missing_refs(i.roads, i.parts["nodes"]).select("source_id", "node_id")


@query(
    "poi_points",
    f"""SELECT node_id AS source_id, {o.rn('lat', 7)} AS lat, {o.rn('lon', 7)} AS lon, CASE WHEN k % 13 = 0 THEN 'food_and_drink' ELSE 'shopping' END AS category,
        CASE WHEN k % 26 = 0 THEN 'Corner' END AS name FROM node_v WHERE (k % 13 = 0 OR k % 17 = 0) AND k % 29 <> 28
        UNION ALL SELECT source_id, CASE WHEN k % 37 = 0 THEN {o.rn('ring[3].y', 7)} ELSE {o.rn('(ring[1].y + ring[2].y + ring[3].y + ring[4].y) / 4', 7)} END,
        CASE WHEN k % 37 = 0 THEN {o.rn('ring[3].x', 7)} ELSE {o.rn('(ring[1].x + ring[2].x + ring[3].x + ring[4].x) / 4', 7)} END,
        CASE WHEN k % 4 = 0 THEN 'education' ELSE 'transit' END, NULL FROM building_v WHERE k % 6 = 4""",
    ["node", "building"],
)
def poi_points(v: Views):
    i = Imported(v)
    p = ingest.pois(i.classified, i.parts["nodes"], i.nodes)
    return p.select("source_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "category", "name")


@query(
    "turn_restrictions",
    f"""WITH {ROADS} SELECT source_id, CASE WHEN kind IN ({KIND_LIST}) THEN kind END AS kind, from_way, via_node, to_way, CASE WHEN kind IN ({KIND_LIST}) THEN 'car' ELSE 'malformed' END AS outcome,
        source_id IN (SELECT source_id FROM rr) AS resolvable FROM restriction_v""",
    NET_VIEWS,
)
def turn_restrictions(v: Views):
    i = Imported(v)
    ok = i.resolvable.select("source_id", F.lit(True).alias("ok"))
    return i.restrictions.join(ok, "source_id", "left").select("source_id", "kind", "from_way", "via_node", "to_way", "outcome", F.coalesce("ok", F.lit(False)).alias("resolvable"))


@query("navigable_nodes", f"WITH {ROADS} SELECT area_id, node_id FROM nav", NET_VIEWS)
def navigable_nodes(v: Views):
    return Imported(v).navigable


@query("road_segments", f"WITH {SEGMENTS} SELECT segment_id, road_id, class, from_node, to_node, lanes, {o.rn('dist', 4)} AS distance_m FROM seg", NET_VIEWS)
def road_segments(v: Views):
    s = Imported(v).segments
    return s.select("segment_id", "road_id", "class", "from_node", "to_node", F.col("lane_count").alias("lanes"), F.round("distance_m", 4).alias("distance_m"))


TWIN = "LEFT JOIN seg t ON t.area_id = s.area_id AND t.road_id = s.road_id AND t.from_node = s.to_node AND t.to_node = s.from_node"


@query("reverse_twins", f"WITH {SEGMENTS} SELECT s.segment_id, t.segment_id IS NOT NULL AS has_twin, t.lanes AS twin_lanes FROM seg s {TWIN}", NET_VIEWS)
def reverse_twins(v: Views):
    return network.twins(Imported(v).segments).select("segment_id", "has_twin", "twin_lanes")


@query(
    "cross_sections",
    f"""WITH {SEGMENTS} SELECT s.segment_id, coalesce(s.lanes, CASE WHEN t.segment_id IS NULL THEN 2 ELSE 1 END) AS lanes, CASE WHEN s.lanes IS NULL THEN 'defaulted' ELSE 'tagged' END AS provenance,
        {LANE_TYPE.format(c='s.class')} AS lane_type,
        {o.rn("(coalesce(s.lanes, CASE WHEN t.segment_id IS NULL THEN 2 ELSE 1 END) + CASE WHEN t.segment_id IS NULL THEN 0 ELSE coalesce(t.lanes, 1) END) * " + LANE_WIDTH.format(c='s.class'), 4)} AS width_m
        FROM seg s {TWIN}""",
    NET_VIEWS,
)
def cross_sections(v: Views):
    return network.cross_sections(Imported(v).segments).select("segment_id", "lanes", "provenance", "lane_type", F.round("width_m", 4).alias("width_m"))


@query("turn_candidates", f"WITH {TURNS} SELECT node_id, incoming, outgoing, movement FROM turn", NET_VIEWS)
def turn_candidates(v: Views):
    return network.turn_candidates(Imported(v).segments).drop("area_id")


@query(
    "resolved_restrictions",
    f"""WITH {RESOLVED} SELECT source_id, CASE WHEN n_in = 1 AND n_out = 1 THEN incoming END AS incoming, CASE WHEN n_in = 1 AND n_out = 1 THEN outgoing END AS outgoing, n_in = 1 AND n_out = 1 AS resolved FROM res""",
    NET_VIEWS,
)
def resolved_restrictions(v: Views):
    i = Imported(v)
    return network.resolve_restrictions(i.resolvable, i.segments).select("source_id", "incoming", "outgoing", "resolved")


def applied_turns(i: Imported):
    return i.segments, i.turns


@query("restricted_turns", f"WITH {APPLIED} SELECT incoming, outgoing, movement, allowed, restriction FROM applied", NET_VIEWS)
def restricted_turns(v: Views):
    return applied_turns(Imported(v))[1].select("incoming", "outgoing", "movement", "allowed", "restriction")


@query("legal_exits", f"WITH {APPLIED} SELECT incoming, count(*) AS exits FROM applied WHERE allowed GROUP BY incoming", NET_VIEWS)
def legal_exits(v: Views):
    return network.legal_exits(applied_turns(Imported(v))[1]).groupBy("incoming").agg(F.count("*").alias("exits"))


@query("legal_graph", f"WITH {APPLIED} SELECT incoming, outgoing FROM applied WHERE allowed AND incoming NOT IN (SELECT segment_id FROM seg WHERE class = 'trunk') AND outgoing NOT IN (SELECT segment_id FROM seg WHERE class = 'trunk')", NET_VIEWS)
def legal_graph(v: Views):
    segments, turns = applied_turns(Imported(v))
    return network.legal_graph(segments, turns, "class <> 'trunk'")[1].select("incoming", "outgoing")


@query("broken_turns", f"WITH {TURNS} SELECT incoming, outgoing FROM turn WHERE movement = 'left'", NET_VIEWS)
def broken_turns(v: Views):
    s = Imported(v).segments
    t = network.turn_candidates(s)
    moved = t.withColumn("node_id", F.when(F.col("movement") == "left", F.concat("node_id", F.lit("x"))).otherwise(F.col("node_id")))
    return network.check_turns(moved, s).select("incoming", "outgoing")


@query("routable_nodes", f"WITH {SEGMENTS} SELECT from_node AS node_id FROM seg WHERE class = 'primary' UNION SELECT to_node FROM seg WHERE class = 'primary' UNION SELECT node_id FROM nav JOIN node_v USING (node_id) WHERE k % 10 = 0", NET_VIEWS)
def routable_nodes(v: Views):
    i = Imported(v)
    few = i.navigable.filter(F.substring("node_id", -1, 1) == "0")
    return network.with_endpoints(few, i.segments.filter("class = 'primary'")).select("node_id")


@query(
    "layer_counts",
    f"""WITH {ROADS} SELECT t.area_id, (SELECT count(*) FROM road r WHERE r.area_id = t.area_id) AS roads, (SELECT count(*) FROM nav n WHERE n.area_id = t.area_id) AS nodes,
        (SELECT count(*) FROM building_v b WHERE b.area_id = t.area_id AND k % 6 < 4 AND k % 37 <> 0) AS buildings,
        (SELECT count(*) FROM building_v b WHERE b.area_id = t.area_id AND k % 6 = 4) + (SELECT count(*) FROM node_v b WHERE b.area_id = t.area_id AND (k % 13 = 0 OR k % 17 = 0) AND k % 29 <> 28) AS pois,
        (SELECT count(*) FROM building_v b WHERE b.area_id = t.area_id AND k % 6 = 5 AND k % 4 IN (1, 3) AND k % 37 <> 0) AS area_features FROM town_v t""",
    [*NET_VIEWS, "building", "town"],
)
def layer_counts(v: Views):
    i = Imported(v)
    layers = {
        "roads": i.roads, "nodes": i.navigable, "buildings": ingest.buildings(i.classified),
        "pois": ingest.pois(i.classified, i.parts["nodes"], i.nodes), "area_features": ingest.area_features(i.classified),
    }
    return compose.layer_counts(v.town, layers)


@query(
    "features_outside_box",
    "SELECT source_id, concat('way/', source_id) AS ref FROM building_v b JOIN town_v t USING (area_id) WHERE lat - hy > max_lat - CAST(0.004 AS DOUBLE) OR lon - hx > max_lon",
    ["building", "town"],
)
def features_outside_box(v: Views):
    small = v.town.withColumn("max_lat", F.col("max_lat") - 0.004)
    return ingest.outside_box(v.building.withColumnRenamed("ring", "line"), small).select("source_id", "ref")


@query("node_pois_outside_box", "SELECT node_id AS source_id, concat('node/', node_id) AS ref FROM node_v n JOIN town_v t USING (area_id) WHERE lat > max_lat OR lon > max_lon", ["node", "town"])
def node_pois_outside_box(v: Views):
    n = v.node.withColumn("source_id", F.col("node_id")).withColumn("footprint", F.lit(None).cast("array<string>"))
    return ingest.pois_outside_box(n, v.town).select("source_id", "ref")


REL = "concat('relation/', CAST((k - k % 5) / 5 AS BIGINT), '/', k % 5)"


@query(
    "rings_near_box",
    f"""SELECT source_id FROM (SELECT {REL} AS source_id, meets, max(meets) OVER (PARTITION BY area_id, CAST((k - k % 5) / 5 AS BIGINT)) AS any_meets FROM
        (SELECT *, CASE WHEN lat - hy > max_lat - CAST(0.0045 AS DOUBLE) OR lon - hx > max_lon - CAST(0.006 AS DOUBLE) THEN 0 ELSE 1 END AS meets FROM building_v JOIN town_v t USING (area_id)) b) x
        WHERE meets = 1 OR any_meets = 0""",
    ["building", "town"],
)
def rings_near_box(v: Views):
    small = v.town.withColumn("max_lat", F.col("max_lat") - 0.0045).withColumn("max_lon", F.col("max_lon") - 0.006)
    rings = v.building.select("area_id", F.expr(REL).alias("source_id"), F.col("ring").alias("line"))
    return ingest.drop_far_rings(rings, small).select("source_id")
