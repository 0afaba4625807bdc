"""Streets, ring assembly and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geo, tags
from terrafold.operators import graph, ingest, spatial
from terrafold.plans import oracle as o
from terrafold.plans.elements import Imported, staged
from terrafold.plans.q_geometry import uuid5_sql
from terrafold.functions import ids
from terrafold.plans.q_network import APPLIED, NET_VIEWS, ROADS
from terrafold.plans.registry import query
from terrafold.plans.views import Views
from terrafold.session import settle


def ways_with_lines(v: Views):
    i = Imported(v)
    return staged(v, "road_lines", lambda: ingest.resolve_geometry(i.roads, i.nodes))


NAMED = ROADS + f""",
  nway AS (SELECT way_id, area_id, class, dir, name, nullif(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), '') AS norm FROM road),
  at_node AS (SELECT DISTINCT w.area_id, norm, w.way_id, node_id FROM nway w JOIN rnode r ON r.way_id = w.way_id WHERE norm IS NOT NULL),
  link AS (SELECT DISTINCT a.area_id, a.way_id AS a, f.b FROM at_node a JOIN (SELECT area_id, norm, node_id, min(way_id) AS b FROM at_node GROUP BY ALL) f USING (area_id, norm, node_id) WHERE a.way_id <> f.b),
  ends AS (SELECT way_id, arg_min(lat, pos) AS la, arg_min(lon, pos) AS lo, arg_max(lat, pos) AS lb, arg_max(lon, pos) AS lp FROM rnode GROUP BY way_id),
  head AS (SELECT w.*, CASE WHEN dir > 0 THEN {o.bearing('la', 'lo', 'lb', 'lp')} ELSE {o.bearing('lb', 'lp', 'la', 'lo')} END AS h FROM nway w JOIN ends USING (way_id) WHERE norm IS NOT NULL AND dir <> 0),
  divided AS (SELECT DISTINCT a.area_id, a.way_id AS a, b.way_id AS b FROM head a JOIN head b ON a.area_id = b.area_id AND a.norm = b.norm AND a.way_id < b.way_id
     AND least(abs(a.h - b.h), 360 - abs(a.h - b.h)) >= 135
     WHERE EXISTS (SELECT 1 FROM rnode p JOIN rnode q ON p.way_id = a.way_id AND q.way_id = b.way_id AND {o.hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} <= 30))"""


@query("same_name_links", f"WITH {NAMED} SELECT a, b FROM link", NET_VIEWS)
def same_name_links(v: Views):
    return graph.connected_links(ways_with_lines(v).withColumn("norm_name", tags.norm_name("name"))).select("a", "b")


DOUBLED = NAMED.replace("ends AS (SELECT way_id,", """rnode2 AS (SELECT way_id, area_id, pos, lat, lon FROM rnode UNION ALL SELECT concat(way_id, 'x'), area_id, pos, lat + CAST(0.00008 AS DOUBLE), lon + CAST(0.00008 AS DOUBLE) FROM rnode),
  nway2 AS (SELECT way_id, area_id, dir, norm FROM nway UNION ALL SELECT concat(way_id, 'x'), area_id, -dir, norm FROM nway),
  ends AS (SELECT way_id,""").replace("FROM rnode GROUP BY way_id)", "FROM rnode2 GROUP BY way_id)").replace("FROM nway w JOIN ends", "FROM nway2 w JOIN ends").replace("FROM rnode p JOIN rnode q", "FROM rnode2 p JOIN rnode2 q")


@query("divided_road_links", f"WITH {DOUBLED} SELECT a, b FROM divided", NET_VIEWS)
def divided_road_links(v: Views):
    # Every street gets a second carriageway about 12 m away, drawn the same way and driven the other way.
    w = ways_with_lines(v).withColumn("norm_name", tags.norm_name("name"))
    moved = F.transform("line", lambda p: geo.point(p["x"] + 0.00008, p["y"] + 0.00008))
    second = w.withColumn("source_id", F.concat("source_id", F.lit("x"))).withColumn("line", moved).withColumn("direction", -F.col("direction"))
    return graph.divided_links(w.unionByName(second)).select("a", "b")


STREETS = NAMED.replace("wr AS", "RECURSIVE wr AS", 1) + """,
  both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link UNION SELECT a, b FROM divided UNION SELECT b, a FROM divided),
  reach(way_id, other) AS (SELECT way_id, way_id FROM nway UNION SELECT r.way_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
  comp AS (SELECT way_id, min(other) AS first_way FROM reach GROUP BY way_id)"""


@query("street_components", f"WITH {STREETS} SELECT way_id AS source_id, first_way FROM comp", NET_VIEWS)
def street_components(v: Views):
    return grouped(v).select("source_id", "first_way")


def grouped(v: Views):
    return staged(v, "street_groups", lambda: graph.group_streets(ways_with_lines(v)))


RANK = "list_position(['motorway','trunk','primary','secondary','tertiary','unclassified','residential','service'], class)"


@query(
    "streets",
    f"""WITH {STREETS}, st AS (SELECT area_id, first_way, string_agg(way_id, '+' ORDER BY way_id) AS street_key, list(name ORDER BY way_id)[1] AS name, arg_min(class, {RANK}) AS class, count(*) AS ways FROM nway JOIN comp USING (way_id) GROUP BY area_id, first_way)
        SELECT {uuid5_sql(ids.STREET_NAMESPACE, "concat(area_id, ':', street_key)")} AS street_id, street_key, name, class, ways FROM st""",
    NET_VIEWS,
)
def streets(v: Views):
    return graph.streets(ways_with_lines(v), grouped(v)).select("street_id", "street_key", "name", "class", "ways")


@query(
    "segments_with_street",
    f"""WITH {STREETS} SELECT first_way AS street, count(*) AS vertices FROM rnode JOIN comp USING (way_id) GROUP BY first_way""",
    NET_VIEWS,
)
def segments_with_street(v: Views):
    from terrafold.operators import network

    i = Imported(v)
    street = grouped(v).select("area_id", "source_id", F.col("first_way").alias("street"))
    # Each road vertex once: road rows joined to their street, checked against the vertex counts per street.
    flat = i.roads.select("area_id", F.col("source_id").alias("road_id"), F.explode("nodes").alias("node_id"))
    return network.with_street(flat, street).groupBy("street").agg(F.count("*").alias("vertices"))


# Squares drawn as two to four pieces, some reversed, one in seven left open.
@query(
    "assembled_rings",
    f"SELECT concat('relation/', k) AS source_id, 5 AS n, {o.rn(o.steps_sum('ring', o.hav('{a}.y', '{a}.x', '{b}.y', '{b}.x')), 4)} AS perimeter_m FROM building_v WHERE k % 7 <> 3",
    ["building"],
)
def assembled_rings(v: Views):
    r = F.col("ring")
    piece = lambda i, start, n, flip: F.struct(F.lit(i).alias("member_pos"), (F.reverse(F.slice(r, start, n)) if flip else F.slice(r, start, n)).alias("line"))
    two = F.array(piece(0, 1, 3, False), piece(1, 3, 3, True))
    four = F.array(piece(2, 1, 2, False), piece(0, 4, 2, True), piece(3, 2, 2, False), piece(1, 3, 2, True))
    opened = F.array(piece(0, 1, 3, False), piece(1, 3, 2, False))
    members = F.when(F.col("k") % 7 == 3, opened).when(F.col("k") % 2 == 0, two).otherwise(four)
    m = v.building.select("area_id", F.col("k").cast("string").alias("relation_id"), F.explode(members).alias("m")).select("area_id", "relation_id", "m.*")
    rings = graph.assemble_rings(m)
    return rings.select("source_id", F.size("ring").alias("n"), F.round(geo.length_m("ring"), 4).alias("perimeter_m"))


# One large ring per region: its customers as vertices around a centre, one piece from each to the next. Members come in a scrambled order, every third piece
# is drawn backwards, every second has its geometry inline and the others come by their way's nodes.
VERTICES = """SELECT area_id, k, i, n, (i * 7919 + 13) % n AS member_pos, CAST(10.0135 AS DOUBLE) + CAST(0.03 AS DOUBLE) * CAST(substr(area_id, 2, 3) AS BIGINT) + (CAST(0.004 AS DOUBLE) + CAST(0.0005 AS DOUBLE) * (k % 5)) * sin(i * 2 * pi() / n) AS lat,
  -CAST(83.9865 AS DOUBLE) + (CAST(0.004 AS DOUBLE) + CAST(0.0005 AS DOUBLE) * (k % 5)) * cos(i * 2 * pi() / n) AS lon
  FROM (SELECT area_id, k, CAST(row_number() OVER (PARTITION BY area_id ORDER BY k) - 1 AS BIGINT) AS i, CAST(count(*) OVER (PARTITION BY area_id) AS BIGINT) AS n FROM {poi}) c"""


@query(
    "relation_rings",
    f"""WITH v AS ({VERTICES.format(poi='poi_v')}), e AS (SELECT a.*, b.lat AS lat2, b.lon AS lon2 FROM v a JOIN v b ON a.area_id = b.area_id AND b.i = (a.i + 1) % a.n)
        SELECT concat('relation/', area_id) AS source_id, CASE WHEN area_id = 'R0' THEN 'residential' WHEN area_id = 'R1' THEN 'park' ELSE 'water' END AS kind, CAST(count(*) + 1 AS INT) AS vertices,
          {o.rn(f"sum({o.hav('lat', 'lon', 'lat2', 'lon2')})", 3)} AS perimeter_m,
          {o.rn("max(CASE WHEN member_pos = 0 THEN CASE WHEN k % 3 = 0 THEN lat2 ELSE lat END END)", 7)} AS first_lat, {o.rn("max(CASE WHEN member_pos = 0 THEN CASE WHEN k % 3 = 0 THEN lat ELSE lat2 END END)", 7)} AS second_lat
        FROM e GROUP BY area_id""",
    ["poi"],
)
def relation_rings(v: Views):
    vertex = settle(v.spark.sql(VERTICES.format(poi="{poi}"), poi=v.poi))
    after = vertex.select("area_id", F.pmod(F.col("i") - 1, F.col("n")).alias("i"), F.col("k").alias("k2"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    e = vertex.join(after, ["area_id", "i"])
    node = lambda k: F.concat(F.lit("v"), k)
    turned = lambda a: F.when(F.col("k") % 3 == 0, F.reverse(a)).otherwise(a)
    at = lambda lat, lon: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    nodes = vertex.select("area_id", node("k").alias("node_id"), "lat", "lon")
    ways = e.filter("k % 2 = 1").select("area_id", node("k").alias("way_id"), turned(F.array(node("k"), node("k2"))).alias("nodes"))
    member = F.struct(
        "member_pos", F.lit("way").alias("type"), node("k").alias("ref"), F.when(F.col("k") % 4 == 0, F.lit("")).otherwise(F.lit("outer")).alias("role"),
        F.when(F.col("k") % 2 == 0, turned(F.array(at("lat", "lon"), at("lat2", "lon2")))).alias("geometry"),
    )
    listed = e.groupBy("area_id").agg(F.array_sort(F.collect_list(member)).alias("m"))
    key, value = F.when(F.col("area_id") == "R0", "building").when(F.col("area_id") == "R1", "leisure").otherwise("natural"), F.when(F.col("area_id") == "R0", "house").when(F.col("area_id") == "R1", "park").otherwise("water")
    relations = listed.select(
        "area_id", F.lit(0).cast("bigint").alias("element_pos"), F.col("area_id").alias("relation_id"), F.map_from_arrays(F.array(F.lit("type"), key), F.array(F.lit("multipolygon"), value)).alias("tags"),
        F.transform("m", lambda x: x.dropFields("member_pos")).alias("members"),
    )
    buildings, areas, made = ingest.relation_features(relations, ways, nodes)
    features = buildings.select("area_id", "source_id", "nodes", F.col("category").alias("kind")).unionByName(areas.select("area_id", "source_id", "nodes", "kind"))
    rings = ingest.resolve_geometry(features, made, into="ring")
    at_lat = lambda i: F.round(F.col("ring")[i]["y"], 7)
    return rings.select("source_id", "kind", F.size("ring").alias("vertices"), F.round(geo.length_m("ring"), 3).alias("perimeter_m"), at_lat(0).alias("first_lat"), at_lat(1).alias("second_lat"))


OD_SQL = "od AS (SELECT concat(area_id, '-', j) AS od_id, area_id, concat('n', town * 100 + (j * 37 + 3) % 100) AS origin, concat('n', town * 100 + (j * 53 + 71) % 100) AS destination FROM town_v, range(0, 4) t(j))"


def od_pairs(v: Views):
    t = v.town.select("area_id", "town", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    n = lambda a, b: F.concat(F.lit("n"), F.col("town") * 100 + (F.col("j") * a + b) % 100)
    return t.select(F.concat_ws("-", "area_id", "j").alias("od_id"), "area_id", n(37, 3).alias("origin"), n(53, 71).alias("destination"))


ROUTES = APPLIED.replace("wr AS", "RECURSIVE wr AS", 1) + f", {OD_SQL}" + """,
  dist(od_id, edge, d) USING KEY (od_id, edge) AS (
    SELECT od_id, segment_id, dist FROM od JOIN seg ON seg.area_id = od.area_id AND seg.from_node = od.origin WHERE origin <> destination
    UNION
    SELECT od_id, edge, min(d) FROM (SELECT c.od_id, t.outgoing AS edge, c.d + s.dist AS d FROM dist c JOIN applied t ON t.incoming = c.edge AND t.allowed JOIN seg s ON s.segment_id = t.outgoing) x
    WHERE NOT EXISTS (SELECT 1 FROM recurring.dist k WHERE k.od_id = x.od_id AND k.edge = x.edge AND k.d <= x.d) GROUP BY od_id, edge)"""


@query(
    "turn_aware_routes",
    f"""WITH {ROUTES} SELECT od.od_id, CASE WHEN origin = destination OR min(d) IS NOT NULL THEN 'ok' ELSE 'no_route' END AS status,
        CASE WHEN origin = destination THEN 0 ELSE {o.rn('min(d)', 3)} END AS total_m
        FROM od LEFT JOIN (SELECT q.od_id, d, to_node FROM dist q JOIN seg s ON s.segment_id = q.edge) a ON a.od_id = od.od_id AND a.to_node = od.destination GROUP BY od.od_id, origin, destination""",
    [*NET_VIEWS, "town"],
)
def turn_aware_routes(v: Views):
    i = Imported(v)
    answers, _ = graph.shortest_paths(i.segments, i.turns.filter("allowed"), od_pairs(v), with_tree=False)
    return answers.select("od_id", "status", F.round("total_m", 3).alias("total_m"))


@query(
    "route_lines",
    f"""WITH {ROUTES} SELECT od.od_id, {o.rn('min(d)', 2)} AS total_m, {o.rn('min(d)', 2)} AS line_m, 1 AS extra_nodes FROM od JOIN (SELECT q.od_id, d, to_node FROM dist q JOIN seg s ON s.segment_id = q.edge) a
        ON a.od_id = od.od_id AND a.to_node = od.destination WHERE origin <> destination GROUP BY od.od_id""",
    [*NET_VIEWS, "town"],
)
def route_lines(v: Views):
    i = Imported(v)
    answers, tree = graph.shortest_paths(i.segments, i.turns.filter("allowed"), od_pairs(v))
    lines = graph.route_lines(graph.reconstruct(answers, tree), i.segments)
    return lines.select(
        "od_id", F.round("total_m", 2).alias("total_m"), F.round(geo.length_m("line"), 2).alias("line_m"), (F.size("nodes") - F.size("segments")).alias("extra_nodes"),
    )


# A street of one piece per customer and region, driven both ways, with turning round allowed everywhere: routes from end to end, back, from the middle, and
# to a node that isn't there.
@query(
    "long_routes",
    f"""WITH v AS ({VERTICES.format(poi='poi_v')}), e AS (SELECT a.area_id, a.i, a.n, {o.hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS d FROM v a JOIN v b ON a.area_id = b.area_id AND b.i = a.i + 1),
        t AS (SELECT area_id, sum(d) AS d, sum(d) FILTER (i >= n // 2) AS half, count(*) AS hops, count(*) FILTER (i >= n // 2) AS half_hops FROM e GROUP BY area_id)
        SELECT concat('on-', area_id) AS od_id, 'ok' AS status, {o.rn('d', 3)} AS total_m, hops FROM t UNION ALL SELECT concat('back-', area_id), 'ok', {o.rn('d', 3)}, hops FROM t
        UNION ALL SELECT concat('half-', area_id), 'ok', {o.rn('half', 3)}, half_hops FROM t UNION ALL SELECT concat('none-', area_id), 'no_route', NULL, 0 FROM t""",
    ["poi"],
)
def long_routes(v: Views):
    vertex = settle(v.spark.sql(VERTICES.format(poi="{poi}"), poi=v.poi))
    after = vertex.select("area_id", (F.col("i") - 1).alias("i"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    e = vertex.join(after, ["area_id", "i"]).withColumn("distance_m", geo.haversine("lat", "lon", "lat2", "lon2"))
    node = lambda i: F.concat(F.lit("v"), F.col("i") + i)
    way = lambda name, a, b: e.select("area_id", F.concat(F.lit(name), "i").alias("segment_id"), node(a).alias("from_node"), node(b).alias("to_node"), "distance_m")
    segments = settle(way("f", 0, 1).unionByName(way("r", 1, 0)))
    turns = segments.select("area_id", F.col("segment_id").alias("incoming"), F.col("to_node").alias("node")).join(segments.select("area_id", F.col("segment_id").alias("outgoing"), F.col("from_node").alias("node")), ["area_id", "node"])
    ends = vertex.groupBy("area_id").agg(F.max("n").alias("n"))
    v_at = lambda i: F.concat(F.lit("v"), i.cast("string"))
    first, last = v_at(F.lit(0)), v_at(F.col("n") - 1)
    pair = lambda name, a, b: F.struct(F.concat(F.lit(f"{name}-"), "area_id").alias("od_id"), a.alias("origin"), b.alias("destination"))
    od = ends.select("area_id", F.explode(F.array(pair("on", first, last), pair("back", last, first), pair("half", v_at(F.floor(F.col("n") / 2)), last), pair("none", first, F.lit("nowhere")))).alias("p")).select("area_id", "p.*")
    answers, tree = graph.shortest_paths(segments, turns, od)
    hops = graph.reconstruct(answers, tree).groupBy("od_id").agg(F.max("hop").alias("hops"))
    return answers.join(hops, "od_id", "left").select("od_id", "status", F.round("total_m", 3).alias("total_m"), F.coalesce("hops", F.lit(0)).cast("bigint").alias("hops"))


@query(
    "route_snaps",
    f"SELECT query_id, nearest_id, d > 25 AS far FROM (SELECT source_id AS query_id, arg_min(node_id, (round(d, 6), node_id)) AS nearest_id, min(d) AS d FROM (SELECT p.source_id, n.node_id, {o.hav('p.lat', 'p.lon', 'n.lat', 'n.lon')} AS d FROM poi_v p, node_v n WHERE k2 = 0) t GROUP BY source_id) u".replace(" WHERE k2 = 0", ""),
    ["poi", "node"],
)
def route_snaps(v: Views):
    q = v.poi.select(F.col("source_id").alias("query_id"), F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon"))
    n = spatial.nearest(q, v.node, "node_id")
    return n.select("query_id", "nearest_id", graph.snap_flag("distance_m").alias("far"))
