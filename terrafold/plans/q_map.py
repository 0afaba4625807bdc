"""Re-import, map data, GeoJSON and stream-style queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import clip, compose, mapdata, reconcile, scan
from terrafold.plans import oracle as o
from terrafold.plans.q_areas import owned_pois
from terrafold.plans.q_areas import OWNED, OWNERS
from terrafold.plans.q_geometry import RING_M2, uuid5_sql
from terrafold.plans.q_spatial import LANES_SQL, lattice_edges
from terrafold.plans.registry import query
from terrafold.plans.views import Views
from terrafold.sources import geojson
from terrafold.streaming import imports


def old_new(v: Views):
    old = v.poi.filter("k % 3 <> 0").select(F.concat(F.lit("old-"), "k").alias("id"), "area_id", "source_id", "kind")
    new = v.poi.filter("k % 5 <> 0 AND area_id <> 'R4'").select("area_id", "source_id", F.upper("kind").alias("kind"), "k")
    return old, new.unionByName(new.filter("k % 4 = 0").withColumn("k", F.col("k") + 10_000_000).withColumn("kind", F.lit("twice")))


@query(
    "upserted_layer",
    f"""SELECT CASE WHEN k % 3 <> 0 THEN concat('old-', k) ELSE {uuid5_sql(reconcile.ROW_NAMESPACE, "concat(area_id, ':', source_id)")} END AS id, source_id, CASE WHEN k % 4 = 0 THEN 'twice' ELSE upper(kind) END AS kind FROM poi_v WHERE k % 5 <> 0 AND area_id <> 'R4'
        UNION ALL SELECT concat('old-', k), source_id, kind FROM poi_v WHERE area_id = 'R4' AND k % 3 <> 0""",
    ["poi"],
)
def upserted_layer(v: Views):
    old, new = old_new(v)
    return reconcile.upsert(old, new, ["area_id", "source_id"], order="k").select("id", "source_id", "kind")


@query(
    "import_changes",
    """SELECT area_id, count(*) FILTER (WHERE n AND NOT o) AS created, count(*) FILTER (WHERE n AND o) AS updated, count(*) FILTER (WHERE o AND NOT n) AS removed FROM
       (SELECT area_id, k % 3 <> 0 AS o, k % 5 <> 0 AS n FROM poi_v WHERE area_id <> 'R4') t GROUP BY area_id""",
    ["poi"],
)
def import_changes(v: Views):
    old, new = old_new(v)
    return reconcile.reconcile_stats({"pois": (old, new, ["area_id", "source_id"])})


@query("swept_children", "SELECT k FROM poi_v WHERE (k - k % 2) % 3 <> 0 OR FALSE", ["poi"])
def swept_children(v: Views):
    children = v.poi.select("k", (F.col("k") - F.col("k") % 2).alias("parent"))
    return reconcile.sweep_children(children, v.poi.filter("k % 3 <> 0"), "parent", "k").select("k")


ELL = "boundary_v WHERE name = 'ell'"


@query(
    "ids_in_boundaries",
    f"""SELECT boundary_id, 'pois' AS layer, source_id AS id FROM (SELECT * FROM {ELL}) b JOIN poi_v p USING (area_id) WHERE {o.in_ring('p.lon', 'p.lat', 'ring')}
        UNION ALL SELECT boundary_id, 'squares', source_id FROM (SELECT * FROM {ELL}) b JOIN (SELECT area_id, source_id, lat, lon, CAST(0.0002 AS DOUBLE) AS s FROM poi_v) p USING (area_id)
          WHERE lat + s >= ring[1].y AND lat - s <= ring[6].y AND lon + s >= ring[1].x AND lon - s <= ring[2].x AND NOT (lat - s > ring[3].y AND lon - s > ring[4].x)""",
    ["boundary", "poi"],
)
def ids_in_boundaries(v: Views):
    b = v.boundary.filter("name = 'ell'")
    h = F.lit(0.0002)
    pts = v.poi.select("area_id", F.col("source_id").alias("id"), "lat", "lon")
    sq = pts.select("area_id", "id", geo.bbox_ring(F.col("lat") - h, F.col("lon") - h, F.col("lat") + h, F.col("lon") + h).alias("shape"))
    return mapdata.ids_in_boundary(b, {"pois": pts}, {}, {"squares": sq})


@query(
    "clipped_buildings",
    f"""SELECT source_id, {o.rn('greatest(0, least(lat + hy, m_lat) - greatest(lat - hy, min_lat)) * greatest(0, least(lon + hx, m_lon) - greatest(lon - hx, min_lon)) * 10000000000', 2)} AS area FROM
        (SELECT b.*, min_lat, min_lon, min_lat + CAST(0.00415 AS DOUBLE) AS m_lat, min_lon + CAST(0.0052 AS DOUBLE) AS m_lon FROM building_v b JOIN town_v t USING (area_id)) x
        WHERE lat - hy < m_lat AND lat + hy > min_lat AND lon - hx < m_lon AND lon + hx > min_lon""",
    ["building", "town"],
)
def clipped_buildings(v: Views):
    small = v.town.withColumn("max_lat", F.col("min_lat") + 0.00415).withColumn("max_lon", F.col("min_lon") + 0.0052)
    c = mapdata.clip_rings_to_box(v.building.select("area_id", "source_id", "ring"), small)
    return c.select("source_id", F.round(F.abs(geo.signed_area("ring")) * 1e10, 2).alias("area"))


@query(
    "clipped_streets",
    f"""WITH {LANES_SQL} SELECT segment_id, {o.rn('sqrt(power(x2 - ax, 2) + power(y2 - ay, 2)) * (t1 - t0) * 100000', 4)} AS length FROM (
          SELECT *, greatest(0, CASE WHEN x2 = ax THEN 0 ELSE least((min_lon - ax) / (x2 - ax), (max_lon - ax) / (x2 - ax)) END, CASE WHEN y2 = ay THEN 0 ELSE least((min_lat - ay) / (y2 - ay), (max_lat - ay) / (y2 - ay)) END) AS t0,
                    least(1, CASE WHEN x2 = ax THEN 1 ELSE greatest((min_lon - ax) / (x2 - ax), (max_lon - ax) / (x2 - ax)) END, CASE WHEN y2 = ay THEN 1 ELSE greatest((min_lat - ay) / (y2 - ay), (max_lat - ay) / (y2 - ay)) END) AS t1
          FROM edge JOIN town_v USING (area_id) WHERE (x2 <> ax OR ax BETWEEN min_lon AND max_lon) AND (y2 <> ay OR ay BETWEEN min_lat AND max_lat)) c WHERE t1 > t0""",
    ["node", "town"],
)
def clipped_streets(v: Views):
    c = mapdata.clip_lines_to_box(lattice_edges(v), v.town, "segment_id")
    return c.groupBy("segment_id").agg(F.round(F.sum(geo.planar_length("line")) * 100000, 4).alias("length"))


@query(
    "squares_cut_by_boundaries",
    f"""SELECT boundary_id, source_id, {o.rn('(greatest(0, least(n, y3) - greatest(s, y1)) * greatest(0, least(e, x2) - greatest(w, x1)) + greatest(0, least(n, y6) - greatest(s, y3)) * greatest(0, least(e, x4) - greatest(w, x1))) * 100000000', 1)} AS area FROM
        (SELECT boundary_id, source_id, lat - CAST(0.0002 AS DOUBLE) AS s, lat + CAST(0.0002 AS DOUBLE) AS n, lon - CAST(0.0002 AS DOUBLE) AS w, lon + CAST(0.0002 AS DOUBLE) AS e,
          ring[1].x AS x1, ring[1].y AS y1, ring[2].x AS x2, ring[3].y AS y3, ring[4].x AS x4, ring[6].y AS y6 FROM (SELECT * FROM {ELL}) b JOIN poi_v p USING (area_id)) q
        WHERE greatest(0, least(n, y3) - greatest(s, y1)) * greatest(0, least(e, x2) - greatest(w, x1)) + greatest(0, least(n, y6) - greatest(s, y3)) * greatest(0, least(e, x4) - greatest(w, x1)) > 0""",
    ["boundary", "poi"],
)
def squares_cut_by_boundaries(v: Views):
    h = F.lit(0.0002)
    sq = v.poi.select("area_id", "source_id", geo.bbox_ring(F.col("lat") - h, F.col("lon") - h, F.col("lat") + h, F.col("lon") + h).alias("ring"))
    c = mapdata.clip_rings_to_boundary(sq, v.boundary.filter("name = 'ell'"), "source_id")
    return c.groupBy("boundary_id", "source_id").agg(F.round(F.sum("area") * 1e8, 1).alias("area"))


@query("footprint_areas", f"SELECT source_id, {o.rn(RING_M2, 3)} AS footprint_m2 FROM building_v", ["building"])
def footprint_areas(v: Views):
    return mapdata.footprint_area(v.building).select("source_id", F.round("footprint_m2", 3).alias("footprint_m2"))


@query(
    "map_data_pois",
    f"""WITH {OWNERS}, {OWNED}, comp AS (SELECT outer_id, source_id, area_id, kind, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY outer_id, source_id ORDER BY rank) AS rn FROM owned JOIN own ON owner_id = area_id) t WHERE rn = 1)
        SELECT boundary_id, c.source_id, c.area_id, c.kind FROM comp c JOIN (SELECT * FROM {ELL}) b ON b.area_id = c.outer_id WHERE {o.in_ring('c.lon', 'c.lat', 'ring')}""",
    ["area", "poi", "boundary"],
)
def map_data_pois(v: Views):
    from terrafold.operators import spatial

    comp = compose.compose_by_source_id(owned_pois(v), compose.owners(v.area)).withColumnRenamed("area_id", "owner_area")
    b = v.boundary.filter("name = 'ell'").select("boundary_id", F.col("area_id").alias("outer_id"), "ring")
    return spatial.points_in_rings(comp, b, on="outer_id", edge_counts=False).select("boundary_id", "source_id", F.col("owner_area").alias("area_id"), "kind")


@query("geojson_batches", "SELECT area_id, batch, count(*) AS n FROM (SELECT area_id, CAST((row_number() OVER (PARTITION BY area_id ORDER BY source_id) - 1) // 50 AS BIGINT) AS batch FROM poi_v) t GROUP BY area_id, batch", ["poi"])
def geojson_batches(v: Views):
    p = v.poi.withColumn("p", geo.point("lon", "lat")).withColumn("category", F.col("kind"))
    f = geojson.to_features(p, "pois", "Point", "p", "source_id")
    c = geojson.collections(scan.batches(f, ["area_id"], ["id"], 50))
    # Every feature is read back from the collection text.
    back = F.size(F.from_json("collection", "features array<struct<id:string>>")["features"])
    return c.select("area_id", "batch", back.cast("bigint").alias("n"))


@query(
    "boundary_texts",
    "SELECT k, CASE k % 6 WHEN 0 THEN 'invalid_geojson' WHEN 1 THEN 'holes_not_supported' WHEN 2 THEN 'invalid_geojson' WHEN 3 THEN 'invalid_coordinate' WHEN 4 THEN 'invalid_geojson' END AS error FROM node_v",
    ["node"],
)
def boundary_texts(v: Views):
    xy = lambda a, b: F.concat(F.lit("["), F.col("lon") + a, F.lit(","), F.col("lat") + b, F.lit("]"))
    ring = F.concat(F.lit("["), F.concat_ws(",", xy(0, 0), xy(0.1, 0), xy(0.1, 0.1), xy(0, 0)), F.lit("]"))
    k = F.col("k") % 6
    coords = (
        F.when(k == 1, F.concat(ring, F.lit(","), ring)).when(k == 2, F.lit("[[1,2,3],[4,5,6]]")).when(k == 3, F.lit("[[0,95],[1,95],[1,96],[0,95]]")).when(k == 4, F.lit("")).otherwise(ring)
    )
    kind = F.when(k == 0, "Point").otherwise("Polygon")
    text = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":['), coords, F.lit("]}"))
    return geojson.read_boundaries(v.node.select("k", text.alias("geojson"))).select("k", "error")


@query(
    "newest_feedback",
    "SELECT block_id, arg_max(building_count, updated_at) AS building_count FROM (SELECT concat('P', user_id % 200) AS block_id, CAST(event_id % 40 AS INT) AS building_count, event_id AS updated_at FROM events) e GROUP BY block_id",
)
def newest_feedback(v: Views):
    e = v.table("events").select(
        F.concat(F.lit("P"), F.col("user_id").cast("bigint") % 200).alias("block_id"), (F.col("event_id") % 40).cast("int").alias("building_count"), F.lit(False).alias("no_buildings"),
        F.col("event_id").cast("bigint").alias("updated_at"),
    )
    return imports.newest_feedback(e).select("block_id", "building_count")


# A staircase stays within the tolerance; every second node's line has a spike of 50 that must stay with its two neighbours.
@query("simplified_lines", "SELECT node_id, CASE WHEN k % 2 = 1 THEN 5 ELSE 2 END AS kept FROM node_v", ["node"])
def simplified_lines(v: Views):
    step = lambda i: geo.point(i * 10.0, F.when(i == 20, (F.col("k") % 2) * 50.0).otherwise((i % 2) * 0.5))
    lines = v.node.select("node_id", "k", F.transform(F.sequence(F.lit(0), F.lit(40)), step).alias("line"))
    return mapdata.simplify(lines, 1.5).select("node_id", F.size("line").alias("kept"))




@query(
    "boundary_violations",
    "SELECT boundary_id, 'outside_area' AS violation FROM boundary_v WHERE name = 'out' UNION ALL SELECT boundary_id, 'duplicate_name' FROM boundary_v WHERE name IN ('ell', 'few', 'tie')",
    ["boundary"],
)
def boundary_violations(v: Views):
    from terrafold.functions import rules

    b = v.boundary.withColumn("name", F.when(F.col("name").isin("few", "tie"), F.lit(" ell ")).otherwise(F.col("name")))
    return rules.check_boundaries(b, v.area)


@query(
    "boundaries_in_boxes",
    "SELECT boundary_id, round(0.5 * 47 * 9 - 0.5 * 23 * (12 - 9 * 15 / 38.0::DOUBLE - 3), 4) AS area, 0 AS dropped_parts, FALSE AS filled_holes FROM boundary_v WHERE name = 'out'",
    ["boundary"],
)
def boundaries_in_boxes(v: Views):
    b = mapdata.boundary_in_box(v.boundary.filter("name = 'out'"), v.area)
    return b.select("boundary_id", F.round(F.abs(geo.signed_area("ring")) * 1e6, 4).alias("area"), F.col("dropped_parts").cast("int").alias("dropped_parts"), "filled_holes")


@query(
    "lines_cut_by_boundaries",
    f"""SELECT boundary_id, source_id, {o.rn('len * 100000', 3)} AS length FROM (SELECT boundary_id, source_id, CASE WHEN lat > ring[1].y AND lat < ring[3].y THEN greatest(0, least(e, ring[2].x) - greatest(w, ring[1].x))
          WHEN lat >= ring[3].y AND lat < ring[6].y THEN greatest(0, least(e, ring[4].x) - greatest(w, ring[1].x)) ELSE 0 END AS len
        FROM (SELECT *, lon - CAST(0.003 AS DOUBLE) AS w, lon + CAST(0.003 AS DOUBLE) AS e FROM (SELECT * FROM {ELL}) b JOIN poi_v p USING (area_id)) q) t WHERE len > 0""",
    ["boundary", "poi"],
)
def lines_cut_by_boundaries(v: Views):
    line = F.array(geo.point(F.col("lon") - 0.003, "lat"), geo.point(F.col("lon") + 0.003, "lat"))
    c = clip.clip_lines(v.poi.select("area_id", "source_id", line.alias("line")), clip.scopes_of(v.area, v.boundary.filter("name = 'ell'")), "source_id")
    length = F.aggregate("parts", F.lit(0.0), lambda acc, part: acc + geo.planar_length(part))
    return c.select(F.col("scope_id").alias("boundary_id"), "source_id", F.round(length * 100000, 3).alias("length"))


@query(
    "clipped_heights",
    """SELECT segment_id, 0 AS part, 2 AS n FROM (SELECT concat(area_id, '_', row, '_', col) AS segment_id FROM cell_v WHERE row < 49 AND col < 49
       AND area_id IN (SELECT area_id FROM cell_v GROUP BY area_id HAVING count(*) = 2500)) t""",
    ["cell"],
)
def clipped_heights(v: Views):
    from terrafold.operators import raster

    cells = raster.whole_grids(v.cell)
    c = cells.filter("row < 49 AND col < 49")
    x, y = F.col("origin_lon") + F.col("col") * F.col("lon_step"), F.col("origin_lat") + F.col("row") * F.col("lat_step")
    # Streets that run far beyond the north edge are cut at the grid's box.
    lines = c.select("area_id", F.concat_ws("_", "area_id", "row", "col").alias("segment_id"), F.array(geo.point(x, y), geo.point(x, y + 0.02)).alias("line"))
    h = raster.headers_of(cells)
    boxes = h.select("area_id", F.col("origin_lat").alias("min_lat"), F.col("origin_lon").alias("min_lon"), (F.col("origin_lat") + 49 * F.col("lat_step")).alias("max_lat"), (F.col("origin_lon") + 49 * F.col("lon_step")).alias("max_lon"))
    parts = mapdata.clip_lines_to_box(lines, boxes, "segment_id")
    clean = raster.despike(cells)
    return mapdata.resample_clipped(parts, clean, raster.smooth(clean)).select("segment_id", "part", F.size("exact").alias("n"))


@query(
    "map_data_layers",
    f"""WITH {OWNERS}, {OWNED}, comp AS (SELECT outer_id, source_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY outer_id, source_id ORDER BY rank) AS rn FROM owned JOIN own ON owner_id = area_id) t WHERE rn = 1),
        ell AS (SELECT area_id, ring FROM {ELL}), inp AS (SELECT p.* FROM poi_v p JOIN ell USING (area_id) WHERE {o.in_ring('p.lon', 'p.lat', 'ring')})
        SELECT 'pois' AS layer, c.outer_id AS area_id, count(*) AS n FROM comp c JOIN ell ON ell.area_id = c.outer_id WHERE {o.in_ring('c.lon', 'c.lat', 'ring')} GROUP BY c.outer_id
        UNION ALL SELECT 'nodes', area_id, count(*) FROM inp GROUP BY area_id""",
    ["area", "poi", "boundary"],
)
def map_data_layers(v: Views):
    nodes = v.poi.select("area_id", F.col("source_id").alias("node_id"), "lat", "lon")
    # No street meets a boundary here, so the nodes are those inside.
    segments = v.poi.select("area_id", F.col("source_id").alias("from_node"), F.col("source_id").alias("to_node"), F.array(geo.point(F.col("lon") + 5, "lat"), geo.point(F.col("lon") + 5.001, "lat")).alias("line"))
    m = mapdata.map_data({"pois": owned_pois(v)}, {"segments": segments, "nodes": nodes}, v.area, v.boundary.filter("name = 'ell'"))
    n = lambda df, layer, key: df.groupBy(F.lit(layer).alias("layer"), F.col(key).alias("area_id")).agg(F.count("*").alias("n"))
    return n(m["pois"], "pois", "outer_id").unionByName(n(m["nodes"], "nodes", "area_id"))
