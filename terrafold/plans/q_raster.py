"""Height-grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import raster
from terrafold.plans import oracle as o
from terrafold.plans.registry import query
from terrafold.plans.views import Views

CELL = ["cell"]


def size_sql(extent: str) -> str:
    return f"CAST(least(greatest(round_even({extent} / 5.0::DOUBLE, 0) + 1, 2), 256) AS INT)"


@query(
    "grid_sizes",
    f"""SELECT area_id, {size_sql(f'(max_lat - min_lat) * {o.MPD}')} AS rows, {size_sql(f'(max_lon - min_lon) * {o.MPD} * cos(radians((min_lat + max_lat) / 2))')} AS cols FROM area_v
        UNION ALL SELECT area_id, {size_sql(f'(max_lat - min_lat) * {o.MPD}')}, {size_sql(f'(max_lon - min_lon) * {o.MPD} * cos(radians((min_lat + max_lat) / 2))')} FROM town_v""",
    ["area", "town"],
)
def grid_sizes(v: Views):
    boxes = v.area.select("area_id", "min_lat", "min_lon", "max_lat", "max_lon").unionByName(v.town.drop("town"))
    return raster.grid_headers(boxes).select("area_id", "rows", "cols")


@query(
    "grid_points",
    """SELECT area_id, count(*) AS n, round(sum(lat), 4) + 0.0 AS sum_lat, round(sum(lon), 4) + 0.0 AS sum_lon FROM
       (SELECT area_id, origin_lat + r.r * lat_step AS lat, origin_lon + c.c * lon_step AS lon FROM (SELECT DISTINCT area_id, origin_lat, origin_lon, lat_step, lon_step FROM cell_v) h, range(0, 50) r(r), range(0, 50) c(c)) t GROUP BY area_id""",
    CELL,
)
def grid_points(v: Views):
    p = raster.grid_points(raster.headers_of(v.cell))
    return p.groupBy("area_id").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 4).alias("sum_lat"), F.round(F.sum("lon"), 4).alias("sum_lon"))


@query("terrarium_heights", "SELECT k, round((k % 131) * 256 + k % 256 + (k * 7 % 256) / 256 - 32768, 6) + 0.0 AS height FROM ping_v", ["ping"])
def terrarium_heights(v: Views):
    k = F.col("k")
    return v.ping.select("k", F.round(raster.terrarium_height(k % 131, k % 256, (k * 7) % 256), 6).alias("height"))


@query(
    "grid_vectors",
    "SELECT area_id, row, col, CAST(height AS FLOAT)::DOUBLE AS height FROM cell_v WHERE area_id IN (SELECT area_id FROM cell_v GROUP BY area_id HAVING count(*) = 2500)",
    CELL,
)
def grid_vectors(v: Views):
    grids = raster.cells_to_grid(v.cell.drop("k"))
    whole = grids.filter(raster.grid_ok())
    return raster.grid_to_cells(whole).select("area_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.col("height").cast("double").alias("height"))


NEAR = "neigh AS (SELECT a.area_id, a.row, a.col, a.height, b.height AS h FROM cell_v a JOIN cell_v b ON a.area_id = b.area_id AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (a.row <> b.row OR a.col <> b.col))"
CLEAN = NEAR + """,
  med AS (SELECT area_id, row, col, median(h) AS m FROM neigh GROUP BY area_id, row, col),
  fair AS (SELECT n.area_id, n.row, n.col, min(h) AS lo, max(h) AS hi FROM neigh n JOIN med USING (area_id, row, col) WHERE abs(h - m) <= 15 GROUP BY n.area_id, n.row, n.col),
  clean AS (SELECT c.area_id, c.row, c.col, c.rows, c.cols, c.origin_lat, c.origin_lon, c.lat_step, c.lon_step,
            CASE WHEN abs(height - m) > 15 AND (height < lo OR height > hi) THEN m ELSE height END AS height FROM cell_v c LEFT JOIN med USING (area_id, row, col) LEFT JOIN fair USING (area_id, row, col))"""


@query("despiked_cells", f"WITH {CLEAN} SELECT area_id, row, col, {o.r6('height')} AS height FROM clean", CELL)
def despiked_cells(v: Views):
    return raster.despike(v.cell).select("area_id", "row", "col", F.round("height", 6).alias("height"))


# 0.0002 degrees are 22.24 m north and about 21.9 m east, so 60 m are 3 samples on both axes.
SMOOTH = CLEAN + """,
  ext AS (SELECT area_id, max(row) AS mr, max(col) AS mc FROM cell_v GROUP BY area_id),
  across AS (SELECT c.area_id, c.row, c.col, (SELECT sum(x.height) FROM range(-3, 4) d(d) JOIN clean x ON x.area_id = c.area_id AND x.row = c.row AND x.col = least(greatest(c.col + d.d, 0), mc)) / 7 AS height FROM clean c JOIN ext USING (area_id)),
  smooth AS (SELECT c.area_id, c.row, c.col, (SELECT sum(x.height) FROM range(-3, 4) d(d) JOIN across x ON x.area_id = c.area_id AND x.col = c.col AND x.row = least(greatest(c.row + d.d, 0), mr)) / 7 AS height FROM clean c JOIN ext USING (area_id))"""


@query("smoothed_cells", f"WITH {SMOOTH} SELECT area_id, row, col, {o.r6('height')} AS height FROM smooth", CELL)
def smoothed_cells(v: Views):
    s = raster.smooth(raster.despike(v.cell), 60.0)
    return s.select("area_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.round("height", 6).alias("height"))


PROBES = "SELECT k, area_id, origin_lat + lat_step * ((k * 37) % 600 / 10.0 - 5) AS lat, origin_lon + lon_step * ((k * 53) % 570 / 10.0 - 3) AS lon FROM (SELECT CAST(row * 50 + col AS BIGINT) AS k, area_id, origin_lat, origin_lon, lat_step, lon_step FROM {cell}) c"
SAMPLE = """smp AS (SELECT k, area_id, r, c, CAST(least(floor(r), 48) AS BIGINT) AS r0, CAST(least(floor(c), 48) AS BIGINT) AS c0 FROM
  (SELECT k, p.area_id, least(greatest((lat - h.origin_lat) / h.lat_step, 0), 49) AS r, least(greatest((lon - h.origin_lon) / h.lon_step, 0), 49) AS c
   FROM ({probes}) p JOIN (SELECT DISTINCT area_id, origin_lat, origin_lon, lat_step, lon_step FROM cell_v) h USING (area_id)) q),
 val AS (SELECT k, s.area_id, (a.height * (1 - (c - c0)) + b.height * (c - c0)) * (1 - (r - r0)) + (d.height * (1 - (c - c0)) + e.height * (c - c0)) * (r - r0) AS height FROM smp s
   JOIN {cells} a ON a.area_id = s.area_id AND a.row = r0 AND a.col = c0 JOIN {cells} b ON b.area_id = s.area_id AND b.row = r0 AND b.col = c0 + 1
   JOIN {cells} d ON d.area_id = s.area_id AND d.row = r0 + 1 AND d.col = c0 JOIN {cells} e ON e.area_id = s.area_id AND e.row = r0 + 1 AND e.col = c0 + 1)"""


@query("sampled_heights", f"WITH {SAMPLE.format(probes=PROBES.format(cell='cell_v'), cells='cell_v')} SELECT area_id, k, {o.r6('height')} AS height FROM val", CELL)
def sampled_heights(v: Views):
    probes = v.spark.sql(PROBES, cell=v.cell)
    s = raster.sample_grid(probes, raster.headers_of(v.cell), raster.quads(v.cell))
    return s.select("area_id", "k", F.round("height", 6).alias("height"))


@query(
    "points_on_grids",
    f"SELECT p.area_id, k, lat BETWEEN origin_lat AND origin_lat + 49 * lat_step AND lon BETWEEN origin_lon AND origin_lon + 49 * lon_step AS inside FROM ({PROBES.format(cell='cell_v')}) p JOIN (SELECT DISTINCT area_id, origin_lat, origin_lon, lat_step, lon_step FROM cell_v) h USING (area_id)",
    CELL,
)
def points_on_grids(v: Views):
    p = v.spark.sql(PROBES, cell=v.cell).join(raster.headers_of(v.cell), "area_id")
    return p.select("area_id", "k", raster.grid_contains("lat", "lon").alias("inside"))


# A tower on every sample that is far enough from the edges: a square of one to three samples' half width around a point near it.
TOWERS = "SELECT concat('b', area_id, '_', row, '_', col) AS source_id, area_id, origin_lat + lat_step * (row + 0.3) AS y, origin_lon + lon_step * (col + 0.4) AS x, lat_step * (1 + (row * 3 + col) % 3) AS hy, lon_step * (1 + col % 2) AS hx FROM {cell} WHERE row BETWEEN 4 AND 44 AND col BETWEEN 4 AND 44"


def towers(v: Views):
    t = v.spark.sql(TOWERS, cell=v.cell)
    c = lambda n: F.col(n).cast("double")
    return t.select("source_id", "area_id", geo.bbox_ring(c("y") - c("hy"), c("x") - c("hx"), c("y") + c("hy"), c("x") + c("hx")).alias("ring"))


CORNERS = f"SELECT source_id AS k, area_id, y + sy * hy AS lat, x + sx * hx AS lon FROM ({TOWERS.format(cell='cell_v')}) t, (VALUES (-1, -1), (-1, 1), (1, 1), (1, -1)) s(sx, sy)"


@query(
    "building_bases",
    f"""WITH {CLEAN}, {SAMPLE.format(probes=CORNERS, cells='clean')} SELECT source_id, {o.r6('min(height)')} AS base_m FROM (
        SELECT k AS source_id, height FROM val UNION ALL SELECT source_id, c.height FROM ({TOWERS.format(cell='cell_v')}) t JOIN clean c ON c.area_id = t.area_id
          AND abs(c.origin_lat + c.row * c.lat_step - y) < hy AND abs(c.origin_lon + c.col * c.lon_step - x) < hx) u GROUP BY source_id""",
    CELL,
)
def building_bases(v: Views):
    return raster.building_base(towers(v), raster.despike(v.cell)).select("source_id", F.round("base_m", 6).alias("base_m"))


def tracks(v: Views):
    t = v.spark.sql(TOWERS, cell=v.cell)
    c = lambda n: F.col(n).cast("double")
    line = F.array(geo.point(c("x") - c("hx"), c("y") - c("hy")), geo.point(c("x"), c("y")), geo.point(c("x") + c("hx"), c("y") + c("hy")))
    return t.select(F.col("source_id").alias("segment_id"), "area_id", line.alias("line"))


TRACK = f"SELECT concat(source_id, '|', s) AS k, area_id, y + s * hy AS lat, x + s * hx AS lon FROM ({TOWERS.format(cell='cell_v')}) t, (VALUES (-1), (0), (1)) v(s)"


@query(
    "segment_heights",
    f"""WITH {SMOOTH}, {SAMPLE.format(probes=TRACK, cells='clean')}, {SAMPLE.format(probes=TRACK, cells='smooth').replace('smp', 'smp2').replace('val AS', 'val2 AS')}
        SELECT split_part(val.k, '|', 1) AS segment_id, CAST(split_part(val.k, '|', 2) AS INT) + 1 AS pos, {o.r6('val.height')} AS exact, {o.r6('val2.height')} AS smoothed FROM val JOIN val2 USING (k)""",
    CELL,
)
def segment_heights(v: Views):
    clean = raster.despike(v.cell)
    h = raster.line_heights(tracks(v), clean, raster.smooth(clean, 60.0))
    e = h.select("segment_id", F.posexplode(F.arrays_zip("exact", "smoothed")).alias("pos", "z"))
    return e.select("segment_id", "pos", F.round("z.exact", 6).alias("exact"), F.round("z.smoothed", 6).alias("smoothed"))


@query(
    "elevation_backfill",
    f"""WITH {CLEAN} SELECT area_id, (SELECT count(*) FROM ({TOWERS.format(cell='cell_v')}) t WHERE t.area_id = c.area_id) AS buildings, (SELECT count(*) FROM ({TOWERS.format(cell='cell_v')}) t WHERE t.area_id = c.area_id) AS segments
        FROM (SELECT DISTINCT area_id FROM clean) c""",
    CELL,
)
def elevation_backfill(v: Views):
    bases, heights = raster.analyse_elevation(v.cell, towers(v), tracks(v))
    ids = raster.headers_of(v.cell).select("area_id")
    n = lambda df, name: df.groupBy("area_id").agg(F.count("*").alias(name))
    return ids.join(n(bases, "buildings"), "area_id", "left").join(n(heights, "segments"), "area_id", "left")


@query(
    "grid_versions",
    "SELECT area_id, CAST(CASE WHEN g % 3 = 0 THEN 1 WHEN g % 3 = 1 THEN 4 ELSE 5 END AS INT) AS version FROM (SELECT DISTINCT area_id, CAST(substr(area_id, 2) AS INT) AS g FROM cell_v) t",
    CELL,
)
def grid_versions(v: Views):
    g = F.substring("area_id", 2, 9).cast("int")
    old = v.cell.filter(g % 3 != 0)
    new = v.cell.withColumn("height", F.when((g % 3 == 2) & (F.col("row") == 7) & (F.col("col") == 7), F.col("height") + 1).otherwise(F.col("height")))
    return raster.grid_version(old, raster.headers_of(old).select("area_id", F.lit(4).alias("version")), new)


MIDLAT = "round(a.origin_lat + 49 * a.lat_step / 2, 9)"


@query(
    "cell_slopes",
    f"""SELECT a.area_id, a.row, a.col, {o.r6(f"sqrt(power(((b.height - a.height) + (d.height - c.height)) / 2 / (a.lon_step * {o.MPD} * cos(radians({MIDLAT}))), 2) + power(((c.height - a.height) + (d.height - b.height)) / 2 / (a.lat_step * {o.MPD}), 2))")} AS slope
        FROM cell_v a JOIN cell_v b ON b.area_id = a.area_id AND b.row = a.row AND b.col = a.col + 1 JOIN cell_v c ON c.area_id = a.area_id AND c.row = a.row + 1 AND c.col = a.col
        JOIN cell_v d ON d.area_id = a.area_id AND d.row = a.row + 1 AND d.col = a.col + 1""",
    CELL,
)
def cell_slopes(v: Views):
    s = raster.cell_slope(v.cell)
    return s.select("area_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), F.round("slope", 6).alias("slope"))


# Pixels under small boxes of the towns, with a height by formula and every 50th pixel missing.
PIX = "CAST((px * 7 + py * 13) % 101 AS DOUBLE)"


def small_points(v: Views):
    return v.node.select("node_id", "lat", "lon")


@query(
    "resampled_heights",
    f"""WITH p AS (SELECT node_id, ({8388608} * (lon + 180.0::DOUBLE) / 360.0::DOUBLE) - 0.5 AS x, (0.5 - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * pi())) * 8388608 - 0.5 AS y FROM node_v),
        c AS (SELECT node_id, CAST(floor(x) AS BIGINT) + dx AS px, CAST(floor(y) AS BIGINT) + dy AS py, (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w
              FROM p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dx, dy))
        SELECT node_id, round(sum(w * CASE WHEN (px + py) % 50 = 0 THEN 0 ELSE {PIX} END), 4) + 0.0 AS height FROM c GROUP BY node_id""",
    ["node"],
)
def resampled_heights(v: Views):
    pts = small_points(v)
    p = geo.mercator_pixel("lat", "lon")
    around = pts.select(F.floor(p["x"]).alias("x"), F.floor(p["y"]).alias("y"))
    around = around.select(F.explode(F.sequence(F.col("x") - 2, F.col("x") + 2)).alias("px"), "y").select("px", F.explode(F.sequence(F.col("y") - 2, F.col("y") + 2)).alias("py")).distinct()
    pixels = around.filter("(px + py) % 50 <> 0").select("px", "py", F.expr(PIX).alias("height"))
    return raster.resample(pts, pixels).select("node_id", F.round("height", 4).alias("height"))
