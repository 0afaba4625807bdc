"""Height grids as long tables of cells (``area_id, row, col, height`` plus the grid's header columns).

A grid is at most 256 x 256 samples, so a window over one grid row or column, or an array of one row, is bounded
by 256 however many areas there are; nothing ever groups a whole area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geo

# Fixed values.
SPIKE_THRESHOLD_M = 15.0
SMOOTHING_M = 30.0
SPACING_M = 5.0
MIN_SAMPLES, MAX_SAMPLES = 2, 256
STEEP_SLOPE = 0.30

HEADER = ["rows", "cols", "origin_lat", "origin_lon", "lat_step", "lon_step"]


def terrarium_height(r, g, b) -> Column:
    return geo.col(r) * 256 + geo.col(g) + geo.col(b) / 256 - 32768


def grid_size(min_lat, min_lon, max_lat, max_lon) -> Column:
    """``struct<rows, cols>``: about 5 m between samples, 2 to 256 per axis, halves rounded to even."""
    s, w, n, e = (geo.col(c) for c in (min_lat, min_lon, max_lat, max_lon))
    mid = geo.centroid(geo.bbox_ring(s, w, n, e))["y"]

    def samples(extent):
        return F.least(F.greatest(F.bround(extent / SPACING_M, 0) + 1, F.lit(MIN_SAMPLES)), F.lit(MAX_SAMPLES)).cast("int")

    return F.struct(samples((n - s) * geo.METERS_PER_DEGREE).alias("rows"), samples((e - w) * geo.meters_per_degree_lon(mid)).alias("cols"))


def grid_headers(areas: DataFrame) -> DataFrame:
    """``area_id`` and the header columns of every area's grid."""
    a = areas.withColumn("_g", grid_size("min_lat", "min_lon", "max_lat", "max_lon"))
    return a.select(
        "area_id", F.col("_g.rows").alias("rows"), F.col("_g.cols").alias("cols"), F.col("min_lat").alias("origin_lat"), F.col("min_lon").alias("origin_lon"),
        ((F.col("max_lat") - F.col("min_lat")) / (F.col("_g.rows") - 1)).alias("lat_step"), ((F.col("max_lon") - F.col("min_lon")) / (F.col("_g.cols") - 1)).alias("lon_step"),
    )


def grid_points(headers: DataFrame) -> DataFrame:
    """Every sample point: ``row, col, lat, lon`` with the header."""
    p = headers.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    return p.select("*", (F.col("origin_lat") + F.col("row") * F.col("lat_step")).alias("lat"), (F.col("origin_lon") + F.col("col") * F.col("lon_step")).alias("lon"))


def grid_ok() -> Column:
    """Header and size rules of a grid given as a vector ``heights``."""
    return F.expr("rows >= 2 AND cols >= 2 AND lat_step > 0 AND lon_step > 0 AND size(heights) = rows * cols")


def grid_contains(lat, lon) -> Column:
    north = F.col("origin_lat") + (F.col("rows") - 1) * F.col("lat_step")
    east = F.col("origin_lon") + (F.col("cols") - 1) * F.col("lon_step")
    return geo.col(lat).between(F.col("origin_lat"), north) & geo.col(lon).between(F.col("origin_lon"), east)


def grid_to_cells(grids: DataFrame) -> DataFrame:
    """Row-major vectors (``heights``) to cells, heights as float32."""
    g = grids.select(*[c for c in grids.columns if c != "heights"], F.posexplode("heights").alias("_i", "height"))
    return g.withColumn("row", F.floor(F.col("_i") / F.col("cols")).cast("int")).withColumn("col", (F.col("_i") % F.col("cols")).cast("int")).withColumn("height", F.col("height").cast("float")).drop("_i")


def cells_to_grid(cells: DataFrame) -> DataFrame:
    """Cells to row-major vectors; at most 65,536 heights per area by the size rule."""
    return cells.groupBy("area_id", *HEADER).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "col", F.col("height").cast("float").alias("height")))), lambda e: e["height"]).alias("heights"))


def resample(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """Bilinear heights of points from a pixel table (``px, py, height``; a pixel holds the height at its centre). Pixels that are
    missing count as 0 m."""
    p = geo.mercator_pixel("lat", "lon")
    at = points.withColumn("_x", p["x"] - 0.5).withColumn("_y", p["y"] - 0.5)
    x0, y0 = F.floor("_x"), F.floor("_y")
    fx, fy = F.col("_x") - x0, F.col("_y") - y0
    last = geo.WORLD_PIXELS - 1
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(last))
    corner = lambda dx, dy, w: F.struct(clamp(x0 + dx).cast("bigint").alias("px"), clamp(y0 + dy).cast("bigint").alias("py"), w.alias("w"))
    four = F.array(corner(0, 0, (1 - fx) * (1 - fy)), corner(1, 0, fx * (1 - fy)), corner(0, 1, (1 - fx) * fy), corner(1, 1, fx * fy))
    flat = at.select(*points.columns, F.explode(four).alias("c")).select(*points.columns, "c.px", "c.py", "c.w")
    # Pixels are as many as points or more, which Spark's size estimate of exploded rows doesn't see: never sent whole to every task.
    found = pixels.select(F.col("px").cast("bigint").alias("px"), F.col("py").cast("bigint").alias("py"), "height").hint("merge")
    j = flat.join(found, ["px", "py"], "left")
    # Each point has four corners; equal points are counted and come out as often as they went in.
    g = j.groupBy(*points.columns).agg(F.sum(F.col("w") * F.coalesce("height", F.lit(0.0))).alias("_sum"), (F.count(F.lit(1)) / 4).cast("int").alias("_same"))
    return g.withColumn("height", F.col("_sum") / F.col("_same")).withColumn("_k", F.explode(F.sequence(F.lit(1), "_same"))).drop("_sum", "_same", "_k")


def _along_row():
    return W.partitionBy("area_id", "row").orderBy("col")


def _along_column():
    return W.partitionBy("area_id", "col").orderBy("row")


def despike(cells: DataFrame, threshold: float = SPIKE_THRESHOLD_M) -> DataFrame:
    """Replaces void pixels by the median of their neighbours: farther than the threshold from that median and outside the range of
    the neighbours that are themselves within it. One pass over the original values."""
    row = _along_row()
    trio = F.struct(F.lag("height").over(row).alias("l"), F.col("height").alias("c"), F.lead("height").over(row).alias("r"))
    t = cells.withColumn("_t", trio)
    colw = _along_column()
    t = t.withColumn("_u", F.lag("_t").over(colw)).withColumn("_d", F.lead("_t").over(colw))
    near = F.array_sort(F.array_compact(F.array(*(F.col(x) for x in ("_t.l", "_t.r", "_u.l", "_u.c", "_u.r", "_d.l", "_d.c", "_d.r")))))
    t = t.withColumn("_n", near)
    n, half = F.size("_n"), F.floor(F.size("_n") / 2).cast("int")
    median = F.when(n % 2 == 1, F.try_element_at("_n", half + 1)).otherwise((F.try_element_at("_n", half) + F.try_element_at("_n", half + 1)) / 2)
    t = t.withColumn("_m", median)
    fair = F.filter("_n", lambda x: F.abs(x - F.col("_m")) <= threshold)
    far = F.abs(F.col("height") - F.col("_m")) > threshold
    spike = far & ((F.col("height") < F.array_min(fair)) | (F.col("height") > F.array_max(fair)))
    return t.withColumn("height", F.when(F.coalesce(spike, F.lit(False)), F.col("_m")).otherwise(F.col("height"))).drop("_t", "_u", "_d", "_n", "_m")


def _radii(radius_m: float) -> tuple[Column, Column]:
    middle = F.round(F.col("origin_lat") + (F.col("rows") - 1) * F.col("lat_step") / 2, geo.ORIGIN_DECIMALS)
    row = F.bround(F.lit(radius_m) / (F.col("lat_step") * geo.METERS_PER_DEGREE), 0)
    column = F.bround(F.lit(radius_m) / (F.col("lon_step") * geo.meters_per_degree_lon(middle)), 0)
    return row.cast("int"), column.cast("int")


def _blur(cells: DataFrame, line: str, along: str, radius: Column) -> DataFrame:
    """Moving average along one axis with clamped ends, over arrays of at most 256 heights."""
    arr = cells.groupBy("area_id", line, *HEADER).agg(F.transform(F.array_sort(F.collect_list(F.struct(along, "height"))), lambda e: e["height"]).alias("h"))
    arr = arr.withColumn("_r", radius)
    n = F.size("h")

    def mean(i):
        low, high = i - F.col("_r"), i + F.col("_r")
        lo, hi = F.greatest(low, F.lit(0)), F.least(high, n - 1)
        inner = F.aggregate(F.slice("h", lo + 1, hi - lo + 1), F.lit(0.0), lambda acc, x: acc + x)
        return (inner + (lo - low) * F.element_at("h", 1) + (high - hi) * F.element_at("h", -1)) / (F.col("_r") * 2 + 1)

    out = F.when(F.col("_r") <= 0, F.col("h")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), mean))
    return arr.select("area_id", line, *HEADER, F.posexplode(out).alias(along, "height"))


def smooth(cells: DataFrame, radius_m: float = SMOOTHING_M) -> DataFrame:
    """Separable box blur; the radius in samples is worked out per area and axis."""
    row_radius, col_radius = _radii(radius_m)
    c = cells.select("area_id", "row", "col", *HEADER, F.col("height").cast("double").alias("height"))
    across = _blur(c, "row", "col", col_radius)
    return _blur(across, "col", "row", row_radius).select("area_id", "row", "col", *HEADER, "height")


def quads(cells: DataFrame, heights: tuple[str, ...] = ("height",)) -> DataFrame:
    """One row per grid square with the heights of its corners: ``<name>_sw, _se, _nw, _ne``."""
    row = cells.withColumn("_e", F.lead(F.struct(*heights)).over(_along_row()))
    both = row.withColumn("_n", F.lead(F.struct(*heights, "_e")).over(_along_column()))
    whole = both.filter(F.col("_e").isNotNull() & F.col("_n").isNotNull() & F.col("_n._e").isNotNull())
    cols = [c for h in heights for c in (F.col(h).alias(f"{h}_sw"), F.col(f"_e.{h}").alias(f"{h}_se"), F.col(f"_n.{h}").alias(f"{h}_nw"), F.col(f"_n._e.{h}").alias(f"{h}_ne"))]
    return whole.select("area_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *HEADER, *cols)


def sample_grid(points: DataFrame, headers: DataFrame, squares: DataFrame, heights: tuple[str, ...] = ("height",)) -> DataFrame:
    """Bilinear heights at ``lat, lon``; a point outside takes the nearest edge. Areas without a grid give no row."""
    p = points.join(headers.select("area_id", *HEADER), "area_id")
    r = F.least(F.greatest((F.col("lat") - F.col("origin_lat")) / F.col("lat_step"), F.lit(0.0)), F.col("rows") - 1.0)
    c = F.least(F.greatest((F.col("lon") - F.col("origin_lon")) / F.col("lon_step"), F.lit(0.0)), F.col("cols") - 1.0)
    p = p.withColumn("_r", r).withColumn("_c", c)
    p = p.withColumn("row", F.least(F.floor("_r"), F.col("rows") - 2).cast("int")).withColumn("col", F.least(F.floor("_c"), F.col("cols") - 2).cast("int"))
    cols = [f"{h}_{k}" for h in heights for k in ("sw", "se", "nw", "ne")]
    j = p.drop(*HEADER).join(squares.select("area_id", "row", "col", *cols), ["area_id", "row", "col"])
    fr, fc = F.col("_r") - F.col("row"), F.col("_c") - F.col("col")

    def value(h):
        k = lambda s: F.col(f"{h}_{s}")
        return ((k("sw") * (1 - fc) + k("se") * fc) * (1 - fr) + (k("nw") * (1 - fc) + k("ne") * fc) * fr).alias(h)

    return j.select(*points.columns, *(value(h) for h in heights))


def headers_of(cells: DataFrame) -> DataFrame:
    return cells.filter("row = 0 AND col = 0").select("area_id", *HEADER)


def building_base(buildings: DataFrame, cells: DataFrame) -> DataFrame:
    """Lowest ground under each footprint: grid samples at its vertices and at the grid points inside it."""
    headers, squares = headers_of(cells), quads(cells)
    corners = buildings.select("area_id", "source_id", F.explode("ring").alias("p")).select("area_id", "source_id", F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))
    at_vertices = sample_grid(corners, headers, squares).select("area_id", "source_id", "height")
    e = buildings.select("area_id", "source_id", "ring", geo.envelope("ring").alias("e")).join(headers, "area_id")
    span = lambda lo, hi, origin, step, n: (
        F.greatest(F.ceil((F.col(lo) - F.col(origin)) / F.col(step)), F.lit(0)), F.least(F.floor((F.col(hi) - F.col(origin)) / F.col(step)), F.col(n) - 1)
    )
    r0, r1 = span("e.min_lat", "e.max_lat", "origin_lat", "lat_step", "rows")
    c0, c1 = span("e.min_lon", "e.max_lon", "origin_lon", "lon_step", "cols")
    e = e.withColumn("_r0", r0).withColumn("_r1", r1).withColumn("_c0", c0).withColumn("_c1", c1).filter("_r0 <= _r1 AND _c0 <= _c1")
    grid = e.withColumn("row", F.explode(F.sequence("_r0", "_r1"))).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    lat, lon = F.col("origin_lat") + F.col("row") * F.col("lat_step"), F.col("origin_lon") + F.col("col") * F.col("lon_step")
    inside = grid.filter(geo.point_in_ring(lon, lat, "ring")).select("area_id", "source_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    flat = cells.select("area_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("height").cast("double").alias("height"))
    at_points = inside.join(flat, ["area_id", "row", "col"]).select("area_id", "source_id", "height")
    return at_vertices.unionByName(at_points).groupBy("area_id", "source_id").agg(F.min("height").alias("base_m"))


def line_heights(lines: DataFrame, cells: DataFrame, smoothed: DataFrame, key: str = "segment_id") -> DataFrame:
    """Exact and smoothed heights per vertex, in order, from one pass over a grid that carries both."""
    both = cells.select("area_id", "row", "col", *HEADER, F.col("height").alias("exact")).join(
        smoothed.select("area_id", "row", "col", F.col("height").alias("smooth")), ["area_id", "row", "col"]
    )
    v = lines.select("area_id", key, F.posexplode("line").alias("_pos", "p")).select("area_id", key, "_pos", F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))
    s = sample_grid(v, headers_of(cells), quads(both, ("exact", "smooth")), ("exact", "smooth"))
    g = s.groupBy("area_id", key).agg(F.array_sort(F.collect_list(F.struct("_pos", "exact", "smooth"))).alias("_h"))
    return g.select("area_id", key, F.transform("_h", lambda e: e["exact"]).alias("exact"), F.transform("_h", lambda e: e["smooth"]).alias("smoothed"))


def analyse_elevation(cells: DataFrame, buildings: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(building bases, segment heights) of every area at once from raw cells: despike, smooth, sample."""
    clean = despike(cells)
    return building_base(buildings, clean), line_heights(segments, clean, smooth(clean))


def grid_fingerprint(cells: DataFrame) -> DataFrame:
    """Order-free content hash per area; combines map-side instead of collecting a grid."""
    h = F.xxhash64("row", "col", F.col("height").cast("float"), *HEADER)
    return cells.groupBy("area_id").agg(F.bit_xor(h).alias("content"), F.count("*").alias("n"))


def grid_version(previous: DataFrame, stored_versions: DataFrame, current: DataFrame) -> DataFrame:
    """Version per area: 1 when new, unchanged when heights, size and origin are equal, else one more."""
    old = grid_fingerprint(previous).join(stored_versions, "area_id").select("area_id", F.struct("content", "n").alias("_old"), "version")
    new = grid_fingerprint(current).select("area_id", F.struct("content", "n").alias("_new"))
    j = new.join(old, "area_id", "left")
    v = F.when(F.col("version").isNull(), 1).when(F.col("_old") == F.col("_new"), F.col("version")).otherwise(F.col("version") + 1)
    return j.select("area_id", v.cast("int").alias("version"))


def cell_slope(cells: DataFrame) -> DataFrame:
    """Gradient magnitude of every grid square (rise over run)."""
    middle = F.round(F.col("origin_lat") + (F.col("rows") - 1) * F.col("lat_step") / 2, geo.ORIGIN_DECIMALS)
    w, h = F.col("lon_step") * geo.meters_per_degree_lon(middle), F.col("lat_step") * geo.METERS_PER_DEGREE
    gx = ((F.col("height_se") - F.col("height_sw")) + (F.col("height_ne") - F.col("height_nw"))) / 2 / w
    gy = ((F.col("height_nw") - F.col("height_sw")) + (F.col("height_ne") - F.col("height_se"))) / 2 / h
    return quads(cells).select("area_id", "row", "col", *HEADER, F.hypot(gx, gy).alias("slope"))


def whole_grids(cells: DataFrame) -> DataFrame:
    """Cells of grids that hold every sample their header states; a grid with missing samples breaks the size rule."""
    n = cells.groupBy("area_id").agg(F.count("*").alias("_n"), F.max(F.col("rows") * F.col("cols")).alias("_want")).filter("_n = _want")
    return cells.join(n.select("area_id"), "area_id", "left_semi")
