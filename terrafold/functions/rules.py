"""Predicates and data-quality rules as column expressions that name the broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geo

# Fixed values.
MAX_AREA_SQUARE_METERS = 10_000_000.0
MIN_BUILDABLE_SQUARE_METERS = 30.0


def valid_coord(lat, lon) -> Column:
    return F.coalesce(geo.col(lat).between(-90, 90) & geo.col(lon).between(-180, 180), F.lit(False))


def bbox_area_m2(min_lat, min_lon, max_lat, max_lon) -> Column:
    """South edge times west edge."""
    s, w, n, e = (geo.col(c) for c in (min_lat, min_lon, max_lat, max_lon))
    return geo.haversine(s, w, s, e) * geo.haversine(s, w, n, w)


def bbox_problem(min_lat, min_lon, max_lat, max_lon, limit: float = MAX_AREA_SQUARE_METERS) -> Column:
    s, w, n, e = (geo.col(c) for c in (min_lat, min_lon, max_lat, max_lon))
    return (
        F.when(~(valid_coord(s, w) & valid_coord(n, e)), "out_of_range")
        .when(~((s < n) & (w < e)), "empty")
        .when(bbox_area_m2(s, w, n, e) > limit, "too_large")
    )


def in_box(lat, lon, box) -> Column:
    """Inside or on the edge. ``box`` is a struct column or a dict of columns with the four bounds."""
    return geo.col(lat).between(box["min_lat"], box["max_lat"]) & geo.col(lon).between(box["min_lon"], box["max_lon"])


def covered_by(line, box) -> Column:
    """Every vertex inside or on the edge; nothing is not covered."""
    line = geo.col(line)
    return F.coalesce((F.size(line) > 0) & F.forall(line, lambda p: in_box(p["y"], p["x"], box)), F.lit(False))


def envelope_meets(env, box) -> Column:
    env = geo.col(env)
    return ~(
        (env["max_lat"] < box["min_lat"]) | (env["min_lat"] > box["max_lat"])
        | (env["max_lon"] < box["min_lon"]) | (env["min_lon"] > box["max_lon"])
    )


def ring_ok(nodes) -> Column:
    """A closed ring of node references with at least three distinct vertices."""
    nodes = geo.col(nodes)
    return F.coalesce(
        (F.size(nodes) >= 4)
        & (F.try_element_at(nodes, F.lit(1)) == F.try_element_at(nodes, F.lit(-1)))
        & (F.size(F.array_distinct(F.slice(nodes, F.lit(1), F.greatest(F.size(nodes) - 1, F.lit(0))))) >= 3),
        F.lit(False),
    )


def boundary_problem(name, ring, box) -> Column:
    """The first broken rule of a traced boundary, NULL when it is fine."""
    name, ring = geo.col(name), geo.col(ring)
    repeats = F.exists(geo.steps(ring), lambda s: s["a"] == s["b"])
    flat = F.forall(F.slice(ring, F.lit(3), F.size(ring)), lambda p: geo.orientation(ring[0], ring[1], p) == 0)
    return (
        F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "blank_name")
        .when(F.size(ring) < 4, "too_few_vertices")
        .when(F.try_element_at(ring, F.lit(1)) != F.try_element_at(ring, F.lit(-1)), "not_closed")
        .when(repeats | flat, "degenerate")
        .when(geo.self_intersects(ring), "self_intersecting")
        .when(~covered_by(ring, box), "outside_import_area")
    )


def eligibility(is_clipped, is_median, buildable_m2) -> Column:
    return (
        F.when(geo.col(is_clipped), "clipped")
        .when(geo.col(is_median), "median")
        .when(F.coalesce(geo.col(buildable_m2), F.lit(0.0)) < MIN_BUILDABLE_SQUARE_METERS, "no_buildable_area")
        .otherwise("eligible")
    )


def feedback_problem(building_count, no_buildings) -> Column:
    n, none = geo.col(building_count), F.coalesce(geo.col(no_buildings), F.lit(False))
    return F.when(n.isNull() == ~none, "exactly_one").when(n < 0, "negative_count")


def feedback_target(building_count, no_buildings) -> Column:
    return F.when(F.coalesce(geo.col(no_buildings), F.lit(False)), F.lit(0)).otherwise(F.coalesce(geo.col(building_count), F.lit(0)))


COLUMN_CHECKS: dict[str, dict[str, str]] = {
    "buildings": {
        "height_positive": "height_meters IS NULL OR height_meters > 0",
        "levels_not_negative": "levels IS NULL OR levels >= 0",
    },
    "grids": {
        "at_least_2x2": "rows >= 2 AND cols >= 2",
        "height_count": "size(heights) = rows * cols",
        "positive_steps": "lat_step > 0 AND lon_step > 0",
    },
    "assignments": {"count_source_domain": "count_source IN ('reference', 'default', 'feedback')"},
    "feedback": {
        "exactly_one": "(building_count IS NULL) = coalesce(no_buildings, false)",
        "count_not_negative": "building_count IS NULL OR building_count >= 0",
    },
}


def check_constraints(df: DataFrame, table: str) -> DataFrame:
    """One row per broken rule: the input row plus ``violation``. A single pass over the data."""
    rules = COLUMN_CHECKS[table]
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.lit(name)) for name, sql in rules.items())))
    return df.withColumn("violation", F.explode(broken))


def completed(areas: DataFrame) -> DataFrame:
    return areas.filter(F.col("status") == "completed")


def check_boundaries(boundaries: DataFrame, areas: DataFrame) -> DataFrame:
    """``boundary_id, violation``: boundaries that leave their area's box, and names used twice in one area (the trimmed name counts)."""
    box = {k: F.col(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")}
    j = boundaries.join(areas.select("area_id", *box), "area_id")
    outside = j.filter(~covered_by("ring", box)).select("boundary_id", F.lit("outside_area").alias("violation"))
    named = boundaries.select("boundary_id", "area_id", F.trim("name").alias("_n"))
    twice = named.groupBy("area_id", "_n").agg(F.count("*").alias("_k")).filter("_k > 1")
    repeated = named.join(twice, ["area_id", "_n"]).select("boundary_id", F.lit("duplicate_name").alias("violation"))
    return outside.unionByName(repeated)
