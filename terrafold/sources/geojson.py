"""GeoJSON out and in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geo, rules

PROPERTIES = {
    "buildings": ["category", "block_id", "height_meters", "levels", "building_type", "area_id", "base_elevation_meters"],
    "pois": ["category", "name", "area_id"],
    "area_features": ["kind", "area_id"],
    "blocks": ["area_m2", "buildable_m2", "is_median", "is_clipped", "area_id", "eligibility", "real_count", "generated_count", "is_reference", "reference_block_id", "style", "feedback"],
    "road_segments": ["class", "from_node", "to_node", "distance_m", "lanes", "provenance", "lane_type", "width_m", "exact", "smoothed"],
    "navigable_nodes": [],
    "generation_zones": ["block_id", "reason"],
}


def _pairs(line: Column) -> Column:
    return F.transform(line, lambda p: F.array(p["x"], p["y"]))


def _json_text(text: Column) -> Column:
    """A JSON string with everything escaped that needs it."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def geometry(kind: str, shape: Column) -> Column:
    """GeoJSON geometry text of a point struct, line, ring or array of rings."""
    coords = {
        "Point": lambda s: F.array(s["x"], s["y"]),
        "LineString": _pairs,
        "Polygon": lambda s: F.array(_pairs(s)),
        "MultiPolygon": lambda s: F.transform(s, lambda r: F.array(_pairs(r))),
    }[kind](shape)
    return F.to_json(F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")))


def lines_geometry(parts) -> Column:
    """The geometry of an array of lines: one line, or several as one geometry."""
    parts = geo.col(parts)
    single = F.to_json(F.struct(F.lit("LineString").alias("type"), _pairs(F.try_element_at(parts, F.lit(1))).alias("coordinates")))
    several = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.transform(parts, _pairs).alias("coordinates")))
    return F.when(F.size(parts) == 1, single).when(F.size(parts) > 1, several)


def polygons_geometry(polygons) -> Column:
    """The geometry of an array of polygons, holes after their outer ring: one polygon, or several as one geometry."""
    polygons = geo.col(polygons)
    coords = F.transform(polygons, lambda p: F.transform(geo.polygon_rings(p), _pairs))
    single = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.try_element_at(coords, F.lit(1)).alias("coordinates")))
    several = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coords.alias("coordinates")))
    return F.when(F.size(polygons) == 1, single).when(F.size(polygons) > 1, several)


def to_features(df: DataFrame, layer: str, kind: str, shape: str, id_column: str) -> DataFrame:
    """One row per feature: ``area_id, id, feature`` (GeoJSON text). Properties that the frame lacks are written as null."""
    props = F.struct(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in PROPERTIES[layer])) if PROPERTIES[layer] else F.struct(F.lit(layer).alias("layer"))
    body = F.to_json(props, {"ignoreNullFields": "false"})
    text = F.concat(F.lit('{"type":"Feature","id":'), _json_text(F.col(id_column).cast("string")), F.lit(',"geometry":'), geometry(kind, F.col(shape)), F.lit(',"properties":'), body, F.lit("}"))
    return df.select("area_id", F.col(id_column).alias("id"), text.alias("feature"))


def collections(batched: DataFrame) -> DataFrame:
    """FeatureCollection texts per ``area_id, batch``: the batch size (see ``scan.batches``) bounds each text."""
    g = batched.groupBy("area_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "feature"))), lambda e: e["feature"]), ",").alias("f"), F.count("*").alias("n"))
    return g.select("area_id", "batch", "n", F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("collection"))


def read_boundaries(df: DataFrame, column: str = "geojson") -> DataFrame:
    """Boundary texts to ``ring`` and ``error``: one ring only, positions of two numbers, coordinates in range."""
    g = F.from_json(F.col(column), "type string, coordinates array<array<array<double>>>")
    out = df.withColumn("_g", g).withColumn("_r", F.try_element_at("_g.coordinates", F.lit(1)))
    pairs = F.forall("_r", lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull())
    in_range = F.forall("_r", lambda p: rules.valid_coord(p[1], p[0]))
    shape_ok = (F.col("_g.type") == "Polygon") & (F.size("_g.coordinates") >= 1)
    error = (
        F.when(~F.coalesce(shape_ok, F.lit(False)), "invalid_geojson")
        .when(F.size("_g.coordinates") > 1, "holes_not_supported")
        .when(~F.coalesce(pairs, F.lit(False)), "invalid_geojson")
        .when(~in_range, "invalid_coordinate")
    )
    ring = F.when(error.isNull(), F.transform("_r", lambda p: geo.point(p[0], p[1])))
    return out.select(*df.columns, ring.alias("ring"), error.alias("error"))
