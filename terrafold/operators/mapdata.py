"""Map data of areas: whole entities that meet a boundary, or geometries cut at the area's box."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import planar, spatial

BOX = ("min_lat", "min_lon", "max_lat", "max_lon")


def ids_in_boundary(boundaries: DataFrame, points: dict[str, DataFrame], lines: dict[str, DataFrame], rings: dict[str, DataFrame]) -> DataFrame:
    """``boundary_id, layer, id`` of everything that meets a boundary (``boundary_id, area_id, ring``). Layers: frames with ``area_id, id`` and
    ``lat, lon``, ``line`` or ``shape``."""
    b = boundaries.select("boundary_id", "area_id", "ring")
    parts = [spatial.points_in_rings(df, b, on="area_id").select("boundary_id", F.lit(n).alias("layer"), "id") for n, df in points.items()]
    parts += [spatial.lines_meeting_rings(df, b, on="area_id").select("boundary_id", F.lit(n).alias("layer"), "id") for n, df in lines.items()]
    parts += [spatial.rings_meeting_rings(df, b, on="area_id").select("boundary_id", F.lit(n).alias("layer"), "id") for n, df in rings.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def clip_rings_to_box(rings: DataFrame, areas: DataFrame, shape: str = "ring") -> DataFrame:
    """Rings cut at their area's box; what has no area left (it only touches the edge) is dropped."""
    a = areas.select("area_id", *(F.col(c).alias(f"_{c}") for c in BOX))
    j = rings.join(a, "area_id").withColumn("_cut", geo.clip_ring_rect(F.col(shape), F.col("_min_lon"), F.col("_min_lat"), F.col("_max_lon"), F.col("_max_lat")))
    j = j.filter((F.size("_cut") > 0)).filter(F.abs(geo.signed_area("_cut")) > 0)
    return j.withColumn(shape, F.col("_cut")).drop("_cut", *[f"_{c}" for c in BOX])


def clip_lines_to_box(lines: DataFrame, areas: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Lines cut at their area's box as ordered parts ``part, line``: a line that leaves and comes back gives several parts."""
    a = areas.select("area_id", *(F.col(c).alias(f"_{c}") for c in BOX))
    e = lines.join(a, "area_id").select("*", F.posexplode(geo.steps(line)).alias("_i", "_s"))
    s, t = (lambda end, ax: F.col(f"_s.{end}.{ax}")), F.col("_t")
    cut = geo.clip_edge_rect(s("a", "x"), s("a", "y"), s("b", "x"), s("b", "y"), "_min_lon", "_min_lat", "_max_lon", "_max_lat")
    e = e.withColumn("_t", cut).filter("_t IS NOT NULL AND _t.t1 > _t.t0")
    at = lambda u: geo.point(s("a", "x") + (s("b", "x") - s("a", "x")) * u, s("a", "y") + (s("b", "y") - s("a", "y")) * u)
    e = e.select("area_id", key, "_i", at(t["t0"]).alias("p"), at(t["t1"]).alias("q"), (t["t0"] == 0).alias("whole_start"), (t["t1"] == 1).alias("whole_end"))
    # Edges of one line (bounded by the source's way length) are chained while they touch.
    g = e.groupBy("area_id", key).agg(F.array_sort(F.collect_list(F.struct("_i", "p", "q", "whole_start", "whole_end"))).alias("v"))
    empty = F.array().cast("array<array<struct<x:double,y:double>>>")

    def chain(acc, x):
        last = F.element_at(acc["parts"], -1)
        joins = acc["open"] & x["whole_start"] & (acc["i"] == x["_i"] - 1)
        grown = F.concat(F.slice(acc["parts"], F.lit(1), F.size(acc["parts"]) - 1), F.array(F.concat(last, F.array(x["q"]))))
        return F.struct(F.when(joins, grown).otherwise(F.concat(acc["parts"], F.array(F.array(x["p"], x["q"])))).alias("parts"), x["whole_end"].alias("open"), x["_i"].alias("i"))

    start = F.struct(empty.alias("parts"), F.lit(False).alias("open"), F.lit(-2).alias("i"))
    parts = F.aggregate("v", start, chain, lambda acc: acc["parts"])
    return g.select("area_id", key, F.posexplode(parts).alias("part", "line"))


def clip_rings_to_boundary(shapes: DataFrame, boundaries: DataFrame, id_column: str, cell: float = 0.001) -> DataFrame:
    """Rings cut at a traced boundary through a polygon overlay: ``boundary_id, <id>, ring, hole, area`` (square degrees). Pairs that meet are found first, so
    only those enter the overlay."""
    pairs = spatial.rings_meeting_rings(shapes.select("area_id", id_column, F.col("ring").alias("shape")), boundaries.select("boundary_id", "area_id", "ring"), on="area_id")
    key = F.concat_ws("\u0001", "boundary_id", id_column)
    both = pairs.select(key.alias("key"), F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("shape").alias("ring")), F.struct(F.lit("b").alias("side"), "ring"))).alias("s")).select("key", "s.*")
    out = planar.overlay(both, "intersection", cell)
    parts = F.split("key", "\u0001")
    return out.select(parts[0].alias("boundary_id"), parts[1].alias(id_column), "ring", "hole", "area")


def footprint_area(buildings: DataFrame) -> DataFrame:
    """Square metres of each composed building."""
    return buildings.withColumn("footprint_m2", geo.ring_area_m2("ring"))


def _keep(xy: np.ndarray, tolerance: float) -> np.ndarray:
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(xy) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, p = xy[j] - xy[i], xy[i + 1 : j] - xy[i]
        squared = float(d @ d)
        t = np.clip(p @ d / squared, 0, 1) if squared else np.zeros(len(p))
        far = np.hypot(*(p - t[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplify(lines: DataFrame, tolerance: float, line: str = "line") -> DataFrame:
    """Lines without the points that lie within the tolerance of what remains; ends always stay. One line is one numpy step."""

    def thin(flat: pd.Series) -> pd.Series:
        return flat.map(lambda v: _keep(np.asarray(v, dtype=float).reshape(-1, 2), tolerance).tolist() if len(v) >= 6 else [True] * (len(v) // 2))

    mask = F.pandas_udf(thin, "array<boolean>")(F.flatten(F.transform(line, lambda p: F.array(p["x"], p["y"]))))
    return lines.withColumn("_k", mask).withColumn(line, F.filter(line, lambda p, i: F.element_at("_k", i + 1))).drop("_k")


def boundary_in_box(boundaries: DataFrame, areas: DataFrame, cell: float = 0.005) -> DataFrame:
    """A traced ring cut to its area's box and reduced to one outline: the largest part, how many parts were left out, and whether holes were
    filled. Vertices are clamped into the box, so rounding never leaves one outside."""
    j = boundaries.join(areas.select("area_id", *BOX), "area_id")
    box = geo.bbox_ring(*(F.col(c) for c in BOX))
    both = j.select(F.col("boundary_id").alias("key"), F.explode(F.array(F.struct(F.lit("a").alias("side"), geo.close_ring("ring").alias("ring")), F.struct(F.lit("b").alias("side"), box.alias("ring")))).alias("s"))
    out = planar.outline_of(planar.overlay(both.select("key", "s.*"), "intersection", cell)).withColumnRenamed("key", "boundary_id")
    k = out.withColumnRenamed("ring", "_o").join(j.select("boundary_id", "area_id", *BOX), "boundary_id")
    clamp = lambda v, lo, hi: F.least(F.greatest(v, F.col(lo)), F.col(hi))
    ring = F.transform("_o", lambda p: geo.point(clamp(p["x"], "min_lon", "max_lon"), clamp(p["y"], "min_lat", "max_lat")))
    return k.select("boundary_id", "area_id", ring.alias("ring"), "dropped_parts", "filled_holes")


def resample_clipped(parts: DataFrame, cells: DataFrame, smoothed: DataFrame, key: str = "segment_id") -> DataFrame:
    """Exact and smoothed heights of clipped line parts (``part, line``), whose vertices no longer match the stored heights."""
    from terrafold.operators import raster

    whole = parts.withColumn("_id", F.concat_ws("\u0001", key, F.col("part").cast("string")))
    h = raster.line_heights(whole.select("area_id", "_id", "line"), cells, smoothed, key="_id")
    ids = F.split("_id", "\u0001")
    return h.select("area_id", ids[0].alias(key), ids[1].cast("int").alias("part"), "exact", "smoothed")


def nearby(kind: str, layers: dict[str, DataFrame], centers: DataFrame, radius_m: float) -> DataFrame:
    """Features of one kind near centers: footprints and area features by their outline, the others by their point."""
    df = layers[kind]
    return spatial.rings_within_radius(centers, df, radius_m) if "ring" in df.columns else spatial.within_radius(centers, df, radius_m)


def within_bbox(kind: str, layers: dict[str, DataFrame], boxes: DataFrame, contained: bool) -> DataFrame:
    """Features of one kind that meet boxes or, with ``contained``, lie inside them."""
    df = layers[kind]
    if "ring" in df.columns:
        return spatial.rings_in_boxes(df, boxes) if contained else spatial.rings_meeting_boxes(df, boxes)
    return spatial.points_in_boxes(df, boxes, strict=contained)


def polygons_meeting(layer: DataFrame, scopes: DataFrame, on: str, *key: str) -> DataFrame:
    """``scope columns, <key>`` of the entities (``polygons``) that share a point with a scope's ``ring``; a scope within a hole meets nothing."""
    parts = layer.select(on, *key, F.explode("polygons").alias("_p")).withColumn("shape", F.col("_p.outer"))
    met = spatial.rings_meeting_rings(parts, scopes, on=on)
    in_hole = F.exists("_p.holes", lambda h: geo.point_in_ring(F.col("ring")[0]["x"], F.col("ring")[0]["y"], h) & ~geo.lines_touch(h, F.col("ring")))
    return met.filter(~in_hole).select(*(c for c in scopes.columns if c != "ring"), *key).distinct()


def map_data(features: dict[str, DataFrame], network_layers: dict[str, DataFrame], areas: DataFrame, boundaries: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every layer of every completed area at once, whole entities only (see ``clip`` for cut ones).

    ``features`` (``area_id, source_id`` and ``lat, lon``, ``ring``, ``polygon`` or ``polygons``) are composed over the inner areas: each source id once, the area's own copy
    first, as ``outer_id``. ``network_layers`` (``segments`` with ``line``, ``nodes``) stay the area's own. With ``boundaries`` (``boundary_id, area_id, ring``) each layer is
    narrowed to what meets a boundary; ends of kept segments stay, so the result is routable."""
    from terrafold.operators import clip, compose, network

    owners = compose.owners(areas)
    out = {n: compose.compose_by_source_id(df, owners) for n, df in features.items()} | dict(network_layers)
    if boundaries is None:
        return out
    b = boundaries.select("boundary_id", F.col("area_id").alias("outer_id"), "ring")
    for n in features:
        df = out[n]
        if {"ring", "polygon", "polygons"} & set(df.columns):
            out[n] = df.join(polygons_meeting(clip.as_polygons(df), b, "outer_id", "source_id"), ["outer_id", "source_id"])
        else:
            out[n] = spatial.points_in_rings(df, b, on="outer_id").drop("ring")
    own = b.withColumnRenamed("outer_id", "area_id")
    segments = spatial.lines_meeting_rings(network_layers["segments"], own, on="area_id").drop("ring")
    nodes = spatial.points_in_rings(network_layers["nodes"], own, on="area_id")
    out["segments"] = segments
    ids = network.with_endpoints(nodes, segments)
    out["nodes"] = network_layers["nodes"].join(ids, ["area_id", "node_id"], "left_semi")
    return out
