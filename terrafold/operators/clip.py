"""Map data in clip mode: every layer cut at a scope, a traced boundary or an area's box.

A scope is ``scope_id, area_id, ring`` (closed, may be concave). An entity keeps only what is left of it in its own dimension: points inside or on the
edge, stretches of lines, and polygons with their holes. What only touches the scope is gone. Attributes still describe the whole entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import compose, planar, spatial
from terrafold.session import settle

BOX = ("min_lat", "min_lon", "max_lat", "max_lon")
#: Degrees by which a scope is known beyond an entity's own box.
MARGIN = 1e-5


def scopes_of(areas: DataFrame, boundaries: DataFrame | None = None) -> DataFrame:
    """The boundaries (``boundary_id, area_id, ring``) as scopes, or without any the areas' boxes."""
    if boundaries is None:
        return areas.select(F.col("area_id").alias("scope_id"), "area_id", geo.bbox_ring(*BOX).alias("ring"))
    return boundaries.select(F.col("boundary_id").alias("scope_id"), "area_id", geo.close_ring("ring").alias("ring"))


def clip_points(points: DataFrame, scopes: DataFrame, *key: str) -> DataFrame:
    """``scope_id, area_id, <key>`` of the points (``lat, lon``) in a scope or on its edge."""
    return spatial.points_in_rings(points.select("area_id", *key, "lat", "lon"), scopes, on="area_id").select("scope_id", "area_id", *key)


def _stretches(lines: DataFrame, *key: str) -> DataFrame:
    """Straight pieces ``edge, t0, t1, a, b`` of lines that cross a scope's edge, those inside or on the edge."""
    e = lines.select("scope_id", "area_id", *key, "ring", F.posexplode(geo.steps("line")).alias("edge", "s"))
    x = lambda end, ax: F.col(f"s.{end}.{ax}")
    dx, dy = x("b", "x") - x("a", "x"), x("b", "y") - x("a", "y")

    def meet(t: Column) -> Column:
        rx, ry = t["b"]["x"] - t["a"]["x"], t["b"]["y"] - t["a"]["y"]
        det = dx * ry - dy * rx
        ox, oy = t["a"]["x"] - x("a", "x"), t["a"]["y"] - x("a", "y")
        u, w = F.try_divide(ox * ry - oy * rx, det), F.try_divide(ox * dy - oy * dx, det)
        return F.when(u.between(0, 1) & w.between(0, 1), u)

    # Cuts fall on whole grid units along the edge: two that rounding alone keeps apart are one, and none is at an end.
    units = F.hypot(dx, dy) * planar.UNITS
    inner = F.filter(F.transform(F.array_compact(F.transform(geo.steps("ring"), meet)), lambda u: F.round(u * units)), lambda n: (n > 0) & (n < F.floor(units)))
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.transform(F.array_distinct(inner), lambda n: F.try_divide(n, units))))
    e = e.filter((dx != 0) | (dy != 0)).withColumn("_t", cuts)
    n = F.size("_t") - 1
    spans = F.zip_with(F.slice("_t", F.lit(1), n), F.slice("_t", F.lit(2), n), lambda p, q: F.struct(p.alias("t0"), q.alias("t1")))
    e = e.select("scope_id", "area_id", *key, "ring", "edge", "s", F.explode(spans).alias("u"))
    at = lambda t: geo.point(x("a", "x") + dx * t, x("a", "y") + dy * t)
    mid = (F.col("u.t0") + F.col("u.t1")) / 2
    mx, my = x("a", "x") + dx * mid, x("a", "y") + dy * mid
    e = e.filter(geo.point_in_ring(mx, my, "ring") | geo.point_on_ring(mx, my, "ring"))
    end = lambda t, whole, p: F.when(t == whole, F.col(p)).otherwise(at(t))
    return e.select("scope_id", "area_id", *key, "edge", F.col("u.t0").alias("t0"), F.col("u.t1").alias("t1"), end(F.col("u.t0"), 0.0, "s.a").alias("a"), end(F.col("u.t1"), 1.0, "s.b").alias("b"))


def _all_inside(line: str) -> Column:
    """Every vertex, not one only: a line that touches the edge up to a rounding error counts as cut."""
    return F.forall(line, lambda p: geo.point_in_ring(p["x"], p["y"], "ring"))


def clip_lines(lines: DataFrame, scopes: DataFrame, *key: str) -> DataFrame:
    """``scope_id, area_id, <key>, parts``: what is left of each line (``area_id, <key>, line``) as lines in walk order.

    A line is cut where it meets the scope's edge. A piece goes on from the one before if that ended where it starts, by the place along
    the line; pieces that go on from each other are stitched to one part."""
    met = spatial.lines_meeting_rings(lines.select("area_id", *key, "line"), scopes, on="area_id")
    met = settle(met.withColumn("_cut", geo.lines_touch("line", "ring") | ~_all_inside("line")))
    whole = met.filter("NOT _cut").select("scope_id", "area_id", *key, F.array("line").alias("parts"))
    own = ["scope_id", "area_id", *key]
    order = W.partitionBy(*own).orderBy("edge", "t0")
    edge, t1 = F.lag("edge").over(order), F.lag("t1").over(order)
    goes_on = ((F.col("edge") == edge) & (F.col("t0") == t1)) | ((F.col("edge") == edge + 1) & (F.col("t0") == 0) & (t1 == 1))
    pieces = _stretches(met.filter("_cut"), *key).withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    pieces = pieces.withColumn("part", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    straight = pieces.groupBy(*own, "part", "edge").agg(F.min_by("a", "t0").alias("a"), F.max_by("b", "t1").alias("b"))
    line = F.array_sort(F.collect_list(F.struct("edge", "a", "b")))
    stitched = straight.groupBy(*own, "part").agg(line.alias("v")).select(*own, "part", F.concat(F.array(F.col("v")[0]["a"]), F.transform("v", lambda p: p["b"])).alias("line"))
    cut = stitched.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda p: p["line"]).alias("parts"))
    return whole.unionByName(cut)


def _local(shape: Column, ring: Column) -> Column:
    """The scope around one entity: the ring cut to the entity's box and a little more. It may run to and fro along that box, which changes nothing by
    the even-odd rule."""
    return geo.let(geo.envelope(shape), lambda e: geo.clip_ring_rect(ring, e["min_lon"] - MARGIN, e["min_lat"] - MARGIN, e["max_lon"] + MARGIN, e["max_lat"] + MARGIN))


def clip_polygons(shapes: DataFrame, scopes: DataFrame, *key: str) -> DataFrame:
    """``scope_id, area_id, <key>, polygons``: what is left of each entity (``area_id, <key>, polygons``: an array of ``outer, holes``) as polygons with
    their holes, in the order of their lowest vertices. An entity without any area left is absent. All entities of all scopes are cut in one overlay."""
    outline = shapes.select("area_id", *key, F.posexplode("polygons").alias("_n", "poly")).withColumn("shape", F.col("poly.outer"))
    met = spatial.rings_meeting_rings(outline, scopes, on="area_id")
    cut = F.exists(geo.polygon_rings("poly"), lambda r: geo.lines_touch(r, F.col("ring")))
    met = settle(met.withColumn("_whole", ~cut & _all_inside("shape")))
    own = ["scope_id", "area_id", *key]
    whole = met.filter("_whole").select(*own, geo.canonical_polygon("poly").alias("polygon"))
    part = settle(met.filter("NOT _whole").select(*own, "poly", "shape", "ring", F.xxhash64(*own, "_n").alias("_h"), "_n")).withColumn("key", F.concat_ws(":", F.col("_h"), "_n", *own))
    rings = F.concat(F.transform(geo.polygon_rings("poly"), lambda r: F.struct(F.lit("a").alias("side"), r.alias("ring"))), F.array(F.struct(F.lit("b").alias("side"), _local(F.col("shape"), F.col("ring")).alias("ring"))))
    sides = part.select("key", F.explode(rings).alias("s")).select("key", "s.side", F.col("s.side").alias("shape"), "s.ring").filter(F.size("ring") > 0)
    left = planar.polygons(planar.overlay(sides, "intersection")).filter("area > 0")
    named = left.join(part.select("key", *own), "key").select(*own, "polygon")
    return whole.unionByName(named).groupBy(*own).agg(F.array_sort(F.collect_list("polygon")).alias("polygons"))


def as_polygons(layer: DataFrame) -> DataFrame:
    """A layer with ``polygons``: of its ``ring`` or ``polygon`` where it has no such column."""
    if "polygons" in layer.columns:
        return layer
    one = F.col("polygon") if "polygon" in layer.columns else geo.polygon(geo.close_ring("ring"))
    return layer.withColumn("polygons", F.array(one)).drop("ring", "polygon")


def clip_layers(layers: dict[str, DataFrame], scopes: DataFrame, keys: dict[str, str]) -> dict[str, DataFrame]:
    """Layers (``area_id``, the id column named by ``keys`` and ``lat, lon``, ``line``, ``ring``, ``polygon`` or ``polygons``) per scope, with ``parts`` or
    ``polygons`` cut and all other columns as they are; points have no geometry to cut. Layers of one kind are cut together."""
    kind = {n: "lines" if "line" in df.columns else "polygons" if {"ring", "polygon", "polygons"} & set(df.columns) else "points" for n, df in layers.items()}
    rows = {n: as_polygons(df) if kind[n] == "polygons" else df for n, df in layers.items()}
    shape = {"lines": ["line"], "polygons": ["polygons"], "points": ["lat", "lon"]}
    out = {}
    for k, clip in (("lines", clip_lines), ("polygons", clip_polygons), ("points", clip_points)):
        together = None
        for n in (n for n in layers if kind[n] == k):
            part = rows[n].select("area_id", F.lit(n).alias("layer"), F.col(keys[n]).cast("string").alias("id"), *shape[k])
            together = part if together is None else together.unionByName(part)
        if together is None:
            continue
        cut = settle(clip(together, scopes, "layer", "id"))
        for n in (n for n in layers if kind[n] == k):
            rest = rows[n].drop(*(shape[k] if k != "points" else [])).withColumn("_id", F.col(keys[n]).cast("string"))
            own = cut.filter(F.col("layer") == n).drop("layer").withColumnRenamed("id", "_id")
            out[n] = own.join(rest, ["area_id", "_id"]).drop("_id")
    return {n: out[n] for n in layers}


def map_data_clip(features: dict[str, DataFrame], network: dict[str, DataFrame], areas: DataFrame, scopes: DataFrame | None = None, keys: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Every layer of every area cut at its scopes (see ``scopes_of``), the area's box without any.

    ``features`` (``area_id, source_id`` and ``lat, lon``, ``ring``, ``polygon`` or ``polygons``) are composed over the inner areas first, each source
    id once, the area's own copy first; their own area is ``owner_id`` in the result. ``network`` layers (``line`` or ``lat, lon``) stay the area's own, and no end
    of a segment is added: a clipped export is not for routing. ``keys`` names the id column of a network layer (``segment_id``, ``node_id``)."""
    owners, scopes = compose.owners(areas), settle(scopes if scopes is not None else scopes_of(areas))
    shown = {n: compose.compose_by_source_id(df, owners).withColumnRenamed("area_id", "owner_id").withColumnRenamed("outer_id", "area_id") for n, df in features.items()}
    return clip_layers(shown | network, scopes, {n: "source_id" for n in features} | {"segments": "segment_id", "nodes": "node_id"} | (keys or {}))
