"""Elements to typed features: roads, buildings, points of interest, area features, restrictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geo, rules, tags
from terrafold.session import settle


def classify_ways(ways: DataFrame) -> DataFrame:
    """Adds ``role``: road, then building, then poi, then area; at most one per way, NULL for the rest."""
    t = lambda k: tags.tag("tags", k)
    role = (
        F.when(tags.road_class(t("highway")).isNotNull(), "road")
        .when(t("building").isNotNull(), "building")
        .when(tags.poi_category("tags").isNotNull(), "poi")
        .when(tags.area_kind("tags").isNotNull(), "area")
    )
    return ways.withColumn("role", role).withColumn("ring_ok", rules.ring_ok("nodes"))


def roads(classified: DataFrame) -> DataFrame:
    """Road ways with class, name, direction and lanes; ``problem`` names what would reject the payload."""
    ow = tags.oneway_effective("tags")
    direction = tags.oneway_dir(ow)
    lane_keys = ("lanes", "lanes:forward", "lanes:backward")
    problem = F.coalesce(
        F.when(F.size("nodes") < 2, F.lit("needs at least two nodes")),
        tags.oneway_problem(ow),
        *(tags.lane_problem(tags.tag("tags", k)) for k in lane_keys),
    )
    r = classified.filter("role = 'road'").withColumn("direction", direction)
    lanes = tags.split_lanes("tags", F.col("direction"))
    return r.select(
        "area_id", "element_pos", F.col("way_id").alias("source_id"), "nodes", tags.road_class(tags.tag("tags", "highway")).alias("class"),
        tags.tag("tags", "name").alias("name"), "direction", lanes["forward"].alias("forward_lanes"), lanes["backward"].alias("backward_lanes"),
        problem.alias("problem"),
    )


def _building_columns() -> list[Column]:
    t = lambda k: tags.tag("tags", k)
    return [
        tags.building_category(t("building")).alias("category"), tags.height_meters(t("height")).alias("height_meters"),
        tags.levels(t("building:levels")).alias("levels"), tags.building_type(t("building")).alias("building_type"),
    ]


def buildings(classified: DataFrame) -> DataFrame:
    b = classified.filter("role = 'building' AND ring_ok")
    return b.select("area_id", "element_pos", F.col("way_id").alias("source_id"), "nodes", *_building_columns())


def area_features(classified: DataFrame) -> DataFrame:
    a = classified.filter("role = 'area' AND ring_ok")
    return a.select("area_id", "element_pos", F.col("way_id").alias("source_id"), "nodes", tags.area_kind("tags").alias("kind"))


def relation_features(relations: DataFrame, ways: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(buildings, area features, nodes)`` of multipolygon relations (``area_id, element_pos, relation_id, tags, members``): one feature per closed outer
    ring, in the columns of ``buildings`` and ``area_features``. Inner rings are ignored. Vertices get node ids of their own (``<source_id>#<i>``), because a
    member's inline geometry names none; they are the third frame. Relations of other kinds, and rings that can't be closed, give nothing."""
    from terrafold.operators import graph

    t = lambda k: tags.tag("tags", k)
    kind = F.when(t("building").isNull(), tags.area_kind("tags"))
    r = relations.filter(t("type") == "multipolygon").withColumn("kind", kind).filter(t("building").isNotNull() | F.col("kind").isNotNull())
    m = r.select("area_id", "relation_id", F.posexplode("members").alias("member_pos", "m"))
    m = m.filter("m.type = 'way' AND m.role IN ('outer', '')").select("area_id", "relation_id", "member_pos", "m.ref", "m.geometry")
    rings = graph.assemble_rings(graph.member_points(m, ways, nodes))
    ids = F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.concat("source_id", F.lit("#"), i))
    whole = settle(rings.withColumn("_ids", ids))
    f = whole.withColumn("nodes", F.concat("_ids", F.slice("_ids", 1, 1))).join(r.select("area_id", "relation_id", "element_pos", "tags", "kind"), ["area_id", "relation_id"])
    b = f.filter("kind IS NULL").select("area_id", "element_pos", "source_id", "nodes", *_building_columns())
    a = f.filter("kind IS NOT NULL").select("area_id", "element_pos", "source_id", "nodes", "kind")
    v = whole.select("area_id", F.explode(F.arrays_zip("_ids", F.slice("ring", F.lit(1), F.size("ring") - 1).alias("p"))).alias("v"))
    return b, a, v.select("area_id", F.col("v._ids").alias("node_id"), F.col("v.p.y").alias("lat"), F.col("v.p.x").alias("lon"))


def skipped_features(classified: DataFrame) -> DataFrame:
    """Building and area ways that are not a closed ring, and poi ways without two distinct vertices."""
    too_short = (F.col("role") == "poi") & ~F.col("ring_ok") & (F.size(F.array_distinct("nodes")) < 2)
    open_ring = F.col("role").isin("building", "area") & ~F.col("ring_ok")
    return classified.filter(open_ring | too_short).select("area_id", F.col("way_id").alias("source_id"), "role")


def resolve_geometry(features: DataFrame, nodes: DataFrame, into: str = "line", key: str = "source_id") -> DataFrame:
    """Adds the vertex coordinates of ``nodes`` in order as ``into``. A feature with a node that is not there is left out whole (see
    ``unresolved``), never shortened. A feature's vertices are bounded by the source's
    own limit on way length, so collecting them per feature is safe however many features there are."""
    flat = features.select("area_id", key, F.posexplode("nodes").alias("_pos", "node_id"))
    hit = flat.join(nodes.select("area_id", "node_id", "lat", "lon"), ["area_id", "node_id"])
    lines = hit.groupBy("area_id", key).agg(F.array_sort(F.collect_list(F.struct("_pos", geo.point("lon", "lat").alias("p")))).alias("_v"))
    whole = features.join(lines, ["area_id", key]).filter(F.size("_v") == F.size("nodes"))
    return whole.select(*features.columns, F.transform("_v", lambda e: e["p"]).alias(into))


def unresolved(features: DataFrame, nodes: DataFrame, key: str = "source_id") -> DataFrame:
    """``area_id, <key>, missing``: features that reference nodes which are not there, and how many."""
    return missing_refs(features, nodes, key).groupBy("area_id", key).agg(F.count(F.lit(1)).alias("missing"))


def missing_refs(features: DataFrame, nodes: DataFrame, key: str = "source_id") -> DataFrame:
    """(feature, node) references that resolve to no node."""
    flat = features.select("area_id", key, F.explode("nodes").alias("node_id")).distinct()
    return flat.join(nodes.select("area_id", "node_id"), ["area_id", "node_id"], "left_anti")


def pois(classified: DataFrame, raw_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points of interest from tagged nodes and from ways: a closed way sits at the mean of its vertices, an open one
    at its middle vertex."""
    w = classified.filter("role = 'poi'").filter(F.col("ring_ok") | (F.size(F.array_distinct("nodes")) >= 2))
    middle = F.element_at("nodes", (F.floor(F.size("nodes") / 2) + 1).cast("int"))
    # Only the vertices that define the point are joined: all but the closing one, or the middle one.
    used = F.when(F.col("ring_ok"), F.slice("nodes", F.lit(1), F.size("nodes") - 1)).otherwise(F.array(middle))
    flat = w.select("area_id", F.col("way_id").alias("source_id"), F.explode(used).alias("node_id"), "tags", "nodes", F.size(used).alias("_used"))
    at = flat.join(nodes, ["area_id", "node_id"])
    from_ways = at.groupBy("area_id", "source_id").agg(
        F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.first("tags").alias("tags"), F.first("nodes").alias("footprint"), F.count(F.lit(1)).alias("_n"), F.first("_used").alias("_used"),
    ).filter("_n = _used").drop("_n", "_used")
    from_nodes = raw_nodes.filter(tags.poi_category("tags").isNotNull()).select(
        "area_id", F.col("node_id").alias("source_id"), "lat", "lon", "tags", F.lit(None).cast("array<string>").alias("footprint")
    )
    both = from_ways.unionByName(from_nodes)
    return both.select("area_id", "source_id", "lat", "lon", tags.poi_category("tags").alias("category"), tags.tag("tags", "name").alias("name"), "footprint")


def restrictions(relations: DataFrame) -> DataFrame:
    """Turn restriction relations as ``kind, from_way, via_node, to_way, outcome``: ``car`` ones apply, ``other_vehicle`` ones
    are ignored, ``malformed`` ones are skipped and reported."""
    r = relations.filter(tags.tag("tags", "type") == "restriction")
    k, m = tags.restriction_kind("tags"), tags.restriction_members("members")
    r = r.select("area_id", "element_pos", F.col("relation_id").alias("source_id"), k.alias("k"), m.alias("m"))
    incomplete = F.col("m.from_way").isNull() | F.col("m.via_node").isNull() | F.col("m.to_way").isNull()
    outcome = F.when((F.col("k.outcome") == "car") & incomplete, "malformed").otherwise(F.col("k.outcome"))
    return r.select("area_id", "element_pos", "source_id", "k.kind", "m.from_way", "m.via_node", "m.to_way", outcome.alias("outcome"))


def resolvable_restrictions(parsed: DataFrame, road_rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Car restrictions whose from and to are roads and whose via node exists."""
    ids = road_rows.select("area_id", "source_id").distinct()
    out = parsed.filter("outcome = 'car'")
    for c in ("from_way", "to_way"):
        out = out.join(ids.withColumnRenamed("source_id", c), ["area_id", c], "left_semi")
    return out.join(nodes.select("area_id", F.col("node_id").alias("via_node")), ["area_id", "via_node"], "left_semi")


def outside_box(features: DataFrame, areas: DataFrame, line: str = "line") -> DataFrame:
    """Features whose envelope does not meet their area's box, with a typed reference."""
    box = {k: F.col(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")}
    j = features.join(areas.select("area_id", *box), "area_id").withColumn("_e", geo.envelope(line))
    return j.filter(~rules.envelope_meets("_e", box)).select("area_id", "source_id", F.concat(F.lit("way/"), "source_id").alias("ref"))


def pois_outside_box(poi_rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Node points must lie inside the box."""
    box = {k: F.col(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")}
    j = poi_rows.filter(F.col("footprint").isNull()).join(areas.select("area_id", *box), "area_id")
    return j.filter(~rules.in_box("lat", "lon", box)).select("area_id", "source_id", F.concat(F.lit("node/"), "source_id").alias("ref"))


def drop_far_rings(features: DataFrame, areas: DataFrame, line: str = "line") -> DataFrame:
    """Drops rings of a multipolygon relation that lie outside the box while a sibling ring meets it. When none
    does, all stay, so that the box check still rejects the relation."""
    box = {k: F.col(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")}
    rel = F.regexp_extract("source_id", r"^(relation/[^/#]+)", 1)
    j = features.join(areas.select("area_id", *box), "area_id").withColumn("_r", rel).withColumn("_t", rules.envelope_meets(geo.envelope(line), box))
    # Relations with a ring inside, found by a combinable aggregate; no window over a relation's rings.
    touching = j.filter("_r <> ''").groupBy("area_id", "_r").agg(F.max("_t").alias("_any"))
    k = j.join(touching, ["area_id", "_r"], "left")
    return k.filter((F.col("_r") == "") | F.col("_t") | ~F.coalesce("_any", F.lit(False))).select(*features.columns)
