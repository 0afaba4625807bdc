"""Road network: navigable nodes, directed segments, cross-sections, turns and restrictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geo, tags

DEFAULT_LANES_PER_STREET = 2


def navigable_nodes(roads: DataFrame, restrictions: DataFrame | None = None) -> DataFrame:
    """Nodes used more than once over all roads, road ends, and via nodes of restrictions."""
    last = F.size("nodes") - 1
    used = roads.select("area_id", F.posexplode("nodes").alias("pos", "node_id"), last.alias("last"))
    ends = ((F.col("pos") == 0) | (F.col("pos") == F.col("last"))).cast("int")
    # One combinable aggregate: a busy node adds up map-side.
    keep = used.groupBy("area_id", "node_id").agg(F.count("*").alias("uses"), F.max(ends).alias("is_end")).filter("uses > 1 OR is_end = 1")
    out = keep.select("area_id", "node_id")
    if restrictions is not None:
        out = out.unionByName(restrictions.select("area_id", F.col("via_node").alias("node_id")))
    return out.distinct()


def segmentize(roads: DataFrame, navigable: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cut every road at its navigable nodes into directed segments.

    Forward pieces unless the road is one-way against its drawing, reverse pieces unless one-way along it. Two pieces of one
    road with the same ends collapse to the later one."""
    flat = roads.select("area_id", "source_id", F.posexplode("nodes").alias("pos", "node_id"))
    marks = navigable.select("area_id", "node_id", F.lit(True).alias("nav"))
    placed = flat.join(nodes.select("area_id", "node_id", "lat", "lon"), ["area_id", "node_id"]).join(marks, ["area_id", "node_id"], "left")
    vertex = F.struct("pos", "node_id", geo.point("lon", "lat").alias("p"), F.coalesce("nav", F.lit(False)).alias("nav"))
    ways = placed.groupBy("area_id", "source_id").agg(F.array_sort(F.collect_list(vertex)).alias("v"))
    # A road with a node that is not there is left out whole, never bridged.
    ways = ways.join(roads.select("area_id", "source_id", F.size("nodes").alias("_n")), ["area_id", "source_id"]).filter(F.size("v") == F.col("_n")).drop("_n")
    cut = F.filter(F.transform("v", lambda e, i: F.when(e["nav"], i)), lambda i: i.isNotNull())
    ways = ways.withColumn("c", cut)
    n = F.greatest(F.size("c") - 1, F.lit(0))
    spans = F.zip_with(F.slice("c", F.lit(1), n), F.slice("c", F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    r = roads.select("area_id", "source_id", "class", "direction", "forward_lanes", "backward_lanes")
    ways = ways.select("area_id", "source_id", "v", spans.alias("spans")).join(r, ["area_id", "source_id"])

    def piece(s, i, reverse: bool):
        part = F.slice(F.col("v"), s["a"] + 1, s["b"] - s["a"] + 1)
        part = F.reverse(part) if reverse else part
        return F.struct(
            F.element_at(part, 1)["node_id"].alias("from_node"), F.element_at(part, -1)["node_id"].alias("to_node"),
            F.transform(part, lambda e: e["p"]).alias("line"), (F.col("backward_lanes") if reverse else F.col("forward_lanes")).alias("lane_count"),
            (i * 2 + int(reverse)).alias("ord"),
        )

    fwd = F.when(F.col("direction") >= 0, F.transform("spans", lambda s, i: piece(s, i, False)))
    rev = F.when(F.col("direction") <= 0, F.transform("spans", lambda s, i: piece(s, i, True)))
    ways = ways.withColumn("pieces", F.when(fwd.isNull(), rev).when(rev.isNull(), fwd).otherwise(F.concat(fwd, rev)))
    later = lambda p: F.exists(
        "pieces", lambda o: (o["from_node"] == p["from_node"]) & (o["to_node"] == p["to_node"]) & (o["ord"] > p["ord"])
    )
    out = ways.select("area_id", F.col("source_id").alias("road_id"), "class", F.explode(F.filter("pieces", lambda p: ~later(p))).alias("s"))
    return out.select(
        "area_id", F.concat_ws(">", "road_id", "s.from_node", "s.to_node").alias("segment_id"), "road_id", "class", "s.from_node", "s.to_node",
        "s.line", geo.length_m("s.line").alias("distance_m"), "s.lane_count",
    )


def twins(segments: DataFrame) -> DataFrame:
    """Adds ``has_twin`` and ``twin_lanes`` of the same road's segment with swapped ends (a closed loop is its own twin).

    The key is the unordered pair of ends, so a road piece and its reverse (at most two rows) meet in one group."""
    a, b = F.least("from_node", "to_node"), F.greatest("from_node", "to_node")
    w = W.partitionBy("area_id", "road_id", a, b)
    by_end = w.orderBy("from_node")
    loop = F.col("from_node") == F.col("to_node")
    has = loop | (F.count("*").over(w) == 2)
    other = F.when(loop, F.col("lane_count")).otherwise(F.coalesce(F.lag("lane_count").over(by_end), F.lead("lane_count").over(by_end)))
    return segments.select("*", has.alias("has_twin"), other.alias("twin_lanes"))


def cross_sections(segments: DataFrame) -> DataFrame:
    """Lanes of the own direction with their provenance, lane type and the whole road's width."""
    t = twins(segments)
    own_default = F.when(F.col("has_twin"), DEFAULT_LANES_PER_STREET // 2).otherwise(DEFAULT_LANES_PER_STREET)
    own = F.coalesce("lane_count", own_default)
    other = F.when(F.col("has_twin"), F.coalesce("twin_lanes", F.lit(DEFAULT_LANES_PER_STREET // 2))).otherwise(F.lit(0))
    return t.select(
        "area_id", "segment_id", own.cast("int").alias("lanes"), F.when(F.col("lane_count").isNotNull(), "tagged").otherwise("defaulted").alias("provenance"),
        tags.lane_type("class").alias("lane_type"), ((own + other) * tags.lane_width("class")).alias("width_m"),
    )


def turn_candidates(segments: DataFrame) -> DataFrame:
    """Every incoming x outgoing pair at a node with its movement kind. Bearings are computed once per segment,
    before the join, so the pair rows carry two numbers instead of two lines."""
    at = lambda i: F.element_at("line", i)
    b = lambda p, q: geo.bearing(p["y"], p["x"], q["y"], q["x"])
    inc = segments.select("area_id", F.col("to_node").alias("node_id"), F.col("segment_id").alias("incoming"), b(at(-2), at(-1)).alias("b_in"))
    out = segments.select("area_id", F.col("from_node").alias("node_id"), F.col("segment_id").alias("outgoing"), b(at(1), at(2)).alias("b_out"))
    j = inc.join(out, ["area_id", "node_id"])
    return j.select("area_id", "node_id", "incoming", "outgoing", geo.turn_kind("b_in", "b_out").alias("movement"))


def resolve_restrictions(restrictions: DataFrame, segments: DataFrame) -> DataFrame:
    """Restrictions with the one incoming and one outgoing segment they mean; ``resolved`` is false when either is not
    exactly one."""
    inc = segments.groupBy("area_id", F.col("road_id").alias("from_way"), F.col("to_node").alias("via_node")).agg(
        F.count("*").alias("n_in"), F.min("segment_id").alias("incoming")
    )
    out = segments.groupBy("area_id", F.col("road_id").alias("to_way"), F.col("from_node").alias("via_node")).agg(
        F.count("*").alias("n_out"), F.min("segment_id").alias("outgoing")
    )
    j = restrictions.join(inc, ["area_id", "from_way", "via_node"], "left").join(out, ["area_id", "to_way", "via_node"], "left")
    ok = F.coalesce((F.col("n_in") == 1) & (F.col("n_out") == 1), F.lit(False))
    return j.select(
        "area_id", "source_id", "element_pos", "kind", "via_node", F.when(ok, F.col("incoming")).alias("incoming"),
        F.when(ok, F.col("outgoing")).alias("outgoing"), ok.alias("resolved"),
    )


def apply_restrictions(turns: DataFrame, resolved: DataFrame) -> DataFrame:
    """Allowed flag and restriction kind per turn; restrictions apply in payload order and the last effect on a turn wins.

    ``no_*`` forbids its pair. ``only_*`` allows its pair and forbids the other exits of the same incoming segment."""
    r = resolved.filter("resolved").select("area_id", "incoming", F.col("outgoing").alias("target"), "element_pos", "kind")
    only = F.col("kind").startswith("only_")
    direct = r.select("area_id", "incoming", F.col("target").alias("outgoing"), "element_pos", "kind", only.alias("allowed"))
    others = r.filter(only).join(turns.select("area_id", "incoming", "outgoing"), ["area_id", "incoming"]).filter("outgoing <> target")
    others = others.select("area_id", "incoming", "outgoing", "element_pos", "kind", F.lit(False).alias("allowed"))
    last = direct.unionByName(others).groupBy("area_id", "incoming", "outgoing").agg(F.max_by(F.struct("allowed", "kind"), "element_pos").alias("e"))
    return turns.join(last, ["area_id", "incoming", "outgoing"], "left").select(
        *turns.columns, F.coalesce("e.allowed", F.lit(True)).alias("allowed"), F.coalesce("e.kind", F.lit("none")).alias("restriction")
    )


def check_turns(turns: DataFrame, segments: DataFrame) -> DataFrame:
    """Turns whose incoming segment does not end, or whose outgoing one does not start, at their node."""
    ends = segments.select("area_id", F.col("segment_id").alias("incoming"), F.col("to_node").alias("_end"))
    starts = segments.select("area_id", F.col("segment_id").alias("outgoing"), F.col("from_node").alias("_start"))
    j = turns.join(ends, ["area_id", "incoming"], "left").join(starts, ["area_id", "outgoing"], "left")
    bad = ~F.coalesce((F.col("_end") == F.col("node_id")) & (F.col("_start") == F.col("node_id")), F.lit(False))
    return j.filter(bad).select(*turns.columns)


def legal_exits(turns: DataFrame) -> DataFrame:
    """Allowed (incoming, outgoing) pairs."""
    return turns.filter("allowed").select("area_id", "incoming", "outgoing")


def legal_graph(segments: DataFrame, turns: DataFrame, accessible: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, successors): accessible segments, and allowed turns between two of them."""
    edges = segments.filter(accessible) if accessible else segments
    ids = edges.select("area_id", "segment_id")
    succ = legal_exits(turns)
    if accessible:
        for c in ("incoming", "outgoing"):
            succ = succ.join(ids.withColumnRenamed("segment_id", c), ["area_id", c], "left_semi")
    return edges, succ


def with_street(segments: DataFrame, street_of_way: DataFrame) -> DataFrame:
    """Segments with their road's street attributes (inner)."""
    return segments.join(street_of_way.withColumnRenamed("source_id", "road_id"), ["area_id", "road_id"])


def with_endpoints(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Ids of the given nodes plus both ends of the given segments, so a filtered network stays routable."""
    ends = segments.select("area_id", F.explode(F.array("from_node", "to_node")).alias("node_id"))
    return nodes.select("area_id", "node_id").unionByName(ends).distinct()
