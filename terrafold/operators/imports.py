"""A batch of payloads as one import: checked whole, written to all layers at once, reported per area."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import ingest, network
from terrafold.session import settle
from terrafold.sources import osm, versions

LAYERS = ("nodes", "roads", "segments", "buildings", "pois", "areas", "restrictions")


def features(payloads: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(rows of every layer, ``rejected_features``) of complete payloads.

    ``rejected_features`` is ``area_id, ref, problem``: nodes without valid coordinates, roads that break a rule, and features that
    refer to nodes which are not there."""
    parts = osm.split_elements(settle(osm.explode_elements(payloads)))
    ways = settle(ingest.classify_ways(parts["ways"]))
    given = settle(osm.fill_way_nodes(parts["nodes"], parts["ways"]))
    roads = settle(ingest.roads(ways))
    of_relations, areas_of_relations, vertices = ingest.relation_features(parts["relations"], parts["ways"], given)
    buildings = settle(ingest.buildings(ways).unionByName(of_relations))
    areas = settle(ingest.area_features(ways).unionByName(areas_of_relations))
    nodes = settle(given.unionByName(vertices))
    good = roads.filter("problem IS NULL").drop("problem")
    restrictions = ingest.resolvable_restrictions(ingest.restrictions(parts["relations"]), good, given)
    navigable = settle(network.navigable_nodes(good, restrictions))
    layers = {
        "nodes": given.join(navigable.select("area_id", "node_id").distinct(), ["area_id", "node_id"], "left_semi"),
        "roads": ingest.resolve_geometry(good, given),
        "segments": network.segmentize(good, navigable, given),
        "buildings": ingest.resolve_geometry(buildings, nodes),
        "pois": ingest.pois(ways, parts["nodes"], given),
        "areas": ingest.resolve_geometry(areas, nodes),
        "restrictions": restrictions,
    }
    poi_ways = ways.filter("role = 'poi'").select("area_id", F.col("way_id").alias("source_id"), "nodes")
    referring = reduce(DataFrame.unionByName, [f.select("area_id", "source_id", "nodes") for f in (roads, buildings, areas, poi_ways)])
    way = lambda df, problem: df.select("area_id", F.concat(F.lit("way/"), "source_id").alias("ref"), problem.alias("problem"))
    rejected = [
        parts["problems"].select("area_id", F.concat(F.lit("node/"), "ref").alias("ref"), "problem"),
        way(roads.filter("problem IS NOT NULL"), F.col("problem")),
        way(ingest.unresolved(referring, nodes), F.concat("missing", F.lit(" missing node(s)"))),
    ]
    return layers, reduce(DataFrame.unionByName, rejected)


def import_run(payloads: DataFrame, root: str, change_id: str) -> DataFrame:
    """``area_id, status, problem`` and the number of rows per layer: what became of each area of ``payloads`` (``area_id, remark, elements``).

    A payload with any problem is rejected whole and its area stays as it was (status ``failed``; ``problem`` is the first one by reference).
    The others replace their areas in all layers at once (``imported``); an area that has no rows in a layer any more loses those it
    had. Of several payloads of an area the newest counts if they have ``arrived`` and ``file`` (``osm.newest_payloads``). Payloads
    without an area are left out. Repeating a ``change_id`` writes nothing."""
    batch = settle(osm.newest_payloads(payloads.filter("area_id IS NOT NULL")))
    complete, incomplete = osm.complete_payloads(batch)
    layers, rejected = features(complete)
    rejected = settle(rejected)
    first = rejected.groupBy("area_id").agg(F.min_by(F.concat_ws(": ", "ref", "problem"), F.struct("ref", "problem")).alias("problem"))
    failed = settle(first.unionByName(incomplete.select("area_id", F.col("reason").alias("problem"))))
    accepted = settle(complete.select("area_id").distinct().join(failed, "area_id", "left_anti"))
    layers = {name: settle(rows.join(accepted, "area_id", "left_semi")) for name, rows in layers.items()}
    versions.change(root, change_id, layers, accepted)
    counted = reduce(DataFrame.unionByName, [rows.groupBy("area_id").agg(F.count(F.lit(1)).alias("n")).withColumn("layer", F.lit(name)) for name, rows in layers.items()])
    wide = counted.groupBy("area_id").pivot("layer", list(LAYERS)).agg(F.sum("n"))
    out = accepted.withColumn("problem", F.lit(None).cast("string")).unionByName(failed).join(wide, "area_id", "left")
    status = F.when(F.col("problem").isNull(), "imported").otherwise("failed")
    return out.select("area_id", status.alias("status"), "problem", *(F.coalesce(name, F.lit(0)).alias(name) for name in LAYERS))
