"""Re-import, missing nodes, repeated points, rounds that run out, and the antimeridian, on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import graph, ingest, network, raster, reconcile, spatial
from terrafold.sources import geojson, layers


def test_an_emptied_area_loses_its_rows(spark):
    old = spark.createDataFrame([("1", "A", "a", 1), ("2", "A", "b", 1), ("3", "B", "c", 1), ("4", "C", "d", 1)], "id string, area_id string, source_id string, v int")
    new = spark.createDataFrame([("B", "c", 2), ("B", "e", 2)], "area_id string, source_id string, v int")
    areas = spark.createDataFrame([("A",), ("B",)], "area_id string")
    out = reconcile.upsert(old, new, ["area_id", "source_id"], areas=areas).collect()
    assert sorted((r.area_id, r.source_id, r.v) for r in out) == [("B", "c", 2), ("B", "e", 2), ("C", "d", 1)]
    assert {r.source_id: r.id for r in out}["c"] == "3"
    counts = {r.area_id: (r.created, r.updated, r.removed) for r in reconcile.changes(old, new, ["area_id", "source_id"], areas).collect()}
    assert counts == {"A": (0, 0, 2), "B": (1, 1, 0)}
    assert reconcile.upsert(old, new, ["area_id", "source_id"]).filter("area_id = 'A'").count() == 2


def test_an_emptied_area_loses_its_folder(spark, tmp_path):
    path = str(tmp_path / "layer")
    schema = "area_id string, v int"
    layers.write_layer(spark.createDataFrame([("A b", 1), ("B", 1), ("C", 1)], schema), path)
    layers.write_layer(spark.createDataFrame([("B", 2)], schema), path, spark.createDataFrame([("A b",), ("B",)], "area_id string"))
    assert sorted(tuple(r) for r in layers.read_layer(spark, path).select("area_id", "v").collect()) == [("B", 2), ("C", 1)]


def test_a_missing_node_leaves_the_feature_out(spark):
    nodes = spark.createDataFrame([("A", str(i), 0.0, 0.001 * i) for i in range(3)], "area_id string, node_id string, lat double, lon double")
    roads = spark.createDataFrame([("A", "w1", ["0", "1", "2"], "residential", 0, 1, 1), ("A", "w2", ["0", "9", "2"], "residential", 0, 1, 1)], "area_id string, source_id string, nodes array<string>, class string, direction int, forward_lanes int, backward_lanes int")
    assert [r.source_id for r in ingest.resolve_geometry(roads, nodes).collect()] == ["w1"]
    assert [(r.source_id, r.missing) for r in ingest.unresolved(roads, nodes).collect()] == [("w2", 1)]
    assert {r.road_id for r in network.segmentize(roads, network.navigable_nodes(roads), nodes).collect()} == {"w1"}


def test_equal_points_are_resampled_each(spark):
    points = spark.createDataFrame([(10.0, 20.0), (10.0, 20.0)], "lat double, lon double")
    p = geo.mercator_pixel("lat", "lon")
    corner = points.select(F.floor(p["x"] - 0.5).alias("x"), F.floor(p["y"] - 0.5).alias("y")).first()
    pixels = spark.createDataFrame([(corner.x + a, corner.y + b, 10.0) for a in (0, 1) for b in (0, 1)], "px long, py long, height double")
    assert [round(r.height, 9) for r in raster.resample(points, pixels).collect()] == [10.0, 10.0]


def chain(spark, hops):
    edges = spark.createDataFrame([("A", f"e{i}", f"n{i}", f"n{i + 1}", 1.0) for i in range(hops)], "area_id string, segment_id string, from_node string, to_node string, distance_m double")
    turns = spark.createDataFrame([("A", f"e{i}", f"e{i + 1}") for i in range(hops - 1)], "area_id string, incoming string, outgoing string")
    od = spark.createDataFrame([("r", "A", "n0", f"n{hops}")], "od_id string, area_id string, origin string, destination string")
    return edges, turns, od


def test_routes_raise_when_rounds_run_out(spark):
    edges, turns, od = chain(spark, 30)
    with pytest.raises(RuntimeError):
        graph.shortest_paths(edges, turns, od, max_rounds=2, arcs=graph.contract(edges, turns, max_rounds=0))


def test_walk_back_by_doubling(spark):
    tree = spark.createDataFrame([("r", f"e{i}", float(i), f"e{i - 1}" if i else None) for i in range(37)] + [("s", "x", 0.0, None)], "od_id string, edge string, d double, prev string")
    answers = spark.createDataFrame([("r", "e36"), ("s", "x"), ("t", None)], "od_id string, last_edge string")
    hops = sorted((r.od_id, r.hop, r.edge) for r in graph.reconstruct(answers, tree).collect())
    assert hops == [("r", i + 1, f"e{i}") for i in range(37)] + [("s", 1, "x")]


def test_nearest_over_the_antimeridian(spark):
    q = spark.createDataFrame([("q", 10.0, 179.9999)], "query_id string, q_lat double, q_lon double")
    t = spark.createDataFrame([("near", 10.0, -179.9999), ("far", 10.0, 179.99)], "t string, lat double, lon double")
    assert spatial.nearest(q, t, "t").first().nearest_id == "near"


def test_feature_ids_are_escaped(spark):
    df = spark.createDataFrame([("A", 'n"1\\', 1.0, 2.0)], "area_id string, node_id string, x double, y double").withColumn("p", geo.point("x", "y"))
    text = geojson.to_features(df, "navigable_nodes", "Point", "p", "node_id").first().feature
    assert json.loads(text)["id"] == 'n"1\\'
