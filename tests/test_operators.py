"""Operators against small hand-made cases and brute force."""

import json
import math
import random
import uuid

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geo, ids, tags
from terrafold.operators import buildable, graph, ingest, mapdata, network, planar, raster, scan, spatial
from terrafold.sources import geojson, layers, osm
from terrafold.streaming import imports


def one(df):
    return df.collect()[0]


def ring_df(spark, rows, key="key"):
    """rows: (key, side, [(x, y), ...])"""
    return spark.createDataFrame(
        [(k, s, [{"x": float(x), "y": float(y)} for x, y in r]) for k, s, r in rows], "key string, side string, ring array<struct<x:double,y:double>>"
    )


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def test_stable_unit_vectors(spark):
    df = spark.createDataFrame([("a",), ("way/123",), ("é:1.0",), ("",)], "s string").select(ids.stable_unit("s").alias("u"))
    u = [r.u for r in df.collect()]
    assert u[0] == 444641715 / 2**32 and u[1] == 1071952468 / 2**32

    def slow(text):
        h = 0x811C9DC5
        for b in text.encode():
            h = ((h ^ b) * 0x01000193) % 2**32
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = ((h ^ (h >> shift)) * factor) % 2**32
        return (h ^ (h >> 16)) / 2**32

    assert u[2] == slow("é:1.0") and u[3] == slow("")


def test_uuid5_is_rfc4122(spark):
    names = ["x", "T1:a+b", "ü"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", ids.uuid5(ids.BLOCK_NAMESPACE, "n").alias("u"))
    for r in df.collect():
        assert r.u == str(uuid.uuid5(uuid.UUID(ids.BLOCK_NAMESPACE), r.n))


@pytest.mark.parametrize(
    "text,metres", [("12", 12.0), ("12.5 m", 12.5), ("12,5", 12.5), ("40 ft", 12.192), ("40'", 12.192), ("abc", None), ("0", None), ("-3", None), ("1e3", None), ("12 mm", None)]
)
def test_height_texts(spark, text, metres):
    got = one(spark.createDataFrame([(text,)], "t string").select(tags.height_meters("t").alias("h"))).h
    assert got == metres if metres is None else got == pytest.approx(metres)


def test_scans_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"g{rng.randrange(20)}", i, float(rng.randrange(100)), float(rng.randrange(100))) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, v double, e double")
    got = scan.prefix_scan(df, ["g"], ["v", "i"], number="n", sums={"s": "e"}, maxes={"m": "e"}, previous_max={"p": "e"})
    w = W.partitionBy("g").orderBy("v", "i")
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("n"), F.sum("e").over(w).alias("s"), F.max("e").over(w).alias("m"), F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("p"))
    assert sorted(map(tuple, got.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    q = {r.g: (r.v_median, r.v_iqr) for r in scan.spread(df, ["g"], "v", "v").collect()}
    import statistics

    for g in {r[0] for r in rows}:
        vs = [r[2] for r in rows if r[0] == g]
        a, _, c = statistics.quantiles(vs, n=4, method="inclusive")
        assert q[g] == (pytest.approx(statistics.median(vs)), pytest.approx(c - a))


def test_components_brute_force(spark):
    rng = random.Random(3)
    n = 300
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(220)] + [(i, i + 1) for i in range(200, 260)]
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    v = spark.createDataFrame([(f"{i:04d}",) for i in range(n)], "id string")
    e = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in pairs], "a string, b string")
    got = {r.id: r.component for r in graph.connected_components(v, e).collect()}
    assert got == {f"{i:04d}": f"{find(i):04d}" for i in range(n)}


def test_streets_join_by_name_node_and_carriageway(spark):
    def way(i, name, nodes, pts, direction=0, cls="residential"):
        return ("A", i, name, cls, nodes, direction, [{"x": float(x), "y": float(y)} for x, y in pts])

    ways = [
        way("1", "Main  St", ["a", "b"], [(0, 0), (0.001, 0)]), way("2", "main st", ["b", "c"], [(0.001, 0), (0.002, 0)], cls="tertiary"),
        way("3", "Ring", ["d", "e"], [(0, 0.01), (0.002, 0.01)], 1), way("4", "ring", ["f", "g"], [(0.002, 0.01015), (0, 0.01015)], 1),
        way("5", None, ["a", "d"], [(0, 0), (0, 0.01)]), way("6", None, ["d", "h"], [(0, 0.01), (0, 0.02)]),
    ]
    df = spark.createDataFrame(ways, "area_id string, source_id string, name string, class string, nodes array<string>, direction int, line array<struct<x:double,y:double>>")
    s = {r.street_key: (r["class"], r["name"]) for r in graph.streets(df, graph.group_streets(df)).collect()}
    assert set(s) == {"1+2", "3+4", "5", "6"}
    assert s["1+2"] == ("tertiary", "Main  St")


def routing_case(spark):
    """A straight pair a-b-c and a detour a-d-e-c, all two-way."""
    pos = {"a": (0, 0), "b": (0.001, 0), "c": (0.002, 0), "d": (0, 0.001), "e": (0.002, 0.001)}
    roads = [("w1", "ab"), ("w2", "bc"), ("w3", "ad"), ("w4", "de"), ("w5", "ec")]
    nodes = spark.createDataFrame([("A", k, float(y), float(x)) for k, (x, y) in pos.items()], "area_id string, node_id string, lat double, lon double")
    r = spark.createDataFrame([("A", i, w, list(n), "residential", 0, None, None) for i, (w, n) in enumerate(roads)],
                              "area_id string, element_pos bigint, source_id string, nodes array<string>, class string, direction int, forward_lanes int, backward_lanes int")
    seg = network.segmentize(r, network.navigable_nodes(r), nodes)
    return seg, network.turn_candidates(seg)


def run_routes(spark, seg, turns):
    od = spark.createDataFrame([("1", "A", "a", "c"), ("2", "A", "a", "a")], "od_id string, area_id string, origin string, destination string")
    answers, tree = graph.shortest_paths(seg, network.legal_exits(turns), od)
    hops = {r.od_id: r.n for r in graph.reconstruct(answers, tree).groupBy("od_id").agg(F.count("*").alias("n")).collect()}
    return {r.od_id: (r.status, r.total_m) for r in answers.collect()}, hops


def test_routes_follow_restrictions(spark):
    seg, turns = routing_case(spark)
    free = turns.withColumn("allowed", F.lit(True))
    answers, hops = run_routes(spark, seg, free)
    assert hops == {"1": 2} and answers["2"] == ("ok", 0.0) and answers["1"][1] == pytest.approx(2 * geo.METERS_PER_DEGREE * 0.001, rel=1e-6)
    no = spark.createDataFrame([("A", "r", 1, "no_straight_on", "w1", "b", "w2")], "area_id string, source_id string, element_pos bigint, kind string, from_way string, via_node string, to_way string")
    barred = network.apply_restrictions(turns, network.resolve_restrictions(no, seg))
    answers, hops = run_routes(spark, seg, barred)
    # Straight on at b is forbidden: three edges of detour (or a turn back), never the direct pair.
    assert answers["1"][0] == "ok" and hops["1"] >= 3
    shut = free.withColumn("allowed", ~F.col("outgoing").endswith(">c"))
    answers, hops = run_routes(spark, seg, shut)
    assert answers["1"] == ("no_route", None)


def test_block_loop_with_house_and_dead_end(spark):
    pts = {"a": (0.001, 0.001), "b": (0.003, 0.001), "c": (0.003, 0.003), "d": (0.001, 0.003), "x": (0.002, 0.002)}
    line = lambda *n: [{"x": pts[i][0], "y": pts[i][1]} for i in n]
    segs = [("A", "s1", line("a", "b")), ("A", "s2", line("b", "c")), ("A", "s3", line("c", "d")), ("A", "s4", line("d", "a")), ("A", "s4r", line("a", "d")), ("A", "dead", line("a", "x"))]
    seg = spark.createDataFrame(segs, "area_id string, segment_id string, line array<struct<x:double,y:double>>")
    area = spark.createDataFrame([("A", 0.0, 0.0, 0.004, 0.004)], "area_id string, min_lat double, min_lon double, max_lat double, max_lon double")
    blocks, members = planar.derive_blocks(seg, area)
    b = planar.identify(blocks, members).collect()
    # The ground around the loop is clipped but no road leaves the box, so only the loop is a block.
    assert len(b) == 1 and not b[0].is_clipped and b[0].segment_key == "dead,s1,s2,s3,s4,s4r"
    assert b[0].area_m2 == pytest.approx((0.002 * geo.METERS_PER_DEGREE) ** 2, rel=1e-4)
    house = spark.createDataFrame([("A", "h", [{"x": x / 1e4, "y": y / 1e4} for x, y in square(12, 22, 2)]), ("A", "out", [{"x": x / 1e4, "y": y / 1e4} for x, y in square(29, 22, 2)])],
                                  "area_id string, source_id string, ring array<struct<x:double,y:double>>")
    links = buildable.link_buildings(house, planar.identify(blocks, members)).collect()
    assert [r.source_id for r in links] == ["h"]


def test_crossing_roads_without_shared_node_and_island(spark):
    l = lambda *p: [{"x": x, "y": y} for x, y in p]
    segs = [("A", "h", l((-0.001, 0.002), (0.005, 0.002))), ("A", "v", l((0.002, -0.001), (0.002, 0.005)))]
    segs += [("A", f"i{k}", l(p, q)) for k, (p, q) in enumerate(zip(square(0.0005, 0.0005, 0.001)[:-1], square(0.0005, 0.0005, 0.001)[1:]))]
    seg = spark.createDataFrame(segs, "area_id string, segment_id string, line array<struct<x:double,y:double>>")
    area = spark.createDataFrame([("A", 0.0, 0.0, 0.004, 0.004)], "area_id string, min_lat double, min_lon double, max_lat double, max_lon double")
    blocks, members = planar.derive_blocks(seg, area)
    rows = sorted((round(r.area_m2 / (0.001 * geo.METERS_PER_DEGREE) ** 2, 3), r.is_clipped) for r in blocks.collect())
    # Four quarters of the box; one of them holds the island, whose own block is the fifth.
    assert rows == [(1.0, False), (3.0, True), (4.0, True), (4.0, True), (4.0, True)]
    sets = {r.s for r in members.groupBy("face").agg(F.array_join(F.array_sort(F.collect_list("segment_id")), ",").alias("s")).collect()}
    assert sets == {"i0,i1,i2,i3", "h,i0,i1,i2,i3,v", "h,v"}


@pytest.mark.parametrize("how,area", [("union", 7.0), ("intersection", 1.0), ("difference", 3.0)])
def test_overlay_of_squares(spark, how, area):
    parts = planar.overlay(ring_df(spark, [("k", "a", square(0, 0, 2)), ("k", "b", square(1, 1, 2))]), how, 1.0).collect()
    assert len(parts) == 1 and parts[0].area == pytest.approx(area)


def test_overlay_with_hole_and_outline(spark):
    shapes = ring_df(spark, [("k", "a", square(0, 0, 4)), ("k", "b", square(1, 1, 1)), ("k", "a", square(10, 0, 1))])
    parts = planar.overlay(shapes, "difference", 1.0)
    got = sorted((r.hole, round(r.area, 6)) for r in parts.collect())
    assert got == [(False, 1.0), (False, 16.0), (True, 1.0)]
    best = one(planar.outline_of(parts))
    assert best.dropped_parts == 1 and best.filled_holes and len(best.ring) == 5


def test_nearest_brute_force(spark):
    rng = random.Random(9)
    pts = [(f"n{i}", 10 + rng.random() * 0.3, -84 + rng.random() * 0.3) for i in range(60)]
    qs = [(f"q{i}", 10 + rng.random() * 0.3, -84 + rng.random() * 0.3) for i in range(40)]
    got = spatial.nearest(spark.createDataFrame(qs, "query_id string, q_lat double, q_lon double"), spark.createDataFrame(pts, "node_id string, lat double, lon double"), "node_id", start_m=50.0)

    def hav(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371000 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    want = {q[0]: min(pts, key=lambda p: hav(q[1], q[2], p[1], p[2]))[0] for q in qs}
    assert {r.query_id: r.nearest_id for r in got.collect()} == want


def test_payload_files_layers_and_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    node = lambda i, lat, lon: {"type": "node", "id": i, "lat": lat, "lon": lon}
    house = [node(1, 0.0, 0.0), node(2, 0.0, 0.001), node(3, 0.001, 0.001), node(4, 0.001, 0.0), {"type": "way", "id": 9, "nodes": [1, 2, 3, 4, 1], "tags": {"building": "yes", "height": "9 m"}}]
    (src / "A.json").write_text(json.dumps({"elements": house}))
    (src / "B.json").write_text(json.dumps({"remark": "timed out", "elements": []}))
    complete, rejected = osm.complete_payloads(osm.read_osm(spark, str(src)))
    assert [r.area_id for r in complete.collect()] == ["A"] and [r.area_id for r in rejected.collect()] == ["B"]
    parts = osm.split_elements(osm.explode_elements(complete))
    assert parts["nodes"].count() == 4 and parts["ways"].count() == 1
    for _ in range(2):
        imports.start_import(imports.payload_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / f"cp{_}")).awaitTermination()
    b = layers.read_layer(spark, str(tmp_path / "out" / "buildings"), ["A"]).collect()
    assert len(b) == 1 and b[0].height_meters == 9.0 and len(b[0].line) == 5
    stages = {(r.stage, r.n) for r in spark.read.parquet(str(tmp_path / "out" / "stages")).collect()}
    assert stages == {("fetched", 5), ("building", 1)}


def test_feedback_stream_equals_batch(spark, tmp_path):
    rows = [(f"P{i % 7}", i, False, i * 10) for i in range(50)]
    schema = "block_id string, building_count int, no_buildings boolean, updated_at bigint"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "fb"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "fb"))
    imports.start_feedback(stream, str(tmp_path / "cp"), "fb_out").awaitTermination()
    batch = imports.newest_feedback(spark.read.parquet(str(tmp_path / "fb")))
    assert sorted(map(tuple, spark.table("fb_out").collect())) == sorted(map(tuple, batch.collect()))


def test_geojson_features_are_json(spark):
    df = spark.createDataFrame([("A", "1", 'Bar "x"', {"x": 1.5, "y": 2.5})], "area_id string, id string, name string, p struct<x:double,y:double>").withColumn("category", F.lit("other"))
    f = json.loads(one(geojson.to_features(df, "pois", "Point", "p", "id")).feature)
    assert f["geometry"] == {"type": "Point", "coordinates": [1.5, 2.5]} and f["properties"] == {"category": "other", "name": 'Bar "x"', "area_id": "A"}


def test_simplify_keeps_what_sticks_out(spark):
    line = [{"x": float(x), "y": float(y)} for x, y in [(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 0), (5, 0)]]
    out = one(mapdata.simplify(spark.createDataFrame([(line,)], "line array<struct<x:double,y:double>>"), 0.5)).line
    assert [(p.x, p.y) for p in out] == [(0, 0), (2, -0.1), (3, 5), (4, 0), (5, 0)]


def test_despike_replaces_a_lone_pit(spark):
    rows = [("A", r, c, 5, 5, 0.0, 0.0, 0.1, 0.1, -300.0 if (r, c) == (2, 2) else float(r)) for r in range(5) for c in range(5)]
    df = spark.createDataFrame(rows, "area_id string, row int, col int, rows int, cols int, origin_lat double, origin_lon double, lat_step double, lon_step double, height double")
    out = {(r.row, r.col): r.height for r in raster.despike(df).collect()}
    assert out[(2, 2)] == 2.0 and out[(0, 0)] == 0.0


def test_lines_that_leave_and_return_are_cut_in_parts(spark):
    line = [{"x": float(x), "y": float(y)} for x, y in [(1, 1), (3, 1), (3, 1.5), (1, 1.5), (0.5, 1.5)]]
    l = spark.createDataFrame([("A", "s", line)], "area_id string, segment_id string, line array<struct<x:double,y:double>>")
    a = spark.createDataFrame([("A", 0.0, 0.0, 2.0, 2.0)], "area_id string, min_lat double, min_lon double, max_lat double, max_lon double")
    parts = [[(p.x, p.y) for p in r.line] for r in mapdata.clip_lines_to_box(l, a, "segment_id").orderBy("part").collect()]
    assert parts == [[(1, 1), (2, 1)], [(2, 1.5), (1, 1.5), (0.5, 1.5)]]


def test_broken_features_are_set_aside(spark):
    ways = spark.createDataFrame([("A", 1, "w", ["1", "2", "1"], None, {"building": "yes"}), ("A", 2, "r", ["1"], None, {"highway": "service"})],
                                 "area_id string, element_pos bigint, way_id string, nodes array<string>, geometry array<struct<lat:double,lon:double>>, tags map<string,string>")
    c = ingest.classify_ways(ways)
    assert [r.source_id for r in ingest.skipped_features(c).collect()] == ["w"]
    assert one(ingest.roads(c)).problem == "needs at least two nodes"
