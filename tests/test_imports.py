"""One import over all layers: accepted and rejected payloads, emptied areas, replays, and the stream that does the same."""

import json
import os

from terrafold.operators.imports import LAYERS, import_run
from terrafold.sources import osm, versions
from terrafold.streaming import imports


def node(i, lat, lon, **tags):
    return {"type": "node", "id": str(i), "lat": lat, "lon": lon, **({"tags": tags} if tags else {})}


def way(i, nodes, **tags):
    return {"type": "way", "id": str(i), "nodes": [str(n) for n in nodes], "tags": tags}


CORNERS = [node(1, 0.0, 0.0), node(2, 0.0, 0.001), node(3, 0.001, 0.001), node(4, 0.001, 0.0)]
TOWN = [*CORNERS, node(5, 0.0005, 0.0005, amenity="cafe", name="X"), way(10, [1, 2, 3], highway="residential"), way(11, [3, 4], highway="residential"), way(12, [1, 2, 3, 4, 1], building="yes")]
COUNTS = {"nodes": 3, "roads": 2, "segments": 4, "buildings": 1, "pois": 1, "areas": 0, "restrictions": 0}


def payloads(spark, tmp_path, name, files):
    folder = tmp_path / name
    folder.mkdir()
    for file, elements, at in files:
        path = folder / file
        path.write_text(json.dumps(elements if isinstance(elements, dict) else {"elements": elements}))
        os.utime(path, (at, at))
    return str(folder)


def state(spark, root):
    out = {}
    for name in LAYERS:
        for r in versions.read(spark, root, name).groupBy("area_id").count().collect():
            out[r.area_id, name] = r["count"]
    return out


def expected(area):
    return {(area, k): n for k, n in COUNTS.items() if n}


def test_import_run(spark, tmp_path):
    root = str(tmp_path / "root")
    lost = [*CORNERS, way(10, [1, 99], highway="residential")]
    first = payloads(spark, tmp_path, "a", [("A.json", TOWN, 1), ("B.json", TOWN, 1), ("C.json", {"remark": "timed out", "elements": []}, 1), ("D.json", lost, 1)])
    report = {r.area_id: r for r in import_run(osm.read_osm(spark, first), root, "1").collect()}
    assert {a: r.status for a, r in report.items()} == {"A": "imported", "B": "imported", "C": "failed", "D": "failed"}
    assert {k: report["A"][k] for k in LAYERS} == COUNTS
    assert report["C"].problem == "incomplete: timed out" and report["D"].problem == "way/10: 1 missing node(s)"
    assert state(spark, root) == {**expected("A"), **expected("B")}
    # B is empty now, A is rejected and stays as it was.
    second = payloads(spark, tmp_path, "b", [("A.json", lost, 2), ("B.json", [], 2)])
    assert {r.area_id: r.status for r in import_run(osm.read_osm(spark, second), root, "2").collect()} == {"A": "failed", "B": "imported"}
    assert state(spark, root) == expected("A")
    # A change that is known already writes nothing; one without its log entry isn't seen.
    import_run(osm.read_osm(spark, first), root, "2").collect()
    versions.read(spark, root, "pois").write.parquet(f"{root}/pois/version=99")
    assert state(spark, root) == expected("A")


def test_import_stream(spark, tmp_path):
    root = str(tmp_path / "root")
    folder = payloads(spark, tmp_path, "a", [("A.1.json", [], 100), ("A.2.json", TOWN, 200), ("B.1.json", TOWN, 200), ("B.2.json", [], 100)])
    for k in range(2):
        imports.start_import_run(imports.payload_stream(spark, folder), root, str(tmp_path / f"cp{k}"), "s").awaitTermination()
    assert state(spark, root) == {**expected("A"), **expected("B")}
    assert {(r.area_id, r.status) for r in spark.read.parquet(f"{root}/reports").collect()} == {("A", "imported"), ("B", "imported")}


def test_feedback_table_equals_batch(spark, tmp_path):
    schema = "block_id string, building_count int, no_buildings boolean, updated_at bigint"
    source, root = str(tmp_path / "fb"), str(tmp_path / "root")
    for part in range(2):
        rows = [(f"P{i % (7 - 3 * part)}", i, False, i * 10) for i in range(part * 50, part * 50 + 50)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        imports.start_feedback_table(stream, root, str(tmp_path / "cp"), "f").awaitTermination()
    want = imports.newest_feedback(spark.read.parquet(source)).collect()
    got = versions.read(spark, root, "feedback", "block_id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 7
