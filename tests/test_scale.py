"""Steps that must stay spread over tasks: their plans, and their rows against brute force."""

import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import blocks, compose, raster, spatial
from terrafold.plans.views import Views
from terrafold.session import settle

SAMPLE = "block_id string, ring_index int, idx int, x double, y double, nx double, ny double"
FOOT = "block_id string, building_id string, ring array<struct<x:double,y:double>>"


def meters(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(a))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def first_hit(s, feet):
    """(distance, id) of the first footprint a sample's ray meets."""
    block, ring_index, _, x, y, nx, ny = s
    found = []
    if None in (block, ring_index, x):
        return None, None
    for b, name, ring in feet:
        if b != block:
            continue
        rx, ry, inside, d = nx * 25.0, ny * 25.0, False, math.inf
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            dx, dy = bx - ax, by - ay
            det = rx * dy - ry * dx
            if det:
                u, w = ((ax - x) * dy - (ay - y) * dx) / det, ((ax - x) * ry - (ay - y) * rx) / det
                if 0 <= u <= 1 and 0 <= w <= 1:
                    d = min(d, u * 25.0)
            if (ay > y) != (by > y) and x < ax + (y - ay) / dy * dx:
                inside = not inside
        d = 0.0 if inside else d
        if d < math.inf:
            found.append((d, name is not None, name))
    return (min(found)[0], min(found)[2]) if found else (None, None)


def test_ray_hits_meet_in_tiles_and_equal_brute_force(spark):
    r = random.Random(5)
    samples, feet = [], []
    for i in range(300):
        t = r.uniform(0, 2 * math.pi)
        samples.append((r.choice("ab"), 0, i, r.uniform(-300, 300), r.uniform(-20, 20), math.cos(t), math.sin(t)))
    samples += [(None, 0, 900, 0.0, 0.0, 1.0, 0.0), ("a", None, 901, 0.0, 0.0, 1.0, 0.0), ("a", 0, 902, None, 0.0, 1.0, 0.0), ("c", 0, 903, 0.0, 0.0, 1.0, 0.0), ("a", 0, 904, 249.0, 0.0, 1.0, 0.0)]
    for i in range(120):
        x, y, h, w = r.uniform(-310, 310), r.uniform(-25, 25), r.uniform(1, 9), r.uniform(1, 30)
        ring = [(x, y), (x + w, y), (x + w, y + h), (x, y), (x, y)] if i % 3 else [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        feet.append((r.choice("ab"), f"h{i:03d}", ring))
    feet += [(*f[:1], "h000" if i % 2 else None, f[2]) for i, f in enumerate(feet[:8])] + [(None, "n", feet[0][2]), ("a", "dot", [(249.5, 0.0)]), ("d", "far", [])]
    df = spark.createDataFrame(samples, SAMPLE)
    houses = spark.createDataFrame([(b, i, [{"x": x, "y": y} for x, y in ring]) for b, i, ring in feet], FOOT)
    hits = blocks.ray_hits(df, houses)
    steps = plan(hits)
    got = {r.idx: (r.hit_m, r.building_id) for r in hits.collect()}
    assert len(got) == len(samples)
    for s in samples:
        d, name = first_hit(s, feet)
        assert (got[s[2]][0] is None) == (d is None) and (d is None or abs(got[s[2]][0] - d) < 1e-9) and got[s[2]][1] == name, s
    # Samples are dealt to tiles once: no join of samples with footprints, no second one to bring the best back.
    assert "Join" not in steps and steps.count("Exchange hash") == 2


def test_views_deal_the_rows_of_a_small_file_to_many_tasks(spark, tmp_path):
    spark.range(1000).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey", "'X' AS c_mktsegment").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    v = Views(spark, str(tmp_path))
    assert v.plot.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and v.plot.count() == 1000


def test_resample_sends_no_pixel_table_whole(spark):
    points = spark.range(50).selectExpr("concat('p', id) AS node_id", "10.0 + id * 1e-5 AS lat", "20.0 + id * 1e-5 AS lon")
    pixels = spark.range(10).selectExpr("explode(sequence(0, 100)) AS px", "id AS py", "1.0D AS height")
    out = raster.resample(points, pixels)
    assert "Broadcast" not in plan(out) and out.count() == 50


def test_nearest_widens_its_search_by_doubling(spark, monkeypatch):
    radii, one_round = [], spatial._nearest_round
    monkeypatch.setattr(spatial, "_nearest_round", lambda *a: radii.append(a[4]) or one_round(*a))
    q = spark.createDataFrame([("near", 10.0, 20.0), ("far", 10.0, 20.004)], "query_id string, q_lat double, q_lon double")
    t = spark.createDataFrame([("a", 10.001, 20.0)], "id string, lat double, lon double")
    got = {r.query_id: round(r.distance_m) for r in spatial.nearest(q, t, "id").collect()}
    assert radii == [250.0, 500.0] and got == {"near": 111, "far": 452}


def test_references_are_the_best_of_all_pairs(spark):
    """Blocks in one place, odd attributes and repeated ids among them, against brute force."""
    rng = random.Random(11)
    kinds, areas = ["local", "arterial", None], [0.5, 900.0, 900.0, 1200.0, 70_000.0, 0.0, -3.0, None]

    def block(i):
        return (f"b{i % 190}" if i else None, 10 + rng.choice([0.0, 1e-5, rng.uniform(0, 0.008)]), 20 + rng.uniform(0, 0.006) if i % 9 else None, rng.choice(kinds), rng.choice([*areas, rng.uniform(500, 4000)]), rng.choice(kinds))

    rows = [block(i) for i in range(200)]
    # An area of 0 divides only among the subjects.
    held = [r for r in rows[::3] if r[4] != 0.0]
    schema = "block_id string, lat double, lon double, road_group string, area_m2 double, style string"
    got = blocks.match_references(spark.createDataFrame(rows, schema), spark.createDataFrame(held, schema)).collect()
    best: dict = {}
    for s in rows:
        for e in held:
            if s[0] is None or None in (s[2], e[2]):
                continue
            d = meters(s[1], s[2], e[1], e[2])
            if d > 500:
                continue
            ratio = None if None in (s[4], e[4]) or s[4] / e[4] <= 0 else abs(math.log(s[4] / e[4]))
            score = None if ratio is None else d / 500 + (s[3] is None or s[3] != e[3]) + ratio + (s[5] is None or s[5] != e[5])
            score = -1.0 if s[0] == e[0] else score
            # Missing scores and ids come first, as SQL orders them.
            rank = (score is not None, round(score or 0.0, 9), e[0] is not None, e[0] or "")
            if s[0] not in best or rank < best[s[0]][0]:
                best[s[0]] = (rank, e[0], None if score is None or score < 0 else score)
    assert len(got) == len(rows)
    for r in got:
        _, reference, score = best.get(r.block_id, (None, None, None))
        assert r.reference_id == reference, r
        assert (r.score is None) == (score is None) and (score is None or abs(r.score - score) < 1e-7), r


def test_many_different_blocks_in_one_place_find_their_reference(spark):
    """800 million pairs within the radius: comparing all of them took minutes."""
    n = 40_000
    at = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) / 1e6
    rows = spark.range(n).select(F.concat(F.lit("b"), "id").alias("block_id"), (10 + at(1) * 0.003).alias("lat"), (20 + at(2) * 0.003).alias("lon"), F.element_at(F.array(F.lit("local"), F.lit("arterial")), (F.col("id") % 2 + 1).cast("int")).alias("road_group"),
                                 (1000 + 3000 * at(3)).alias("area_m2"), F.lit("regular").alias("style"), "id")
    rows = settle(rows)
    started = time.time()
    got = {r.block_id: r.reference_id for r in blocks.match_references(rows, rows.filter("id % 2 = 0 OR id % 4 = 1")).collect()}
    assert time.time() - started < 90
    assert len(got) == n and all(got[f"b{i}"] == f"b{i}" for i in range(0, n, 2))
    table = rows.toPandas().set_index("id")
    held = table[(table.index % 2 == 0) | (table.index % 4 == 1)]
    for i in range(3, 400, 40):
        s = table.loc[i]
        d = [meters(s.lat, s.lon, a, b) for a, b in zip(held.lat, held.lon, strict=True)]
        score = [x / 500 + (g != s.road_group) + abs(math.log(s.area_m2 / m)) for x, g, m in zip(d, held.road_group, held.area_m2, strict=True)]
        assert got[f"b{i}"] == held.block_id.iloc[min(range(len(score)), key=score.__getitem__)]


def test_frontage_samples_leave_tasks_as_rows(spark, monkeypatch):
    """some rings at a time are one numpy step, and no array of samples is unpacked row by row afterwards."""
    monkeypatch.setattr(blocks, "STEP_SAMPLES", 100)
    rings = {"a": [(0, 0), (80, 0), (80, 60), (0, 60), (0, 0)], "b": [(0, 0), (9.3, 1.7), (12.1, 14.9), (3.3, 6.1), (3.3, 6.1), (0, 0)], None: [(0, 0), (0.3, 0), (0, 0)], "none": [(1, 1), (1, 1)]}
    df = spark.createDataFrame([(k, 0, [(float(x), float(y)) for x, y in r]) for k, r in rings.items()], "block_id string, ring_index int, ring array<struct<x:double,y:double>>").coalesce(1)
    out = blocks.frontage_samples(df)
    assert "MapInArrow" in plan(out) and "Generate" not in plan(out)
    got = {}
    for r in out.collect():
        got.setdefault(r["block_id"], []).append(r)
    assert set(got) == {"a", "b", None}
    for name, rows in got.items():
        xy = np.array(rings[name], float)
        cum = np.r_[0.0, np.cumsum(np.hypot(*np.diff(xy, axis=0).T))]
        n = max(1, round(cum[-1]))
        at = (np.arange(n) + 0.5) * cum[-1] / n
        rows.sort(key=lambda r: r["idx"])
        assert [r["idx"] for r in rows] == list(range(n)) and {r["n"] for r in rows} == {n}
        for axis, c in enumerate("xy"):
            assert np.allclose([r[c] for r in rows], np.interp(at, cum, xy[:, axis]), atol=1e-9)
        assert np.allclose([r["nx"] ** 2 + r["ny"] ** 2 for r in rows], 1)
    assert [(r["nx"], r["ny"]) for r in got["a"][:1]] == [(0.0, 1.0)]


def test_rounded_equals_round(spark):
    """rounding without decimals gives the same doubles, ties and odd values included."""
    rng = np.random.default_rng(5)
    values = [0.0, -0.0, -4e-7, 5e-7, -5e-7, 0.0000015, 2.5, 1.0000005, -1.0000005, 1e12, -3.7e15, 1e300, float("nan"), float("inf"), None, *(rng.integers(-(10**9), 10**9, 500) / 2e6).tolist(), *rng.normal(0, 1e3, 500).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 3, 6):
        rows = df.select(geo.rounded("x", digits).alias("a"), F.round("x", digits).alias("b")).collect()
        assert [repr(r["a"]) for r in rows] == [repr(r["b"]) for r in rows]


def test_cells_meet_without_a_side_held_whole(spark):
    """no side of these joins is held whole in every task, however small its file is; the pairs are all there."""
    rng = random.Random(4)
    at = [(i, 10 + rng.random() * 0.01, 20 + rng.random() * 0.01) for i in range(200)]
    centers = spark.createDataFrame([(f"c{i}", lat, lon) for i, lat, lon in at[:80]] + [("null", None, 20.0)], "center_id string, c_lat double, c_lon double")
    points = spark.createDataFrame([(f"p{i}", lat, lon) for i, lat, lon in at[80:]], "p string, lat double, lon double")
    near = spatial.within_radius(centers, points, 150.0)
    lines = points.selectExpr("p", "array(named_struct('x', lon, 'y', lat), named_struct('x', lon + 1e-4, 'y', lat)) AS line")
    along = spatial.lines_within_radius(centers, lines, 150.0)
    for df in (near, along):
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
    want = {(f"c{i}", f"p{j}") for i, a, b in at[:80] for j, c, d in at[80:] if meters(a, b, c, d) <= 150}
    assert {(r["center_id"], r["p"]) for r in near.collect()} == want
    assert want <= {(r["center_id"], r["p"]) for r in along.collect()}


def test_blocks_are_measured_in_tasks_as_their_samples_tell(spark, monkeypatch):
    r = random.Random(11)
    box = lambda x, y, w, h: [{"x": a, "y": b} for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]
    rings, houses = [], []
    for k in range(40):
        w, h = r.randint(30, 90), r.randint(30, 80)
        rings.append((f"b{k}", 0, box(0.0, 0.0, float(w), float(h))))
        if k % 5 == 0:
            rings.append((f"b{k}", 1, box(w * 0.4, h * 0.4, 8.0, 6.0)))
        if k % 7 == 0:
            rings.append((f"b{k}", 2, box(1.0, 1.0, 0.0, 0.0)))
        for j in range(r.randint(0, 12)):
            houses.append((f"b{k}", f"h{r.randint(0, 400):03d}" if j % 9 else None, box(r.uniform(1, w), r.uniform(1, h), r.uniform(0.5, 20), r.uniform(2, 9)), r.choice([None, 1, 2, 5])))
    rings += [rings[3], ("bare", 0, box(0.0, 0.0, 300.0, 40.0)), (None, 0, box(0.0, 0.0, 9.0, 9.0)), ("none", None, box(0.0, 0.0, 40.0, 40.0)), ("nil", 0, None)]
    houses += [houses[5], (None, "h1", box(0.0, 0.0, 3.0, 3.0), 1), ("alone", "h2", box(0.0, 0.0, 3.0, 3.0), 1), ("none", "h3", box(3.0, 3.0, 3.0, 3.0), 1), ("nil", "h4", box(3.0, 3.0, 3.0, 3.0), 1), ("bare", "h5", [], 1)]
    ring_rows = spark.createDataFrame(rings, "block_id string, ring_index int, ring array<struct<x:double,y:double>>")
    house_rows = spark.createDataFrame(houses, FOOT + ", levels int")
    hits = settle(blocks.ray_hits(blocks.frontage_samples(ring_rows), house_rows.drop("levels")))
    runs = settle(blocks.frontage_runs(hits))
    kept = []
    monkeypatch.setattr(blocks, "settle", lambda df, *a: kept.append(settle(df, *a)) or kept[-1])
    measures, gaps, coverage = blocks.measure_blocks(ring_rows, house_rows)
    got = measures.collect()
    # A block's samples stay in its task: what is written is less than they are.
    assert sum(df.count() for df in kept) < hits.count() / 5
    near = lambda rows: sorted((b, round(v, 6)) for b, v in rows)
    assert near(gaps.collect()) == near(blocks.run_gaps(runs).collect())
    share = hits.filter("block_id IS NOT NULL").groupBy("block_id").agg((F.count("building_id") / F.count("*")).alias("c"))
    assert near(coverage.collect()) == near(share.collect())
    found = {}
    for run in runs.filter("building_id IS NOT NULL").collect():
        found.setdefault((run.block_id, run.building_id), {}).setdefault(run.ring_index, []).append((run.size_m, -run.start_m, run.length_m))
    setback = {(x.block_id, x.building_id): x.m for x in hits.filter("building_id IS NOT NULL").groupBy("block_id", "building_id").agg(F.percentile("hit_m", 0.5).alias("m")).collect()}
    with_rings = {b for b, _, _ in rings if b}
    assert len(found) > 60 and {(m.block_id, m.building_id) for m in got} == {(b, i) for b, i, _, _ in houses if b in with_rings}
    inner = [m for m in got if (m.block_id, m.building_id) not in found]
    assert len(inner) > 10 and len({(m.block_id, m.building_id) for m in inner}) == len(inner)
    for m in got:
        if (m.block_id, m.building_id) in found:
            by_ring = found[m.block_id, m.building_id]
            ring_index = min(by_ring, key=lambda i: (-round(sum(x[0] for x in by_ring[i]), 9), i))
            size, start, length = max(by_ring[ring_index])
            assert (m.ring_index, round(m.width_m, 6), round(m.start_m, 6)) == (ring_index, round(size, 6), round(-start, 6))
            assert abs(m.front_setback_m - setback[m.block_id, m.building_id]) < 1e-9
            outline = next(p for b, i, p in rings if (b, i) == (m.block_id, ring_index))
            w, h = outline[2]["x"] - outline[0]["x"], outline[2]["y"] - outline[0]["y"]
            middle = (m.start_m + m.width_m / 2) % length
            turns = [0, w, w + h, 2 * w + h, length]
            if min(abs(middle - t) for t in turns) > 0.6:
                axis = "y" if middle < w or w + h < middle < 2 * w + h else "x"
                depths = {round(max(p[axis] for p in f) - min(p[axis] for p in f), 6) for b, i, f, _ in houses if (b, i) == (m.block_id, m.building_id)}
                assert round(m.depth_m, 6) in depths
        else:
            assert (m.width_m, m.depth_m, m.start_m) == (0, 0, 0)
    far = lambda foot, ring: F.when(geo.lines_touch(foot, ring), 0.0).otherwise(F.least(F.array_min(F.transform(foot, lambda p: geo.distance_to_line(p["x"], p["y"], ring))), F.array_min(F.transform(ring, lambda p: geo.distance_to_line(p["x"], p["y"], foot)))))
    pairs = house_rows.withColumnRenamed("ring", "foot").join(ring_rows, "block_id").select("block_id", "building_id", "ring_index", far("foot", "ring").alias("d"))
    nearest = {(x.block_id, x.building_id): x.m for x in pairs.groupBy("block_id", "building_id").agg(F.min(F.struct("d", "ring_index")).alias("m")).collect()}
    for m in inner:
        want = nearest[m.block_id, m.building_id]
        assert m.ring_index == want.ring_index and (m.front_setback_m is None) == (want.d is None) and (want.d is None or abs(m.front_setback_m - want.d) < 1e-9)


def test_fingerprints_have_exact_quantiles(spark):
    r = random.Random(12)
    rows = [(f"b{k}", r.choice([0.0, r.uniform(1, 9)]) if k % 4 else 0.0, r.choice([None, r.uniform(0, 9)]), r.uniform(0, 9), r.choice([None, 1, 2, 3])) for k in range(30) for _ in range(r.randint(1, 9))]
    gaps = [(f"b{r.randrange(35)}", r.uniform(0, 5)) for _ in range(60)] + [(None, 1.0)]
    m = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1)], "block_id string, width_m double, depth_m double, front_setback_m double, levels int")
    out = blocks.fingerprints(m, spark.createDataFrame(gaps, "block_id string, gap_m double"), spark.createDataFrame([(f"b{k}", 0.5) for k in range(1, 40)], "block_id string, coverage double"))
    # Quantiles of whole blocks are taken in tasks: no aggregate holds a map of values per block.
    assert "ObjectHashAggregate" not in plan(out)
    got = {x.block_id: x for x in out.collect()}
    assert set(got) == {b for b, *_ in rows} - {"b0"}
    quantile = lambda v, p: None if not v else float(np.quantile(v, p))
    same = lambda a, b: a == b or (None not in (a, b) and abs(a - b) < 1e-9)
    for b, x in got.items():
        mine = [y for y in rows if y[0] == b]
        use = [y for y in mine if y[1] > 0] or mine
        assert x.buildings == len(mine) and same(x.median_levels, quantile([y[4] for y in mine if y[4] is not None], 0.5))
        for i, name in ((1, "width"), (2, "depth"), (3, "front_setback")):
            v = [y[i] for y in use if y[i] is not None]
            assert same(x[f"{name}_median"], quantile(v, 0.5)) and same(x[f"{name}_iqr"], v and quantile(v, 0.75) - quantile(v, 0.25) or (0.0 if v else None))
        v = [g for name, g in gaps if name == b]
        assert same(x.side_gap_median, quantile(v, 0.5) or 0.0) and same(x.side_gap_iqr, quantile(v, 0.75) - quantile(v, 0.25) if v else 0.0)


def test_sums_within_a_radius_equal_all_pairs(spark):
    r = random.Random(13)
    places = [(10.0, 20.0), (0.0, -179.9995), (-0.0005, 179.9995), (59.9, 5.0), (-89.997, 100.0)]
    spot = lambda k: (places[k][0] + r.uniform(-0.004, 0.004) * (0.3 if k == 4 else 1), (places[k][1] + r.uniform(-0.009, 0.009) * (2000 if k == 4 else 1) + 180) % 360 - 180)
    of = lambda n, most: [(f"c{i}", *spot(r.choice([0, 0, 0, 1, 2, 3, 4])), r.choice(["a", "a", "b", None]), r.choice([None, *range(most)]), r.randrange(5)) for i in range(n)]
    centers, points = of(400, 9), of(900, 9)
    centers += [(*centers[0][:3], "b", 1, 1), (None, 10.0, 20.0, "a", 1, 1), ("nowhere", None, 20.0, "a", 1, 1), ("alone", 40.0, 20.0, "a", 1, 1)]
    points += [("x", None, 20.0, "a", 1, 1), *((f"e{i}", 10.0, 20.0, "b", None, 2) for i in range(300))]
    c = spark.createDataFrame(centers, "center_id string, c_lat double, c_lon double, kind string, u int, w int")
    p = spark.createDataFrame(points, "id string, lat double, lon double, kind string, t int, g long")
    out = spatial.sums_within_radius(c, p, 500.0, "kind", ["t", "g"])
    assert "Join" not in plan(out)
    want = {}
    for i, (name, lat, lon, kind, *_) in enumerate(centers):
        near = [x for x in points if None not in (lat, kind, x[1]) and x[3] == kind and meters(lat, lon, x[1], x[2]) <= 500]
        if near:
            t = [x[4] for x in near if x[4] is not None]
            want.setdefault(name, []).append((len(near), sum(t) if t else None, sum(x[5] for x in near)))
    got = {}
    for x in out.collect():
        got.setdefault(x.center_id, []).append((x.n, x.t, x.g))
    key = lambda v: sorted(v, key=str)
    assert {k: key(v) for k, v in got.items()} == {k: key(v) for k, v in want.items()} and len(want) > 250 and max(v[0][0] for v in want.values()) > 100


def test_calibration_makes_no_pairs(spark):
    blocks_ = [(f"b{i}", 10.0 + i * 1e-5, 20.0, "regular") for i in range(200)]
    feedback = [(f"b{i}", 10.0 + i * 1e-5, 20.0, "regular", i % 4, 2) for i in range(0, 200, 10)]
    out = blocks.calibration(spark.createDataFrame(blocks_, "block_id string, lat double, lon double, style string"), spark.createDataFrame(feedback, "block_id string, lat double, lon double, style string, target long, generated long"))
    assert "haversine" not in plan(out).lower() and "ASIN" not in plan(out).upper()
    rows = out.collect()
    assert len(rows) == 180 and {round(x.factor, 6) for x in rows} == {round(sum(i % 4 for i in range(0, 200, 10)) / 40, 6)}


def test_blocks_of_other_areas_are_not_paired_with_their_own(spark):
    r = random.Random(14)
    rows = [(f"b{i}", 10 + r.uniform(0, 0.01), 20 + r.uniform(0, 0.03), r.choice(["A", "A", "B", "C", None])) for i in range(250)] + [("far", 11.0, 20.0, "A")]
    b = spark.createDataFrame(rows, "block_id string, lat double, lon double, area_id string")
    areas = spark.createDataFrame([("A", "completed"), ("B", "completed"), ("C", "failed")], "area_id string, status string")
    c = b.select(F.col("block_id").alias("center_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.col("area_id").alias("own_area"))
    out = blocks.blocks_within(c, b, areas)
    joins = [x for x in plan(out).split("\n") if "Join" in x and "Inner" in x]
    assert joins and any("area_id" in x for x in joins)
    got = {(x.center_id, x.block_id, x.area_id, x.own_area) for x in out.collect()}
    want = {(p[0], q[0], q[3], p[3]) for p in rows for q in rows if p[3] and q[3] in ("A", "B") and p[3] != q[3] and meters(*p[1:3], *q[1:3]) <= 500}
    assert got == want and len(want) > 100


def test_composed_blocks_meet_only_what_may_hide_them(spark):
    r = random.Random(15)
    boxes = {"O": (0, 100), "M": (10, 90), "S": (20, 60), "T": (20, 60), "U": (50, 85), "X": (200, 210)}
    status = {"T": "completed", "X": "importing"}
    areas = [(k, status.get(k, "completed"), 10 + a * 1e-4, 20 + a * 1e-4, 10 + z * 1e-4, 20 + z * 1e-4) for k, (a, z) in boxes.items()]
    areas.append(("V", "failed", *areas[2][2:]))
    rows = []
    for i in range(260):
        area = r.choice("OOMMSTUVX")
        a, z = boxes.get(area, boxes["S"])
        y, x, h = 10 + r.uniform(a, z) * 1e-4, 20 + r.uniform(a, z) * 1e-4, r.uniform(1, 7) * 1e-4
        corners = [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)] if i % 2 else [(x - h, y - h), (x + h, y - h), (x + h, y + h)]
        rows.append((f"k{i}", area, y, x, [{"x": p, "y": q} for p, q in [*corners, corners[0]]], r.choice([False, False, True, None])))
    b = spark.createDataFrame(rows, "block_id string, area_id string, lat double, lon double, ring array<struct<x:double,y:double>>, is_clipped boolean")
    out = compose.composable_blocks(b, spark.createDataFrame(areas, "area_id string, status string, min_lat double, min_lon double, max_lat double, max_lon double"))
    assert "LeftSemi" in plan(out)

    def within(i, o):
        i, o = i[2:], o[2:]
        return i[0] >= o[0] and i[1] >= o[1] and i[2] <= o[2] and i[3] <= o[3]

    def holds(ring, lat, lon):
        inside = False
        for p, q in zip(ring, ring[1:]):
            if (p["y"] > lat) != (q["y"] > lat) and lon < p["x"] + (lat - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"]):
                inside = not inside
        return inside

    covers = {(o[0], i[0]) for o in areas for i in areas if o[0] != i[0] and within(i, o)}
    done = {a[0] for a in areas if a[1] == "completed"}
    want = set()
    for name, area, lat, lon, _, clipped in rows:
        if clipped is not False or area not in done:
            continue
        for outer in (o for o, i in covers if i == area):
            hidden = False
            for _, holder, _, _, ring, cut in rows:
                more = (outer, holder) in covers and holder in done and cut is False and holder != area and (holder, area) in covers and ((area, holder) not in covers or holder < area)
                hidden = hidden or ((holder == outer or more) and holds(ring, lat, lon))
            if not hidden:
                want.add((outer, name))
    got = [(x.outer_id, x.block_id) for x in out.collect()]
    assert sorted(got) == sorted(want) and len(want) > 30
