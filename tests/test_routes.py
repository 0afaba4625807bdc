"""Routes over the contracted turn graph against a search on the turn graph itself."""

import heapq
import random

import pytest

from terrafold.operators import graph


def dijkstra(cost, turns, starts, ends):
    best, heap = {}, [(cost[s], s) for s in starts]
    heapq.heapify(heap)
    while heap:
        d, s = heapq.heappop(heap)
        if s in best:
            continue
        best[s] = d
        if s in ends:
            return d
        for t in turns.get(s, ()):
            if t not in best:
                heapq.heappush(heap, (d + cost[t], t))
    return None


@pytest.mark.parametrize("least_share, small", [(0.0, graph.SMALL), (0.15, graph.SMALL), (2.0, graph.SMALL), (0.15, 100)])
def test_random_networks(spark, least_share, small):
    """Chains, dead ends, loops, a lattice and forbidden turns; with all contracted that can be, with some, and with nothing; by tasks, or by joins first."""
    rng = random.Random(5)
    segments, turns = [], []
    for area in "AB":
        links = [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(f"g{i}_{j}", f"g{i + a}_{j + b}") for i in range(4) for j in range(4) for a, b in ((0, 1), (1, 0))]
        links += [("c10", "d0"), ("d0", "d1"), ("c40", "g0_0"), ("c0", "g3_3"), ("c20", "l0"), ("l0", "l1"), ("l1", "c20"), ("x0", "x1")]
        for a, b in links:
            c = float(rng.randrange(1, 9))
            segments.append((area, f"{a}>{b}", a, b, c))
            if rng.random() < 0.8:
                segments.append((area, f"{b}>{a}", b, a, c))
        own = [s for s in segments if s[0] == area]
        turns += [(area, s[1], t[1]) for s in own for t in own if s[3] == t[2] and rng.random() < (0.5 if (s[2], s[3]) == (t[3], t[2]) else 0.9)]
    nodes = sorted({s[2] for s in segments} | {s[3] for s in segments})
    od = [(f"{area}{k}", area, *rng.sample(nodes, 2)) for area in "AB" for k in range(25)] + [("same", "A", "c3", "c3"), ("gone", "A", "c3", "nowhere")]
    e = spark.createDataFrame(segments, "area_id string, segment_id string, from_node string, to_node string, distance_m double")
    t = spark.createDataFrame(turns, "area_id string, incoming string, outgoing string")
    o = spark.createDataFrame(od, "od_id string, area_id string, origin string, destination string")
    arcs = graph.contract(e, t, least_share=least_share, small=small)
    contracted = arcs.filter("mid IS NOT NULL").count()
    assert (contracted > 0) == (least_share < 1)
    answers, tree = graph.shortest_paths(e, t, o, arcs=arcs)
    got = {r.od_id: r for r in answers.collect()}
    hops = {}
    for r in sorted(graph.reconstruct(answers, tree).collect(), key=lambda r: r.hop):
        hops.setdefault(r.od_id, []).append(r.edge)
    cost, allowed = {(s[0], s[1]): s[4] for s in segments}, {}
    for area, a, b in turns:
        allowed.setdefault((area, a), []).append((area, b))
    for i, area, a, b in od:
        if a == b:
            assert (got[i].status, got[i].total_m) == ("ok", 0.0)
            continue
        starts = [(s[0], s[1]) for s in segments if (s[0], s[2]) == (area, a)]
        want = dijkstra(cost, allowed, starts, {(s[0], s[1]) for s in segments if (s[0], s[3]) == (area, b)})
        assert got[i].total_m == want and got[i].status == ("no_route" if want is None else "ok")
        if want is not None:
            route = [(area, x) for x in hops[i]]
            assert route[0] in starts and sum(cost[x] for x in route) == want and route[-1][1] == got[i].last_edge
            assert all(y in allowed[x] for x, y in zip(route, route[1:], strict=False))
        else:
            assert i not in hops


def test_long_street_is_contracted_to_its_end(spark):
    """A street driven both ways leaves a core of few states however long it is (a bound on the rounds left some hundred of these)."""
    n = 3000
    segments = [("A", f"{d}{i}", f"v{i + (d == 'r')}", f"v{i + (d == 'f')}", 1.0) for i in range(n) for d in "fr"]
    e = spark.createDataFrame(segments, "area_id string, segment_id string, from_node string, to_node string, distance_m double")
    t = e.selectExpr("area_id", "segment_id AS incoming", "to_node AS node").join(e.selectExpr("area_id", "segment_id AS outgoing", "from_node AS node"), ["area_id", "node"])
    arcs = graph.contract(e, t)
    core = arcs.filter(f"lu = {graph.CORE}").select("u").union(arcs.filter(f"lw = {graph.CORE}").select("w")).distinct().count()
    assert core <= 60


@pytest.mark.parametrize("searched", [graph.SEARCHED, 3])
def test_searches_in_tasks_and_by_joins_agree(spark, monkeypatch, searched):
    """One-way rings with cross streets; pairs for several areas, repeated pairs, pairs of one edge and areas without a turn; in tasks, or by joins."""
    rng = random.Random(8)
    segments = [(a, f"{a}{i}", f"v{i}", f"v{(i + 1) % 60}", float(rng.randrange(1, 9))) for a in "AB" for i in range(60)]
    segments += [(a, f"{a}x{i}", f"v{i}", f"v{(i * 7 + 3) % 60}", float(rng.randrange(1, 9))) for a in "AB" for i in range(0, 60, 4)] + [("C", "c0", "v0", "v1", 4.0), ("C", "c1", "v1", "v0", 5.0)]
    e = spark.createDataFrame(segments, "area_id string, segment_id string, from_node string, to_node string, distance_m double")
    turns = [(s[0], s[1], t[1]) for s in segments for t in segments if s[0] == t[0] != "C" and s[3] == t[2]]
    t = spark.createDataFrame(turns, "area_id string, incoming string, outgoing string")
    od = [(f"p{k}", rng.choice("AB"), f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for k in range(30)]
    od += [od[0], ("one", "C", "v0", "v1"), ("two", "C", "v1", "v0"), ("both", "A", "v1", "v9"), ("both", "B", "v1", "v9"), (None, "A", "v1", "v2"), ("lost", "A", "v1", None), ("far", "Z", "v1", "v2")]
    rounds, by_joins = [], graph._spread
    monkeypatch.setattr(graph, "_spread", lambda *a, **k: rounds.append(1) or by_joins(*a, **k))
    pairs = spark.createDataFrame(od, "od_id string, area_id string, origin string, destination string")
    for some in (pairs.filter("od_id <> 'both'"), pairs) if searched > 3 else (pairs,):
        answers, tree = graph.shortest_paths(e, t, some, searched=searched)
        cost, allowed = {s[:2]: s[4] for s in segments}, {}
        for area, a, b in turns:
            allowed.setdefault((area, a), []).append((area, b))
        hops = {}
        for r in sorted(graph.reconstruct(answers, tree, searched=searched).collect(), key=lambda r: r.hop):
            hops.setdefault(r.od_id, []).append((r.hop, r.edge))
        got = answers.collect()
        assert len(got) == some.count() and (searched == 3 or some is pairs or not rounds)
        for r in got:
            if r.od_id in (None, "both"):
                continue
            if r.origin == r.destination:
                assert (r.status, r.total_m) == ("ok", 0.0)
                continue
            starts = [s[:2] for s in segments if (s[0], s[2]) == (r.area_id, r.origin)]
            want = dijkstra(cost, allowed, starts, {s[:2] for s in segments if (s[0], s[3]) == (r.area_id, r.destination)})
            assert (r.total_m, r.status) == (want, "no_route" if want is None else "ok")
            if want is not None:
                route = [x for _, x in hops[r.od_id]][:: 2 if r.od_id == "p0" else 1]
                assert sum(cost[r.area_id, x] for x in route) == want and route[-1] == r.last_edge and (r.area_id, route[0]) in starts
                assert [h for h, _ in hops[r.od_id]][:: 2 if r.od_id == "p0" else 1] == list(range(1, len(route) + 1))
        assert rounds or some is not pairs
