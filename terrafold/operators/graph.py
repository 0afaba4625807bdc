"""Iterative graph jobs: connected components, streets, ring assembly and turn-aware shortest paths.

Every round is a few joins over whole frames; its result is written to the shared work folder (``settle``), so
plans stay short and a lost executor only repeats one round."""

from __future__ import annotations

import heapq
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geo, ids, tags
from terrafold.operators import cells, lists
from terrafold.session import settle

CLASS_RANK = {c: i for i, c in enumerate(tags.ROAD_CLASSES)}
# Carriageways of a divided road.
DIVIDED_MIN_HEADING_DIFFERENCE = 135.0
DIVIDED_MAX_GAP_M = 30.0


def connected_components(vertices: DataFrame, edges: DataFrame, max_rounds: int = 14) -> DataFrame:
    """``id, component`` where component is the smallest id reachable. ``vertices`` has ``id``; ``edges`` has ``a, b``.

    Each round hooks every component onto the smallest neighbouring label and then jumps one pointer further, so long chains
    shrink geometrically. All group steps are ``min``, which combines map-side: a hub with a third of the edges sends one row
    per task."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = settle(both)
    labels = settle(vertices.select("id", F.col("id").alias("label")))
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        near = labels.join(seen.select(F.col("a").alias("id"), "m"), "id", "left")
        near = near.select("id", "label", F.least("label", "m").alias("next"))
        # The root of a component follows the smallest label any of its members saw.
        hook = near.groupBy("label").agg(F.min("next").alias("root"))
        joined = near.join(hook, "label").select("id", "label", F.least("next", "root").alias("next"))
        # One pointer jump: the label of my label.
        jump = joined.select(F.col("id").alias("next"), F.col("next").alias("further"))
        after = settle(joined.join(jump, "next", "left").select("id", F.col("label").alias("old"), F.least("next", F.coalesce("further", "next")).alias("label")))
        labels = after.select("id", "label")
        if after.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


# -- streets --------------------------------------------------------------------------------------

def connected_links(ways: DataFrame) -> DataFrame:
    """Links between ways of the same normalised name that share a node: every way to the smallest way at that node. That spans
    the same components as all pairs, with one row per way and node instead of a square."""
    at = ways.filter(F.col("norm_name").isNotNull()).select("area_id", "norm_name", "source_id", F.explode(F.array_distinct("nodes")).alias("node_id"))
    first = at.groupBy("area_id", "norm_name", "node_id").agg(F.min("source_id").alias("b"))
    j = at.join(first, ["area_id", "norm_name", "node_id"]).filter("source_id <> b")
    return j.select("area_id", F.col("source_id").alias("a"), "b").distinct()


def divided_links(ways: DataFrame) -> DataFrame:
    """Carriageways of a divided road: same name, both one-way, travel headings at least 135 degrees apart, some vertices at most 30 m
    apart. ``ways`` has ``norm_name, direction, line``."""
    w = ways.filter(F.col("norm_name").isNotNull() & (F.col("direction") != 0))
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    fwd = F.col("direction") > 0
    s = lambda axis: F.when(fwd, first[axis]).otherwise(last[axis])
    e = lambda axis: F.when(fwd, last[axis]).otherwise(first[axis])
    w = w.withColumn("heading", geo.bearing(s("y"), s("x"), e("y"), e("x")))
    v = w.select("area_id", "norm_name", "source_id", "heading", F.explode("line").alias("p")).select("*", F.col("p.y").alias("lat"), F.col("p.x").alias("lon"))
    left = v.select("area_id", "norm_name", F.col("source_id").alias("a"), F.col("heading").alias("ha"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    left = cells.with_box_cells(left, cells.disc_box("c_lat", "c_lon", DIVIDED_MAX_GAP_M), DIVIDED_MAX_GAP_M)
    right = cells.with_point_cell(v.select("area_id", "norm_name", F.col("source_id").alias("b"), F.col("heading").alias("hb"), "lat", "lon"), "lat", "lon", DIVIDED_MAX_GAP_M)
    diff = F.pmod(F.abs(F.col("ha") - F.col("hb")), F.lit(360.0))
    apart = F.least(diff, 360.0 - diff) >= DIVIDED_MIN_HEADING_DIFFERENCE
    close = geo.haversine("c_lat", "c_lon", "lat", "lon") <= DIVIDED_MAX_GAP_M
    j = left.join(right, ["area_id", "norm_name", "_band", "_cell"]).filter((F.col("a") < F.col("b")) & apart & close)
    return j.select("area_id", "a", "b").distinct()


def group_streets(ways: DataFrame) -> DataFrame:
    """``area_id, source_id, street_key`` for every way; unnamed ways are streets of their own.

    ``ways``: ``area_id, source_id, name, class, nodes, direction, line``. The key is the smallest way id of the group here;
    ``streets`` turns it into the published key."""
    named = ways.withColumn("norm_name", tags.norm_name("name"))
    links = connected_links(named).unionByName(divided_links(named))
    vid = lambda c: F.concat_ws("\u0001", "area_id", c)
    comp = connected_components(ways.select(vid("source_id").alias("id")), links.select(vid("a").alias("a"), vid("b").alias("b")))
    parts = lambda c, i: F.split(c, "\u0001")[i]
    return comp.select(parts("id", 0).alias("area_id"), parts("id", 1).alias("source_id"), parts("component", 1).alias("first_way"))


def streets(ways: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row per street: key (its way ids joined with ``+``), derived id, name of the first way, most significant class.

    The key lists a street's ways by definition, so they are collected per street: bounded by the ways of one name in one box."""
    rank = tags.lookup(F.col("class"), CLASS_RANK)
    j = grouped.join(ways.select("area_id", "source_id", "name", "class"), ["area_id", "source_id"])
    g = j.groupBy("area_id", "first_way").agg(
        F.array_join(F.array_sort(F.collect_list("source_id")), "+").alias("street_key"),
        F.min_by("name", "source_id").alias("name"), F.min_by("class", rank).alias("class"), F.count("*").alias("ways"),
    )
    return g.select("area_id", ids.uuid5(ids.STREET_NAMESPACE, F.concat_ws(":", "area_id", "street_key")).alias("street_id"), "street_key", "name", "class", "ways", "first_way")


# -- multipolygon rings ---------------------------------------------------------------------------

def member_points(members: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Outer way members of relations with their points: inline geometry, else the way's nodes; a member with an unknown node or way
    is dropped. ``members``: ``area_id, relation_id, member_pos, ref, geometry``."""
    inline = members.filter(F.size("geometry") > 0).filter(F.forall("geometry", lambda p: p["lat"].isNotNull() & p["lon"].isNotNull()))
    inline = inline.select("area_id", "relation_id", "member_pos", F.transform("geometry", lambda p: geo.point(p["lon"], p["lat"])).alias("line"))
    by_way = members.filter(F.col("geometry").isNull() | (F.size("geometry") == 0))
    flat = by_way.join(ways.select("area_id", F.col("way_id").alias("ref"), "nodes"), ["area_id", "ref"])
    flat = flat.select("area_id", "relation_id", "member_pos", F.size("nodes").alias("_n"), F.posexplode("nodes").alias("_pos", "node_id"))
    hit = flat.join(nodes, ["area_id", "node_id"])
    lines = hit.groupBy("area_id", "relation_id", "member_pos", "_n").agg(F.array_sort(F.collect_list(F.struct("_pos", geo.point("lon", "lat").alias("p")))).alias("v"))
    whole = lines.filter(F.size("v") == F.col("_n")).select("area_id", "relation_id", "member_pos", F.transform("v", lambda e: e["p"]).alias("line"))
    return inline.unionByName(whole).filter(F.size("line") >= 2)


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces joined where exactly two of them meet: ``area_id, relation_id, first, member_pos, pos, ahead, ring, front`` for every piece of every
    run. ``first`` is the smallest member of the run and ``pos`` the place in it, walked in the direction in which ``first`` was drawn; ``ring`` is true where the run
    closes. An open run is cut where ``first`` begins, into the pieces from there on (``front``) and those before."""
    key = ["area_id", "relation_id"]
    ends = pieces.select(*key, "pid", "member_pos", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("p")), F.struct(F.lit(1).alias("side"), F.col("e").alias("p")))).alias("x"))
    ends = ends.select(*key, "pid", "member_pos", "x.side", "x.p")
    # Where two ends meet, who leaves by one goes on by the other; elsewhere one turns round.
    ends = ends.withColumn("end", F.col("pid") * 2 + F.col("side"))
    pair = ends.groupBy(*key, "p").agg(F.count("*").alias("n"), F.min("end").alias("lo"), F.max("end").alias("hi"))
    met = ends.join(pair, [*key, "p"])
    other = F.when(F.col("n") == 2, F.col("lo") + F.col("hi") - F.col("end")).otherwise(F.col("end"))
    # A walk through a piece is named by the end it leaves by: 1 is as drawn. It enters the next piece by the end ``other`` and leaves by the opposite.
    walk = met.select(*key, "member_pos", F.col("end").alias("he"), other.bitwiseXOR(F.lit(1)).alias("nxt"), F.struct("member_pos", (1 - F.col("side")).alias("turned")).alias("label"))
    walk = settle(walk)
    runs = lists.ranked(walk.join(lists.around(walk.select("he", "nxt", "label")), "he"), *key, "best")
    runs = runs.select(*key, F.col("best.member_pos").alias("first"), F.col("best.turned").alias("way"), "member_pos", (F.col("he") % 2 == 1).alias("ahead"), "pos")
    size = runs.groupBy(*key, "first", "way").agg(
        F.count("*").alias("n"), F.countDistinct("member_pos").alias("n_pieces"), F.max(F.when((F.col("member_pos") == F.col("first")) & ~F.col("ahead"), F.col("pos"))).alias("back"),
    )
    runs = runs.join(size, [*key, "first", "way"]).filter("way = 0").withColumn("ring", F.col("n") == F.col("n_pieces"))
    # An open run is walked there and back: forth from ``first``, back through it to the other end, and from there to ``first`` again.
    half = (F.col("back") + 1) / 2
    runs = runs.filter(F.col("ring") | (F.col("pos") < half) | (F.col("pos") >= half + F.col("n_pieces")))
    return runs.select(*key, "first", "member_pos", "pos", "ahead", "ring", (F.col("ring") | (F.col("pos") < half)).alias("front"))


def _lines_of(runs: DataFrame, pieces: DataFrame, *key: str) -> DataFrame:
    """The pieces' lines end to end per ``key``, in the order of ``pos``, turned where not ``ahead``."""
    j = runs.join(pieces.select("area_id", "relation_id", "member_pos", "line"), ["area_id", "relation_id", "member_pos"])
    line = F.when(F.col("ahead"), F.col("line")).otherwise(F.reverse("line"))
    g = j.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("l")))).alias("v"))
    return g.select(*key, F.concat(F.slice(F.col("v")[0]["l"], 1, 1), F.flatten(F.transform("v", lambda x: F.slice(x["l"], F.lit(2), F.size(x["l"]))))).alias("line"))


def _choose(runs: pd.DataFrame) -> pd.DataFrame:
    """Rings of one relation from its runs: from the first unused one, on by the first that fits the end (turned when it fits by its end) until the
    start is reached again. ``head`` and ``tail`` are the members at a run's two ends; whichever is met decides the order."""
    rows = runs.sort_values("head", kind="stable").reset_index(drop=True)
    fits: dict[str, list[tuple[int, int, bool]]] = {}
    for i, r in enumerate(rows.itertuples(index=False)):
        fits.setdefault(r.s, []).append((r.head, i, True))
        fits.setdefault(r.e, []).append((r.tail, i, False))
    for v in fits.values():
        v.sort(key=lambda x: (x[0], not x[2]))
    used, out = np.zeros(len(rows), bool), []
    for start in rows["order"].to_numpy().argsort(kind="stable"):
        if used[start]:
            continue
        used[start] = True
        chain, tip = [(start, True)], rows.e[start]
        while tip != rows.s[start]:
            at = fits.get(tip, [])
            while at and used[at[0][1]]:
                at.pop(0)
            if not at:
                break
            _, i, ahead = at[0]
            used[i] = True
            chain.append((i, ahead))
            tip = rows.e[i] if ahead else rows.s[i]
        else:
            out += [(rows.order[start], k, rows.run[i], ahead) for k, (i, ahead) in enumerate(chain)]
    chosen = pd.DataFrame(out, columns=["start", "turn", "run", "run_ahead"])
    return chosen.assign(area_id=rows.area_id[0], relation_id=rows.relation_id[0])[["area_id", "relation_id", "start", "turn", "run", "run_ahead"]]


def _three_points(line: Column) -> Column:
    """Whether ``line`` has three different points, in one pass (``array_distinct`` compares structs pair by pair)."""

    def step(seen: Column, p: Column) -> Column:
        a, b, n = seen["a"], seen["b"], seen["n"]
        new = (n == 0) | (~p.eqNullSafe(a) & ((n == 1) | ((n == 2) & ~p.eqNullSafe(b))))
        return F.when(new, F.struct(F.when(n == 0, p).otherwise(a).alias("a"), F.when(n == 1, p).otherwise(b).alias("b"), (n + 1).alias("n"))).otherwise(seen)

    none = F.lit(None).cast("struct<x:double,y:double>")
    return F.aggregate(line, F.struct(none.alias("a"), none.alias("b"), F.lit(0).alias("n")), step)["n"] >= 3


def assemble_rings(pieces: DataFrame) -> DataFrame:
    """Closed outer rings ``area_id, relation_id, source_id, ring`` from member pieces (``area_id, relation_id, member_pos, line``) joined end to end.

    The published order: start at the first unused piece, extend at its end by the first fitting piece (reversed when it fits by its
    end), close, repeat; chains that can't be closed are dropped with their pieces. Where just two pieces meet there is nothing to choose, so
    such runs are joined by ranking them as linked lists, in as many rounds as the longest has binary digits. What is left are the joints where more
    meet: there a relation's runs (no geometry, and fewer than the members its one element listed) are chosen in member order."""
    key = ["area_id", "relation_id"]
    same = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    p = settle(pieces.select(*key, "member_pos", "line", same(F.element_at("line", 1)).alias("s"), same(F.element_at("line", -1)).alias("e"), F.monotonically_increasing_id().alias("pid")))
    runs = settle(_joined(p))
    simple = _lines_of(runs.filter("ring"), p, *key, "first").withColumnRenamed("first", "start")

    # Runs between joints: where they begin and end, and which members stand there.
    open_ = runs.filter("NOT ring").withColumn("run", F.col("first") * 2 + F.when(F.col("front"), 0).otherwise(1))
    along = open_.join(p.select(*key, "member_pos", "s", "e"), [*key, "member_pos"])
    enter, leave = F.when(F.col("ahead"), F.col("s")).otherwise(F.col("e")), F.when(F.col("ahead"), F.col("e")).otherwise(F.col("s"))
    spans = along.groupBy(*key, "run").agg(
        F.min_by(enter, "pos").alias("s"), F.max_by(leave, "pos").alias("e"), F.min_by("member_pos", "pos").alias("head"), F.max_by("member_pos", "pos").alias("tail"), F.min("member_pos").alias("order"),
    )
    # A relation without a joint of three ends closes nothing more.
    joints = spans.select(*key, F.explode(F.array("s", "e")).alias("p")).groupBy(*key, "p").agg(F.count("*").alias("n")).filter("n > 2").select(*key).distinct()
    schema = "area_id string, relation_id string, start long, turn long, run long, run_ahead boolean"
    asked = spans.join(joints, key, "left_semi").select("area_id", "relation_id", "s", "e", F.col("head").cast("long").alias("head"), F.col("tail").cast("long").alias("tail"), F.col("order").cast("long").alias("order"), F.col("run").cast("long").alias("run"))
    chosen = settle(asked.groupBy(*key).applyInPandas(_choose, schema))
    sized = open_.groupBy(*key, "run").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    parts = chosen.join(open_, [*key, "run"]).join(sized, [*key, "run"])
    within = F.when(F.col("run_ahead"), F.col("pos") - F.col("low")).otherwise(F.col("high") - F.col("pos"))
    parts = parts.select(*key, "start", "member_pos", F.struct(F.col("turn"), within.alias("k")).alias("pos"), (F.col("ahead") == F.col("run_ahead")).alias("ahead"))
    rings = simple.unionByName(_lines_of(parts, p, *key, "start").withColumn("start", F.col("start").cast(p.schema["member_pos"].dataType)))

    own = F.slice("line", F.lit(1), F.size("line") - 1)
    rings = settle(rings.filter(_three_points(own)))
    # The rings of a relation are fewer than its members.
    number = W.partitionBy(*key)
    rings = rings.withColumn("_k", F.row_number().over(number.orderBy("start")) - 1).withColumn("_n", F.count("*").over(number))
    sid = F.when(F.col("_n") == 1, F.concat(F.lit("relation/"), "relation_id")).otherwise(F.concat(F.lit("relation/"), "relation_id", F.lit("/"), "_k"))
    return rings.select(*key, sid.alias("source_id"), F.col("line").alias("ring"))


# -- routes ---------------------------------------------------------------------------------------

#: So many more shortcuts than arcs that go may a contracted state leave.
SPARE = 3
#: Tables of improvements that are put together when there are more: each costs every round a scan.
PARTS = 4
#: An area of at most so many arcs is contracted by one task.
SMALL = 200_000
#: Level of states that were not contracted.
CORE = 1 << 30
#: An area of at most so many arcs with its shortcuts is searched in tasks, for so many pairs at a time; a route of at most so many edges is put in order in one.
SEARCHED, PAIRS = 2_000_000, 500


def _contract_small(arcs: pd.DataFrame, least_share: float, level: int) -> pd.DataFrame:
    """The rounds of ``contract`` on one small area: its arcs with their ``mid``, and a row without ``w`` for every state that went in round ``level``."""
    out: dict[str, dict[str, tuple]] = {}
    into: dict[str, set[str]] = {}
    for u, w, c, mid in zip(arcs.u, arcs.w, arcs.c, arcs.mid, strict=True):
        out.setdefault(u, {})[w] = (c, mid)
        out.setdefault(w, {})
        into.setdefault(w, set()).add(u)
        into.setdefault(u, set())
    rows, order, rng = [], sorted(out), random.Random(level)
    while order:
        rng.shuffle(order)
        chosen, beaten = [], set()
        for s in order:
            i, o = len(into[s]), len(out[s])
            if s not in beaten and i * o <= i + o + SPARE:
                chosen.append(s)
                beaten.update(into[s], out[s])
        if len(chosen) < max(1.0, least_share * len(order)):
            break
        for s in chosen:
            before, after = [(u, *out[u].pop(s)) for u in into.pop(s)], out.pop(s)
            rows += [(u, s, c, mid, None) for u, c, mid in before] + [(s, w, c, mid, None) for w, (c, mid) in after.items()]
            rows.append((s, None, None, None, level))
            for w, (c2, _) in after.items():
                into[w].remove(s)
                for u, c1, _ in before:
                    if u != w and (w not in out[u] or (c1 + c2, s) < (out[u][w][0], out[u][w][1] or "")):
                        out[u][w] = (c1 + c2, s)
                        into[w].add(u)
        went = set(chosen)
        order = [s for s in order if s not in went]
        level += 1
    rows += [(u, w, c, mid, None) for u, to in out.items() for w, (c, mid) in to.items()]
    return pd.DataFrame(rows, columns=["u", "w", "c", "mid", "level"]).astype({"c": "float64", "level": "Int32"}).assign(area_id=arcs.area_id.iloc[0])


def contract(edges: DataFrame, successors: DataFrame, cost: str = "distance_m", least_share: float = 0.15, max_rounds: int = 200, small: int = SMALL) -> DataFrame:
    """The turn graph with shortcuts over its simple states: ``area_id, u, w, c, mid, lu, lw``.

    A state is a directed edge just taken; an arc ``u -> w`` costs what ``w`` costs. A round takes out states whose shortcuts are hardly more than the arcs they
    replace (streets without a choice, with or without turning round) and of which no two are neighbours: for every way through such a state one shortcut
    remembers it as ``mid``. A street of n states shrinks by about a quarter per round. ``lu`` and ``lw`` are the rounds in which the ends went, ``CORE`` for those left.
    It ends when a round takes out less than ``least_share`` of the states, or after ``max_rounds``: a core of few hops is searched faster than contracted.
    Once no area has more than ``small`` arcs, every area goes through its further rounds in a task of its own, since a round of joins takes seconds however little is left.
    The result serves any origins and destinations."""
    cost_of = edges.select("area_id", F.col("segment_id").alias("w"), F.col(cost).alias("c"))
    arcs = successors.select("area_id", F.col("incoming").alias("u"), F.col("outgoing").alias("w")).filter("u <> w").join(cost_of, ["area_id", "w"])
    active = settle(arcs.groupBy("area_id", "u", "w").agg(F.min("c").alias("c")).withColumn("mid", F.lit(None).cast("string")))
    gone, levels, states = [], [], None
    ends = lambda df: df.select("area_id", F.col("u").alias("state"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(df.select("area_id", F.col("w").alias("state"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    small_enough = (F.count("*") <= small) & ~F.max(F.col("c").isNull() | F.isnan("c"))
    whole = lambda: settle(active.groupBy("area_id").agg(small_enough.alias("ok")))
    sizes = whole()
    for turn in range(max_rounds):
        if sizes.filter("NOT ok").isEmpty():
            break
        degree = ends(active).groupBy("area_id", "state").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
        # The first of its simple neighbours, in a new random order every round.
        simple = degree.filter(F.col("i") * F.col("o") <= F.col("i") + F.col("o") + SPARE).select("area_id", "state", F.struct(F.xxhash64("state", F.lit(turn)).alias("h"), "state").alias("rank"))
        of = lambda end, name: simple.select("area_id", F.col("state").alias(end), F.col("rank").alias(name))  # noqa: E731, B023
        near = active.select("area_id", "u", "w").join(of("u", "ru"), ["area_id", "u"]).join(of("w", "rw"), ["area_id", "w"])
        beaten = near.select("area_id", F.when(F.col("ru") < F.col("rw"), F.col("w")).otherwise(F.col("u")).alias("state")).distinct()
        chosen = settle(simple.select("area_id", "state").join(beaten, ["area_id", "state"], "left_anti"))
        states = degree.count() if states is None else states
        went = chosen.count()
        if went < max(1.0, least_share * states):
            break
        states -= went
        out = lambda end, name: chosen.select("area_id", F.col("state").alias(end), F.lit(True).alias(name))  # noqa: E731, B023
        told = settle(active.join(out("u", "gu"), ["area_id", "u"], "left").join(out("w", "gw"), ["area_id", "w"], "left"))
        into = told.filter("gw").select("area_id", "u", F.col("w").alias("mid"), F.col("c").alias("c1"))
        onward = told.filter("gu").select("area_id", F.col("u").alias("mid"), "w", F.col("c").alias("c2"))
        short = into.join(onward, ["area_id", "mid"]).filter("u <> w").select("area_id", "u", "w", (F.col("c1") + F.col("c2")).alias("c"), "mid")
        rest = told.filter("gu IS NULL AND gw IS NULL").select("area_id", "u", "w", "c", "mid")
        active = settle(rest.unionByName(short).groupBy("area_id", "u", "w").agg(F.min(F.struct("c", "mid")).alias("m")).select("area_id", "u", "w", "m.c", "m.mid"))
        gone.append(told.filter("gu OR gw").select("area_id", "u", "w", "c", "mid"))
        levels.append(chosen.withColumn("level", F.lit(turn)))
        sizes = whole()
    alone = active.join(sizes.filter("ok"), "area_id", "left_semi")
    first = len(levels)
    finish = lambda arcs: _contract_small(arcs, least_share, first)
    done = settle(alone.groupBy("area_id").applyInPandas(finish, "area_id string, u string, w string, c double, mid string, level int"))
    active = active.join(sizes.filter("ok"), "area_id", "left_anti").unionByName(done.filter("w IS NOT NULL").drop("level"))
    levels.append(done.filter("w IS NULL").select("area_id", F.col("u").alias("state"), "level"))
    for g in gone:
        active = active.unionByName(g)
    level = levels[0]
    for x in levels[1:]:
        level = level.unionByName(x)
    at = lambda end: level.select("area_id", F.col("state").alias(end), F.col("level").alias(f"l{end}"))
    both = active.join(at("u"), ["area_id", "u"], "left").join(at("w"), ["area_id", "w"], "left")
    return settle(both.select("area_id", "u", "w", "c", "mid", F.coalesce("lu", F.lit(CORE)).alias("lu"), F.coalesce("lw", F.lit(CORE)).alias("lw")))


def _spread(start: DataFrame, steps: DataFrame, max_rounds: int, ahead: DataFrame | None = None) -> DataFrame:
    """Least ``d`` and its ``prev`` for every ``od_id, area_id, state`` reached from ``start`` (``od_id, area_id, state, d``) by ``steps`` (``area_id, state, next, c``).

    A round handles only the states that became better in the round before. Every round's improvements are a table of their own (a few of them are put
    together now and then), and candidates are compared with the rows of the same states in them. ``ahead`` (``od_id, area_id, state, rest``) tells what is left from
    a state to the end; ``total`` is then the length by way of it, and states that can't beat a pair's least ``total`` go no further."""
    def told(df: DataFrame) -> DataFrame:
        if ahead is None:
            return df.withColumn("total", F.lit(None).cast("double"))
        return df.join(ahead, ["od_id", "area_id", "state"], "left").withColumn("total", F.col("d") + F.col("rest")).drop("rest")

    def all_of(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    best = lambda df: df.groupBy("od_id", "area_id", "state").agg(F.min(F.struct("d", "prev", "total")).alias("m")).select("od_id", "area_id", "state", "m.*")
    own = ["od_id", "area_id", "state"]
    parts = [settle(told(best(start.select(*own, "d", F.lit(None).cast("string").alias("prev"), F.lit(None).cast("double").alias("total"))).drop("total")))]
    fresh = parts[0]
    for turn in range(max_rounds + 1):
        if ahead is not None:
            bound = all_of(parts).groupBy("od_id").agg(F.min("total").alias("bound"))
            fresh = fresh.join(bound, "od_id", "left").filter("bound IS NULL OR d < bound").drop("bound")
        to = fresh.select(*own, "d").join(steps, ["area_id", "state"])
        cand = to.groupBy("od_id", "area_id", F.col("next").alias("state")).agg(F.min(F.struct((F.col("d") + F.col("c")).alias("d"), F.col("state").alias("prev"))).alias("m")).select(*own, "m.*")
        known = all_of(parts).join(cand.select(*own), own, "left_semi").groupBy(*own).agg(F.min("d").alias("old"))
        fresh = settle(told(cand.join(known, own, "left").filter("old IS NULL OR d < old").drop("old")))
        if fresh.isEmpty():
            return best(all_of(parts))
        if turn == max_rounds:
            raise RuntimeError(f"routes are not settled after {max_rounds} rounds")
        parts.append(fresh)
        if len(parts) > PARTS:
            parts = [settle(best(all_of(parts)))]
    raise AssertionError


def _chain(last: DataFrame, tree: DataFrame) -> DataFrame:
    """Rows of ``tree`` (``od_id, state, prev``) on the way back from ``last`` (``od_id, state``)."""
    hops = reconstruct(last.select("od_id", F.col("state").alias("last_edge")), tree.select("od_id", F.col("state").alias("edge"), "prev"))
    return tree.join(hops.select("od_id", F.col("edge").alias("state")), ["od_id", "state"])


class _Arcs:
    """Arcs one way, as neighbours of each of ``n`` states."""

    def __init__(self, n: int, state: np.ndarray, to: np.ndarray, cost: np.ndarray):
        order = np.argsort(state, kind="stable")
        self.to, self.cost = to[order], cost[order]
        self.first = np.searchsorted(state[order], np.arange(n + 1))

    def spread(self, start: dict[int, float], max_rounds: int, rest: dict[int, float] | None = None) -> tuple[dict[int, tuple[float, int, int]], tuple[float, int] | None]:
        """``_spread`` for one pair: per state reached its least length, the state before it (-1 for none) and its hops, and with ``rest`` the least
        total with its state, the lower number of equal ones; states that can't beat it go no further. Raises ``OverflowError`` beyond ``max_rounds`` hops."""
        best = {s: (d, -1, 0) for s, d in start.items()}
        heap, done, met = [(d, s) for s, d in start.items()], set(), None
        heapq.heapify(heap)
        while heap:
            d, s = heapq.heappop(heap)
            if met is not None and d > met[0]:
                break
            if s in done:
                continue
            done.add(s)
            hops = best[s][2] + 1
            if hops > max_rounds + 1:
                raise OverflowError
            if rest is not None:
                if s in rest and (met is None or (d + rest[s], s) < met):
                    met = (d + rest[s], s)
                if met is not None and d >= met[0]:
                    continue
            low, high = self.first[s], self.first[s + 1]
            for w, c in zip(self.to[low:high].tolist(), self.cost[low:high].tolist(), strict=True):
                if w not in done and (w not in best or (d + c, s) < best[w][:2]):
                    if w not in best or d + c < best[w][0]:
                        heapq.heappush(heap, (d + c, w))
                    best[w] = (d + c, s, hops)
        return best, met


def _way_back(best: dict[int, tuple[float, int, int]], s: int) -> list[int]:
    out = [s]
    while (s := best[s][1]) >= 0:
        out.append(s)
    return out


def _searched(arcs: pa.Table, asked: pa.Table, max_rounds: int, with_tree: bool) -> pa.Table:
    """The routes of some pairs in some whole areas: per pair found a row with its ``total`` (-1 if it took too many rounds) and last ``edge``, and,
    ``with_tree``, a row without ``total`` for every edge of its route with the one before it."""
    column = lambda t, c: t[c].combine_chunks()
    n = len(arcs)
    names = pa.concat_arrays([*(column(arcs, c) for c in ("u", "w", "mid")), column(asked, "state")])
    areas = pa.concat_arrays([*[column(arcs, "area_id")] * 3, column(asked, "area_id")])
    # States get numbers in the order of their names.
    names, areas = names.dictionary_encode(), areas.dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order), "int64")
    rank[order] = np.arange(len(order))
    valid = names.indices.is_valid().to_numpy(zero_copy_only=False)
    code = np.full(len(names), -1)
    if valid.any():
        known, number = np.unique(rank[names.indices.drop_null().to_numpy()] * len(areas.dictionary) + areas.indices.to_numpy()[valid], return_inverse=True)
        code[valid] = number
    else:
        known = np.zeros(0, "int64")
    u, w, mid, state = np.split(code, [n, 2 * n, 3 * n])
    name = lambda codes: names.dictionary.take(pa.array(order[known[codes] // max(len(areas.dictionary), 1)]))
    cost, lu, lw = (column(arcs, c).to_numpy() for c in ("c", "lu", "lw"))
    down, up = lu > lw, (lw > lu) | ((lu == CORE) & (lw == CORE))
    back, forth = _Arcs(len(known), w[down], u[down], cost[down]), _Arcs(len(known), u[up], w[up], cost[up])
    # Arcs by their ends; null ends have no number and are none.
    ends = u * len(known) + w
    by_ends = np.argsort(ends, kind="stable")
    sorted_ends = ends[by_ends]
    pairs = column(asked, "od_id").dictionary_encode()
    pair, starts, first_d = pairs.indices.to_numpy(), column(asked, "starts").to_numpy(zero_copy_only=False), column(asked, "d").to_numpy()
    found, firsts, todo = [], [], []
    for k, rows in enumerate(np.split(np.argsort(pair, kind="stable"), np.cumsum(np.bincount(pair, minlength=len(pairs.dictionary)))[:-1])):
        start, end = {}, {}
        for s, begins, d in zip(state[rows].tolist(), starts[rows].tolist(), first_d[rows].tolist(), strict=True):
            side = start if begins else end
            side[s] = min(d, side.get(s, d))
        if not start or not end:
            continue
        try:
            after, _ = back.spread(end, max_rounds)
            before, met = forth.spread(start, max_rounds, {s: d for s, (d, *_) in after.items()})
        except OverflowError:
            found.append((k, -1.0, next(iter(end))))
            continue
        if met is None:
            continue
        on, there = _way_back(after, met[1]), _way_back(before, met[1])[::-1]
        found.append((k, met[0], on[-1]))
        firsts.append((k, there[0]))
        way = np.array(there + on[1:], "int64")
        todo.append(np.column_stack([np.full(len(way) - 1, k), way[:-1], way[1:]]))
    edges = []
    left = np.vstack(todo) if todo and with_tree else np.zeros((0, 3), "int64")
    while len(left):
        # A shortcut is the two arcs by way of the state it skips.
        by = mid[by_ends[np.searchsorted(sorted_ends, left[:, 1] * len(known) + left[:, 2])]]
        edges.append(left[by < 0])
        short, by = left[by >= 0], by[by >= 0]
        left = np.vstack([np.column_stack([short[:, 0], short[:, 1], by]), np.column_stack([short[:, 0], by, short[:, 2]])])
    tree = np.vstack(edges) if edges else np.zeros((0, 3), "int64")
    k, total, last = (np.array([f[i] for f in found], dtype) for i, dtype in enumerate(("int64", "float64", "int64")))
    first_k, first = (np.array([f[i] for f in firsts], "int64") for i in (0, 1)) if with_tree else (np.zeros(0, "int64"),) * 2
    out = [
        pairs.dictionary.take(pa.array(np.concatenate([k, first_k, tree[:, 0]]))),
        pa.concat_arrays([pa.array(total), pa.nulls(len(first) + len(tree), pa.float64())]),
        name(np.concatenate([last, first, tree[:, 2]])),
        pa.concat_arrays([pa.nulls(len(last) + len(first), names.dictionary.type), name(tree[:, 1])]),
    ]
    return pa.Table.from_arrays(out, names=["od_id", "total", "edge", "prev"])


def _searched_by_joins(arcs: DataFrame, start: DataFrame, end: DataFrame, max_rounds: int, with_tree: bool) -> tuple[DataFrame, DataFrame | None]:
    """``_searched`` by rounds of joins: ``(met, tree)``, with ``total`` and ``last_edge`` of each pair found."""
    down = arcs.filter("lu > lw").select("area_id", F.col("w").alias("state"), F.col("u").alias("next"), "c")
    up = arcs.filter(f"lw > lu OR (lu = {CORE} AND lw = {CORE})").select("area_id", F.col("u").alias("state"), F.col("w").alias("next"), "c")
    back = settle(_spread(end, down, max_rounds))
    forth = settle(_spread(start, up, max_rounds, back.select("od_id", "area_id", "state", F.col("d").alias("rest"))))
    met = settle(forth.filter("total IS NOT NULL").groupBy("od_id").agg(F.min(F.struct("total", "state")).alias("m")).select("od_id", "m.*"))
    if not with_tree:
        return met.select("od_id", "total", F.lit(None).cast("string").alias("last_edge")), None
    after = settle(_chain(met, back))
    last = after.filter("prev IS NULL").select("od_id", F.col("state").alias("last_edge"))
    before = settle(_chain(met, forth))
    todo = before.filter("prev IS NOT NULL").select("od_id", "area_id", F.col("prev").alias("u"), F.col("state").alias("w"))
    todo = todo.unionByName(after.filter("prev IS NOT NULL").select("od_id", "area_id", F.col("state").alias("u"), F.col("prev").alias("w")))
    tree = before.filter("prev IS NULL").select("od_id", F.col("state").alias("edge"), F.lit(None).cast("string").alias("prev"))
    met = met.join(last, "od_id", "left").select("od_id", "total", "last_edge")
    while True:
        # A shortcut is the two arcs by way of the state it skips; each of them is of an earlier round.
        parts = settle(todo.join(arcs.select("area_id", "u", "w", "mid"), ["area_id", "u", "w"]))
        tree = tree.unionByName(parts.filter("mid IS NULL").select("od_id", F.col("w").alias("edge"), F.col("u").alias("prev")))
        short = parts.filter("mid IS NOT NULL")
        if short.isEmpty():
            return met, tree
        todo = short.select("od_id", "area_id", "u", F.col("mid").alias("w")).unionByName(short.select("od_id", "area_id", F.col("mid").alias("u"), "w"))


def shortest_paths(edges: DataFrame, successors: DataFrame, od: DataFrame, cost: str = "distance_m", max_rounds: int = 100_000, arcs: DataFrame | None = None, with_tree: bool = True, searched: int = SEARCHED) -> tuple[DataFrame, DataFrame | None]:
    """Turn-aware shortest paths for many origin/destination pairs at once.

    ``edges``: ``area_id, segment_id, from_node, to_node, <cost>``; ``successors``: allowed ``area_id, incoming, outgoing``; ``od``: ``od_id,
    area_id, origin, destination``. The state is the last edge taken, so a turn is legal or not by how one arrived. Returns
    ``(answers, tree)``: per pair its status, last edge and total, and the predecessor of every edge on its route (see ``reconstruct``).

    The turn graph is contracted first (``arcs`` of an earlier ``contract`` may be given). From the destination the search goes back over arcs to lower
    levels only, from the origin on over arcs to higher levels and through the core; a route is where both meet. Shortcuts are unpacked on the routes found.
    Pairs of an area of at most ``searched`` arcs are searched in tasks, some hundred at a time, so that its arcs travel once. Those of larger areas, of areas with
    costs below 0 or none and pairs named for several areas are searched by rounds of joins: as many as the levels and the hops within the core, not
    the hops of the route. Raises if a search isn't settled after ``max_rounds`` hops or rounds."""
    arcs = contract(edges, successors, cost) if arcs is None else arcs
    e = edges.select("area_id", F.col("segment_id").alias("state"), "from_node", "to_node", F.col(cost).alias("c"))
    asked = od.filter("origin <> destination").select("od_id", "area_id", "origin", "destination")
    start = asked.join(e.withColumnRenamed("from_node", "origin"), ["area_id", "origin"]).select("od_id", "area_id", "state", F.col("c").alias("d"))
    end = asked.join(e.withColumnRenamed("to_node", "destination"), ["area_id", "destination"]).select("od_id", "area_id", "state", F.lit(0.0).alias("d"))
    ends = settle(start.withColumn("starts", F.lit(True)).unionByName(end.withColumn("starts", F.lit(False))))
    sound = lambda c: F.coalesce((F.col(c) >= 0) & ~F.isnan(c), F.lit(False))
    sizes = settle(arcs.groupBy("area_id").agg(F.count("*").alias("n"), F.min(sound("c")).alias("ok")))
    joined = ends.join(sizes.filter(f"n > {searched} OR NOT ok").select("area_id", F.lit(True).alias("_large")), "area_id", "left").groupBy("od_id")
    joined = settle(joined.agg(F.max(F.coalesce("_large", F.lit(False)) | ~sound("d")).alias("_by"), (F.min("area_id") < F.max("area_id")).alias("_several")).filter("_by OR _several").select("od_id"))
    several = not joined.isEmpty()

    own = ends.filter("od_id IS NOT NULL").join(joined, "od_id", "left_anti") if several else ends.filter("od_id IS NOT NULL")
    parts = own.groupBy("area_id").agg(F.ceil(F.approx_count_distinct("od_id") / PAIRS).cast("int").alias("_parts")).join(sizes, "area_id", "left")
    small = F.coalesce("n", F.lit(0)) <= SMALL
    n_steps = int((sizes.agg(F.sum("n")).first()[0] or 0) // SMALL) + 1
    # Areas of few arcs share a step, others have one or, for many pairs, several.
    parts = settle(parts.select("area_id", "_parts", F.when(small, F.pmod(F.xxhash64("area_id"), F.lit(n_steps))).otherwise(F.xxhash64("area_id")).alias("_home")))
    step = F.xxhash64("_home", "_part").alias("_step")
    dealt = own.join(parts, "area_id").withColumn("_part", F.pmod(F.xxhash64("od_id"), F.col("_parts"))).select("od_id", "area_id", "state", "d", "starts", step)
    copies = arcs.join(parts, "area_id").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts").cast("long") - 1)))
    copies = copies.filter("u IS NOT NULL AND w IS NOT NULL").select("area_id", "u", "w", F.col("c").cast("double").alias("c"), "mid", "lu", "lw", step)
    found = copies.groupBy("_step").cogroup(dealt.groupBy("_step")).applyInArrow(
        lambda a, o: _searched(a, o, max_rounds, with_tree), f"od_id {od.schema['od_id'].dataType.simpleString()}, total double, edge string, prev string"
    )
    found = settle(found)
    if not found.filter("total < 0").isEmpty():
        raise RuntimeError(f"routes are not settled after {max_rounds} rounds")
    met = found.filter("total IS NOT NULL").select("od_id", "total", F.col("edge").alias("last_edge"))
    tree = found.filter("total IS NULL").select("od_id", "edge", "prev") if with_tree else None
    if several:
        rest = ends.join(joined, "od_id", "left_semi")
        of = lambda begins: rest.filter("starts" if begins else "NOT starts").drop("starts")
        more_met, more_tree = _searched_by_joins(arcs, of(True), of(False), max_rounds, with_tree)
        met, tree = met.unionByName(more_met), tree.unionByName(more_tree) if with_tree else None
    same = F.col("origin") == F.col("destination")
    answers = od.join(met, "od_id", "left").select(
        "od_id", "area_id", "origin", "destination", F.when(same | F.col("total").isNotNull(), "ok").otherwise("no_route").alias("status"),
        F.when(same, F.lit(0.0)).otherwise(F.col("total")).alias("total_m"), "last_edge",
    )
    return (answers, tree) if with_tree else (answers.drop("last_edge"), None)


def _in_order(answers: pa.Table, tree: pa.Table) -> pa.Table:
    """``reconstruct`` of some whole routes."""
    column = lambda t, c: t[c].combine_chunks()
    n, m = len(tree), len(answers)
    pairs = pa.concat_arrays([column(tree, "od_id"), column(answers, "od_id")]).dictionary_encode()
    names = pa.concat_arrays([column(tree, "edge"), column(tree, "prev"), column(answers, "last_edge")]).dictionary_encode()
    pair, name = pairs.indices.to_numpy(), names.indices.to_numpy()
    many = len(names.dictionary)
    edge, prev, last = pair[:n] * np.int64(many) + name[:n], pair[:n] * np.int64(many) + name[n : 2 * n], pair[n:] * np.int64(many) + name[2 * n :]
    order = np.argsort(edge)
    edge, prev = edge[order], prev[order]

    def row_of(key):
        at = np.minimum(np.searchsorted(edge, key), max(n - 1, 0))
        return np.where(edge[at] == key, at, -1) if n else np.full(len(key), -1)

    before, at = row_of(prev).tolist(), row_of(last).tolist()
    routes, whose, back = [], [], []
    for k in range(m):
        rows, i = [], at[k]
        while i >= 0:
            rows.append(i)
            i = before[i]
            if len(rows) > n:
                raise RuntimeError("a route goes round")
        routes.append(np.concatenate([last[k : k + 1], prev[rows]]) if rows else last[k : k + 1])
        whose.append(np.full(len(rows) + 1, pair[n + k]))
        back.append(np.arange(len(rows) + 1))
    key, whose, back = (np.concatenate(x) if x else np.zeros(0, "int64") for x in (routes, whose, back))
    length = np.zeros(len(pairs.dictionary), "int64")
    np.maximum.at(length, whose, back)
    hop = (length[whose] - back + 1).astype("int32")
    return pa.Table.from_arrays([pairs.dictionary.take(pa.array(whose)), names.dictionary.take(pa.array(key % max(many, 1))), pa.array(hop)], names=["od_id", "edge", "hop"])


def reconstruct(answers: DataFrame, tree: DataFrame, searched: int = SEARCHED) -> DataFrame:
    """Every edge of every route with its hop number from the start (1-based).

    Routes whose tree has at most ``searched`` edges are put in order in tasks, some together. Longer ones by pointer doubling: tables of the 1st, 2nd, 4th ...
    predecessor, each the join of the one before with itself, until none reaches that far; then from the last edge back, longest jump first, each table doubles
    what is known of the routes. A route of ``n`` hops takes ``2 log2 n`` joins."""
    links = tree.filter("prev IS NOT NULL AND od_id IS NOT NULL").select("od_id", "edge", "prev")
    asked = answers.filter("last_edge IS NOT NULL AND od_id IS NOT NULL").select("od_id", "last_edge")
    sizes = settle(links.groupBy("od_id").agg(F.count("*").alias("_n"), F.count_distinct("edge").alias("_edges")))
    # An edge with several before it branches.
    large = sizes.filter(f"_n > {searched} OR _edges < _n").select("od_id")
    several = not large.isEmpty()
    n_steps = int((sizes.agg(F.sum("_n")).first()[0] or 0) // SMALL) + 1
    home = lambda df: (df.join(large, "od_id", "left_anti") if several else df).join(sizes, "od_id", "left").withColumn("_step", F.when(F.coalesce("_n", F.lit(0)) <= SMALL, F.pmod(F.xxhash64("od_id"), F.lit(n_steps))).otherwise(F.xxhash64("od_id"))).drop("_n", "_edges")
    ordered = home(asked).groupBy("_step").cogroup(home(links).groupBy("_step"))
    out = ordered.applyInArrow(lambda a, t: _in_order(a, t), f"od_id {answers.schema['od_id'].dataType.simpleString()}, edge {answers.schema['last_edge'].dataType.simpleString()}, hop int")
    if not several:
        return out
    jumps = [settle(links.join(large, "od_id", "left_semi").select("od_id", "edge", F.col("prev").alias("to")))]
    while not jumps[-1].isEmpty():
        far = jumps[-1].select("od_id", F.col("edge").alias("to"), F.col("to").alias("further"))
        jumps.append(settle(jumps[-1].join(far, ["od_id", "to"]).select("od_id", "edge", F.col("further").alias("to"))))
    known = asked.join(large, "od_id", "left_semi").select("od_id", F.col("last_edge").alias("edge"), F.lit(0).alias("back"))
    for k in range(len(jumps) - 2, -1, -1):
        more = known.join(jumps[k], ["od_id", "edge"]).select("od_id", F.col("to").alias("edge"), (F.col("back") + (1 << k)).alias("back"))
        known = settle(known.unionByName(more))
    length = known.groupBy("od_id").agg(F.max("back").alias("_n"))
    return out.unionByName(known.join(length, "od_id").select("od_id", "edge", (F.col("_n") - F.col("back") + 1).alias("hop")))


def route_lines(hops: DataFrame, segments: DataFrame) -> DataFrame:
    """Per route its segments, nodes and merged geometry in order (a route's length bounds the collected rows)."""
    j = hops.join(segments.select(F.col("segment_id").alias("edge"), "from_node", "to_node", "line", "distance_m"), "edge")
    g = j.groupBy("od_id").agg(F.array_sort(F.collect_list(F.struct("hop", "edge", "from_node", "to_node", "line"))).alias("h"), F.sum("distance_m").alias("total_m"))
    tail = F.flatten(F.transform(F.slice("h", F.lit(2), F.size("h")), lambda x: F.slice(x["line"], F.lit(2), F.size(x["line"]))))
    return g.select(
        "od_id", F.transform("h", lambda x: x["edge"]).alias("segments"),
        F.concat(F.array(F.col("h")[0]["from_node"]), F.transform("h", lambda x: x["to_node"])).alias("nodes"),
        F.concat(F.col("h")[0]["line"], tail).alias("line"), "total_m",
    )


def snap_flag(distance):
    """Whether a route end lies farther than 25 m from the requested point."""
    return F.coalesce(geo.col(distance) > 25.0, F.lit(False))


