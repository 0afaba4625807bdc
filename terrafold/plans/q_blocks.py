"""Block analytics over plots and houses."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.operators import blocks
from terrafold.plans import oracle as o
from terrafold.plans.elements import staged
from terrafold.plans.q_geometry import unit_sql
from terrafold.plans.registry import query
from terrafold.plans.views import Views
from terrafold.session import settle

VIEWS = ["plot", "house"]


def rings(v: Views):
    return v.plot.select("block_id", F.lit(0).alias("ring_index"), "ring")


@query("frontage_edges", "SELECT block_id, CAST(i AS INT) AS edge_index, CASE WHEN i % 2 = 0 THEN w ELSE h END AS length_m FROM plot_v, range(0, 4) r(i)", VIEWS)
def frontage_edges(v: Views):
    return blocks.frontage_edges(rings(v)).select("block_id", "edge_index", "length_m")


SAMPLES = """smp AS (SELECT block_id, CAST(i AS INT) AS idx, w, h, CAST(2 * (w + h) AS INT) AS n,
    CASE WHEN i < w THEN i + 0.5 WHEN i < w + h THEN w WHEN i < 2 * w + h THEN w - (i - w - h) - 0.5 ELSE 0 END::DOUBLE AS x,
    CASE WHEN i < w THEN 0 WHEN i < w + h THEN i - w + 0.5 WHEN i < 2 * w + h THEN h ELSE h - (i - 2 * w - h) - 0.5 END::DOUBLE AS y,
    CASE WHEN i < w THEN 0 WHEN i < w + h THEN -1 WHEN i < 2 * w + h THEN 0 ELSE 1 END::DOUBLE AS nx, CASE WHEN i < w THEN 1 WHEN i < w + h THEN 0 WHEN i < 2 * w + h THEN -1 ELSE 0 END::DOUBLE AS ny
    FROM plot_v, range(0, 400) r(i) WHERE i < 2 * (w + h))"""
HITS = SAMPLES + """,
  cand AS (SELECT s.block_id, s.idx, b.building_id, CASE WHEN ny = 1 AND x BETWEEN x0 AND x1 THEN y0 WHEN ny = -1 AND x BETWEEN x0 AND x1 THEN h - y1
       WHEN nx = -1 AND y BETWEEN y0 AND y1 THEN w - x1 WHEN nx = 1 AND y BETWEEN y0 AND y1 THEN x0 END AS d FROM smp s JOIN house_v b USING (block_id)),
  hit AS (SELECT s.block_id, s.idx, s.n, b.building_id, b.d FROM smp s LEFT JOIN (SELECT block_id, idx, arg_min(building_id, (d, building_id)) AS building_id, min(d) AS d FROM cand WHERE d <= 25 GROUP BY block_id, idx) b USING (block_id, idx))"""


@query("frontage_samples", f"WITH {SAMPLES} SELECT block_id, idx, {o.r6('x')} AS x, {o.r6('y')} AS y, {o.r6('nx')} AS nx, {o.r6('ny')} AS ny FROM smp", VIEWS)
def frontage_samples(v: Views):
    return blocks.frontage_samples(rings(v)).select("block_id", "idx", *(geo.rounded(c, 6).alias(c) for c in ("x", "y", "nx", "ny")))


def hits_of(v: Views):
    return staged(v, "frontage_hits", lambda: blocks.ray_hits(blocks.frontage_samples(rings(v)), v.house.select("block_id", "building_id", "ring")))


@query("frontage_hits", f"WITH {HITS} SELECT block_id, idx, building_id, {o.r6('d')} AS hit_m FROM hit WHERE building_id IS NOT NULL", VIEWS)
def frontage_hits(v: Views):
    return hits_of(v).filter("building_id IS NOT NULL").select("block_id", "idx", "building_id", F.round("hit_m", 6).alias("hit_m"))


RUNS = HITS + """,
  ch AS (SELECT *, CASE WHEN building_id IS DISTINCT FROM coalesce(lag(building_id) OVER w, CASE WHEN idx = 0 THEN last_value(building_id) OVER full_w END) THEN 1 ELSE 0 END AS new
         FROM hit WINDOW w AS (PARTITION BY block_id ORDER BY idx), full_w AS (PARTITION BY block_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  cu AS (SELECT *, sum(new) OVER (PARTITION BY block_id ORDER BY idx) AS cum, sum(new) OVER (PARTITION BY block_id) AS al FROM ch),
  run AS (SELECT block_id, CASE WHEN al = 0 THEN 1 WHEN cum = 0 THEN al ELSE cum END AS seq, any_value(building_id) AS building_id, coalesce(min(CASE WHEN new = 1 THEN idx END), 0)::DOUBLE AS start_m,
          count(*)::DOUBLE AS size_m, greatest(max(al), 1) AS n_runs, any_value(n) AS n FROM cu GROUP BY ALL)"""


@query("frontage_runs", f"WITH {RUNS} SELECT block_id, CAST(seq AS BIGINT) AS seq, building_id, {o.r6('start_m')} AS start_m, {o.r6('size_m')} AS size_m FROM run", VIEWS)
def frontage_runs(v: Views):
    r = blocks.frontage_runs(hits_of(v))
    return r.select("block_id", F.col("seq").cast("bigint").alias("seq"), "building_id", F.round("start_m", 6).alias("start_m"), F.round("size_m", 6).alias("size_m"))


GAPS = RUNS + """,
  nb AS (SELECT *, CASE WHEN seq = 1 THEN last_value(building_id) OVER f ELSE lag(building_id) OVER o END AS p, CASE WHEN seq = n_runs THEN first_value(building_id) OVER f ELSE lead(building_id) OVER o END AS x
         FROM run WINDOW o AS (PARTITION BY block_id ORDER BY seq), f AS (PARTITION BY block_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  gap AS (SELECT block_id, CASE WHEN building_id IS NULL AND n_runs > 2 AND p IS DISTINCT FROM x THEN size_m WHEN building_id IS NOT NULL AND x IS NOT NULL AND building_id <> x THEN 0 END AS gap_m FROM nb)"""


@query("frontage_gaps", f"WITH {GAPS} SELECT block_id, count(*) AS n, {o.r6('sum(gap_m)')} AS total_m FROM gap WHERE gap_m IS NOT NULL GROUP BY block_id", VIEWS)
def frontage_gaps(v: Views):
    g = blocks.run_gaps(blocks.frontage_runs(hits_of(v)))
    return g.groupBy("block_id").agg(F.count("*").alias("n"), F.round(F.sum("gap_m"), 6).alias("total_m"))


MEASURES = GAPS + """,
  longest AS (SELECT block_id, building_id, arg_min(start_m, (-size_m, start_m)) AS start_m, max(size_m) AS width_m FROM run WHERE building_id IS NOT NULL GROUP BY block_id, building_id),
  sb AS (SELECT block_id, building_id, median(d) AS setback FROM hit WHERE building_id IS NOT NULL GROUP BY block_id, building_id),
  far AS (SELECT block_id, building_id, least(x0, y0, w - x1, h - y1) AS d FROM house_v JOIN plot_v USING (block_id)),
  meas AS (SELECT b.block_id, b.building_id, coalesce(l.start_m, 0) AS start_m, coalesce(l.width_m, 0) AS width_m, levels,
      CASE WHEN l.building_id IS NULL THEN 0 WHEN mid < w OR mid BETWEEN w + h AND 2 * w + h THEN y1 - y0 ELSE x1 - x0 END AS depth_m, coalesce(setback, far.d) AS setback
    FROM house_v b JOIN plot_v USING (block_id) LEFT JOIN (SELECT *, (start_m + width_m / 2) AS mid FROM longest) l ON l.block_id = b.block_id AND l.building_id = b.building_id
    LEFT JOIN sb ON sb.block_id = b.block_id AND sb.building_id = b.building_id JOIN far ON far.block_id = b.block_id AND far.building_id = b.building_id)"""


_MEASURED: dict = {}


def measured(v: Views):
    """(measures, fingerprints), each written once per session and data folder."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _MEASURED:
        m, g, c = blocks.measure_blocks(rings(v), v.house.select("block_id", "building_id", "ring", "levels"))
        m = settle(m)
        _MEASURED[key] = (m, settle(blocks.fingerprints(m, g, c)))
    return _MEASURED[key]


@query("building_measures", f"WITH {MEASURES} SELECT block_id, building_id, {o.r6('width_m')} AS width_m, {o.r6('depth_m')} AS depth_m, {o.r6('setback')} AS setback_m FROM meas", VIEWS)
def building_measures(v: Views):
    m = measured(v)[0]
    return m.select("block_id", "building_id", F.round("width_m", 6).alias("width_m"), F.round("depth_m", 6).alias("depth_m"), F.round("front_setback_m", 6).alias("setback_m"))


QC = lambda c, p: f"quantile_cont({c}, {p}) FILTER (WHERE width_m > 0 OR NOT fronts)"
FP = MEASURES + f""",
  fr AS (SELECT *, bool_or(width_m > 0) OVER (PARTITION BY block_id) AS fronts FROM meas),
  fps AS (SELECT block_id, count(*) AS buildings, quantile_cont(levels, 0.5) AS median_levels, {QC('width_m', 0.5)} AS width_median, {QC('width_m', 0.75)} - {QC('width_m', 0.25)} AS width_iqr,
          {QC('depth_m', 0.5)} AS depth_median, {QC('setback', 0.5)} AS setback_median, {QC('setback', 0.75)} - {QC('setback', 0.25)} AS setback_iqr FROM fr GROUP BY block_id),
  gs AS (SELECT block_id, quantile_cont(gap_m, 0.5) AS g, quantile_cont(gap_m, 0.75) - quantile_cont(gap_m, 0.25) AS gi FROM gap WHERE gap_m IS NOT NULL GROUP BY block_id),
  cov AS (SELECT block_id, count(building_id) / count(*) AS coverage FROM hit GROUP BY block_id),
  fp AS (SELECT f.*, coalesce(g, 0) AS gap_median, coalesce(gi, 0) AS gap_iqr, coverage FROM fps f LEFT JOIN gs USING (block_id) JOIN cov USING (block_id))"""


@query(
    "block_fingerprints",
    f"""WITH {FP} SELECT block_id, buildings, {o.r6('median_levels')} AS median_levels, {o.r6('width_median')} AS width_median, {o.r6('width_iqr')} AS width_iqr, {o.r6('depth_median')} AS depth_median,
        {o.r6('setback_median')} AS setback_median, {o.r6('setback_iqr')} AS setback_iqr, {o.r6('gap_median')} AS gap_median, {o.r6('gap_iqr')} AS gap_iqr, {o.r6('coverage')} AS coverage FROM fp""",
    VIEWS,
)
def block_fingerprints(v: Views):
    f = measured(v)[1]
    names = {"median_levels": "median_levels", "width_median": "width_median", "width_iqr": "width_iqr", "depth_median": "depth_median", "front_setback_median": "setback_median",
             "front_setback_iqr": "setback_iqr", "side_gap_median": "gap_median", "side_gap_iqr": "gap_iqr", "coverage": "coverage"}
    return f.select("block_id", "buildings", *(F.round(a, 6).alias(b) for a, b in names.items()))


ELIGIBLE = "NOT is_clipped AND NOT is_median"
# Plots are long; a quarter of their frontage counts as well covered here through the operator's own rule on a scaled coverage.


@query("exemplar_blocks", f"WITH {FP} SELECT block_id FROM fp JOIN plot_v USING (block_id) WHERE {ELIGIBLE} AND coverage * 2 >= 0.7 AND buildings >= 3", VIEWS)
def exemplar_blocks(v: Views):
    f = measured(v)[1].withColumn("coverage", F.col("coverage") * 2)
    return blocks.exemplars(f, v.plot.filter(ELIGIBLE)).select("block_id")


@query(
    "block_road_groups",
    """SELECT k, CASE max(rank) WHEN 1 THEN 'local' WHEN 2 THEN 'local' WHEN 3 THEN 'local' WHEN 4 THEN 'collector' WHEN 5 THEN 'collector' WHEN 6 THEN 'arterial' WHEN 7 THEN 'arterial' WHEN 8 THEN 'arterial' ELSE 'local' END AS road_group
       FROM (SELECT CAST(k AS BIGINT) AS k FROM plot_v) p LEFT JOIN (SELECT group_id AS k, 1 + qty % 8 AS rank FROM interval_v WHERE qty % 3 = 0) i USING (k) GROUP BY k""",
    ["plot", "interval"],
)
def block_road_groups(v: Views):
    names = F.array(*(F.lit(c) for c in blocks.STRENGTH))
    classes = v.interval.filter("qty % 3 = 0").select(F.concat(F.lit("P"), "group_id").alias("block_id"), F.element_at(names, (1 + F.col("qty") % 8).cast("int")).alias("class")).distinct()
    return blocks.road_groups(v.plot, classes).select(F.substring("block_id", 2, 20).cast("bigint").alias("k"), "road_group")


@query(
    "bounding_road_classes",
    f"""SELECT DISTINCT area_id, lrow % 8 AS class FROM node_v""",
    ["node"],
)
def bounding_road_classes(v: Views):
    n = v.node
    members = n.select("area_id", F.col("area_id").alias("block_id"), F.col("node_id").alias("segment_id"))
    segs = n.select("area_id", F.col("node_id").alias("segment_id"), (F.col("lrow") % 8).alias("class"))
    return blocks.block_road_classes(members, segs).select(F.col("block_id").alias("area_id"), "class")


@query(
    "settlement_styles",
    "SELECT k, CASE WHEN k % 200 <= 150 AND k % 5 - 1 < 2 THEN 'informal' WHEN k % 11 < 6 THEN 'sparse' ELSE 'regular' END AS style FROM ping_v",
    ["ping"],
)
def settlement_styles(v: Views):
    k = F.col("k")
    return v.ping.select("k", blocks.settlement_style(blocks.near_low_water(k % 200, k % 5 - 1), k % 11).alias("style"))


LINES = """edge AS (SELECT a.lon AS ax, a.lat AS ay, b.lon AS x2, b.lat AS y2 FROM node_v a JOIN node_v b ON a.area_id = b.area_id AND ((b.lrow = a.lrow AND b.lcol = a.lcol + 1) OR (b.lcol = a.lcol AND b.lrow = a.lrow + 1)))"""
KX = f"({o.MPD} * cos(radians(n.lat)))"


@query(
    "road_densities",
    f"""WITH {LINES}, l AS (SELECT node_id, (ax - n.lon) * {KX} AS x1, (ay - n.lat) * {o.MPD} AS y1, (x2 - n.lon) * {KX} - (ax - n.lon) * {KX} AS dx, (y2 - n.lat) * {o.MPD} - (ay - n.lat) * {o.MPD} AS dy
          FROM node_v n JOIN edge e ON abs(ax - n.lon) < 0.005 AND abs(ay - n.lat) < 0.005),
        c AS (SELECT node_id, dx * dx + dy * dy AS a, x1 * dx + y1 * dy AS b, x1 * x1 + y1 * y1 - 40000 AS c FROM l)
        SELECT node_id, {o.r6("sum(greatest(least(1, (-b + sqrt(b * b - a * c)) / a) - greatest(0, (-b - sqrt(b * b - a * c)) / a), 0) * sqrt(a)) / 1000 / (100000 / 1000000.0::DOUBLE)")} AS density FROM c WHERE b * b - a * c > 0 GROUP BY node_id""",
    ["node"],
)
def road_densities(v: Views):
    from terrafold.plans.q_spatial import lattice_edges

    e = lattice_edges(v).select(*(F.col("line")[i][a].alias(n) for i, a, n in ((0, "x", "ax"), (0, "y", "ay"), (1, "x", "bx"), (1, "y", "by"))))
    c = v.node.select(F.col("node_id").alias("center_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    d = blocks.road_density(c, e, c.select("center_id", F.lit(100000.0).alias("land_m2")), 200.0)
    return d.select(F.col("center_id").alias("node_id"), F.round("road_density", 6).alias("density"))


SCORE = "(CASE WHEN s.block_id = e.block_id THEN -1 ELSE d / 500 + CASE WHEN s.road_group = e.road_group THEN 0 ELSE 1 END + abs(ln(s.area_m2 / e.area_m2)) + CASE WHEN s.style = e.style THEN 0 ELSE 1 END END)"
MATCH = f"""cand AS (SELECT s.block_id, e.block_id AS ref, {SCORE} AS score FROM (SELECT s.*, e.block_id AS eb, {o.hav('s.lat', 's.lon', 'e.lat', 'e.lon')} AS d FROM plot_v s JOIN plot_v e ON e.k % 4 = 1 AND abs(s.lat - e.lat) < 0.005 AND abs(s.lon - e.lon) < 0.005) s
   JOIN plot_v e ON e.block_id = eb WHERE d <= 500),
 best AS (SELECT block_id, arg_min(ref, (round(score, 9), ref)) AS reference_id, min(score) AS score FROM cand GROUP BY block_id)"""


@query(
    "matched_references",
    f"WITH {MATCH} SELECT p.block_id, reference_id, CASE WHEN score >= 0 THEN {o.r6('score')} END AS score FROM plot_v p LEFT JOIN best USING (block_id)",
    ["plot"],
)
def matched_references(v: Views):
    m = blocks.match_references(v.plot, v.plot.filter("k % 4 = 1").drop("k", "ring", "w", "h"))
    return m.select("block_id", "reference_id", F.round("score", 6).alias("score"))


@query(
    "blocks_near_other_areas",
    f"""SELECT p.block_id AS center_id, b.block_id, {o.rn(o.hav('p.lat', 'p.lon', 'b.lat', 'b.lon'), 4)} AS distance_m FROM plot_v p JOIN plot_v b ON {o.hav('p.lat', 'p.lon', 'b.lat', 'b.lon')} <= 500 AND abs(p.lat - b.lat) < 0.005
        WHERE p.area_id <> b.area_id AND b.area_id IN (SELECT area_id FROM area_v WHERE status = 'completed')""",
    ["plot", "area"],
)
def blocks_near_other_areas(v: Views):
    c = v.plot.select(F.col("block_id").alias("center_id"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"), F.col("area_id").alias("own_area"))
    return blocks.blocks_within(c, v.plot, v.area).select("center_id", "block_id", F.round("distance_m", 4).alias("distance_m"))


DEF = lambda i: f"CASE WHEN style = 'informal' THEN {blocks.INFORMAL_DEFAULTS[i]}::DOUBLE WHEN road_group = 'local' THEN {blocks.DEFAULTS['local'][i]}::DOUBLE WHEN road_group = 'collector' THEN {blocks.DEFAULTS['collector'][i]}::DOUBLE ELSE {blocks.DEFAULTS['arterial'][i]}::DOUBLE END"
GAP = f"({DEF(3)}) * CASE WHEN style = 'sparse' THEN 4 ELSE 1 END"


@query(
    "default_fingerprints",
    f"SELECT block_id, {DEF(0)} AS width, {DEF(1)} AS depth, {DEF(2)} AS setback, {GAP} AS gap, round(({GAP}) * 0.2::DOUBLE, 6) AS gap_iqr, {DEF(4)} AS levels FROM plot_v",
    ["plot"],
)
def default_fingerprints(v: Views):
    d = blocks.default_fingerprint("road_group", "style")
    return v.plot.withColumn("d", d).select(
        "block_id", F.col("d.width_median").alias("width"), F.col("d.depth_median").alias("depth"), F.col("d.front_setback_median").alias("setback"), F.col("d.side_gap_median").alias("gap"),
        F.round("d.side_gap_iqr", 6).alias("gap_iqr"), F.col("d.median_levels").alias("levels"),
    )


CALIB = f"""fb AS (SELECT block_id, lat, lon, style, k % 9 AS target, 1 + k % 6 AS generated FROM plot_v WHERE k % 5 = 2),
 cal AS (SELECT p.block_id, greatest(least(sum(f.target) / sum(f.generated), 2), 0.5) AS factor FROM plot_v p JOIN fb f ON p.style = f.style AND abs(p.lat - f.lat) < 0.005 AND {o.hav('p.lat', 'p.lon', 'f.lat', 'f.lon')} <= 500
   WHERE p.k % 5 <> 2 GROUP BY p.block_id HAVING count(*) >= 2)"""


def calibrated(v: Views):
    fb = v.plot.filter("k % 5 = 2").select("block_id", "lat", "lon", "style", (F.col("k") % 9).alias("target"), (1 + F.col("k") % 6).alias("generated"))
    return blocks.calibration(v.plot, fb)


@query("calibration_factors", f"WITH {CALIB} SELECT block_id, {o.r6('factor')} AS factor FROM cal", ["plot"])
def calibration_factors(v: Views):
    return calibrated(v).select("block_id", F.round("factor", 6).alias("factor"))


FEED = "feed AS (SELECT block_id, CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k % 25 AS INT) END AS building_count, k % 3 = 0 AS no_buildings FROM plot_v WHERE k % 5 = 2)"
EFFECTIVE = f"{FP}, {MATCH.replace('cand AS', 'mcand AS').replace('FROM cand', 'FROM mcand')}, {CALIB}, {FEED}" + f""",
  ef AS (SELECT p.block_id, p.area_id, CASE WHEN f.block_id IS NOT NULL THEN reference_id END AS reference_id, coalesce(CASE WHEN f.block_id IS NOT NULL THEN width_median END, {DEF(0)}) / coalesce(factor, 1) AS width_median,
     CASE WHEN f.block_id IS NOT NULL THEN gap_median ELSE {GAP} END AS gap_median, CASE WHEN f.block_id IS NOT NULL THEN setback_median ELSE {DEF(2)} END AS setback_median,
     coalesce(f.median_levels, {DEF(4)}) AS median_levels, f.median_levels IS NOT NULL AS observed, factor,
     CASE WHEN feed.block_id IS NOT NULL THEN 'feedback' WHEN f.block_id IS NOT NULL THEN 'reference' ELSE 'default' END AS count_source, w, h, p.style,
     CASE WHEN feed.block_id IS NOT NULL THEN CASE WHEN no_buildings THEN 0 ELSE building_count END END AS target
     FROM plot_v p LEFT JOIN best b USING (block_id) LEFT JOIN fp f ON f.block_id = reference_id LEFT JOIN cal USING (block_id) LEFT JOIN feed ON feed.block_id = p.block_id),
  capa AS (SELECT *, CAST(2 * greatest(floor((w - setback_median + gap_median) / (width_median + gap_median)), 0) + 2 * greatest(floor((h - setback_median + gap_median) / (width_median + gap_median)), 0) AS BIGINT) AS capacity FROM ef)"""


def feedback_rows(v: Views):
    k = F.col("k")
    return v.plot.filter("k % 5 = 2").select("block_id", F.when(k % 3 != 0, (k % 25).cast("int")).alias("building_count"), (k % 3 == 0).alias("no_buildings"))


def effective(v: Views):
    def build():
        refs = blocks.match_references(v.plot, v.plot.filter("k % 4 = 1").drop("k", "ring", "w", "h"))
        return blocks.effective_fingerprint(v.plot.select("block_id", "road_group", "style"), refs, measured(v)[1], calibrated(v), feedback_rows(v))

    return staged(v, "effective", build)


@query(
    "effective_fingerprints",
    f"WITH {EFFECTIVE} SELECT block_id, reference_id, {o.r6('width_median')} AS width_median, {o.r6('gap_median')} AS gap_median, {o.r6('setback_median')} AS setback_median, {o.r6('median_levels')} AS median_levels, observed, count_source FROM ef",
    VIEWS,
)
def effective_fingerprints(v: Views):
    e = effective(v)
    return e.select(
        "block_id", "reference_id", F.round("width_median", 6).alias("width_median"), F.round("side_gap_median", 6).alias("gap_median"), F.round("front_setback_median", 6).alias("setback_median"),
        F.round("median_levels", 6).alias("median_levels"), F.col("levels_observed").alias("observed"), "count_source",
    )


def capacity(v: Views):
    return blocks.lot_capacity(blocks.frontage_edges(rings(v)), effective(v))


@query("lot_capacities", f"WITH {EFFECTIVE} SELECT block_id, capacity FROM capa", VIEWS)
def lot_capacities(v: Views):
    return capacity(v)


@query(
    "feedback_effects",
    f"WITH {EFFECTIVE} SELECT block_id, coalesce(least(capacity, target), capacity) AS kept, greatest(coalesce(target - capacity, 0), 0) AS shortfall FROM capa",
    VIEWS,
)
def feedback_effects(v: Views):
    return blocks.apply_feedback(capacity(v), feedback_rows(v)).select("block_id", "kept", "shortfall")


@query(
    "run_summaries",
    f"""WITH {EFFECTIVE} SELECT area_id, count(*) AS eligible_blocks, sum(coalesce(least(capacity, target), capacity))::BIGINT AS buildings, count(*) FILTER (WHERE coalesce(least(capacity, target), capacity) > 0) AS blocks_with_buildings,
        round(avg(factor), 3) + 0.0 AS calibration, coalesce(string_agg(block_id, ',' ORDER BY block_id) FILTER (WHERE target > capacity), '') AS shortfall_blocks FROM capa JOIN plot_v USING (block_id, area_id) WHERE {ELIGIBLE} GROUP BY area_id""",
    VIEWS,
)
def run_summaries(v: Views):
    rows = blocks.apply_feedback(capacity(v), feedback_rows(v)).join(v.plot.filter(ELIGIBLE).select("block_id", "area_id"), "block_id").join(calibrated(v), "block_id", "left")
    return blocks.run_summary(rows).withColumn("calibration", F.round("calibration", 3))


@query(
    "planned_levels",
    f"""SELECT block_id, CAST(CASE WHEN k % 2 = 0 AND n <= 2 THEN CASE WHEN {unit_sql('block_id')} < 0.4::DOUBLE THEN 2 ELSE 1 END ELSE n END AS INT) AS levels
        FROM (SELECT block_id, k, greatest(1, CAST(round_even(k % 9 / 2.0::DOUBLE, 0) AS INT)) AS n FROM plot_v) t""",
    ["plot"],
)
def planned_levels(v: Views):
    p = blocks.plan_levels((F.col("k") % 9) / 2.0, F.col("k") % 2 == 1, "block_id", F.lit(0.4))
    return v.plot.select("block_id", p["levels"].alias("levels"))


@query(
    "storey_shares",
    """SELECT block_id, round(coalesce(CASE WHEN n >= 3 THEN t / n END, CASE WHEN an >= 3 THEN ta / an END, 0.3), 6) + 0.0 AS share FROM
       (SELECT block_id, area_id, count(*) FILTER (WHERE levels IN (1, 2)) AS n, count(*) FILTER (WHERE levels = 2) AS t FROM house_v JOIN plot_v USING (block_id) GROUP BY ALL) b
       JOIN (SELECT area_id, count(*) FILTER (WHERE levels IN (1, 2)) AS an, count(*) FILTER (WHERE levels = 2) AS ta FROM house_v JOIN plot_v USING (block_id) GROUP BY ALL) a USING (area_id)""",
    VIEWS,
)
def storey_shares(v: Views):
    h = v.house.join(v.plot.select("block_id", "area_id"), "block_id")
    return blocks.storey_shares(h).select("block_id", F.round("share", 6).alias("share"))


@query(
    "stale_runs",
    "SELECT area_id, concat(CASE WHEN root % 2 = 0 THEN 'roads_changed;' ELSE '' END, CASE WHEN root % 3 = 0 THEN 'terrain_changed;' ELSE '' END) AS reasons FROM area_v",
    ["area"],
)
def stale_runs(v: Views):
    runs = v.area.select("area_id", F.lit("a").alias("hash"), F.when(F.col("root") != 3, 1).alias("version"))
    now = v.area.select("area_id", F.when(F.col("root") % 2 == 0, "b").otherwise("a").alias("hash"), F.when(F.col("root") % 3 == 0, 2).otherwise(1).alias("version"))
    r = blocks.stale_reasons(runs, now)
    return r.select("area_id", F.concat_ws("", F.transform("reasons", lambda x: F.concat(x, F.lit(";")))).alias("reasons"))


@query("assignment_rows", "SELECT area_id, block_id, style, CASE WHEN k % 4 = 1 THEN block_id END AS reference_block_id, CAST(k % 7 AS INT) AS lot_count FROM plot_v", ["plot"])
def assignment_rows(v: Views):
    # Run documents of a hundred blocks each, written as JSON and read back.
    a = F.struct("style", F.when(F.col("k") % 4 == 1, F.col("block_id")).alias("reference_block_id"), (F.col("k") % 7).cast("int").alias("lot_count"))
    doc = v.plot.groupBy("area_id", (F.col("k") - F.col("k") % 100).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("block_id", a.alias("a")))).alias("m"))
    runs = doc.select("area_id", F.to_json("m").alias("blocks"))
    return blocks.read_assignments(runs).select("area_id", "block_id", "style", "reference_block_id", "lot_count")


@query(
    "block_properties",
    """SELECT p.block_id, CASE WHEN is_clipped THEN 'clipped' WHEN is_median THEN 'median' WHEN area_m2 - 2400 < 30 THEN 'no_buildable_area' ELSE 'eligible' END AS eligibility, coalesce(n, 0) AS real_count, 0 AS generated_count, k % 4 = 1 AS is_reference,
       style, CASE WHEN k % 5 = 2 AND k % 3 <> 0 THEN CAST(k % 25 AS INT) END AS feedback_count FROM plot_v p LEFT JOIN (SELECT block_id, count(*) AS n FROM house_v GROUP BY block_id) h USING (block_id)""",
    VIEWS,
)
def block_properties(v: Views):
    b = v.plot.select("block_id", "is_clipped", "is_median", (F.col("area_m2") - 2400).alias("buildable_m2"))
    counts = blocks.counts_per_block(v.plot, v.house, v.house.limit(0))
    assigned = v.plot.select("block_id", "style", F.lit(None).cast("string").alias("reference_block_id"))
    p = blocks.block_properties(b, counts, assigned, v.plot.filter("k % 4 = 1"), feedback_rows(v))
    return p.select("block_id", "eligibility", "real_count", F.col("generated_count").alias("generated_count"), "is_reference", "style", F.col("feedback.building_count").alias("feedback_count"))


# Lattice points of plots placed on the map: water, land use and steep ground by rectangles around every sixth node.
@query(
    "suitability_zones",
    """SELECT block_id, reason, count(*) * 4.0 AS zone_m2 FROM (
       SELECT n.area_id AS block_id, n.node_id, 'landuse' AS reason FROM node_v n WHERE EXISTS (SELECT 1 FROM building_v b WHERE b.k % 6 = 5 AND b.k % 4 = 1 AND abs(b.lat - n.lat) <= b.hy * 8 AND abs(b.lon - n.lon) <= b.hx * 8)
       UNION ALL SELECT area_id, node_id, 'steep' FROM node_v WHERE k % 4 = 0) z GROUP BY block_id, reason""",
    ["node", "building"],
)
def suitability_zones(v: Views):
    pts = v.node.select(F.col("area_id").alias("block_id"), "area_id", F.col("node_id").alias("point_id"), "lat", "lon")
    grow = lambda b: geo.bbox_ring(F.col("lat") - F.col("hy") * 8, F.col("lon") - F.col("hx") * 8, F.col("lat") + F.col("hy") * 8, F.col("lon") + F.col("hx") * 8)
    use = v.building.filter("k % 6 = 5 AND k % 4 = 1").withColumn("ring", grow(None)).select(F.lit("park").alias("kind"), "ring")
    slopes = v.node.select(F.col("node_id").alias("point_id"), F.when(F.col("k") % 4 == 0, 0.5).otherwise(0.1).alias("slope"))
    zones, _ = blocks.suitability(pts, v.building.limit(0), use, slopes, 4.0)
    return zones


