"""Aggregations, ordered scans, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import scan
from terrafold.plans import oracle as o
from terrafold.plans.registry import query
from terrafold.plans.views import Views


@query(
    "interval_spread",
    f"""SELECT group_id, {o.r6('quantile_cont(price, 0.5)')} AS price_median,
       {o.r6('CASE WHEN count(*) < 2 THEN 0 ELSE quantile_cont(price, 0.75) - quantile_cont(price, 0.25) END')} AS price_iqr FROM interval_v GROUP BY group_id""",
    ["interval"],
)
def interval_spread(v: Views):
    s = scan.spread(v.interval, ["group_id"], "price", "price")
    return s.select("group_id", F.round("price_median", 6).alias("price_median"), F.round("price_iqr", 6).alias("price_iqr"))


@query(
    "union_length",
    """SELECT group_id, sum(greatest(end_m - greatest(start_m, coalesce(reach, start_m)), 0)) AS covered_m FROM (
       SELECT *, max(end_m) OVER (PARTITION BY group_id ORDER BY start_m, end_m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM
       (SELECT DISTINCT group_id, start_m, end_m FROM interval_v) i) t GROUP BY group_id""",
    ["interval"],
)
def union_length(v: Views):
    return scan.union_length(v.interval, ["group_id"])


@query(
    "side_gaps",
    """SELECT group_id, line, greatest(start_m - reach, 0.0) AS gap_m FROM (
       SELECT *, max(end_m) OVER (PARTITION BY group_id ORDER BY start_m, end_m, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM interval_v) t
       WHERE reach IS NOT NULL""",
    ["interval"],
)
def side_gaps(v: Views):
    return scan.side_gaps(v.interval, ["group_id"], tie=["line"]).select("group_id", "line", "gap_m")


@query(
    "frontage_coverage",
    f"""SELECT group_id, {o.r6('CASE WHEN f > 0 THEN c / f ELSE 0 END')} AS coverage FROM (SELECT u.group_id, c, f FROM
       (SELECT group_id, sum(greatest(end_m - greatest(start_m, coalesce(reach, start_m)), 0)) AS c FROM (
         SELECT *, max(end_m) OVER (PARTITION BY group_id ORDER BY start_m, end_m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM
         (SELECT DISTINCT group_id, start_m, end_m FROM interval_v) i) t GROUP BY group_id) u
       JOIN (SELECT group_id, max(end_m) - min(start_m) AS f FROM interval_v GROUP BY group_id) g USING (group_id)) z""",
    ["interval"],
)
def frontage_coverage(v: Views):
    frontage = v.interval.groupBy("group_id").agg((F.max("end_m") - F.min("start_m")).alias("f"))
    return scan.union_length(v.interval, ["group_id"]).join(frontage, "group_id").select(
        "group_id", F.round(scan.coverage("covered_m", "f"), 6).alias("coverage")
    )


@query("poi_batches", "SELECT source_id, area_id, CAST((row_number() OVER (PARTITION BY area_id ORDER BY source_id) - 1) // 50 AS BIGINT) AS batch FROM poi_v", ["poi"])
def poi_batches(v: Views):
    return scan.batches(v.poi.select("source_id", "area_id"), ["area_id"], ["source_id"], 50)


RING_D = f"sqrt(power((lon - c_lon) * {o.MPD} * cos(radians(c_lat)), 2) + power((lat - c_lat) * {o.MPD}, 2))"


@query(
    "building_rings",
    f"""SELECT source_id, area_id, CAST(dense_rank() OVER (PARTITION BY area_id ORDER BY floor(d / 100)) - 1 AS INT) AS ring,
       row_number() OVER (PARTITION BY area_id, floor(d / 100) ORDER BY d, source_id) AS position
       FROM (SELECT source_id, b.area_id, {RING_D} AS d FROM building_v b JOIN (SELECT area_id, (min_lat + max_lat) / 2 AS c_lat, (min_lon + max_lon) / 2 AS c_lon FROM town_v) t USING (area_id)) x""",
    ["building", "town"],
)
def building_rings(v: Views):
    t = v.town.select("area_id", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("c_lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("c_lon"))
    b = v.building.select("source_id", "area_id", "lat", "lon").join(t, "area_id")
    return scan.ring_batches(b, ["area_id"], "lat", "lon", "c_lat", "c_lon", "source_id").select("source_id", "area_id", "ring", "position")


@query(
    "farthest_node_pairs",
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY node_id) - 1 AS p, count(*) OVER (PARTITION BY area_id) AS n FROM node_v),
       picked AS (SELECT DISTINCT s.* FROM s JOIN range(0, 60) r(i) ON (n > 60 AND p = floor(i * n / 60)) OR (n <= 60 AND p = i)),
       d AS (SELECT a.area_id, a.node_id AS a, b.node_id AS b, sqrt(power((a.lon - b.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + power(a.lat - b.lat, 2)) * {o.MPD} AS dist
             FROM picked a JOIN picked b ON a.area_id = b.area_id AND a.node_id < b.node_id)
       SELECT area_id, CAST(rk AS INT) AS rank, a, b, {o.rn('dist', 4)} AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY dist DESC, a, b) AS rk FROM d) t WHERE rk <= 3""",
    ["node"],
)
def farthest_node_pairs(v: Views):
    return scan.farthest_pairs(v.node, ["area_id"], "node_id").withColumn("distance_m", F.round("distance_m", 4))


@query("line_union", "SELECT kind, count(*) AS n FROM (SELECT 'node' AS kind, node_id AS id FROM node_v UNION ALL SELECT 'town', area_id FROM town_v) u GROUP BY kind", ["node", "town"])
def line_union(v: Views):
    u = v.node.select(F.lit("node").alias("kind"), F.col("node_id").alias("id")).unionByName(v.town.select(F.lit("town").alias("kind"), F.col("area_id").alias("id")))
    return u.groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "key_set_difference",
    """SELECT 'gone' AS side, k FROM (SELECT k FROM poi_v WHERE k % 3 <> 0 EXCEPT SELECT k FROM poi_v WHERE k % 5 <> 0) a
       UNION ALL SELECT 'kept', k FROM (SELECT k FROM poi_v WHERE k % 3 <> 0 INTERSECT SELECT k FROM poi_v WHERE k % 5 <> 0) b""",
    ["poi"],
)
def key_set_difference(v: Views):
    old, new = v.poi.filter("k % 3 <> 0").select("k"), v.poi.filter("k % 5 <> 0").select("k")
    gone, kept = old.subtract(new), old.intersect(new)
    return gone.select(F.lit("gone").alias("side"), "k").unionByName(kept.select(F.lit("kept").alias("side"), "k"))


@query(
    "equal_segment_sets",
    """SELECT key, count(*) AS n FROM (SELECT group_id, string_agg(DISTINCT CAST(qty % 4 AS VARCHAR), ',' ORDER BY CAST(qty % 4 AS VARCHAR)) AS key FROM interval_v GROUP BY group_id) t GROUP BY key""",
    ["interval"],
)
def equal_segment_sets(v: Views):
    # Distinct members first: the set that is collected holds at most the distinct ids of one face.
    members = v.interval.select("group_id", (F.col("qty") % 4).cast("string").alias("m")).distinct()
    keys = members.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"))
