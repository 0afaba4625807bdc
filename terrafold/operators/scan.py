"""Ordered scans that never put one group into one task.

A plain ``Window.partitionBy(group)`` sends a whole group to one task; a group holding a third of all rows
would stall there. Here rows are range-partitioned by (group, order), scanned inside each slice, and the
slice totals (one row per slice and group) are carried over. Numbers, running sums and running maxima
come out exactly as the plain window would give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.session import settle


def sliced(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_slice``: increasing along (group, order), stored once so that every reader sees the
    same slices even when an executor is lost."""
    ranged = df.repartitionByRange(*[F.col(c) for c in [*group, *order]])
    return settle(ranged.withColumn("_slice", F.spark_partition_id()))


def prefix_scan(
    df: DataFrame,
    group: list[str],
    order: list[str],
    number: str | None = None,
    sums: dict[str, str] | None = None,
    maxes: dict[str, str] | None = None,
    previous_max: dict[str, str] | None = None,
) -> DataFrame:
    """Add columns along ``order`` within ``group``.

    ``number``: 1-based position. ``sums``: output -> column, inclusive running sum. ``maxes``: inclusive running
    maximum. ``previous_max``: running maximum over the rows before, NULL on the first. ``order`` must be unique in the group
    for stable positions."""
    sums, maxes, previous_max = sums or {}, maxes or {}, previous_max or {}
    base = sliced(df, group, order)
    by_order = [F.col(c) for c in order]
    here = W.partitionBy(*group, "_slice").orderBy(*by_order)
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = here.rowsBetween(W.unboundedPreceding, -1)
    local: list[Column] = []
    if number:
        local.append(F.row_number().over(here).alias("_n"))
    local += [F.sum(c).over(upto).alias(f"_s_{o}") for o, c in sums.items()]
    local += [F.max(c).over(upto).alias(f"_m_{o}") for o, c in maxes.items()]
    local += [F.max(c).over(before).alias(f"_p_{o}") for o, c in previous_max.items()]
    scanned = base.select("*", *local)
    # Slice totals: one row per (group, slice). Groups that fit in one slice carry nothing over, so only
    # groups split over several slices reach the second window, at most one row per slice each.
    totals = base.groupBy(*group, "_slice").agg(
        F.count("*").alias("_cn"),
        *(F.sum(c).alias(f"_cs_{o}") for o, c in sums.items()),
        *(F.max(c).alias(f"_cm_{o}") for o, c in {**maxes, **previous_max}.items()),
    )
    earlier = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *group,
        "_slice",
        F.coalesce(F.sum("_cn").over(earlier), F.lit(0)).alias("_on"),
        *(F.coalesce(F.sum(f"_cs_{o}").over(earlier), F.lit(0)).alias(f"_os_{o}") for o in sums),
        *(F.max(f"_cm_{o}").over(earlier).alias(f"_om_{o}") for o in {**maxes, **previous_max}),
    ).filter("_on > 0")
    keys = [scanned[c].eqNullSafe(carry[c]) for c in group] + [scanned["_slice"] == carry["_slice"]]
    joined = scanned.join(carry, keys, "left")
    out = [scanned[c] for c in df.columns]
    if number:
        out.append((F.col("_n") + F.coalesce(F.col("_on"), F.lit(0))).cast("bigint").alias(number))
    out += [(F.col(f"_s_{o}") + F.coalesce(F.col(f"_os_{o}"), F.lit(0))).alias(o) for o in sums]
    out += [F.greatest(F.col(f"_m_{o}"), F.col(f"_om_{o}")).alias(o) for o in maxes]
    out += [F.greatest(F.col(f"_p_{o}"), F.col(f"_om_{o}")).alias(o) for o in previous_max]
    return joined.select(*out)


def exact_quantiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact inclusive quantiles (linear interpolation) per group.

    Equal values are counted before the shuffle; the counts are scanned in slices; only the one or two
    values around each quantile survive into the last aggregate."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_k"))
    ranked = prefix_scan(counted, group, [value], sums={"_to": "_k"})
    totals = ranked.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group]).agg(F.max("_to").alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    at = ranked.join(totals, same).select(*group, F.col(value).cast("double").alias("_v"), "_to", (F.col("_to") - F.col("_k")).alias("_from"), "_n")
    aggs = []
    for name, share in shares.items():
        position = (F.col("_n") - 1) * share  # 0-based
        low = F.floor(position)
        holds = lambda p: (p >= F.col("_from")) & (p < F.col("_to"))
        lo = F.max(F.when(holds(low), F.col("_v")))
        hi = F.max(F.when(holds(F.least(low + 1, F.col("_n") - 1)), F.col("_v")))
        part = F.max(position - low)
        aggs.append((lo + (hi - lo) * part).alias(name))
    return at.groupBy(*group).agg(*aggs, F.max("_n").alias("n"))


def spread(df: DataFrame, group: list[str], value: str, prefix: str) -> DataFrame:
    """``<prefix>_median`` and ``<prefix>_iqr`` (inclusive quartiles; 0 under two values)."""
    qs = exact_quantiles(df, group, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    return qs.select(
        *group, F.col("_q2").alias(f"{prefix}_median"), F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("_q3") - F.col("_q1")).alias(f"{prefix}_iqr")
    )


def union_length(intervals: DataFrame, group: list[str], start: str = "start_m", end: str = "end_m") -> DataFrame:
    """Length covered by the intervals of each group, overlaps counted once."""
    scanned = prefix_scan(intervals.select(*group, start, end).distinct(), group, [start, end], previous_max={"_reach": end})
    own = F.col(end) - F.greatest(F.col(start), F.coalesce(F.col("_reach"), F.col(start)))
    return scanned.groupBy(*group).agg(F.sum(F.greatest(own, F.lit(0.0))).alias("covered_m"))


def side_gaps(intervals: DataFrame, group: list[str], start: str = "start_m", end: str = "end_m", tie: list[str] | None = None) -> DataFrame:
    """One row per interval but the first: its start minus the furthest end before it, at least 0."""
    scanned = prefix_scan(intervals, group, [start, end, *(tie or [])], previous_max={"_reach": end})
    return scanned.filter(F.col("_reach").isNotNull()).withColumn("gap_m", F.greatest(F.col(start) - F.col("_reach"), F.lit(0.0))).drop("_reach")


def coverage(covered, frontage) -> Column:
    covered, frontage = (F.col(c) if isinstance(c, str) else c for c in (covered, frontage))
    return F.when(frontage > 0, covered / frontage).otherwise(F.lit(0.0))


def batches(df: DataFrame, group: list[str], order: list[str], size: int = 500) -> DataFrame:
    """0-based ``batch`` of ``size`` rows along the order."""
    numbered = prefix_scan(df, group, order, number="_pos")
    return numbered.withColumn("batch", F.floor((F.col("_pos") - 1) / size).cast("bigint")).drop("_pos")


def ring_batches(df: DataFrame, group: list[str], lat: str, lon: str, c_lat: str, c_lon: str, tie: str, width_m: float = 100.0) -> DataFrame:
    """Concentric rings around a centre: ``distance_m``, dense ``ring`` (0-based, empty rings skipped) and ``position``
    along (distance, tie) within the ring."""
    from terrafold.functions import geo

    flat = F.hypot((F.col(lon) - F.col(c_lon)) * geo.meters_per_degree_lon(c_lat), (F.col(lat) - F.col(c_lat)) * geo.METERS_PER_DEGREE)
    placed = df.withColumn("distance_m", flat).withColumn("_ring", F.floor(F.col("distance_m") / width_m))
    # Rings are few (at most box diagonal / width), so ranking them is a small window over distinct values.
    rings = placed.select(*group, "_ring").distinct()
    rings = rings.withColumn("ring", F.dense_rank().over(W.partitionBy(*group).orderBy("_ring")) - 1)
    numbered = prefix_scan(placed, [*group, "_ring"], ["distance_m", tie], number="position")
    return numbered.join(rings, [*group, "_ring"]).drop("_ring")


def even_sample(df: DataFrame, group: list[str], order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows per group at positions floor(i * n / limit)."""
    numbered = prefix_scan(df, group, order, number="_pos")
    totals = numbered.groupBy(*group).agg(F.max("_pos").alias("_n"))
    j = numbered.join(totals, group)
    # Row p (0-based) is picked when some i in [0, limit) has floor(i * n / limit) = p.
    p, n = F.col("_pos") - 1, F.col("_n")
    i = F.ceil(p * limit / n)
    picked = (n <= limit) | ((i < limit) & (F.floor(i * n / limit) == p))
    return j.filter(picked).drop("_pos", "_n")


def farthest_pairs(points: DataFrame, group: list[str], key: str, count: int = 3, sample: int = 60) -> DataFrame:
    """The ``count`` farthest pairs per group among an even sample of at most ``sample`` points (``lat``, ``lon``). The sample
    bounds the pairs, so they are built inside one bounded array per group."""
    from terrafold.functions import geo

    picked = even_sample(points, group, [key], sample)
    pool = picked.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(key, "lat", "lon"))).alias("_pool"))
    pairs = pool.select(*group, "_pool", F.posexplode("_pool").alias("_i", "_a")).select(
        *group, "_a", F.explode(F.slice("_pool", F.col("_i") + 2, F.lit(sample))).alias("_b")
    )
    pairs = pairs.withColumn("distance_m", geo.ground_distance("_a.lat", "_a.lon", "_b.lat", "_b.lon"))
    ranked = pairs.withColumn(
        "rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("distance_m"), f"_a.{key}", f"_b.{key}"))
    )
    return ranked.filter(F.col("rank") <= count).select(*group, "rank", F.col(f"_a.{key}").alias("a"), F.col(f"_b.{key}").alias("b"), "distance_m")
