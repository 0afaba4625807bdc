"""Nested areas, ownership, feedback and area bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrafold.functions import geo, rules
from terrafold.operators import cells, spatial

BOX = ("min_lat", "min_lon", "max_lat", "max_lon")


def count_per(df: DataFrame, name: str, key: str = "area_id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def layer_counts(areas: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """One row per area with the size of each layer; one shuffle over all layers together."""
    tagged = None
    for name, df in layers.items():
        part = df.select("area_id", F.lit(name).alias("_layer"))
        tagged = part if tagged is None else tagged.unionByName(part)
    counts = tagged.groupBy("area_id").agg(*(F.count_if(F.col("_layer") == n).alias(n) for n in layers))
    return areas.select("area_id").join(counts, "area_id", "left").select("area_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in layers))


def _inside(inner: str, outer: str) -> Column:
    i, o = (lambda c: F.col(f"{inner}.{c}")), (lambda c: F.col(f"{outer}.{c}"))
    return (i("min_lat") >= o("min_lat")) & (i("min_lon") >= o("min_lon")) & (i("max_lat") <= o("max_lat")) & (i("max_lon") <= o("max_lon"))


def area_pairs(areas: DataFrame, size_m: float = 5000.0) -> DataFrame:
    """(outer_id, inner_id) for every area whose box lies in another area's box. Boxes meet in cells, and a pair is kept in the
    inner box's south-west cell only."""
    small = areas.select(F.col("area_id").alias("inner_id"), F.col("status").alias("inner_status"), *BOX)
    small = cells.with_point_cell(small, "min_lat", "min_lon", size_m).alias("i")
    big = areas.select(F.col("area_id").alias("outer_id"), F.col("status").alias("outer_status"), *BOX)
    big = cells.with_box_cells(big, cells.box_columns(), size_m).alias("o")
    keys = (F.col("i._band") == F.col("o._band")) & (F.col("i._cell") == F.col("o._cell"))
    out = small.join(big, keys).filter((F.col("inner_id") != F.col("outer_id")) & _inside("i", "o"))
    return out.select("outer_id", "outer_status", "inner_id", "inner_status", F.col("i.min_lat").alias("min_lat"), F.col("i.min_lon").alias("min_lon"))


def areas_covered_by(areas: DataFrame) -> DataFrame:
    """Completed inner areas of every area, with their order (south, west, id)."""
    p = area_pairs(areas).filter("inner_status = 'completed'")
    w = W.partitionBy("outer_id").orderBy("min_lat", "min_lon", "inner_id")
    return p.select("outer_id", "inner_id", F.row_number().over(w).alias("rank"))


def areas_covering(areas: DataFrame) -> DataFrame:
    """Completed or importing areas whose box covers an area."""
    return area_pairs(areas).filter(F.col("outer_status").isin("completed", "importing")).select("inner_id", "outer_id")


def deletable(areas: DataFrame) -> DataFrame:
    """Areas that no other area covers."""
    return areas.join(areas_covering(areas).select(F.col("inner_id").alias("area_id")), "area_id", "left_anti")


def owners(areas: DataFrame) -> DataFrame:
    """(outer_id, owner_id, rank): the area itself at rank 0, then its completed inner areas in order."""
    own = rules.completed(areas).select(F.col("area_id").alias("outer_id"), F.col("area_id").alias("owner_id"), F.lit(0).alias("rank"))
    return own.unionByName(areas_covered_by(areas).select("outer_id", F.col("inner_id").alias("owner_id"), "rank"))


def compose_by_source_id(features: DataFrame, owner_ranks: DataFrame) -> DataFrame:
    """The composed layer of every outer area: each source id once, from its first owner. ``min_by`` combines map-side, so a source
    id repeated in very many areas costs one row per task."""
    j = features.join(owner_ranks.withColumnRenamed("owner_id", "area_id"), "area_id")
    cols = [c for c in features.columns]
    return j.groupBy("outer_id", "source_id").agg(F.min_by(F.struct(*cols), "rank").alias("_f")).select("outer_id", "_f.*")


def shadowed(features: DataFrame, owner_ranks: DataFrame) -> DataFrame:
    """Rows a composed layer hides: an earlier owner holds their source id."""
    j = features.join(owner_ranks.withColumnRenamed("owner_id", "area_id"), "area_id")
    best = j.groupBy("outer_id", "source_id").agg(F.min("rank").alias("_best"))
    return j.join(best, ["outer_id", "source_id"]).filter(F.col("rank") > F.col("_best")).drop("_best")


def without_covered(features: DataFrame, areas: DataFrame, line: str | None = None) -> DataFrame:
    """Features of an area that none of its completed inner areas' boxes covers. Points have ``lat, lon``; others their vertices
    in ``line``."""
    pairs = areas_covered_by(areas).select(F.col("outer_id").alias("area_id"), F.col("inner_id").alias("_inner"))
    boxes = pairs.join(areas.select(F.col("area_id").alias("_inner"), *BOX), "_inner")
    env = geo.envelope(line) if line else F.struct(F.col("lat").alias("min_lat"), F.col("lon").alias("min_lon"), F.col("lat").alias("max_lat"), F.col("lon").alias("max_lon"))
    # A box is convex, so covering all vertices is covering their envelope: one cell per feature is enough.
    size = 500.0
    f = features.withColumn("_e", env)
    f = cells.with_point_cell(f, "_e.min_lat", "_e.min_lon", size)
    b = cells.with_box_cells(boxes, cells.box_columns(), size).alias("b")
    f = f.alias("f")
    cond = (
        (F.col("f.area_id") == F.col("b.area_id")) & (F.col("f._band") == F.col("b._band")) & (F.col("f._cell") == F.col("b._cell"))
        & (F.col("f._e.min_lat") >= F.col("b.min_lat")) & (F.col("f._e.max_lat") <= F.col("b.max_lat"))
        & (F.col("f._e.min_lon") >= F.col("b.min_lon")) & (F.col("f._e.max_lon") <= F.col("b.max_lon"))
    )
    return f.join(b, cond, "left_anti").drop("_e", "_band", "_cell")


def composable_blocks(blocks: DataFrame, areas: DataFrame) -> DataFrame:
    """Inner areas' whole blocks that an outer area shows: unclipped, not covered by a block of the outer area, nor by an unclipped
    block of another inner area that is more outer (equal boxes: the lower area id wins).

    ``blocks`` has ``area_id, block_id, ring, is_clipped, lat, lon`` where lat/lon is a point inside."""
    inner = areas_covered_by(areas).select("outer_id", F.col("inner_id").alias("area_id"))
    cand = blocks.filter(~F.col("is_clipped")).join(inner, "area_id").select("outer_id", "area_id", "block_id", "lat", "lon")
    # Which areas' blocks may hide a block of an inner area: those of the outer area, and whole ones of other inner areas that cover it.
    others = inner.select("outer_id", F.col("area_id").alias("holder"))
    covers = area_pairs(areas).select(F.col("outer_id").alias("holder"), F.col("inner_id").alias("area_id")).distinct()
    equal = covers.select(F.col("holder").alias("area_id"), F.col("area_id").alias("holder"), F.lit(True).alias("_equal"))
    more_outer = inner.join(covers, "area_id").join(others, ["outer_id", "holder"], "left_semi").join(equal, ["holder", "area_id"], "left")
    more_outer = more_outer.filter("holder <> area_id AND (_equal IS NULL OR holder < area_id)").select("outer_id", "area_id", "holder", F.lit(True).alias("_whole"))
    hiding = inner.select("outer_id", "area_id", F.col("outer_id").alias("holder"), F.lit(False).alias("_whole")).unionByName(more_outer).distinct()
    probes = cand.join(hiding, ["outer_id", "area_id"]).select("outer_id", "block_id", "lat", "lon", "holder", "_whole")
    rings = blocks.select(F.col("area_id").alias("holder"), F.col("is_clipped").alias("h_clipped"), "ring")
    held = spatial.points_covered(probes, rings, on="holder", also=~F.col("_whole") | (F.col("h_clipped") == F.lit(False))).select("outer_id", "block_id")
    return cand.join(held, ["outer_id", "block_id"], "left_anti")


def feedback_status(feedback: DataFrame, blocks: DataFrame) -> DataFrame:
    """Feedback with ``orphaned`` set when its block is gone."""
    here = blocks.select("block_id", F.lit(True).alias("_here")).distinct()
    return feedback.join(here, "block_id", "left").withColumn("orphaned", F.col("_here").isNull()).drop("_here")


def without_elevation(areas: DataFrame, grids: DataFrame) -> DataFrame:
    return rules.completed(areas).join(grids.select("area_id").distinct(), "area_id", "left_anti")


def without_place(areas: DataFrame) -> DataFrame:
    return areas.filter(F.col("place_name").isNull())


def find_area(requests: DataFrame, areas: DataFrame) -> DataFrame:
    """Existing areas with exactly the requested provider and box."""
    return requests.join(areas.select("area_id", "provider", *BOX), ["provider", *BOX])


def search_areas(areas: DataFrame, text: str, hay: Column, key: str = "recent") -> DataFrame:
    """Areas whose text holds every word; ``rank`` by recent, size or name with the id as tie."""
    words = F.filter(F.split(F.lower(F.lit(text)), r"\s+"), lambda w: w != "")
    hit = areas.withColumn("_h", F.lower(hay)).filter(F.forall(words, lambda w: F.contains(F.col("_h"), w))).drop("_h")
    order = {
        "recent": [F.col("imported_day").desc_nulls_last()],
        "size": [rules.bbox_area_m2(*BOX).desc()],
        "name": [F.col("place_name").isNull(), F.lower("place_name")],
    }[key]
    return hit.orderBy(*order, "area_id")


def pick_featured(areas: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: the first configured candidate (``area_id, rank``) that is completed, else the latest completed area."""
    done = rules.completed(areas)
    configured = done.join(candidates, "area_id").select(done["*"], F.lit(0).alias("_tier"), F.col("rank").cast("bigint").alias("_r"))
    recent = done.withColumn("_tier", F.lit(1)).withColumn("_r", F.lit(0).cast("bigint"))
    return configured.unionByName(recent).orderBy("_tier", "_r", F.coalesce("imported_day", "created_day").desc(), "area_id").limit(1).drop("_tier", "_r")


def set_place(areas: DataFrame, answers: DataFrame) -> DataFrame:
    """New place names where the answer has one; the stored one otherwise."""
    a = answers.select("area_id", F.col("place_name").alias("_new"))
    return areas.join(a, "area_id", "left").withColumn("place_name", F.coalesce("_new", "place_name")).drop("_new")


def area_status(areas: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Status after a batch: ``outcomes`` has ``area_id, outcome (started | ok | failed), day``."""
    o = outcomes.select("area_id", "outcome", "day")
    j = areas.join(o, "area_id", "left")
    status = F.when(F.col("outcome") == "ok", "completed").when(F.col("outcome") == "failed", "failed").when(F.col("outcome") == "started", "importing").otherwise(F.col("status"))
    day = F.when(F.col("outcome") == "ok", F.col("day")).otherwise(F.col("imported_day"))
    return j.withColumn("status", status).withColumn("imported_day", day).drop("outcome", "day")


def drop_area(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the given areas."""
    ids = gone.select("area_id").distinct()
    return {name: df.join(ids, "area_id", "left_anti") for name, df in tables.items()}


def road_graph_hash(blocks: DataFrame) -> DataFrame:
    """SHA-256 of an area's block ids, sorted and joined by newlines.

    The digest is defined over one text per area, so an area's ids meet in one row: 37 bytes per block, and an area is at most
    10 square kilometres (see ``rules.bbox_problem``) with blocks of at least some square metres."""
    listed = blocks.groupBy("area_id").agg(F.array_sort(F.collect_list("block_id")).alias("_b"))
    return listed.select("area_id", F.sha2(F.array_join("_b", "\n"), 256).alias("hash"))
