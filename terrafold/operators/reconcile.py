"""Idempotent re-import: upserts by natural key, sweeps, and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import ids

# Fixed value: the namespace of this library's own row ids.
ROW_NAMESPACE = "0f5f3b52-6a0e-5c1c-9c55-7b1d4a3c8e21"


def latest(new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last of several rows with one key. ``max_by`` combines map-side, so a key repeated very often is cheap."""
    rest = [c for c in new.columns if c not in keys]
    return new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str | None = None, areas: DataFrame | None = None) -> DataFrame:
    """The layer after an import of ``new``: existing ids are kept, new rows get an id derived from their key, rows that ``new`` no longer has
    are gone. ``areas`` (``area_id``) says which areas were imported: one of them without new rows loses all it had, others stay as they are.
    Without it they are the areas of ``new``. ``existing`` has an ``id`` column; keys include ``area_id``."""
    rows = latest(new, keys, order) if order else new
    ids_of = existing.select(*keys, F.col("id").alias("_old"))
    j = rows.join(ids_of, keys, "left")
    derived = ids.uuid5(ROW_NAMESPACE, F.concat_ws(":", *keys))
    touched = j.select(F.coalesce("_old", derived).alias("id"), *[c for c in rows.columns])
    cols = [c for c in existing.columns if c != "id" and c in rows.columns]
    kept = existing.join(_imported(rows, areas), "area_id", "left_anti").select("id", *cols)
    return touched.select("id", *cols).unionByName(kept)


def _imported(new: DataFrame, areas: DataFrame | None) -> DataFrame:
    return (new if areas is None else areas).select("area_id").distinct()


def changes(existing: DataFrame, new: DataFrame, keys: list[str], areas: DataFrame | None = None) -> DataFrame:
    """``area_id, created, updated, removed`` from a key difference (full outer join) over the areas that were imported (``areas``, else those of ``new``)."""
    old = existing.select(*keys, F.lit(True).alias("_o")).distinct()
    now = new.select(*keys, F.lit(True).alias("_n")).distinct()
    j = old.join(now, keys, "full_outer").join(_imported(new, areas), "area_id", "left_semi")
    o, n = F.col("_o").isNotNull(), F.col("_n").isNotNull()
    return j.groupBy("area_id").agg(F.count_if(n & ~o).alias("created"), F.count_if(n & o).alias("updated"), F.count_if(o & ~n).alias("removed"))


def reconcile_stats(layers: dict[str, tuple[DataFrame, DataFrame, list[str]]], areas: DataFrame | None = None) -> DataFrame:
    """The sum of ``changes`` over several layers (name -> existing, new, keys)."""
    total = None
    for existing, new, keys in layers.values():
        part = changes(existing, new, keys, areas)
        total = part if total is None else total.unionByName(part)
    return total.groupBy("area_id").agg(*(F.sum(c).alias(c) for c in ("created", "updated", "removed")))


def sweep_children(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")
