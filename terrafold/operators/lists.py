"""Ranking of linked lists that close: pointer doubling over whole frames, or over some keys in one task where the keys are small."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import settle

#: A key of at most so many elements is ranked in one task; a step takes keys of about so many elements together.
SMALL, STEP = 200_000, 50_000


def around(links: DataFrame) -> DataFrame:
    """``he, best, off`` for ``links`` (``he, nxt, label``; every ``he`` is the ``nxt`` of exactly one): the smallest label on the cycle and how many steps ahead of ``he`` it is (see ``ranked``).

    After round k every element knows the smallest label among the next 2^k steps and how far away it is; a cycle of n takes log2 n joins."""
    state = links.select("he", F.col("nxt").alias("ptr"), F.col("label").alias("best"), F.lit(0).cast("bigint").alias("off"))
    reach = 1
    while True:
        far = state.select(F.col("he").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("best").alias("best2"), F.col("off").alias("off2"))
        better = F.col("best2") < F.col("best")
        state = settle(state.join(far, "ptr").select(
            "he", F.col("ptr2").alias("ptr"), F.least("best", "best2").alias("best"), F.when(better, F.col("off2") + reach).otherwise(F.col("off")).alias("off"), better.alias("moved"),
        ))
        if state.filter("moved").isEmpty():
            break
        state = state.drop("moved")
        reach *= 2
    return state.select("he", "best", "off")


def ranked(labelled: DataFrame, *key: str) -> DataFrame:
    """Turns ``off`` (steps to the smallest label) into ``pos`` (steps from it); ``key`` names a cycle."""
    sizes = labelled.groupBy(*key).agg(F.count("*").alias("_n"))
    return labelled.join(sizes, list(key)).withColumn("pos", F.pmod(F.col("_n") - F.col("off"), F.col("_n"))).drop("off", "_n")


def _ranked_step(links: pa.Table) -> pa.Table:
    """``face`` and ``pos`` of whole cycles: ``around`` and ``ranked`` in numpy, with ``he`` as label."""
    he, nxt = (links.column(c).to_numpy() for c in ("he", "nxt"))
    order = np.argsort(he)
    ptr = order[np.searchsorted(he, nxt, sorter=order)]
    best, off, reach = he.copy(), np.zeros(len(he), np.int64), 1
    while True:
        better = best[ptr] < best
        if not better.any():
            break
        best, off, ptr, reach = np.where(better, best[ptr], best), np.where(better, off[ptr] + reach, off), ptr[ptr], reach * 2
    _, back, n = np.unique(best, return_inverse=True, return_counts=True)
    return links.drop_columns(["nxt", "_step"]).append_column("face", pa.array(best)).append_column("pos", pa.array((n[back] - off) % n[back]))


def cycles(links: DataFrame, small: int = SMALL, step: int = STEP) -> DataFrame:
    """``links`` (``key, he, nxt`` and more; a cycle lies in one key) with ``face``, the smallest ``he`` on the cycle, and ``pos``, the steps
    from it, instead of ``nxt``. ``links`` is read several times, so it should be settled.

    Keys of at most ``small`` elements are ranked in tasks, some together, so their rows travel once; larger ones by rounds of joins."""
    own = F.xxhash64("key")
    sizes = settle(links.groupBy(own.alias("_k")).agg(F.count(F.lit(1)).alias("_n")))
    large = sizes.filter(F.col("_n") > small).select("_k")
    rows = sizes.filter(F.col("_n") <= small).agg(F.sum("_n")).first()[0] or 0
    several = not large.isEmpty()
    alone = links.withColumn("_k", own).join(large, "_k", "left_anti").drop("_k") if several else links
    names = [c for c in links.columns if c != "nxt"]
    schema = ", ".join(f"`{c}` {links.schema[c].dataType.simpleString()}" for c in names) + ", face long, pos long"
    dealt = alone.withColumn("_step", F.pmod(own, F.lit(rows // step + 1)))
    out = dealt.groupBy("_step").applyInArrow(_ranked_step, schema)
    if not several:
        return out
    rest = settle(links.withColumn("_k", own).join(large, "_k", "left_semi").drop("_k"))
    state = around(rest.select("he", "nxt", F.col("he").alias("label")))
    return out.unionByName(ranked(rest.drop("nxt").join(state.withColumnRenamed("best", "face"), "he"), "face"))
