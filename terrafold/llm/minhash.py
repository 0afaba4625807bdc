"""Near-duplicate documents by MinHash.

One permutation hashes a document's shingles once and keeps the smallest hash of each of ``bands * rows`` bins. An empty bin
borrows from the first non-empty bin of its own fixed random probe sequence (optimal densification), so documents of any length
have a full signature and equal bins still mean what they should. Bands of bins are the buckets. Inside a bucket every member is
compared with one centre only (a star), on full shingle sets.

A star alone could miss a link between two members that don't both resemble the centre. Members of one centre that are not
connected after the stars are therefore bounded exactly by what they have in common with it (``unlinked``), and the few pairs left
are compared too. Documents with equal sets are one class before any of this: copies cost one row each in two
aggregations, never pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm import text as tx
from terrafold.llm.decontamination import bitmap, hit
from terrafold.operators.graph import connected_components
from terrafold.session import settle

SEED = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(rows: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    return [np.unique(tx.shingles(tx.hashes(tx.words(t.lower())), k)) for t in rows]


def signature(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Documents x bins; every set must have an element."""
    out = np.zeros((len(sets), bins), np.uint64)
    full = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        # Bins are ranges of the hash, so in a sorted set the first of a bin is its smallest.
        b = (((s >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        out[i, b[first]] = s[first]
        full[i, b[first]] = True
        if len(first) == 1:
            out[i] = s[0]
            full[i] = True
    row, col = np.nonzero(~full)
    attempt = 0
    with np.errstate(over="ignore"):
        while len(row):
            attempt += 1
            probe = tx.mix(col.astype(np.uint64) * SEED + np.uint64(attempt))
            donor = (((probe >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
            hit = full[row, donor]
            out[row[hit], col[hit]] = out[row[hit], donor[hit]]
            row, col = row[~hit], col[~hit]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = tx.mix(out * SEED + parts[:, :, j])
    return out


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n_shingles, fp`` (of the set, null if empty) ``, keys`` (one per band)."""

    def columns(batch: list[bytes]) -> list:
        sets = shingle_sets(batch, k)
        some = [s for s in sets if len(s)]
        keys = band_keys(signature(some, bands * rows), bands, rows) if some else np.zeros((0, bands), np.uint64)
        ends = np.cumsum([bands if len(s) else 0 for s in sets])
        return [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            tx.lists(tx.signed(keys.ravel()), ends),
        ]

    return tx.per_text(docs, "n_shingles long, fp binary, keys array<long>", columns)


def sets_of(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """``id, hashes``: the sets of the documents ``wanted`` (``doc_id``), one row per distinct set.

    Tasks skip other documents by a bitmap of at most 16 MB before they hash them, so whole texts are never shuffled; what it
    lets through by chance, the join drops."""
    table = bitmap(wanted.select(F.lit(0).alias("k"), F.xxhash64("doc_id").alias("shingle"))).get(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            here = hit(table, batch.column("place").to_numpy().view(np.uint64))
            for part, rows in tx.runs(iter([batch.filter(pa.array(here))])):
                sets = shingle_sets(rows, k)
                flat = tx.signed(np.concatenate([*sets, np.zeros(0, np.uint64)]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), tx.lists(flat, np.cumsum([len(s) for s in sets]))], names=["id", "hashes"])

    if table is None:
        return docs.sparkSession.createDataFrame([], "id long, hashes array<long>")
    named = tx.two(docs).filter("doc_id IS NOT NULL").withColumn("place", F.xxhash64("doc_id"))
    return named.mapInArrow(run, "id long, hashes array<long>").join(wanted.withColumnRenamed("doc_id", "id"), "id", "left_semi").distinct()


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``both``, the size of the intersection of the full sets of ``doc`` and ``centre``."""
    left = pairs.join(sets.select(F.col("id").alias("doc"), F.col("hashes").alias("x")), "doc")
    pair = left.join(sets.select(F.col("id").alias("centre"), F.col("hashes").alias("y")), "centre")
    return pair.select("doc", "centre", "n", "cn", F.size(F.array_intersect("x", "y")).cast("long").alias("both"))


def links(reps: DataFrame, docs: DataFrame, k: int, share: int) -> DataFrame:
    """``a, b``: confirmed links that connect every two classes which share a bucket and have ``100 * both >= share * union``.

    ``reps``: ``doc_id, n_shingles, keys`` of one document per class."""
    buckets = reps.select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), F.explode("keys").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("doc").alias("centre"), F.max("doc").alias("last")).filter("centre < last").drop("last")
    stars = settle(buckets.join(shared, "bucket").filter("doc <> centre").select("doc", "centre", "n").distinct())
    wanted = stars.select(F.col("doc").alias("doc_id")).unionByName(stars.select(F.col("centre").alias("doc_id"))).distinct()
    sets = settle(sets_of(docs, k, settle(wanted)))
    sizes = reps.select(F.col("doc_id").alias("centre"), F.col("n_shingles").alias("cn"))
    done = settle(measured(stars.join(sizes, "centre"), sets))
    found = _near(done, share)
    return found.unionByName(_near(measured(unlinked(done, found, sets, share), sets), share))


def _near(pairs: DataFrame, share: int) -> DataFrame:
    return pairs.filter(f"100 * both >= {share} * (n + cn - both)").select(F.col("doc").alias("a"), F.col("centre").alias("b"))


def unlinked(done: DataFrame, found: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """``doc, centre, n, cn``: pairs of members of one centre, not connected yet, that could be near.

    What both members have in common lies inside the centre's set, where it is at most the smaller of their measured
    intersections, or outside. A near pair needs ``share / (100 + share)`` of the sum of its sizes. So it is possible only if the
    inside alone may suffice, or if the two share what is missing outside. The latter pairs are found by outside elements, from
    the rarest at this centre on: members in order of size, a pair that needs so many of them shares one among the first of
    both, ``own - need + 1`` each. What the group has in common with its centre is never looked up."""
    ends = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).distinct()
    comps = connected_components(ends, found).select(F.col("id").alias("doc"), "component")
    labelled = done.select("doc", "centre", "n", "both").join(comps, "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component")
    apart = labelled.groupBy("centre").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("centre")
    labelled = settle(labelled.join(apart, "centre", "left_semi"))
    side = lambda df, mark: df.select(*(F.col(c).alias(f"{mark}_{c}") for c in df.columns))
    ordered = f"x_label <> y_label AND (x_n < y_n OR x_n = y_n AND x_doc < y_doc) AND 100 * x_n >= {share} * y_n"
    need = f"({share} * (x_n + y_n) - {100 + share} * least(x_both, y_both))"

    inner = labelled.filter(f"100 * both >= {share} * n")
    inside = side(inner, "x").join(side(inner, "y"), F.expr(f"x_centre = y_centre AND {ordered} AND {need} <= 0"))

    outer = labelled.join(sets.select(F.col("id").alias("doc"), F.col("hashes").alias("x")), "doc").join(sets.select(F.col("id").alias("centre"), F.col("hashes").alias("y")), "centre")
    outer = settle(outer.select("centre", "doc", "n", "both", "label", F.explode(F.array_except("x", "y")).alias("element")))
    often = outer.groupBy("centre", "element").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("low"), F.max("label").alias("high")).filter("f > 1").select("centre", "element", "f", F.expr("low < high").alias("across"))
    own = Window.partitionBy("centre", "doc")
    # Elements that no member of another component has come first; they match nothing and are only counted.
    common = outer.join(settle(often), ["centre", "element"]).withColumn("useful", F.count_if("across").over(own))
    ranked = common.withColumn("place", F.row_number().over(own.orderBy("across", "f", "element")) + (F.col("n") - F.col("both")) - F.count(F.lit(1)).over(own))
    first = lambda least: f"place <= n - both - greatest(1, ceil({least}) - both) + 1"
    looked = ranked.filter("across").filter(f"100 * (both + useful) >= {share} * n").filter(first(f"{share} * n / 100D")).withColumn("first", F.expr(first(f"{2 * share} * n / {100 + share}D"))).drop("f", "across", "place")
    looked = settle(looked)
    outside = side(looked.filter("first"), "x").join(side(looked, "y"), F.expr(f"x_centre = y_centre AND x_element = y_element AND {ordered} AND {need} <= {100 + share} * least(x_useful, y_useful)"))
    pairs = [df.select(F.col("x_doc").alias("doc"), F.col("y_doc").alias("centre"), F.col("x_n").alias("n"), F.col("y_n").alias("cn")) for df in (inside, outside)]
    return settle(pairs[0].unionByName(pairs[1]).distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = 5, share: int = 80, bands: int = 40, rows: int = 6) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    Two documents are linked if the distinct shingles of ``shingle_words`` words have 100 * intersection >= ``share`` * union; a
    component is all that is reachable, named by its smallest ``doc_id``, which alone is kept. With the defaults two documents of
    similarity 0.8 share no bucket with probability 5e-6. Shingles are compared as 64-bit hashes.

    Null, empty and blank texts have no shingles and are linked with nothing. A null ``doc_id`` can't be named: such a row has a
    null component and is kept. Rows that repeat a ``doc_id`` are one document of the graph and get the same component. No rows
    give no rows."""
    sig = settle(signatures(docs, shingle_words, bands, rows))
    named = sig.filter("doc_id IS NOT NULL AND fp IS NOT NULL")
    # Equal sets have equal sizes and keys.
    classes = settle(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")))
    reps = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "keys")
    classes = classes.select("fp", "rep")
    edges = settle(links(reps, docs, shingle_words, share))
    # A repeated doc_id with different texts belongs to several classes; that links them.
    repeated = named.join(classes, "fp").filter("doc_id <> rep").join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = edges.unionByName(repeated)
    ends = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).distinct()
    comps = connected_components(ends, edges)
    of_class = classes.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n_shingles", "fp").join(of_class, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
