"""Removal of passages that occur earlier in the corpus, by super-k-mers.

A window is ``k`` consecutive words. Its minimiser is the smallest hash of the ``m`` word runs in it; consecutive windows mostly
share one, and such a run of windows is a super-k-mer. Equal windows have equal minimisers, so a window can only recur among
super-k-mers of the same minimiser. The steps:

1. Every super-k-mer sends its minimiser and a 128-bit digest (minimiser and words). Minimisers that occur once are gone here.
2. Equal super-k-mers: all but the earliest are removed whole. This is an aggregation, so thousands of copies of a passage send one
   row per task.
3. The earliest of each kind that share a minimiser with another kind travel as packed strings to the minimiser's bucket, where
   their windows are sorted by words, document and position; all but the first of each are removed.
4. Where a minimiser has over ``crowd`` kinds (the edges of a passage that very many documents share), its windows travel one by one
   to buckets of their own first and last words, so no bucket gathers them all.

Words come from the input throughout; nothing is judged on what is left."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import text as tx
from terrafold.session import settle

#: Words of a minimiser.
M = 6
PRIME = np.uint64(0x9E3779B97F4A7C15)


def super_kmers(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, digest, first window and number of windows of each super-k-mer of a sequence of hashed words."""
    n = len(h) - k + 1
    if n < 1:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = min(M, k)
    g = tx.shingles(h, m)
    views = np.lib.stride_tricks.sliding_window_view(g, k - m + 1)
    at = views.argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    count = np.diff(np.r_[first, n])
    with np.errstate(over="ignore"):
        # Two chained sums of products would do; each word is scrambled with its place in the super-k-mer instead.
        end = first + count + k - 1
        size = end - first
        flat = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
        place = flat - np.repeat(first, size)
        parts = tx.mix(h[flat] + PRIME * (place.astype(np.uint64) + np.uint64(1)))
        digest = np.add.reduceat(parts, np.r_[0, np.cumsum(size)[:-1]])
    return g[at[first]], digest, first, count


def _occurrences(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, row, minimiser, digest, start, n`` of every super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in tx.runs(batches):
            parts = [super_kmers(tx.hashes(tx.words(t)), k) for t in rows]
            each = np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts])
            a, b, c, d = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(each)), batch.column("row").take(pa.array(each)), pa.array(tx.signed(a)), pa.array(tx.signed(b)), pa.array(c.astype(np.int32)), pa.array(d.astype(np.int16))], names=names)

    names = ["doc_id", "row", "minimiser", "digest", "start", "n"]
    return docs.select("doc_id", "row", "text").mapInArrow(run, "doc_id long, row long, minimiser long, digest long, start int, n short")


def _packed(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``bucket, doc_id, row, start, packed``: the words of the wanted super-k-mers; single windows where ``crowded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _unpacked(batches):
            ids, numbers, wants = (batch.column(c).to_pylist() for c in ("doc_id", "row", "wants"))
            out: list[tuple] = []
            for doc, number, t, want in zip(ids, numbers, rows, wants, strict=True):
                w = tx.words(t)
                for x in want:
                    if x["crowded"]:
                        spans = [(i, i + k) for i in range(x["start"], x["start"] + x["n"])]
                        ends = tx.hashes([b" ".join((w[a], w[b - 1])) for a, b in spans])
                        with np.errstate(over="ignore"):
                            keys = tx.signed(tx.mix(ends + np.uint64(x["minimiser"] & (2**64 - 1))))
                    else:
                        spans, keys = [(x["start"], x["start"] + x["n"] + k - 1)], [x["minimiser"]]
                    out += [(int(key), doc, number, a, b" ".join(w[a:b])) for key, (a, b) in zip(keys, spans, strict=True)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["bucket", "doc_id", "row", "start", "packed"])

    wants = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("minimiser", "start", "n", "crowded")).alias("wants"))
    return _zipped(docs).join(wants, ["doc_id", "row"]).mapInArrow(run, "bucket long, doc_id long, row long, start int, packed binary")


def _zipped(docs: DataFrame) -> DataFrame:
    """Texts compressed for a shuffle; columns ``absent`` and ``carried``, if there, go along."""
    with_it = [c for c in ("absent", "carried") if c in docs.columns]
    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in with_it)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for batch, rows in tx.runs(batches):
            columns = [batch.column("doc_id"), batch.column("row"), pa.array([z.compress(t) for t in rows], pa.binary()), *(batch.column(c) for c in with_it)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "z", *with_it])

    return docs.mapInArrow(run, f"doc_id long, row long, z binary{more}")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield part, [z.decompress(x) for x in part.column("z").to_pylist()]


def _later_windows(bucketed: DataFrame, k: int) -> DataFrame:
    """``doc_id, row, start``: windows of which the same bucket holds an earlier one. The input is sorted by bucket in each partition."""

    def close(rows: list[tuple]) -> list[tuple[int, int, int]]:
        windows = []
        for doc, number, start, packed in rows:
            w = packed.split(b" ")
            windows += [(b" ".join(w[i : i + k]), doc, number, start + i) for i in range(len(w) - k + 1)]
        windows.sort()
        return _later(windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for key, *place, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "row", "start", "packed")), strict=True):
                if key != bucket:
                    if len(held) > 1:
                        found += close(held)
                    held, bucket = [], key
                held.append((*place, packed))
            yield _pairs(found)
        if len(held) > 1:
            yield _pairs(close(held))

    return bucketed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, row long, start int")


def _later(windows: list[tuple]) -> list[tuple[int, int, int]]:
    """Of sorted (words, document, row, start): document, row and start of all after the first of each words."""
    out, words, first = [], None, None
    for w, *place in windows:
        if w != words:
            words, first = w, place
        elif place != first:
            out.append(tuple(place))
    return out


def _pairs(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    docs, numbers, starts = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int64()), pa.array(starts, pa.int32())], names=["doc_id", "row", "start"])


def repeated_windows(docs: DataFrame, k: int, crowd: int) -> DataFrame:
    """``doc_id, row, start, n``: runs of ``n`` windows that start earlier elsewhere. ``docs``: ``doc_id, row`` (not null; together the name of a text and its
    place in the order), ``text``."""
    found = _occurrences(docs, k)
    # Tables of their own, so that in the joins Spark can split a frequent minimiser.
    often = settle(found.groupBy("minimiser").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("minimiser"))
    found = settle(found.join(often, "minimiser", "left_semi"))
    kinds = found.groupBy("minimiser", "digest", "n").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"))
    kinds = settle(kinds.select("minimiser", "digest", "n", F.col("first.doc_id").alias("first_doc"), F.col("first.row").alias("first_row"), F.col("first.start").alias("first_start")))
    copies = found.join(kinds, ["minimiser", "digest", "n"]).filter("doc_id <> first_doc OR row <> first_row OR start <> first_start").select("doc_id", "row", "start", F.col("n").cast("int").alias("n"))
    several = settle(kinds.groupBy("minimiser").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("minimiser", (F.col("c") > crowd).alias("crowded")))
    wanted = kinds.join(several, "minimiser").select(F.col("first_doc").alias("doc_id"), F.col("first_row").alias("row"), F.col("first_start").alias("start"), "n", "minimiser", "crowded")
    later = _later_windows(_packed(docs, wanted, k), k)
    return copies.unionByName(later.select("doc_id", "row", "start", F.lit(1).alias("n")))


def without_repeats(docs: DataFrame, k: int = 20, crowd: int = 2000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``doc_id, n_words, n_removed, kept_sha256`` (of the words left, joined by one blank, in
    UTF-8) and ``kept``: those words if some went, else the text as it is. With ``carry`` also ``carried``, a struct of those
    columns; others are not read.

    A word goes if a window of ``k`` words that covers it has an equal one that starts earlier: in a smaller ``doc_id``, or
    earlier in the same document. Null, empty and short texts have no windows and lose nothing. A null ``doc_id`` counts as the
    largest. Different texts of one ``doc_id``, or without one, are documents of their own in the order of a digest of theirs; equal rows lose
    the same words. No rows give no rows."""
    last = 2**63 - 1
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc_id")
    source = docs.select(ident, F.col("doc_id").isNull().alias("absent"), F.col("text").cast("string").alias("text"), *([F.struct(*carry).alias("carried")] if carry else []))
    # Only texts whose id does not name them need a name of their own: a table of ids that occur more than once, none as a rule.
    shared = settle(source.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > 1).select("doc_id", F.lit(True).alias("_shared")))
    if shared.isEmpty():
        source = source.withColumn("row", F.lit(0).cast("long"))
    else:
        number = F.when(F.col("_shared"), F.xxhash64("text", "absent")).otherwise(F.lit(0).cast("long"))
        source = source.join(shared, "doc_id", "left").withColumn("row", number).drop("_shared")
    with_it = ["carried"] * bool(carry)
    more = f", carried {source.schema['carried'].dataType.simpleString()}" if carry else ""
    gone = repeated_windows(source.select("doc_id", "row", "text"), k, crowd).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "n")).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _unpacked(batches):
            n_words, n_removed, sha, kept = [], [], [], []
            for t, gone in zip(rows, batch.column("gone").to_pylist(), strict=True):
                w = tx.words(t)
                n_words.append(len(w))
                if gone:
                    change = np.zeros(len(w) + 1, np.int32)
                    np.add.at(change, [min(x["start"], len(w)) for x in gone], 1)
                    np.add.at(change, [min(x["start"] + x["n"] + k - 1, len(w)) for x in gone], -1)
                    stays = np.cumsum(change[:-1]) == 0
                    w = [x for x, s in zip(w, stays.tolist(), strict=True) if s]
                n_removed.append(n_words[-1] - len(w))
                left = b" ".join(w)
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append((left if n_removed[-1] else t).decode("utf-8", "replace"))
            columns = [batch.column("doc_id"), batch.column("absent"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string()), *(batch.column(c) for c in with_it)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "absent", "n_words", "n_removed", "kept_sha256", "kept", *with_it])

    out = _zipped(source).join(gone, ["doc_id", "row"], "left").mapInArrow(run, f"doc_id long, absent boolean, n_words long, n_removed long, kept_sha256 string, kept string{more}")
    return out.withColumn("doc_id", F.when(~F.col("absent"), F.col("doc_id"))).drop("absent")
