"""Benchmark passages in documents: a prefix-filtered join of shingle sets.

A benchmark item gives windows of ten words; a shorter item is one window. A window is the set of its shingles of three words, and a document
holds it where a stretch of the same length holds the whole set in the same places. As nothing may be missing, the necessary prefix of a
window is one shingle: its rarest in the documents, which Spark counts first. Only places of prefix shingles are joined. The window's length and
the shingle's place in it say where the window would have to begin; it must fit into the text, and its words are then compared one by one.

Tasks skip places whose shingle no window asks for by a bitmap whose size is bounded whatever the size of the benchmark; what it lets
through by chance, the join drops. Nothing else of the benchmark is sent to tasks unless Spark finds a table small enough by its size."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.text import FOLD, hashes, runs, shingles, signed, two
from terrafold.session import settle

SHINGLE = 3
#: Bits of a bitmap: 1,024 for each shingle, but never more than 16 MB.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27
RUN_BYTES = 2 << 20


def split(rows: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts in one list, and where each text ends."""
    found = [t.translate(FOLD).split() for t in rows]
    return list(chain.from_iterable(found)), np.cumsum([len(w) for w in found], dtype=np.int64)


def within(ends: np.ndarray, k: int) -> np.ndarray:
    """Places where ``k`` words of one text begin."""
    starts = np.concatenate([[0], ends[:-1]])
    room = np.maximum(ends - starts - k + 1, 0)
    return np.repeat(starts, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)


def places(h: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles of ``k`` words stand, and their hashes."""
    at = within(ends, k)
    return at, shingles(h, k)[at] if len(at) else np.zeros(0, np.uint64)


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """``item, words`` for every window of every item, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in runs(batches, RUN_BYTES):
            items, out = [], []
            for item, t in zip(batch.column("item").to_pylist(), rows, strict=True):
                w = t.translate(FOLD).split()
                own = {b" ".join(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else ()
                items += [item] * len(own)
                out += [x.decode() for x in own]
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(out, pa.string())], names=["item", "words"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(run, "item string, words string").distinct()


def window_shingles(distinct: DataFrame) -> DataFrame:
    """``words, length, k, place, shingle`` for every shingle of every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("words").to_pylist():
                w = text.encode().split()
                k = min(SHINGLE, len(w))
                found = signed(shingles(hashes(w), k))
                m = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([text] * m), pa.array([len(w)] * m, pa.int32()), pa.array([k] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(found)], names=["words", "length", "k", "place", "shingle"])

    return distinct.mapInArrow(run, "words string, length int, k int, place int, shingle long")


def bitmap(asked: DataFrame) -> dict[int, np.ndarray]:
    """By shingle size, two bits for every shingle of ``asked`` (``k``, ``shingle``)."""
    out = {}
    for r in asked.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect():  # three sizes
        bits = min(max(1 << (1024 * r["n"]).bit_length(), LEAST_BITS), MOST_BITS)
        bit = F.explode(F.array(F.col("shingle").bitwiseAND(bits - 1), F.shiftrightunsigned("shingle", 32).bitwiseAND(bits - 1))).alias("bit")
        filled = asked.filter(F.col("k") == r["k"]).select(bit).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits"))
        table = filled.toArrow()  # at most MOST_BITS / 64 rows
        own = np.zeros(bits // 64, np.uint64)
        own[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
        out[r["k"]] = own
    return out


def hit(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    top, one, low = np.uint64(len(table) * 64 - 1), np.uint64(1), np.uint64(63)
    a, b = h & top, (h >> np.uint64(32)) & top
    return ((table[a >> np.uint64(6)] >> (a & low)) & (table[b >> np.uint64(6)] >> (b & low)) & one).astype(bool)


def counts(docs: DataFrame, asked: dict[int, np.ndarray]) -> DataFrame:
    """``k, shingle, n``: how often shingles stand in the documents, for those in the bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, RUN_BYTES):
            found, ends = split(rows)
            h = hashes(found)
            for k, table in asked.items():
                _, s = places(h, ends, k)
                s, n = np.unique(s[hit(table, s)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k, np.int32)), pa.array(signed(s)), pa.array(n.astype(np.int64))], names=["k", "shingle", "n"])

    return two(docs).select("text").mapInArrow(run, "k int, shingle long, n long").groupBy("k", "shingle").agg(F.sum("n").alias("n"))


PLACES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("key", pa.binary()), ("k", pa.int32()), ("shingle", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("around", pa.string())])


def candidates(docs: DataFrame, asked: dict[int, np.ndarray], width: int) -> DataFrame:
    """A row for each document (``at`` is null; ``key``, a digest of its text, only where places follow) and one for each place of a prefix
    shingle, with the words around it that a window could cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in runs(batches, RUN_BYTES):
            found, ends = split(rows)
            starts, h = np.concatenate([[0], ends[:-1]]).astype(np.int64), hashes(found)
            keys: list[bytes | None] = [None] * len(rows)
            out: list[list] = [[] for _ in range(6)]
            for k, table in asked.items():
                at, s = places(h, ends, k)
                met = hit(table, s)
                at, s = at[met], signed(s[met])
                reach = width if k == SHINGLE else k
                for a, x, d in zip(at.tolist(), s.tolist(), np.searchsorted(ends, at, side="right").tolist(), strict=True):
                    if keys[d] is None:
                        keys[d] = xxhash.xxh3_128_digest(rows[d])
                    low = max(a - (reach - k), int(starts[d]))
                    around = b" ".join(found[low : min(a + reach, int(ends[d]))]).decode()
                    for column, value in zip(out, (keys[d], k, x, a - int(starts[d]), a - low, around), strict=True):
                        column.append(value)
            n, m = len(rows), len(out[0])
            none = lambda j: pa.nulls(n, PLACES.field(j).type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ends - starts), pa.array(keys, pa.binary()), *map(none, range(3, 8))], schema=PLACES)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), *(pa.array(c, PLACES.field(j).type) for j, c in enumerate(out, 2))], schema=PLACES)

    return two(docs).mapInArrow(run, "doc_id long, n_words long, key binary, k int, shingle long, at long, before int, around string")


def prefixes(found: DataFrame, seen: DataFrame) -> DataFrame:
    """``words, length, k, place, shingle``: the rarest shingle of each window whose shingles all occur. A shingle that occurs nowhere
    rules its windows out."""
    ranked = found.join(seen, ["k", "shingle"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    least = ranked.groupBy("words", "length", "k").agg(F.min(F.struct("n", "shingle", "place")).alias("least"))
    return least.filter("least.n > 0").select("words", "length", "k", "least.place", "least.shingle")


def occurrences(places_: DataFrame, prefix: DataFrame) -> DataFrame:
    """``key, start, length, words``: windows that stand in a text, verified word by word."""
    w = prefix.select(F.col("k").alias("w_k"), F.col("shingle").alias("w_shingle"), "words", "length", "place")
    around = F.split("around", " ", -1)
    fits = (F.col("before") >= F.col("place")) & (F.col("before") - F.col("place") + F.col("length") <= F.size(around))
    same = F.array_join(F.slice(around, F.greatest(F.col("before") - F.col("place") + 1, F.lit(1)), F.col("length")), " ") == F.col("words")
    met = places_.join(w, (F.col("k") == F.col("w_k")) & (F.col("shingle") == F.col("w_shingle")) & fits & same)
    return met.select("key", (F.col("at") - F.col("place")).alias("start"), "length", "words")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for every row of ``docs`` (``doc_id``, ``text``) against ``benchmark``
    (``item_id``, ``text``): words, words inside a window of ``width`` words that some item holds too (a shorter item is one window), and the
    ids of these items, sorted as texts.

    A null or empty text has no words and no hits; an item without words gives nothing. Each row of ``docs`` is judged by its text alone, so rows without
    an id or of one id are fine. Rows of one ``item_id`` are one item, and items without an id are one whose id is the empty text. An empty benchmark
    hits nothing, and no documents give no rows."""
    members = settle(windows(benchmark, width))
    found = settle(window_shingles(members.select("words").distinct()))
    sizes = bitmap(found.select("k", "shingle").distinct())
    prefix = settle(prefixes(found, counts(docs, sizes)))
    rows = settle(candidates(docs, bitmap(prefix.select("k", "shingle").distinct()), width))
    met = settle(occurrences(rows.filter("at IS NOT NULL").drop("doc_id", "n_words"), prefix))

    # Covered words: each stretch adds what lies beyond all that began before it in the same text.
    spans = met.groupBy("key", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(Window.partitionBy("key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    covered = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0))).groupBy("key").agg(F.sum("new").alias("n_hit"))
    items = met.select("key", "words").distinct().join(members, "words").select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    told = covered.join(items, "key")

    whole = rows.filter("at IS NULL").select("doc_id", "n_words", "key")
    some = whole.filter("key IS NOT NULL").join(told, "key", "left").drop("key")
    none = whole.filter("key IS NULL").select("doc_id", "n_words", F.lit(None).cast("long").alias("n_hit"), F.lit(None).cast("array<string>").alias("items"))
    hits, ids = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return some.unionByName(none).select("doc_id", "n_words", hits.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("items"), (hits > 0).alias("contaminated"))
