"""Best-fit packing of token pieces into sequences of a fixed length.

Only lengths matter to a packing, and there are at most ``size`` of them, so the plan is made on the histogram of lengths: a bounded
table however many pieces there are. Exact complements come first: for each length, longest first, a single, a pair or a triple of
lengths that fills the gap to the last token, taken as often as all its lengths are available. Each such step uses a length up, so
there are at most ``size`` of them. What is left goes best fit, longest first, again by counts.

A plan line says: so many sequences of these lengths. Pieces find their place by their rank among pieces of their length. Ranks are
counted in parallel: a frequent length is dealt over many salts, whose sizes (a table bounded by the number of partitions) give each
salt its first rank."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from terrafold.llm import text as tx
from terrafold.llm.pieces import MEMORY, pieces
from terrafold.session import settle


class Tokens:
    """Encodes texts as the tokenizer of a ``tokenizers`` file does, piece by piece, remembering pieces.

    Plain pieces go to the same vocabulary as ranks (in a byte-level BPE file ids follow the merges), which is several times
    faster; pieces that may hold a special token go to the tokenizer itself."""

    def __init__(self, tokenizer: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(tokenizer)
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        letter = _byte_letters()
        ranks = {bytes(letter[c] for c in t): i for t, i in self.slow.get_vocab(with_added_tokens=False).items() if t not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special and self.special.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known, out = self.known, []
        for piece in pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.array(self.fast.encode_ordinary(piece), "<u4").tobytes()
                if len(piece) <= 64:
                    if len(known) > MEMORY:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)


def _byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: visible Latin letters for themselves, others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


def narrowed(ids: bytes) -> bytes:
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else ids


@F.pandas_udf(BinaryType())
def widened(ids: pd.Series, length: pd.Series) -> pd.Series:
    """32-bit integers again; the number of ids tells which they were."""
    return pd.Series([x if len(x) == 4 * n else np.frombuffer(x, "<u2").astype("<u4").tobytes() for x, n in zip(ids, length, strict=True)])


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids``: each text's ids and ``end_id``, cut into pieces of ``size``, the
    first of which may be shorter. Ids travel as 16-bit integers where all of a piece fit (``widened`` undoes it)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] * with_ids)]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = Tokens(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch, rows in tx.runs(batches):
            out: list[tuple] = []
            for doc, t in zip(batch.column("doc_id").to_pylist(), rows, strict=True):
                ids = encoder.encode(t.decode("utf-8", "replace")) + last
                n = len(ids) // 4
                start, k = 0, 0
                while start < n:
                    end = start + (((n - start - 1) % size) + 1)
                    part = ids[4 * start : 4 * end]
                    out.append((doc, k, start, end - start, zlib.crc32(part), narrowed(part) if with_ids else None)[: len(names)])
                    start, k = end, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names=names)

    return tx.two(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(how many sequences, their lengths) from how many pieces there are of each length up to ``size``."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[int, tuple[int, ...]]] = []

    def take(lengths: tuple[int, ...]) -> None:
        values, need = np.unique(np.array(lengths), return_counts=True)
        times = int((left[values] // need).min())
        left[values] -= times * need
        out.append((times, lengths))

    def fits(lengths: tuple[int, ...]) -> bool:
        values, need = np.unique(np.array(lengths), return_counts=True)
        return bool((left[values] >= need).all())

    if left[size]:
        take((size,))
    for length in range(size - 1, 0, -1):
        while left[length]:
            found = _complement(left, length, size - length, fits)
            if not found:
                break
            take((length, *found))
    # Best fit: open sequences by gap, as (count, lengths); each length goes into the smallest gap that holds it.
    gaps: dict[int, list[list]] = {}
    for length in range(size, 0, -1):
        todo = int(left[length])
        while todo:
            best = min((g for g in gaps if g >= length and gaps[g]), default=None)
            if best is None:
                per = size // length
                times, rest = divmod(todo, per)
                for n, k in ((times, per), (1, rest)):
                    if n and k:
                        gaps.setdefault(size - k * length, []).append([n, (length,) * k])
                break
            n, lengths = gaps[best].pop()
            times = min(n, todo)
            if n > times:
                gaps[best].append([n - times, lengths])
            gaps.setdefault(best - length, []).append([times, (*lengths, length)])
            todo -= times
    out += [(n, lengths) for entries in gaps.values() for n, lengths in entries]
    return out


def _complement(left: np.ndarray, length: int, gap: int, fits) -> tuple[int, ...] | None:
    """A single, pair or triple of available lengths, none above ``length``, that sums to ``gap``."""
    if gap <= length and left[gap] and fits((length, gap)):
        return (gap,)
    have = left > 0
    pair = _pair(have, left, length, gap, (length,), fits)
    if pair:
        return pair
    for first in np.flatnonzero(have[: min(length, gap - 2) + 1])[::-1].tolist():
        if 3 * first < gap:
            break
        pair = _pair(have, left, first, gap - first, (length, first), fits)
        if pair:
            return (first, *pair)
    return None


def _pair(have: np.ndarray, left: np.ndarray, top: int, gap: int, with_: tuple[int, ...], fits) -> tuple[int, int] | None:
    low, high = (gap + 1) // 2, min(top, gap - 1)
    if high < low:
        return None
    a = np.arange(high, low - 1, -1)
    for x in a[have[a] & have[gap - a]].tolist():
        if fits((*with_, x, gap - x)):
            return x, gap - x
    return None


def places(spark: SparkSession, lines: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """``length, low, high, sequence, first, same, rank_offset``: pieces of a length with ranks ``low`` to ``high`` (exclusive) fill ``same``
    places, one after the other from ``first``, in each sequence from ``sequence`` on. At most a few rows per length."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, lengths in lines:
        offset = 0
        for length in dict.fromkeys(lengths):
            same = lengths.count(length)
            low = used.get(length, 0)
            rows.append((length, low, low + n * same, sequence, offset, same))
            used[length] = low + n * same
            offset += same * length
        sequence += n
    return spark.createDataFrame(rows, "length long, low long, high long, sequence long, first long, same long")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if wanted, ``ids`` (little-endian unsigned
    32-bit integers).

    A document is its ids and ``end_id``; only longer ones than ``size`` are cut. Null and empty texts are the end alone; a null
    ``doc_id`` is packed like any other; repeated rows are packed each; other columns are not read. No rows give no rows."""
    spark = docs.sparkSession
    table = settle(tokenized(docs, tokenizer, end_id, size, with_ids))
    ids = [widened("ids", "length").alias("ids")] * with_ids
    # At most `size` rows.
    counts = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = sum(counts.values())
    # A salt holds about half a partition's share of all pieces, so there are at most size + 2 * partitions of them.
    salts = {length: max(1, -(-2 * partitions * n // total)) for length, n in counts.items()}
    salt_of = spark.createDataFrame(list(salts.items()) or [(0, 1)], "length long, salts long")
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("salts"))
    dealt = table.join(F.broadcast(salt_of), "length").withColumn("salt", spread).drop("salts")
    sizes = sorted((r["length"], r["salt"], r["n"]) for r in dealt.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).collect())
    firsts, at, before = [], 0, None
    for length, salt, n in sizes:
        at = at if length == before else 0
        firsts.append((length, salt, at))
        at, before = at + n, length
    first = spark.createDataFrame(firsts or [(0, 0, 0)], "length long, salt long, base long")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(F.broadcast(first), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))
    place = places(spark, plan(counts, size)) if counts else spark.createDataFrame([], "length long, low long, high long, sequence long, first long, same long")
    here = ranked.join(F.broadcast(place.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    return here.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *ids, (F.col("sequence") + F.floor(step / F.col("same"))).cast("long").alias("sequence_id"), (F.col("first") + (step % F.col("same")) * F.col("length")).alias("offset"),
    )
