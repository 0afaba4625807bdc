"""Language-model scores by logistic context mixing.

The text is its lower-cased words, each followed by a blank, and a lone blank for the end. A byte is coded by binary decisions: the
sixteen commonest take five, others nine. For every decision five predictors look up how the bit fell after the same hashed
context (the last one to four bytes and the whole word so far) in the training documents. Their log-odds are mixed with weights
that a gate (the place in the word, the decision, and how often the word so far was seen) selects, and an adaptive map of the mixed
log-odds refines the result. The score adds up to the log10 probability of the text; over its bytes that gives the bits per byte.

All of it is gathered by Spark from every training document: counts per hashed context are added up over tasks; then the weights
learn online, each task running over all its words and seeing each decision with that word's own count taken out, and are averaged;
so is the map. Tables have a fixed size (5.9 million slots), which is what may be broadcast.

Documents are packed into blocks of some megabytes. A block works on its distinct words, so a word is coded once per block. The
counts of words, for the base score, are looked up by an exchange: every block sends the hashes of its words, dealt into buckets, and
gets the corpus counts back in the same order. A word that is everywhere is one entry per block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm import text as tx
from terrafold.session import settle

# Bytes coded with five decisions, the blank ends a word.
COMMON = b" etaoinshrdlucmg"
#: Bits of each context's table, and where it starts in the joint one.
TABLE_BITS = (14, 16, 19, 20, 22)
CONTEXTS, STARTS = len(TABLE_BITS), np.cumsum([0, *(1 << b for b in TABLE_BITS)])
SLOTS = int(STARTS[-1])
#: Place (4) x decision (6) x how often the word so far was seen (4).
GATES, STEPS = 96, 33
#: Added to counts; how fast weights learn; the weight of the mixed value in the map; the surest probability.
DELTA, RATE, TRUST, SUREST = 0.3, 0.3, 20.0, 2.0**-14
CHUNK = 6_000

_NIBBLE = np.full(256, -1, np.int64)
_NIBBLE[list(COMMON)] = np.arange(len(COMMON))
_G, _G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def decisions(coded: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For words that end in a blank: word, slots (contexts x decisions), gate and bit of all their decisions, a step at a time."""
    lengths = np.array([len(w) for w in coded])
    flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(coded)), lengths)
    starts = np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    place = np.arange(len(flat)) - starts
    with np.errstate(over="ignore"):
        history = []
        h = np.zeros(len(flat), np.uint64)
        for back in range(1, 5):
            before = np.zeros(len(flat), np.uint64)
            before[back:] = flat[:-back]
            h = h * np.uint64(257) + np.where(place >= back, before + np.uint64(1), np.uint64(0))
            history.append(h * _G + np.uint64(back))
        history[0] = history[0] + np.minimum(place, 3).astype(np.uint64) * _G2
        # The word so far: a polynomial in an odd base, so dividing by the power of its start is exact.
        base = np.uint64(0x5851F42D4C957F2D)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        power = np.cumprod(np.r_[np.uint64(1), np.full(max(len(flat) - 1, 0), base)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(max(len(flat) - 1, 0), inverse)])
        sums = np.r_[np.uint64(0), np.cumsum((flat + np.uint64(1)) * power)]
        history.append(tx.mix((sums[:-1] - sums[starts]) * down[starts]) + np.uint64(5))
        nibble = _NIBBLE[flat.astype(np.int64)]
        escape = nibble < 0
        code = np.where(escape, flat.astype(np.int64), nibble)
        rounds = [(np.arange(len(flat)), escape.astype(np.int64), np.ones(len(flat), np.int64))]
        for j in range(8):
            own = np.arange(len(flat)) if j < 4 else np.flatnonzero(escape)
            top = np.where(escape[own], 8, 4)
            seen = (1 << j) | (code[own] >> (top - j))
            rounds.append((own, (code[own] >> (top - 1 - j)) & 1, np.where(escape[own], 32, 1) + seen))
        for j, (own, bit, node) in enumerate(rounds):
            at = node.astype(np.uint64) * _G2
            slots = np.stack([(((h[own] + at) * _G) >> np.uint64(64 - TABLE_BITS[k])).astype(np.int64) + STARTS[k] for k, h in enumerate(history)])
            kind = np.where(escape[own] & (j > 0), 5, min(j, 4))
            yield word[own], slots, kind * 4 + np.minimum(place[own], 3), bit


def _chunks(words: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    for at in range(0, len(words), CHUNK):
        yield at, [w + b" " for w in words[at : at + CHUNK]]


def count_bits(words: list[bytes], counts: np.ndarray, table: np.ndarray) -> None:
    """Adds to ``table`` (2 x slots) how often each bit followed each context."""
    flat = table.reshape(-1)
    for at, coded in _chunks(words):
        c = counts[at : at + len(coded)].astype(np.float32)
        for word, slots, _, bit in decisions(coded):
            np.add.at(flat, (slots + bit * SLOTS).ravel(), np.tile(c[word], CONTEXTS))


def often(table: np.ndarray) -> np.ndarray:
    """Per slot of the last context a level 0 to 3 of how often it was seen, against the mean of all its slots."""
    seen = table[0, STARTS[-2] :] + table[1, STARTS[-2] :]
    mean = seen.mean()
    return np.digitize(seen, [2 * mean + 2, 16 * mean + 8, 256 * mean + 64]).astype(np.uint8)


class Mixer:
    """Log-odds of the predictors mixed by gated weights, then refined by a map of counts per gate and step of the mixed value."""

    def __init__(self, weights: np.ndarray | None = None, seen: np.ndarray | None = None):
        self.weights = np.r_[np.full(CONTEXTS, 0.3), 0.0][None, :].repeat(GATES, 0) if weights is None else weights
        self.seen = np.zeros((2, GATES * STEPS)) if seen is None else seen

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        w = self.weights.astype(np.float32)
        z = w[gate, CONTEXTS]
        for k in range(CONTEXTS):
            z += w[gate, k] * odds[k]
        return np.clip(z, np.float32(-12), np.float32(12))

    def step(self, z: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return gate * STEPS + np.clip(np.rint(z * 2).astype(np.int32) + STEPS // 2, 0, STEPS - 1)

    def learn(self, odds: np.ndarray, gate: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """One online update from decisions that count ``weight`` times."""
        z = self.mixed(odds, gate)
        p = 1 / (1 + np.exp(-z))
        at = self.step(z, gate)
        self.seen[1] += np.bincount(at, weight * bit, GATES * STEPS)
        self.seen[0] += np.bincount(at, weight, GATES * STEPS)
        error, curve = weight * (bit - p), weight * np.maximum(p * (1 - p), 0.01)
        for k in range(CONTEXTS + 1):
            x = odds[k] if k < CONTEXTS else 1.0
            self.weights[:, k] += RATE * np.bincount(gate, error * x, GATES) / (np.bincount(gate, curve * x * x, GATES) * (CONTEXTS + 1) + 50.0)

    def log10(self, odds: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        z = self.mixed(odds, gate)
        p = 1 / (1 + np.exp(-z))
        at = self.step(z, gate)
        ones, all_ = self.seen[1].astype(np.float32), (self.seen[0] + TRUST).astype(np.float32)
        refined = (ones[at] + np.float32(TRUST) * p) / all_[at]
        p = np.clip((p + refined) / 2, np.float32(SUREST), np.float32(1 - SUREST))
        return np.log10(np.where(bit == 1, p, 1 - p))


def gates(levels: np.ndarray, slots: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return gate * 4 + levels[slots[-1] - STARTS[-2]]


def score_words(words: list[bytes], odds_table: np.ndarray, levels: np.ndarray, mixer: Mixer) -> np.ndarray:
    out = np.zeros(len(words))
    for at, coded in _chunks(words):
        for word, slots, gate, bit in decisions(coded):
            out[at : at + len(coded)] += np.bincount(word, mixer.log10(odds_table[slots], gates(levels, slots, gate), bit), len(coded))
    return out


# -- blocks ---------------------------------------------------------------------------------------

def blocks(docs: DataFrame) -> DataFrame:
    """``block, doc_ids, held, z``: documents of one run packed together; words lower-cased, joined by blanks, documents by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, first = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        for k, (batch, rows) in enumerate(tx.runs(batches)):
            data = b"\n".join([b" ".join(tx.words(t.lower())) for t in rows])
            listed = [pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), pa.concat_arrays([batch.column(c)])) for c in ("doc_id", "held")]
            yield pa.RecordBatch.from_arrays([pa.array([first + k], pa.int64()), *listed, pa.array([z.compress(data)], pa.binary())], names=["block", "doc_ids", "held", "z"])

    return docs.mapInArrow(run, "block long, doc_ids array<long>, held array<boolean>, z binary")


class Block:
    """Distinct words of a block (by hash) and where they stand; the empty word is the end of a document."""

    def __init__(self, row: dict):
        docs = [x.split(b" ") if x else [] for x in zstandard.ZstdDecompressor().decompress(row["z"]).split(b"\n")]
        self.block, self.doc_ids = row["block"], row["doc_ids"]
        self.held = np.array(row["held"], bool)
        tokens = [w for d in docs for w in (*d, b"")]
        self.lengths = np.array([len(d) + 1 for d in docs])
        self.hashes, first, self.at = np.unique(tx.hashes(tokens), return_index=True, return_inverse=True)
        self.words = [tokens[i] for i in first.tolist()]
        self.train = np.bincount(self.at, np.repeat(~self.held, self.lengths), len(self.hashes)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


PARTS = "kind int, key long, block long, a binary, b binary"
REQUEST, TABLE, WORDS = 0, 1, 2
_NAMES = ["kind", "key", "block", "a", "b"]
#: Slots of a table that travel together.
CUT = 1 << 14


def _part(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=_NAMES)


def gathered(packed: DataFrame, buckets: int) -> DataFrame:
    """Of every block the hashes and training counts of its words, dealt into buckets, and its training words; of every task its table
    of bits, in cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, z = np.zeros((2, SLOTS), np.float32), zstandard.ZstdCompressor(level=1)
        for row in _rows(batches):
            b = Block(row)
            bucket = b.hashes % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            yield _part([(REQUEST, k, b.block, b.hashes[own].tobytes(), b.train[own].tobytes()) for k in range(buckets) if len(own := order[ends[k] : ends[k + 1]])])
            words, counts = [w for w, c in zip(b.words, b.train.tolist(), strict=True) if c], b.train[b.train > 0]
            count_bits(words, counts, table)
            if words:
                yield _part([(WORDS, 0, b.block, z.compress(b" ".join(words)), z.compress(counts.tobytes()))])
        cuts = table.reshape(2, -1, CUT).astype(np.uint32)
        yield _part([(TABLE, k, 0, *(z.compress(cuts[y, k].tobytes()) for y in (0, 1))) for k in range(cuts.shape[1]) if cuts[:, k].any()])

    return packed.mapInArrow(run, PARTS)


def answered(requests: DataFrame) -> DataFrame:
    """``block, bucket, counts, n, v``: corpus counts for each request, in its order; ``n`` and ``v`` (tokens and distinct words of the
    bucket) stand on one row of it. A bucket holds what its share of hashes holds, whatever is frequent."""

    def answer(table):  # noqa: ANN001, ANN202
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
        counts = [np.frombuffer(x, np.int64) for x in table.column("b").to_pylist()]
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        back = np.split(total[at], np.cumsum([len(h) for h in hashes])[:-1])
        rows = table.num_rows
        n, v = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        n[0], v[0] = total.sum(), (total > 0).sum()
        return pa.table({"block": table.column("block"), "bucket": table.column("key"), "counts": pa.array([x.tobytes() for x in back], pa.binary()), "n": n, "v": v})

    return requests.groupBy("key").applyInArrow(answer, "block long, bucket long, counts binary, n long, v long")


def bit_table(parts: DataFrame) -> np.ndarray:
    """The sum of the tasks' tables; a fixed size."""

    def add(table):  # noqa: ANN001, ANN202
        z = zstandard.ZstdDecompressor()
        a, b = (sum(np.frombuffer(z.decompress(x), np.uint32).astype(np.float64) for x in table.column(c).to_pylist()) for c in ("a", "b"))
        return pa.table({"key": table.column("key")[:1], "a": pa.array([a.astype(np.float32).tobytes()], pa.binary()), "b": pa.array([b.astype(np.float32).tobytes()], pa.binary())})

    out = np.zeros((2, SLOTS // CUT, CUT), np.float32)
    for r in parts.groupBy("key").applyInArrow(add, "key long, a binary, b binary").toLocalIterator():
        out[0, r["key"]], out[1, r["key"]] = np.frombuffer(r["a"], np.float32), np.frombuffer(r["b"], np.float32)
    return out.reshape(2, -1)


def learned(parts: DataFrame, table: np.ndarray) -> Mixer:
    """Every task learns online over the training words (``a, b`` of ``parts``) of its blocks; weights are averaged by tokens seen, maps are added up."""
    # The log-odds as the predictor would have had them without this very occurrence, by its bit.
    with np.errstate(invalid="ignore"):
        lower = np.log((table[1] + DELTA) / (np.maximum(table[0] - 1, 0) + DELTA))
        upper = np.log((np.maximum(table[1] - 1, 0) + DELTA) / (table[0] + DELTA))
    held = parts.sparkSession.sparkContext.broadcast((np.concatenate([lower, upper]).astype(np.float32), often(table)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (odds, levels), mixer, tokens = held.value, Mixer(), 0
        for row in _rows(batches):
            z = zstandard.ZstdDecompressor()
            words, counts = z.decompress(row["a"]).split(b" "), np.frombuffer(z.decompress(row["b"]), np.int64).astype(np.float64)
            for at, coded in _chunks(words):
                c = counts[at : at + len(coded)]
                for word, slots, gate, bit in decisions(coded):
                    mixer.learn(odds[slots + bit * SLOTS], gates(levels, slots, gate), bit, c[word])
            tokens += int(counts.sum())
        if tokens:
            values = np.concatenate([mixer.weights.ravel() * tokens, mixer.seen.ravel(), [tokens]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "value"])

    sums = parts.mapInArrow(run, "i long, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
    if not sums:
        return Mixer()
    values = np.zeros(len(sums))
    for r in sums:
        values[r["i"]] = r["value"]
    size = GATES * (CONTEXTS + 1)
    return Mixer((values[:size] / values[-1]).reshape(GATES, -1), values[size:-1].reshape(2, -1))


def scored(docs: DataFrame, held_out: str) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` per row of ``docs`` (``doc_id``, ``text``).

    ``held_out`` is an SQL condition on ``doc_id``; documents for which it is true are not learned from (null counts as false).
    ``base_score`` is the add-one unigram log10 probability of the words and the end, ``score`` the model's. Null and empty texts are
    the end alone; null ids are passed on; repeated rows are each learned from and scored; other columns are not read. No rows
    give no rows."""
    source = tx.two(docs).withColumn("held", F.coalesce(F.expr(held_out), F.lit(False)))
    packed = settle(blocks(source.select("doc_id", "text", "held")))
    buckets = max(8, packed.count() // 4)
    parts = settle(gathered(packed, buckets))
    answers = settle(answered(parts.filter(f"kind = {REQUEST}")))
    facts = answers.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = facts["n"] or 0, facts["v"] or 0
    table = bit_table(parts.filter(f"kind = {TABLE}").select("key", "a", "b"))
    mixer = learned(parts.filter(f"kind = {WORDS}").select("a", "b"), table)
    odds = np.log((table[1] + DELTA) / (table[0] + DELTA)).astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast((odds, often(table), mixer))
    replies = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("replies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, levels, mixer = held.value
        for row in _rows(batches):
            b = Block(row)
            bucket = b.hashes % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            counts = np.zeros(len(order), np.int64)
            counts[order] = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(row["replies"], key=lambda r: r["bucket"])])
            base = np.log10((counts + 1) / (n + v + 1))
            ends = np.cumsum(b.lengths)
            sums = lambda x: np.add.reduceat(x[b.at], ends - b.lengths)
            score, size = sums(score_words(b.words, odds, levels, mixer)), sums(np.array([len(w) + 1 for w in b.words]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.doc_ids, pa.int64()), pa.array(b.held), pa.array(b.lengths.astype(np.int64)), pa.array(sums((counts > 0).astype(np.int64))), pa.array(np.full(len(ends), n, np.int64)), pa.array(sums(base)), pa.array(score), pa.array(-score / size / np.log10(2))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
            )

    out = packed.join(replies, "block").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return out
