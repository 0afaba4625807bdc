"""Byte-level BPE as a tree reduction.

Encodings of byte strings form a monoid: the encoding of a concatenation depends on the two encodings only near the joint. A match of
the pattern is halved down to single bytes, and neighbours are joined: if re-encoding the two tokens at the joint gives the same two,
the encodings are simply put together; else the window around the joint grows by one token on each side and is re-encoded until the
tokens next to it stay as they are. That is proof enough: a sequence of tokens is an encoding exactly if each two neighbours
are the encoding of their bytes. Decoding concatenates up the same tree. Encodings of distinct texts are remembered by a task, so the
work per row is a lookup for most words; the memory is bounded."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terrafold.llm import text as tx
from terrafold.llm.pieces import MEMORY, pieces


class Encoder:
    """Ranks of byte strings; the rank is the id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self._pairs: dict[tuple[int, int], tuple[int, ...]] = {}
        self._known: dict[bytes, tuple[int, ...]] = {}
        self._pieces: dict[str, bytes] = {}

    @classmethod
    def load(cls, lines: list[bytes], pattern: str) -> Encoder:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge(self, data: bytes) -> tuple[int, ...]:
        """The encoding of a short byte string by its definition: merge the neighbours of least rank, leftmost first."""
        if len(data) > 100:
            return self._merge_long(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
            if best == 1 << 40:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, data: bytes) -> tuple[int, ...]:
        """The same with a heap, for windows that had to grow far (long runs of one character)."""
        n, ranks = len(data), self.ranks
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = ranks.get(data[i : end[j]])
                if rank is not None:
                    heappush(heap, (rank, i, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, stop = heappop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], after[i], end[j] = stop, after[j], 0
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = after[i]
        return tuple(out)

    def pair(self, a: int, b: int) -> tuple[int, ...]:
        """The encoding of the bytes of two tokens; the tokens are stable side by side if it is these two."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > MEMORY:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b])
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left + right
        i, j = len(left) - 1, 1
        inside = self.pair(left[-1], right[0])
        if inside == (left[-1], right[0]):
            return left + right
        while True:
            ok_left = i == 0 or self.pair(left[i - 1], inside[0]) == (left[i - 1], inside[0])
            ok_right = j == len(right) or self.pair(inside[-1], right[j]) == (inside[-1], right[j])
            if ok_left and ok_right:
                return left[:i] + inside + right[j:]
            # The side that isn't stable yet doubles.
            if not ok_left:
                i = max(0, i - max(1, len(left) - i))
            if not ok_right:
                j = min(len(right), 2 * j)
            inside = self.merge(b"".join([self.tokens[t] for t in left[i:] + right[:j]]))

    def reduce(self, data: bytes) -> tuple[int, ...]:
        """Encodes the halves and joins them."""
        if len(data) == 1:
            return (self.ranks[data],)
        known = self._known.get(data) if len(data) <= 32 else None
        if known is None:
            half = len(data) // 2
            known = self.join(self.reduce(data[:half]), self.reduce(data[half:]))
            if len(data) <= 32:
                if len(self._known) > MEMORY:
                    self._known.clear()
                self._known[data] = known
        return known

    def match(self, data: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else self.reduce(data)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out = []
        known = self._pieces
        for piece in pieces(text):
            ids = known.get(piece)
            if ids is None:
                ids = b"".join([i.to_bytes(4, "little") for m in self.find(piece) for i in self.match(m.encode())])
                if len(piece) <= 64:
                    if len(known) > MEMORY:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Concatenates up a tree of halves; its leaves are runs of tokens."""
        n = len(ids) // 4
        if n > 256:
            half = n // 2 * 4
            return self.decode(ids[:half]) + self.decode(ids[half:])
        tokens = self.tokens
        return b"".join([tokens[i] for i in memoryview(ids).cast("I")]) if n else b""


def encoded(docs: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) per row of ``docs`` (``doc_id``, ``text``; other columns are not read).

    Each match of ``pattern`` is encoded by itself; there are no special tokens. Null and empty texts have no ids, a null
    ``doc_id`` is passed on, repeated rows are encoded each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_file, pattern)
        for batch, rows in tx.runs(batches):
            ids = [encoder.encode(t.decode("utf-8", "replace")) for t in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return tx.two(docs).mapInArrow(run, "doc_id long, ids binary")


def decoded(ids: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded`` from ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks_file, pattern)
        for batch in batches:
            rows = [x or b"" for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in rows], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()), pa.array([encoder.decode(x) for x in rows], pa.binary())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded"],
            )

    return ids.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded binary")


def _encoder(ranks_file: str, pattern: str) -> Encoder:
    with open(ranks_file, "rb") as lines:
        return Encoder.load(lines.readlines(), pattern)
