"""Packing by bounded-space online best fit.

Each partition streams its documents past a fixed number of open windows. A piece goes to the window that it fills
best; when it fits none, the fullest is topped up with the piece's head and emitted, and the tail goes on. What stays
open at the end of a partition (less than one window each after merging) is merged over groups of partitions. The last
rest of a group is laid into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_slices
from .vocabulary import Ids

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Leftovers of so many partitions are merged in one task; each has less than one window of ids.
FAN_IN = 64
#: These separators count as white space in str.split but not in the tokenizer.
_ODD = regex.compile("[\x1c-\x1f]")


class Encoder:
    """Texts to little-endian 32-bit ids. No token of this vocabulary holds white space, so the words between encode alone."""

    def __init__(self, path: str):
        self.ids = Ids(path)

    def encode(self, text: str) -> bytes:
        if _ODD.search(text):
            return self.ids.whole_ids(text)
        return b"".join(self.ids.look_up(text.split()))


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class Windows:
    """Open windows of one partition; emits rows of PIECE with the ids of a piece at the end."""

    def __init__(self, size: int, open_windows: int, first_id: int):
        self.size, self.n, self.next = size, open_windows, first_id
        self.open: list[tuple[int, list]] = []

    def _emit(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next, at
            at += len(ids) // 4
        self.next += 1

    def add(self, doc_id, start: int, ids: bytes, total: int) -> Iterator[tuple]:
        while ids:
            need, best = len(ids) // 4, -1
            for k, (used, _) in enumerate(self.open):
                if used + need <= self.size and (best < 0 or used > self.open[best][0]):
                    best = k
            if best < 0 and need < self.size and len(self.open) < self.n:
                self.open.append((need, [(doc_id, start, ids, total)]))
                return
            if best >= 0:
                used, pieces = self.open.pop(best)
                head, ids = ids, b""
            else:
                used, pieces = self.open.pop(max(range(len(self.open)), key=lambda k: self.open[k][0])) if self.open and need < self.size else (0, [])
                head, ids = ids[: 4 * (self.size - used)], ids[4 * (self.size - used) :]
            pieces.append((doc_id, start, head, total))
            used, start = used + len(head) // 4, start + len(head) // 4
            if used == self.size:
                yield from self._emit(pieces)
            else:
                self.open.append((used, pieces))

    def merge(self) -> Iterator[tuple]:
        """Fills the fullest windows from the emptiest until at most one is open."""
        self.open.sort(key=lambda w: w[0])
        while len(self.open) > 1:
            spare, self.n = self.open.pop(0)[1], 0
            for piece in spare:
                yield from self._top_up(*piece)

    def _top_up(self, doc_id, start, ids, total) -> Iterator[tuple]:
        while ids:
            used, pieces = self.open.pop() if self.open else (0, [])
            head, ids = ids[: 4 * (self.size - used)], ids[4 * (self.size - used) :]
            pieces.append((doc_id, start, head, total))
            used, start = used + len(head) // 4, start + len(head) // 4
            if used == self.size:
                yield from self._emit(pieces)
            else:
                self.open.append((used, pieces))

    def close(self) -> Iterator[tuple]:
        """Lays the last open window into sequences of decreasing powers of two."""
        for used, pieces in self.open:
            while used:
                room = size = 1 << (used.bit_length() - 1)
                part = []
                while room:
                    doc_id, start, ids, total = pieces.pop(0)
                    head, rest = ids[: 4 * room], ids[4 * room :]
                    part.append((doc_id, start, head, total))
                    room -= len(head) // 4
                    if rest:
                        pieces.insert(0, (doc_id, start + len(head) // 4, rest, total))
                used -= size
                yield from self._emit(part)
        self.open = []


def _batch(rows: list[tuple], ids: bool) -> pa.RecordBatch:
    names = [f.split()[0] for f in PIECE.split(", ")]
    columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))]
    if ids:
        columns.append(pa.array([r[7] if len(r) > 7 else None for r in rows], pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def pack(documents: DataFrame, tokenizer_path: str, size: int = 4096, open_windows: int = 16, end_id: int = 2) -> DataFrame:
    """One row a piece: which ids of which document stand where in which sequence.

    A null or empty text still has its end id, one piece of length 1. Rows are independent: repeated rows and null ids
    are packed each. An empty table gives no piece; other columns are not read. Only full sequences and sequences
    whose length is a power of two are made, so none is padded.
    """
    end = end_id.to_bytes(4, "little")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        windows, rows = Windows(size, open_windows, part << 32), []
        for b in in_slices(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                rows += windows.add(doc_id, 0, ids, len(ids) // 4)
            yield _batch(rows, True)
            rows = []
        rows += windows.merge()
        rows += [(d, s, len(i) // 4, 0, n, part, 0, i) for _, pieces in windows.open for d, s, i, n in pieces]
        yield _batch(rows, True)

    def rest(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, rows = Windows(size, open_windows, (1 << 62) | (key[0].as_py() << 32)), []
        pieces = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["part"], r["doc_id"] or 0, r["start"]))
        for r in pieces:
            rows += windows._top_up(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        rows += windows.close()
        yield _batch(rows, False)

    filled = cut(documents.select("doc_id", "text").mapInArrow(fill, f"{PIECE}, ids binary"))
    left = filled.where("ids is not null").select("doc_id", "start", "doc_tokens", "ids", F.col("sequence_id").alias("part"), F.floor(F.col("sequence_id") / FAN_IN).alias("fan"))
    return filled.where("ids is null").drop("ids").unionByName(left.groupBy("fan").applyInArrow(rest, PIECE))
