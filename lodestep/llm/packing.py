"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the documents it reads, in order: no shuffle, and memory bounded by the open windows. A document
longer than a window fills whole windows; the rest of it is placed online into the fill level that minimises the
sum of squared counts of partly filled windows, kept in an array by level. When a task's documents end (or too
many windows are open) the windows still open are joined end to end, cutting pieces at window boundaries, and the
remainder is laid out in windows of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestep.llm import tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc: int | None, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total


class SumOfSquares:
    """Windows by fill level: ``counts[h]`` windows are open with h tokens. ``closed`` takes finished windows."""

    def __init__(self, size: int, most_open: int = 8192):
        self.size, self.most = size, most_open
        self.counts = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}
        self.number = 0

    def level_for(self, length: int) -> int:
        """The level to place ``length`` tokens on: 0 opens a window. Ties go to the fuller window."""
        n, c = self.counts, self.size
        grown = n[length + 1 : c + 1].copy()  # after placing on level h the window is on level h + length
        from_level = n[1 : c - length + 1]
        change = 2 * (grown - from_level) + 2
        change[-1] = 1 - 2 * from_level[-1]  # a full window is no longer counted
        change[from_level == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1]))
        return best + 1 if change[best] <= 2 * n[length] + 1 else 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while len(piece.ids) >= self.size:
            yield [Piece(piece.doc, piece.start, piece.ids[: self.size], piece.total)]
            piece = Piece(piece.doc, piece.start + self.size, piece.ids[self.size :], piece.total)
        length = len(piece.ids)
        if not length:
            return
        level = self.level_for(length)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
            self.number -= 1
        else:
            window = []
        window.append(piece)
        if level + length == self.size:
            yield window
            return
        self.open.setdefault(level + length, []).append(window)
        self.counts[level + length] += 1
        self.number += 1
        if self.number > self.most:
            yield from self.finish()

    def finish(self) -> Iterator[list[Piece]]:
        """Closes every open window: full windows of joined pieces, then windows of powers of two."""
        pieces = [p for level in sorted(self.open, reverse=True) for w in self.open[level] for p in w]
        left = sum(len(p.ids) for p in pieces)
        self.counts[:], self.number = 0, 0
        self.open.clear()
        window, room = [], self._next(left)
        for p in pieces:
            start, ids = p.start, p.ids
            while len(ids):
                take = min(room, len(ids))
                window.append(Piece(p.doc, start, ids[:take], p.total))
                start, ids, room, left = start + take, ids[take:], room - take, left - take
                if not room:
                    yield window
                    window, room = [], self._next(left)

    def _next(self, left: int) -> int:
        return self.size if left >= self.size else 1 << max(left.bit_length() - 1, 0)


def pack(docs: DataFrame, tokenizer: str, spaces: str, end_id: int, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """Packs every document's ids and ``end_id`` into sequences of at most ``size`` tokens; one row per piece.

    Returns doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id and offset,
    and the ids themselves with ``with_ids``. ``size`` is a power of two. Sequences shorter than ``size`` have a
    power of two tokens, so nothing is padded. Null and empty texts are ``end_id`` alone. Rows that repeat a
    doc_id are documents of their own; a null doc_id stays null. An empty table gives no rows. A sequence_id
    carries the task's partition in its high bits.
    """
    if size & (size - 1) or size < 2:
        raise ValueError("size must be a power of two")
    end = np.array([end_id], "<u4").tobytes()
    schema = SCHEMA + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence, rows = SumOfSquares(size), TaskContext.get().partitionId() << 40, []

        def take(windows: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for window in windows:
                offset = 0
                for p in window:
                    row = (p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, sequence, offset)
                    rows.append((*row, p.ids.astype(np.int64)) if with_ids else row)
                    offset += len(p.ids)
                sequence += 1

        def out() -> pa.RecordBatch:
            types = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for key, raw in tokens.encode_batches(keys, texts, tokenizer, spaces):
                ids = np.frombuffer(raw + end, "<u4")
                take(packer.add(Piece(key, 0, ids, len(ids))))
                if len(rows) >= 20_000:
                    yield out()
                    rows.clear()
        take(packer.finish())
        if rows:
            yield out()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
