"""Sum-of-squares online packing of tokenized documents into windows.

Each partition packs its documents as they come. The full windows of a long document leave at once; its rest, of s tokens, goes
into a partially filled window. The level array counts the partially filled windows of each fill level; the rest is placed into
the level (or a new window) that makes the sum of the squared counts smallest, ties to the fullest. When a partition ends, what
its still open windows hold is laid end to end and cut at window bounds, so a partition leaves one padded window at most.

A task holds its open windows only: at most some hundred KB of ids for each thousand levels. Placement needs nothing from
other partitions, so there is no shuffle and no bottleneck; padding is under one window for each input partition. A retried
task reads the same rows and gives the same result. Null and empty texts are the end id alone; repeated rows are packed each, and
rows that share an id are documents of their own. A very long text is encoded whole, four bytes an id, and cut into full windows.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.bpe import load
from tessera.llm.common import documents_of, tidy

WINDOW, END_ID = 1024, 0
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]

Piece = tuple[int | None, int, int, bytes]  # document, start, its number of tokens, ids


class SumOfSquares:
    """Online packing; ``done`` gets the pieces of windows that are full."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]
        self.done: list[list[Piece]] = []

    def level(self, size: int) -> int:
        """The fill level to place ``size`` tokens into; 0 is a new window."""
        n, top = self.counts, self.window - size
        change = 1 - 2 * n[: top + 1] + np.where(np.arange(top + 1) == top, 0, 2 * n[size : self.window + 1] + 1)
        change[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * n[size] + 1
        return top - int(np.argmin(change[::-1]))

    def add(self, piece: Piece) -> None:
        size = len(piece[3]) // 4
        if size == self.window:
            self.done.append([piece])
            return
        at = self.level(size)
        pieces = self.open[at].pop() if at else []
        pieces.append(piece)
        if at:
            self.counts[at] -= 1
        if at + size == self.window:
            self.done.append(pieces)
        else:
            self.counts[at + size] += 1
            self.open[at + size].append(pieces)

    def close(self) -> None:
        """Lays the rest end to end, fullest windows first."""
        row: list[Piece] = []
        room = self.window
        for level in reversed(self.open):
            for doc, start, total, ids in (p for pieces in level for p in pieces):
                while ids:
                    part, ids = ids[: 4 * room], ids[4 * room :]
                    row.append((doc, start, total, part))
                    start, room = start + len(part) // 4, room - len(part) // 4
                    if not room:
                        self.done.append(row)
                        row, room = [], self.window
            level.clear()
        self.counts[:] = 0
        if row:
            self.done.append(row)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds its ids (binary)."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = load(path), SumOfSquares(window)
        first = TaskContext.get().partitionId() << 40
        given = 0

        def out() -> pa.RecordBatch:
            nonlocal given
            rows: list[tuple] = []
            for pieces in packer.done:
                offset = 0
                for doc, start, total, ids in pieces:
                    n = len(ids) // 4
                    rows.append((doc, start, n, crc32(ids), total, first + given, offset, *((ids,) if with_ids else ())))
                    offset += n
                given += 1
            packer.done = []
            types = [pa.int64()] * 7 + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], _NAMES + ["ids"] * with_ids)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = tokenizer.encode(text) + end
                total, step = len(ids) // 4, 4 * window
                for i in range(0, len(ids), step):
                    packer.add((doc, i // 4, total, ids[i : i + step]))
            yield out()
        packer.close()
        yield out()

    return documents_of(docs).mapInArrow(tidy(run), SCHEMA + ", ids binary" * with_ids)
