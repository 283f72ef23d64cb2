"""Sum-of-squares online packing of token ids into windows of a fixed length.

A document of at most a window goes whole into the open window whose new fill level makes the sum of squared counts
of windows per level smallest: an array holds how many windows are open at each level (each number of ids filled), and
windows at one level are interchangeable. Of a longer document the whole windows are cut off first. Documents are cut
for two more reasons only: at a task's end the windows still open are joined end to end and cut anew, so that a task
pads one window at most; and where more than `most_open` windows are open (as when all documents are just over half
a window) the fullest of them joins those, one at a time, so that a task's memory stays bounded and the others stay open.

Map-only: no shuffle, and a task holds its open windows only. Sequence ids are the task's partition number and a
counter, so a task that runs again gives the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks
from .tokens import encoder

#: Bits of a sequence id that count a task's own sequences.
OWN_BITS = 36
PIECE = (("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"))


class SumOfSquares:
    """Feeds pieces (key, start, ids, doc_tokens) to windows; full windows go to `emit` as lists of pieces."""

    def __init__(self, window: int, emit, most_open: int = 4096):
        self.window, self.emit, self.most_open = window, emit, most_open
        self.count = np.zeros(window + 1, np.int64)  # open windows at each level
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0
        self.rest: list = []
        self.rest_fill = 0

    def add(self, key, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n // w * w
        for s in range(0, whole, w):
            self.emit([(key, s, ids[s : s + w], n)])
        if whole < n:
            self._place((key, whole, ids[whole:], n))
        if self.n_open > self.most_open:
            self._close_fullest()

    def level(self, size: int) -> int:
        """The level of the window to use, 0 for a new one: a move from h to h + size changes the squares by
        2 (N[h + size] - N[h]) + 2; a full window is not counted. Of equal ones the emptiest."""
        count, top = self.count, self.window
        change = 2 * (count[size:] - count[: top + 1 - size]) + 2
        change[0] = 2 * count[size] + 1  # a new window
        change[-1] = 1 - 2 * count[top - size]
        if size == top:
            return 0
        change[1:][count[1 : top + 1 - size] == 0] = np.iinfo(np.int64).max
        return int(np.argmin(change))

    def _place(self, piece) -> None:
        size = len(piece[2])
        h = self.level(size)
        into = self.open[h].pop() if h else []
        self.count[h] -= h > 0
        self.n_open -= h > 0
        into.append(piece)
        if h + size == self.window:
            self.emit(into)
        else:
            self.open[h + size].append(into)
            self.count[h + size] += 1
            self.n_open += 1

    def _append(self, piece) -> None:
        """End to end, cutting at the window's end."""
        key, start, ids, n = piece
        while len(ids):
            k = min(len(ids), self.window - self.rest_fill)
            self.rest.append((key, start, ids[:k], n))
            self.rest_fill += k
            start, ids = start + k, ids[k:]
            if self.rest_fill == self.window:
                self.emit(self.rest)
                self.rest, self.rest_fill = [], 0

    def _close_fullest(self) -> None:
        h = int(np.flatnonzero(self.count)[-1])
        for piece in self.open[h].pop():
            self._append(piece)
        self.count[h] -= 1
        self.n_open -= 1

    def _join(self) -> None:
        for level in self.open:
            for window in level:
                for piece in window:
                    self._append(piece)
            level.clear()
        self.count[:] = 0
        self.n_open = 0

    def close(self) -> None:
        self._join()
        if self.rest:
            self.emit(self.rest)
            self.rest, self.rest_fill = [], 0


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is an empty one and gives the end id alone; ids may be null or repeat (each row is a document
    of its own); a text longer than a window fills whole windows first, however long it is. A task keeps 4,096 windows
    open at most; beyond that the documents of the fullest are cut where windows end. An empty table gives no rows.
    """
    schema = docs.select(F.col(id_column)).schema
    for name, t in PIECE:
        schema = schema.add(name, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first, made = encoder(tokenizer), TaskContext.get().partitionId() << OWN_BITS, 0
        out: list[tuple] = []

        def emit(pieces) -> None:
            nonlocal made
            at = 0
            for key, start, ids, n in pieces:
                out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, first + made, at))
                at += len(ids)
            made += 1

        def drained():
            columns = list(zip(*out, strict=True))
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:])]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        packer = SumOfSquares(window, emit)
        for rows, data, offsets in text_blocks(batches, text_column):
            key_type = rows.schema.field(id_column).type
            ids, at = code.encode(data, offsets)
            for k, key in enumerate(rows.column(id_column).to_pylist()):
                packer.add(key, np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)))
            if out:
                yield drained()
        packer.close()
        if out:
            yield drained()

    return docs.select(id_column, text_column).mapInArrow(run, schema)
