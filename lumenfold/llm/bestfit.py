"""Best-fit packing by sum of squares: whole documents into as few windows as can be.

Documents become pieces (only one longer than a window is cut: its remainder first, then whole windows). Pieces are
placed from the longest on. An array counts the open sequences by residual gap; a piece goes where the sum of the
squared counts becomes smallest, of equal gaps into the least. A new sequence is begun only where no open one has
room: counts that stay level keep gaps of all sizes ready, and the short pieces at the end close them.

Scale: ids are made in one pass over the texts, of which only 40 bytes a piece go on, written to the shared folder.
Pieces are dealt out evenly in parts of PART pieces, so each part has the mix of lengths of the whole and a task
holds one part's numbers. Each part leaves a sequence or two that are not full. Nothing is grouped by document, so
copies and repeated ids change nothing. Sequence ids are a part's number and a counter over an order fixed by the
pieces, so a task that runs again gives the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_blocks, written
from .tokens import encoder

#: Pieces in a part.
PART = 1 << 15
#: Bits of a sequence id that count a part's own sequences.
OWN_BITS = 36


class Gaps:
    """Open sequences by residual gap; `place` gives the sequence and offset of a piece."""

    def __init__(self, window: int):
        self.window, self.made = window, 0
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def gap(self, size: int) -> int:
        """The gap to use, 0 if none has room. From g to g - size the squares change by 2 (N[g - size] - N[g]) + 2; a
        full sequence is not counted."""
        before, after = self.count[size:], self.count[: self.window + 1 - size]
        change = 2 * (after - before) + 2
        change[0] -= 1
        change[before == 0] = np.iinfo(np.int64).max
        k = int(np.argmin(change))
        return size + k if before[k] else 0

    def place(self, size: int) -> tuple[int, int]:
        g = self.gap(size) if size < self.window else 0
        if g:
            sequence = self.open[g].pop()
            self.count[g] -= 1
        else:
            g, sequence = self.window, self.made
            self.made += 1
        if g > size:
            self.open[g - size].append(sequence)
            self.count[g - size] += 1
        return sequence, self.window - g


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """deal (a number of the row's own), id, piece, start, length, ids_crc32: the pieces of every document."""
    schema = T.StructType().add("deal", "long").add(docs.select(F.col(id_column)).schema[0])
    schema = schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, deal = encoder(tokenizer), TaskContext.get().partitionId() << OWN_BITS
        for rows, data, offsets in text_blocks(batches, text_column):
            ids, at = code.encode(data, offsets)
            of, start, size, crc = [], [], [], []
            for k in range(rows.num_rows):
                own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                cuts = [0, *range(len(own) % window or window, len(own), window), len(own)]
                of += [k] * (len(cuts) - 1)
                start += cuts[:-1]
                size += [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
                crc += [zlib.crc32(own[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
            of = np.array(of, np.int64)
            number = np.arange(len(of)) - np.searchsorted(of, of)
            columns = [pa.array(deal + np.arange(len(of))), rows.column(id_column).take(pa.array(of)), pa.array(number.astype(np.int32))]
            deal += len(of)
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (start, size, crc))], names=["deal", id_column, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", part: int = PART) -> DataFrame:
    """A row per piece: id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    A document is its ids and `end_id`. A null text is an empty one and is the end id alone; ids may be null or
    repeat (each row is a document of its own); whole texts are packed, however long. Ties of length are placed in the
    order of the rows. Other columns are ignored; an empty table gives no rows. `part` bounds the pieces of a task.
    """
    found = written(pieces(docs, tokenizer, window, end_id, id_column, text_column), "pieces")
    parts = -(-found.count() // part) or 1
    schema = found.drop("deal").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        rows = rows.take(pa.array(np.lexsort((rows.column("deal").to_numpy(), -rows.column("length").to_numpy())))).drop_columns(["deal"])
        gaps, first = Gaps(window), TaskContext.get().partitionId() << OWN_BITS
        placed = np.array([gaps.place(n) for n in rows.column("length").to_pylist()], np.int64)
        rows = rows.append_column("sequence_id", pa.array(first + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))
        yield from rows.to_batches(max_chunksize=10_000)

    return found.repartition(parts, "deal").mapInArrow(run, schema)
