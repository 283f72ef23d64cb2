"""What the operators share: shared-folder tables, text buffers, word and shingle hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shipped(spark: SparkSession) -> None:
    """Sends this package's code to the executors once per application, so it need not be installed there.

    Arrow batches are kept to 8 MB: texts are worked on in blocks of 1 MB, so larger batches only hold memory.
    """
    if spark.conf.get(ARROW_BYTES) == "67108864b":  # Spark's default, unless the session has its own
        spark.conf.set(ARROW_BYTES, "8388608b")
    context = spark.sparkContext
    if getattr(context, "_lumenfold_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp()) / "lumenfold_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "lumenfold").rglob("*.py")):
            z.write(f, f.relative_to(root))
    context.addPyFile(str(archive))
    context._lumenfold_shipped = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset and the master is local (tests), a local one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), f"lumenfold-{uuid.uuid4().hex[:8]}")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts lineage: writes to the shared folder and reads back, so a lost executor costs one reread."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes `written` tables that nothing will read again, so that a long pipeline's disk use stays that of a step."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets, without Python strings; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes each, or one longer row: bounds what numpy holds at once."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20):
    """(slice of the batch, bytes, offsets) of each block of rows."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(column))
        for i, j in blocks(offsets, limit):
            lo = offsets[i]
            yield batch.slice(i, j - i), data[lo : offsets[j]], offsets[i : j + 1] - lo


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The stretches between offsets as an Arrow column; nothing is copied."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def binary_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a large binary column without nulls."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., size[0] of them, then first[1], ..."""
    return np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)


def equal_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Of the stretches between offsets: each one's place among the distinct ones, and the distinct ones (bytes).

    Arrow compares the bytes themselves, so no two different stretches ever share a place.
    """
    found = binaries(data, offsets).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def content_hashes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of short byte strings, eight bytes of every string at a time, each step mixed before the next."""
    h = mix(size.astype(np.uint64) + U64(11))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    on = np.arange(len(size))
    for k in range(0, int(size.max(initial=0)), 8):
        on = on[size[on] > k]
        rest = np.minimum(size[on] - k, 8).astype(np.uint64)
        word = eight[first[on] + k] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * rest))
        h[on] = mix(h[on] * U64(0x9E3779B97F4A7C15) + word)
    return h


def _word_table() -> np.ndarray:
    """Byte to word byte: A-Z lower-cased, other ASCII than 0-9 and letters 0."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    keep = np.zeros(256, bool)
    keep[48:58] = keep[97:123] = keep[128:] = True
    keep[65:91] = True
    t[~keep] = 0
    return t


WORD = _word_table()


def word_bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: start and end byte and row of each alphanumeric word; all words' lower-cased bytes end to end, and where each ends there.

    Word bytes are ASCII letters and digits and all of UTF-8's bytes over 127; words end at row ends.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint8), np.zeros(1, np.int64)
    b = WORD[data]
    is_word = b != 0
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(is_word[1:], is_word[:-1], out=edge[1:])
    edge |= cut[:n]
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    keep = is_word[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, b[is_word], np.concatenate([[0], np.cumsum(ends - starts)])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: start and end byte, 64-bit hash and row of each lower-cased alphanumeric word, as `word_bytes` finds them."""
    starts, ends, row, packed, at = word_bytes(data, offsets)
    return starts, ends, content_hashes(packed, at[:-1], np.diff(at)), row


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def blank_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: start and end byte and row of each word; words are what lies between blanks."""
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[offsets] = True
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    keep = word[starts]
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: A key is common if it has more than this many rows and more than this part of all rows: at most SPREAD are.
COMMON_ROWS, SPREAD = 10_000, 10_000


def with_key(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` joined with the one row that `table` has for each key; its column `count` says how many rows have the key.

    Keys of very many rows (at most SPREAD of them) are broadcast, so no task gets all rows of one; the rest shuffle.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    common = table.where(F.col(count) > max(COMMON_ROWS, total // SPREAD))
    if common.isEmpty():
        return rows.join(table.drop(count), key)
    rest = rows.join(F.broadcast(common.select(key)), key, "left_anti").join(table.drop(count), key)
    return rest.unionByName(rows.join(F.broadcast(common.drop(count)), key))


def bucketed(df: DataFrame, column: str, name: str, buckets: int) -> DataFrame:
    """`df` written to the shared folder in buckets of `column`, so that joins on it do not move its rows.

    The catalog holds the table only until its plan is resolved.
    """
    spark = df.sparkSession
    table, path = f"lumenfold_{uuid.uuid4().hex}", scratch(spark, name)
    df.write.bucketBy(buckets, column).option("compression", "zstd").option("path", path).saveAsTable(table)
    found = spark.table(table)
    found.schema  # resolves it
    spark.sql(f"DROP TABLE {table}")
    found._scratch = path
    return found


#: Bytes of text in a bucket.
BUCKET = 128 << 20


def buckets_for(spark: SparkSession, size: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET), 1)


def groups_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of each group of rows that come sorted by integer `columns`."""
    last, held = None, []
    for batch in batches:
        key = np.column_stack([batch.column(c).to_numpy() for c in columns])
        edge = (np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1).tolist()
        for s, e in zip([0, *edge], [*edge, len(key)], strict=True):
            if e == s:
                continue
            if held and tuple(key[s]) != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = tuple(key[s])
            held.append(batch.slice(s, e - s))
    if held:
        yield last, pa.Table.from_batches(held)
