"""Token-id files: canonical length-limited Huffman coding, decoded by table from independent blocks.

Texts are encoded once and the ids kept in a table. Its global counts (one row per vocabulary entry, however
large the corpus) give code lengths on the driver by package-merge. The ids are then range-partitioned by
document id; each partition writes blocks of some 64k ids: payload bits, the documents' ids and lengths, and
the bit offset of every 256th id. The codebook and each shard's number of ids lie beside the blocks, so the files are
read from their path alone. A reader decodes any block by itself, all its checkpoints side by side.

Scale: the ids (2 bytes each) are shuffled once; start positions come from per-shard totals, one row a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import forget, scratch, text_blocks, written
from .tokens import encoder

#: Longest code; a decoding table has 2 ** MAX_BITS entries.
MAX_BITS = 18
BLOCK_IDS = 1 << 16
CHECKPOINT = 256


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits by package-merge; 0 for ids that do not occur."""
    length = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        length[used] = 1
        return length
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    level, is_leaf = leaf, [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaf, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        is_leaf.append(rank < len(leaf))
    take = 2 * len(leaf) - 2
    for mask in reversed(is_leaf):
        leaves = int(mask[:take].sum())
        length[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return length


def canonical_codes(length: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    code = np.zeros(len(length), np.uint64)
    order = np.lexsort((np.arange(len(length)), length))
    order = order[length[order] > 0]
    if len(order):
        top = int(length.max())
        step = np.int64(1) << (top - length[order])
        code[order] = ((np.cumsum(step) - step) >> (top - length[order])).astype(np.uint64)
    return code


def decoding_table(length: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """id and length for every value of the next `top` bits."""
    top = max(1, int(length.max(initial=0)))
    order = np.lexsort((np.arange(len(length)), length))
    order = order[length[order] > 0]
    span = np.int64(1) << (top - length[order])
    symbol = np.zeros(1 << top, np.uint32)
    bits = np.ones(1 << top, np.int64)
    filled = int(span.sum())
    symbol[:filled] = np.repeat(order, span)
    bits[:filled] = np.repeat(length[order], span)
    return symbol, bits, top


def encode_block(ids: np.ndarray, code: np.ndarray, length: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Big-endian bits of the ids, and the bit offset of each CHECKPOINT-th id."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    n_bits = length[ids]
    end = np.cumsum(n_bits)
    at = end - n_bits
    word = at >> 5
    shifted = code[ids] << (64 - n_bits - (at & 31)).astype(np.uint64)
    out = np.zeros((int(end[-1]) >> 5) + 2, np.uint64)
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes()[: (int(end[-1]) + 7) >> 3], at[::CHECKPOINT]


def decode_block(payload: bytes, n: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """All checkpoints advance together, one id a step."""
    symbol, bits, top = table
    raw = np.frombuffer(payload + bytes(8), ">u4", count=(len(payload) + 8) // 4).astype(np.uint64)
    pairs = (raw[:-1] << np.uint64(32)) | raw[1:]
    lanes = len(checkpoints)
    out = np.zeros((lanes, CHECKPOINT), np.uint32)
    at = checkpoints.astype(np.int64)
    last = n - (lanes - 1) * CHECKPOINT if lanes else 0
    down = np.uint64(64 - top)
    for k in range(min(CHECKPOINT, n)):
        if k == last:  # the last lane may be shorter
            at = at[:-1]
        look = ((pairs[at >> 5] << (at & 31).astype(np.uint64)) >> down).astype(np.int64)
        out[: len(at), k] = symbol[look]
        at = at + bits[look]
    return out.reshape(-1)[:n]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_tokens, ids (little-endian unsigned 16-bit, or 32-bit for vocabularies beyond 65,536) with the end id."""
    schema = docs.select(F.col(id_column)).schema.add("n_tokens", "long").add("ids", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        width = id_type(code.library.get_vocab_size(), end_id)
        for rows, data, offsets in text_blocks(batches, text_column):
            ids, at = code.encode(data, offsets)
            n, step = len(at) - 1, np.dtype(width).itemsize
            flat = np.insert(ids, at[1:], end_id).astype(width)
            at = at + np.arange(n + 1)
            packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((at * step).astype(np.int32)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.array(np.diff(at)), packed], names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def id_type(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"


def count_ids(tokens: DataFrame, width: str) -> DataFrame:
    """token, n: each task counts into one array, then one row per token and task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column("ids"):
                part = np.bincount(np.frombuffer(x.as_buffer(), width))
                if len(part) > len(total):
                    part[: len(total)] += total
                    total = part
                else:
                    total[: len(part)] += part
        token = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(total[token].astype(np.int64))], names=["token", "n"])

    return tokens.select("ids").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def write_files(tokens: DataFrame, width: str, path: str, id_column: str = "doc_id") -> None:
    """Writes the token files under `path`: blocks, codebook (token, length of its code) and shards (shard, n_tokens).

    Blocks are in ascending id order (nulls first, equal ids by a hash of their content). The three tables are all a reader needs.
    """
    spark = tokens.sparkSession
    found = count_ids(tokens, width).toPandas()  # one row per vocabulary entry at most
    counts = np.zeros(int(found.token.max()) + 1 if len(found) else 1, np.int64)
    counts[found.token.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    length = code_lengths(counts)
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum() >> 25), 1)
    id_type_ = tokens.schema[id_column].dataType.simpleString()
    schema = f"shard long, first_token long, n_tokens long, payload binary, checkpoints binary, lengths binary, ids array<{id_type_}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, start, held, keys, shard = canonical_codes(length), 0, [], [], None

        def block() -> pa.RecordBatch:
            nonlocal start
            ids = np.concatenate(held)
            payload, points = encode_block(ids, code, length)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    pa.array([start], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([payload], pa.binary()),
                    pa.array([points.astype("<u8").tobytes()], pa.binary()),
                    pa.array([np.array([len(x) for x in held], "<u4").tobytes()], pa.binary()),
                    pa.array([keys], pa.list_(key_type)),
                ],
                names=["shard", "first_token", "n_tokens", "payload", "checkpoints", "lengths", "ids"],
            )
            start += len(ids)
            held.clear()
            keys.clear()
            return out

        size = 0
        for batch in batches:
            key_type = batch.schema.field(id_column).type
            for s, key, x in zip(batch.column("_shard").to_pylist(), batch.column(id_column).to_pylist(), batch.column("ids"), strict=True):
                shard = s
                held.append(np.frombuffer(x.as_buffer(), width))
                keys.append(key)
                size += len(held[-1])
                if size >= BLOCK_IDS:
                    yield block()
                    size = 0
        if held:
            yield block()

    # rows of one id (or of none) are spread by their content, and rows that repeat by their place in the table
    keys_ = [id_column, "_content", "_place"]
    ordered = (
        tokens.select(id_column, "ids", F.xxhash64("ids").alias("_content"), F.monotonically_increasing_id().alias("_place"))
        .repartitionByRange(shards, *keys_)
        .sortWithinPartitions(*keys_)
        .select(id_column, "ids", F.spark_partition_id().cast("long").alias("_shard"))
    )
    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    used = np.flatnonzero(length)
    spark.createDataFrame(pa.table({"token": used, "length": length[used]})).coalesce(1).write.parquet(f"{path}/codebook")
    spark.read.parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{path}/shards")


def read_files(spark: SparkSession, path: str, id_column: str = "doc_id", ids: bool = False) -> DataFrame:
    """id, start (ids of all documents before it), n_tokens, ids_crc32 of every document (and its ids), decoded from its block."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    codebook = spark.read.parquet(f"{path}/codebook").toPandas()  # one row per vocabulary entry at most
    length = np.zeros(int(codebook.token.max()) + 1 if len(codebook) else 1, np.int64)
    length[codebook.token.to_numpy(np.int64)] = codebook.length.to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(length)
        for batch in batches:
            for k in range(batch.num_rows):
                at = lambda name: batch.column(name)[k]
                n = at("n_tokens").as_py()
                decoded = decode_block(at("payload").as_py(), n, np.frombuffer(at("checkpoints").as_py(), "<u8"), table).astype("<u4")
                sizes = np.frombuffer(at("lengths").as_py(), "<u4").astype(np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(decoded[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [at("ids").values, pa.array(np.full(len(sizes), at("shard").as_py())), pa.array(starts + at("first_token").as_py()), pa.array(sizes), pa.array(crc, pa.int64())]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(decoded)).astype(np.int32)), pa.array(decoded.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [id_column, "shard", "_start", "n_tokens", "ids_crc32", *["ids"] * ids]
    docs = blocks.mapInArrow(run, f"{id_column} {kind}, shard long, _start long, n_tokens long, ids_crc32 long{', ids array<int>' if ids else ''}")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = spark.read.parquet(f"{path}/shards").select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_before"))
    return docs.join(F.broadcast(shards), "shard").select(id_column, (F.col("_before") + F.col("_start")).alias("start"), *names[3:])


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Writes all texts' ids under `path` (a new folder in the shared one) and reads them back. A null text is an empty one: the end id alone.

    Ids may be null (first) or repeat; an empty table gives no rows; a text of any length stays in one block.
    """
    width = id_type(encoder(tokenizer).library.get_vocab_size(), end_id)
    tokens = written(tokenized(docs, tokenizer, end_id, id_column, text_column), "token-ids")
    path = path or scratch(docs.sparkSession, "token-files")
    write_files(tokens, width, path, id_column)
    forget(tokens)
    return read_files(docs.sparkSession, path, id_column)
