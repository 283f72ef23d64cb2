"""Suffix-array dedup of byte strings: every byte of a 50-byte string that also starts in an earlier document.

Two equal windows of WINDOW bytes have equal anchors: the least hash of the SEED-byte strings in them. Consecutive
windows with one anchor form a stretch of text. Only stretches whose anchor occurs in several documents can hold a
repeat; they are dealt out by anchor, so equal windows meet in one place whatever the corpus. There the stretches of
an anchor are put end to end, and a suffix array (`grouping`) brings equal windows together; each run of suffixes
with WINDOW bytes in common has the smallest document of its members. A window is a repeat for all other documents.

Hashes only say what has to meet: copies of a stretch are merged when their bytes are equal, in its chunk and again
where they meet, and which windows different stretches have in common is read off the suffix arrays.

Steps, each a table or a shuffle that a lost executor rereads: documents are packed into chunks of some MB, written
bucketed by chunk; anchors of each chunk (6 bytes each) are dealt out and those of several documents come back;
stretches are dealt out and answers come back; both come back to chunks without moving the chunks. Nothing grows on
the driver. An anchor that occurs very often, as in a line that a third of all documents have, would bring all its
surroundings to one place: its stretches are cut by the longer anchors of COMMON_SEED bytes before they are dealt out,
so what lies in the line is one string a chunk, and what reaches beyond it is spread by what follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, blocks, bucketed, buckets_for, content_hashes, groups_of, mix, text_blocks, written
from .grouping import suffix_arrays

WINDOW, SEED = 50, 24
#: Occurrences beyond which an anchor's stretches are cut by longer anchors, and those anchors' bytes.
COMMON, COMMON_SEED = 20_000, 48
#: Strings of a lane beyond which it is told apart further, and the anchors for that.
LANE, FINER = 16, (40, 48)
#: Bytes of text in a chunk; most windows of a stretch; symbols in one batch of lanes.
CHUNK, LONGEST, BATCH = 4 << 20, 64, 3 << 19
#: Bytes of text for each part that anchors are dealt to.
PART = 12 << 20
LAST = np.iinfo(np.int64).max


# ---- chunks


def chunks_of(docs: DataFrame, keep: tuple[str, ...], size: int) -> DataFrame:
    """chunk, rows (the `keep` columns as an Arrow stream), ids, sizes, text: bucketed by chunk in the shared folder."""
    names = list(dict.fromkeys([*keep, "doc_id", "text"]))

    def pack(held: list, chunk: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches([h[0].select(list(keep)) for h in held])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_table(rows)
        ids = np.concatenate([h[0].column("doc_id").cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False) for h in held])
        sizes = np.concatenate([np.diff(h[2]) for h in held])
        text = np.concatenate([h[1] for h in held])
        values = [[chunk], [sink.getvalue().to_pybytes()], [ids.astype("<i8").tobytes()], [sizes.astype("<i8").tobytes()], [text.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(values[0], pa.int64()), *(pa.array(v, pa.binary()) for v in values[1:])], names=["chunk", "rows", "ids", "sizes", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for block in text_blocks(batches, "text"):
            held.append(block)
            size += len(block[1])
            if size >= CHUNK:
                yield pack(held, chunk)
                chunk, held, size = chunk + 1, [], 0
        if held:
            yield pack(held, chunk)

    packed = docs.select(*names).mapInArrow(run, "chunk long, rows binary, ids binary, sizes binary, text binary")
    return bucketed(packed, "chunk", "chunks", buckets_for(docs.sparkSession, size))


# ---- stretches of a chunk


def anchors(data: np.ndarray, offsets: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's texts: first byte, number of windows, anchor key and text of each stretch."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < WINDOW:
        return none, none, np.zeros(0, np.uint64), none
    h = data.astype(np.uint64) + U64(1)
    width = 1
    while width < seed:  # hashes of strings up to twice as long, from two that may overlap
        step = min(width, seed - width)
        h = h[:-step] * U64(0x9E3779B97F4A7C15 + 2 * width) + h[step:]
        h ^= h >> U64(31)
        width += step
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    span, width = WINDOW - seed + 1, 1
    while width * 2 <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if span > width:
        h = np.minimum(h[: -(span - width)], h[span - width :])
    # windows that stay within one text
    size = np.diff(offsets)
    fits = np.flatnonzero(size >= WINDOW)
    count = size[fits] - WINDOW + 1
    inside = np.zeros(n + 1, np.int8)
    inside[offsets[fits]] = 1
    inside[offsets[fits] + count] -= 1
    inside = np.cumsum(inside[: len(h)], dtype=np.int8).view(bool)
    start = np.empty(len(h), bool)
    start[0] = True
    np.not_equal(h[1:], h[:-1], out=start[1:])
    start[offsets[fits]] = True
    start &= inside
    first = np.flatnonzero(start)
    if not len(first):
        return none, none, np.zeros(0, np.uint64), none
    text = np.searchsorted(offsets, first, side="right") - 1
    end = np.minimum(np.append(first[1:], n), offsets[text + 1] - WINDOW + 1)
    windows = end - first
    key = mix(h[first])
    if (windows > LONGEST).any():  # one anchor for long, as in a run of one letter: cut
        pieces = -(-windows // LONGEST)
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, key, text, left = (np.repeat(x, pieces) for x in (first, key, text, windows))
        first = first + place * LONGEST
        windows = np.minimum(left - place * LONGEST, LONGEST)
    return first, windows, key, text


class Chunk:
    def __init__(self, batch: pa.RecordBatch, k: int):
        self.id = batch.column("chunk")[k].as_py()
        self.rows = batch.column("rows")[k]
        self.ids = np.frombuffer(batch.column("ids")[k].as_buffer(), "<i8")
        self.data = np.frombuffer(batch.column("text")[k].as_buffer() or b"", np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(batch.column("sizes")[k].as_buffer(), "<i8"))])

    def stretches(self):
        """First byte, windows, anchor and text of the chunk's stretches."""
        parts = []
        for i, j in blocks(self.offsets, 1 << 20):
            lo = self.offsets[i]
            first, windows, key, text = anchors(self.data[lo : self.offsets[j]], self.offsets[i : j + 1] - lo)
            parts.append((first + lo, windows, key, text + i))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return data[_runs(first, size)]


# ---- anchors of several documents


def part_bits(size: int) -> int:
    return min(31, max(0, (-(-size // PART) - 1).bit_length()))


def _parts(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)


def _by_part(key: np.ndarray, bits: int):
    """(part, from, to) of sorted keys."""
    part = _parts(key, bits)
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]))
    return zip(part[at].tolist(), at.tolist(), np.append(at[1:], len(part)).tolist(), strict=True)


def _low(key: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits of a key below its part's."""
    return (key >> U64(32 - bits)).astype(np.uint32)


def shared_anchors(chunks: DataFrame, bits: int) -> DataFrame:
    """chunk, part, anchors, common: those of each chunk's anchors that some other document has too, and the very common of them."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = Chunk(batch, k)
                _, _, key, text = chunk.stretches()
                order = np.argsort(key)
                key, doc = key[order], chunk.ids[text[order]]
                at = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
                if not len(at):
                    continue
                several = np.maximum.reduceat(doc, at) > np.minimum.reduceat(doc, at)
                times = np.minimum(np.diff(np.append(at, len(key))), 0x7FFF) | (several << 15)  # known to be in several documents: the top bit
                key = key[at]
                out = [(p, _low(key[s:e], bits).astype("<u4").tobytes(), times[s:e].astype("<u2").tobytes()) for p, s, e in _by_part(key, bits)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([chunk.id] * len(out), pa.int64()), *(pa.array([o[j] for o in out], pa.binary()) for j in (1, 2))],
                    names=["part", "chunk", "anchors", "times"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in groups_of(batches, "part"):
            held = [np.frombuffer(v, "<u4") for v in rows.column("anchors").to_pylist()]
            every, times = np.concatenate(held), np.concatenate([np.frombuffer(v, "<u2") for v in rows.column("times").to_pylist()])
            order = np.argsort(every, kind="stable")
            every, times = every[order], times[order]
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            several = (np.diff(np.append(at, len(every))) > 1) | (np.maximum.reduceat(times, at) > 0x7FFF)
            total = np.add.reduceat((times & 0x7FFF).astype(np.int64), at)
            known, common = every[at][several], (total > COMMON)[several]
            if not len(known):
                continue
            found = []
            for c, v in zip(rows.column("chunk").to_pylist(), held, strict=True):
                at = np.minimum(np.searchsorted(known, v), len(known) - 1)
                on = known[at] == v
                if on.any():
                    found.append((c, v[on].tobytes(), np.packbits(common[at[on]]).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([int(part)] * len(found), pa.int64()), *(pa.array([f[j] for f in found], pa.binary()) for j in (1, 2))],
                names=["chunk", "part", "anchors", "common"],
            )

    dealt = chunks.select("chunk", "rows", "ids", "sizes", "text").mapInArrow(local, "part long, chunk long, anchors binary, times binary")
    return _by_parts(dealt, bits).mapInArrow(meet, "chunk long, part long, anchors binary, common binary")


def _by_parts(dealt: DataFrame, bits: int) -> DataFrame:
    """Parts met in tasks: a few parts a task, however many there are."""
    tasks = max(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 8)
    return dealt.repartition(tasks, "part").sortWithinPartitions("part")


def wanted_keys(parts: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted anchors, with the bits below those kept cut off, and which of them are very common."""
    keys, common = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for p in sorted(parts, key=lambda p: p["part"]):
        low = np.frombuffer(p["anchors"], "<u4").astype(np.uint64)
        keys.append((U64(p["part"]) << U64(32)) | low)
        common.append(np.unpackbits(np.frombuffer(p["common"], np.uint8), count=len(low)).astype(bool))
    return np.concatenate(keys), np.concatenate(common)


# ---- equal windows


def _numbered(*keys: np.ndarray) -> np.ndarray:
    """0, 1, ... for each run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def least_documents(first: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray, data: np.ndarray):
    """(string, windows, document) runs of the smallest document that has each window of each string."""
    windows = size - WINDOW + 1
    begin = np.concatenate([[0], np.cumsum(windows)])
    low = np.repeat(doc, windows)  # of every window, in order
    order = np.argsort(anchor, kind="stable")
    _settle(first[order], size[order], begin[order], _numbered(anchor[order]), doc[order], data, low, 0)
    run = np.ones(len(low), bool)
    run[1:] = low[1:] != low[:-1]
    run[begin[:-1]] = True
    start = np.flatnonzero(run)
    length = np.diff(np.append(start, len(low)))
    return np.searchsorted(begin, start, side="right") - 1, length, low[start]


def _settle(first, size, place, lane, doc, data, low, level: int) -> None:
    """Lowers `low` at equal windows of one lane to the least document; place: where a string's windows begin in it.

    Strings come sorted by lane (0, 1, ...). Copies of a string are one, with the least of their documents. What
    differs in a lane has one suffix array; lanes of many strings are dealt to shorter ones by longer anchors first,
    as windows that are equal have these in common as well.
    """
    windows = size - WINDOW + 1
    one, which, least = merged(data, first, size, lane, doc)
    f, z, w = first[one], size[one], windows[one]
    own_low = np.repeat(least, w)
    begin = np.cumsum(w) - w
    own = _numbered(lane[one])
    per = np.bincount(own)[own]
    large = (per > LANE) & (level < len(FINER))
    short = (per > 1) & ~large
    _compare(f[short], z[short], begin[short], own[short], data, own_low)
    if large.any():
        f, z, at, own, least = (x[large] for x in (f, z, begin, own, least))
        offsets = np.concatenate([[0], np.cumsum(z)])
        parts = []
        for i, j in blocks(offsets, 1 << 20):
            inner, n, key, of = anchors(gather(data, f[i:j], z[i:j]), offsets[i : j + 1] - offsets[i], FINER[level])
            parts.append((inner + offsets[i], n, key, of + i))
        inner, n, key, of = (np.concatenate(x) for x in zip(*parts, strict=True))
        inner = inner - offsets[of]
        key = mix(key + own[of].astype(np.uint64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        inner, n, of = inner[order], n[order], of[order]
        _settle(f[of] + inner, n + WINDOW - 1, at[of] + inner, _numbered(key[order]), least[of], data, own_low, level + 1)
    low[_runs(place, windows)] = own_low[_runs(begin[which], windows)]


def merged(data: np.ndarray, first: np.ndarray, size: np.ndarray, key: np.ndarray, doc: np.ndarray):
    """Byte-equal strings of one key as one: (one of each, sorted by key; which of them each string is; least document).

    Hashes bring strings together and their bytes are compared.
    """
    content = content_hashes(data, first, size)
    while True:
        order = np.lexsort((content, key))
        k, c = key[order], content[order]
        new = np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
        at = np.flatnonzero(new)
        head = np.repeat(at, np.diff(np.append(at, len(k))))
        other = _unequal(data, first, size, order[~new], order[head[~new]])
        if not len(other):
            break
        content[other] = mix(content[other] + U64(1))  # one hash for different bytes: tell them apart
    which = np.empty(len(key), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[at], which, np.minimum.reduceat(doc[order], at) if len(at) else np.zeros(0, np.int64)


def _batches(size: np.ndarray, lane: np.ndarray):
    """(strings, strings of each lane, symbols of each lane) of batches of whole lanes, those of like lengths together."""
    if not len(size):
        return
    at = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    per = np.diff(np.append(at, len(lane)))
    symbols = np.add.reduceat(size + 1, at) + 1
    by = np.argsort(symbols, kind="stable")[::-1]
    at, per, symbols = at[by], per[by], symbols[by]
    total = np.cumsum(symbols)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + BATCH, side="right")))
        yield _runs(at[i:j], per[i:j]), per[i:j], symbols[i:j]
        i = j


def _ordered(first, size, per, lane_size, data):
    """A batch's strings end to end, per[k] of them in lane k: where each begins, the suffix arrays, and from each place four symbols as one."""
    lane_begin = np.concatenate([[0], np.cumsum(lane_size)])
    lane = np.repeat(np.arange(len(per)), per)
    start = np.cumsum(size + 1) - (size + 1) + lane  # each earlier lane has one symbol more: its end
    symbols = np.ones(int(lane_begin[-1]), np.int32)
    symbols[lane_begin[1:] - 1] = 0
    symbols[_runs(start, size)] = gather(data, first, size).astype(np.int32) + 2
    padded = np.concatenate([symbols.astype(np.uint16), np.zeros(LONGEST + WINDOW + 4, np.uint16)])
    words = sum(padded[k : len(padded) - 3 + k].astype(np.uint64) << U64(16 * k) for k in range(4))
    return start, suffix_arrays(symbols, lane_begin), words


def _agree(order: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Places of the order that share at least `size` symbols with the one before: four at a time, dropping what differs."""
    pair = np.arange(1, len(order))
    for k in [*range(0, size - 3, 4), size - 4]:
        pair = pair[words[order[pair] + k] == words[order[pair - 1] + k]]
    return pair


def _compare(first, size, place, lane, data, low) -> None:
    """Lowers `low` at equal windows of each lane's strings to the least document among them."""
    for own, per, lane_size in _batches(size, lane):
        start, order, words = _ordered(first[own], size[own], per, lane_size, data)
        count = size[own] - WINDOW + 1
        window = np.full(int(lane_size.sum()), -1, np.int64)  # its place in `low`
        window[_runs(start, count)] = _runs(place[own], count)
        order = order[window[order] >= 0]
        same = np.zeros(len(order), bool)
        same[_agree(order, words, WINDOW)] = True
        head = np.flatnonzero(~same)
        where = window[order]
        low[where] = np.repeat(np.minimum.reduceat(low[where], head), np.diff(np.append(head, len(order))))


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - end + size, size)


def earliest(stretches: DataFrame, bits: int) -> DataFrame:
    """chunk, part, runs, lengths, documents: for every chunk's stretches the smallest document of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), table in groups_of(batches, "part"):
            column = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]  # noqa: E731,B023
            anchor, sizes, docs, texts = column("anchor", "<u4"), column("sizes", "<u1"), column("documents", "<i8"), column("bytes", "<u1")
            n = np.array([len(a) for a in anchor])
            size = np.concatenate(sizes).astype(np.int64)
            of, length, doc = least_documents(np.cumsum(size) - size, size, np.concatenate(anchor), np.concatenate(docs), np.concatenate(texts))
            runs = np.bincount(of, minlength=len(size))
            string, run_at = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(runs)])
            out = []
            for s, e in zip(string[:-1].tolist(), string[1:].tolist(), strict=True):
                a, b = run_at[s], run_at[e]
                out.append((runs[s:e].astype("<u1").tobytes(), length[a:b].astype("<u1").tobytes(), doc[a:b].astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [table.column("chunk").combine_chunks(), pa.array([int(part)] * len(n), pa.int64()), *(pa.array([o[k] for o in out], pa.binary()) for k in range(3))],
                names=["chunk", "part", "runs", "lengths", "documents"],
            )

    return _by_parts(stretches, bits).mapInArrow(run, "chunk long, part long, runs binary, lengths binary, documents binary")


# ---- the operator


def _with_parts(chunks: DataFrame, parts: DataFrame, *columns: str) -> DataFrame:
    """Chunks stay where their buckets are; what came back for them is gathered per chunk and joined."""
    gathered = parts.groupBy("chunk").agg(F.collect_list(F.struct("part", *columns)).alias("parts"))
    return chunks.join(gathered.hint("shuffle_hash"), "chunk", "left")


def removals(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), clean: str | None = None) -> DataFrame:
    """The `keep` columns of every row, n_bytes, n_removed, n_spans and kept_sha256; `clean` names a text column.

    A null text is an empty one; texts under 50 bytes lose nothing. Documents are told apart by doc_id: rows with
    one id never repeat each other, and a null id counts as the largest. In the `clean` text only whole characters
    are removed. Repeated rows are returned each; an empty table gives no rows; other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = chunks_of(docs, keep, size)
    bits = part_bits(size)
    several = written(shared_anchors(chunks, bits), "anchors")

    def cut(key: np.ndarray) -> np.ndarray:
        return key >> U64(32 - bits)

    def open_(batch: pa.RecordBatch, k: int):
        chunk = Chunk(batch, k)
        return chunk, wanted_keys(batch.column("parts")[k].as_py() or [], bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, wanted = open_(batch, k)
                if not len(wanted[0]):
                    continue
                (first, windows, _, _), (key, one, least) = _distinct(chunk, wanted, cut)
                size = windows[one] + WINDOW - 1
                at = np.concatenate([[0], np.cumsum(size)])
                data = gather(chunk.data, first[one], size)
                out = []
                for p, s, e in _by_part(key << U64(32 - bits), bits):
                    out.append((p, key[s:e].astype("<u4").tobytes(), size[s:e].astype("<u1").tobytes(), least[s:e].astype("<i8").tobytes(), data[at[s] : at[e]].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int64()), pa.array([chunk.id] * len(out), pa.int64()), *(pa.array([o[j] for o in out], pa.binary()) for j in range(1, 5))],
                    names=["part", "chunk", "anchor", "sizes", "documents", "bytes"],
                )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, wanted = open_(batch, k)
                gone = np.zeros(len(chunk.data), bool)
                answers = sorted(batch.column("answers")[k].as_py() or [], key=lambda p: p["part"])
                if answers and len(wanted[0]):
                    (first, windows, text, which), _ = _distinct(chunk, wanted, cut)
                    runs = np.concatenate([np.frombuffer(p["runs"], "<u1") for p in answers]).astype(np.int64)
                    length = np.concatenate([np.frombuffer(p["lengths"], "<u1") for p in answers]).astype(np.int64)
                    doc = np.concatenate([np.frombuffer(p["documents"], "<i8") for p in answers])
                    run_at = np.cumsum(runs) - runs
                    n = runs[which]
                    take = np.arange(int(n.sum())) + np.repeat(run_at[which] - np.cumsum(n) + n, n)
                    size = length[take]
                    into = np.cumsum(size) - size  # windows before each run, less those of earlier stretches
                    into -= np.repeat(np.cumsum(windows) - windows, n)
                    begin = np.repeat(first, n) + into
                    hit = doc[take] < np.repeat(chunk.ids[text], n)
                    edge = np.zeros(len(gone) + 1, np.int32)
                    np.add.at(edge, begin[hit], 1)
                    np.add.at(edge, begin[hit] + size[hit] + WINDOW - 1, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                yield _result(chunk, gone, clean)

    joined = _with_parts(chunks, several, "anchors", "common")
    answers = written(earliest(joined.mapInArrow(send, "part long, chunk long, anchor binary, sizes binary, documents binary, bytes binary"), bits), "answers")
    back = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "runs", "lengths", "documents")).alias("answers"))
    schema = docs.select(*keep).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if clean:
        schema = schema.add(clean, "string")
    return joined.join(back.hint("shuffle_hash"), "chunk", "left").mapInArrow(apply, schema)


def _distinct(chunk: Chunk, wanted: tuple[np.ndarray, np.ndarray], cut):
    """Stretches of wanted anchors, and the distinct ones among them in order of anchor.

    Returns (first, windows, text, which) of all and (anchor, one of all, smallest document) of the distinct: `which`
    numbers the latter. Anchors are compared without their lowest bits; stretches of very common ones are cut.
    """
    wanted, common = wanted
    first, windows, key, text = chunk.stretches()
    key = cut(key)
    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
    on = wanted[at] == key
    first, windows, key, text, often = first[on], windows[on], key[on], text[on], common[at[on]]
    if often.any():
        f, size = first[often], windows[often] + WINDOW - 1
        offsets = np.concatenate([[0], np.cumsum(size)])
        parts = [(first[~often], windows[~often], key[~often], text[~often])]
        for i, j in blocks(offsets, 1 << 20):
            inner, n, longer, of = anchors(gather(chunk.data, f[i:j], size[i:j]), offsets[i : j + 1] - offsets[i], COMMON_SEED)
            parts.append((f[of + i] + inner + offsets[i] - offsets[of + i], n, cut(longer), text[often][of + i]))
        first, windows, key, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    one, which, least = merged(chunk.data, first, windows + WINDOW - 1, key, chunk.ids[text])
    return (first, windows, text, which), (key[one], one, least)


def _unequal(data: np.ndarray, first: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Those of the strings a whose bytes are not those of the strings b."""
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,)) if len(data) > 7 else np.zeros(0, np.uint64)
    bad = size[a] != size[b]
    for k in range(0, int(size[a].max(initial=0)), 8):
        end = np.minimum(k, np.minimum(size[a], size[b]) - 8)  # no string is shorter than a window
        bad |= words[first[a] + end] != words[first[b] + end]
    return a[bad]


def _result(chunk: Chunk, gone: np.ndarray, clean: str | None) -> pa.RecordBatch:
    rows = pa.ipc.open_stream(chunk.rows.as_buffer()).read_all().combine_chunks()
    o = chunk.offsets
    removed = np.concatenate([[0], np.cumsum(gone)])
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    begin[o[:-1][o[:-1] < len(gone)]] |= gone[o[:-1][o[:-1] < len(gone)]]
    spans = np.concatenate([[0], np.cumsum(begin)])
    left = chunk.data[~gone].tobytes()
    at = (o - removed[o]).tolist()
    columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
    names = list(rows.schema.names)
    hashes = [hashlib.sha256(left[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    columns += [pa.array(np.diff(o)), pa.array(np.diff(removed[o])), pa.array(np.diff(spans[o])), pa.array(hashes, pa.string())]
    names += ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if clean:
        lead = np.flatnonzero((chunk.data & 0xC0) != 0x80)
        whole = np.logical_and.reduceat(gone, lead) if len(lead) else np.zeros(0, bool)
        gone = np.repeat(whole, np.diff(np.append(lead, len(gone))))
        removed = np.concatenate([[0], np.cumsum(gone)])
        left = chunk.data[~gone].tobytes()
        at = (o - removed[o]).tolist()
        columns.append(pa.array([left[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()))
        names.append(clean)
    return pa.RecordBatch.from_arrays(columns, names=names)
