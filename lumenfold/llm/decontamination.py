"""Benchmark decontamination with an FM-index per shard of training text.

Test phrases are windows of `window` words of each benchmark item (an item of fewer words is one window). A
shard is some MB of documents inside a task. Words that no phrase contains cannot be part of an occurrence, so
they end a run; runs of at least the shortest phrase's words form the shard's text. Its suffix array gives the
Burrows-Wheeler transform, kept as a wavelet matrix. All phrases are searched backwards together: each step
narrows every phrase's interval of suffixes by two wavelet ranks. Occurrences are located by walking back to a
sampled suffix position (every 16th and every run's first), and their spans are merged.

Words are told apart by their bytes, never by a hash: a pass's vocabulary holds them, and Arrow looks texts' words up.

Scale: map-only over documents. The benchmark is dealt out by its bytes, however many files it has; phrases are made in
tasks and written in blocks with their size. Blocks of GROUP_BYTES are broadcast for one pass over the texts, in which a
shard is indexed once. A larger benchmark takes more passes, each written to the shared folder, so neither the driver nor
a broadcast ever holds more than one group.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binaries, equal_bytes, forget, text_blocks, word_bytes, written

#: Bytes of text per shard, and of benchmark text whose windows are made at once.
SHARD_BYTES, PHRASE_BYTES = 8 << 20, 4 << 20
#: Windows in a block (some 7 MB), and bytes of the blocks that one pass over the documents searches for.
BLOCK_PHRASES, GROUP_BYTES = 1 << 17, 64 << 20
SAMPLE = 16
#: Columns of the rows between two passes.
WORDS, HITS, ITEMS, SPANS = "_n_words", "_n_hit", "_items_so_far", "_spans_so_far"


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of runs of symbols over 0, each ended by a 0; the zeros rank by position, below all symbols.

    Prefix doubling that sorts only suffixes not yet told apart: log2 of the longest run's length rounds.
    """
    n = len(text)
    zero = text == 0
    rank = text.astype(np.int64) + n
    rank[zero] = np.arange(int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    sorted_rank = rank[order]
    first = np.concatenate([np.ones(min(1, n), bool), sorted_rank[1:] != sorted_rank[:-1]])
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = head
    tied = np.flatnonzero(~(first & np.append(first[1:], True)))
    while len(tied):
        at = order[tied]
        key = rank[np.minimum(at + step, n - 1)]
        by = np.lexsort((key, head[tied]))
        at, key, group = at[by], key[by], head[tied][by]
        order[tied] = at
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
        head[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = head[tied]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        step *= 2
    return order


class WaveletMatrix:
    """rank(c, i): how often symbol c is among the first i symbols, for arrays of c and i."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits = bits
        self.zeros, self.ones = [], []
        s = symbols
        for k in range(bits - 1, -1, -1):
            bit = (s >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            ones, z = self.ones[level], self.zeros[level]
            bit = (c >> k) & 1 == 1
            a, b = ones[low], ones[high]
            low, high = np.where(bit, z + a, low - a), np.where(bit, z + b, high - b)
        return (high - low).astype(np.int64)


class FMIndex:
    def __init__(self, text: np.ndarray, alphabet: int):
        """text: runs of symbols 1 to alphabet - 1, each ended by a 0."""
        order = suffix_order(text)
        self.n = len(text)
        self.bwt = text[order - 1].astype(np.int64)  # the suffix at 0 follows the last 0
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))]).astype(np.int64)
        self.tree = WaveletMatrix(self.bwt, max(1, int(alphabet - 1).bit_length()))
        sampled = (order % SAMPLE == 0) | (self.bwt == 0)
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)])
        self.sampled = sampled
        self.position = order[sampled]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of suffixes that begin with each phrase; phrases are left-aligned rows padded with 0."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            on = np.flatnonzero((length > k) & (low < high))
            c = phrases[on, k].astype(np.int64)
            low[on] = self.before[c] + self.tree.rank(c, low[on])
            high[on] = self.before[c] + self.tree.rank(c, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            r = rows[left]
            done = self.sampled[r]
            out[left[done]] = self.position[self.sampled_before[r[done]]] + steps[left[done]]
            left, r = left[~done], r[~done]
            c = self.bwt[r]
            rows[left] = self.before[c] + self.tree.rank(c, r)
            steps[left] += 1
        return out


@dataclass
class Phrases:
    """A block of distinct phrases: symbols are places in `vocabulary` (distinct words' bytes) plus 1; owners lists each phrase's items."""

    vocabulary: pa.Array
    rows: np.ndarray
    length: np.ndarray
    owner_at: np.ndarray
    owners: np.ndarray
    items: list


def phrases_of(items: list, data: np.ndarray, offsets: np.ndarray, window: int, most: int) -> Iterator[Phrases]:
    """The windows of the items' texts, in blocks of at most `most` of them; a block's are distinct."""
    _, _, row, packed, at = word_bytes(data, offsets)
    n = np.bincount(row, minlength=len(items))
    count = np.where(n > 0, np.maximum(1, n - window + 1), 0)
    owner = np.repeat(np.arange(len(items)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.cumsum(n) - n, count)
    size = np.repeat(np.minimum(n, window), count)
    for lo in range(0, len(start), most):
        own, first, length = owner[lo : lo + most], start[lo : lo + most], size[lo : lo + most]
        begin, end = int(first[0]), int(first[-1] + length[-1])
        symbol, vocabulary = equal_bytes(packed, at[begin : end + 1])
        symbol = np.append(symbol + 1, np.zeros(window, np.int64)).astype(np.int32)
        rows = symbol[(first - begin)[:, None] + np.arange(window)]
        rows[np.arange(window) >= length[:, None]] = 0
        rows, which = np.unique(rows, axis=0, return_inverse=True)
        pair = np.unique(np.column_stack([which.ravel(), own]), axis=0)
        owners = np.unique(pair[:, 1])
        owner_at = np.searchsorted(pair[:, 0], np.arange(len(rows) + 1))
        yield Phrases(vocabulary, rows, np.count_nonzero(rows, axis=1), owner_at, np.searchsorted(owners, pair[:, 1]), [items[k] for k in owners.tolist()])


def phrase_table(benchmark: DataFrame, window: int) -> DataFrame:
    """The blocks of phrases (place, size in bytes, pickled block), made in tasks and written to the shared folder."""
    most, limit = BLOCK_PHRASES, PHRASE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for rows, data, offsets in text_blocks(batches, "text", limit):
            for block in phrases_of(rows.column("item_id").to_pylist(), data, offsets, window, most):
                yield pa.RecordBatch.from_arrays([pa.array([place]), pa.array([len(dumped := pickle.dumps(block))]), pa.array([dumped], pa.binary())], names=["place", "size", "block"])
                place += 1

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    items = items.repartition(-(-size // limit) or 1)  # many small files make no more blocks than one large one
    return written(items.mapInArrow(run, "place long, size long, block binary"), "phrases")


def groups_by_bytes(blocks: list[tuple[int, int]], limit: int) -> list[list[int]]:
    """Places of the blocks (place, bytes), in order, in groups of at most `limit` bytes each, or one larger block."""
    groups, used = [], limit + 1
    for place, size in sorted(blocks):
        if used + size > limit:
            groups.append([])
            used = 0
        groups[-1].append(place)
        used += size
    return groups


def _symbols(packed: np.ndarray, at: np.ndarray, vocabulary: pa.Array) -> np.ndarray:
    """Each word's place in the vocabulary plus 1; 0 for other words."""
    if not len(vocabulary):
        return np.zeros(len(at) - 1, np.int32)
    return pc.fill_null(pc.index_in(binaries(packed, at), vocabulary), -1).to_numpy() + np.int32(1)


def _occurrences(symbol: np.ndarray, row: np.ndarray, vocabulary: pa.Array, blocks: list[Phrases]):
    """Of each block with words in common: places of the shard's words that its phrases cover, and pairs (row, item's number)."""
    known = np.flatnonzero(symbol)
    if not len(known):
        return
    new_run = np.concatenate([[True], (np.diff(known) > 1) | (row[known[1:]] != row[known[:-1]])])
    first = np.flatnonzero(new_run)
    size = np.diff(np.append(first, len(known)))
    kept = np.repeat(size >= min(p.length.min() for p in blocks), size)
    known, new_run = known[kept], new_run[kept]
    if not len(known):
        return
    run = np.cumsum(new_run) - 1  # a 0 behind each run
    place = np.arange(len(known)) + run
    text = np.zeros(len(known) + run[-1] + 1, np.int64)
    text[place] = symbol[known]
    word = np.full(len(text), -1, np.int64)
    word[place] = known
    index = FMIndex(text, len(vocabulary) + 1)
    for p in blocks:
        symbols = np.append(0, pc.index_in(p.vocabulary, vocabulary).to_numpy() + 1)
        low, high = index.search(symbols[p.rows], p.length)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        n = (high - low)[found]
        which = np.repeat(found, n)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[found], n)
        where = index.locate(rows)
        cover = np.zeros(len(text) + 1, np.int64)
        np.add.at(cover, where, 1)
        np.add.at(cover, where + p.length[which], -1)
        hit = word[np.flatnonzero(np.cumsum(cover)[:-1] > 0)]
        # (row, phrase) pairs once, then each with the phrase's items
        pair = np.unique(np.column_stack([row[word[where]], which]), axis=0)
        n = np.diff(p.owner_at)[pair[:, 1]]
        owner = p.owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(p.owner_at[pair[:, 1]], n)]
        yield p, hit, np.unique(np.column_stack([np.repeat(pair[:, 0], n), owner]), axis=0)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: tuple[str, ...] = ("doc_id",), clean: str | None = None) -> DataFrame:
    """The `keep` columns of every row, n_words, n_hit, items (array<string>, sorted) and spans (begin, end byte).

    `clean` names a further column: the text without its spans. Null texts (of either table) have no words; a
    null item_id marks words but is in no list; repeated rows are scanned each; empty tables give no hits or no rows.
    Whole texts are scanned, however long: one that is longer than a shard is a shard of its own. Further columns of
    either table are left out unless `keep` names them. Spans reach from a merged run's first word to its last.
    """
    table = phrase_table(benchmark, window)
    groups = groups_by_bytes([(r.place, r.size) for r in table.select("place", "size").collect()], GROUP_BYTES) or [[]]
    docs, before = docs.select(*dict.fromkeys([*keep, "text"])), []
    for group in groups:
        found = table.where(F.col("place").between(group[0], group[-1])).collect() if group else []
        blocks = [pickle.loads(r.block) for r in found]
        last = group is groups[-1]
        docs = _pass(docs, blocks, keep, clean if last else None, bool(before), last)
        if not last:
            docs = written(docs, "decontaminated")
            forget(*before)
            before = [docs]
    forget(table)
    return docs


def _pass(docs: DataFrame, phrases: list[Phrases], keep: tuple[str, ...], clean: str | None, again: bool, last: bool) -> DataFrame:
    """One pass over the texts with a bounded group of blocks. Where it is not the first (`again`), the rows hold the
    spans and items that earlier ones found, in columns SPANS and ITEMS; where it is not the `last`, it returns such rows.
    """
    vocabulary = pc.unique(pa.chunked_array([p.vocabulary for p in phrases], pa.large_binary()))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, phrases))
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    carried = [*keep] if last else list(dict.fromkeys([*keep, "text"]))
    names = ("n_words", "n_hit", "items", "spans") if last else (WORDS, HITS, ITEMS, SPANS)
    schema = docs.select(*carried).schema.add(names[0], "long").add(names[1], "long").add(names[2], T.ArrayType(T.StringType()))
    schema = schema.add(names[3], T.ArrayType(T.StructType().add("begin", "integer").add("end", "integer")))
    if clean:
        schema = schema.add(clean, "string")

    def shard(held: list) -> Iterator[pa.RecordBatch]:
        symbol, row, start, end = (np.concatenate([h[k] for h in held]) for k in (2, 3, 0, 1))
        base = np.cumsum([0] + [h[4].num_rows for h in held])
        row = row + np.repeat(base[:-1], [len(h[0]) for h in held])
        rows = int(base[-1])
        hit = np.zeros(len(symbol), bool)
        items: list[set] = [set() for _ in range(rows)]
        if again:
            hit = _inside(start, row, held, base)
            items = [set(own) for h in held for own in h[4].column(ITEMS).to_pylist()]
        vocabulary, blocks = shared.value
        for p, at, pairs in _occurrences(symbol, row, vocabulary, blocks):
            hit[at] = True
            for r, k in pairs.tolist():
                if p.items[k] is not None:
                    items[r].add(p.items[k])
        hits = np.flatnonzero(hit)
        new = np.concatenate([np.ones(min(1, len(hits)), bool), (np.diff(hits) > 1) | (row[hits[1:]] != row[hits[:-1]])])
        at = np.flatnonzero(new)
        begin, stop, of = start[hits[at]], end[hits[np.append(at[1:], len(hits)) - 1]] if len(at) else np.zeros(0, np.int64), row[hits[at]]
        bounds = np.searchsorted(of, np.arange(rows + 1)).tolist()
        n_words, n_hit = np.bincount(row, minlength=rows), np.bincount(row[hits], minlength=rows)
        for g, h in enumerate(held):
            lo, hi = int(base[g]), int(base[g + 1])
            own = [list(zip(begin[bounds[r] : bounds[r + 1]].tolist(), stop[bounds[r] : bounds[r + 1]].tolist(), strict=True)) for r in range(lo, hi)]
            offsets, data = h[6], h[5]
            own = [[(a - o, b - o) for a, b in s] for s, o in zip(own, offsets[:-1].tolist(), strict=True)]
            columns = [
                *(h[4].column(c) for c in carried),
                pa.array(n_words[lo:hi].astype(np.int64)),
                pa.array(n_hit[lo:hi].astype(np.int64)),
                pa.array([sorted(s) for s in items[lo:hi]], pa.list_(pa.string())),
                pa.array([[{"begin": a, "end": b} for a, b in s] for s in own], span),
            ]
            if clean:
                columns.append(pa.array([_without(data[a:b].tobytes(), s) for a, b, s in zip(offsets[:-1].tolist(), offsets[1:].tolist(), own, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows, data, offsets in text_blocks(batches, "text"):
            start, end, row, packed, at = word_bytes(data, offsets)
            held.append((start.astype(np.int32), end.astype(np.int32), _symbols(packed, at, shared.value[0]), row, rows, data if clean else None, offsets))
            size += len(data)
            if size >= SHARD_BYTES:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    return docs.mapInArrow(run, schema)


def _inside(start: np.ndarray, row: np.ndarray, held: list, base: np.ndarray) -> np.ndarray:
    """Whether words of the shard begin inside spans that an earlier pass found."""
    hit = np.zeros(len(start), bool)
    for h, first in zip(held, base.tolist(), strict=False):
        for r, (spans, o) in enumerate(zip(h[4].column(SPANS).to_pylist(), h[6][:-1].tolist(), strict=True)):
            lo, hi = np.searchsorted(row, [first + r, first + r + 1])
            for s in spans:
                a, b = np.searchsorted(start[lo:hi], [s["begin"] + o, s["end"] + o])
                hit[lo + a : lo + b] = True
    return hit


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return b"".join([*parts, text[at:]]).decode()


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the ids joined by commas), contaminated."""
    return scan(docs, benchmark, window).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
