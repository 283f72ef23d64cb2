"""Runs of periodically repeated words, by Baier grouping.

A run is a stretch of words with smallest period q, at least `repeats` periods long, that neither neighbour extends.
Every run has a Lyndon root: under the order of words or under its inverse, the longest Lyndon word at the root's
places is the root itself. Phase one of the grouping suffix sorter (`grouping.lyndon_arrays`) gives those words'
lengths, for both orders side by side, without ever sorting suffixes; its groups say which are equal. A root that
follows itself is a candidate; how far its period reaches to both sides is the longest common extension of
two places one period apart, compared word by word, so no hash is trusted.

A run of at least r periods holds each of its words r times. So a word that a text has fewer times is in none, and
cuts the text; what lies between is cut again by its own counts. This is exact and leaves little of plain prose.

Scale: map-only; a task works on blocks of whole texts of bounded size, or on one longer text, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blank_words, equal_bytes, ragged, text_blocks
from .grouping import lyndon_arrays

#: Bytes of text worked on at once, and rounds of cutting (more would cut no run either, so this bounds time alone).
BLOCK, ROUNDS = 2 << 20, 8
#: What separates words.
BLANKS = r"[\x20\x09-\x0D]+"

def stretches(symbol: np.ndarray, row: np.ndarray, least: int, repeats: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of the stretches of words that can hold a run: see the cutting above."""
    place, own = np.arange(len(symbol)), row.astype(np.int64)
    for _ in range(ROUNDS):
        if not len(place):
            break
        key = own * (int(symbol.max()) + 1) + symbol[place]
        _, which, n = np.unique(key, return_inverse=True, return_counts=True)
        keep = n[which] >= repeats
        done = keep.all()
        place, own = place[keep], own[keep]
        new = np.concatenate([np.ones(min(1, len(place)), bool), (np.diff(place) != 1) | (np.diff(own) != 0)])
        own = np.cumsum(new) - 1
        size = np.bincount(own, minlength=1)
        long = size[own] >= least if len(own) else np.zeros(0, bool)
        if done and long.all():
            break
        place, own = place[long], own[long]
    first = np.concatenate([np.ones(min(1, len(own)), bool), np.diff(own) != 0])
    at = np.flatnonzero(first)
    return place[at], np.diff(np.append(at, len(place)))


def common_extension(symbols: np.ndarray, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
    """How many symbols agree from a and b on (way 1) or before them (way -1); a < b, and a lane's ends stop it."""
    out, live, step = np.zeros(len(a), np.int64), np.arange(len(a)), 8
    while len(live):
        span = np.arange(step) if way > 0 else np.arange(-1, -step - 1, -1)
        at = way * out[live]
        x = symbols[np.clip((a[live] + at)[:, None] + span, 0, len(symbols) - 1)]
        y = symbols[np.clip((b[live] + at)[:, None] + span, 0, len(symbols) - 1)]
        differ = (x != y) | (x == 0) | (y == 0)
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), step)
        out[live] += n
        live = live[n == step]
        step = min(step * 2, max(8, (1 << 20) // max(1, len(live))))
    return out


def runs(symbol: np.ndarray, row: np.ndarray, least: int = 6, repeats: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, length and smallest period of every run of at least `least` symbols and `repeats` periods inside a row,
    by place, then period. symbol: numbers from 0; row: the row of each, ascending. `repeats` is 3 at least.
    """
    first, size = stretches(symbol, row, least, repeats)
    if not len(first):
        z = np.zeros(0, np.int64)
        return z, z, z
    lanes = len(first)
    begin = np.concatenate([[0], np.cumsum(size + 1)]) + 1  # a 0 before all lanes and behind each
    inside = np.delete(np.arange(1, begin[-1]), begin[1:] - 2)
    _, plain = np.unique(symbol[ragged(first, size)], return_inverse=True)
    top = int(plain.max()) + 1
    text = np.zeros((2, begin[-1]), np.int64)
    text[0, inside], text[1, inside] = plain + 1, top - plain  # both orders
    n = begin[-1] - 1
    both = np.concatenate([text[0, 1:], text[1, 1:]])
    length, word = lyndon_arrays(both, np.concatenate([begin - 1, begin[1:] - 1 + n]))
    at = np.flatnonzero(both)
    on = np.zeros(len(both) + 1, bool)  # the same Lyndon word follows at once
    on[at] = word[at] == word[np.minimum(at + length[at], len(both) - 1)]
    led = np.zeros(len(both) + 1, bool)
    led[at[on[at]] + length[at[on[at]]]] = True
    head = at[on[at] & ~led[at]]
    if repeats > 3:  # a run of r periods holds r - 1 whole roots
        head = head[on[head + length[head]]]
    place, period = head % n + 1, length[head].astype(np.int64)
    ahead = common_extension(text[0], place, place + period, 1)
    behind = common_extension(text[0], place, place + period, -1)
    start, total = place - behind, ahead + behind + period
    good = total >= np.maximum(least, repeats * period)
    start, total, period = start[good], total[good], period[good]
    found = np.unique(np.column_stack([start, period, total]), axis=0)  # both orders may give one
    lane = np.searchsorted(begin, found[:, 0], side="right") - 1
    return first[lane] + found[:, 0] - begin[lane], found[:, 2], found[:, 1]


def _collapsed(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The given words of each row joined by one blank: bytes and offsets."""
    size = end - start
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    step = size + ~last
    at = np.cumsum(step) - step
    out = np.full(int(step.sum()), 32, np.uint8)
    out[ragged(at, size)] = data[ragged(start, size)]
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, step, minlength=rows).astype(np.int64))])


def find_runs(docs: DataFrame, least: int = 6, repeats: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, runs (array of start, length, period in words, by start, then period), collapsed: a row for every row.

    `collapsed` is the text's words without those that a run contains after its first period, joined by one blank.
    A null text is an empty one and has no words; texts are taken whole, however long; ids may be null or repeat;
    runs that touch or overlap are all given. Other columns are ignored; an empty table gives no rows.
    """
    run_type = T.StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = docs.select(F.col(id_column)).schema.add("n_words", "long").add("runs", T.ArrayType(run_type)).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, text_column, BLOCK):
            start, end, row = blank_words(data, offsets)
            ends = np.zeros(len(start) + 1, np.int64)
            np.cumsum(end - start, out=ends[1:])
            symbol, _ = equal_bytes(data[ragged(start, end - start)], ends)
            place, total, period = runs(symbol, row, least, repeats)
            change = np.zeros(len(row) + 1, np.int64)
            np.add.at(change, place + period, 1)
            np.add.at(change, place + total, -1)
            keep = np.cumsum(change)[:-1] == 0
            text, text_at = _collapsed(data, start[keep], end[keep], row[keep], rows.num_rows)
            first = np.searchsorted(row, np.arange(rows.num_rows + 1))
            of = row[place] if len(place) else np.zeros(0, np.int64)
            found = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (place - first[of], total, period)], names=["start", "length", "period"])
            bounds = np.searchsorted(of, np.arange(rows.num_rows + 1)).astype(np.int32)
            buffers = [None, pa.py_buffer(text_at.astype(np.int64)), pa.py_buffer(text)]
            columns = [rows.column(id_column), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(bounds), found)]
            columns.append(pa.Array.from_buffers(pa.large_string(), rows.num_rows, buffers).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text of all rows; of every tenth document, by a hash of its id, the text repeats a period from some word on.

    h = crc32 of the decimal id, g = floor(h / 10). Where h % 10 = 0 and the text has n > 0 words, each word i >= a
    becomes word a + (i - a) % p, with a = g % n and p = 1 + floor((n - a) / (3 + g % 8)), and blanks between words
    become one. A null id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", BLANKS), lambda w: w != "")

    def repeated(ws: Column) -> Column:
        n = F.size(ws)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(F.get(ws, a + (i - a) % p))), " ")

    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"))
    return rows.select("doc_id", F.when(F.size("_words") > 0, repeated(F.col("_words"))).otherwise(F.col("text")).alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest length / period (start, length, period, exponent_milli), runs_sha256, collapsed_sha256.

    Of equal exponents the first, then the shortest period; texts without runs have nulls. Digests are never null.
    """
    best = "aggregate(slice(runs, 2, size(runs)), get(runs, 0), (b, r) -> IF(r.length * b.period > b.length * r.period, r, b))"
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (
        find_runs(docs)
        .withColumn("best", F.expr(best))
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
            F.expr("1000 * best.length div best.period").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )
