"""Embedding near-duplicates by lattice hashing.

In each of several tables a vector's direction is projected at random to 8 dimensions and decoded to the nearest
point of the E8 lattice: its cell. A vector is filed under its own cell and looks also into the neighbouring
cells nearest to it (lattice point plus one of the 240 shortest lattice vectors). Vectors that meet are compared
by cosine in double precision, block against block.

Scale: vectors with equal components are one. Cells are counted first (20-byte rows); only cells in which vectors
can meet are given the vectors. A cell of more than `BLOCK` entries is dealt out in pairs of blocks, so no task
holds more than two blocks. A task gives the number of links of each of its vectors, counting a pair only in the
first cell that both have, and for the components only links that join what it has not joined yet: rows grow with the
vectors, not with the pairs of a dense cluster. Recall on links is measured against brute force in the tests.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, forget, groups_of, mix, with_key, written
from .components import components

#: Tables, neighbouring cells probed, cell size (of the projection, scaled to keep lengths), entries in a block.
TABLES, PROBES, CELL, BLOCK = 8, 3, 0.55, 2048


def shortest_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: +-1 in two places, and +-1/2 everywhere with an even number of minus signs."""
    pairs = [(i, j, a, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(pairs), 8))
    for k, (i, j, a, b) in enumerate(pairs):
        whole[k, i], whole[k, j] = a, b
    half = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate([whole, half])


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with even sums."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    gap = (x - r)[odd]
    worst = np.abs(gap).argmax(1)
    r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8: of the even-sum integer points and those shifted by one half, the nearer."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _keys(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(points.shape[:-1], table + 1, np.uint64)
    for k in range(8):
        h = mix(h * U64(0x9E3779B97F4A7C15) + (2 * points[..., k]).astype(np.int64).view(np.uint64))
    return h


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, cell: float = CELL, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Own cell (n, tables) and probed cells (n, tables, probes) of unit vectors, as 64-bit keys."""
    n, d = unit.shape
    near = shortest_vectors()
    own, others = np.zeros((n, tables), np.uint64), np.zeros((n, tables, probes), np.uint64)
    for t in range(tables):
        rng = np.random.default_rng((seed, t, d))
        project = np.linalg.qr(rng.standard_normal((d, 8)))[0] if d >= 8 else rng.standard_normal((d, 8)) / np.sqrt(8)
        x = unit @ project * (np.sqrt(max(d, 8) / 8) / cell) + rng.uniform(0, 1, 8)
        point = decode(x)
        best = np.argsort(-((x - point) @ near.T), axis=1)[:, :probes]
        own[:, t] = _keys(point, t)
        others[:, t] = _keys(point[:, None, :] + near[best], t)
    return mix(own + U64(d)), mix(others + U64(d))  # vectors of different lengths share no cell


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: unit vectors in double precision, and the rows' places. All are finite and not zero (`_valid`)."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    length = np.diff(offsets)
    for d in np.unique(length):
        at = np.flatnonzero(length == d)
        x = values[offsets[at][:, None] + np.arange(d)].astype(np.float64)
        x = x / np.abs(x).max(1, keepdims=True)
        yield x / np.linalg.norm(x, axis=1, keepdims=True), at


def _valid():
    """Not null, with finite components and one that is not zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)


def _first_cell(own_a, others_a, own_b, others_b) -> np.ndarray:
    """The first cell in which the vectors of each pair meet: of the first such table, the one with the smallest key."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(own_a), none)
    for t in range(own_a.shape[1]):
        todo = np.flatnonzero(out == none)
        if not len(todo):
            break
        a, b = own_a[todo, t], own_b[todo, t]
        found = np.where(a == b, a, none)
        found = np.minimum(found, np.where((others_b[todo, t] == a[:, None]).any(1), a, none))
        out[todo] = np.minimum(found, np.where((others_a[todo, t] == b[:, None]).any(1), b, none))
    return out


class Forest:
    """Tells which pairs of numbers join what was not joined before."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of those pairs. Pairs within one tree are dropped all at once, so a dense cluster costs little."""
        new = []
        todo = np.arange(len(a))
        while len(todo := todo[self.label[a[todo]] != self.label[b[todo]]]):
            some, name = todo[:4096], {}

            def root(x: int, name=name) -> int:
                while (up := name.get(x, x)) != x:
                    name[x] = name.get(up, up)
                    x = up
                return x

            for k, x, y in zip(some.tolist(), self.label[a[some]].tolist(), self.label[b[some]].tolist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    name[max(x, y)] = min(x, y)
                    new.append(k)
            to = np.arange(len(self.label))
            for x in list(name):
                to[x] = root(x)
            self.label = to[self.label]
            todo = todo[4096:]
        return np.array(new, np.int64)


def links(vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, probes: int = PROBES, cell: float = CELL) -> DataFrame:
    """a, b, n of (vec_id, copies, embedding), distinct vectors: per task either a vector's linked copies (b is null,
    n counts them) or a link (n is null). The counts of all tasks add up; the links join what all links join."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, at in _vectors(batch.column("embedding")):
                own, others = cells(unit, tables, probes, cell)
                key = np.concatenate([own.ravel(), others.ravel()])
                ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[at]
                who = np.concatenate([np.repeat(ids, tables), np.repeat(ids, tables * probes)])
                is_own = np.arange(len(key)) < own.size
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(who), pa.array(is_own)], names=["cell", "vec_id", "own"])

    filed = written(vectors.select("vec_id", "embedding").mapInArrow(file, "cell long, vec_id long, own boolean"), "cells")
    met = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("n_own")).where("n > 1 and n_own > 0")
    parts = F.ceil(F.col("n") / BLOCK)
    entries = filed.join(met, "cell").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
    # entries of part i are in the pairs of parts (i, j) for all j: a pair has two parts at most
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    dealt = entries.select("cell", "vec_id", "own", "part", other.alias("j")).select(
        "cell", "vec_id", "own", F.col("part").alias("side"), F.least("part", "j").alias("lo"), F.greatest("part", "j").alias("hi")
    )
    full = dealt.join(vectors, "vec_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group of a few rows is the rule, so groups are compared as they end."""
        out: list[tuple] = []
        size = 0
        for (key, lo, hi), table in groups_of(batches, "cell", "lo", "hi"):
            found = _block(table, lo != hi, np.int64(key).view(np.uint64))
            size += len(found[0])
            out.append(found)
            if size > 10_000:
                yield _rows(out)
                out, size = [], 0
        if out:
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        a, b, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b < 0), pa.array(n, mask=n < 0)], names=["a", "b", "n"])

    def _block(table: pa.Table, split: bool, key: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = table.column("embedding").combine_chunks()
        a, b, n = [], [], []
        for unit, at in _vectors(column):  # several lengths only where hashes collide
            ids, copies = table.column("vec_id").to_numpy()[at], table.column("copies").to_numpy()[at]
            own, side = table.column("own").to_numpy()[at], table.column("side").to_numpy()[at]
            total, forest, place = np.zeros(len(at), np.int64), Forest(len(at)), None
            for i in range(0, len(ids), 512):
                ok = (unit[i : i + 512] @ unit.T >= threshold) & (ids[i : i + 512, None] < ids) & (own[i : i + 512, None] | own)
                if split:
                    ok &= side[i : i + 512, None] != side
                x, y = np.nonzero(ok)
                if not len(x):
                    continue
                x += i
                if place is None:
                    place = cells(unit, tables, probes, cell)
                for s in range(0, len(x), 1 << 16):
                    p, q = x[s : s + (1 << 16)], y[s : s + (1 << 16)]
                    first = _first_cell(place[0][p], place[1][p], place[0][q], place[1][q]) == key
                    p, q = p[first], q[first]
                    total += np.bincount(p, copies[q], minlength=len(at)).astype(np.int64) + np.bincount(q, copies[p], minlength=len(at)).astype(np.int64)
                    new = forest.joins(p, q)
                    a.append(ids[p[new]])
                    b.append(ids[q[new]])
                    n.append(np.full(len(new), -1, np.int64))
            has = np.flatnonzero(total)
            a.append(ids[has])
            b.append(np.full(len(has), -1, np.int64))
            n.append(total[has])
        return np.concatenate(a), np.concatenate(b), np.concatenate(n)

    grouped = full.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
    return grouped.mapInArrow(compare, "a long, b long, n long")


def near_duplicates(table: DataFrame, threshold: float = 0.9, **how) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, zero or have null or non-finite components, and null ids, link with nothing. Equal
    vectors link with each other without being compared. Repeated rows count as one vector and are returned each; rows
    of one vec_id with several vectors are vectors of their own of that name, each with its own n_links, in one
    component. Vectors of different lengths are never compared, those of one length as if they were alone. An empty
    table gives no rows; other columns are ignored.
    """
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    named = rows.withColumn("_valid", F.coalesce(_valid(), F.lit(False)))
    # 128 bits stand for the components
    key = F.concat(F.hex(F.xxhash64("embedding")), F.hex(F.xxhash64(F.lit(1), "embedding"))).alias("key")
    valid = named.where("_valid").select("vec_id", "embedding", key)
    groups = valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.count(F.lit(1)).alias("rows"), F.first("embedding").alias("embedding"))
    reps = written(groups.withColumn("number", F.monotonically_increasing_id()), "vectors")
    found = written(links(reps.select(F.col("number").alias("vec_id"), "copies", "embedding"), threshold, **how), "vector-links")
    more = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("more"))
    # components of vectors; several vectors of one vec_id are one
    names = reps.select("number", "rep")
    same = names.groupBy("rep").agg(F.min("number").alias("b")).join(names, "rep").select(F.col("number").alias("a"), "b").where("a <> b")
    joined = components(found.where("n is null").select("a", "b").union(same))
    labelled = names.join(joined, names.number == joined.node, "left").select("number", "rep", F.coalesce("component", "number").alias("c"))
    smallest = labelled.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_rep = (
        reps.select("key", "rows", "copies", "number")
        .join(labelled.select("number", "c"), "number")
        .join(smallest, "c")
        .join(more, F.col("number") == more.a, "left")
        .select("key", "rows", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    )
    of_rep = written(of_rep, "vector-classes")
    linked = with_key(valid.select("vec_id", key), of_rep, "key", "rows").select("vec_id", "n_links", "component_id")
    alone = named.where("not _valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    forget(reps, found)
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
