"""A prefix trie of conversations: a node for every distinct sequence of first turns, from adaptive radix trees.

A turn's id is 16 bytes of SHA-256 over its role and text, so a conversation is one key of fixed-width, big-endian
units and nothing else of its text moves. Equal conversations are one key with a count. The distinct keys are sorted
into ranges of bounded size; a task builds one range's radix tree (`radix`) and gives a row for each turn-aligned depth.
Only prefixes that the last key of a range shares with the first of the next are in two trees: their rows, a path per
range, are added up. All other rows are final where they arise.

Scale: a very common first turn, opening or whole conversation is spread over ranges like any other keys, since the
ranges follow whole keys. The ids of a very common conversation are sorted over ranges too; what one task hashes, in
order, are pieces of their text. The turns of one conversation meet in one task, as they are one key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, groups_of, written
from .radix import UNIT, Member, Tree, walk

#: Bytes of keys in a range, and of text in a piece of a list of ids; rows of a batch that a task gives.
RANGE, PIECE, ROWS = 4 << 20, 1 << 16, 10_000
#: The digest of no ids.
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 over the role's length in bytes, the role and the text."""
    return F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, UNIT)


def turn_lists(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of id, words): the turns of each conversation in order of `turn`, nulls first, then of their ids.

    A null role or text is an empty one; words are what blanks separate. Rows that repeat are turns of their own. A
    null conv_id is one conversation. Other columns are ignored.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = turns.select(F.col("conv_id").cast("long"), F.struct("turn", turn_id(role, text).alias("id"), words.alias("words")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def rebuilt(lists: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation c with its first h turns replaced by those of conversation c - c % 20.

    h = crc32 of the decimal id, modulo 4. All turns of the other are taken where it has fewer than h, none where it
    is absent. Of a negative id the remainder is negative or 0. A null id keeps its turns.
    """
    c = F.col("conv_id")
    heads = lists.where(c % 20 == 0).select(c.alias("_base"), F.slice("turns", 1, 3).alias("_head"))
    h = F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4, F.lit(0)).cast("int")
    opening = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return lists.join(heads, c - c % 20 == F.col("_base"), "left").select("conv_id", F.concat(opening, rest).alias("turns"))


def _digests(members: DataFrame) -> DataFrame:
    """seq, ends: of (seq, conv_id) the SHA-256 of each seq's decimal ids, ascending, joined by commas; null ids are left out."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, first, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)])], names=["seq", "first", "text"])

        for batch in batches:
            for s, c in zip(batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (s != seq or size > PIECE):
                    yield piece()
                    held, size = [], 0
                if not held:
                    seq, first = s, c
                held.append(str(c))
                size += len(held[-1]) + 1
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, h, done = None, hashlib.sha256(), []
        for batch in batches:
            for s, text in zip(batch.column("seq").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if s != seq and seq is not None:
                    done.append((seq, h.hexdigest()))
                    h = hashlib.sha256()
                h.update((b"," if s == seq else b"") + text.encode())
                seq = s
            if len(done) >= ROWS:
                yield _batch(done, "seq binary, ends string")
                done = []
        if seq is not None:
            yield _batch([*done, (seq, h.hexdigest())], "seq binary, ends string")

    sorted_ids = members.where("conv_id is not null").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    pieces = sorted_ids.mapInArrow(join, "seq binary, first long, text string")
    return pieces.repartition("seq").sortWithinPartitions("seq", "first").select("seq", "text").mapInArrow(digest, "seq binary, ends string")


_TYPES = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _shared_units(a: bytes | None, b: bytes | None) -> int:
    """Whole units at the start of both; -1 where there is no other key."""
    if a is None or b is None:
        return -1
    n = 0
    while a[n : n + UNIT] == b[n : n + UNIT] and n < min(len(a), len(b)):
        n += UNIT
    return n // UNIT


def _neighbours(keys: DataFrame) -> DataFrame:
    """part, before, after: how many units each range shares with its neighbours; one row a range."""
    order = Window.orderBy("part")  # as many rows as there are ranges
    ends = keys.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    ends = ends.select("part", "lo", "hi", F.lag("hi").over(order).alias("last"), F.lead("lo").over(order).alias("next"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r["part"], _shared_units(r["last"], r["lo"]), _shared_units(r["hi"], r["next"])) for r in batch.to_pylist()]
            yield _batch(rows, "part int, before int, after int")

    return ends.mapInArrow(run, "part int, before int, after int")


_NODE = "name binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, spans boolean, parent binary, parent_spans boolean, parent_conv_id long"


def _trees(keys: DataFrame, parts: int) -> DataFrame:
    """The rows of each range's tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups_of(batches, "part"):
            tree, bounds = Tree(), rows.slice(0, 1).select(["before", "after"]).to_pylist()[0]
            for r in rows.select(["key", "n", "conv_id", "words", "ends"]).to_pylist():
                tree.insert(r["key"], Member(r["n"], r["conv_id"], r["words"], r["ends"] or NO_ENDS))
            found = list(walk(tree, bounds["before"], bounds["after"]))
            for k in range(0, len(found), ROWS):
                yield _batch(
                    [
                        (e.name, e.depth, e.smallest, e.copies, e.children, e.leaves, e.saved, e.ends, e.spans, *((p.name, p.spans, p.smallest) if (p := e.parent) else (None, False, None)))
                        for e in found[k : k + ROWS]
                    ],
                    _NODE,
                )

    return keys.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, _NODE)


def prefix_trie(lists: DataFrame) -> DataFrame:
    """A row per node of (conv_id, turns): name, depth, conv_id, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns; its members are the conversations that start with it, conv_id is their
    smallest id, name is 16 bytes of SHA-256 over its turns' ids. n_children counts nodes one turn longer, n_leaves
    childless nodes below or at it; saved_tokens adds up (n_convs - 1) x words of the last turn from it downwards;
    ends_sha256 is of the decimal ids, ascending, comma-joined, of members that end here. The root has no turns and a
    null parent. A null conv_id is a member, the largest, and is not among the ids. An empty table has no nodes.
    """
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    rows = lists.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"].cast("int")).alias("words"))
    convs = written(rows.withColumn("seq", F.substring(F.unhex(F.sha2("key", 256)), 1, UNIT)), "conversations")
    keys = convs.groupBy("seq", "key", "words").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    keys = keys.join(_digests(convs.select("seq", "conv_id")), "seq", "left")
    size = convs.agg(F.sum(F.octet_length("key"))).first()[0] or 0
    parts = -(-size // RANGE) or 1
    ranged = written(keys.drop("seq").repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id()), "ranges")
    forget(convs)
    bounds = F.broadcast(_neighbours(ranged))  # three numbers a range of RANGE bytes
    nodes = written(_trees(ranged.join(bounds, "part"), parts), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    spine = nodes.where("spans").groupBy("name").agg(F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"), F.first("parent").alias("parent"))
    spine = written(spine, "spine")
    columns = ["name", "depth", "conv_id", "parent", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    own = nodes.where("not spans")
    parents = spine.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = own.where("parent_spans").select(*columns).unionByName(spine.select(*columns)).join(parents, "parent", "left")
    every = own.where("not parent_spans").select(*columns, "parent_conv_id").unionByName(below)
    return every.select("name", "depth", "conv_id", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
