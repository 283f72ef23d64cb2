"""Chat formatting by cumulative-snapshot collapse, in DataFrame functions only.

A logger that stores a conversation after every turn leaves snapshots: conversations whose turns are the
first turns of a longer one. Each turn is hashed with its position; the running XOR of those hashes is a
rolling hash of every prefix. Conversations are first reduced to one representative per whole-conversation
hash (a partial aggregate, so a conversation copied a million times costs a million counts), then
representatives whose hash is a proper prefix of another are removed by an anti-join, then the rest is rendered.

Scale: one shuffle by conv_id for the running hash, one of 24-byte keys for each side of the anti-join.
Prefix keys are distinct before the join, so a very common first turn is one row there. The turns of one
conversation meet in one task because its rendered text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _turn_hash(salt: int) -> Column:
    parts = [F.lit(salt), F.col("_pos")]
    for c in ("role", "text"):  # xxhash64 skips nulls: mark them
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, _pos (from 1), _n (turns in the conversation), _h1, _h2 (hash of turns 1 to _pos).

    Turns are ordered by turn, then role, then text (nulls first), so ties and repeated rows have one order.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("_pos", F.row_number().over(order))
    return rows.select(
        "conv_id",
        "role",
        "text",
        "_pos",
        F.count(F.lit(1)).over(whole).alias("_n"),
        F.bit_xor(_turn_hash(1)).over(running).alias("_h1"),
        F.bit_xor(_turn_hash(2)).over(running).alias("_h2"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies: the conversations that are no proper prefix of another.

    Of conversations with equal turns the smallest conv_id stays (a null id counts as largest) and n_copies
    says how many there were. A null conv_id is one conversation like any other.
    """
    keys = prefix_hashes(turns).select("conv_id", "_pos", "_n", "_h1", "_h2")
    whole = (
        keys.where("_pos = _n")
        .groupBy("_pos", "_h1", "_h2")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    proper = keys.where("_pos < _n").select("_pos", "_h1", "_h2").distinct()
    return whole.join(proper, ["_pos", "_h1", "_h2"], "left_anti").select(
        "conv_id", F.col("_pos").cast("long").alias("n_turns"), "n_copies"
    )


def render(turns: DataFrame, begin: str = "<|", middle: str = "|>\n", end: str = "<|end|>\n", also: tuple[str, ...] = ()) -> DataFrame:
    """conv_id, columns `also` (equal within a conversation), chat: the turns in order as ``begin role middle text end``.

    A null role is "unknown", a null text empty.
    """
    piece = F.concat(
        F.lit(begin), F.coalesce("role", F.lit("unknown")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(end)
    )
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text", piece.alias("piece"))))
    chat = F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("chat")
    return turns.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in also], chat)


def format_chats(turns: DataFrame, **template: str) -> DataFrame:
    """conv_id, n_turns, n_copies, chat of every maximal conversation. Extra columns of `turns` are ignored.

    Empty input gives no rows; an empty text is a turn with an empty body.
    """
    keep = maximal_conversations(turns).withColumnRenamed("conv_id", "_keep")
    slim = turns.select("conv_id", "turn", "role", "text")
    kept = slim.join(keep, F.col("conv_id").eqNullSafe(F.col("_keep"))).drop("_keep")  # only what stays is rendered
    return render(kept, also=("n_turns", "n_copies"), **template).select("conv_id", "n_turns", "n_copies", "chat")
