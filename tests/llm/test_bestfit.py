import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import bestfit
from lumenfold.llm.common import read
from lumenfold.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [(3, "hello there, it's me"), (1, None), (2, ""), (7, "x " * 6000), (7, "x " * 6000), (None, "né 中"), (5, "a" * 5000), (4, "\n\n  b")]


def slowest(sizes, window):
    """The rule by its definition: of the open sequences with room the one that leaves the smallest sum of squares, or a new one."""
    fills, out = [], []
    for size in sizes:
        best = None
        for k, fill in enumerate(fills):
            if fill + size > window:
                continue
            after = [*fills[:k], fill + size, *fills[k + 1 :]]
            gaps = [window - f for f in after if f < window]
            squares = sum(gaps.count(g) ** 2 for g in set(gaps))
            best = min(best or (squares, window, 0), (squares, window - fill, k)) if best else (squares, window - fill, k)
        if best is None:
            fills.append(size)
            out.append((0,))
        else:
            out.append((fills[best[2]],))
            fills[best[2]] += size
    return [x[0] for x in out], sorted(fills)


@pytest.mark.parametrize("seed", range(6))
def test_places_as_the_definition_says(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 20) for _ in range(60)), reverse=bool(seed % 2))
    gaps, fills, offsets = bestfit.Gaps(20), {}, []
    for size in sizes:
        sequence, offset = gaps.place(size)
        assert fills.get(sequence, 0) == offset
        fills[sequence] = offset + size
        offsets.append(offset)
    assert (offsets, sorted(fills.values())) == slowest(sizes, 20)


def held_against(docs, pieces, window, end_id):
    """Every id of every row is in one piece, cut only where a window is too short, and sequences have no holes."""
    want = {}
    for doc_id, text in docs:
        ids = np.array([*encoder(PATH).library.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        head = len(ids) % window or window
        cuts = [0, *range(head, len(ids), window), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            row = (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
            want[row] = want.get(row, 0) + 1
    got, sequences = {}, {}
    for p in pieces:
        row = (p.doc_id, p.piece, p.start, p.length, p.ids_crc32)
        got[row] = got.get(row, 0) + 1
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *[n for _, n in s]])[:-1].tolist() and sum(n for _, n in s) <= window
    return len(sequences), sum(p.length for p in pieces)


def test_every_row_is_packed(spark):
    docs = spark.createDataFrame([(*r, 9, "clash") for r in ROWS], "doc_id long, text string, piece int, deal string").repartition(3)
    held_against(ROWS, bestfit.pack(docs, PATH).collect(), 2048, 0)
    held_against(ROWS, bestfit.pack(docs, PATH, window=7, end_id=5, part=100).collect(), 7, 5)
    named = docs.select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))
    assert bestfit.pack(named, PATH, id_column="name", text_column="body").columns == ["name", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert bestfit.pack(docs.limit(0), PATH).count() == 0


def test_whole_table_needs_hardly_more_than_it_must(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    made, total = held_against([tuple(r) for r in docs.collect()], bestfit.pack(docs, PATH).collect(), 2048, 0)
    assert made <= -(-total // 2048) + 2
    many, _ = held_against([tuple(r) for r in docs.collect()], bestfit.pack(docs, PATH, part=200).collect(), 2048, 0)
    assert many <= made * 1.03
