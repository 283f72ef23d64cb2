import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import substrings
from lumenfold.llm.grouping import suffix_arrays

DOCS = "doc_id long, text string, n_bytes string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=8))
def test_suffix_arrays_of_lanes(lanes):
    lanes = [[*x, 0] for x in lanes]
    begin = np.concatenate([[0], np.cumsum([len(x) for x in lanes])])
    got = suffix_arrays(np.array([s for x in lanes for s in x]), begin)
    for k, x in enumerate(lanes):
        assert (got[begin[k] : begin[k + 1]] - begin[k]).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def brute(rows):
    first = {}
    big = 1 << 62
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, big), big - 1 if i is None else i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < (big - 1 if i is None else i):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], DOCS).repartition(parts)
    got = [tuple(r) for r in substrings.removals(df).collect()]
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("common", [3, 20_000])
def test_against_brute_force(spark, monkeypatch, common):
    """Also where nearly all anchors are cut by longer ones before they are dealt out."""
    monkeypatch.setattr(substrings, "COMMON", common)
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(12)]
    rows = []
    for i in range(120):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, max(0, len(t) - 1))
            t = t[:k] + rng.choice(words) + t[k + rng.randint(0, 4) :]
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "a" * 49), (203, "a" * 50), (204, "a" * 700), (205, "ab" * 300), (206, "b" + "ab" * 100), (None, base[0]), (None, base[1]), (50, base[2]), (50, base[2]), (300, base[3] * 3)]
    monkeypatch.setattr(substrings, "CHUNK", 3000)
    check(spark, rows)


@pytest.mark.parametrize("lane", [2, 5, 32])
def test_many_contexts_of_common_lines(monkeypatch, lane):
    """Lines of 33, 47 and 60 bytes before and after texts of their own, with short lanes forced; and copies of them."""
    rng = random.Random(6)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    lines = [own(33), own(47), own(60)]
    rows = [(k, (own(rng.randint(0, 40)) + rng.choice(lines) + own(rng.randint(0, 40)) + rng.choice(lines) * rng.randint(1, 2)).encode()) for k in range(80)]
    rows += [(80 + k, t) for k, (_, t) in enumerate(rows[:30] * 3)]
    monkeypatch.setattr(substrings, "LANE", lane)
    data = np.frombuffer(b"".join(t for _, t in rows), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])])
    first, windows, key, text = substrings.anchors(data, offsets)
    order = np.argsort(key, kind="stable")
    first, windows, key, text = first[order], windows[order], key[order], text[order]
    of, length, doc = substrings.least_documents(first, windows + 49, key, text, data)
    at = np.repeat(first[of] - np.concatenate([[0], np.cumsum(windows)])[of], length) + np.arange(length.sum())
    got = dict(zip(at.tolist(), np.repeat(doc, length).tolist(), strict=True))
    least = {}
    for k, t in rows:
        for i in range(len(t) - 49):
            least.setdefault(t[i : i + 50], k)
    assert got == {int(offsets[k]) + i: least[t[i : i + 50]] for k, t in rows for i in range(len(t) - 49)}


def test_all_of_a_given_table(spark, sf_dir):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    check(spark, [(r["doc_id"], r["text"]) for r in table])


def test_empty_and_single(spark):
    assert substrings.removals(spark.createDataFrame([], DOCS)).count() == 0
    check(spark, [(1, "only one document, with no other to repeat it, of more than fifty bytes")])


def test_clean_text_keeps_whole_characters(spark):
    passage = "".join(chr(0xC0 + k % 60) for k in range(60))
    rows = [(1, passage), (2, "é" + passage + "é"), (3, "x" + passage[1:] + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.left for r in substrings.removals(df, clean="left").collect()}
    assert out == {1: passage, 2: "éé", 3: "xy"}
