import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.llm import decontamination as d

from .words import thue_morse

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = WORDS.findall(lower(text or ""))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for doc, text in docs:
        w = WORDS.findall(lower(text or ""))
        hit, found = set(), set()
        for p, owners in windows.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= {str(o) for o in owners if o is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "g", "é", "12", "ÄÖ", "zeta", "x9", "the", "of"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(words(rng.randint(8, 25)))) for k in range(25)] + [(30, "solo"), (31, ""), (32, None), (None, "unnamed item"), (33, "g the of"), (33, "g the of")]
    docs = []
    for k in range(80):
        w = words(rng.randint(0, 60))
        if rng.random() < 0.5:
            t = rng.choice([i[1] for i in items if i[1]]).upper().split()
            at = rng.randint(0, len(w))
            w = w[:at] + t[: rng.randint(5, 30)] + w[at:]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w)))
    docs += [(90, None), (91, ""), (None, "solo"), (92, "Unnamed ITEM"), (7, "solo solo"), (7, "solo solo"), (93, "of " * 5000 + "g the of")]
    monkeypatch.setattr(d, "SHARD_BYTES", 500)
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, n_hit long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in d.report(df, bench).collect()), key=str)
    assert got == brute(docs, items)
    monkeypatch.setattr(d, "BLOCK_PHRASES", 40)  # several blocks of phrases in one pass, and several passes, give the same
    assert sorted((tuple(r) for r in d.report(df, bench).collect()), key=str) == got
    monkeypatch.setattr(d, "GROUP_BYTES", 8_000)
    assert sorted((tuple(r) for r in d.report(df, bench).collect()), key=str) == got


def test_passes_follow_the_benchmarks_bytes(spark):
    """The 40 items make one block, or few, in however many partitions they come; a group is bounded by bytes."""
    items = spark.createDataFrame([(k, f"item {k} of the benchmark with words enough for three windows {k}") for k in range(40)], "item_id long, text string")
    for parts in (1, 40, 200):
        blocks = [(r.place, r.size) for r in d.phrase_table(items.repartition(parts), 10).select("place", "size").collect()]
        assert len(d.groups_by_bytes(blocks, d.GROUP_BYTES)) == 1 and len(blocks) <= 4
    assert d.groups_by_bytes([(3, 5), (1, 4), (2, 9), (4, 1)], 9) == [[1], [2], [3, 4]]
    assert d.groups_by_bytes([], 9) == []


def test_words_of_one_polynomial_hash(spark):
    """The Thue-Morse word of 1,024 letters and its complement agree under every polynomial hash modulo 2**64."""
    one, two = thue_morse(1024)
    docs = spark.createDataFrame([(1, f"x {one} y"), (2, f"x {two} y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, two, "clash")], "item_id long, text string, doc_id string")
    docs = docs.withColumn("item_id", F.lit("clash"))
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in d.report(docs, items).collect()) == [(1, 0, 0), (2, 1, 1)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in d.report(docs, none).collect()] == [(1, 3, 0, 0)]
    assert d.report(docs.limit(0), none).count() == 0


def test_clean_text(spark):
    docs = spark.createDataFrame([(1, "keep this; One two THREE four. And that")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    row = d.scan(docs, items, clean="left").first()
    assert row.left == "keep this; . And that" and [tuple(s) for s in row.spans] == [(11, 29)]


def test_clean_text_in_several_passes(spark, monkeypatch):
    """Spans of earlier passes are kept, also where `keep` names the text itself and a window overlaps an earlier one."""
    monkeypatch.setattr(d, "BLOCK_PHRASES", 1)
    monkeypatch.setattr(d, "GROUP_BYTES", 1)
    docs = spark.createDataFrame([(1, "é one two three; four nine"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([("a", "one two"), ("b", "two three four"), ("c", "nine"), ("d", "absent")], "item_id string, text string")
    rows = sorted(d.scan(docs, items, keep=("doc_id", "text"), clean="left").collect())
    assert [(r.doc_id, r.n_words, r.n_hit, r["items"], r.left) for r in rows] == [(1, 6, 5, ["a", "b", "c"], "é "), (2, 0, 0, [], "")]
    assert rows[0].text == "é one two three; four nine"


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=10), st.lists(st.integers(1, 4), min_size=1, max_size=5))
def test_index_counts_and_locates(runs, phrase):
    text = np.array([s for r in runs for s in [*r, 0]])
    index = d.FMIndex(text, 5)
    low, high = index.search(np.array([phrase]), np.array([len(phrase)]))
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(len(text)) if text[i : i + len(phrase)].tolist() == phrase]
