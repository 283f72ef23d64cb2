import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import grouping, periodic
from lumenfold.llm.common import read

WORDS = re.compile("[^\x20\x09-\x0d]+")


def lyndon_lengths(s):
    """By the definition: up to the next smaller suffix."""
    return [next((j - i for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s) - i) for i in range(len(s))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=25), min_size=1, max_size=6))
def test_phase_one_gives_lyndon_words(texts):
    lanes = [[*t, 0] for t in texts]
    begin = np.cumsum([0, *map(len, lanes)])
    length, word = grouping.lyndon_arrays(np.array([x for lane in lanes for x in lane]), begin)
    for lane, lo, hi in zip(lanes, begin, begin[1:], strict=False):
        assert length[lo:hi].tolist() == [*lyndon_lengths(lane[:-1]), 1]
        words = [tuple(lane[i : i + n]) for i, n in enumerate(length[lo:hi])]
        own = word[lo:hi].tolist()
        assert all((own[i] == own[j]) == (words[i] == words[j]) for i in range(len(own)) for j in range(i))


def brute_runs(s, least=6, repeats=4):
    out = []
    for q in range(1, len(s) // repeats + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j + q - i
            if n >= max(least, repeats * q) and not any(all(s[k] == s[k + r] for k in range(i, i + n - r)) for r in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def found(rows, **limits):
    symbol = np.array([x for r in rows for x in r], np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    first = np.cumsum([0, *map(len, rows)])
    got = [[] for _ in rows]
    for p, n, q in zip(*(x.tolist() for x in periodic.runs(symbol, row, **limits)), strict=True):
        got[row[p]].append((p - int(first[row[p]]), n, q))
    return got


PIECE = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 7)).map(lambda x: x[0] * x[1])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PIECE, max_size=5).map(lambda x: sum(x, [])), min_size=1, max_size=5))
def test_runs_equal_brute_force(rows):
    assert found(rows) == [brute_runs(r) for r in rows]
    assert found(rows, least=3, repeats=3) == [brute_runs(r, 3, 3) for r in rows]


def test_long_texts():
    rng = random.Random(4)
    sentence = [rng.randint(0, 300) for _ in range(700)]
    rows = [sentence * 6 + [1] * 9, [7] * 3000, [rng.randint(0, 1) for _ in range(4000)], sentence, list(range(50)) * 2]
    assert found(rows) == [brute_runs(r) for r in rows]


def brute(doc_id, text):
    words = WORDS.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    own = brute_runs(words)
    drop = {k for i, m, q in own for k in range(i + q, i + m)}
    best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    kept = " ".join(w for k, w in enumerate(words) if k not in drop)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(own), *best, 1000 * best[1] // best[2] if own else None, sha("".join(f"{i},{m},{q}\n" for i, m, q in own)), sha(kept))


def test_report_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK", 3000)
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:12]
    texts = ["a b " * 9 + "c", None, "", " \t\n", "x", "é\x85 ü  " * 7 + "\x00 z", "no runs here at all", "w " * 6, "w " * 5, "a b c d " * 4 + "a b c", "one two three four five six seven eight " * 3]
    rows = [(k, t) for k in [*ids, 1, None, -5] for t in texts] + [(ids[0], "many words " * 4000), (2, "z" * 5000 + " q" * 9)]
    docs = spark.createDataFrame([(*r, "clash", 0) for r in rows], "doc_id long, text string, runs string, n_runs int").repartition(3)
    got = periodic.report(periodic.with_planted_runs(docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(*r) for r in rows), key=str)
    assert periodic.report(docs.limit(0)).count() == 0
    own = periodic.find_runs(docs.where("doc_id = 2").selectExpr("doc_id as name", "text as body"), id_column="name", text_column="body").first()
    assert own.n_words == 10 and own.collapsed == "z" * 5000 + " q" and [tuple(r) for r in own.runs] == [(1, 9, 1)]


def test_whole_table(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    got = periodic.report(periodic.with_planted_runs(docs)).collect()
    assert sorted(map(tuple, got)) == sorted(brute(r.doc_id, r.text) for r in docs.collect())
    assert sum(r.n_runs > 0 for r in got) > 5
