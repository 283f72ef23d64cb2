import random

import numpy as np
import pyarrow as pa

from lumenfold.llm import minhash
from lumenfold.llm.common import text_buffer, written
from lumenfold.llm.components import components

from .words import thue_morse

DOCS = "doc_id long, text string, class_id string"


def brute(rows, idf, threshold=0.8):
    """Classes by comparing all pairs."""
    texts = [t or "" for _, t in rows]
    row, ids, count = minhash.shingles(*text_buffer(pa.array(texts)))
    w = count * idf[(ids % np.uint64(minhash.TABLE)).astype(int)].astype(float)
    total = np.bincount(row, w, minlength=len(rows))
    overlap = np.zeros((len(rows), len(rows)))
    order = np.argsort(ids, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(ids[order])) + 1):
        if len(group) > 1:
            overlap[np.ix_(row[group], row[group])] += np.minimum.outer(w[group], w[group])
    ok = overlap >= threshold * (total[:, None] + total - overlap)
    ok &= (total > 0) & (total[:, None] > 0)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    same = {}
    for i, t in enumerate(texts):
        root[find(i)] = find(same.setdefault(t, i))
    for i, j in zip(*np.nonzero(np.tril(ok, -1)), strict=True):
        root[find(int(i))] = find(int(j))
    return [find(i) for i in range(len(rows))]


def test_classes_equal_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for base in range(25):
        t = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(1, 6)):
            c = list(t)
            for _ in range(rng.choice([0, 1, 1, 2, 8])):
                c[rng.randrange(len(c))] = rng.choice(words)
            rows.append((len(rows), " ".join(c)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "one two"), (904, "!!!"), (905, "one two three four five")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(3)
    idf = minhash.inverse_frequencies(df)
    want = brute(rows, idf)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    smallest = {}
    for (i, _), c in zip(rows, want, strict=True):
        smallest[c] = min(i, smallest.get(c, i))
    assert got == {i: smallest[c] for (i, _), c in zip(rows, want, strict=True)}


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    ids = np.sort(rng.integers(0, 1 << 40, 200).astype(np.uint64))
    a, b = rng.gamma(2, 1, 200), rng.gamma(2, 1, 200)
    row = np.repeat([0, 1], 200)
    _, drawn = minhash.samples(row, np.concatenate([ids, ids]), np.concatenate([a, b]), 2, 4000)
    assert abs((drawn[0] == drawn[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_one_of_each_with_nulls_and_repeats(spark):
    long = " ".join(f"w{k}" for k in range(100))
    rows = [(1, long), (2, long + " tail"), (2, long + " tail"), (3, "other text of its own"), (3, "other text of its own"), (None, long), (None, "nameless"), (None, "nameless"), (4, None), (5, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    kept = sorted(((r.doc_id, r.text) for r in minhash.one_of_each(df).collect()), key=str)
    assert kept == sorted([(1, long), (3, "other text of its own"), (4, None), (None, "nameless")], key=str)
    assert minhash.one_of_each(df.limit(0)).count() == 0
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(500, k) for k in range(501, 540)] + [(3, 3), (None, 1)]
    root = list(range(1000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {v for a, b in edges if a is not None and a != b for v in (a, b)}
    assert got == {v: find(v) for v in nodes}


def recall(spark, rows):
    """Share of the links that brute force finds whose ends are in one class, and classes that it has not."""
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS).repartition(4)
    idf = minhash.inverse_frequencies(df)
    want = brute(rows, idf)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    first = {}
    linked = [(first.setdefault(c, i), i) for (i, _), c in zip(rows, want, strict=True)]
    linked = [(a, b) for a, b in linked if a != b]
    group = dict(zip([i for i, _ in rows], want, strict=True))
    wrong = sum(group[c] != group[i] for i, c in got.items())
    return sum(got[a] == got[b] for a, b in linked) / len(linked), wrong, len(linked)


def test_pairs_within_a_long_template(spark):
    """300 pairs share 15 words each and a template of 1,000 words with all: none but the pairs reaches 0.8."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(20000)]
    template = [rng.choice(words) for _ in range(1000)]
    rows = []
    for pair in range(300):
        own = [rng.choice(words) for _ in range(80)]
        for _ in range(2):
            rest = [rng.choice(words) for _ in range(25)]
            rows.append((len(rows), " ".join(template + own + rest)))
    share, wrong, links = recall(spark, rows)
    assert links == 300 and share >= 0.99 and not wrong


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for _ in range(500):
        c = list(base)
        for _ in range(rng.randint(0, 6)):
            c[rng.randrange(len(c))] = rng.choice(words)
        rows.append((len(rows), " ".join(c)))
    rows += [(1000 + k, " ".join(rng.choice(words) for _ in range(60))) for k in range(200)]
    share, wrong, links = recall(spark, rows)
    assert links > 100 and share >= 0.99 and not wrong


def test_given_documents(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    share, wrong, links = recall(spark, [(r["doc_id"], r["text"]) for r in table])
    assert links > 50 and share >= 0.99 and not wrong


def test_frequencies_are_exact_where_they_matter(spark):
    """Against exact document frequencies, down to one in RAREST documents."""
    rng = random.Random(13)
    words = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join([f"line {k % 7} of a common head", *(rng.choice(words) for _ in range(30))])) for k in range(3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    idf = minhash.inverse_frequencies(df)
    row, ids, _ = minhash.shingles(*text_buffer(pa.array([t for _, t in rows])))
    found, n = np.unique(ids, return_counts=True)
    exact = 1 + np.log((1 + len(rows)) / (1 + np.maximum(n, len(rows) / minhash.RAREST)))
    off = np.abs(idf[(found % np.uint64(minhash.TABLE)).astype(int)] - exact)
    assert np.quantile(off, 0.85) < 0.1 and off[n > 100].max() < 0.1


def test_an_id_with_several_texts(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(1, a), (2, a + " end"), (2, b), (3, b + " end"), (4, "something else of its own entirely")]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    got = {(r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_pairs_that_share_rare_shingles(spark, monkeypatch):
    """Against all pairs of entries, with groups of several blocks: none is lost and few are given twice."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(14)
    words = [f"w{k}" for k in range(3000)]
    template = [rng.choice(words) for _ in range(300)]
    rows = []
    for k in range(120):
        t = list(template)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((k, " ".join(t), k // 2))
    rows += [(500, None, 500), (501, "", 501), (502, "one two", 502), (503, "one two", 503)]
    df = spark.createDataFrame(rows, "doc_id long, text string, c long").repartition(3)
    rare = minhash.prefixes(df, minhash.inverse_frequencies(df))
    entries = written(rare.join(df.select("doc_id", "c"), "doc_id"), "entries")
    per = {}
    for r in entries.collect():
        per.setdefault(r.shingle, []).append(r)
    meetings = [
        (a.doc_id, b.doc_id)
        for group in per.values()
        for a in group
        for b in group
        if a.doc_id < b.doc_id and a.c != b.c and a.weight <= b.most * (1 + 1e-9) and b.weight <= a.most * (1 + 1e-9)
    ]
    want = set(meetings)
    got = [(r.a, r.b) for r in minhash._sharing(entries).collect()]
    assert set(got) == want and (502, 503) in want
    assert len(want) > 500 and len(meetings) > 5 * len(want) and len(got) < 1.2 * len(want)


def test_long_words_are_told_apart(spark):
    """Words that agree under every polynomial hash modulo 2**64 are two classes."""
    for n in (1024, 4096):
        docs = spark.createDataFrame([(k, t) for k, t in enumerate(thue_morse(n))], "doc_id long, text string")
        assert sorted((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()) == [(0, 0), (1, 1)]
