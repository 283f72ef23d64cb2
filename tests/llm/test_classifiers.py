import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import quality, toxicity
from lumenfold.llm.common import text_buffer, words

DOCS = "doc_id long, text string, score string"


def corpus(seed, n=1500):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su", "ke") for b in ("na", "ro", "ti", "vu", "pe", "da")]
    bad = ["vile", "rotten", "wicked", "cursed", "foul"]
    docs, labels = [], []
    for k in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 150))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() < 0.7)
        for _ in range(rng.randint(2, 5) if toxic else 0):
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        text = " ".join(t).capitalize() + "."
        if not good:
            text = text.upper().replace(" ", "!! ") if rng.random() < 0.5 else " | ".join(t)
        docs.append((k, text, "clash"))
        labels.append((k, good, toxic))
    return docs, labels


def held_out_accuracy(rows, labels, column):
    want = {r[0]: r[column] for r in labels}
    held = [r for r in rows if r.held_out and r.doc_id in want]
    assert len(held) > 100
    return np.mean([r.predicted == want[r.doc_id] for r in held])


def test_quality_on_held_out_rows(spark):
    docs, labels = corpus(1)
    df = spark.createDataFrame([*docs, (None, None, "x"), (5000, "", "x"), (5001, "word " * 30000, "x")], DOCS)
    trees = quality.train(df, spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int"))
    rows = quality.score(df, trees).collect()
    assert len(rows) == len(docs) + 3 and all(0 <= r.score <= 1 for r in rows)
    assert held_out_accuracy(rows, labels, 1) > 0.97


def test_toxicity_on_held_out_rows(spark):
    docs, labels = corpus(2)
    df = spark.createDataFrame([*docs, (None, None, "x"), (5000, "", "x"), (5001, "word " * 30000, "x")], DOCS)
    model = toxicity.train(df, spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int"))
    rows = toxicity.with_fold(toxicity.score(df, model)).collect()
    assert held_out_accuracy(rows, labels, 2) > 0.97
    by = {r.doc_id: r for r in rows}
    assert by[5000].predicted == by[None].predicted == by[5001].predicted == 0
    text = {d[0]: d[1].encode() for d in docs}
    spans = [text[r.doc_id][p.begin : p.end].lower() for r in rows if r.doc_id in text for p in r.passages]
    assert spans and all(any(b in s for b in (b"vile", b"rotten", b"wicked", b"cursed", b"foul")) for s in spans)


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", "x")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(df, toxicity.train(df, none)).first().predicted == 0
    assert quality.score(df, quality.train(df, none)).first().score == 0.5
    assert quality.score(df.limit(0), quality.train(df.limit(0), none)).count() == 0
    assert toxicity.score(df.limit(0), toxicity.train(df.limit(0), none)).count() == 0


def maximal(scores):
    """Maximal scoring segments by definition: repeatedly the best (leftmost, then shortest), then both sides."""

    def best(lo, hi):
        top = None
        for i in range(lo, hi):
            s = 0.0
            for j in range(i, hi):
                s += scores[j]
                if s > 1e-12 and (top is None or s > top[2] + 1e-12):
                    top = (i, j, s)
        return [] if top is None else [*best(lo, top[0]), top, *best(top[1] + 1, hi)]

    return best(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-5, 5), max_size=14))
def test_segments_cover_the_best(scores):
    s = np.array(scores, float) + (1 + np.arange(len(scores))) ** 1.5 * 1e-6  # no ties
    total, up = np.cumsum(s) - s, np.flatnonzero(s > 0)
    got = toxicity.segments(up, s[up], total[up])
    want = maximal(s.tolist())
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float)
    trees = quality.fit(x[:3000], y[:3000])
    assert ((trees.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97


def test_repeated_words_far_apart_score_again():
    bad = ["vile", "rotten", "wicked", "cursed", "foul", "cruel"]
    dense, filler = " ".join(bad), " ".join(["calm"] * 300)
    twice = f"{filler} {dense} {filler} {dense} {filler}"
    scattered = " ".join(f"{b} {filler}" for b in bad)  # each word once, far apart
    data, offsets = text_buffer(pa.array([twice, f"{scattered} {dense}", scattered]))
    keys = np.unique(words(*text_buffer(pa.array([dense])))[2])
    model = toxicity.Model(keys, np.full(len(keys), 4.0), -toxicity.DRIFT, 1.0, 0.0, (0.0, 1.0, 0.1))
    evidence, found = model.evidence(data, offsets)
    raw = data.tobytes()
    assert [[raw[o + a : o + b].decode() for a, b, _ in f] for o, f in zip(offsets[:2].tolist(), found, strict=False)] == [[dense, dense], [dense]]
    assert not found[2] and evidence[1, 0] == found[1][0][2] - np.log(len(f"{scattered} {dense}".split()))
