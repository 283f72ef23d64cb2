"""Fitted operators and the whole pipeline against plain Python."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from lumenfold.llm import quality, toxicity
from lumenfold.llm.common import text_buffer, word_bytes, words
from lumenfold.llm.tokens import encoder

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXT = st.lists(st.sampled_from(list("abAB1 .,!?#|'\n\té中") + ["the ", "longwordstogether", "\n\n"]), max_size=60).map("".join)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_words_of_a_block(texts):
    start, end, row, packed, at = word_bytes(*text_buffer(pa.array(texts)))
    raw = "".join(texts).encode()
    want = [(k, m.group().encode()) for k, t in enumerate(texts) for m in WORD.finditer(lower(t))]
    assert [(int(r), packed.tobytes()[a:b]) for r, a, b in zip(row, at, at[1:], strict=False)] == want
    assert [lower(raw[a:b].decode()).encode() for a, b in zip(start, end, strict=True)] == [w for _, w in want]
    key = words(*text_buffer(pa.array(texts)))[2].tolist()
    assert all((key[i] == key[j]) == (want[i][1] == want[j][1]) for i in range(len(want)) for j in range(i))


def plain_statistics(text):
    b = text.encode()
    size, n = len(b), max(len(b), 1)
    w = [m.group().encode() for m in WORD.finditer(lower(text))]
    capital = ["A" <= text[m.start()] <= "Z" for m in WORD.finditer(lower(text))]
    share = lambda xs: (len(set(xs)) / len(xs), max(xs.count(x) for x in set(xs)) / len(xs)) if xs else (1.0, 0.0)
    lines = [tuple(x) for x in ([m.group() for m in WORD.finditer(lower(part))] for part in text.split("\n")) if x]
    length = [len(x) for x in w]
    mean = sum(length) / len(w) if w else 0.0
    out = {"log_bytes": math.log1p(size), "log_words": math.log1p(len(w)), "word_length": mean}
    for name, members in quality.GROUPS.items():
        out[name] = sum(x in members for x in b) / n
    d = max(len(w), 1)
    out["word_length_sd"] = math.sqrt(max(sum(x * x for x in length) / d - mean**2, 0))
    out["short_words"], out["long_words"] = sum(x <= 3 for x in length) / d, sum(x >= 12 for x in length) / d
    out["new_words"], out["top_word"] = share(w)
    out["new_trigrams"] = share(list(zip(w, w[1:], w[2:], strict=False)))[0]
    out["new_lines"] = share(lines)[0]
    out["line_bytes"] = math.log1p(size / (1 + sum(x in b"\n\r" for x in b)))
    out["upper_words"] = sum(capital) / d
    out["bytes_per_stop"] = math.log1p(size / (1 + sum(x in b".,;:?" for x in b)))
    return [out[s] for s in quality.STATISTICS]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_statistics_equal_plain_python(texts):
    got = quality.statistics(*text_buffer(pa.array(texts)))
    assert got == pytest.approx(np.array([plain_statistics(t) for t in texts]), abs=1e-9)


def test_trees_equal_a_walk_of_the_nodes():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (900, 4))
    trees = quality.fit(x[:600], (x[:600, 0] * x[:600, 1] > x[:600, 2]).astype(float), trees=15)

    def walked(row):
        total = trees.base
        for node in trees.root.tolist():
            while trees.left[node] != node:
                node = int(trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node])
            total += trees.value[node]
        return 1 / (1 + math.exp(-total))

    assert trees.score(x) == pytest.approx(np.array([walked(r) for r in x]))
    assert len({*trees.score(x).tolist()}) > 50


def test_word_scores_rate_and_law():
    """The words' log-odds by their formula, the rate as the root of its equation, and evidence segment by segment."""
    rng = random.Random(5)
    n = 40
    keys = np.array(sorted(rng.sample(range(1, 1 << 62), n)), np.uint64)
    toxic = np.array([rng.choice([0, 0, 0, 1, 9, 30]) for _ in range(n)])
    clean = np.array([rng.choice([0, 3, 80, 400]) for _ in range(n)])
    corpus = (toxic + clean) * 7 + 1
    every = int(corpus.sum()) + 5000
    model = toxicity._word_model(keys, toxic, clean, corpus, every)
    nt, nc = max(toxic.max(), 1) + toxicity.PRIOR, max(clean.max(), 1) + toxicity.PRIOR
    want = {}
    for k, t, c, all_ in zip(keys.tolist(), toxic.tolist(), clean.tolist(), corpus.tolist(), strict=True):
        prior = toxicity.PRIOR * all_ / every + 0.5
        delta = math.log((t + prior) / max(nt - t - prior, 0.5)) - math.log((c + prior) / max(nc - c - prior, 0.5))
        solid = max(abs(delta) - toxicity.ERRORS * math.sqrt(1 / (t + prior) + 1 / (c + prior)), 0) * (1 if delta > 0 else -1)
        want[k] = (min(max(solid, toxicity.LEAST), toxicity.MOST) if t + c else 0.0) - toxicity.DRIFT
    got = model.word_scores(np.array([*keys.tolist(), 12345], np.uint64))
    assert got == pytest.approx(np.array([*want.values(), -toxicity.DRIFT]))
    seen = toxic + clean > 0
    mass = {k: a * c / max(t + c, 1) for k, t, c, a in zip(keys.tolist(), toxic.tolist(), clean.tolist(), corpus.tolist(), strict=True) if t + c}
    other = every - corpus[seen].sum()
    total = sum(mass.values()) + other
    assert sum(m / total * math.exp(model.rate * want[k]) for k, m in mass.items()) + other / total * math.exp(-model.rate * toxicity.DRIFT) == pytest.approx(1, abs=1e-6)
    vocabulary = [f"w{k}" for k in range(12)]
    own = np.sort(words(*text_buffer(pa.array([" ".join(vocabulary)])))[2])
    model = toxicity.Model(own, np.linspace(-2, 3, 12), -toxicity.DRIFT, 0.9, 0.4, (-1.0, 0.8, 0.3))
    texts = ["", "nothing here", *(" ".join(rng.choice([*vocabulary, "x", "y"]) for _ in range(rng.randint(1, 80))) for _ in range(30))]
    evidence, _ = model.evidence(*text_buffer(pa.array(texts)))
    for text, row in zip(texts, evidence.tolist(), strict=True):
        found, last = [], {}
        for k, w in enumerate(text.split()):
            s = float(model.word_scores(words(*text_buffer(pa.array([w])))[2])[0])
            if s > 0:
                if k - last.get(w, -99) <= toxicity.REPEAT:
                    found.append(-toxicity.DRIFT)
                else:
                    found.append(s)
                last[w] = k
            else:
                found.append(s)
        best = max((sum(found[i:j]) for i in range(len(found)) for j in range(i + 1, len(found) + 1)), default=0)
        z = 0.9 * best - 0.4 - math.log(len(found)) if best > 0 else -10.0
        assert row[0] == pytest.approx(max(z, -10.0))


def windows(text, n=50):
    return [text[k : k + n] for k in range(len(text) - n + 1)]


def by_hand(docs, benchmark):
    """The pipeline's stages on (doc_id, text) whose near copies are clear-cut and of which nothing is toxic."""
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))}
    kept = []
    for i, t in sorted(docs):
        if not any(len(shingles(t) & shingles(u)) > 0.85 * len(shingles(t) | shingles(u)) for _, u in kept):
            kept.append((i, t))
    first = {}
    for i, t in kept:
        for w in windows(t):
            first.setdefault(w, i)
    out = []
    for i, t in kept:
        gone = [False] * len(t)
        for k, w in enumerate(windows(t)):
            if first[w] < i:
                gone[k : k + 50] = [True] * 50
        out.append((i, "".join(c for c, g in zip(t, gone, strict=True) if not g)))
    phrases = set()
    for item in benchmark:
        w = WORD.findall(lower(item))
        phrases |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    clean = []
    for i, t in out:
        found = list(WORD.finditer(lower(t)))
        w = [m.group() for m in found]
        hit = {k for p in phrases for s in range(len(w) - len(p) + 1) if tuple(w[s : s + len(p)]) == p for k in range(s, s + len(p))}
        parts, at = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                parts.append(t[at : found[k].start()])
            at = found[k].end()
        clean.append((i, "".join([*parts, t[at:]])))
    return clean


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, items = text(25), [text(14), text(6)]
    docs = []
    for k in range(30):
        t = text(rng.randint(80, 160))
        if k % 4 == 0:
            t = f"{t} {passage} {text(30)}"
        if k % 5 == 0:
            t = f"{t}; {rng.choice(items).title()}. {text(20)}"
        docs.append((k, t))
    for k in range(30, 42):
        w = docs[k - 30][1].split()
        if k % 2:
            w[rng.randrange(40)] = "changed"  # one word of a hundred: five shingles differ
        docs.append((k, " ".join(w)))
    folder = str(tmp_path)
    rows = spark.createDataFrame([(i, t, "x", "y", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    want = by_hand(docs, items)
    assert len(want) == 30 and any(t != dict(docs)[i] for i, t in want)
    code = encoder(public_tokenizers.path("byte_bpe_50k.json")).library
    ids = {i: [*code.encode(t, add_special_tokens=False).ids, 1] for i, t in want}
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == set(ids)
    for p in pieces:
        own = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(own.tobytes())
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
