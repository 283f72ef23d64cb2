"""Toxicity by maximum-scoring segments.

A word's score is its log-odds of occurring in toxic against clean documents, with an informative Dirichlet
prior in proportion to the word's count in the whole corpus, less ERRORS standard errors, so that a word must be
well attested to count. A constant drift makes the expected score of clean text negative. One linear scan
finds all maximal scoring segments of a text; the largest of n words of clean text follows an extreme-value law,
P(S >= s) ~ 1 - exp(-K n exp(-lambda s)), where lambda solves sum p exp(lambda s) = 1 over clean words and K
is fitted to clean documents. A document's evidence is its segments' log-significance beyond that law, turned
into a probability by a logistic fit.

The law and the logistic fit see each sampled document with scores of words that the other half of the sample gave,
as scores look better on the documents they come from. The final scores come from the whole sample.

Scale: words of a bounded labelled sample (`labelled.SAMPLE_ROWS`) are the vocabulary; the corpus pass counts only
those words, in one array per task. Scoring is map-only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, mix, text_blocks, words, written
from .labelled import SAMPLE_ROWS, in_fold, labelled_texts, sample_of

#: Weight of the prior in documents, drift per word, standard errors taken off, and the E-value below which a segment is a toxic passage.
PRIOR, DRIFT, ERRORS, SIGNIFICANT = 50.0, 0.15, 1.8, 1e-2
MOST, LEAST = 8.0, -1.0
#: Words behind a scoring word in which its repetition is no new evidence; passages further apart are scored each by itself.
REPEAT = 20
PASSAGES = T.ArrayType(T.StructType().add("begin", "integer").add("end", "integer").add("score", "double"))


def segments(position: np.ndarray, gain: np.ndarray, before: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score) of one text, in one pass.

    position, gain: the words with positive score; before[k]: total score of all words before the k-th of them.
    A stack holds candidate segments with the cumulative totals at their ends; a new one absorbs earlier ones
    for as long as that raises its score.
    """
    stack: list[list] = []  # first word, last word, total before it, total after it
    for w, g, lo in zip(position.tolist(), gain.tolist(), before.tolist(), strict=True):
        first, low, high = w, lo, lo + g
        while stack:
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:  # the nearest candidate that starts lower
                k -= 1
            if k < 0 or stack[k][3] >= high:
                break
            first, low = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append([first, w, low, high])
    return [(a, b, high - low) for a, b, low, high in stack]


@dataclass
class Model:
    """Sorted word hashes and their scores; `other` is any other word's score."""

    keys: np.ndarray
    scores: np.ndarray
    other: float
    rate: float  # lambda
    log_k: float
    weights: tuple[float, float, float]

    def word_scores(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(key), self.other)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.scores[at], self.other)

    def scored(self, data: np.ndarray, offsets: np.ndarray):
        """Words of a block with their scores, cumulative totals, the positive ones and each text's bounds in both.

        A word that stood within the REPEAT words before scores the drift only: repetition on the spot is no new evidence.
        """
        start, end, key, row = words(data, offsets)
        s = self.word_scores(key)
        up = np.flatnonzero(s > 0)
        which = mix(key[up] + mix(row[up].astype(np.uint64)))
        order = np.argsort(which, kind="stable")
        again = np.zeros(len(up), bool)
        again[order[1:]] = (which[order[1:]] == which[order[:-1]]) & (np.diff(up[order]) <= REPEAT)
        s[up[again]] = -DRIFT
        up = up[~again]
        first = np.searchsorted(row, np.arange(len(offsets)))
        return start, end, s, np.cumsum(s) - s, up, first, np.searchsorted(up, first)

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list]:
        """Per text: top segment's log-significance and the sum of all significant ones'; its passages as bytes."""
        start, end, s, total, up, first, bounds = self.scored(data, offsets)
        out, found = np.zeros((len(offsets) - 1, 2)), []
        out[:, 0] = -10.0
        for k in range(len(offsets) - 1):
            own, n = up[bounds[k] : bounds[k + 1]], first[k + 1] - first[k]
            kept = []
            if len(own):
                law = self.log_k + np.log(n)
                top, extra = -10.0, 0.0
                for a, b, x in segments(own, s[own], total[own]):
                    z = self.rate * x - law
                    top = max(top, z)
                    if z > -np.log(SIGNIFICANT):
                        extra += z
                        kept.append((int(start[a] - offsets[k]), int(end[b] - offsets[k]), x))
                out[k] = max(top, -10.0), extra
            found.append(kept)
        return out, found

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        a, b, c = self.weights
        return 1 / (1 + np.exp(-np.clip(a + b * evidence[:, 0] + c * np.log1p(evidence[:, 1]), -60, 60)))


def _sample_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Words of the sample, sorted, and how many of its documents have each: a row for the toxic and the clean ones of
    each half. Bounded as the sample is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            _, _, key, row = words(data, offsets)
            order = np.lexsort((row, key))
            k, r = key[order], row[order]
            once = np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
            k, r = k[once], r[once]
            kind = 2 * rows.column("half").to_numpy()[r] + 1 - rows.column("label").to_numpy()[r]
            word, at = np.unique(k, return_inverse=True)
            n = np.bincount(at * 4 + kind, minlength=4 * len(word)).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in n)], names=["word", *names])

    names = ["toxic0", "clean0", "toxic1", "clean1"]
    counts = texts.mapInArrow(run, "word long, " + ", ".join(f"{n} int" for n in names)).groupBy("word").agg(*[F.sum(n).cast("int").alias(n) for n in names])
    table = counts.toArrow()
    word = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], np.stack([table.column(n).to_numpy()[order] for n in names])


def _corpus_counts(docs: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Occurrences of each of `keys` (sorted) in all texts, and of all words: one array per task, then summed."""
    known = docs.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ks = known.value
        total = np.zeros(len(ks) + 1, np.int64)
        for _, data, offsets in text_blocks(batches, "text"):
            key = words(data, offsets)[2]
            total[-1] += len(key)
            if len(ks):
                at = np.minimum(np.searchsorted(ks, key), len(ks) - 1)
                total[:-1] += np.bincount(at[ks[at] == key], minlength=len(ks))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["word", "n"])

    found = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(keys) + 1, np.int64)
    out[found.column("word").to_numpy()] = found.column("n").to_numpy()
    return out[:-1], int(out[-1])


def _rate(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(rate s) = 1; there is one if the mean is negative and a score positive."""
    seen = p > 0
    p, s = p[seen], s[seen]
    if not (s > 0).any() or p @ s >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while high < 64 and p @ np.exp(high * s) < 1:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float, float]:
    a = np.column_stack([np.ones(len(x)), x[:, 0], np.log1p(x[:, 1])])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(3)
        w += np.linalg.solve(h, a.T @ (y - p) - ridge * w)
    return tuple(float(v) for v in w)


def _word_model(keys: np.ndarray, toxic: np.ndarray, clean: np.ndarray, corpus: np.ndarray, every: int) -> Model:
    """Scores of words and the rate, from the documents of each kind that have them and the words' corpus counts.

    Words that score as any other word does are not kept: their scores are what the model gives without them.
    """
    seen = toxic + clean > 0
    keys, corpus, t, c = keys[seen], corpus[seen], toxic[seen].astype(float), clean[seen].astype(float)
    if not t.sum() or not c.sum():
        return Model(np.zeros(0, np.uint64), np.zeros(0), -DRIFT, 1.0, 0.0, (-4.0, 0.0, 0.0))
    prior = PRIOR * corpus / max(every, 1) + 0.5
    nt, nc = max(t.max(), 1) + PRIOR, max(c.max(), 1) + PRIOR  # documents of each kind: the commonest word is in nearly all
    odds = lambda y, n: np.log((y + prior) / np.maximum(n - y - prior, 0.5))
    delta = odds(t, nt) - odds(c, nc)
    error = np.sqrt(1 / (t + prior) + 1 / (c + prior))
    solid = np.sign(delta) * np.maximum(np.abs(delta) - ERRORS * error, 0)
    scores = np.clip(solid, LEAST, MOST) - DRIFT
    # lambda: over clean words; those outside the vocabulary have the score `other`
    clean = corpus * (c / np.maximum(t + c, 1))
    p = np.append(clean, max(every - corpus.sum(), 0)) / max(every - (corpus - clean).sum(), 1)
    rate, own = _rate(p, np.append(scores, -DRIFT)), solid != 0
    return Model(keys[own], scores[own], -DRIFT, rate, 0.0, (0.0, 1.0, 0.0))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from labels.toxic outside the held-out fold. Without labelled rows of both kinds nothing is toxic."""
    half = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2)).cast("int")
    texts = written(labelled_texts(docs, sample_of(labels, "toxic", folds, held_out, sample_rows)).withColumn("half", half), "toxic-sample")
    keys, (t0, c0, t1, c1) = _sample_counts(texts)
    corpus, every = _corpus_counts(docs, keys)
    model = _word_model(keys, t0 + t1, c0 + c1, corpus, every)
    if not len(model.keys):
        return model
    # each half is seen by the model of the other
    frozen = docs.sparkSession.sparkContext.broadcast([_word_model(keys, t1, c1, corpus, every), _word_model(keys, t0, c0, corpus, every)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            own = rows.column("half").to_numpy()
            n, best, rate, sums = (np.zeros(len(own)) for _ in range(4))
            for h, m in enumerate(frozen.value):
                _, _, s, total, up, first, bounds = m.scored(data, offsets)
                for k in np.flatnonzero(own == h):
                    mine = up[bounds[k] : bounds[k + 1]]
                    found = [x for *_, x in segments(mine, s[mine], total[mine])]
                    n[k], best[k], rate[k], sums[k] = first[k + 1] - first[k], max(found, default=0.0), m.rate, sum(x for x in found if m.rate * x > 1)
            yield pa.RecordBatch.from_arrays([rows.column("label"), *(pa.array(v) for v in (n, best, rate, sums))], names=["label", "n", "best", "rate", "sums"])

    seen = texts.mapInArrow(run, "label int, n double, best double, rate double, sums double").toPandas().sort_values(["label", "n", "best"])
    plain = seen[(seen.label == 0) & (seen.n > 0) & (seen.best > 0)]
    if len(plain):  # a Gumbel variable's mean is its location plus Euler's constant
        model.log_k = float((plain.rate * plain.best - np.log(plain.n)).mean() - 0.5772156649)
    law = model.log_k + np.log(np.maximum(seen.n, 1))
    top = np.where(seen.best > 0, np.maximum(seen.rate * seen.best - law, -10), -10)
    more = np.where(top > -np.log(SIGNIFICANT), np.maximum(seen.rate * seen.sums - law, 0), 0)
    a, b, c = _logistic(np.column_stack([top, more]), seen.label.to_numpy(float))
    model.weights = (a, max(b, 1e-3), max(c, 0.0))  # more evidence never lowers a score
    forget(texts)
    return model


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), suffix: str = "") -> DataFrame:
    """The `keep` columns of every row, then score, predicted, n_passages and passages (begin, end byte, score).

    A null or empty text has no passage and the lowest score. Repeated rows are scored each, an empty table gives
    no rows; `suffix` is put behind the new columns' names where `keep` has columns of those names.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(model)
    columns = list(dict.fromkeys([*keep, "text"]))
    schema = docs.select(*keep).schema
    new = [f"{c}{suffix}" for c in ("score", "predicted", "n_passages", "passages")]
    for c, kind in zip(new, ("double", "integer", "integer", PASSAGES), strict=True):
        schema = schema.add(c, kind)
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            x, found = frozen.value.evidence(data, offsets)
            p = frozen.value.probability(x)
            lists = pa.array([[{"begin": a, "end": b, "score": s} for a, b, s in f] for f in found], span)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([len(f) for f in found], pa.int32()), lists],
                names=schema.names,
            )

    return docs.select(*columns).mapInArrow(run, schema)


def with_fold(docs: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    return docs.withColumn("held_out", in_fold("doc_id", folds, held_out))
