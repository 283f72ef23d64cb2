"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed with numpy over blocks of texts inside tasks. Trees are fitted on the
driver from a bounded sample of labelled documents (`labelled.SAMPLE_ROWS`), whose statistics are a few MB.
All trees lie in flat arrays, so a block of documents walks all of them level by level with array gathers.
Scoring is map-only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, text_blocks, words
from .labelled import in_fold, labelled_texts, sample_of

#: Bytes whose share of a text is a statistic, by group.
GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t",
    "newline": b"\n\r",
    "stop": b".,;:?",
    "shout": b"!",
    "symbol": b"#$%&*+<=>@^_~|\\/{}[]",
    "quote": b"\"'()-`",
    "high": bytes(range(128, 256)),
}
STATISTICS = [
    "log_bytes", "log_words", *GROUPS, "word_length", "word_length_sd", "short_words", "long_words", "new_words",
    "top_word", "new_trigrams", "line_bytes", "new_lines", "upper_words", "bytes_per_stop",
]


def _share_new(key: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: distinct keys over keys, and the most frequent key's share; 1 and 0 where there are none."""
    n = np.bincount(row, minlength=rows)
    order = np.lexsort((key, row))
    k, r = key[order], row[order]
    first = np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (r[1:] != r[:-1])])
    distinct = np.bincount(r[first], minlength=rows)
    at = np.flatnonzero(first)
    most = np.zeros(rows)
    np.maximum.at(most, r[at], np.diff(np.append(at, len(k))))
    d = np.maximum(n, 1)
    return np.where(n > 0, distinct / d, 1.0), most / d


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text; an empty text has zeros and shares of 1 for what is new."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    d = np.maximum(size, 1)
    out = {"log_bytes": np.log1p(size)}
    group = np.full(256, len(GROUPS), np.uint8)
    for g, members in enumerate(GROUPS.values()):
        group[np.frombuffer(members, np.uint8)] = g
    doc = np.repeat(np.arange(rows), size)
    table = np.bincount(doc * (len(GROUPS) + 1) + group[data], minlength=rows * (len(GROUPS) + 1)).reshape(rows, -1)
    for g, name in enumerate(GROUPS):
        out[name] = table[:, g] / d
    start, end, key, row = words(data, offsets)
    n = np.bincount(row, minlength=rows)
    dn = np.maximum(n, 1)
    length = (end - start).astype(float)
    out["log_words"] = np.log1p(n)
    mean = np.bincount(row, length, minlength=rows) / dn
    out["word_length"] = mean
    out["word_length_sd"] = np.sqrt(np.maximum(np.bincount(row, length**2, minlength=rows) / dn - mean**2, 0))
    out["short_words"] = np.bincount(row[length <= 3], minlength=rows) / dn
    out["long_words"] = np.bincount(row[length >= 12], minlength=rows) / dn
    out["new_words"], out["top_word"] = _share_new(key, row, rows)
    if len(key) > 2:
        same = row[2:] == row[:-2]
        tri = mix(key[:-2] * np.uint64(3) + mix(key[1:-1] * np.uint64(5) + mix(key[2:])))
        out["new_trigrams"] = _share_new(tri[same], row[2:][same], rows)[0]
    else:
        out["new_trigrams"] = np.ones(rows)
    # lines: a line's key is the sum of its words' keys times odd numbers by place
    breaks = np.flatnonzero(data == 10)
    line_of = np.searchsorted(breaks, start)
    new_line = np.concatenate([np.ones(min(1, len(start)), bool), (line_of[1:] != line_of[:-1]) | (row[1:] != row[:-1])])
    at = np.flatnonzero(new_line)
    if len(at):
        place = np.arange(len(start)) - np.repeat(at, np.diff(np.append(at, len(start))))
        sums = np.add.reduceat(mix(key + place.astype(np.uint64)), at)
        out["new_lines"] = _share_new(sums, row[at], rows)[0]
    else:
        out["new_lines"] = np.ones(rows)
    out["line_bytes"] = np.log1p(size / (1 + table[:, list(GROUPS).index("newline")]))
    out["upper_words"] = np.bincount(row[np.isin(data[start], np.frombuffer(GROUPS["upper"], np.uint8))], minlength=rows) / dn
    out["bytes_per_stop"] = np.log1p(size / (1 + table[:, list(GROUPS).index("stop")]))
    return np.column_stack([out[s] for s in STATISTICS]) if rows else np.zeros((0, len(STATISTICS)))


@dataclass
class Trees:
    """All nodes of all trees: a leaf points to itself."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.broadcast_to(self.root, (len(x), len(self.root))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-np.clip(self.base + self.value[node].sum(1), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, smooth: float = 1.0, least: int = 20) -> Trees:
    """Newton boosting of the logistic loss; splits are searched on per-node histograms of binned statistics."""
    n, f = x.shape
    prior = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for k in range(f)]
    binned = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)]) if n else np.zeros((0, f), int)
    margin = np.full(n, base)
    root, feature, threshold, left, right, value = [], [], [], [], [], []
    column = np.arange(f) * bins

    def node() -> int:
        k = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(k)
        right.append(k)
        value.append(0.0)
        return k

    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        root.append(node())
        at = np.full(n, root[-1])
        level = [root[-1]]
        for d in range(depth + 1):
            place = np.full(len(feature), -1)
            place[level] = np.arange(len(level))
            local = place[at]
            inside = local >= 0
            key = (local[inside, None] * f * bins + column + binned[inside]).ravel()
            shape = (len(level), f, bins)
            sums = [np.bincount(key, np.repeat(w[inside], f), minlength=int(np.prod(shape))).reshape(shape) for w in (g, h, np.ones(n))]
            gs, hs, ns = (s.cumsum(2) for s in sums)
            gt, ht, nt = (s[:, :1, -1:] for s in (gs, hs, ns))
            gain = gs**2 / (hs + smooth) + (gt - gs) ** 2 / (ht - hs + smooth) - gt**2 / (ht + smooth)
            gain[(ns < least) | (nt - ns < least)] = -1
            gain[:, :, -1] = -1
            best = gain.reshape(len(level), -1).argmax(1)
            following = []
            for i, k in enumerate(level):
                value[k] = rate * float(gt[i, 0, 0] / (ht[i, 0, 0] + smooth))
                j, b = divmod(int(best[i]), bins)
                if d == depth or gain[i, j, b] <= 1e-6 or b >= len(cuts[j]):
                    continue
                feature[k], threshold[k] = j, float(cuts[j][b])
                left[k], right[k] = node(), node()
                following += [left[k], right[k]]
                own = at == k
                at[own] = np.where(binned[own, j] <= b, left[k], right[k])
            level = following
            if not level:
                break
        margin += np.array(value)[at]
    pack = lambda v, t: np.array(v, t)
    return Trees(pack(root, np.int64), pack(feature, np.int64), pack(threshold, float), pack(left, np.int64), pack(right, np.int64), pack(value, float), depth, base)


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> Trees:
    """Trees from labels.quality outside the held-out fold; without labelled rows every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column("label"), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=["label", *STATISTICS])

    schema = "label int, " + ", ".join(f"{s} double" for s in STATISTICS)
    found = labelled_texts(docs, sample_of(labels, "quality", folds, held_out)).mapInArrow(run, schema).toPandas()
    found = found.sort_values(list(found.columns))  # rows arrive in any order: fit on one order
    return fit(found[STATISTICS].to_numpy(float), found["label"].to_numpy(float))


def score(docs: DataFrame, trees: Trees, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row. Null and empty texts are scored by their (empty) statistics.

    Other columns are ignored; repeated rows are scored each; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(trees)  # some thousand nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            s = model.value.score(statistics(data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select("doc_id", in_fold("doc_id", folds, held_out).alias("held_out"), "text")
    schema = source.select("doc_id", "held_out").schema.add("score", "double").add("predicted", "integer")
    return source.mapInArrow(run, schema)

