"""MinHash near-duplicates: improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words (a shorter text is one shingle); its weight is its count in the document
times its inverse document frequency. Frequencies are counted over all documents in a hashed table of fixed size,
less what an entry holds of rare shingles on average; a shingle in fewer than one of RAREST documents is as rare as
one in that many, so rarity means the same at every size. Each of BANDS x ROWS consistent samples picks one shingle
and one weight level, equal for two documents with probability equal to their weighted Jaccard similarity. Documents
that agree on a band meet; candidates are compared by exact weighted Jaccard, and verified links form classes.

Within a band group every member is first compared with the group's leader. A group that is one component then is
done, as classes need no further link. In a group that is not, members of different components are candidates: all
of them where the group is small; in larger groups those that share one of their rarest shingles, which every pair at
the threshold does (`prefixes`), and whose weights and places of that shingle allow the threshold.

Scale: equal texts are one representative. Groups are reduced by partial aggregates and never collected; a leader of
very many pairs is dealt out to several tasks. Texts lie in buckets of doc_id, so only those of candidates move.
Results are classes, so copies are never paired off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPREAD, U64, bucketed, buckets_for, forget, groups_of, mix, text_blocks, text_buffer, with_key, words, written
from .components import components

WORDS, THRESHOLD = 5, 0.8
#: At similarity 0.8 a pair meets in some band with probability 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.997.
BANDS, ROWS = 8, 3
#: Members of a group up to which all are candidates; texts in a block of numbers; pairs of one text that a task gets.
SMALL, BLOCK, SALTED = 16, 1024, 4096
#: Shingles before its own that an entry of `prefixes` names: what two texts share there has given the pair already.
BEFORE = 4
#: Shingles in fewer documents than one in this many count as in that many: rarity is told up to here at every size.
RAREST = 1024
#: Entries of the table of document frequencies, and of one row of it in the shuffle.
TABLE, SLICE = 1 << 20, 1 << 14
#: Bits of a shingle's id; the rest of 64 numbers the block's rows, so that one sort groups both.
ID_BITS = 46


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, count) of every distinct shingle of a block's texts, in order of row and id."""
    _, _, key, row = words(data, offsets)
    rows = len(offsets) - 1
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    padded = np.concatenate([key, np.zeros(WORDS, np.uint64)])
    place = np.arange(len(key)) - first[row]
    h = np.zeros(len(key), np.uint64)
    for k in range(WORDS):
        inside = place + k < n[row]
        h += np.where(inside, padded[k : k + len(key)], U64(0)) * U64(2 * k + 0x9E3779B97F4A7C15)
    starts = place + WORDS <= n[row]
    starts |= place == 0  # a shorter text's only shingle
    row, h = row[starts], mix(h[starts])
    both = np.sort((row.astype(np.uint64) << U64(ID_BITS)) | (h >> U64(64 - ID_BITS)))
    at = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    count = np.diff(np.append(at, len(both)))
    both = both[at]
    return (both >> U64(ID_BITS)).astype(np.int64), both & U64((1 << ID_BITS) - 1), count


def _entry(ids: np.ndarray) -> np.ndarray:
    return (ids % U64(TABLE)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """One slice of counts in the narrowest of 2, 4 or 8 bytes each: a task's counts are small."""
    top = int(counts.max(initial=0))
    return counts.astype("<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // SLICE}").astype(np.int64)


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each entry of the hashed table, from all rows: 4 MB whatever the corpus."""
    schema = "slice int, counts binary, rows long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(TABLE, np.int64), 0
        for block, data, offsets in text_blocks(batches, "text"):
            total += np.bincount(_entry(shingles(data, offsets)[1]), minlength=TABLE)
            rows += block.num_rows
        yield from sliced(total, rows)

    def sliced(total: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
        n = TABLE // SLICE
        parts = [_packed(total[k * SLICE : (k + 1) * SLICE]) for k in range(n)]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(parts, pa.binary()), pa.array([rows] + [0] * (n - 1), pa.int64())], names=["slice", "counts", "rows"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        rows: dict[int, int] = {}
        for b in batches:
            for s, c, r in zip(b.column("slice").to_pylist(), b.column("counts"), b.column("rows").to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + _unpacked(c.as_py())
                rows[s] = rows.get(s, 0) + r
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(v) for v in sums.values()], pa.binary()), pa.array(list(rows.values()), pa.int64())], names=["slice", "counts", "rows"])

    summed = docs.select("text").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect()
    df, n = np.zeros(TABLE), 0
    for r in summed:
        df[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = _unpacked(bytes(r["counts"]))
        n += r["rows"]
    df -= df.sum() / TABLE  # what an entry holds of rare shingles on average
    return (1 + np.log((1 + n) / (1 + np.clip(df, max(1.0, n / RAREST), max(n, 1))))).astype(np.float32)


def _quantiles(n: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Gamma(2, 1) at n even quantiles and its logarithm: 1 - (1 + x) exp(-x) = u, by bisection."""
    u = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low.astype(np.float32), np.log(low).astype(np.float32)


_TABLES: list[np.ndarray] = []


def samples(row: np.ndarray, ids: np.ndarray, weight: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and k consistent weighted samples of each.

    For shingle s with weight w: r, c from Gamma(2, 1) and b uniform, all fixed by s and the sample's number;
    t = floor(ln w / r + b), and the shingle with the least c exp(-r (t - b) - r) is the sample (s, t).
    """
    if not _TABLES:
        _TABLES.extend(_quantiles())
    gamma, log_gamma = _TABLES
    if not len(row):
        return np.zeros(0, np.int64), np.zeros((0, k), np.uint64)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    size = np.diff(np.append(first, len(row)))
    log_w = np.log(weight).astype(np.float32)
    out = np.zeros((len(first), k), np.uint64)
    for j in range(k):
        h = ids * U64(0x9E3779B97F4A7C15) + U64((0xD1B54A32D192ED03 * (j + 1)) & 0xFFFFFFFFFFFFFFFF)
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
        r = gamma[(h & U64(0xFFFF)).astype(np.int64)]
        log_c = log_gamma[((h >> U64(16)) & U64(0xFFFF)).astype(np.int64)]
        b = (h >> U64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + b)
        a = log_c - r * (t - b + np.float32(1))
        low = np.minimum.reduceat(a, first)
        at = np.flatnonzero(a == np.repeat(low, size))
        at = at[np.searchsorted(at, first)]  # of equal ones the first
        out[:, j] = mix(ids[at] * U64(31) + t[at].astype(np.int64).view(np.uint64))
    return row[first], out


def bands(docs: DataFrame, idf: np.ndarray, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """doc_id, band, key, own (share of the weight in the rarest shingles): one row per band of every row with a shingle."""
    table = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in text_blocks(batches, "text"):
            row, ids, count = shingles(data, offsets)
            rarity = table.value[_entry(ids)]
            who, drawn = samples(row, ids, count * rarity, block.num_rows, n_bands * n_rows)
            own = np.bincount(row, count * (rarity == table.value.max()), minlength=block.num_rows)[who] / np.bincount(row, count, minlength=block.num_rows)[who]
            h = np.zeros((len(who), n_bands), np.uint64)
            for j in range(n_rows):
                h = mix(h * U64(3) + drawn[:, j::n_rows] + U64(1))
            doc = block.column("doc_id").take(pa.array(np.repeat(who, n_bands)))
            band = np.tile(np.arange(n_bands, dtype=np.int32), len(who))
            columns = [doc, pa.array(band), pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(own.astype(np.float32), n_bands))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "band", "key", "own"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, band int, key long, own float")


def similarity(pairs: DataFrame, idf: np.ndarray) -> DataFrame:
    """a, b, similarity of rows (a, b, text_a, text_b): exact weighted Jaccard of their TF-IDF shingles."""
    table = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _ in text_blocks(batches, "text_a", 1 << 19):
            weights = []
            for c in ("text_a", "text_b"):
                row, ids, count = shingles(*text_buffer(block.column(c)))
                weights.append(((row.astype(np.uint64) << U64(ID_BITS)) | ids, count * table.value[_entry(ids)].astype(float)))
            key = np.concatenate([w[0] for w in weights])
            order = np.argsort(key, kind="stable")
            key, w = key[order], np.concatenate([w[1] for w in weights])[order]
            twice = np.flatnonzero(key[1:] == key[:-1])
            pair = (key >> U64(ID_BITS)).astype(np.int64)
            shared = np.bincount(pair[twice], np.minimum(w[twice], w[twice + 1]), minlength=block.num_rows)
            every = np.bincount(pair, w, minlength=block.num_rows) - shared
            s = np.divide(shared, every, out=np.zeros(block.num_rows), where=every > 0)
            yield pa.RecordBatch.from_arrays([block.column("a"), block.column("b"), pa.array(s)], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double")


def _texts_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """doc_id, text of each representative, in buckets of doc_id: later joins on doc_id leave the texts where they are."""
    size = reps.agg(F.sum("size")).first()[0] or 0
    n = buckets_for(docs.sparkSession, size)
    named = reps.select(F.col("rep").alias("doc_id")).where("doc_id is not null").distinct()
    return bucketed(docs.repartition(n, "doc_id").join(named, "doc_id", "left_semi"), "doc_id", "texts", n)


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """a, b of those pairs (distinct) that reach the threshold.

    The texts of a stay in their buckets until they move to b's, once a pair. A b of very many pairs (a group's
    leader) is dealt out with copies of its text, so no task gets all pairs of one.
    """
    per = pairs.groupBy("b").count()
    total = per.agg(F.sum("count")).first()[0] or 0
    hot = F.broadcast(per.where(F.col("count") > max(SALTED, total // SPREAD)).select("b", F.ceil(F.col("count") / SALTED).alias("salts")))  # at most SPREAD rows
    salts = F.coalesce("salts", F.lit(1).cast("long"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    met = pairs.join(hot, "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), salts)).drop("salts").join(left, "a")
    heads = texts.join(per.select(F.col("b").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    heads = heads.join(hot, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("salts")
    near = similarity(met.join(heads, ["b", "salt"]), idf).where(F.col("similarity") >= threshold)
    return written(near.select("a", "b"), "verified")


def prefixes(texts: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, shingle, weight (of the whole text), most, before: the rarest shingles of each text, enough to find every partner.

    In order of rarity all that two texts share lies from their first common shingle on, so their overlap is at most
    what either has from there. `most` is the greatest weight of a partner that this still lets reach the threshold;
    shingles that leave no partner are not given, which are all but the first 1 - t of a text's weight. `before` names
    the BEFORE shingles that precede this one (-1: none); they are rows of the text too, with a larger `most`.
    """
    table = texts.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, offsets in text_blocks(batches, "text"):
            row, ids, count = shingles(data, offsets)
            rarity = table.value[_entry(ids)].astype(float)
            order = np.lexsort((ids, -rarity, row))
            row, ids, w = row[order], ids[order], (count * rarity)[order]
            total = np.bincount(row, w, minlength=block.num_rows)
            through = np.cumsum(w)
            ends = np.concatenate([[0.0], through])[np.searchsorted(row, np.arange(block.num_rows), side="right")]
            most = (ends[row] - through + w) * (1 + threshold) / threshold - total[row]
            near = most >= (threshold - 1e-9) * total[row]
            ids = ids.astype(np.int64)
            before = np.full((len(ids), BEFORE), -1, np.int64)
            for k in range(1, BEFORE + 1):
                before[k:, k - 1] = np.where(row[k:] == row[:-k], ids[:-k], -1)
            row, before = row[near], before[near]
            named = pa.ListArray.from_arrays(pa.array(np.arange(0, before.size + 1, BEFORE, dtype=np.int32)), pa.array(before.ravel()))
            columns = [block.column("doc_id").take(pa.array(row)), pa.array(ids[near]), pa.array(total[row]), pa.array(most[near]), named]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "shingle", "weight", "most", "before"])

    return texts.select("doc_id", "text").mapInArrow(run, "doc_id long, shingle long, weight double, most double, before array<long>")


def _sharing(entries: DataFrame) -> DataFrame:
    """a, b: pairs of different components that share a rare shingle and whose weights and places allow the threshold; few repeat.

    entries: rows of `prefixes` with the text's component c. Texts that no other text of the group can reach are left
    out first; a group is dealt out in pairs of blocks, so a task holds numbers of two blocks, and no texts. A pair is
    given at the first shingle it shares; it is left out at a later one if both name a common shingle before that, where
    it met on easier terms. So rows grow with the pairs, not with all that each pair shares.
    """
    slack = 1 + 1e-9
    per = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("weight").alias("least"), F.max("most").alias("furthest"))
    open_ = entries.join(per.where("lo < hi").drop("lo", "hi"), "shingle").where((F.col("least") <= F.col("most") * slack) & (F.col("weight") <= F.col("furthest") * slack))
    parts = F.ceil(F.col("n") / BLOCK)
    dealt = open_.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.select("shingle", "doc_id", "c", "weight", "most", "before", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, lo, hi), rows in groups_of(batches, "shingle", "lo", "hi"):
            doc, c, w, most, part = (rows.column(x).to_numpy() for x in ("doc_id", "c", "weight", "most", "part"))
            most = most * slack
            ok = (w <= most[:, None]) & (w[:, None] <= most) & (c != c[:, None]) & (doc[:, None] < doc)
            if lo != hi:  # pairs of one block meet where it is dealt out with itself
                ok &= part != part[:, None]
            i, j = np.nonzero(ok)
            if len(i):
                before = rows.column("before").combine_chunks().flatten().to_numpy().reshape(-1, BEFORE)
                again = np.zeros(len(i), bool)
                for x in before.T:
                    for y in before.T:
                        again |= (x[i] == y[j]) & (x[i] >= 0)
                i, j = i[~again], j[~again]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(doc[j])], names=["a", "b"])

    keys = ["shingle", "lo", "hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def _residue(filed: DataFrame, group: DataFrame, pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame | None:
    """a, b: links between components that share a band group and that the leaders did not join; None if there are none."""
    key = ["band", "key"]
    label = group.select(F.col("node").alias("doc_id"), F.col("component").alias("c"))
    named = filed.join(label, "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    open_ = named.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo < _hi").drop("_lo", "_hi")
    left = written(named.join(open_, key), "residue")
    if left.isEmpty():
        return None
    few = left.where(F.col("n") <= SMALL)
    one, two = (few.select(*key, F.col("doc_id").alias(d), F.col("c").alias(f"c_{d}")) for d in ("a", "b"))
    candidates = one.join(two, key).where("c_a <> c_b and a < b").select("a", "b")
    docs = written(left.where(F.col("n") > SMALL).select("doc_id", "c").distinct(), "residue-documents")
    if not docs.isEmpty():
        rare = prefixes(texts.join(docs.select("doc_id"), "doc_id", "left_semi"), idf, threshold)
        candidates = candidates.union(_sharing(written(rare.join(docs, "doc_id"), "prefixes")))
    done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    candidates = written(candidates.distinct(), "candidates")  # a pair shares many shingles: once before it is looked up
    out = _verified(candidates.join(done, ["a", "b"], "left_anti"), texts, idf, threshold)
    forget(left, docs, candidates)
    return out


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """digest (of a text), n (rows with it), class_id (smallest doc_id of the class): one row per distinct text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = docs.select("doc_id", F.md5("text").alias("digest"), F.octet_length("text").alias("size"))
    reps = written(hashed.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("size").cast("long").alias("size")), "text-classes")
    idf = inverse_frequencies(docs)
    texts = _texts_of(docs, reps)
    filed = written(bands(texts, idf), "bands")
    # two orders of preference, by the band's parity: the text with the least of its own, the nearest to all others, and any
    prefer = F.struct(F.when(F.col("band") % 2 == 0, F.col("own")), F.xxhash64("doc_id", F.col("band") % 2), "doc_id")
    leaders = filed.groupBy("band", "key").agg(F.min_by("doc_id", prefer).alias("b"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    leaders = leaders.where("lo < hi").select("band", "key", "b")
    met = written(filed.drop("own").join(leaders, ["band", "key"]), "groups")
    pairs = written(met.where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct(), "candidates")
    links = _verified(pairs, texts, idf, threshold)
    group = components(links)
    more = _residue(met.drop("b"), group, pairs, texts, idf, threshold)
    if more is not None and not more.isEmpty():
        group = components(links.union(more))
    out = written(reps.join(group, reps.rep == group.node, "left").select("digest", "n", F.coalesce("component", "rep").alias("class_id")), "classes")
    forget(reps, filed, met, pairs, links, texts)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), kept (doc_id = class_id) of every row.

    Equal texts are one class; a null text equals an empty one. Texts without words link with equal texts only. A
    null doc_id is in its text's class but never names one; where all are null the class is null and its rows are
    kept. Repeated rows are rows of one class; rows with one id and several texts link as one document. An empty
    table gives no rows; other columns are ignored.
    """
    out = with_key(_digests(docs), classes(docs, threshold), "digest", "n").select("doc_id", "class_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull()))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` (all columns) that stand for their class: the smallest doc_id's, once where it repeats.

    Texts move by doc_id, which is even, not by digest, which a large group of copies shares.
    """
    named = classes(docs, threshold)
    heads = named.select(F.col("class_id").alias("doc_id")).where("doc_id is not null").distinct()
    out = docs.join(heads, "doc_id", "left_semi").select(*docs.columns)
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    if not ids.where("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    nameless = docs.where("doc_id is null")
    if nameless.isEmpty():
        return out
    alone = named.where("class_id is null").select("digest")
    own = nameless.withColumn("_digest", F.md5(F.coalesce("text", F.lit(""))))
    own = own.join(alone, own["_digest"] == alone["digest"], "left_semi").dropDuplicates(["_digest"])
    return out.unionByName(own.select(*docs.columns))
