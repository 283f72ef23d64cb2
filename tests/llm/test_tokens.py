import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import packing, token_counts, token_files, tokens
from lumenfold.llm.common import text_buffer
from lumenfold.llm.tokens import encoder

from .words import thue_morse

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = list("abst' re l vmd\n\t.,!1é_ß×²ñ\x0b\x1c") + ["'s", "'ll", "'re", " 't", "<|endoftext|>", "中", "😀", "  "]
DOCS = "doc_id long, text string, start string"
ROWS = [(3, "hello there, it's me"), (1, None), (2, ""), (7, "x " * 6000), (7, "x " * 6000), (None, "né 中 <|endoftext|>"), (5, "a" * 5000), (4, "\n\n  b")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), max_size=12))
def test_ids_equal_the_library(texts):
    code = encoder(PATH)
    ids, at = code.encode(*text_buffer(pa.array(texts, pa.string())))
    want = [e.ids for e in code.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == want


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_are_told_apart(spark, n):
    """Words that agree under every polynomial hash modulo 2**64 get their own ids, in one block and over tables."""
    texts = thue_morse(n)
    code = encoder(PATH)
    ids, at = code.encode(*text_buffer(pa.array(texts, pa.string())))
    want = [e.ids for e in code.library.encode_batch(list(texts), add_special_tokens=False)]
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(2)] == want and want[0] != want[1]
    docs = spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string").coalesce(1)
    for end, found in ((1, packing.pack(docs, PATH, window=1 << 14)), (2, token_files.round_trip(docs, PATH))):
        crc = {r.doc_id: r.ids_crc32 for r in found.collect()}
        assert crc == {k + 1: zlib.crc32(np.array([*w, end], "<u4").tobytes()) for k, w in enumerate(want)}


def test_ids_do_not_rest_on_the_hash(monkeypatch):
    """With a hash that nearly all pre-tokens share, and a memory that starts anew, ids are the library's."""
    monkeypatch.setattr(tokens, "content_hashes", lambda data, first, size: (size % 3).astype(np.uint64))
    monkeypatch.setattr(tokens, "MEMORY", 2)
    code = tokens.Encoder(PATH)
    for texts in (["one two three", "two's four", ""], ["six two one", "é one 中"], ["four six"]):
        ids, at = code.encode(*text_buffer(pa.array(texts, pa.string())))
        want = [e.ids for e in code.library.encode_batch(texts, add_special_tokens=False)]
        assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == want


def test_other_kinds_of_tokenizers_are_refused():
    plain = {"normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "model": {"type": "BPE"}}
    tokens._expect_plain_bytes(plain)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}, {"model": {"type": "WordPiece"}}):
        with pytest.raises(ValueError):
            tokens._expect_plain_bytes(plain | change)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=30))
def test_longest_match_equals_greedy(word):
    word = word.replace(b" ", b"")
    pieces = [b" a", b" ab", b"b", b"bc", b"bcd", b"c", b"d", b" ", b"ab", b"abcde", b"a"]
    vocabulary = {p for p in pieces}
    auto = token_counts.Automaton(pieces)
    text, n, i = b" " + word, 0, 0
    while i < len(text):
        sizes = [k for k in range(len(text) - i, 0, -1) if text[i : i + k] in vocabulary]
        if not sizes:
            n = 1
            break
        i, n = i + sizes[0], n + 1
    assert auto.count(word) == n


def test_longest_match_on_a_real_vocabulary():
    pieces = token_counts.load_pieces(PATH)
    vocabulary, auto = set(pieces), token_counts.automaton(PATH)
    for word in [b"hello", b"internationalisation", "größte".encode(), b"x" * 40, b"antidisestablishment", b""]:
        text, n = b" " + word, 0
        while text:
            k = next(k for k in range(len(text), 0, -1) if text[:k] in vocabulary)
            text, n = text[k:], n + 1
        assert auto.count(word) == n


def test_token_counts_of_all_rows(spark):
    out = token_counts.count_tokens(spark.createDataFrame([(*r, "clash") for r in ROWS], DOCS), PATH).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    assert by[1].n_tokens == by[2].n_words == 0 and by[7].n_words == 6000
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), PATH).count() == 0


def _ids(text, end):
    return [*encoder(PATH).library.encode(text or "", add_special_tokens=False).ids, end]


def test_packing_places_every_id_once(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in ROWS], DOCS).repartition(2)
    pieces = packing.pack(docs, PATH).collect()
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == np.cumsum([0, *[p.length for p in s]])[:-1].tolist()
        assert sum(p.length for p in s) <= 2048
    for doc_id, text in {(i, t) for i, t in ROWS if i != 7}:
        ids, own = _ids(text, 1), sorted((p for p in pieces if p.doc_id == doc_id), key=lambda p: p.start)
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert sum(p.length for p in own) == len(ids) == own[0].doc_tokens
        for p in own:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_packing_pads_little(spark):
    rng = np.random.default_rng(0)
    full = []
    packer = packing.SumOfSquares(2048, lambda s: full.append(sum(len(p[2]) for p in s)))
    total = 0
    for k in range(3000):
        n = int(rng.integers(1, 3000))
        total += n
        packer.add(k, np.zeros(n, np.uint32))
    assert sum(len(x) for x in packer.open) == packer.n_open < 2048  # with a level for each id, one window a level
    packer.close()
    assert sum(full) == total and len(full) * 2048 - total < 2048


def test_packing_chooses_the_least_sum_of_squares():
    """Against all levels tried by hand, and documents of at most a window stay whole until the end."""
    rng = np.random.default_rng(3)
    whole = []
    packer = packing.SumOfSquares(64, lambda s: whole.append(s))
    for k in range(2000):
        size = int(rng.integers(1, 65))

        def squares(h, size=size):
            after = packer.count.copy()
            after[h] -= h > 0
            after[h + size] += h + size < 64
            return int((after**2).sum())

        levels = [h for h in range(65 - size) if h == 0 or packer.count[h]]
        assert squares(packer.level(size)) == min(map(squares, levels))
        packer.add(k, np.zeros(size, np.uint32))
    assert all(start == 0 and len(ids) == n for s in whole for _, start, ids, n in s)


def test_packing_bounds_what_is_open():
    full = []
    packer = packing.SumOfSquares(64, lambda s: full.append(sum(len(p[2]) for p in s)), most_open=10)
    for k in range(500):
        packer.add(k, np.zeros(40, np.uint32))
        assert packer.n_open <= 10
    packer.close()
    assert sum(full) == 500 * 40 and len(full) * 64 - sum(full) < 64


def test_token_files_round_trip(spark):
    out = token_files.round_trip(spark.createDataFrame([(*r, "clash") for r in ROWS], DOCS), PATH).collect()
    rows = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (doc_id, text) in zip(sorted(out, key=lambda r: r.start), rows, strict=True):
        ids = _ids(text, 2)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_files.round_trip(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_token_files_are_read_from_their_path_alone(spark, tmp_path):
    docs = spark.createDataFrame([(*r, "clash") for r in ROWS], DOCS)
    want = sorted(map(tuple, token_files.round_trip(docs, PATH, path=f"{tmp_path}/files").collect()), key=str)
    got = token_files.read_files(spark.newSession(), f"{tmp_path}/files")
    assert sorted(map(tuple, got.collect()), key=str) == want
    texts = token_files.read_files(spark, f"{tmp_path}/files", ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in texts)


@pytest.mark.parametrize("seed", range(4))
def test_huffman_codes_and_blocks(seed):
    rng = np.random.default_rng(seed)
    counts = (rng.pareto(0.3, 500) * 10).astype(np.int64)
    counts[counts > 1 << 40] = 1 << 40
    for limit in (9, 12, 18):
        length = token_files.code_lengths(counts, limit)
        used = length[length > 0]
        assert ((counts > 0) == (length > 0)).all() and used.max() <= limit and (2.0**-used).sum() <= 1
    ids = rng.choice(500, 5000, p=counts / counts.sum())
    code, table = token_files.canonical_codes(length), token_files.decoding_table(length)
    for n in (0, 1, 255, 256, 257, 5000):
        payload, points = token_files.encode_block(ids[:n], code, length)
        assert token_files.decode_block(payload, n, points, table).tolist() == ids[:n].tolist()
        assert len(payload) == (length[ids[:n]].sum() + 7) // 8


def test_code_lengths_are_optimal_without_a_limit():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 0, 3])
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a + b
        heapq.heappush(heap, a + b)
    assert (token_files.code_lengths(counts) * counts).sum() == cost


def test_token_counts_of_punctuation_and_capitals(spark):
    texts = ["!!! ### {}", "Hello, World! It's (HERE)", "if (a[i] != 0) { x += 'Y'; }\n\treturn;", "| A | b |\n|---|---|", "größte, 中文! 😀", "a.b.c", "\x00\x01 Z", " \n\t ", "Q" * 300 + "..." * 50]
    vocabulary = set(token_counts.load_pieces(PATH))

    def brute(text):
        n = 0
        for part in text.encode().split():
            edges = [k for k in range(1, len(part)) if bool(token_counts.WORD[part[k]]) != bool(token_counts.WORD[part[k - 1]])]
            for k, (i, j) in enumerate(zip([0, *edges], [*edges, len(part)], strict=True)):
                rest = (b"" if k else b" ") + part[i:j]
                while rest:
                    longest = next(m for m in range(len(rest), 0, -1) if rest[:m] in vocabulary)
                    rest, n = rest[longest:], n + 1
        return n

    out = token_counts.count_tokens(spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], DOCS), PATH).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {k: brute(t) for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_words for r in out} == {0: 0, 1: 5, 2: 7, 3: 2, 4: 3, 5: 3, 6: 1, 7: 0, 8: 1}


def test_rows_without_ids_are_spread_over_shards(spark, tmp_path):
    """A third of all rows have no id, and many repeat: no shard gets all of them, and places stay gapless."""
    rows = [(None, f"text {k}") for k in range(200)] + [(5, "same text")] * 200 + [(k, f"own {k}") for k in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = token_files.round_trip(docs, PATH, path=str(tmp_path / "files")).collect()
    found.sort(key=lambda r: r.start)
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist() and len(found) == len(rows)
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in found), key=lambda x: (x is not None, x))
    per = spark.read.parquet(str(tmp_path / "files/shards")).agg({"n_tokens": "max", "shard": "count"}).first()
    assert per["max(n_tokens)"] < 0.5 * sum(r.n_tokens for r in found) and per["count(shard)"] == 4
