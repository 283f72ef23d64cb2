"""Token counts by a linear longest-match automaton.

Greedy word pieces need the longest vocabulary entry at every position. A trie with failure links finds the
pieces of a word in one left-to-right pass: when no child matches, the failure link of a node leads to the
state that remains after popping the pieces that are then certain. Only counts are asked for, so each link
carries the number of pieces it pops and no piece is ever built.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_blocks
from .tokens import stand_ins

#: Runs of word bytes, and of the others, in a text without blanks.
RUNS = re.compile(b"([%b]+)|[^%b]+" % ((re.escape(bytes(x for x in range(256) if WORD[x])),) * 2))
#: Longest string between blanks whose count is remembered.
LONGEST = 64
#: Words whose counts a task remembers; beyond it the memory starts anew (a matter of speed only).
MEMORY = 1 << 18
#: Byte that marks a word's first piece: pieces that begin with it match only there.
MARK = 0x20


def load_pieces(path: str) -> list[bytes]:
    """Vocabulary entries of a byte-level BPE file (its printable stand-ins turned back to bytes), without special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    back = {c: b for b, c in enumerate(stand_ins())}
    return [bytes(back[c] for c in t) for t in spec["model"]["vocab"] if t not in special]


class Automaton:
    """count(word): pieces of greedy longest match on MARK + word, or on the word alone where it follows another without
    a blank; a word with an unmatched byte is 1 unknown piece.

    Entries are either word starts (MARK and then no MARK) or continuations (no MARK); others are ignored.
    """

    def __init__(self, pieces: Iterable[bytes]):
        starts, inner = [], []
        for p in set(pieces):
            if p[:1] == bytes([MARK]) and MARK not in p[1:]:
                starts.append(p)
            elif p and MARK not in p:
                inner.append(p)
        self.next: list[dict[int, int]] = [{}]  # node 0: between pieces
        is_piece = [False]
        for p in starts + inner:
            v = 0
            for b in p:
                v = self.next[v].setdefault(b, len(self.next))
                if v == len(self.next):
                    self.next.append({})
                    is_piece.append(False)
            is_piece[v] = True
        n = len(self.next)
        self.fail: list[int] = [-1] * n
        self.popped: list[int] = [0] * n
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in self.next[u].items():
                if is_piece[v]:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, k = self.fail[u], self.popped[u]
                    while z >= 0 and b not in self.next[z]:
                        k += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][b], k
                queue.append(v)

    def count(self, word: bytes, mark: bytes = bytes([MARK])) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        v, total = 0, 0
        for b in mark + word:
            while (t := step[v].get(b)) is None:
                if fail[v] < 0:
                    return 1
                total += popped[v]
                v = fail[v]
            v = t
        while v:
            if fail[v] < 0:
                return 1
            total += popped[v]
            v = fail[v]
        return total

    def counts(self, text: bytes) -> tuple[int, int]:
        """Words and pieces of a text without blanks: each run of word bytes or of others is matched by itself."""
        n_words = total = 0
        for run in RUNS.finditer(text):
            n_words += run[1] is not None
            total += self.count(run[0]) if run.start() == 0 else self.count(run[0], b"")
        return n_words, total


_LOADED: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _LOADED:
        _LOADED[path] = Automaton(load_pieces(path))
    return _LOADED[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, n_tokens of each row. Words are runs of ASCII letters, digits and bytes over 127.

    Tokens are the pieces of words and of the runs of punctuation and symbols between them, in their own case; only
    ASCII blanks (space, tab, line breaks) have none. The first run after a blank matches word starts, others continuations.
    Null and empty texts count 0; ids may be null or repeat (a row each). `vocabulary` is a path that every
    executor has. Map-only: no shuffle; a task holds the automaton and a bounded memory of words.
    """
    schema = docs.select(F.col(id_column)).schema.add("n_words", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, memory = automaton(vocabulary).counts, {}
        for rows, data, offsets in text_blocks(batches, text_column):
            text = data.tobytes()
            n_words, n_tokens = [], []
            for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                some = total = 0
                for w in text[i:j].split():
                    if (k := memory.get(w)) is None:
                        k = counts(w)
                        if len(w) <= LONGEST:
                            if len(memory) >= MEMORY:
                                memory.clear()
                            memory[w] = k
                    some += k[0]
                    total += k[1]
                n_words.append(some)
                n_tokens.append(total)
            yield pa.RecordBatch.from_arrays([rows.column(id_column), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=schema.names)

    return docs.select(id_column, text_column).mapInArrow(run, schema)
