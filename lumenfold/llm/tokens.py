"""Token ids of whole texts by the tokenizers library, with each distinct pre-token encoded once per task.

A byte-level BPE works on pre-tokens. Their bounds are found with numpy over a block of texts, equal ones become one
by their bytes (Arrow's dictionary encoding), and only pre-tokens that the task has not met yet go to the library's
model; ids of the rest are gathered from arrays. A hash only says where to look: the bytes of what is found are
compared. Texts with characters outside ASCII and the Latin letters U+00C0 to U+027F, whose
classes need Unicode tables, or with a special token's string go to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .common import binary_buffer, content_hashes, equal_bytes, ragged

#: Distinct pre-tokens that a task remembers, and their bytes at most; beyond either the memory starts anew.
MEMORY, MEMORY_BYTES = 1_000_000, 32 << 20
OTHER, LETTER, DIGIT, SPACE = range(4)


def _classes() -> np.ndarray:
    c = np.zeros(256, np.uint8)
    c[65:91] = c[97:123] = c[128:] = LETTER
    c[48:58] = DIGIT
    c[9:14] = c[32] = SPACE
    return c


CLASSES = _classes()


def stand_ins() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def pretoken_starts(b: np.ndarray, row_start: np.ndarray) -> np.ndarray:
    """Mask of the bytes at which a pre-token starts; row_start marks rows' first bytes (texts of plain characters)."""
    n = len(b)
    cls = CLASSES[b]
    space = cls == SPACE
    start = row_start.copy()
    start[1:] |= cls[1:] != cls[:-1]
    ends_row = np.append(row_start[1:], True)
    joined = np.zeros(n, bool)  # follows one blank, which belongs to this pre-token
    joined[1:] = (b[:-1] == 32) & ~space[1:]
    joined &= ~row_start
    start &= ~joined
    last = space & ~ends_row  # a run's last blank stands apart if something follows it in the text
    last[:-1] &= ~space[1:]
    start |= last
    # contractions: an apostrophe that starts a pre-token, then s t m d or re ve ll
    at = np.flatnonzero((b == 39) & start & ~joined)
    if len(at):
        padded = np.concatenate([b, np.zeros(2, np.uint8)])
        open_ = np.concatenate([~row_start, np.zeros(2, bool)])
        x, y = padded[at + 1], padded[at + 2]
        one = open_[at + 1] & np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = open_[at + 1] & open_[at + 2] & (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108))
        for k, hit in ((2, at[one]), (3, at[two & ~one])):
            for j in range(1, k):
                start[hit + j] = False
            hit = hit + k
            start[hit[hit < n]] = True
    return start


def _expect_plain_bytes(file: dict) -> None:
    """Raises unless a tokenizer file is a byte-level BPE as `pretoken_starts` splits texts: no normalizer, no prefix space."""
    steps = file.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    plain = len(steps) == 1 and steps[0].get("type") == "ByteLevel" and not steps[0].get("add_prefix_space") and steps[0].get("use_regex", True)
    if file.get("normalizer") or not plain or file["model"].get("type") != "BPE":
        raise ValueError("the tokenizer must be a byte-level BPE with no normalizer, no prefix space and the usual splitting")


class Growing:
    """A one-dimensional array that grows at its end."""

    def __init__(self, kind, values=()):
        self.held, self.used = np.zeros(1 << 12, kind), 0
        self.extend(np.asarray(values, kind))

    def extend(self, values: np.ndarray) -> None:
        while self.used + len(values) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.used : self.used + len(values)] = values
        self.used += len(values)

    def all(self) -> np.ndarray:
        return self.held[: self.used]

    def last(self):
        return self.held[self.used - 1]

    def __len__(self) -> int:
        return self.used

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.held[at]


class Encoder:
    """encode(data, offsets) -> ids (uint32) of all rows and the n + 1 offsets of rows in them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        _expect_plain_bytes(json.loads(self.library.to_str()))
        self.model = self.library.model
        self.table = dict(enumerate(stand_ins()))
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes and what they stand for
        self.text, self.text_at = Growing(np.uint8), Growing(np.int64, [0])  # the pre-tokens met, and where each ends
        self.ids, self.ids_at = Growing(np.uint32), Growing(np.int64, [0])

    def _model_ids(self, pretoken: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(pretoken.decode("latin-1").translate(self.table))]

    def _learn(self, data: np.ndarray, first: np.ndarray, size: np.ndarray, keys: np.ndarray) -> None:
        text = data.tobytes()
        found = [self._model_ids(text[s:e]) for s, e in zip(first.tolist(), (first + size).tolist(), strict=True)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        known = len(self.text_at) - 1
        self.text.extend(data[ragged(first, size)])
        self.text_at.extend(self.text_at.last() + np.cumsum(size))
        self.ids.extend(np.fromiter((i for x in found for i in x), np.uint32, int(n.sum())))
        self.ids_at.extend(self.ids_at.last() + np.cumsum(n))
        where = np.searchsorted(self.keys, keys)
        self.slot = np.insert(self.slot, where, known + np.arange(len(keys)))
        self.keys = np.insert(self.keys, where, keys)

    def _slots(self, data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The places of distinct pre-tokens among those met; -1 where another one with the same hash was met before."""
        key = content_hashes(data, first, size)
        alone, at = np.unique(key, return_index=True)  # of two with one hash the first is learned
        if len(self.keys) + len(alone) > MEMORY or len(self.text) + len(data) > MEMORY_BYTES:
            self._forget()
        new = ~np.isin(alone, self.keys, assume_unique=True)
        if new.any():
            self._learn(data, first[at[new]], size[at[new]], alone[new])
        slot = self.slot[np.searchsorted(self.keys, key)]
        begin, end = self.text_at[slot], self.text_at[slot + 1]
        same = end - begin == size
        own = np.flatnonzero(same)
        differs = data[ragged(first[own], size[own])] != self.text[ragged(begin[own], size[own])]
        if differs.any():
            same[own[np.repeat(np.arange(len(own)), size[own])[differs]]] = False
        return np.where(same, slot, -1)

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mask of rows whose characters all have known classes."""
        n = len(data)
        odd = ((data >= 0x80) & (data < 0xC3) & (np.append(np.uint8(0), data[:-1]) < 0xC3)) | (data > 0xC9)
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        bad = np.concatenate([[0], np.cumsum(odd)])
        plain = bad[offsets[1:]] == bad[offsets[:-1]]
        if n:
            text = data.tobytes()
            for s in self.special:
                at = text.find(s)
                while at >= 0:
                    plain[np.searchsorted(offsets, at, side="right") - 1] = False
                    at = text.find(s, at + 1)
        return plain

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain = self._plain(data, offsets)
        if not plain.all():
            return self._mixed(data, offsets, plain)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        row_start = np.zeros(n + 1, bool)
        row_start[offsets[:-1]] = True
        starts = np.flatnonzero(pretoken_starts(data, row_start[:n]))
        which, pretokens = equal_bytes(data, np.append(starts, n))
        text, at = binary_buffer(pretokens)
        slot = self._slots(text, at[:-1], np.diff(at))
        begin, end, ids = self.ids_at[slot], self.ids_at[slot + 1], self.ids.all()
        for k in np.flatnonzero(slot < 0).tolist():  # hash met with other bytes: encoded anew
            own = np.array(self._model_ids(text[at[k] : at[k + 1]].tobytes()), np.uint32)
            begin[k], end[k] = len(ids), len(ids) + len(own)
            ids = np.concatenate([ids, own])
        size = (end - begin)[which]
        upto = np.concatenate([[0], np.cumsum(size)])
        return ids[ragged(begin[which], size)], upto[np.searchsorted(starts, offsets)]

    def _mixed(self, data: np.ndarray, offsets: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.diff(offsets)
        own = data[np.repeat(plain, size)]
        ids, at = self.encode(own, np.concatenate([[0], np.cumsum(size[plain])]))
        text = data.tobytes()
        rest = [text[offsets[k] : offsets[k + 1]].decode() for k in np.flatnonzero(~plain)]
        coded = iter(self.library.encode_batch_fast(rest, add_special_tokens=False))
        own_rows = iter(range(int(plain.sum())))
        parts = []
        for p in plain:
            if p:
                k = next(own_rows)
                parts.append(ids[at[k] : at[k + 1]])
            else:
                parts.append(np.asarray(next(coded).ids, np.uint32))
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
