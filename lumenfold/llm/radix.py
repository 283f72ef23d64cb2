"""An adaptive radix tree over byte keys whose length is a multiple of a fixed width, and its nodes at whole depths.

A tree node holds the bytes that all keys below it share (path compression) and its children by their next byte, in
the smallest of four layouts that has room: up to 4 or 16 sorted bytes, an index of 256 bytes into up to 48 children,
or 256 places. `walk` gives an entry for every prefix of a whole number of units, also inside a compressed path.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

#: Children that each layout has room for.
LAYOUTS = (4, 16, 48, 256)
#: Bytes of a unit of the keys, and of the hash that names a prefix.
UNIT = 16


class Node:
    __slots__ = ("prefix", "value", "room", "keys", "kids")

    def __init__(self, prefix: bytes, value=None):
        self.prefix, self.value = prefix, value
        self.room, self.keys, self.kids = LAYOUTS[0], bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.room == 256:
            return self.kids[byte]
        if self.room == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        at = self.keys.find(byte)
        return self.kids[at] if at >= 0 else None

    def children(self) -> list[tuple[int, Node]]:
        """In order of their bytes."""
        if self.room == 256:
            return [(b, kid) for b, kid in enumerate(self.kids) if kid is not None]
        if self.room == 48:
            return [(b, self.kids[at - 1]) for b, at in enumerate(self.keys) if at]
        return list(zip(self.keys, self.kids, strict=True))

    def add(self, byte: int, kid: Node) -> None:
        if self.room < 256 and len(self.kids) == self.room:
            self._grow()
        if self.room == 256:
            self.kids[byte] = kid
        elif self.room == 48:
            self.kids.append(kid)
            self.keys[byte] = len(self.kids)
        else:
            at = bisect_left(self.keys, byte)
            self.keys.insert(at, byte)
            self.kids.insert(at, kid)

    def _grow(self) -> None:
        held = self.children()
        self.room = LAYOUTS[LAYOUTS.index(self.room) + 1]
        if self.room >= 48:
            self.keys, self.kids = bytearray(256 if self.room == 48 else 0), [None] * (256 if self.room == 256 else 0)
            for byte, kid in held:
                self.add(byte, kid)

    def split(self, at: int) -> None:
        """Leaves the first `at` bytes of the prefix here; the next leads to a node with what was here."""
        below = Node(self.prefix[at + 1 :], self.value)
        below.room, below.keys, below.kids = self.room, self.keys, self.kids
        byte, self.prefix, self.value = self.prefix[at], self.prefix[:at], None
        self.room, self.keys, self.kids = LAYOUTS[0], bytearray(), []
        self.add(byte, below)


def _agree(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


class Tree:
    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, value) -> None:
        if self.root is None:
            self.root = Node(key, value)
            return
        node, at = self.root, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                node.split(_agree(prefix, key[at : at + len(prefix)]))
            at += len(node.prefix)
            if at == len(key):
                node.value = value
                return
            kid = node.child(key[at])
            if kid is None:
                node.add(key[at], Node(key[at + 1 :], value))
                return
            node, at = kid, at + 1


@dataclass(slots=True)
class Member:
    """What a key stands for: copies of it, the smallest id among them, weight of each unit, and a digest of all ids."""

    copies: int
    smallest: int | None
    weights: list[int]
    ends: str


@dataclass(slots=True)
class Entry:
    """A prefix of `depth` units. Sums reach over the tree's own keys; `spans`: another tree may have the prefix too."""

    name: bytes
    depth: int
    smallest: int | None
    copies: int
    children: int
    leaves: int
    saved: int
    ends: str | None
    spans: bool
    parent: Entry | None = None


def least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


class _Frame:
    """A tree node on the way down, with what its children have given so far."""

    __slots__ = ("node", "depth", "names", "hash", "rest", "left", "right", "todo", "copies", "smallest", "leaves", "saved", "own", "grown", "weights", "open")

    def __init__(self, node: Node, edge: bytes, above: _Frame | None, left: bool, right: bool):
        self.node, self.left, self.right = node, left, right
        self.hash = above.hash.copy() if above else hashlib.sha256()
        self.depth = above.depth if above else 0
        path = (above.rest if above else b"") + edge + node.prefix
        whole = len(path) // UNIT
        self.names = [] if above else [(0, self.hash.digest()[:UNIT])]
        for k in range(whole):
            self.hash.update(path[k * UNIT : (k + 1) * UNIT])
            self.names.append((self.depth + k + 1, self.hash.digest()[:UNIT]))
        self.depth, self.rest = self.depth + whole, path[whole * UNIT :]
        kids = node.children()
        self.todo = [(b, kid, left and not k and node.value is None, right and k == len(kids) - 1) for k, (b, kid) in enumerate(kids)][::-1]
        member = node.value
        self.copies, self.smallest, self.weights = (member.copies, member.smallest, member.weights) if member else (0, None, None)
        self.leaves = self.saved = self.own = 0
        self.grown, self.open = False, []


def walk(tree: Tree, before: int = -1, after: int = -1) -> Iterator[Entry]:
    """Every prefix of whole units, after the ones below it; its parent is filled in by the time the walk ends.

    Trees over consecutive ranges of sorted keys: `before` and `after` say how many units the first key shares with the
    last key of the tree before, and the last with the first of the tree after (-1: there is none). A prefix that two
    trees have counts as a child, and once less for `saved`, in the first of them only, and a key that the next tree
    goes on from is no leaf; so entries of one prefix are added up over trees.
    """
    if tree.root is None:
        return
    stack = [_Frame(tree.root, b"", None, True, True)]
    while stack:
        f = stack[-1]
        if f.todo:
            byte, kid, left, right = f.todo.pop()
            stack.append(_Frame(kid, bytes([byte]), f, left, right))
            continue
        stack.pop()
        member = f.node.value
        for depth, name in reversed(f.names):
            first = not (f.left and depth <= before)  # no tree before has it
            if not f.grown and not (f.right and depth == after):
                f.leaves += 1
            if depth:
                f.saved += (f.copies - first) * f.weights[depth - 1]
            ends = member.ends if member and depth == f.depth else None
            entry = Entry(name, depth, f.smallest, f.copies, f.own, f.leaves, f.saved, ends, not first or (f.right and depth <= after))
            for below in f.open:
                below.parent = entry
            f.grown, f.own, f.open = True, int(first), [entry]
            yield entry
        if stack:
            up = stack[-1]
            up.copies, up.smallest = up.copies + f.copies, least(up.smallest, f.smallest)
            up.leaves, up.saved, up.own = up.leaves + f.leaves, up.saved + f.saved, up.own + f.own
            up.grown, up.weights = up.grown or f.grown, up.weights or f.weights
            up.open += f.open
