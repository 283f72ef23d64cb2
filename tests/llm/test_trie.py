import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import queries, radix, trie
from lumenfold.llm.common import read

WORDS = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "conv_id long, turn int, role string, text string, depth long, name string"


def test_layouts_grow():
    tree = radix.Tree()
    keys = [bytes([b]) + bytes(15) for b in range(256)]
    random.Random(1).shuffle(keys)
    rooms = []
    for k, key in enumerate(keys):
        tree.insert(key, k)
        rooms.append(tree.root.room)
        assert [bytes([b]) for b, _ in tree.root.children()] == sorted(x[:1] for x in keys[: k + 1]) if k else tree.root.prefix == key
    assert [rooms.index(r) + 1 for r in radix.LAYOUTS[1:]] == [5, 17, 49] and rooms[-1] == 256
    assert tree.root.child(7).value == keys.index(bytes([7]) + bytes(15))
    few = radix.Tree()
    for key in (b"abcdefgh" * 4, b"abcdefgh" * 2):
        few.insert(key, key)
    assert few.root.prefix == b"abcdefgh" * 2 and few.root.child(97).prefix == b"bcdefgh" + b"abcdefgh"


def brute(convs):
    """convs: {id: [(role, text), ...]}; rows of the contract."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        own = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in own) or 1
        saved[p] = sum(saved[k] for k in own) + ((len(nodes[p]) - 1) * len(WORDS.findall(p[-1][1])) if p else 0)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(
        (
            (low(m), len(p), low(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in sorted(c for c in m if c is not None and len(convs[c]) == len(p))).encode()).hexdigest())
            for p, m in nodes.items()
        ),
        key=str,
    )


UNITS = [bytes([b]) * 16 for b in (0, 1, 255)] + [bytes(15) + bytes([b]) for b in range(1, 9)] + [bytes(7) + b"x" + bytes(8)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(UNITS), max_size=5), min_size=1, max_size=40), st.integers(1, 5))
def test_trees_over_ranges_add_up(convs, parts):
    """The entries of trees over any cuts of the sorted keys, added up, are those of the definition."""
    members = {}
    for c, units in enumerate(convs):
        members.setdefault(b"".join(units), []).append(c)
    weigh = {u: k for k, u in enumerate(UNITS)}
    keys = sorted(members)
    cuts = sorted({0, len(keys), *random.Random(len(keys)).choices(range(len(keys) + 1), k=parts)})
    ranges = [keys[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    rows = {}
    for k, own in enumerate(ranges):
        tree = radix.Tree()
        for key in random.Random(k).sample(own, len(own)):
            ids = members[key]
            tree.insert(key, radix.Member(len(ids), ids[0], [weigh[key[i : i + 16]] for i in range(0, len(key), 16)], str(ids)))
        before = trie._shared_units(ranges[k - 1][-1] if k else None, own[0])
        after = trie._shared_units(own[-1], ranges[k + 1][0] if k + 1 < len(ranges) else None)
        for e in list(radix.walk(tree, before, after)):
            assert (e.parent is None) == (e.depth == 0)
            assert e.spans or e.name not in rows
            rows.setdefault(e.name, []).append(e)
    got = sorted((min(e.smallest for e in es), es[0].depth, *(sum(getattr(e, x) for e in es) for x in ("copies", "children", "leaves", "saved"))) for es in rows.values())
    named = {c: [(str(weigh[u]), "w " * weigh[u]) for u in units] for c, units in enumerate(convs)}
    assert got == sorted((r[0], r[1], *r[3:7]) for r in brute(named))


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        own.setdefault(c, []).append(((turn is not None, turn), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: t[0])] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if c is not None else 0
        out[c] = (own.get(c - c % 20, [])[:h] if h else []) + ts[h:]
    return out


def columns(nodes):
    return sorted((tuple(r) for r in nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


@pytest.mark.parametrize("limit", [1 << 22, 400])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(trie, "RANGE", limit)
    monkeypatch.setattr(trie, "PIECE", 8)
    monkeypatch.setattr(trie, "ROWS", 7)
    rng = random.Random(limit)
    opening = [("system", "be  good\t"), ("user", "é hello"), (None, None), ("user", "")]
    rows = [(c, k if k or c % 3 else None, *rng.choice(opening)) for c in range(160) if c not in (40, 60) for k in range(rng.randint(1, 5))]
    rows += [(c, k, "user", "same turns") for c in range(200, 290) for k in range(3)] + [(None, 1, "user", "nobody"), (None, 0, "user", "asks")]
    rows += [(1000, k, "user", f"turn {k}") for k in range(300)] + [(10**12 + 7, 0, "x", "b" * 5000), (10**12 + 8, 0, "xb", "b" * 4999)]
    df = spark.createDataFrame([(*r, 3, "clash") for r in rows], SCHEMA).repartition(5)
    want = brute(rebuilt(rows))
    assert columns(trie.prefix_trie(trie.rebuilt(trie.turn_lists(df)))) == want
    assert len(want) > 400


def test_ties_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "a", "x"), (1, 0, "a", "x"), (1, 0, "b", "y"), (2, 0, "b", "y"), (2, 0, "a", "x"), (2, 0, "a", "x")], "conv_id long, turn int, role string, text string")
    nodes = trie.prefix_trie(trie.turn_lists(df)).collect()
    assert len(nodes) == 4 and {r.n_convs for r in nodes} == {2}
    names = {r.name: r.depth for r in nodes}
    assert all(names[r.parent] == r.depth - 1 for r in nodes if r.depth)
    assert trie.prefix_trie(trie.turn_lists(df.limit(0))).count() == 0


def test_sql_equals_the_query(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.sql(queries.OP12_SQL).fetchall()
    got = queries.op12_prefix_trie(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    rows = [tuple(r) for r in read(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(want, key=str) == brute(rebuilt(rows))
