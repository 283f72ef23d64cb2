import numpy as np
from lumenfold.llm import embeddings as e

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def vectors(seed, n=400, d=64):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    out = list(base)
    for k in range(n // 2):  # partners at cosines from 0.85 to 0.99
        x = base[k] / np.linalg.norm(base[k])
        z = rng.standard_normal(d)
        z -= (z @ x) * x
        c = rng.uniform(0.85, 0.99)
        out.append(c * x + np.sqrt(1 - c * c) * z / np.linalg.norm(z))
    return np.array(out, np.float32)


def test_links_and_components_against_brute_force(spark):
    x = vectors(0)
    x = np.concatenate([x, x[:5], x[:1]])
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(x)]
    bad = [(9001, None, "a"), (9002, [0.0] * 64, "a"), (9003, [float("nan")] + [1.0] * 63, "a"), (9004, [None] + [1.0] * 63, "a"), (9005, [float("inf")] * 64, "a"), (9006, [], "a"), (None, x[0].tolist(), "a")]
    got = {r.vec_id: r for r in e.near_duplicates(spark.createDataFrame(rows + bad, SCHEMA).repartition(3)).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    cos = u @ u.T
    want = cos >= 0.9
    np.fill_diagonal(want, False)
    n = np.array([got[k].n_links for k in range(len(x))])
    assert (n <= want.sum(1)).all()
    assert n.sum() >= 0.9 * want.sum()  # recall; measured at 0.99
    for v in (9001, 9002, 9003, 9004, 9005, 9006):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (0, v, True)
    assert got[len(x) - 1].component_id == 0 and not got[len(x) - 1].kept


def test_blocks_of_a_large_cell(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = (np.ones(64) + 0.01 * rng.standard_normal((150, 64))).astype(np.float32)
    monkeypatch.setattr(e, "BLOCK", 20)
    out = e.near_duplicates(spark.createDataFrame([(k, v.tolist(), "a") for k, v in enumerate(x)], SCHEMA)).collect()
    assert {r.n_links for r in out} == {149} and {r.component_id for r in out} == {0}
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_decoding_is_the_nearest_lattice_point():
    rng = np.random.default_rng(2)
    x = rng.uniform(-3, 3, (300, 8))
    p = e.decode(x)
    near = e.shortest_vectors()
    assert len(near) == 240 and np.allclose((near**2).sum(1), 2)
    d = ((x - p) ** 2).sum(1)
    around = ((x[:, None] - p[:, None] - near) ** 2).sum(2)
    assert (d[:, None] <= around + 1e-9).all()
    assert (d <= 1 + 1e-9).all()  # the covering radius is 1


def test_a_longer_vector_among_many(spark):
    x = vectors(3, n=60)
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(x)]
    longer = [(1000, [*x[0].tolist(), 0.5], "a"), (1001, [*x[0].tolist(), 0.51], "a")]
    alone = {r.vec_id: (r.n_links, r.component_id) for r in e.near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    mixed = {r.vec_id: (r.n_links, r.component_id) for r in e.near_duplicates(spark.createDataFrame(rows + longer, SCHEMA).coalesce(1)).collect()}
    assert sum(n for n, _ in alone.values()) > 0
    assert mixed == alone | {1000: (1, 1000), 1001: (1, 1000)}


def test_an_id_with_several_vectors(spark):
    x = vectors(5, n=4, d=16)[:4]
    rows = [(1, x[0]), (2, x[0] * 2 + 1e-3), (2, x[1]), (3, x[1] * 0.5), (2, x[1]), (4, x[2])]
    out = e.near_duplicates(spark.createDataFrame([(k, v.tolist(), "a") for k, v in rows], SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == [(1, 1, 1), (2, 1, 1), (2, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


def test_rows_of_a_dense_cluster_grow_with_its_vectors(spark):
    """400 vectors that are all linked: 79,800 pairs, but only a tree of links and a count for each leave a task."""
    rng = np.random.default_rng(6)
    x = np.ones(32) + 0.02 * rng.standard_normal((400, 32))
    df = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(x)], "vec_id long, copies long, embedding array<double>")
    rows = e.links(df).collect()
    total = {}
    for r in rows:
        if r.n is not None:
            total[r.a] = total.get(r.a, 0) + r.n
    assert total == {k: 399 for k in range(400)} and len(rows) < 40 * 400


def test_counts_do_not_depend_on_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(k, v.tolist(), "a") for k, v in enumerate(vectors(8, n=150))], SCHEMA)
    whole = sorted(map(tuple, e.near_duplicates(df).collect()))
    monkeypatch.setattr(e, "BLOCK", 7)
    assert sorted(map(tuple, e.near_duplicates(df).collect())) == whole
