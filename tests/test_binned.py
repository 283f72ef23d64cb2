import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import axes, lookup
from lumenfold.functions.axes import Axis
from lumenfold.operators import algebra, cov, hist, model, reweight, select, tables
from lumenfold.plans import binned, queries
from lumenfold.sources import catalog, layout
from lumenfold.streaming import fill

#: Queries that write the files they read, run a stream, or look at the data for an axis's range.
WITH_JOBS = {
    "hist_auto_range", "stream_hist_fill", "stream_partials", "written_tables", "event_files", "catalog_flags", "object_systematics", "stack_scan", "binned_completeness", "binned_scan", "damaged_files",
}


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_building_a_query_runs_no_job(spark, sf_dir, monkeypatch):
    tables_read = {}

    def read(session, folder, table):
        if table not in tables_read:
            tables_read[table] = session.read.parquet(f"{folder}/{table}.parquet")
        return tables_read[table]

    for module in (queries, binned):
        monkeypatch.setattr(module, "read", read)
    for table in ("lineitem", "orders", "part", "nation", "region", "embeddings", "events"):
        read(spark, sf_dir, table)
    ran = {}
    for name, query in queries.queries().items():
        if name not in WITH_JOBS:
            spark.sparkContext.setJobGroup(f"building {name}", "")
            query(spark, sf_dir)
            ran[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"building {name}"))
    spark.sparkContext.setJobGroup("tests", "")
    assert len(ran) > 90 and {n: k for n, k in ran.items() if k} == {}


@pytest.mark.parametrize(
    ("name", "scans"),
    [("fold_nuisances", 1), ("penalised_objective", 2), ("chi2_given_invcov", 1), ("ratio_covariance", 1), ("marginalise_condition", 2), ("stat_split_sum", 1), ("chi2_shapes", 2), ("lead_sublead_pairs", 1)],
)
def test_tables_are_read_once(spark, sf_dir, name, scans):
    assert final_plan(queries.queries()[name](spark, sf_dir)).count("FileScan") <= scans


# ---- the model with nuisances


def cells_of(spark, sf_dir):
    return model.filled(binned._binned(queries.read(spark, sf_dir, "lineitem")), "gen", "reco", F.expr(binned._ROLE), {n: F.expr(w) for n, w in binned._WEIGHTS.items()})


def test_fold_at_zero_is_the_nominal_fold(spark, sf_dir):
    cells = cells_of(spark, sf_dir)
    want = {r.reco: r.folded for r in queries.queries()["fold_closure"](spark, sf_dir).collect()}
    for theta in ([], [("disc", 0.0), ("tax", 0.0), ("line", 0.0)], [("unknown", 5.0)]):
        table = lookup.local(spark, theta, "nuisance string, theta double")
        got = {r.reco: r.value for r in model.fold(model.truth(cells), cells, binned._NUISANCES, table).collect()}
        assert got == pytest.approx(want, abs=0.006)


def test_fold_is_the_product_of_three_linear_forms(spark, sf_dir):
    """Against dense numpy arrays built from the same cells."""
    theta = {"disc": -0.8, "tax": 0.5, "line": 1.5}
    cells = cells_of(spark, sf_dir)
    rows = cells.collect()
    bins = [-1, 0, 1, 2, 3]
    place = {b: k for k, b in enumerate(bins)}
    total, background = ({v: np.zeros((5, 5)) for v in model.names(binned._NUISANCES)} for _ in range(2))
    for r in rows:
        total[r.variation][place[r.reco], place[r.gen]] += r.w
        if r.role != "in":
            background[r.variation][place[r.reco], place[r.gen]] += r.w

    def matrices(v):
        t, b = total[v], background[v]
        gen, back = t.sum(0), b.sum(0)
        gamma = back / np.where(gen == 0, 1, gen)
        rest = t.sum(1) - b.sum(1)
        return (t - b) / np.where(gen - back == 0, 1, gen - back), np.where(gamma == 1, 0, gamma), b.sum(1) / np.where(rest <= 0, 1, rest)

    nominal = [m.copy() for m in matrices("nominal")]
    at = [m.copy() for m in nominal]
    for n in binned._NUISANCES:
        up, down = n.variations
        for k in range(3):
            if k or n.transfer:
                at[k] += theta[n.name] * ((matrices(up)[k] - matrices(down)[k]) / 2 if down else matrices(up)[k] - nominal[k])
    want = (at[0] @ (total["nominal"].sum(0) * (1 - at[1]))) * (1 + at[2])
    table = lookup.local(spark, list(theta.items()), "nuisance string, theta double")
    got = {r.reco: r.value for r in model.fold(model.truth(cells), cells, binned._NUISANCES, table).collect()}
    assert got == pytest.approx({b: want[place[b]] for b in got}, rel=1e-9) and len(got) >= 4


def test_jacobian_is_the_folds_slope(spark, sf_dir):
    """Every derivative against a difference quotient of the fold itself."""
    cells = cells_of(spark, sf_dir).persist()
    theta = {"disc": 0.3, "tax": -0.6, "line": 0.2}
    table = lambda t: lookup.local(spark, list(t.items()), "nuisance string, theta double")
    beta = {r.gen: r.value for r in model.truth(cells).collect()}
    truth = lambda b: lookup.local(spark, list(b.items()), "gen int, value double")
    fold = lambda b, t: {r.reco: r.value for r in model.fold(truth(b), cells, binned._NUISANCES, table(t)).collect()}
    j = {(r.a, r.i): r.d for r in model.jacobian(truth(beta), cells, binned._NUISANCES, table(theta)).collect()}
    for n in binned._NUISANCES:
        up, down = (fold(beta, theta | {n.name: theta[n.name] + h}) for h in (1e-3, -1e-3))
        for reco in up:
            assert j[reco, n.name] == pytest.approx((up[reco] - down[reco]) / 2e-3, rel=1e-4, abs=1e-3)
    base = fold(beta, theta)
    g = max(beta, key=beta.get)
    more = fold(beta | {g: beta[g] + 1}, theta)
    for reco in base:
        assert j.get((reco, f"gen:{g}"), 0.0) == pytest.approx(more[reco] - base[reco], abs=1e-5)
    c = model.parameter_covariance(lookup.local(spark, [(g, 9.0)], "gen int, variance double"), binned._NUISANCES)
    assert {(r.i, r["cov"]) for r in c.collect()} == {(f"gen:{g}", 9.0), ("disc", 1.0), ("tax", 1.0), ("line", 1.0)}
    nominal = {r.reco: r.value for r in model.folds(cells).where("variation = 'nominal'").collect()}
    assert nominal == pytest.approx(fold(beta, dict.fromkeys(theta, 0.0)))
    cells.unpersist()


def test_variations_by_name_and_missing_bins(spark):
    varied = spark.createDataFrame([("nominal", 0, 1.0), ("nominal", 1, 2.0), ("A_UP", 0, 3.0), ("A_DN", 1, 5.0), ("B", 0, 4.0)], "variation string, gen int, value double")
    nuisances = [model.Nuisance("A", objects=True), model.Nuisance("B", objects=True, one_sided=True)]
    got = {(r.nuisance, r.gen): r.delta for r in model.deltas(varied, ["gen"], nuisances).collect()}
    assert got == {("A", 0): 1.5, ("A", 1): -2.5, ("B", 0): 3.0, ("B", 1): -2.0}
    theta = lookup.local(spark, [("A", 2.0), ("B", 0.5)], "nuisance string, theta double")
    assert {r.gen: r.value for r in model.at(varied, ["gen"], nuisances, theta).collect()} == {0: 1 + 3 + 1.5, 1: 2 - 5 - 1}
    assert model.Nuisance("x").variations == ("xUp", "xDown")
    assert {r.gen: r.value for r in model.at(varied, ["gen"], [], theta).collect()} == {0: 1.0, 1: 2.0}


# ---- binnings that travel with the columns


X, OTHER = Axis.regular("x", 4, 0, 8), Axis.variable("x", [0, 2, 4, 6, 9])


def filled(spark, axis, **by):
    rows = spark.range(40).select((F.col("id") % 9).cast("double").alias("v"), *[F.lit(v).alias(k) for k, v in by.items()])
    return hist.histogram(rows, [axis], ["v"], 1.0, by=list(by))


def test_binnings_are_not_mixed(spark, tmp_path):
    a, b = filled(spark, X, dataset="a"), filled(spark, OTHER, dataset="b")
    a.write.parquet(str(tmp_path / "a"))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert axes.binnings(back) == axes.binnings(a) == {"x": X.metadata[axes.BINNING]}
    members = lookup.local(spark, [("s", "a", 1), ("s", "b", 1)], "stack string, dataset string, times int")
    value = lambda h: h.select("x", F.col("sumw").alias("value"), F.col("sumw2").alias("variance"))
    for one in (a, back):
        for mix in (
            lambda: algebra.add(one, b, ["x"]),
            lambda: algebra.compare(value(one), value(b), ["x"], "ratio"),
            lambda: catalog.stacked([one, b], members, ["x"]),
            lambda: hist.scaled_to(one, b, "x", 1),
        ):
            with pytest.raises(ValueError, match="binnings of x differ"):
                mix()
    layout.write_table(a, str(tmp_path / "t"), objsyst="nominal")
    layout.write_table(a, str(tmp_path / "t"), objsyst="JES_UP")
    with pytest.raises(ValueError, match="differ"):
        layout.write_table(b, str(tmp_path / "t"), objsyst="JES_DN")


def test_binnings_outlive_the_algebra(spark):
    a, b = filled(spark, X, dataset="a"), filled(spark, X, dataset="b")
    members = lookup.local(spark, [("s", "a", 1), ("s", "b", 2)], "stack string, dataset string, times int")
    value = lambda h: h.select("x", F.col("sumw").alias("value"), F.col("sumw2").alias("variance"))
    own = {"x": X.metadata[axes.BINNING]}
    sums = catalog.stacked([a, b], members, ["x"])
    for h in (algebra.add(a, b, ["x"]), algebra.compare(value(a), value(b), ["x"], "sum"), sums, algebra.project(a, ["x"]), a.where("x > 0").withColumnRenamed("x", "y").withColumnRenamed("y", "x")):
        assert axes.binnings(h, ["x"]) == own
    assert {r.x: r.sumw for r in sums.collect()} == {r.x: 3 * r.sumw for r in a.collect()}
    merged = algebra.rebin(a, X, X.rebinned(2))
    assert axes.binnings(merged) == {"x": X.rebinned(2).metadata[axes.BINNING]}
    with pytest.raises(ValueError):
        algebra.add(merged, a, ["x"])


# ---- covariance


def test_event_of_many_cells_is_dealt_out(spark):
    """One event with 3,000 cells beside small ones: the same covariance, and no group of the join holds more than two blocks."""
    rows = spark.range(3000).select(F.lit(-1).alias("e"), F.col("id").cast("int").alias("c"), (F.col("id") % 7 + 1.0).alias("w"))
    rows = rows.union(spark.range(900).select((F.col("id") % 300).cast("int"), (F.col("id") % 11).cast("int"), F.lit(2.0)))
    per = cov.per_event(rows, "e", "c", {"w": "w"})
    pairs = cov.block_pairs(cov.in_blocks(per, "e", "c", 256).where("last > 0"))
    sizes = pairs.groupBy("e", "lo", "hi").count()
    assert sizes.agg(F.max("count")).first()[0] <= 512 and sizes.count() == 12 * 13 // 2
    got = cov.event_covariance(rows, "e", "c", "w", block=256)
    plain = per.select("e", F.col("c").alias("i"), F.col("w").alias("a")).join(per.select("e", F.col("c").alias("j"), F.col("w").alias("b")), "e").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("want"))
    assert got.join(plain, ["i", "j"], "full").where("cov is null or want is null or cov <> want").isEmpty()
    few = cov.event_covariance(rows.where("e >= 0"), "e", "c", "w")
    assert few.count() == cov.event_covariance(rows.where("e >= 0"), "e", "c", "w", block=2).count()


def test_matrices_by_axis_equal_numpy(spark):
    own = [Axis.regular("a", 4, 0, 8, underflow=False), Axis.variable("b", [0, 1, 3]), Axis.regular("c", 2, 0, 2, underflow=False, overflow=False)]
    shape = [a.extent for a in own]
    n = int(np.prod(shape))
    m = np.random.default_rng(1).integers(0, 50, (n, n)).astype(float)
    table = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n)], "i long, j long, cov double")
    back = axes.slots_of(own, "i")
    assert table.where(axes.flat_index(own, [back[a.name] for a in own]) != F.col("i")).isEmpty()
    t = m.reshape(shape * 2)

    def dense(df, size):
        out = np.zeros((size, size))
        for r in df.collect():
            out[r.i, r.j] = r.cov
        return out

    both = {"i": own, "j": own}
    got = cov.on_axes(table, both, keep=["c", "a"])
    want = t.sum(axis=(1, 4)).transpose(1, 0, 3, 2).reshape(shape[2] * shape[0], -1)
    assert np.array_equal(dense(got, len(want)), want)
    got = cov.on_axes(table, both, keep=["a"], within={"b": (1, 3), "c": (0, 1)})
    assert np.array_equal(dense(got, shape[0]), t[:, 2, 0][:, :, 2, 0])  # b has an underflow slot, so its second bin is slot 2
    half = own[0].rebinned(2)
    got = cov.on_axes(table, both, coarse={"a": half})
    fold = lambda x, ax: np.stack([x.take([0, 1], ax).sum(ax), x.take([2, 3], ax).sum(ax), x.take(4, ax)], ax)
    want = fold(fold(t, 0), 3).reshape(3 * shape[1] * shape[2], -1)
    assert np.array_equal(dense(got, len(want)), want)
    assert [a.extent for a in cov.kept_axes(own, None, {"a": half})] == [3, shape[1], shape[2]]


def test_chi_square_of_tables(spark):
    a = spark.createDataFrame([(0, 3.0), (1, 5.0)], "i int, value double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "i int, value double")
    d = np.array([3.0, 4.0, -2.0])
    inverse = np.array([[2.0, -1.0, 0.5], [-1.0, 3.0, 0.0], [0.5, 0.0, 1.0]])
    table = spark.createDataFrame([(i, j, float(inverse[i, j])) for i in range(3) for j in range(3)], "i int, j int, cov double")
    row = algebra.chi_square(a, b, table).first()
    assert row.chi2 == pytest.approx(d @ inverse @ d) and row.ndf == 3
    assert tuple(algebra.chi_square(a.limit(0), b.limit(0), table).first()) == (0.0, 0)


def test_conditioning_equals_numpy(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(6, 6))
    c, x = a @ a.T + np.eye(6), rng.normal(size=6)
    c[2, 5] = c[5, 2] = 0.0
    at = {1: 0.5, 4: -2.0, 2: 1.0}
    cov_ = spark.createDataFrame([(i, j, float(c[i, j])) for i in range(6) for j in range(6) if c[i, j]], "i int, j int, cov double")
    values = spark.createDataFrame([(i, float(x[i])) for i in range(6)], "i int, value double")
    k, rest = list(at), [0, 3, 5]
    gain = c[np.ix_(rest, k)] @ np.linalg.inv(c[np.ix_(k, k)])
    v, m = algebra.condition_on(values, cov_, at)
    assert {r.i: r.value for r in v.collect()} == pytest.approx(dict(zip(rest, x[rest] + gain @ (np.array(list(at.values())) - x[k]), strict=True)))
    want = c[np.ix_(rest, rest)] - gain @ c[np.ix_(k, rest)]
    assert {(r.i, r.j): r["cov"] for r in m.collect()} == pytest.approx({(p, q): want[i, j] for i, p in enumerate(rest) for j, q in enumerate(rest)})
    free = algebra.condition_on(values, cov_, {1: 0.0, 4: 0.0})[1].where("i = j")
    want = {r.i: r["cov"] - w for r in free.collect() if r.i in rest for w in [want[rest.index(r.i), rest.index(r.i)]]}
    got = {r.i: r.contribution for r in algebra.nuisance_contribution(values, cov_, [1, 2, 4], 2).collect()}
    assert got == pytest.approx(want)


def test_derived_corrections(spark):
    axis = Axis.regular("pt", 4, 0, 4)
    rows = spark.createDataFrame([(0.5, True)] * 6 + [(1.5, True)] * 2 + [(0.5, False)] * 2 + [(1.5, False)] * 2 + [(9.0, True), (2.5, True), (None, True), (0.5, None)], "x double, data boolean")
    h = reweight.side_by_side(rows, axis, "x", F.col("data"))
    assert {r.pt: (r.n, r.d) for r in h.collect()} == {0: (6, 2), 1: (2, 2), 2: (1, 0), 4: (1, 0)}
    ratio = reweight.shape_ratio(h, axis)
    got = {r.pt: r.ratio for r in ratio.collect()}
    assert got == pytest.approx({0: 0.6 / 0.5, 1: 0.2 / 0.5, 2: None, 4: None}) and axes.binnings(ratio, ["pt"]) == {"pt": axis.metadata[axes.BINNING]}
    plain = reweight.correction(ratio, axis)
    assert {r.x: r.correction for r in reweight.corrected(rows.select("x").distinct(), plain, axis, "x").collect()} == pytest.approx({0.5: 1.2, 1.5: 0.4, 2.5: 1.0, 9.0: 1.0, None: 1.0})
    smooth = {r.pt: r.value for r in reweight.correction(ratio, axis, 1).collect()}
    assert smooth == pytest.approx({0: 0.8, 1: 0.8})
    assert reweight.correction(ratio, axis, 1, by_error=True).where("value is not null").count() == 2


# ---- selections and leading items


def test_leading_items_are_limited_before_the_shuffle(spark, sf_dir):
    plan = final_plan(queries.queries()["lead_sublead_pairs"](spark, sf_dir))
    assert "collect_list" not in plan and plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1
    rows = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (1, 9, "c"), (2, 1, None), (None, 4, "d")], "e int, x int, s string")
    got = {r.e: r for r in tables.leading(rows, "e", ["x"], 2).collect()}
    assert (got[1].leading1.s, got[1].leading2.s, got[1].n_leading) == ("b", "a", 2)
    assert got[2].leading1.x == 1 and got[2].leading2 is None and got[None].leading1.s == "d"


def test_stitching_by_dataset(spark):
    limits = spark.createDataFrame([("low", 70.0, None, None), ("v", None, 50.0, 100.0), ("open", None, 50.0, -1.0)], "dataset string, ht_max double, vpt_low double, vpt_high double")
    rows = spark.createDataFrame([("low", 70.0, 0.0), ("low", 70.1, 0.0), ("v", 99.0, 50.0), ("v", 99.0, 100.0), ("v", 1.0, 49.9), ("open", 1.0, 1e6), ("open", 1.0, 49.0), ("none", 1e9, -5.0), (None, 1.0, 1.0)], "dataset string, ht double, vpt double")
    got = {(r.dataset, r.ht, r.vpt) for r in select.stitched(rows, limits, "ht", "vpt").collect()}
    assert got == {("low", 70.0, 0.0), ("v", 99.0, 50.0), ("open", 1.0, 1e6), ("none", 1e9, -5.0), (None, 1.0, 1.0)}
    assert select.stitched(rows, limits.select("dataset", "ht_max"), "ht").count() == 8


def test_levels_are_checked(spark):
    with pytest.raises(ValueError):
        select.muon_pair(identity="superb")
    with pytest.raises(ValueError):
        select.muon_pair(isolation="medium")
    pair = spark.createDataFrame([(1, 0), (1, 1), (-1, 1)], "a int, b int").select(F.struct(F.col("a").alias("charge")).alias("lead"), F.struct(F.col("b").alias("charge")).alias("sub"))
    assert select.muon_pair().filter(pair).count() == 2  # a neutral one differs from a charged one


# ---- sources


def test_stacks_prune_partitions_at_run_time(spark, sf_dir):
    plan = final_plan(queries.queries()["stack_scan"](spark, sf_dir))
    assert plan.count("dynamicpruning") >= 2 and "Cartesian" not in plan


def test_absent_covariance_is_zero(spark, tmp_path):
    h = filled(spark, X).select(F.col("x").alias("i"), "sumw")
    h.write.parquet(str(tmp_path / "values/dataset=a"))
    values, covariance = layout.binned(spark, str(tmp_path / "values"), dataset="a")
    assert {(r.i, r.j, r["cov"]) for r in covariance.collect()} == {(r.i, r.i, 0.0) for r in values.collect()}
    spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0)], "i int, j int, cov double").write.parquet(str(tmp_path / "cov/dataset=a"))
    _, covariance = layout.binned(spark, str(tmp_path / "values"), str(tmp_path / "cov"), dataset="a")
    got = {(r.i, r.j): r["cov"] for r in covariance.collect()}
    assert got[0, 0] == 4.0 and got[0, 1] == 1.0 and got[1, 1] == 0.0


# ---- streams


SCHEMA = "v double, kind string"


def feed(spark, path, n):
    for k in range(n):
        spark.range(k * 10, k * 10 + 10).select((F.col("id") % 9).cast("double").alias("v"), F.lit("a").alias("kind")).coalesce(1).write.mode("append").parquet(path)


def partials(spark, folder, every=3):
    stream = fill.source(spark, f"{folder}/in", spark.createDataFrame([], SCHEMA).schema, files=1)
    one = lambda rows: hist.histogram(rows, [X], ["v"], 1.0, by=["kind"])
    return fill.start_partials(stream, one, f"{folder}/table", f"{folder}/checkpoint", ["kind", "x"], every)


def summed(spark, folder):
    return sorted(tuple(r) for r in fill.summed(spark, f"{folder}/table", ["kind", "x"]).select("kind", "x", "sumw", "n").collect())


def batch(spark, folder):
    rows = spark.read.parquet(f"{folder}/in")
    return sorted(tuple(r) for r in hist.histogram(rows, [X], ["v"], 1.0, by=["kind"]).select("kind", "x", "sumw", "n").collect())


def test_partial_sums_survive_a_killed_stream(spark, tmp_path):
    """Batches run again after their sums were written but before they were committed; compaction keeps few folders."""
    folder = str(tmp_path)
    feed(spark, f"{folder}/in", 4)
    partials(spark, folder).awaitTermination()
    assert summed(spark, folder) == batch(spark, folder)
    for number in (3, 2):  # the last commits are lost, the second of them of a batch that was compacted
        for f in tmp_path.glob(f"checkpoint/commits/*{number}*"):
            f.unlink()
    feed(spark, f"{folder}/in", 5)
    partials(spark, folder).awaitTermination()
    assert summed(spark, folder) == batch(spark, folder)
    found = fill.ranges(spark, f"{folder}/table")
    assert fill.cover(found)[0] == (0, 8) and len(found) <= 5
    (tmp_path / "table/first=9/last=9").mkdir(parents=True)  # a batch that was being written
    assert summed(spark, folder) == batch(spark, folder)


def test_cover_takes_the_widest():
    assert fill.cover([(0, 0), (1, 1), (0, 2), (3, 3), (4, 4), (6, 6)]) == [(0, 2), (3, 3), (4, 4)]
    assert fill.cover([]) == []
