import math
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import expr, lookup, nested, weights
from lumenfold.functions.axes import Axis, flat_index
from lumenfold.operators import algebra, cov, hist, select, smooth, tables, yields
from lumenfold.sources import catalog, layout


def index_of(spark, axis, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double")
    return [r[0] for r in df.orderBy("k").select(axis.index("x")).collect()]


# ---- axes


@pytest.mark.parametrize("axis", [Axis.regular("a", 2, 0, 2), Axis.variable("a", [0, 1, 2])])
def test_edges(spark, axis):
    assert index_of(spark, axis, [-1.0, 0.0, 0.999, 1.0, 2.0, math.nan, None]) == [-1, 0, 0, 1, 2, 2, None]


def test_closed_end_clamp_and_no_flow(spark):
    closed = Axis.variable("a", [0, 1, 2], underflow=False, overflow=False)
    assert index_of(spark, closed, [2.0, 2.0001, -0.1, math.nan]) == [1, None, None, None]
    clamp = Axis.regular("a", 10, 0, 1, clamp=True)
    assert index_of(spark, clamp, [-3.0, 7.0, math.nan, 1.0]) == [0, 9, 9, 9]


def test_long_and_log_axes_agree_with_the_driver(spark):
    rng = random.Random(0)
    for axis in (Axis.variable("a", sorted(rng.uniform(0, 10) for _ in range(60))), Axis.variable("a", [0, 1, 5, 9]), Axis.regular("a", 7, 0, 7)):
        values = [rng.uniform(-2, 12) for _ in range(200)] + list(axis.edges)
        assert index_of(spark, axis, values) == [axis.place(v) for v in values]
    log = Axis.regular("a", 3, 1, 1000, transform="log")
    assert index_of(spark, log, [0.5, 1.0, 9.99, 10.01, 999.0, 1000.0, 0.0, -1.0]) == [-1, 0, 0, 1, 2, 3, -1, -1]


def test_prebinned_rebinned_narrowed(spark):
    fine = Axis.variable("a", range(11))
    coarse = fine.rebinned(5)
    assert coarse.edges == (0, 5, 10) and fine.rebinned(4).edges == (0, 4, 8, 10)
    narrow = fine.narrowed(2, 5)
    assert narrow.edges == (2, 3, 4, 5) and narrow.underflow and narrow.overflow
    df = spark.createDataFrame([(k,) for k in range(12)], "k int").orderBy("k")
    assert [r[0] for r in df.select(fine.prebinned_index(coarse, "k")).collect()] == [2, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 2]


# ---- histograms


def rows(spark, n=3000, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame([(rng.randrange(400), rng.uniform(-1, 12), rng.choice([0.1, 0.2, 0.7]), rng.uniform(0, 2)) for _ in range(n)], "event long, x double, y double, w double")


AXES = [Axis.regular("x", 5, 0, 10), Axis.variable("y", [0.0, 0.2, 0.5])]


def test_cells_add_up_and_project(spark):
    df = rows(spark)
    h = hist.histogram(df, AXES, weight="w")
    total = df.agg(F.sum("w")).first()[0]
    assert h.agg(F.sum("sumw")).first()[0] == pytest.approx(total)
    one = {r.x: r.sumw for r in algebra.project(h, ["x"]).collect()}
    assert one == pytest.approx({r.x: r.sumw for r in hist.histogram(df, AXES[:1], weight="w").collect()})
    full = hist.dense(h, AXES)
    assert full.count() == AXES[0].extent * AXES[1].extent and full.where("sumw is null").count() == 0
    assert full.select(flat_index(AXES).alias("k")).distinct().count() == full.count()


def test_splits_add_up(spark):
    df = rows(spark).withColumn("event", F.when(F.col("event") % 7 == 0, -F.col("event")).otherwise(F.col("event")))
    parts = [hist.statistical_split(df, "event", 4, k).withColumn("statk", F.lit(k)) for k in range(4)]
    assert sum(p.count() for p in parts) == df.count()
    h = None
    for p in parts:
        one = hist.histogram(p, AXES[:1], weight="w", by=["statk"])
        h = one if h is None else h.unionByName(one)
    whole = {r.x: r.sumw for r in hist.combine_splits(h, ["x"]).collect()}
    assert whole == pytest.approx({r.x: r.sumw for r in hist.histogram(df, AXES[:1], weight="w").collect()})
    assert hist.combine_splits(h, ["x"], into=2).select("statk").distinct().count() == 2
    ids = spark.createDataFrame([(-1,), (7,)], "i long").select(expr.unsigned_mod("i", 7)).collect()
    assert [r[0] for r in ids] == [(2**64 - 1) % 7, 0]


def test_variations_in_one_pass(spark):
    df = rows(spark)
    v = {(r.variation, r.x): r.sumw for r in hist.variations(df, AXES[:1], {"a": "w", "b": F.col("w") * 2}).collect()}
    for r in hist.histogram(df, AXES[:1], weight=F.col("w") * 2).collect():
        assert v["b", r.x] == pytest.approx(r.sumw) and v["a", r.x] == pytest.approx(r.sumw / 2)


def test_radial_width(spark):
    h = spark.createDataFrame([(0, 3.0), (-1, 1.0)], "r int, sumw double")
    out = {r.r: r.width for r in hist.with_widths(h, [Axis.variable("r", [1.0, 2.0])], radial=["r"]).collect()}
    assert out == {0: 1.5, -1: None}
    with pytest.raises(ValueError):
        hist.same_binning(AXES, AXES[:1])


# ---- covariance and algebra


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_covariance_fixture(spark):
    df = spark.createDataFrame([("A", 0, 1.0), ("A", 0, 2.0), ("A", 1, 4.0), ("B", 1, 1.0)], "e string, c int, w double")
    got = {k: r.cov for k, r in table(cov.event_covariance(df, "e", "c", "w"), "i", "j").items()}
    assert got == {(0, 0): 9, (0, 1): 12, (1, 0): 12, (1, 1): 17}


def test_covariance_sums(spark):
    df = hist.with_bins(rows(spark), AXES[:1]).withColumnRenamed("_bin_x", "c")
    c = cov.event_covariance(df, "event", "c", "w")
    assert c.agg(F.sum("cov")).first()[0] == pytest.approx(df.groupBy("event").agg(F.sum("w").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0])
    mapping = spark.createDataFrame([(k, 0) for k in AXES[0].slots()], "old int, new int")
    assert cov.rebinned(c, mapping).first()["cov"] == pytest.approx(c.agg(F.sum("cov")).first()[0])
    assert all(abs(r["corr"]) <= 1 + 1e-9 for r in cov.correlation(c).collect())


def test_poisson_bootstrap_approaches_the_covariance(spark):
    df = hist.with_bins(rows(spark), AXES[:1]).withColumnRenamed("_bin_x", "c")
    exact = table(cov.event_covariance(df, "event", "c", "w"), "i", "j")
    drawn = table(cov.bootstrap(df, "event", "c", "w", 400), "i", "j")
    for k in [(1, 1), (2, 2)]:
        assert drawn[k].cov == pytest.approx(exact[k].cov, rel=0.35)


def test_conditioning_fixture(spark):
    c = spark.createDataFrame([(0, 0, 4.0), (0, 1, 2.0), (1, 0, 2.0), (1, 1, 2.0)], "i int, j int, cov double")
    v = spark.createDataFrame([(0, 1.0), (1, 1.0)], "i int, value double")
    x, k = algebra.condition(v, c, 1, 0.0)
    assert [tuple(r) for r in x.collect()] == [(0, 0.0)] and [tuple(r) for r in k.collect()] == [(0, 0, 2.0)]
    assert algebra.nuisance_contribution(v, c, [1], 1).first().contribution == 2.0
    assert algebra.marginalise(c, 1).count() == 1


def test_shape_jacobian_against_differences(spark):
    values = {0: 2.0, 1: 3.0, 2: 5.0, 3: 1.0, 4: 1.0}
    df = lambda v: spark.createDataFrame([(k, x, k // 3) for k, x in v.items()], "i int, value double, b int")
    shape = lambda v: {r.i: r["shape"] for r in algebra.shapes(df(v), ["b"], "value").collect()}
    jac = table(algebra.shape_jacobian(df(values), "i", "b"), "a", "i")
    base, moved = shape(values), shape(values | {1: 3.0 + 1e-6})
    for a in (0, 1, 2):
        assert jac[a, 1].d == pytest.approx((moved[a] - base[a]) / 1e-6, abs=1e-5)
    assert (3, 1) not in jac


def test_comparison_covariance_of_a_ratio(spark):
    v = lambda x: spark.createDataFrame([(0, x[0]), (1, x[1])], "i int, value double")
    c = lambda a, b: spark.createDataFrame([(0, 0, a), (0, 1, b), (1, 0, b), (1, 1, a)], "i int, j int, cov double")
    out = table(algebra.compare_covariance(c(1.0, 0.5), c(2.0, 0.0), v((4.0, 6.0)), v((2.0, 3.0)), "ratio"), "i", "j")
    assert out[0, 1].cov == pytest.approx(0.5 / (2 * 3)) and out[0, 0].cov == pytest.approx(1 / 4 + 2 * 16 / 16)
    both = algebra.compare_covariance(c(1.0, 0.5), c(2.0, 0.0), v((4.0, 6.0)), v((2.0, 3.0)), "difference")
    assert table(both, "i", "j")[1, 1].cov == 3.0


# ---- nested events and selections


def test_nested_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5, 6], [2, 0, 4], [0, 99999999, 7, 5])], "f array<int>, n array<int>, i array<int>")
    row = df.select(
        nested.unflatten("f", "n").alias("u"), nested.gather("f", "i").alias("g"), nested.gather_matched("f", "i").alias("m"),
        nested.unflatten_matrix("f", F.array(F.lit(2), F.lit(1)), F.array(F.lit(2), F.lit(2))).alias("x"), nested.nth("f", 9, -1).alias("d"),
    ).first()
    assert row.u == [[1, 2], [], [3, 4, 5, 6]] and row.g == [1, None, None, 6] and row.m == [1, 6]
    assert row.x == [[[1, 2], [3, 4]], [[5, 6]]] and row.d == -1


def test_leading_ties_and_matches(spark):
    df = spark.sql("select named_struct('pt', 5.0D, 'n', 0) a, named_struct('pt', 5.0D, 'n', 1) b, array(named_struct('f', false)) m, cast(array() as array<struct<f:boolean>>) z")
    row = df.select(nested.leading_pair("a", "b").alias("x"), nested.leading_pair("a", "b", ties_to_first=True).alias("y"), nested.any_matched("m", "f").alias("m"), nested.any_matched("z", "f").alias("z")).first()
    assert row.x.lead.n == 1 and row.y.lead.n == 0 and row.m is False and row.z is False


def test_event_id_wraps_like_unsigned(spark):
    for run, lumi, event in ((320000, 70, 5_000_000_000), (1, 2, 3), (65536, 0, 1)):
        got = spark.range(1).select(expr.event_id(F.lit(run), F.lit(lumi), F.lit(event))).first()[0]
        assert got % 2**64 == ((run << 48) + (lumi << 32) + event) % 2**64


def test_delta_phi_and_pair_mass(spark):
    got = spark.range(1).select(expr.delta_phi(F.lit(3.0), F.lit(-3.0)), expr.delta_r(F.lit(0.0), F.lit(3.1), F.lit(0.0), F.lit(-3.1))).first()
    assert got[0] == pytest.approx(6 - 2 * math.pi) and got[1] == pytest.approx(2 * math.pi - 6.2)
    pair = spark.sql("select named_struct('pt', 45.0D, 'eta', 0.0D, 'phi', 0.0D, 'mass', 0.0D) a, named_struct('pt', 45.0D, 'eta', 0.0D, 'phi', 3.141592653589793D, 'mass', 0.0D) b")
    z = pair.select(expr.four_sum(F.col("a"), F.col("b")).alias("z")).first().z
    assert z.mass == pytest.approx(90) and z.pt == pytest.approx(0, abs=1e-9)


def test_selection_and_cutflow(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (None, 5.0)], "a int, w double")
    s = select.Selection().add("has", F.col("a").isNotNull()).add("two", F.col("a") >= 2)
    assert [(r.step, r.n) for r in select.cutflow(df, s, "w").orderBy("step_no").collect()] == [("raw", 3.0), ("all", 35.0), ("has", 30.0), ("two", 20.0)]
    assert s.filter(df).count() == 1 and df.where(s.any()).count() == 2 and df.where(s.require(has=True, two=False)).count() == 1


def test_item_tables_and_optional_columns(spark):
    df = spark.sql("select 1L id, array(named_struct('pt', 2.0D, 'kids', array(named_struct('q', 1), named_struct('q', 2)))) items union all select 2L, cast(array() as array<struct<pt:double,kids:array<struct<q:int>>>>)")
    assert tables.item_table(df, "items", ["id"]).count() == 1
    assert [tuple(r) for r in tables.grandchild_table(df, "items", "kids", ["id"], ["pt"]).collect()] == [(1, 2.0, 1), (1, 2.0, 2)]
    assert tables.event_table(df, {"id": "id", "gone": "met.pt"}).columns == ["id"]
    assert nested.field_or_none(df, "items.pt") is not None and nested.field_or_none(df, "items.eta") is None


# ---- weights and corrections


def test_weight_variations_leave_the_factor_out(spark):
    df = spark.createDataFrame([(0.0, 2.0, 3.0)], "a double, b double, up double")
    row = weights.WeightSet().add("a", "a", up="up").add("b", "b").apply(df).first()
    assert row.wt_nominal == 0 and row.wt_aUp == 6


def test_multiplicity_fixture(spark):
    df = spark.sql("select array(named_struct('e', 0.5D, 's', 1.1D, 'p', true), named_struct('e', 0.2D, 's', 0.9D, 'p', false)) j")
    assert df.select(weights.multiplicity("j", "p", "e", "s")).first()[0] == pytest.approx(1.1275)


def test_lookups(spark):
    df = spark.createDataFrame([(1.5, "a"), (9.0, "a"), (None, "a"), (0.5, "b")], "x double, k string")
    t = spark.createDataFrame([(0, "a", 2.0), (1, "a", 3.0), (0, "b", 5.0)], "x int, k string, value double")
    axis = Axis.variable("x", [0, 1, 2], underflow=False, overflow=False)
    assert [r.correction for r in lookup.binned_lookup(df, t, [(axis, "x")], keys=["k"]).orderBy("k", F.col("x").asc_nulls_first()).collect()] == [1.0, 3.0, 1.0, 5.0]
    r = spark.createDataFrame([(0.0, 1.0, 7.0)], "lo double, hi double, value double")
    assert sorted(x.correction for x in lookup.range_lookup(df, r, "x").collect()) == [1.0, 1.0, 1.0, 7.0]
    seg = [(0.0, 1.0, 1.0, 2.0, 0.0, 0.0), (1.0, 2.0, 3.0, 0.0, 1.0, 0.0)]
    p = spark.createDataFrame([(-5.0,), (0.5,), (1.5,), (9.0,), (None,)], "x double").select(lookup.polynomial("x", seg))
    assert [x[0] for x in p.collect()] == [1.0, 2.0, 3.25, 4.0, None]


# ---- yields, smoothing, sources


def test_efficiency_totals_are_ratios_of_sums(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 10)], "d string, num int, den int")
    long = df.select("d", F.lit("x").alias("bin"), F.col("num").cast("double"), F.col("den").cast("double"), (F.col("num") / F.col("den")).alias("efficiency"))
    out = {r.d: r.efficiency for r in yields.with_totals(long, "d", {"t": ["a", "b"]}).collect()}
    assert out["t"] == pytest.approx(4 / 12)


def test_smoothing_by_hand(spark):
    v = [1.0, 2.0, 4.0, 8.0]
    df = spark.createDataFrame([(float(k), x, x) for k, x in enumerate(v)], "e double, v double, err double")
    got = [r.smoothed for r in smooth.moving_average(df, "e", "v", 1).orderBy("e").collect()]
    assert got == pytest.approx([1.5, 7 / 3, 14 / 3, 6.0])
    g = [r.smoothed for r in smooth.gaussian_kernel(df, "e", "v", 1.5, error="err").orderBy("e").collect()]
    want = []
    for i in range(4):
        w = [math.exp(-0.5 * ((j - i) / 1.5) ** 2) / v[j] for j in range(4)]
        want.append(sum(a * b for a, b in zip(w, v, strict=True)) / sum(w))
    assert g == pytest.approx(want)


def test_stacks_of_stacks(spark):
    links = spark.createDataFrame([("top", "s1", "stack"), ("top", "s2", "stack"), ("s1", "d1", "dset"), ("s2", "d2", "dset"), ("s2", "s1", "stack")], "stack string, child string, kind string")
    got = {(r.stack, r.dataset): r.times for r in catalog.stack_members(spark, links).collect()}
    assert got == {("top", "d1"): 2, ("top", "d2"): 1, ("s1", "d1"): 1, ("s2", "d1"): 1, ("s2", "d2"): 1}


def test_catalog_files_and_guards(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"r1": {"mc": {"xsec": 2.5, "eventcount": 10, "label": "x"}, "data": {"lumi": 59.5, "era": "A"}}}')
    cat = {r.dataset: r for r in catalog.load_catalog(spark, str(tmp_path)).collect()}
    assert cat["mc"].is_mc and cat["mc"].xsec == 2.5 and not cat["data"].is_mc and cat["data"].lumi == 59.5
    with pytest.raises(Exception, match="lumi xor xsec"):
        catalog.checked(catalog.catalog(spark, [("r", "bad", True, 1.0, 2.0, 1.0, None)])).collect()


def test_layout_round_trip_and_reports(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id long, x double")
    for sys in ("nominal", "up"):
        layout.write_table(df, path, dataset="d", objsyst=sys)
    assert layout.scan_table(spark, path, ["id"], F.col("x") > 2.5, objsyst="up").collect()[0].id == 2
    files = str(tmp_path / "f")
    df.coalesce(1).write.parquet(files)
    df.limit(0).coalesce(1).write.mode("append").parquet(files)
    assert layout.empty_or_corrupt(spark, files).count() == 1
    assert layout.scan_events(spark, files, exclude_prefix="part-99").count() == 2
    layout.write_tables(df, {"a": lambda d: d, "b": lambda d: d.limit(1)}, str(tmp_path / "m"), dataset="d")
    assert spark.read.parquet(str(tmp_path / "m")).groupBy("tbl").count().count() == 2


def test_corrupt_pages_and_footers_are_found(spark, tmp_path):
    """2,000 bytes of data overwritten leave the footer whole; a cut file has none."""
    path = tmp_path / "f"
    df = spark.range(60000).selectExpr("id", "uuid() AS s")
    for _ in range(3):
        df.coalesce(1).write.mode("append").parquet(str(path))
    pages, footer, _ = sorted(path.glob("*.parquet"))
    raw = bytearray(pages.read_bytes())
    raw[4000:6000] = b"\7" * 2000
    pages.write_bytes(raw)
    footer.write_bytes(footer.read_bytes()[:-100])
    for crc in path.glob(".*.crc"):
        crc.unlink()
    got = {r.file.rsplit("/", 1)[1] for r in layout.empty_or_corrupt(spark, str(path)).collect()}
    assert got == {pages.name, footer.name}


def test_catalog_flags(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"r": {"low": {"xsec": 1.0, "flags": {"genHT": 70}}, "v": {"xsec": 1.0, "flags": {"genVpt": [50, -1]}}, "d": {"lumi": 2.0, "era": "B"}}}')
    cat = {r.dataset: r for r in catalog.load_catalog(spark, str(tmp_path)).collect()}
    assert cat["low"].ht_max == 70 and cat["low"].vpt_low is None
    assert (cat["v"].vpt_low, cat["v"].vpt_high, cat["v"].ht_max) == (50, -1, None)
    assert cat["d"].era == "B" and cat["d"].ht_max is None and not cat["d"].is_mc


def test_stitching_keeps_the_boundary(spark):
    rows = spark.createDataFrame([(69.0, 5.0), (70.0, 5.0), (70.1, 5.0), (70.0, 4.9), (70.0, 10.0)], "ht double, vpt double")
    flags = {"ht_max": 70, "vpt_low": 5, "vpt_high": 10}
    assert sorted(map(tuple, rows.where(select.in_sample(flags, "ht", "vpt")).collect())) == [(69.0, 5.0), (70.0, 5.0)]


def test_completeness(spark):
    want = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 10), ("e", 10)], "file string, entries long")
    made = spark.createDataFrame([("a", 0, 5, True), ("a", 5, 10, True), ("b", 0, 4, True), ("b", 6, 10, True), ("c", 0, 10, False), ("e", 0, 6, True), ("e", 4, 10, True)], "file string, start long, stop long, ok boolean")
    got = {r.file: (r.status, r.gaps, r.overlaps) for r in layout.completeness(want, made).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "complete", "b": "incomplete", "c": "erroneous", "d": "missing", "e": "incomplete"}
    assert got["b"][1] == 2 and got["e"][2] == 2
