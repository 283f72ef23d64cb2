"""Algebra of binned tables: scaling, projection, shapes, response and folding, chi-square, conditioning.

Values are tables (key, value), covariances (i, j, cov), responses (reco, gen, t): sparse, so that only cells that
exist are joined. All products are equi-joins followed by partial aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axes import Axis, agreed_binning, carrying, slots_of
from .cov import merged_bin


def scale(h: DataFrame, factor: float, value: str = "sumw", variance: str | None = "sumw2") -> DataFrame:
    out = h.withColumn(value, F.col(value) * factor)
    return out if variance is None else out.withColumn(variance, F.col(variance) * factor * factor)


def scale_covariance(cov: DataFrame, factor: float) -> DataFrame:
    return cov.withColumn("cov", F.col("cov") * factor * factor)


def add(a: DataFrame, b: DataFrame, keys: Sequence[str], weight: float = 1.0, value: str = "sumw", variance: str = "sumw2") -> DataFrame:
    """a + weight * b with outer-join semantics: a cell that one side lacks is 0 there. Raises if the keys carry different binnings."""
    known, cols = agreed_binning(a, b, keys), [*keys, value, variance]
    out = a.select(cols).unionByName(scale(b.select(cols), weight, value, variance)).groupBy(*keys).agg(F.sum(value).alias(value), F.sum(variance).alias(variance))
    return carrying(out, known)


def project(h: DataFrame, keys: Sequence[str], value: str = "sumw", variance: str = "sumw2") -> DataFrame:
    """Sums out all other axes."""
    return h.groupBy(*keys).agg(F.sum(value).alias(value), F.sum(variance).alias(variance))


def rebin(h: DataFrame, axis: Axis, coarse: Axis, others: Sequence[str] = (), value: str = "sumw", variance: str = "sumw2") -> DataFrame:
    """Merges the bins of one axis; an interior bin goes where its middle lies on `coarse`, flow stays flow."""
    binned = h.withColumn(axis.name, merged_bin(axis, coarse, F.col(axis.name))).where(F.col(axis.name).isNotNull())
    return binned.groupBy(*others, replace(coarse, name=axis.name).column(axis.name)).agg(F.sum(value).alias(value), F.sum(variance).alias(variance))


def slice_range(h: DataFrame, axis: Axis, low: float, high: float) -> DataFrame:
    """Bins that lie within [low, high]; flow goes."""
    inside = [k for k in range(axis.bins) if axis.edges[k] >= low and axis.edges[k + 1] <= high]
    return h.where(F.col(axis.name).isin(inside))


def shapes(h: DataFrame, block: Sequence[str], value: str = "sumw") -> DataFrame:
    """Adds flux (the block's sum) and shape (value / flux; null for an empty block)."""
    flux = F.sum(value).over(Window.partitionBy(*block))
    return h.withColumn("flux", flux).withColumn("shape", F.try_divide(F.col(value), F.col("flux")))


def shape_jacobian(h: DataFrame, cell: str, block: str, value: str = "value") -> DataFrame:
    """a, i, d: d shape_a / d value_i = (delta_ai - shape_a) / flux within a block."""
    s = shapes(h, [block], value)
    a = s.select(F.col(block).alias("_b"), F.col(cell).alias("a"), "shape", "flux")
    i = h.select(F.col(block).alias("_b"), F.col(cell).alias("i"))
    return a.join(i, "_b").select("a", "i", F.try_divide(F.when(F.col("a") == F.col("i"), 1.0).otherwise(0.0) - F.col("shape"), F.col("flux")).alias("d"))


def over_profile(h: DataFrame, block: Sequence[str], value: str = "sumw") -> DataFrame:
    """Adds modulation: value over the block's mean value."""
    return h.withColumn("modulation", F.try_divide(F.col(value), F.avg(value).over(Window.partitionBy(*block))))


def _ratio_or(a, b, when_zero: float):
    return F.when(b == 0, F.lit(when_zero)).otherwise(F.try_divide(a, b))


def background_fractions(total: DataFrame, unmatched: DataFrame, outside: DataFrame, key: str) -> DataFrame:
    """key, gamma = (unmatched + outside) / total: a zero total counts as 1, and gamma = 1 as 0."""
    both = unmatched.select(key, F.col("sumw").alias("u")).unionByName(outside.select(key, F.col("sumw").alias("u"))).groupBy(key).agg(F.sum("u").alias("u"))
    j = total.select(key, F.col("sumw").alias("t")).join(both, key, "full")
    u, t = F.coalesce("u", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    g = F.try_divide(u, F.when(t == 0, F.lit(1.0)).otherwise(t))
    return j.select(key, F.when(g == 1, F.lit(0.0)).otherwise(g).alias("gamma"))


def reco_backgrounds(total: DataFrame, background: DataFrame, key: str) -> DataFrame:
    """key, rho = background / (total - background); a denominator that is not positive counts as 1."""
    j = total.select(key, F.col("sumw").alias("t")).join(background.select(key, F.col("sumw").alias("b")), key, "full")
    b, t = F.coalesce("b", F.lit(0.0)), F.coalesce("t", F.lit(0.0))
    return j.select(key, F.try_divide(b, F.when(t - b <= 0, F.lit(1.0)).otherwise(t - b)).alias("rho"))


def response(transfer: DataFrame, gen_total: DataFrame, gen_background: DataFrame, gen: str = "gen") -> DataFrame:
    """reco, gen, t: transfer over the generated sum that is not background; a zero sum counts as 1."""
    pure = gen_total.select(gen, F.col("sumw").alias("t")).join(gen_background.select(gen, F.col("sumw").alias("b")), gen, "left").select(gen, (F.col("t") - F.coalesce("b", F.lit(0.0))).alias("p"))
    p = F.when(F.coalesce("p", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("p"))
    return transfer.join(pure, gen, "left").select("reco", gen, F.try_divide(F.col("sumw"), p).alias("t"))


def fold(truth: DataFrame, resp: DataFrame, gamma: DataFrame, rho: DataFrame) -> DataFrame:
    """reco, value = (T [truth (1 - gamma)]) (1 + rho); truth (gen, value)."""
    g = truth.join(gamma, "gen", "left").select("gen", (F.col("value") * (1 - F.coalesce("gamma", F.lit(0.0)))).alias("v"))
    pure = resp.join(g, "gen").groupBy("reco").agg(F.sum(F.col("t") * F.col("v")).alias("v"))
    return pure.join(rho, "reco", "left").select("reco", (F.col("v") * (1 + F.coalesce("rho", F.lit(0.0)))).alias("value"))


def shifted(nominal: DataFrame, variations: DataFrame, theta: dict[str, float], keys: Sequence[str], value: str) -> DataFrame:
    """nominal + sum over nuisances of theta * variation; variations (nuisance, keys, delta). Linear, cell by cell."""
    weights = F.create_map(*[F.lit(x) for pair in theta.items() for x in pair])
    moved = variations.where(F.col("nuisance").isin(list(theta))).groupBy(*keys).agg(F.sum(F.col("delta") * F.element_at(weights, F.col("nuisance"))).alias("_d"))
    out = nominal.join(moved, list(keys), "full")
    return out.select(*keys, (F.coalesce(value, F.lit(0.0)) + F.coalesce("_d", F.lit(0.0))).alias(value))


def systematic_deltas(wide: DataFrame, keys: Sequence[str], nominal: str, pairs: dict[str, tuple[str, str | None]]) -> DataFrame:
    """nuisance, keys, delta of columns of one table: half of up - down, or one-sided up - nominal; missing bins are 0."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(n).alias("nuisance"), ((c(u) - c(d)) * 0.5 if d else c(u) - c(nominal)).alias("delta")) for n, (u, d) in pairs.items()])
    return wide.select(*keys, F.inline(rows)).select("nuisance", *keys, "delta")


def purity_stability(transfer: DataFrame) -> DataFrame:
    """bin, purity (diagonal over the reco bin's sum), stability (diagonal over the gen bin's sum)."""
    d = transfer.where("reco = gen").select(F.col("reco").alias("bin"), F.col("sumw").alias("d"))
    r = transfer.groupBy(F.col("reco").alias("bin")).agg(F.sum("sumw").alias("r"))
    g = transfer.groupBy(F.col("gen").alias("bin")).agg(F.sum("sumw").alias("g"))
    return d.join(r, "bin").join(g, "bin").select("bin", F.try_divide(F.col("d"), F.col("r")).alias("purity"), F.try_divide(F.col("d"), F.col("g")).alias("stability"))


def vector(key: str, value) -> Column:
    """Aggregate: {key: value} of all rows. As long as the binning; one row of it meets a matrix without shuffling either."""
    value = F.col(value) if isinstance(value, str) else value
    return F.map_from_entries(F.collect_list(F.struct(key, value)))


def _at(v: str, key: str) -> Column:
    return F.coalesce(F.try_element_at(v, F.col(key)), F.lit(0.0))


def quadratic_form(row: DataFrame, d: str, inverse: str) -> DataFrame:
    """chi2 and ndf of one row that holds a vector `d` and the inverse covariance, an array of (i, j, cov)."""
    entries = row.select(d, F.inline(inverse))
    return entries.agg(F.coalesce(F.sum(_at(d, "i") * F.col("cov") * _at(d, "j")), F.lit(0.0)).alias("chi2"), F.max(F.size(d)).cast("long").alias("ndf"))


def chi_square(a: DataFrame, b: DataFrame, inverse: DataFrame) -> DataFrame:
    """chi2 and ndf of two value tables (i, value), given the inverse covariance (i, j, cov)."""
    known = agreed_binning(a, b, ["i"])
    both = a.select("i", F.col("value").alias("d")).unionByName(b.select("i", (-F.col("value")).alias("d")))
    return chi_square_of(carrying(both.groupBy("i").agg(F.sum("d").alias("d")), known), inverse)


def chi_square_of(difference: DataFrame, inverse: DataFrame) -> DataFrame:
    """chi2 and ndf of differences (i, d), given the inverse covariance (i, j, cov); i may be of any one type.

    The differences become one row, as long as the binning, which is broadcast to the matrix: they are read once.
    """
    d = difference.agg(vector("i", "d").alias("_d"))
    met = inverse.crossJoin(F.broadcast(d))  # one row
    chi2 = met.agg(F.coalesce(F.sum(_at("_d", "i") * F.col("cov") * _at("_d", "j")), F.lit(0.0)).alias("chi2"), F.coalesce(F.max(F.size("_d")), F.lit(0)).cast("long").alias("ndf"))
    return chi2


def chi_square_shapes(values: DataFrame, pairs: DataFrame, inverse: DataFrame, axes: Sequence[Axis], block: Sequence[str], within: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """chi2, ndf, expected of the shapes of two spectra within blocks and ranges, for a given inverse covariance (i, j, cov).

    values: (i, x, y) over flat cells of the axes; pairs: (i, j, cov_x, cov_y), the spectra uncorrelated. Shapes are
    taken within each combination of the `block` axes' bins, then cells outside `within` (and flow of its axes) go.
    expected is the trace of the inverse with the shapes' own covariance, J C J^T of both after the same slice: what
    chi2 would be on average if the spectra differed by their errors only.
    """
    bins = slots_of(axes, "i")
    number = F.concat_ws(",", *[bins[n].cast("string") for n in block])
    sliced = F.lit(True)
    for a in axes:
        if within and a.name in within:
            low, high = within[a.name]
            sliced = sliced & bins[a.name].isin([k for k in range(a.bins) if a.edges[k] >= low and a.edges[k + 1] <= high])
    v = values.withColumn("block", number)
    of = Window.partitionBy("block")
    s = v.select("i", "block", *[e for c in ("x", "y") for e in (F.try_divide(F.col(c), F.sum(c).over(of)).alias(f"s{c}"), F.sum(c).over(of).alias(f"f{c}"))])
    kept = s.where(sliced)
    chi2 = chi_square_of(kept.select("i", (F.coalesce("sx", F.lit(0.0)) - F.coalesce("sy", F.lit(0.0))).alias("d")), inverse)
    # d shape_a / d value_i = (delta_ai - shape_a) / flux within a block, for both spectra side by side
    one = F.when(F.col("a") == F.col("i"), 1.0).otherwise(0.0)
    jac = kept.select(F.col("i").alias("a"), "block", "sx", "sy", "fx", "fy").join(v.select("block", "i"), "block")
    jac = jac.select("a", "i", *[F.try_divide(one - F.col(f"s{c}"), F.col(f"f{c}")).alias(f"d{c}") for c in ("x", "y")])
    right = jac.select(F.col("a").alias("b"), F.col("i").alias("j"), F.col("dx").alias("ex"), F.col("dy").alias("ey"))
    half = pairs.join(right, "j").groupBy("i", "b").agg(F.sum(F.col("cov_x") * F.col("ex")).alias("cx"), F.sum(F.col("cov_y") * F.col("ey")).alias("cy"))
    full = jac.join(half, "i").groupBy("a", "b").agg(F.sum(F.coalesce(F.col("dx") * F.col("cx"), F.lit(0.0)) + F.coalesce(F.col("dy") * F.col("cy"), F.lit(0.0))).alias("c"))
    trace = inverse.join(full, (F.col("i") == F.col("a")) & (F.col("j") == F.col("b"))).agg(F.coalesce(F.sum(F.col("cov") * F.col("c")), F.lit(0.0)).alias("expected"))
    return chi2.crossJoin(F.broadcast(trace))  # one row each


def marginalise(cov: DataFrame, k: int) -> DataFrame:
    return cov.where((F.col("i") != k) & (F.col("j") != k))


def _pivots(cov: DataFrame, ks: Sequence[int], values: DataFrame | None = None, at: Sequence[float] = ()) -> DataFrame:
    """One row for conditioning on entries ks one after the other: per step s the covariance's column _c<s> as it is then,
    its diagonal entry _p<s>, and how far the entry moves, _m<s>; and _ks, the entries.

    One aggregation takes all columns; what a step does to the later ones is arithmetic of that row, which is as long
    as the binning times the steps.
    """
    take = [F.map_from_entries(F.collect_list(F.when(F.col("j") == k, F.struct("i", "cov")))).alias(f"_c{s}") for s, k in enumerate(ks)]
    known = F.collect_set(F.when(F.col("i").isin(list(ks)), F.col("i"))).alias("_ks")
    row = cov.agg(*take, known)
    if values is not None:
        entries = values.agg(*[F.max(F.when(F.col("i") == k, F.col("value"))).alias(f"_x{s}") for s, k in enumerate(ks)])
        row = row.crossJoin(F.broadcast(entries))  # one row
    none = F.lit(0.0)
    for s, k in enumerate(ks):
        own = f"_c{s}"
        row = row.withColumn(f"_p{s}", F.try_element_at(own, F.lit(k)))
        if values is not None:
            row = row.withColumn(f"_m{s}", F.lit(float(at[s])) - F.col(f"_x{s}"))
        for t in range(s + 1, len(ks)):
            share = F.coalesce(F.try_element_at(f"_c{t}", F.lit(k)), none) / F.col(f"_p{s}")
            row = row.withColumn("_share", share)
            row = row.withColumn(f"_c{t}", F.map_zip_with(f"_c{t}", own, lambda i, x, y: F.coalesce(x, none) - F.coalesce(y, none) * F.col("_share"))).drop("_share")
            if values is not None:
                row = row.withColumn(f"_x{t}", F.col(f"_x{t}") + F.coalesce(F.try_element_at(own, F.lit(ks[t])), none) / F.col(f"_p{s}") * F.col(f"_m{s}"))
    return row


def condition_on(values: DataFrame, cov: DataFrame, at: dict[int, float]) -> tuple[DataFrame, DataFrame]:
    """Values and covariance given that some entries have these values: a rank-one update each, all in one join.

    Neither table is filtered and read again: what the updates need becomes one row that is broadcast.
    """
    ks = list(at)
    steps = range(len(ks))
    pivot = F.broadcast(_pivots(cov, ks, values, list(at.values())))
    stays = lambda c: ~F.array_contains("_ks", F.col(c))
    moved = sum((_at(f"_c{s}", "i") / F.col(f"_p{s}") * F.col(f"_m{s}") for s in steps), F.lit(0.0))
    less = sum((_at(f"_c{s}", "i") * _at(f"_c{s}", "j") / F.col(f"_p{s}") for s in steps), F.lit(0.0))
    v = values.crossJoin(pivot).where(stays("i")).select("i", (F.col("value") + moved).alias("value"))
    return v, cov.crossJoin(pivot).where(stays("i") & stays("j")).select("i", "j", (F.col("cov") - less).alias("cov"))


def condition(values: DataFrame, cov: DataFrame, k: int, at: float) -> tuple[DataFrame, DataFrame]:
    """Values and covariance given that entry k is `at`."""
    return condition_on(values, cov, {k: at})


def baseline(values: DataFrame, cov: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """x b and C b b^T for a table (i, b)."""
    bi, bj = base.select("i", F.col("b").alias("bi")), base.select(F.col("i").alias("j"), F.col("b").alias("bj"))
    v = values.join(bi, "i").select("i", (F.col("value") * F.col("bi")).alias("value"))
    return v, cov.join(bi, "i").join(bj, "j").select("i", "j", (F.col("cov") * F.col("bi") * F.col("bj")).alias("cov"))


def nuisance_contribution(values: DataFrame, cov: DataFrame, nuisances: Sequence[int], chosen: int) -> DataFrame:
    """i, contribution: variance with only `chosen` free less the variance with all nuisances fixed.

    With the others fixed first, that is what fixing `chosen` takes away. (The values do not matter.)
    """
    ks = [k for k in nuisances if k != chosen] + [chosen]
    last = len(ks) - 1
    out = cov.crossJoin(F.broadcast(_pivots(cov, ks))).where((F.col("i") == F.col("j")) & ~F.array_contains("_ks", F.col("i")))
    return out.select("i", (_at(f"_c{last}", "i") * _at(f"_c{last}", "i") / F.col(f"_p{last}")).alias("contribution"))


def objective(chi2: DataFrame, theta: DataFrame, truth: DataFrame, penalty: float) -> DataFrame:
    """chi2 / 2 + sum theta^2 / 2 + penalty * sum of negative truth, as one row. One table for both is read once."""
    t = F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)).alias("t")
    n = F.coalesce(F.sum(F.greatest(-F.col("value"), F.lit(0.0))), F.lit(0.0)).alias("n")
    terms = theta.agg(t, n) if theta is truth else theta.agg(t).crossJoin(F.broadcast(truth.agg(n)))
    return chi2.select("chi2").crossJoin(F.broadcast(terms)).select((F.col("chi2") / 2 + F.col("t") / 2 + penalty * F.col("n")).alias("loss"))


def remove_background(reco: DataFrame, rho: DataFrame) -> DataFrame:
    """reco, background = rho v / (1 + rho), pure = v - background."""
    b = F.coalesce("rho", F.lit(0.0)) * F.col("value") / (1 + F.coalesce("rho", F.lit(0.0)))
    return reco.join(rho, "reco", "left").select("reco", b.alias("background"), (F.col("value") - b).alias("pure"))


def fold_jacobian(resp: DataFrame, gamma: DataFrame, rho: DataFrame) -> DataFrame:
    """a (reco), i (gen), d: derivative of the fold by the truth at fixed nuisances, for cov.sandwich."""
    j = resp.join(gamma, "gen", "left").join(rho, "reco", "left")
    return j.select(F.col("reco").alias("a"), F.col("gen").alias("i"), (F.col("t") * (1 - F.coalesce("gamma", F.lit(0.0))) * (1 + F.coalesce("rho", F.lit(0.0)))).alias("d"))


# -- comparisons of two binned results


def compare(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """keys, value, variance of a sum, difference, product or ratio of uncorrelated inputs (value, variance).

    A cell that one side lacks is 0 there; a ratio is null where its denominator is 0. Raises if the keys carry different binnings.
    """
    known = agreed_binning(a, b, keys)
    j = a.select(*keys, F.col("value").alias("_x"), F.col("variance").alias("_vx")).join(b.select(*keys, F.col("value").alias("_y"), F.col("variance").alias("_vy")), list(keys), "full")
    x, vx, y, vy = (F.coalesce(c, F.lit(0.0)) for c in ("_x", "_vx", "_y", "_vy"))
    value, variance = {
        "sum": (x + y, vx + vy),
        "difference": (x - y, vx + vy),
        "product": (x * y, vx * y * y + vy * x * x),
        "ratio": (F.try_divide(x, y), F.try_divide(vx, y * y) + F.try_divide(vy * x * x, y * y * y * y)),
    }[how]
    return carrying(j.select(*keys, value.alias("value"), variance.alias("variance")), known)


def compare_covariance(cov_a: DataFrame, cov_b: DataFrame, a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """(i, j, cov) of the comparison: C = Da Ca Da + Db Cb Db with the derivatives of each cell."""
    if how in ("sum", "difference"):
        return cov_a.unionByName(cov_b).groupBy("i", "j").agg(F.sum("cov").alias("cov"))
    j = a.select("i", F.col("value").alias("x")).join(b.select("i", F.col("value").alias("y")), "i")
    if how == "product":
        da, db = F.col("y"), F.col("x")
    else:
        da, db = F.try_divide(F.lit(1.0), F.col("y")), -F.try_divide(F.col("x"), F.col("y") * F.col("y"))

    def part(cov, d):
        left, right = j.select("i", d.alias("di")), j.select(F.col("i").alias("j"), d.alias("dj"))
        return cov.join(left, "i").join(right, "j").select("i", "j", (F.col("cov") * F.col("di") * F.col("dj")).alias("cov"))

    return part(cov_a, da).unionByName(part(cov_b, db)).groupBy("i", "j").agg(F.sum("cov").alias("cov"))


def ratio_covariance(pairs: DataFrame, values: DataFrame, x: str = "x", y: str = "y", cov_x: str = "cov_x", cov_y: str = "cov_y") -> DataFrame:
    """(i, j, cov) of x / y per cell, x and y uncorrelated, of covariances side by side (i, j, cov_x, cov_y) and values (i, x, y).

    The values become one row, as long as the binning, which is broadcast. Null where y is 0.
    """
    v = F.broadcast(values.agg(vector("i", x).alias("_x"), vector("i", y).alias("_y")))
    xi, xj, yi, yj = (F.try_element_at(v_, F.col(k)) for v_ in ("_x", "_y") for k in ("i", "j"))
    cov = F.try_divide(F.col(cov_x), yi * yj) + F.try_divide(F.col(cov_y) * xi * xj, yi * yi * yj * yj)
    return pairs.crossJoin(v).select("i", "j", cov.alias("cov"))
