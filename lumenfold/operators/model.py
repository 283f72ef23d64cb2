"""The detector model with nuisances: response, background fractions and their variations, and the fold they give.

A filled table has a row per (variation, gen, reco, role) with a weight `w`; role "in" is matched, all others are
background. Every matrix of every variation comes from it by grouping, so all variations cost one pass over the items.
Variations of the weight are columns of that pass (`filled`), variations of the objects are rows of other partitions
that arrive beside the nominal ones (`filled_from_partitions`): after that they are treated alike.

T, gamma and rho are each linear in the nuisances theta, the fold is not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lookup import local
from . import algebra
from .hist import gathered

NOMINAL = "nominal"


@dataclass(frozen=True)
class Nuisance:
    """A systematic and how its variations are named: of weights nameUp and nameDown, of objects name_UP and name_DN; a
    one-sided one is its name alone. `transfer` says whether the response varies with it."""

    name: str
    one_sided: bool = False
    objects: bool = False
    transfer: bool = True

    @property
    def variations(self) -> tuple[str, str | None]:
        if self.one_sided:
            return self.name, None
        up, down = ("_UP", "_DN") if self.objects else ("Up", "Down")
        return self.name + up, self.name + down


def names(nuisances: Sequence[Nuisance]) -> list[str]:
    """All variations, the nominal one first."""
    return [NOMINAL, *(v for n in nuisances for v in n.variations if v)]


def filled(rows: DataFrame, gen: str, reco: str, role: Column, weights: dict[str, Column], most: int | None = None) -> DataFrame:
    """variation, gen, reco, role, w: sums under every weight from one aggregation of the rows.

    `most` bounds the cells (gen, reco, role), as the axes' extents do; what follows then needs no shuffle if they are few.
    """
    wide = rows.groupBy(F.col(gen).alias("gen"), F.col(reco).alias("reco"), role.alias("role")).agg(*[F.sum(w).alias(f"w_{n}") for n, w in weights.items()])
    wide = wide if most is None else gathered(wide, most * len(weights))
    each = F.array(*[F.struct(F.lit(n).alias("variation"), F.col(f"w_{n}").alias("w")) for n in weights])
    return wide.select("gen", "reco", "role", F.inline(each))


def filled_from_partitions(table: DataFrame, variation: str = "objsyst", most: int | None = None) -> DataFrame:
    """variation, gen, reco, role, w of a table that holds each object systematic in rows (partitions) of its own.

    One aggregation over all partitions: their outer union. A cell that a partition lacks is no row. `most` bounds the
    rows, as in `filled`.
    """
    cells = table.groupBy(F.col(variation).alias("variation"), "gen", "reco", "role").agg(F.sum("w").alias("w"))
    return cells if most is None else gathered(cells, most)


def _sums(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, total and background: the background is what was not matched."""
    w = F.col("w")
    return cells.groupBy(*keys).agg(F.sum(w).alias("total"), F.coalesce(F.sum(F.when(F.col("role") != "in", w)), F.lit(0.0)).alias("background"))


def gammas(cells: DataFrame) -> DataFrame:
    """variation, gen, value: the background's share; a zero total counts as 1 and a share of 1 as 0."""
    g = F.try_divide(F.col("background"), F.when(F.col("total") == 0, F.lit(1.0)).otherwise(F.col("total")))
    return _sums(cells, ["variation", "gen"]).select("variation", "gen", F.when(g == 1, F.lit(0.0)).otherwise(g).alias("value"))


def rhos(cells: DataFrame) -> DataFrame:
    """variation, reco, value: background over the rest; a rest that is not positive counts as 1."""
    rest = F.col("total") - F.col("background")
    return _sums(cells, ["variation", "reco"]).select("variation", "reco", F.try_divide(F.col("background"), F.when(rest <= 0, F.lit(1.0)).otherwise(rest)).alias("value"))


def responses(cells: DataFrame) -> DataFrame:
    """variation, reco, gen, value: matched weight over the generated one that is not background; a zero sum counts as 1."""
    pure = _sums(cells, ["variation", "gen"]).select("variation", "gen", (F.col("total") - F.col("background")).alias("_pure"))
    met = cells.groupBy("variation", "reco", "gen").agg(F.sum(F.when(F.col("role") == "in", F.col("w"))).alias("_in")).where("_in is not null")
    return met.join(pure, ["variation", "gen"]).select("variation", "reco", "gen", F.try_divide(F.col("_in"), F.when(F.col("_pure") == 0, F.lit(1.0)).otherwise(F.col("_pure"))).alias("value"))


def deltas(varied: DataFrame, keys: Sequence[str], nuisances: Sequence[Nuisance]) -> DataFrame:
    """nuisance, keys, delta: half of up - down, or one-sided variation - nominal; bins that a variation lacks are 0."""
    pairs = {n.name: n.variations for n in nuisances}
    wide = varied.groupBy(*keys).pivot("variation", names(nuisances)).agg(F.sum("value"))
    return algebra.systematic_deltas(wide, keys, NOMINAL, pairs)


def at(varied: DataFrame, keys: Sequence[str], nuisances: Sequence[Nuisance], theta: DataFrame) -> DataFrame:
    """keys, value = nominal + sum over nuisances of theta x delta: the variations contracted with theta (nuisance, theta).

    One aggregation: every variation of a cell enters with its own coefficient, the nominal one with 1, less theta for
    each one-sided nuisance. Nuisances that theta does not list are at 0; theta is a short table and is broadcast if
    its rows are the driver's own (`lookup.local`).
    """
    half = [(n.name, v, c) for n in nuisances if not n.one_sided for v, c in zip(n.variations, (0.5, -0.5), strict=True)]
    one = [(n.name, v, c) for n in nuisances if n.one_sided for v, c in ((n.name, 1.0), (NOMINAL, -1.0))]
    share = F.array(*[F.struct(F.lit(n).alias("nuisance"), F.lit(v).alias("variation"), F.lit(c).alias("_share")) for n, v, c in [*half, *one]]) if half or one else None
    nominal = varied.where(F.col("variation") == NOMINAL) if share is None else varied
    if share is None:
        return nominal.groupBy(*keys).agg(F.sum("value").alias("value"))
    moved = theta.select("nuisance", "theta", F.inline(F.filter(share, lambda s: s["nuisance"] == F.col("nuisance")))).toDF("nuisance", "theta", "_of", "variation", "_share")
    weights = moved.groupBy("variation").agg(F.sum(F.col("theta") * F.col("_share")).alias("_moved"))
    factor = F.coalesce("_moved", F.lit(0.0)) + F.when(F.col("variation") == NOMINAL, 1.0).otherwise(0.0)
    # no more rows than there are variations
    return varied.join(F.broadcast(weights), "variation", "left").groupBy(*keys).agg(F.sum(F.col("value") * factor).alias("value"))


def truth(cells: DataFrame) -> DataFrame:
    """gen, value: the nominal generated sums."""
    nominal = F.when(F.col("variation") == NOMINAL, F.col("w"))
    return cells.groupBy("gen").agg(F.sum(nominal).alias("value")).where("value is not null")


def _matrices(cells: DataFrame, nuisances: Sequence[Nuisance], theta: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T (reco, gen, t), gamma (gen, gamma) and rho (reco, rho) at theta."""
    gamma = at(gammas(cells), ["gen"], nuisances, theta).withColumnRenamed("value", "gamma")
    rho = at(rhos(cells), ["reco"], nuisances, theta).withColumnRenamed("value", "rho")
    t = at(responses(cells), ["reco", "gen"], [n for n in nuisances if n.transfer], theta).withColumnRenamed("value", "t")
    return t, gamma, rho


def fold(beta: DataFrame, cells: DataFrame, nuisances: Sequence[Nuisance], theta: DataFrame) -> DataFrame:
    """reco, value = T(theta) [beta (1 - gamma(theta))] (1 + rho(theta)) of a truth (gen, value)."""
    return algebra.fold(beta, *_matrices(cells, nuisances, theta))


def jacobian(beta: DataFrame, cells: DataFrame, nuisances: Sequence[Nuisance], theta: DataFrame) -> DataFrame:
    """a (reco), i (parameter), d: derivatives of the fold at (beta, theta) by every truth bin ("gen:" and its number) and nuisance.

    By a nuisance the three linear forms give three terms: dT [beta (1 - gamma)] (1 + rho) - T [beta dgamma] (1 + rho)
    + T [beta (1 - gamma)] drho. For `cov.sandwich` with a covariance of the same parameters.
    """
    t, gamma, rho = _matrices(cells, nuisances, theta)
    by_gen = algebra.fold_jacobian(t, gamma, rho).select("a", F.concat(F.lit("gen:"), F.col("i")).alias("i"), "d")
    if not nuisances:
        return by_gen
    truth_ = beta.join(gamma, "gen", "left").select("gen", "value", (F.col("value") * (1 - F.coalesce("gamma", F.lit(0.0)))).alias("pure"))
    met = [n for n in nuisances if n.transfer]
    moved = deltas(responses(cells), ["reco", "gen"], met).join(truth_, "gen").select("nuisance", "reco", (F.col("delta") * F.col("pure")).alias("x")) if met else None
    lost = deltas(gammas(cells), ["gen"], nuisances).join(truth_, "gen").join(t, "gen").select("nuisance", "reco", (-F.col("t") * F.col("value") * F.col("delta")).alias("x"))
    lost = lost if moved is None else lost.unionByName(moved)
    scaled = lost.groupBy("nuisance", "reco").agg(F.sum("x").alias("x")).join(rho, "reco", "left").select("nuisance", "reco", (F.col("x") * (1 + F.coalesce("rho", F.lit(0.0)))).alias("x"))
    folded = t.join(truth_, "gen").groupBy("reco").agg(F.sum(F.col("t") * F.col("pure")).alias("_p"))
    more = deltas(rhos(cells), ["reco"], nuisances).join(folded, "reco").select("nuisance", "reco", (F.col("delta") * F.col("_p")).alias("x"))
    by_nuisance = scaled.unionByName(more).groupBy("nuisance", "reco").agg(F.sum("x").alias("d"))
    return by_gen.unionByName(by_nuisance.select(F.col("reco").alias("a"), F.col("nuisance").alias("i"), "d"))


def parameter_covariance(gen: DataFrame, nuisances: Sequence[Nuisance]) -> DataFrame:
    """i, j, cov over the parameters of `jacobian`: the truth's (gen, variance) without correlations, and unit priors."""
    own = gen.select(F.concat(F.lit("gen:"), F.col("gen")).alias("i"), F.col("variance").cast("double").alias("cov"))
    if nuisances:
        own = own.unionByName(local(gen.sparkSession, [(n.name, 1.0) for n in nuisances], "i string, cov double"))
    return own.select("i", F.col("i").alias("j"), "cov")


def folds(cells: DataFrame) -> DataFrame:
    """variation, reco, value: every variation's own truth through its own matrices, as for replicas of the events."""
    g = gammas(cells).withColumnRenamed("value", "gamma")
    beta = cells.groupBy("variation", "gen").agg(F.sum("w").alias("b")).join(g, ["variation", "gen"]).select("variation", "gen", (F.col("b") * (1 - F.col("gamma"))).alias("pure"))
    pure = responses(cells).join(beta, ["variation", "gen"]).groupBy("variation", "reco").agg(F.sum(F.col("value") * F.col("pure")).alias("p"))
    rho = rhos(cells).withColumnRenamed("value", "rho")
    return pure.join(rho, ["variation", "reco"], "left").select("variation", "reco", (F.col("p") * (1 + F.coalesce("rho", F.lit(0.0)))).alias("value"))
