"""Weighted histograms as long tables (bin columns, sumw, sumw2)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axes import Axis, agreed_binning, grid
from ..functions.expr import unsigned_mod
from ..functions.lookup import BROADCAST_ROWS


#: Rows of a binned table up to which it is gathered in one partition.
GATHERED = 100_000


def gathered(h: DataFrame, cells: int) -> DataFrame:
    """A binned table that its axes bound to `cells` rows: in one partition if these are few, so that grouping and joining it
    needs no further shuffle. The aggregation that made it stays spread over its tasks up to their partial sums."""
    return h.coalesce(1) if cells <= GATHERED else h


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def with_bins(df: DataFrame, axes: Sequence[Axis], values: Sequence[Column | str] | None = None) -> DataFrame:
    """Adds one index column per axis and drops rows that have no slot on some axis."""
    out = df
    for a, v in zip(axes, values or [a.name for a in axes], strict=True):
        out = out.withColumn(f"_bin_{a.name}", a.index(v))
    return out.where(" AND ".join(f"`_bin_{a.name}` IS NOT NULL" for a in axes))


def histogram(df: DataFrame, axes: Sequence[Axis], values: Sequence[Column | str] | None = None, weight=1.0, by: Sequence[str] = ()) -> DataFrame:
    """by..., one index column per axis (which carries the axis's binning), sumw, sumw2 and n. Cells without rows are absent (see `dense`).

    One partial aggregation: the shuffle carries one row per cell and task.
    """
    w = F.lit(weight) if isinstance(weight, int | float) else _col(weight)
    filled = with_bins(df.withColumn("_w", w), axes, values)
    keys = [*by, *[a.column(f"_bin_{a.name}") for a in axes]]
    return filled.groupBy(*keys).agg(F.sum("_w").alias("sumw"), F.sum(F.col("_w") * F.col("_w")).alias("sumw2"), F.count(F.lit(1)).alias("n"))


def variations(df: DataFrame, axes: Sequence[Axis], weights: dict[str, Column | str], values: Sequence[Column | str] | None = None) -> DataFrame:
    """variation, bins, sumw, sumw2 for all weights in one scan and one aggregation."""
    filled = with_bins(df, axes, values)
    sums = [x for n, w in weights.items() for x in (F.sum(_col(w)).alias(f"{n}__w"), F.sum(_col(w) * _col(w)).alias(f"{n}__w2"))]
    wide = filled.groupBy(*[a.column(f"_bin_{a.name}") for a in axes]).agg(*sums)
    rows = F.array(*[F.struct(F.lit(n).alias("variation"), F.col(f"{n}__w").alias("sumw"), F.col(f"{n}__w2").alias("sumw2")) for n in weights])
    return wide.select(*[a.name for a in axes], F.inline(rows))


def dense(h: DataFrame, axes: Sequence[Axis]) -> DataFrame:
    """All cells of the axes, zeros where the histogram has none."""
    names = [a.name for a in axes]
    rest = [c for c in h.columns if c not in names]
    cells = math.prod(len(a.slots()) for a in axes)  # the histogram has no more rows
    out = grid(h.sparkSession, axes).join(F.broadcast(h) if set(rest) <= {"n", "sumw", "sumw2"} and cells <= BROADCAST_ROWS else h, names, "left")
    return out.select(*names, *[F.coalesce(c, F.lit(0).cast(h.schema[c].dataType)).alias(c) for c in rest])


def statistical_split(df: DataFrame, identity, n: int, k: int | Sequence[int]) -> DataFrame:
    """Rows whose unsigned id modulo n is k (or one of k); all rows if n is not positive."""
    if n <= 0:
        return df
    ks = [k] if isinstance(k, int) else list(k)
    return df.where(unsigned_mod(identity, n).isin(ks))


def combine_splits(h: DataFrame, keys: Sequence[str], split: str = "statk", keep: Sequence[int] | None = None, into: int | None = None) -> DataFrame:
    """Adds splits up (all, or those in `keep`), or re-splits to a divisor: the new number is the old modulo `into`."""
    if keep is not None:
        h = h.where(F.col(split).isin(list(keep)))
    by = [*keys]
    if into is not None:
        h = h.withColumn(split, F.col(split) % into)
        by = [split, *keys]
    return h.groupBy(*by).agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"))


def split_sums(h: DataFrame, keys: Sequence[str], wanted: dict[str, Sequence[int] | None], split: str = "statk", value: str = "sumw") -> DataFrame:
    """keys and a sum per entry of `wanted` over its splits (None: all), side by side in one aggregation."""
    one = lambda ks: F.col(value) if ks is None else F.when(F.col(split).isin(list(ks)), F.col(value))
    return h.groupBy(*keys).agg(*[F.sum(one(ks)).alias(n) for n, ks in wanted.items()])


def transfer(df: DataFrame, reco: Sequence[tuple[Axis, Column | str]], gen: Sequence[tuple[Axis, Column | str]], weight) -> DataFrame:
    """Reco bins (suffix _reco), gen bins (suffix _gen), sumw, sumw2 in one aggregation."""
    from dataclasses import replace

    axes = [replace(a, name=f"{a.name}_reco") for a, _ in reco] + [replace(a, name=f"{a.name}_gen") for a, _ in gen]
    return histogram(df, axes, [v for _, v in [*reco, *gen]], weight)


def density(h: DataFrame, axes: Sequence[Axis], radial: Sequence[str] = (), clip: float | None = None) -> DataFrame:
    """Adds density = sumw / (total * widths); flow cells have none. Radial axes have width (hi^2 - lo^2) / 2."""
    out = with_widths(h, axes, radial, clip)
    total = F.sum("sumw").over(Window.partitionBy())
    return out.withColumn("density", F.try_divide(F.col("sumw"), total * F.col("width"))).drop("width")


def with_widths(h: DataFrame, axes: Sequence[Axis], radial: Sequence[str] = (), clip: float | None = None) -> DataFrame:
    """Adds `width`, the product of bin widths; an infinite edge is cut to `clip`, or the width is null."""
    width = F.lit(1.0)
    for a in axes:
        cases = None
        for k in a.slots():
            lo = -float("inf") if k < 0 else a.edges[k]
            hi = float("inf") if k >= a.bins else a.edges[k + 1]
            hi = clip if hi == float("inf") and clip is not None else hi
            w = None if abs(lo) == float("inf") or abs(hi) == float("inf") else (hi * hi - lo * lo) / 2 if a.name in radial else hi - lo
            cases = (F if cases is None else cases).when(F.col(a.name) == k, F.lit(w).cast("double"))
        width = width * cases
    return h.withColumn("width", width)


def scaled_to(h: DataFrame, other: DataFrame, axis: str, first: int) -> DataFrame:
    """`h` scaled so that its sum over bins >= first equals the other's. One row of two sums is joined to all cells.

    Raises if the axis carries different binnings."""
    agreed_binning(h, other, [axis])
    a = h.agg(F.sum(F.when(F.col(axis) >= first, F.col("sumw"))).alias("_a"))
    b = other.agg(F.sum(F.when(F.col(axis) >= first, F.col("sumw"))).alias("_b"))
    f = F.try_divide(F.col("_b"), F.col("_a"))
    out = h.crossJoin(F.broadcast(a.crossJoin(b)))  # one row
    return out.withColumn("sumw", F.col("sumw") * f).withColumn("sumw2", F.col("sumw2") * f * f).drop("_a", "_b")


def same_binning(a: Sequence[Axis], b: Sequence[Axis]) -> None:
    """Refuses to mix binnings that the driver holds; of tables: `axes.agreed_binning`."""
    if list(a) != list(b):
        raise ValueError("the binnings differ")
