"""Smoothing of binned ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving_average(df: DataFrame, order: str, value: str, half: int, error: str | None = None, by: Sequence[str] = (), into: str = "smoothed") -> DataFrame:
    """Mean of `half` neighbours on both sides, fewer at the ends; with errors the weights are 1 / error.

    Without `by` all bins share one window: meant for binned tables, which are as long as their axes.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    if error is None:
        out = F.avg(value).over(w)
    else:
        out = F.try_divide(F.sum(F.try_divide(F.col(value), F.col(error))).over(w), F.sum(F.try_divide(F.lit(1.0), F.col(error))).over(w))
    return df.withColumn(into, out)


def gaussian_kernel(df: DataFrame, edge: str, value: str, sigma: float, error: str | None = None, by: Sequence[str] = (), into: str = "smoothed") -> DataFrame:
    """Weights exp(-((edge_j - edge_i) / sigma)^2 / 2), over the error if given; all bins of a group count.

    A group's bins, whose number is its axis length, are laid beside each row as one array.
    """
    other = F.struct(F.col(edge).cast("double").alias("x"), F.col(value).cast("double").alias("v"), (F.col(error) if error else F.lit(1.0)).cast("double").alias("e"))
    every = df.groupBy(*by).agg(F.sort_array(F.collect_list(other)).alias("_all"))
    joined = df.join(every, list(by)) if by else df.crossJoin(F.broadcast(every))  # one row
    k = lambda o: F.exp(F.pow((o["x"] - F.col(edge)) / sigma, F.lit(2)) * -0.5) / o["e"]
    top = F.aggregate("_all", F.lit(0.0), lambda s, o: s + k(o) * o["v"])
    bottom = F.aggregate("_all", F.lit(0.0), lambda s, o: s + k(o))
    return joined.withColumn(into, F.try_divide(top, bottom)).drop("_all")
