"""Corrections derived from the ratio of two histograms and applied to the events they came from.

Every step is as long as an axis: the ratio of the two shapes, its smoothing over neighbouring bins, and a lookup by
the bin that each event falls in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axes import Axis
from ..functions.lookup import BROADCAST_ROWS
from .smooth import moving_average


def side_by_side(df: DataFrame, axis: Axis, value: Column | str, numerator: Column, weight: Column | str = 1.0) -> DataFrame:
    """The axis's bin, n, n2, d, d2: sums of the weight and its square for rows that are of the numerator and those that are not.

    One pass over both; rows without a bin, and those for which `numerator` is null, count for neither.
    """
    w = F.lit(float(weight)) if isinstance(weight, int | float) else weight if isinstance(weight, Column) else F.col(weight)
    rows = df.select(axis.index(value).alias("_bin"), numerator.alias("_n"), w.alias("_w")).where("_bin is not null")
    of = lambda is_n, x: F.coalesce(F.sum(F.when(F.col("_n") == is_n, x)), F.lit(0.0))
    w = F.col("_w")
    return rows.groupBy(axis.column("_bin")).agg(of(True, w).alias("n"), of(True, w * w).alias("n2"), of(False, w).alias("d"), of(False, w * w).alias("d2"))


def shape_ratio(h: DataFrame, axis: Axis) -> DataFrame:
    """Adds ratio and error of both sides' shapes (each over its own total), uncorrelated; null where the denominator has nothing."""
    every = Window.partitionBy()  # as long as the axis
    h_ = h.select(*h.columns, F.sum("n").over(every).alias("_n"), F.sum("d").over(every).alias("_d"))
    n, d = F.try_divide(F.col("n"), F.col("_n")), F.try_divide(F.col("d"), F.col("_d"))
    vn, vd = F.try_divide(F.col("n2"), F.col("_n") * F.col("_n")), F.try_divide(F.col("d2"), F.col("_d") * F.col("_d"))
    error = F.sqrt(F.try_divide(vn, d * d) + F.try_divide(n * n * vd, d * d * d * d))
    return h_.select(*h.columns, F.try_divide(n, d).alias("ratio"), error.alias("error"))


def correction(ratio: DataFrame, axis: Axis, neighbours: int = 0, by_error: bool = False) -> DataFrame:
    """The axis's bin and value: the ratio, averaged over `neighbours` bins on both sides. Bins without a ratio have none.

    Flow bins are left as they are and lend nothing to their neighbours; bins without a ratio are left out. With errors
    a bin weighs 1 / error, and one without an error counts not at all.
    """
    if not neighbours:
        return ratio.select(axis.name, F.col("ratio").alias("value"))
    number = F.col(axis.name)
    inside = number.between(0, axis.bins - 1)
    usable = F.col("ratio").isNotNull() & (~inside | (F.col("error") > 0) if by_error else F.lit(True))
    rows = ratio.withColumn("_flow", F.when(~inside, number)).where(usable)
    smooth = moving_average(rows, axis.name, "ratio", neighbours, "error" if by_error else None, by=["_flow"], into="_smooth")
    return smooth.select(axis.name, F.when(inside, F.col("_smooth")).otherwise(F.col("ratio")).alias("value"))


def corrected(df: DataFrame, table: DataFrame, axis: Axis, value: Column | str, into: str = "correction") -> DataFrame:
    """Adds the correction of the bin that each row falls in; 1 where there is none. The table is broadcast, as it has no
    more rows than the axis has slots."""
    cells = table.select(F.col(axis.name).alias("_bin"), F.col("value").alias("_value"))
    cells = F.broadcast(cells) if axis.extent <= BROADCAST_ROWS else cells
    out = df.withColumn("_bin", axis.index(value)).join(cells, "_bin", "left")
    return out.select(*df.columns, F.coalesce("_value", F.lit(1.0)).alias(into))
