"""Corrections: binned tables and piecewise polynomials, joined by bin index.

A correction table has one row per cell, so it is small by construction. Tables of rows that the driver holds (`local`)
are broadcast, as their length is known; all others are left to the planner, which knows or measures their size. So
building a plan never runs a job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .axes import Axis

#: Rows up to which a correction is broadcast (some tens of MB).
BROADCAST_ROWS = 500_000


def local(spark: SparkSession, rows: Sequence[tuple], schema: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """A table of the driver's own rows, with a broadcast hint if there are no more than `most`. The hint outlives a select."""
    table = spark.createDataFrame(list(rows), schema)
    return F.broadcast(table) if len(rows) <= most else table


def binned_lookup(
    df: DataFrame, table: DataFrame, axes: Sequence[tuple[Axis, Column | str]], value: str = "value", keys: Sequence[str] = (), default: float | None = 1.0, into: str = "correction"
) -> DataFrame:
    """Adds the value of the cell that each row falls in.

    `table` (see `local`) has a bin column named like each axis, the `keys` columns (compared by equality) and `value`. An axis
    with `clamp` uses its outer bins beyond its range; otherwise such rows, like nulls, get the default.
    """
    bins = {f"_bin_{a.name}": a.index(c) for a, c in axes}
    cells = table.select(*[F.col(a.name).alias(f"_bin_{a.name}") for a, _ in axes], *keys, F.col(value).alias("_value"))
    out = df.withColumns(bins).join(cells, [*bins, *keys], "left")
    found = F.col("_value") if default is None else F.coalesce("_value", F.lit(default))
    return out.withColumn(into, found).drop(*bins, "_value").select(*df.columns, into)


def range_lookup(df: DataFrame, ranges: Sequence[tuple[float, float, float]] | DataFrame, x: str, default: float = 1.0, into: str = "correction") -> DataFrame:
    """The value of the range (lo, hi, value) with lo <= x < hi; ranges need not make up an axis. There is no equal key, so
    there must be few of them; those of a table are brought to the driver to know that."""
    rows = ranges.select("lo", "hi", "value").take(BROADCAST_ROWS + 1) if isinstance(ranges, DataFrame) else ranges
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("a range table of this size needs an axis: use binned_lookup")
    r = local(df.sparkSession, rows, "_lo double, _hi double, _value double")
    out = df.join(r, (F.col(x) >= F.col("_lo")) & (F.col(x) < F.col("_hi")), "left")
    return out.select(*[df[c] for c in df.columns], F.coalesce("_value", F.lit(default)).alias(into))


def polynomial(x, segments: Sequence[tuple[float, float, float, float, float, float]]) -> Column:
    """Segments (x0, x1, p1, p2, p3, p4): p1 + p2 d + p3 d^2 + p4 d^3 with d = x - x0; constant beyond both ends."""
    x = x if isinstance(x, Column) else F.col(x)
    inside = F.greatest(F.least(x, F.lit(segments[-1][1])), F.lit(segments[0][0]))

    def horner(s):
        d = inside - F.lit(s[0])
        return F.lit(s[2]) + d * (F.lit(s[3]) + d * (F.lit(s[4]) + d * F.lit(s[5])))

    out = horner(segments[-1])
    for s in reversed(segments[:-1]):
        out = F.when(inside < s[1], horner(s)).otherwise(out)
    return F.when(x.isNotNull(), out)


def efficiency_pair(df: DataFrame, table: DataFrame, legs: Sequence[tuple[str, str]], eta: Axis, pt: Axis, into: str = "sf") -> DataFrame:
    """Product over legs (eta column, pt column) of the cell's value at (abs(eta), pt); 1 outside the table or for nulls."""
    out = df.withColumn(into, F.lit(1.0))
    for k, (e, p) in enumerate(legs):
        out = binned_lookup(out, table, [(eta, F.abs(F.col(e))), (pt, p)], into=f"_leg{k}")
        out = out.withColumn(into, F.col(into) * F.col(f"_leg{k}")).drop(f"_leg{k}")
    return out
