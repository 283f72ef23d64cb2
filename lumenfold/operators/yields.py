"""Yields, efficiencies, totals and percentages: one scan with conditional sums, whatever the number of bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookup import local


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def yields(df: DataFrame, dataset: str, bins: dict[str, Column], weight, base: Column | None = None) -> DataFrame:
    """dataset, bin, n: sum of weights of each bin's cut (and the base cut). Bins may overlap."""
    rows = df if base is None else df.where(base)
    sums = [F.coalesce(F.sum(F.when(c, _col(weight))), F.lit(0.0)).alias(f"b{k}") for k, c in enumerate(bins.values())]
    wide = rows.groupBy(dataset).agg(*sums)
    return wide.select(dataset, F.inline(F.array(*[F.struct(F.lit(n).alias("bin"), F.col(f"b{k}").alias("n")) for k, n in enumerate(bins)])))


def efficiencies(df: DataFrame, dataset: str, bins: dict[str, Column], weight, base: Column, passing: Column, extra: Column | None = None) -> DataFrame:
    """dataset, bin, num, den, efficiency (0 where den is 0). The numerator takes the passing cut, not the base one."""
    extra = F.lit(True) if extra is None else extra
    sums = []
    for k, c in enumerate(bins.values()):
        sums += [F.coalesce(F.sum(F.when(passing & c & extra, _col(weight))), F.lit(0.0)).alias(f"n{k}"), F.coalesce(F.sum(F.when(base & c & extra, _col(weight))), F.lit(0.0)).alias(f"d{k}")]
    wide = df.groupBy(dataset).agg(*sums)
    rows = F.array(*[F.struct(F.lit(n).alias("bin"), F.col(f"n{k}").alias("num"), F.col(f"d{k}").alias("den")) for k, n in enumerate(bins)])
    return wide.select(dataset, F.inline(rows)).withColumn("efficiency", _efficiency())


def _efficiency() -> Column:
    return F.when(F.col("den") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("num"), F.col("den")))


def with_totals(table: DataFrame, dataset: str, totals: dict[str, Sequence[str]]) -> DataFrame:
    """Adds a row set per total: yields add, efficiencies are the ratio of summed numerators and denominators."""
    members = local(table.sparkSession, [(t, m) for t, ms in totals.items() for m in ms], f"_total string, `{dataset}` string")
    joined = table.join(members, dataset)
    ratio = "num" in table.columns
    sums = [F.sum(c).alias(c) for c in (("num", "den") if ratio else ("n",))]
    added = joined.groupBy(F.col("_total").alias(dataset), "bin").agg(*sums)
    return table.unionByName(added.withColumn("efficiency", _efficiency()) if ratio else added)


def percentages(table: DataFrame, dataset: str, reference: str) -> DataFrame:
    """Adds percent = 100 n / the reference row's n in the same bin; 0 where that is 0. A bin has a row per dataset."""
    out = table.withColumn("_ref", F.max(F.when(F.col(dataset) == reference, F.col("n"))).over(Window.partitionBy("bin")))
    p = F.when(F.coalesce("_ref", F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("n") * 100, F.col("_ref")))
    return out.withColumn("percent", p).drop("_ref")


def pivoted(table: DataFrame, dataset: str, bins: Sequence[str], value: str = "n") -> DataFrame:
    """Datasets as rows, the listed bins as columns; listing them spares the pass that would look for them."""
    return table.groupBy(dataset).pivot("bin", list(bins)).agg(F.first(value))


def chosen_bins(table: DataFrame, labels: Sequence[str]) -> DataFrame:
    return table.where(F.col("bin").isin(list(labels)))


def rates(df: DataFrame, bin_: Column, value, weight) -> DataFrame:
    """bin, rate = sum(w v) / sum(w), null where the weights add up to 0."""
    g = df.groupBy(bin_.alias("bin")).agg(F.sum(_col(weight) * _col(value)).alias("_n"), F.sum(_col(weight)).alias("_d"))
    return g.select("bin", F.try_divide(F.col("_n"), F.col("_d")).alias("rate"))


def ratio_with_errors(num: DataFrame, den: DataFrame, keys: Sequence[str], lumi: float = 1.0) -> DataFrame:
    """keys, ratio, error of two histograms (sumw, sumw2); `lumi` scales the denominator."""
    j = num.select(*keys, F.col("sumw").alias("n"), F.col("sumw2").alias("n2")).join(den.select(*keys, (F.col("sumw") * lumi).alias("d"), (F.col("sumw2") * lumi * lumi).alias("d2")), list(keys))
    n, d = F.col("n"), F.col("d")
    error = F.sqrt(F.try_divide(F.col("n2"), d * d) + F.try_divide(n * n * F.col("d2"), d * d * d * d))
    return j.select(*keys, F.try_divide(n, d).alias("ratio"), error.alias("error"))
