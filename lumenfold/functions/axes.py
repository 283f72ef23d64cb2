"""Histogram axes as driver-side values and bin indices as Column expressions.

A bin index is 0 to n - 1 inside the axis, -1 for underflow, n for overflow, and null where a value has no slot.
Bins are half-open; the last one is closed only where there is no overflow slot. NaN counts as overflow.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Key of a bin column's metadata under which its binning is kept, also in Parquet files.
BINNING = "binning"
#: Axes with at most this many edges become a chain of comparisons; longer ones search an array literal.
CHAIN = 32


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Axis:
    name: str
    edges: tuple[float, ...]
    underflow: bool = True
    overflow: bool = True
    clamp: bool = False
    even: bool = False  # equal widths (of the transformed value): the index is arithmetic
    transform: str | None = None  # None, "log" or "sqrt"

    @classmethod
    def regular(cls, name: str, bins: int, start: float, stop: float, transform: str | None = None, **flow) -> Axis:
        f, back = {None: (float, float), "log": (math.log, math.exp), "sqrt": (math.sqrt, lambda v: v * v)}[transform]
        a, b = f(start), f(stop)
        edges = [back(a + (b - a) * k / bins) for k in range(bins + 1)]
        edges[0], edges[-1] = float(start), float(stop)
        return cls(name, tuple(edges), even=True, transform=transform, **flow)

    @classmethod
    def variable(cls, name: str, edges: Sequence[float], **flow) -> Axis:
        if list(edges) != sorted(set(edges)) or len(edges) < 2:
            raise ValueError("edges must increase and be two at least")
        return cls(name, tuple(float(e) for e in edges), **flow)

    @property
    def bins(self) -> int:
        return len(self.edges) - 1

    @property
    def extent(self) -> int:
        return self.bins + self.underflow + self.overflow

    def slots(self) -> list[int]:
        return list(range(-1 if self.underflow else 0, self.bins + (1 if self.overflow else 0)))

    @property
    def metadata(self) -> dict:
        """What a bin column carries: all that tells one binning from another. The axis's name is the column's."""
        return {BINNING: json.dumps([list(self.edges), self.underflow, self.overflow, self.clamp, self.transform])}

    def column(self, value: Column | str) -> Column:
        """A column of bin numbers under the axis's name and with its binning."""
        return _col(value).alias(self.name, metadata=self.metadata)

    # -- bin index

    def index(self, value: Column | str) -> Column:
        x = _col(value).cast("double")
        n, lo, hi = self.bins, F.lit(self.edges[0]), F.lit(self.edges[-1])
        if self.even:
            t = {None: lambda v: v, "log": F.ln, "sqrt": F.sqrt}[self.transform]
            a, b = (float({None: float, "log": math.log, "sqrt": math.sqrt}[self.transform](e)) for e in (self.edges[0], self.edges[-1]))
            inside = F.least(F.floor((t(x) - F.lit(a)) / F.lit(b - a) * F.lit(float(n))).cast("int"), F.lit(n - 1))
        elif len(self.edges) <= CHAIN:
            inside = F.lit(n - 1)
            for k in range(n - 2, -1, -1):
                inside = F.when(x < F.lit(self.edges[k + 1]), F.lit(k)).otherwise(inside)
        else:
            inside = F.size(F.filter(F.array(*map(F.lit, self.edges)), lambda e: e <= x)) - 1
            inside = F.least(inside, F.lit(n - 1))
        none = F.lit(None).cast("int")
        under = F.lit(0) if self.clamp else F.lit(-1) if self.underflow else none
        over = F.lit(n - 1) if self.clamp else F.lit(n) if self.overflow else none
        beyond = (x > hi) if not self.overflow and not self.clamp else (x >= hi)
        return F.when(x.isNull(), none).when(F.isnan(x), over).when(x < lo, under).when(beyond, over).otherwise(inside).cast("int")

    def prebinned_index(self, coarse: Axis, value: Column | str) -> Column:
        """Index on `coarse` of a column that holds bin numbers of this axis, counted from its underflow slot.

        A bin is placed by its lower edge plus half the least width. The underflow slot has no finite edge and is
        placed as infinite, that is with the overflow, as in the system whose results are matched.
        """
        half = min(b - a for a, b in zip(self.edges, self.edges[1:], strict=False)) / 2
        places = [math.inf] * self.underflow + [e + half for e in self.edges[:-1]] + [math.inf] * self.overflow
        table = F.array(*[F.lit(coarse.place(p)).cast("int") for p in places])
        return F.get(table, _col(value).cast("int"))

    def place(self, x: float) -> int | None:
        """index() of one number on the driver."""
        n = self.bins
        if math.isnan(x) or x > self.edges[-1] or (x == self.edges[-1] and (self.overflow or self.clamp)):
            return n - 1 if self.clamp else n if self.overflow else None
        if x < self.edges[0]:
            return 0 if self.clamp else -1 if self.underflow else None
        return min(sum(e <= x for e in self.edges) - 1, n - 1)

    # -- derived axes

    def rebinned(self, k: int) -> Axis:
        """Every k bins become one; a variable axis keeps its last edge, a regular one its range with bins // k bins."""
        if self.even:
            made = Axis.regular(self.name, self.bins // k, self.edges[0], self.edges[-1], self.transform, underflow=self.underflow, overflow=self.overflow, clamp=self.clamp)
            return made
        edges = list(self.edges[::k])
        if edges[-1] != self.edges[-1]:
            edges.append(self.edges[-1])
        return replace(self, edges=tuple(edges))

    def narrowed(self, first: int, last: int) -> Axis:
        """Bins first to last - 1; a side that loses bins gets a flow slot."""
        return replace(
            self,
            edges=self.edges[first : last + 1],
            underflow=self.underflow or first > 0,
            overflow=self.overflow or last < self.bins - 1,
            even=self.even and self.transform is None,
        )

    # -- tables

    def table(self, spark: SparkSession) -> DataFrame:
        """bin, lo, hi of every slot; flow slots reach to infinity."""
        rows = []
        for k in self.slots():
            lo = -math.inf if k < 0 else self.edges[k]
            hi = math.inf if k >= self.bins else self.edges[k + 1]
            rows.append((k, lo, hi))
        return spark.createDataFrame(rows, f"`{self.name}` int, `{self.name}_lo` double, `{self.name}_hi` double")


def automatic(df: DataFrame, name: str, value: Column | str, bins: int) -> Axis:
    """Two passes: the value's range, then even bins over it (one aggregate row reaches the driver)."""
    lo, hi = df.agg(F.min(_col(value)).cast("double"), F.max(_col(value)).cast("double")).first()
    if lo is None:
        raise ValueError("no values to take a range from")
    return Axis.regular(name, bins, lo, hi if hi > lo else lo + 1.0, underflow=False, overflow=False)


def grid(spark: SparkSession, axes: Sequence[Axis]) -> DataFrame:
    """All cells of the axes' slots: the product of a few short lists, so its size is the histogram's."""
    out = None
    for a in axes:
        one = spark.createDataFrame([(k,) for k in a.slots()], f"`{a.name}` int")
        out = one if out is None else out.crossJoin(one)
    return out


def flat_index(axes: Sequence[Axis], columns: Sequence[Column | str] | None = None) -> Column:
    """Row-major cell number over all slots, flow included."""
    out = F.lit(0).cast("long")
    for a, c in zip(axes, columns or [a.name for a in axes], strict=True):
        out = out * a.extent + _col(c) + (1 if a.underflow else 0)
    return out


def slots_of(axes: Sequence[Axis], cell: Column | str) -> dict[str, Column]:
    """The way back from `flat_index`: each axis's bin number in a cell number, flow included."""
    out, rest = {}, _col(cell)
    for a in reversed(axes):
        out[a.name] = (rest % a.extent - (1 if a.underflow else 0)).cast("int")
        rest = F.floor(rest / a.extent) if a is not axes[0] else rest
    return {a.name: out[a.name] for a in axes}


def binnings(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str]:
    """Binnings that the columns carry; those without one are left out. Reads the schema only."""
    wanted = df.columns if columns is None else list(columns)
    return {f.name: f.metadata[BINNING] for f in df.schema.fields if f.name in wanted and BINNING in f.metadata}


def agreed_binning(a: DataFrame, b: DataFrame, columns: Iterable[str] | None = None) -> dict[str, str]:
    """Refuses to mix binnings: raises if a column carries one in both tables and they differ. Returns the known ones."""
    x, y = binnings(a, columns), binnings(b, columns)
    for name in sorted(set(x) & set(y)):
        if x[name] != y[name]:
            raise ValueError(f"the binnings of {name} differ: {x[name]} and {y[name]}")
    return x | y


def carrying(df: DataFrame, known: dict[str, str]) -> DataFrame:
    """The columns with the binnings that an operation on several tables lost."""
    for name, binning in known.items():
        if name in df.columns:
            df = df.withMetadata(name, {BINNING: binning})
    return df


def categories(value: Column | str, labels: dict) -> Column:
    """Label of an integer or string category; an unlisted one is its own text."""
    mapping = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, _col(value)), _col(value).cast("string"))
