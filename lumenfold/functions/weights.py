"""Event weights and their variations as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


class WeightSet:
    """Named factors with optional up and down variations.

    The nominal weight is the product of all factors; a variation replaces one factor, computed by leaving it out
    of the product (so a zero factor is no division by zero).
    """

    def __init__(self):
        self.factors: dict[str, tuple[Column, Column | None, Column | None]] = {}

    def add(self, name: str, nominal, up=None, down=None) -> WeightSet:
        self.factors[name] = (_col(nominal), None if up is None else _col(up), None if down is None else _col(down))
        return self

    def _product(self, columns) -> Column:
        return reduce(lambda a, b: a * b, columns, F.lit(1.0))

    def columns(self) -> dict[str, Column]:
        out = {"wt_nominal": self._product(f[0] for f in self.factors.values())}
        for name, (_, up, down) in self.factors.items():
            rest = self._product(f[0] for k, f in self.factors.items() if k != name)
            if up is not None:
                out[f"wt_{name}Up"] = rest * up
            if down is not None:
                out[f"wt_{name}Down"] = rest * down
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(self.columns())


def envelope(values, indices: list[int]) -> tuple[Column, Column]:
    """(greatest, least) of the listed entries of an array."""
    picked = [F.get(_col(values), F.lit(i)) for i in indices]
    return F.greatest(*picked), F.least(*picked)


def scale_envelope(values) -> tuple[Column, Column]:
    """Seven-point envelope of nine weights in row-major order: both opposite corners are left out."""
    return envelope(values, [0, 1, 3, 5, 7, 8])


def corner_envelope(values) -> tuple[Column, Column]:
    return envelope(values, [0, 8])


def hessian(values) -> tuple[Column, Column]:
    """1 +- sqrt(sum over entries 1 to 100 of (w - 1) ** 2 / 99)."""
    spread = F.sqrt(F.aggregate(F.slice(_col(values), 2, 100), F.lit(0.0), lambda s, w: s + (w - 1) * (w - 1)) / 99)
    return 1 + spread, 1 - spread


def coupling(values) -> Column:
    """Half the difference of entries 102 and 101."""
    return (F.get(_col(values), F.lit(102)) - F.get(_col(values), F.lit(101))) * 0.5


def hessian_and_coupling(values) -> tuple[Column, Column]:
    spread = hessian(values)[0] - 1
    total = F.sqrt(spread * spread + coupling(values) * coupling(values))
    return 1 + total, 1 - total


def shower(values) -> dict[str, Column]:
    """Initial- and final-state variations; 1 for a row with fewer than four entries."""
    ok = F.size(_col(values)) >= 4
    pick = lambda i: F.when(ok, F.get(_col(values), F.lit(i))).otherwise(F.lit(1.0))
    return {"ISRUp": pick(0), "FSRUp": pick(1), "ISRDown": pick(2), "FSRDown": pick(3)}


def multiplicity(items, passes: str, efficiency: str, factor: str) -> Column:
    """Product over passing of f e and over failing of 1 - f e, over the same with f = 1; a zero product counts as 1."""

    def product(scaled: bool) -> Column:
        def step(acc, x):
            e = x[efficiency] * x[factor] if scaled else x[efficiency]
            return acc * F.when(x[passes], e).otherwise(1 - e)

        p = F.aggregate(_col(items), F.lit(1.0), step)
        return F.when(p == 0, F.lit(1.0)).otherwise(p)

    return product(True) / product(False)


def flavour_presence(items, flavour_field: str, flavour: int, factor: float) -> tuple[Column, Column]:
    """(up, down): 1 + factor and 1 - factor for events that have an entry of the flavour, else 1."""
    has = F.exists(_col(items), lambda x: x[flavour_field] == flavour)
    return F.when(has, F.lit(1 + factor)).otherwise(F.lit(1.0)), F.when(has, F.lit(1 - factor)).otherwise(F.lit(1.0))


def guarded(weight, *, invalid: Column | None = None) -> Column:
    """1 where the weight is null or not positive, or where `invalid` holds."""
    w = _col(weight)
    bad = w.isNull() | (w <= 0)
    return F.when(bad if invalid is None else bad | invalid, F.lit(1.0)).otherwise(w)


def normalisation(is_mc, xsec, lumi, eventcount) -> Column:
    """1000 * xsec * lumi / eventcount for simulation, 1 for data."""
    return F.when(_col(is_mc), F.try_divide(_col(xsec) * _col(lumi) * 1000, _col(eventcount))).otherwise(F.lit(1.0))


def split_factor(n: int, chosen: int = 1) -> float:
    """What one or several of n statistical splits are scaled by to stand for all."""
    return n / chosen


def chosen_weight(dataset, alternatives: list[str], nominal, alternative) -> Column:
    return F.when(_col(dataset).isin(alternatives), _col(alternative)).otherwise(_col(nominal))
