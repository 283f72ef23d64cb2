"""Derived variables, cuts and kinematics as Column expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# -- variables


def constant(v) -> Column:
    return F.lit(v)


def absolute(x) -> Column:
    return F.abs(_col(x))


def logarithm(x, base: float = math.e) -> Column:
    """Null where x is not positive."""
    x = _col(x)
    return F.when(x > 0, F.ln(x) / math.log(base))


def ratio(a, b) -> Column:
    """Null where b is 0."""
    return F.try_divide(_col(a), _col(b))


def product(a, b) -> Column:
    return _col(a) * _col(b)


def relative_resolution(truth, reco) -> Column:
    return F.try_divide(_col(reco) - _col(truth), _col(truth))


def from_cut(cut: Column) -> Column:
    """1 where the cut holds, 0 where not, null where unknown."""
    return cut.cast("int").cast("double")


def delta_phi(a, b) -> Column:
    """Wrapped into [-pi, pi)."""
    d = (_col(a) - _col(b) + math.pi) / (2 * math.pi)
    return (d - F.floor(d)) * (2 * math.pi) - math.pi


def delta_r(eta1, phi1, eta2, phi2) -> Column:
    return F.sqrt(F.pow(_col(eta1) - _col(eta2), 2) + F.pow(delta_phi(phi1, phi2), 2))


# -- cuts


def two_sided(x, lo, hi) -> Column:
    return (_col(x) >= lo) & (_col(x) < hi)


def greater(x, lo) -> Column:
    return _col(x) >= lo


def less(x, hi) -> Column:
    return _col(x) < hi


def equals(x, v) -> Column:
    return _col(x) == v


def no_cut() -> Column:
    return F.lit(True)


def both(*cuts: Column) -> Column:
    return reduce(lambda a, b: a & b, cuts, F.lit(True))


def per_dataset(dataset, common: Column, extra: dict[str, Column]) -> Column:
    """The common cut and the row's dataset's own one, if it has one."""
    own = F.lit(True)
    for name, cut in extra.items():
        own = F.when(_col(dataset) == name, cut).otherwise(own)
    return common & own


# -- four-vectors


def four_sum(a: Column, b: Column) -> Column:
    """struct(pt, eta, phi, mass, y) of two structs with pt, eta, phi, mass."""

    def cartesian(v):
        px, py, pz = v["pt"] * F.cos(v["phi"]), v["pt"] * F.sin(v["phi"]), v["pt"] * F.sinh(v["eta"])
        return px, py, pz, F.sqrt(px * px + py * py + pz * pz + v["mass"] * v["mass"])

    px, py, pz, e = (x + y for x, y in zip(cartesian(a), cartesian(b), strict=True))
    pt = F.sqrt(px * px + py * py)
    mass = F.sqrt(F.greatest(e * e - px * px - py * py - pz * pz, F.lit(0.0)))
    return F.struct(
        pt.alias("pt"),
        F.asinh(F.try_divide(pz, pt)).alias("eta"),
        F.atan2(py, px).alias("phi"),
        mass.alias("mass"),
        rapidity(pt, F.asinh(F.try_divide(pz, pt)), mass).alias("y"),
    )


def rapidity(pt: Column, eta: Column, mass: Column) -> Column:
    across = F.sqrt(mass * mass + pt * pt)
    along = F.sqrt(mass * mass + F.pow(pt * F.cosh(eta), 2))
    return F.ln(F.try_divide(along + pt * F.sinh(eta), across))


def event_id(run, lumi, event) -> Column:
    """(run << 48) + (lumi << 32) + event with the bits of an unsigned 64-bit sum that wraps.

    The upper and lower halves are added apart, so that ANSI arithmetic cannot overflow.
    """
    run, lumi, event = (_col(c).cast("long") for c in (run, lumi, event))
    high = F.shiftleft(run, 16) + lumi + F.shiftrightunsigned(event, 32)
    return F.shiftleft(high, 32).bitwiseOR(event.bitwiseAND(F.lit(0xFFFFFFFF)))


def unsigned_mod(x, n: int) -> Column:
    """x modulo n of the unsigned number with x's 64 bits."""
    x = _col(x).cast("long")
    return F.pmod(F.pmod(x, F.lit(n)) + F.when(x < 0, F.lit((1 << 64) % n)).otherwise(F.lit(0)), F.lit(n))
