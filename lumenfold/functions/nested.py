"""Nested collections: array expressions inside one event. Nothing here joins or shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Index that stands for "no entry" in the source format.
SENTINEL = 99999999


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def unflatten(flat, counts) -> Column:
    """array -> array of arrays of the given counts."""
    flat, counts = _col(flat), _col(counts)
    places = F.transform(counts, lambda n, i: F.struct(n.alias("n"), i.alias("i")))

    def piece(p):
        before = F.aggregate(F.slice(counts, 1, p["i"]), F.lit(0), lambda s, n: s + n)
        return F.slice(flat, before + 1, p["n"])

    return F.transform(places, piece)


def unflatten_matrix(flat, rows, columns) -> Column:
    """array -> array of matrices; rows and columns have one entry per matrix."""
    rows, columns = _col(rows), _col(columns)
    cells = F.zip_with(rows, columns, lambda r, c: r * c)
    parts = unflatten(flat, cells)
    return F.transform(parts, lambda p, i: F.transform(F.sequence(F.lit(1), F.get(rows, i)), lambda r: F.slice(p, (r - 1) * F.get(columns, i) + 1, F.get(columns, i))))


def gather(items, index) -> Column:
    """items[index]; null where an index is out of range."""
    items = _col(items)
    return F.transform(_col(index), lambda i: F.get(items, i))


def gather_matched(items, index, sentinel: int = SENTINEL) -> Column:
    """items[index] without the entries whose index is the sentinel or out of range."""
    items = _col(items)
    return F.filter(F.transform(F.filter(_col(index), lambda i: i != sentinel), lambda i: F.get(items, i)), lambda x: x.isNotNull())


def without_padding(items) -> Column:
    """Entries with pt > 0; their number is F.size of the result."""
    return F.filter(_col(items), lambda x: x["pt"] > 0)


def positive_entries(items, field: str = "wt") -> Column:
    return F.filter(_col(items), lambda x: x[field] > 0)


def nth(items, n: int, default=None, field: str | None = None) -> Column:
    """The n-th entry (or its field), or null, or the default."""
    x = F.get(_col(items), F.lit(n))
    x = x[field] if field else x
    return x if default is None else F.coalesce(x, F.lit(default))


def with_fields(items, **fields) -> Column:
    """Adds or replaces struct fields; each is a function of the entry."""

    def update(x):
        for name, f in fields.items():
            x = x.withField(name, f(x))
        return x

    return F.transform(_col(items), update)


def calibrated(items, threshold: float, factor: str) -> Column:
    """rawPt := pt, then pt := pt * factor below the threshold."""
    items = with_fields(items, rawPt=lambda x: x["pt"])
    return with_fields(items, pt=lambda x: F.when(x["rawPt"] < threshold, x["rawPt"] * x[factor]).otherwise(x["rawPt"]))


def with_tags(items, score: str, points: dict[str, float]) -> Column:
    """pass<Point> := score > value for every working point."""
    return with_fields(items, **{f"pass{p}": (lambda v: lambda x: x[score] > v)(v) for p, v in points.items()})


def any_matched(matches, flag: str) -> Column:
    """True if some matched entry has the flag; no match is false."""
    return F.exists(_col(matches), lambda m: m[flag])


def flavour(hadron, parton) -> Column:
    """A light hadron flavour with gluon parton is 21."""
    return F.when((_col(hadron) == 0) & (_col(parton) == 21), F.lit(21)).otherwise(_col(hadron))


def swapped_pt(items, factor: str, skip: bool) -> Column:
    """Keeps the stored pt, adds the raw one, and uses the raw one if corrections are skipped."""
    items = with_fields(items, pt_stored=lambda x: x["pt"], pt_raw=lambda x: x["pt"] * x[factor])
    return with_fields(items, pt=lambda x: x["pt_raw"]) if skip else items


def quadrature_shift(pt, uncertainties, up: bool) -> Column:
    """pt * (1 +- sqrt(sum (u - 1) ** 2))."""
    total = F.sqrt(F.aggregate(_col(uncertainties), F.lit(0.0), lambda s, u: s + (u - 1) * (u - 1)))
    return _col(pt) * (1 + total if up else 1 - total)


def leading_pair(first, second, key: str = "pt", ties_to_first: bool = False) -> Column:
    """struct(lead, sub). Where the keys are equal the second leads, or the first if asked for."""
    a, b = _col(first), _col(second)
    swap = (a[key] < b[key]) if ties_to_first else ~(a[key] > b[key])
    return F.when(swap, F.struct(b.alias("lead"), a.alias("sub"))).otherwise(F.struct(a.alias("lead"), b.alias("sub")))


def normalised_weight(weight, pt, denominator, order: int = 4) -> Column:
    """weight * (denominator / pt) ** order; null where pt is 0."""
    return _col(weight) * F.pow(F.try_divide(_col(denominator), _col(pt)), F.lit(order))


def field_or_none(df: DataFrame, path: str) -> Column | None:
    """The column, if the schema has it: optional objects are resolved once, on the driver."""
    kind: T.DataType = df.schema
    for part in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return F.col(path)


def source_for(params: dict, systematic: str) -> dict:
    """Parameters under a systematic: the common ones and its own, or else the nominal ones."""
    return params.get("common", {}) | params.get(systematic, params.get("nominal", {}))
