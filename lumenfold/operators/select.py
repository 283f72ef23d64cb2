"""Named selections and cutflows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Selection:
    """An ordered list of named boolean conditions; an unknown (null) condition does not pass."""

    def __init__(self):
        self.cuts: dict[str, Column] = {}

    def add(self, name: str, cut: Column) -> Selection:
        self.cuts[name] = F.coalesce(cut, F.lit(False))
        return self

    def add_if(self, enabled: bool, name: str, cut) -> Selection:
        """Limits of -1 and the like switch a cut off: `cut` is then not built."""
        return self.add(name, cut()) if enabled else self

    def all(self, *names: str) -> Column:
        return reduce(lambda a, b: a & b, [self.cuts[n] for n in names or self.cuts], F.lit(True))

    def any(self, *names: str) -> Column:
        return reduce(lambda a, b: a | b, [self.cuts[n] for n in names or self.cuts], F.lit(False))

    def require(self, **values: bool) -> Column:
        return reduce(lambda a, b: a & b, [self.cuts[n] == F.lit(v) for n, v in values.items()], F.lit(True))

    def steps(self) -> dict[str, Column]:
        """The conjunction of each condition with all before it."""
        out, so_far = {}, F.lit(True)
        for name, cut in self.cuts.items():
            so_far = so_far & cut
            out[name] = so_far
        return out

    def filter(self, df: DataFrame) -> DataFrame:
        return df.where(self.all())


#: Flags of the id levels, and least isolation number of the isolation levels (fixed values).
ID_FLAGS = {"loose": "looseId", "medium": "mediumId", "tight": "tightId"}
ISOLATION_LEVELS = {"loose": 2, "tight": 4}


def _level(level: str, levels: dict):
    if level != "none" and level not in levels:
        raise ValueError(f"no such level: {level}")
    return levels.get(level)


def muon_pair(
    minimum_pt: tuple[float, float] = (-1, -1), maximum_eta: float | tuple[float, float] = -1, opposite: bool = True, isolation: str = "none", identity: str = "none", maximum_dxy: float = -1, maximum_dz: float = -1, lead: str = "lead", sub: str = "sub"
) -> Selection:
    """Selection of two leading objects; limits below 0 and the level "none" are off.

    minimum_pt is of the leading and the other one (equal passes), and so is maximum_eta (equal does not pass), or one
    limit that both share in one step. identity asks for a flag of both, isolation for a least `pfIsoId` of both,
    opposite for charges that differ.
    """
    a, b = F.col(lead), F.col(sub)
    each = lambda f: f(a) & f(b)
    flag, least = _level(identity, ID_FLAGS), _level(isolation, ISOLATION_LEVELS)
    both, lead_eta, sub_eta = (-1, *maximum_eta) if isinstance(maximum_eta, tuple) else (maximum_eta, -1, -1)
    return (
        Selection()
        .add("two", a.isNotNull() & b.isNotNull())
        .add_if(minimum_pt[0] >= 0, "lead_pt", lambda: a["pt"] >= minimum_pt[0])
        .add_if(minimum_pt[1] >= 0, "sub_pt", lambda: b["pt"] >= minimum_pt[1])
        .add_if(both >= 0, "eta", lambda: each(lambda m: F.abs(m["eta"]) < both))
        .add_if(lead_eta >= 0, "lead_eta", lambda: F.abs(a["eta"]) < lead_eta)
        .add_if(sub_eta >= 0, "sub_eta", lambda: F.abs(b["eta"]) < sub_eta)
        .add_if(flag is not None, "id", lambda: each(lambda m: m[flag].cast("boolean")))
        .add_if(least is not None, "isolation", lambda: each(lambda m: m["pfIsoId"] >= least))
        .add_if(maximum_dxy >= 0, "dxy", lambda: each(lambda m: F.abs(m["dxy"]) < maximum_dxy))
        .add_if(maximum_dz >= 0, "dz", lambda: each(lambda m: F.abs(m["dz"]) < maximum_dz))
        .add_if(opposite, "charge", lambda: a["charge"] != b["charge"])
    )


def pair_system(pole: float = 0, width: float = -1, minimum_pt: float = -1, maximum_y: float = -1, pair: str = "pair") -> Selection:
    """Selection by the pair's own mass, pt and y (fields of a struct): within the window, at least, at most in size.

    Limits below 0 are off; values on a limit pass.
    """
    z = F.col(pair)
    return (
        Selection()
        .add_if(width >= 0, "mass", lambda: mass_window(z["mass"], pole, width))
        .add_if(minimum_pt >= 0, "pair_pt", lambda: z["pt"] >= minimum_pt)
        .add_if(maximum_y >= 0, "pair_y", lambda: F.abs(z["y"]) <= maximum_y)
    )


#: Least pile-up id of each level (fixed values).
PILEUP_LEVELS = {"loose": 4, "medium": 6, "tight": 7}


def global_event(trigger: str | None = None, met: str = "met", maximum_met: float = -1, jets: str = "jets", tag: str = "passMediumB", maximum_tags: int = -1, muons: str = "muons", maximum_muons: int = -1, electrons: str = "electrons", maximum_electrons: int = -1, noise: Sequence[str] = (), vertices: str = "vertices", minimum_vertices: int = -1) -> Selection:
    """Selection of whole events: trigger, missing energy, tagged jets, lepton counts, all noise flags, vertices.

    Limits below 0 and empty names are off; counts and limits that are equal pass.
    """
    return (
        Selection()
        .add_if(bool(trigger), "trigger", lambda: F.col(trigger))
        .add_if(maximum_met >= 0, "met", lambda: F.col(met) <= maximum_met)
        .add_if(maximum_tags >= 0, "tags", lambda: F.size(F.filter(jets, lambda x: x[tag])) <= maximum_tags)
        .add_if(maximum_muons >= 0, "muons", lambda: F.size(muons) <= maximum_muons)
        .add_if(maximum_electrons >= 0, "electrons", lambda: F.size(electrons) <= maximum_electrons)
        .add_if(len(noise) > 0, "noise", lambda: reduce(lambda a, b: a & b, [F.col(n) for n in noise]))
        .add_if(minimum_vertices >= 0, "vertices", lambda: F.col(vertices) >= minimum_vertices)
    )


def jet(minimum_pt: float = -1, maximum_eta: float = -1, jet_id: str = "none", pileup: str = "none", of: str | None = None) -> Selection:
    """Selection of jets: pt >= minimum, |eta| <= maximum, an id flag by level, pile-up id of at least its level's.

    Works on a table of jets, or on the struct column `of`. Limits below 0 and the level "none" are off.
    """
    ids = {"loose": "jetIdLoose", "tight": "jetIdTight", "tightLepVeto": "jetIdLepVeto", "none": None}
    if jet_id not in ids or pileup not in {*PILEUP_LEVELS, "none"}:
        raise ValueError(f"no such level: {jet_id}, {pileup}")
    field = lambda n: F.col(n) if of is None else F.col(of)[n]
    return (
        Selection()
        .add_if(minimum_pt >= 0, "pt", lambda: field("pt") >= minimum_pt)
        .add_if(maximum_eta >= 0, "eta", lambda: F.abs(field("eta")) <= maximum_eta)
        .add_if(jet_id != "none", "jetId", lambda: field(ids[jet_id]).cast("boolean"))
        .add_if(pileup != "none", "puId", lambda: field("puId") >= PILEUP_LEVELS[pileup])
    )


def inherited(event: Selection, items: Selection) -> Selection:
    """The items' selection behind that of their event: for tables with a row per item."""
    both = Selection()
    both.cuts = {**event.cuts, **items.cuts}
    return both


def mass_window(mass, pole: float, width: float) -> Column:
    return (mass if isinstance(mass, Column) else F.col(mass)).between(pole - width, pole + width)


def stitched(df: DataFrame, catalog: DataFrame, ht: str | None = None, vpt: str | None = None, dataset: str = "dataset") -> DataFrame:
    """Rows of many datasets that lie in their own dataset's sample: ht <= ht_max, vpt_low <= vpt < vpt_high.

    `catalog` has a row per dataset, as `load_catalog` gives it or as the driver's rows; a null limit, a negative
    vpt_high, or a dataset that it does not list limits nothing. A null ht or vpt passes no limit.
    """
    limits = [c for c in ("ht_max", "vpt_low", "vpt_high") if c in catalog.columns]
    rows = df.join(catalog.select(F.col("dataset").alias(dataset), *[F.col(c).alias(f"_{c}") for c in limits]), dataset, "left")
    cut = F.lit(True)
    if ht and "ht_max" in limits:
        cut = cut & (F.col("_ht_max").isNull() | (F.col(ht) <= F.col("_ht_max")))
    if vpt and "vpt_low" in limits:
        cut = cut & (F.col("_vpt_low").isNull() | (F.col(vpt) >= F.col("_vpt_low")))
    if vpt and "vpt_high" in limits:
        cut = cut & (F.coalesce("_vpt_high", F.lit(-1.0)) < 0) | (cut & (F.col(vpt) < F.col("_vpt_high")))
    return rows.where(cut).select(*df.columns)


def in_sample(flags: dict[str, float], ht: str | None = None, vpt: str | None = None) -> Column:
    """Sample stitching of one dataset (of several: `stitched`): ht at most its own maximum, low <= vpt < high (a negative high is no limit)."""
    cut = F.lit(True)
    if ht and "ht_max" in flags:
        cut = cut & (F.col(ht) <= flags["ht_max"])
    if vpt and "vpt_low" in flags:
        cut = cut & (F.col(vpt) >= flags["vpt_low"])
        if flags.get("vpt_high", -1) >= 0:
            cut = cut & (F.col(vpt) < flags["vpt_high"])
    return cut


def quality(items, minimum_pt: float = -1, maximum_eta: float = -1, flag: str | None = None, level: float | None = None, maximum_dxy: float = -1, maximum_dz: float = -1) -> Column:
    """Entries of a collection that pass; limits that are not positive are off."""

    def keep(x):
        ok = F.lit(True)
        if minimum_pt > 0:
            ok = ok & (x["pt"] > minimum_pt)
        if maximum_eta > 0:
            ok = ok & (F.abs(x["eta"]) < maximum_eta)
        if flag:
            ok = ok & (x[flag] if level is None else x[flag] >= level)
        if maximum_dxy > 0:
            ok = ok & (F.abs(x["dxy"]) < maximum_dxy)
        if maximum_dz > 0:
            ok = ok & (F.abs(x["dz"]) < maximum_dz)
        return ok

    return F.filter(items if isinstance(items, Column) else F.col(items), keep)


def passes_id_or_pt(x: Column, level: int, threshold: float) -> Column:
    return (x["puId"] >= level) | (x["pt"] >= threshold)


def clear_of(x: Column, others: list[tuple[Column, Column]], distance: float) -> Column:
    """Farther than `distance` from every (eta, phi); a missing other counts as far away."""
    from ..functions.expr import delta_r

    far = [F.coalesce(delta_r(x["eta"], x["phi"], e, p), F.lit(999.0)) > distance for e, p in others]
    return reduce(lambda a, b: a & b, far, F.lit(True))


def matched_mask(items, mask, index: str) -> Column:
    """Entries whose index points to an entry of `mask` that is true."""
    mask = mask if isinstance(mask, Column) else F.col(mask)
    return F.filter(items if isinstance(items, Column) else F.col(items), lambda x: (x[index] >= 0) & F.coalesce(F.get(mask, F.greatest(x[index], F.lit(0))), F.lit(False)))


def cutflow(df: DataFrame, selection: Selection, weight, level: str = "event") -> DataFrame:
    """level, step_no, step, n: row 0 the raw row count, row 1 all rows' weight, then the weight after each step.

    One aggregation with a conditional sum per step, unpivoted after it.
    """
    w = weight if isinstance(weight, Column) else F.col(weight)
    sums = [F.count(F.lit(1)).cast("double").alias("s0"), F.coalesce(F.sum(w), F.lit(0.0)).alias("s1")]
    sums += [F.coalesce(F.sum(F.when(c, w)), F.lit(0.0)).alias(f"s{k + 2}") for k, c in enumerate(selection.steps().values())]
    names = ["raw", "all", *selection.cuts]
    rows = F.array(*[F.struct(F.lit(k).alias("step_no"), F.lit(n).alias("step"), F.col(f"s{k}").alias("n")) for k, n in enumerate(names)])
    return df.agg(*sums).select(F.lit(level).alias("level"), F.inline(rows))
