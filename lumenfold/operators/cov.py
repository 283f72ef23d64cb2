"""Covariance of binned sums, as long tables (i, j, cov)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axes import Axis, flat_index, slots_of

#: Cells of one event that are paired within one group of the join.
BLOCK = 1024


def per_event(df: DataFrame, event: str, cell: str, weights: dict[str, Column | str]) -> DataFrame:
    """event, cell and the sum of each weight: what values and covariances of the same table have in common."""
    sums = [F.sum(w if isinstance(w, Column) else F.col(w)).alias(n) for n, w in weights.items()]
    return df.where(F.col(cell).isNotNull()).groupBy(event, cell).agg(*sums)


def event_covariance(df: DataFrame, event: str, cell: str, weight: Column | str, block: int = BLOCK) -> DataFrame:
    """C_ij = sum over events of (sum of weights in i) (sum in j): entries of one event are correlated.

    Rows are first added up per event and cell, so the self-join on the event sees each cell once; only i <= j is
    formed and the other half mirrored after the second aggregation. An event of more than `block` cells is dealt out
    in pairs of blocks, so that no task forms more than the pairs of two blocks of one event.
    """
    return covariance_of(per_event(df, event, cell, {"w": weight}), event, cell, {"cov": "w"}, block)


def covariance_of(per: DataFrame, event: str, cell: str, columns: dict[str, str], block: int = BLOCK) -> DataFrame:
    """i, j and a covariance per entry of `columns` (its name: the weight's), all from one join of `per_event`'s rows."""
    blocks = in_blocks(per, event, cell, block)
    weights = list(dict.fromkeys(columns.values()))
    side = lambda rows, by, x: rows.select(*by, F.col("cell").alias(x), *[F.col(w).alias(f"_{x}_{w}") for w in weights])
    whole = blocks.where("last = 0")  # joined where the blocks were numbered: no further shuffle
    dealt = block_pairs(blocks.where("last > 0"))
    met = side(whole, ["e"], "i").join(side(whole, ["e"], "j"), "e").drop("e")
    keys = ["e", "lo", "hi"]
    met = met.unionByName(side(dealt.where("part = lo"), keys, "i").join(side(dealt.where("part = hi"), keys, "j"), keys).drop(*keys))
    return mirrored(met.where("i <= j").groupBy("i", "j").agg(*[F.sum(F.col(f"_i_{w}") * F.col(f"_j_{w}")).alias(n) for n, w in columns.items()]))


def in_blocks(per: DataFrame, event: str, cell: str, block: int = BLOCK) -> DataFrame:
    """e, cell, the weights, part and last: an event's cells in order of their number, in blocks of `block` cells from 0 to last."""
    of = Window.partitionBy(event)
    part = F.floor((F.row_number().over(of.orderBy(cell)) - 1) / block).cast("int").alias("part")
    last = F.floor((F.count(F.lit(1)).over(of) - 1) / block).cast("int").alias("last")
    return per.select(F.col(event).alias("e"), F.col(cell).alias("cell"), *[c for c in per.columns if c not in (event, cell)], part, last)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Each cell once for every pair lo <= hi of its event's blocks that has its own; i <= j lies in pairs lo <= hi."""
    pair = lambda k: F.struct(F.least(k, "part").alias("lo"), F.greatest(k, "part").alias("hi"))
    return blocks.select("*", F.inline(F.transform(F.sequence(F.lit(0), F.col("last")), pair)))


def mirrored(half: DataFrame) -> DataFrame:
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    rest = [c for c in half.columns if c not in ("i", "j")]
    return half.select(F.inline(both), *rest).select("i", "j", *rest)


# ---- matrices over cells of several axes (flat numbers of `axes.flat_index`)


def on_axes(table: DataFrame, axes: dict[str, Sequence[Axis]], keep: Sequence[str] | None = None, within: dict[str, tuple[float, float]] | None = None, coarse: dict[str, Axis] | None = None, value: str = "cov", also: Sequence[str] = ()) -> DataFrame:
    """A matrix over flat cell numbers, sliced, rebinned and projected by axis: no join, one aggregation.

    axes: of each index column, as {"i": a, "j": a} for a covariance and {"reco": r, "gen": g} for a transfer. `within`
    keeps bins that lie in a range of an axis (flow goes); `coarse` merges an axis's bins by where their middle lies on
    another one, flow stays flow if that has the slot; `keep` names the axes that stay, in order, the others are summed
    out. The result's cells are numbered over what stays, rebinned: `kept_axes`. `also` names index columns that stay as
    they are, so that two sides may be treated each in its own way.
    """
    sides = {}
    for side, own in axes.items():
        bins = slots_of(own, side)
        for a in own:
            if within and a.name in within:
                low, high = within[a.name]
                inside = [k for k in range(a.bins) if a.edges[k] >= low and a.edges[k + 1] <= high]
                bins[a.name] = F.when(bins[a.name].isin(inside), bins[a.name])
            if coarse and a.name in coarse:
                bins[a.name] = merged_bin(a, coarse[a.name], bins[a.name])
        left_out = [a for a in own if keep is not None and a.name not in keep]
        to = kept_axes(own, keep, coarse)
        for a in left_out:  # a bin that goes takes the cell with it, also where its axis is summed out
            bins[to[0].name] = F.when(bins[a.name].isNotNull(), bins[to[0].name])
        sides[side] = flat_index(to, [bins[a.name] for a in to])
    out = table.withColumns(sides).where(" AND ".join(f"`{s}` IS NOT NULL" for s in sides))
    return out.groupBy(*[c for c in table.columns if c in sides or c in also]).agg(F.sum(value).alias(value))


def kept_axes(axes: Sequence[Axis], keep: Sequence[str] | None = None, coarse: dict[str, Axis] | None = None) -> list[Axis]:
    """The axes that the cells of `on_axes` are numbered over."""
    by = {a.name: (coarse or {}).get(a.name, a) for a in axes}
    return [by[n] for n in (keep if keep is not None else [a.name for a in axes])]


def merged_bin(axis: Axis, coarse: Axis, number: Column) -> Column:
    """The bin of `coarse` that a bin of `axis` falls in: an interior one by its middle, flow into flow."""
    out = F.lit(None).cast("int")
    for k in axis.slots():
        to = (-1 if coarse.underflow else None) if k < 0 else (coarse.bins if coarse.overflow else None) if k >= axis.bins else coarse.place((axis.edges[k] + axis.edges[k + 1]) / 2)
        out = F.when(number == k, F.lit(to).cast("int")).otherwise(out)
    return out


def bootstrap(df: DataFrame, event: str, cell: str, weight: Column | str, replicas: int, draw: Column | None = None) -> DataFrame:
    """i, j, cov of the cells' sums over event-level replicas: sum of d d^T / (replicas - 1) about the mean.

    Every event has one deterministic weight per replica, a function of its id, so a replica is the same on every
    run. The default is Poisson(1) by inversion of a hash. Events are added up per cell first and the expansion to
    replicas happens inside the partial aggregation. Hashes cost most by far, so an event's cells, one row at most for
    each cell there is, are brought together and it is hashed once per replica. They are dealt out over as many tasks as
    the session has shuffle partitions: by its bytes alone the planner would merge this step into a few.
    """
    w = weight if isinstance(weight, Column) else F.col(weight)
    per = df.where(F.col(cell).isNotNull()).groupBy(event, cell).agg(F.sum(w).alias("w"))
    r = F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))
    if draw is None:
        tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        whole = per.repartition(tasks, event).groupBy(event).agg(F.collect_list(F.struct(cell, "w")).alias("_cells"))
        # the hash is a column of its own: every comparison would compute it again
        drawn = whole.withColumn("r", r).withColumn("_hash", hashed(event, "r"))
        drawn, draw = drawn.select("r", poisson("_hash").alias("_times"), F.inline("_cells")), F.col("_times")
    else:
        drawn = per.withColumn("r", r)
    sums = drawn.groupBy("r", cell).agg(F.sum(F.col("w") * draw).alias("s"))
    return over_replicas(sums.select("r", F.col(cell).alias("i"), F.col("s").alias("value")), replicas)


def over_replicas(values: DataFrame, replicas: int) -> DataFrame:
    """i, j, cov of values (r, i, value), a row for every replica and cell: sum of d d^T / (replicas - 1) about the mean."""
    mean = values.groupBy("i").agg((F.sum("value") / replicas).alias("_m"))
    d = values.join(mean, "i").select("r", "i", (F.col("value") - F.col("_m")).alias("di"))
    met = d.join(d.select("r", F.col("i").alias("j"), F.col("di").alias("dj")), "r").where("i <= j")
    return mirrored(met.groupBy("i", "j").agg((F.sum(F.col("di") * F.col("dj")) / (replicas - 1)).alias("cov")))


def hashed(*parts: Column | str) -> Column:
    """The MD5 of the parts' text in hexadecimal, which every engine can repeat; null if a part is. Its first 32 bits are a number in [0, 1)."""
    text = [(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat(text[0], *[x for t in text[1:] for x in (F.lit(":"), t)]))


def poisson(hash: Column | str) -> Column:
    """Poisson(1) of the number that a column of `hashed` stands for; the tail beyond 7 has probability 1e-5 and counts as 7, as null does.

    Hexadecimal digits of one length are in the order of their numbers, so the bounds are written in them and nothing
    is parsed.
    """
    h = F.col(hash) if isinstance(hash, str) else hash
    out, p, total = F.lit(7), 0.36787944117144233, 0.0
    bounds = []
    for k in range(7):
        total += p
        bounds.append(f"{math.ceil(total * (1 << 32)):08x}")
        p /= k + 1
    for k in range(6, -1, -1):
        out = F.when(h < bounds[k], F.lit(k)).otherwise(out)
    return out


def rebinned(cov: DataFrame, mapping: DataFrame) -> DataFrame:
    """Covariance after bins merge; mapping has `old` and `new`. Both sides are joined by key."""
    a = mapping.select(F.col("old").alias("i"), F.col("new").alias("_i"))
    b = mapping.select(F.col("old").alias("j"), F.col("new").alias("_j"))
    return cov.join(a, "i").join(b, "j").groupBy(F.col("_i").alias("i"), F.col("_j").alias("j")).agg(F.sum("cov").alias("cov"))


def correlation(cov: DataFrame) -> DataFrame:
    """i, j, corr; null where a variance is 0."""
    diagonal = cov.where("i = j").select(F.col("i").alias("k"), F.col("cov").alias("v"))
    di, dj = diagonal.select(F.col("k").alias("i"), F.col("v").alias("vi")), diagonal.select(F.col("k").alias("j"), F.col("v").alias("vj"))
    return cov.join(di, "i").join(dj, "j").select("i", "j", F.try_divide(F.col("cov"), F.sqrt(F.col("vi") * F.col("vj"))).alias("corr"))


def sandwich(jacobian: DataFrame, cov: DataFrame) -> DataFrame:
    """J C J^T of sparse tables (a, i, d) and (i, j, cov): two joins and two aggregations."""
    right = jacobian.select(F.col("a").alias("b"), F.col("i").alias("j"), F.col("d").alias("dj"))
    half = cov.join(right, "j").groupBy("i", "b").agg(F.sum(F.col("cov") * F.col("dj")).alias("c"))
    return jacobian.join(half, "i").groupBy("a", "b").agg(F.sum(F.col("d") * F.col("c")).alias("cov")).select(F.col("a").alias("i"), F.col("b").alias("j"), "cov")


def relative_error(h: DataFrame, cov: DataFrame, cell: str = "i", value: str = "value") -> DataFrame:
    d = cov.where("i = j").select(F.col("i").alias(cell), F.col("cov").alias("_v"))
    return h.join(d, cell).select(cell, F.try_divide(F.sqrt("_v"), F.col(value)).alias("relative_error"))


def pulls(values: DataFrame, cov: DataFrame, nuisances: Sequence[int]) -> DataFrame:
    """i, value, error of the nuisance entries, beside the unit prior."""
    d = cov.where("i = j").select("i", F.sqrt("cov").alias("error"))
    return values.where(F.col("i").isin(list(nuisances))).join(d, "i").select("i", "value", "error", F.lit(1.0).alias("prior"))
