"""Registered queries of the detector model with nuisances, stacks and partitions of binned tables, and matrices over several axes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr, lookup, weights
from ..functions.axes import Axis, flat_index, slots_of
from ..operators import algebra, cov, hist, model, reweight, select, tables
from ..sources import catalog, layout
from .queries import (
    _COV, _GEN, _RANKED, _RECO, _VAL, DISC, KPRICE, KRECO, PRICE, QTY, TAX, _catalog, _folder, _item_fields, _items, _k, _values_and_cov, case, query, read, rounded,
)

# ---- the fold under nuisances


#: The weights of a pass over the items: two variations of the weight with both sides, one with one side.
_NUISANCES = [model.Nuisance("disc"), model.Nuisance("tax", one_sided=True), model.Nuisance("line", transfer=False)]
_WEIGHTS = {
    "nominal": "l_quantity",
    "discUp": "l_quantity * (1 + 4 * l_discount)",
    "discDown": "l_quantity * (1 - 2 * l_discount)",
    "tax": "l_quantity * (1 + 3 * l_tax)",
    "lineUp": "l_quantity * (1 + 0.1 * l_linenumber)",
    "lineDown": "l_quantity * (1 - 0.05 * l_linenumber)",
}
_THETA = {"disc": 0.7, "tax": -0.4, "line": 0.3}
_BKG = "l_returnflag = 'N' OR l_linestatus = 'O'"
#: Cells (gen, reco, role) at most.
_CELLS = 2 * PRICE.extent**2
_ROLE = f"CASE WHEN {_BKG} THEN 'background' ELSE 'in' END"


def _binned(rows: DataFrame, reco: str = KRECO) -> DataFrame:
    rows = hist.with_bins(rows, [PRICE], [_k(KPRICE)]).withColumnRenamed("_bin_price", "gen")
    return hist.with_bins(rows, [PRICE], [_k(reco)]).withColumnRenamed("_bin_price", "reco")


def _model_sql(items: str) -> str:
    """gamma, rho and rs per variation v of items (v, gen, reco, bkg, w)."""
    return f"""it AS ({items}),
g AS (SELECT v, gen, sum(w) AS t, sum(CASE WHEN bkg THEN w ELSE 0 END) AS b FROM it GROUP BY 1, 2),
gamma AS (SELECT v, gen, CASE WHEN b / CASE WHEN t = 0 THEN 1 ELSE t END = 1 THEN 0 ELSE b / CASE WHEN t = 0 THEN 1 ELSE t END END AS x FROM g),
r AS (SELECT v, reco, sum(w) AS t, sum(CASE WHEN bkg THEN w ELSE 0 END) AS b FROM it GROUP BY 1, 2),
rho AS (SELECT v, reco, b / CASE WHEN t - b <= 0 THEN 1 ELSE t - b END AS x FROM r),
tr AS (SELECT v, reco, gen, sum(w) AS s FROM it WHERE NOT bkg GROUP BY 1, 2, 3),
rs AS (SELECT v, reco, gen, s / CASE WHEN t - b = 0 THEN 1 ELSE t - b END AS x FROM tr JOIN g USING (v, gen))"""


def _coefficients(theta: dict[str, float], nuisances: list[model.Nuisance]) -> str:
    c = {model.NOMINAL: 1.0}
    for n in nuisances:
        up, down = n.variations
        c[up] = theta[n.name] * (1 if n.one_sided else 0.5)
        if down:
            c[down] = -theta[n.name] * 0.5
        else:
            c[model.NOMINAL] -= theta[n.name]
    return ", ".join(f"('{v}', {x!r}::double)" for v, x in c.items())


_VARIED_ITEMS = f"""SELECT t.v, {_GEN} AS gen, {_RECO} AS reco, ({_BKG}) AS bkg, t.w FROM lineitem, LATERAL (VALUES {', '.join(f"('{n}', {w})" for n, w in _WEIGHTS.items())}) t(v, w)
WHERE l_extendedprice IS NOT NULL AND l_discount IS NOT NULL"""


@query(f"""WITH {_model_sql(_VARIED_ITEMS)},
k(v, c) AS (VALUES {_coefficients(_THETA, _NUISANCES)}), kt(v, c) AS (VALUES {_coefficients(_THETA, [n for n in _NUISANCES if n.transfer])}),
ga AS (SELECT gen, sum(x * c) AS gamma FROM gamma JOIN k USING (v) GROUP BY 1), ro AS (SELECT reco, sum(x * c) AS rho FROM rho JOIN k USING (v) GROUP BY 1),
ts AS (SELECT reco, gen, sum(x * c) AS t FROM rs JOIN kt USING (v) GROUP BY 1, 2)
SELECT reco, round(sum(ts.t * g.t * (1 - gamma)) * (1 + any_value(rho)), 2) AS value FROM ts JOIN g ON g.gen = ts.gen AND g.v = 'nominal' JOIN ga ON ga.gen = ts.gen JOIN ro USING (reco) GROUP BY reco""")
def fold_nuisances(spark, sf_dir):
    """The truth folded at theta: response, gamma and rho move with the nuisances (one leaves the response), from one scan."""
    cells = _varied_cells(spark, sf_dir)
    theta = lookup.local(spark, list(_THETA.items()), "nuisance string, theta double")
    return rounded(model.fold(model.truth(cells), cells, _NUISANCES, theta), value=2)


_AT_THETA = f"""{_model_sql(_VARIED_ITEMS)},
k(v, c) AS (VALUES {_coefficients(_THETA, _NUISANCES)}), kt(v, c) AS (VALUES {_coefficients(_THETA, [n for n in _NUISANCES if n.transfer])}),
ga AS (SELECT gen, sum(x * c) AS gamma FROM gamma JOIN k USING (v) GROUP BY 1), ro AS (SELECT reco, sum(x * c) AS rho FROM rho JOIN k USING (v) GROUP BY 1),
ts AS (SELECT reco, gen, sum(x * c) AS t FROM rs JOIN kt USING (v) GROUP BY 1, 2), be AS (SELECT gen, t AS b FROM g WHERE v = 'nominal')"""


def _deltas_of(table: str, keys: str, nuisances: list[model.Nuisance]) -> str:
    own = lambda v: f"coalesce(sum(x) FILTER (v = '{v}'), 0)"
    return " UNION ALL ".join(f"SELECT '{n.name}' AS u, {keys}, {f'{own(n.name)} - {own(model.NOMINAL)}' if n.one_sided else f'({own(n.variations[0])} - {own(n.variations[1])}) * 0.5'} AS z FROM {table} GROUP BY {keys}" for n in nuisances)


_JACOBIAN = f"""{_AT_THETA}, dt AS ({_deltas_of('rs', 'reco, gen', [n for n in _NUISANCES if n.transfer])}), dg AS ({_deltas_of('gamma', 'gen', _NUISANCES)}), dr AS ({_deltas_of('rho', 'reco', _NUISANCES)}),
j AS (SELECT ts.reco AS a, 'gen:' || ts.gen AS i, ts.t * (1 - gamma) * (1 + rho) AS d FROM ts JOIN ga USING (gen) JOIN ro USING (reco)
UNION ALL SELECT a, i, sum(d) FROM (
  SELECT dt.reco AS a, u AS i, z * b * (1 - gamma) * (1 + rho) AS d FROM dt JOIN be USING (gen) JOIN ga USING (gen) JOIN ro USING (reco)
  UNION ALL SELECT ts.reco, u, -ts.t * b * z * (1 + rho) FROM ts JOIN be USING (gen) JOIN dg USING (gen) JOIN ro USING (reco)
  UNION ALL SELECT dr.reco, u, z * ts.t * b * (1 - gamma) FROM dr JOIN ts USING (reco) JOIN be USING (gen) JOIN ga USING (gen)) GROUP BY 1, 2)"""


def _varied_cells(spark, sf_dir) -> DataFrame:
    return model.filled(_binned(_items(spark, sf_dir)), "gen", "reco", F.expr(_ROLE), {n: F.expr(w) for n, w in _WEIGHTS.items()}, _CELLS)


def _at_theta(spark) -> DataFrame:
    return lookup.local(spark, list(_THETA.items()), "nuisance string, theta double")


@query(f"WITH {_JACOBIAN} SELECT a AS reco, i AS parameter, round(d, 4) + 0.0 AS derivative FROM j")
def fold_jacobian_nuisances(spark, sf_dir):
    """Derivatives of the fold at theta by every truth bin and every nuisance."""
    cells = _varied_cells(spark, sf_dir)
    j = model.jacobian(model.truth(cells), cells, _NUISANCES, _at_theta(spark))
    return rounded(j.select(F.col("a").alias("reco"), F.col("i").alias("parameter"), F.col("d").alias("derivative")), derivative=4)


@query(f"""WITH {_JACOBIAN}, c AS (SELECT 'gen:' || gen AS i, b AS v FROM be UNION ALL VALUES {', '.join(f"('{n.name}', 1.0)" for n in _NUISANCES)})
SELECT x.a AS i, y.a AS j, round(sum(x.d * c.v * y.d) / 1e3, 3) + 0.0 AS cov FROM j x JOIN c ON c.i = x.i JOIN j y ON y.i = x.i GROUP BY 1, 2""")
def fold_covariance_nuisances(spark, sf_dir):
    """First-order covariance of the fold: the truth's (its variance as its sum) and unit priors on the nuisances."""
    cells = _varied_cells(spark, sf_dir)
    beta = model.truth(cells)
    j = model.jacobian(beta, cells, _NUISANCES, _at_theta(spark))
    c = cov.sandwich(j, model.parameter_covariance(beta.withColumnRenamed("value", "variance"), _NUISANCES))
    return rounded(c.withColumn("cov", F.col("cov") / 1e3), cov=3)


@query(f"""WITH {_AT_THETA}, y AS (SELECT reco, t AS y FROM r WHERE v = 'nominal'), bp AS (SELECT gen, b - 20000 AS b FROM be),
fo AS (SELECT ts.reco, sum(ts.t * bp.b * (1 - gamma)) * (1 + any_value(rho)) AS f FROM ts JOIN bp USING (gen) JOIN ga USING (gen) JOIN ro USING (reco) GROUP BY 1)
SELECT round((0.5 * (SELECT sum((f - y) ** 2 / y) FROM fo JOIN y USING (reco)) + 0.5 * {sum(v * v for v in _THETA.values())!r} + 2.0 * (SELECT sum(greatest(-b, 0)) FROM bp)) / 1e3, 4)::double AS loss""")
def unfolding_objective(spark, sf_dir):
    """Half of chi-square between the fold of a trial truth and the observed sums, half of the nuisances' squares, and a
    penalty on negative truth."""
    cells = _varied_cells(spark, sf_dir)
    theta = _at_theta(spark)
    trial = model.truth(cells).select("gen", (F.col("value") - 20000).alias("value"))
    observed = cells.groupBy(F.col("reco").alias("i")).agg(F.sum(F.when(F.col("variation") == model.NOMINAL, F.col("w"))).alias("value"))
    folded = model.fold(trial, cells, _NUISANCES, theta).withColumnRenamed("reco", "i")
    inverse = observed.select("i", F.col("i").alias("j"), (1 / F.col("value")).alias("cov"))
    out = algebra.objective(algebra.chi_square(folded, observed, inverse), theta.select(F.col("theta").alias("value")), trial, 2.0)
    return rounded(out.select((F.col("loss") / 1e3).alias("loss")), loss=4)


_REPLICAS = 6
_POISSON_SQL = "CASE " + " ".join(f"WHEN u < {b!r} THEN {k}" for k, b in enumerate([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712])) + " ELSE 7 END"
_REPLICA_ITEMS = f"""SELECT r AS v, gen, reco, bkg, l_quantity * {_POISSON_SQL} AS w FROM (SELECT t.r, {_GEN} AS gen, {_RECO} AS reco, ({_BKG}) AS bkg, l_quantity,
('0x' || md5(l_orderkey::varchar || ':' || t.r::varchar)[1:8])::bigint / 4294967296.0::double AS u FROM lineitem, range({_REPLICAS}) t(r) WHERE l_extendedprice IS NOT NULL AND l_discount IS NOT NULL)"""


@query(f"""WITH {_model_sql(_REPLICA_ITEMS)}, fo AS (SELECT v, rs.reco, sum(rs.x * g.t * (1 - gamma.x)) * (1 + any_value(rho.x)) AS f FROM rs JOIN g USING (v, gen) JOIN gamma USING (v, gen) JOIN rho USING (v, reco) GROUP BY 1, 2),
m AS (SELECT reco, sum(f) / {_REPLICAS} AS m FROM fo GROUP BY 1), z AS (SELECT v, fo.reco, f - m AS z FROM fo JOIN m ON m.reco = fo.reco)
SELECT a.reco AS i, b.reco AS j, round(sum(a.z * b.z) / {_REPLICAS - 1} / 1e3, 2) + 0.0 AS cov FROM z a JOIN z b ON a.v = b.v GROUP BY 1, 2""")
def fold_bootstrap(spark, sf_dir):
    """Covariance of the fold over event-level replicas: each has its own truth and matrices, all from one pass."""
    draws = {str(r): F.col("l_quantity") * cov.poisson(f"_hash{r}") for r in range(_REPLICAS)}
    rows = _binned(_items(spark, sf_dir)).withColumns({f"_hash{r}": cov.hashed("l_orderkey", F.lit(r)) for r in range(_REPLICAS)})
    cells = model.filled(rows, "gen", "reco", F.expr(_ROLE), draws, _CELLS)
    values = model.folds(cells).select(F.col("variation").alias("r"), F.col("reco").alias("i"), "value")
    c = cov.over_replicas(values, _REPLICAS)
    return rounded(c.withColumn("cov", F.col("cov") / 1e3), cov=2)


#: Object systematics move the reconstructed price; each fills partitions of its own. One loses some cells.
_OBJECTS = [model.Nuisance("JES", objects=True), model.Nuisance("JER", objects=True, one_sided=True)]
_SHIFTED = {"nominal": (1.0, "true"), "JES_UP": (1.2, "true"), "JES_DN": (0.8, "l_linenumber < 6"), "JER": (1.1, "l_extendedprice < 60000")}
_OBJECT_ITEMS = " UNION ALL ".join(
    f"SELECT '{v}' AS v, {_GEN} AS gen, {case(PRICE, f'({KRECO} * {s!r}::double)')} AS reco, ({_BKG}) AS bkg, l_quantity AS w FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND {cut}" for v, (s, cut) in _SHIFTED.items()
)


def _delta_sql(which: str, table: str, keys: str) -> str:
    own = lambda v: f"coalesce(sum(x) FILTER (v = '{v}'), 0)"
    bins = "reco, gen" if keys == "reco, gen" else "reco, NULL::int AS gen" if keys == "reco" else "NULL::int AS reco, gen"
    return f"""SELECT '{which}' AS matrix, 'JES' AS nuisance, {bins}, round(({own('JES_UP')} - {own('JES_DN')}) * 0.5, 8) + 0.0 AS delta FROM {table} GROUP BY {keys}
UNION ALL SELECT '{which}', 'JER', {bins}, round({own('JER')} - {own('nominal')}, 8) + 0.0 FROM {table} GROUP BY {keys}"""


@query(f"WITH {_model_sql(_OBJECT_ITEMS)} {_delta_sql('gamma', 'gamma', 'gen')} UNION ALL {_delta_sql('rho', 'rho', 'reco')} UNION ALL {_delta_sql('response', 'rs', 'reco, gen')}")
def object_systematics(spark, sf_dir):
    """Variations of gamma, rho and the response from the written partitions of each object systematic, read by one scan."""
    path = _folder(spark, "objsyst")
    for name, (factor, cut) in _SHIFTED.items():
        rows = _binned(_items(spark, sf_dir).where(cut), f"({KRECO} * {factor!r}D)")
        filled = rows.groupBy("gen", "reco", F.expr(_ROLE).alias("role")).agg(F.sum("l_quantity").alias("w"))
        layout.write_table(filled, path, objsyst=name)
    cells = model.filled_from_partitions(layout.scan_table(spark, path), most=_CELLS * len(_SHIFTED))
    none = F.lit(None).cast("int")
    parts = [("gamma", model.gammas(cells), ["gen"]), ("rho", model.rhos(cells), ["reco"]), ("response", model.responses(cells), ["reco", "gen"])]
    out = None
    for name, matrix, keys in parts:
        d = model.deltas(matrix, keys, _OBJECTS)
        d = d.select(F.lit(name).alias("matrix"), "nuisance", *[F.col(k) if k in keys else none.alias(k) for k in ("reco", "gen")], "delta")
        out = d if out is None else out.unionByName(d)
    return rounded(out, delta=8)


def _conditioned(steps: list[int]) -> str:
    """CTEs c0 (all), c1, ...: the covariance conditioned on each entry in turn."""
    out = ["c0 AS (SELECT i, j, cov FROM c)"]
    for n, k in enumerate(steps):
        out.append(
            f"""c{n + 1} AS (SELECT x.i, x.j, x.cov - coalesce(a.cov, 0) * coalesce(b.cov, 0) / p.cov AS cov FROM c{n} x JOIN (SELECT cov FROM c{n} WHERE i = {k} AND j = {k}) p ON true
LEFT JOIN c{n} a ON a.i = x.i AND a.j = {k} LEFT JOIN c{n} b ON b.i = x.j AND b.j = {k} WHERE x.i <> {k} AND x.j <> {k})"""
        )
    return ", ".join(out)


@query(f"""WITH {_COV}, {_conditioned([1, 3, 4])} SELECT f.i, round(f.cov - s.cov, 2) AS contribution FROM c2 f JOIN c3 s ON s.i = f.i AND s.j = f.j WHERE f.i = f.j""")
def nuisance_contributions(spark, sf_dir):
    """One of three nuisances: the variance with it free and the others fixed, less that with all fixed."""
    return rounded(algebra.nuisance_contribution(*_values_and_cov(spark, sf_dir), [1, 3, 4], 4), contribution=2)


def _shifted(steps: dict[int, float]) -> str:
    """CTEs v0, v1, ...: the values conditioned on each entry in turn, beside `_conditioned`."""
    out = ["v0 AS (SELECT i, value FROM v)"]
    for n, (k, at) in enumerate(steps.items()):
        out.append(f"v{n + 1} AS (SELECT x.i, x.value + coalesce(a.cov, 0) / p.cov * ({at!r} - y.value) AS value FROM v{n} x JOIN (SELECT value FROM v{n} WHERE i = {k}) y ON true JOIN (SELECT cov FROM c{n} WHERE i = {k} AND j = {k}) p ON true LEFT JOIN c{n} a ON a.i = x.i AND a.j = {k} WHERE x.i <> {k})")
    return ", ".join(out)


_FIXED = {4: 100.0, 1: 5000.0, 3: 20.0}


@query(f"WITH {_COV}, {_VAL}, {_conditioned(list(_FIXED))}, {_shifted(_FIXED)} SELECT c3.i, c3.j, round(c3.cov, 2) AS cov, round(v3.value, 3) AS value FROM c3 JOIN v3 ON v3.i = c3.i")
def condition_several(spark, sf_dir):
    """Values and covariance given that three entries have stated values."""
    v, c = algebra.condition_on(*_values_and_cov(spark, sf_dir), _FIXED)
    return rounded(c.join(v, "i"), cov=2, value=3)


# ---- chi-square of shapes


_FLAT = [QTY, DISC]
_BINQ, _BIND = case(QTY, "l_quantity"), case(DISC, "l_discount")
_INSIDE = (2, 7)  # the quantity bins that lie in [10, 40]


@query(f"""
WITH per AS (SELECT l_orderkey AS e, {_BINQ} AS q, {_BIND} AS d, coalesce(sum({KPRICE}) FILTER (l_linestatus = 'O'), 0) AS x, coalesce(sum({KPRICE}) FILTER (l_linestatus = 'F'), 0) AS y
  FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1, 2, 3),
v AS (SELECT q, d, sum(x) AS x, sum(y) AS y FROM per GROUP BY 1, 2), s AS (SELECT q, d, sum(x) OVER w AS fx, sum(y) OVER w AS fy, x / sum(x) OVER w AS sx, y / sum(y) OVER w AS sy FROM v WINDOW w AS (PARTITION BY d)),
c AS (SELECT a.q AS iq, a.d AS id, b.q AS jq, b.d AS jd, sum(a.x * b.x) AS cx, sum(a.y * b.y) AS cy FROM per a JOIN per b ON a.e = b.e GROUP BY 1, 2, 3, 4),
k AS (SELECT a.q AS aq, a.d AS d, i.q AS iq, (CASE WHEN a.q = i.q THEN 1.0 ELSE 0.0 END - a.sx) / a.fx AS jx, (CASE WHEN a.q = i.q THEN 1.0 ELSE 0.0 END - a.sy) / a.fy AS jy FROM s a JOIN s i ON i.d = a.d WHERE a.q BETWEEN {_INSIDE[0]} AND {_INSIDE[1]}),
m AS (SELECT p.aq, p.d AS ad, r.aq AS bq, r.d AS bd, sum(p.jx * cx * r.jx + p.jy * cy * r.jy) AS cov FROM k p JOIN c ON c.iq = p.iq AND c.id = p.d JOIN k r ON r.iq = c.jq AND r.d = c.jd
  WHERE p.d = r.d AND abs(p.aq - r.aq) <= 1 GROUP BY 1, 2, 3, 4),
f AS (SELECT q, d, sx - sy AS z FROM s WHERE q BETWEEN {_INSIDE[0]} AND {_INSIDE[1]}),
n AS (SELECT a.q AS aq, a.d AS ad, b.q AS bq, b.d AS bd, a.z * b.z AS zz, CASE WHEN a.q = b.q THEN 2.0 ELSE -0.5 END * 1e4 AS inv FROM f a JOIN f b ON b.d = a.d AND abs(a.q - b.q) <= 1)
SELECT round(sum(zz * inv), 5)::double AS chi2, (SELECT count(*) FROM f) AS ndf, round(sum(inv * cov), 5)::double AS expected FROM n LEFT JOIN m USING (aq, ad, bq, bd)""")
def chi2_shapes(spark, sf_dir):
    """Chi-square of two spectra's shapes per discount bin within a range of quantity, for a given inverse covariance with
    neighbours, and what the spectra's own covariances, put through the same transform and slice, make one expect."""
    rows = hist.with_bins(_items(spark, sf_dir), _FLAT, ["l_quantity", "l_discount"]).withColumn("cell", flat_index(_FLAT, ["_bin_qty", "_bin_disc"]))
    of = lambda s: F.coalesce(F.when(F.col("l_linestatus") == s, _k(KPRICE)), F.lit(0.0))
    per = cov.per_event(rows, "l_orderkey", "cell", {"x": of("O"), "y": of("F")})
    values = per.groupBy(F.col("cell").alias("i")).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    pairs = cov.covariance_of(per, "l_orderkey", "cell", {"cov_x": "x", "cov_y": "y"})
    inverse = [(flat_number(q, d), flat_number(p, d), 1e4 * (2.0 if p == q else -0.5)) for d in DISC.slots() for q in range(*_span()) for p in (q - 1, q, q + 1) if p in range(*_span())]
    given = lookup.local(spark, inverse, "i long, j long, cov double")
    out = algebra.chi_square_shapes(values, pairs, given, _FLAT, ["disc"], {"qty": (10, 40)})
    return rounded(out, chi2=5, expected=5)


def _span() -> tuple[int, int]:
    return _INSIDE[0], _INSIDE[1] + 1


def flat_number(q: int, d: int) -> int:
    """`flat_index` of one cell of (QTY, DISC) on the driver; both have an underflow slot."""
    return (q + 1) * DISC.extent + d + 1


# ---- covariance and transfer over several axes


_WIDE = Axis.regular("qty", 5, 0, 50, underflow=False)
_AXES = [_WIDE, DISC, TAX]
_HALF = Axis.variable("qty", [0, 20, 50], underflow=False)
_TAXED = "l_quantity IS NOT NULL AND l_discount IS NOT NULL AND " + case(TAX, "l_tax") + " IN (1, 2)"


def _flat_items(spark, sf_dir) -> DataFrame:
    rows = hist.with_bins(_items(spark, sf_dir), _AXES, ["l_quantity", "l_discount", "l_tax"])
    return rows.withColumn("cell", flat_index(_AXES, ["_bin_qty", "_bin_disc", "_bin_tax"]))


@query(f"""
WITH per AS (SELECT l_orderkey AS e, {case(_HALF, 'l_quantity')} AS q, {_BIND} AS d, sum({KPRICE}) AS w FROM lineitem WHERE {_TAXED} GROUP BY 1, 2, 3)
SELECT a.q AS qty_i, a.d AS disc_i, b.q AS qty_j, b.d AS disc_j, round(sum(a.w * b.w), 2) AS cov FROM per a JOIN per b ON a.e = b.e GROUP BY 1, 2, 3, 4""")
def cov_three_axes(spark, sf_dir):
    """A covariance over three axes, sliced in one, rebinned in another and projected onto two."""
    c = cov.event_covariance(_flat_items(spark, sf_dir), "l_orderkey", "cell", _k(KPRICE))
    how = {"keep": ["qty", "disc"], "coarse": {"qty": _HALF}}
    c = cov.on_axes(c, {"i": _AXES, "j": _AXES}, within={"tax": (0.02, 0.06)}, **how)
    left = cov.kept_axes(_AXES, **how)
    bins = {f"{n}_{s}": x for s in ("i", "j") for n, x in slots_of(left, s).items()}
    return rounded(c.select(*[x.alias(n) for n, x in bins.items()], "cov"), cov=2)


@query(f"""SELECT {case(_HALF, 'l_quantity')} AS qty_reco, {_BIND} AS disc_gen, round(sum({KPRICE}), 3) AS sumw FROM lineitem WHERE {_TAXED} GROUP BY 1, 2""")
def transfer_three_axes(spark, sf_dir):
    """A transfer over three axes on both sides: each side is projected onto an axis of its own, after a slice of both."""
    t = _flat_items(spark, sf_dir).groupBy(F.col("cell").alias("reco"), F.col("cell").alias("gen")).agg(F.sum(_k(KPRICE)).alias("sumw"))
    how = {"keep": ["qty"], "coarse": {"qty": _HALF}}
    t = cov.on_axes(t, {"reco": _AXES}, within={"tax": (0.02, 0.06)}, value="sumw", also=["gen"], **how)
    t = cov.on_axes(t, {"gen": _AXES}, keep=["disc"], within={"tax": (0.02, 0.06)}, value="sumw", also=["reco"])
    out = t.select(slots_of(cov.kept_axes(_AXES, **how), "reco")["qty"].alias("qty_reco"), slots_of([DISC], "gen")["disc"].alias("disc_gen"), "sumw")
    return rounded(out, sumw=3)


_HOT = "(CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_orderkey END)"
_FINE = "floor(l_extendedprice / 500)::int"


@query(f"""WITH per AS (SELECT {_HOT} AS e, {_FINE} AS cell, sum(l_quantity) AS w FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1, 2)
SELECT a.cell AS i, b.cell AS j, round(sum(a.w * b.w), 2) AS cov FROM per a JOIN per b ON a.e = b.e GROUP BY 1, 2""")
def cov_many_cells(spark, sf_dir):
    """One event that has nearly all cells beside many small ones: it is dealt out in pairs of blocks."""
    rows = _items(spark, sf_dir).withColumns({"event": F.expr(_HOT), "cell": F.floor(F.col("l_extendedprice") / 500).cast("int")})
    return rounded(cov.event_covariance(rows, "event", "cell", "l_quantity", block=32), cov=2)


# ---- stacks and partitions of binned tables


_TOTAL = Axis.regular("total", 6, 0, 300, underflow=False)
_LINKS = [("all", "mc", "stack"), ("all", "5-LOW", "dset"), ("mc", "1-URGENT", "dset"), ("mc", "2-HIGH", "dset"), ("other", "3-MEDIUM", "dset")]


@query(f"""
WITH h AS (SELECT o_orderpriority AS d, {case(_TOTAL, '(o_totalprice / 1000)')} AS total, sum(o_totalprice / 1000) AS w, sum((o_totalprice / 1000) ** 2) AS w2 FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1, 2)
SELECT 'all' AS stack, total AS i, round(sum(w), 3) AS sumw, round(coalesce(sum(w2) FILTER (d <> '2-HIGH'), 0) * 0.25, 3) AS cov FROM h GROUP BY total""")
def stack_scan(spark, sf_dir):
    """A named stack read from partitioned values and covariances, pruned at run time; one dataset has no covariance stored."""
    path = _folder(spark, "binned")
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "dataset")
    h = hist.histogram(o, [_TOTAL], [F.col("o_totalprice") / 1000], F.col("o_totalprice") / 1000, by=["dataset"])
    h.write.partitionBy("dataset").parquet(f"{path}/values/objsyst=nominal")
    c = h.where("dataset <> '2-HIGH'").select("dataset", F.col("total").alias("i"), F.col("total").alias("j"), F.col("sumw2").alias("cov"))
    c.write.partitionBy("dataset").parquet(f"{path}/covariances/objsyst=nominal")
    members = catalog.stack_members(spark, catalog.stack_links(spark, _LINKS))
    values, covariance = catalog.scan_stack(spark, f"{path}/values", f"{path}/covariances", members, "all", ["total"], "total", objsyst="nominal")
    diagonal = algebra.scale_covariance(covariance, 0.5).where("i = j").select("stack", "i", "cov")
    return rounded(values.withColumnRenamed("total", "i").join(diagonal, ["stack", "i"]).select("stack", "i", "sumw", "cov"), sumw=3, cov=3)


@query(f"""
SELECT {case(_TOTAL, '(o_totalprice / 1000)')} AS i, round(sum(o_totalprice / 1000), 3) AS sumw, CASE WHEN {case(_TOTAL, '(o_totalprice / 1000)')} < 3 THEN round(sum((o_totalprice / 1000) ** 2), 3) ELSE 0 END::double AS cov
FROM orders WHERE o_totalprice >= 0 AND o_orderpriority = '2-HIGH' GROUP BY 1""")
def binned_scan(spark, sf_dir):
    """One dataset's values and covariance by their coordinates; where no covariance is stored it is zero."""
    path = _folder(spark, "binned")
    o = read(spark, sf_dir, "orders").where("o_totalprice >= 0").withColumnRenamed("o_orderpriority", "dataset")
    h = hist.histogram(o, [_TOTAL], [F.col("o_totalprice") / 1000], F.col("o_totalprice") / 1000, by=["dataset"])
    h.write.partitionBy("dataset").parquet(f"{path}/values")
    h.where("total < 3").select("dataset", F.col("total").alias("i"), F.col("total").alias("j"), F.col("sumw2").alias("cov")).write.partitionBy("dataset").parquet(f"{path}/covariances")
    values, covariance = layout.binned(spark, f"{path}/values", f"{path}/covariances", "total", dataset="2-HIGH")
    out = values.withColumnRenamed("total", "i").join(covariance.where("i = j"), "i")
    return rounded(out.select("i", "sumw", "cov"), sumw=3, cov=3)


_JOBS = {"objects": ["nominal", "JES_UP", "JES_DN"], "weights": ["nominal", "puUp"]}
_WANTED = f"""d AS (SELECT DISTINCT o_orderpriority AS dataset FROM orders),
j AS (SELECT dataset, o AS objsyst, w AS wtsyst FROM d, (VALUES ('nominal'), ('JES_UP'), ('JES_DN')) a(o), (VALUES ('nominal'), ('puUp')) b(w) WHERE dataset <> '5-LOW' UNION ALL SELECT dataset, 'DATA', 'nominal' FROM d WHERE dataset = '5-LOW'),
x AS (SELECT j.*, tbl, statk FROM j, (VALUES ('jets'), ('events')) t(tbl), range(2) s(statk))"""


@query(f"""WITH {_WANTED}, s AS (SELECT dataset, objsyst, wtsyst, tbl, statk, CASE WHEN dataset = '2-HIGH' AND objsyst = 'JES_DN' THEN 'missing' WHEN dataset = '1-URGENT' AND wtsyst = 'puUp' AND tbl = 'jets' THEN 'empty' ELSE 'complete' END AS status FROM x
UNION ALL SELECT 'unknown', 'nominal', 'nominal', 'jets', 0, 'extra')
SELECT dataset, objsyst, wtsyst, tbl, statk::int AS statk, status FROM s""")
def binned_completeness(spark, sf_dir):
    """Binned outputs that the jobs ask for against the listing of what was written: some missing, some empty, one extra."""
    path = _folder(spark, "outputs")
    keys = ["dataset", "objsyst", "wtsyst", "tbl", "statk"]
    wanted = layout.binned_jobs(catalog.systematic_jobs(_catalog(spark, sf_dir), **_JOBS), ["jets", "events"], 2).select(*keys)
    h = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("dataset")).agg(F.sum("o_totalprice").alias("sumw"))
    empty = (F.col("dataset") == "1-URGENT") & (F.col("wtsyst") == "puUp") & (F.col("tbl") == "jets")
    rows = wanted.where(~((F.col("dataset") == "2-HIGH") & (F.col("objsyst") == "JES_DN")))
    rows.where(~empty).join(h, "dataset").coalesce(2).write.partitionBy(*keys).parquet(path)
    extra = h.limit(1).select(F.lit("unknown").alias("dataset"), F.lit("nominal").alias("objsyst"), F.lit("nominal").alias("wtsyst"), F.lit("jets").alias("tbl"), F.lit(0).alias("statk"), "sumw")
    extra.write.mode("append").partitionBy(*keys).parquet(path)
    for r in rows.where(empty).collect():  # a few folders with a file of no bytes
        at = "/".join(f"{k}={r[k]}" for k in keys)
        h.limit(0).select(F.lit("").alias("value")).coalesce(1).write.mode("append").text(f"{path}/{at}")
    found = layout.partition_status(wanted, layout.partition_files(spark, path, keys), keys)
    return found.select("dataset", "objsyst", "wtsyst", "tbl", F.col("statk").cast("int").alias("statk"), "status")


@query("SELECT o_orderpriority AS dataset, round(sum(CASE WHEN o_orderstatus = 'P' THEN -0.5 ELSE o_totalprice / 1e5 END), 4) AS count FROM orders GROUP BY 1")
def generator_weights(spark, sf_dir):
    """The count table where events have generator weights, of either sign."""
    o = read(spark, sf_dir, "orders").withColumn("genWeight", F.when(F.col("o_orderstatus") == "P", -0.5).otherwise(F.col("o_totalprice") / 1e5))
    return rounded(layout.counts(o, by=[F.col("o_orderpriority").alias("dataset")]), count=4)


@query("SELECT 'no rows' AS folder, true AS reported UNION ALL SELECT 'no table', true UNION ALL SELECT o_orderstatus, false FROM orders GROUP BY 1")
def damaged_files(spark, sf_dir):
    """Of files with rows, one without and one that is no table, those that the report names."""
    path = _folder(spark, "files")
    o = read(spark, sf_dir, "orders")
    o.write.partitionBy("o_orderstatus").parquet(f"{path}/good")
    o.limit(0).coalesce(1).write.parquet(f"{path}/empty")
    o.limit(1).select(F.lit("not a table").alias("value")).coalesce(1).write.text(f"{path}/text")
    bad = layout.empty_or_corrupt(spark, path, glob="part-*").withColumn("reported", F.lit(True))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"))
    folder = F.when(F.col("file").contains("/empty/"), "no rows").when(F.col("file").contains("/text/"), "no table").otherwise(F.regexp_extract("file", "o_orderstatus=([A-Z])", 1))
    return files.join(bad, "file", "left").groupBy(folder.alias("folder")).agg(F.coalesce(F.max("reported"), F.lit(False)).alias("reported"))


# ---- selections with every branch on


_SAMPLES = [("1-URGENT", 30.0, None, None), ("2-HIGH", None, 0.02, 0.08), ("3-MEDIUM", 20.0, 0.05, -1.0), ("5-LOW", None, None, None)]
_SAMPLES_SQL = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "NULL::double" if x is None else f"{x!r}::double" for x in r) + ")" for r in _SAMPLES)


@query(f"""WITH s(d, ht, lo, hi) AS (VALUES {_SAMPLES_SQL})
SELECT l_orderkey, l_linenumber, o_orderpriority AS dataset FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN s ON d = o_orderpriority
WHERE (ht IS NULL OR l_quantity <= ht) AND (lo IS NULL OR l_discount >= lo) AND (coalesce(hi, -1) < 0 OR l_discount < hi)""")
def stitching_by_catalog(spark, sf_dir):
    """Each dataset's own limits, from its catalog row; quantities and discounts are whole steps, so rows lie on the limits."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("dataset"))
    rows = _items(spark, sf_dir).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    limits = lookup.local(spark, _SAMPLES, "dataset string, ht_max double, vpt_low double, vpt_high double")
    return select.stitched(rows, limits, "l_quantity", "l_discount").select("l_orderkey", "l_linenumber", "dataset")


_STEPS = ["two", "lead_pt", "sub_pt", "lead_eta", "sub_eta", "id", "isolation", "dxy", "dz", "charge", "mass", "pair_pt", "pair_y"]
_PASS = [
    "two", "p1 >= 20000", "p2 >= 10000", "abs(e1) < 2.4", "abs(e2) < 2", "{id}1 AND {id}2", "q1 >= 2 AND q2 >= 2", "abs(x1) < 0.05 AND abs(x2) < 0.05", "abs(z1) < 0.04 AND abs(z2) < 0.04", "c1 <> c2",
    "mass BETWEEN 20000 AND 180000", "pt >= 15000", "abs(y) <= 1.5",
]


def _aggregates(conditions: list[str]) -> list[str]:
    return ["count(*)::double", "sum(w)", *[f"coalesce(sum(w) FILTER ({c}), 0)" for c in conditions]]


def _identity_sql(level: str) -> str:
    so_far = [" AND ".join(f"({p.format(id=level)})" for p in _PASS[: k + 1]) for k in range(len(_PASS))]
    names = ", ".join(f"'{n}'" for n in ["raw", "all", *_STEPS])
    return f"SELECT '{level}' AS identity, unnest(range({len(_PASS) + 2}))::int AS step_no, unnest([{names}]) AS step, round(unnest(a), 3) AS n FROM (SELECT [{', '.join(_aggregates(so_far))}] AS a FROM e)"


@query(f"""
WITH {_RANKED}, t AS (SELECT *, l_linenumber <> 2 AS loose, l_quantity > 15 AS medium, l_linestatus = 'F' AS tight FROM l),
p AS (SELECT l_orderkey, any_value(n) >= 2 AS two, {', '.join(f"max({c}) FILTER (k = {k}) AS {n}{k}" for k in (1, 2) for c, n in (('l_extendedprice', 'p'), ('eta', 'e'), ('phi', 'f'), ('mass', 'm'), ('charge', 'c'), ('l_linenumber', 'q'), ('l_discount - 0.05', 'x'), ('l_tax - 0.04', 'z')))},
  {', '.join(f"bool_or({c}) FILTER (k = {k}) AS {c}{k}" for k in (1, 2) for c in ('loose', 'medium', 'tight'))} FROM t GROUP BY 1),
v AS (SELECT *, p1 * cos(f1) + p2 * cos(f2) AS px, p1 * sin(f1) + p2 * sin(f2) AS py, p1 * sinh(e1) + p2 * sinh(e2) AS pz, sqrt((p1 * cosh(e1)) ** 2 + m1 ** 2) + sqrt((p2 * cosh(e2)) ** 2 + m2 ** 2) AS en FROM p),
e AS (SELECT v.*, o_totalprice / 1000 AS w, sqrt(px * px + py * py) AS pt, sqrt(greatest(en * en - px * px - py * py - pz * pz, 0)) AS mass, 0.5 * ln((en + pz) / nullif(en - pz, 0)) AS y FROM v JOIN orders ON o_orderkey = l_orderkey)
{' UNION ALL '.join(_identity_sql(level) for level in ('loose', 'medium', 'tight'))}""")
def muon_selection(spark, sf_dir):
    """The pair selection with every cut on, as a cutflow for each id level."""
    more = {"looseId": F.col("l_linenumber") != 2, "mediumId": F.col("l_quantity") > 15, "tightId": F.col("l_linestatus") == "F", "pfIsoId": F.col("l_linenumber"), "dxy": F.col("l_discount") - 0.05, "dz": F.col("l_tax") - 0.04}
    rows = _items(spark, sf_dir).select("l_orderkey", *_item_fields(), *[c.alias(n) for n, c in more.items()])
    top = tables.leading(rows, "l_orderkey", ["order", "l_linenumber"], 2).withColumnsRenamed({"leading1": "lead", "leading2": "sub"})
    e = top.withColumn("pair", expr.four_sum(F.col("lead"), F.col("sub"))).join(read(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = None
    for level in select.ID_FLAGS:
        s = select.inherited(
            select.muon_pair((20000, 10000), (2.4, 2.0), isolation="loose", identity=level, maximum_dxy=0.05, maximum_dz=0.04),
            select.pair_system(100000, 80000, 15000, 1.5),
        )
        flow = select.cutflow(e, s, F.col("o_totalprice") / 1000).select(F.lit(level).alias("identity"), "step_no", "step", "n")
        out = flow if out is None else out.unionByName(flow)
    return rounded(out, n=3)


@query(f"""
WITH {_RANKED}, p AS (SELECT l_orderkey, {', '.join(f"max({c}) FILTER (k = {k}) AS {n}{k}" for k in (1, 2) for c, n in (('l_extendedprice', 'p'), ('eta', 'e'), ('phi', 'f'), ('mass', 'm')))} FROM l GROUP BY 1 HAVING max(n) >= 2),
v AS (SELECT l_orderkey, p1 * cos(f1) + p2 * cos(f2) AS px, p1 * sin(f1) + p2 * sin(f2) AS py, p1 * sinh(e1) + p2 * sinh(e2) AS pz, sqrt((p1 * cosh(e1)) ** 2 + m1 ** 2) + sqrt((p2 * cosh(e2)) ** 2 + m2 ** 2) AS en FROM p)
SELECT l_orderkey, round(sqrt(px * px + py * py) / 1000, 5) AS pt, round(asinh(pz / sqrt(px * px + py * py)), 6) AS eta, round(atan2(py, px), 6) AS phi, round(sqrt(greatest(en * en - px * px - py * py - pz * pz, 0)) / 1000, 4) AS mass,
  round(0.5 * ln((en + pz) / (en - pz)), 5) AS y FROM v WHERE px * px + py * py > 1""")
def pair_kinematics(spark, sf_dir):
    """All five quantities of the two leading items' four-vector sum."""
    rows = _items(spark, sf_dir).select("l_orderkey", *_item_fields())
    top = tables.leading(rows, "l_orderkey", ["order", "l_linenumber"], 2).where("n_leading = 2")
    z = top.select("l_orderkey", expr.four_sum(F.col("leading1"), F.col("leading2")).alias("z")).where("z.pt > 1")
    out = z.select("l_orderkey", (F.col("z.pt") / 1000).alias("pt"), "z.eta", "z.phi", (F.col("z.mass") / 1000).alias("mass"), "z.y")
    return rounded(out, pt=5, eta=6, phi=6, mass=4, y=5)


@query("""
SELECT l_orderkey, count(*) FILTER (l_extendedprice > 10000 AND abs((l_quantity - 25) / 10) < 2 AND l_returnflag = 'R' AND abs(l_discount - 0.05) < 0.04 AND abs(l_tax - 0.04) < 0.03)::int AS flagged,
  count(*) FILTER (l_linenumber >= 3 AND abs(l_tax - 0.04) < 0.03)::int AS levelled, count(*)::int AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def item_quality_limits(spark, sf_dir):
    """Item selections with every limit on: by a flag, and by the least level of an id."""
    item = F.struct(
        F.col("l_extendedprice").alias("pt"), ((F.col("l_quantity") - 25) / 10).alias("eta"), (F.col("l_returnflag") == "R").alias("good"), F.col("l_linenumber").alias("level"),
        (F.col("l_discount") - 0.05).alias("dxy"), (F.col("l_tax") - 0.04).alias("dz"),
    )
    items = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    e = items.join(read(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    flagged = select.quality("items", 10000, 2, "good", None, 0.04, 0.03)
    levelled = select.quality("items", flag="level", level=3, maximum_dz=0.03)
    return e.select("l_orderkey", F.size(flagged).alias("flagged"), F.size(levelled).alias("levelled"), F.size("items").alias("n"))


# ---- weights and streams


_PT = Axis.regular("pt", 8, 0, 320, underflow=False)
_NUM = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
_PTSQL = case(_PT, "(o_totalprice / 1000)")


@query(f"""
WITH o AS (SELECT {_PTSQL} AS pt, {_NUM} AS n, o_totalprice / 1000 AS w FROM orders WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_totalprice >= 0),
h AS (SELECT pt, coalesce(sum(w) FILTER (n), 0) AS n, coalesce(sum(w * w) FILTER (n), 0) AS n2, coalesce(sum(w) FILTER (NOT n), 0) AS d, coalesce(sum(w * w) FILTER (NOT n), 0) AS d2 FROM o GROUP BY 1),
t AS (SELECT sum(n) AS tn, sum(d) AS td FROM h),
r AS (SELECT pt, (n / tn) / nullif(d / td, 0) AS ratio, sqrt((n2 / (tn * tn)) / nullif((d / td) ** 2, 0) + (n / tn) ** 2 * (d2 / (td * td)) / nullif((d / td) ** 4, 0)) AS error FROM h, t),
s AS (SELECT pt, sum(ratio / error) OVER w / sum(1 / error) OVER w AS c FROM r WHERE pt BETWEEN 0 AND 7 AND error > 0 AND ratio IS NOT NULL WINDOW w AS (ORDER BY pt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) UNION ALL SELECT pt, ratio FROM r WHERE pt NOT BETWEEN 0 AND 7)
SELECT o.pt, round(sum(w) FILTER (NOT n), 3) AS before, round(sum(w * coalesce(c, 1)) FILTER (NOT n), 3) AS after, round(any_value(c), 7) AS correction FROM o LEFT JOIN s ON s.pt = o.pt GROUP BY 1""")
def derived_reweighting(spark, sf_dir):
    """Weights derived from the ratio of two datasets' shapes, smoothed by errors, and applied to the denominator's events."""
    o = read(spark, sf_dir, "orders").where("o_totalprice is not null and o_orderpriority is not null").withColumn("w", F.col("o_totalprice") / 1000)
    h = reweight.side_by_side(o, _PT, "w", F.expr(_NUM), "w")
    table = reweight.correction(reweight.shape_ratio(h, _PT), _PT, 1, by_error=True)
    out = reweight.corrected(o, table, _PT, "w").withColumn("pt", _PT.index("w")).where("pt is not null")
    den = ~F.expr(_NUM)
    out = out.groupBy("pt").agg(F.sum(F.when(den, F.col("w"))).alias("before"), F.sum(F.when(den, F.col("w") * F.col("correction"))).alias("after"), F.max("correction").alias("correction"))
    return rounded(out, before=3, after=3, correction=7)


@query("""
SELECT p_partkey, round(CASE WHEN p_size < 26 OR p_size > 40 OR p_retailprice > 1500 THEN 1.0 ELSE (p_size - 25) / 10.0 END, 6)::double AS guarded FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL""")
def guarded_weight(spark, sf_dir):
    """A looked-up weight that counts as 1 where it is absent or not positive, and where the row is outside the weight's range."""
    axis = Axis.regular("size", 40, 0.5, 40.5, underflow=False, overflow=False)
    t = lookup.local(spark, [(k, (k - 24) / 10) for k in range(40)], "size int, value double")
    p = lookup.binned_lookup(read(spark, sf_dir, "part").where("p_size is not null and p_retailprice is not null"), t, [(axis, "p_size")], default=None, into="raw")
    return rounded(p.select("p_partkey", weights.guarded("raw", invalid=F.col("p_retailprice") > 1500).alias("guarded")), guarded=6)


_PERIODS = [(1.0, 10.0, 0.9), (10.0, 20.5, 1.1), (30.0, 45.0, 1.25)]


@query(f"""WITH r(lo, hi, v) AS (VALUES {', '.join(f"({a!r}::double, {b!r}::double, {v!r}::double)" for a, b, v in _PERIODS)})
SELECT l_orderkey, l_linenumber, coalesce(v, 1.0)::double AS correction FROM lineitem LEFT JOIN r ON l_quantity >= lo AND l_quantity < hi""")
def range_correction(spark, sf_dir):
    """A correction by ranges that leave gaps, so that they are no axis; a value on a limit belongs to the upper range."""
    out = lookup.range_lookup(_items(spark, sf_dir), _PERIODS, "l_quantity")
    return out.select("l_orderkey", "l_linenumber", "correction")


_VALUES = Axis.regular("value", 12, 0, 120)


@query(f"SELECT event_type, {case(_VALUES, 'value')} AS value, count(*) AS n, round(sum(value), 3) AS sumw FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def stream_partials(spark, sf_dir):
    """`events` as small files that arrive over many batches; each batch leaves its own sums, which are added up and compacted."""
    from ..streaming import fill

    out, events = _folder(spark, "partials"), read(spark, sf_dir, "events")
    events.repartition(7).write.parquet(f"{out}/arriving")
    stream = fill.source(spark, f"{out}/arriving", events.schema, files=1)
    keys = ["event_type", "value"]
    one = lambda rows: hist.histogram(rows, [_VALUES], ["value"], "value", by=["event_type"])
    fill.start_partials(stream, one, f"{out}/table", f"{out}/checkpoint", keys, every=3).awaitTermination()
    return rounded(fill.summed(spark, f"{out}/table", keys).select(*keys, "n", "sumw"), sumw=3)
