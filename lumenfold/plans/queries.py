"""The registered queries of the analytics library, and the SQL that gives the same rows.

Roles of the tables: an order is an event, its line items are the event's items, an order's priority is its dataset.
Quantity, price, discount and tax are coordinates; the price after discount is the reconstructed price. Sums are
rounded, as engines add in different orders.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, lookup, nested, weights
from ..functions.axes import Axis, automatic, categories
from ..operators import algebra, cov, hist, select, smooth, tables, yields
from ..sources import catalog, layout

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from . import binned  # noqa: F401  registers its own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import binned  # noqa: F401

    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of `spark.checkpoint.dir`; a local one only where the master is local and it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lumenfold-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Rounds columns; adding 0.0 turns a negative zero into zero."""
    return df.withColumns({c: F.round(F.col(c), k) + F.lit(0.0) for c, k in digits.items()})


def case(axis: Axis, x: str) -> str:
    """SQL for a bin index by comparisons of edges."""
    n = axis.bins
    under = "0" if axis.clamp else "-1" if axis.underflow else "NULL"
    over = str(n - 1) if axis.clamp else str(n) if axis.overflow else "NULL"
    beyond = ">=" if axis.overflow or axis.clamp else ">"
    inside = " ".join(f"WHEN {x} < {axis.edges[k + 1]!r}::double THEN {k}" for k in range(n - 1))
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN isnan({x}) THEN {over} WHEN {x} < {axis.edges[0]!r}::double THEN {under} WHEN {x} {beyond} {axis.edges[-1]!r}::double THEN {over} {inside} ELSE {n - 1} END)"


QTY = Axis.regular("qty", 10, 0, 50)
DISC = Axis.variable("disc", [0.0, 0.02, 0.05, 0.08])
PRICE = Axis.variable("price", [5.0, 15.0, 25.0, 40.0])  # in thousands
TAX = Axis.regular("tax", 4, 0, 0.08, overflow=False)
CELLS = Axis.variable("cell", [0, 10, 20, 30, 40], underflow=False)  # quantity, five cells with overflow
KPRICE = "(l_extendedprice / 1000)"
KRECO = "(l_extendedprice * (1 - l_discount) / 1000)"


def _k(c: str) -> Column:
    return F.expr(c[1:-1] if c[0] == "(" else c)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem")


# ---- histograms


@query(f"""
SELECT {case(QTY, 'l_quantity')} AS qty, {case(DISC, 'l_discount')} AS disc, round(sum({KPRICE}), 3) AS sumw, round(sum({KPRICE} * {KPRICE}), 2) AS sumw2, count(*) AS n
FROM lineitem WHERE l_quantity >= 5 AND l_tax < 0.07 AND l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1, 2""")
def hist_weighted_2d(spark, sf_dir):
    rows = _items(spark, sf_dir).where(expr.both(expr.greater("l_quantity", 5), expr.less("l_tax", 0.07)))
    return rounded(hist.histogram(rows, [QTY, DISC], ["l_quantity", "l_discount"], _k(KPRICE)), sumw=3, sumw2=2)


CLAMPED = Axis.variable("price", [10.0, 20.0, 22.5, 40.0, 60.0], clamp=True)


@query(f"""
SELECT {case(CLAMPED, KPRICE)} AS price, round(sum(l_quantity), 3) AS sumw, round(sum(l_quantity * l_quantity), 2) AS sumw2, count(*) AS n
FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1""")
def hist_clamped_variable(spark, sf_dir):
    return rounded(hist.histogram(_items(spark, sf_dir), [CLAMPED], [_k(KPRICE)], "l_quantity"), sumw=3, sumw2=2)


FINE = Axis.variable("size", [float(k) for k in range(51)])
COARSE = FINE.rebinned(5).narrowed(1, 8)


@query(f"""
SELECT CASE WHEN p_size < 1 OR p_size > 50 THEN 7 ELSE {case(COARSE, '(p_size - 1 + 0.5)::double')} END AS size, round(sum(p_retailprice), 2) AS sumw, count(*) AS n
FROM part WHERE p_size IS NOT NULL GROUP BY 1""")
def hist_prebinned_rebin(spark, sf_dir):
    p = read(spark, sf_dir, "part").withColumn("_size", FINE.prebinned_index(COARSE, "p_size"))
    g = p.where("_size is not null").groupBy(F.col("_size").alias("size")).agg(F.sum("p_retailprice").alias("sumw"), F.count(F.lit(1)).alias("n"))
    return rounded(g, sumw=2)


LOG = Axis.regular("lp", 8, 1.0, 128.0, transform="log")


@query(f"""
WITH h AS (SELECT {case(LOG, KPRICE)} AS lp, sum(l_quantity) AS s FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1),
e AS (SELECT k AS lp, 2 ** (7 * k / 8.0) AS lo, 2 ** (7 * (k + 1) / 8.0) AS hi FROM range(8) t(k))
SELECT lp, round(s, 2) AS sumw, round(s / (sum(s) OVER () * (hi - lo)), 8) AS density FROM h LEFT JOIN e USING (lp)""")
def hist_log_axis(spark, sf_dir):
    h = hist.histogram(_items(spark, sf_dir), [LOG], [_k(KPRICE)], "l_quantity")
    return rounded(hist.density(h, [LOG]).select("lp", "sumw", "density"), sumw=2, density=8)


@query("""
SELECT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS category, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sumw
FROM lineitem GROUP BY 1, 2""")
def hist_category_auto(spark, sf_dir):
    c = categories("l_returnflag", {"A": "accepted", "R": "returned"}).alias("category")
    return rounded(_items(spark, sf_dir).groupBy(c, "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("sumw")), sumw=2)


@query("""
WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT least(floor((o_totalprice - lo) / (hi - lo) * 20.0)::int, 19) AS total, count(*) AS n FROM orders, r WHERE o_totalprice IS NOT NULL GROUP BY 1""")
def hist_auto_range(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    axis = automatic(o, "total", "o_totalprice", 20)
    return hist.histogram(o, [axis], ["o_totalprice"]).select("total", "n")


@query(f"""
WITH g AS (SELECT q.k AS qty, d.k AS disc FROM range(-1, 11) q(k), range(-1, 4) d(k)),
h AS (SELECT {case(QTY, 'l_quantity')} AS qty, {case(DISC, 'l_discount')} AS disc, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT g.qty::int AS qty, g.disc::int AS disc, coalesce(n, 0) AS n FROM g LEFT JOIN h ON h.qty = g.qty AND h.disc = g.disc""")
def hist_dense_grid(spark, sf_dir):
    h = hist.histogram(_items(spark, sf_dir), [QTY, DISC], ["l_quantity", "l_discount"]).select("qty", "disc", "n")
    return hist.dense(h, [QTY, DISC])


@query(f"""
WITH h AS (SELECT {case(QTY, 'l_quantity')} AS qty, l_orderkey % 5 AS k, sum({KPRICE}) AS s FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1, 2)
SELECT qty, round(sum(s), 3) AS whole, round(sum(CASE WHEN k IN (0, 2) THEN s END) * 2.5, 3) AS from_two FROM h GROUP BY qty""")
def stat_split_sum(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("statk", expr.unsigned_mod("l_orderkey", 5))
    h = hist.histogram(rows, [QTY], ["l_quantity"], _k(KPRICE), by=["statk"])
    sums = hist.split_sums(h, ["qty"], {"whole": None, "from_two": [0, 2]})
    return rounded(algebra.scale(sums, weights.split_factor(5, 2), "from_two", None), whole=3, from_two=3)


@query(f"""
SELECT (l_orderkey % 10) % 5 AS statk, {case(QTY, 'l_quantity')} AS qty, round(sum({KPRICE}), 3) AS sumw FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1, 2""")
def stat_resplit(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("statk", expr.unsigned_mod("l_orderkey", 10))
    h = hist.histogram(rows, [QTY], ["l_quantity"], _k(KPRICE), by=["statk"])
    return rounded(hist.combine_splits(h, ["qty"], into=5).select("statk", "qty", "sumw"), sumw=3)


@query(f"""
WITH t AS (SELECT {case(PRICE, KPRICE)} AS gen, {case(PRICE, KRECO)} AS reco, l_quantity AS w FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_discount IS NOT NULL)
SELECT reco AS price_reco, gen AS price_gen, round(sum(w), 2) AS sumw, round(sum(w * w), 2) AS sumw2, count(*) AS n FROM t GROUP BY 1, 2""")
def transfer_matrix(spark, sf_dir):
    return rounded(hist.transfer(_items(spark, sf_dir), [(PRICE, _k(KRECO))], [(PRICE, _k(KPRICE))], "l_quantity"), sumw=2, sumw2=2)


_VARIED = {"nominal": "l_quantity", "qtyUp": "l_quantity * 1.05", "qtyDown": "l_quantity * 0.95", "taxUp": "l_quantity * (1 + l_tax)"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS variation, {case(DISC, 'l_discount')} AS disc, round(sum({w}), 2) AS sumw FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 2" for n, w in _VARIED.items()))
def syst_variations(spark, sf_dir):
    s = weights.WeightSet().add("qty", "l_quantity", F.col("l_quantity") * 1.05, F.col("l_quantity") * 0.95).add("tax", F.lit(1.0), 1 + F.col("l_tax"))
    rows = s.apply(_items(spark, sf_dir))
    h = hist.variations(rows, [DISC], {"nominal": "wt_nominal", "qtyUp": "wt_qtyUp", "qtyDown": "wt_qtyDown", "taxUp": "wt_taxUp"}, ["l_discount"])
    return rounded(h.select("variation", "disc", "sumw"), sumw=2)


@query(f"""
WITH h AS (SELECT {case(DISC, 'l_discount')} AS disc, sum(l_quantity) AS n, sum(l_quantity * 1.05) AS u, sum(l_quantity * 0.95) AS d, sum(l_quantity * (1 + l_tax)) AS t FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1)
SELECT 'qty' AS nuisance, disc, round((u - d) * 0.5, 2) AS delta FROM h UNION ALL SELECT 'tax', disc, round(t - n, 2) FROM h""")
def systematic_deltas(spark, sf_dir):
    v = {"n": F.col("l_quantity"), "u": F.col("l_quantity") * 1.05, "d": F.col("l_quantity") * 0.95, "t": F.col("l_quantity") * (1 + F.col("l_tax"))}
    h = hist.variations(_items(spark, sf_dir), [DISC], v, ["l_discount"])
    wide = h.groupBy("disc").pivot("variation", list(v)).agg(F.first("sumw"))
    return rounded(algebra.systematic_deltas(wide, ["disc"], "n", {"qty": ("u", "d"), "tax": ("t", None)}), delta=2)


# ---- covariance


_PER = f"per AS (SELECT l_orderkey AS e, {case(CELLS, 'l_quantity')} AS cell, sum({KPRICE}) AS w FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1, 2)"
_COV = _PER + ", c AS (SELECT a.cell AS i, b.cell AS j, sum(a.w * b.w) AS cov FROM per a JOIN per b ON a.e = b.e GROUP BY 1, 2)"
_VAL = "v AS (SELECT cell AS i, sum(w) AS value FROM per GROUP BY 1)"


def _cells(spark, sf_dir) -> DataFrame:
    return hist.with_bins(_items(spark, sf_dir), [CELLS], ["l_quantity"]).withColumnRenamed("_bin_cell", "cell")


def _cov(spark, sf_dir) -> DataFrame:
    return cov.event_covariance(_cells(spark, sf_dir), "l_orderkey", "cell", _k(KPRICE))


def _values_and_cov(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Both from the same sums per event and cell, so the items are read once."""
    per = cov.per_event(_cells(spark, sf_dir), "l_orderkey", "cell", {"w": _k(KPRICE)})
    values = per.groupBy(F.col("cell").alias("i")).agg(F.sum("w").alias("value"))
    return values, cov.covariance_of(per, "l_orderkey", "cell", {"cov": "w"})


@query(f"WITH {_COV} SELECT i, j, round(cov, 2) AS cov FROM c")
def cov_event_correlated(spark, sf_dir):
    return rounded(_cov(spark, sf_dir), cov=2)


@query(f"WITH {_COV} SELECT c.i, c.j, round(c.cov / sqrt(a.cov * b.cov), 8) AS corr FROM c JOIN c a ON a.i = c.i AND a.j = c.i JOIN c b ON b.i = c.j AND b.j = c.j")
def correlation_from_cov(spark, sf_dir):
    return rounded(cov.correlation(_cov(spark, sf_dir)), corr=8)


@query(f"WITH {_COV} SELECT i // 2 AS i, j // 2 AS j, round(sum(cov), 2) AS cov FROM c GROUP BY 1, 2")
def cov_rebinned(spark, sf_dir):
    c = _cov(spark, sf_dir)
    mapping = lookup.local(spark, [(k, k // 2) for k in CELLS.slots()], "old int, new int")
    return rounded(cov.rebinned(c, mapping), cov=2)


@query(f"WITH {_COV}, {_VAL} SELECT v.i, round(sqrt(c.cov) / v.value, 8) AS relative_error FROM v JOIN c ON c.i = v.i AND c.j = v.i")
def relative_errors(spark, sf_dir):
    return rounded(cov.relative_error(*_values_and_cov(spark, sf_dir)), relative_error=8)


@query(f"""
WITH {_COV}, {_VAL}, s AS (SELECT i, value, i // 2 AS b, sum(value) OVER (PARTITION BY i // 2) AS f FROM v),
jac AS (SELECT x.i AS a, y.i AS i, (CASE WHEN x.i = y.i THEN 1.0 ELSE 0.0 END - x.value / x.f) / x.f AS d FROM s x JOIN s y ON x.b = y.b)
SELECT p.a AS i, q.a AS j, round(sum(p.d * c.cov * q.d) * 1e6, 6) AS cov FROM jac p JOIN c ON c.i = p.i JOIN jac q ON q.i = c.j GROUP BY 1, 2""")
def shape_covariance(spark, sf_dir):
    v, c = _values_and_cov(spark, sf_dir)
    jac = algebra.shape_jacobian(v.withColumn("block", F.floor(F.col("i") / 2)), "i", "block")
    return rounded(cov.sandwich(jac, c).withColumn("cov", F.col("cov") * 1e6), cov=6)


@query(f"""
WITH {_COV}, {_VAL}, k AS (SELECT i, cov AS ck FROM c WHERE j = 4), p AS (SELECT cov AS p FROM c WHERE i = 4 AND j = 4), x AS (SELECT value AS x FROM v WHERE i = 4)
SELECT c.i, c.j, round(c.cov - a.ck * b.ck / p.p, 2) AS cov, round(v.value + a.ck / p.p * (100 - x.x), 3) AS value
FROM c JOIN k a ON a.i = c.i JOIN k b ON b.i = c.j JOIN v ON v.i = c.i, p, x WHERE c.i <> 4 AND c.j <> 4""")
def marginalise_condition(spark, sf_dir):
    v, c = algebra.condition(*_values_and_cov(spark, sf_dir), 4, 100.0)
    return rounded(c.join(v, "i"), cov=2, value=3)


@query(f"""
WITH {_COV}, {_VAL} SELECT v.i, round(v.value, 3) AS value, round(sqrt(c.cov), 4) AS error, 1.0::double AS prior FROM v JOIN c ON c.i = v.i AND c.j = v.i WHERE v.i IN (1, 3)""")
def nuisance_pulls(spark, sf_dir):
    return rounded(cov.pulls(*_values_and_cov(spark, sf_dir), [1, 3]), value=3, error=4)


@query(f"""
WITH {_COV}, k AS (SELECT i, cov AS ck FROM c WHERE j = 4), p AS (SELECT cov AS p FROM c WHERE i = 4 AND j = 4)
SELECT k.i, round(k.ck * k.ck / p.p, 2) AS contribution FROM k, p WHERE k.i <> 4""")
def nuisance_contribution(spark, sf_dir):
    return rounded(algebra.nuisance_contribution(*_values_and_cov(spark, sf_dir), [4], 4), contribution=2)


@query(f"""
WITH {_COV}, {_VAL} SELECT c.i, c.j, round(c.cov * (c.i + 1) * (c.j + 1), 2) AS cov, round(v.value * (v.i + 1), 3) AS value FROM c JOIN v ON v.i = c.i""")
def apply_baseline(spark, sf_dir):
    base = lookup.local(spark, [(k, float(k + 1)) for k in CELLS.slots()], "i int, b double")
    v, c = algebra.baseline(*_values_and_cov(spark, sf_dir), base)
    return rounded(c.join(v, "i"), cov=2, value=3)


_REPLICAS = 8


@query(f"""
WITH {_PER}, d AS (SELECT cell, r, w * ((e * (2 * r + 3)) % 7) AS x FROM per, range({_REPLICAS}) t(r)),
s AS (SELECT cell, r, sum(x) AS s FROM d GROUP BY 1, 2), m AS (SELECT cell, sum(s) / {_REPLICAS} AS m FROM s GROUP BY 1),
z AS (SELECT s.cell, s.r, s.s - m.m AS z FROM s JOIN m USING (cell))
SELECT a.cell AS i, b.cell AS j, round(sum(a.z * b.z) / {_REPLICAS - 1} / 1e4, 2) AS cov FROM z a JOIN z b ON a.r = b.r GROUP BY 1, 2""")
def bootstrap_cov(spark, sf_dir):
    draw = (F.col("l_orderkey") * (2 * F.col("r") + 3)) % 7
    c = cov.bootstrap(_cells(spark, sf_dir), "l_orderkey", "cell", _k(KPRICE), _REPLICAS, draw)
    return rounded(c.withColumn("cov", F.col("cov") / 1e4), cov=2)


_POISSON = "CASE " + " ".join(f"WHEN u < {b!r} THEN {k}" for k, b in enumerate([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712])) + " ELSE 7 END"


@query(f"""
WITH {_PER}, x AS (SELECT cell, r, w, ('0x' || md5(e::varchar || ':' || r::varchar)[1:8])::bigint / 4294967296.0::double AS u FROM per, range(20) t(r)),
s AS (SELECT cell, r, sum(w * {_POISSON}) AS s FROM x GROUP BY 1, 2), m AS (SELECT cell, sum(s) / 20 AS m FROM s GROUP BY 1),
z AS (SELECT s.cell, s.r, s.s - m.m AS z FROM s JOIN m USING (cell))
SELECT a.cell AS i, b.cell AS j, round(sum(a.z * b.z) / 19 / 1e4, 3) AS cov FROM z a JOIN z b ON a.r = b.r GROUP BY 1, 2""")
def bootstrap_poisson(spark, sf_dir):
    c = cov.bootstrap(_cells(spark, sf_dir), "l_orderkey", "cell", _k(KPRICE), 20)
    return rounded(c.withColumn("cov", F.col("cov") / 1e4), cov=3)


# ---- response and folding


_GEN, _RECO = case(PRICE, KPRICE), case(PRICE, KRECO)
_FOLD = f"""it AS (SELECT {_GEN} AS gen, {_RECO} AS reco, l_quantity AS w, l_returnflag = 'N' AS un, l_linestatus = 'O' AS outside FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_discount IS NOT NULL),
gt AS (SELECT gen, sum(w) AS t, sum(CASE WHEN un OR outside THEN w ELSE 0 END) AS b FROM it GROUP BY 1),
gamma AS (SELECT gen, CASE WHEN b / CASE WHEN t = 0 THEN 1 ELSE t END = 1 THEN 0 ELSE b / CASE WHEN t = 0 THEN 1 ELSE t END END AS gamma FROM gt),
rt AS (SELECT reco, sum(w) AS t, sum(CASE WHEN un OR outside THEN w ELSE 0 END) AS b FROM it GROUP BY 1),
rho AS (SELECT reco, b / CASE WHEN t - b <= 0 THEN 1 ELSE t - b END AS rho FROM rt),
tr AS (SELECT reco, gen, sum(w) AS s FROM it WHERE NOT un AND NOT outside GROUP BY 1, 2),
rs AS (SELECT tr.reco, tr.gen, tr.s / CASE WHEN gt.t - gt.b = 0 THEN 1 ELSE gt.t - gt.b END AS t FROM tr JOIN gt USING (gen)),
fo AS (SELECT rs.reco, sum(rs.t * gt.t * (1 - gamma)) * (1 + any_value(rho)) AS value FROM rs JOIN gt USING (gen) JOIN gamma USING (gen) JOIN rho USING (reco) GROUP BY rs.reco)"""


class _Model:
    """Histograms of the fold's roles from one table: unmatched = returnflag N, outside = else linestatus O."""

    def __init__(self, spark, sf_dir):
        rows = hist.with_bins(_items(spark, sf_dir), [PRICE], [_k(KPRICE)]).withColumnRenamed("_bin_price", "gen")
        rows = hist.with_bins(rows, [PRICE], [_k(KRECO)]).withColumnRenamed("_bin_price", "reco")
        un, out = F.col("l_returnflag") == "N", F.col("l_linestatus") == "O"
        # one aggregation of the table has all roles; no filter or dropped column makes it another one for some of them
        role = F.when(un & out, "both").when(un, "un").when(out, "out").otherwise("in").alias("role")
        cells = hist.gathered(rows.groupBy("gen", "reco", role).agg(F.sum("l_quantity").alias("w")), 4 * PRICE.extent**2)
        total = lambda key, *roles: cells.groupBy(key).agg(F.sum(F.when(F.col("role").isin(*roles) if roles else F.lit(True), F.col("w"))).alias("sumw")).where("sumw is not null")
        self.gen, self.reco = total("gen"), total("reco")
        self.gamma = algebra.background_fractions(self.gen, total("gen", "un", "both"), total("gen", "out"), "gen")
        self.rho = algebra.reco_backgrounds(self.reco, total("reco", "un", "out", "both"), "reco")
        self.transfer = cells.groupBy("reco", "gen").agg(F.sum(F.when(F.col("role") == "in", F.col("w"))).alias("sumw")).where("sumw is not null")
        self.response = algebra.response(self.transfer, self.gen, total("gen", "un", "out", "both"))
        self.truth = self.gen.select("gen", F.col("sumw").alias("value"))

    def fold(self) -> DataFrame:
        return algebra.fold(self.truth, self.response, self.gamma, self.rho)


@query(f"WITH {_FOLD} SELECT gen AS bin, round(gamma, 8) AS gamma, round(rho, 8) AS rho FROM gamma FULL JOIN rho ON gamma.gen = rho.reco")
def backgrounds_gamma_rho(spark, sf_dir):
    m = _Model(spark, sf_dir)
    j = m.gamma.withColumnRenamed("gen", "bin").join(m.rho.withColumnRenamed("reco", "bin"), "bin", "full")
    return rounded(j.select("bin", "gamma", "rho"), gamma=8, rho=8)


@query(f"WITH {_FOLD} SELECT reco, gen, round(t, 8) AS t FROM rs")
def response_matrix(spark, sf_dir):
    return rounded(_Model(spark, sf_dir).response, t=8)


@query(f"WITH {_FOLD} SELECT fo.reco, round(value, 2) AS folded, round(rt.t, 2) AS observed, abs(value - rt.t) < 1e-6 * rt.t AS closes FROM fo JOIN rt USING (reco)")
def fold_closure(spark, sf_dir):
    m = _Model(spark, sf_dir)
    j = m.fold().join(m.reco, "reco")
    return rounded(j.select("reco", F.col("value").alias("folded"), F.col("sumw").alias("observed"), (F.abs(F.col("value") - F.col("sumw")) < 1e-6 * F.col("sumw")).alias("closes")), folded=2, observed=2)


@query(f"WITH {_FOLD} SELECT reco, round(rho * rt.t / (1 + rho), 2) AS background, round(rt.t - rho * rt.t / (1 + rho), 2) AS pure FROM rt JOIN rho USING (reco)")
def background_removal(spark, sf_dir):
    m = _Model(spark, sf_dir)
    return rounded(algebra.remove_background(m.reco.select("reco", F.col("sumw").alias("value")), m.rho), background=2, pure=2)


@query(f"""WITH {_FOLD} SELECT d.reco AS bin, round(d.s / r.s, 8) AS purity, round(d.s / g.s, 8) AS stability FROM tr d
JOIN (SELECT reco, sum(s) AS s FROM tr GROUP BY 1) r ON r.reco = d.reco JOIN (SELECT gen, sum(s) AS s FROM tr GROUP BY 1) g ON g.gen = d.gen WHERE d.reco = d.gen""")
def purity_stability(spark, sf_dir):
    return rounded(algebra.purity_stability(_Model(spark, sf_dir).transfer), purity=8, stability=8)


@query(f"""WITH {_FOLD}, j AS (SELECT rs.reco AS a, rs.gen AS i, t * (1 - gamma) * (1 + rho) AS d FROM rs JOIN gamma USING (gen) JOIN rho USING (reco)),
c AS (SELECT gen AS i, sum(w * w) AS v FROM it GROUP BY 1)
SELECT x.a AS i, y.a AS j, round(sum(x.d * c.v * y.d), 2) AS cov FROM j x JOIN c USING (i) JOIN j y USING (i) GROUP BY 1, 2""")
def fold_error_propagation(spark, sf_dir):
    m = _Model(spark, sf_dir)
    diagonal = hist.histogram(_items(spark, sf_dir), [PRICE], [_k(KPRICE)], "l_quantity").where("price is not null")
    c = diagonal.select(F.col("price").alias("i"), F.col("price").alias("j"), F.col("sumw2").alias("cov"))
    return rounded(cov.sandwich(algebra.fold_jacobian(m.response, m.gamma, m.rho), c), cov=2)


@query(f"""WITH {_FOLD}, g AS (SELECT gen, t + 0.5 * 0.01 * t * gen AS v FROM gt)
SELECT rs.reco, round(sum(rs.t * g.v * (1 - gamma)) * (1 + any_value(rho)), 2) AS value FROM rs JOIN g USING (gen) JOIN gamma USING (gen) JOIN rho USING (reco) GROUP BY rs.reco""")
def fold_shifted_truth(spark, sf_dir):
    m = _Model(spark, sf_dir)
    deltas = m.truth.select(F.lit("slope").alias("nuisance"), "gen", (F.col("value") * 0.01 * F.col("gen")).alias("delta"))
    truth = algebra.shifted(m.truth, deltas, {"slope": 0.5}, ["gen"], "value")
    return rounded(algebra.fold(truth, m.response, m.gamma, m.rho), value=2)


_CHI = f"""a AS (SELECT {case(QTY, 'l_quantity')} AS i, sum(l_quantity) AS x, sum(l_quantity * l_quantity) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1),
b AS (SELECT {case(QTY, 'l_quantity')} AS i, sum(l_quantity) AS y FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
x2 AS (SELECT sum((x - coalesce(y, 0)) ** 2 / v) AS chi2, count(*) AS ndf FROM a LEFT JOIN b USING (i))"""


def _chi(spark, sf_dir) -> DataFrame:
    """Differences of two histograms and the inverse of the first's variances, from one aggregation of the items."""
    rows = hist.with_bins(_items(spark, sf_dir), [QTY], ["l_quantity"])
    of = lambda s, w: F.sum(F.when(F.col("l_linestatus") == s, w))
    q = F.col("l_quantity")
    h = rows.groupBy(F.col("_bin_qty").alias("i")).agg(of("O", q).alias("x"), of("F", q).alias("y"), of("O", q * q).alias("v"))
    d = F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    inverse = F.collect_list(F.when(F.col("v").isNotNull(), F.struct("i", F.col("i").alias("j"), (1 / F.col("v")).alias("cov"))))
    return algebra.quadratic_form(h.agg(algebra.vector("i", d).alias("d"), inverse.alias("inverse")), "d", "inverse")


@query(f"WITH {_CHI} SELECT round(chi2, 5) AS chi2, ndf FROM x2")
def chi2_given_invcov(spark, sf_dir):
    return rounded(_chi(spark, sf_dir), chi2=5)


@query(f"WITH {_CHI}, t AS (SELECT sum((l_discount - 0.05) ** 2) AS t, sum(greatest(0.05 - l_discount, 0)) AS n FROM lineitem) SELECT round(chi2 / 2 + t / 2 + 3 * n, 4) AS loss FROM x2, t")
def penalised_objective(spark, sf_dir):
    shift = _items(spark, sf_dir).select((F.col("l_discount") - 0.05).alias("value"))
    return rounded(algebra.objective(_chi(spark, sf_dir), shift, shift, 3.0), loss=4)


# ---- binned-table algebra


_H3 = f"h AS (SELECT {case(QTY, 'l_quantity')} AS qty, {case(DISC, 'l_discount')} AS disc, {case(TAX, 'l_tax')} AS tax, sum({KPRICE}) AS sumw FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND {case(TAX, 'l_tax')} IS NOT NULL GROUP BY 1, 2, 3)"


def _h3(spark, sf_dir) -> DataFrame:
    return hist.histogram(_items(spark, sf_dir), [QTY, DISC, TAX], ["l_quantity", "l_discount", "l_tax"], _k(KPRICE))


@query(f"WITH {_H3} SELECT CASE WHEN qty < 0 THEN -1 WHEN qty >= 10 THEN 5 ELSE qty // 2 END AS qty, disc, round(sum(sumw), 3) AS sumw FROM h WHERE tax IN (1, 2) GROUP BY 1, 2")
def rebin_project_slice(spark, sf_dir):
    h = algebra.slice_range(_h3(spark, sf_dir), TAX, 0.02, 0.06)
    h = algebra.project(h, ["qty", "disc"])
    return rounded(algebra.rebin(h, QTY, QTY.rebinned(2), ["disc"]).select("qty", "disc", "sumw"), sumw=3)


@query(f"""WITH {_H3}, p AS (SELECT qty, disc, sum(sumw) AS s FROM h WHERE qty BETWEEN 0 AND 9 GROUP BY 1, 2)
SELECT qty, disc, round(sum(s) OVER (PARTITION BY disc), 3) AS flux, round(s / sum(s) OVER (PARTITION BY disc), 8) AS shape, round(s / (((qty + 1) * 5.0) ** 2 - (qty * 5.0) ** 2) * 2, 5) AS per_area FROM p""")
def shapes_per_block(spark, sf_dir):
    p = algebra.project(_h3(spark, sf_dir).where(F.col("qty").between(0, 9)), ["qty", "disc"])
    s = hist.with_widths(algebra.shapes(p, ["disc"]), [QTY], radial=["qty"])
    return rounded(s.select("qty", "disc", "flux", "shape", (F.col("sumw") / F.col("width")).alias("per_area")), flux=3, shape=8, per_area=5)


@query(f"WITH {_H3} SELECT qty, disc, tax, round(sumw / avg(sumw) OVER (PARTITION BY qty, disc), 8) AS modulation FROM h")
def angular_profile(spark, sf_dir):
    return rounded(algebra.over_profile(_h3(spark, sf_dir), ["qty", "disc"]).select("qty", "disc", "tax", "modulation"), modulation=8)


_TWO = f"""a AS (SELECT {case(QTY, 'l_quantity')} AS qty, sum({KPRICE}) AS x, sum({KPRICE} * {KPRICE}) AS vx FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
b AS (SELECT {case(QTY, 'l_quantity')} AS qty, sum({KPRICE}) AS y, sum({KPRICE} * {KPRICE}) AS vy FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
j AS (SELECT coalesce(a.qty, b.qty) AS qty, coalesce(x, 0) AS x, coalesce(vx, 0) AS vx, coalesce(y, 0) AS y, coalesce(vy, 0) AS vy FROM a FULL JOIN b ON a.qty = b.qty)"""


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    h = hist.histogram(_items(spark, sf_dir), [QTY], ["l_quantity"], _k(KPRICE), by=["l_returnflag"])
    return tuple(h.where(F.col("l_returnflag") == f).select("qty", "sumw", "sumw2") for f in ("A", "R"))


@query(f"WITH {_TWO} SELECT qty, round(x / y, 8) AS ratio, round(sqrt(vx / (y * y) + x * x * vy / (y * y * y * y)), 8) AS error FROM j WHERE x <> 0 AND y <> 0")
def binned_comparison_ratio(spark, sf_dir):
    return rounded(yields.ratio_with_errors(*_two(spark, sf_dir), ["qty"]), ratio=8, error=8)


@query(f"""WITH {_TWO} SELECT 'sum' AS how, qty, round(x + y, 3) AS value, round(vx + vy, 2) AS variance FROM j UNION ALL SELECT 'difference', qty, round(x - y, 3), round(vx + vy, 2) FROM j
UNION ALL SELECT 'product', qty, round(x * y / 1e6, 4), round((vx * y * y + vy * x * x) / 1e12, 6) FROM j""")
def comparison_arithmetic(spark, sf_dir):
    a, b = (h.select("qty", F.col("sumw").alias("value"), F.col("sumw2").alias("variance")) for h in _two(spark, sf_dir))
    out = None
    for how, (kv, kw, dv, dw) in {"sum": (1, 1, 3, 2), "difference": (1, 1, 3, 2), "product": (1e6, 1e12, 4, 6)}.items():
        c = algebra.compare(a, b, ["qty"], how)
        c = c.select(F.lit(how).alias("how"), "qty", (F.col("value") / kv).alias("value"), (F.col("variance") / kw).alias("variance"))
        c = rounded(c, value=dv, variance=dw)
        out = c if out is None else out.unionByName(c)
    return out


@query(f"WITH {_TWO} SELECT qty, round(sum(z), 3) AS sumw FROM (SELECT qty, x AS z FROM a UNION ALL SELECT qty, -0.5 * y FROM b) GROUP BY qty")
def weighted_add(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return rounded(algebra.add(a, b, ["qty"], -0.5).select("qty", "sumw"), sumw=3)


@query(f"WITH {_TWO}, f AS (SELECT sum(y) FILTER (qty >= 5) / sum(x) FILTER (qty >= 5) AS f FROM j) SELECT a.qty, round(x * f, 3) AS sumw FROM a, f")
def partial_range_scaling(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return rounded(hist.scaled_to(a, b, "qty", 5).select("qty", "sumw"), sumw=3)


# ---- catalog, stacks, yields


_LUMI = 59.5
#: Cross sections of the datasets; event counts come from the data.
_XSEC = {"1-URGENT": 6.4, "2-HIGH": 2.1, "3-MEDIUM": 0.7, "4-NOT SPECIFIED": 0.05}
_DATA = "5-LOW"
_STACKS = [("all", "fast", "stack"), ("all", "slow", "stack"), ("fast", "1-URGENT", "dset"), ("fast", "2-HIGH", "dset"), ("slow", "3-MEDIUM", "dset"), ("slow", "4-NOT SPECIFIED", "dset"), ("data", _DATA, "dset")]
_TOTALS = {"simulation": list(_XSEC), "everything": [*_XSEC, _DATA]}


def _catalog(spark, sf_dir) -> DataFrame:
    n = layout.counts(read(spark, sf_dir, "orders"), by=[F.col("o_orderpriority").alias("dataset")])
    rows = [("r1", d, True, x, None, None, None) for d, x in _XSEC.items()] + [("r1", _DATA, False, None, _LUMI, None, None)]
    return catalog.checked(catalog.catalog(spark, rows)).drop("eventcount").join(n.withColumnRenamed("count", "eventcount"), "dataset")


_TOTAL = Axis.regular("total", 6, 0, 300, underflow=False)
_FACTOR = "(CASE o_orderpriority " + " ".join(f"WHEN '{d}' THEN {1000 * x!r} * {_LUMI} / n" for d, x in _XSEC.items()) + " ELSE 1.0 END)"
_SCALED = f"n AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), o AS (SELECT *, {case(_TOTAL, '(o_totalprice / 1000)')} AS total, {_FACTOR}::double AS w FROM orders JOIN n USING (o_orderpriority) WHERE o_totalprice IS NOT NULL AND o_totalprice >= 0)"


@query(f"""WITH {_SCALED}, m(stack, d) AS (VALUES {', '.join(f"('{s}', '{c}')" for s, c, k in _STACKS if k == 'dset')}, ('all', '1-URGENT'), ('all', '2-HIGH'), ('all', '3-MEDIUM'), ('all', '4-NOT SPECIFIED'))
SELECT stack, total, round(sum(w), 4) AS sumw FROM o JOIN m ON d = o_orderpriority GROUP BY 1, 2""")
def stack_normalised(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "dataset")
    h = catalog.normalised(hist.histogram(o, [_TOTAL], [F.col("o_totalprice") / 1000], by=["dataset"]), _catalog(spark, sf_dir), _LUMI)
    links = catalog.stack_links(spark, _STACKS)
    return rounded(catalog.stacked(h, catalog.stack_members(spark, links), ["total"]).select("stack", "total", "sumw"), sumw=4)


_BINS = {"low": "o_totalprice < 50000", "mid": "o_totalprice >= 50000 AND o_totalprice < 150000", "high": "o_totalprice >= 150000"}


def _yield_table(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "dataset")
    # no more rows than the driver's catalog has
    c = F.broadcast(_catalog(spark, sf_dir).select("dataset", weights.normalisation("is_mc", "xsec", F.lit(_LUMI), "eventcount").alias("w")))
    return yields.yields(o.join(c, "dataset"), "dataset", {n: F.expr(b) for n, b in _BINS.items()}, "w", F.col("o_orderstatus") != "P")


_YIELD = f"{_SCALED}, y AS (SELECT o_orderpriority AS dataset, {', '.join(f'coalesce(sum(w) FILTER ({b}), 0) AS {n}' for n, b in _BINS.items())} FROM o WHERE o_orderstatus <> 'P' GROUP BY 1)"
_MEMBERS = "tm(t, d) AS (VALUES " + ", ".join(f"('{t}', '{d}')" for t, ds in _TOTALS.items() for d in ds) + ")"


@query(f"WITH {_YIELD}, {_MEMBERS}, a AS (SELECT * FROM y UNION ALL SELECT t, sum(low), sum(mid), sum(high) FROM y JOIN tm ON d = dataset GROUP BY t) SELECT dataset, round(low, 3) AS low, round(mid, 3) AS mid, round(high, 3) AS high FROM a")
def yield_pivot(spark, sf_dir):
    t = yields.with_totals(_yield_table(spark, sf_dir), "dataset", _TOTALS)
    return rounded(yields.pivoted(t, "dataset", list(_BINS)), low=3, mid=3, high=3)


@query(f"""WITH {_YIELD}, u AS (SELECT dataset, 'low' AS bin, low AS n FROM y UNION ALL SELECT dataset, 'high', high FROM y)
SELECT u.dataset, u.bin, round(u.n, 3) AS n, round(CASE WHEN r.n = 0 THEN 0 ELSE 100 * u.n / r.n END, 6) AS percent FROM u JOIN u r ON r.bin = u.bin AND r.dataset = '{_DATA}'""")
def yield_percentages(spark, sf_dir):
    t = yields.percentages(yields.chosen_bins(_yield_table(spark, sf_dir), ["low", "high"]), "dataset", _DATA)
    return rounded(t, n=3, percent=6)


@query(f"""WITH {_MEMBERS}, e AS (SELECT o_orderpriority AS dataset, b.bin, sum(CASE WHEN o_orderstatus = 'F' AND b.ok AND o_orderdate >= DATE '1995-01-01' THEN 1.0 ELSE 0 END) AS num, sum(CASE WHEN o_orderstatus <> 'P' AND b.ok AND o_orderdate >= DATE '1995-01-01' THEN 1.0 ELSE 0 END) AS den
FROM orders, LATERAL (VALUES {', '.join(f"('{n}', {b})" for n, b in _BINS.items())}) b(bin, ok) GROUP BY 1, 2),
a AS (SELECT * FROM e UNION ALL SELECT t, bin, sum(num), sum(den) FROM e JOIN tm ON d = dataset GROUP BY t, bin)
SELECT dataset, bin, num::double AS num, den::double AS den, round(CASE WHEN den = 0 THEN 0 ELSE num / den END, 8)::double AS efficiency FROM a""")
def efficiency_totals(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "dataset")
    e = yields.efficiencies(o, "dataset", {n: F.expr(b) for n, b in _BINS.items()}, F.lit(1.0), F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F", F.col("o_orderdate") >= F.lit("1995-01-01").cast("date"))
    return rounded(yields.with_totals(e, "dataset", _TOTALS), efficiency=8)


@query(f"SELECT {case(QTY, 'l_quantity')} AS bin, round(sum({KPRICE} * CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / sum({KPRICE}), 8) AS rate FROM lineitem GROUP BY 1")
def rate_per_bin(spark, sf_dir):
    return rounded(yields.rates(_items(spark, sf_dir), QTY.index("l_quantity"), expr.from_cut(F.col("l_returnflag") == "R"), _k(KPRICE)), rate=8)


@query("SELECT o_orderpriority AS dataset, count(*)::double AS count FROM orders GROUP BY 1")
def count_table(spark, sf_dir):
    return layout.counts(read(spark, sf_dir, "orders"), by=[F.col("o_orderpriority").alias("dataset")])


@query(f"""WITH d AS (SELECT DISTINCT o_orderpriority AS dataset FROM orders)
SELECT dataset, o AS objsyst, w AS wtsyst FROM d, (VALUES ('nominal'), ('JES_UP'), ('JES_DN')) a(o), (VALUES ('nominal'), ('puUp')) b(w) WHERE dataset <> '{_DATA}' UNION ALL SELECT dataset, 'DATA', 'nominal' FROM d WHERE dataset = '{_DATA}'""")
def systematic_jobs(spark, sf_dir):
    return catalog.systematic_jobs(_catalog(spark, sf_dir), ["nominal", "JES_UP", "JES_DN"], ["nominal", "puUp"])


@query("SELECT r_name AS name, n_name AS dataset FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT n_name, n_name FROM nation")
def dataset_groups(spark, sf_dir):
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    g = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_name").alias("name"), F.col("n_name").alias("member"))
    names = r.select(F.col("r_name").alias("name")).unionByName(n.select(F.col("n_name").alias("name")))
    return catalog.expand(names, g)


@query(f"""SELECT o_orderkey, round(CASE WHEN o_orderpriority IN ('1-URGENT') THEN o_totalprice / 2000 ELSE o_totalprice / 1000 END, 6) AS w FROM orders
WHERE o_orderstatus <> 'P' AND (o_orderpriority <> '{_DATA}' OR o_totalprice < 100000)""")
def dataset_cuts_and_weights(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    o = o.where(expr.per_dataset("o_orderpriority", F.col("o_orderstatus") != "P", {_DATA: expr.less("o_totalprice", 100000)}))
    w = weights.chosen_weight("o_orderpriority", ["1-URGENT"], F.col("o_totalprice") / 1000, F.col("o_totalprice") / 2000)
    return rounded(o.select("o_orderkey", w.alias("w")), w=6)


# ---- nested events


def _item_fields() -> list[Column]:
    """Fields of an item, those that order it first."""
    return [
        F.negative("l_extendedprice").alias("order"),
        "l_linenumber",
        F.col("l_extendedprice").alias("pt"),
        ((F.col("l_quantity") - 25) / 10).alias("eta"),
        ((F.col("l_discount") - 0.05) * 60).alias("phi"),
        (F.col("l_tax") * 100).alias("mass"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("charge"),
        F.col("l_quantity").alias("quantity"),
    ]


def _item_rows(spark, sf_dir) -> DataFrame:
    return _items(spark, sf_dir).select("l_orderkey", *_item_fields())


def _events(spark, sf_dir) -> DataFrame:
    """One row per order with its line items as an array, dearest first."""
    items = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*_item_fields()))).alias("items"))
    return read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))


_RANKED = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY -l_extendedprice, l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n,
  (l_quantity - 25) / 10 AS eta, (l_discount - 0.05) * 60 AS phi, l_tax * 100 AS mass, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS charge FROM lineitem)"""


@query("""
WITH l AS (SELECT l_orderkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, n::int AS n, count(*) FILTER (k < n // 2)::int AS n_first, round(sum(p) FILTER (k < n // 2), 2) AS first_sum, round(sum(p) FILTER (k >= n // 2), 2) AS second_sum, round(max(p) FILTER (k = n - 1), 2) AS gathered, (count(*) FILTER (p > 20000))::int AS kept
FROM l GROUP BY 1, 2""")
def nested_gather_unflatten(spark, sf_dir):
    flat = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_extendedprice").alias("p")))).alias("f"))
    flat = flat.select("l_orderkey", F.col("f.p").alias("flat"), F.size("f").alias("n"))
    counts = F.array(F.floor(F.col("n") / 2).cast("int"), (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    parts = flat.withColumn("parts", nested.unflatten("flat", counts)).withColumn("entries", F.transform("flat", lambda p: F.struct((p - 20000).alias("pt"))))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    index = F.array(F.col("n") - 1, F.lit(nested.SENTINEL))
    two = nested.gather_matched("flat", index)
    null_if_none = lambda a: F.when(F.size(a) > 0, total(a))
    out = parts.select(
        "l_orderkey",
        "n",
        F.size(F.get("parts", F.lit(0))).alias("n_first"),
        null_if_none(F.get("parts", F.lit(0))).alias("first_sum"),
        null_if_none(F.get("parts", F.lit(1))).alias("second_sum"),
        nested.nth(two, 0).alias("gathered"),
        F.size(nested.without_padding("entries")).alias("kept"),
    )
    return rounded(out, first_sum=2, second_sum=2, gathered=2)


_DPHI = "((phi1 - phi2 + pi()) / (2 * pi()) - floor((phi1 - phi2 + pi()) / (2 * pi()))) * (2 * pi()) - pi()"


@query(f"""
WITH {_RANKED}, p AS (SELECT a.l_orderkey, a.l_extendedprice AS pt1, b.l_extendedprice AS pt2, a.eta AS eta1, b.eta AS eta2, a.phi AS phi1, b.phi AS phi2, a.mass AS m1, b.mass AS m2, c.l_extendedprice AS pt3
  FROM l a JOIN l b ON b.l_orderkey = a.l_orderkey AND b.k = 2 LEFT JOIN l c ON c.l_orderkey = a.l_orderkey AND c.k = 3 WHERE a.k = 1),
v AS (SELECT *, pt1 * cos(phi1) + pt2 * cos(phi2) AS px, pt1 * sin(phi1) + pt2 * sin(phi2) AS py, pt1 * sinh(eta1) + pt2 * sinh(eta2) AS pz,
  sqrt((pt1 * cosh(eta1)) ** 2 + m1 ** 2) + sqrt((pt2 * cosh(eta2)) ** 2 + m2 ** 2) AS e FROM p)
SELECT l_orderkey, round(CASE WHEN pt1 > pt2 THEN pt1 ELSE pt2 END, 2) AS lead_pt, round(coalesce(pt3, 0), 2) AS third_pt, round(sqrt(px * px + py * py) / 1000, 5) AS pair_pt,
  round(sqrt(greatest(e * e - px * px - py * py - pz * pz, 0)) / 1000, 4) AS pair_mass FROM v""")
def lead_sublead_pairs(spark, sf_dir):
    top = tables.leading(_item_rows(spark, sf_dir), "l_orderkey", ["order", "l_linenumber"], 3)
    e = top.where("n_leading >= 2")
    pair = nested.leading_pair(F.col("leading1"), F.col("leading2"))
    e = e.select("l_orderkey", pair.alias("p"), F.coalesce(F.col("leading3.pt"), F.lit(0.0)).alias("third_pt"))
    z = e.withColumn("z", expr.four_sum(F.col("p.lead"), F.col("p.sub")))
    out = z.select("l_orderkey", F.col("p.lead.pt").alias("lead_pt"), "third_pt", (F.col("z.pt") / 1000).alias("pair_pt"), (F.col("z.mass") / 1000).alias("pair_mass"))
    return rounded(out, lead_pt=2, third_pt=2, pair_pt=5, pair_mass=4)


@query(f"""
WITH {_RANKED}, p AS (SELECT a.l_orderkey, b.eta AS eta1, a.eta AS eta2, b.phi AS phi1, a.phi AS phi2, b.k FROM l a JOIN l b ON b.l_orderkey = a.l_orderkey AND b.k > 1 WHERE a.k = 1)
SELECT l_orderkey, count(*) FILTER (sqrt((eta1 - eta2) ** 2 + ({_DPHI}) ** 2) > 1.0)::int AS n_far, round(min(sqrt((eta1 - eta2) ** 2 + ({_DPHI}) ** 2)), 6) AS nearest FROM p GROUP BY 1""")
def delta_r_overlap(spark, sf_dir):
    e = _events(spark, sf_dir).where(F.size("items") >= 2)
    lead, rest = F.get("items", F.lit(0)), F.slice("items", F.lit(2), F.size("items"))
    far = F.filter(rest, lambda x: select.clear_of(x, [(lead["eta"], lead["phi"])], 1.0))
    near = F.array_min(F.transform(rest, lambda x: expr.delta_r(x["eta"], x["phi"], lead["eta"], lead["phi"])))
    return rounded(e.select("l_orderkey", F.size(far).alias("n_far"), near.alias("nearest")), nearest=6)


_FLOW = ["two", "lead_pt", "sub_pt", "eta", "charge", "status"]


@query(f"""
WITH {_RANKED}, e AS (SELECT o_orderkey, o_totalprice / 1000 AS w, n >= 2 AS two, p1, p2, abs(e1) < 2 AND abs(e2) < 2 AS eta, c1 * c2 < 0 AS charge, o_orderstatus <> 'P' AS status
  FROM (SELECT l_orderkey, any_value(n) AS n, max(l_extendedprice) FILTER (k = 1) AS p1, max(l_extendedprice) FILTER (k = 2) AS p2, max(eta) FILTER (k = 1) AS e1, max(eta) FILTER (k = 2) AS e2, max(charge) FILTER (k = 1) AS c1, max(charge) FILTER (k = 2) AS c2 FROM l GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT count(*)::double AS s0, sum(w) AS s1, sum(w) FILTER (two) AS s2, sum(w) FILTER (two AND p1 >= 30000) AS s3, sum(w) FILTER (two AND p1 >= 30000 AND p2 >= 20000) AS s4,
  sum(w) FILTER (two AND p1 >= 30000 AND p2 >= 20000 AND eta) AS s5, sum(w) FILTER (two AND p1 >= 30000 AND p2 >= 20000 AND eta AND charge) AS s6, sum(w) FILTER (two AND p1 >= 30000 AND p2 >= 20000 AND eta AND charge AND status) AS s7 FROM e)
SELECT 'event' AS level, k::int AS step_no, step, round(coalesce(v, 0), 3) AS n FROM s, LATERAL (VALUES (0, 'raw', s0), (1, 'all', s1), (2, 'two', s2), (3, 'lead_pt', s3), (4, 'sub_pt', s4), (5, 'eta', s5), (6, 'charge', s6), (7, 'status', s7)) x(k, step, v)""")
def cutflow_events_items(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("lead", F.get("items", F.lit(0))).withColumn("sub", F.get("items", F.lit(1)))
    s = select.muon_pair((30000, 20000), 2.0).add("status", F.col("o_orderstatus") != "P")
    return rounded(select.cutflow(e, s, F.col("o_totalprice") / 1000), n=3)


@query(f"""
WITH {_RANKED} SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS pt, l_extendedprice > 30000 AS "passTight", CASE WHEN l_extendedprice < 20000 THEN round(l_extendedprice * 1.1, 5) ELSE round(l_extendedprice, 5) END AS calibrated
FROM l WHERE l_extendedprice > 10000 AND abs(eta) < 2 AND l_linenumber IS NOT NULL""")
def item_table_quality(spark, sf_dir):
    e = _events(spark, sf_dir)
    items = select.quality("items", minimum_pt=10000, maximum_eta=2)
    items = nested.with_tags(nested.with_fields(items, factor=lambda x: F.lit(1.1)), "pt", {"Tight": 30000})
    flat = tables.item_table(e.withColumn("items", nested.calibrated(items, 20000, "factor")), "items", ["l_orderkey"])
    return rounded(flat.select("l_orderkey", "l_linenumber", F.col("rawPt").alias("pt"), "passTight", F.col("pt").alias("calibrated")), pt=2, calibrated=5)


@query("""
SELECT l_orderkey, l_linenumber, round(l_tax * (l_extendedprice / l_quantity / 1000) ** 4, 6) AS wt FROM lineitem WHERE l_tax > 0 AND l_quantity > 0""")
def correlator_weights(spark, sf_dir):
    entry = F.struct("l_linenumber", F.col("l_tax").alias("wt"))
    item = F.struct((F.col("l_quantity") * 1000).alias("pt"), F.col("l_extendedprice").alias("pt_denom"), F.array(entry).alias("entries"))
    e = _items(spark, sf_dir).where("l_quantity > 0").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    return rounded(tables.correlator_table(e, "items", "entries", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "wt"), wt=6)


@query("SELECT o_orderkey, ((o_custkey * 256 + o_orderkey % 256) * 4294967296 + o_orderkey)::bigint AS event_id, (o_custkey * 256 + o_orderkey % 256) % 7 AS high_mod FROM (SELECT *, 0 AS z FROM orders)")
def composite_event_id(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    # the run holds the upper bits of a lumi-sized number, so that the sum stays below 2 ** 63 here
    run, lumi = F.shiftright(F.col("o_custkey") * 256, 16), F.pmod(F.col("o_custkey") * 256, F.lit(65536)) + F.col("o_orderkey") % 256
    return o.select("o_orderkey", expr.event_id(run, lumi, "o_orderkey").alias("event_id"), expr.unsigned_mod(F.col("o_custkey") * 256 + F.col("o_orderkey") % 256, 7).alias("high_mod"))


# ---- corrections and weights


_SF = {(q, d): 1.0 + 0.01 * (q + 1) - 0.02 * d for q in range(5) for d in range(3)}
_SFQ, _SFD = Axis.regular("q", 5, 0, 40, underflow=False, overflow=False), Axis.variable("d", [0.0, 0.03, 0.06, 0.09], clamp=True)
_SFV = ", ".join(f"({q}, {d}, {v!r}::double)" for (q, d), v in _SF.items())


@query(f"""
WITH t(q, d, v) AS (VALUES {_SFV}) SELECT l_orderkey, l_linenumber, round(coalesce(v, 1.0), 8) AS sf FROM lineitem LEFT JOIN t ON t.q = {case(_SFQ, 'l_quantity')} AND t.d = {case(_SFD, 'l_discount')}""")
def correction_lookup(spark, sf_dir):
    t = lookup.local(spark, [(q, d, v) for (q, d), v in _SF.items()], "q int, d int, value double")
    out = lookup.binned_lookup(_items(spark, sf_dir), t, [(_SFQ, "l_quantity"), (_SFD, "l_discount")], into="sf")
    return rounded(out.select("l_orderkey", "l_linenumber", "sf"), sf=8)


_SEGMENTS = [(5.0, 15.0, 1.0, 0.01, -0.002, 0.0001), (15.0, 30.0, 1.05, -0.004, 0.0005, 0.0), (30.0, 45.0, 1.1, 0.0, -0.0003, 0.00001)]


def _poly_sql(x: str) -> str:
    c = f"greatest(least({x}, 45.0), 5.0)"
    one = lambda s: f"({s[2]} + ({c} - {s[0]}) * ({s[3]} + ({c} - {s[0]}) * ({s[4]} + ({c} - {s[0]}) * {s[5]})))"
    return f"(CASE WHEN {c} < 15.0 THEN {one(_SEGMENTS[0])} WHEN {c} < 30.0 THEN {one(_SEGMENTS[1])} ELSE {one(_SEGMENTS[2])} END)"


@query(f"SELECT l_orderkey, l_linenumber, round({_poly_sql('l_quantity::double')}::double, 7) AS correction FROM lineitem WHERE l_quantity IS NOT NULL")
def poly_correction(spark, sf_dir):
    return rounded(_items(spark, sf_dir).where("l_quantity is not null").select("l_orderkey", "l_linenumber", lookup.polynomial("l_quantity", _SEGMENTS).alias("correction")), correction=7)


@query("""
WITH l AS (SELECT l_orderkey, 0.3 + 4 * l_discount AS e, 0.9 + l_tax AS f, l_quantity > 25 AS p FROM lineitem),
s AS (SELECT l_orderkey, product(CASE WHEN p THEN e * f ELSE 1 - e * f END) AS a, product(CASE WHEN p THEN e ELSE 1 - e END) AS b FROM l GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN a = 0 THEN 1 ELSE a END / CASE WHEN b = 0 THEN 1 ELSE b END, 9) AS w FROM s""")
def multiplicity_weight(spark, sf_dir):
    item = F.struct("l_linenumber", (F.lit(0.3) + 4 * F.col("l_discount")).alias("eff"), (F.lit(0.9) + F.col("l_tax")).alias("sf"), (F.col("l_quantity") > 25).alias("passes"))
    e = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return rounded(e.select("l_orderkey", weights.multiplicity("items", "passes", "eff", "sf").alias("w")), w=9)


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: 1 + x::double) AS w FROM embeddings)
SELECT vec_id, round(greatest(w[1], w[2], w[4], w[6], w[8], w[9]), 6) AS scale_up, round(least(w[1], w[2], w[4], w[6], w[8], w[9]), 6) AS scale_down, round(greatest(w[1], w[9]), 6) AS corner_up,
round(1 + sqrt(list_sum(list_transform(w[2:101], lambda x: (x - 1) ** 2)) / 99), 6) AS pdf_up, round(w[1], 6) AS "ISRUp", round(w[4], 6) AS "FSRDown" FROM e""")
def envelope_weights(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: 1 + x.cast("double")).alias("w"))
    up, down = weights.scale_envelope("w")
    s = weights.shower("w")
    out = e.select("vec_id", up.alias("scale_up"), down.alias("scale_down"), weights.corner_envelope("w")[0].alias("corner_up"), weights.hessian("w")[0].alias("pdf_up"), s["ISRUp"].alias("ISRUp"), s["FSRDown"].alias("FSRDown"))
    return rounded(out, scale_up=6, scale_down=6, corner_up=6, pdf_up=6, ISRUp=6, FSRDown=6)


@query("""
SELECT l_orderkey, l_linenumber, round(CASE WHEN l_extendedprice > 0 THEN ln(l_extendedprice) / ln(10) END, 7) AS log_price, round(l_extendedprice / nullif(l_quantity, 0), 8) AS unit, round((l_extendedprice * (1 - l_discount) - l_extendedprice) / nullif(l_extendedprice, 0), 7) AS resolution, abs(l_quantity - 25) AS dist, round(l_quantity * l_tax, 6) AS prod FROM lineitem""")
def derived_variables(spark, sf_dir):
    l = _items(spark, sf_dir)  # noqa: E741
    out = l.select(
        "l_orderkey",
        "l_linenumber",
        expr.logarithm("l_extendedprice", 10).alias("log_price"),
        expr.ratio("l_extendedprice", "l_quantity").alias("unit"),
        expr.relative_resolution("l_extendedprice", F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("resolution"),
        expr.absolute(F.col("l_quantity") - 25).alias("dist"),
        expr.product("l_quantity", "l_tax").alias("prod"),
    )
    return rounded(out, log_price=7, unit=8, resolution=7, prod=6)


# ---- smoothing


_DAILY = "d AS (SELECT (year(o_orderdate) * 12 + month(o_orderdate))::int AS m, sum(o_totalprice) / 1e6 AS v, sqrt(count(*)) AS e FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"


def _monthly(spark, sf_dir) -> DataFrame:
    m = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m")
    return read(spark, sf_dir, "orders").where("o_orderdate is not null").groupBy(m).agg((F.sum("o_totalprice") / 1e6).alias("v"), F.sqrt(F.count(F.lit(1))).alias("e"))


@query(f"""WITH {_DAILY} SELECT m, round(v, 4) AS v, round(avg(v) OVER w, 5) AS smooth, round(sum(v / e) OVER w / sum(1 / e) OVER w, 5) AS weighted FROM d WINDOW w AS (ORDER BY m ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def moving_average(spark, sf_dir):
    d = smooth.moving_average(_monthly(spark, sf_dir), "m", "v", 2, into="smooth")
    d = smooth.moving_average(d, "m", "v", 2, error="e", into="weighted")
    return rounded(d.select("m", "v", "smooth", "weighted"), v=4, smooth=5, weighted=5)


@query(f"""WITH {_DAILY} SELECT a.m, round(sum(exp(-0.5 * ((b.m - a.m) / 3.0) ** 2) / b.e * b.v) / sum(exp(-0.5 * ((b.m - a.m) / 3.0) ** 2) / b.e), 5) AS smooth FROM d a, d b GROUP BY a.m""")
def gaussian_kernel(spark, sf_dir):
    return rounded(smooth.gaussian_kernel(_monthly(spark, sf_dir), "m", "v", 3.0, error="e", into="smooth").select("m", "smooth"), smooth=5)


# ---- completeness and streaming


@query("""
WITH x AS (SELECT o_orderkey AS file, 10 * (1 + o_custkey % 3) AS entries FROM orders),
p AS (SELECT l_orderkey AS file, 10 * (l_linenumber - 1) AS start, 10 * l_linenumber AS stop, l_returnflag <> 'A' AS ok FROM lineitem),
g AS (SELECT DISTINCT file, unnest(range(start, stop)) AS i FROM p WHERE ok), c AS (SELECT file, count(*) AS n FROM g GROUP BY 1),
inr AS (SELECT g.file, count(*) AS n FROM g JOIN x USING (file) WHERE i < entries GROUP BY 1), t AS (SELECT file, sum(stop - start) FILTER (ok) AS total, count(*) FILTER (NOT ok) AS bad FROM p GROUP BY 1)
SELECT x.file, CASE WHEN t.total IS NULL AND coalesce(t.bad, 0) = 0 THEN 'missing' WHEN coalesce(t.bad, 0) > 0 THEN 'erroneous' WHEN coalesce(inr.n, 0) < entries OR t.total > coalesce(inr.n, 0) THEN 'incomplete' ELSE 'complete' END AS status
FROM x LEFT JOIN t USING (file) LEFT JOIN inr USING (file) LEFT JOIN c USING (file)""")
def completeness_check(spark, sf_dir):
    expected = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), (10 * (1 + F.col("o_custkey") % 3)).alias("entries"))
    produced = _items(spark, sf_dir).select(F.col("l_orderkey").alias("file"), (10 * (F.col("l_linenumber") - 1)).alias("start"), (10 * F.col("l_linenumber")).alias("stop"), (F.col("l_returnflag") != "A").alias("ok"))
    return layout.completeness(expected, produced).select("file", "status")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def missing_outputs(spark, sf_dir):
    produced = _items(spark, sf_dir).where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return layout.missing(read(spark, sf_dir, "orders"), produced, ["o_orderkey"])


_VALUE = Axis.regular("value", 12, 0, 120)


@query(f"SELECT event_type, {case(_VALUE, 'value')} AS value, count(*) AS n, round(sum(value), 3) AS sumw FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def stream_hist_fill(spark, sf_dir):
    """The running histogram of `events` files through Structured Streaming, after all input has arrived."""
    from ..streaming import fill

    schema = read(spark, sf_dir, "events").schema
    stream = fill.source(spark, sf_dir, schema, glob="events.parquet")
    if not stream.isStreaming:
        raise RuntimeError("not a stream")
    out = _folder(spark, "stream")
    running = fill.running(stream, [_VALUE], ["value"], "value", by=["event_type"])
    fill.start_table(running, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return rounded(fill.latest(spark, f"{out}/table").select("event_type", "value", "n", "sumw"), sumw=3)


# ---- more of the nested event chain


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS pt, round(l_quantity, 2) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def generic_object_table(spark, sf_dir):
    flat = tables.generic_table(_events(spark, sf_dir), "items", ["l_orderkey"])
    return rounded(flat.select("l_orderkey", "l_linenumber", "pt", "quantity"), pt=2, quantity=2)


@query("SELECT o_custkey, o_orderkey AS \"Jkey\", round(o_totalprice, 2) AS \"Jtotal\", l_linenumber, round(l_quantity, 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL")
def grandchild_table(spark, sf_dir):
    """Customer as event, orders as items, line items as their constituents."""
    child = F.struct("l_linenumber", F.col("l_quantity").alias("quantity"))
    items = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(child).alias("kids"))
    o = read(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    e = o.where("o_custkey is not null").groupBy("o_custkey").agg(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"), "kids")).alias("items"))
    return rounded(tables.grandchild_table(e, "items", "kids", ["o_custkey"], ["key", "total"]), Jtotal=2, quantity=2)


@query("""
SELECT l_orderkey, l_linenumber, round(l_tax * (l_extendedprice / l_quantity / 1000) ** 4, 6) AS wt_gen, round(l_discount * (l_extendedprice * (1 - l_discount) / l_quantity / 1000) ** 4, 6) AS wt_reco
FROM lineitem WHERE l_tax > 0 AND l_quantity > 0""")
def transfer_item_table(spark, sf_dir):
    entry = F.struct("l_linenumber", F.col("l_tax").alias("wt_gen"), F.col("l_discount").alias("wt_reco"))
    q = F.col("l_quantity") * 1000
    item = F.struct(q.alias("pt"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pt_denom"), q.alias("pt_gen"), F.col("l_extendedprice").alias("pt_denom_gen"), F.array(entry).alias("entries"))
    e = _items(spark, sf_dir).where("l_quantity > 0").groupBy("l_orderkey").agg(F.collect_list(item).alias("items"))
    return rounded(tables.transfer_table(e, "items", "entries", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "wt_gen", "wt_reco"), wt_gen=6, wt_reco=6)


@query(f"""
WITH {_RANKED}, e AS (SELECT l_orderkey, any_value(n) AS n, max(l_extendedprice) FILTER (k = 1) AS lead, max(l_extendedprice) FILTER (k = 3) AS third, max(charge) FILTER (k = 3) AS third_charge FROM l GROUP BY 1)
SELECT o_orderkey AS event_id, round(o_totalprice, 2) AS ht, n::int AS n_items, round(lead, 2) AS lead_pt, round(coalesce(third, 0), 2) AS third_pt, coalesce(third_charge, -999)::int AS third_charge FROM e JOIN orders ON o_orderkey = l_orderkey""")
def event_table(spark, sf_dir):
    e = _events(spark, sf_dir)
    wanted = {"event_id": "o_orderkey", "ht": "o_totalprice", "met": "MET.pt", "pileup": "Pileup.nTrueInt"}  # the last two do not exist here
    derived = {"n_items": F.size("items"), "lead_pt": nested.nth("items", 0, field="pt"), "third_pt": nested.nth("items", 2, 0.0, "pt"), "third_charge": nested.nth("items", 2, -999, "charge")}
    return rounded(tables.event_table(e, wanted, derived), ht=2, lead_pt=2, third_pt=2)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 + sqrt(l_discount ** 2 + l_tax ** 2)), 4) AS up, round(l_extendedprice * (1 - sqrt(l_discount ** 2 + l_tax ** 2)), 4) AS down FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL")
def quadrature_shift(spark, sf_dir):
    l = _items(spark, sf_dir).where("l_discount is not null and l_tax is not null")  # noqa: E741
    u = F.array(1 + F.col("l_discount"), 1 + F.col("l_tax"))
    sources = {s: nested.source_for({"common": {"pt": "l_extendedprice"}, "UP": {"up": True}, "nominal": {"up": False}}, s) for s in ("UP", "DN")}
    shift = lambda s: nested.quadrature_shift(sources[s]["pt"], u, sources[s]["up"])
    return rounded(l.select("l_orderkey", "l_linenumber", shift("UP").alias("up"), shift("DN").alias("down")), up=4, down=4)


@query(f"""
WITH {_RANKED}, m AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS pt, l_quantity >= 20 OR l_extendedprice >= 40000 AS ok, (l_linenumber - 1)::int AS idx, k FROM l),
f AS (SELECT a.l_orderkey, count(*) FILTER (a.ok) AS n_ok, count(*) FILTER (coalesce(b.ok, false)) AS n_matched, bool_or(a.ok) AS any_ok FROM m a LEFT JOIN m b ON b.l_orderkey = a.l_orderkey AND b.k = a.idx + 1 GROUP BY 1)
SELECT l_orderkey, n_ok::int AS n_ok, n_matched::int AS n_matched, any_ok FROM f JOIN orders ON o_orderkey = l_orderkey""")
def matched_masks(spark, sf_dir):
    """Items that pass an id level or a threshold, items whose index points to such an item, and whether there is one."""
    e = _events(spark, sf_dir)
    items = nested.with_fields("items", puId=lambda x: x["quantity"], iReco=lambda x: x["l_linenumber"] - 1)
    e = e.withColumn("items", items).withColumn("mask", F.transform("items", lambda x: select.passes_id_or_pt(x, 20, 40000)))
    flagged = F.zip_with("items", "mask", lambda x, m: x.withField("flag", m))
    return e.select("l_orderkey", F.size(F.filter("mask", lambda m: m)).alias("n_ok"), F.size(select.matched_mask("items", "mask", "iReco")).alias("n_matched"), nested.any_matched(flagged, "flag").alias("any_ok"))


_VETO_ETA, _VETO_PHI = Axis.regular("e", 5, -2.5, 2.5, clamp=True), Axis.regular("p", 6, -3.14159, 3.14159, clamp=True)
_VETO = {(e, p): float((e * 7 + p) % 4 == 0) for e in range(5) for p in range(6)}
_VETO_SQL = ", ".join(f"({e}, {p}, {v!r}::double)" for (e, p), v in _VETO.items())


@query(f"""
WITH {_RANKED}, v(e, p, v) AS (VALUES {_VETO_SQL}), x AS (SELECT *, greatest(least(phi, 3.14159), -3.14159) AS clipped FROM l)
SELECT l_orderkey, l_linenumber FROM x JOIN v ON v.e = {case(_VETO_ETA, 'eta')} AND v.p = least(greatest(floor((clipped - -3.14159::double) / (3.14159::double - -3.14159::double) * 6.0)::int, 0), 5) WHERE v.v = 0""")
def map_veto(spark, sf_dir):
    l = _items(spark, sf_dir).withColumns({"eta": (F.col("l_quantity") - 25) / 10, "phi": (F.col("l_discount") - 0.05) * 60})  # noqa: E741
    phi = F.greatest(F.least("phi", F.lit(3.14159)), F.lit(-3.14159))
    t = lookup.local(spark, [(e, p, v) for (e, p), v in _VETO.items()], "e int, p int, value double")
    out = lookup.binned_lookup(l, t, [(_VETO_ETA, "eta"), (_VETO_PHI, phi)], default=None, into="veto")
    return out.where("veto = 0").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity <= 30 AND l_discount >= 0.02 AND l_discount < 0.08")
def sample_stitching(spark, sf_dir):
    """Quantities and discounts are whole steps, so rows lie on all three limits."""
    flags = {"ht_max": 30, "vpt_low": 0.02, "vpt_high": 0.08}
    return _items(spark, sf_dir).where(select.in_sample(flags, "l_quantity", "l_discount")).select("l_orderkey", "l_linenumber", "l_quantity")


_SFT = Axis.variable("pt", [10.0, 20.0, 30.0, 60.0], underflow=False, overflow=False)
_SFE = Axis.variable("eta", [0.0, 0.9, 1.2, 2.1, 2.4], underflow=False, overflow=False)
_SFS = {(e, p): round(0.95 + 0.01 * e + 0.02 * p, 4) for e in range(4) for p in range(3)}
_SFS_SQL = ", ".join(f"({e}, {p}, {v!r}::double)" for (e, p), v in _SFS.items())


@query(f"""
WITH {_RANKED}, s(e, p, v) AS (VALUES {_SFS_SQL}), x AS (SELECT l_orderkey, k, coalesce(v, 1.0) AS f FROM l LEFT JOIN s ON s.e = {case(_SFE, 'abs(eta)')} AND s.p = {case(_SFT, KPRICE)} WHERE k <= 2 AND n >= 2)
SELECT l_orderkey, round(product(f), 7) AS sf, round(max(f) FILTER (k = 1), 7) AS trigger FROM x GROUP BY 1""")
def pair_scale_factor(spark, sf_dir):
    e = _events(spark, sf_dir).where(F.size("items") >= 2)
    legs = {f"{v}{k}": nested.nth("items", k, field=v) / (1000 if v == "pt" else 1) for k in (0, 1) for v in ("eta", "pt")}
    e = e.select("l_orderkey", *[c.alias(n) for n, c in legs.items()])
    t = lookup.local(spark, [(a, p, v) for (a, p), v in _SFS.items()], "eta int, pt int, value double")
    both = lookup.efficiency_pair(e, t, [("eta0", "pt0"), ("eta1", "pt1")], _SFE, _SFT, into="sf")
    both = lookup.efficiency_pair(both, t, [("eta0", "pt0")], _SFE, _SFT, into="trigger")
    return rounded(both.select("l_orderkey", "sf", "trigger"), sf=7, trigger=7)


_PU = Axis.regular("pu", 50, 0.5, 50.5, underflow=False, overflow=False)


@query("""
SELECT p_partkey, round(1 + (p_size - 25) / 100.0, 6)::double AS nominal, round(CASE WHEN p_size < 26 THEN 1.0 ELSE (p_size - 25) / 10.0 END, 6)::double AS guarded FROM part WHERE p_size BETWEEN 1 AND 50""")
def pileup_weight(spark, sf_dir):
    """A one-dimensional correction with variants as keys, and one whose values at or below 0 count as 1."""
    t = lookup.local(spark, [(k, s, 1 + (k - 24) / 100 if s == "nominal" else (k - 24) / 10) for k in range(50) for s in ("nominal", "raw")], "pu int, syst string, value double")
    p = read(spark, sf_dir, "part").where(F.col("p_size").between(1, 50))
    p = lookup.binned_lookup(p.withColumn("syst", F.lit("nominal")), t, [(_PU, "p_size")], keys=["syst"], into="nominal")
    p = lookup.binned_lookup(p.withColumn("syst", F.lit("raw")), t, [(_PU, "p_size")], keys=["syst"], default=None, into="raw")
    return rounded(p.select("p_partkey", "nominal", weights.guarded("raw").alias("guarded")), nominal=6, guarded=6)


@query("""
WITH f AS (SELECT l_orderkey, CASE WHEN l_linenumber = 1 AND l_returnflag = 'N' THEN 21 WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END AS fl FROM lineitem)
SELECT l_orderkey, bool_or(fl = 21) AS has_gluon, CASE WHEN bool_or(fl = 21) THEN 1.1 ELSE 1.0 END::double AS up, CASE WHEN bool_or(fl = 21) THEN 0.9 ELSE 1.0 END::double AS down FROM f GROUP BY 1""")
def flavour_weights(spark, sf_dir):
    hadron, parton = F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("l_linenumber")), F.when(F.col("l_returnflag") == "N", 21).otherwise(1)
    item = F.struct(nested.flavour(hadron, parton).alias("fl"))
    e = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(item).alias("jets"))
    up, down = weights.flavour_presence("jets", "fl", 21, 0.1)
    return e.select("l_orderkey", F.exists("jets", lambda x: x["fl"] == 21).alias("has_gluon"), F.round(up, 6).alias("up"), F.round(down, 6).alias("down"))


@query("""
WITH e AS (SELECT vec_id, list_transform(list_concat(embedding, embedding), lambda x: 1 + x::double) AS w FROM embeddings),
s AS (SELECT vec_id, sqrt(list_sum(list_transform(w[2:101], lambda x: (x - 1) ** 2)) / 99) AS pdf, (w[103] - w[102]) * 0.5 AS alpha FROM e)
SELECT vec_id, round(1 - pdf, 6) AS pdf_down, round(alpha, 6) + 0.0 AS alpha, round(1 + sqrt(pdf ** 2 + alpha ** 2), 6) AS both_up FROM s""")
def pdf_uncertainties(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.concat("embedding", "embedding"), lambda x: 1 + x.cast("double")).alias("w"))
    out = e.select("vec_id", weights.hessian("w")[1].alias("pdf_down"), weights.coupling("w").alias("alpha"), weights.hessian_and_coupling("w")[0].alias("both_up"))
    return rounded(out, pdf_down=6, alpha=6, both_up=6)


@query(f"""SELECT {case(DISC, 'l_discount')} AS disc, round(sum(l_quantity * {_poly_sql('l_quantity::double')}), 3) AS sumw FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY 1""")
def reweighted_fill(spark, sf_dir):
    w = F.col("l_quantity") * lookup.polynomial("l_quantity", _SEGMENTS)
    return rounded(hist.histogram(_items(spark, sf_dir), [DISC], ["l_discount"], w).select("disc", "sumw"), sumw=3)


@query("SELECT l_returnflag AS level, l_linestatus AS step, round(sum(l_quantity), 2) AS sumw, count(*) AS n FROM lineitem GROUP BY 1, 2")
def merged_partials(spark, sf_dir):
    """Partial counts per supplier (a file's part) added up."""
    parts = _items(spark, sf_dir).groupBy(F.col("l_returnflag").alias("level"), F.col("l_linestatus").alias("step"), "l_suppkey").agg(F.sum("l_quantity").alias("sumw"), F.count(F.lit(1)).alias("n"))
    return rounded(layout.merged(parts, ["level", "step"], ["sumw", "n"]), sumw=2)


@query(f"""WITH {_COV}, {_VAL}, d AS (SELECT a.cell AS i, b.cell AS j, sum(a.w * b.w) AS cov FROM (SELECT l_orderkey AS e, {case(CELLS, 'l_quantity')} AS cell, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2) a
JOIN (SELECT l_orderkey AS e, {case(CELLS, 'l_quantity')} AS cell, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2) b ON a.e = b.e GROUP BY 1, 2),
u AS (SELECT {case(CELLS, 'l_quantity')} AS i, sum(l_quantity) AS y FROM lineitem GROUP BY 1), j AS (SELECT i, value AS x, y FROM v JOIN u USING (i))
SELECT c.i, c.j, round((c.cov / (p.y * q.y) + d.cov * p.x * q.x / (p.y * p.y * q.y * q.y)) * 1e6, 5) AS cov FROM c JOIN d ON d.i = c.i AND d.j = c.j JOIN j p ON p.i = c.i JOIN j q ON q.i = c.j""")
def ratio_covariance(spark, sf_dir):
    """Covariance of price over quantity per cell, the two taken as uncorrelated."""
    per = cov.per_event(_cells(spark, sf_dir), "l_orderkey", "cell", {"p": _k(KPRICE), "q": "l_quantity"})
    pairs = cov.covariance_of(per, "l_orderkey", "cell", {"cov_x": "p", "cov_y": "q"})
    values = per.groupBy(F.col("cell").alias("i")).agg(F.sum("p").alias("x"), F.sum("q").alias("y"))
    out = algebra.ratio_covariance(pairs, values)
    return rounded(out.withColumn("cov", F.col("cov") * 1e6), cov=5)


@query("""
WITH l AS (SELECT l_orderkey, l_extendedprice AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, round(max(p) FILTER (k = 2), 2) AS upper_right, round(max(p) FILTER (k = 3), 2) AS lower_left FROM l WHERE n >= 4 GROUP BY 1""")
def nested_matrices(spark, sf_dir):
    flat = _items(spark, sf_dir).groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_extendedprice").alias("p")))).alias("f"))
    flat = flat.where(F.size("f") >= 4).select("l_orderkey", F.slice("f.p", 1, 4).alias("flat"))
    m = F.get(nested.unflatten_matrix("flat", F.array(F.lit(2)), F.array(F.lit(2))), F.lit(0))
    return rounded(flat.select("l_orderkey", F.get(F.get(m, F.lit(0)), F.lit(1)).alias("upper_right"), F.get(F.get(m, F.lit(1)), F.lit(0)).alias("lower_left")), upper_right=2, lower_left=2)


# ---- selections, sources and array functions


@query(f"""
WITH {_RANKED}, e AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_extendedprice > 30000) AS tags, count(*) FILTER (l_returnflag = 'R') AS returned FROM l GROUP BY 1)
SELECT o_orderkey FROM orders JOIN e ON o_orderkey = l_orderkey WHERE o_orderpriority <> '5-LOW' AND o_totalprice <= 200000 AND tags <= 2 AND n <= 5 AND returned <= 1 AND o_orderstatus <> 'P' AND o_orderdate IS NOT NULL AND n >= 2""")
def global_selection(spark, sf_dir):
    e = _events(spark, sf_dir).withColumns(
        {
            "jets": nested.with_tags(F.col("items"), "pt", {"MediumB": 30000}),
            "electrons": F.filter("items", lambda x: x["charge"] == -1),
            "fired": F.col("o_orderpriority") != "5-LOW",
            "clean": F.col("o_orderstatus") != "P",
            "known": F.col("o_orderdate").isNotNull(),
            "vertices": F.size("items"),
        }
    )
    s = select.global_event("fired", "o_totalprice", 200000, "jets", "passMediumB", 2, "items", 5, "electrons", 1, ["clean", "known"], "vertices", 2)
    return s.filter(e).select(F.col("l_orderkey").alias("o_orderkey"))


_JETS_SQL = "SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS pt, (l_quantity - 25) / 10 AS eta, l_returnflag <> 'R' AS tight, l_linenumber AS pu FROM lineitem"


def _jets(spark, sf_dir) -> DataFrame:
    return _items(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("pt"), ((F.col("l_quantity") - 25) / 10).alias("eta"), (F.col("l_returnflag") != "R").cast("int").alias("jetIdTight"), F.col("l_linenumber").alias("puId")
    )


@query(f"WITH j AS ({_JETS_SQL}) SELECT level, l_orderkey, l_linenumber FROM j, (VALUES ('loose', 4), ('medium', 6), ('tight', 7)) v(level, least) WHERE pt >= 20 AND abs(eta) <= 2 AND tight AND pu >= least")
def jet_selection(spark, sf_dir):
    j = _jets(spark, sf_dir)
    passed = {level: select.jet(20, 2, "tight", level).all() for level in select.PILEUP_LEVELS}
    levels = F.array_compact(F.array(*[F.when(c, F.lit(level)) for level, c in passed.items()]))
    return j.select(F.explode(levels).alias("level"), "l_orderkey", "l_linenumber")


@query(f"""
WITH j AS (SELECT j.*, o_orderstatus <> 'P' AS good, o_totalprice <= 200000 AS low FROM ({_JETS_SQL}) j JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT count(*)::double AS s0, sum(pt) AS s1, sum(pt) FILTER (low) AS s2, sum(pt) FILTER (low AND good) AS s3, sum(pt) FILTER (low AND good AND pt >= 20) AS s4, sum(pt) FILTER (low AND good AND pt >= 20 AND abs(eta) <= 2) AS s5 FROM j)
SELECT 'item' AS level, k::int AS step_no, step, round(coalesce(v, 0), 3) AS n FROM s, LATERAL (VALUES (0, 'raw', s0), (1, 'all', s1), (2, 'met', s2), (3, 'noise', s3), (4, 'pt', s4), (5, 'eta', s5)) x(k, step, v)""")
def cutflow_items(spark, sf_dir):
    """The items' flow, behind the cuts of their events."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("met"), (F.col("o_orderstatus") != "P").alias("good"))
    event = select.global_event(maximum_met=200000, noise=["good"])
    return rounded(select.cutflow(_jets(spark, sf_dir).join(o, "l_orderkey"), select.inherited(event, select.jet(20, 2)), "pt", "item"), n=3)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 20 AND 30")
def mass_window(spark, sf_dir):
    return _items(spark, sf_dir).where(select.mass_window("l_quantity", 25, 5)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
SELECT l_linestatus, count(*) FILTER (l_quantity >= 10 AND l_quantity < 20) AS two_sided, count(*) FILTER (l_returnflag = 'R') AS equal, count(*) AS no_cut,
  count(*) FILTER ((l_quantity >= 10 AND l_quantity < 20) OR l_returnflag = 'R') AS either, count(*) FILTER ((l_quantity >= 10 AND l_quantity < 20) AND NOT l_returnflag = 'R') AS required, 7.0::double AS constant
FROM lineitem GROUP BY 1""")
def cut_kinds(spark, sf_dir):
    s = select.Selection().add("window", expr.two_sided("l_quantity", 10, 20)).add("flag", expr.equals("l_returnflag", "R"))
    wanted = {"two_sided": s.cuts["window"], "equal": s.cuts["flag"], "no_cut": expr.no_cut(), "either": s.any("window", "flag"), "required": s.require(window=True, flag=False)}
    return _items(spark, sf_dir).groupBy("l_linestatus").agg(*[F.count_if(c).alias(n) for n, c in wanted.items()], F.max(expr.constant(7.0)).alias("constant"))


@query(f"""
WITH {_RANKED}, g AS (SELECT a.l_orderkey, a.k, a.l_extendedprice AS p, a.l_tax AS t, a.l_discount AS d, b.l_extendedprice AS q FROM l a LEFT JOIN l b ON b.l_orderkey = a.l_orderkey AND b.k = a.l_linenumber)
SELECT l_orderkey, count(*) FILTER (t > 0)::int AS n_positive, count(q)::int AS n_gathered, round(sum(q), 2) AS gathered, round(sum(p * (1 - d)), 4) AS raw, round(sum(p), 2) AS stored FROM g JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def entries_gathered(spark, sf_dir):
    e = _events(spark, sf_dir)
    items = nested.swapped_pt(nested.with_fields("items", jec=lambda x: F.lit(1.0) - (x["phi"] / 60 + 0.05)), "jec", True)
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.coalesce(x[f], F.lit(0.0)))
    e = e.withColumn("swapped", items).withColumn("got", nested.gather("items", F.transform("items", lambda x: (x["l_linenumber"] - 1).cast("int"))))
    out = e.select(
        "l_orderkey", F.size(nested.positive_entries("items", "mass")).alias("n_positive"), F.size(F.filter("got", lambda x: x.isNotNull())).alias("n_gathered"),
        F.when(F.exists("got", lambda x: x.isNotNull()), total("got", "pt")).alias("gathered"), total("swapped", "pt").alias("raw"), total("swapped", "pt_stored").alias("stored"),
    )
    return rounded(out, gathered=2, raw=4, stored=2)


@query("SELECT l_returnflag AS flag, count(*) AS n, round(sum(l_quantity), 2) AS quantity, 'nominal' AS objsyst FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def written_tables(spark, sf_dir):
    """Two tables of the same objects written under their coordinates; one read back by partition filters, pruned and pushed down."""
    path = _folder(spark, "skims")
    make = {"jets": lambda d: d.select("l_returnflag", "l_linestatus", "l_quantity"), "keys": lambda d: d.select("l_orderkey")}
    layout.write_tables(_items(spark, sf_dir).select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity"), make, path, objsyst="nominal", dataset="all")
    t = layout.scan_table(spark, path, ["l_returnflag", "l_quantity", "objsyst"], F.col("l_linestatus") == "O", tbl="jets", dataset="all")
    return rounded(t.groupBy(F.col("l_returnflag").alias("flag"), "objsyst").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")), quantity=2)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def event_files(spark, sf_dir):
    """Event files in nested folders, read recursively; files outside the pattern stay out."""
    path = _folder(spark, "events")
    o = read(spark, sf_dir, "orders")
    o.where("o_orderstatus = 'F'").write.parquet(f"{path}/a/b")
    o.where("o_orderstatus = 'O'").write.parquet(f"{path}/c")
    o.where("o_orderstatus = 'P'").write.json(f"{path}/d")
    return layout.scan_events(spark, path, exclude_prefix="dropped").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r_name AS runtag, n_name AS dataset, n_nationkey % 2 = 0 AS is_mc, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 0.5 END::double AS xsec, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10.0 END::double AS ht_max, -1.0::double AS vpt_high, 'A' AS era FROM nation JOIN region ON n_regionkey = r_regionkey")
def catalog_flags(spark, sf_dir):
    """Catalog files written from the nations: simulation has a cross section and a flag, data neither."""
    path = _folder(spark, "catalog")
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    mc = F.col("n_nationkey") % 2 == 0
    flags = F.struct(F.when(mc, F.col("n_nationkey") * 10).alias("genHT"), F.array(F.lit(5), F.lit(-1)).alias("genVpt"))
    attributes = F.struct(F.when(mc, F.col("n_nationkey") + 0.5).alias("xsec"), F.lit("A").alias("era"), flags.alias("flags"))
    sets = n.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", attributes))).alias("sets"))
    sets.select(F.to_json(F.create_map("r_name", "sets")).alias("value"), F.col("r_name").alias("file")).write.partitionBy("file").text(path)
    found = catalog.load_catalog(spark, path, glob="*.txt")
    return found.select("runtag", "dataset", "is_mc", "xsec", "ht_max", "vpt_high", "era")


@query(f"""WITH m(stack, dataset) AS (VALUES ('urgent', '1-URGENT'), ('all', '1-URGENT'), ('all', '2-HIGH'), ('all', '3-MEDIUM')),
h AS (SELECT o_orderpriority AS dataset, {case(_TOTAL, 'o_totalprice / 1000')} AS total, count(*) AS n FROM orders WHERE o_totalprice IS NOT NULL GROUP BY 1, 2)
SELECT stack, total AS i, total AS j, sum(CASE WHEN dataset <> '3-MEDIUM' THEN n ELSE 0 END)::double AS cov FROM h JOIN m USING (dataset) GROUP BY 1, 2""")
def stacked_covariances(spark, sf_dir):
    """A stack's covariance; one dataset has none stored, which counts as zero."""
    o = read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "dataset")
    h = hist.histogram(o, [_TOTAL], [F.col("o_totalprice") / 1000], by=["dataset"])
    stored = h.where("dataset <> '3-MEDIUM'").select("dataset", F.col("total").alias("i"), F.col("total").alias("j"), F.col("sumw2").alias("cov"))
    links = catalog.stack_links(spark, [("urgent", "1-URGENT", "dset"), ("all", "urgent", "stack"), ("all", "2-HIGH", "dset"), ("all", "3-MEDIUM", "dset")])
    return catalog.stacked_covariance(stored, h, catalog.stack_members(spark, links), "total")
