"""Dataset catalog, groups, stacks and systematics: small dimension tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.axes import agreed_binning, carrying
from ..functions.lookup import local
from ..functions.weights import normalisation
from .layout import scan_table

CATALOG = "runtag string, dataset string, is_mc boolean, xsec double, lumi double, eventcount double, ht_max double"


def catalog(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return local(spark, rows, CATALOG)


def load_catalog(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Reads JSON files of the shape {runtag: {dataset: {attributes}}} into one row per dataset.

    ht_max, vpt_low and vpt_high are the attributes flags.genHT and flags.genVpt (a pair); flags is their JSON text.
    Run tags and datasets are keys of JSON objects, so they are read as maps, not as columns.
    """
    attributes = T.MapType(T.StringType(), T.StringType())
    schema = T.MapType(T.StringType(), T.MapType(T.StringType(), attributes))
    text = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    flat = (
        text.select(F.from_json("value", schema).alias("m"))
        .select(F.explode("m").alias("runtag", "sets"))
        .select("runtag", F.explode("sets").alias("dataset", "a"))
    )
    number = lambda k: F.try_element_at("a", F.lit(k)).cast("double").alias(k)
    flag = lambda path, name: F.get_json_object(F.try_element_at("a", F.lit("flags")), path).cast("double").alias(name)
    flags = [flag("$.genHT", "ht_max"), flag("$.genVpt[0]", "vpt_low"), flag("$.genVpt[1]", "vpt_high")]
    return flat.select("runtag", "dataset", F.try_element_at("a", F.lit("xsec")).isNotNull().alias("is_mc"), *[number(k) for k in ("xsec", "lumi", "eventcount")], *flags, *[F.try_element_at("a", F.lit(k)).alias(k) for k in ("era", "tag", "location", "label", "flags")])


def checked(cat: DataFrame) -> DataFrame:
    """Fails on a dataset that has both a luminosity and a cross section, or neither."""
    wrong = F.col("lumi").isNotNull() == F.col("xsec").isNotNull()
    message = F.concat(F.lit("lumi xor xsec is needed: "), F.col("dataset"))
    return cat.withColumn("dataset", F.when(wrong, F.raise_error(message).cast("string")).otherwise(F.col("dataset")))


def groups(spark: SparkSession, members: dict[str, Sequence[str]]) -> DataFrame:
    return local(spark, [(g, m) for g, ms in members.items() for m in ms], "name string, member string")


def expand(names: DataFrame, group_table: DataFrame) -> DataFrame:
    """name, dataset: a group's members; a name that is no group is itself."""
    return names.join(group_table, "name", "left").select("name", F.coalesce("member", "name").alias("dataset"))


def systematic_jobs(cat: DataFrame, objects: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """dataset, objsyst, wtsyst: all combinations for simulation, (DATA, nominal) for data, once each."""
    spark = cat.sparkSession
    o = spark.createDataFrame([(x,) for x in objects], "objsyst string")
    w = spark.createDataFrame([(x,) for x in weights], "wtsyst string")
    mc = cat.where("is_mc").select("dataset").crossJoin(F.broadcast(o)).crossJoin(F.broadcast(w))  # two short lists
    data = cat.where("not is_mc").select("dataset", F.lit("DATA").alias("objsyst"), F.lit("nominal").alias("wtsyst"))
    return mc.unionByName(data).distinct()


def stack_members(spark: SparkSession, links: DataFrame, roots: Sequence[str] | None = None) -> DataFrame:
    """stack, dataset, times: leaves reached from each stack through stacks of stacks, and over how many paths.

    A recursive common table expression; a dataset on two paths counts twice, as it would be added twice.
    """
    start = "" if roots is None else "WHERE stack IN (" + ", ".join("'" + r.replace("'", "''") + "'" for r in roots) + ")"
    return spark.sql(
        f"""WITH RECURSIVE m(stack, child, kind) AS (
              SELECT stack, child, kind FROM {{links}} {start}
              UNION ALL
              SELECT m.stack, l.child, l.kind FROM m JOIN {{links}} l ON m.kind = 'stack' AND l.stack = m.child)
            SELECT stack, child AS dataset, count(*) AS times FROM m WHERE kind = 'dset' GROUP BY stack, child""",
        links=links,
    )


def normalised(hist: DataFrame, cat: DataFrame, lumi: float, dataset: str = "dataset") -> DataFrame:
    """Histograms of many datasets scaled to a luminosity: simulation by 1000 xsec lumi / eventcount, data as it is."""
    c = cat.select(F.col("dataset").alias(dataset), normalisation("is_mc", "xsec", F.lit(lumi), "eventcount").alias("_f"))
    out = hist.join(c, dataset)
    return out.withColumn("sumw", F.col("sumw") * F.col("_f")).withColumn("sumw2", F.col("sumw2") * F.col("_f") * F.col("_f")).drop("_f")


def stacked(hist: DataFrame | Sequence[DataFrame], members: DataFrame, keys: Sequence[str], dataset: str = "dataset") -> DataFrame:
    """stack, keys, sumw, sumw2: sums over each stack's datasets, of one histogram or several (as of several datasets).

    Raises if the keys of several carry different binnings.
    """
    first, *rest = [hist] if isinstance(hist, DataFrame) else hist
    known = agreed_binning(first, first, keys)
    for h in rest:
        known |= agreed_binning(first, h, keys)
        first = first.unionByName(h)
    m = members.select("stack", F.col("dataset").alias(dataset), "times")
    out = first.join(m, dataset).groupBy("stack", *keys).agg(F.sum(F.col("sumw") * F.col("times")).alias("sumw"), F.sum(F.col("sumw2") * F.col("times")).alias("sumw2"))
    return carrying(out, known)


def stacked_covariance(covariance: DataFrame | None, hist: DataFrame, members: DataFrame, key: str, dataset: str = "dataset") -> DataFrame:
    """stack, i, j, cov of each stack: sums over its datasets. Where no covariance is stored it is zero on the diagonal."""
    m = members.select("stack", F.col("dataset").alias(dataset), "times")
    zero = hist.join(m, dataset).select("stack", F.col(key).alias("i"), F.col(key).alias("j"), F.lit(0.0).alias("cov"))
    if covariance is None:
        return zero.distinct()
    stored = covariance.join(m, dataset).select("stack", "i", "j", (F.col("cov") * F.col("times")).alias("cov"))
    return stored.unionByName(zero).groupBy("stack", "i", "j").agg(F.sum("cov").alias("cov"))


def stack_links(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """(stack, child, kind), kind "stack" or "dset": the driver's own list, so what is reached over it is as bounded."""
    return local(spark, rows, "stack string, child string, kind string")


def scan_stack(spark: SparkSession, values_path: str, covariance_path: str | None, members: DataFrame, stack: str, keys: Sequence[str], key: str, dataset: str = "dataset", **coordinates) -> tuple[DataFrame, DataFrame]:
    """Values (stack, keys, sumw, sumw2) and covariance (stack, i, j, cov) of a named stack of partitioned binned tables.

    The stack's datasets are found at run time (`stack_members`, a short table that is broadcast) and prune the
    partitions of both tables by `dataset`; `coordinates` prune the others. A dataset without stored covariance, or
    no covariance table at all, counts as zero on the diagonal.
    """
    own = F.broadcast(members.where(F.col("stack") == stack))
    values = scan_table(spark, values_path, **coordinates)
    stored = None if covariance_path is None else scan_table(spark, covariance_path, **coordinates)
    return stacked(values, own, keys, dataset), stacked_covariance(stored, values, own, key, dataset)
