"""Reading and writing event and item tables, and checks of what is there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.axes import agreed_binning, binnings

#: Partition columns of skims, and the further ones of binned tables.
SKIM = ("configsuite", "runtag", "dataset", "objsyst", "tbl")
BINNED = (*SKIM, "wtsyst", "statn", "statk", "kind")


def scan_events(spark: SparkSession, path: str | Sequence[str], exclude_prefix: str | None = None, glob: str = "*.parquet") -> DataFrame:
    """One row per event of all files below the path whose names do not start with `exclude_prefix`."""
    paths = [path] if isinstance(path, str) else list(path)
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).parquet(*paths)
    return df if exclude_prefix is None else df.where(~F.col("_metadata.file_name").startswith(exclude_prefix))


def scan_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None, **coordinates) -> DataFrame:
    """A partitioned table with its coordinates as partition filters, then projection and predicate pushed down."""
    df = spark.read.parquet(path)
    for k, v in coordinates.items():
        df = df.where(F.col(k) == v)
    df = df if where is None else df.where(where)
    return df if columns is None else df.select(*columns)


def write_table(df: DataFrame, path: str, mode: str = "append", **coordinates) -> None:
    """Writes under Hive-style partition columns; files of other coordinates stay.

    Raises if the table is there and one of its columns carries another binning: one output holds one binning.
    """
    for k, v in coordinates.items():
        df = df.withColumn(k, F.lit(v))
    if binnings(df):
        try:
            there = df.sparkSession.read.parquet(path)
        except AnalysisException:  # nothing there yet
            there = None
        if there is not None:
            agreed_binning(there, df)
    df.write.mode(mode).partitionBy(*coordinates).parquet(path)


def write_tables(objects: DataFrame, tables: dict[str, Callable[[DataFrame], DataFrame]], path: str, **coordinates) -> None:
    """Several tables of the same objects, which are computed once and kept while the tables are written."""
    objects = objects.persist()
    try:
        for name, make in tables.items():
            write_table(make(objects), path, tbl=name, **coordinates)
    finally:
        objects.unpersist()


def counts(df: DataFrame, weight: str = "genWeight", by: Sequence[str | Column] = ()) -> DataFrame:
    """by, count: the sum of generator weights if there are any, else the number of rows."""
    n = F.sum(weight) if weight in df.columns else F.count(F.lit(1)).cast("double")
    return df.groupBy(*by).agg(n.alias("count"))


def merged(parts: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Partial results of many files added up."""
    return parts.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def completeness(expected: DataFrame, produced: DataFrame, file: str = "file") -> DataFrame:
    """file, status, covered, gaps, overlaps: expected (file, entries) against produced (file, start, stop, ok).

    missing: nothing produced; erroneous: some piece failed; incomplete: the good pieces do not tile [0, entries).
    """
    good = produced.where("ok")
    before = F.coalesce(F.max("stop").over(Window.partitionBy(file).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tiles = good.withColumn("_before", before)
    per = tiles.groupBy(file).agg(
        F.max("stop").alias("_end"),
        F.sum(F.greatest(F.col("start") - F.col("_before"), F.lit(0))).alias("gaps"),
        F.sum(F.greatest(F.least("_before", "stop") - F.col("start"), F.lit(0))).alias("overlaps"),
    )
    bad = produced.where("not ok").groupBy(file).agg(F.count(F.lit(1)).alias("_bad"))
    j = expected.join(per, file, "left").join(bad, file, "left")
    gaps = F.coalesce("gaps", F.lit(0)) + F.greatest(F.col("entries") - F.coalesce("_end", F.lit(0)), F.lit(0))
    overlaps = F.coalesce("overlaps", F.lit(0)) + F.greatest(F.coalesce("_end", F.lit(0)) - F.col("entries"), F.lit(0))
    status = (
        F.when(F.col("_end").isNull() & F.col("_bad").isNull(), "missing")
        .when(F.coalesce("_bad", F.lit(0)) > 0, "erroneous")
        .when((gaps > 0) | (overlaps > 0), "incomplete")
        .otherwise("complete")
    )
    return j.select(file, status.alias("status"), (F.col("entries") - gaps).alias("covered"), gaps.alias("gaps"), overlaps.alias("overlaps"))


def missing(expected: DataFrame, produced: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.select(*keys).join(produced.select(*keys), list(keys), "left_anti")


def file_rows(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """file, n, n_read of every file below a path: its rows by its footer, and those whose columns could all be read.

    Unreadable files are skipped, unreadable pages end a file.
    """
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("ignoreCorruptFiles", "true").parquet(path)
    name = F.col("_metadata.file_path").alias("file")
    footers = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    pages = df.select(name, F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h")).groupBy("file").agg(F.count("h").alias("n_read"), F.bit_xor("h").alias("_all"))
    return footers.join(pages, "file", "left").select("file", "n", F.coalesce(F.when(F.col("_all").isNotNull(), F.col("n_read")), F.lit(0).cast("long")).alias("n_read"))


def empty_or_corrupt(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """file: listed files that have no row, or whose footer or columns cannot be read whole. A report; nothing is deleted."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("file"))
    return listed.join(file_rows(spark, path, glob).where("n > 0 and n = n_read"), "file", "left_anti")


def binned(spark: SparkSession, values_path: str, covariance_path: str | None = None, key: str = "i", **coordinates) -> tuple[DataFrame, DataFrame]:
    """Values and covariance (i, j, cov) of a binned table at its coordinates; a covariance that is absent is zero on the diagonal.

    `key` is the values' cell column. A stack of tables: `catalog.scan_stack`.
    """
    values = scan_table(spark, values_path, **coordinates)
    zero = values.select(F.col(key).alias("i"), F.col(key).alias("j"), F.lit(0.0).alias("cov"))
    if covariance_path is None:
        return values, zero.distinct()
    stored = scan_table(spark, covariance_path, **coordinates).select("i", "j", "cov")
    return values, stored.unionByName(zero).groupBy("i", "j").agg(F.sum("cov").alias("cov"))


def partition_files(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """A row per file below a partitioned table: its coordinates `keys` (as text) and bytes, from the listing alone.

    Nothing is opened. Files of no bytes are listed too, which scans leave out.
    """
    files = spark.read.format("binaryFile").load(path)
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    plain = lambda c: F.regexp_replace(c, "^([^:/]+:)/+", "$1/")  # noqa: E731  one spelling of file:/ and file:///
    listed = spark.createDataFrame([(f,) for f in files.inputFiles()], "uri string").select(plain(decoded(F.col("uri"))).alias("path"))
    sized = listed.join(files.select(plain(F.col("path")).alias("path"), F.col("length").alias("bytes")), "path", "left")
    return sized.select(*[decoded(F.regexp_extract("path", f"/{k}=([^/]*)/", 1)).alias(k) for k in keys], F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


def partition_status(expected: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, status, bytes of binned outputs: expected partitions (keys, once each) against `partition_files`.

    missing: no file; empty: files of no bytes only; extra: files at coordinates that nobody expects; else complete.
    Coordinates are compared and given as text.
    """
    expected = expected.select(*[F.col(k).cast("string").alias(k) for k in keys])
    made = files.groupBy(*keys).agg(F.sum("bytes").alias("bytes")).withColumn("_made", F.lit(True))
    j = expected.select(*keys).withColumn("_wanted", F.lit(True)).join(made, list(keys), "full")
    status = F.when(F.col("_made").isNull(), "missing").when(F.col("_wanted").isNull(), "extra").when(F.col("bytes") == 0, "empty").otherwise("complete")
    return j.select(*keys, status.alias("status"), F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))


def binned_jobs(jobs: DataFrame, tables: Sequence[str], splits: int) -> DataFrame:
    """jobs (dataset, objsyst, wtsyst) x tables x statistical splits: a row per binned output (tbl, statn, statk)."""
    per = F.array(*[F.struct(F.lit(t).alias("tbl"), F.lit(splits).alias("statn"), F.lit(k).alias("statk")) for t in tables for k in range(splits)])
    return jobs.select("*", F.inline(per))
