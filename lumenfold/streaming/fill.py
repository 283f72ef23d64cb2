"""Incremental histograms with Structured Streaming.

The state is one row per cell, so it is bounded by the binning and needs no watermark. Replayed input is kept out
by the checkpoint.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.axes import Axis
from ..operators.hist import histogram


def source(spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files: int | None = None) -> DataFrame:
    """Parquet files as they arrive; `files` at most per batch."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(path)


def running(stream: DataFrame, axes: Sequence[Axis], values: Sequence[Column | str] | None = None, weight=1.0, by: Sequence[str] = ()) -> DataFrame:
    """The same aggregation as the batch histogram, over all input so far."""
    return histogram(stream, axes, values, weight, by)


def start(hist: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Keeps the current histogram in an in-memory table of that name."""
    return hist.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_partials(stream: DataFrame, fill: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: Sequence[str], every: int = 16) -> StreamingQuery:
    """Every batch writes the partial sums of its own rows, `fill(batch)`, under `path`/first=<number>/last=<number>.

    A batch that runs again overwrites its own folder, so a replay changes nothing. After each `every` batches all that
    lies there is added up into one folder of the whole range, so a batch costs its own cells and, on average, the
    histogram's once in `every` (2 at least); folders that an earlier such range covers are deleted. `summed` reads it at any time.
    """

    def write(batch: DataFrame, number: int) -> None:
        fill(batch).write.mode("overwrite").parquet(f"{path}/first={number}/last={number}")
        if number % every == every - 1:
            compact(batch.sparkSession, path, keys, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ranges(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """The ranges of batches whose folders were written whole, from the listing of their success marks."""
    fs, at = _files(spark, path)
    marks = fs.globStatus(at(f"{path}/first=*/last=*/_SUCCESS")) or []
    return sorted((int(a), int(b)) for a, b in (re.search(r"/first=(\d+)/last=(\d+)/", m.getPath().toString()).groups() for m in marks))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the making of its paths."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.sc().hadoopConfiguration()), at


def cover(found: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges that hold every batch once: from the first on the widest that begins there."""
    widest, out = dict(sorted(found)), []  # of equal beginnings the last
    at = 0
    while at in widest:
        out.append((at, widest[at]))
        at = widest[at] + 1
    return out


def summed(spark: SparkSession, path: str, keys: Sequence[str], found: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """The histogram over all whole batches so far: the partial sums added up. Reads the folders of `cover` only."""
    chosen = cover(ranges(spark, path) if found is None else found)
    parts = spark.read.option("basePath", path).parquet(*[f"{path}/first={a}/last={b}" for a, b in chosen]).drop("first", "last")
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in parts.columns if c not in keys])


def compact(spark: SparkSession, path: str, keys: Sequence[str], last: int) -> None:
    """One folder for all batches up to `last`; what the whole range before it covers goes, and that range stays for readers."""
    found = [r for r in ranges(spark, path) if r != (0, last)]  # a replay writes that folder again
    summed(spark, path, keys, found).write.mode("overwrite").parquet(f"{path}/first=0/last={last}")
    before = max((b for a, b in found if a == 0 and 0 < b < last), default=-1)
    fs, at = _files(spark, path)
    for a, b in found:
        if b <= before and (a, b) != (0, before):
            fs.delete(at(f"{path}/first={a}/last={b}"), True)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The histogram after the last whole batch that `start_table` wrote, which the listing tells."""
    batches = {int(re.search(r"/batch=(\d+)/", f).group(1)) for f in spark.read.format("binaryFile").load(path).inputFiles()}
    return spark.read.parquet(f"{path}/batch={max(batches)}")


def start_table(hist: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the current histogram whole after every batch, under `path`/batch=<number>.

    Earlier batches stay, so a reader never meets a table that is being replaced; a batch that runs again writes its own.
    """

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return hist.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
