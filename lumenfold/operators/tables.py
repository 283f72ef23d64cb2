"""Flat item tables from nested events: event columns repeated per item by one Generate, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nested import field_or_none, normalised_weight


def present(df: DataFrame, columns: dict[str, str]) -> dict[str, Column]:
    """Those of {output name: path} whose path the schema has."""
    found = {n: field_or_none(df, p) for n, p in columns.items()}
    return {n: c for n, c in found.items() if c is not None}


def event_table(df: DataFrame, columns: dict[str, str], derived: dict[str, Column] | None = None) -> DataFrame:
    """One row per event: the columns that exist, and derived ones."""
    cols = present(df, columns) | (derived or {})
    return df.select(*[c.alias(n) for n, c in cols.items()])


def item_table(df: DataFrame, items: str, common: Sequence[str] = (), prefix: str = "", keep: Column | None = None) -> DataFrame:
    """One row per item, with all its fields and the common event columns. `keep` filters events before, so that
    their items are never generated."""
    rows = df if keep is None else df.where(keep)
    fields = rows.schema[items].dataType.elementType.names
    out = rows.select(*common, F.explode(items).alias("_item"))
    return out.select(*common, *[F.col(f"_item.{f}").alias(f"{prefix}{f}") for f in fields])


def leading(rows: DataFrame, event: str, order: Sequence[str | Column], k: int) -> DataFrame:
    """event, n_leading (up to k), leading1 ... leadingk: structs of the first k rows of each event in the given order; null beyond.

    The rank limit is applied before the rows are shuffled as well as after, so a task sends k rows of an event at most
    and no event's rows are collected.
    """
    rank = F.row_number().over(Window.partitionBy(event).orderBy(*order))
    top = rows.withColumn("_rank", rank).where(F.col("_rank") <= k)
    item = F.struct(*[c for c in rows.columns if c != event])
    nth = [F.max(F.when(F.col("_rank") == i, item)).alias(f"leading{i}") for i in range(1, k + 1)]
    return top.groupBy(event).agg(F.count(F.lit(1)).cast("int").alias("n_leading"), *nth)


def grandchild_table(df: DataFrame, items: str, children: str, common: Sequence[str] = (), item_fields: Sequence[str] = (), prefix: str = "J") -> DataFrame:
    """One row per child of each item, with the listed item fields (prefixed) and the common event columns."""
    one = df.select(*common, F.explode(items).alias("_item"))
    two = one.select(*common, *[F.col(f"_item.{f}").alias(f"{prefix}{f}") for f in item_fields], F.explode(f"_item.{children}").alias("_child"))
    fields = two.schema["_child"].dataType.names
    return two.select(*common, *[f"{prefix}{f}" for f in item_fields], *[F.col(f"_child.{f}").alias(f) for f in fields])


def correlator_table(df: DataFrame, items: str, entries: str, common: Sequence[str], pt: str = "pt", denominator: str = "pt_denom", order: int = 4) -> DataFrame:
    """Entries of each item's correlator with wt scaled by (denominator / pt) ** order; entries with wt <= 0 go."""
    flat = grandchild_table(df, items, entries, common, (pt, denominator))
    flat = flat.where("wt > 0").withColumn("wt", normalised_weight("wt", f"J{pt}", f"J{denominator}", order))
    return flat


def transfer_table(df: DataFrame, items: str, entries: str, common: Sequence[str], order: int = 4) -> DataFrame:
    """Entries with both gen and reco coordinates and weights; those with wt_gen <= 0 go."""
    flat = grandchild_table(df, items, entries, common, ("pt", "pt_denom", "pt_gen", "pt_denom_gen")).where("wt_gen > 0")
    return flat.withColumn("wt_reco", normalised_weight("wt_reco", "Jpt", "Jpt_denom", order)).withColumn("wt_gen", normalised_weight("wt_gen", "Jpt_gen", "Jpt_denom_gen", order))


def generic_table(df: DataFrame, name: str, common: Sequence[str]) -> DataFrame:
    """Every field of a named object: a struct gives one row per event, an array of structs one per item."""
    kind = df.schema[name].dataType
    if hasattr(kind, "elementType"):
        return item_table(df, name, common)
    return df.select(*common, f"{name}.*")
