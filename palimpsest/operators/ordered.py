"""Ordered state as windows: islands, running counters, inherited values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.kernels import labels
from palimpsest.session import share_package


def in_order(key: str, pos: str):
    return Window.partitionBy(key).orderBy(pos)


def islands(df: DataFrame, key: str, pos: str, value: Column) -> DataFrame:
    """``df`` with ``island``: a number that grows where ``value`` changes (null equals null)."""
    w = in_order(key, pos)
    changed = F.when(F.lag(F.lit(1)).over(w).isNull() | ~value.eqNullSafe(F.lag(value).over(w)), 1).otherwise(0)
    return df.withColumn("__changed", changed).withColumn("island", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__changed")


def border_groups(df: DataFrame, key: str, pos: str, border: str) -> DataFrame:
    """Runs of two and more adjacent rows of an equal border; number and edge (first, middle, last) of each."""
    runs = islands(df, key, pos, F.col(border))
    size = F.count("*").over(Window.partitionBy(key, "island"))
    place = F.row_number().over(Window.partitionBy(key, "island").orderBy(pos))
    grouped = runs.withColumn("size", size).withColumn("place", place).where(F.col(border).isNotNull() & (F.col("size") > 1))
    nth = F.dense_rank().over(Window.partitionBy(key).orderBy("island")) - 1
    edge = F.when(F.col("place") == 1, "first").when(F.col("place") == F.col("size"), "last").otherwise("middle")
    return grouped.select(key, pos, F.concat(F.lit("bg_"), nth).alias("border_group"), edge.alias("edge"))


def coalesced(df: DataFrame, key: str, pos: str, status: str, text: str) -> DataFrame:
    """Adjacent rows of one status as one row of joined text."""
    rows = F.array_sort(F.collect_list(F.struct(pos, text)))
    return islands(df, key, pos, F.col(status)).groupBy(key, "island", status).agg(
        F.min(pos).alias("first_pos"), F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r[text]), "|").alias("text")
    ).drop("island")


def editable_regions(df: DataFrame, key: str, pos: str, editable: Column) -> DataFrame:
    """Maximal runs of editable rows; the others are walls."""
    return islands(df.withColumn("__open", editable), key, pos, F.col("__open")).where("__open").groupBy(key, "island").agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count("*").alias("n")).drop("island")


def running(df: DataFrame, key: str, pos: str, flag: Column, name: str) -> DataFrame:
    """How many rows before this one have the flag."""
    before = in_order(key, pos).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(F.when(flag, 1).otherwise(0)).over(before), F.lit(0)).cast("long"))


def last_before(df: DataFrame, key: str, pos: str, value: Column, name: str) -> DataFrame:
    """The last non-null value before this row."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(in_order(key, pos).rowsBetween(Window.unboundedPreceding, -1)))


def inherited(df: DataFrame, key: list[str], pos: str, value: str) -> DataFrame:
    """A section without a value of its own takes the last one before it."""
    w = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("effective", F.last(value, ignorenulls=True).over(w))


def counters(df: DataFrame, key: str, pos: str, level: str, deepest: int = 2) -> DataFrame:
    """W2, default restarts: the counter of each level 1.., reset by any shallower row. ``level`` counts from 1."""
    out = df
    for k in range(1, deepest + 1):
        shallower = F.sum(F.when(F.col(level) < k, 1).otherwise(0)).over(in_order(key, pos).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        out = out.withColumn(f"__turn{k}", shallower)
    for k in range(1, deepest + 1):
        w = Window.partitionBy(key, f"__turn{k}").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(f"c{k}", F.sum(F.when(F.col(level) == k, 1).otherwise(0)).over(w).cast("long"))
    return out.drop(*(f"__turn{k}" for k in range(1, deepest + 1)))


def list_labels(df: DataFrame, levels: dict[tuple[int, int], dict]) -> DataFrame:
    """W2, W3 in full: labels of (doc_id, pos, num_id, ilvl) with starts, overrides and restarts, by document in order.

    For the accepted and the rejected view, project the rows first; counters then
    skip what the view has not.
    """
    share_package(df.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        pdf["label"] = labels(list(zip(pdf["num_id"], pdf["ilvl"])), levels)
        return pdf[["doc_id", "pos", "label"]]

    return df.select("doc_id", "pos", "num_id", "ilvl").groupBy("doc_id").applyInPandas(run, "doc_id long, pos int, label string")


def tab_stops(width: int, step: int) -> Column:
    """Default tab stops up to a width."""
    return F.sequence(F.lit(step), F.lit(width), F.lit(step))
