"""Logical grids of tables (G1-G4, R11, J4): addresses, spans, widths and signatures by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def addressed(cells: DataFrame) -> DataFrame:
    """G1: physical cells (table_id, row, cell, grid_span) get their first column: what stands before them in the row."""
    before = Window.partitionBy("table_id", "row").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("col", F.coalesce(F.sum("grid_span").over(before), F.lit(0)).cast("long"))


def grid_width(cells: DataFrame) -> DataFrame:
    """The widest row of each table."""
    rows = cells.groupBy("table_id", "row").agg(F.sum("grid_span").alias("width"))
    return rows.groupBy("table_id").agg(F.max("width").alias("width"), F.count("*").alias("n_rows"))


def occupied(cells: DataFrame) -> DataFrame:
    """Every grid place with the cell that owns it."""
    placed = addressed(cells)
    return placed.select("table_id", "row", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("grid_span") - 1)).alias("col"), F.col("cell").alias("owner"), F.col("col").alias("anchor_col"))


def vertical_merges(cells: DataFrame) -> DataFrame:
    """G1: cells with merge = start or continue; row spans, and orphans that continue nothing."""
    w = Window.partitionBy("table_id", "col").orderBy("row")
    start = F.sum(F.when(F.coalesce("merge", F.lit("")) == "continue", 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    grouped = cells.withColumn("run", start).groupBy("table_id", "col", "run").agg(F.min("row").alias("row"), F.count("*").alias("row_span"), F.min_by("merge", "row").alias("first"))
    return grouped.select("table_id", "row", "col", "row_span", (F.coalesce("first", F.lit("")) == "continue").alias("orphan"))


def row_signature(cells: DataFrame) -> DataFrame:
    """A row's cells in order, with arrows for spans."""
    text = F.concat(F.col("text"), F.when(F.col("grid_span") > 1, F.concat(F.lit("→"), F.col("grid_span"))).otherwise(""))
    rows = F.array_sort(F.collect_list(F.struct("cell", text.alias("text"))))
    return cells.groupBy("table_id", "row").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " | ").alias("signature"))


def table_text(cells: DataFrame) -> DataFrame:
    """Cells parted by tabs, rows by line ends."""
    row = F.array_sort(F.collect_list(F.struct("cell", "text")))
    lines = cells.groupBy("table_id", "row").agg(F.array_join(F.transform(row, lambda r: r["text"]), "\t").alias("line"))
    table = F.array_sort(F.collect_list(F.struct("row", "line")))
    return lines.groupBy("table_id").agg(F.array_join(F.transform(table, lambda r: r["line"]), "\n").alias("text"))
