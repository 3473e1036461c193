"""Comparison of tables (D21-D25, J4-J6): aligned rows, changes of cells with their words, nested tables, tracked texts.

A table is a row with its rows and cells as arrays, so a pair of tables is one row of
a join and is compared in one Arrow pass, however many tables there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.inline import word_changes
from palimpsest.functions.kernels import match_rows, patience, row_quality
from palimpsest.operators.revisions import survives
from palimpsest.session import share_package

#: Fixed value: the mean likeness of cells under which two matched rows are a deletion and an insertion.
ROW_QUALITY = 0.3

ROWS = "array<struct<row:int,para_id:string,cells:array<struct<col:int,text:string,span:int>>>>"
CELL_CHANGES = "table_id string, old_row int, new_row int, col int, cell_change string, old_text string, new_text string, ops array<struct<op:string,text:string>>"


def gathered(cells: DataFrame, name: str) -> DataFrame:
    """(table_id, name): the rows of each table with their cells. ``cells``: (table_id, row, col, text, span and, if known, para_id of the row)."""
    para = F.col("para_id") if "para_id" in cells.columns else F.lit(None).cast("string")
    row = cells.groupBy(F.col("table_id").cast("string").alias("table_id"), F.col("row").cast("int").alias("row")).agg(
        F.min(para).alias("para_id"), F.array_sort(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), F.coalesce("text", F.lit("")).alias("text"), F.col("span").cast("int").alias("span")))).alias("cells")
    )
    return row.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "para_id", "cells"))).alias(name))


def signature(row: dict) -> str:
    return " | ".join(c["text"] + (f"→{c['span']}" if c["span"] > 1 else "") for c in row["cells"])


def aligned_rows(old: Sequence[dict], new: Sequence[dict]) -> list[tuple[int | None, int | None]]:
    """Places of matched, deleted and inserted rows, in order.

    Rows with one paragraph id that each side has once are the same row; others are
    keyed by their signature. Between equal keys, rows pair by likeness, best first;
    a pair whose cells have little in common is taken apart.
    """
    ids = [Counter(r["para_id"] for r in rows if r["para_id"]) for rows in (old, new)]
    shared = {x for x, n in ids[0].items() if n == 1 and ids[1][x] == 1}

    def key(row: dict) -> tuple:
        return ("id", row["para_id"]) if row["para_id"] in shared else ("text", signature(row))

    out: list[tuple[int | None, int | None]] = []
    gone: list[int] = []
    come: list[int] = []

    def close() -> None:
        pairs = dict(match_rows([signature(old[i]) for i in gone], [signature(new[j]) for j in come]))
        pairs = {gone[i]: come[j] for i, j in pairs.items() if quality(old[gone[i]], new[come[j]]) >= ROW_QUALITY}
        later = iter([*come, None])
        j = next(later)
        for i in gone:
            while i in pairs and j is not None and j != pairs[i]:
                out.append((None, j))
                j = next(later)
            out.append((i, pairs.get(i)))
            if i in pairs:
                j = next(later)
        while j is not None:
            out.append((None, j))
            j = next(later)
        gone.clear()
        come.clear()

    for op, i0, i1, j0, j1 in patience([key(r) for r in old], [key(r) for r in new]):
        if op == "equal":
            close()
            out.extend(zip(range(i0, i1), range(j0, j1)))
        else:
            gone.extend(range(i0, i1))
            come.extend(range(j0, j1))
    close()
    return out


def quality(old: dict, new: dict) -> float:
    a, b = ({c["col"]: c["text"] for c in r["cells"]} for r in (old, new))
    columns = range(max([*a, *b], default=-1) + 1)
    return row_quality([a.get(c) for c in columns], [b.get(c) for c in columns])


def cell_rows(old: Sequence[dict], new: Sequence[dict]) -> Iterator[tuple]:
    """(old row, new row, col, change, old text, new text, ops) of two tables, in order of the alignment."""
    for i, j in aligned_rows(old, new):
        a = {c["col"]: c for c in old[i]["cells"]} if i is not None else {}
        b = {c["col"]: c for c in new[j]["cells"]} if j is not None else {}
        rows = (None if i is None else old[i]["row"], None if j is None else new[j]["row"])
        for col in sorted(a.keys() | b.keys()):
            x, y = a.get(col), b.get(col)
            ops = None
            if y is None:
                kind = "deleted"
            elif x is None:
                kind = "inserted"
            elif x["text"] != y["text"]:
                kind, ops = "modified", [{"op": op, "text": t} for op, t in word_changes(x["text"], y["text"], whole=False)]
            else:
                kind = "merge_changed" if x["span"] != y["span"] else "unchanged"
            yield (*rows, col, kind, x and x["text"], y and y["text"], ops)


def compared(pairs: DataFrame) -> DataFrame:
    """Changes of cells of (table_id, old, new), rows as :func:`gathered` has them; a null side is a table without rows."""
    share_package(pairs.sparkSession)
    fields = [("table_id", pa.string()), ("old_row", pa.int32()), ("new_row", pa.int32()), ("col", pa.int32()), ("cell_change", pa.string()), ("old_text", pa.string()), ("new_text", pa.string())]
    schema = pa.schema([*fields, ("ops", pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *r) for key, old, new in zip(*(c.to_pylist() for c in batch.columns)) for r in cell_rows(old or [], new or [])]
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return pairs.select(F.col("table_id").cast("string").alias("table_id"), "old", "new").mapInArrow(run, CELL_CHANGES)


def of_cells(old: DataFrame, new: DataFrame) -> DataFrame:
    """D21 of two tables of cells."""
    return compared(gathered(old, "old").join(gathered(new, "new"), "table_id", "full"))


def table_changes(cell_changes: DataFrame, old_kinds: DataFrame, new_kinds: DataFrame) -> DataFrame:
    """(table_id, change): structure_changed where a row came or went or where the blocks of a cell are of other kinds; else cells_modified or unchanged.

    ``old_kinds``, ``new_kinds``: (table_id, row, col, kinds), the kinds of a cell's blocks in order; cells without a row there have a paragraph.
    """
    plain = F.lit("paragraph")
    a = old_kinds.select(F.col("table_id").cast("string").alias("table_id"), F.col("row").alias("old_row"), "col", F.col("kinds").alias("old_kinds"))
    b = new_kinds.select(F.col("table_id").cast("string").alias("table_id"), F.col("row").alias("new_row"), "col", F.col("kinds").alias("new_kinds"))
    cells = cell_changes.join(a, ["table_id", "old_row", "col"], "left").join(b, ["table_id", "new_row", "col"], "left")
    unlike = F.coalesce("old_kinds", plain) != F.coalesce("new_kinds", plain)
    one_sided = F.col("old_row").isNull() | F.col("new_row").isNull()
    return cells.groupBy("table_id").agg(
        F.when(F.bool_or(one_sided | unlike | F.col("cell_change").isin("inserted", "deleted")), "structure_changed").when(F.bool_or(F.col("cell_change") != "unchanged"), "cells_modified").otherwise("unchanged").alias("change")
    )


def nested_pairs(cell_changes: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Nested tables (table_id, parent_id, row, col, nth) of two versions, paired where their parents' cells are: (old_table, new_table, change).

    The pairs' cells are compared as those of any tables; deeper ones follow in the same way, a level at a time.
    """
    places = cell_changes.where("old_row is not null and new_row is not null").select(F.col("table_id").alias("parent_id"), "old_row", "new_row", "col")
    a = old.select(F.col("parent_id").cast("string").alias("parent_id"), F.col("row").alias("old_row"), "col", "nth", F.col("table_id").alias("old_table"))
    b = new.select(F.col("parent_id").cast("string").alias("parent_id"), F.col("row").alias("new_row"), "col", "nth", F.col("table_id").alias("new_table"))
    both = a.join(places, ["parent_id", "old_row", "col"], "left").join(b, ["parent_id", "new_row", "col", "nth"], "full")
    kind = F.when(F.col("old_table").isNull(), "inserted").when(F.col("new_table").isNull(), "deleted").otherwise("paired")
    return both.select("old_table", "new_table", kind.alias("change"))


def tracked_texts(segments: DataFrame) -> DataFrame:
    """The old and the new text of tracked tables: (table_id, old_text, new_text). ``segments``: (table_id, row, col, block, seq, text, has_ins, has_del),
    a segment being inserted or deleted if its row is."""

    def joined(accept: bool) -> Column:
        keep = survives(F.col("has_ins"), F.col("has_del"), accept)
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("seq", "text")))), lambda s: s["text"]), "")

    paragraphs = segments.groupBy("table_id", "row", "col", "block").agg(joined(False).alias("old"), joined(True).alias("new"))

    def of(side: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.trim(side) != "", F.struct("row", "col", "block", F.col(side).alias("text")))))
        return F.array_join(F.transform(rows, lambda r: r["text"]), " ")

    return paragraphs.groupBy("table_id").agg(of("old").alias("old_text"), of("new").alias("new_text"))
