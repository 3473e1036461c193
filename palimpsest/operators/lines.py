"""Operators over documents whose lines are still in one row.

A document arrives as one row, and its lines are an array of that row. What needs one
document at a time is then an expression over the array: no text is shuffled, and
rows are made last. The operators of :mod:`blocks` and :mod:`update` do the same for
tables that arrive as blocks; tests hold the two against each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import blocks, update
from palimpsest.session import share_package


def spread(documents: DataFrame) -> DataFrame:
    """A scan of fewer pieces than there are cores, dealt to all of them, for comparisons that cost far more than a shuffle; others as they are."""
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return documents if documents.rdd.getNumPartitions() >= cores else documents.repartition(cores)


def with_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, lines) of documents that have a text."""
    return documents.where(F.col("text").isNotNull()).select("doc_id", F.split("text", "\n").alias("lines"))


def plain_text(documents: DataFrame) -> DataFrame:
    """R2: lines parted by an empty line."""
    return with_lines(documents).select("doc_id", F.array_join("lines", "\n\n").alias("plain"))


def outline_totals(documents: DataFrame) -> DataFrame:
    """A row per row, so a document that comes in several rows has several."""
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    return with_lines(documents).select("doc_id", F.size("lines").cast("long").alias("n_blocks"), chars.alias("n_chars"))


def outline(documents: DataFrame) -> DataFrame:
    """W1, R6. Depths are laid out section by section: each heading's level as often as its section has lines."""
    levels = F.transform("lines", blocks.heading_level)
    heads = F.filter(F.transform("levels", lambda v, i: F.when(v.isNotNull(), i)), lambda i: i.isNotNull())
    starts = F.concat(F.array(F.lit(0)), F.col("heads"), F.array(F.size("lines")))
    # Of a place and the next one: the level there, once for each line between.
    sections = F.transform(F.sequence(F.lit(0), F.size("heads")), lambda k: F.array_repeat(F.when(k == 0, 0).otherwise(F.get("levels", F.get("starts", k))), F.get("starts", k + 1) - F.get("starts", k)))
    rows = with_lines(documents).withColumn("levels", levels).withColumn("heads", heads).withColumn("starts", starts)
    flat = rows.select("doc_id", F.posexplode(F.arrays_zip("lines", "levels", F.flatten(sections).alias("depths"))).alias("pos", "b"))
    level, text = F.col("b.levels"), F.col("b.lines")
    return flat.select(
        "doc_id",
        "pos",
        F.when(level.isNull(), "body").otherwise(F.concat(F.lit("heading"), level)).alias("role"),
        F.col("b.depths").alias("depth"),
        F.left(text, F.lit(T.PREVIEW_CHARS)).alias("preview"),
        F.char_length(text).cast("long").alias("char_len"),
        F.octet_length(text).cast("long").alias("byte_len"),
    )


def window(documents: DataFrame, first: int, last: int) -> DataFrame:
    """R8."""
    if first > last:
        raise ValueError("reversed range")
    none = F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("text"))
    held = F.transform(F.slice("lines", first + 1, last - first + 1), lambda x, i: F.struct((i + first).alias("pos"), x.alias("text")))
    ok = F.size("lines") > last
    rows = with_lines(documents).select("doc_id", F.when(ok, "ok").otherwise("invalid_range").alias("outcome"), F.explode(F.when(ok, held).otherwise(F.array(none))).alias("b"))
    return rows.select("doc_id", "b.pos", "b.text", "outcome")


def pages(documents: DataFrame, offset: int, rows: int = blocks.PAGE_ROWS) -> DataFrame:
    """R9."""
    if not 0 < rows <= blocks.PAGE_MOST:
        raise ValueError(f"1 to {blocks.PAGE_MOST} rows")
    more = F.size("lines") > offset + rows
    flat = with_lines(documents).select("doc_id", more.alias("has_more"), F.posexplode(F.slice("lines", offset + 1, rows)).alias("at", "text"))
    return flat.select("doc_id", (F.col("at") + offset).alias("pos"), "text", "has_more", F.when(F.col("has_more"), F.lit(offset + rows)).cast("long").alias("next_offset"))


def replace_gated(documents: DataFrame, item: update.Item) -> DataFrame:
    """The census is a sum over the row's array; the text is changed only where it matches and the gate is passed."""
    n, after = update.matches(item)
    counts = F.transform("lines", n)
    found = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = with_lines(documents).withColumn("counts", counts).withColumn("found", found)
    zipped = F.transform(F.arrays_zip("lines", "counts"), lambda b, i: F.struct(i.alias("pos"), b["lines"].alias("text"), b["counts"].alias("n")))
    hit = F.filter(zipped, lambda b: (b["n"] > 0) | ((F.col("found") == 0) & (b["pos"] == 0)))
    flat = rows.select("doc_id", "found", F.explode(hit).alias("b")).withColumn("outcome", update.gate(F.col("found"), item))
    new = F.when(F.col("outcome") == "applied", after(F.col("b.text")))
    return flat.select("doc_id", "b.pos", F.col("found").alias("n_found"), "outcome", new.alias("new_text"), F.when(F.col("b.n") > 0, T.excerpt(F.col("b.text"), item.old)).alias("excerpt"))


def straddling(documents: DataFrame, needle: str) -> DataFrame:
    """Documents where the text stands across lines but in none of them."""
    across = T.occurrences(F.array_join("lines", ""), needle)
    inside = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + T.occurrences(x, needle))
    return with_lines(documents).select("doc_id", across.alias("across"), inside.alias("inside")).where("across > inside")


def diagnosis(documents: DataFrame, item: update.Item, scope_last: int) -> DataFrame:
    """U4: see :func:`update.diagnosis`."""
    inside, outside = F.slice("lines", 1, scope_last + 1), F.slice("lines", scope_last + 2, F.greatest(F.size("lines"), F.lit(1)))
    bare = update.without_label(item.old)

    def some(lines: Column, needle: Column, shaped=lambda x: x) -> Column:
        return F.exists(lines, lambda x: F.contains(shaped(x), needle))

    old = F.lit(item.old)
    why = (
        F.when(some(inside, F.lit(item.new)), "already_applied")
        .when(some(outside, old), "out_of_scope")
        .when(some(inside, T.fold(old), T.fold), "normalize_ws_matches")
        .when(some(inside, F.lit(bare)) & F.lit(bare != item.old), "label_strip_matches")
        .when(F.contains(F.array_join(inside, ""), old), "wall_straddle")
        .otherwise("no_candidate")
    )
    return with_lines(documents).where(~some(inside, old)).select("doc_id", why.alias("diagnosis"))


def apply_worklist(documents: DataFrame, items: list[update.Item]) -> DataFrame:
    """See :func:`update.apply_worklist`; a fold over each row's array."""
    update.checked(items)
    share_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield update.outcome_batch([(doc, *r) for doc, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in update.folded(lines, items)])

    return with_lines(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "lines").mapInArrow(run, update.OUTCOMES)


def revised_pairs(documents: DataFrame) -> DataFrame:
    """(doc_id, old, new): the lines of both versions, by the rule of :func:`palimpsest.operators.versions.revised`."""
    n, text = F.size("lines"), lambda i: F.get("lines", i)

    def rows(i: Column) -> Column:
        place = F.when((i == 0) & (n >= 6), 2 * n).otherwise(2 * i)
        own = F.struct(place.alias("place"), F.when(i % 4 == 1, F.replace(text(i), F.lit("the"), F.lit("this"))).otherwise(text(i)).alias("text"))
        clause = F.struct((2 * i + 1).alias("place"), F.concat(F.lit("Inserted clause "), i, F.lit(" for review.")).alias("text"))
        return F.when(i % 5 == 3, F.array().cast("array<struct<place:int,text:string>>")).when(i % 7 == 2, F.array(own, clause)).otherwise(F.array(own))

    new = F.transform(F.array_sort(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), rows))), lambda r: r["text"])
    return with_lines(documents).select("doc_id", F.col("lines").alias("old"), new.alias("new"))
