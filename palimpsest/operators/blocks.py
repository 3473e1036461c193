"""Blocks of documents and reads over them (R1-R13, R20-R25, A14, IO10, IO15).

A block is a line of a text. ``blocks`` is the one place where texts are split;
everything else is projections, windows over a document, and joins on positions.
Document order is data: every table carries ``pos``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.session import share_package

#: Rows of a page by default and at most, patterns of a search at most.
PAGE_ROWS, PAGE_MOST, PATTERNS_MOST = 16, 64, 8
#: Words that a worker lays out at once; a longer block is laid out whole.
WORDS_AT_ONCE = 100_000


def so_far():
    """A document's blocks up to this one."""
    return Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, text), a row per line; a null text has no block."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))


def heading_level(text: Column | None = None) -> Column:
    """The level of a heading, null for body text. Plain text has no styles, so short lines stand for headings."""
    text = F.col("text") if text is None else text
    n = T.n_words(text)
    return F.when((F.char_length(text) == 0) | (n > 5), F.lit(None).cast("int")).when(n <= 2, 1).otherwise(2)


def outline(blk: DataFrame) -> DataFrame:
    """A row per block; its depth is the level of the nearest heading at or before it, else 0."""
    level = heading_level()
    return blk.withColumn("level", level).select(
        "doc_id",
        "pos",
        F.when(F.col("level").isNull(), "body").otherwise(F.concat(F.lit("heading"), F.col("level"))).alias("role"),
        F.coalesce(F.last("level", ignorenulls=True).over(so_far()), F.lit(0)).cast("int").alias("depth"),
        F.left("text", F.lit(T.PREVIEW_CHARS)).alias("preview"),
        F.char_length("text").cast("long").alias("char_len"),
        F.octet_length("text").cast("long").alias("byte_len"),
    )


def outline_totals(blk: DataFrame) -> DataFrame:
    """Blocks and characters of each document; partial sums, one shuffle of a row per document and task."""
    return blk.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.char_length("text").cast("long")).alias("n_chars"))


def plain_text(blk: DataFrame) -> DataFrame:
    """R2: blocks parted by an empty line, in order, whatever partitions they came from."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return blk.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("plain"))


def find(blk: DataFrame, patterns: list[str]) -> DataFrame:
    """Matches and matching blocks of each pattern; those without a match have a row too.

    One pass: each block yields its counts as an array, which is summed by pattern,
    so the text is never joined with the patterns.
    """
    if not 0 < len(patterns) <= PATTERNS_MOST:
        raise ValueError(f"1 to {PATTERNS_MOST} patterns")
    counts = F.array(*(F.struct(F.lit(p).alias("pattern"), T.occurrences(F.col("text"), p).alias("n")) for p in patterns))
    each = blk.select("doc_id", F.explode(counts).alias("c"))
    found = each.groupBy("c.pattern").agg(
        F.sum("c.n").cast("long").alias("n_matches"), F.count_if(F.col("c.n") > 0).alias("n_blocks"), F.count_distinct(F.when(F.col("c.n") > 0, F.col("doc_id"))).alias("n_docs")
    )
    known = blk.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
    zero = F.lit(0).cast("long")
    return known.join(found, "pattern", "left").select("pattern", *(F.coalesce(c, zero).alias(c) for c in ("n_matches", "n_blocks", "n_docs")))


def excerpts(blk: DataFrame, pattern: str) -> DataFrame:
    """Matching blocks with the first match in its surroundings."""
    return blk.where(F.contains("text", F.lit(pattern))).select("doc_id", "pos", T.occurrences(F.col("text"), pattern).alias("n_matches"), T.excerpt(F.col("text"), pattern).alias("excerpt"))


def whole_words(blk: DataFrame, word: str) -> DataFrame:
    """blocks that have the word as a whole, in any case."""
    return blk.where(F.col("text").rlike(T.whole_word(word))).select("doc_id", "pos")


def window(blk: DataFrame, first: int, last: int) -> DataFrame:
    """Blocks first..last of every document. A reversed range, or one past the end, is an outcome, not an empty result."""
    if first > last:
        raise ValueError("reversed range")
    sizes = blk.groupBy("doc_id").agg(F.count("*").alias("n_blocks"))
    held = blk.where(F.col("pos").between(first, last))
    return (
        sizes.join(held, "doc_id", "left")
        .withColumn("outcome", F.when(F.col("n_blocks") > last, "ok").otherwise("invalid_range"))
        .where((F.col("outcome") == "ok") | (F.coalesce("pos", F.lit(first)) == first))
        .select("doc_id", F.when(F.col("outcome") == "ok", F.col("pos")).alias("pos"), F.when(F.col("outcome") == "ok", F.col("text")).alias("text"), "outcome")
    )


def pages(blk: DataFrame, offset: int, rows: int = PAGE_ROWS) -> DataFrame:
    """Rows offset.. of every document, with has_more and next_offset. Positions are gapless, so no sort is needed."""
    if not 0 < rows <= PAGE_MOST:
        raise ValueError(f"1 to {PAGE_MOST} rows")
    sizes = blk.groupBy("doc_id").agg(F.count("*").alias("n"))
    more = F.col("n") > offset + rows
    return blk.where(F.col("pos").between(offset, offset + rows - 1)).join(sizes, "doc_id").select("doc_id", "pos", "text", more.alias("has_more"), F.when(more, F.lit(offset + rows)).cast("long").alias("next_offset"))


def section_of(blk: DataFrame, heading: int) -> DataFrame:
    """The heading'th heading of each document and what follows, up to a heading of its level or above."""
    marked = blk.withColumn("level", heading_level()).withColumn("nth", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(so_far()))
    own = F.max(F.when((F.col("nth") == heading) & F.col("level").isNotNull(), F.col("level"))).over(so_far())
    after = marked.where(F.col("nth") >= heading).withColumn("own", own)
    ends = F.sum(F.when((F.col("nth") > heading) & (F.col("level") <= F.col("own")), 1).otherwise(0)).over(so_far())
    return after.withColumn("ends", ends).where("ends = 0").select("doc_id", "pos", "text")


def cut_by_words(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with about ``most`` words in all; a longer row is a run of its own."""
    at = np.cumsum(counts) // most
    edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(counts)]
    yield from ((a, z) for a, z in zip(edges, edges[1:]) if a < z)


def span_handles(blk: DataFrame) -> DataFrame:
    """Dense handles s_0.. of a block's words, with offsets.

    A word begins where the words and gaps before it end: one running sum over the
    words of a batch, without a shuffle, and no row carries its block along.
    """
    share_package(blk.sparkSession)
    gaps = F.transform(F.split("text", T.WORD, -1), lambda g: F.char_length(g))
    rows = blk.where("text is not null").select("doc_id", "pos", F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0)).alias("words"), gaps.alias("gaps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column("words").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            for first, end in cut_by_words(counts, WORDS_AT_ONCE):
                some, n = batch.slice(first, end - first), counts[first:end]
                words, begins = some.column("words").flatten(), np.cumsum(n) - n
                row = np.repeat(np.arange(len(n)), n)
                nth = np.arange(len(row)) - begins[row]
                # A block has a gap before each word and one after the last.
                before = some.column("gaps").flatten().to_numpy(zero_copy_only=False)[np.arange(len(row)) + row]
                length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
                ends = np.cumsum(before.astype(np.int64) + length)
                of_rows = np.concatenate([[0], ends])[begins]
                columns = [some.column("doc_id").take(pa.array(row)), some.column("pos").take(pa.array(row)), pa.array(nth), pa.array(ends - length - of_rows[row]), words]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pos", "nth", "start", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in blk.schema}
    spans = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, pos {kinds['pos']}, nth long, start long, text string")
    return spans.select("doc_id", "pos", F.concat(F.lit("s_"), F.col("nth")).alias("handle"), "start", "text")


def markdown(blk: DataFrame) -> DataFrame:
    """Each block as extended markdown and as HTML."""
    level = heading_level()
    marks = F.when(level.isNull(), "").otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" ")))
    safe = T.escaped_html(F.col("text"))
    tag = F.when(level.isNull(), "p").otherwise(F.concat(F.lit("h"), level))
    return blk.select("doc_id", "pos", F.concat(marks, F.col("text")).alias("markdown"), F.concat(F.lit("<"), tag, F.lit(">"), safe, F.lit("</"), tag, F.lit(">")).alias("html"))


def identity(documents: DataFrame) -> DataFrame:
    """IO10, IO15: digest, length and data URI of the bytes of each text."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    encoded = F.translate(F.base64(data), "\r\n", "")  # Spark breaks it into lines of 76
    return documents.select("doc_id", F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("bytes"), F.concat(F.lit("data:text/plain;base64,"), encoded).alias("data_uri"))
