"""Arriving documents as a stream, an extension: each micro-batch is audited and appended.

Files of documents that land in a folder are read once. A batch's blocks are counted
and guarded as in the batch operators; the running outline totals by source are kept
by Structured Streaming, so a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import blocks

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def arriving(spark: SparkSession, folder: str, schema: str = DOCUMENTS, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def running_totals(stream: DataFrame) -> DataFrame:
    """Blocks and characters by source, updated with each batch; state is a row per source."""
    return blocks.blocks(stream.select(F.struct("source", "doc_id").alias("doc_id"), "text")).groupBy("doc_id.source").agg(F.count("*").alias("n_blocks"), F.sum(F.char_length("text").cast("long")).alias("n_chars"))


def matched_lines(stream: DataFrame, patterns: list[str]) -> DataFrame:
    """Blocks that hold one of the patterns, as they arrive; stateless."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.contains("text", F.lit(p))
    return blocks.blocks(stream).where(hit)


def each_batch(stream: DataFrame, audit: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Writes ``audit`` of each micro-batch under its number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        audit(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
