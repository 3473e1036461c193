"""Revised versions of documents by a fixed rule, as targets for comparisons.

The corpus has one version of each document. Comparisons need two, so the second is
made here, in plain expressions that any engine can repeat: every fifth line goes,
every fourth has a word replaced, a clause follows every seventh, and the first line
of longer documents moves to their end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def revised(blk: DataFrame) -> DataFrame:
    """(doc_id, pos, text, base_pos) of the revised documents; base_pos is null for inserted lines."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    sized = blk.withColumn("n", n).where("pos % 5 <> 3")
    text = F.when(F.col("pos") % 4 == 1, F.replace("text", F.lit("the"), F.lit("this"))).otherwise(F.col("text"))
    place = F.when((F.col("pos") == 0) & (F.col("n") >= 6), 2 * F.col("n")).otherwise(2 * F.col("pos")).cast("long")
    own = F.struct(place.alias("place"), text.alias("text"), F.col("pos").alias("base_pos"))
    clause = F.struct((2 * F.col("pos") + 1).cast("long").alias("place"), F.concat(F.lit("Inserted clause "), F.col("pos"), F.lit(" for review.")).alias("text"), F.lit(None).cast("int").alias("base_pos"))
    rows = sized.select("doc_id", F.explode(F.when(F.col("pos") % 7 == 2, F.array(own, clause)).otherwise(F.array(own))).alias("r"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("r.place")) - 1
    return rows.select("doc_id", pos.alias("pos"), F.col("r.text").alias("text"), F.col("r.base_pos").alias("base_pos"))
