"""Formatting roles, markup and aggregates (A3-A13): counts, shares and exemplars in one shuffle each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Percent of rows from which a role is primary or common, and rows from which it is minor.
PRIMARY, COMMON, MINOR = 20, 5, 3
DOMINANT_SHARE, SNIPPET, SAMPLE = 0.9, 80, 120


def frequency(count: Column, total: Column) -> Column:
    """By whole percent of all rows."""
    percent = F.floor(count * 100 / total)
    return F.when(percent >= PRIMARY, "primary").when(percent >= COMMON, "common").when(count >= MINOR, "minor").otherwise("rare")


def paragraph_roles(blk: DataFrame, signature: list[str], pos: str, text: Column) -> DataFrame:
    """A5: rows by signature, in order of first place; exemplar is the first non-empty snippet."""
    snippet = F.when(F.char_length(text) > 0, F.left(text, F.lit(SNIPPET)))
    groups = blk.withColumn("__snippet", snippet).groupBy(*signature).agg(
        F.count("*").alias("n"), F.min(pos).alias("first_pos"), F.min_by("__snippet", F.when(F.col("__snippet").isNotNull(), F.col(pos))).alias("exemplar")
    )
    # Over the signatures, of which there are few whatever the number of blocks.
    every = Window.partitionBy(F.lit(0))
    total, order = F.sum("n").over(every), F.row_number().over(every.orderBy("first_pos"))
    return groups.select(*signature, "n", "first_pos", "exemplar", frequency(F.col("n"), total).alias("frequency"), (order - 1).cast("long").alias("role_no"))


def heaviest(df: DataFrame, value: str, weight: Column) -> DataFrame:
    """A3: the value with most weight; ties go to the least value."""
    sums = df.groupBy(value).agg(F.sum(weight).alias("weight"))
    return sums.agg(F.max_by(value, F.struct(F.col("weight"), -F.col(value))).alias("value"), F.max("weight").alias("weight"))


def dominant(df: DataFrame, key: str, value: str, share: float = DOMINANT_SHARE) -> DataFrame:
    """A4: the most frequent value of each key if more than ``share`` of all its rows have it."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.sum("n").alias("total"), F.max(F.when(F.col(value).isNotNull(), F.struct(F.col("n"), F.col(value).alias("value")))).alias("top"))
    return best.select(key, F.when(F.col("top.n") > share * F.col("total"), F.col("top.value")).alias("dominant"), "total")


def suffixed(df: DataFrame, base: str, order: str) -> DataFrame:
    """Names made unique: the first keeps its own, later ones get _2, _3.."""
    nth = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return df.withColumn("unique_id", F.when(nth == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), nth)))


def first_of_each(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The first use of each character style."""
    return df.groupBy(key).agg(F.min(order).alias("first_pos"), F.min_by(value, order).alias("first_use"), F.count("*").alias("n"))


def manual_markup(blk: DataFrame, deletion: Column, insertion: Column) -> DataFrame:
    """Hand-made markup of documents: counts, blocks, the first sample; detected from two hits in two blocks."""
    sort = F.when(deletion, "deletion").when(insertion, "insertion")
    hits = blk.withColumn("sort", sort).where("sort is not null")
    return hits.groupBy("doc_id").agg(
        F.count_if(F.col("sort") == "insertion").alias("insertions"),
        F.count_if(F.col("sort") == "deletion").alias("deletions"),
        F.count_distinct("pos").alias("n_blocks"),
        F.min_by(F.left("text", F.lit(SAMPLE)), "pos").alias("sample"),
        ((F.count("*") >= 2) & (F.count_distinct("pos") >= 2)).alias("detected"),
    )


def summary(items: DataFrame, outcome: str) -> DataFrame:
    """A10: totals of a worklist and whether its result may be delivered."""
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(outcome) == "applied").alias("applied"),
        F.count_if(F.col(outcome) != "applied").alias("refused"),
        (F.count_if(F.col(outcome) != "applied") == 0).alias("deliverable"),
    )


def canonical_digest(df: DataFrame, columns: list[str], order: list[str], key: str) -> DataFrame:
    """The SHA-256 of a JSON array of rows with sorted keys, in the given order, by key."""
    names = sorted(columns)
    rows = F.array_sort(F.collect_list(F.struct(*order, F.to_json(F.struct(*names)).alias("json"))))
    text = F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: r["json"]), ","), F.lit("]"))
    return df.groupBy(key).agg(F.sha2(text.cast("binary"), 256).alias("digest"), F.count("*").alias("n"))
