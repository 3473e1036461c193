"""Matching of blocks, revisions and notes between versions (J1-J12, D2, S-rules of pairing).

The reference semantics are one-to-one matchings. Equal keys are paired by their
occurrence number, which is an equi-join after a window; only the increasing run of
anchors and the greedy best match need a sequence kernel, by document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.kernels import content_similarity, increasing
from palimpsest.session import share_package


def content_hash(text: Column) -> Column:
    """The hash by which blocks are the same."""
    return F.sha2(text.cast("binary"), 256)


def unique_anchors(base: DataFrame, target: DataFrame) -> DataFrame:
    """J1 before the order test: blocks whose content occurs once on each side."""

    def once(blk: DataFrame, pos: str) -> DataFrame:
        return blk.groupBy("doc_id", F.xxhash64("text").alias("hash"), "text").agg(F.count("*").alias("n"), F.min("pos").alias(pos)).where("n = 1").drop("n")

    return once(base, "base_pos").join(once(target, "target_pos"), ["doc_id", "hash", "text"]).select("doc_id", "base_pos", "target_pos")


def ordered_anchors(anchors: DataFrame) -> DataFrame:
    """The longest run of anchors that keeps its order on both sides, by document."""
    share_package(anchors.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("base_pos", ignore_index=True)
        return pdf.iloc[increasing(pdf["target_pos"].tolist())]

    return anchors.groupBy("doc_id").applyInPandas(run, anchors.schema)


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The occurrence number within equal keys, which pairs them one to one."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def exact_moves(deleted: DataFrame, inserted: DataFrame) -> DataFrame:
    """A deleted and an inserted block of equal normalised text of at least 20 bytes, first with first."""

    def side(blk: DataFrame, pos: str) -> DataFrame:
        keyed = blk.withColumn("key", F.trim(F.regexp_replace("text", "\\s+", " "))).where(F.octet_length("key") >= T.MOVE_BYTES)
        return numbered(keyed, ["doc_id", "key"], ["pos"]).select("doc_id", "key", "nth", F.col("pos").alias(pos))

    return side(deleted, "from_pos").join(side(inserted, "to_pos"), ["doc_id", "key", "nth"]).select("doc_id", "from_pos", "to_pos", F.octet_length("key").cast("long").alias("n_bytes"))


def consecutive_groups(blk: DataFrame, least: int = 2) -> DataFrame:
    """Runs of adjacent positions as groups of joined text."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    runs = blk.withColumn("island", island).groupBy("doc_id", "island").agg(F.count("*").alias("n"), F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("rows"))
    return runs.where(F.col("n") >= least).select("doc_id", "pos", "n", F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("text"))


def group_moves(deleted: DataFrame, inserted: DataFrame) -> DataFrame:
    """Groups of two and more blocks that moved as one."""
    moved = exact_moves(consecutive_groups(deleted), consecutive_groups(inserted))
    sizes = consecutive_groups(deleted).select("doc_id", F.col("pos").alias("from_pos"), F.col("n").alias("n_blocks"))
    return moved.join(sizes, ["doc_id", "from_pos"])


def unmatched(base: DataFrame, target: DataFrame) -> DataFrame:
    """Blocks of ``base`` beyond the number of equal ones in ``target``: a multiset difference by occurrence."""
    keys = ["doc_id", "text"]
    mine, theirs = numbered(base, keys, ["pos"]), numbered(target, keys, ["pos"]).select(*keys, "nth")
    return mine.join(theirs, [*keys, "nth"], "left_anti").drop("nth")


def census_match(before: DataFrame, after: DataFrame, key: list[str], exact: str, order: str) -> DataFrame:
    """Revisions of two versions, paired one to one by ``key``: equal content first, then what is left, in order.

    Returns key columns, before and after orders, and the disposition: untouched,
    modified, resolved (only before) or new (only after).
    """
    full = [*key, exact]
    one = numbered(before, full, [order]).withColumnRenamed(order, "before")
    two = numbered(after, full, [order]).withColumnRenamed(order, "after")
    same = one.join(two, [*full, "nth"]).select(*key, "before", "after", F.lit("untouched").alias("disposition"))
    rest = ["nth", exact]
    left = numbered(one.join(two.select(*full, "nth"), [*full, "nth"], "left_anti").drop(*rest), key, ["before"])
    right = numbered(two.join(one.select(*full, "nth"), [*full, "nth"], "left_anti").drop(*rest), key, ["after"])
    pairs = left.select(*key, "before", "nth").join(right.select(*key, "after", "nth"), [*key, "nth"], "full")
    kind = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "resolved").otherwise("modified")
    return same.unionByName(pairs.select(*key, "before", "after", kind.alias("disposition")))


def note_pairs(before: DataFrame, after: DataFrame, least: float = 0.90) -> DataFrame:
    """Notes (doc_id, note_id, text): equal ids first, then equal text, then the best similarity above ``least``."""
    share_package(before.sparkSession)
    one, two = before.select("doc_id", F.col("note_id").alias("old"), F.col("text").alias("old_text")), after.select("doc_id", F.col("note_id").alias("new"), F.col("text").alias("new_text"))
    by_id = one.join(two, (one.doc_id == two.doc_id) & (one.old == two.new)).select(one.doc_id, "old", "new", F.when(F.col("old_text") == F.col("new_text"), "same").otherwise("modified").alias("how"))
    one = one.join(by_id, ["doc_id", "old"], "left_anti")
    two = two.join(by_id, ["doc_id", "new"], "left_anti")
    nth1 = F.row_number().over(Window.partitionBy("doc_id", "old_text").orderBy("old"))
    nth2 = F.row_number().over(Window.partitionBy("doc_id", "new_text").orderBy("new"))
    o, t = one.withColumn("nth", nth1), two.withColumn("nth", nth2).withColumnRenamed("new_text", "old_text")
    by_text = o.join(t, ["doc_id", "old_text", "nth"]).select("doc_id", "old", "new", F.lit("renumbered").alias("how"))
    one, two = one.join(by_text, ["doc_id", "old"], "left_anti"), two.join(by_text, ["doc_id", "new"], "left_anti")

    def greedy(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows, used = [], set()
        for old, text in a.sort_values("old")[["old", "old_text"]].itertuples(index=False):
            scored = [(content_similarity(text, t), -n, new) for n, (new, t) in enumerate(b.sort_values("new")[["new", "new_text"]].itertuples(index=False)) if new not in used]
            if scored and max(scored)[0] > least:
                used.add(max(scored)[2])
                rows.append((key[0], old, max(scored)[2], "similar"))
            else:
                rows.append((key[0], old, None, "deleted"))
        rows += [(key[0], None, new, "inserted") for new in b["new"] if new not in used]
        return pd.DataFrame(rows, columns=["doc_id", "old", "new", "how"]).astype({"old": "Int64", "new": "Int64"})

    rest = one.groupBy("doc_id").cogroup(two.groupBy("doc_id")).applyInPandas(greedy, "doc_id long, old long, new long, how string")
    return by_id.unionByName(by_text).unionByName(rest)


def expanded_selection(revisions: DataFrame, authors: list[str], ids: list[int]) -> DataFrame:
    """The revision ids that authors and ids stand for; unknown ones are rows with an error, never dropped."""
    spark = revisions.sparkSession
    asked = spark.createDataFrame([("author", a, None) for a in authors] + [("id", None, i) for i in ids], "how string, author string, revision_id long")
    by_author = asked.where("how = 'author'").select("author").join(revisions.select("author", "revision_id"), "author", "left").select(F.col("author").alias("asked"), "revision_id")
    known = revisions.select(F.col("revision_id").alias("known")).distinct()
    by_id = asked.where("how = 'id'").join(known, F.col("revision_id") == F.col("known"), "left").select(F.col("revision_id").cast("string").alias("asked"), F.col("known").alias("revision_id"))
    return by_author.unionByName(by_id).withColumn("outcome", F.when(F.col("revision_id").isNull(), "unknown").otherwise("ok")).distinct()
