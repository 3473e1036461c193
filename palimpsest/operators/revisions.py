"""Revision semantics over tracked segments.

A segment has ``has_ins`` and ``has_del``; both together are the stacked state,
inserted and then deleted. Accepting and rejecting are one projection each, and a
selection is an equi-join; nothing here iterates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status(has_ins: Column, has_del: Column) -> Column:
    """The four states as one letter: n(ormal), i(nserted), d(eleted), s(tacked)."""
    return F.when(has_ins & has_del, "s").when(has_ins, "i").when(has_del, "d").otherwise("n")


def survives(has_ins: Column, has_del: Column, accept: bool) -> Column:
    """M1: accepting keeps insertions, rejecting keeps deletions; stacked ones go either way."""
    return ~has_del if accept else ~has_ins & has_del | ~has_ins & ~has_del


def projected(segments: DataFrame, accept: bool) -> DataFrame:
    """The segments that stay when all is accepted, or all rejected."""
    return segments.where(survives(F.col("has_ins"), F.col("has_del"), accept))


def projected_text(segments: DataFrame, accept: bool, sep: str = " ") -> DataFrame:
    """The text of either projection; documents of which nothing stays keep a row."""
    held = F.when(survives(F.col("has_ins"), F.col("has_del"), accept), F.struct("pos", "text"))
    ordered = F.array_sort(F.collect_list(held))
    return segments.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s["text"]), sep).alias("plain"), F.count(held).alias("n_kept"))


def part_counts(revisions: DataFrame, document: str, part: str, kind: str) -> DataFrame:
    """A1: revisions of each part and, in the same pass, of each document (null part)."""
    return revisions.rollup(document, part).agg(F.count("*").alias("n"), F.count_distinct(kind).alias("kinds")).where(F.col(document).isNotNull())


def joined_marks(blk: DataFrame, removed: Column, props: str, marker: Column | None = None) -> DataFrame:
    """M2, M7: a block whose mark is resolved away merges into the following one, whose properties win.

    Rows of ``marker`` have no width: joins step over them (M3), and they are in no group.
    """
    if marker is not None:
        blk = blk.where(~F.coalesce(marker, F.lit(False)))
    before = F.coalesce(F.lag(removed).over(Window.partitionBy("doc_id").orderBy("pos")), F.lit(False))
    group = F.sum(F.when(before, 0).otherwise(1)).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return blk.withColumn("group_no", group).groupBy("doc_id", "group_no").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), F.max_by(props, "pos").alias("props"), F.count("*").alias("n_joined")
    )


def resolved(segments: DataFrame, selection: DataFrame, action: str) -> DataFrame:
    """M8, M9: resolves the selected revisions; the others stay as they are.

    ``selection``: (revision_id); ``segments`` carry ins_id and del_id. Of a
    stacked segment, accepting the insertion leaves a deletion, rejecting it drops
    the segment; accepting the deletion drops it, rejecting it leaves an insertion.
    """
    ids = selection.select("revision_id").distinct()
    out = segments.join(ids.withColumnRenamed("revision_id", "ins_id").withColumn("__ins", F.lit(True)), "ins_id", "left")
    out = out.join(ids.withColumnRenamed("revision_id", "del_id").withColumn("__del", F.lit(True)), "del_id", "left")
    ins, gone = F.col("has_ins") & F.coalesce("__ins", F.lit(False)), F.col("has_del") & F.coalesce("__del", F.lit(False))
    if action == "accept":
        drop, clear_ins, clear_del = gone, ins, F.lit(False)
    elif action == "reject":
        drop, clear_ins, clear_del = ins, F.lit(False), gone
    else:
        raise ValueError(action)
    out = out.where(~drop).withColumn("has_ins", F.col("has_ins") & ~clear_ins).withColumn("has_del", F.col("has_del") & ~clear_del)
    return out.select(*segments.columns)


def mixed_plan(segments: DataFrame, accepts: DataFrame, rejects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments after, refusals). Accepts come first, then rejects, whose ids must still be there.

    A plan is refused as a whole for a document in which it names an id for both, an
    id that the document has not, or a reject that the accepts have already settled:
    the document's segments stay as they were, and each such id is a row with its
    code. ``accepts``, ``rejects``: (doc_id, revision_id).
    """
    sides = segments.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("has_ins"), F.col("ins_id")), F.when(F.col("has_del"), F.col("del_id"))))).alias("revision_id"))
    known = sides.distinct().withColumn("known", F.lit(True))
    a = accepts.select("doc_id", "revision_id").distinct().withColumn("a", F.lit(True))
    r = rejects.select("doc_id", "revision_id").distinct().withColumn("r", F.lit(True))
    keys = ["doc_id", "revision_id"]
    named = a.join(r, keys, "full").join(known, keys, "left")
    # An insertion that goes with an accepted deletion of the same segment cannot be rejected after it.
    gone = segments.where("has_ins and has_del").join(a.select("doc_id", F.col("revision_id").alias("del_id")), ["doc_id", "del_id"], "left_semi").select("doc_id", F.col("ins_id").alias("revision_id"))
    left = segments.join(a.select("doc_id", F.col("revision_id").alias("del_id")), ["doc_id", "del_id"], "left_anti")
    still = left.select("doc_id", F.explode(F.array_compact(F.array(F.when(F.col("has_ins"), F.col("ins_id")), F.when(F.col("has_del"), F.col("del_id"))))).alias("revision_id")).distinct()
    settled = gone.distinct().join(still, keys, "left_anti").withColumn("settled", F.lit(True))
    code = F.when(F.col("a") & F.col("r"), "contradiction").when(F.col("known").isNull(), "unknown").when(F.col("r") & F.col("settled"), "settled_by_accept")
    refused = named.join(settled, keys, "left").withColumn("code", code).where("code is not null").select("doc_id", "revision_id", "code")
    bad = refused.select("doc_id").distinct()
    live = segments.join(bad, "doc_id", "left_anti")
    after = resolved(live, a.join(bad, "doc_id", "left_anti"), "accept")
    done = resolved(after, r.join(bad, "doc_id", "left_anti"), "reject")
    out = done.unionByName(segments.join(bad, "doc_id", "left_semi").select(*segments.columns))
    return out.withColumn("status", status(F.col("has_ins"), F.col("has_del"))), refused


def changed_blocks(revisions: DataFrame) -> DataFrame:
    """The blocks that revisions touch, each once and in order."""
    return revisions.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("blocks"))


def plan_sets(known: DataFrame, accepts: DataFrame, rejects: DataFrame) -> DataFrame:
    """Every known id with what the plan does: accept, reject, contradiction or leave; unknown ids are rows too."""
    flag = F.lit(True)
    rows = known.select("revision_id", flag.alias("known")).join(accepts.select("revision_id", flag.alias("a")), "revision_id", "full").join(rejects.select("revision_id", flag.alias("r")), "revision_id", "full")
    what = F.when(F.col("known").isNull(), "unknown").when(F.col("a") & F.col("r"), "contradiction").when(F.col("a"), "accept").when(F.col("r"), "reject").otherwise("leave")
    return rows.select("revision_id", what.alias("disposal"))


def created_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that only one side has."""
    flag = F.lit(1)
    rows = before.select("revision_id", flag.alias("b")).distinct().join(after.select("revision_id", flag.alias("a")).distinct(), "revision_id", "full")
    return rows.where("a is null or b is null").select("revision_id", F.when(F.col("b").isNull(), "created").otherwise("gone").alias("side"))


def emptied_tables(rows: DataFrame, accept: bool) -> DataFrame:
    """M4: tables that had rows of which none stays."""
    stays = survives(F.col("has_ins"), F.col("has_del"), accept)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.count_if(stays).alias("n_kept")).where("n_rows > 0 and n_kept = 0")


def restored_properties(rows: DataFrame, accept: bool) -> DataFrame:
    """M6: the current properties when accepted, the previous ones, where some were kept, when rejected."""
    return rows.withColumn("props", F.col("props") if accept else F.coalesce("previous_props", "props"))


def census(revisions: DataFrame, signature: list[str]) -> DataFrame:
    """A stable id of content: a hash of the signature and the ordinal among equal ones. 0 is never an id."""
    nth = F.row_number().over(Window.partitionBy(*signature).orderBy("pos"))
    return revisions.withColumn("ordinal", nth).withColumn("revision_key", F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in signature), F.col("ordinal").cast("string")).cast("binary"), 256))


def unreferenced(notes: DataFrame, references: DataFrame) -> DataFrame:
    """Notes that something refers to; the others are pruned."""
    return notes.join(references.select("note_id").distinct(), "note_id", "left_semi")


def torn_ranges(markers: DataFrame) -> DataFrame:
    """Range markers (range_id, side) of which one side is missing."""
    return markers.groupBy("range_id").agg(F.count_if(F.col("side") == "start").alias("starts"), F.count_if(F.col("side") == "end").alias("ends")).where("starts <> ends")


def whole_moves(selection: DataFrame, moves: DataFrame) -> DataFrame:
    """A selection grown to all revisions of the moves that it touches."""
    touched = moves.join(selection, "revision_id", "left_semi").select("move_id").distinct()
    return selection.select("revision_id").union(moves.join(touched, "move_id").select("revision_id")).distinct()
