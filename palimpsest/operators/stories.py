"""Stories and opaque content.

Headers, footers, notes and text boxes are blocks with a story beside the document.
They pair by the sections that use them, then by content, then by likeness.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.kernels import content_similarity
from palimpsest.operators import diffing
from palimpsest.session import share_package


def slot_keys(references: DataFrame) -> DataFrame:
    """A story's key: the sections and kinds that refer to it, in order. ``references``: (doc_id, story_id, section, kind)."""
    slots = F.sort_array(F.collect_set(F.struct("section", "kind")))
    return references.groupBy("doc_id", "story_id").agg(F.array_join(F.transform(slots, lambda s: F.concat_ws(":", s["section"], s["kind"])), ",").alias("slot"))


def paired_by_slot(before: DataFrame, after: DataFrame) -> DataFrame:
    """Stories of equal slot keys, first with first; the others one-sided."""

    def side(refs: DataFrame, name: str) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("doc_id", "slot").orderBy("story_id"))
        return slot_keys(refs).withColumn("nth", nth).withColumnRenamed("story_id", name)

    return side(before, "old").join(side(after, "new"), ["doc_id", "slot", "nth"], "full").select("doc_id", "slot", "old", "new")


def paired_by_likeness(before: DataFrame, after: DataFrame) -> DataFrame:
    """Stories (doc_id, story_id, text): equal texts first, then the likest ones, whatever the likeness; the earliest wins ties."""
    share_package(before.sparkSession)

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("story_id"), b.sort_values("story_id")
        rows, free = [], list(zip(b["story_id"], b["text"]))
        rest = []
        for old, text in zip(a["story_id"], a["text"]):
            same = next((n for n, t in free if t == text), None)
            if same is None:
                rest.append((old, text))
            else:
                rows.append((key[0], old, same, "equal"))
                free = [f for f in free if f[0] != same]
        for old, text in rest:
            if not free:
                rows.append((key[0], old, None, "deleted"))
                continue
            best = max(range(len(free)), key=lambda n: (content_similarity(text, free[n][1]), -n))
            rows.append((key[0], old, free.pop(best)[0], "modified"))
        rows += [(key[0], None, n, "inserted") for n, _ in free]
        return pd.DataFrame(rows, columns=["doc_id", "old", "new", "how"]).astype({"old": "Int64", "new": "Int64"})

    one, two = (df.select(*(F.col(c).alias(c) for c in ("doc_id", "story_id", "text"))) for df in (before, after))
    return one.groupBy("doc_id").cogroup(two.groupBy("doc_id")).applyInPandas(run, "doc_id long, old long, new long, how string")


def compared_stories(before_refs: DataFrame, after_refs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, old, new, change, changes): stories of two versions paired by slot, and by likeness where no slot fits, with their lines compared.

    ``before_refs``, ``after_refs``: (doc_id, story_id, section, kind); ``before``, ``after``: (doc_id, story_id, text).
    """
    slots = paired_by_slot(before_refs, after_refs).select("doc_id", "old", "new")
    sure = slots.where("old is not null and new is not null")
    one = before.join(sure.select("doc_id", F.col("old").alias("story_id")), ["doc_id", "story_id"], "left_anti")
    two = after.join(sure.select("doc_id", F.col("new").alias("story_id")), ["doc_id", "story_id"], "left_anti")
    pairs = sure.unionByName(paired_by_likeness(one, two).select("doc_id", "old", "new"))
    texts = pairs.join(before.select("doc_id", F.col("story_id").alias("old"), F.col("text").alias("a")), ["doc_id", "old"], "left").join(after.select("doc_id", F.col("story_id").alias("new"), F.col("text").alias("b")), ["doc_id", "new"], "left")
    kind = F.when(F.col("old").isNull(), "inserted").when(F.col("new").isNull(), "deleted").when(F.col("a").eqNullSafe(F.col("b")), "matched").otherwise("modified")
    rows = texts.withColumn("change", kind).withColumn("key", F.xxhash64("doc_id", "old", "new"))
    changed = diffing.compared(rows.where("change = 'modified'").select(F.col("key").alias("doc_id"), F.split(F.coalesce("a", F.lit("")), "\n").alias("old"), F.split(F.coalesce("b", F.lit("")), "\n").alias("new")))
    return rows.join(changed.withColumnRenamed("doc_id", "key"), "key", "left").select("doc_id", "old", "new", "change", "changes")


def paired_replacements(changes: DataFrame, alike: Column) -> DataFrame:
    """A deletion followed by an insertion of a like sort (as of equations) is one modification."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    kind = F.col("change_type")
    first = (kind == "deleted") & (F.lead("change_type").over(w) == "inserted") & alike & F.lead(alike).over(w)
    rows = changes.withColumn("first", F.coalesce(first, F.lit(False))).withColumn("next_text", F.lead("new_text").over(w)).withColumn("next_pos", F.lead("target_pos").over(w))
    rows = rows.withColumn("second", F.coalesce(F.lag("first").over(w), F.lit(False)))
    return rows.where(~F.col("second")).select(
        "doc_id",
        "seq",
        F.when(F.col("first"), "modified").otherwise(kind).alias("change_type"),
        "base_pos",
        F.when(F.col("first"), F.col("next_pos")).otherwise(F.col("target_pos")).alias("target_pos"),
        "old_text",
        F.when(F.col("first"), F.col("next_text")).otherwise(F.col("new_text")).alias("new_text"),
    )


def opaque_changes(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Opaque content (keys, content_hash, width, height, alt) that came, went, or changed in content, size or description."""
    a = before.select(*keys, *(F.col(c).alias(f"l_{c}") for c in ("content_hash", "width", "height", "alt")), F.lit(1).alias("in_l"))
    b = after.select(*keys, *(F.col(c).alias(f"r_{c}") for c in ("content_hash", "width", "height", "alt")), F.lit(1).alias("in_r"))

    def differs(*columns: str) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))
        return out

    kind = F.when(F.col("in_l").isNull(), "inserted").when(F.col("in_r").isNull(), "deleted").when(differs("content_hash"), "content").when(differs("width", "height"), "size").when(differs("alt"), "alt_text")
    return a.join(b, keys, "full").select(*keys, kind.alias("change")).where("change is not null")


def formatting_changes(before: DataFrame, after: DataFrame, keys: list[str], text: str, props: list[str]) -> DataFrame:
    """Blocks of equal text whose properties differ, with the names of those."""
    a = before.select(*keys, F.col(text).alias("l_text"), *(F.col(p).alias(f"l_{p}") for p in props))
    b = after.select(*keys, F.col(text).alias("r_text"), *(F.col(p).alias(f"r_{p}") for p in props))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"l_{p}").eqNullSafe(F.col(f"r_{p}")), F.lit(p)) for p in props)))
    return a.join(b, keys).where(F.col("l_text").eqNullSafe(F.col("r_text"))).select(*keys, F.array_join(changed, ",").alias("changed")).where("changed <> ''")


def converted_markup(blk: DataFrame, deletion: Column, insertion: Column) -> DataFrame:
    """Hand-made markup as tracked status; rows that are tracked already stay as they are, so it may be repeated."""
    plain = ~F.col("has_ins") & ~F.col("has_del")
    return blk.withColumn("has_del", F.col("has_del") | (plain & deletion)).withColumn("has_ins", F.col("has_ins") | (plain & insertion & ~deletion))


def unreached_cells(cells: DataFrame, needle: str) -> DataFrame:
    """Matches in cells that a change of body text does not reach, by table."""
    from palimpsest.functions.text import occurrences

    return cells.groupBy("table_id").agg(F.sum(occurrences(F.col("text"), needle)).alias("unreached")).where("unreached > 0")


def auditable(documents: DataFrame, quarantined: DataFrame) -> DataFrame:
    """V6: documents with a quarantined part are refused, as rows."""
    return documents.join(quarantined.select("doc_id").distinct().withColumn("bad", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("bad"), "refused").otherwise("auditable").alias("audit"))


def link_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """V7: links (doc_id, pos, target) whose text stayed and whose target did not."""
    b = after.select("doc_id", "pos", F.col("target").alias("new_target"), F.col("text").alias("new_text"))
    return before.join(b, ["doc_id", "pos"]).where((F.col("text") == F.col("new_text")) & (F.col("target") != F.col("new_target"))).select("doc_id", "pos", "target", "new_target")


def render(changes: DataFrame) -> DataFrame:
    """One row per block of the pair's full view: status, the text on either side, and edges of its run."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    kind = F.when(F.col("change_type") == "matched", "unchanged").otherwise(F.col("change_type"))
    rows = changes.withColumn("status", kind)
    return rows.select(
        "doc_id",
        "seq",
        F.concat(F.lit("b_"), F.coalesce(F.col("base_pos").cast("string"), F.concat(F.lit("n"), "target_pos"))).alias("block_id"),
        "status",
        F.coalesce("old_text", F.lit("")).alias("old_text"),
        F.coalesce("new_text", F.lit("")).alias("new_text"),
        (F.coalesce(F.lag("status").over(w), F.lit("")) != F.col("status")).alias("run_start"),
        (F.coalesce(F.lead("status").over(w), F.lit("")) != F.col("status")).alias("run_end"),
    )


def render_single(blk: DataFrame) -> DataFrame:
    """One row per block of a plain document: its text as one segment, and its list, if it is in one. ``blk`` may have num_id, ilvl and label."""
    listed = F.lit(None).cast("struct<num_id:bigint,ilvl:int,label:string>")
    if {"num_id", "ilvl"} <= set(blk.columns):
        label = F.col("label") if "label" in blk.columns else F.lit(None).cast("string")
        listed = F.when(F.col("num_id").isNotNull() & (F.col("num_id") != 0), F.struct(F.col("num_id").cast("bigint").alias("num_id"), F.col("ilvl").cast("int").alias("ilvl"), label.alias("label")))
    segment = F.array(F.struct(F.lit("equal").alias("op"), F.col("text").alias("text")))
    return blk.select("doc_id", "pos", F.concat(F.lit("b_"), "pos").alias("block_id"), F.when(F.col("text") == "", F.array().cast("array<struct<op:string,text:string>>")).otherwise(segment).alias("segments"), listed.alias("list"))


def render_tracked(segments: DataFrame) -> DataFrame:
    """One row per block of a tracked document: its runs in order as (op, text, author), neighbours of one look joined, objects apart.

    ``segments``: (doc_id, pos, seq, text, has_ins, has_del, author). A stacked run is a deletion; a block is inserted or deleted if all its text is.
    """
    op = F.when(F.col("has_del"), "delete").when(F.col("has_ins"), "insert").otherwise("equal")
    runs = F.array_sort(F.collect_list(F.struct("seq", op.alias("op"), "text", F.coalesce("author", F.lit("")).alias("author"))))
    kind = "array<struct<op:string,text:string,author:string>>"

    def joined(done, r):
        last = F.try_element_at(done, F.lit(-1))
        same = (F.size(done) > 0) & (last["op"] == r["op"]) & (last["author"] == r["author"]) & ~F.contains(F.concat(last["text"], r["text"]), F.lit("\ufffc"))
        own = F.struct(r["op"].alias("op"), r["text"].alias("text"), r["author"].alias("author"))
        longer = F.struct(r["op"].alias("op"), F.concat(last["text"], r["text"]).alias("text"), r["author"].alias("author"))
        return F.when(same, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(own)))

    rows = segments.groupBy("doc_id", "pos").agg(runs.alias("runs")).withColumn("segments", F.aggregate("runs", F.array().cast(kind), joined))
    ops = F.array_distinct(F.transform(F.filter("segments", lambda x: x["text"] != ""), lambda x: x["op"]))
    status = F.when(ops == F.array(F.lit("insert")), "inserted").when(ops == F.array(F.lit("delete")), "deleted").when(F.size(F.array_except(ops, F.array(F.lit("equal")))) > 0, "modified").otherwise("unchanged")
    return rows.select("doc_id", "pos", status.alias("status"), "segments")


def content_tags(blk: DataFrame) -> DataFrame:
    """What a block holds: text, digits, symbols, links, tables of bars."""
    text = F.col("text")
    tags = F.array_compact(
        F.array(
            F.when(text.rlike("\\p{L}"), F.lit("text")),
            F.when(text.rlike("[0-9]"), F.lit("number")),
            F.when(text.rlike("[#*$%&<>]"), F.lit("symbol")),
            F.when(F.contains(text, F.lit("@")), F.lit("address")),
            F.when(F.contains(text, F.lit(" | ")), F.lit("columns")),
        )
    )
    return blk.select("doc_id", "pos", F.array_join(tags, ",").alias("tags"))


def selected_rows(revisions: DataFrame, author: str | None = None, ids: list[int] | None = None, kinds: list[str] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """Revisions by author, ids, kinds and block range together; with no match the outcome says so, as a row."""
    test = F.lit(True)
    if author is not None:
        test = test & (F.col("author") == author)
    if ids is not None:
        test = test & F.col("revision_id").isin(ids)
    if kinds is not None:
        test = test & F.col("kind").isin(kinds)
    if between is not None:
        test = test & F.col("pos").between(*between)
    found = revisions.where(test).select("doc_id", "revision_id", F.lit("selected").alias("outcome"))
    nothing = revisions.sparkSession.range(1).join(found.limit(1).select(F.lit(0).cast("long").alias("id")), "id", "left_anti")
    return found.unionByName(nothing.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("revision_id"), F.lit("empty_selection").alias("outcome")))
