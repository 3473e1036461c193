"""Comparison of versions (D1-D12, D14-D17, D28-D30): aligned blocks, word changes, redlines, structural differences.

Both versions of a document are one row, and alignment and word differences are one
Arrow pass over it. Word changes are the data that both versions are rebuilt from.
Tables are in ``table_diff``, formats and objects in words in ``functions.inline``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions.inline import word_changes
from palimpsest.functions.kernels import align, block_similarity, content_similarity
from palimpsest.session import share_package

CHANGES = "array<struct<op:string,text:string>>"

#: When a modification is two unrelated texts (D7), and when a paragraph was split.
UNRELATED, UNRELATED_SHORT, SHORT_RATIO, LEAST_VISIBLE = 0.15, 0.25, 0.30, 20
SPLIT_RATIO, SPLIT_SIMILARITY = 0.35, 0.55


def similarity(a: Column, b: Column) -> Column:
    """F6 as a column, by Arrow batches."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([content_similarity(p or "", q or "") for p, q in zip(x, y)], dtype="float64")

    return run(a, b)


def gathered(blk: DataFrame, name: str) -> DataFrame:
    """A row per document: its blocks in order, as an array of (pos, text)."""
    return blk.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "text"))).alias(name))


CHANGE = "struct<seq:int,change_type:string,base_pos:int,target_pos:int,old_text:string,new_text:string,ops:" + CHANGES + ">"


def change_rows(old: list[str], new: list[str], words: bool = True) -> list[dict]:
    """The changes of one document, in order, with the word changes of modified lines."""
    rows = []
    for n, (kind, i, j) in enumerate(align(old, new, block_similarity)):
        a, b = None if i is None else old[i], None if j is None else new[j]
        row = {"seq": n, "change_type": kind, "base_pos": i, "target_pos": j, "old_text": a, "new_text": b, "ops": None}
        if words and kind == "modified":
            row["ops"] = [{"op": op, "text": t} for op, t in word_changes(a, b)]
        rows.append(row)
    return rows


def compared(pairs: DataFrame, words: bool = True) -> DataFrame:
    """(doc_id, changes) of (doc_id, old, new), both versions' lines as arrays: a row per document, and no shuffle.

    Alignment and word changes are one Arrow pass. ``words=False`` leaves word changes out.
    """
    share_package(pairs.sparkSession)
    kind = pa.struct([("seq", pa.int32()), ("change_type", pa.string()), ("base_pos", pa.int32()), ("target_pos", pa.int32()), ("old_text", pa.string()), ("new_text", pa.string()), ("ops", pa.list_(pa.struct([("op", pa.string()), ("text", pa.string())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [change_rows(old or [], new or [], words) for old, new in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(kind))], ["doc_id", "changes"])

    return pairs.select(F.col("doc_id").cast("long").alias("doc_id"), "old", "new").mapInArrow(run, f"doc_id long, changes array<{CHANGE}>")


def changes_of(rows: DataFrame) -> DataFrame:
    """The changes of :func:`compared` as rows."""
    return rows.select("doc_id", F.explode("changes").alias("c")).select("doc_id", "c.seq", "c.change_type", "c.base_pos", "c.target_pos", "c.old_text", "c.new_text")


def _whole(op: str, text: Column) -> Column:
    return F.array(F.struct(F.lit(op).alias("op"), F.coalesce(text, F.lit("")).alias("text"))).cast(CHANGES)


def _ops(change: Column) -> Column:
    """A change's word changes; of what is not modified, one run."""
    kind = change["change_type"]
    return F.when(kind == "modified", change["ops"]).when(kind == "matched", _whole("equal", change["old_text"])).when(kind == "deleted", _whole("delete", change["old_text"])).otherwise(_whole("insert", change["new_text"]))


def inline_of(rows: DataFrame) -> DataFrame:
    """(doc_id, seq, base_pos, target_pos, change_type, n, op, text) of :func:`compared`."""
    flat = rows.select("doc_id", F.explode("changes").alias("c"))
    out = flat.select("doc_id", "c.seq", "c.base_pos", "c.target_pos", "c.change_type", F.posexplode_outer(_ops(F.col("c"))).alias("n", "o"))
    return out.select("doc_id", "seq", "base_pos", "target_pos", "change_type", "n", F.col("o.op").alias("op"), F.coalesce("o.text", F.lit("")).alias("text"))


def rebuilt_rows(rows: DataFrame, accept: bool) -> DataFrame:
    """Law: either version's text from the changes of :func:`compared`, in the row."""
    side, pos = ("delete", "target_pos") if accept else ("insert", "base_pos")

    def line(c: Column) -> Column:
        kept = F.transform(F.filter(_ops(c), lambda o: o["op"] != side), lambda o: o["text"])
        return F.struct(c[pos].alias("pos"), F.array_join(kept, "").alias("text"))

    placed = F.array_sort(F.transform(F.filter("changes", lambda c: c[pos].isNotNull()), line))
    return rows.select("doc_id", F.array_join(F.transform(placed, lambda x: x["text"]), "\n").alias("text"))


def redline(rows: DataFrame) -> DataFrame:
    """(doc_id, paragraphs) of :func:`compared`: a tracked document whose accepted view is the target and whose rejected view is the base.

    A paragraph is its mark's status and its (status, text) segments; the last
    paragraph's mark cannot be tracked, so that of a run at the end stands one
    paragraph earlier.
    """
    share_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("mark", pa.string()), ("segments", pa.list_(pa.struct([("status", pa.string()), ("text", pa.string())])))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([redline_paragraphs(c) for c in part.column(1).to_pylist()], kind)], ["doc_id", "paragraphs"])

    return rows.select("doc_id", "changes").mapInArrow(run, "doc_id long, paragraphs array<struct<mark:string,segments:array<struct<status:string,text:string>>>>")


STATUS = {"equal": "normal", "delete": "deleted", "insert": "inserted"}


def redline_paragraphs(changes: list[dict]) -> list[dict]:
    own = [{"deleted": "deleted", "inserted": "inserted"}.get(c["change_type"], "normal") for c in changes]
    marks = list(own)
    kept = [n for n, s in enumerate(own) if s == "normal"]
    if kept:
        marks[kept[-1] :] = [*own[kept[-1] + 1 :], "normal"]
    elif marks:
        # Nothing stays: the other side's last mark goes both ways.
        opposite = [n for n, s in enumerate(own) if s != own[-1]]
        marks[-1] = "normal"
        if opposite:
            marks[opposite[-1]] = "stacked"
    out = []
    for c, status, mark in zip(changes, own, marks):
        if c["ops"] is not None:
            segments = [{"status": STATUS[o["op"]], "text": o["text"]} for o in c["ops"]]
        else:
            segments = [{"status": status, "text": c["new_text"] if status == "inserted" else c["old_text"]}]
        out.append({"mark": mark, "segments": segments})
    return out


def aligned(base: DataFrame, target: DataFrame) -> DataFrame:
    """D1-D5 for tables of blocks: (doc_id, seq, change_type, base_pos, target_pos, old_text, new_text), positions being the tables' own."""

    def lines(name: str) -> Column:
        return F.transform(F.coalesce(name, F.array().cast("array<struct<pos:int,text:string>>")), lambda x: x["text"])

    both = gathered(base, "a").join(gathered(target, "b"), "doc_id", "full")
    found = changes_of(compared(both.select("doc_id", lines("a").alias("old"), lines("b").alias("new")), words=False))
    places = both.select(F.col("doc_id").cast("long").alias("doc_id"), F.transform("a", lambda x: x["pos"]).alias("a_pos"), F.transform("b", lambda x: x["pos"]).alias("b_pos"))
    return found.join(places, "doc_id").withColumn("base_pos", F.get("a_pos", "base_pos")).withColumn("target_pos", F.get("b_pos", "target_pos")).drop("a_pos", "b_pos")


def with_unrelated_split(changes: DataFrame) -> DataFrame:
    """A modification of unlike texts, or of an empty and a non-empty one, is a deletion and an insertion."""
    old, new = F.col("old_text"), F.col("new_text")
    sim = F.when(F.col("change_type") == "modified", similarity(old, new))
    a, b = T.visible_chars(old), T.visible_chars(new)
    near = F.least(a, b) / F.greatest(a, b)
    unlike = (a >= LEAST_VISIBLE) & (b >= LEAST_VISIBLE) & ((F.col("sim") < UNRELATED) | (F.col("sim") < UNRELATED_SHORT) & (near < SHORT_RATIO))
    empty = (old == "") != (new == "")
    split = (F.col("change_type") == "modified") & (unlike | empty)
    none = F.lit(None).cast("string")
    gone = F.struct(F.lit("deleted").alias("change_type"), F.col("base_pos"), F.lit(None).cast("int").alias("target_pos"), old.alias("old_text"), none.alias("new_text"), F.lit(0).alias("part"))
    come = F.struct(F.lit("inserted").alias("change_type"), F.lit(None).cast("int").alias("base_pos"), F.col("target_pos"), none.alias("old_text"), new.alias("new_text"), F.lit(1).alias("part"))
    same = F.struct(F.col("change_type"), F.col("base_pos"), F.col("target_pos"), old.alias("old_text"), new.alias("new_text"), F.lit(0).alias("part"))
    return changes.withColumn("sim", sim).select("doc_id", "seq", F.explode(F.when(split, F.array(gone, come)).otherwise(F.array(same))).alias("c")).select("doc_id", "seq", "c.*")


def insertion_anchors(changes: DataFrame) -> DataFrame:
    """Inserted blocks after the last base block that was matched before them."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.last(F.when(F.col("change_type").isin("matched", "modified"), F.col("base_pos")), ignorenulls=True).over(w)
    return changes.withColumn("after_base_pos", anchor).where("change_type = 'inserted'").select("doc_id", "target_pos", "after_base_pos", "new_text")


def paragraph_splits(changes: DataFrame) -> DataFrame:
    """Modified blocks of which a part became a block of its own, before or after it.

    After: the inserted block is the end that the modified one lost. Before: the
    modified block is its own end, and what it lost is much like the inserted one.
    What is left must be like its counterpart in length and words.
    """
    w = Window.partitionBy("doc_id").orderBy("seq")
    rows = changes.select("doc_id", "seq", "change_type", "base_pos", "target_pos", T.normalized(F.col("old_text")).alias("old"), T.normalized(F.col("new_text")).alias("new"))
    for side, near in (("next", F.lead), ("last", F.lag)):
        rows = rows.withColumn(f"{side}_type", near("change_type").over(w)).withColumn(f"{side}_text", near("new").over(w))
    old, new, after, ahead = F.col("old"), F.col("new"), F.col("next_text"), F.col("last_text")

    def lost(end: Column) -> Column:
        return F.left(old, F.char_length(old) - F.char_length(end))

    long_enough = [F.octet_length(x) >= T.SPLIT_BYTES for x in (after, new)]
    one = (F.col("next_type") == "inserted") & long_enough[0] & F.endswith(old, after) & ~F.endswith(new, after) & (F.char_length(old) > F.char_length(after))
    two = (F.col("last_type") == "inserted") & long_enough[1] & F.endswith(old, new) & (F.octet_length(old) > F.octet_length(new) + 5)
    kind = F.when(F.coalesce(one, F.lit(False)), "after").when(F.coalesce(two, F.lit(False)), "before")
    found = rows.where("change_type = 'modified'").withColumn("split", kind).where("split is not null")
    found = found.withColumn("removed", F.when(F.col("split") == "after", lost(after)).otherwise(lost(new))).withColumn("beside", F.when(F.col("split") == "after", new).otherwise(ahead))
    a, b = F.octet_length("removed"), F.octet_length("beside")
    found = found.where((F.least(a, b) >= T.SPLIT_BYTES) & (F.least(a, b) / F.greatest(a, b) >= SPLIT_RATIO))
    return found.where(similarity(F.col("removed"), F.col("beside")) >= SPLIT_SIMILARITY).select("doc_id", "seq", "base_pos", "target_pos", "split")


def cell_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells (table_id, row, col, text, span) of two grids by address: modified, merge_changed, unchanged, deleted, inserted."""
    keys = ["table_id", "row", "col"]
    a, b = old.select(*keys, F.col("text").alias("old_text"), F.col("span").alias("old_span")), new.select(*keys, F.col("text").alias("new_text"), F.col("span").alias("new_span"))
    kind = (
        F.when(F.col("old_span").isNull(), "inserted")
        .when(F.col("new_span").isNull(), "deleted")
        .when(~F.col("old_text").eqNullSafe(F.col("new_text")), "modified")
        .when(F.col("old_span") != F.col("new_span"), "merge_changed")
        .otherwise("unchanged")
    )
    return a.join(b, keys, "full").select(*keys, kind.alias("cell_change"))


def structural(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Every difference of two tables as (keys, path, left, right); null-safe, one full join."""
    a = one.select(*keys, *(F.col(c).cast("string").alias(f"l_{c}") for c in columns), F.lit(True).alias("in_l"))
    b = two.select(*keys, *(F.col(c).cast("string").alias(f"r_{c}") for c in columns), F.lit(True).alias("in_r"))
    both = a.join(b, keys, "full")
    here, there = F.coalesce("in_l", F.lit(False)), F.coalesce("in_r", F.lit(False))
    entries = [
        F.when(here & there & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.struct(F.lit(c).alias("path"), F.col(f"l_{c}").alias("left"), F.col(f"r_{c}").alias("right"))) for c in columns
    ]
    entries.append(F.when(here != there, F.struct(F.lit("row").alias("path"), here.cast("string").alias("left"), there.cast("string").alias("right"))))
    return both.select(*keys, F.explode(F.array_compact(F.array(*entries))).alias("d")).select(*keys, "d.*")
