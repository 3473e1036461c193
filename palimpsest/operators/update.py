"""Guarded updates (U1-U9, J13): census, count gate, replacement; the ordered worklist fold.

Refusals are rows with a code, never exceptions and never dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.session import share_package


@dataclass(frozen=True)
class Item:
    """A change of a worklist: ``old`` becomes ``new`` where it stands exactly ``expected`` times in a document.

    With ``fold``, spaces, apostrophes and quotation marks match their like, and what
    does not match stays as it is written (F14).
    """

    id: str
    old: str
    new: str
    expected: int = 1
    fold: bool = False


def matches(item: Item) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Of a text column: how often an item matches (F12), and the text with it replaced."""
    if not item.fold:
        return lambda text: T.occurrences(text, item.old), lambda text: F.replace(text, F.lit(item.old), F.lit(item.new))
    pattern = T.folded_pattern(item.old)
    new = item.new.replace("\\", "\\\\").replace("$", "\\$")
    return lambda text: F.regexp_count(text, F.lit(pattern)).cast("long"), lambda text: F.regexp_replace(text, pattern, new)


def gate(found: Column, item: Item) -> Column:
    """The outcome of an item by its matches in the whole document."""
    return F.when(found == 0, "unreachable_match").when(found != item.expected, "match_count_mismatch").when(F.lit(item.old == item.new), "no_op").otherwise("applied")


def in_scope(blk: DataFrame, tables: bool = False, between: tuple[int, int] | None = None) -> DataFrame:
    """The blocks that an item may reach: those of the body outside tables, or with them; of an inclusive range, or of one block as (n, n).

    ``blk`` may have a column block_type; without it all blocks are paragraphs.
    """
    out = blk
    if not tables and "block_type" in blk.columns:
        out = out.where(F.col("block_type") != "table")
    if between is not None:
        if between[0] > between[1]:
            raise ValueError("reversed range")
        out = out.where(F.col("pos").between(*between))
    return out


#: Changes of a worklist at most.
MOST_ITEMS = 100


def checked(items: list[Item]) -> list[Item]:
    if not 0 < len(items) <= MOST_ITEMS or len({i.id for i in items}) < len(items) or any(not i.old for i in items):
        raise ValueError("1 to 100 changes with their own ids and an old text each")
    return items


def replace_gated(blk: DataFrame, item: Item) -> DataFrame:
    """The blocks of each document that has the text exactly as often as expected, with it replaced.

    For tables that arrive as blocks: the census is a window over the document. Where
    documents are rows, :func:`palimpsest.operators.lines.replace_gated` needs none.
    """
    n, after = matches(item)
    counted = blk.withColumn("n", n(F.col("text"))).withColumn("found", F.sum("n").over(Window.partitionBy("doc_id")))
    hit = counted.where((F.col("n") > 0) | ((F.col("found") == 0) & (F.col("pos") == 0))).withColumn("outcome", gate(F.col("found"), item))
    new = F.when(F.col("outcome") == "applied", after(F.col("text")))
    return hit.select("doc_id", "pos", F.col("found").alias("n_found"), "outcome", new.alias("new_text"), F.when(F.col("n") > 0, T.excerpt(F.col("text"), item.old)).alias("excerpt"))


def replace_all(blk: DataFrame, word: str, new: str) -> DataFrame:
    """A whole word in any case, everywhere; blocks that do not change are left out (no-op)."""
    # A match gives up the sign after it by look-ahead, so that neighbours of one blank both match.
    pattern = f"(?i)(^|[^\\p{{L}}\\p{{N}}]){T.quoted(word)}(?=$|[^\\p{{L}}\\p{{N}}])"
    after = F.regexp_replace("text", pattern, "$1" + new.replace("\\", "\\\\").replace("$", "\\$"))
    return blk.withColumn("after", after).where("after <> text").select("doc_id", "pos", F.col("after").alias("text"))


def straddling(segments: DataFrame, needle: str) -> DataFrame:
    """Documents where the text stands across segments but in none of them."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "text")))
    joined = segments.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("joined"), F.sum(T.occurrences(F.col("text"), needle)).alias("inside"))
    across = T.occurrences(F.col("joined"), needle)
    return joined.select("doc_id", across.alias("across"), "inside").where("across > inside")


def without_label(text: str) -> str:
    return re.sub("^\\s*\\(?[0-9A-Za-z]{1,4}\\)\\s+", "", text)


def diagnosis(blk: DataFrame, item: Item, scope_last: int) -> DataFrame:
    """U4: why documents have no match in blocks up to ``scope_last``: already applied, out of scope, folding, label, across blocks, none."""
    text, inside = F.col("text"), F.col("pos") <= scope_last
    bare = without_label(item.old)

    def some(test: Column) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False))

    probes = blk.groupBy("doc_id").agg(
        some(inside & F.contains(text, F.lit(item.old))).alias("here"),
        some(inside & F.contains(text, F.lit(item.new))).alias("applied"),
        some(~inside & F.contains(text, F.lit(item.old))).alias("outside"),
        some(inside & F.contains(T.fold(text), T.fold(F.lit(item.old)))).alias("folded"),
        some(inside & F.contains(text, F.lit(bare)) & F.lit(bare != item.old)).alias("label"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("pos", "text")))), lambda r: r["text"]), "").alias("joined"),
    )
    why = F.when(F.col("applied"), "already_applied").when(F.col("outside"), "out_of_scope").when(F.col("folded"), "normalize_ws_matches").when(F.col("label"), "label_strip_matches").when(F.contains("joined", F.lit(item.old)), "wall_straddle").otherwise("no_candidate")
    return probes.where(~F.col("here")).select("doc_id", why.alias("diagnosis"))


def bound(documents: DataFrame, expected: DataFrame) -> DataFrame:
    """U8: documents whose digest and length are those a worklist was made for."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    have = documents.select("doc_id", F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("long").alias("bytes"))
    joined = expected.join(have, "doc_id", "left")
    same = (expected["sha256"] == have["sha256"]) & (expected["bytes"] == have["bytes"])
    return joined.select("doc_id", F.when(have["sha256"].isNull(), "missing").when(same, "bound").otherwise("stale").alias("binding"))


def guard(segments: DataFrame) -> DataFrame:
    """The guard of a block: the digest of its text that is not deleted, runs of one status apart; formatting has no part."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "status", "text")))
    atoms = F.aggregate(
        F.transform("rows", lambda r: F.struct(r["status"].alias("s"), r["text"].alias("t"))),
        F.array().cast("array<struct<s:string,t:string>>"),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["s"] == r["s"]),
            F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(r["s"].alias("s"), F.concat(F.try_element_at(acc, F.lit(-1))["t"], r["t"]).alias("t")))),
        ).otherwise(F.concat(acc, F.array(r))),
    )
    framed = F.array_join(F.transform("atoms", lambda a: F.concat(a["s"], F.lit(":"), F.char_length(a["t"]), F.lit(":"), a["t"])), ";")
    grouped = segments.groupBy("doc_id").agg(rows.alias("rows")).withColumn("atoms", atoms)
    return grouped.select("doc_id", F.concat(F.lit("v2:"), F.sha2(framed.cast("binary"), 256)).alias("guard"), F.size("atoms").cast("long").alias("n_runs"))


def apply_worklist(blk: DataFrame, items: list[Item]) -> DataFrame:
    """Items in order on each document; later ones see earlier edits. Outcomes by (document, item), and the digest after each.

    The fold is sequential by meaning, so it runs by document; documents run side by side.
    """
    checked(items)
    share_package(blk.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield outcome_batch([(doc, *r) for doc, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in folded(lines, items)])

    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    texts = blk.groupBy("doc_id").agg(F.transform(ordered, lambda b: b["text"]).alias("lines"))
    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), "lines").mapInArrow(run, OUTCOMES)


OUTCOMES = "doc_id long, seq int, item string, n_found long, outcome string, n_chars long"


def outcome_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in OUTCOMES.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def folded(lines: list[str], items: list[Item]) -> Iterator[tuple[int, str, int, str, int]]:
    """(seq, item, matches, outcome, characters after) of each item on one document."""
    for seq, item in enumerate(items):
        pattern = re.compile(T.folded_pattern(item.old)) if item.fold else None
        n = sum(len(pattern.findall(line)) if pattern else line.count(item.old) for line in lines)
        if n == 0:
            code = "unreachable_match"
        elif n != item.expected:
            code = "match_count_mismatch"
        elif item.old == item.new:
            code = "no_op"
        else:
            code = "applied"
            lines = [pattern.sub(lambda _, new=item.new: new, line) if pattern else line.replace(item.old, item.new) for line in lines]
        yield seq, item.id, n, code, sum(map(len, lines)) + max(0, len(lines) - 1)
