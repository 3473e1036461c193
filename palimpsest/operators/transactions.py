"""Transactions of edits (U10-U13, U15, 2.10.1): a catalog, checks, and set-based application.

A document's state is four tables: blocks, cells of tables, properties, and side rows
(comments, notes, bookmarks, styles, headers, images, controls...). Each operation of
the catalog says which table it acts on and how: it replaces a text, adds, removes
or moves rows, or sets a property. An edit is judged against its own target there;
what no rule covers is refused as ``unsupported_op``.

A transaction is atomic: if one of its operations is refused, none of its document's
rows change. Outcomes are rows of their own. Positions and addresses are those from
before the transaction; edits of one target apply in order of seq, the last wins.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The operations' names by group and pattern.
CATALOG = {
    ("content", "text"): "replace",
    ("content", "rows_added"): "insert",
    ("content", "rows_removed"): "delete",
    ("content", "rows_moved"): "move blocks_to_table",
    ("format", "set"): "set_attr set_format set_para_format apply_style set_doc_defaults",
    ("format", "side"): "create_style modify_style",
    ("tables", "set"): "set_cell_format set_row_format set_table_format",
    ("tables", "rows_moved"): "table_op",
    ("references", "side"): "insert_cross_ref insert_bookmark rename_bookmark remove_bookmark",
    ("numbering", "set"): "set_numbering",
    ("images", "set"): "set_image_attrs set_image_layout",
    ("images", "rows_removed"): "delete_image",
    ("images", "side"): "insert_image replace_image",
    ("comments", "side"): "comment_create comment_reply comment_resolve comment_delete",
    ("notes", "side"): "insert_note edit_note delete_note",
    ("sections", "set"): "set_page_setup set_section_type",
    ("sections", "rows_added"): "insert_section_break",
    ("headers", "text"): "edit_header edit_footer",
    ("headers", "side"): "create_header create_footer set_header_footer_mode",
    ("equations", "side"): "insert_equation",
    ("controls", "side"): "wrap_content_control wrap_blocks_content_control",
    ("controls", "set"): "set_content_control_value",
    ("controls", "text"): "sdt_text_fill",
    ("forms", "set"): "set_form_field_value",
    ("opaque", "text"): "set_textbox_text opaque_text_edit",
}

#: What each operation does: on blocks; on side rows, with their kind; on a property, with its scope; on cells.
ON_BLOCKS = {"replace": "text", "insert": "add", "delete": "remove", "move": "move", "blocks_to_table": "table"}
ON_SIDE = {
    "add": {
        "create_style": "style", "insert_bookmark": "bookmark", "insert_cross_ref": "cross_ref", "insert_image": "image", "comment_create": "comment", "comment_reply": "comment", "insert_note": "note",
        "create_header": "header", "create_footer": "footer", "insert_equation": "equation", "wrap_content_control": "control", "wrap_blocks_content_control": "control", "insert_section_break": "section",
    },
    "text": {
        "modify_style": "style", "replace_image": "image", "edit_note": "note", "edit_header": "header", "edit_footer": "footer", "sdt_text_fill": "control", "set_content_control_value": "control",
        "set_form_field_value": "form_field", "set_textbox_text": "textbox", "opaque_text_edit": "opaque",
    },
    "rename": {"rename_bookmark": "bookmark"},
    "resolve": {"comment_resolve": "comment"},
    "remove": {"remove_bookmark": "bookmark", "delete_image": "image", "comment_delete": "comment", "delete_note": "note"},
}
ON_PROPERTIES = {
    "set_attr": "paragraph", "set_format": "run", "set_para_format": "paragraph", "apply_style": "paragraph", "set_numbering": "paragraph", "set_cell_format": "cell", "set_row_format": "row",
    "set_table_format": "table", "set_image_attrs": "image", "set_image_layout": "image", "set_page_setup": "section", "set_section_type": "section", "set_header_footer_mode": "section", "set_doc_defaults": "document",
}
TABLE_OPS = ("insert_row", "delete_row", "insert_column", "delete_column", "set_cell_text")

#: pos: a block, or the anchor of an added row. target: a side row's key; a cell's, row's or column's address as
#: table/row/col; the last block of a range. name: the property, or the table operation. expect: the guard, the text
#: or value that must be there.
EDITS = "txn_id long, doc_id long, seq int, op string, pos int, target string, name string, expect string, value string, author string"
BLOCKS = "doc_id long, pos int, text string"
CELLS = "doc_id long, table_id string, row int, col int, text string"
PROPERTIES = "doc_id long, scope string, target string, name string, value string"
SIDE = "doc_id long, kind string, key string, parent string, pos int, text string, author string, done boolean"


@dataclass(frozen=True)
class State:
    """The tables of documents; those not given are empty."""

    blocks: DataFrame
    cells: DataFrame
    properties: DataFrame
    side: DataFrame

    @classmethod
    def of(cls, blocks: DataFrame, cells: DataFrame | None = None, properties: DataFrame | None = None, side: DataFrame | None = None) -> State:
        def or_empty(df: DataFrame | None, schema: str) -> DataFrame:
            return empty(blocks.sparkSession, schema) if df is None else df

        return cls(blocks, or_empty(cells, CELLS), or_empty(properties, PROPERTIES), or_empty(side, SIDE))


def operation_catalog(spark: SparkSession) -> DataFrame:
    """(op, op_group, pattern) of every operation."""
    rows = [(op, group, pattern) for (group, pattern), ops in CATALOG.items() for op in ops.split()]
    return spark.createDataFrame(rows, "op string, op_group string, pattern string")


def act_rows() -> list[tuple[str, str, str | None]]:
    """(op, act, kind): the table an operation acts on with what it does there, as blocks.text or side.add, and the side kind or scope."""
    rows: list[tuple[str, str, str | None]] = [(op, f"blocks.{act}", None) for op, act in ON_BLOCKS.items()]
    rows += [(op, f"side.{act}", kind) for act, ops in ON_SIDE.items() for op, kind in ops.items()]
    rows += [(op, "properties.set", scope) for op, scope in ON_PROPERTIES.items()]
    return [*rows, ("table_op", "cells", None)]


def acts(spark: SparkSession) -> DataFrame:
    """:func:`act_rows` as a table."""
    return spark.createDataFrame(act_rows(), "op string, act string, kind string")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema, without a Python worker."""
    return spark.range(0).selectExpr(*(f"cast(null as {kind}) as {name}" for name, kind in (c.split() for c in schema.split(", "))))


def planned(edits: DataFrame) -> DataFrame:
    """Edits with the pattern, the act and the kind of their operation; plain expressions, no join."""

    def chosen(pairs: dict[str, list[str]]) -> Column:
        return F.coalesce(*(F.when(F.col("op").isin(*ops), F.lit(name)) for name, ops in pairs.items()), F.lit(None).cast("string"))

    patterns: dict[str, list[str]] = {}
    for (_, pattern), ops in CATALOG.items():
        patterns.setdefault(pattern, []).extend(ops.split())
    by_act: dict[str, list[str]] = {}
    by_kind: dict[str, list[str]] = {}
    for op, act, kind in act_rows():
        by_act.setdefault(act, []).append(op)
        if kind:
            by_kind.setdefault(kind, []).append(op)
    return edits.withColumns({"pattern": chosen(patterns), "act": chosen(by_act), "kind": chosen(by_kind)})


def fault() -> Column:
    """What is wrong with a planned edit whatever the state."""
    on_block = F.col("act").startswith("blocks.")
    by_target = F.col("act").startswith("side.") | (F.col("act") == "cells")
    return (
        F.when(F.col("pattern").isNull(), "unknown_op")
        .when(on_block & (F.col("pos").isNull() | (F.col("pos") < 0)), "missing_target")
        .when(by_target & F.col("target").isNull(), "missing_target")
        .when(F.col("author").isNull(), "missing_author")
        .when((F.col("act") == "properties.set") & F.col("name").isNull(), "missing_name")
        .when((F.col("act") == "cells") & ~F.coalesce(F.col("name").isin(*TABLE_OPS), F.lit(False)), "unsupported_op")
        .when(F.col("op").isin("replace", "insert", "move", "comment_create", "comment_reply", "edit_note", "rename_bookmark") & F.col("value").isNull(), "missing_value")
    )


def schema_faults(edits: DataFrame) -> DataFrame:
    """Edits that no state could satisfy, each a row with its code."""
    return planned(edits).withColumn("code", fault()).where("code is not null").select("txn_id", "doc_id", "seq", "op", "code")


def acts_of(edits: DataFrame) -> set[str]:
    """The acts that edits ask for, of which there are a dozen; what no edit asks for needs no join."""
    return {r["act"] for r in planned(edits).select("act").where("act is not null").distinct().collect()}


def impersonated(edits: DataFrame, revisions: DataFrame) -> DataFrame:
    """Edits whose author already owns revisions of the document; '' is an author like others."""
    owners = revisions.select("doc_id", "author").distinct()
    return edits.join(owners, ["doc_id", "author"], "left_semi")


def address(k: int) -> Column:
    """Part ``k`` of a target table/row/col; null where it is left out."""
    part = F.try_element_at(F.split("target", "/"), F.lit(k + 1))
    return F.when(part != "", part)


def outcomes(state: State, edits: DataFrame, owned: DataFrame | None = None, present: set[str] | None = None) -> DataFrame:
    """Each edit with its act and its code: ok, or the first reason against it, before anything is applied.

    ``owned``: revisions (doc_id, author) that are there already, for U13.
    """
    keys = ["txn_id", "doc_id", "seq"]
    present = acts_of(edits) if present is None else present
    plan = planned(edits)
    none = F.lit(None)
    blk = state.blocks.select("doc_id", "pos", F.col("text").alias("block_text"))
    # Side rows by kind and key: those that are there, and those that the transaction adds earlier.
    added = plan.where("act = 'side.add'").select("doc_id", "kind", F.col("target").alias("key"), F.col("seq").alias("since"), F.col("txn_id").alias("by"))
    there = state.side.select("doc_id", "kind", "key", F.lit(-1).alias("since"), F.lit(None).cast("long").alias("by"), F.col("text").alias("side_text"), "done")
    held = there.unionByName(added, allowMissingColumns=True)
    wants = plan.where("act like 'side.%'").select(*keys, "act", "kind", "target").withColumn("needed_kind", F.col("kind")).withColumn("needed", F.col("target"))
    asked = wants.join(held.select("doc_id", F.col("kind").alias("k"), "key", "since", "by", "side_text", "done"), "doc_id")
    asked = asked.where((F.col("k") == F.col("kind")) & (F.col("key") == F.col("target")) & (F.col("since") < F.col("seq")) & (F.col("by").isNull() | (F.col("by") == F.col("txn_id"))))
    side = asked.groupBy(*keys).agg(F.max_by("side_text", "since").alias("side_text"), F.max("done").alias("done"), F.lit(True).alias("side_there"))
    # What else must be there: the comment replied to, the bookmark referred to, the style applied.
    refers = F.when(F.col("op") == "comment_reply", F.struct(F.lit("comment").alias("k"), F.col("name").alias("key"))).when(F.col("op") == "insert_cross_ref", F.struct(F.lit("bookmark").alias("k"), F.col("value").alias("key")))
    refers = refers.when(F.col("op") == "apply_style", F.struct(F.lit("style").alias("k"), F.col("value").alias("key"))).when(F.col("kind") == "image", F.struct(F.lit("image").alias("k"), F.col("target").alias("key")))
    second = plan.withColumn("ref", refers).where("ref is not null").select(*keys, "doc_id", "ref.k", "ref.key")
    found = second.join(held.select("doc_id", F.col("kind").alias("k"), "key", "since", "by"), ["doc_id", "k", "key"]).where("since < seq and (by is null or by = txn_id)").select(*keys).distinct().withColumn("ref_there", F.lit(True))
    cells = state.cells.select("doc_id", "table_id", "row", "col", F.col("text").alias("cell_text"))
    tables = plan.where("act = 'cells' or kind in ('cell', 'row', 'table')").select(*keys, address(0).alias("table_id"), address(1).cast("int").alias("r"), address(2).cast("int").alias("c"))
    at = tables.join(cells, ["doc_id", "table_id"]).where("(r is null or r = row) and (c is null or c = col)").groupBy(*keys).agg(F.min("cell_text").alias("cell_text"), F.lit(True).alias("cell_there"))
    props = state.properties.select("doc_id", F.col("scope").alias("kind"), F.col("target").alias("prop_target"), "name", F.col("value").alias("prop_value"))
    on_sides, on_cells, on_properties = any(a.startswith("side.") for a in present), "cells" in present, "properties.set" in present
    wide = plan.withColumn("fault", fault()).withColumn("prop_target", F.coalesce("target", F.col("pos").cast("string"), F.lit("")))
    absent = {"side_text": none.cast("string"), "done": none.cast("boolean"), "side_there": none.cast("boolean"), "ref_there": none.cast("boolean"), "cell_text": none.cast("string"), "cell_there": none.cast("boolean"), "impersonated": none.cast("boolean"), "prop_value": none.cast("string"), "to_there": none.cast("boolean")}
    if owned is not None:
        wide = wide.join(impersonated(edits, owned).select(*keys, F.lit(True).alias("impersonated")), keys, "left")
    if on_sides:
        wide = wide.join(side, keys, "left")
    if on_sides or on_properties:
        wide = wide.join(found, keys, "left")
    if on_cells or on_properties:
        wide = wide.join(at, keys, "left")
    there = state.blocks.select("doc_id", F.col("pos").alias("to"), F.lit(True).alias("to_there"))
    if "blocks.move" in present:
        wide = wide.withColumn("to", F.when(F.col("act") == "blocks.move", F.col("value").try_cast("int"))).join(there, ["doc_id", "to"], "left")
    if on_properties:
        wide = wide.join(props, ["doc_id", "kind", "prop_target", "name"], "left")
    wide = wide.join(blk, ["doc_id", "pos"], "left")
    wide = wide.withColumns({c: v for c, v in absent.items() if c not in wide.columns})

    def is_act(name: str) -> Column:
        return F.col("act") == name

    on_block, on_side, setting = F.col("act").startswith("blocks."), F.col("act").startswith("side."), is_act("properties.set")
    on_paragraph = setting & F.col("kind").isin("paragraph", "run")
    anchored = (on_side & is_act("side.add") & F.col("pos").isNotNull()) | on_paragraph | on_block
    current = F.when(on_block, F.col("block_text")).when(on_side, F.col("side_text")).when(is_act("cells"), F.col("cell_text")).when(setting, F.col("prop_value"))
    needs_cell = is_act("cells") | F.col("kind").isin("cell", "row", "table")
    same = F.col("value").eqNullSafe(current)
    code = (
        F.when(F.col("fault").isNotNull(), F.col("fault"))
        .when(F.col("act").isNull(), "unsupported_op")
        .when(F.col("impersonated"), "author_impersonation")
        .when(anchored & F.col("block_text").isNull(), "anchor_not_found")
        .when(is_act("blocks.move") & F.col("to_there").isNull(), "anchor_not_found")
        .when(needs_cell & F.col("cell_there").isNull(), "target_not_found")
        .when(is_act("side.add") & F.col("side_there"), "duplicate_target")
        .when(on_side & ~is_act("side.add") & F.col("side_there").isNull(), "target_not_found")
        .when((F.col("op").isin("comment_reply", "insert_cross_ref", "apply_style") | (setting & (F.col("kind") == "image"))) & F.col("ref_there").isNull(), "reference_not_found")
        .when(F.col("expect").isNotNull() & ~F.col("expect").eqNullSafe(current), "stale_edit")
        .when((is_act("blocks.text") | is_act("side.text") | setting | (is_act("cells") & (F.col("name") == "set_cell_text"))) & same, "no_op_edit")
        .when(is_act("side.resolve") & F.col("done"), "no_op_edit")
        .otherwise("ok")
    )
    return wide.withColumn("code", code).select(*plan.columns, "prop_target", "block_text", "code")


def applied(state: State, edits: DataFrame, owned: DataFrame | None = None) -> tuple[State, DataFrame]:
    """(state after, outcomes)."""
    present = acts_of(edits)
    judged = outcomes(state, edits, owned, present)
    failed = F.max((F.col("code") != "ok").cast("int")).over(Window.partitionBy("txn_id", "doc_id"))
    judged = judged.withColumn("outcome", F.when(failed == 1, F.when(F.col("code") == "ok", "rolled_back").otherwise("refused")).otherwise("applied"))
    live = judged.where("outcome = 'applied'")
    blocks, made = blocks_after(state.blocks, live, present)
    cells = cells_after(state.cells, live) if "cells" in present else state.cells.select("doc_id", "table_id", "row", "col", "text")
    side = side_after(state.side, live) if any(a.startswith("side.") for a in present) else state.side
    after = replace(state, blocks=blocks, cells=cells.unionByName(made), properties=properties_after(state.properties, live), side=side)
    return after, judged.select("txn_id", "doc_id", "seq", "op", "code", "outcome")


_ROWS = "array<struct<seq:int,value:string>>"


def _listed(condition: Column, value: str) -> Column:
    return F.coalesce(F.array_sort(F.collect_list(F.when(condition, F.struct("seq", F.col(value).alias("value"))))), F.array().cast(_ROWS))


def _renumbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, (F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def blocks_after(blk: DataFrame, live: DataFrame, present: set[str]) -> tuple[DataFrame, DataFrame]:
    """Blocks after live edits, and the cells of the tables that blocks became. Added and moved blocks stand after their anchor."""
    act = F.col("act")
    edits = live.where(act.startswith("blocks."))
    last = F.coalesce(F.col("target").try_cast("int"), F.col("pos"))
    ranged = edits.where(act == "blocks.table").select("doc_id", "seq", F.coalesce("value", F.lit("\t")).alias("sign"), F.explode(F.sequence("pos", last)).alias("pos"))
    own = edits.groupBy("doc_id", "pos").agg(
        F.max_by("value", F.when(act == "blocks.text", F.col("seq"))).alias("new_text"),
        F.bool_or(act.isin("blocks.remove", "blocks.move")).alias("removed"),
        _listed(act == "blocks.add", "value").alias("added"),
    )
    now = blk.join(own, ["doc_id", "pos"], "left").withColumn("text", F.coalesce("new_text", "text"))
    to_table = ranged.groupBy("doc_id", "pos").agg(F.min(F.struct("seq", "sign")).alias("t"))
    now = now.join(to_table, ["doc_id", "pos"], "left") if "blocks.table" in present else now.withColumn("t", F.lit(None).cast("struct<seq:int,sign:string>"))
    moved = edits.where(act == "blocks.move").select("doc_id", "pos", "seq", F.col("value").cast("int").alias("to")).join(now.select("doc_id", "pos", "text"), ["doc_id", "pos"])
    arriving = moved.groupBy("doc_id", F.col("to").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("seq", F.col("text").alias("value")))).alias("arriving"))
    stays = ~F.coalesce("removed", F.lit(False)) & F.col("t").isNull()
    nothing = F.array().cast(_ROWS)
    rows = F.concat(
        F.when(stays, F.array(F.struct(F.lit(-1).alias("seq"), F.col("text").alias("value")))).otherwise(nothing), F.array_sort(F.concat(F.coalesce("added", nothing), F.coalesce("arriving", nothing)))
    )
    now_too = now.join(arriving, ["doc_id", "pos"], "left") if "blocks.move" in present else now.withColumn("arriving", F.lit(None).cast(_ROWS))
    flat = now_too.select("doc_id", F.col("pos").alias("old_pos"), F.posexplode(rows).alias("n", "r"))
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy("old_pos", "n")) - 1
    after = flat.select("doc_id", pos.alias("pos"), F.col("r.value").alias("text"))
    table_rows = _renumbered(now.where("t is not null").withColumn("table_id", F.concat(F.lit("new"), F.col("t.seq"))), ["doc_id", "table_id"], ["pos"], "row")
    made = table_rows.select("doc_id", "table_id", "row", F.posexplode(F.split("text", F.concat(F.lit("\\Q"), F.col("t.sign"), F.lit("\\E")))).alias("col", "text"))
    return after, made


def cells_after(cells: DataFrame, live: DataFrame) -> DataFrame:
    """Cells after live table operations; a new row's or column's value is split at tabs and line ends."""
    ops = live.where("act = 'cells'").select("doc_id", "seq", "name", "value", address(0).alias("table_id"), address(1).cast("int").alias("row"), address(2).cast("int").alias("col"))
    text = ops.where("name = 'set_cell_text'").groupBy("doc_id", "table_id", "row", "col").agg(F.max_by("value", "seq").alias("new_text"))
    out = cells.join(text, ["doc_id", "table_id", "row", "col"], "left").withColumn("text", F.coalesce("new_text", "text")).drop("new_text")
    for axis, cross, sign in (("row", "col", "\t"), ("col", "row", "\n")):
        word = {"row": "row", "col": "column"}[axis]
        gone = ops.where(F.col("name") == f"delete_{word}").select("doc_id", "table_id", axis).distinct()
        out = out.join(gone, ["doc_id", "table_id", axis], "left_anti")
        new = ops.where(F.col("name") == f"insert_{word}").select("doc_id", "table_id", axis, "seq", F.posexplode(F.split(F.coalesce("value", F.lit("")), sign)).alias(cross, "text"))
        both = out.withColumn("seq", F.lit(-1)).unionByName(new.withColumn(axis, F.col(axis)).select("doc_id", "table_id", "row", "col", "text", "seq"))
        out = _renumbered(both, ["doc_id", "table_id"], [axis, "seq"], "__at").drop(axis, "seq").withColumnRenamed("__at", axis)
    return out.select("doc_id", "table_id", "row", "col", "text")


def properties_after(properties: DataFrame, live: DataFrame) -> DataFrame:
    """Properties after live edits; the last value wins, and what was there is kept as ``previous``."""
    name = F.when(F.col("op") == "apply_style", "style").otherwise(F.col("name"))
    sets = live.where("act = 'properties.set'").select("doc_id", F.col("kind").alias("scope"), F.col("prop_target").alias("target"), name.alias("name"), "seq", "value")
    return set_property(properties, sets, ["doc_id", "scope", "target", "name"], "value", insert=True).select("doc_id", "scope", "target", "name", "value", "previous_value")


def side_after(side: DataFrame, live: DataFrame) -> DataFrame:
    """Side rows after live edits."""
    act = F.col("act")
    edits = live.where(act.startswith("side."))
    parent = F.when(F.col("op") == "comment_reply", F.col("name")).when(F.col("op") == "insert_cross_ref", F.col("value"))
    new = edits.where(act == "side.add").select("doc_id", "kind", F.col("target").alias("key"), parent.alias("parent"), "pos", F.col("value").alias("text"), "author", F.lit(False).alias("done"))
    own = edits.where(act != "side.add").groupBy("doc_id", "kind", F.col("target").alias("key")).agg(
        F.max_by("value", F.when(act == "side.text", F.col("seq"))).alias("new_text"),
        F.max_by("value", F.when(act == "side.rename", F.col("seq"))).alias("new_key"),
        F.bool_or(act == "side.resolve").alias("resolved"),
        F.bool_or(act == "side.remove").alias("removed"),
    )
    rows = side.unionByName(new).join(own, ["doc_id", "kind", "key"], "left").where(~F.coalesce("removed", F.lit(False)))
    done = F.coalesce("done", F.lit(False)) | F.coalesce("resolved", F.lit(False))
    return rows.select("doc_id", "kind", F.coalesce("new_key", "key").alias("key"), "parent", "pos", F.coalesce("new_text", "text").alias("text"), "author", done.alias("done"))


def set_property(rows: DataFrame, edits: DataFrame, key: list[str], name: str, insert: bool = False) -> DataFrame:
    """The ``set`` pattern: the last edit's value wins, and what was there is kept as previous; with ``insert``, new keys become rows."""
    last = edits.groupBy(*key).agg(F.max_by("value", "seq").alias("__value"))
    out = rows.join(last, key, "full" if insert else "left")
    previous: Column = F.when(F.col("__value").isNotNull(), F.col(name))
    return out.withColumn(f"previous_{name}", previous).withColumn(name, F.coalesce("__value", name)).drop("__value")


def edits_of(*frames: DataFrame) -> DataFrame:
    """Edits from frames that leave columns out; those are null."""
    fields = [c.split() for c in EDITS.split(", ")]
    return reduce(DataFrame.unionByName, (f.select(*((F.col(n) if n in f.columns else F.lit(None)).cast(k).alias(n) for n, k in fields)) for f in frames))
