"""Truth tables, refusals and edge cases that whole tables do not reach."""

import re

import pytest
from pyspark.sql import functions as F

from palimpsest import session
from palimpsest.functions import text as T
from palimpsest.operators import audit, blocks, cascade, diffing, grid, lines, matching, ordered, package_rules, revisions, roles, stories, table_diff, transactions, update, validate, versions
from palimpsest.sources import docx, docx_elements, docx_resolve, html


def values(df, *columns):
    return [tuple(r) if len(r) > 1 else r[0] for r in (df.select(*columns) if columns else df).collect()]


def test_survival_table(spark):
    df = spark.createDataFrame([(False, False), (True, False), (False, True), (True, True)], "i boolean, d boolean")
    got = values(df.select(revisions.status(F.col("i"), F.col("d")), revisions.survives(F.col("i"), F.col("d"), True), revisions.survives(F.col("i"), F.col("d"), False)))
    assert got == [("n", True, True), ("i", True, False), ("d", False, True), ("s", False, False)]


@pytest.mark.parametrize("action, which, want", [("accept", 1, "d"), ("reject", 1, None), ("accept", 2, None), ("reject", 2, "i")])
def test_stacked_segments(spark, action, which, want):
    seg = spark.createDataFrame([(1, 0, "x", True, True, 1, 2)], "doc_id long, pos int, text string, has_ins boolean, has_del boolean, ins_id long, del_id long")
    done = revisions.resolved(seg, spark.createDataFrame([(which,)], "revision_id long"), action)
    assert values(done.select(revisions.status(F.col("has_ins"), F.col("has_del")))) == ([want] if want else [])


def test_unknown_action_is_an_error(spark):
    seg = spark.createDataFrame([], "doc_id long, pos int, text string, has_ins boolean, has_del boolean, ins_id long, del_id long")
    with pytest.raises(ValueError):
        revisions.resolved(seg, spark.createDataFrame([], "revision_id long"), "keep")


def test_text_functions(spark):
    df = spark.createDataFrame([("(a)Text",), ("(a) Text",), ("1. Text",), ("abcde) x",)], "t string")
    assert values(df.select(T.prefix_separated(F.col("t")))) == ["(a) Text", "(a) Text", "1. Text", "abcde) x"]
    one = spark.range(1)
    got = one.select(T.color_hex(F.lit("#ff00aa")), T.color_hex(F.lit("red")), T.snake(F.lit("HeadingTwo Char")), T.quantized(F.lit(-36), 72), T.numbering_sort(F.lit("• x")), T.rels_path(F.lit("word/document.xml")), T.part_directory(F.lit("a.xml")))
    assert values(got) == [("FF00AA", None, "heading_two_char", -72, "bullet", "word/_rels/document.xml.rels", "")]
    assert values(one.select(T.level_text(F.lit("%1.%2"), [F.lit("3")]), T.level_text(F.lit("%1)"), [F.lit("c")]))) == [("", "c)")]
    assert values(one.select(T.letters(F.lit(0)), T.letters(F.lit(27)), T.letters(F.lit(703)), T.letters(F.lit(18279)), T.letters(F.lit(475255)), T.roman(F.lit(0)), T.roman(F.lit(1994)))) == [("", "aa", "aaa", "aaaa", "aaaaa", "", "mcmxciv")]


def blk(spark, *lines):
    return blocks.blocks(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a\n\nb")], "doc_id long, text string")
    b = blocks.blocks(docs)
    assert sorted(values(b)) == [(2, 0, ""), (3, 0, "a"), (3, 1, ""), (3, 2, "b")]
    assert sorted(values(blocks.plain_text(b))) == [(2, ""), (3, "a\n\n\n\nb")]


def test_span_handles_of_long_and_odd_blocks(spark):
    """Offsets are code points of the text; separators that no token has count too, and no step grows by the square of a block."""
    odd = ["", "  ", "a", " a, b_1 ", "x\u2028y\u0085z", "\U0001f600 \U00020000\u00e9 \u0661", "...", "\r\vq"]
    got = values(blocks.span_handles(blk(spark, *odd)))
    assert sorted(got) == sorted((1, p, f"s_{n}", m.start(), m.group()) for p, t in enumerate(odd) for n, m in enumerate(re.finditer(r"\w+", t)))
    many = 150_000
    spans = blocks.span_handles(blk(spark, "a b", "ab, " * many, "c"))
    assert "Exchange" not in spans._jdf.queryExecution().executedPlan().toString()
    assert values(spans.where("pos = 1").agg(F.count("*"), F.sum("start"), F.max("start"), F.count_distinct("handle"))) == [(many, 2 * many * (many - 1), 4 * (many - 1), many)]
    assert values(spans.where("pos = 2"), "handle", "start", "text") == [("s_0", 0, "c")]


def test_reads_refuse_bad_ranges(spark):
    with pytest.raises(ValueError):
        blocks.window(blk(spark, "a"), 3, 1)
    with pytest.raises(ValueError):
        blocks.pages(blk(spark, "a"), 0, 65)
    with pytest.raises(ValueError):
        blocks.find(blk(spark, "a"), [])
    assert values(blocks.window(blk(spark, "a", "b"), 0, 5), "pos", "outcome") == [(None, "invalid_range")]


def test_gate_and_no_op(spark):
    b = blk(spark, "one two one", "nil")
    assert values(update.replace_gated(b, update.Item("x", "one", "1", 2)), "n_found", "outcome", "new_text") == [(2, "applied", "1 two 1")]
    assert values(update.replace_gated(b, update.Item("x", "one", "1", 1)), "outcome") == ["match_count_mismatch"]
    assert values(update.replace_gated(b, update.Item("x", "one", "one", 2)), "outcome") == ["no_op"]
    assert values(update.replace_gated(b, update.Item("x", "zero", "0")), "pos", "outcome") == [(0, "unreachable_match")]
    with pytest.raises(ValueError):
        update.checked([update.Item("x", "", "y")])


def test_worklist_sees_earlier_edits(spark):
    items = [update.Item("a", "cat", "dog"), update.Item("b", "dog", "cow", 2)]
    got = values(update.apply_worklist(blk(spark, "cat and dog"), items).orderBy("seq"), "item", "n_found", "outcome")
    assert got == [("a", 1, "applied"), ("b", 2, "applied")]


def test_folded_items_match_alike_signs(spark):
    item = update.Item("f", "it's \"so\" far", "done", 2, fold=True)
    b = blk(spark, "it\u2019s\u00a0\u201cso\u201d far, \u00e9", "it's \"so\"\tfar")
    want = [(0, 2, "applied", "done, \u00e9"), (1, 2, "applied", "done")]
    assert sorted(values(update.replace_gated(b, item), "pos", "n_found", "outcome", "new_text")) == want
    assert values(update.apply_worklist(b, [item]), "n_found", "outcome", "n_chars") == [(2, "applied", 12)]
    assert values(update.replace_gated(b, update.Item("x", "it's", "x", 1)), "outcome") == ["applied"]
    text = spark.createDataFrame([("aXaXXa",), ("",), ("XX",), ("a.a",)], "t string")
    assert values(text.select(T.match_positions(F.col("t"), "X"), T.match_positions(F.col("t"), "XX"), T.match_positions(F.col("t"), "."))) == [([1, 3, 4], [3], []), ([], [], []), ([0, 1], [0], []), ([], [], [1])]


def test_scope_of_an_item(spark):
    b = spark.createDataFrame([(1, 0, "a", "paragraph"), (1, 1, "a", "table"), (1, 2, "a", "paragraph")], "doc_id long, pos int, text string, block_type string")
    assert values(update.in_scope(b), "pos") == [0, 2] and values(update.in_scope(b, tables=True, between=(1, 1)), "pos") == [1]
    with pytest.raises(ValueError):
        update.in_scope(b, between=(2, 1))


def test_lines_in_a_row_are_as_blocks(spark, data):
    """Operators on arrays of lines against those on tables of blocks, and plans without a shuffle."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "one\n\ntwo words here that go on\n"), (-4, "moron.\nTmoron")], "doc_id long, text string"))
    b, item = blocks.blocks(docs), update.Item("w", "worthless", "x", 2)
    pairs = [
        (lines.plain_text(docs), blocks.plain_text(b)), (lines.outline(docs), blocks.outline(b)), (lines.outline_totals(docs), blocks.outline_totals(b)), (lines.window(docs, 1, 3), blocks.window(b, 1, 3)),
        (lines.pages(docs, 2, 3), blocks.pages(b, 2, 3)), (lines.replace_gated(docs, item), update.replace_gated(b, item)), (lines.straddling(docs, ".T"), update.straddling(b, ".T")),
        (lines.diagnosis(docs, update.Item("z", "stupid", "trash"), 3), update.diagnosis(b, update.Item("z", "stupid", "trash"), 3)), (lines.apply_worklist(docs, [item]), update.apply_worklist(b, [item])),
    ]
    for one, two in pairs:
        names = sorted(one.columns)
        assert names == sorted(two.columns)
        assert sorted(values(one, *names), key=str) == sorted(values(two, *names), key=str)
        assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    revised = [(d, n, x) for d, new in values(lines.revised_pairs(docs), "doc_id", "new") for n, x in enumerate(new)]
    assert sorted(revised) == sorted(values(versions.revised(b), "doc_id", "pos", "text"))
    rows = diffing.compared(lines.revised_pairs(docs))
    assert sorted(values(diffing.changes_of(rows)), key=str) == sorted(values(diffing.aligned(b, versions.revised(b))), key=str)
    assert "Exchange" not in diffing.rebuilt_rows(rows, True)._jdf.queryExecution().executedPlan().toString()


def test_guard_ignores_how_runs_are_cut(spark):
    rows = [(1, 0, "n", "ab"), (1, 1, "n", "c"), (2, 0, "n", "abc"), (3, 0, "n", "ab"), (3, 1, "i", "c")]
    got = dict(values(update.guard(spark.createDataFrame(rows, "doc_id long, pos int, status string, text string")), "doc_id", "guard"))
    assert got[1] == got[2] != got[3]


def test_notes_pair_in_three_passes(spark):
    schema = "doc_id long, note_id long, text string"
    old = spark.createDataFrame([(1, 1, "same id and text"), (1, 2, "moves to another id"), (1, 3, "the quick brown fox jumps over the lazy dog again today"), (1, 4, "gone for good")], schema)
    new = spark.createDataFrame([(1, 1, "same id, new text"), (1, 7, "moves to another id"), (1, 8, "the quick brown fox jumps over the lazy dog again today!"), (1, 9, "entirely fresh words")], schema)
    got = set(values(matching.note_pairs(old, new), "old", "new", "how"))
    assert got == {(1, 1, "modified"), (2, 7, "renumbered"), (3, 8, "similar"), (4, None, "deleted"), (None, 9, "inserted")}


def test_chains_and_threads_end_in_cycles(spark):
    styles = spark.createDataFrame([("a", "b", None), ("b", "c", 2), ("c", None, 3)], "style_id string, based_on string, size int")
    assert sorted(values(cascade.flattened(styles, ["size"]), "style_id", "size", "depth")) == [("a", 2, 2), ("b", 2, 1), ("c", 3, 0)]
    edges = spark.createDataFrame([(1, 1, 2, True), (1, 2, 1, False), (1, 3, 9, False)], "doc_id long, para_id long, parent_id long, done boolean")
    assert sorted(values(audit.thread_roots(edges), "para_id", "root_id")) == [(1, 2), (2, 1), (3, 3)]
    loop = spark.createDataFrame([("a", "b", 1), ("b", "c", None), ("c", "b", 3), ("d", "d", 4), ("e", "none", None)], "style_id string, based_on string, size int")
    assert sorted(values(cascade.style_chains(loop), "style_id", "ancestor", "depth")) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("b", "b", 0), ("b", "c", 1), ("c", "b", 1), ("c", "c", 0), ("d", "d", 0), ("e", "e", 0)]


def test_chains_and_threads_of_any_length(spark):
    n = 700
    styles = spark.createDataFrame([(k, k - 1 if k else None, 5 if k == 0 else None) for k in range(n)], "style_id int, based_on int, size int")
    assert sorted(values(cascade.flattened(styles, ["size"]).where("style_id in (0, 350, 699)"))) == [(0, 5, 0), (350, 5, 350), (699, 5, 699)]
    edges = spark.createDataFrame([(d, k, k - 1 if k else None, k == 0) for d in (1, 2) for k in range(n)] + [(2, -1, -2, True), (2, -2, -1, False), (2, -3, -2, False)], "doc_id long, para_id long, parent_id long, done boolean")
    got = {(d, p): (r, k, done) for d, p, r, k, done in values(audit.thread_roots(edges))}
    assert len(got) == 2 * n + 3 and all(got[d, k] == (0, k, True) for d in (1, 2) for k in range(n))
    assert got[2, -1][0] == -2 and got[2, -2][0] == -1 and got[2, -3] == (-1, 2, True)


def test_plans_that_contradict_are_refused(spark):
    seg = spark.createDataFrame([(1, 0, "a", True, False, 1, None), (2, 0, "b", True, True, 2, 3), (3, 0, "c", True, False, 4, None), (4, 0, "d", True, False, 5, None)], "doc_id long, pos int, text string, has_ins boolean, has_del boolean, ins_id long, del_id long")
    ids = "doc_id long, revision_id long"
    accepts, rejects = spark.createDataFrame([(1, 1), (2, 3), (3, 9), (4, 5)], ids), spark.createDataFrame([(1, 1), (2, 2)], ids)
    after, refused = revisions.mixed_plan(seg, accepts, rejects)
    assert sorted(values(refused)) == [(1, 1, "contradiction"), (2, 2, "settled_by_accept"), (3, 9, "unknown")]
    assert sorted(values(after, "doc_id", "status")) == [(1, "i"), (2, "s"), (3, "i"), (4, "n")]


def test_audit_of_two_tracked_versions(spark):
    schema = "doc_id long, pos int, seq int, text string, has_ins boolean, has_del boolean, author string"
    same = [(1, 0, 0, "kept", False, False, None), (1, 1, 0, "prior", True, False, "you")]
    before = spark.createDataFrame([*same, (2, 0, 0, "x", False, False, None), (2, 1, 0, "y", False, True, "you")], schema)
    after = spark.createDataFrame([*same, (1, 0, 1, " and more", True, False, "me"), (2, 0, 0, "changed", False, False, None)], schema)
    got = audit.audited(before, after)
    rows = {r["doc_id"]: r for r in got["counts"].collect()}
    assert (rows[1]["direct"], rows[1]["untouched"], rows[1]["new"], rows[1]["violations"], rows[1]["delivers"]) == (0, 1, 1, 0, True)
    assert rows[2]["direct"] > 0 and rows[2]["resolved"] == 1 and not rows[2]["delivers"]
    assert {r["prior"] for r in got["direct"].where("doc_id = 2 and base_pos = 1").collect()} == {"delete:you:1"}
    ids = "artifact string, revision_id long"
    task = audit.verified_task(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], ids), spark.createDataFrame([("a", 1), ("b", 7), ("c", 3)], ids), spark.createDataFrame([("a", True), ("b", True), ("c", False)], "artifact string, delivers boolean"))
    assert {r["artifact"]: (r["missing"], r["undeclared"], r["verified"]) for r in task.collect()} == {"a": (0, 0, True), "b": (1, 1, False), "c": (0, 0, False)}


def test_cascades_of_paragraphs_and_fonts(spark):
    styles = spark.createDataFrame([("A", None, "left", 10), ("B", "A", None, 20)], "style_id string, based_on string, alignment string, spacing int")
    paragraphs = spark.createDataFrame([(1, 0, "B", None, None), (1, 1, "B", "right", None), (1, 2, "No", None, None), (1, 3, None, None, 5)], "doc_id long, pos int, style_id string, alignment string, spacing int")
    defaults = spark.createDataFrame([("both", 0)], "alignment string, spacing int")
    assert sorted(values(cascade.paragraph_cascade(paragraphs, styles, defaults), "pos", "alignment", "spacing")) == [(0, "left", 20), (1, "right", 20), (2, "both", 0), (3, "both", 5)]
    runs = spark.createDataFrame([(1, "minorAscii", "Times"), (1, "majorBidi", "Times"), (1, None, "Times"), (2, "minorHAnsi", None)], "doc_id long, theme_ref string, font string")
    fonts = spark.createDataFrame([(1, "minor_latin", "Calibri")], "doc_id long, slot string, font string")
    assert sorted(values(cascade.resolved_fonts(runs, fonts), "doc_id", "theme_ref", "effective_font"), key=str) == sorted([(1, "minorAscii", "Calibri"), (1, "majorBidi", "Times"), (1, None, "Times"), (2, "minorHAnsi", None)], key=str)
    lists = "num_id int, ilvl int, kind string, start int"
    one, two = spark.createDataFrame([(1, 0, "decimal", None), (2, 0, "roman", 1), (3, 0, "x", 1)], lists), spark.createDataFrame([(1, 0, "decimal", None), (2, 0, "roman", 2)], lists)
    assert sorted(values(cascade.same_numbering(one, two, ["num_id", "ilvl"], ["kind", "start"]))) == [(1, 0, True), (2, 0, False), (3, 0, False)]


def test_revision_tables(spark):
    rows = spark.createDataFrame([(1, "new", "old"), (2, "new", None)], "id long, props string, previous_props string")
    assert sorted(values(revisions.restored_properties(rows, False), "id", "props")) == [(1, "old"), (2, "new")] and sorted(values(revisions.restored_properties(rows, True), "id", "props")) == [(1, "new"), (2, "new")]
    ids = "note_id long"
    assert values(revisions.unreferenced(spark.createDataFrame([(1,), (2,)], ids), spark.createDataFrame([(2,), (2,)], ids))) == [2]
    marks = spark.createDataFrame([(1, "start"), (1, "end"), (2, "start")], "range_id long, side string")
    assert values(revisions.torn_ranges(marks), "range_id") == [2]
    moves = spark.createDataFrame([(7, 1), (7, 2), (8, 3)], "move_id long, revision_id long")
    assert sorted(values(revisions.whole_moves(spark.createDataFrame([(1,)], "revision_id long"), moves))) == [1, 2]
    b = spark.createDataFrame([(1, 0, "a", "p0"), (1, 1, "mark", "m"), (1, 2, "b", "p2")], "doc_id long, pos int, text string, props string")
    assert values(revisions.joined_marks(b, F.col("pos") == 0, "props", F.col("props") == "m"), "text", "props") == [("ab", "p2")]
    assert values(spark.range(1).select(T.identity_tag(F.lit("field"), F.lit("x")), ordered.tab_stops(2000, 720))) == [("field:2d711642b726", [720, 1440])]
    changes = spark.createDataFrame([(1, 0, "deleted", 0, None, "e1", None), (1, 1, "inserted", None, 0, None, "e2"), (1, 2, "matched", 1, 1, "t", "t")], "doc_id long, seq int, change_type string, base_pos int, target_pos int, old_text string, new_text string")
    alike = F.coalesce("old_text", "new_text").startswith("e")
    assert sorted(values(stories.paired_replacements(changes, alike), "seq", "change_type", "base_pos", "target_pos", "new_text")) == [(0, "modified", 0, 0, "e2"), (2, "matched", 1, 1, "t")]
    paths = spark.createDataFrame([("/a/b",), ("/a/c",)], "path string")
    assert values(validate.nested_in(paths, "path", "/b$", "R"), "subject") == ["/a/b"] and values(validate.too_many(paths, 1, "R"), "subject") == ["2"]
    set_ = transactions.set_property(spark.createDataFrame([(1, "a")], "id long, p string"), spark.createDataFrame([(1, 0, "b"), (1, 1, "c")], "id long, seq int, value string"), ["id"], "p")
    assert values(set_, "p", "previous_p") == [("c", "a")]




def test_toggles_inherit_null(spark):
    df = spark.createDataFrame([(None, False, True), (None, None, None), (True, False, False)], "a boolean, b boolean, c boolean")
    assert values(df.select(cascade.effective(F.col("a"), F.col("b"), F.col("c"), F.lit(None).cast("boolean")))) == [False, None, True]


def test_unlike_modifications_split(spark):
    changes = spark.createDataFrame([(1, 0, "modified", 0, 0, "alpha beta gamma delta epsilon", "zwölf boxkämpfer jagen viktor quer"), (1, 1, "modified", 1, 1, "", "new text")], "doc_id long, seq int, change_type string, base_pos int, target_pos int, old_text string, new_text string")
    got = values(diffing.with_unrelated_split(changes).orderBy("seq", "part"), "seq", "change_type")
    assert got == [(0, "deleted"), (0, "inserted"), (1, "deleted"), (1, "inserted")]


def test_paragraph_split_is_found(spark):
    whole, first, second = "The first part of the clause. And the second part of it.", "The first part of the clause.", "And the second part of it."
    rows = [
        (1, 0, "modified", 0, 0, whole, first), (1, 1, "inserted", None, 1, None, second),
        (2, 0, "inserted", None, 0, None, "The first part of that clause."), (2, 1, "modified", 0, 1, whole, second),
        (3, 0, "modified", 0, 0, whole, "Quite another thing stands here now"), (3, 1, "inserted", None, 1, None, second),
        (4, 0, "modified", 0, 0, whole, first), (4, 1, "deleted", 1, None, second, None),
    ]
    changes = spark.createDataFrame(rows, "doc_id long, seq int, change_type string, base_pos int, target_pos int, old_text string, new_text string")
    assert sorted(values(diffing.paragraph_splits(changes), "doc_id", "seq", "split")) == [(1, 0, "after"), (2, 1, "before")]


def rows_of_table(*rows):
    return [{"row": n, "para_id": p, "cells": [{"col": c, "text": t, "span": 1} for c, t in enumerate(texts)]} for n, (p, *texts) in enumerate(rows)]


def test_rows_of_tables_align():
    old = rows_of_table((None, "head", "sum"), ("A", "x", "1"), (None, "some words here", "2"), (None, "gone for good", "77"))
    new = rows_of_table((None, "head", "sum"), (None, "some words there", "2"), ("A", "entirely new", "9"), (None, "zzzz", "qqqq"))
    assert table_diff.aligned_rows(old[:1], []) == [(0, None)] and table_diff.aligned_rows([], new[:1]) == [(None, 0)]
    got = table_diff.aligned_rows(old, new)
    assert (0, 0) in got and (1, 2) in got and sorted(i for i, _ in got if i is not None) == [0, 1, 2, 3] and sorted(j for _, j in got if j is not None) == [0, 1, 2, 3]
    for side in (0, 1):
        places = [p[side] for p in got if p[side] is not None]
        assert places == sorted(places)
    # A shared signature pattern but cells without anything in common come apart.
    assert table_diff.aligned_rows(rows_of_table((None, "aaaa", "")), rows_of_table((None, "bbbb", ""))) in ([(0, None), (None, 0)], [(None, 0), (0, None)])


def test_tables_are_compared(spark):
    cells = "table_id long, row int, col int, text string, span int"
    old = spark.createDataFrame([(1, 0, 0, "a", 1), (1, 0, 1, "the old words", 1), (1, 1, 0, "goes", 2), (2, 0, 0, "same", 1), (3, 0, 0, "only here", 1)], cells)
    new = spark.createDataFrame([(1, 0, 0, "a", 2), (1, 0, 1, "the new words", 1), (2, 0, 0, "same", 1), (4, 0, 0, "only there", 1)], cells)
    changes = table_diff.of_cells(old, new)
    got = sorted(values(changes, "table_id", "old_row", "new_row", "col", "cell_change"), key=str)
    assert got == sorted([("1", 0, 0, 0, "merge_changed"), ("1", 0, 0, 1, "modified"), ("1", 1, None, 0, "deleted"), ("2", 0, 0, 0, "unchanged"), ("3", 0, None, 0, "deleted"), ("4", None, 0, 0, "inserted")], key=str)
    ops = changes.where("cell_change = 'modified'").first()["ops"]
    assert "".join(o["text"] for o in ops if o["op"] != "insert") == "the old words" and "".join(o["text"] for o in ops if o["op"] != "delete") == "the new words"
    kinds = "table_id long, row int, col int, kinds string"
    none = spark.createDataFrame([], kinds)
    assert dict(values(table_diff.table_changes(changes, none, none))) == {"1": "structure_changed", "2": "unchanged", "3": "structure_changed", "4": "structure_changed"}
    two = spark.createDataFrame([(2, 0, 0, "paragraph,paragraph")], kinds)
    assert dict(values(table_diff.table_changes(changes, none, two)))["2"] == "structure_changed"
    nested = "table_id string, parent_id long, row int, col int, nth int"
    pairs = table_diff.nested_pairs(changes, spark.createDataFrame([("n1", 1, 0, 1, 0), ("n2", 1, 1, 0, 0)], nested), spark.createDataFrame([("m1", 1, 0, 1, 0), ("m9", 4, 0, 0, 0)], nested))
    assert sorted(values(pairs), key=str) == sorted([("n1", "m1", "paired"), ("n2", None, "deleted"), (None, "m9", "inserted")], key=str)


def test_tracked_tables_have_two_texts(spark):
    rows = [(1, 0, 0, 0, 0, "kept ", False, False), (1, 0, 0, 0, 1, "new", True, False), (1, 0, 0, 0, 2, "old", False, True), (1, 0, 1, 0, 0, " ", False, False), (1, 1, 0, 0, 0, "both", True, True), (1, 2, 0, 0, 0, "row", True, False)]
    seg = spark.createDataFrame(rows, "table_id long, row int, col int, block int, seq int, text string, has_ins boolean, has_del boolean")
    assert values(table_diff.tracked_texts(seg)) == [(1, "kept old", "kept new row")]


PAIRS = [(["a"], ["a"]), (["a", "b"], ["a"]), (["a"], ["a", "b"]), (["a", "old end"], ["a", "fresh words"]), (["x y z"], ["q r s"]), (["one", "two"], ["three is new", "four is new", "five too"]), (["k", "", "m"], ["", "m", "n"]), (["d1 gone", "d2 gone"], ["kept not"]), ([""], ["a"]), (["a long line of words here", "b"], ["a long line of other words here", "c", "b"])]


def test_redlines_accept_to_the_target_and_reject_to_the_base(spark):
    """As written packages, resolved on their XML."""
    pairs = spark.createDataFrame([(n, a, b) for n, (a, b) in enumerate(PAIRS)], "doc_id long, old array<string>, new array<string>")
    made = docx.write_redlines(diffing.redline(diffing.compared(pairs)), "me", "2024-01-01T00:00:00Z")
    for accept in (True, False):
        done = docx_resolve.resolved(made, accept)
        got = {}
        for doc, pos, text in sorted(values(docx.blocks(done), "doc_id", "pos", "text")):
            got.setdefault(int(doc), []).append(text)
        assert got == {n: list(b if accept else a) for n, (a, b) in enumerate(PAIRS)}
    facts = docx_elements.package_facts(made)
    assert [r for r in values(package_rules.findings_of(facts), "rule_id") if r != "I-REL-001"] == []



def test_grid_orphans(spark):
    cells = spark.createDataFrame([(1, 0, 0, "continue"), (1, 1, 0, "start"), (1, 2, 0, "continue")], "table_id long, row long, col long, merge string")
    assert sorted(values(grid.vertical_merges(cells), "row", "row_span", "orphan")) == [(0, 1, True), (1, 2, False)]


def test_islands_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, None), (1, 2, "x")], "doc_id long, pos int, v string")
    assert values(ordered.islands(df, "doc_id", "pos", F.col("v")).orderBy("pos"), "island") == [1, 1, 2]


def test_new_findings_and_verdict(spark):
    one = validate.out_of_range(spark.range(5), "id", 0, 3, "R")
    assert values(validate.new_findings(one, one), "subject") == []
    assert values(validate.verdict(one)) == [(1, 0, False)]


def test_transaction_is_atomic(spark):
    b = blk(spark, "a", "b", "c")
    edits = spark.createDataFrame([(1, 1, 0, "replace", 0, None, None, None, "A", "me"), (1, 1, 1, "delete", 1, None, None, "not b", None, "me")], transactions.EDITS)
    after, outcomes = transactions.applied(transactions.State.of(b), edits)
    assert values(after.blocks.orderBy("pos"), "text") == ["a", "b", "c"]
    assert sorted(values(outcomes, "seq", "code", "outcome")) == [(0, "ok", "rolled_back"), (1, "stale_edit", "refused")]
    bad = [(1, 1, 0, "fly", 0, "me"), (1, 1, 1, "insert", None, "me"), (1, 1, 2, "insert", 1, None), (1, 1, 3, "table_op", None, "me"), (1, 1, 4, "set_format", 0, "me"), (1, 1, 5, "insert", 0, "me")]
    faults = transactions.schema_faults(transactions.edits_of(spark.createDataFrame(bad, "txn_id long, doc_id long, seq int, op string, pos int, author string")))
    assert values(faults.orderBy("seq"), "code") == ["unknown_op", "missing_target", "missing_author", "missing_target", "missing_name", "missing_value"]
    assert transactions.operation_catalog(spark).select("op").distinct().count() == 49
    assert {r["op"] for r in transactions.operation_catalog(spark).collect()} == {r["op"] for r in transactions.acts(spark).collect()}


SIDE = [("style", "Title"), ("bookmark", "b1"), ("image", "i1"), ("comment", "c1"), ("note", "n1"), ("header", "h1"), ("footer", "f1"), ("control", "k1"), ("form_field", "x1"), ("textbox", "t1"), ("opaque", "o1")]


def whole_state(spark):
    cells = [(1, "T", r, c, f"{r}{c}") for r in range(3) for c in range(2)]
    props = [(1, "paragraph", "0", "align", "left")]
    return transactions.State.of(
        blk(spark, "a", "b", "c|d", "e|f", "g"), spark.createDataFrame(cells, transactions.CELLS), spark.createDataFrame(props, transactions.PROPERTIES), spark.createDataFrame([(1, k, n, None, 0, "old", "you", False) for k, n in SIDE], transactions.SIDE)
    )


def run_edits(spark, *rows, **more):
    """Edits of (op, pos, target, name, expect, value) as one transaction on the state above."""
    edits = spark.createDataFrame([(1, 1, n, op, pos, target, name, expect, value, "me") for n, (op, pos, target, name, expect, value) in enumerate(rows)], transactions.EDITS)
    after, outcomes = transactions.applied(whole_state(spark), edits, **more)
    return after, [r["code"] for r in outcomes.orderBy("seq").collect()]


def test_every_operation_acts_on_its_own_table(spark):
    """Each of the 49 operations alone: it is applied, and one table differs, or it is refused."""
    before = whole_state(spark)
    tables = {n: sorted(map(str, getattr(before, n).collect())) for n in ("blocks", "cells", "properties", "side")}
    example = {"replace": (0, None, None, None, "A"), "insert": (0, None, None, None, "x"), "delete": (0, None, None, None, None), "move": (0, None, None, None, "3"), "blocks_to_table": (2, "3", None, None, "|"), "table_op": (None, "T/1", "delete_row", None, None)}
    for op, kind in transactions.ON_SIDE["add"].items():
        example[op] = (0, "fresh", "c1" if op == "comment_reply" else None, None, "b1" if op == "insert_cross_ref" else "x")
    for act in ("text", "rename", "resolve", "remove"):
        for op, kind in transactions.ON_SIDE[act].items():
            example[op] = (None, dict(SIDE)[kind], None, "old" if act == "text" else None, "new")
    where = {"paragraph": (0, None), "run": (0, None), "cell": (None, "T/0/1"), "row": (None, "T/0"), "table": (None, "T"), "image": (None, "i1"), "section": (None, "0"), "document": (None, None)}
    for op, scope in transactions.ON_PROPERTIES.items():
        example[op] = (*where[scope], "p", None, "Title" if op == "apply_style" else "v")
    rows, docs = [], sorted(example)
    assert len(docs) == 49
    for n, op in enumerate(docs):
        pos, target, name, expect, value = example[op]
        rows.append((n, 100 + n, 0, op, pos, target, name, expect, value, "me"))
    copies = spark.createDataFrame([(100 + n,) for n in range(49)], "id long")
    state = transactions.State(*(getattr(before, n).crossJoin(copies).withColumn("doc_id", F.col("id")).drop("id") for n in ("blocks", "cells", "properties", "side")))
    after, outcomes = transactions.applied(state, spark.createDataFrame(rows, transactions.EDITS))
    assert {r["op"]: r["outcome"] for r in outcomes.collect() if r["outcome"] != "applied"} == {}
    touched = {op: set() for op in docs}
    for name in tables:
        old, new = {}, {}
        for target, df in ((old, getattr(state, name)), (new, getattr(after, name).drop("previous_value"))):
            for r in df.collect():
                target.setdefault(r["doc_id"], []).append(tuple(v for k, v in sorted(r.asDict().items()) if k != "doc_id"))
        for n, op in enumerate(docs):
            if sorted(old.get(100 + n, []), key=str) != sorted(new.get(100 + n, []), key=str):
                touched[op].add(name)
    want = {op: {a.split(".")[0]} for op, a in ((r["op"], r["act"]) for r in transactions.acts(spark).collect())}
    want["blocks_to_table"] = {"blocks", "cells"}
    assert touched == want


def test_block_and_table_operations(spark):
    after, codes = run_edits(spark, ("replace", 1, None, None, "b", "B"), ("move", 1, None, None, None, "4"), ("insert", 4, None, None, None, "end"), ("blocks_to_table", 2, "3", None, None, "|"))
    assert codes == ["ok"] * 4
    assert values(after.blocks.orderBy("pos"), "pos", "text") == [(0, "a"), (1, "g"), (2, "B"), (3, "end")]
    assert sorted(values(after.cells.where("table_id <> 'T'"), "row", "col", "text")) == [(0, 0, "c"), (0, 1, "d"), (1, 0, "e"), (1, 1, "f")]
    ops = (("table_op", None, "T/0", "insert_row", None, "x\ty"), ("table_op", None, "T/1", "delete_row", None, None), ("table_op", None, "T/2/1", "set_cell_text", "21", "new"), ("table_op", None, "T//0", "insert_column", None, "p\nq\nr"))
    after, codes = run_edits(spark, *ops)
    assert codes == ["ok"] * 4
    grid_rows = {}
    for r in after.cells.orderBy("row", "col").collect():
        grid_rows.setdefault(r["row"], []).append(r["text"])
    assert grid_rows == {0: ["00", "p", "01"], 1: ["x", "q", "y"], 2: ["20", "r", "new"]}


def test_side_rows_and_references(spark):
    after, codes = run_edits(
        spark, ("insert_bookmark", 0, "b2", None, None, None), ("insert_cross_ref", 1, "r", None, None, "b2"), ("comment_reply", 0, "c2", "c1", None, "why"), ("comment_resolve", None, "c1", None, None, None), ("rename_bookmark", None, "b1", None, None, "b9")
    )
    assert codes == ["ok"] * 5
    rows = {(r["kind"], r["key"]): (r["parent"], r["text"], r["done"]) for r in after.side.collect()}
    assert rows["cross_ref", "r"][0] == "b2" and rows["comment", "c2"] == ("c1", "why", False) and rows["comment", "c1"][2] and ("bookmark", "b9") in rows and ("bookmark", "b1") not in rows
    bad = (
        ("insert_cross_ref", 0, "r", None, None, "b7"), ("insert_bookmark", 0, "b7", None, None, None), ("insert_bookmark", 0, "b1", None, None, None), ("edit_note", None, "n7", None, None, "x"),
        ("edit_note", None, "n1", None, "other", "x"), ("edit_note", None, "n1", None, None, "old"), ("apply_style", 0, None, "style", None, "None"), ("set_para_format", 0, None, "align", None, "left"),
        ("insert_note", 9, "n8", None, None, "x"), ("table_op", None, "T/7", "delete_row", None, None), ("table_op", None, "T/0", "merge_cells", None, None), ("set_image_attrs", None, "i7", "alt", None, "x"),
    )
    after, codes = run_edits(spark, *bad)
    assert codes == ["reference_not_found", "ok", "duplicate_target", "target_not_found", "stale_edit", "no_op_edit", "reference_not_found", "no_op_edit", "anchor_not_found", "target_not_found", "unsupported_op", "reference_not_found"]
    assert after.side.count() == len(SIDE)


def test_properties_keep_what_was_there(spark):
    after, codes = run_edits(spark, ("set_para_format", 0, None, "align", "left", "right"), ("apply_style", 1, None, "style", None, "Title"), ("set_doc_defaults", None, None, "size", None, "24"))
    assert codes == ["ok"] * 3
    assert sorted(values(after.properties, "scope", "target", "name", "value", "previous_value"), key=str) == [("document", "", "size", "24", None), ("paragraph", "0", "align", "right", "left"), ("paragraph", "1", "style", "Title", None)]


def test_authors_of_revisions_are_not_impersonated(spark):
    owned = spark.createDataFrame([(1, "me"), (1, "")], "doc_id long, author string")
    assert run_edits(spark, ("delete", 0, None, None, None, None), owned=owned)[1] == ["author_impersonation"]
    assert run_edits(spark, ("delete", 0, None, None, None, None), owned=owned.where("author = ''"))[1] == ["ok"]


def test_dominant_needs_its_share(spark):
    df = spark.createDataFrame([(1, "r")] * 9 + [(1, "g")] + [(2, "r")] * 10 + [(3, None)], "doc long, color string")
    assert sorted(values(roles.dominant(df, "doc", "color"))) == [(1, None, 10), (2, "r", 10), (3, None, 1)]


# --- packages -----------------------------------------------------------------------------


def packages(spark, *contents):
    return spark.createDataFrame([(str(n), bytearray(c)) for n, c in enumerate(contents)], "doc_id string, content binary")


def test_package_is_deterministic_and_tracked(spark, tmp_path):
    made = docx.package([docx.paragraph_xml([("normal", "the quick "), ("deleted", "brown"), ("inserted", "red"), ("stacked", "x"), ("normal", " fox")], "me", "2020")])
    assert made == docx.package([docx.paragraph_xml([("normal", "the quick "), ("deleted", "brown"), ("inserted", "red"), ("stacked", "x"), ("normal", " fox")], "me", "2020")])
    (tmp_path / "a.docx").write_bytes(made)
    read = docx.read_packages(spark, str(tmp_path))
    assert values(docx.spans(read), "status", "author", "text") == [("normal", None, "the quick "), ("deleted", "me", "brown"), ("inserted", "me", "red"), ("stacked", "me", "x"), ("normal", None, " fox")]
    assert values(docx.blocks(read), "doc_id", "pos", "block_type", "text") == [("a.docx", 0, "paragraph", "the quick red fox")]
    assert values(docx.relationships(read), "rel_type", "target") == [("officeDocument", "word/document.xml")]
    assert ("override", "/word/document.xml") in values(docx.content_types(read), "sort", "name")


def test_hostile_packages_are_rows(spark):
    bomb = docx.packed({"../evil": b"x"})
    twice = docx.packed({"A.xml": b"x", "a.xml": b"y"})
    typed = docx.packed({docx.MAIN_PART: b"<!DOCTYPE x><x/>"})
    deep = docx.packed({docx.MAIN_PART: b"<a>" * 600 + b"</a>" * 600})
    df = packages(spark, b"no zip", bomb, twice)
    assert [e for e in values(docx.parts(df), "error")] == ["not a package", "path leaves the package", "repeated name"]
    late = docx.packed({docx.MAIN_PART: b"<!--" + b"x" * 5000 + b"--><!DOCTYPE x [<!ENTITY e 'boom'>]><x>&e;</x>"})
    wide = docx.packed({docx.MAIN_PART: "<?xml version='1.0' encoding='utf-16'?><!DOCTYPE x><x/>".encode("utf-16")})
    cut = docx.packed({docx.MAIN_PART: b"<a><b></a>"})
    got = values(docx.blocks(packages(spark, typed, deep, docx.packed({"x": b""}), late, wide, cut)), "block_type", "text")
    assert got[:5] == [("error", "document type"), ("error", "too deep"), ("error", "no main part"), ("error", "document type"), ("error", "document type")] and got[5][1].startswith("malformed")


def test_equal_names_in_two_folders_are_two_documents(spark, tmp_path):
    for folder in ("a b", "c"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.docx").write_bytes(docx.package([docx.paragraph_xml([("normal", folder)])]))
    assert docx.blocks(docx.read_packages(spark, str(tmp_path))).select("doc_id").distinct().count() == 2


def test_html_is_tolerant():
    assert html.block_rows("<h1>A</h1><p>b <b>c<br><p>d<script>var x='</p>'</script>") == [("h1", "A"), ("p", "b c"), ("p", "d")]
    assert html.block_rows(None) == []


def test_data_uri_holds_all_bytes(spark):
    import base64

    texts = ["", "short", "x" * 48, "y" * 49, "é😀\n" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(values(blocks.identity(df), "doc_id", "data_uri"))
    assert got == {n: "data:text/plain;base64," + base64.b64encode(t.encode()).decode() for n, t in enumerate(texts)}


def test_sessions_are_evicted_when_idle(spark):
    held = session.Sessions(ttl=10)
    one = held.put(spark.range(3), now=0)
    two = held.clone(one, now=8)
    assert held.get(one, now=9).count() == 3 and held.evict(now=15) == [] and held.evict(now=18.5) == [two] and held.evict(now=19.5) == [one]
    held.put(spark.range(1), now=19)
    assert held.evict(now=50) and held.evict(now=50) == []
    with pytest.raises(KeyError):
        held.get(two, now=51)


def test_renders_of_blocks(spark):
    b = spark.createDataFrame([(1, 0, "a", 3, 1), (1, 1, "", 0, 0), (1, 2, "c", None, None)], "doc_id long, pos int, text string, num_id long, ilvl int")
    got = {r["pos"]: (len(r["segments"]), r["list"] and (r["list"]["num_id"], r["list"]["ilvl"])) for r in stories.render_single(b).collect()}
    assert got == {0: (1, (3, 1)), 1: (0, None), 2: (1, None)} and stories.render_single(b.select("doc_id", "pos", "text")).where("list is not null").count() == 0
    rows = [(1, 0, 0, "a", False, False, None), (1, 0, 1, "b", False, False, None), (1, 0, 2, "x", True, False, "me"), (1, 0, 3, "y", True, True, "me"), (1, 1, 0, "gone", False, True, "me"), (1, 2, 0, "new", True, False, "me"), (1, 3, 0, "s", False, False, None), (1, 3, 1, "\ufffc", False, False, None)]
    seg = spark.createDataFrame(rows, "doc_id long, pos int, seq int, text string, has_ins boolean, has_del boolean, author string")
    got = {r["pos"]: (r["status"], [(x["op"], x["text"]) for x in r["segments"]]) for r in stories.render_tracked(seg).collect()}
    assert got == {0: ("modified", [("equal", "ab"), ("insert", "x"), ("delete", "y")]), 1: ("deleted", [("delete", "gone")]), 2: ("inserted", [("insert", "new")]), 3: ("unchanged", [("equal", "s"), ("equal", "\ufffc")])}


def test_comments_pair_as_notes_do(spark):
    """The comments of two packages, through the same three passes."""
    schema = "doc_id long, comment_id long, text string"
    old, new = (spark.createDataFrame(rows, schema).withColumnRenamed("comment_id", "note_id") for rows in ([(1, 1, "why"), (1, 2, "moved away")], [(1, 1, "why not"), (1, 5, "moved away")]))
    assert set(values(matching.note_pairs(old, new), "old", "new", "how")) == {(1, 1, "modified"), (2, 5, "renumbered")}
