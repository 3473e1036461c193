"""Every registered query against its SQL, on whole tables; those without SQL against laws."""

import pytest
from results import rows_of, rows_of_sql

from palimpsest.plans import block_queries, edit_queries, registry, revision_queries

ASSETS = registry.queries()
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, data, oracle):
    assert rows_of(ASSETS[name](spark, data)) == rows_of_sql(oracle, SQL[name])


def test_all_are_registered():
    assert len(ASSETS) > 70
    assert block_queries.replace_gated and revision_queries.mixed_plan and edit_queries.package_findings


def test_ordered_anchors_keep_their_order(spark, data):
    rows = ASSETS["ordered_anchors"](spark, data).toPandas().sort_values(["doc_id", "base_pos"])
    step = rows.groupby("doc_id")["target_pos"].diff().dropna()
    assert len(rows) and (step > 0).all()


def test_alignment_uses_every_block_once(spark, data, oracle):
    rows = ASSETS["align_blocks"](spark, data).toPandas()
    both = oracle.execute(f"WITH {block_queries.BLK}, {block_queries.TGT} SELECT (SELECT count(*) FROM blk), (SELECT count(*) FROM tgt)").fetchall()[0]
    assert (rows.base_pos.notna().sum(), rows.target_pos.notna().sum()) == both
    assert rows[rows.change_type == "matched"].eval("old_text == new_text").all()


def test_inline_ops_are_minimal_runs(spark, data):
    rows = ASSETS["inline_ops"](spark, data).toPandas().sort_values(["doc_id", "seq", "n"])
    same = (rows.op == rows.groupby(["doc_id", "seq"]).op.shift()) & (rows.op != "equal")
    assert len(rows) and not same.any()


def test_insertion_anchors_point_before(spark, data):
    rows = ASSETS["insertion_anchors"](spark, data).toPandas()
    assert len(rows) and (rows.target_pos >= 0).all()


def test_full_numbering_agrees_with_counters(spark, data):
    full = ASSETS["numbering_full"](spark, data).where("doc_id % 2 = 0").toPandas().set_index(["doc_id", "pos"]).label
    simple = ASSETS["numbering_labels"](spark, data).toPandas().set_index(["doc_id", "pos"]).label
    shared = full.index.intersection(simple.index)
    tops = [i for i in shared if simple[i].count(".") == 1 and simple[i].endswith(".")]
    assert tops and all(full[i] == simple[i] for i in tops)


def test_table_rows_align(spark, data):
    rows = ASSETS["aligned_table_rows"](spark, data).toPandas()
    assert set(rows.cell_change) <= {"modified", "deleted", "inserted", "unchanged", "merge_changed"}
    assert not rows.duplicated(["table_id", "old_row", "new_row", "col"]).any() and not rows.dropna(subset=["old_row"]).duplicated(["table_id", "old_row", "col"]).any()


def test_html_blocks_have_text_only(spark, data):
    rows = ASSETS["html_blocks"](spark, data).toPandas()
    assert len(rows) and not rows.text.str.contains("track\\(").any() and (rows.text.str.strip() != "").all()
