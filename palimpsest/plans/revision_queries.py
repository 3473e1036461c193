"""Queries over revisions, tables, styles, comments and packages.

The corpus has no tracked documents, so ``events`` stands for them: a user is a
document, an event a segment in order of its id, and the id's divisors say whether
it was inserted or deleted. SQL repeats the same rule.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.operators import audit, blocks, cascade, diffing, grid, lines, matching, ordered, revisions, roles, stories, table_diff, transactions, validate
from palimpsest.operators.versions import revised
from palimpsest.plans.block_queries import BLK, GONE, TGT
from palimpsest.plans.registry import query
from palimpsest.sources import docx, html

SEG = (
    "seg AS (SELECT user_id AS doc_id, event_id AS pos, event_type AS text, event_id % 3 = 1 AS has_ins, event_id % 4 = 1 AS has_del, "
    "CASE WHEN event_id % 3 = 1 THEN event_id * 2 END AS ins_id, CASE WHEN event_id % 4 = 1 THEN event_id * 2 + 1 END AS del_id, 'a' || (event_id % 7) AS author FROM events)"
)
STATUS = "CASE WHEN has_ins AND has_del THEN 's' WHEN has_ins THEN 'i' WHEN has_del THEN 'd' ELSE 'n' END"


def segments(t):
    e = F.col("event_id")
    return t.events.select(
        F.col("user_id").alias("doc_id"),
        e.alias("pos"),
        F.col("event_type").alias("text"),
        (e % 3 == 1).alias("has_ins"),
        (e % 4 == 1).alias("has_del"),
        F.when(e % 3 == 1, e * 2).alias("ins_id"),
        F.when(e % 4 == 1, e * 2 + 1).alias("del_id"),
        F.concat(F.lit("a"), e % 7).alias("author"),
    )


def revision_rows(t):
    """A row per revision: its id, kind, author and content."""
    seg = segments(t)
    one = seg.where("has_ins").select("doc_id", "pos", F.col("ins_id").alias("revision_id"), F.lit("insert").alias("kind"), "author", "text")
    two = seg.where("has_del").select("doc_id", "pos", F.col("del_id").alias("revision_id"), F.lit("delete").alias("kind"), "author", "text")
    return one.unionByName(two)


REV = "rev AS (SELECT doc_id, pos, ins_id AS revision_id, 'insert' AS kind, author, text FROM seg WHERE has_ins UNION ALL SELECT doc_id, pos, del_id, 'delete', author, text FROM seg WHERE has_del)"


@query(f"WITH {SEG} SELECT doc_id, coalesce(string_agg(CASE WHEN NOT has_del THEN text END, ' ' ORDER BY pos), '') AS plain, count(*) FILTER (NOT has_del) AS n_kept FROM seg GROUP BY doc_id")
def accept_projection(t):
    return revisions.projected_text(segments(t), accept=True)


@query(f"WITH {SEG} SELECT doc_id, coalesce(string_agg(CASE WHEN NOT has_ins THEN text END, ' ' ORDER BY pos), '') AS plain, count(*) FILTER (NOT has_ins) AS n_kept FROM seg GROUP BY doc_id")
def reject_projection(t):
    return revisions.projected_text(segments(t), accept=False)


@query(f"WITH {SEG}, {REV} SELECT author, kind, count(*) AS n FROM rev GROUP BY author, kind")
def author_kind_summary(t):
    return revision_rows(t).groupBy("author", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {SEG}, {REV} SELECT DISTINCT doc_id, author FROM rev")
def revision_authors(t):
    return revision_rows(t).select("doc_id", "author").distinct()


@query("SELECT user_id AS doc_id, event_type AS part, count(*) AS n, count(DISTINCT props) AS kinds FROM events GROUP BY ROLLUP (user_id, event_type) HAVING user_id IS NOT NULL")
def revision_counts_rollup(t):
    return revisions.part_counts(t.events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("part"), "props"), "doc_id", "part", "props")


@query(
    "WITH h AS (SELECT *, event_id % 2 AS half FROM events), b AS (SELECT user_id AS doc_id, event_type AS kind, props AS excerpt, event_id AS id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS nth FROM h WHERE half = 0), "
    "a AS (SELECT user_id AS doc_id, event_type AS kind, props AS excerpt, event_id AS id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS nth FROM h WHERE half = 1), "
    "s AS (SELECT b.doc_id, b.kind, b.id AS before, a.id AS after FROM b JOIN a USING (doc_id, kind, excerpt, nth)), "
    "lb AS (SELECT doc_id, kind, id, row_number() OVER (PARTITION BY doc_id, kind ORDER BY id) AS nth FROM b WHERE id NOT IN (SELECT before FROM s)), la AS (SELECT doc_id, kind, id, row_number() OVER (PARTITION BY doc_id, kind ORDER BY id) AS nth FROM a WHERE id NOT IN (SELECT after FROM s)) "
    "SELECT doc_id, kind, before, after, 'untouched' AS disposition FROM s UNION ALL SELECT doc_id, kind, lb.id, la.id, CASE WHEN lb.id IS NULL THEN 'new' WHEN la.id IS NULL THEN 'resolved' ELSE 'modified' END FROM lb FULL JOIN la USING (doc_id, kind, nth)"
)
def census_match(t):
    rows = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("kind"), F.col("props").alias("excerpt"), F.col("event_id").alias("place"))
    return matching.census_match(rows.where("place % 2 = 0"), rows.where("place % 2 = 1"), ["doc_id", "kind"], "excerpt", "place")


def selected(t):
    return revision_rows(t).where("author in ('a1', 'a4')").select("revision_id")


_SEL = "sel AS (SELECT revision_id FROM rev WHERE author IN ('a1', 'a4')), f AS (SELECT seg.*, has_ins AND ins_id IN (SELECT revision_id FROM sel) AS si, has_del AND del_id IN (SELECT revision_id FROM sel) AS sd FROM seg)"


@query(f"WITH {SEG}, {REV}, {_SEL} SELECT doc_id, pos, text, CASE WHEN has_ins AND NOT si AND has_del THEN 's' WHEN has_ins AND NOT si THEN 'i' WHEN has_del THEN 'd' ELSE 'n' END AS status FROM f WHERE NOT sd")
def selective_accept(t):
    done = revisions.resolved(segments(t), selected(t), "accept")
    return done.select("doc_id", "pos", "text", revisions.status(F.col("has_ins"), F.col("has_del")).alias("status"))


@query(f"WITH {SEG}, {REV}, {_SEL} SELECT doc_id, pos, text, CASE WHEN has_ins AND has_del AND NOT sd THEN 's' WHEN has_ins THEN 'i' WHEN has_del AND NOT sd THEN 'd' ELSE 'n' END AS status FROM f WHERE NOT si")
def selective_reject(t):
    done = revisions.resolved(segments(t), selected(t), "reject")
    return done.select("doc_id", "pos", "text", revisions.status(F.col("has_ins"), F.col("has_del")).alias("status"))


# Of documents 0 and 1 modulo 3 the plan is sound; the others name an id for both sides, or one that is not there.
_PLAN = (
    f"WITH {SEG}, {REV}, acc AS (SELECT doc_id, revision_id FROM rev WHERE author = 'a1' AND kind = 'delete'), rej AS (SELECT doc_id, revision_id FROM rev WHERE author = 'a2' AND kind = 'insert' UNION SELECT doc_id, revision_id FROM acc WHERE doc_id % 3 = 2), "
    "bad AS (SELECT DISTINCT acc.doc_id FROM acc JOIN rej USING (doc_id, revision_id)), f AS (SELECT seg.*, has_del AND author = 'a1' AS ad, has_ins AND author = 'a2' AS ri, bad.doc_id IS NOT NULL AS bad FROM seg LEFT JOIN bad USING (doc_id)) "
)


def plan_parts(t):
    rev = revision_rows(t)
    accepts = rev.where("author = 'a1' and kind = 'delete'").select("doc_id", "revision_id")
    rejects = rev.where("author = 'a2' and kind = 'insert'").select("doc_id", "revision_id").union(accepts.where("doc_id % 3 = 2"))
    return revisions.mixed_plan(segments(t), accepts, rejects)


@query(_PLAN + "SELECT doc_id, pos, text, CASE WHEN has_ins AND has_del THEN 's' WHEN has_ins THEN 'i' WHEN has_del THEN 'd' ELSE 'n' END AS status FROM f WHERE bad OR (NOT ad AND NOT ri)")
def mixed_plan(t):
    return plan_parts(t)[0].select("doc_id", "pos", "text", "status")


@query(_PLAN + "SELECT acc.doc_id, acc.revision_id, 'contradiction' AS code FROM acc JOIN rej USING (doc_id, revision_id)")
def mixed_plan_refusals(t):
    return plan_parts(t)[1]


@query(f"WITH {SEG}, {REV} SELECT doc_id, string_agg(DISTINCT pos, ',' ORDER BY pos) AS blocks FROM rev GROUP BY doc_id")
def changed_blocks(t):
    return revisions.changed_blocks(revision_rows(t)).select("doc_id", F.array_join("blocks", ",").alias("blocks"))


@query(
    f"WITH {SEG}, {REV}, k AS (SELECT DISTINCT revision_id FROM rev), a AS (SELECT DISTINCT revision_id, true AS a FROM rev WHERE author IN ('a1', 'a2')), r AS (SELECT DISTINCT revision_id, true AS r FROM rev WHERE author IN ('a2', 'a3') UNION SELECT 999999999999, true) "
    "SELECT revision_id, CASE WHEN k.known IS NULL THEN 'unknown' WHEN a AND r THEN 'contradiction' WHEN a THEN 'accept' WHEN r THEN 'reject' ELSE 'leave' END AS disposal FROM (SELECT revision_id, true AS known FROM k) k FULL JOIN a USING (revision_id) FULL JOIN r USING (revision_id)"
)
def set_algebra_plan(t):
    rev = revision_rows(t)
    unknown = t.spark.createDataFrame([(999999999999,)], "revision_id long")
    return revisions.plan_sets(rev, rev.where("author in ('a1', 'a2')").select("revision_id"), rev.where("author in ('a2', 'a3')").select("revision_id").union(unknown))


@query(f"WITH {SEG}, {REV}, b AS (SELECT DISTINCT revision_id FROM rev WHERE kind = 'insert'), a AS (SELECT DISTINCT revision_id FROM rev WHERE revision_id % 5 > 0) SELECT revision_id, 'gone' AS side FROM b ANTI JOIN a USING (revision_id) UNION ALL SELECT revision_id, 'created' FROM a ANTI JOIN b USING (revision_id)")
def created_ids(t):
    rev = revision_rows(t)
    return revisions.created_ids(rev.where("kind = 'insert'"), rev.where("revision_id % 5 > 0"))


@query(f"WITH {SEG}, {REV} SELECT 'a1' AS asked, revision_id, 'ok' AS outcome FROM rev WHERE author = 'a1' UNION SELECT 'nobody', NULL, 'unknown' UNION SELECT '2', 2, CASE WHEN EXISTS (SELECT 1 FROM rev WHERE revision_id = 2) THEN 'ok' ELSE 'unknown' END UNION SELECT '-5', NULL, 'unknown'")
def expanded_selection(t):
    return matching.expanded_selection(revision_rows(t), ["a1", "nobody"], [2, -5])


@query(f"WITH {SEG} SELECT doc_id, count(*) AS n_rows, count(*) FILTER (NOT has_del) AS n_kept FROM (SELECT doc_id * 1000 + pos % 1000 AS doc_id, has_ins, has_del FROM seg) GROUP BY doc_id HAVING count(*) FILTER (NOT has_del) = 0")
def emptied_tables(t):
    return revisions.emptied_tables(segments(t).withColumn("doc_id", F.col("doc_id") * 1000 + F.col("pos") % 1000), accept=True)


@query(
    "WITH s AS (SELECT conv_id AS doc_id, turn AS pos, text, role = 'assistant' AS gone, role AS props FROM conversations), g AS (SELECT *, sum(CASE WHEN coalesce(pg, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS group_no FROM (SELECT *, lag(gone) OVER (PARTITION BY doc_id ORDER BY pos) AS pg FROM s)) "
    "SELECT doc_id, CAST(group_no AS BIGINT) AS group_no, string_agg(text, '' ORDER BY pos) AS text, arg_max(props, pos) AS props, count(*) AS n_joined FROM g GROUP BY doc_id, group_no"
)
def mark_join(t):
    rows = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text", F.col("role").alias("props"))
    return revisions.joined_marks(rows, F.col("props") == "assistant", "props")


@query(
    f"WITH {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY author, text ORDER BY pos) AS ordinal FROM (SELECT doc_id, pos, text, author FROM seg WHERE has_ins)) SELECT doc_id, pos, ordinal, sha256(author || chr(31) || text || chr(31) || ordinal) AS revision_key FROM n"
)
def revision_census(t):
    rows = segments(t).where("has_ins").select("doc_id", "pos", "text", "author")
    return revisions.census(rows, ["author", "text"]).select("doc_id", "pos", "ordinal", "revision_key")


# --- ordered state -------------------------------------------------------------------------

_ISL = "i AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, CASE WHEN lag(1) OVER w IS NULL OR {0} IS DISTINCT FROM lag({0}) OVER w THEN 1 ELSE 0 END AS c FROM {1} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)))"


@query(
    f"WITH {SEG}, {_ISL.format('text', 'seg')}, z AS (SELECT *, count(*) OVER (PARTITION BY doc_id, island) AS size, row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) AS place FROM i), k AS (SELECT * FROM z WHERE size > 1) "
    "SELECT doc_id, pos, 'bg_' || (dense_rank() OVER (PARTITION BY doc_id ORDER BY island) - 1) AS border_group, CASE WHEN place = 1 THEN 'first' WHEN place = size THEN 'last' ELSE 'middle' END AS edge FROM k"
)
def border_groups(t):
    return ordered.border_groups(segments(t), "doc_id", "pos", "text")


@query(f"WITH {SEG}, st AS (SELECT *, {STATUS} AS status FROM seg), {_ISL.format('status', 'st')} SELECT doc_id, any_value(status) AS status, min(pos) AS first_pos, count(*) AS n, string_agg(text, '|' ORDER BY pos) AS text FROM i GROUP BY doc_id, island")
def coalesced_runs(t):
    rows = segments(t).withColumn("status", revisions.status(F.col("has_ins"), F.col("has_del")))
    return ordered.coalesced(rows, "doc_id", "pos", "status", "text")


@query(f"WITH {SEG}, st AS (SELECT *, NOT has_del AS open FROM seg), {_ISL.format('open', 'st')} SELECT doc_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM i WHERE open GROUP BY doc_id, island")
def editable_regions(t):
    return ordered.editable_regions(segments(t), "doc_id", "pos", ~F.col("has_del"))


@query(f"WITH {SEG} SELECT doc_id, pos, CAST(coalesce(sum(CASE WHEN text = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS section FROM seg")
def section_index(t):
    return ordered.running(segments(t), "doc_id", "pos", F.col("text") == "signup", "section").select("doc_id", "pos", "section")


@query(f"WITH {SEG} SELECT doc_id, pos, last_value(CASE WHEN NOT has_ins THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after_pos FROM seg")
def insertion_anchor_window(t):
    return ordered.last_before(segments(t), "doc_id", "pos", F.when(~F.col("has_ins"), F.col("pos")), "after_pos").select("doc_id", "pos", "after_pos")


@query(f"WITH {SEG}, h AS (SELECT doc_id, pos AS section, text AS kind, CASE WHEN pos % 3 = 0 THEN pos END AS ref FROM seg) SELECT doc_id, section, kind, last_value(ref IGNORE NULLS) OVER (PARTITION BY doc_id, kind ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS effective_ref FROM h")
def section_inheritance(t):
    rows = segments(t).select("doc_id", F.col("pos").alias("section"), F.col("text").alias("kind"), F.when(F.col("pos") % 3 == 0, F.col("pos")).alias("ref"))
    return cascade.section_references(rows).select("doc_id", "section", "kind", "effective_ref")


@query("SELECT n, CASE WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) ELSE chr(CAST(96 + (n - 1) // 26 AS INTEGER)) || chr(CAST(97 + (n - 1) % 26 AS INTEGER)) END AS letter, "
    "['','c','cc','ccc','cd','d','dc','dcc','dccc','cm'][n // 100 % 10 + 1] || ['','x','xx','xxx','xl','l','lx','lxx','lxxx','xc'][n // 10 % 10 + 1] || ['','i','ii','iii','iv','v','vi','vii','viii','ix'][n % 10 + 1] AS roman FROM (SELECT DISTINCT CAST(p_size AS BIGINT) + 40 * (p_partkey % 10) AS n FROM part)")
def numeral_formats(t):
    from palimpsest.functions import text as T

    rows = t.part.select((F.col("p_size").cast("long") + 40 * (F.col("p_partkey") % 10)).alias("n")).distinct()
    return rows.select("n", T.letters(F.col("n")).alias("letter"), T.roman(F.col("n")).alias("roman"))


# --- roles and aggregates ----------------------------------------------------------------------


@query("WITH s AS (SELECT p_size, sum(length(p_name)) AS w FROM part GROUP BY p_size) SELECT arg_max(p_size, w * 1000 - p_size) AS value, CAST(max(w) AS BIGINT) AS weight FROM s")
def default_font_size(t):
    return roles.heaviest(t.part, "p_size", F.char_length("p_name").cast("long"))


@query(
    "WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), g AS (SELECT p_brand, CAST(sum(n) AS BIGINT) AS total, max(n) AS top FROM c GROUP BY p_brand) SELECT p_brand, CASE WHEN top > 0.2 * total THEN (SELECT max(p_type) FROM c WHERE c.p_brand = g.p_brand AND c.n = g.top) END AS dominant, total FROM g"
)
def dominant_color(t):
    return roles.dominant(t.part, "p_brand", "p_type", share=0.2)


@query("SELECT p_partkey, CASE WHEN row_number() OVER w = 1 THEN p_name ELSE p_name || '_' || row_number() OVER w END AS unique_id FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)")
def role_suffix(t):
    return roles.suffixed(t.part, "p_name", "p_partkey").select("p_partkey", "unique_id")


@query("SELECT p_type, min(p_partkey) AS first_pos, arg_min(p_name, p_partkey) AS first_use, count(*) AS n FROM part GROUP BY p_type")
def inline_roles(t):
    return roles.first_of_each(t.part, "p_type", "p_partkey", "p_name")


@query(
    "WITH j AS (SELECT conv_id, turn, '{\"role\":\"' || role || '\",\"turn\":' || turn || '}' AS json FROM conversations) SELECT conv_id, sha256('[' || string_agg(json, ',' ORDER BY turn) || ']') AS digest, count(*) AS n FROM j GROUP BY conv_id"
)
def canonical_digest(t):
    return roles.canonical_digest(t.conversations, ["turn", "role"], ["turn"], "conv_id")


# --- grids ------------------------------------------------------------------------------------------

CELLS = "cells AS (SELECT user_id AS table_id, (rn - 1) // 4 AS row, (rn - 1) % 4 AS cell, 1 + event_id % 2 AS grid_span, event_type AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events))"


def cells(t):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1
    return t.events.withColumn("rn", rn).select(F.col("user_id").alias("table_id"), F.floor(F.col("rn") / 4).alias("row"), (F.col("rn") % 4).alias("cell"), (1 + F.col("event_id") % 2).alias("grid_span"), F.col("event_type").alias("text"))


@query(f"WITH {CELLS}, r AS (SELECT table_id, row, sum(grid_span) AS w FROM cells GROUP BY ALL) SELECT table_id, CAST(max(w) AS BIGINT) AS width, count(*) AS n_rows FROM r GROUP BY table_id")
def grid_width(t):
    return grid.grid_width(cells(t))


@query(
    f"WITH {CELLS}, a AS (SELECT *, CAST(coalesce(sum(grid_span) OVER (PARTITION BY table_id, row ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c0 FROM cells) SELECT table_id, row, c0 + unnest(range(grid_span)) AS col, cell AS owner, c0 AS anchor_col FROM a"
)
def grid_owners(t):
    return grid.occupied(cells(t))


@query(f"WITH {CELLS} SELECT table_id, row, string_agg(text || CASE WHEN grid_span > 1 THEN '→' || grid_span ELSE '' END, ' | ' ORDER BY cell) AS signature FROM cells GROUP BY table_id, row")
def row_signature(t):
    return grid.row_signature(cells(t))


@query(f"WITH {CELLS}, l AS (SELECT table_id, row, string_agg(text, chr(9) ORDER BY cell) AS line FROM cells GROUP BY ALL) SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS text FROM l GROUP BY table_id")
def table_text(t):
    return grid.table_text(cells(t))


@query(
    f"WITH {CELLS}, m AS (SELECT table_id, row, cell AS col, CASE WHEN text = 'view' THEN 'continue' ELSE 'start' END AS merge FROM cells), s AS (SELECT *, sum(CASE WHEN merge = 'continue' THEN 0 ELSE 1 END) OVER (PARTITION BY table_id, col ORDER BY row) AS run FROM m) "
    "SELECT table_id, col, min(row) AS row, count(*) AS row_span, arg_min(merge, row) = 'continue' AS orphan FROM s GROUP BY table_id, col, run"
)
def vertical_merges(t):
    rows = cells(t).select("table_id", "row", F.col("cell").alias("col"), F.when(F.col("text") == "view", "continue").otherwise("start").alias("merge"))
    return grid.vertical_merges(rows)


@query(
    f"WITH {CELLS}, o AS (SELECT table_id, row, cell AS col, text, grid_span AS span FROM cells WHERE row % 5 <> 4), n AS (SELECT table_id, row, cell AS col, CASE WHEN cell = 1 THEN text || '!' ELSE text END AS text, CASE WHEN cell = 2 THEN 1 ELSE grid_span END AS span FROM cells WHERE row % 7 <> 6) "
    "SELECT table_id, row, col, CASE WHEN o.span IS NULL THEN 'inserted' WHEN n.span IS NULL THEN 'deleted' WHEN o.text <> n.text THEN 'modified' WHEN o.span <> n.span THEN 'merge_changed' ELSE 'unchanged' END AS cell_change FROM o FULL JOIN n USING (table_id, row, col)"
)
def table_cell_diff(t):
    c = cells(t).withColumnRenamed("cell", "col")
    old = c.where("row % 5 <> 4").withColumnRenamed("grid_span", "span")
    new = c.where("row % 7 <> 6").withColumn("text", F.when(F.col("col") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("span", F.when(F.col("col") == 2, 1).otherwise(F.col("grid_span")))
    return diffing.cell_diff(old, new)


@query(
    f"WITH {CELLS}, d AS (SELECT table_id, row, cell AS col, 'r' || row || ' ' || text AS text, grid_span AS span FROM cells), n AS (SELECT table_id, row, col, CASE WHEN col = 1 THEN text || '!' ELSE text END AS text, CASE WHEN col = 2 THEN 1 ELSE span END AS span FROM d WHERE row % 7 <> 6), k AS (SELECT DISTINCT table_id, row FROM n) "
    "SELECT CAST(table_id AS VARCHAR) AS table_id, CAST(d.row AS INTEGER) AS old_row, CASE WHEN k.row IS NOT NULL THEN CAST(d.row AS INTEGER) END AS new_row, CAST(d.col AS INTEGER) AS col, CASE WHEN k.row IS NULL THEN 'deleted' WHEN d.text <> n.text THEN 'modified' WHEN d.span <> n.span THEN 'merge_changed' ELSE 'unchanged' END AS cell_change, d.text AS old_text, n.text AS new_text "
    "FROM d LEFT JOIN k USING (table_id, row) LEFT JOIN n USING (table_id, row, col)"
)
def table_comparison(t):
    # Rows carry their number as paragraph id, so that the right alignment is known.
    old = cells(t).select("table_id", "row", F.col("cell").alias("col"), F.concat(F.lit("r"), "row", F.lit(" "), "text").alias("text"), F.col("grid_span").alias("span"), F.concat(F.lit("p"), "row").alias("para_id"))
    new = old.where("row % 7 <> 6").withColumn("text", F.when(F.col("col") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("span", F.when(F.col("col") == 2, 1).otherwise(F.col("span")))
    return table_diff.of_cells(old, new).drop("ops")


@query()
def aligned_table_rows(t):
    rows = cells(t).select("table_id", "row", F.col("cell").alias("col"), "text", F.col("grid_span").alias("span"))
    new = rows.where("row % 6 <> 5").withColumn("text", F.replace("text", F.lit("error"), F.lit("warning")))
    return table_diff.of_cells(rows, new).select("table_id", "old_row", "new_row", "col", "cell_change")


# --- cascades, threads, validation, audit -----------------------------------------------------------

_CHAIN = "RECURSIVE s AS (SELECT p_partkey AS style_id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS based_on, CASE WHEN p_partkey % 4 = 0 THEN p_size END AS size, CASE WHEN p_partkey % 7 = 0 THEN p_brand END AS brand FROM part), chain AS (SELECT style_id, style_id AS ancestor, based_on AS next_id, 0 AS depth FROM s UNION ALL SELECT c.style_id, s.style_id, s.based_on, c.depth + 1 FROM chain c JOIN s ON c.next_id = s.style_id WHERE s.style_id <> c.style_id)"


def styles(t):
    k = F.col("p_partkey")
    return t.part.select(k.alias("style_id"), F.when(k > 0, F.floor(k / 3)).alias("based_on"), F.when(k % 4 == 0, F.col("p_size")).alias("size"), F.when(k % 7 == 0, F.col("p_brand")).alias("brand"))


@query(f"WITH {_CHAIN} SELECT c.style_id, arg_min(size, CASE WHEN size IS NOT NULL THEN depth END) AS size, arg_min(brand, CASE WHEN brand IS NOT NULL THEN depth END) AS brand, CAST(max(depth) AS INTEGER) AS depth FROM chain c JOIN s ON c.ancestor = s.style_id GROUP BY c.style_id")
def style_chain(t):
    return cascade.flattened(styles(t), ["size", "brand"])


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 5 = 0 THEN true END, CASE WHEN o_orderkey % 3 = 0 THEN false END, CASE WHEN c_custkey % 2 = 0 THEN true END, false) AS bold FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def toggle_cascade(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", cascade.effective(F.when(F.col("o_orderkey") % 5 == 0, True), F.when(F.col("o_orderkey") % 3 == 0, False), F.when(F.col("c_custkey") % 2 == 0, True), F.lit(False)).alias("bold"))


@query("WITH a AS (SELECT p_partkey AS style_id, p_type AS d FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey AS style_id, CASE WHEN p_partkey % 4 = 0 THEN lower(p_type) ELSE p_type END AS d FROM part WHERE p_partkey % 3 <> 0) SELECT style_id, CASE WHEN b.d IS NULL THEN 'only_left' WHEN a.d IS NULL THEN 'only_right' WHEN a.d = b.d THEN 'same' ELSE 'collision' END AS kind, coalesce(b.d, a.d) AS merged FROM a FULL JOIN b USING (style_id)")
def style_collisions(t):
    k = F.col("style_id")
    rows = t.part.select(F.col("p_partkey").alias("style_id"), F.col("p_type").alias("d"))
    return cascade.collisions(rows.where(k % 5 != 0), rows.where(k % 3 != 0).withColumn("d", F.when(k % 4 == 0, F.lower("d")).otherwise(F.col("d"))), "style_id", "d")


@query(
    "WITH p AS (SELECT o_orderkey, o_custkey AS num_id, CAST(o_orderkey % 3 AS INTEGER) AS ilvl FROM orders), n AS (SELECT c_custkey AS num_id, c_nationkey AS abstract_id, CASE WHEN c_custkey % 11 = 0 THEN 5 END AS o FROM customer), l AS (SELECT n_nationkey AS abstract_id, 0 AS ilvl, 1 AS s FROM nation UNION ALL SELECT n_nationkey, 1, n_regionkey FROM nation) "
    "SELECT o_orderkey, abstract_id, ilvl, CAST(coalesce(o, s, 0) AS INTEGER) AS start FROM p LEFT JOIN n USING (num_id) LEFT JOIN l USING (abstract_id, ilvl)"
)
def numbering_lookup(t):
    paragraphs = t.orders.select("o_orderkey", F.col("o_custkey").alias("num_id"), (F.col("o_orderkey") % 3).cast("int").alias("ilvl"))
    nums = t.customer.select(F.col("c_custkey").alias("num_id"), F.col("c_nationkey").alias("abstract_id"), F.when(F.col("c_custkey") % 11 == 0, 5).alias("start_override"))
    n = t.nation
    levels = n.select(F.col("n_nationkey").alias("abstract_id"), F.lit(0).alias("ilvl"), F.lit(1).alias("level_start")).unionByName(n.select(F.col("n_nationkey").alias("abstract_id"), F.lit(1).alias("ilvl"), F.col("n_regionkey").alias("level_start")))
    return cascade.level_of(paragraphs, nums, levels).select("o_orderkey", "abstract_id", "ilvl", "start")


@query(
    "WITH RECURSIVE e AS (SELECT conv_id AS doc_id, turn AS para_id, CASE WHEN turn > 0 THEN turn - 1 END AS parent_id, role = 'user' AS done FROM conversations), up AS (SELECT doc_id, para_id, para_id AS at_id, parent_id AS next_id, 0 AS depth FROM e UNION ALL SELECT u.doc_id, u.para_id, e.para_id, e.parent_id, u.depth + 1 FROM up u JOIN e ON u.doc_id = e.doc_id AND u.next_id = e.para_id), "
    "l AS (SELECT doc_id, para_id, arg_max(at_id, depth) AS root_id, CAST(max(depth) AS INTEGER) AS depth FROM up GROUP BY ALL) SELECT l.doc_id, l.para_id, root_id, depth, e.done AS root_done FROM l JOIN e ON l.doc_id = e.doc_id AND root_id = e.para_id"
)
def thread_root(t):
    edges = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("para_id"), F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_id"), (F.col("role") == "user").alias("done"))
    return audit.thread_roots(edges)


_FINDINGS = (
    "SELECT 'I-XREF-001' AS rule_id, 'error' AS severity, CAST(doc_id AS VARCHAR) AS subject, 'no such target' AS message FROM (SELECT DISTINCT doc_id FROM documents ANTI JOIN labels USING (doc_id)) UNION ALL "
    "SELECT 'I-REL-002', 'error', CAST(l_orderkey AS VARCHAR) || '/' || l_linenumber, 'not unique' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL "
    "SELECT 'I-ANN-002', 'error', CAST(user_id AS VARCHAR), 'start and end do not pair' FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'signup') <> 1 OR count(*) FILTER (event_type = 'purchase') <> 1 UNION ALL "
    "SELECT DISTINCT 'I-ORD-001', 'warning', CAST(conv_id AS VARCHAR), 'children out of order' FROM (SELECT conv_id, length(role) AS r, lag(length(role)) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b > r UNION ALL "
    "SELECT 'I-PKG-002', 'error', 'AFRICA', 'missing' WHERE NOT EXISTS (SELECT 1 FROM region WHERE lower(r_name) = 'africa') UNION ALL "
    "SELECT 'I-ANN-006', 'error', CAST(p_size AS VARCHAR), 'outside 1..45' FROM part WHERE p_size NOT BETWEEN 1 AND 45"
)


@query(_FINDINGS)
def validation_findings(t):
    marks = t.events.select("user_id", F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").alias("side"))
    children = t.conversations.withColumn("rank", F.char_length("role"))
    return (
        validate.dangling(t.documents, t.labels, "doc_id", "doc_id", "I-XREF-001")
        .union(validate.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], "I-REL-002"))
        .union(validate.unpaired(marks, "user_id", "side", "I-ANN-002"))
        .union(validate.misordered(children, "conv_id", "turn", "rank", "I-ORD-001"))
        .union(validate.required(t.region, "r_name", ["AFRICA"], "I-PKG-002"))
        .union(validate.out_of_range(t.part, "p_size", 1, 45, "I-ANN-006"))
    )


@query(f"WITH f AS ({_FINDINGS}) SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS ok FROM f")
def validation_verdict(t):
    return validate.verdict(validation_findings(t))


_CENSUS = (
    "cb AS (SELECT doc_id, text, pos, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS nth FROM blk WHERE pos % 3 = 0), ca AS (SELECT doc_id, text, pos, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS nth FROM tgt WHERE base_pos % 3 = 0), "
    "cs AS (SELECT cb.doc_id, cb.pos AS before, ca.pos AS after FROM cb JOIN ca USING (doc_id, text, nth)), "
    "xb AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM cb ANTI JOIN (SELECT doc_id, before AS pos FROM cs) USING (doc_id, pos)), xa AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM ca ANTI JOIN (SELECT doc_id, after AS pos FROM cs) USING (doc_id, pos)), "
    "cen AS (SELECT doc_id, before, after, 'untouched' AS d FROM cs UNION ALL SELECT doc_id, xb.pos, xa.pos, CASE WHEN xb.pos IS NULL THEN 'new' WHEN xa.pos IS NULL THEN 'resolved' ELSE 'modified' END FROM xb FULL JOIN xa USING (doc_id, nth))"
)


@query(
    f"WITH {BLK}, {TGT}, {GONE}, {_CENSUS}, mb AS (SELECT DISTINCT doc_id, before AS pos, true AS passed FROM cen WHERE d <> 'untouched' AND before IS NOT NULL), ma AS (SELECT DISTINCT doc_id, after AS pos, true AS passed FROM cen WHERE d <> 'untouched' AND after IS NOT NULL), "
    "l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, text AS l, passed AS pl FROM blk ANTI JOIN gone USING (doc_id, pos) LEFT JOIN mb USING (doc_id, pos)), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, text AS r, passed AS pr FROM tgt ANTI JOIN come USING (doc_id, pos) LEFT JOIN ma USING (doc_id, pos)), "
    "p AS (SELECT doc_id, CASE WHEN count(l) <> count(r) OR count(*) FILTER (l IS DISTINCT FROM r AND pl IS NULL AND pr IS NULL) > 0 THEN 1 ELSE 0 END AS bad FROM l FULL JOIN r USING (doc_id, nth) GROUP BY doc_id), "
    "dc AS (SELECT doc_id, count(*) AS direct FROM (SELECT doc_id FROM gone UNION ALL SELECT doc_id FROM come) GROUP BY doc_id), cc AS (SELECT doc_id, count(*) FILTER (d = 'untouched') AS u, count(*) FILTER (d = 'modified') AS m, count(*) FILTER (d = 'resolved') AS x, count(*) FILTER (d = 'new') AS n FROM cen GROUP BY doc_id) "
    "SELECT doc_id, CAST(coalesce(bad, 0) AS BIGINT) AS violations, coalesce(direct, 0) AS direct, coalesce(u, 0) AS untouched, coalesce(m, 0) AS modified, coalesce(x, 0) AS resolved, coalesce(n, 0) AS new, coalesce(bad, 0) = 0 AND direct IS NULL AND coalesce(m, 0) = 0 AS delivers FROM p FULL JOIN dc USING (doc_id) FULL JOIN cc USING (doc_id)"
)
def audit_counts(t):
    base = blocks.blocks(t.documents)
    target = revised(base)
    one, two = base.where("pos % 3 = 0"), target.where("base_pos % 3 = 0")
    census = matching.census_match(one.select("doc_id", "text", F.col("pos").alias("place")), two.select("doc_id", "text", F.col("pos").alias("place")), ["doc_id"], "text", "place")
    direct = audit.direct_delta(base, target)
    return audit.counts(direct, audit.untouched_proof(base, target, *audit.mentioned(direct), *audit.implicated(census)), census)


@query("SELECT 'unknown_effect' AS fault, CAST(doc_id AS VARCHAR) AS subject FROM (SELECT DISTINCT doc_id FROM documents ANTI JOIN labels USING (doc_id)) UNION ALL SELECT 'duplicate_path', p_name FROM part GROUP BY p_name HAVING count(*) > 1")
def manifest_faults(t):
    effects = t.labels.select(F.col("doc_id").alias("effect_id")).distinct()
    return audit.manifest_faults(t.part.select(F.col("p_name").alias("path")), effects, t.documents.select(F.col("doc_id").alias("effect_id")))


# --- transactions -------------------------------------------------------------------------------------

_EDITS = (
    "e AS (SELECT doc_id AS txn_id, doc_id, 0 AS seq, 'replace' AS op, 0 AS pos, NULL AS expect, 'New first line' AS value, 'a' AS author FROM documents UNION ALL "
    "SELECT doc_id, doc_id, 1, 'insert', 1, NULL, 'An added line', 'a' FROM documents UNION ALL SELECT doc_id, doc_id, 2, 'delete', 2, CASE WHEN doc_id % 5 = 0 THEN 'stale' END, NULL, 'a' FROM documents)"
)


def edits(t):
    d = F.col("doc_id")
    none = F.lit(None).cast("string")

    def op(seq, name, pos, expect, value):
        return F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("op"), F.lit(pos).alias("pos"), expect.alias("expect"), value.alias("value"))

    ops = F.array(op(0, "replace", 0, none, F.lit("New first line")), op(1, "insert", 1, none, F.lit("An added line")), op(2, "delete", 2, F.when(d % 5 == 0, "stale"), none))
    return t.documents.select(d.alias("txn_id"), "doc_id", F.explode(ops).alias("o")).select("txn_id", "doc_id", "o.*", F.lit("a").alias("author"))


_JUDGED = (
    f"{BLK}, {_EDITS}, j AS (SELECT e.*, CASE WHEN b.text IS NULL THEN 'anchor_not_found' WHEN expect IS NOT NULL AND expect <> b.text THEN 'stale_edit' WHEN op = 'replace' AND value = b.text THEN 'no_op_edit' ELSE 'ok' END AS code FROM e LEFT JOIN blk b USING (doc_id, pos)), "
    "o AS (SELECT *, CASE WHEN max(CASE WHEN code <> 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY txn_id, doc_id) = 1 THEN (CASE WHEN code = 'ok' THEN 'rolled_back' ELSE 'refused' END) ELSE 'applied' END AS outcome FROM j)"
)


@query(f"WITH {_JUDGED} SELECT txn_id, doc_id, seq, op, code, outcome FROM o")
def transaction_outcomes(t):
    return transactions.applied(transactions.State.of(blocks.blocks(t.documents)), transactions.edits_of(edits(t)))[1]


@query(
    f"WITH {_JUDGED}, a AS (SELECT DISTINCT doc_id FROM o WHERE outcome = 'applied'), r AS (SELECT b.doc_id, pos, 0 AS n, CASE WHEN a.doc_id IS NOT NULL AND pos = 0 THEN 'New first line' ELSE text END AS text FROM blk b LEFT JOIN a USING (doc_id) WHERE NOT (a.doc_id IS NOT NULL AND pos = 2) "
    "UNION ALL SELECT doc_id, 1, 1, 'An added line' FROM a) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, n) - 1 AS pos, text FROM r"
)
def transaction_result(t):
    return transactions.applied(transactions.State.of(blocks.blocks(t.documents)), transactions.edits_of(edits(t)))[0].blocks


@query("SELECT CAST(49 AS BIGINT) AS n_ops, CAST(14 AS BIGINT) AS n_groups")
def operation_catalog(t):
    return transactions.operation_catalog(t.spark).agg(F.count("*").alias("n_ops"), F.count_distinct("op_group").alias("n_groups"))


# --- packages and pages -----------------------------------------------------------------------------------


def packages(t):
    """Each document as a Word package: its lines as paragraphs, every fourth one an insertion."""
    lines = F.split("text", "\n")
    paragraph = F.transform(lines, lambda x, k: F.array(F.struct(F.when(k % 4 == 3, "inserted").otherwise("normal").alias("status"), x.alias("text"))))
    return docx.write_packages(t.documents.where("text is not null").select("doc_id", paragraph.alias("segments")))


@query(f"WITH {BLK} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pos AS INTEGER) AS pos, text FROM blk")
def docx_round_trip(t):
    return docx.blocks(packages(t)).select("doc_id", "pos", "text")


@query(f"WITH {BLK} SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos % 4 = 3 THEN 'inserted' ELSE 'normal' END AS status, text FROM blk WHERE text <> ''")
def docx_spans(t):
    return docx.spans(packages(t)).where("text <> ''").select("doc_id", "pos", "status", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(['[Content_Types].xml', '_rels/.rels', 'word/document.xml']) AS part_name FROM documents WHERE text IS NOT NULL")
def docx_parts(t):
    return docx.parts(packages(t)).select("doc_id", "part_name")


@query()
def html_blocks(t):
    return html.blocks(t.pages)


# --- stories, opaque content, selections -------------------------------------------------------


@query("WITH r AS (SELECT user_id AS doc_id, event_id % 5 AS story_id, event_id % 3 AS section, event_type AS kind FROM events), a AS (SELECT doc_id, story_id, string_agg(section || ':' || kind, ',' ORDER BY section, kind) AS slot FROM (SELECT DISTINCT * FROM r) GROUP BY ALL), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slot ORDER BY story_id) AS nth FROM a), b AS (SELECT doc_id, story_id, string_agg(section || ':' || kind, ',' ORDER BY section, kind) AS slot FROM (SELECT DISTINCT * FROM r WHERE story_id <> 2) GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slot ORDER BY story_id) AS nth FROM b) "
    "SELECT doc_id, slot, n.story_id AS old, m.story_id AS new FROM n FULL JOIN m USING (doc_id, slot, nth)")
def story_slots(t):
    refs = t.events.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 5).alias("story_id"), (F.col("event_id") % 3).alias("section"), F.col("event_type").alias("kind"))
    return stories.paired_by_slot(refs, refs.where("story_id <> 2"))


@query()
def story_likeness(t):
    turns = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("story_id"), "text")
    after = turns.where("story_id <> 1").withColumn("text", F.when(F.col("story_id") == 2, F.concat(F.lit("New start. "), "text")).otherwise(F.col("text")))
    return stories.paired_by_likeness(turns, after)


@query("WITH b AS (SELECT vec_id, label, sha256(CAST(label AS VARCHAR)) AS h FROM embeddings) SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'deleted' WHEN vec_id % 10 = 1 THEN 'content' WHEN vec_id % 10 = 2 THEN 'size' WHEN vec_id % 10 = 3 THEN 'alt_text' END AS change FROM b WHERE vec_id % 10 <= 3")
def opaque_changes(t):
    k = F.col("vec_id") % 10
    rows = t.embeddings.select("vec_id", F.sha2(F.col("label").cast("string"), 256).alias("content_hash"), F.lit(10).alias("width"), F.lit(20).alias("height"), F.lit("a").alias("alt"))
    after = rows.where(k != 0).withColumn("content_hash", F.when(k == 1, "x").otherwise(F.col("content_hash"))).withColumn("width", F.when(k == 2, 11).otherwise(F.col("width"))).withColumn("alt", F.when(k == 3, "b").otherwise(F.col("alt")))
    return stories.opaque_changes(rows, after, ["vec_id"])


@query("SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'p_size' END, CASE WHEN p_partkey % 4 = 0 THEN 'p_brand' END) AS changed FROM part WHERE (p_partkey % 3 = 0 OR p_partkey % 4 = 0) AND p_partkey % 5 <> 0")
def formatting_changes(t):
    k = F.col("p_partkey")
    rows = t.part.select("p_partkey", "p_name", "p_size", "p_brand")
    after = rows.withColumn("p_size", F.when(k % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size"))).withColumn("p_brand", F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("p_brand"))).withColumn("p_name", F.when(k % 5 == 0, "other").otherwise(F.col("p_name")))
    return stories.formatting_changes(rows, after, ["p_partkey"], "p_name", ["p_size", "p_brand"])


@query(f"WITH {BLK} SELECT doc_id, pos, concat_ws(',', CASE WHEN regexp_matches(text, '\\p{{L}}') THEN 'text' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'number' END, CASE WHEN regexp_matches(text, '[#*$%&<>]') THEN 'symbol' END, CASE WHEN contains(text, '@') THEN 'address' END, CASE WHEN contains(text, ' | ') THEN 'columns' END) AS tags FROM blk")
def content_tags(t):
    return stories.content_tags(blocks.blocks(t.documents))


@query(f"WITH {SEG}, m AS (SELECT doc_id, pos, has_ins OR (NOT has_ins AND NOT has_del AND text = 'signup' AND text <> 'error') AS i, has_del OR (NOT has_ins AND NOT has_del AND text = 'error') AS d FROM seg) SELECT doc_id, pos, CASE WHEN i AND d THEN 's' WHEN i THEN 'i' WHEN d THEN 'd' ELSE 'n' END AS status FROM m")
def converted_markup(t):
    done = stories.converted_markup(segments(t), F.col("text") == "error", F.col("text") == "signup")
    again = stories.converted_markup(done, F.col("text") == "error", F.col("text") == "signup")
    return again.select("doc_id", "pos", revisions.status(F.col("has_ins"), F.col("has_del")).alias("status"))


@query(f"WITH {CELLS} SELECT table_id, CAST(sum(len(text) - len(replace(text, 'e', ''))) AS BIGINT) AS unreached FROM cells GROUP BY table_id HAVING sum(len(text) - len(replace(text, 'e', ''))) > 0")
def unreached_cells(t):
    return stories.unreached_cells(cells(t), "e")


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'refused' ELSE 'auditable' END AS audit FROM documents")
def auditable_documents(t):
    return stories.auditable(t.documents, t.labels.where("quality = 0"))


@query("SELECT page_id AS doc_id, CAST(0 AS INTEGER) AS pos, url AS target, replace(url, 'http://', 'https://') AS new_target FROM pages WHERE starts_with(url, 'http://')")
def link_changes(t):
    links = t.pages.select(F.col("page_id").alias("doc_id"), F.lit(0).alias("pos"), F.col("url").alias("target"), F.lit("link").alias("text"))
    return stories.link_changes(links, links.withColumn("target", F.replace("target", F.lit("http://"), F.lit("https://"))))


@query(f"WITH {SEG}, {REV} SELECT doc_id, revision_id, 'selected' AS outcome FROM rev WHERE author = 'a3' AND kind = 'delete' AND pos BETWEEN 10 AND 5000")
def selector_filter(t):
    return stories.selected_rows(revision_rows(t), author="a3", kinds=["delete"], between=(10, 5000))


@query("SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS BIGINT) AS revision_id, 'empty_selection' AS outcome")
def empty_selection(t):
    return stories.selected_rows(revision_rows(t), author="nobody")


@query()
def pair_render(t):
    return stories.render(diffing.changes_of(diffing.compared(lines.revised_pairs(lines.spread(t.documents)), words=False)))
