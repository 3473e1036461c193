"""Queries over transactions by pattern, validation of packages, and redlines, with their SQL.

Documents have no properties, side rows or faults of their own, so each query gives
them some by a rule on the document's number that SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import blocks, diffing, lines, package_rules, stories, transactions
from palimpsest.plans.block_queries import BLK, TGT
from palimpsest.plans.registry import query
from palimpsest.plans.revision_queries import CELLS, cells, packages
from palimpsest.sources import docx, docx_elements, docx_resolve
from palimpsest.tables import stored

def number():
    return F.col("doc_id")


def edits(rows, *ops):
    """An edit per row and op: (op, columns); the transaction is the document."""
    fields = ("pos", "target", "name", "expect", "value")
    kinds = {"pos": "int"}

    def of(n, op, columns):
        values = ((columns.get(f) if f in columns else F.lit(None)).cast(kinds.get(f, "string")).alias(f) for f in fields)
        return F.struct(F.lit(n).alias("seq"), F.lit(op).alias("op"), *values)

    made = F.array(*(of(n, op, columns) for n, (op, columns) in enumerate(ops)))
    return transactions.edits_of(rows.select(number().alias("txn_id"), "doc_id", F.explode(made).alias("o")).select("txn_id", "doc_id", "o.*", F.lit("me").alias("author")))


def lit(**columns):
    return {k: F.lit(v) for k, v in columns.items()}


@query(
    "WITH d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL) SELECT doc_id, 'paragraph' AS scope, '0' AS target, 'align' AS name, 'right' AS value, CASE WHEN doc_id % 3 = 0 THEN 'left' END AS previous_value FROM d WHERE doc_id % 5 > 0 UNION ALL "
    "SELECT doc_id, 'document', '', 'size', '24', NULL FROM d WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 'paragraph', '0', 'align', CASE WHEN doc_id % 3 = 0 THEN 'left' END, NULL FROM d WHERE doc_id % 5 = 0 AND doc_id % 3 = 0"
)
def transaction_properties(t):
    """The set pattern; documents whose guard is stale keep what they had."""
    docs = t.documents.where("text is not null").select("doc_id")
    had = docs.where(number() % 3 == 0).select("doc_id", F.lit("paragraph").alias("scope"), F.lit("0").alias("target"), F.lit("align").alias("name"), F.lit("left").alias("value"))
    ops = [("set_para_format", lit(pos=0, name="align", value="right") | {"expect": F.when(number() % 5 == 0, "none")}), ("set_doc_defaults", lit(name="size", value="24"))]
    return transactions.applied(transactions.State.of(blocks.blocks(t.documents), properties=had), edits(docs, *ops))[0].properties


@query(
    "WITH d AS (SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0) SELECT doc_id, 'comment' AS kind, 'c1' AS key, NULL AS parent, 0 AS pos, 'first' AS text, 'you' AS author, true AS done FROM d UNION ALL SELECT doc_id, 'comment', 'c2', 'c1', 0, 'why', 'me', false FROM d "
    "UNION ALL SELECT doc_id, 'note', 'n1', NULL, 0, 'a note, edited', 'me', false FROM d"
)
def transaction_side_rows(t):
    """The side patterns: a reply needs its comment, which every other document has not."""
    docs = t.documents.where("text is not null").select("doc_id")
    had = docs.where(number() % 2 == 0).select("doc_id", *(F.lit(v).cast(k).alias(c) for c, v, k in (("kind", "comment", "string"), ("key", "c1", "string"), ("parent", None, "string"), ("pos", 0, "int"), ("text", "first", "string"), ("author", "you", "string"), ("done", False, "boolean"))))
    ops = [("comment_reply", lit(pos=0, target="c2", name="c1", value="why")), ("comment_resolve", lit(target="c1")), ("insert_note", lit(pos=0, target="n1", value="a note, edited"))]
    return transactions.applied(transactions.State.of(blocks.blocks(t.documents), side=had), edits(docs, *ops))[0].side


@query(
    f"WITH {CELLS}, ok AS (SELECT table_id FROM cells GROUP BY table_id HAVING max(row) >= 1), x AS (SELECT table_id, row AS place, 0 AS n, cell AS col, CASE WHEN ok.table_id IS NOT NULL AND row = 1 AND cell = 0 THEN 'set' ELSE text END AS text FROM cells LEFT JOIN ok USING (table_id) WHERE NOT (ok.table_id IS NOT NULL AND row = 0) "
    "UNION ALL SELECT table_id, 1, 1, c, ['new', 'line'][c + 1] FROM ok, (SELECT unnest([0, 1]) AS c)) SELECT table_id AS doc_id, 'T' AS table_id, CAST(dense_rank() OVER (PARTITION BY table_id ORDER BY place, n) - 1 AS INTEGER) AS row, CAST(col AS INTEGER) AS col, text FROM x"
)
def transaction_cells(t):
    """Rows of tables come and go; a table of one row is refused whole."""
    grid = cells(t).select(F.col("table_id").alias("doc_id"), F.lit("T").alias("table_id"), F.col("row").cast("int").alias("row"), F.col("cell").cast("int").alias("col"), "text")
    ops = [("table_op", lit(target="T/0", name="delete_row")), ("table_op", lit(target="T/1", name="insert_row", value="new\tline")), ("table_op", lit(target="T/1/0", name="set_cell_text", value="set"))]
    none = blocks.blocks(t.documents).where("false")
    return transactions.applied(transactions.State.of(none, cells=grid), edits(grid.select("doc_id").distinct(), *ops))[0].cells


@query(
    f"WITH {BLK}, s AS (SELECT doc_id, count(*) AS n FROM blk GROUP BY doc_id), p AS (SELECT doc_id, text, CASE WHEN n > 2 AND pos = 0 THEN 2 ELSE pos END AS place, CASE WHEN n > 2 AND pos = 0 THEN 1 ELSE 0 END AS k FROM blk JOIN s USING (doc_id)) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, k) - 1 AS pos, text FROM p"
)
def transaction_moves(t):
    """The first block moves after the third, where there is one."""
    ops = [("move", lit(pos=0, value="2"))]
    return transactions.applied(transactions.State.of(blocks.blocks(t.documents)), edits(t.documents.where("text is not null").select("doc_id"), *ops))[0].blocks


# --- packages --------------------------------------------------------------------------------------

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def faulty_packages(t):
    """Documents as packages of one paragraph, most of them with a fault that their number decides."""
    k = number() % 9
    types = f'<Types xmlns="{docx.TYPES[1:-1]}"><Default Extension="rels" ContentType="a/rels"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{package_rules.MAIN_TYPES[0]}"/></Types>'
    rels = f'<Relationships xmlns="{docx.RELS[1:-1]}"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="word/document.xml"/></Relationships>'
    twice = f'<Relationships xmlns="{docx.RELS[1:-1]}"><Relationship Id="a" Type="{_REL}/x" Target="document.xml"/><Relationship Id="a" Type="{_REL}/x" Target="document.xml"/></Relationships>'
    ident = number().cast("string")
    body = (
        F.when(k == 1, F.concat(F.lit('<w:p><w:hyperlink r:id="r'), ident, F.lit('"/></w:p>')))
        .when(k == 2, F.concat(F.lit('<w:p><w:bookmarkStart w:id="'), ident, F.lit('" w:name="n"/></w:p>')))
        .when(k == 3, F.lit("<w:p><w:pPr><w:jc/><w:keepNext/></w:pPr></w:p>"))
        .when(k == 4, F.concat(F.lit('<w:p><w:ins w:id="'), ident, F.lit('"><w:r/></w:ins><w:del w:id="'), ident, F.lit('"><w:r/></w:del></w:p>')))
        .when(k == 5, F.lit('<w:p><w:ins w:id="1"><w:ins w:id="2"><w:r/></w:ins></w:ins></w:p>'))
        .when(k == 6, F.lit("<m:oMath/>"))
        .otherwise(F.concat(F.lit("<w:p><w:r><w:t>"), T.escaped_html(F.left("text", F.lit(20))), F.lit("</w:t></w:r></w:p>")))
    )
    main = F.concat(F.lit(f'<w:document xmlns:w="{docx.W[1:-1]}" xmlns:r="{_REL}" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><w:body>'), body, F.when(k == 7, "").otherwise("<w:sectPr/>"), F.lit("</w:body></w:document>"))

    def part(name, text):
        return F.struct(F.lit(name).alias("name"), (text if not isinstance(text, str) else F.lit(text)).alias("text"))

    parts = F.array(part("[Content_Types].xml", types), part("_rels/.rels", rels), part("word/document.xml", main), part("word/_rels/document.xml.rels", F.when(k == 8, twice).otherwise(twice.replace(' Id="a"', ' Id="b"', 1))))
    return docx.write_parts(t.documents.where("text is not null").select("doc_id", parts.alias("parts")))


_FAULTS = (
    "f AS (SELECT doc_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k FROM documents WHERE text IS NOT NULL), r AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, ['I-REL-001', 'I-ANN-003', 'I-ORD-001', 'I-ANN-001', 'I-TC-003', 'I-MATH-002', 'I-DOC-003', 'I-REL-002'][k] AS rule_id, CASE WHEN k = 3 THEN 'warning' ELSE 'error' END AS severity, "
    "CASE WHEN k = 8 THEN 'word/_rels/document.xml.rels' ELSE 'word/document.xml' END AS part, CASE k WHEN 1 THEN 'r' || doc_id WHEN 2 THEN CAST(doc_id AS VARCHAR) WHEN 3 THEN 'w:pPr@3' WHEN 4 THEN CAST(doc_id AS VARCHAR) WHEN 5 THEN 'ins' WHEN 6 THEN 'oMath' WHEN 7 THEN 'w:p' ELSE 'a' END AS subject FROM f WHERE doc_id % 9 = k)"
)


@query(f"WITH {_FAULTS} SELECT * FROM r")
def package_findings(t):
    """All 44 rules over packages with seeded faults; the others find nothing."""
    return package_rules.findings_of(stored(docx_elements.package_facts(faulty_packages(t)), "package-facts"))


@query(f"WITH {_FAULTS} SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') = 0 AS ok FROM documents d LEFT JOIN r ON r.doc_id = CAST(d.doc_id AS VARCHAR) WHERE text IS NOT NULL GROUP BY d.doc_id")
def package_verdicts(t):
    facts = stored(docx_elements.package_facts(faulty_packages(t)), "package-facts")
    return package_rules.verdicts(facts, package_rules.findings_of(facts))


@query(f"WITH {BLK} SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'word/document.xml' AS part, count(*) FILTER (pos % 4 = 3 AND text <> '') AS insertions, CAST(0 AS BIGINT) AS deletions FROM blk GROUP BY doc_id")
def package_preflight(t):
    return docx_resolve.preflight(packages(t)).select("doc_id", "part", "insertions", "deletions")


def redlines(t):
    return docx.write_redlines(diffing.redline(diffing.compared(lines.revised_pairs(lines.spread(t.documents)))), "me", "2024-01-01T00:00:00Z")


def _texts(resolved):
    rows = docx.blocks(resolved).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("b"))
    return rows.select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"))


@query(f"WITH {BLK}, {TGT} SELECT CAST(doc_id AS VARCHAR) AS doc_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM tgt GROUP BY doc_id")
def redline_accepted(t):
    """Compared, written as a redline, accepted on its XML and read again: the target."""
    return _texts(docx_resolve.resolved(redlines(t), accept=True))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents WHERE text IS NOT NULL")
def redline_rejected(t):
    """The same, rejected: the base."""
    return _texts(docx_resolve.resolved(redlines(t), accept=False))


@query(
    "WITH s AS (SELECT conv_id AS doc_id, turn AS story_id, text FROM conversations) SELECT doc_id, CAST(story_id AS BIGINT) AS old, CASE WHEN story_id <> 1 THEN CAST(story_id AS BIGINT) END AS new, CASE WHEN story_id = 1 THEN 'deleted' WHEN story_id = 2 THEN 'modified' ELSE 'matched' END AS change FROM s"
)
def story_comparison(t):
    """Stories pair by the sections that use them, then their texts are compared."""
    story = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("story_id"), "text")
    refs = story.select("doc_id", "story_id", F.col("story_id").alias("section"), F.lit("header").alias("kind"))
    after = story.where("story_id <> 1").withColumn("text", F.when(F.col("story_id") == 2, F.concat(F.lit("New. "), "text")).otherwise(F.col("text")))
    return stories.compared_stories(refs, refs.where("story_id <> 1"), story, after).select("doc_id", "old", "new", "change")
