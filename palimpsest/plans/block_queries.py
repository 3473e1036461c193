"""Queries over blocks and versions of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import audit, blocks, diffing, lines, matching, ordered, roles, update
from palimpsest.operators.versions import revised
from palimpsest.plans.registry import query

BLK = "blk AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"
TGT = (
    "sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM blk), "
    "moved AS (SELECT doc_id, CASE WHEN pos = 0 AND n >= 6 THEN 2 * n ELSE 2 * pos END AS place, CASE WHEN pos % 4 = 1 THEN replace(text, 'the', 'this') ELSE text END AS text, pos AS base_pos "
    "FROM sized WHERE pos % 5 <> 3 UNION ALL SELECT doc_id, 2 * pos + 1, 'Inserted clause ' || pos || ' for review.', NULL FROM sized WHERE pos % 5 <> 3 AND pos % 7 = 2), "
    "tgt AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS pos, text, base_pos FROM moved)"
)
WORDS = "(length(text) - length(replace(text, ' ', '')) + 1)"
LEVEL = f"CASE WHEN length(text) = 0 OR {WORDS} > 5 THEN NULL WHEN {WORDS} <= 2 THEN 1 ELSE 2 END"
#: Deleted and inserted blocks by occurrence: what one side has more often than the other.
GONE = (
    "b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS nth FROM blk), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) AS nth FROM tgt), "
    "gone AS (SELECT b.doc_id, b.pos, b.text FROM b LEFT JOIN t USING (doc_id, text, nth) WHERE t.pos IS NULL), come AS (SELECT t.doc_id, t.pos, t.text FROM t LEFT JOIN b USING (doc_id, text, nth) WHERE b.pos IS NULL)"
)
PATTERNS = ["the", "Licensed under", "idiot", "ung", "token = ", "no such words here", "|", "ción"]


def count_sql(needle: str, text: str = "text") -> str:
    n = needle.replace("'", "''")
    return f"((length({text}) - length(replace({text}, '{n}', ''))) // {len(needle)})"


@query(f"WITH {BLK} SELECT doc_id, pos, text FROM blk")
def blocks_explode(t):
    return blocks.blocks(t.documents)


@query(f"WITH {BLK} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS plain FROM blk GROUP BY doc_id")
def doc_plain_text(t):
    return lines.plain_text(t.documents)


@query(
    f"WITH {BLK}, lv AS (SELECT *, {LEVEL} AS level FROM blk) SELECT doc_id, pos, CASE WHEN level IS NULL THEN 'body' ELSE 'heading' || level END AS role, "
    "CAST(coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS INTEGER) AS depth, left(text, 120) AS preview, "
    "length(text) AS char_len, CAST(strlen(text) AS BIGINT) AS byte_len FROM lv"
)
def outline_depth(t):
    return lines.outline(t.documents)


@query(f"WITH {BLK} SELECT doc_id, count(*) AS n_blocks, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM blk GROUP BY doc_id")
def outline_totals(t):
    return lines.outline_totals(t.documents)


@query(
    f"WITH {BLK}, p AS (SELECT unnest([{', '.join(repr(p) for p in PATTERNS)}]) AS pattern), m AS (SELECT pattern, doc_id, (length(text) - length(replace(text, pattern, ''))) // length(pattern) AS n FROM blk, p) "
    "SELECT pattern, CAST(sum(n) AS BIGINT) AS n_matches, count(*) FILTER (n > 0) AS n_blocks, count(DISTINCT doc_id) FILTER (n > 0) AS n_docs FROM m GROUP BY pattern"
)
def find_batch_zero_rows(t):
    return blocks.find(blocks.blocks(t.documents), PATTERNS)


@query(
    f"WITH {BLK}, m AS (SELECT *, instr(text, 'pathetic') AS mt FROM blk WHERE contains(text, 'pathetic')), e AS (SELECT *, greatest(mt - 32, 1) AS s, least(mt + 39, length(text)) AS z FROM m) "
    f"SELECT doc_id, pos, {count_sql('pathetic')} AS n_matches, (CASE WHEN s > 1 THEN '...' ELSE '' END) || substring(text, s, mt - s) || '«pathetic»' || substring(text, mt + 8, z - mt - 7) || (CASE WHEN z < length(text) THEN '...' ELSE '' END) AS excerpt FROM e"
)
def find_matches(t):
    return blocks.excerpts(blocks.blocks(t.documents), "pathetic")


@query(f"WITH {BLK} SELECT doc_id, pos FROM blk WHERE regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}])scum($|[^\\p{{L}}\\p{{N}}])')")
def find_whole_word_ci(t):
    return blocks.whole_words(blocks.blocks(t.documents), "scum")


@query(f"WITH {BLK} SELECT doc_id, pos, translate(text, chr(9) || chr(160) || chr(8217) || chr(8220) || chr(8221), '  ''\"\"') AS folded FROM blk")
def normalize_ws_fold(t):
    return blocks.blocks(t.documents).select("doc_id", "pos", T.fold(F.col("text")).alias("folded"))


@query(f"WITH {BLK} SELECT doc_id, pos, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS normalized FROM blk")
def normalized_text(t):
    return blocks.blocks(t.documents).select("doc_id", "pos", T.normalized(F.col("text")).alias("normalized"))


@query(
    f"WITH {BLK}, v AS (SELECT doc_id, pos, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM blk) SELECT doc_id, pos, CAST(round(1000 * (CASE WHEN n = 0 THEN 0.0 WHEN n <= 5 THEN 0.1 ELSE 1.0 + ln(n) / 5.0 END)) AS BIGINT) AS milli FROM v"
)
def content_significance(t):
    return blocks.blocks(t.documents).select("doc_id", "pos", F.round(1000 * T.significance(F.col("text"))).cast("long").alias("milli"))


@query(f"WITH {BLK} SELECT doc_id, pos, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|\\s+|.')) AS n_tokens FROM blk")
def token_counts(t):
    return blocks.blocks(t.documents).select("doc_id", "pos", F.size(T.simple_tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(f"WITH {BLK}, k AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|\\s+|.')) AS token FROM blk) SELECT token, count(*) AS n FROM k WHERE regexp_matches(token, '[0-9%$]|^(USD|EUR|GBP)$') GROUP BY token")
def high_value_tokens(t):
    tokens = blocks.blocks(t.documents).select(F.explode(T.simple_tokens(F.col("text"))).alias("token"))
    return tokens.where(T.high_value(F.col("token"))).groupBy("token").agg(F.count("*").alias("n"))


@query(
    f"WITH {BLK}, s AS (SELECT doc_id, count(*) AS n FROM blk GROUP BY doc_id) SELECT s.doc_id, CASE WHEN n > 4 THEN pos END AS pos, CASE WHEN n > 4 THEN text END AS text, CASE WHEN n > 4 THEN 'ok' ELSE 'invalid_range' END AS outcome "
    "FROM s LEFT JOIN (SELECT * FROM blk WHERE pos BETWEEN 2 AND 4) b USING (doc_id) WHERE n > 4 OR coalesce(pos, 2) = 2"
)
def block_window(t):
    return lines.window(t.documents, 2, 4)


@query(
    f"WITH {BLK}, s AS (SELECT doc_id, count(*) AS n FROM blk GROUP BY doc_id) SELECT doc_id, pos, text, n > 8 AS has_more, CASE WHEN n > 8 THEN CAST(8 AS BIGINT) END AS next_offset FROM blk JOIN s USING (doc_id) WHERE pos BETWEEN 4 AND 7"
)
def page_slice(t):
    return lines.pages(t.documents, 4, 4)


@query(
    f"WITH {BLK}, lv AS (SELECT *, {LEVEL} AS level FROM blk), nt AS (SELECT *, count(level) OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM lv), "
    "h AS (SELECT doc_id, pos AS hp, level AS hl FROM nt WHERE nth = 2 AND level IS NOT NULL), e AS (SELECT h.doc_id, min(nt.pos) AS ep FROM h JOIN nt ON nt.doc_id = h.doc_id AND nt.pos > hp AND nt.level <= hl GROUP BY h.doc_id) "
    "SELECT nt.doc_id, nt.pos, nt.text FROM nt JOIN h USING (doc_id) LEFT JOIN e USING (doc_id) WHERE nt.pos >= hp AND (ep IS NULL OR nt.pos < ep)"
)
def section_read(t):
    return blocks.section_of(blocks.blocks(t.documents), 2)


@query(f"WITH {BLK}, k AS (SELECT doc_id, pos, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|\\s+|.') AS l FROM blk), "
    "x AS (SELECT doc_id, pos, unnest(range(len(l))) AS nr, unnest(l) AS text FROM k), o AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id, pos ORDER BY nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM x) "
    "SELECT doc_id, pos, 's_' || (row_number() OVER (PARTITION BY doc_id, pos ORDER BY nr) - 1) AS handle, CAST(start AS BIGINT) AS start, text FROM o WHERE regexp_matches(text, '[\\p{L}\\p{N}_]')")
def span_handles(t):
    return blocks.span_handles(blocks.blocks(t.documents))


@query(
    f"WITH {BLK}, lv AS (SELECT *, {LEVEL} AS level, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS safe FROM blk) "
    "SELECT doc_id, pos, (CASE WHEN level IS NULL THEN '' ELSE repeat('#', level) || ' ' END) || text AS markdown, '<' || (CASE WHEN level IS NULL THEN 'p' ELSE 'h' || level END) || '>' || safe || '</' || (CASE WHEN level IS NULL THEN 'p' ELSE 'h' || level END) || '>' AS html FROM lv"
)
def markdown_html(t):
    return blocks.markdown(blocks.blocks(t.documents))


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes, 'data:text/plain;base64,' || to_base64(encode(text)) AS data_uri FROM documents")
def content_identity(t):
    return blocks.identity(t.documents)


# --- updates -----------------------------------------------------------------------------

_OLD, _NEW = "worthless", "of little worth"


@query(
    f"WITH {BLK}, c AS (SELECT *, {count_sql(_OLD)} AS n FROM blk), f AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id) AS BIGINT) AS n_found FROM c), "
    "h AS (SELECT *, CASE WHEN n_found = 0 THEN 'unreachable_match' WHEN n_found <> 2 THEN 'match_count_mismatch' ELSE 'applied' END AS outcome FROM f WHERE n > 0 OR (n_found = 0 AND pos = 0)), "
    f"e AS (SELECT *, instr(text, '{_OLD}') AS mt, greatest(instr(text, '{_OLD}') - 32, 1) AS s, least(instr(text, '{_OLD}') + {len(_OLD) + 31}, length(text)) AS z FROM h) "
    f"SELECT doc_id, pos, n_found, outcome, CASE WHEN outcome = 'applied' THEN replace(text, '{_OLD}', '{_NEW}') END AS new_text, CASE WHEN n > 0 THEN (CASE WHEN s > 1 THEN '...' ELSE '' END) || substring(text, s, mt - s) || '«{_OLD}»' || substring(text, mt + {len(_OLD)}, z - mt - {len(_OLD)} + 1) || (CASE WHEN z < length(text) THEN '...' ELSE '' END) END AS excerpt FROM e"
)
def replace_gated(t):
    return lines.replace_gated(t.documents, update.Item("w1", _OLD, _NEW, expected=2))


_PERSON = "regexp_replace({0}, '(?i)(^|[^\\p{{L}}\\p{{N}}])moron($|[^\\p{{L}}\\p{{N}}])', '\\1person\\2', 'g')"


# Neighbours share the sign between them, so without look-ahead a second pass takes every other one.
@query(f"WITH {BLK}, r AS (SELECT doc_id, pos, text, {_PERSON.format(_PERSON.format('text'))} AS after FROM blk) SELECT doc_id, pos, after AS text FROM r WHERE after <> text")
def replace_all_ci(t):
    return update.replace_all(blocks.blocks(t.documents), "moron", "person")


_ITEMS = [update.Item("a", "idiot", "person", 1), update.Item("b", "person", "reader", 1), update.Item("c", "clown", "clown", 1), update.Item("d", "Licensed under", "Used under", 2)]


_FOLDED = (
    "WITH d AS (SELECT doc_id, text AS t0 FROM documents), a AS (SELECT *, " + count_sql("idiot", "t0") + " AS na FROM d), a2 AS (SELECT *, CASE WHEN na = 1 THEN replace(t0, 'idiot', 'person') ELSE t0 END AS t1 FROM a), "
    "b AS (SELECT *, " + count_sql("person", "t1") + " AS nb FROM a2), b2 AS (SELECT *, CASE WHEN nb = 1 THEN replace(t1, 'person', 'reader') ELSE t1 END AS t2 FROM b), "
    "c AS (SELECT *, " + count_sql("clown", "t2") + " AS nc, " + count_sql("Licensed under", "t2") + " AS nd FROM b2), c2 AS (SELECT *, CASE WHEN nd = 2 THEN replace(t2, 'Licensed under', 'Used under') ELSE t2 END AS t3 FROM c), "
    "folded AS (SELECT doc_id, CAST(0 AS INTEGER) AS seq, 'a' AS item, na AS n_found, CASE WHEN na = 0 THEN 'unreachable_match' WHEN na <> 1 THEN 'match_count_mismatch' ELSE 'applied' END AS outcome, length(t1) AS n_chars FROM c2 "
    "UNION ALL SELECT doc_id, 1, 'b', nb, CASE WHEN nb = 0 THEN 'unreachable_match' WHEN nb <> 1 THEN 'match_count_mismatch' ELSE 'applied' END, length(t2) FROM c2 "
    "UNION ALL SELECT doc_id, 2, 'c', nc, CASE WHEN nc = 0 THEN 'unreachable_match' WHEN nc <> 1 THEN 'match_count_mismatch' ELSE 'no_op' END, length(t2) FROM c2 "
    "UNION ALL SELECT doc_id, 3, 'd', nd, CASE WHEN nd = 0 THEN 'unreachable_match' WHEN nd <> 2 THEN 'match_count_mismatch' ELSE 'applied' END, length(t3) FROM c2) "
)


@query(_FOLDED + "SELECT * FROM folded")
def worklist_fold(t):
    return lines.apply_worklist(t.documents, _ITEMS)


@query(
    _FOLDED + "SELECT count(*) AS total, count(*) FILTER (outcome = 'applied') AS applied, count(*) FILTER (outcome <> 'applied') AS refused, count(*) FILTER (outcome <> 'applied') = 0 AS deliverable FROM folded"
)
def worklist_summary(t):
    return roles.summary(lines.apply_worklist(t.documents, _ITEMS), "outcome")


@query(
    f"WITH {BLK}, p AS (SELECT doc_id, bool_or(pos <= 3 AND contains(text, 'stupid')) AS here, bool_or(pos <= 3 AND contains(text, 'trash')) AS applied, bool_or(pos > 3 AND contains(text, 'stupid')) AS outside FROM blk GROUP BY doc_id) "
    "SELECT doc_id, CASE WHEN applied THEN 'already_applied' WHEN outside THEN 'out_of_scope' ELSE 'no_candidate' END AS diagnosis FROM p WHERE NOT here"
)
def zero_match_diagnosis(t):
    return lines.diagnosis(t.documents, update.Item("z", "stupid", "trash"), 3)


@query(
    f"WITH {BLK}, j AS (SELECT doc_id, string_agg(text, '' ORDER BY pos) AS joined, CAST(sum({count_sql('.T')}) AS BIGINT) AS inside FROM blk GROUP BY doc_id) SELECT doc_id, {count_sql('.T', 'joined')} AS across, inside FROM j WHERE {count_sql('.T', 'joined')} > inside"
)
def straddled_matches(t):
    return lines.straddling(t.documents, ".T")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'stale' ELSE 'bound' END AS binding FROM documents")
def input_binding(t):
    docs = t.documents
    data = F.col("text").cast("binary")
    expected = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat(data, F.lit(" ").cast("binary"))).otherwise(data), 256).alias("sha256"), F.octet_length(data).cast("long").alias("bytes"))
    return update.bound(docs, expected)


@query(
    f"WITH {BLK}, s AS (SELECT doc_id, pos, text, CASE WHEN pos % 3 = 1 THEN 'i' ELSE 'n' END AS status FROM blk), g AS (SELECT *, CASE WHEN status = lag(status) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM s), "
    "r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g), m AS (SELECT doc_id, run, any_value(status) AS status, string_agg(text, '' ORDER BY pos) AS text FROM r GROUP BY doc_id, run) "
    "SELECT doc_id, 'v2:' || sha256(string_agg(status || ':' || length(text) || ':' || text, ';' ORDER BY run)) AS guard, count(*) AS n_runs FROM m GROUP BY doc_id"
)
def guard_hash(t):
    segments = blocks.blocks(t.documents).withColumn("status", F.when(F.col("pos") % 3 == 1, "i").otherwise("n"))
    return update.guard(segments)


# --- two versions ---------------------------------------------------------------------------


def two(t):
    base = blocks.blocks(t.documents)
    return base, revised(base)


@query(f"WITH {BLK}, {TGT} SELECT doc_id, pos, text FROM tgt")
def revised_versions(t):
    return two(t)[1].select("doc_id", "pos", "text")


@query(
    f"WITH {BLK}, {TGT}, b AS (SELECT doc_id, text, min(pos) AS base_pos FROM blk GROUP BY doc_id, text HAVING count(*) = 1), t AS (SELECT doc_id, text, min(pos) AS target_pos FROM tgt GROUP BY doc_id, text HAVING count(*) = 1) "
    "SELECT doc_id, base_pos, target_pos FROM b JOIN t USING (doc_id, text)"
)
def unique_hash_anchors(t):
    return matching.unique_anchors(*two(t))


@query()
def ordered_anchors(t):
    return matching.ordered_anchors(matching.unique_anchors(*two(t)))


@query(f"WITH {BLK}, {TGT}, {GONE} SELECT doc_id, 'deleted' AS side, pos, text FROM gone UNION ALL SELECT doc_id, 'inserted', pos, text FROM come")
def multiset_difference(t):
    base, target = two(t)
    gone, come = matching.unmatched(base, target), matching.unmatched(target, base)
    return gone.select("doc_id", F.lit("deleted").alias("side"), "pos", "text").unionByName(come.select("doc_id", F.lit("inserted").alias("side"), "pos", "text"))


_MOVE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    f"WITH {BLK}, {TGT}, x AS (SELECT b.*, {_MOVE} AS key FROM blk b ANTI JOIN tgt USING (doc_id, pos, text)), y AS (SELECT g.doc_id, g.pos, {_MOVE} AS key FROM tgt g ANTI JOIN blk USING (doc_id, pos, text)), "
    "a AS (SELECT doc_id, key, pos AS from_pos, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS nth FROM x WHERE strlen(key) >= 20), b AS (SELECT doc_id, key, pos AS to_pos, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS nth FROM y WHERE strlen(key) >= 20) "
    "SELECT doc_id, from_pos, to_pos, CAST(strlen(key) AS BIGINT) AS n_bytes FROM a JOIN b USING (doc_id, key, nth)"
)
def moves_exact(t):
    base, target = two(t)
    at = ["doc_id", "pos", "text"]
    return matching.exact_moves(base.join(target, at, "left_anti"), target.join(base, at, "left_anti"))


@query(
    f"WITH {BLK}, x AS (SELECT * FROM blk WHERE ({LEVEL}) IS NULL), i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM x), g AS (SELECT doc_id, min(pos) AS pos, count(*) AS n, {_MOVE.replace('text', 'string_agg(text, chr(10) ORDER BY pos)')} AS key FROM i GROUP BY doc_id, island HAVING count(*) >= 2), "
    "a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS nth FROM g WHERE strlen(key) >= 20) SELECT doc_id, pos AS from_pos, pos + 1000 AS to_pos, CAST(strlen(key) AS BIGINT) AS n_bytes, n AS n_blocks FROM a"
)
def moves_grouped(t):
    # Runs of body text between headings, against the same runs a thousand blocks on.
    body = blocks.blocks(t.documents).where(blocks.heading_level().isNull())
    return matching.group_moves(body, body.withColumn("pos", F.col("pos") + 1000))


@query(
    f"WITH {BLK}, {TGT}, {GONE} SELECT doc_id, pos AS base_pos, NULL::BIGINT AS target_pos, 'deleted' AS change_type FROM gone UNION ALL SELECT doc_id, NULL, pos, 'inserted' FROM come"
)
def direct_delta(t):
    return audit.direct_delta(*two(t))


@query(
    f"WITH {BLK}, {TGT}, n AS (SELECT doc_id, count(*) AS n FROM blk GROUP BY doc_id), l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, text AS l FROM blk WHERE pos % 5 <> 3 AND pos % 4 <> 1 AND pos > 0), "
    "r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, text AS r FROM tgt WHERE base_pos IS NOT NULL AND base_pos % 4 <> 1 AND base_pos > 0), "
    "j AS (SELECT doc_id, count(l) AS n_before, count(r) AS n_after, count(*) FILTER (l = r) AS eq FROM l FULL JOIN r USING (doc_id, nth) GROUP BY doc_id) "
    "SELECT doc_id, n_before, n_after, CASE WHEN n_before <> n_after THEN 0 ELSE eq END AS proved, CASE WHEN n_before <> n_after THEN 'length_mismatch' WHEN eq < n_before THEN 'content_differs' ELSE 'proved' END AS verdict FROM j"
)
def untouched_proof(t):
    base, target = two(t)
    return audit.untouched_proof(
        base, target, base.where("pos % 5 = 3 or pos % 4 = 1 or pos = 0").select("doc_id", "pos"), target.where("base_pos is null or base_pos % 4 = 1 or base_pos = 0").select("doc_id", "pos")
    )


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def diff_reject_equals_base(t):
    return diffing.rebuilt_rows(diffing.compared(lines.revised_pairs(lines.spread(t.documents))), accept=False)


@query(f"WITH {BLK}, {TGT} SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM tgt GROUP BY doc_id")
def diff_accept_equals_target(t):
    return diffing.rebuilt_rows(diffing.compared(lines.revised_pairs(lines.spread(t.documents))), accept=True)


@query("SELECT CAST(0 AS BIGINT) AS n_changes")
def diff_self_empty(t):
    pairs = lines.with_lines(lines.spread(t.documents)).select("doc_id", F.col("lines").alias("old"), F.col("lines").alias("new"))
    return diffing.changes_of(diffing.compared(pairs)).where("change_type <> 'matched'").agg(F.count("*").alias("n_changes"))


@query()
def align_blocks(t):
    return diffing.with_unrelated_split(diffing.changes_of(diffing.compared(lines.revised_pairs(lines.spread(t.documents)), words=False)))


@query()
def inline_ops(t):
    return diffing.inline_of(diffing.compared(lines.revised_pairs(lines.spread(t.documents)))).where("change_type = 'modified'")


@query()
def insertion_anchors(t):
    return diffing.insertion_anchors(diffing.changes_of(diffing.compared(lines.revised_pairs(lines.spread(t.documents)), words=False)))


@query(
    f"WITH {BLK}, {TGT}, j AS (SELECT doc_id, pos, b.text AS l, g.text AS r, b.doc_id IS NOT NULL AND b.pos IS NOT NULL AS hl, g.pos IS NOT NULL AS hr FROM blk b FULL JOIN tgt g USING (doc_id, pos)), "
    "x AS (SELECT doc_id, pos, l, r FROM j) SELECT doc_id, pos, CASE WHEN l IS NULL OR r IS NULL THEN 'row' ELSE 'text' END AS path, CASE WHEN l IS NULL THEN 'false' WHEN r IS NULL THEN 'true' ELSE l END AS left, CASE WHEN r IS NULL THEN 'false' WHEN l IS NULL THEN 'true' ELSE r END AS right FROM x WHERE l IS DISTINCT FROM r"
)
def structural_differences(t):
    return diffing.structural(*two(t), ["doc_id", "pos"], ["text"])


@query(
    f"WITH {BLK}, s AS (SELECT doc_id, CAST({WORDS} AS BIGINT) AS words, pos, text FROM blk), g AS (SELECT words, count(*) AS n, min(doc_id * 1000000 + pos) AS first_pos, arg_min(CASE WHEN length(text) > 0 THEN left(text, 80) END, CASE WHEN length(text) > 0 THEN doc_id * 1000000 + pos END) AS exemplar FROM s GROUP BY words) "
    "SELECT words, n, first_pos, exemplar, CASE WHEN (n * 100) // sum(n) OVER () >= 20 THEN 'primary' WHEN (n * 100) // sum(n) OVER () >= 5 THEN 'common' WHEN n >= 3 THEN 'minor' ELSE 'rare' END AS frequency, row_number() OVER (ORDER BY first_pos) - 1 AS role_no FROM g"
)
def role_groups(t):
    blk = blocks.blocks(t.documents).withColumn("words", T.n_words(F.col("text")).cast("long")).withColumn("place", F.col("doc_id") * 1000000 + F.col("pos"))
    return roles.paragraph_roles(blk, ["words"], "place", F.col("text"))


@query(
    f"WITH {BLK}, h AS (SELECT *, CASE WHEN contains(text, '***') THEN 'deletion' WHEN contains(text, '%%%') THEN 'insertion' END AS sort FROM blk) SELECT doc_id, count(*) FILTER (sort = 'insertion') AS insertions, count(*) FILTER (sort = 'deletion') AS deletions, count(DISTINCT pos) AS n_blocks, arg_min(left(text, 120), pos) AS sample, count(*) >= 2 AS detected FROM h WHERE sort IS NOT NULL GROUP BY doc_id"
)
def manual_markup(t):
    return roles.manual_markup(blocks.blocks(t.documents), F.contains("text", F.lit("***")), F.contains("text", F.lit("%%%")))


@query(
    f"WITH {BLK}, lv AS (SELECT doc_id, pos, coalesce({LEVEL}, 3) AS level FROM blk), s AS (SELECT *, sum(CASE WHEN level < 1 THEN 1 ELSE 0 END) OVER w AS t1, sum(CASE WHEN level < 2 THEN 1 ELSE 0 END) OVER w AS t2 FROM lv WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), "
    "c AS (SELECT doc_id, pos, level, CAST(sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t1 ORDER BY pos) AS BIGINT) AS c1, CAST(sum(CASE WHEN level = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, t2 ORDER BY pos) AS BIGINT) AS c2 FROM s) "
    "SELECT doc_id, pos, CASE WHEN level = 1 THEN c1 || '.' ELSE c1 || '.' || c2 END AS label FROM c WHERE level < 3"
)
def numbering_labels(t):
    level = F.coalesce(blocks.heading_level(), F.lit(3))
    counted = ordered.counters(blocks.blocks(t.documents).withColumn("level", level), "doc_id", "pos", "level")
    pattern = F.when(F.col("level") == 1, "%1.").otherwise("%1.%2")
    return counted.where("level < 3").select("doc_id", "pos", T.level_text(pattern, [F.col("c1").cast("string"), F.col("c2").cast("string")]).alias("label"))


@query()
def numbering_full(t):
    blk = blocks.blocks(t.documents).withColumn("ilvl", (F.coalesce(blocks.heading_level(), F.lit(3)) - 1).cast("int")).withColumn("num_id", (F.col("doc_id") % 2 + 1).cast("int"))
    levels = {(1, 0): {"text": "%1."}, (1, 1): {"text": "%1.%2"}, (1, 2): {"text": "(%3)", "kind": "letter"}, (2, 0): {"text": "%1)", "kind": "roman"}, (2, 1): {"text": "%1.%2"}, (2, 2): {"text": "%3", "start": 3, "restart": 0}}
    return ordered.list_labels(blk, levels)
