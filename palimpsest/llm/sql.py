"""DuckDB SQL for the queries that SQL can express: passages, leaks and near copies."""

from __future__ import annotations

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

REPEATED_PHRASES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k:k + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM d)),
first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS p FROM win JOIN first USING (s) WHERE f < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: For items of five words and more, as all of the benchmark are.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ds AS (SELECT doc_id, k - 1 AS pos, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
bs AS (SELECT item_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM b)),
iw AS (SELECT item_id, s, count(*) AS weight FROM bs GROUP BY ALL),
im AS (SELECT item_id, len(w) AS n, len(w) - 4 AS mass FROM b WHERE len(w) >= 5),
cand AS (SELECT doc_id, item_id FROM ds JOIN iw USING (s) JOIN im USING (item_id) GROUP BY doc_id, item_id, mass HAVING count(*) >= 0.8 * mass),
st AS (SELECT doc_id, item_id, n, mass, unnest(range(0, len(w) - n + 1)) AS start FROM cand JOIN im USING (item_id) JOIN d USING (doc_id)),
ww AS (SELECT st.doc_id, item_id, mass, start, s, count(*) AS have FROM st JOIN ds ON ds.doc_id = st.doc_id AND pos BETWEEN start AND start + n - 5 GROUP BY ALL),
sc AS (SELECT doc_id, item_id, mass, start, sum(least(have, weight)) AS shared FROM ww JOIN iw USING (item_id, s) GROUP BY ALL),
best AS (SELECT doc_id, item_id, mass, CAST(max(shared) AS BIGINT) AS shared FROM sc GROUP BY ALL)
SELECT doc_id, item_id, shared, 2 * mass - shared AS united FROM best WHERE 10 * shared >= 8 * (2 * mass - shared)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT w, min(doc_id) AS text_id FROM d GROUP BY w),
sh AS (SELECT DISTINCT text_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT text_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM t WHERE len(w) > 0)),
sz AS (SELECT text_id, count(*) AS z FROM sh GROUP BY text_id),
p AS (SELECT x.text_id AS a, y.text_id AS b, count(*) AS n FROM sh x JOIN sh y ON x.s = y.s AND x.text_id < y.text_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN sz za ON za.text_id = a JOIN sz zb ON zb.text_id = b WHERE 10 * n >= 8 * (za.z + zb.z - n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS x, b AS y FROM e UNION SELECT x, e.b FROM reach JOIN e ON y = e.a),
c AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY x),
n AS (SELECT a AS x, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, coalesce(class_id, text_id) AS class_id, text_id, coalesce(links, 0) AS links FROM d JOIN t USING (w) LEFT JOIN c ON c.x = text_id LEFT JOIN n ON n.x = text_id
"""
