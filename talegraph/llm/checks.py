"""SQL that says in DuckDB what the operators find, for the queries that it can express at the check size."""

from __future__ import annotations

_SPLIT = r"""
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
split AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS l, len(ws) AS n FROM w)
"""

OP5_SQL = f"""
WITH {_SPLIT},
named AS (SELECT doc_id, l, n, md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) AS h FROM split),
wins AS (SELECT doc_id, l, h FROM named WHERE l + 49 <= n),
firsts AS (SELECT h, min(doc_id) AS d FROM wins GROUP BY h),
dup AS (SELECT x.doc_id, x.l FROM wins x JOIN firsts f ON x.h = f.h WHERE x.doc_id > f.d),
gone AS (SELECT DISTINCT doc_id, l FROM (SELECT doc_id, unnest(range(l, l + 50)) AS l FROM dup) q),
kept AS (SELECT s.doc_id, string_agg(word, ' ' ORDER BY s.l) AS text, count(*) AS n FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.l = g.l WHERE g.l IS NULL GROUP BY s.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
split AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS l, len(ws) AS n FROM w),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS t FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0) q),
tens AS (SELECT doc_id, l, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS t FROM split),
short AS (SELECT s.doc_id, s.l, iw.m, iw.item FROM split s JOIN iw ON iw.m < 10 AND s.l + iw.m - 1 <= s.n JOIN w ON w.doc_id = s.doc_id WHERE array_to_string(w.ws[s.l : s.l + iw.m - 1], ' ') = iw.t),
hits AS (SELECT x.doc_id, x.l, 10 AS m, iw.item FROM tens x JOIN iw ON iw.m = 10 AND iw.t = x.t WHERE x.l + 9 <= x.n UNION ALL SELECT doc_id, l, m, item FROM short),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, l FROM (SELECT doc_id, unnest(range(l, l + m)) AS l FROM hits) q) r GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT doc_id, item FROM hits) q GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.list, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN items i ON i.doc_id = w.doc_id
"""

OP1_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
split AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS l, len(ws) AS n FROM w),
fives AS (SELECT doc_id, l, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS t FROM split),
sh AS (SELECT DISTINCT doc_id, t FROM fives WHERE l + 4 <= n OR (n < 5 AND l = 1)),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS met FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * met >= 80 * (x.n + y.n - met)),
r(id, other) AS (SELECT u, v FROM links UNION SELECT r.id, links.v FROM r JOIN links ON links.u = r.other),
least_of AS (SELECT id, min(other) AS m FROM r GROUP BY id)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN least_of k ON k.id = w.doc_id
"""
