"""SQL of the two operators on whole texts that need recursion or byte strings; fit for small tables only."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets as distinct shingles, classes of equal sets, links by counting common shingles, components by recursion.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
k AS (SELECT r, count(*) AS n, sha256(string_agg(s, chr(10) ORDER BY s)) AS k FROM s GROUP BY r),
rep AS (SELECT k, min(r) AS r, min(n) AS n FROM k GROUP BY k),
rs AS (SELECT s.r, s.s, rep.n FROM s JOIN rep ON rep.r = s.r),
p AS (SELECT a.r AS a, b.r AS b, min(a.n) AS an, min(b.n) AS bn, count(*) AS c FROM rs a JOIN rs b ON a.s = b.s AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (an + bn - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT r, r FROM rep UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
own AS (SELECT k.r, k.n, rep.r AS rr FROM k JOIN rep ON rep.k = k.k),
low AS (SELECT rr, min(doc_id) AS m FROM own JOIN d ON d.r = own.r GROUP BY 1),
comp AS (SELECT reach.a, min(low.m) AS c FROM reach JOIN low ON low.rr = reach.b GROUP BY 1)
SELECT d.doc_id, coalesce(own.n, 0) AS n_shingles, CASE WHEN own.r IS NULL THEN d.doc_id ELSE comp.c END AS component_id
FROM d LEFT JOIN own ON own.r = d.r LEFT JOIN comp ON comp.a = own.rr
"""

#: Every 400-byte string by its place, counted; what the repeated ones cover; the rest put together again.
REPEATS = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
c AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
x AS (SELECT w.r, w.i FROM w JOIN c ON c.m = w.m),
g AS (SELECT r, i, CASE WHEN i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 400, -1) THEN 1 ELSE 0 END AS fresh FROM x),
n AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
s AS (SELECT r, run, min(i) AS a, max(i) + 400 AS b FROM n GROUP BY 1, 2),
k AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
t AS (SELECT r, count(*) AS spans, sum(b - a) AS removed, max(b) AS last FROM s GROUP BY r),
y AS (SELECT k.r, string_agg(substr(d.h, CAST(2 * k.before + 1 AS BIGINT), CAST(2 * (k.a - k.before) AS BIGINT)), '' ORDER BY k.a) AS kept FROM k JOIN d ON d.r = k.r GROUP BY k.r)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN t.r IS NULL THEN d.h ELSE y.kept || substr(d.h, CAST(2 * t.last + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN t ON t.r = d.r LEFT JOIN y ON y.r = d.r
"""
