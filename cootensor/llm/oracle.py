"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_COMPONENTS = """
reach(id, other) AS (
  SELECT id, id FROM nodes
  UNION
  SELECT r.id, CASE WHEN l.a = r.other THEN l.b ELSE l.a END
  FROM reach r JOIN links l ON l.a = r.other OR l.b = r.other)
"""

OP1 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT id, CASE WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)])
                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
nodes AS (SELECT id, len(sh) AS n FROM s),
x AS (SELECT id, unnest(sh) AS t FROM s),
links AS (
  SELECT p.a, p.b FROM (SELECT u.id AS a, v.id AS b, count(*) AS c FROM x u JOIN x v ON u.t = v.t AND u.id < v.id GROUP BY ALL) p
  JOIN nodes m ON m.id = p.a JOIN nodes n ON n.id = p.b WHERE 100 * c >= 75 * (m.n + n.n - c)),
{_COMPONENTS}
SELECT n.id AS doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM nodes n JOIN reach r ON r.id = n.id GROUP BY ALL
"""

OP6 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, m, unnest([array_to_string(ws[i:i + m - 1], ' ') for i in range(1, len(ws) - m + 2)]) AS t
  FROM (SELECT *, least(10, len(ws)) AS m FROM bw WHERE len(ws) > 0)),
pos AS (
  SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS t
  FROM (SELECT doc_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS i FROM dw, (SELECT DISTINCT m FROM win))),
hit AS (SELECT p.doc_id, p.i, p.m, w.item_id FROM pos p JOIN win w ON w.m = p.m AND w.t = p.t),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, len(d.ws) AS n_words, coalesce(w.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
       sha256(coalesce(i.s, '')) AS items_sha256, coalesce(w.n, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words w USING (doc_id) LEFT JOIN items i USING (doc_id)
"""

OP7 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x for x in e if x <> 0]) > 0),
nodes AS (SELECT vec_id AS id FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
{_COMPONENTS},
ends AS (SELECT a AS id FROM links UNION ALL SELECT b FROM links),
degree AS (SELECT id, count(*) AS n FROM ends GROUP BY 1),
comp AS (SELECT id, min(other) AS c FROM reach GROUP BY 1)
SELECT n.id AS vec_id, coalesce(d.n, 0) AS n_links, c.c AS component_id, n.id = c.c AS kept
FROM nodes n JOIN comp c ON c.id = n.id LEFT JOIN degree d ON d.id = n.id
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '') AS tie FROM documents),
s AS (
  SELECT source, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
o AS (
  SELECT *, sum(size) OVER () AS t, coalesce(sum(3 * size) OVER before, 0) AS used, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_w,
         row_number() OVER (ORDER BY 3 * size / w, source) AS k
  FROM s WINDOW before AS (ORDER BY 3 * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, bool_and(size = 0 OR w * (t - used) / left_w > 3 * size) OVER (ORDER BY k) AS is_full FROM o),
g AS (
  SELECT source, size, CASE WHEN is_full THEN CAST(3 * size AS DOUBLE)
    ELSE w * CAST(t - sum(CASE WHEN is_full THEN 3 * size ELSE 0 END) OVER () AS DOUBLE) / CAST(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM f),
p AS (
  SELECT d.n, d.source, d.size, CAST(floor(g.target + 0.5) AS BIGINT) AS quota, g.size AS source_size, e.pass,
         left(md5('0:' || e.pass || ':' || d.tie), 12) AS key, d.tie
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, (SELECT unnest([0, 1, 2]) AS pass) e),
q AS (
  SELECT n, quota, size, source_size * pass + sum(size) OVER (PARTITION BY source, pass ORDER BY key, tie, n ROWS UNBOUNDED PRECEDING) - size AS start FROM p),
r AS (SELECT n, CAST(sum(greatest(0, least(start + size, quota) - start)) AS BIGINT) AS taken FROM q GROUP BY n)
SELECT d.doc_id, d.size, g.size AS source_size, g.target, r.taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN r ON r.n = d.n
"""

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT row_number() OVER () AS j, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d WHERE len(ws) > 0),
it AS (SELECT j, term, count(*) AS times FROM (SELECT j, unnest(ws) AS term FROM i) GROUP BY ALL),
tf AS (
  SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term, c.n),
part AS (
  SELECT tf.k, tf.term, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 75 + (75 * len(d.ws) * c.n) // c.l))) AS v
  FROM tf JOIN w USING (term) JOIN d ON d.k = tf.k, c),
score AS (SELECT it.j, part.k, CAST(sum(it.times * part.v) AS BIGINT) AS score FROM it JOIN part USING (term) GROUP BY ALL),
ranked AS (
  SELECT s.j, d.doc_id, s.score, CAST(row_number() OVER (PARTITION BY s.j ORDER BY s.score DESC, d.doc_id NULLS LAST) AS INTEGER) AS rank
  FROM score s JOIN d ON d.k = s.k WHERE s.score > 0)
SELECT i.item_id, r.rank, r.doc_id, r.score FROM ranked r JOIN i ON i.j = r.j WHERE r.rank <= 10
"""


def _op2() -> str:
    from . import secrets as s

    weak = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}", "bare": r"[A-Za-z0-9+/_=-]{20,}"}
    group = {"assign": 2, "ident": 2, "endpoint": 1}
    keeps = {"assign": "length(v) >= 8", "access": "length(m) >= 16", "hex": "length(m) >= 32", "ident": "length(v) >= 3",
             "bare": "length(m) >= 20 AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[0-9]')",
             "endpoint": "length(v) >= 1"}
    parts = []
    for rank, kind in enumerate(s.KINDS, 1):
        p = weak.get(kind, s.PATTERNS[kind]).replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {rank} AS rank, '{kind}' AS kind, '{s.ROLES[kind]}' AS role, stop - length(m) AS "start", stop AS "end" FROM (
    SELECT doc_id, ms[i] AS m, vs[i] AS v,
           list_sum([length(x) for x in ps[1:i]]) + list_sum([length(x) for x in ms[1:i]]) AS stop
    FROM (SELECT doc_id, ps, ms, vs, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT doc_id, string_split_regex(t, '{p}') AS ps, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group.get(kind, 0)}) AS vs
      FROM d)))
  WHERE {keeps[kind]}""")
    near = 'AND o.doc_id = p.doc_id AND abs(o."start" - p."start") <= ' + str(s.SCOPE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(parts)}),
signed AS (SELECT doc_id FROM d WHERE regexp_matches(t, '(?i:password|passwd|secret|token|api_?key|access_?key_?id|client_?id|user_?name|user|login|account)["'']?\\x20*[:=]|AKIA[A-Z0-9]{{12}}|[0-9a-f]{{32}}')),
parts AS (
  SELECT p.* FROM raw p JOIN signed USING (doc_id)
  WHERE p.rank <= 3 OR NOT EXISTS (
    SELECT 1 FROM raw o WHERE o.doc_id = p.doc_id AND o.rank <= 3 AND o."start" < p."end" AND o."end" > p."start")),
weak AS (
  SELECT p.*, EXISTS (SELECT 1 FROM parts o WHERE o.role = 'i' {near}) AS i, EXISTS (SELECT 1 FROM parts o WHERE o.role = 's' {near}) AS s
  FROM parts p WHERE p.rank > 3),
spans AS (
  SELECT doc_id, rank, kind, "start", "end" FROM parts WHERE rank <= 3
  UNION ALL SELECT doc_id, rank, kind, "start", "end" FROM weak
  WHERE CASE kind WHEN 'ident' THEN s WHEN 'bare' THEN i ELSE i AND s END),
told AS (
  SELECT doc_id, count(*) FILTER (rank = 1) AS a, count(*) FILTER (rank = 2) AS b, count(*) FILTER (rank = 3) AS c, count(*) FILTER (rank > 3) AS l,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) FILTER (rank <= 3) AS base,
         string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", rank) AS spans
  FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(l, 0) AS n_linked
FROM d LEFT JOIN told USING (doc_id)
"""


ORACLE_SQL = {"op1_ngram_jaccard_join": OP1, "op2_secret_scan": _op2(), "op6_benchmark_decontamination": OP6,
              "op7_embedding_near_dedup": OP7, "op11_mixing": OP11, "op13_ranked_search": OP13}
