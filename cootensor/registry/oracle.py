"""DuckDB oracle SQL for the registered queries.

Tensors are rebuilt from the base tables with the same rules as
``cootensor.sources.fixtures``.
"""

import re

TRADE = """
trade AS (
  SELECT CAST(c.c_nationkey AS INTEGER) AS cn, CAST(s.s_nationkey AS INTEGER) AS sn,
         CAST((year(o.o_orderdate) - 1995) * 12 + month(o.o_orderdate) - 1 AS INTEGER) AS m,
         CAST(sum(l.l_quantity) AS DOUBLE) AS product
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  GROUP BY 1, 2, 3
  HAVING sum(l.l_quantity) <> 0)"""

NATION_REGION = """
nation_region AS (
  SELECT CAST(n_regionkey AS INTEGER) AS _1, CAST(n_nationkey AS INTEGER) AS _2, 1.0::DOUBLE AS product
  FROM nation)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["ttm"] = with_(TRADE, NATION_REGION) + """
SELECT f._1 AS cn, t.sn, t.m, sum(t.product * f.product) AS product
FROM trade t JOIN nation_region f ON t.cn = f._2
GROUP BY f._1, t.sn, t.m"""

# ------------------------------------------------------------------ fixtures

DAY = "CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER)"
DEC_SUM = "CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE)"

EVENTS_UED = f"""
ev_cells AS (
  SELECT user_id, event_type, {DAY} AS d, {DEC_SUM} AS product
  FROM events GROUP BY 1, 2, 3 HAVING {DEC_SUM} <> 0),
events_ued AS (
  SELECT CAST(dense_rank() OVER (ORDER BY user_id) - 1 AS INTEGER) AS u,
         CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS e, d, product
  FROM ev_cells)"""

EVENTS_ED = f"""
ed_cells AS (
  SELECT event_type, {DAY} AS d, {DEC_SUM} AS product
  FROM events GROUP BY 1, 2 HAVING {DEC_SUM} <> 0),
events_ed AS (
  SELECT CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS e, d, product FROM ed_cells)"""

PARTS_CELLS = """
parts_cells AS (
  SELECT p.p_brand, p.p_type, l.l_returnflag, l.l_linestatus, CAST(sum(l.l_quantity) AS DOUBLE) AS product
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY 1, 2, 3, 4 HAVING sum(l.l_quantity) <> 0)"""

PARTS = PARTS_CELLS + """,
parts AS (
  SELECT CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS b,
         CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS t,
         CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS f,
         CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS INTEGER) AS s, product
  FROM parts_cells)"""

EMBED = """
embed AS (
  SELECT i, j, product FROM (
    SELECT CAST(vec_id AS INTEGER) AS i, CAST(unnest(range(len(embedding))) AS INTEGER) AS j,
           CAST(unnest(embedding) AS DOUBLE) AS product
    FROM embeddings) WHERE product <> 0)"""

MONTH_YEAR = """
month_year AS (
  SELECT DISTINCT CAST(floor(m / 12) AS INTEGER) AS _1, m AS _2, 1.0::DOUBLE AS product FROM trade)"""

LAG_WEIGHTS = """
lag_weights AS (
  SELECT CAST(a AS INTEGER) AS _1, CAST(b AS INTEGER) AS _2, CAST(c AS DOUBLE) AS product
  FROM (VALUES (0, 0, 0.0), (0, 1, 0.5), (0, 2, 0.25), (0, 3, 0.25)) v(a, b, c))"""

EVENTS_LAG = EVENTS_ED + """,
events_lag AS (
  SELECT e, CAST(k AS INTEGER) AS lag, CAST(d + k AS INTEGER) AS d, product
  FROM events_ed, range(4) r(k)),
done AS (SELECT d FROM events_lag GROUP BY d HAVING count(DISTINCT lag) = 4),
x AS (SELECT e, lag, d, product FROM events_lag WHERE d IN (SELECT d FROM done) AND lag <> 3),
y AS (SELECT e, CAST(0 AS INTEGER) AS lag, d, sum(product) AS product
      FROM events_lag WHERE d IN (SELECT d FROM done) AND lag = 3 GROUP BY e, d)"""


def sib(name: str, src: str, mode: str) -> str:
    """Shifted identity + bias factor over the indices of ``mode`` in ``src``."""
    return f"""
{name} AS (
  SELECT _1, CAST(0 AS INTEGER) AS _2, CAST(_1 + 1 AS DOUBLE) AS product
  FROM (SELECT DISTINCT {mode} AS _1 FROM {src})
  UNION ALL
  SELECT _1, CAST(_1 + 1 AS INTEGER) AS _2, 1.0::DOUBLE AS product
  FROM (SELECT DISTINCT {mode} AS _1 FROM {src}))"""


def lcg(i: str, j: str, seed: int) -> str:
    return (f"CAST((CAST({i} AS BIGINT) * 1103515245 + CAST({j} AS BIGINT) * 12345 + {seed}) "
            f"% 2147483647 AS DOUBLE) / 2147483647.0::DOUBLE")


def affine_step(src: str, out: str, fac: str, mode: str, modes: list[str], precision: float | None,
                where: str) -> str:
    """One affine mode product as SQL (weights = rows with _2 > 0, bias = _2 = 0)."""
    sel = ", ".join(f"w._1 AS {m}" if m == mode else f"x.{m}" for m in modes)
    grp = ", ".join(str(i + 1) for i in range(len(modes)))
    cols = ", ".join(f"p.{m}" for m in modes)
    if where == "before":
        cond = f"WHERE abs(p.product) > {precision}" if precision is not None else ""
        fin = f"""SELECT {cols}, p.product + b.product AS product
  FROM {out}_p p JOIN {fac} b ON p.{mode} = b._1 AND b._2 = 0 {cond}"""
    else:
        cond = f"WHERE abs(p.product + b.product) > {precision}" if precision is not None else ""
        fin = f"""SELECT {cols}, p.product + b.product AS product
  FROM {out}_p p JOIN {fac} b ON p.{mode} = b._1 AND b._2 = 0 {cond}"""
    return f"""
{out}_p AS (
  SELECT {sel}, sum(x.product * w.product) AS product
  FROM {src} x JOIN {fac} w ON x.{mode} = w._2 - 1 AND w._2 > 0
  GROUP BY {grp}),
{out} AS ({fin})"""


Q = ORACLE_SQL

Q["scan_tensor"] = with_(TRADE) + "SELECT * FROM trade"
Q["sink_roundtrip"] = with_(TRADE) + "SELECT * FROM trade"
Q["csv_tensor"] = with_(TRADE) + "SELECT cn AS _1, sn AS _2, m AS _3, product FROM trade"
Q["literal_factor"] = with_(EVENTS_LAG) + """
SELECT x.e, CAST(f.a AS INTEGER) AS lag, x.d, round(sum(x.product * f.c), 6) AS product
FROM events_lag x
JOIN (SELECT a, b, CAST(c AS DOUBLE) AS c FROM (VALUES (0, 0, 0.5), (0, 1, 0.25), (0, 2, 0.25)) v(a, b, c)) f
  ON x.lag = f.b
GROUP BY x.e, f.a, x.d"""
Q["index_grid"] = with_(PARTS) + """
SELECT CAST(b AS INTEGER) AS b, CAST(t AS INTEGER) AS t, CAST(f AS INTEGER) AS f, CAST(s AS INTEGER) AS s
FROM (SELECT unnest(range((SELECT max(b) + 1 FROM parts))) AS b),
     (SELECT unnest(range((SELECT max(t) + 1 FROM parts))) AS t),
     (SELECT unnest(range((SELECT max(f) + 1 FROM parts))) AS f),
     (SELECT unnest(range((SELECT max(s) + 1 FROM parts))) AS s)"""
Q["factor_store"] = with_(EVENTS_UED, sib("fe", "events_ued", "e"), sib("fd", "events_ued", "d")) + """
SELECT CAST(0 AS INTEGER) AS iter, CAST(1 AS INTEGER) AS mode, _1, _2, product FROM fe
UNION ALL
SELECT CAST(1 AS INTEGER) AS iter, CAST(2 AS INTEGER) AS mode, _1, _2, product FROM fd"""
Q["factor_snapshot"] = with_(EVENTS_UED, sib("fd", "events_ued", "d")) + "SELECT * FROM fd"

Q["mode_rename"] = with_(TRADE) + "SELECT cn AS _1, sn AS _2, m AS _3, product FROM trade"
Q["bias_encode"] = with_(EMBED) + "SELECT i AS _1, CAST(j + 1 AS INTEGER) AS _2, product FROM embed"
Q["bias_split"] = with_(EVENTS_UED) + """
SELECT u AS _1, u AS _2, 1.0::DOUBLE AS product, CAST(u + 1 AS DOUBLE) AS bias
FROM (SELECT DISTINCT u FROM events_ued)"""
Q["time_slice"] = with_(TRADE) + "SELECT * FROM trade WHERE m >= 12 AND m < 24"
Q["cell_lookup"] = with_(TRADE) + "SELECT * FROM trade WHERE cn = 1 AND sn = 2 AND m = 3"
Q["sparsify"] = with_(EVENTS_UED) + "SELECT * FROM events_ued WHERE abs(product) > 100.0"
Q["rebase"] = with_(TRADE) + """
SELECT cn, sn, CAST(m - (SELECT min(m) FROM trade) AS INTEGER) AS m, product FROM trade"""
Q["collapse_modes"] = with_(EVENTS_UED) + """
SELECT CAST(0 AS INTEGER) AS u, e, d, round(sum(product), 6) AS product FROM events_ued GROUP BY e, d"""
Q["transpose"] = with_(EMBED) + "SELECT j AS _1, i AS _2, product FROM embed"
Q["unfold"] = with_(TRADE) + "SELECT cn, m, sn, product FROM trade"
Q["fold_roundtrip"] = with_(TRADE) + "SELECT * FROM trade"
Q["spmm_composite_key"] = with_(TRADE, MONTH_YEAR) + """
SELECT f._1, t.cn, t.sn, sum(f.product * t.product) AS product
FROM month_year f JOIN trade t ON f._2 = t.m GROUP BY 1, 2, 3"""

Q["spmm_atb"] = with_(EMBED) + """
SELECT e.j AS _1, l.l AS _2, round(sum(e.product * 1.0), 6) AS product
FROM embed e JOIN (SELECT CAST(vec_id AS INTEGER) AS i, CAST(label AS INTEGER) AS l FROM embeddings) l
  ON e.i = l.i
GROUP BY 1, 2"""
Q["spmm_abt"] = with_(EMBED) + f""",
proj AS (
  SELECT CAST(p AS INTEGER) AS _1, CAST(j AS INTEGER) AS _2, {lcg('p', 'j', 7)} AS product
  FROM range(4) a(p), (SELECT unnest(range((SELECT max(j) + 1 FROM embed))) AS j))
SELECT e.i, p._1, round(sum(e.product * p.product), 6) AS product
FROM embed e JOIN proj p ON e.j = p._2 GROUP BY 1, 2"""
Q["gram"] = with_(TRADE) + """
SELECT a.cn AS _1, b.cn AS _2, sum(a.product * b.product) AS product
FROM trade a JOIN trade b ON a.sn = b.sn AND a.m = b.m GROUP BY 1, 2"""
Q["matrix_add"] = with_(TRADE) + """
SELECT _1, _2, sum(product) AS product
FROM (SELECT cn AS _1, sn AS _2, product FROM trade UNION ALL SELECT sn, cn, product FROM trade) GROUP BY 1, 2"""
Q["mode_marginal"] = with_(TRADE) + "SELECT sn, sum(product) AS product FROM trade GROUP BY sn"
Q["tensor_shape"] = with_(TRADE) + """
SELECT CAST(max(cn) + 1 AS INTEGER) AS cn, CAST(max(sn) + 1 AS INTEGER) AS sn, CAST(max(m) + 1 AS INTEGER) AS m
FROM trade"""
Q["nnz_density"] = with_(EVENTS_UED) + """
SELECT count(*) AS nnz,
       CAST(max(u) + 1 AS DOUBLE) * CAST(max(e) + 1 AS DOUBLE) * CAST(max(d) + 1 AS DOUBLE) AS dense_cells,
       CAST(count(*) AS DOUBLE) / (CAST(max(u) + 1 AS DOUBLE) * CAST(max(e) + 1 AS DOUBLE) * CAST(max(d) + 1 AS DOUBLE)) AS density
FROM events_ued"""
Q["topk_core"] = with_(TRADE) + "SELECT * FROM trade ORDER BY abs(product) DESC, cn, sn, m LIMIT 100"
LINE_LAGS = """
line_cells AS (
  SELECT CAST(l_orderkey AS INTEGER) AS o, CAST(l_partkey AS INTEGER) AS p,
         CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS d,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS product
  FROM lineitem GROUP BY 1, 2, 3),
line_lags AS (
  SELECT o, p, CAST(lag AS INTEGER) AS lag, CAST(d + lag AS INTEGER) AS d, product
  FROM (SELECT *, unnest(range(12)) AS lag FROM line_cells))"""
Q["topk_large"] = with_(LINE_LAGS) + "SELECT * FROM line_lags ORDER BY abs(product) DESC, o, p, lag, d LIMIT 499999"
Q["topk_ties"] = with_(LINE_LAGS) + "SELECT o, p, lag, d, 1.0::DOUBLE AS product FROM line_lags ORDER BY o, p, lag, d LIMIT 20000"
Q["vstack"] = with_(TRADE) + """
SELECT CAST(0 AS INTEGER) AS MATRIX_ID, cn AS _1, sn AS _2, sum(product) AS product FROM trade GROUP BY ALL
UNION ALL
SELECT CAST(1 AS INTEGER) AS MATRIX_ID, sn AS _1, cn AS _2, sum(product) AS product FROM trade GROUP BY ALL"""
Q["ttm_chain"] = with_(TRADE, NATION_REGION, MONTH_YEAR) + """
SELECT a._1 AS cn, b._1 AS sn, y._1 AS m, sum(t.product) AS product
FROM trade t JOIN nation_region a ON t.cn = a._2 JOIN nation_region b ON t.sn = b._2
JOIN month_year y ON t.m = y._2
GROUP BY 1, 2, 3"""
Q["ttm_chain_skip"] = with_(TRADE, NATION_REGION, MONTH_YEAR) + """
SELECT a._1 AS cn, t.sn, y._1 AS m, sum(t.product) AS product
FROM trade t JOIN nation_region a ON t.cn = a._2 JOIN month_year y ON t.m = y._2
GROUP BY 1, 2, 3"""
Q["ttm_chain_topk"] = with_(TRADE, NATION_REGION, MONTH_YEAR) + """,
s1 AS (SELECT f._1 AS cn, t.sn, t.m, sum(t.product * f.product) AS product
       FROM trade t JOIN nation_region f ON t.cn = f._2 GROUP BY 1, 2, 3),
k1 AS (SELECT * FROM s1 ORDER BY abs(product) DESC, cn, sn, m LIMIT 500),
s2 AS (SELECT k1.cn, k1.sn, f._1 AS m, sum(k1.product * f.product) AS product
       FROM k1 JOIN month_year f ON k1.m = f._2 GROUP BY 1, 2, 3)
SELECT * FROM s2 ORDER BY abs(product) DESC, cn, sn, m LIMIT 500"""

Q["lag_expand"] = with_(EVENTS_LAG) + "SELECT * FROM events_lag"
Q["complete_times"] = with_(EVENTS_LAG) + "SELECT d FROM done"
Q["lag_xy_split"] = with_(EVENTS_LAG) + """
SELECT CAST(0 AS INTEGER) AS part, e, lag, d, product FROM x
UNION ALL
SELECT CAST(1 AS INTEGER) AS part, e, lag, d, product FROM y"""
Q["rebase_time"] = with_(EVENTS_LAG) + """,
mn AS (SELECT min(d) AS m0 FROM x WHERE d > 5)
SELECT CAST(0 AS INTEGER) AS part, e, lag, CAST(d - (SELECT m0 FROM mn) AS INTEGER) AS d, product FROM x WHERE d > 5
UNION ALL
SELECT CAST(1 AS INTEGER) AS part, e, lag, CAST(d - (SELECT m0 FROM mn) AS INTEGER) AS d, product FROM y WHERE d > 5"""

Q["affine_ttm"] = with_(EVENTS_LAG, LAG_WEIGHTS) + "," + affine_step(
    "x", "a1", "lag_weights", "lag", ["e", "lag", "d"], 1e-6, "before").lstrip() + """
SELECT e, lag, d, round(product, 6) AS product FROM a1"""
Q["affine_chain"] = with_(PARTS, sib("ft", "parts", "t"), sib("ff", "parts", "f"), sib("fs", "parts", "s")) + "," + ",".join([
    affine_step("parts", "c1", "ft", "t", ["b", "t", "f", "s"], 0.5, "before").lstrip(),
    affine_step("c1", "c2", "ff", "f", ["b", "t", "f", "s"], 0.5, "before").lstrip(),
    affine_step("c2", "c3", "fs", "s", ["b", "t", "f", "s"], 0.5, "before").lstrip()]) + """
SELECT * FROM c3"""
PREDICT = "," + ",".join([
    sib("fe", "x", "e").lstrip(),
    affine_step("x", "p1", "fe", "e", ["e", "lag", "d"], 1.0, "after").lstrip(),
    affine_step("p1", "p2", "lag_weights", "lag", ["e", "lag", "d"], 1.0, "after").lstrip()])
Q["predict_tensor"] = with_(EVENTS_LAG, LAG_WEIGHTS) + PREDICT + """
SELECT e, lag, d, round(product, 6) AS product FROM p2"""
Q["r2_score"] = with_(EVENTS_LAG, LAG_WEIGHTS) + PREDICT + """,
j AS (SELECT y.product AS yv, p2.product AS pv FROM y JOIN p2 USING (e, lag, d) WHERE p2.product > 0)
SELECT round(1 - sum(power(yv - pv, 2)) / (var_pop(yv) * count(*)), 6) AS r2, count(*) AS n FROM j"""
Q["r2_inloop"] = with_(EVENTS_LAG, LAG_WEIGHTS) + PREDICT + """,
j AS (SELECT y.product AS yv, p2.product AS pv FROM y JOIN p2 USING (e, lag, d) WHERE p2.product >= 1)
SELECT round(1 - sum(power(yv - pv, 2)) / (var_pop(yv) * count(*)), 6) AS r2, count(*) AS n FROM j"""
Q["recon_mse"] = with_(TRADE, NATION_REGION, MONTH_YEAR) + """,
g AS (SELECT a._1 AS r1, b._1 AS r2, y._1 AS yr, sum(t.product) AS product
      FROM trade t JOIN nation_region a ON t.cn = a._2 JOIN nation_region b ON t.sn = b._2
      JOIN month_year y ON t.m = y._2 GROUP BY 1, 2, 3),
rec AS (SELECT a._2 AS cn, b._2 AS sn, y._2 AS m, sum(g.product) AS product
        FROM g JOIN nation_region a ON g.r1 = a._1 JOIN nation_region b ON g.r2 = b._1
        JOIN month_year y ON g.yr = y._1 GROUP BY 1, 2, 3)
SELECT count(*) AS n, avg(power(t.product - rec.product, 2)) AS mse
FROM trade t JOIN rec USING (cn, sn, m)"""

Q["index_modes"] = with_(PARTS_CELLS) + """
SELECT CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand,
       CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS INTEGER) AS p_type,
       l_returnflag, l_linestatus, product
FROM parts_cells"""
Q["index_modes_nulls"] = """
WITH c AS (
  SELECT CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS f, l_linestatus AS s, CAST(sum(l_quantity) AS DOUBLE) AS product
  FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)
SELECT CAST(dense_rank() OVER (ORDER BY f NULLS LAST) - 1 AS INTEGER) AS flag,
       CAST(dense_rank() OVER (ORDER BY s) - 1 AS INTEGER) AS l_linestatus, product FROM c"""
Q["build_tensor"] = with_(EVENTS_UED) + "SELECT * FROM events_ued"


def with_rec(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n"


def lcg_grid(name: str, src: str, mode: str, rank: int, seed: int) -> str:
    return f"""
{name} AS (
  SELECT CAST(r AS INTEGER) AS _1, CAST(j AS INTEGER) AS _2, {lcg('r', 'j', seed)} AS product
  FROM range({rank}) a(r), (SELECT unnest(range((SELECT max({mode}) + 1 FROM {src}))) AS j))"""


TUCKER_F = ",".join([lcg_grid("f1", "trade", "cn", 2, 3).lstrip(), lcg_grid("f2", "trade", "sn", 2, 4).lstrip(),
                     lcg_grid("f3", "trade", "m", 3, 5).lstrip()])
CORE = """
core AS (
  SELECT a._1 AS cn, b._1 AS sn, c._1 AS m, sum(t.product * a.product * b.product * c.product) AS product
  FROM trade t JOIN f1 a ON t.cn = a._2 JOIN f2 b ON t.sn = b._2 JOIN f3 c ON t.m = c._2
  GROUP BY 1, 2, 3)"""

Q["random_factors"] = with_(TRADE) + "," + ",".join([
    lcg_grid("f1", "trade", "cn", 2, 11).lstrip(), lcg_grid("f2", "trade", "sn", 3, 12).lstrip(),
    lcg_grid("f3", "trade", "m", 4, 13).lstrip()]) + """
SELECT CAST(0 AS INTEGER) AS mode, * FROM f1 UNION ALL
SELECT CAST(1 AS INTEGER) AS mode, * FROM f2 UNION ALL
SELECT CAST(2 AS INTEGER) AS mode, * FROM f3"""
Q["tucker_core"] = with_(TRADE) + "," + TUCKER_F + "," + CORE.lstrip() + """
SELECT cn, sn, m, round(product, 4) AS product FROM core"""
Q["tucker_reconstruct"] = with_(TRADE) + "," + TUCKER_F + "," + CORE.lstrip() + """
SELECT a._2 AS cn, b._2 AS sn, c._2 AS m, round(sum(g.product * a.product * b.product * c.product), 4) AS product
FROM core g JOIN f1 a ON g.cn = a._1 JOIN f2 b ON g.sn = b._1 JOIN f3 c ON g.m = c._1
GROUP BY 1, 2, 3"""

Q["recon_mse_outer"] = with_(TRADE) + "," + TUCKER_F + "," + CORE.lstrip() + """,
rec AS (
  SELECT a._2 AS cn, b._2 AS sn, c._2 AS m, sum(g.product / 1e6 * a.product * b.product * c.product) AS product
  FROM core g JOIN f1 a ON g.cn = a._1 JOIN f2 b ON g.sn = b._1 JOIN f3 c ON g.m = c._1 GROUP BY 1, 2, 3)
SELECT count(*) AS n, round(avg(power(coalesce(t.product, 0) - rec.product, 2)) / 1e3, 4) AS mse_k
FROM rec LEFT JOIN trade t USING (cn, sn, m)"""

GRAM_CN = """
g AS (SELECT a.cn AS _1, b.cn AS _2, sum(a.product * b.product) AS product
      FROM trade a JOIN trade b ON a.sn = b.sn AND a.m = b.m GROUP BY 1, 2),
pw(step, j, v) AS (
  SELECT 0, _1, 1.0::DOUBLE FROM (SELECT DISTINCT _1 FROM g)
  UNION ALL
  SELECT step + 1, j, v / sqrt(sum(v * v) OVER ()) FROM (
    SELECT p.step, g._1 AS j, sum(g.product * p.v) AS v
    FROM pw p JOIN g ON g._2 = p.j WHERE p.step < 60 GROUP BY p.step, g._1))"""
Q["gram_eigvec"] = with_rec(TRADE, GRAM_CN) + """
SELECT CAST(0 AS INTEGER) AS _1, CAST(j AS INTEGER) AS _2, round(v, 6) AS product FROM pw WHERE step = 60"""
Q["gram_eigvec_subspace"] = Q["gram_eigvec"]

REG_XY = EVENTS_LAG + """,
x0 AS (SELECT min(d) AS m0 FROM x),
xr AS (SELECT e, lag, CAST(d - (SELECT m0 FROM x0) AS INTEGER) AS d, product / 1024.0::DOUBLE AS product
       FROM x),
yr AS (SELECT e, lag, CAST(d - (SELECT m0 FROM x0) AS INTEGER) AS d, product / 1024.0::DOUBLE AS product
       FROM y)""" + "," + LAG_WEIGHTS.lstrip() + "," + sib("fe", "xr", "e").lstrip()


def normal_sql(xb: str, mode: str, key: list[str], ysrc: str, ykeep: list[str]) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in key)
    n = " * ".join(f"CAST(max({k}) + 1 AS DOUBLE)" for k in ykeep)
    return f"""
gx AS (SELECT CAST(a.{mode} + 1 AS INTEGER) AS _1, CAST(b.{mode} + 1 AS INTEGER) AS _2,
              sum(a.product * b.product) AS product FROM {xb} a JOIN {xb} b ON {on} GROUP BY 1, 2),
sx AS (SELECT CAST({mode} + 1 AS INTEGER) AS _1, CAST(0 AS INTEGER) AS _2, sum(product) AS product
       FROM {xb} GROUP BY {mode}),
amat AS (
  SELECT _1, _2, sum(product) AS product FROM (
    SELECT * FROM gx
    UNION ALL SELECT * FROM sx
    UNION ALL SELECT _2 AS _1, _1 AS _2, product FROM sx
    UNION ALL SELECT CAST(0 AS INTEGER), CAST(0 AS INTEGER), {n} FROM {ysrc}
    UNION ALL SELECT CAST(r AS INTEGER), CAST(r AS INTEGER), 0.001::DOUBLE
              FROM range(0, (SELECT max({mode}) + 2 FROM {xb})) q(r))
  GROUP BY 1, 2)"""


def cross_sql(xb: str, mode: str, key: list[str], ysrc: str) -> str:
    on = " AND ".join(f"y.{k} = x.{k}" for k in key)
    return f"""
cmat AS (
  SELECT CAST(y.{mode} AS INTEGER) AS _1, CAST(x.{mode} + 1 AS INTEGER) AS _2, sum(y.product * x.product) AS product
  FROM {ysrc} y JOIN {xb} x ON {on} GROUP BY 1, 2
  UNION ALL
  SELECT CAST({mode} AS INTEGER) AS _1, CAST(0 AS INTEGER) AS _2, sum(product) AS product FROM {ysrc} GROUP BY {mode})"""


GAUSS_JORDAN = """
nn AS (SELECT max(_1) + 1 AS n FROM amat),
ny AS (SELECT max(_1) + 1 AS k FROM cmat),
rows_ AS (SELECT unnest(range((SELECT n FROM nn))) AS r),
cols_ AS (SELECT unnest(range((SELECT n FROM nn) + (SELECT k FROM ny))) AS c),
aug AS (
  SELECT rows_.r, cols_.c, coalesce(a.product, ct.product, 0.0) AS v
  FROM rows_ CROSS JOIN cols_
  LEFT JOIN amat a ON a._1 = rows_.r AND a._2 = cols_.c
  LEFT JOIN cmat ct ON ct._2 = rows_.r AND ct._1 + (SELECT n FROM nn) = cols_.c),
gj(step, r, c, v) AS (
  SELECT 0, r, c, v FROM aug
  UNION ALL
  SELECT g.step + 1, g.r, g.c,
         CASE WHEN g.r = g.step THEN g.v / p.v ELSE g.v - f.v * pr.v / p.v END
  FROM gj g
  JOIN gj p ON p.step = g.step AND p.r = g.step AND p.c = g.step
  JOIN gj pr ON pr.step = g.step AND pr.r = g.step AND pr.c = g.c
  JOIN gj f ON f.step = g.step AND f.r = g.r AND f.c = g.step
  WHERE g.step < (SELECT n FROM nn)),
bsol AS (
  SELECT CAST(c - (SELECT n FROM nn) AS INTEGER) AS _1, CAST(r AS INTEGER) AS _2, v AS product
  FROM gj WHERE step = (SELECT n FROM nn) AND c >= (SELECT n FROM nn) AND v <> 0)"""

XB_E = affine_step("xr", "xb", "lag_weights", "lag", ["e", "lag", "d"], 0.0, "before").lstrip()
SYSTEM_E = ",".join([XB_E, normal_sql("xb", "e", ["lag", "d"], "yr", ["lag", "d"]).lstrip(),
                     cross_sql("xb", "e", ["lag", "d"], "yr").lstrip()])

Q["normal_equations"] = with_(REG_XY) + "," + SYSTEM_E + """
SELECT _1, _2, round(product, 4) AS product FROM amat"""
Q["cross_moments"] = with_(REG_XY) + "," + SYSTEM_E + """
SELECT _1, _2, round(product, 4) AS product FROM cmat"""
Q["ridge_solve"] = with_rec(REG_XY) + "," + SYSTEM_E + "," + GAUSS_JORDAN.lstrip() + """
SELECT _1, _2, round(product, 6) AS product FROM bsol"""
Q["ridge_solve_cg"] = with_rec(REG_XY) + "," + SYSTEM_E + "," + GAUSS_JORDAN.lstrip() + """
SELECT _1, _2, round(product, 4) AS product FROM bsol"""

XB_LAG = affine_step("xr", "xb", "fe", "e", ["e", "lag", "d"], 0.0, "before").lstrip()
SYSTEM_LAG = ",".join([XB_LAG, normal_sql("xb", "lag", ["e", "d"], "yr", ["e", "d"]).lstrip(),
                       cross_sql("xb", "lag", ["e", "d"], "yr").lstrip()])
Q["regression_step"] = with_rec(REG_XY) + "," + SYSTEM_LAG + "," + GAUSS_JORDAN.lstrip() + """
SELECT _1, _2, round(product, 6) AS product FROM bsol"""
Q["regression_step_matrix_free"] = Q["regression_step"]


def renewed(k: int, prior: str, mode: str, key: list[str]) -> str:
    """CTEs of the k-th update of an ALS fit: ``bsol{k}`` renews mode ``mode``'s factor from the projected X ``xb{k}`` built by ``prior``."""
    names = r"\b(xb|gx|sx|amat|cmat|nn|ny|rows_|cols_|aug|gj|bsol)\b"
    text = ",".join([normal_sql("xb", mode, key, "yr", key).lstrip(), cross_sql("xb", mode, key, "yr").lstrip(), GAUSS_JORDAN.lstrip()])
    return prior + "," + re.sub(names, rf"\g<1>{k}", text)


_MODES = ["e", "lag", "d"]
Q["tensor_regression_fit"] = with_rec(REG_XY) + "," + ",".join([
    renewed(1, affine_step("xr", "xb1", "lag_weights", "lag", _MODES, 0.0, "before").lstrip(), "e", ["lag", "d"]),
    renewed(2, affine_step("xr", "xb2", "bsol1", "e", _MODES, 0.0, "before").lstrip(), "lag", ["e", "d"]),
    renewed(3, affine_step("xr", "xb3", "bsol2", "lag", _MODES, 0.0, "before").lstrip(), "e", ["lag", "d"]),
    renewed(4, affine_step("xr", "xb4", "bsol3", "e", _MODES, 0.0, "before").lstrip(), "lag", ["e", "d"])]) + """
SELECT CAST(0 AS INTEGER) AS mode, _1, _2, round(product, 5) AS product FROM bsol3
UNION ALL SELECT CAST(1 AS INTEGER) AS mode, _1, _2, round(product, 5) AS product FROM bsol4"""
Q["mode_residual"] = with_(REG_XY) + "," + XB_LAG + """,
pp AS (SELECT x.e, w._1 AS lag, x.d, sum(x.product * w.product) AS product
       FROM xb x JOIN lag_weights w ON x.lag = w._2 - 1 AND w._2 > 0 GROUP BY 1, 2, 3),
pb AS (SELECT pp.e, pp.lag, pp.d, pp.product + b.product AS product
       FROM pp JOIN lag_weights b ON pp.lag = b._1 AND b._2 = 0)
SELECT y.e, y.lag, y.d, round(y.product - pb.product, 6) AS residual FROM yr y JOIN pb USING (e, lag, d)"""


def reg_grid(name: str, mode: str, seed: int) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT CAST(t AS INTEGER) AS _1, CAST(s AS INTEGER) AS _2, {lcg('t', 's', seed)} AS product
    FROM (SELECT unnest(range((SELECT max({mode}) + 1 FROM yr))) AS t),
         (SELECT unnest(range((SELECT max({mode}) + 2 FROM xr))) AS s))
  WHERE abs(product) > 1e-6)"""


Q["random_reg_factors"] = with_(REG_XY) + "," + reg_grid("r0", "e", 13).lstrip() + "," + \
    reg_grid("r1", "lag", 14).lstrip() + """
SELECT CAST(0 AS INTEGER) AS mode, * FROM r0 UNION ALL SELECT CAST(1 AS INTEGER) AS mode, * FROM r1"""

# Eigenvectors of a small symmetric matrix by cyclic Jacobi rotations.  The state is one row:
# the matrix and the product of the rotations as row-major lists of d * d numbers.
JACOBI_SWEEPS = 12


def jacobi(name: str, gram: str, d: str) -> str:
    """CTEs of the eigen decomposition of ``gram`` (_1, _2, product), d x d: ``{name}`` holds
    (k, j, lam, v), component k from the largest eigenvalue down, v its entry at index j."""
    mixed = lambda m: (f"[CASE WHEN k % d = p THEN c * {m}[k + 1] - s * {m}[k - p + q + 1] "      # noqa: E731
                       f"WHEN k % d = q THEN s * {m}[k - q + p + 1] + c * {m}[k + 1] ELSE {m}[k + 1] END FOR k IN range(d * d)]")
    rows = ("[CASE WHEN k // d = p THEN c * b[k + 1] - s * b[k + (q - p) * d + 1] "
            "WHEN k // d = q THEN s * b[k + (p - q) * d + 1] + c * b[k + 1] ELSE b[k + 1] END FOR k IN range(d * d)]")
    return f"""
{name}_d AS (SELECT CAST({d} AS BIGINT) AS d),
{name}_p AS (SELECT row_number() OVER (ORDER BY p, q) - 1 AS pair, p, q
  FROM (SELECT unnest(range((SELECT d FROM {name}_d))) AS p), (SELECT unnest(range((SELECT d FROM {name}_d))) AS q) WHERE p < q),
{name}_0 AS (SELECT list(coalesce(g.product, 0.0) ORDER BY a.i, b.j) AS a, list(CASE WHEN a.i = b.j THEN 1.0::DOUBLE ELSE 0.0 END ORDER BY a.i, b.j) AS v
  FROM (SELECT unnest(range((SELECT d FROM {name}_d))) AS i) a CROSS JOIN (SELECT unnest(range((SELECT d FROM {name}_d))) AS j) b
  LEFT JOIN {gram} g ON g._1 = a.i AND g._2 = b.j),
{name}_r(step, a, v) AS (
  SELECT CAST(0 AS BIGINT), a, v FROM {name}_0
  UNION ALL
  SELECT step + 1, {rows}, {mixed('v')} FROM (
    SELECT *, {mixed('a')} AS b FROM (
      SELECT *, t * c AS s FROM (
        SELECT *, 1 / sqrt(1 + t * t) AS c FROM (
          SELECT *, CASE WHEN apq = 0 THEN 0.0 ELSE (CASE WHEN tau < 0 THEN -1.0 ELSE 1.0 END) / (abs(tau) + sqrt(1 + tau * tau)) END AS t FROM (
            SELECT *, CASE WHEN apq = 0 THEN 0.0 ELSE (a[q * d + q + 1] - a[p * d + p + 1]) / (2 * apq) END AS tau FROM (
              SELECT r.step, r.a, r.v, x.p, x.q, dd.d, r.a[x.p * dd.d + x.q + 1] AS apq
              FROM {name}_r r JOIN {name}_d dd ON true
              JOIN {name}_p x ON x.pair = r.step % (dd.d * (dd.d - 1) // 2)
              WHERE r.step < {JACOBI_SWEEPS} * (dd.d * (dd.d - 1) // 2)))))))),
{name}_l AS (SELECT i, a[i * d + i + 1] AS lam, v, d,
    row_number() OVER (ORDER BY a[i * d + i + 1] DESC, i) - 1 AS k
  FROM (SELECT r.a, r.v, dd.d, unnest(range(dd.d)) AS i FROM {name}_r r JOIN {name}_d dd ON true
        WHERE r.step = {JACOBI_SWEEPS} * (dd.d * (dd.d - 1) // 2))),
{name} AS (SELECT k, j, lam, v[j * d + i + 1] AS v FROM (SELECT *, unnest(range(d)) AS j FROM {name}_l))"""


def svd_start(name: str, mode: str, key: list[str]) -> str:
    """CTEs of the SVD start of one mode: components until the rest is 1e-6 of the norm, |u| > 1e-3, bias rows."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in key)
    return f"""
{name}_g AS (SELECT a.{mode} AS _1, b.{mode} AS _2, sum(a.product * b.product) AS product
             FROM xr a JOIN xr b ON {on} GROUP BY 1, 2),""" + \
        jacobi(f"{name}_j", f"{name}_g", f"(SELECT max({mode}) + 1 FROM xr)").lstrip() + f""",
{name}_t AS (SELECT k, sum(lam) OVER (ORDER BY k DESC) AS rest, sum(lam) OVER () AS whole FROM (SELECT DISTINCT k, lam FROM {name}_j)),
{name} AS (
  SELECT CAST(j AS INTEGER) AS _1, CAST(k + 1 AS INTEGER) AS _2, abs(v) AS product FROM {name}_j JOIN {name}_t USING (k)
  WHERE rest > 1e-12 * whole AND abs(v) > 1e-3 AND j <= (SELECT max({mode}) FROM yr)
  UNION ALL SELECT CAST(unnest(range((SELECT max({mode}) + 1 FROM yr))) AS INTEGER), 0, 0.0)"""


Q["svd_init_factors"] = with_rec(REG_XY) + "," + ",".join([
    svd_start("s0", "e", ["lag", "d"]).lstrip(), svd_start("s1", "lag", ["e", "d"]).lstrip()]) + """
SELECT CAST(0 AS INTEGER) AS mode, _1, _2, round(product, 6) AS product FROM s0
UNION ALL SELECT CAST(1 AS INTEGER) AS mode, _1, _2, round(product, 6) AS product FROM s1"""


def hooi_update(name: str, mode: str, factors: dict[str, str], rank: int = 2) -> str:
    """CTEs of one HOOI update: T projected by the other modes' factors has few columns, so its left
    singular vectors come from the columns' small Gram: u = Y v / sigma, largest entry positive."""
    a, b = [m for m in ("cn", "sn", "m") if m != mode]
    return f"""
{name}_y AS (SELECT t.{mode} AS j, f._1 * {rank} + g._1 AS r, sum(t.product * f.product * g.product) AS y
  FROM trade t JOIN {factors[a]} f ON t.{a} = f._2 JOIN {factors[b]} g ON t.{b} = g._2 GROUP BY 1, 2),
{name}_g AS (SELECT a.r AS _1, b.r AS _2, sum(a.y * b.y) AS product FROM {name}_y a JOIN {name}_y b USING (j) GROUP BY 1, 2),""" + \
        jacobi(f"{name}_j", f"{name}_g", str(rank * rank)).lstrip() + f""",
{name}_u AS (SELECT e.k, y.j, sum(y.y * e.v) / sqrt(any_value(e.lam)) AS u
  FROM {name}_y y JOIN {name}_j e ON e.j = y.r WHERE e.k < {rank} GROUP BY 1, 2),
{name} AS (SELECT CAST(k AS INTEGER) AS _1, CAST(j AS INTEGER) AS _2,
  u * sign(first_value(u) OVER (PARTITION BY k ORDER BY abs(u) DESC)) AS product FROM {name}_u WHERE u <> 0)"""


def hooi_sql(sweeps: int, seed: int) -> str:
    now = {m: f"h0{m}" for m in ("cn", "sn", "m")}
    parts = [lcg_grid(now[m], "trade", m, 2, seed + i).lstrip() for i, m in enumerate(now)]
    for it in range(1, sweeps + 1):
        for m in now:
            parts.append(hooi_update(f"h{it}{m}", m, now).lstrip())
            now[m] = f"h{it}{m}"
    return with_rec(TRADE) + "," + ",".join(parts) + "\n" + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS mode, _1, _2, round(product, 6) AS product FROM {now[m]}" for i, m in enumerate(now))


Q["tucker_hooi"] = hooi_sql(2, 5)

# Rank-1 HOOI = alternating power method: step s renews the vector of mode
# s % 3 from the other two, normalises it and makes its largest entry positive.
HOPM_STEPS = 9
Q["hosvd_rank1"] = with_rec(TRADE) + "," + ",".join([
    lcg_grid("f1", "trade", "cn", 1, 9).lstrip(), lcg_grid("f2", "trade", "sn", 1, 10).lstrip(),
    lcg_grid("f3", "trade", "m", 1, 11).lstrip()]) + f""",
init AS (SELECT 0 AS mode, _2 AS idx, product AS v FROM f1
         UNION ALL SELECT 1, _2, product FROM f2
         UNION ALL SELECT 2, _2, product FROM f3),
hopm(step, mode, idx, v) AS (
  SELECT 0, mode, idx, v FROM init
  UNION ALL
  SELECT h.step + 1, h.mode, h.idx, CASE WHEN h.mode = h.step % 3 THEN n.v ELSE h.v END
  FROM hopm h
  LEFT JOIN (
    SELECT step, k, idx, y / sqrt(sum(y * y) OVER (PARTITION BY step))
                         * sign(first_value(y) OVER (PARTITION BY step ORDER BY abs(y) DESC, idx)) AS v
    FROM (
      SELECT a.step, a.step % 3 AS k,
             CASE a.step % 3 WHEN 0 THEN t.cn WHEN 1 THEN t.sn ELSE t.m END AS idx,
             sum(t.product * CASE a.step % 3 WHEN 0 THEN b.v * c.v WHEN 1 THEN a.v * c.v ELSE a.v * b.v END) AS y
      FROM trade t
      JOIN hopm a ON a.mode = 0 AND a.idx = t.cn
      JOIN hopm b ON b.mode = 1 AND b.idx = t.sn AND b.step = a.step
      JOIN hopm c ON c.mode = 2 AND c.idx = t.m AND c.step = a.step
      GROUP BY 1, 2, 3)) n
    ON n.step = h.step AND n.k = h.mode AND n.idx = h.idx
  WHERE h.step < {HOPM_STEPS} AND (h.mode <> h.step % 3 OR n.v IS NOT NULL))
SELECT CAST(mode AS INTEGER) AS mode, CAST(0 AS INTEGER) AS _1, CAST(idx AS INTEGER) AS _2, round(v, 6) AS product
FROM hopm WHERE step = {HOPM_STEPS} AND v <> 0"""

Q["index_roundtrip"] = with_(PARTS_CELLS) + """
SELECT p_brand, sum(product) AS product FROM parts_cells GROUP BY p_brand"""

Q["index_versions"] = """
WITH early AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01'),
late AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM early))
SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS id, CAST(0 AS INTEGER) AS version FROM early
UNION ALL
SELECT l_partkey, (SELECT count(*) FROM early) + row_number() OVER (ORDER BY l_partkey) - 1 AS id, CAST(1 AS INTEGER) AS version FROM late"""
