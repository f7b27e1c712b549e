"""DuckDB SQL for the queries of the study module."""

from __future__ import annotations

from .oracle import _EFFORT, _FOLDS, _QS, _SHARES, SQL, WORDS, salt

_ITEMS = """li AS (SELECT l_orderkey AS o, l_partkey % 4 AS t, CAST(floor(l_quantity) AS BIGINT) AS q, l_suppkey AS s,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem),
st AS (SELECT o, k, t, q % k AS i, s % k AS j FROM li)"""

# a statement is node 2k, the guard in front of it 2k + 1; only statements other than calls set a variable
_SLICES = f"""{_ITEMS}, mx AS (SELECT o, max(k) AS m, count(*) FILTER (WHERE t IN (1, 3)) AS n_all, count(*) FILTER (WHERE t = 3) AS n_mem FROM st GROUP BY 1),
ed AS (SELECT o, 2 * k AS a, 2 * k + 1 AS b, 'control' AS kind FROM st WHERE t = 2
  UNION ALL SELECT x.o, 2 * x.k, 2 * y.k, 'data' FROM st x JOIN st y ON y.o = x.o AND y.k = x.i AND y.t <> 3 WHERE x.t IN (1, 2, 3)
  UNION ALL SELECT x.o, CASE WHEN x.t = 2 THEN 2 * x.k + 1 ELSE 2 * x.k END, 2 * y.k, 'data' FROM st x JOIN st y ON y.o = x.o AND y.k = x.j AND y.t <> 3),
sd AS (SELECT w, o, 2 * k AS n FROM st JOIN mx USING (o), (VALUES ('all'), ('data')) v(w) WHERE CASE WHEN n_all > 0 THEN t IN (1, 3) ELSE k = m END
  UNION ALL SELECT 'memory', o, 2 * k FROM st JOIN mx USING (o) WHERE CASE WHEN n_mem > 0 THEN t = 3 ELSE k = m END),
wk AS (SELECT w, o, n, 0 AS d FROM sd UNION SELECT wk.w, wk.o, ed.b, d + 1 FROM wk JOIN ed ON ed.o = wk.o AND ed.a = wk.n AND (ed.kind = 'data' OR wk.w <> 'data')),
rs AS (SELECT w, o, n, min(d) AS d FROM wk GROUP BY 1, 2, 3),
sl AS (SELECT w, o, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS lines, count(*) AS c FROM (SELECT DISTINCT w, o, n // 2 + 2 AS line FROM rs) GROUP BY 1, 2),
dp AS (SELECT o, max(d) AS depth FROM rs WHERE w = 'all' GROUP BY 1),
sk AS (SELECT o, string_agg(CAST(k + 2 AS VARCHAR), ',' ORDER BY k) AS sinks FROM st WHERE t IN (1, 3) GROUP BY 1),
fn AS (SELECT o AS id, m + 3 AS n_lines, coalesce(sinks, '') AS sinks, a.lines AS slice, b.lines AS data_slice, c.lines AS memory_slice, a.c AS n_all_lines, b.c AS n_data, c.c AS n_mem_lines,
  CASE WHEN n_all > 0 THEN 'matched' ELSE 'fallback' END AS status, CASE WHEN n_mem > 0 THEN 'matched' ELSE 'fallback' END AS memory_status, CAST(depth AS BIGINT) AS depth
  FROM mx JOIN dp USING (o) LEFT JOIN sk USING (o) JOIN sl a USING (o) JOIN sl b USING (o) JOIN sl c USING (o) WHERE a.w = 'all' AND b.w = 'data' AND c.w = 'memory')"""

SQL["c_slice_table"] = f"WITH RECURSIVE {_SLICES} SELECT id, n_lines, sinks, slice, data_slice, memory_slice, status, memory_status, depth FROM fn"
SQL["c_slice_summary"] = f"""WITH RECURSIVE {_SLICES} SELECT n_lines, count(*) AS n, round(avg(n_all_lines / n_lines), 6) AS rsr, round(avg(n_data / n_lines), 6) AS data_rsr, round(avg(n_mem_lines / n_lines), 6) AS memory_rsr,
  round(avg(depth), 6) AS mean_depth, round(avg(CAST(status = 'fallback' AS DOUBLE)), 6) AS fallback, round(avg(CAST(memory_status = 'fallback' AS DOUBLE)), 6) AS memory_fallback FROM fn GROUP BY 1"""
SQL["reference_graph_slice"] = f"""WITH RECURSIVE {_ITEMS}, ed AS (SELECT o, k AS a, i AS b FROM st WHERE i > 0 UNION SELECT o, k, j FROM st WHERE j > 0),
wk AS (SELECT o, k AS n FROM st WHERE t = 3 UNION SELECT wk.o, b FROM wk JOIN ed ON ed.o = wk.o AND ed.a = wk.n)
SELECT o AS grp, count(*) AS n, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS lines FROM wk JOIN st ON st.o = wk.o AND st.k = wk.n WHERE t <> 2 GROUP BY 1""".replace("SELECT o AS grp", "SELECT wk.o AS grp")

SQL["tfidf_train_fit"] = f"""
WITH lb AS (SELECT doc_id, 1 - quality AS label FROM labels),
ds AS (SELECT * FROM (SELECT * FROM lb WHERE label = 1 ORDER BY md5('sample' || doc_id), doc_id LIMIT 100) UNION ALL SELECT * FROM (SELECT * FROM lb WHERE label = 0 ORDER BY md5('sample' || doc_id), doc_id LIMIT 400)),
rf AS (SELECT repeat, doc_id, (row_number() OVER (PARTITION BY repeat, label ORDER BY md5('fold' || repeat || '/' || doc_id), doc_id) - 1) % 5 AS fold FROM ds, range(2) z(repeat)),
a AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM ds)),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS tok FROM a), tf AS (SELECT doc_id, tok, count(*) AS tf FROM g GROUP BY 1, 2),
m AS (SELECT r.repeat, f.fold, r.doc_id, r.fold = f.fold AS test FROM rf r, (SELECT DISTINCT fold FROM rf) f),
t AS (SELECT repeat, fold, doc_id, test, tok, tf FROM tf JOIN m USING (doc_id)),
ft AS (SELECT repeat, fold, tok, sum(tf) AS total, count(*) AS df FROM t WHERE NOT test GROUP BY 1, 2, 3),
v AS (SELECT *, row_number() OVER (PARTITION BY repeat, fold ORDER BY total DESC, tok) AS k FROM ft QUALIFY k <= 2000),
n AS (SELECT repeat, fold, count(*) AS n FROM m WHERE NOT test GROUP BY 1, 2),
w AS (SELECT repeat, fold, doc_id, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM t JOIN v USING (repeat, fold, tok) JOIN n USING (repeat, fold) WHERE test),
l AS (SELECT repeat, fold, doc_id, w / sqrt(sum(w * w) OVER (PARTITION BY repeat, fold, doc_id)) AS w FROM w)
SELECT m.repeat, m.fold, count(w) AS n_terms, count(DISTINCT m.doc_id) AS n_docs, round(sum(w), 4) AS total, round(max(w), 6) AS top FROM m LEFT JOIN l USING (repeat, fold, doc_id) WHERE test GROUP BY 1, 2"""

# the distribution of Student's t with v degrees of freedom as a finite sum, for odd and even v
_T = """th AS (SELECT *, atan(abs(t) / sqrt(v)) AS a FROM tv),
sm AS (SELECT th.*, CASE WHEN v % 2 = 1 THEN 2 / pi() * (a + CASE WHEN v > 1 THEN sin(a) * (SELECT sum(exp(0.5 * ln(pi()) - ln(2) + lgamma(k + 1) - lgamma(k + 1.5)) * power(cos(a), 2 * k + 1)) FROM range(CAST((v - 1) / 2 AS BIGINT)) z(k)) ELSE 0 END)
  ELSE sin(a) * (SELECT sum(exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi())) * power(cos(a), 2 * k)) FROM range(CAST(v / 2 AS BIGINT)) z(k)) END AS inside FROM th)"""
SQL["spearman_p"] = f"""WITH {_SHARES}, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM sh),
rh AS (SELECT count(*) AS n, corr(ra, rb) AS rho FROM r), tv AS (SELECT n, rho, n - 2 AS v, rho * sqrt((n - 2) / (1 - rho * rho)) AS t FROM rh), {_T}
SELECT n, round(rho, 6) AS rho, round(1 - inside, 6) AS p FROM sm"""
SQL["corrected_t_p"] = f"""WITH {_FOLDS}, tv AS (SELECT count(*) AS j, count(*) - 1 AS v, avg(a - b) / sqrt((1 / count(*) + 0.25) * nullif(var_samp(a - b), 0)) AS t FROM fm), {_T}
SELECT j, round(t, 6) AS t, round(1 - inside, 6) AS p FROM sm"""
SQL["mcnemar_p"] = """WITH j AS (SELECT source, (length(text) > 1500) = (quality = 1) AS a, (NOT regexp_matches(text, '[0-9]')) = (quality = 1) AS b FROM documents JOIN labels USING (doc_id)),
c AS (SELECT source, count(*) FILTER (WHERE a AND NOT b) AS n10, count(*) FILTER (WHERE NOT a AND b) AS n01 FROM j GROUP BY 1)
SELECT source, n10, n01, round(least(1, 2 * (SELECT sum(exp(lgamma(n10 + n01 + 1) - lgamma(k + 1) - lgamma(n10 + n01 - k + 1) - (n10 + n01) * ln(2))) FROM range(least(n10, n01) + 1) z(k))) + 1e-9, 6) AS p FROM c"""

SQL["bootstrap_mean_ci_linear"] = f"""WITH g AS (SELECT source, round(avg(n_chars), 3) AS v, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM documents GROUP BY 1),
d AS (SELECT r, {salt("'boot' || r || '/' || i")} % n AS hit FROM g, range(1000) z(r)), m AS (SELECT r, avg(v) AS m FROM d JOIN g ON g.i = d.hit GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 6) AS lo, round(quantile_cont(m, 0.975), 6) AS hi FROM m"""

SQL["random_effort_cdf"] = f"""WITH RECURSIVE {_EFFORT}, nd AS (SELECT n_lines AS n, d, count(*) AS c FROM e WHERE kind = 'top_down' GROUP BY 1, 2),
pr AS (SELECT n, d, c, 0 AS k, 1.0::DOUBLE AS p FROM nd UNION ALL SELECT n, d, c, k + 1, CASE WHEN k >= n THEN p ELSE p * greatest(0, n - d - k) / (n - k) END FROM pr WHERE k < 30)
SELECT CAST(k AS BIGINT) AS k, round(sum(c * (1 - p)) / sum(c), 6) AS share FROM pr GROUP BY 1"""

_CUT = """SELECT '{grid}' AS grid, round(t, 6) AS threshold, round(f1, 6) AS f1 FROM (
  SELECT t, coalesce(2 * count(*) FILTER (WHERE score >= t AND actual) / nullif(count(*) FILTER (WHERE score >= t) + count(*) FILTER (WHERE actual), 0), 0) AS f1 FROM qs, ({cuts}) c(t) GROUP BY t ORDER BY f1 DESC, t LIMIT 1)"""
_GRID = "SELECT DISTINCT CASE WHEN nv > {most} THEN q ELSE s END FROM (SELECT count(DISTINCT score) AS nv, quantile_cont(score, list_transform(range({count}), lambda i: {low} + ({high} - {low}) * i / {last})) AS qs FROM qs) z, (SELECT unnest(z.qs) AS q) u, (SELECT DISTINCT score AS s FROM qs) v"
SQL["best_f1_grids"] = f"WITH {_QS} " + " UNION ALL ".join([
    _CUT.format(grid="all_256", cuts=_GRID.format(most=256, count=256, last=255, low=0.0, high=1.0)),
    _CUT.format(grid="inner_200", cuts=_GRID.format(most=200, count=200, last=199, low=0.01, high=0.99)),
    _CUT.format(grid="rounded_3", cuts="SELECT DISTINCT round(score, 3) FROM qs"),
])

SQL["pair_order"] = "SELECT conv_id, turn, row_number() OVER (ORDER BY role, conv_id, turn) - 1 AS place FROM conversations"
SQL["xml_paths"] = """SELECT CAST(n_regionkey AS BIGINT) AS region, string_agg(n_name, ',' ORDER BY n_nationkey) AS names, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS key_sum, bool_or(n_nationkey = 0) AS has_first FROM nation GROUP BY 1"""
SQL["xml_code_features"] = f"""WITH {_ITEMS}, f AS (SELECT o, k + 2 AS line, unnest(CASE t WHEN 0 THEN ['op:='] WHEN 1 THEN ['op:=', 'op:+'] WHEN 2 THEN ['ctrl:if', 'op:>', 'lit:number', 'op:='] ELSE ['call', 'callee:memcpy', 'lit:number'] END) AS feat FROM st
  UNION ALL SELECT DISTINCT o, -1, 'type:int' FROM st)
SELECT feat, count(*) AS n, count(DISTINCT o) AS n_functions, CAST(sum(line) AS BIGINT) AS lines FROM f GROUP BY 1"""
SQL["frozen_embeddings"] = """WITH a AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^ \\t\\n\\r\\f\\v]+')[1:512] AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS w FROM a),
e AS (SELECT doc_id, """ + ", ".join(f"avg(CAST('0x' || substr(md5(w), {1 + 2 * i}, 2) AS INTEGER) / 255) AS e{i}" for i in range(4)) + """ FROM t GROUP BY 1)
SELECT doc_id, """ + ", ".join(f"round(coalesce(e{i}, 0), 6) AS e{i}" for i in range(4)) + """ FROM a LEFT JOIN e USING (doc_id)"""
