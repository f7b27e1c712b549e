"""DuckDB SQL for the queries of the catalogue: the same results from the same tables."""

from __future__ import annotations

LINES = """
p0 AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
p1 AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS p FROM p0),
ln AS (SELECT doc_id, CAST(unnest(range(len(p))) AS BIGINT) AS line_idx, unnest(p) AS line FROM p1)"""

PAIRS = f"""{LINES},
ll AS (SELECT DISTINCT doc_id, line FROM ln WHERE length(line) > 20),
nx AS (SELECT doc_id AS x, lead(doc_id) OVER (PARTITION BY line ORDER BY doc_id) AS y FROM ll),
nn AS (SELECT x, y FROM nx WHERE y IS NOT NULL GROUP BY x, y HAVING count(*) >= 2),
cp AS (SELECT x, min(y) AS y FROM nn JOIN documents da ON da.doc_id = x JOIN documents db ON db.doc_id = y WHERE da.text <> db.text GROUP BY x)"""

DELETED = f"""{PAIRS},
dl AS (SELECT l.doc_id, l.line_idx FROM ln l JOIN cp ON l.doc_id = cp.x
       WHERE NOT EXISTS (SELECT 1 FROM ln b WHERE b.doc_id = cp.y AND b.line = l.line))"""

ALL_SINK, SPARSE_SINK = "contains(line, ',')", "regexp_matches(line, '[0-9]')"


def mention(name: str, crit: str) -> str:
    return f"""
{name}_t AS (SELECT DISTINCT doc_id, line_idx, {crit} AS crit, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) AS tok FROM ln),
{name}_s AS (SELECT DISTINCT doc_id, tok FROM {name}_t WHERE crit AND length(tok) >= 2),
{name} AS (SELECT DISTINCT t.doc_id, t.line_idx FROM {name}_t t JOIN {name}_s s ON s.doc_id = t.doc_id AND s.tok = t.tok)"""


def measures(name: str, region: str) -> str:
    return f"""
{name}_n AS (SELECT doc_id, count(*) AS n FROM ln GROUP BY 1),
{name}_r AS (SELECT doc_id, count(*) AS r FROM {region} GROUP BY 1),
{name}_d AS (SELECT dl.doc_id, count(*) AS d, count(m.line_idx) AS hit FROM dl LEFT JOIN {region} m ON m.doc_id = dl.doc_id AND m.line_idx = dl.line_idx GROUP BY 1),
{name} AS (SELECT d.doc_id, n, d, hit, coalesce(r, 0) AS r, hit / d AS cov, coalesce(r, 0) / n AS rsr
           FROM {name}_d d JOIN {name}_n USING (doc_id) LEFT JOIN {name}_r USING (doc_id))"""


def near(name: str, crit: str, source: str = "ln") -> str:
    """Distance of every line to the nearest sink."""
    return f"""
{name}_w AS (SELECT doc_id, line_idx, line, count(*) OVER (PARTITION BY doc_id) AS n_lines,
    line_idx - max(CASE WHEN {crit} THEN line_idx END) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS back,
    min(CASE WHEN {crit} THEN line_idx END) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - line_idx AS ahead FROM {source}),
{name} AS (SELECT doc_id, line_idx, line, n_lines, coalesce(least(back, ahead), n_lines) AS dist FROM {name}_w)"""


WORDS = "regexp_extract_all(lower(text), '[a-z0-9_]{2,}')"
CODE = r"regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]')"


def salt(expr: str) -> str:
    return f"CAST('0x' || substr(md5({expr}), 1, 8) AS BIGINT)"


SQL: dict[str, str] = {}

SQL["label_coercion_partition"] = """
SELECT coalesce(nullif(lang, ''), nullif(source, ''), 'unlabeled') AS grp,
  count(*) FILTER (WHERE CAST(toxic AS VARCHAR) IN ('1', '1.0')) AS n_pos, count(*) FILTER (WHERE CAST(toxic AS VARCHAR) IN ('1', 'True', 'true')) AS n_pos_text,
  count(*) FILTER (WHERE CAST(toxic AS VARCHAR) IN ('0', '0.0')) AS n_neg, count(*) FILTER (WHERE toxic IS NULL OR CAST(toxic AS VARCHAR) NOT IN ('1', '1.0')) AS n_not_pos, count(*) FILTER (WHERE toxic IS NULL) AS n_null
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"""

SQL["qualify_pairs_prefix"] = f"""
WITH {PAIRS} SELECT x, y, length(a.text) AS n_before, length(b.text) AS n_after FROM cp JOIN documents a ON a.doc_id = x JOIN documents b ON b.doc_id = y JOIN labels l ON l.doc_id = x
WHERE l.quality = 1 AND regexp_matches(b.text, '\\S') AND a.text <> b.text ORDER BY x LIMIT 40"""

SQL["skip_accounting"] = f"""
WITH {DELETED} SELECT CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty' WHEN x IS NULL THEN 'no_pair' WHEN k.doc_id IS NULL THEN 'insertion_only' ELSE 'used' END AS reason, count(*) AS n
FROM documents d LEFT JOIN cp ON cp.x = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM dl) k ON k.doc_id = d.doc_id GROUP BY 1"""

SQL["pair_by_key_text_differs"] = """
WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS nxt FROM conversations),
k AS (SELECT sha1(text || chr(0) || nxt) AS pair_key, conv_id, turn FROM p WHERE text <> nxt)
SELECT pair_key, min({'c': conv_id, 't': turn}).c AS conv_id, min({'c': conv_id, 't': turn}).t AS turn, count(*) AS n FROM k GROUP BY 1"""

SQL["fingerprint_sha"] = "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1"

_MARKERS = "('code', 1, 'funcbefore'), ('code', 1, 'funcafter'), ('code', 1, 'vul'), ('text', 2, 'text'), ('text', 2, 'sentence'), ('text', 2, 'lang'), ('text', 2, 'html'), ('vector', 3, 'embedding'), ('image', 4, 'image'), ('image', 4, 'pixels'), ('tabular', 5, 'label'), ('tabular', 5, 'quality'), ('tabular', 5, 'cacctbal')"
_NEEDS = "('code', 'before', 'funcbefore'), ('code', 'label', 'vul'), ('text', 'text', 'text'), ('text', 'id', 'docid'), ('text', 'id', 'itemid'), ('text', 'order', 'turn'), ('text', 'order', 'docid'), ('vector', 'id', 'vecid'), ('vector', 'vector', 'embedding'), ('vector', 'group', 'group'), ('tabular', 'label', 'quality'), ('tabular', 'label', 'cmktsegment'), ('tabular', 'split', 'split')"
SQL["schema_gate_modality"] = f"""
WITH h AS (SELECT DISTINCT table_name AS dataset, regexp_replace(lower(column_name), '[^a-z0-9]', '', 'g') AS c FROM information_schema.columns WHERE table_name IN ('customer', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations', 'events')),
m AS (SELECT * FROM (VALUES {_MARKERS}) v(modality, prio, marker)), r AS (SELECT * FROM (VALUES {_NEEDS}) v(modality, need, alias)),
t AS (SELECT dataset, modality, prio, count(*) AS hits FROM h JOIN m ON marker = c GROUP BY 1, 2, 3),
b AS (SELECT dataset, modality, hits FROM t QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY hits DESC, prio) = 1),
l AS (SELECT dataset, string_agg(need, ',' ORDER BY need) AS missing FROM (SELECT DISTINCT b.dataset, r.need FROM b JOIN r USING (modality)) n WHERE NOT EXISTS (SELECT 1 FROM b JOIN r USING (modality) JOIN h ON h.dataset = b.dataset AND h.c = r.alias WHERE b.dataset = n.dataset AND r.need = n.need) GROUP BY 1)
SELECT d.dataset, coalesce(modality, 'unknown') AS modality, coalesce(hits, 0) AS hits, coalesce(missing, '') AS missing FROM (SELECT DISTINCT dataset FROM h) d LEFT JOIN b USING (dataset) LEFT JOIN l USING (dataset)"""

SQL["manifest_resolution"] = "SELECT regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS key, count(*) AS n, min(p_partkey) AS first_part, min(p_brand) AS brand FROM part GROUP BY 1"

SQL["regex_taxonomy_lines"] = f"""
WITH {LINES}, k AS (SELECT CASE WHEN NOT regexp_matches(line, '\\S') THEN 'blank' WHEN regexp_matches(line, 'licen[cs]e', 'i') THEN 'license' WHEN regexp_matches(line, '[0-9]') THEN 'digits'
  WHEN contains(line, '|') THEN 'table' WHEN contains(line, ',') THEN 'clauses' ELSE 'plain' END AS kind FROM ln)
SELECT kind, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM k GROUP BY 1"""

SQL["extract_ids_sorted"] = """
WITH x AS (SELECT page_id, list_sort(list_distinct(list_transform(regexp_extract_all(html, '(?i)[a-z]+\\.example\\.(?:com|net|org)'), lambda v: upper(v)))) AS ids FROM pages)
SELECT page_id, array_to_string(ids, ',') AS ids, CAST(len(ids) AS BIGINT) AS n FROM x"""

SQL["line_explode_stats"] = f"""
WITH {LINES}, d AS (SELECT lang, len(p) AS n FROM p1 JOIN documents USING (doc_id))
SELECT lang, count(*) AS n_docs, round(avg(n), 6) AS mean_lines, round(quantile_cont(n, 0.25), 6) AS p25, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75, round(avg(CAST(n >= 10 AS DOUBLE)) * 100, 6) AS pct10 FROM d GROUP BY 1"""

SQL["ident_sets_per_line"] = f"""
WITH {LINES}, k AS (SELECT doc_id, line_idx, list_sort(list_filter(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')), lambda v: v NOT IN ('the', 'of', 'and', 'to', 'in', 'a', 'is'))) AS ids FROM ln)
SELECT doc_id, line_idx, CAST(len(ids) AS BIGINT) AS n, md5(array_to_string(ids, ' ')) AS idents FROM k"""

SQL["lexer_token_counts"] = f"""
WITH t AS (SELECT lang, unnest({CODE}) AS tok FROM documents)
SELECT lang, CASE WHEN regexp_matches(tok, '^[A-Za-z_]') THEN 'word' WHEN regexp_matches(tok, '^[0-9]') THEN 'number' ELSE 'sign' END AS kind, count(*) AS n, count(DISTINCT tok) AS n_distinct FROM t GROUP BY 1, 2"""

SQL["vocab_topk_oov"] = f"""
WITH a AS (SELECT doc_id AS doc, {CODE} AS t FROM documents), t AS (SELECT doc, unnest(range(len(t))) AS pos, unnest(t) AS tok, {salt("'oov' || doc")} % 5 = 0 AS test FROM a),
c AS (SELECT tok, count(*) AS n, min({{'d': doc, 'p': pos}}) AS f FROM t WHERE NOT test GROUP BY 1),
v AS (SELECT tok, row_number() OVER (ORDER BY n DESC, f) AS rank FROM c ORDER BY n DESC, f LIMIT 500),
j AS (SELECT doc, pos, rank FROM t LEFT JOIN v USING (tok) WHERE test)
SELECT doc AS doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE rank IS NULL) AS n_oov,
  array_to_string(list_resize(list(CAST(coalesce(rank + 1, 1) AS VARCHAR) ORDER BY pos)[1:16], 16, '0'), ' ') AS ids FROM j GROUP BY 1"""

SQL["ngram_counts"] = f"""
WITH a AS (SELECT {WORDS} AS w FROM documents), g AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS gram FROM a)
SELECT gram, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, gram LIMIT 50"""

SQL["feature_bag_counts"] = """
WITH t AS (SELECT role, unnest(list_filter(string_split(coalesce(nullif(text, ''), 'EMPTYFEAT'), ' '), lambda v: v <> '')) AS feat FROM conversations)
SELECT role, count(*) AS n, count(DISTINCT feat) AS n_distinct FROM t GROUP BY 1"""

SQL["first_appearance_ids"] = """
WITH a AS (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*') AS t FROM conversations), t AS (SELECT conv_id, turn, unnest(range(len(t))) AS pos, unnest(t) AS tok FROM a),
f AS (SELECT *, min(pos) OVER (PARTITION BY conv_id, turn, tok) AS first FROM t), n AS (SELECT *, 'VAR' || dense_rank() OVER (PARTITION BY conv_id, turn ORDER BY first) AS name FROM f)
SELECT conv_id, turn, string_agg(name, ' ' ORDER BY pos) AS normalized, count(DISTINCT name) AS n_names FROM n GROUP BY 1, 2"""

SQL["markup_feature_sets"] = """
WITH a AS (SELECT page_id, string_split(html, '<') AS p FROM pages), l AS (SELECT page_id, unnest(range(len(p))) AS line, unnest(p) AS part FROM a),
f AS (SELECT page_id, line, unnest(list_concat(CASE WHEN regexp_extract(part, '^([a-zA-Z][a-zA-Z0-9]*)', 1) <> '' THEN ['tag:' || regexp_extract(part, '^([a-zA-Z][a-zA-Z0-9]*)', 1)] ELSE [] END,
  list_transform(regexp_extract_all(part, '\\s([a-z]+)=', 1), lambda v: 'attr:' || v))) AS feat FROM l)
SELECT page_id, array_to_string(list_sort(list(DISTINCT feat)), ' ') AS feats, count(*) AS n, count(*) FILTER (WHERE line BETWEEN 1 AND 10) AS n_head FROM f GROUP BY 1"""

SQL["multiset_line_diff"] = f"""
WITH {PAIRS}, c AS (SELECT doc_id, line, count(*) AS n FROM ln GROUP BY 1, 2),
u AS (SELECT x, y, line, n AS nb, 0 AS na FROM cp JOIN c ON c.doc_id = x UNION ALL SELECT x, y, line, 0, n FROM cp JOIN c ON c.doc_id = y),
g AS (SELECT x, y, line, sum(nb) AS nb, sum(na) AS na FROM u GROUP BY 1, 2, 3 HAVING sum(nb) <> sum(na))
SELECT x, y, CAST(sum(greatest(0, nb - na)) AS BIGINT) AS n_deleted, CAST(sum(greatest(0, na - nb)) AS BIGINT) AS n_added, count(*) AS n_lines FROM g GROUP BY 1, 2"""

_coverage = """SELECT '{tier}' AS tier, CASE WHEN d <= 1 THEN '1' WHEN d <= 5 THEN '2-5' ELSE '>5' END AS stratum, count(*) AS n, round(avg(cov), 6) AS mean_cov, round(quantile_cont(cov, 0.5), 6) AS median_cov,
  round(avg(rsr), 6) AS mean_rsr, round(avg(cov) / nullif(avg(rsr), 0), 6) AS concentration, count(*) FILTER (WHERE r > 0) AS n_region FROM {m} GROUP BY 2"""
SQL["region_mention_coverage"] = f"WITH {DELETED},{mention('ma', ALL_SINK)},{mention('ms', SPARSE_SINK)},{measures('xa', 'ma')},{measures('xs', 'ms')} " + _coverage.format(tier="all", m="xa") + " UNION ALL " + _coverage.format(tier="sparse", m="xs")

SQL["region_sink_window_calibrated"] = f"""
WITH {LINES},{mention('ms', SPARSE_SINK)}, tg AS (SELECT doc_id, count(*) AS target FROM ms GROUP BY 1),{near('ns', ALL_SINK)},
c AS (SELECT doc_id, n_lines, greatest(dist, 1) AS k, count(*) AS c FROM ns WHERE dist < n_lines GROUP BY 1, 2, 3),
w AS (SELECT doc_id, n_lines, k, CAST(sum(c) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS BIGINT) AS win_size FROM c)
SELECT doc_id, n_lines, target, min(k) AS k, min_by(win_size, k) AS win_size FROM w JOIN tg USING (doc_id) WHERE win_size >= target GROUP BY 1, 2, 3"""

SQL["region_unit_mapping"] = f"""
WITH {LINES},{near('ns', SPARSE_SINK)}, u AS (SELECT DISTINCT doc_id, line_idx // 5 AS unit FROM ns WHERE dist <= 1 AND dist < n_lines)
SELECT doc_id, count(*) AS n_units, CAST(sum(unit) AS BIGINT) AS unit_sum FROM u GROUP BY 1"""

SQL["region_tail_random_expect"] = f"""
WITH {DELETED},{mention('ma', ALL_SINK)},{measures('xa', 'ma')},
j AS (SELECT dl.doc_id, line_idx AS i, n, d, r AS k FROM dl JOIN xa USING (doc_id) WHERE r > 0)
SELECT doc_id, k, round(count(*) FILTER (WHERE i >= n - k) / d, 6) AS tail_cov, round(k / n, 6) AS random_cov,
  round(sum(least(i, n - k) - greatest(0, i - k + 1) + 1) / ((n - k + 1) * d), 6) AS window_cov FROM j GROUP BY doc_id, n, d, k"""

SQL["random_lines_draws"] = f"""
WITH {DELETED},{mention('ma', ALL_SINK)},{measures('xa', 'ma')},
t AS (SELECT ln.doc_id, ln.line_idx, d, r AS k, draw, row_number() OVER (PARTITION BY ln.doc_id, draw ORDER BY md5(ln.doc_id || '/' || draw || '/' || ln.line_idx)) AS rn
      FROM ln JOIN xa USING (doc_id), range(20) z(draw) WHERE r > 0),
h AS (SELECT t.doc_id, draw, d, count(dl.line_idx) AS c FROM t LEFT JOIN dl ON dl.doc_id = t.doc_id AND dl.line_idx = t.line_idx WHERE rn <= k GROUP BY 1, 2, 3)
SELECT doc_id, round(avg(c / d), 6) AS mean_cov, round(avg(CAST(c > 0 AS DOUBLE)), 6) AS hit_share FROM h GROUP BY 1"""

SQL["region_set_algebra"] = f"""
WITH {LINES},{mention('ms', SPARSE_SINK)},{near('ns', SPARSE_SINK)},
a AS (SELECT doc_id, list_sort(list(line_idx)) AS a FROM ms GROUP BY 1), b AS (SELECT doc_id, list_sort(list(line_idx)) AS b FROM ns WHERE dist <= 2 AND dist < n_lines GROUP BY 1),
j AS (SELECT doc_id, a, coalesce(b, []) AS b, p, len(list_intersect(a, coalesce(b, []))) AS x FROM a LEFT JOIN b USING (doc_id) JOIN p1 USING (doc_id))
SELECT doc_id, CAST(x AS BIGINT) AS n_chop, CAST(len(a) + len(b) - x AS BIGINT) AS n_union, CAST(len(a) - x AS BIGINT) AS n_only_a, round(x / len(a), 6) AS prec, round(coalesce(x / nullif(len(b), 0), 0), 6) AS rec,
  round(x / (len(a) + len(b) - x), 6) AS jac, md5(array_to_string(list_transform(a, lambda i: p[i + 1]), chr(10))) AS text_md5 FROM j"""

SQL["text_scan_region"] = f"""
WITH {DELETED}, ad AS (SELECT DISTINCT cp.x AS doc_id, l.line FROM ln l JOIN cp ON l.doc_id = cp.y WHERE NOT EXISTS (SELECT 1 FROM ln b WHERE b.doc_id = cp.x AND b.line = l.line)),
ch AS (SELECT doc_id, line FROM ad UNION ALL SELECT doc_id, line FROM dl JOIN ln USING (doc_id, line_idx)),
ct AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) AS tok FROM ch),
al AS (SELECT DISTINCT ln.doc_id, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) AS tok FROM ln WHERE ln.doc_id IN (SELECT x FROM cp) AND ln.doc_id NOT IN (SELECT doc_id FROM ct)),
ft AS (SELECT * FROM ct UNION ALL SELECT * FROM al), lt AS (SELECT DISTINCT ln.doc_id, line_idx, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) AS tok FROM ln JOIN cp ON cp.x = ln.doc_id),
rg AS (SELECT doc_id, count(DISTINCT line_idx) AS r FROM lt JOIN ft USING (doc_id, tok) GROUP BY 1), nn2 AS (SELECT ln.doc_id, count(*) AS n FROM ln JOIN cp ON cp.x = ln.doc_id GROUP BY 1)
SELECT doc_id, coalesce(r, 0) AS r, round(coalesce(r, 0) / n, 6) AS rsr FROM nn2 LEFT JOIN rg USING (doc_id)"""

SQL["trivial_baselines"] = """
WITH g AS (SELECT lang, count(*) FILTER (WHERE quality = 1) AS pos, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT lang, pos, n, round(2 * (pos / n) / (1 + pos / n), 6) AS always, round((pos / n) / (pos / n + 0.5), 6) AS coin FROM g"""

SQL["closure_depth_strata"] = """
WITH RECURSIVE s AS (SELECT n_nationkey AS src, unnest([(n_nationkey * 2) % 25, (n_nationkey * 3 + 1) % 25]) AS dst FROM nation WHERE n_nationkey % 3 <> 2),
w AS (SELECT n_regionkey AS grp, n_nationkey AS node, 0 AS depth FROM nation WHERE n_nationkey % 5 = n_regionkey
      UNION SELECT grp, dst, depth + 1 FROM w JOIN s ON s.src = w.node WHERE depth < 30),
m AS (SELECT grp, node, min(depth) AS depth FROM w GROUP BY 1, 2)
SELECT CAST(r_regionkey AS BIGINT) AS grp, CASE WHEN depth IS NULL THEN 'outside' WHEN depth >= 3 THEN '>=3' ELSE CAST(depth AS VARCHAR) END AS stratum, count(*) AS n
FROM region, nation LEFT JOIN m ON m.grp = r_regionkey AND m.node = n_nationkey GROUP BY 1, 2"""

SQL["textual_reaching_definitions"] = """
WITH c AS (SELECT DISTINCT conv_id, turn, role, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS tok FROM conversations),
j AS (SELECT u.conv_id, u.tok, u.turn AS at_, d.turn AS def_, count(*) FILTER (WHERE d.turn <= u.turn) OVER (PARTITION BY u.conv_id, u.tok, u.turn) AS nb
      FROM c u JOIN c d ON d.conv_id = u.conv_id AND d.tok = u.tok WHERE u.role = 'user' AND d.role <> 'user')
SELECT conv_id, count(*) AS n_edges, count(*) FILTER (WHERE nb = 0) AS n_fallback FROM j WHERE def_ <= at_ OR nb = 0 GROUP BY 1"""

_EFFORT = f"""{DELETED}, ow AS (SELECT ln.* FROM ln JOIN cp ON cp.x = ln.doc_id),{mention('ms', SPARSE_SINK)},{near('ns', SPARSE_SINK, 'ow')},
q AS (SELECT ns.doc_id, ns.line_idx, dist, n_lines, m.line_idx IS NOT NULL AS inr FROM ns LEFT JOIN ms m ON m.doc_id = ns.doc_id AND m.line_idx = ns.line_idx),
o AS (SELECT 'top_down' AS kind, *, row_number() OVER (PARTITION BY doc_id ORDER BY line_idx) - 1 AS pos FROM q
  UNION ALL SELECT 'region_first', *, row_number() OVER (PARTITION BY doc_id ORDER BY inr DESC, line_idx) - 1 FROM q
  UNION ALL SELECT 'sink_proximity', *, row_number() OVER (PARTITION BY doc_id ORDER BY inr DESC, CASE WHEN inr THEN dist END, line_idx) - 1 FROM q),
e AS (SELECT kind, o.doc_id, n_lines, min(pos) AS ifa, (max(pos) + 1) / n_lines AS effort, count(*) AS d FROM o JOIN dl ON dl.doc_id = o.doc_id AND dl.line_idx = o.line_idx GROUP BY 1, 2, 3)"""

SQL["reading_order_effort"] = f"""WITH {_EFFORT}
SELECT kind, count(*) AS n, round(avg(ifa), 6) AS ifa, round(avg(effort), 6) AS effort, round(avg(CAST(ifa < 1 AS INT)), 6) AS top1, round(avg(CAST(ifa < 3 AS INT)), 6) AS top3, round(avg(CAST(ifa < 5 AS INT)), 6) AS top5, round(avg(CAST(ifa < 10 AS INT)), 6) AS top10,
  round(avg((n_lines - d) / (d + 1)), 6) AS rnd_ifa, round(avg(d * (n_lines + 1) / (d + 1) / n_lines), 6) AS rnd_effort,
  round(avg(1 - greatest(0, n_lines - d) / greatest(1, n_lines) * CASE WHEN n_lines <= 1 THEN 0 ELSE greatest(0, n_lines - d - 1) / greatest(1, n_lines - 1) END * CASE WHEN n_lines <= 2 THEN 0 ELSE greatest(0, n_lines - d - 2) / greatest(1, n_lines - 2) END), 6) AS rnd_top3
FROM e GROUP BY 1"""

SQL["effort_cdf"] = f"WITH {_EFFORT} SELECT kind, CAST(k AS BIGINT) AS k, round(avg(CAST(ifa < k AS DOUBLE)), 6) AS share FROM e, range(31) z(k) GROUP BY 1, 2"

SQL["strata_fix_size"] = """
WITH o AS (SELECT l_orderkey, count(*) AS d, avg(l_discount) AS disc, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)
SELECT CASE WHEN d <= 1 THEN '1' WHEN d <= 5 THEN '2-5' ELSE '>5' END AS stratum, count(*) AS n, round(avg(disc), 6) AS mean_disc, round(quantile_cont(qty, 0.5), 6) AS median_qty FROM o GROUP BY 1"""

SQL["strata_nearest_rank_quartile"] = """
WITH d AS (SELECT doc_id, length(text) AS n FROM documents), s AS (SELECT list_sort(list(n)) AS s, count(*) AS t FROM d),
c AS (SELECT s[least(t, CAST(floor(0.25 * t) AS BIGINT) + 1)] AS c1, s[least(t, CAST(floor(0.5 * t) AS BIGINT) + 1)] AS c2, s[least(t, CAST(floor(0.75 * t) AS BIGINT) + 1)] AS c3 FROM s)
SELECT CAST(CASE WHEN n <= c1 THEN 1 WHEN n <= c2 THEN 2 WHEN n <= c3 THEN 3 ELSE 4 END AS BIGINT) AS bin, count(*) AS n_docs, min(n) AS lo, max(n) AS hi FROM d, c GROUP BY 1"""

SQL["quartile_digitize"] = """
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS q FROM lineitem)
SELECT CAST(CASE WHEN l_extendedprice < q[1] THEN 0 WHEN l_extendedprice < q[2] THEN 1 WHEN l_extendedprice < q[3] THEN 2 ELSE 3 END AS BIGINT) AS bin, count(*) AS n, round(avg(l_discount), 6) AS mean_disc, round(min(l_extendedprice), 6) AS lo FROM lineitem, q GROUP BY 1"""

SQL["quantile_summary"] = f"""
WITH {DELETED},{mention('ma', ALL_SINK)},{measures('xa', 'ma')}
SELECT count(*) AS n, round(quantile_cont(cov, 0.25), 6) AS p25, round(quantile_cont(cov, 0.5), 6) AS p50, round(quantile_cont(cov, 0.75), 6) AS p75,
  round(avg(CAST(cov >= 0.999 AS DOUBLE)) * 100, 6) AS "full", round(avg(CAST(cov >= 0.9 AS DOUBLE)) * 100, 6) AS most, round(avg(CAST(cov <= 0.25 AS DOUBLE)) * 100, 6) AS little FROM xa"""

SQL["category_min_n_both_arms"] = """
SELECT source, count(*) FILTER (WHERE quality = 1) AS n_a, count(*) FILTER (WHERE quality = 0) AS n_b, round(avg(n_chars) FILTER (WHERE quality = 1), 6) AS mean_a, round(avg(n_chars) FILTER (WHERE quality = 0), 6) AS mean_b
FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING n_a >= 5 AND n_b >= 5"""

SQL["composition_topk"] = """
SELECT source, count(*) AS n, count(DISTINCT lang) AS n_langs, round(100 * count(*) / sum(count(*)) OVER (), 1) AS pct, count(*) OVER () AS n_sources, max(count(*)) OVER () AS largest
FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 8"""

SQL["commit_weighted_mean"] = """
WITH p AS (SELECT l_orderkey, avg(l_discount) AS m FROM lineitem GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS n_orders, round((SELECT avg(m) FROM p), 6) AS weighted, round((SELECT avg(l_discount) FROM lineitem), 6) AS plain"""

SQL["pooled_and_grouped"] = """
SELECT coalesce(r_name, 'pooled') AS grp, count(*) AS n, round(avg(c_acctbal), 6) AS mean_bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name), ())"""

SQL["json_props_extract"] = """
WITH e AS (SELECT event_type, value, unnest(map_entries(from_json(props, '"MAP(VARCHAR, BIGINT)"'))) AS kv FROM events)
SELECT event_type, kv.key AS k, count(*) AS n, CAST(sum(kv.value) AS BIGINT) AS total, max(kv.value) AS most, round(avg(value), 6) AS mean_value FROM e GROUP BY 1, 2"""

SQL["stream_event_counts"] = """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"""

_FEATS = f"""{PAIRS}, f AS (SELECT doc_id, list_distinct({WORDS}) AS f FROM documents),
pf AS (SELECT x, y, a.f AS bef, b.f AS aft, list_filter(b.f, lambda v: NOT list_contains(a.f, v)) AS delta FROM cp JOIN f a ON a.doc_id = x JOIN f b ON b.doc_id = y)"""

SQL["feature_delta_test_a"] = f"""WITH {_FEATS}, t AS (SELECT len(delta) AS k, len(list_intersect(delta, aft)) > len(list_intersect(delta, bef)) AS grown FROM pf)
SELECT count(*) AS n, count(*) FILTER (WHERE k > 0) AS n_delta, round(avg(CAST(k > 0 AS DOUBLE)), 6) AS share, count(*) FILTER (WHERE k > 0 AND grown) AS n_grown, round(avg(k), 6) AS mean_size FROM t"""

SQL["delta_negative_control"] = f"""WITH {_FEATS}, dl AS (SELECT DISTINCT l.doc_id FROM ln l JOIN cp ON l.doc_id = cp.x WHERE NOT EXISTS (SELECT 1 FROM ln b WHERE b.doc_id = cp.y AND b.line = l.line)),
t AS (SELECT len(delta) AS k, x IN (SELECT doc_id FROM dl) AS arm FROM pf WHERE len(bef) > 0)
SELECT 'with_deletions' AS arm, count(*) FILTER (WHERE arm) AS n, count(*) FILTER (WHERE arm AND k > 0) AS n_delta FROM t UNION ALL SELECT 'control', count(*) FILTER (WHERE NOT arm), count(*) FILTER (WHERE NOT arm AND k > 0) FROM t"""

_SCORES = f"""q AS (SELECT DISTINCT doc_id AS q, unnest({WORDS}) AS feat FROM documents), s AS (SELECT DISTINCT item_id AS s, unnest({WORDS}) AS feat FROM benchmark),
z AS (SELECT s, count(*) AS n FROM s GROUP BY 1), c AS (SELECT q, s, count(*) AS c FROM q JOIN s USING (feat) GROUP BY 1, 2),
b AS (SELECT q, s, c / n AS score, row_number() OVER (PARTITION BY q ORDER BY c / n DESC, s) AS rn FROM c JOIN z USING (s)),
bs AS (SELECT u.q, b.s, round(coalesce(b.score, 0), 9) AS score, coalesce(contains(d.text, i.text), false) AS actual
       FROM (SELECT DISTINCT q FROM q) u LEFT JOIN b ON b.q = u.q AND rn = 1 JOIN documents d ON d.doc_id = u.q LEFT JOIN benchmark i ON i.item_id = b.s),
sw AS (SELECT k / 10 AS tau, count(*) FILTER (WHERE score >= k / 10 AND actual) AS tp, count(*) FILTER (WHERE score >= k / 10 AND NOT actual) AS fp, count(*) FILTER (WHERE score < k / 10 AND actual) AS fn, count(*) FILTER (WHERE score < k / 10 AND NOT actual) AS tn FROM bs, range(1, 11) z(k) GROUP BY k)"""

SQL["nearest_signature_tau_sweep"] = f"""WITH {_SCORES}
SELECT tau, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS prec, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS rec, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS bal_acc,
  round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc FROM sw"""

SQL["best_tau_and_fp_reduction"] = f"""WITH {_SCORES}, f AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM sw), bt AS (SELECT * FROM f ORDER BY f1 DESC, tau LIMIT 1),
l AS (SELECT fp AS fp_low, 2 * ((tp + fn) / (tp + fp + fn + tn)) / (1 + (tp + fn) / (tp + fp + fn + tn)) AS af FROM f ORDER BY tau LIMIT 1)
SELECT tau, round(f1, 6) AS f1, fp, fp_low, round(coalesce((fp_low - fp) / nullif(fp_low, 0), 0), 6) AS fp_reduction, round(af, 6) AS always_f1 FROM bt, l"""

SQL["nearest_jaccard_text"] = f"""WITH q AS (SELECT DISTINCT item_id AS q, unnest({WORDS}) AS feat FROM benchmark), s AS (SELECT DISTINCT doc_id AS s, unnest({WORDS}) AS feat FROM documents),
nq AS (SELECT q, count(*) AS nq FROM q GROUP BY 1), ns AS (SELECT s, count(*) AS ns FROM s GROUP BY 1), c AS (SELECT q, s, count(*) AS c FROM q JOIN s USING (feat) GROUP BY 1, 2)
SELECT q AS item_id, round(coalesce(max(c / (nq + ns - c)), 0), 6) AS score FROM nq LEFT JOIN c USING (q) LEFT JOIN ns USING (s) GROUP BY 1"""

SQL["nearest_jaccard_cosine"] = """
SELECT q.vec_id, round(max(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])), 5) AS score FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1"""

_GRAPH = f"""{LINES}, nd AS (SELECT doc_id, line_idx AS node, line FROM ln WHERE line_idx < 80), tk AS (SELECT DISTINCT doc_id, node, unnest(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')) AS tok FROM nd),
ed AS (SELECT x.doc_id, x.node AS a, y.node AS b FROM nd x JOIN nd y ON y.doc_id = x.doc_id AND y.node = x.node + 1
  UNION SELECT x.doc_id, x.node, y.node FROM nd x JOIN nd y ON y.doc_id = x.doc_id AND y.node BETWEEN x.node + 1 AND x.node + 3 WHERE regexp_matches(x.line, '[0-9]')
  UNION SELECT x.doc_id, x.node, y.node FROM tk x JOIN tk y ON y.doc_id = x.doc_id AND y.tok = x.tok AND x.node < y.node)"""
_ADJ = f"""{_GRAPH}, fu AS (SELECT doc_id, a, b FROM ed UNION SELECT doc_id, b, a FROM ed UNION SELECT doc_id, node, node FROM nd), dg AS (SELECT doc_id, a, count(*) AS d FROM fu GROUP BY 1, 2),
aj AS (SELECT f.doc_id, f.a, f.b, 1 / sqrt(x.d * y.d) AS w FROM fu f JOIN dg x ON x.doc_id = f.doc_id AND x.a = f.a JOIN dg y ON y.doc_id = f.doc_id AND y.a = f.b)"""
SQL["graph_edges"] = f"WITH {_GRAPH} SELECT doc_id, count(*) AS n_edges, CAST(sum(b - a) AS BIGINT) AS span FROM ed GROUP BY 1"
SQL["normalized_adjacency"] = f"WITH {_ADJ} SELECT doc_id, count(*) AS n, round(sum(w), 6) AS weight FROM aj GROUP BY 1"
SQL["propagate_mean_max"] = f"WITH {_ADJ}, pr AS (SELECT aj.doc_id, a, sum(w * length(line)) AS x FROM aj JOIN nd ON nd.doc_id = aj.doc_id AND nd.node = aj.b GROUP BY 1, 2) SELECT doc_id, round(avg(x), 4) AS mean_x, round(max(x), 4) AS max_x FROM pr GROUP BY 1"

_SHARES = f"""{LINES}, sh AS (SELECT doc_id, CAST(floor(1000 * avg(CAST(contains(line, ',') AS DOUBLE)) + 1e-9) AS BIGINT) AS a, CAST(floor(1000 * avg(CAST(length(line) > 60 AS DOUBLE)) + 1e-9) AS BIGINT) AS b FROM ln GROUP BY 1)"""
SQL["wilcoxon_w_z"] = f"""WITH {_SHARES}, d AS (SELECT a - b AS d, abs(a - b) AS m FROM sh WHERE a <> b), r AS (SELECT d, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS r FROM d),
t AS (SELECT coalesce(sum(t * t * t - t), 0) AS ties FROM (SELECT count(*) AS t FROM d GROUP BY m)), s AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS up, coalesce(sum(r) FILTER (WHERE d < 0), 0) AS dn FROM r)
SELECT n, round(least(up, dn), 6) AS w, round((least(up, dn) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s, t"""
SQL["cliffs_delta"] = """WITH j AS (SELECT n_chars AS v, quality FROM documents JOIN labels USING (doc_id))
SELECT (SELECT count(*) FROM j WHERE quality = 1) AS n, (SELECT count(*) FROM j WHERE quality = 0) AS m, round(avg(CASE WHEN a.v > b.v THEN 1 WHEN a.v < b.v THEN -1 ELSE 0 END), 6) AS delta FROM j a, j b WHERE a.quality = 1 AND b.quality = 0"""
SQL["spearman_rho"] = f"""WITH {_SHARES}, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM sh) SELECT count(*) AS n, round(corr(ra, rb), 6) AS rho FROM r"""
SQL["mcnemar_counts"] = """WITH j AS (SELECT (length(text) > 1500) = (quality = 1) AS a, (NOT regexp_matches(text, '[0-9]')) = (quality = 1) AS b FROM documents JOIN labels USING (doc_id))
SELECT count(*) FILTER (WHERE a AND b) AS n11, count(*) FILTER (WHERE a AND NOT b) AS n10, count(*) FILTER (WHERE NOT a AND b) AS n01, count(*) FILTER (WHERE NOT a AND NOT b) AS n00 FROM j"""

_FOLDS = """j AS (SELECT doc_id, quality, length(text) > 1500 AS ha, NOT regexp_matches(text, '[0-9]') AS hb FROM documents JOIN labels USING (doc_id)),
rf AS (SELECT repeat, j.*, (row_number() OVER (PARTITION BY repeat, quality ORDER BY md5('fold' || repeat || '/' || doc_id), doc_id) - 1) % 5 AS fold FROM j, range(6) z(repeat)),
fm AS (SELECT repeat, fold, avg(CAST(ha = (quality = 1) AS DOUBLE)) AS a, avg(CAST(hb = (quality = 1) AS DOUBLE)) AS b, count(*) AS nt FROM rf GROUP BY 1, 2)"""
SQL["nb_corrected_t"] = f"WITH {_FOLDS} SELECT count(*) AS j, round(avg(a - b), 6) AS mean, round(avg(a - b) / sqrt((1 / count(*) + 0.25) * nullif(var_samp(a - b), 0)), 6) AS t FROM fm"
SQL["mean_diff_ci"] = f"WITH {_FOLDS} SELECT repeat, round(avg(a - b), 6) AS mean, round(avg(a - b) - 1.96 * (stddev_samp(a - b) / sqrt(count(*))), 6) AS lo, round(avg(a - b) + 1.96 * (stddev_samp(a - b) / sqrt(count(*))), 6) AS hi, round(stddev_pop(a - b), 6) AS std_pop FROM fm GROUP BY 1"
SQL["per_fold_summary"] = f"WITH {_FOLDS} SELECT repeat, CAST(sum(nt) AS BIGINT) AS n, round(avg(a), 6) AS mean_a, round(stddev_pop(a), 6) AS std_a, round(avg(b), 6) AS mean_b, round(stddev_pop(b), 6) AS std_b FROM fm GROUP BY 1"
SQL["holm_adjust"] = """WITH p AS (SELECT source AS name, count(*) FILTER (WHERE toxic = 1) / nullif(count(toxic) * 20.0::DOUBLE, 0) AS p FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
h AS (SELECT name, p, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)) AS raw FROM p WHERE p IS NOT NULL)
SELECT name, round(p, 6) AS p, round(max(raw) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM h UNION ALL SELECT name, NULL, NULL FROM p WHERE p IS NULL"""

SQL["bootstrap_mean_ci"] = f"""WITH g AS (SELECT source, round(avg(n_chars), 3) AS v, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM documents GROUP BY 1),
d AS (SELECT r, {salt("'boot' || r || '/' || i")} % n AS hit FROM g, range(1000) z(r)), m AS (SELECT r, avg(v) AS m FROM d JOIN g ON g.i = d.hit GROUP BY 1), s AS (SELECT list_sort(list(m)) AS s FROM m)
SELECT round(s[26], 6) AS lo, round(s[975], 6) AS hi FROM s"""
SQL["bootstrap_f1_ci"] = f"""WITH g AS (SELECT NOT regexp_matches(text, '[0-9]') AS hat, quality = 1 AS y, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents JOIN labels USING (doc_id)),
d AS (SELECT r, {salt("'bootf1' || r || '/' || i")} % n AS hit FROM g, range(100) z(r)),
m AS (SELECT r, coalesce(2 * count(*) FILTER (WHERE hat AND y) / nullif(2 * count(*) FILTER (WHERE hat AND y) + count(*) FILTER (WHERE hat AND NOT y) + count(*) FILTER (WHERE NOT hat AND y), 0), 0) AS f1 FROM d JOIN g ON g.i = d.hit GROUP BY 1), s AS (SELECT list_sort(list(f1)) AS s FROM m)
SELECT round(s[3], 6) AS lo, round(s[97], 6) AS hi FROM s"""

SQL["balanced_sample"] = """SELECT * FROM (SELECT doc_id, CAST(toxic AS BIGINT) AS toxic FROM labels WHERE toxic = 1 ORDER BY md5('sample' || doc_id), doc_id LIMIT 20)
UNION ALL SELECT * FROM (SELECT doc_id, CAST(toxic AS BIGINT) FROM labels WHERE toxic = 0 ORDER BY md5('sample' || doc_id), doc_id LIMIT 80)"""
SQL["stratified_folds"] = "SELECT doc_id, (row_number() OVER (PARTITION BY quality ORDER BY md5('fold' || doc_id), doc_id) - 1) % 5 AS fold FROM labels"
SQL["repeated_folds"] = """WITH r AS (SELECT repeat, quality, doc_id, (row_number() OVER (PARTITION BY repeat, quality ORDER BY md5('fold' || repeat || '/' || doc_id), doc_id) - 1) % 5 AS fold FROM labels, range(30) z(repeat))
SELECT repeat, fold, CAST(quality AS BIGINT) AS quality, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM r GROUP BY 1, 2, 3"""
SQL["grouped_folds_simple"] = f"SELECT {salt('''concat('group', source)''')} % 5 AS fold, count(*) AS n, count(DISTINCT source) AS n_groups FROM documents GROUP BY 1"

SQL["tfidf_weights"] = f"""WITH t AS (SELECT doc_id, unnest({WORDS}) AS tok FROM documents), tf AS (SELECT doc_id, tok, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT tok, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM t),
w AS (SELECT doc_id, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (tok), n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM w GROUP BY 1)
SELECT doc_id, count(*) AS n_terms, round(max(w / l), 6) AS top, round(sum(w / l), 5) AS total FROM w JOIN l USING (doc_id) GROUP BY 1"""

_QS = """qs AS (SELECT round(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) / greatest(length(text), 1), 2) AS score, quality = 1 AS actual FROM documents JOIN labels USING (doc_id)),
ps AS (SELECT score, count(*) FILTER (WHERE actual) AS p, count(*) AS n FROM qs GROUP BY 1),
cv AS (SELECT score, p, sum(p) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS k, sum(p) OVER () AS pos FROM ps)"""
SQL["average_precision"] = f"WITH {_QS} SELECT round(sum(p / pos * (tp / k)), 6) AS ap, CAST(max(pos) AS BIGINT) AS n_pos FROM cv"
SQL["best_f1_threshold"] = f"WITH {_QS} SELECT round(score, 6) AS threshold, round(2 * tp / (k + pos), 6) AS f1 FROM cv ORDER BY 2 * tp / (k + pos) DESC, score DESC LIMIT 1"
SQL["ranked_comparison"] = """WITH j AS (SELECT quality = 1 AS y, length(text) > 1500 AS a, NOT regexp_matches(text, '[0-9]') AS b, NOT contains(text, '|') AS c FROM documents JOIN labels USING (doc_id)),
r AS (SELECT 'length' AS name, 2 * count(*) FILTER (WHERE a AND y) / (2 * count(*) FILTER (WHERE a AND y) + count(*) FILTER (WHERE a <> y)) AS f1 FROM j UNION ALL SELECT 'no_digits', 2 * count(*) FILTER (WHERE b AND y) / (2 * count(*) FILTER (WHERE b AND y) + count(*) FILTER (WHERE b <> y)) FROM j
  UNION ALL SELECT 'no_pipe', 2 * count(*) FILTER (WHERE c AND y) / (2 * count(*) FILTER (WHERE c AND y) + count(*) FILTER (WHERE c <> y)) FROM j UNION ALL SELECT 'unavailable', NULL)
SELECT row_number() OVER (ORDER BY f1 DESC NULLS LAST, name) AS rank, name, round(f1, 6) AS f1 FROM r"""


from . import joins_oracle, study_oracle  # noqa: E402, F401  (add their texts)
