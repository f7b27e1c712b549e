"""DuckDB SQL for the queries of the joins module."""

from __future__ import annotations

from .oracle import SQL

_ELEMENTS = r"""pc AS (SELECT page_id, unnest(string_split(coalesce(html, ''), '<')) AS piece, unnest(range(len(string_split(coalesce(html, ''), '<')))) AS k FROM pages),
tg AS (SELECT page_id, k, lower(regexp_extract(piece, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, starts_with(piece, '/') AS ends FROM pc WHERE k > 0),
lv AS (SELECT *, sum(CASE WHEN ends THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, tag ORDER BY k) + CAST(ends AS INTEGER) AS lvl FROM tg WHERE tag <> ''),
nx AS (SELECT *, lead(ends) OVER w AS next_ends, lead(k) OVER w AS hi FROM lv WINDOW w AS (PARTITION BY page_id, tag, lvl ORDER BY k)),
el AS (SELECT page_id, k AS lo, hi, tag FROM nx WHERE NOT ends AND next_ends)"""

SQL["enclosing_elements"] = f"""WITH {_ELEMENTS} SELECT a.page_id, a.lo AS at, a.tag, count(b.lo) AS depth, coalesce(string_agg(b.tag, '/' ORDER BY b.lo), '') AS path
FROM el a LEFT JOIN el b ON b.page_id = a.page_id AND b.lo < a.lo AND a.hi < b.hi GROUP BY 1, 2, 3"""
SQL["parent_tag_counts"] = f"""WITH {_ELEMENTS}, pr AS (SELECT a.page_id, a.lo, count(*) AS depth, max_by(b.tag, b.lo) AS parent FROM el a JOIN el b ON b.page_id = a.page_id AND b.lo < a.lo AND a.hi < b.hi GROUP BY 1, 2)
SELECT parent, count(*) AS n, count(DISTINCT page_id) AS n_pages, max(depth) AS deepest FROM pr GROUP BY 1"""

_SPLIT = r"regexp_split_to_array(text, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]')"
_LINES = " UNION ALL ".join(
    f"SELECT {k} AS src, '{t}' AS name, unnest(CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END) AS line FROM (SELECT {_SPLIT} AS p FROM {t} WHERE text IS NOT NULL)" for k, t in enumerate(("documents", "benchmark", "conversations"))
)
SQL["memo_reuse"] = rf"""WITH ln AS ({_LINES}), f AS (SELECT line, min(src) AS first FROM ln GROUP BY 1)
SELECT name, count(*) AS n, count(DISTINCT line) AS n_texts, count(DISTINCT line) FILTER (WHERE first = src) AS n_computed, CAST(sum(len(regexp_extract_all(line, '[A-Za-z0-9_]+|[^A-Za-z0-9_\s]'))) AS BIGINT) AS n_tokens,
  CAST(sum(len(list_distinct(regexp_extract_all(line, '[A-Za-z_][A-Za-z0-9_]*')))) AS BIGINT) AS n_idents FROM ln JOIN f USING (line) GROUP BY name"""

SQL["xml_units"] = """SELECT l_orderkey AS id, o_custkey AS customer, count(*) AS n, CAST(sum(l_partkey) AS BIGINT) AS parts, CAST(max(l_linenumber) AS BIGINT) AS last_line, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS total
FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"""

SQL["manifest_substrings"] = """
WITH e AS (SELECT p_partkey AS pos, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS name FROM part UNION ALL SELECT s_suppkey + 1000000000, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') FROM supplier),
k AS (SELECT DISTINCT key FROM (SELECT unnest([p_name, p_brand, p_type, p_name || '-' || p_brand]) AS key FROM part UNION ALL SELECT s_name || ' of ' || n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)),
s AS (SELECT key, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS x FROM k)
SELECT key, count(*) FILTER (WHERE name = x) AS equal, count(*) FILTER (WHERE name <> x AND contains(name, x)) AS inside, count(*) FILTER (WHERE name <> x AND contains(x, name)) AS around, coalesce(min(pos), -1) AS pos
FROM s LEFT JOIN e ON contains(name, x) OR contains(x, name) GROUP BY 1"""


def _group_folds(counts: str, n: int = 5, heavy: int = 1000) -> str:
    """Common tables for stratified group folds of counts(g, pos, neg): ``fd`` has the fold of every group.  Lists are 1-based."""
    cost = "hp[i] * CAST(pos AS HUGEINT) * tn * tn + hn[i] * CAST(neg AS HUGEINT) * tp * tp"
    add = lambda h, c: f"list_transform(range(1, {n + 1}), lambda i: {h}[i] + CASE WHEN i = k THEN {c} ELSE 0 END)"
    return f"""ct AS ({counts}), tt AS (SELECT CAST(greatest(1, sum(pos)) AS HUGEINT) AS tp, CAST(greatest(1, sum(neg)) AS HUGEINT) AS tn, sum(pos + neg) AS total FROM ct),
tl AS (SELECT g, pos, neg, (row_number() OVER (ORDER BY pos + neg DESC, pos DESC, g NULLS FIRST) - 1) % {n} AS fold FROM ct, tt WHERE (pos + neg) * {heavy} <= total),
hv AS (SELECT g, pos, neg, row_number() OVER (ORDER BY pos + neg DESC, pos DESC, g NULLS FIRST) AS r FROM ct, tt WHERE (pos + neg) * {heavy} > total),
ld AS (SELECT list(coalesce(p, 0) ORDER BY f) AS hp, list(coalesce(q, 0) ORDER BY f) AS hn FROM range({n}) z(f) LEFT JOIN (SELECT fold, CAST(sum(pos) AS HUGEINT) AS p, CAST(sum(neg) AS HUGEINT) AS q FROM tl GROUP BY 1) ON fold = f),
st AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS VARCHAR) AS g, CAST(0 AS BIGINT) AS k, hp, hn FROM ld
  UNION ALL SELECT r, g, k, {add('hp', 'pos')}, {add('hn', 'neg')} FROM (
    SELECT hv.r, hv.g, hv.pos, hv.neg, hp, hn, list_sort(list_transform(range(1, {n + 1}), lambda i: {{'c': {cost}, 's': hp[i] + hn[i], 'i': i}}))[1].i AS k FROM st JOIN hv ON hv.r = st.r + 1, tt)),
fd AS (SELECT g, CAST(fold AS BIGINT) AS fold FROM tl UNION ALL SELECT g, k - 1 FROM st WHERE r > 0)"""


SQL["grouped_folds_long_tail"] = f"""WITH RECURSIVE {_group_folds("SELECT CAST(o_custkey AS VARCHAR) AS g, count(*) FILTER (WHERE o_orderstatus = 'F') AS pos, count(*) FILTER (WHERE o_orderstatus <> 'F') AS neg FROM orders GROUP BY 1")}
SELECT fold, count(*) AS n, count(DISTINCT o_custkey) AS n_groups, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_pos FROM orders JOIN fd ON g = CAST(o_custkey AS VARCHAR) GROUP BY 1"""
SQL["grouped_folds_stratified"] = f"""WITH RECURSIVE dl AS (SELECT source, quality FROM documents JOIN labels USING (doc_id)),
{_group_folds("SELECT source AS g, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg FROM dl GROUP BY 1")}
SELECT fold, count(*) AS n, count(DISTINCT source) AS n_groups, count(*) FILTER (WHERE quality = 1) AS n_pos FROM dl JOIN fd ON g IS NOT DISTINCT FROM source GROUP BY 1"""
