"""DuckDB SQL that gives the same rows as :mod:`codelake.queries`, by query."""

from __future__ import annotations

PAGES = r"""
 pg AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS u FROM pages),
 pp AS (SELECT page_id, html, array_to_string(list_reverse(string_split(string_split(u, '/')[1], '.')), '/') || '/' || regexp_replace(u, '^[^/]*/?', '') AS path FROM pg),
 ps AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM pp),
 dirs AS (SELECT array_to_string(segs[1:i], '/') AS dir, i AS depth, count(*) AS n_files, min(page_id) AS first_ord
          FROM (SELECT page_id, segs, unnest(range(1, len(segs))) AS i FROM ps) GROUP BY 1, 2)
"""

SYMBOLS = r"""
 calls AS (SELECT user_id, event_type AS call FROM events GROUP BY ALL),
 users AS (SELECT DISTINCT user_id, 'make_u' || (user_id % 7) AS name, CASE WHEN user_id % 3 = 0 THEN 'method' ELSE 'function' END AS type, 'f' || user_id AS file_path FROM events)
"""

HIERARCHY = r"""
 edges AS (SELECT DISTINCT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer
           UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
 verts AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
"""

TRANSITIONS = r"""
 steps AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
 edges AS (SELECT DISTINCT src, dst FROM steps WHERE dst IS NOT NULL)
"""

SCORE = "(CASE WHEN {t} = '' THEN 0.0 ELSE least(1.0, 0.5 + (CASE WHEN {vague} THEN 0.0 ELSE 0.3 END) + (CASE WHEN length({t}) BETWEEN 20 AND 200 THEN 0.2 ELSE 0.0 END)) END)"
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _strip(c: str) -> str:
    return f"trim({c}, {WS})"


def _vague(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


VAGUE = ["handles", "processes", "manages", "deals with", "works with", "does stuff"]

ORACLE: dict[str, str] = {}
O = ORACLE

O["importance_rank"] = f"""WITH {PAGES} SELECT page_id, score FROM (
 SELECT page_id, (len(string_split(html, '<script')) - 1) * 10 + (len(string_split(html, '<a ')) - 1) * 5
  + CASE WHEN contains(lower(path), 'blog') THEN 50 ELSE 0 END + CASE WHEN contains(lower(path), 'shop') OR contains(lower(path), 'news') THEN 30 ELSE 0 END
  - CASE WHEN contains(lower(path), 'fr') THEN 5 ELSE 0 END AS score FROM pp) ORDER BY score DESC, page_id LIMIT 12"""
O["top_classes"] = "SELECT p_brand AS brand, count(*) AS n_parts FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"
O["topk_per_parent"] = "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"
O["group_top_other"] = """WITH g AS (SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
 r AS (SELECT *, row_number() OVER (ORDER BY n DESC, nation) AS rn, count(*) OVER () AS k FROM g)
 SELECT CASE WHEN k > 8 AND rn >= 8 THEN 'other' ELSE nation END AS nation, sum(n)::BIGINT AS n, least(rn, 8) AS rank FROM r GROUP BY 1, 3"""
O["rate_schedule"] = """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS arrived, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
 SELECT event_id, i * 3600000000 + max(arrived - i * 3600000000) OVER (PARTITION BY user_id ORDER BY arrived, event_id ROWS UNBOUNDED PRECEDING) AS start FROM e"""
O["dir_rollup"] = f"WITH {PAGES} SELECT dir, depth, n_files FROM dirs"
O["dir_purpose"] = f"""WITH {PAGES} SELECT dir, CASE WHEN contains(lower(dir), 'blog') THEN 'Posts' WHEN contains(lower(dir), 'com') THEN 'Company' WHEN contains(lower(dir), 'org') THEN 'Organisation'
 WHEN contains(lower(dir), 'de') THEN 'German' WHEN contains(lower(dir), 'fr') THEN 'French' ELSE 'Contains ' || n_files || ' file(s)' END AS purpose FROM dirs"""
O["common_prefix"] = "SELECT CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN 'data/store/orders/' || min(o_orderstatus) ELSE 'data/store/orders' END AS prefix FROM orders"
O["folder_nodes"] = f"""WITH {PAGES},
 shallow AS (SELECT *, dense_rank() OVER (ORDER BY depth) AS dr FROM dirs),
 picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY first_ord, dir) AS rk FROM shallow WHERE dr <= 2) WHERE rk <= 8),
 nodes AS (SELECT *, row_number() OVER (ORDER BY depth, rk) AS node, regexp_replace(dir, '/?[^/]*$', '') AS parent FROM picked)
 SELECT a.node, a.dir, b.node AS parent_node FROM nodes a LEFT JOIN nodes b ON a.parent = b.dir"""
O["path_functions"] = f"""WITH {PAGES} SELECT page_id,
 CASE WHEN len(segs) = 0 THEN '(unknown)' WHEN len(segs) <= 2 THEN array_to_string(segs, '/') ELSE '.../' || array_to_string(segs[-2:], '/') END AS short,
 trim(lower(regexp_replace(path, '[^A-Za-z0-9]+', '-', 'g')), '-') AS anchor,
 regexp_replace('F_' || path, '[^A-Za-z0-9_]', '_', 'g') AS node,
 string_split(path, '/')[-1] AS name, array_to_string(segs[-2:], '/') AS tail,
 regexp_matches(path, '(^|/)[^/]*/blog/[^/]*/[^/]*$') AS in_blog FROM ps"""
O["entry_points"] = """WITH f AS (SELECT p_partkey, string_split(p_name, ' ')[1] || '.py' AS name, p_name FROM part),
 l AS (SELECT p_partkey, 'main' AS type, 'Main entry point: ' || name AS description FROM f WHERE name = 'red.py'
  UNION ALL SELECT p_partkey, 'cli', 'Command-line interface: ' || name FROM f WHERE name IN ('blue.py', 'red.py')
  UNION ALL SELECT p_partkey, 'api', 'API server: ' || name FROM f WHERE contains(lower(name), 'green'))
 SELECT * FROM l UNION ALL SELECT p_partkey, 'executable', 'Executable script: ' || name FROM f
 WHERE (contains(p_name, 'steel') OR contains(p_name, 'almond')) AND p_partkey NOT IN (SELECT p_partkey FROM l)"""
O["feature_keywords"] = """SELECT ord, feature FROM (VALUES (0::BIGINT, 'Buying', 'purchase'), (0, 'Buying', 'click'), (1, 'Looking', 'view'), (2, 'Failing', 'error'), (3, 'Nothing', 'zzz')) v(ord, feature, word)
 WHERE EXISTS (SELECT 1 FROM events WHERE contains(lower(event_type), word)) GROUP BY 1, 2"""
O["import_classes"] = """SELECT CASE WHEN p_size < 5 OR contains(p_brand, '/') THEN 'internal' WHEN lower(string_split(p_brand, '.')[1]) IN ('brand#11', 'brand#12', 'brand#23') THEN 'stdlib' ELSE 'external' END AS kind, count(*) AS n FROM part GROUP BY 1"""
O["most_used"] = "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"
O["architecture_vote"] = """WITH f AS (SELECT ['models', 'services', 'domain', 'misc', 'lib'][r_regionkey % 5 + 1] AS a, lower(r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey),
 parts AS (SELECT a AS part FROM f UNION SELECT b FROM f),
 v AS (SELECT count(*) AS n, max(part IN ('models', 'views', 'controllers')) AS mvc, max(part IN ('services', 'repositories', 'controllers', 'models')) AS layered,
  max(part IN ('domain', 'application', 'infrastructure', 'presentation')) AS clean, count(*) FILTER (contains(part, 'service')) > 1 AS micro,
  max(part IN ('modules', 'components')) AND count(*) > 5 AS modular, count(*) <= 3 AS flat FROM parts),
 o AS (SELECT * FROM (SELECT 0 AS i, 0.8 AS c, 'MVC' AS name, 'Model-View-Controller pattern with clear separation of concerns' AS d, mvc AS y FROM v
  UNION ALL SELECT 1, 0.7, 'Layered', 'Layered architecture with distinct layers (presentation, business, data)', layered FROM v
  UNION ALL SELECT 2, 0.8, 'Clean Architecture', 'Clean architecture with dependency inversion and domain-centric design', clean FROM v
  UNION ALL SELECT 3, 0.7, 'Microservices', 'Microservices architecture with multiple independent services', micro FROM v
  UNION ALL SELECT 4, 0.7, 'Modular Monolith', 'Modular monolithic structure with well-defined module boundaries', modular FROM v
  UNION ALL SELECT 5, 0.9, 'Simple/Flat', 'Simple flat structure suitable for small projects', flat FROM v) WHERE y)
 SELECT coalesce((SELECT name FROM o ORDER BY c DESC, i LIMIT 1), 'Custom') AS primary_pattern,
  coalesce((SELECT d FROM o ORDER BY c DESC, i LIMIT 1), 'Custom architecture tailored to specific requirements') AS description,
  coalesce((SELECT string_agg(name, ',' ORDER BY i) FROM o), '') AS patterns"""
LANG = "CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' ELSE 'Other' END"
O["language_mix"] = f"SELECT {LANG} AS language, count(*) AS n_files FROM documents GROUP BY 1"
O["diagram_text"] = f"""SELECT 'pie title Language Mix' || chr(10) || string_agg('  "' || language || '" : ' || n, chr(10) ORDER BY language) AS content FROM (SELECT {LANG} AS language, count(*) AS n FROM documents GROUP BY 1)"""
O["dependency_diagram"] = """WITH e AS (SELECT DISTINCT r_name AS src, n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey),
 s AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e) WHERE k <= 3 ORDER BY src, dst LIMIT 15),
 l AS (SELECT 0 AS a, n AS b, '' AS c, '    ' || translate(n, '- ', '__') || '["' || n || '"]' AS line FROM (SELECT src AS n FROM s UNION SELECT dst FROM s)
  UNION ALL SELECT 1, src, dst, '    ' || translate(src, '- ', '__') || ' --> ' || translate(dst, '- ', '__') FROM s)
 SELECT '```mermaid' || chr(10) || 'graph LR' || chr(10) || string_agg(line, chr(10) ORDER BY a, b, c) || chr(10) || '```' AS content FROM l"""
O["file_statistics"] = """WITH f AS (SELECT l_orderkey, count(*) AS nf, count(DISTINCT l_returnflag) AS nc FROM lineitem GROUP BY 1),
 t AS (SELECT count(*) AS total_files, sum(nf)::BIGINT AS total_functions, sum(nc)::BIGINT AS total_classes FROM f),
 s AS (SELECT sum(trunc(l_quantity))::BIGINT AS estimated_lines FROM lineitem WHERE l_linenumber <> 0 AND l_linenumber + trunc(l_quantity) <> 0)
 SELECT total_files, total_functions, total_classes, estimated_lines, round(total_functions / total_files, 2) AS functions_per_file, round(total_classes / total_files, 2) AS classes_per_file FROM t, s"""
O["complexity_overview"] = """WITH f AS (SELECT l_orderkey, count(*) AS c, max(l_returnflag) AS flag FROM lineitem GROUP BY 1)
 SELECT flag, round(avg(c), 2) AS avg_complexity, max(c) AS max_complexity, count(c) AS n_measured, CASE WHEN avg(c) < 5 THEN 'Low' WHEN avg(c) < 10 THEN 'Moderate' ELSE 'High' END AS level FROM f GROUP BY 1"""
O["complexity_dist"] = """WITH f AS (SELECT l_partkey, count(*) AS c FROM lineitem GROUP BY 1)
 SELECT count(*) FILTER (c <= 3) AS simple, count(*) FILTER (c > 3 AND c <= 7) AS moderate, count(*) FILTER (c > 7 AND c <= 15) AS complex, count(*) FILTER (c > 15) AS very_complex FROM f"""
O["coupling"] = """WITH v AS (SELECT 's' || s_suppkey AS id FROM supplier UNION SELECT 'p' || (p_partkey % 500) FROM part),
 e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || (l_partkey % 500) AS dst FROM lineitem WHERE 's' || l_suppkey IN (SELECT id FROM v) AND 'p' || (l_partkey % 500) IN (SELECT id FROM v)),
 c AS (SELECT id, (SELECT count(*) FROM e WHERE src = id) AS efferent, (SELECT count(*) FROM e WHERE dst = id) AS afferent FROM v)
 SELECT id, efferent, afferent, CASE WHEN efferent + afferent > 0 THEN efferent / (efferent + afferent) ELSE 0.0 END AS instability FROM c"""
O["cohesion"] = """WITH s AS (SELECT DISTINCT s_suppkey % 20 AS module, s_nationkey AS name FROM supplier),
 r AS (SELECT c_custkey % 25 AS module, c_nationkey AS ref FROM customer),
 h AS (SELECT r.module, count(*) FILTER (s.name IS NOT NULL) AS internal_refs, count(*) AS total_refs FROM r LEFT JOIN s ON s.module = r.module AND s.name = r.ref GROUP BY 1),
 m AS (SELECT DISTINCT module FROM s)
 SELECT coalesce(m.module, h.module) AS module, coalesce(internal_refs, 0) AS internal_refs, coalesce(total_refs, 0) AS total_refs,
  CASE WHEN m.module IS NULL THEN 0.0 WHEN coalesce(total_refs, 0) = 0 THEN 1.0 ELSE internal_refs / total_refs END AS cohesion FROM m FULL JOIN h ON m.module = h.module"""
O["xref_search"] = """
WITH u AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)
SELECT s_suppkey AS query, 'o:' || a.l_orderkey AS used_by
FROM supplier JOIN u a ON a.l_suppkey = s_suppkey JOIN u b ON b.l_suppkey = s_suppkey + 1 AND a.l_orderkey = b.l_orderkey"""
O["xref_counts"] = "SELECT l_partkey::VARCHAR AS ref, count(DISTINCT l_orderkey) AS n_users FROM lineitem GROUP BY 1"
O["xref_index"] = "SELECT DISTINCT l_partkey::VARCHAR AS ref, 'o:' || l_orderkey AS used_by FROM lineitem"
O["data_sources"] = f"WITH {SYMBOLS} SELECT file_path, name FROM users u WHERE type = 'function' AND EXISTS (SELECT 1 FROM calls c WHERE c.user_id = u.user_id AND (contains(call, 'purch') OR contains(call, 'sign')))"
O["error_calls"] = f"WITH {SYMBOLS} SELECT name, string_agg(call, ',' ORDER BY call) AS calls FROM (SELECT DISTINCT name, call FROM users JOIN calls USING (user_id) WHERE contains(call, 'error')) GROUP BY 1"
O["async_calls"] = f"""WITH {SYMBOLS} SELECT name, string_agg(p, ',' ORDER BY p) AS patterns FROM (
 SELECT name, 'async_function' AS p FROM users WHERE user_id % 4 = 0 UNION SELECT name, call FROM users JOIN calls USING (user_id) WHERE contains(call, 'view') OR contains(call, 'click')) GROUP BY 1"""
O["design_patterns"] = f"WITH {SYMBOLS} SELECT DISTINCT 'factory' AS pattern, name FROM users"
O["api_boundary"] = f"WITH {SYMBOLS} SELECT user_id, name FROM users WHERE user_id % 5 = 0"
O["transitive_deps"] = f"WITH RECURSIVE {HIERARCHY}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src) SELECT src, dst FROM reach WHERE src <> dst"
O["topo_levels"] = f"WITH RECURSIVE {HIERARCHY}, walk AS (SELECT id, 0 AS l FROM verts UNION SELECT e.src, l + 1 FROM walk w JOIN edges e ON e.dst = w.id) SELECT id AS node, max(l)::BIGINT AS level FROM walk GROUP BY 1"
O["entry_leaf_nodes"] = f"WITH {HIERARCHY} SELECT id, 'entry' AS kind FROM verts WHERE id NOT IN (SELECT src FROM edges) UNION ALL SELECT id, 'leaf' FROM verts WHERE id NOT IN (SELECT dst FROM edges)"
O["cycles"] = f"""WITH RECURSIVE {TRANSITIONS}, walk AS (SELECT [src, dst] AS p FROM edges WHERE src <= dst
 UNION ALL SELECT list_append(p, e.dst) FROM walk w JOIN edges e ON e.src = w.p[-1] WHERE w.p[-1] <> w.p[1] AND (e.dst = w.p[1] OR (e.dst > w.p[1] AND NOT list_contains(w.p, e.dst))))
 SELECT array_to_string(p, '>') AS cycle FROM walk WHERE p[1] = p[-1]"""
O["cycle_members"] = f"WITH RECURSIVE {TRANSITIONS}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src) SELECT DISTINCT src AS id FROM reach WHERE src = dst"
O["call_chains"] = f"""WITH {HIERARCHY}, r AS (SELECT * FROM edges WHERE src NOT IN (SELECT dst FROM edges))
 SELECT a.src || '>' || a.dst || '>' || b.dst AS chain FROM r a JOIN edges b ON a.dst = b.src UNION ALL SELECT src || '>' || dst FROM r WHERE dst NOT IN (SELECT src FROM edges)"""
HISTORY = """ranked AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
 edges AS (SELECT a.k AS src, b.k AS dst FROM ranked a JOIN ranked b ON a.c = b.c AND b.i < a.i AND b.i IN (a.i - 1, 1))"""
O["strong_components"] = """WITH RECURSIVE o AS (SELECT o_custkey || ':' || o_orderpriority[1] AS n, lead(o_custkey || ':' || o_orderpriority[1]) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS m FROM orders),
 edges AS (SELECT DISTINCT n AS src, m AS dst FROM o WHERE m IS NOT NULL),
 reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
 nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)
 SELECT n.id, least(n.id, coalesce(min(a.dst), n.id)) AS component FROM nodes n LEFT JOIN (SELECT a.* FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src) a ON a.src = n.id GROUP BY n.id"""
O["history_levels"] = f"""WITH RECURSIVE {HISTORY}, walk AS (SELECT k AS node, 0 AS l FROM ranked WHERE i = 1 UNION SELECT e.src, l + 1 FROM walk w JOIN edges e ON e.dst = w.node)
 SELECT node, max(l)::BIGINT AS level FROM walk WHERE node IN (SELECT src FROM edges UNION SELECT dst FROM edges) GROUP BY 1"""
WAYS = """ways AS (SELECT c, k, i, 1::BIGINT AS n FROM ranked WHERE i = 1
 UNION ALL SELECT r.c, r.k, r.i, w.n + CASE WHEN r.i > 2 THEN 1 ELSE 0 END FROM ways w JOIN ranked r ON r.c = w.c AND r.i = w.i + 1)"""
O["chain_counts"] = f"""WITH RECURSIVE {HISTORY}, {WAYS}
 SELECT k AS node, n FROM ways WHERE k IN (SELECT src FROM edges UNION SELECT dst FROM edges)"""
O["last_chain"] = f"""WITH RECURSIVE {HISTORY}, tops AS (SELECT c, max_by(k, i) AS k, max(i) AS i FROM ranked GROUP BY c HAVING max(i) > 1),
 {WAYS},
 down AS (SELECT src, max(dst) AS dst FROM edges GROUP BY src),
 walk AS (SELECT k AS start, k AS here, k::VARCHAR AS chain FROM tops UNION ALL SELECT start, d.dst, chain || '>' || d.dst FROM walk w JOIN down d ON d.src = w.here)
 SELECT w.start, n - 1 AS rank, chain FROM walk w JOIN ways y ON y.k = w.start WHERE here NOT IN (SELECT src FROM edges)"""
O["reachable_pairs"] = f"""WITH RECURSIVE {HISTORY}, reach AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src),
 asked AS (SELECT o.k AS src, f.k AS dst FROM ranked o JOIN ranked f ON f.i = 1 AND f.c IN (o.c, o.c + 1))
 SELECT DISTINCT a.src, a.dst, r.src IS NOT NULL AND a.src <> a.dst AS reached FROM asked a LEFT JOIN reach r ON r.src = a.src AND r.dst = a.dst"""
O["graph_export"] = f"""WITH {HIERARCHY}, o AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS d FROM edges GROUP BY 1), i AS (SELECT dst AS id, string_agg(src, ',' ORDER BY src) AS d FROM edges GROUP BY 1)
 SELECT v.id, coalesce(o.d, '') AS dependencies, coalesce(i.d, '') AS dependents FROM verts v LEFT JOIN o ON o.id = v.id LEFT JOIN i ON i.id = v.id"""
BLOCKS = """e AS (SELECT DISTINCT 'flag:' || l_returnflag AS src, 'p:' || l_partkey AS dst FROM lineitem),
 b AS (SELECT src AS id, 'out' AS direction, dst AS t FROM e UNION ALL SELECT dst, 'in', src FROM e),
 p AS (SELECT *, (row_number() OVER (ORDER BY id, direction, t) - 1) // {width} AS part FROM b),
 g AS (SELECT id, direction, part, min(t) AS first, max(t) AS last, count(*) AS n, list(t ORDER BY t) AS neighbours FROM p GROUP BY 1, 2, 3),
 k AS (SELECT *, part - min(part) OVER (PARTITION BY id, direction) AS block FROM g)"""
O["adjacency_blocks"] = f"WITH {BLOCKS.format(width=1000)} SELECT id, direction, block, first, last, n, array_to_string(neighbours, ',') AS neighbours FROM k"
O["adjacency_json"] = f"""WITH {BLOCKS.format(width=500)}
SELECT id, direction, block, '{{"id":"' || id || '","direction":"' || direction || '","block":' || block || ',"neighbours":["' || array_to_string(neighbours, '","') || '"]}}' AS json FROM k"""
O["fact_totals"] = """
WITH o AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 2 * o_custkey ELSE o_custkey END AS customer, year(o_orderdate) AS y
  FROM orders WHERE o_orderkey % 5 <> 0)
SELECT 'orders' AS fact, status AS key, count(*)::BIGINT AS value FROM o GROUP BY 2 UNION ALL SELECT 'customers', status, sum(customer)::BIGINT FROM o GROUP BY 2 UNION ALL SELECT 'year', y::VARCHAR, count(*) FROM o GROUP BY 2"""
O["cache_keys"] = "SELECT doc_id, lang || ':' || sha256(text) AS content_key, md5(lang || ':' || lang || ':' || sha256(text)) AS cache_key FROM documents"
O["cache_miss"] = "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE lang = 'en' UNION SELECT md5(text) FROM benchmark)"
O["dedup_last_wins"] = "SELECT conv_id, role, turn, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS k FROM conversations) WHERE k = 1"
SIDES = """d AS (SELECT * FROM (SELECT l_orderkey AS key, CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'O' END AS name, CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS type,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey::VARCHAR END AS def, 'line ' || l_linenumber AS description, l_linenumber % 3 = 0 AS optional,
  row_number() OVER (PARTITION BY l_orderkey, CASE WHEN l_linestatus = 'F' THEN 'F' ELSE 'O' END ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS k FROM lineitem) WHERE k = 1)"""
for _name, _default in (("param_left_merge", "coalesce(d.def, o_custkey::VARCHAR)"), ("param_left_merge_compat", "CASE WHEN d.key IS NOT NULL THEN d.def ELSE o_custkey::VARCHAR END")):
    O[_name] = f"""WITH {SIDES} SELECT o_orderkey AS key, o_orderstatus AS name, coalesce(nullif(d.type, ''), nullif(o_orderpriority, ''), '') AS type, {_default} AS "default",
 coalesce(nullif(d.description, ''), '') AS description, coalesce(d.optional, false) AS optional FROM orders LEFT JOIN d ON d.key = o_orderkey AND d.name = o_orderstatus"""
O["param_full_merge"] = """WITH b AS (SELECT conv_id, turn // 2 AS slot, text FROM conversations WHERE turn % 2 = 0), r AS (SELECT conv_id, turn // 2 AS slot, text FROM conversations WHERE turn % 2 = 1),
 j AS (SELECT coalesce(b.conv_id, r.conv_id) AS conv_id, coalesce(b.slot, r.slot) AS slot, b.text AS bt, r.text AS rt, b.conv_id IS NULL OR (r.conv_id IS NOT NULL AND length(coalesce(r.text, '')) > 1.2 * length(coalesce(b.text, ''))) AS tr
  FROM b FULL JOIN r ON b.conv_id = r.conv_id AND b.slot = r.slot)
 SELECT conv_id, slot, CASE WHEN tr THEN 'refined' ELSE 'base' END AS origin, length(CASE WHEN tr THEN rt ELSE bt END) AS n FROM j"""
_b, _r = (SCORE.format(t=_strip(f"coalesce({c}, '')"), vague=_vague(c, VAGUE)) for c in ("b", "r"))
O["section_best_of"] = f"""WITH j AS (SELECT x.conv_id, x.turn // 2 AS slot, x.text AS b, y.text AS r FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn % 2 = 0 AND y.turn = x.turn + 1),
 s AS (SELECT *, {_b} AS sb, {_r} AS sr FROM j)
 SELECT conv_id, slot, md5(CASE WHEN sr > sb + 0.1 OR (NOT (sb > sr + 0.1) AND {_strip('r')} <> '') THEN r ELSE b END) AS best FROM s"""
O["summary_quality"] = f"SELECT doc_id, round({SCORE.format(t=_strip('text'), vague=_vague('text', ['the idiot', 'stupid', 'license', '###']))}::DOUBLE, 3) AS score FROM documents"
O["weak_sections"] = f"""WITH c AS (SELECT conv_id, turn, text AS s, role AS rt, text AS rd, text AS n, text AS t, text AS e FROM conversations),
 w AS (SELECT conv_id, turn,
  {SCORE.format(t=_strip('s'), vague=_vague('s', VAGUE))} < 0.6 AS summary,
  (CASE WHEN {_strip('rt')} <> '' THEN 0.3 ELSE 0 END) + (CASE WHEN length({_strip('rd')}) > 15 THEN 0.7 WHEN {_strip('rd')} <> '' THEN 0.3 ELSE 0 END) < 0.6 AS returns,
  (CASE WHEN (length({_strip('e')}) > 20 AND contains(lower(e), 'try')) OR contains(lower(e), 'error') THEN 0.9 WHEN length({_strip('e')}) > 10 THEN 0.6 WHEN {_strip('e')} <> '' THEN 0.3 ELSE 0 END) < 0.6 AS eh,
  (CASE WHEN {_strip('t')} = '' THEN 0 WHEN contains(t, 'Exception') AND {_strip('t')} <> 'Exception' THEN 0.9 ELSE 0.5 END) < 0.6 AS th,
  (CASE WHEN {_strip('n')} = '' THEN 0 WHEN length({_strip('n')}) > 20 THEN 0.9 ELSE 0.6 END) < 0.6 AS nt FROM c)
 SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN summary THEN 'summary' END, 'params', CASE WHEN returns THEN 'returns' END, 'examples', 'performance', CASE WHEN eh THEN 'error_handling' END, CASE WHEN th THEN 'throws' END, CASE WHEN nt THEN 'notes' END], lambda x: x IS NOT NULL), ',') AS weak FROM w"""
O["text_normalize"] = f"SELECT doc_id, md5({_strip(chr(114) + 'egexp_replace(regexp_replace(text, ' + chr(39) + '[ \\t]+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '\\n\\s*\\n+' + chr(39) + ', chr(10) || chr(10), ' + chr(39) + 'g' + chr(39) + ')')}) AS h FROM documents"
O["text_truncate"] = "SELECT doc_id, CASE WHEN length(text) > 40 THEN text[1:37] || '...' ELSE text END AS t FROM documents"
O["text_indent"] = f"SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN {_strip('x')} = '' THEN '' ELSE '    ' || x END), chr(10))) AS h FROM documents"
O["html_escape"] = "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')) AS h FROM pages"
O["diagram_label"] = f"""SELECT doc_id, {_strip("regexp_replace(translate(replace(text, '\"', '\\\"'), chr(13) || chr(10) || chr(9), '   '), '\\s{2,}', ' ', 'g')")}[1:60] AS label FROM documents"""
O["file_names"] = """SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_') AS name,
 replace(trim(regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9 _-]', '', 'g')), ' ', '_') AS folder FROM part"""
O["line_counts"] = """SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END AS n, CASE WHEN text = '' THEN 0 ELSE length(rtrim(text, chr(10))) + 1 END AS ended FROM documents"""
O["code_markers"] = "SELECT p_partkey, p_name AS body FROM part"
O["lenient_json"] = """SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 3 = 2 THEN 'none ' || event_type END AS summary FROM events"""
O["docstrings"] = r"""SELECT p_partkey, p_name || chr(10) || chr(10) || 'Args:' || chr(10) || '    ' || p_brand || ' (' || p_type || '): size (optional, default=' || p_size || ')' || chr(10) || chr(10) || 'Returns:' || chr(10) || '    int: a value' AS doc FROM part"""
O["section_dedup"] = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
 h AS (SELECT *, length(line) < 60 AS h, row_number() OVER (PARTITION BY doc_id, line, length(line) < 60 ORDER BY pos) AS nth FROM l),
 k AS (SELECT *, coalesce(last_value(CASE WHEN h THEN nth = 1 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), true) AS keep FROM h)
 SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS h FROM k WHERE keep GROUP BY 1"""
O["url_fix"] = "SELECT event_id, 'see http://host:' || (3000 + user_id % 100) || '/' || event_type || ' and  in src/main' AS t FROM events"
O["drop_lines"] = "SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (contains(x, 'License') OR contains(x, ' token = ') OR contains(x, '###'))), chr(10))) AS h FROM documents"
O["validate_output"] = """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Contains 1 absolute Windows paths; Contains 1 endpoints without leading slash'
 WHEN 1 THEN 'Contains 1 malformed URLs (missing slash); Contains placeholder text: your-repo' ELSE 'Contains 2 paths with missing separators' END AS issues FROM part"""
O["normalize_defaults"] = """SELECT doc_id, coalesce(lang, 'Unnamed Project') AS project, 'unknown' AS path, 'q' || quality AS function, CASE WHEN quality IS NOT NULL THEN 'void' END AS returns, 0::BIGINT AS n_classes
 FROM documents LEFT JOIN labels USING (doc_id)"""
O["validate_rows"] = """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'project_name is missing' WHEN 2 THEN 'a file has no path; functions is no list' ELSE 'files is missing' END AS errors,
 CASE WHEN p_size % 4 = 1 THEN 'Unnamed Project' ELSE 'p' END AS project, CASE WHEN p_size % 4 = 3 THEN 0 ELSE 1 END::BIGINT AS n_files FROM part"""
_w = "string_split(p_name, ' ')[1]"
O["python_symbols"] = f"""SELECT 'm' || p_partkey AS path, NULL AS class_name, {_w} AS name, '(a, b=1, *, c=2)' AS signature, 'str' AS returns, 3::BIGINT AS n_parameters FROM part
 UNION ALL SELECT 'm' || p_partkey, 'K', 'get_' || {_w}, '(self)', '', 1 FROM part"""
O["js_symbols"] = f"""SELECT 'm' || p_partkey AS path, NULL AS class_name, {_w} AS name, 'async (a, b = 2, ...rest)' AS signature, '' AS returns, 3::BIGINT AS n_parameters FROM part
 UNION ALL SELECT 'm' || p_partkey, 'K', 'get_' || {_w}, '(x)', '', 1 FROM part"""
O["ts_symbols"] = f"""SELECT 'm' || p_partkey AS path, NULL AS class_name, {_w} AS name, '(a: number, b?: string): boolean => {{}}' AS signature, 'boolean' AS returns, 2::BIGINT AS n_parameters FROM part
 UNION ALL SELECT 'm' || p_partkey, 'K', 'get_' || {_w}, '(x: string): void', 'void', 1 FROM part"""
O["java_symbols"] = f"""SELECT 'm' || p_partkey AS path, 'K' AS class_name, 'get_' || {_w} AS name, '(String a, List b)' AS signature, 'int' AS returns, 2::BIGINT AS n_parameters FROM part
 UNION ALL SELECT 'm' || p_partkey, 'K', 'K', '(int a)', '', 1 FROM part"""


def oracle_sql() -> dict[str, str]:
    from .oracle_source import ORACLE as source

    return ORACLE | source
