"""DuckDB SQL that gives the same rows as :mod:`codelake.queries_source`, by query."""

from __future__ import annotations

from .oracle import HIERARCHY, PAGES

ORACLE: dict[str, str] = {}
O = ORACLE

W = "string_split(p_name, ' ')[1]"
P = f"p AS (SELECT 'm' || p_partkey AS path, {W} AS w, p_size::VARCHAR AS z FROM part)"


def _fill(c: str) -> str:
    return f"replace(replace({c}, 'WORD', w), 'SIZE', z)"


def _each(columns: str, values: str) -> str:
    """A row of ``values`` for each part; ! before a column fills in its word and size."""
    names = [c.strip() for c in columns.split(",")]
    shown = ", ".join(f"{_fill(n[1:])} AS {n[1:]}" if n[0] == "!" else n for n in names)
    return f"WITH {P} SELECT path, {shown} FROM p, (VALUES {values}) v({', '.join(n.lstrip('!') for n in names)})"


O["python_imports"] = _each("type, !module, name, alias, level, line", """('import', 'os', NULL, NULL, 0::BIGINT, 4::BIGINT), ('import', 'WORDlib.core', NULL, 'lib', 0, 5),
 ('from_import', 'pkg.WORD', 'run', 'go', 0, 6), ('from_import', 'pkg.WORD', 'stop', NULL, 0, 6), ('from_import', '', 'near', NULL, 1, 7), ('import', 'json', NULL, NULL, 0, 47)""")
O["python_variables"] = _each("owner, kind, !name, type, !value, line", """(NULL, 'constant', 'MAX_SIZE', 'int', 'SIZE', 8::BIGINT), (NULL, 'constant', 'LIMIT', 'int', 'SIZE + 1', 9),
 (NULL, 'global', 'mode', 'str', '''WORD''', 10), (NULL, 'global', 'flags', 'dict', '{''a'': True}', 12), ('Box', 'attribute', 'size', 'int', 'SIZE', 37)""")
O["python_calls"] = _each("!name, calls", "('WORD', 'deco,go,lib.call,range'), ('_low', 'self.open'), ('main_WORD', 'f.read,open')")
O["python_complexity"] = _each("!name, cyclomatic, nesting_depth, num_branches, num_loops", """('WORD', 6::BIGINT, 3::BIGINT, 3::BIGINT, 1::BIGINT), ('__init__', 1, 0, 0, 0), ('_low', 1, 0, 0, 0), ('__len__', 1, 0, 0, 0),
 ('open', 1, 0, 0, 0), ('shown', 1, 0, 0, 0), ('main_WORD', 3, 3, 0, 1)""")
O["python_flags"] = _each("!name, flags, decorators", """('WORD', '', 'deco(1)'), ('__init__', 'is_constructor', ''), ('_low', 'is_protected', ''), ('__len__', 'is_magic', ''),
 ('open', 'is_public,is_static', 'staticmethod'), ('shown', 'is_public,is_property', 'property'), ('main_WORD', 'async', '')""")
_DOCS = "class_name, !name, !description, !parameters, returns, returned, throws"
O["python_docs"] = _each(_DOCS, """(NULL, 'WORD', 'Turns WORD.', 'a|str|the first WORD;b|int|the second one;*rest||;c||;**kw||', 'bool', 'whether it turned', 'ValueError'), (NULL, 'main_WORD', '', '', '', '', '')""")
O["js_docs"] = _each(_DOCS, """(NULL, 'WORD', 'Adds WORD.', 'a|number|first;b|string|second SIZE;...rest|Array|', 'number', 'the sum', ''), (NULL, 'arrow_WORD', '', 'q||', '', '', ''),
 ('K', 'constructor', 'Constructs a K instance.', 'a||', '', '', ''), ('K', 'make', '', 'x||', '', '', '')""")
O["ts_docs"] = _each(_DOCS, """(NULL, 'WORD', 'Holds WORD.', 'first|number|the SIZE one;rest|string|', 'boolean', 'all of it', ''), ('Store', 'constructor', 'Creates a new instance of Store.', 'n|number|', '', '', ''),
 ('Store', 'get_WORD', '', 'x|any|', 'void', '', ''), ('Shape', 'area', '', '', 'number', '', '')""")
O["java_docs"] = _each(_DOCS, """('K', 'find_WORD', 'Finds WORD. Then more.', 'a|String|the SIZE one;b|int|', 'int', 'the place', 'IOException'), ('K', 'K', '', 'n|int|', '', '', '')""")
O["file_summaries"] = _each("language, !summary, n_functions, n_methods, n_classes, n_imports", """('python', 'About WORD.' || chr(10) || chr(10) || 'More words.', 2::BIGINT, 5::BIGINT, 1::BIGINT, 6::BIGINT), ('javascript', 'Tools for WORD.', 2, 2, 1, 1)""")
O["main_blocks"] = _each("!code", "('WORD(1)' || chr(10) || 'main_WORD()')")
O["parse_diagnostics"] = "SELECT 'm' || p_partkey AS path, 'parse' AS stage, CASE p_partkey % 3 WHEN 0 THEN 'SyntaxError' ELSE 'KeyError' END AS error FROM part WHERE p_partkey % 3 <> 2"
O["classified_imports"] = """SELECT p_partkey, CASE WHEN p_size % 7 = 0 OR (p_size % 2 = 0 AND p_partkey % 2 = 0) THEN 'internal' WHEN p_size % 4 = 1 THEN 'stdlib' ELSE 'external' END AS kind,
 CASE p_size % 4 WHEN 0 THEN 'pkg' WHEN 1 THEN 'os' WHEN 2 THEN 'a' ELSE string_split(p_name, ' ')[CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END] END AS package FROM part"""

IMPORTS = """imp AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN 't/Test_' ELSE 's/m_' END || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.py' ELSE '.jsx' END AS path,
  ['flask', 'numpy.linalg', 'pytest', 'unittest.mock', 'argparse', 'jsonlib', 'mocha'][s_nationkey % 7 + 1] AS module, CASE WHEN s_nationkey % 2 = 0 THEN 'react' END AS name FROM supplier),
 tf AS (SELECT *, CASE WHEN contains(module, 'unittest') THEN 'unittest' WHEN contains(module, 'pytest') THEN 'pytest' WHEN module = 'mocha' THEN 'mocha' END AS framework FROM imp)"""
O["test_files"] = f"WITH {IMPORTS} SELECT path, k % 3 = 0 AS is_test FROM imp"
O["project_languages"] = f"WITH {IMPORTS} SELECT DISTINCT CASE WHEN k % 2 = 0 THEN 'Python' ELSE 'JavaScript' END AS language FROM imp"
O["frameworks"] = f"""WITH {IMPORTS}, words AS (SELECT unnest(['flask', 'django', 'fastapi', 'express', 'react', 'vue', 'angular', 'pandas', 'numpy', 'tensorflow', 'pytorch']) AS word)
 SELECT word AS name FROM words WHERE EXISTS (SELECT 1 FROM imp WHERE contains(module, word) OR contains(name, word))"""
O["test_frameworks"] = f"WITH {IMPORTS} SELECT path, framework FROM tf"
O["testing_summary"] = f"""WITH {IMPORTS}, f AS (SELECT DISTINCT framework FROM tf WHERE k % 3 = 0 AND framework IS NOT NULL)
 SELECT count(*) FILTER (k % 3 = 0) AS test_count, coalesce((SELECT string_agg(framework, ',' ORDER BY framework) FROM f), '') AS frameworks, count(*) FILTER (k % 3 = 0) || '/' || count(*) || ' files' AS ratio FROM imp"""
O["module_tree"] = f"""WITH {PAGES} SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, string_split(path, '/')[-1] AS name, path, (len(string_split(html, '<a ')) - 1)::BIGINT AS n_functions, (len(string_split(html, '<script')) - 1)::BIGINT AS n_classes FROM pp"""
O["dependency_summary"] = """WITH r AS (SELECT o_orderstatus AS s, string_split(o_orderpriority, '-')[2] AS package, o_custkey % 50 AS path, o_orderpriority AS module FROM orders),
 x AS (SELECT package, count(*) AS n FROM r WHERE s = 'F' GROUP BY 1)
 SELECT (SELECT string_agg(package, ',' ORDER BY package) FROM x) AS external, (SELECT string_agg(package, ',' ORDER BY package) FROM (SELECT DISTINCT package FROM r WHERE s = 'O')) AS stdlib,
  (SELECT count(*) FROM (SELECT DISTINCT package, path, module FROM r WHERE s NOT IN ('F', 'O'))) AS n_internal, (SELECT package FROM x ORDER BY n DESC, package LIMIT 1) AS most_used"""
O["first_packages"] = "SELECT string_agg(b, ',' ORDER BY b) AS packages FROM (SELECT DISTINCT p_brand AS b FROM part ORDER BY 1 LIMIT 15)"
O["variable_flow"] = """WITH r AS (SELECT 'v' || (o_custkey % 40) AS variable, unnest([o_orderpriority, o_orderstatus]) AS ref FROM orders WHERE o_orderkey % 2 = 0)
 SELECT variable, string_agg(ref, ',' ORDER BY ref) AS flows_to FROM (SELECT DISTINCT * FROM r) GROUP BY 1"""
O["data_sinks"] = "SELECT DISTINCT user_id::VARCHAR AS file_path, 'u' || user_id AS name FROM events WHERE user_id % 2 = 0 AND (event_type LIKE 'pur%' OR event_type LIKE 'err%')"
O["direct_dependencies"] = f"WITH {HIERARCHY} SELECT dst AS id, 'dependency' AS kind FROM edges WHERE src = 'n7' UNION ALL SELECT src, 'dependent' FROM edges WHERE dst = 'r1'"
O["global_schedule"] = """WITH e AS (SELECT event_id, epoch_us(ts) AS arrived, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events)
 SELECT event_id, i * 60000000 + max(arrived - i * 60000000) OVER (ORDER BY arrived, event_id ROWS UNBOUNDED PRECEDING) AS start FROM e"""

EXAMPLES = f"""s AS (SELECT p_partkey AS file_ord, p_size AS z, {W} AS w, CASE p_size % 5 WHEN 0 THEN 'api/' WHEN 1 THEN 'tests/' ELSE 'src/' END || 'f' || p_partkey || '.py' AS path,
  CASE p_size % 3 WHEN 0 THEN 'demo_' WHEN 1 THEN 'main_' ELSE '' END || {W} AS name, CASE WHEN p_size % 2 = 0 THEN p_type END AS description FROM part),
 stub AS (SELECT *, CASE WHEN description IS NOT NULL THEN '\"\"\"' || description || '\"\"\"' || chr(10) ELSE '' END || 'def ' || name || '(' || w || '):' || chr(10) || '    # Function implementation' AS code FROM s)"""
O["usage_examples"] = f"""WITH {EXAMPLES}, a AS (SELECT file_ord, -1 AS o, 'Basic Usage' AS title, 'Example from f' || file_ord || '.py' AS description, w || '(1)' || chr(10) || 'main_' || w || '()' AS code FROM s WHERE z % 5 <> 1 AND file_ord % 2 = 0
  UNION ALL SELECT file_ord, 0, 'Example: ' || name, description, code FROM stub WHERE z % 5 <> 1 AND z % 3 = 0)
 SELECT file_ord, title, description, code, 'python' AS language FROM a ORDER BY file_ord, o LIMIT 5"""
O["api_examples"] = f"""WITH {EXAMPLES} SELECT file_ord, 'API Endpoint: ' || name AS title, coalesce(description, 'API endpoint handler') AS description,
 '@app.Route(''/x'')' || chr(10) || '@cached' || chr(10) || 'def ' || name || '(' || w || '):' || chr(10) || CASE WHEN description IS NOT NULL THEN '    \"\"\"' || description || '\"\"\"' || chr(10) ELSE '' END || '    # Implementation' AS code, 'python' AS language
 FROM s WHERE z % 5 = 0 ORDER BY file_ord LIMIT 3"""
O["cli_examples"] = f"""WITH {EXAMPLES} SELECT file_ord, 'CLI: ' || name AS title, coalesce(description, 'Command-line interface') AS description, code, 'python' AS language FROM stub WHERE file_ord % 4 = 0 AND z % 3 = 1"""
O["import_examples"] = f"""WITH {EXAMPLES} SELECT file_ord, 'Importing from f' || file_ord AS title, 'How to import and use f' || file_ord || ' module' AS description,
 'from f' || file_ord || ' import ' || CASE WHEN file_ord % 2 = 0 THEN 'Box' ELSE name END AS code, 'python' AS language FROM s WHERE z % 5 <> 1 ORDER BY file_ord LIMIT 3"""

O["cache_lookup"] = "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN lang = 'de' THEN 'second' WHEN lang = 'en' THEN 'first' END AS details FROM documents"
O["cache_stats"] = """WITH c AS (SELECT lang AS language, count(DISTINCT text) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1)
 SELECT language, n, (SELECT sum(n) FROM c)::BIGINT AS entries, 0::BIGINT AS after_clear FROM c"""

O["details_normal"] = """SELECT p_partkey, CASE p_size % 5 WHEN 2 THEN p_name || chr(10) || '2' WHEN 3 THEN 'plain ' || p_name WHEN 4 THEN '' ELSE p_name END AS summary,
 CASE p_size % 5 WHEN 0 THEN 'a|int|' || p_brand WHEN 2 THEN 'b||d' ELSE '' END AS params, CASE p_size % 5 WHEN 0 THEN 'str' WHEN 4 THEN 'int' ELSE '' END AS rtype, CASE p_size % 5 WHEN 0 THEN p_type WHEN 4 THEN 'n' ELSE '' END AS rdesc,
 CASE p_size % 5 WHEN 1 THEN 'ValueError' ELSE '' END AS throws, CASE p_size % 5 WHEN 1 THEN 'x,y' ELSE '' END AS notes, CASE p_size % 5 WHEN 2 THEN 'go()' ELSE '' END AS examples, CASE p_size % 5 WHEN 4 THEN 'O(1)' ELSE '' END AS time FROM part"""
O["has_content"] = "SELECT p_partkey, ['summary,params,returns', 'summary,throws,notes', 'summary,params,examples', 'summary', 'returns,performance'][p_size % 5 + 1] AS filled FROM part"
O["empty_details"] = "SELECT p_partkey, 'No documentation available.' AS docstring, false AS from_cache, 0::BIGINT AS n_params FROM part"
O["doc_prompts"] = "SELECT p_partkey, 'Code:' || chr(10) || p_name AS ending, true AS starts FROM part"
O["code_sanitized"] = "SELECT p_partkey, 'x =  ' || p_name || chr(10) || '    all' || chr(10) || chr(9) || 'y = `a`  end' AS code FROM part"
O["html_unescaped"] = "SELECT p_partkey, p_name || ' <b> & é €' AS t FROM part"
O["relative_paths"] = """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '' ELSE '/data/projects/' END || replace(p_name, ' ', '/') AS path, p_size % 3 < 2 AS climbs, p_size % 2 = 0 AND regexp_matches(p_name, '^[a-m]') AS early FROM part"""
O["param_default_type"] = """SELECT p_partkey AS key, 'a' AS name, CASE WHEN p_size % 9 = 0 THEN 'string' WHEN p_size % 2 = 0 THEN 'number' ELSE 'any' END AS type, CASE WHEN p_size % 3 = 0 THEN p_brand END AS "default",
 CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END AS description, p_size % 3 = 0 AS optional FROM part"""
O["decoded_files"] = """SELECT 'd' || doc_id || ['.py', '.js', '.java', '.tsx'][doc_id % 6 + 1] AS path, ['python', 'javascript', 'java', 'typescript'][doc_id % 6 + 1] AS language,
 length(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '[^a-zà-ÿ ]', '', 'g') END) AS n FROM documents WHERE doc_id % 6 < 4 AND length(text) <= 5000"""

TEXT = "'# ' || p_name || chr(10) || '## Architecture' || {a} || chr(10) || '{f} and [Data Flow]' || chr(10) || '{m}' || chr(10) || 'see http://' || p_brand || '/x and https://host9/y http://local:80/z'"
MARKS = "[Old Class Diagram] [image placeholder here]"
O["splice_diagrams"] = "SELECT p_partkey, " + TEXT.format(a="CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || 'A-->B' || chr(10) ELSE '' END", f="' || chr(10) || p_brand || chr(10) || '", m=MARKS) + " AS t FROM part"
O["drop_marks"] = "SELECT p_partkey, " + TEXT.format(a="''", f="[Folder Structure]", m=" ") + " AS t FROM part"
O["split_host"] = f"SELECT p_partkey, 'go to http://' || {W} || '.or/g now' AS t FROM part"
O["footers"] = "SELECT event_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '*This README was automatically generated on ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '*' || chr(10) AS footer FROM events"
O["suspicious_urls"] = "SELECT p_partkey, 'http://Brand,https://host,http://local' AS urls FROM part"
O["normalized_documents"] = """SELECT p_partkey, CASE WHEN p_size % 3 = 1 THEN 'p' || p_partkey ELSE 'Unnamed Project' END AS project, [2, 1, 0][p_size % 3 + 1]::BIGINT AS n_files, ['unknown', 'x', NULL][p_size % 3 + 1] AS path,
 CASE WHEN p_size % 3 = 0 THEN 'unnamed' END AS function, CASE WHEN p_size % 3 = 0 THEN 'No description provided.' END AS description, CASE WHEN p_size % 3 = 0 THEN 'unnamed|int|No description available.' ELSE '' END AS parameter,
 CASE WHEN p_size % 3 = 0 THEN 'void|No return value.' ELSE '' END AS returns, CASE WHEN p_size % 3 = 1 THEN 'UnnamedClass|m|str|No return value.' ELSE '' END AS method, CASE WHEN p_size % 3 = 0 THEN 'unnamed' ELSE '' END AS warnings FROM part"""

NL = "chr(10)"
O["architecture_diagram"] = """WITH e AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_brand || '/' || p_partkey || '.py' AS t FROM part WHERE p_size <= 10 ORDER BY p_partkey LIMIT 3)
 SELECT '```mermaid' || chr(10) || 'graph TD' || chr(10) || (SELECT string_agg('    Entry' || i || '["' || t || '<br/>(api)"]', chr(10) ORDER BY i) FROM e) || chr(10) || '    Model["📊 Model Layer"]' || chr(10) || '    Controller["🎮 Controller Layer"]' || chr(10)
  || '    Entry0 --> Controller' || chr(10) || '    Controller --> Model' || chr(10) || '```' AS content"""
O["data_flow_diagram"] = """SELECT '```mermaid' || chr(10) || 'flowchart LR' || chr(10) || '    Input["📥 Input<br/>(User/API/File)"]' || chr(10) || '    Entry["🚪 run_' || (SELECT max(p_partkey) FROM part) || '.py"]' || chr(10) || '    Input --> Entry' || chr(10)
 || '    Process["⚙️ Processing<br/>(Business Logic)"]' || chr(10) || '    Entry --> Process' || chr(10) || '    Storage["💾 Data Storage<br/>(Database)"]' || chr(10) || '    Process --> Storage' || chr(10) || '    Storage --> Process' || chr(10)
 || '    Output["📤 Output<br/>(Response/File/Report)"]' || chr(10) || '    Process --> Output' || chr(10) || '```' AS content"""
O["folder_diagram"] = f"""WITH {PAGES}, shallow AS (SELECT *, dense_rank() OVER (ORDER BY depth) AS dr FROM dirs),
 picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY depth ORDER BY first_ord, dir) AS rk FROM shallow WHERE dr <= 2) WHERE rk <= 8),
 nodes AS (SELECT *, row_number() OVER (ORDER BY depth, rk) AS node, regexp_replace(dir, '/?[^/]*$', '') AS parent FROM picked)
 SELECT '```mermaid' || chr(10) || 'graph TD' || chr(10) || '    Root["📁 Project Root"]' || chr(10) || string_agg('    Dir' || a.node || '["' || string_split(a.dir, '/')[-1] || '<br/><small>Pages</small>"]' || chr(10) || '    '
  || CASE WHEN b.node IS NULL THEN 'Root' ELSE 'Dir' || b.node END || ' --> Dir' || a.node, chr(10) ORDER BY a.node) || chr(10) || '```' AS content FROM nodes a LEFT JOIN nodes b ON a.parent = b.dir"""
O["class_diagram"] = """SELECT '```mermaid' || chr(10) || 'classDiagram' || chr(10) || string_agg('    class Box{' || chr(10) || '        +int size' || chr(10) || '        +_low() ' || chr(10) || '        +open() ' || chr(10) || '        +shown() ' || chr(10) || '    }' || chr(10) || '    Base <|-- Box', chr(10)) || chr(10) || '```' AS content
 FROM (SELECT 1 FROM part LIMIT 8)"""
O["class_map"] = """WITH b AS (SELECT p_brand AS name, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS i, '.../c/d/' || name AS label FROM b),
 l AS (SELECT *, 'C_' || regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') || '_' || i AS own, 'CF_' || regexp_replace(label, '[^A-Za-z0-9_]', '_', 'g') || '_' || i AS file FROM r)
 SELECT 'flowchart LR' || chr(10) || '  subgraph TopClasses[Top Classes by Methods]' || chr(10) || string_agg('    ' || own || '["' || name || ' (' || n || ')"]' || chr(10) || '    ' || file || '["' || label || '"]' || chr(10) || '    ' || own || ' --> ' || file, chr(10) ORDER BY i)
  || chr(10) || '  end' AS content FROM l"""
O["structure_diagram"] = """WITH f AS (SELECT replace(p_brand, '#', '_') AS top, p_partkey AS k, 'f' || lpad(p_partkey::VARCHAR, 6, '0') || '.py' AS name FROM part),
 c AS (SELECT top, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, top) AS rank, count(*) OVER () AS all_ FROM f GROUP BY 1),
 g AS (SELECT CASE WHEN all_ > 8 AND rank >= 8 THEN '…other' ELSE top END AS top, sum(n)::BIGINT AS n, least(rank, 8) AS rank FROM c GROUP BY 1, 3),
 m AS (SELECT g.rank, row_number() OVER (PARTITION BY f.top ORDER BY k) AS i, f.top, f.name, g.n FROM f JOIN g ON g.top = f.top),
 l AS (SELECT rank, 0 AS i, '  subgraph SG_' || regexp_replace(top, '[^A-Za-z0-9_]', '_', 'g') || '[' || top || ']' AS line FROM g
  UNION ALL SELECT rank, 1000, '  end' FROM g
  UNION ALL SELECT rank, i, '    F_' || top || '_' || i || '["' || top || '/' || name || '"]' || chr(10) || '    ROOT_demo --> F_' || top || '_' || i FROM m WHERE i <= 10
  UNION ALL SELECT rank, 11, '    MORE_' || top || '["… +' || (n - 10) || ' more"]' || chr(10) || '    ROOT_demo --> MORE_' || top FROM g WHERE n > 10 AND top <> '…other'
  UNION ALL SELECT rank, 1, '    F__other_1["... ' || n || ' files"]' || chr(10) || '    ROOT_demo --> F__other_1' FROM g WHERE top = '…other')
 SELECT 'flowchart TD' || chr(10) || '  ROOT_demo[demo]' || chr(10) || string_agg(line, chr(10) ORDER BY rank, i) AS content FROM l"""
