"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone
  FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
         WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
shingles AS (SELECT doc_id, md5_number_lower(x) AS h FROM (SELECT doc_id, unnest(s) AS x FROM sets)),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT p.a, p.b FROM pairs p JOIN sets x ON x.doc_id = p.a JOIN sets y ON y.doc_id = p.b
  WHERE 100 * common >= 75 * (len(x.s) + len(y.s) - common)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.b) AS component_id, min(r.b) = s.doc_id AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

OP9 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP11 = r"""
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM docs) GROUP BY ALL),
held AS (SELECT lang, term, count(*) AS docs FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term FROM held WHERE docs >= 10),
sizes AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
own AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM dense JOIN sizes USING (lang)),
whole AS (
  SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL) JOIN sizes USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
words AS (
  SELECT o.lang, o.source, 'term' AS part, o.term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
  FROM own o JOIN whole w ON w.lang = o.lang AND w.term = o.term WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


OP13 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
blocked AS (
  SELECT *, coalesce(turn >> 10, -(1::BIGINT << 62)) AS block, 4 + (length(text) + 3) // 4 AS cost,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth,
         12 + 10 + 10 + length(role) + length(text) + length(role || text) - length(replace(role || text, '\', ''))
         + len(regexp_extract_all(role, '<\|(im_start|im_sep|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>'))
         + len(regexp_extract_all(text, '<\|(im_start|im_sep|im_end|endoftext)\|>|</?s>|\[/?INST\]|<</?SYS>>')) AS chars
  FROM turns),
led AS (
  SELECT *, nth = 1 AND role = 'system' AS lead,
         max(CASE WHEN nth = 1 AND role = 'system' THEN cost ELSE 0 END) OVER (PARTITION BY conv_id) AS kept,
         max(CASE WHEN nth = 1 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS kept_chars
  FROM blocked),
costed AS (SELECT *, CASE WHEN lead THEN 0 ELSE cost END AS c, greatest(1024 - kept, 1) AS room FROM led),
summed AS (
  SELECT *, greatest(room // 2, 1) AS half,
         coalesce(sum(c) OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         coalesce(sum(c) OVER (PARTITION BY conv_id, block ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
  FROM costed),
flagged AS (
  SELECT *, CASE WHEN lead THEN -1 ELSE before END AS g,
         CASE WHEN lag(nth) OVER w IS NULL THEN 1 WHEN lag(lead) OVER w THEN 0
              WHEN c > half OR lag(c > half) OVER w OR spent // half <> lag(spent // half) OVER w THEN 1 ELSE 0 END AS cut
  FROM summed WINDOW w AS (PARTITION BY conv_id, block ORDER BY nth)),
spans AS (SELECT *, sum(cut) OVER (PARTITION BY conv_id ORDER BY nth) AS k FROM flagged),
wins AS (
  SELECT conv_id, k, min(g) AS start, sum(c) AS new, min(room) AS room, min(kept_chars) AS kept_chars FROM spans GROUP BY ALL),
again AS (
  SELECT w.conv_id, sum(s.chars) AS chars FROM wins w JOIN spans s ON s.conv_id = w.conv_id AND s.g >= 0 AND s.g < w.start
    AND s.g >= w.start - greatest(least(256, w.room - w.new), 0) GROUP BY 1),
led_in AS (SELECT conv_id, sum(kept_chars) AS chars FROM wins WHERE start >= 0 GROUP BY 1),
said AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY nth), '') AS learnt
  FROM spans GROUP BY 1)
SELECT s.conv_id, n_turns, turns_sha256, length(learnt)::BIGINT AS loss_chars, sha256(learnt) AS loss_sha256,
       (s.chars + coalesce(a.chars, 0) + coalesce(l.chars, 0))::BIGINT AS formatted_chars
FROM said s LEFT JOIN again a ON a.conv_id = s.conv_id LEFT JOIN led_in l ON l.conv_id = s.conv_id
"""


def _op12(rounds: int = 4) -> str:
    """Plain Lloyd rounds, a pair of CTEs each."""
    sql = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS n, len(v) // 4 AS w FROM kept),
parts AS MATERIALIZED (SELECT n, vec_id, label, p, v[p * w + 1:(p + 1) * w] AS x FROM numbered, range(4) AS r(p)),
book0 AS MATERIALIZED (SELECT p, n - 1 AS entry, x AS z FROM parts WHERE n <= 256),"""
    for k in range(rounds + 1):
        sql += f"""
near{k} AS MATERIALIZED (
  SELECT n, p, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
    SELECT a.n, a.p, a.x, b.entry, list_sum(list_transform(list_zip(a.x, b.z), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d
    FROM parts a JOIN book{k} b ON a.p = b.p) GROUP BY n, p, x),"""
        if k < rounds:
            sql += f"""
sums{k} AS (
  SELECT p, entry, place, sum(c)::BIGINT AS s, count(*) AS m FROM (
    SELECT p, entry, unnest(x) AS c, generate_subscripts(x, 1) AS place FROM near{k}) GROUP BY ALL),
new{k} AS (SELECT p, entry, list((s - ((s % m) + m) % m) // m ORDER BY place) AS z FROM sums{k} GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(n.z, b.z) AS z FROM book{k} b LEFT JOIN new{k} n ON n.p = b.p AND n.entry = b.entry),"""
    return sql + f"""
digest AS (
  SELECT sha256(string_agg(c, ',' ORDER BY p, entry, place)) AS codebooks_sha256 FROM (
    SELECT p, entry, unnest(z)::VARCHAR AS c, generate_subscripts(z, 1) AS place FROM book{rounds})),
coded AS (
  SELECT n, string_agg(lower(printf('%02x', entry::INTEGER)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY n)
SELECT k.vec_id, k.label, code, error, (sum(error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256
FROM numbered k JOIN coded USING (n), digest
"""


ORACLE_SQL = {"op2_line_dedup": OP2, "op8_near_dedup": OP8, "op9_topk": OP9, "op11_divergence": OP11, "op12_codes": _op12(), "op13_chat": OP13}
