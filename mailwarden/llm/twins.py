"""DuckDB twins of the operators that SQL can express, written from the contracts: all windows, all pairs."""
from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def _components(nodes: str, links: str, key: str) -> str:
    """CTEs: ``links`` has (a, b) in both directions; ``parts`` has the least node that each one reaches."""
    return f"""reach AS (SELECT {key} AS a, {key} AS b FROM {nodes} UNION SELECT r.a, l.b FROM reach r JOIN {links} l ON l.a = r.b),
parts AS (SELECT a AS {key}, min(b) AS component_id FROM reach GROUP BY a)"""


OP2 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w),
wins AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts),
least AS (SELECT h, min(doc_id) AS m FROM wins GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM wins JOIN least USING (h) WHERE m < doc_id),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
cut AS (SELECT p.doc_id, count(g.j) AS n_removed, string_agg(word, ' ' ORDER BY p.j) FILTER (g.j IS NULL) AS kept
        FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.j = g.j GROUP BY p.doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN cut USING (doc_id)"""

OP7 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
firsts AS (SELECT d, min(page_id) AS o FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN o < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN o < page_id THEN o END::BIGINT AS refers_to
FROM p LEFT JOIN firsts USING (d)"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id
          AND list_cosine_similarity(x.e, y.e) >= 0.95),
{_components('v', 'links', 'vec_id')},
n AS (SELECT a AS vec_id, count(*) AS k FROM links GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id = component_id AS kept
FROM parts LEFT JOIN n USING (vec_id)"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, sha256(array_to_string(ws[i:i + 2], ' ')) AS h
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
links AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id
          JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
          GROUP BY x.doc_id, y.doc_id, p.k, q.k HAVING 100 * count(*) >= 90 * (p.k + q.k - count(*))),
{_components('w', 'links', 'doc_id')}
SELECT doc_id, coalesce(k, 0)::BIGINT AS n_shingles, component_id::BIGINT AS component_id
FROM parts LEFT JOIN n USING (doc_id)"""

#: CRC-32 of a decimal id, bit by bit: a byte is xor-ed in, each -1 shifts once.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]
  FOR x IN string_split(conv_id::VARCHAR, '')])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
  ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295::BIGINT)"""

OP12 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS pos FROM t),
own AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY pos) AS turns FROM p GROUP BY conv_id),
shift AS (SELECT *, {_CRC} % 6 AS h FROM own),
built AS MATERIALIZED (SELECT s.conv_id, list_concat(coalesce(b.turns[1:s.h], []), s.turns[s.h + 1:]) AS turns
          FROM shift s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 100),
spread AS (SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM built),
seen AS (SELECT conv_id, n, depth, turns[1:depth] AS prefix FROM spread),
node AS MATERIALIZED (SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
         FROM seen GROUP BY prefix, depth),
linked AS (SELECT c.*, q.conv_id AS parent_conv_id, CASE WHEN c.depth > 0 THEN length(c.prefix[c.depth].t) ELSE 0 END AS chars
           FROM node c LEFT JOIN node q ON q.depth = c.depth - 1 AND q.prefix = c.prefix[1:c.depth - 1] AND c.depth > 0),
child AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS k FROM linked WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT l.*, coalesce(k, 0) AS n_children FROM linked l LEFT JOIN child USING (conv_id, depth)),
below AS (SELECT a.conv_id, a.depth, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars) AS saved_tokens
          FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_node) u JOIN node a ON a.depth = u.d AND a.prefix = u.prefix[1:u.d]
          GROUP BY a.conv_id, a.depth)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM full_node JOIN below USING (conv_id, depth)"""

SQL = {"op12_conversation_trie": OP12, "op2_substring_dedup": OP2, "op3_embedding_dedup": OP3, "op7_warc_revisit": OP7, "op10_jaccard_join": OP10}
