"""SQL, for a second engine, of the training-data queries that SQL can express."""

from __future__ import annotations

from .sharding import PRIME, round_keys

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

TOP_K = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM x q JOIN x c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

# Links are counted over all pairs that share a shingle; labels spread along them until the least id has gone everywhere.
NGRAM_JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT w.doc_id, count(g.s) AS n_shingles FROM w LEFT JOIN g USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n_shingles + y.n_shingles - k)),
c AS (SELECT doc_id, doc_id AS seen FROM n UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.seen)
SELECT n.doc_id, n.n_shingles, m.component_id FROM n JOIN (SELECT doc_id, min(seen) AS component_id FROM c GROUP BY doc_id) m USING (doc_id)"""

# Words that fewer sets hold come first; similar sets share one of their first words, and the words of both decide.
LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, i, line, list_sort(list_distinct({_WORDS.format('lower(line)')})) AS ws FROM l),
c AS (SELECT row_number() OVER (ORDER BY min((doc_id, i))) AS c, ws, min((doc_id, i)) AS first_at, len(ws) AS n FROM t WHERE len(ws) > 0 GROUP BY ws),
u AS (SELECT c, n, unnest(ws) AS w FROM c),
f AS (SELECT w, count(*) AS k FROM u GROUP BY w),
o AS (SELECT c, n, w, row_number() OVER (PARTITION BY c ORDER BY k, w) AS place FROM u JOIN f USING (w)),
q AS (SELECT * FROM o WHERE place <= n - ceil(0.8 * n)::INTEGER + 1),
m AS (SELECT DISTINCT x.c AS x, y.c AS y FROM q x JOIN q y ON x.w = y.w AND x.c < y.c AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
d AS (SELECT DISTINCT y FROM m JOIN c a ON a.c = m.x JOIN c b ON b.c = m.y WHERE 100 * len(list_intersect(a.ws, b.ws)) >= 80 * (a.n + b.n - len(list_intersect(a.ws, b.ws)))),
v AS (SELECT t.doc_id, t.i, t.line, c.c IS NULL OR (c.first_at = (t.doc_id, t.i) AND c.c NOT IN (SELECT y FROM d)) AS stays FROM t LEFT JOIN c ON c.ws = t.ws AND c.n > 0),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays) AS text, count(*)::INTEGER AS n_lines, count(*) FILTER (WHERE NOT stays)::INTEGER AS n_removed FROM v GROUP BY doc_id)
SELECT z.doc_id, CASE WHEN z.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0)::INTEGER AS n_lines, coalesce(k.n_removed, 0)::INTEGER AS n_removed FROM documents z LEFT JOIN k USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {"op3_line_dedup": LINE_DEDUP, "op6_exact_top_k": TOP_K, "op10_ngram_jaccard": NGRAM_JACCARD}


def _passes(source: str) -> str:
    """One pass of the permutation over p in a relation (id, size, crc, p, n, a, b), one nested SELECT a round."""
    keep = "doc_id, size, text_crc32, n, a, b"
    out = f"(SELECT {keep}, p % a AS l, p // a AS r FROM {source})"
    for i, (k1, k2) in enumerate(round_keys(42)):
        here, there, side = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
        once = f"(SELECT *, ({here} + {k1}) % {PRIME} AS s FROM {out})"
        twice = f"(SELECT * EXCLUDE (s), (s * s + {k2}) % {PRIME} AS s FROM {once})"
        out = f"(SELECT * EXCLUDE (s, {there}), ({there} + (s * s) % {PRIME}) % {side} AS {there} FROM {twice})"
    return f"SELECT {keep}, l + a * r AS p FROM {out}"


SHARDING = f"""
WITH RECURSIVE polynomial AS (SELECT list_transform(range(256), lambda v: list_reduce([v] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
octets AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS o FROM documents),
sums AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce([4294967295] || o, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM octets, polynomial),
total AS (SELECT count(*) AS n FROM documents),
side AS (SELECT n, a, greatest(1, ceil(n / a)::BIGINT) AS b FROM (SELECT n, (floor(sqrt(greatest(n - 1, 0))) + 1)::BIGINT AS a FROM total)),
numbered AS (SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS p, n, a, b FROM sums, side),
walk AS ({_passes("numbered")} UNION ALL {_passes("(SELECT * FROM walk WHERE p >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (p % 16)::INTEGER AS shard, (p // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM walk WHERE p < n"""

ORACLE_SQL["op5_sharding"] = SHARDING

# For pages whose text stands in one article element without inner menus, forms or comments, as in the test tables.
HTML_ARTICLES = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS body FROM pages),
t AS (SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS body FROM a),
e AS (SELECT page_id, url, replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS body FROM t)
SELECT page_id, url, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(body, '\s+', ' ', 'g'))) AS n_chars FROM e"""

ORACLE_SQL["op8_html_extraction"] = HTML_ARTICLES
