"""DuckDB SQL for the queries that SQL can express."""

from precedent.llm.secret_scan import KINDS, PATTERNS, SCOPE, SHORTEST

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_SQL = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

NEAR_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
         WHERE 100 * n_both >= 75 * (na.n + nb.n - n_both)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


def secret_sql(scope: int = SCOPE) -> str:
    """The spans of secret_scan: matches and the texts between them give offsets, weak
    parts meet within ``scope`` code points."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, unnest(regexp_extract_all(t, {lit(p)})) AS m, "
        f"unnest(string_split_regex(t, {lit(p)})[:len(regexp_extract_all(t, {lit(p)}))]) AS g, "
        f"generate_subscripts(regexp_extract_all(t, {lit(p)}), 1) AS i FROM d"
        for k, p in enumerate(PATTERNS[x] for x in KINDS))
    names = "[" + ", ".join(lit(k) for k in KINDS) + "]"
    listed = f"string_agg({names}[kind + 1] || ':' || a || ':' || b, ',' ORDER BY a, kind)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({kinds}),
p AS (SELECT doc_id, kind, m, len(m) AS n, sum(len(g) + len(m)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS b FROM m),
every AS (SELECT doc_id, kind, b - n AS a, b FROM p WHERE kind <> 0 OR len(regexp_extract(m, {lit(PATTERNS['assign'])}, 2)) >= {SHORTEST}),
shown AS (SELECT * FROM every w WHERE kind < 3 OR NOT EXISTS (
  SELECT 1 FROM every c WHERE c.doc_id = w.doc_id AND c.kind < 3 AND c.a < w.b AND w.a < c.b)),
linked AS (
  SELECT w.doc_id, w.kind, w.a, w.b FROM shown w JOIN shown p ON p.doc_id = w.doc_id AND w.kind >= 3
    AND p.a <= w.b + {scope} AND w.a <= p.b + {scope} AND NOT (p.kind = w.kind AND p.a < w.b AND w.a < p.b)
  GROUP BY ALL HAVING CASE w.kind WHEN 3 THEN bool_or(p.kind IN (0, 2, 4)) WHEN 4 THEN bool_or(p.kind IN (1, 3))
    ELSE bool_or(p.kind IN (0, 2, 4)) AND bool_or(p.kind IN (1, 3)) END),
s AS (SELECT * FROM every WHERE kind < 3 UNION ALL SELECT * FROM linked),
r AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        count(*) FILTER (kind > 2) AS n_linked, {listed} FILTER (kind < 3) AS base, {listed} AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(n_linked, 0) AS n_linked, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (doc_id)
"""


SECRET_SQL = secret_sql()

#: crc32 bit by bit: eight steps a byte, of which the first takes the byte in.
VARIANTS_SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(""" + _LOWER + r""", '[a-z\x{C0}-\x{FF}]{7,}')) AS w FROM documents),
x AS (SELECT w, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r),
c AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(len(x) // 2),
      lambda i: [('0x' || x[2 * i + 1:2 * i + 2])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END), 4294967295) AS h FROM x),
o AS (SELECT CASE WHEN h % 31 = 0 THEN w[1:h % len(w)] || w[h % len(w) + 2:] ELSE w END AS word FROM c),
v AS (SELECT word, count(*) AS n FROM o WHERE len(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS i FROM v)),
near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, v.word FROM cut a JOIN v ON v.word = a.rest
  UNION SELECT v.word, a.word FROM cut a JOIN v ON v.word = a.rest),
top AS (SELECT a, count(*) AS n_near, max(n) AS top_n, first(b ORDER BY n DESC, b) AS top FROM near JOIN v ON v.word = b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * n THEN top END AS form,
        CASE WHEN top_n >= 10 * n THEN top_n END AS form_n FROM v LEFT JOIN top ON a = word),
chain AS (SELECT word, word AS last, 0 AS step FROM f UNION ALL
          SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN root USING (word)
"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
