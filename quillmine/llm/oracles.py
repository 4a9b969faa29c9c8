"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from quillmine.llm.common import LOWER, UPPER

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


DECONTAMINATION = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({ascii_lower("coalesce(text, '')")}, '{WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({ascii_lower("coalesce(text, '')")}, '{WORD}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s:s + 9], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
grams AS (SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS gram
  FROM (SELECT w.*, l.n, unnest(range(1, len(ws) - l.n + 2)) AS s FROM w, (SELECT DISTINCT n FROM win) l)),
found AS (SELECT g.doc_id, g.s, g.n, x.item_id FROM grams g JOIN win x USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM found) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY 1),
dw AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w),
bw AS (SELECT item_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS o FROM b WHERE len(ws) >= 10),
met AS (SELECT DISTINCT item_id, n, doc_id, pos - o - late AS s, o, pos FROM bw JOIN dw USING (word), (VALUES (0), (1)) v(late)),
enough AS (SELECT * FROM met SEMI JOIN (SELECT item_id, doc_id, s FROM met GROUP BY ALL HAVING count(DISTINCT o) >= 9) USING (item_id, doc_id, s)),
inwin AS (SELECT *, unnest(range(greatest(o - 9, 0), least(o, n - 10) + 1)) AS i FROM enough),
nearwin AS (SELECT item_id, doc_id, s, i FROM inwin GROUP BY ALL HAVING count(DISTINCT o) >= 9),
part AS (SELECT DISTINCT item_id, doc_id, pos FROM inwin JOIN nearwin USING (item_id, doc_id, s, i)),
near AS (SELECT doc_id, count(DISTINCT pos) AS n_near FROM part GROUP BY 1),
nearnamed AS (SELECT doc_id, count(*) AS n_near_items, string_agg(item_id, ',' ORDER BY item_id) AS near_items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM part) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0) AS n_near, coalesce(n_near_items, 0) AS n_near_items, sha256(coalesce(near_items, '')) AS near_items_sha256
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id) LEFT JOIN nearnamed USING (doc_id)"""

#: No page of the tables declares an alias, so a page without a rule is allowed.
URL_VERDICTS = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {ascii_lower("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, string_split(trim(regexp_replace(piece, '[ \t]+', ' ', 'g'), ' '), ' ') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents WHERE text IS NOT NULL)
  WHERE regexp_matches(piece, '[^ \t]')),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)
  GROUP BY ALL),
sums AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= 10),
held AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM candidates WHERE k = 3) GROUP BY ALL),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.j, x.f AS l, y.f AS r,
         (1000000::HUGEINT * c.a::HUGEINT * c.a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.lp JOIN grams y ON y.lang = c.lang AND y.phrase = c.rp),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT w.* FROM worst w LEFT JOIN held h ON h.lang = w.lang AND h.part = w.phrase
  WHERE h.most IS NULL OR 100 * h.most < 50 * w.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN sums USING (lang) WHERE rank <= 2000
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
m AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
   AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3
"""
