"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

DECONTAMINATE = r"""
WITH tw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + 9) AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM tw, sizes WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, q.item FROM pos p JOIN win q ON p.n = q.n AND p.g = q.g),
cover AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AS contaminated
FROM tw t LEFT JOIN cover c USING (doc_id) LEFT JOIN items m USING (doc_id)
"""


JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + 3) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""


EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON r.vec_id = l.x),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.c) AS component_id, min(r.c) = r.vec_id AS kept
FROM r LEFT JOIN n USING (vec_id) GROUP BY r.vec_id
"""


LINES = """
WITH l AS (
  SELECT doc_id, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
d AS (SELECT line, length(line) AS n, min(row(doc_id, pos)) AS o FROM l WHERE trim(line) <> '' GROUP BY line),
k AS (
  SELECT *, c AS size, c // 2 AS h FROM (SELECT *, n AS c FROM d WHERE n >= 20 UNION ALL SELECT *, n + 1 FROM d WHERE n >= 20)),
near AS (
  SELECT a.line FROM k a JOIN k b ON a.size = b.size AND left(a.line, a.h) = left(b.line, b.h)
  WHERE b.o < a.o AND a.line <> b.line AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1
  UNION
  SELECT a.line FROM k a JOIN k b ON a.size = b.size AND right(a.line, a.size - a.h - 1) = right(b.line, b.size - b.h - 1)
  WHERE b.o < a.o AND a.line <> b.line AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1),
keep AS (SELECT o FROM d WHERE line NOT IN (SELECT line FROM near)),
j AS (SELECT l.*, trim(l.line) = '' AS blank, keep.o IS NOT NULL AS kept FROM l LEFT JOIN keep ON keep.o = row(l.doc_id, l.pos)),
t AS (
  SELECT doc_id, count(*) FILTER (NOT blank) AS n_lines, count(*) FILTER (kept) AS n_kept,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (blank OR kept), '') AS left_text FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_kept, 0)::BIGINT AS n_kept,
  length(left_text)::BIGINT AS n_chars_left, sha256(left_text) AS text_sha256
FROM documents d LEFT JOIN t USING (doc_id)
"""


#: The table of the crc32 polynomial (a fixed value), and the crc32 of a list of bytes ``{0}``.
CRC_TABLE = """
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
  lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab)"""
CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], {0}), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295)"
DIGITS = "list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda d: ascii(d)::BIGINT)"

ASOF = f"""
WITH {CRC_TABLE},
c AS (SELECT click_id, client_id, epoch_us(ts) AS t FROM (SELECT DISTINCT click_id, client_id, ts FROM clicks)),
k AS (
  SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN t - t % 21600000000 ELSE t END AS t
  FROM (SELECT *, {CRC.format(DIGITS.format("click_id"))} AS h FROM c, crc)),
s AS (
  SELECT sale_id, client_id, CASE WHEN h % 2 = 1 THEN t - t % 21600000000 ELSE t END AS t, cents, h % 3 <> 0 AS twice
  FROM (SELECT sale_id, client_id, epoch_us(sold_at) AS t, CAST(floor(100 * total + 0.5) AS BIGINT) AS cents,
    {CRC.format(DIGITS.format("sale_id"))} AS h FROM sales, crc)),
o AS (SELECT sale_id, client_id, t, cents FROM s UNION ALL SELECT -1 - sale_id, client_id, t, cents FROM s WHERE twice),
w AS (
  SELECT *, count(*) OVER (PARTITION BY client_id, t) AS n_tied,
    row_number() OVER (PARTITION BY client_id, t ORDER BY cents DESC NULLS LAST, sale_id DESC NULLS LAST) AS r
  FROM o WHERE client_id IS NOT NULL AND t IS NOT NULL)
SELECT k.click_id, k.client_id, k.t AS ts_us,
  CASE WHEN k.t - w.t <= 2592000000000 THEN w.sale_id END AS sale_id,
  CASE WHEN k.t - w.t <= 2592000000000 THEN k.t - w.t END AS lag_us,
  CASE WHEN k.t - w.t <= 2592000000000 THEN w.cents END AS total_cents,
  CASE WHEN k.t - w.t <= 2592000000000 THEN w.n_tied ELSE 0 END AS n_tied
FROM k ASOF LEFT JOIN (SELECT * FROM w WHERE r = 1) w ON k.client_id = w.client_id AND k.t >= w.t
"""


UTF8 = "flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))"

SPELLING = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
    FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, {CRC.format(UTF8.format("CAST(doc_id AS VARCHAR) || ':' || run"))} AS h FROM r, crc),
v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word AS a, b.word AS b, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
s AS (SELECT a AS word, count(*) AS n_near, min(row(-n, b)) AS best FROM p GROUP BY a),
f AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best[1] >= 5 * v.n THEN best[2] END AS form,
    CASE WHEN -best[1] >= 5 * v.n THEN (-best[1])::BIGINT END AS form_n
  FROM v LEFT JOIN s USING (word)),
t(word, root) AS (
  SELECT word, word FROM f WHERE form IS NULL
  UNION ALL SELECT f.word, t.root FROM t JOIN f ON f.form = t.word)
SELECT f.word, f.form, t.root, f.n, f.n_near, f.form_n FROM f JOIN t USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_decontaminate": DECONTAMINATE, "op10_ngram_jaccard": JACCARD, "op5_embedding_near_dedup": EMBEDDINGS, "op1_line_dedup": LINES, "op12_tolerant_asof": ASOF, "op13_spelling_variants": SPELLING}
