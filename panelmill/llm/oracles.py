"""DuckDB statements of the results that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP = f"""
WITH line AS (
  SELECT doc_id, pos, lines[pos] AS line,
         trim(translate(lines[pos], '{_UPPER}', '{_LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
often AS (SELECT key FROM line WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.key IS NULL), '')) AS kept_sha256
FROM line LEFT JOIN often o ON line.key = o.key GROUP BY doc_id
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CONTAMINATION = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS wl, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS j FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT wl FROM win),
span AS (
  SELECT doc_id, wl, j, array_to_string(w[j:j + wl - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, wl, unnest(range(1, len(w) - wl + 2)) AS j FROM doc, lengths WHERE len(w) >= wl)),
hit AS (SELECT doc_id, j, wl, item_id FROM span JOIN win USING (wl, phrase)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit
          FROM (SELECT doc_id, unnest(range(j, j + wl)) AS pos FROM hit) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN names USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[j:j + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS j FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS node, doc_id AS root FROM doc
  UNION
  SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node),
found AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc.doc_id, coalesce(n, 0) AS n_shingles, component_id, doc.doc_id = component_id AS kept
FROM doc LEFT JOIN size USING (doc_id) JOIN found ON found.node = doc.doc_id
"""

VECTOR_DUPLICATES = """
WITH RECURSIVE vec AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
good AS (
  SELECT vec_id, e FROM vec
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS node, vec_id AS root FROM vec
  UNION
  SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node),
found AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM vec LEFT JOIN n ON a = vec_id JOIN found ON node = vec_id
"""

PREFIX_TRIE = """
WITH own AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
head AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM own),
built AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:h], o.turns[h + 1:]) AS seq
  FROM head o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5),
prefix AS (
  SELECT conv_id, d, seq[1:d] AS p, coalesce(strlen(seq[d].t), 0) AS bytes, d = len(seq) AS is_end
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM built)),
node AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256
  FROM prefix GROUP BY p, d),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
flagged AS (SELECT node.*, coalesce(c.n, 0) AS n_children FROM node LEFT JOIN children c ON c.p = node.p),
below AS (
  SELECT p[1:a] AS p, sum((n - 1) * bytes) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM flagged) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM flagged f JOIN below b ON b.p = f.p LEFT JOIN flagged u ON f.d > 0 AND u.p = f.p[1:f.d - 1]
"""

MERKLE = """
WITH doc AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WINDOW w AS (ORDER BY doc_id)),
edit AS (
  SELECT doc_id, text, next, length(text) AS n, CAST(floor(length(text) / 4) AS BIGINT) AS q FROM doc),
texts AS (
  SELECT doc_id, 'own' AS kind, text FROM doc
  UNION ALL SELECT doc_id, 'next', next FROM doc
  UNION ALL SELECT doc_id, 'edited', substring(text, 1, n - q) || substring(next, 1, q) FROM edit),
lines AS (SELECT *, string_split(text, chr(10)) AS line FROM texts),
hashed AS (
  SELECT *, list_transform(line, lambda x: sha256('p:' || x)) AS ph,
         list_distinct(flatten(list_transform(line, lambda x: regexp_extract_all(x, ' *(?:[^ ]{1,64} *){1,8}| +')))) AS pieces FROM lines),
cut AS (
  SELECT *, list_filter(range(1, len(line) + 1), lambda i: i = len(line) OR ph[i] < '2'
                        OR trim(line[i], ' ' || chr(9) || chr(13)) = '') AS ends FROM hashed),
sections AS (
  SELECT *, list_transform(range(1, len(ends) + 1), lambda j: sha256('s:' || array_to_string(
    ph[(CASE WHEN j = 1 THEN 1 ELSE ends[greatest(j - 1, 1)] + 1 END):ends[j]], ''))) AS sh FROM cut),
tree AS (SELECT doc_id, kind, text, sha256('r:' || array_to_string(sh, '')) AS root, pieces FROM sections),
near AS (
  SELECT a.doc_id, b.kind, CASE WHEN a.root = b.root THEN 1.0::DOUBLE
         WHEN len(a.pieces) + len(b.pieces) = 0 THEN 0.0::DOUBLE
         ELSE len(list_intersect(a.pieces, b.pieces)) / (len(a.pieces) + len(b.pieces) - len(list_intersect(a.pieces, b.pieces)))::DOUBLE END AS near
  FROM tree a JOIN tree b ON a.doc_id = b.doc_id WHERE a.kind = 'own' AND b.kind <> 'own')
SELECT o.doc_id, length(o.text) AS n_chars, sha256(e.text) AS edited_sha256, o.root AS fingerprint, e.root AS edited_fingerprint,
       ne.near AS near_edited, nn.near AS near_next
FROM tree o JOIN tree e ON e.doc_id = o.doc_id AND e.kind = 'edited'
JOIN near ne ON ne.doc_id = o.doc_id AND ne.kind = 'edited' JOIN near nn ON nn.doc_id = o.doc_id AND nn.kind = 'next'
WHERE o.kind = 'own'
"""

COLLOCATIONS = f"""
WITH piece AS (
  SELECT lang, regexp_extract_all(p, '[^ \\t]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM piece GROUP BY lang),
gram AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 30),
candidate AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram WHERE k > 1),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.j, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * c.a) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate) c
  JOIN gram l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j], ' ')
  JOIN gram r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
around AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM candidate, (VALUES (2), (3)) t(m) WHERE m < k) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best JOIN total USING (lang) LEFT JOIN around USING (lang, phrase)
WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a
QUALIFY rank <= 2000
"""
