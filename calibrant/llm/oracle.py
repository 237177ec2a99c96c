"""SQL counterparts of the text queries that SQL can express on whole tables."""

from __future__ import annotations


EXACT_DEDUP = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""


# crc32 is spelled out, one bit of the decimal digits' bytes a step.
CONVERSATION_TRIE = """
WITH RECURSIVE digits AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR AS d FROM conversations WHERE conv_id IS NOT NULL
), crc(conv_id, d, bits, c) AS (
  SELECT conv_id, d, 0, xor(4294967295::BIGINT, ascii(d)::BIGINT) FROM digits
  UNION ALL
  SELECT conv_id, d, bits + 1,
    CASE WHEN (bits + 1) % 8 = 0 AND (bits + 1) // 8 < length(d)
      THEN xor(CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, ascii(substr(d, (bits + 1) // 8 + 1, 1))::BIGINT)
      ELSE CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END END
  FROM crc WHERE bits < 8 * length(d)
), heads AS (
  SELECT conv_id, xor(c, 4294967295::BIGINT) % 6 AS h FROM crc WHERE bits = 8 * length(d)
), turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT h.conv_id, t.k, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.k <= h.h
  UNION ALL
  SELECT h.conv_id, t.k + 1000000, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.k > h.h
), placed AS (
  SELECT conv_id, length(text) AS chars, row_number() OVER w AS depth,
    list(struct_pack(r := role, t := text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), full_length AS (
  SELECT h.conv_id, coalesce(max(p.depth), 0) AS n FROM heads h LEFT JOIN placed p USING (conv_id) GROUP BY 1
), steps AS (
  SELECT p.conv_id, p.depth, sha256(p.path::VARCHAR) AS node, p.chars, p.depth = n AS last FROM placed p JOIN full_length USING (conv_id)
  UNION ALL
  SELECT conv_id, 0, '', 0, n = 0 FROM full_length
), nodes AS (
  SELECT node, any_value(depth) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM steps GROUP BY node
), links AS (
  SELECT DISTINCT c.node AS child, p.node AS parent FROM steps c JOIN steps p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM links GROUP BY 1
), inside AS (
  SELECT DISTINCT a.node AS top, b.node FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), subtrees AS (
  SELECT i.top AS node, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count(*) FILTER (c.node IS NULL) AS n_leaves
  FROM inside i JOIN nodes n ON n.node = i.node LEFT JOIN children c ON c.node = i.node GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(c.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (node) LEFT JOIN links l ON l.child = n.node LEFT JOIN nodes p ON p.node = l.parent
  LEFT JOIN children c ON c.node = n.node
"""


# Words are runs of characters other than ASCII white space. The limits are those of `quality_rules`.
QUALITY_RULES = r"""
WITH texts AS (
  SELECT row_number() OVER () AS pos, doc_id, source AS host, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT pos, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS k
  FROM texts
), counts AS (
  SELECT pos, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY pos
), windows AS (
  SELECT pos, k, list(word) OVER (PARTITION BY pos ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS w FROM words
), twice AS (
  SELECT pos, unnest(list(k)) AS k FROM windows WHERE len(w) = 8 GROUP BY pos, w HAVING count(*) > 1
), repeated AS (
  SELECT pos, count(DISTINCT p) AS n_repeat_words FROM (SELECT pos, unnest(range(k, k + 8)) AS p FROM twice) GROUP BY pos
), lines AS (
  SELECT pos, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    regexp_replace(trim(regexp_replace(lower(line), '\s+', ' ', 'g')), '\d', '0', 'g') AS normal
  FROM (SELECT pos, host, text, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), doubled AS (
  SELECT pos, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY pos
), hosts AS (
  SELECT host, count(DISTINCT text) AS docs FROM texts GROUP BY host
), often AS (
  SELECT l.host, l.normal FROM lines l JOIN hosts h ON h.host IS NOT DISTINCT FROM l.host
  GROUP BY l.host, l.normal, h.docs HAVING count(DISTINCT l.text) >= 4 AND count(DISTINCT l.text) > 0.05 * h.docs
), gone AS (
  SELECT pos, sum(n) AS n_removed_words FROM lines l JOIN often o ON o.host IS NOT DISTINCT FROM l.host AND o.normal = l.normal GROUP BY pos
), joined AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_removed_words, 0) AS gone
  FROM texts LEFT JOIN counts USING (pos) LEFT JOIN repeated USING (pos) LEFT JOIN doubled USING (pos) LEFT JOIN gone USING (pos)
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    gone > 0 AND (n_words - gone < 10 OR n_words - gone < 0.3 * n_words) AS depleted FROM joined
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, gone::BIGINT AS n_removed_words, depleted, NOT base_failed AND NOT depleted AS kept
FROM judged
"""

SUBSTRING_DEDUP = r"""
WITH texts AS (
  SELECT row_number() OVER () AS pos, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), hashed AS (
  SELECT pos, doc_id, list_transform(words, lambda w: hash(w)) AS codes FROM texts WHERE len(words) >= 50
), windows AS (
  SELECT pos, doc_id, k, hash(list_slice(codes, k, k + 49)) AS h, hash(7, list_slice(codes, k, k + 49)) AS i
  FROM (SELECT pos, doc_id, codes, unnest(range(1, len(codes) - 48)) AS k FROM hashed)
), first AS (
  SELECT h, i, min(doc_id) AS doc_id FROM windows GROUP BY h, i
), gone AS (
  SELECT DISTINCT pos, unnest(range(k, k + 50)) AS p FROM windows w JOIN first f USING (h, i) WHERE f.doc_id < w.doc_id
), per_text AS (
  SELECT pos, list(p) AS gone FROM gone GROUP BY pos
), word_rows AS (
  SELECT pos, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM texts
), kept AS (
  SELECT w.pos, string_agg(w.word, ' ' ORDER BY w.p) AS kept FROM word_rows w LEFT JOIN gone g ON g.pos = w.pos AND g.p = w.p WHERE g.pos IS NULL GROUP BY w.pos
)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(len(g.gone), 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN per_text g USING (pos) LEFT JOIN kept k USING (pos)
"""

# A text of fewer than five words has one n-gram, all of them; texts without words stand alone.
NGRAM_JACCARD_JOIN = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS pos, doc_id, list_filter(
    list_transform(regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+'), lambda w: trim(w, '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~')),
    lambda w: w <> '') AS words FROM documents
), grams AS (
  SELECT DISTINCT pos, hash(list_slice(words, k, k + 4)) AS g
  FROM (SELECT pos, words, unnest(range(1, greatest(len(words) - 3, 2))) AS k FROM texts WHERE len(words) > 0)
), sets AS (
  SELECT pos, list(g ORDER BY g) AS grams FROM grams GROUP BY pos
), classes AS (
  SELECT grams, min(t.doc_id) AS doc_id, min(t.pos) AS class, count(*) AS n_copies, any_value(len(grams)) AS n FROM sets JOIN texts t USING (pos) GROUP BY grams
), of_class AS (
  SELECT class, n, unnest(grams) AS g FROM classes
), pairs AS (
  SELECT a.class AS a, b.class AS b FROM of_class a JOIN of_class b ON a.g = b.g AND a.class <> b.class
  GROUP BY a.class, b.class, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9
), reached(class, other) AS (
  SELECT class, class FROM classes UNION SELECT r.class, p.b FROM reached r JOIN pairs p ON p.a = r.other
), least AS (
  SELECT r.class, min(c.doc_id) AS class_id FROM reached r JOIN classes c ON c.class = r.other GROUP BY r.class
), links AS (
  SELECT a AS class, count(*) AS n_links FROM pairs GROUP BY a
)
SELECT t.doc_id, coalesce(l.class_id, t.doc_id) AS class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, coalesce(c.n_copies, 1)::BIGINT AS n_copies
FROM texts t LEFT JOIN sets s USING (pos) LEFT JOIN classes c ON c.grams = s.grams LEFT JOIN least l USING (class) LEFT JOIN links k USING (class)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": QUALITY_RULES,
        "op7_substring_dedup": SUBSTRING_DEDUP,
        "op8_ngram_jaccard_join": NGRAM_JACCARD_JOIN,
        "op9_exact_dedup": EXACT_DEDUP,
        "op12_conversation_trie": CONVERSATION_TRIE,
    }
