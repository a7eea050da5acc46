"""SQL for the queries that SQL can express, written from their contracts for DuckDB."""

from __future__ import annotations

from tintshelf.llm import decontaminate, jaccard, licenses, lines, repair, variants, vectors

_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = (
    r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    rf"'{_SEP}'), lambda x: x <> '')"
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def _grams(source: str) -> str:
    """Distinct (r, m, g): word runs of each length m in the source's texts."""
    return f"""SELECT DISTINCT r, m, array_to_string(w[p : p + m - 1], ' ') AS g
      FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM {source}, (SELECT DISTINCT least({decontaminate.SHINGLE}, len(w)) AS m FROM b WHERE len(w) > 0) WHERE len(w) >= m)"""


ORACLES: dict[str, str] = {}

ORACLES["op6_decontaminate"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT row_number() OVER () AS r, item_id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
x AS ({_grams("d")}),
y AS (SELECT z.* FROM ({_grams("b")}) z JOIN b USING (r) WHERE m = least({decontaminate.SHINGLE}, len(w))),
n AS (SELECT r, count(*) AS n FROM y GROUP BY r),
i AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM x JOIN y USING (m, g) GROUP BY x.r, y.r)
SELECT doc_id, item_id, n AS n_shingles, k AS n_shared, k / n AS containment
FROM i JOIN n ON n.r = i.b JOIN d ON d.r = i.a JOIN b ON b.r = i.b WHERE k / n >= {decontaminate.CONTAINED}
"""

ORACLES["op2_license_scan"] = f"""
WITH t(template, tpos, gram, label, base, size) AS (VALUES {_values(licenses.templates())}),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, unnest(range(1, len(w))) AS p, w FROM d),
h AS (SELECT r, template, p - 1 - tpos AS diagonal, bit_or(1::BIGINT << tpos) AS mask, any_value(label) AS label, any_value(base) AS base, any_value(size) AS size
      FROM g JOIN t ON gram = w[p] || ' ' || w[p + 1] GROUP BY r, template, diagonal),
n AS (SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > {licenses.MERGE})::INT, 1) AS fresh FROM h),
m AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS run FROM n),
s AS (SELECT r, template, run, bit_count(bit_or(mask)) / any_value(size) AS share, any_value(label) AS label, any_value(base) AS base,
        count(*) FILTER (bit_count(mask) = size) AS places, min(diagonal) FILTER (bit_count(mask) = size) AS first, max(diagonal) FILTER (bit_count(mask) = size) AS last
      FROM m GROUP BY r, template, run),
f AS (SELECT r, coalesce(sum(places) FILTER (base), 0) AS n_base, min(first) FILTER (base) AS first_word, max(last) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND places > 0) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER ((base AND places > 0) OR (NOT base AND share >= {licenses.COVER})) AS labels,
        max(CASE WHEN base THEN 1.0 ELSE share END) FILTER ((base AND places > 0) OR (NOT base AND share >= {licenses.COVER})) AS score
      FROM s GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN f USING (r)
"""

ORACLES["op9_chat_format"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS turns,
    sum(24 + length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) OVER o AS upto
  FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR k = turns))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""

ORACLES["op1_line_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS w FROM documents),
a AS (SELECT r, doc_id, unnest(range(len(w))) AS i, w FROM d),
l AS (SELECT r, doc_id, i, trim(w[i + 1], ' ' || chr(9) || chr(13)) AS s, len(w) AS n FROM a),
f AS (SELECT *, row_number() OVER o AS k, coalesce(lead(i) OVER o, n) AS upto, lead(s, 1) OVER o AS s2, lead(s, 2) OVER o AS s3, coalesce(lead(i, 2) OVER o, n) AS upto2,
        coalesce(lead(i, 3) OVER o, n) AS upto3, words, lead(words) OVER o AS words2
      FROM (SELECT *, len(regexp_split_to_array(s, '[ \\t]+')) AS words FROM l) WHERE s <> '' WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, doc_id, i, upto, s AS gram FROM f WHERE words >= {lines.LONG_WORDS}
      UNION ALL SELECT r, doc_id, i, upto2, s || chr(10) || s2 FROM f WHERE greatest(words, words2) < {lines.LONG_WORDS} AND words + words2 >= {lines.LONG_WORDS}
      UNION ALL SELECT r, doc_id, i, upto3, s || chr(10) || s2 || chr(10) || s3 FROM f WHERE s3 IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY gram ORDER BY doc_id NULLS FIRST, r, i) AS place FROM g),
x AS (SELECT DISTINCT r, unnest(range(i, upto)) AS i FROM p WHERE place > 1),
t AS (SELECT a.r, string_agg(w[a.i + 1], chr(10) ORDER BY a.i) FILTER (x.r IS NULL) AS rest, count(x.r) AS gone
      FROM a LEFT JOIN x ON a.r = x.r AND a.i = x.i GROUP BY a.r)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(rest, '') END AS text, coalesce(len(w), 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed
FROM d LEFT JOIN t USING (r)
"""

ORACLES["op8_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p : p + {jaccard.SHINGLE - 1}], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, greatest(2, len(w) - {jaccard.SHINGLE - 2}))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.r <> y.r GROUP BY x.r, y.r),
l AS (SELECT a, b, shared / (p.n + q.n - shared) AS j FROM i JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE shared / (p.n + q.n - shared) >= {jaccard.THRESHOLD}),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.r = b GROUP BY a),
k AS (SELECT a, count(*) AS n_links, count(*) FILTER (j = 1) AS same, min(doc_id) FILTER (j = 1) AS low FROM l JOIN d ON d.r = b GROUP BY a)
SELECT doc_id, least(doc_id, low) AS class_id, 1 + coalesce(same, 0) AS copies, coalesce(n_links, 0) AS n_links, component_id, doc_id = component_id AS kept
FROM d JOIN c ON c.a = r LEFT JOIN k ON k.a = r
"""

ORACLES["op10_embedding_dedup"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM d WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda v: v IS NULL OR NOT isfinite(v))) = 0
      AND len(list_filter(e, lambda v: v <> 0)) > 0),
l AS (SELECT x.r AS a, y.r AS b FROM u x JOIN u y ON x.label = y.label AND len(x.e) = len(y.e) AND x.r <> y.r
      WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= {vectors.THRESHOLD}),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN d ON d.r = b GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM d JOIN c ON c.a = r LEFT JOIN k ON k.a = r
"""

#: CRC-32 of a string's UTF-8 bytes, by the table of its bytes (``crc.t``).
_CRC_TABLE = """(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i))"""


def _crc32(text: str) -> str:
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(hex({text}), {at}, 1)) - 1)"
    octets = f"list_transform(range(1, strlen({text}) + 1), lambda k: ({digit('2 * k - 1')} * 16 + {digit('2 * k')})::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {octets}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLES["op12_spelling_variants"] = f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
g AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
c AS (SELECT doc_id, w, coalesce(doc_id::VARCHAR, '') || ':' || w AS name, count(*) AS n FROM g WHERE length(w) >= {variants.SHORTEST} GROUP BY doc_id, w),
h AS (SELECT c.*, {_crc32("c.name")} AS h FROM c, crc),
k AS (SELECT CASE WHEN h % {variants.DAMAGE} = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM k WHERE length(word) >= {variants.SHORTEST} GROUP BY word HAVING sum(n) >= {variants.FEWEST}),
y AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS cut FROM v),
x AS (SELECT word, n, cut, substr(word, 1, cut - 1) || substr(word, cut + 1) AS s FROM y),
p AS (SELECT a.word AS a, a.n AS na, b.word AS b, b.n AS nb FROM x a JOIN x b USING (cut, s) WHERE a.word <> b.word
      UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON v.word = x.s UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON v.word = x.s),
q AS (SELECT a, b, na, nb, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY nb DESC, b) AS r FROM p),
j AS (SELECT a AS word, n_near, CASE WHEN nb >= {variants.RATIO} * na THEN b END AS form, CASE WHEN nb >= {variants.RATIO} * na THEN nb END AS form_n FROM q WHERE r = 1),
o(word, root, depth) AS (SELECT word, word, 0 FROM v UNION ALL SELECT o.word, j.form, depth + 1 FROM o JOIN j ON j.word = o.root WHERE j.form IS NOT NULL),
e AS (SELECT word, arg_max(root, depth) AS root FROM o GROUP BY word)
SELECT word, n, coalesce(n_near, 0) AS n_near, form, form_n, root FROM v LEFT JOIN j USING (word) JOIN e USING (word)
"""

_ROLE = "CASE x.s WHEN 2 THEN 'assistant' ELSE 'user' END"
_STEP = "CASE x.s WHEN 2 THEN 4 ELSE 3 END"
ORACLES["op13_conversation_repair"] = f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT r.*, {_crc32("r.name")} % 20 AS h FROM r, crc),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE h <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS wrong FROM n),
g AS (SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, wrong = 'd')),
z AS (SELECT conv_id, count(*) AS rows_, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (wrong = 'b') AS blank, count(*) FILTER (wrong = 'd') AS duplicate,
    count(*) FILTER (wrong = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
-- s: 1 nothing yet, 2 after user, 3 after assistant, 4 after system; all ways to say an edit or insertion, cheapest first in a state
w(conv_id, i, s, cost, audit, said, step) AS (
  SELECT conv_id, 0, 1, 0, '', '', 0 FROM z
  UNION ALL
  SELECT conv_id, i, s, cost, audit, said, step FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, i, s, step % 3 = 0 ORDER BY cost, audit) AS best FROM (
      SELECT x.conv_id, x.i, x.s, x.cost, x.audit, x.said, x.step + 1 AS step FROM w x WHERE x.step % 3 < 2
      UNION ALL
      SELECT x.conv_id, x.i, CASE x.s WHEN 2 THEN 3 ELSE 2 END, x.cost + {repair.INSERT}, x.audit || 'I', x.said || chr(10) || {_ROLE} || ':', x.step + 1 FROM w x WHERE x.step % 3 < 2
      UNION ALL
      SELECT x.conv_id, x.i + 1, e.s, x.cost + e.cost, x.audit || e.letter, x.said || e.said, x.step + 1 FROM w x JOIN g ON g.conv_id IS NOT DISTINCT FROM x.conv_id AND g.i = x.i + 1, LATERAL (
        SELECT x.s AS s, {repair.DELETE} AS cost, 'D' AS letter, '' AS said
        UNION ALL SELECT CASE x.s WHEN 2 THEN 3 ELSE 2 END, {repair.REROLE} + CASE g.wrong WHEN 't' THEN {repair.TRUNCATED} ELSE 0 END, 'R', chr(10) || {_ROLE} || ':' || g.text WHERE g.wrong NOT IN ('b', 'd')
        UNION ALL SELECT CASE left(g.role, 1) WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END, CASE g.wrong WHEN 't' THEN {repair.TRUNCATED} ELSE 0 END, 'K', chr(10) || g.role || ':' || g.text
          WHERE g.wrong NOT IN ('b', 'd') AND ((left(g.role, 1) = 'u' AND x.s <> 2) OR (left(g.role, 1) = 'a' AND x.s = 2) OR (left(g.role, 1) = 's' AND x.s = 1))) e
      WHERE x.step % 3 = 2)) WHERE best = 1),
y AS (SELECT w.*, row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost, audit) AS best FROM w JOIN z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = z.rows_ WHERE s IN (1, 3) AND w.step % 3 = 2),
a AS (SELECT conv_id, cost, audit, said FROM y WHERE best = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id
"""
