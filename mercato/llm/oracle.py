"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

OP10 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
checked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before,
         length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS n_escapes FROM n)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + n_escapes + length('<|turn|><|text|><|end|>'))::BIGINT AS formatted_chars,
       bool_and(CASE WHEN i = 1 THEN role IN ('system', 'user')
                     WHEN role = 'user' THEN before IN ('system', 'assistant')
                     WHEN role = 'assistant' THEN before = 'user' ELSE false END) AS valid
FROM checked GROUP BY conv_id
"""

OP12 = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, docs),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT doc_id, 100 - 75 + (75 * n * docs) // terms AS m FROM d, s),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13 = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_split_to_array(trim(piece, ' ' || chr(9)), '[\x20\x09]+') AS w FROM p WHERE trim(piece, ' ' || chr(9)) <> ''),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS sizes(k)),
f AS (SELECT lang, k, list_aggregate(w[i:i + k - 1], 'string_agg', ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::HUGEINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 100),
cuts AS (SELECT lang, k, phrase, w, a, unnest(range(1, k)) AS split FROM c),
scored AS (
  SELECT u.lang, u.phrase, a, x.f AS l, y.f AS r, n, (1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score, split
  FROM cuts u JOIN n USING (lang)
  JOIN f x ON x.lang = u.lang AND x.phrase = list_aggregate(u.w[1:split], 'string_agg', ' ')
  JOIN f y ON y.lang = u.lang AND y.phrase = list_aggregate(u.w[split + 1:u.k], 'string_agg', ' ')),
weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, split) AS i FROM scored),
kept AS (
  SELECT * FROM weakest s WHERE i = 1 AND NOT EXISTS (
    SELECT 1 FROM c b WHERE b.lang = s.lang AND length(b.phrase) > length(s.phrase) AND b.a >= s.a
      AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' '))),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""

ORACLE = {"op10_chat_formatting": OP10, "op12_ranked_search": OP12, "op13_phrase_collocations": OP13}
