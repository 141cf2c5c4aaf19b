"""SQL that gives the same rows as the queries."""

# word_chars etc. are counted in code points; windows are compared as whole strings here.
QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls
  FROM d
), win AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS s
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT i + o)::BIGINT AS n FROM rep, range(0, 8) AS t(o) GROUP BY r
), m AS (
  SELECT w.r, doc_id,
         len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         len([i for i in range(2, len(ws) + 1) if ws[i] = ws[i - 1]])::BIGINT AS n_adjacent_repeats,
         (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')))::BIGINT AS n_upper
  FROM w LEFT JOIN cov ON cov.r = w.r
), b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
     + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
     + CASE WHEN 100 * n_symbols > 8 * word_chars THEN 4 ELSE 0 END
     + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
     + CASE WHEN 100 * n_upper > 50 * word_chars THEN 16 ELSE 0 END
     + CASE WHEN 100 * n_adjacent_repeats > 40 * n_words THEN 32 ELSE 0 END
     + CASE WHEN word_chars > 20 * n_words THEN 64 ELSE 0 END)::BIGINT AS failed_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *,
    len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '</?s>|\[/?(SYS|INST|ANS|ROLE|TEXT)\]')) AS added,
    CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 15 WHEN 'assistant' THEN 17
      ELSE 7 + 15 + 8 + length(role) + len(regexp_extract_all(role, '\\')) + len(regexp_extract_all(role, '</?s>|\[/?(SYS|INST|ANS|ROLE|TEXT)\]')) END AS marks,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS from_end
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(marks + length(text) + added)::BIGINT AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
    WHEN before = 'user' THEN role = 'assistant' ELSE false END AND (from_end > 1 OR role = 'assistant')) AS valid
FROM e GROUP BY conv_id
"""

# Base 32: five hex digits are twenty bits, four letters.
WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS n, sha1(body) AS hex, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p
), x AS (
  SELECT *, [('0x' || substr(hex, i * 5 + 1, 5))::BIGINT for i in range(8)] AS v FROM d
)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (b >> 15) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((b >> 10) & 31) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((b >> 5) & 31) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (b & 31) + 1, 1) for b in v], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS p FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum([a.p[i] * b.p[i] for i in range(1, len(a.p) + 1)])::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.p) = len(b.p) WHERE a.vec_id % 20 = 0
)
SELECT * FROM (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
) WHERE rank <= 20
"""

# Links by an inverted index over shingles; classes by repeated minimum over links.
JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 3), ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), e AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 85 * (na.n + nb.n - p.c)
), u AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT doc_id AS a, doc_id AS c FROM w
  UNION
  SELECT u.a, r.c FROM r JOIN u ON r.a = u.b
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.a = w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
"""

REPEATS = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), d AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM g) WHERE first < doc_id
), c AS (
  SELECT DISTINCT doc_id, i + o AS i FROM d, range(0, 13) AS t(o)
), p AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w
), k AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept, count(c.i) AS removed
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i GROUP BY p.doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""

# Terms are maximal runs of letters, digits and characters beyond ASCII; all sums in 64 bits.
RANKED = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT row_number() OVER () AS q, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), a AS (
  SELECT q, item_id, t, count(*) AS times FROM i GROUP BY ALL
), n AS (
  SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0
), p AS (
  SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM a) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), n
), s AS (
  SELECT q, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(ws) * docs) // total))))::BIGINT AS score
  FROM a JOIN p USING (t) JOIN w USING (t) JOIN d USING (r), n GROUP BY ALL
), k AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 20
"""

# The checksum by its table; the cheapest edits turn by turn, cost and edits as one comparable string.
REPAIR = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY n) AS t
  FROM range(256) AS r(n)
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT for x in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')],
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM conversations, crc
), g AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM d, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), nth) AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM g)
), y AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS c,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS step FROM f
), ins(f, n, s) AS (
  VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)
), kept(c, s, t) AS (
  VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)
), tr AS (
  SELECT c, f, n, s AS t, 5 * n + 2 AS cost, repeat('I', n) || 'D' AS txt, false AS stays FROM ins, (VALUES ('s'), ('u'), ('a'), ('x')) AS l(c)
  UNION ALL SELECT c, f, n, CASE s WHEN 2 THEN 3 ELSE 2 END, 5 * n + 1, repeat('I', n) || 'R', true FROM ins, (VALUES ('s'), ('u'), ('a'), ('x')) AS l(c)
  UNION ALL SELECT kept.c, f, n, t, 5 * n, repeat('I', n) || 'K', true FROM ins JOIN kept USING (s)
), r AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS state, '00000000' AS best FROM y
  UNION ALL
  SELECT r.conv_id, r.pos + 1, tr.t,
    min(lpad((left(best, 8)::BIGINT + cost + CASE WHEN stays AND fault = 3 THEN 5 ELSE 0 END)::VARCHAR, 8, '0') || substr(best, 9) || txt)
  FROM r JOIN y ON y.conv_id = r.conv_id AND y.pos = r.pos + 1 JOIN tr ON tr.c = y.c AND tr.f = r.state AND NOT (stays AND fault IN (1, 2))
  GROUP BY r.conv_id, r.pos, tr.t
), e AS (
  SELECT conv_id, min(CASE state WHEN 1 THEN lpad((left(best, 8)::BIGINT + 10)::VARCHAR, 8, '0') || substr(best, 9) || 'II'
      WHEN 2 THEN lpad((left(best, 8)::BIGINT + 5)::VARCHAR, 8, '0') || substr(best, 9) || 'I' ELSE best END) AS best
  FROM r JOIN (SELECT conv_id, max(pos) AS pos FROM y GROUP BY 1) USING (conv_id, pos) GROUP BY 1
), a AS (
  SELECT conv_id, k, substr(best, 8 + k, 1) AS op,
    count(*) FILTER (substr(best, 8 + k, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos,
    count(*) FILTER (substr(best, 8 + k, 1) <> 'D') OVER (PARTITION BY conv_id ORDER BY k) AS nth
  FROM (SELECT conv_id, best, unnest(range(1, length(best) - 7)) AS k FROM e)
), b AS (
  SELECT a.conv_id, k, op, a.nth, role, text,
    bool_or(a.nth = 1 AND op = 'K' AND c = 's') OVER (PARTITION BY a.conv_id) AS has_s
  FROM a LEFT JOIN y ON y.conv_id = a.conv_id AND y.pos = a.pos AND op <> 'I' WHERE op <> 'D'
), h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (nth % 2 = 1) <> has_s THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS digest
  FROM b GROUP BY 1
), m AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal
  FROM y GROUP BY 1
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(left(best, 8)::BIGINT, 0) AS cost,
  coalesce(substr(best, 9), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN m USING (conv_id) LEFT JOIN e USING (conv_id) LEFT JOIN h USING (conv_id)
"""
