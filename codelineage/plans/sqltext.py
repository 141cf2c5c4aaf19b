"""SQL fragments for the text rules, used by the comparison queries."""

from __future__ import annotations

WS = r"[ \t\n\x0B\f\r\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NL = "chr(10)"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', 'g')"


def js_trim(x: str) -> str:
    return sub(x, f"^{WS}+|{WS}+$", "")


def squeeze(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def norm_line(x: str) -> str:
    return f"lower({squeeze(x)})"


def norm_syntax(x: str) -> str:
    x = squeeze(x)
    for pattern, to in (
        ("(?s)//.*", ""),
        (r"(?s)/\*.*?\*/", ""),
        ("(?s)#.*", ""),
        (r"\b[a-zA-Z_]\w*\b", "VAR"),
        (f"VAR{WS}*:", "VAR:"),
        ("'[^']*'", '"STR"'),
        ('"[^"]*"', '"STR"'),
        ("`[^`]*`", '"STR"'),
        (r"\b\d+\b", "NUM"),
    ):
        x = sub(x, pattern, to)
    return x


def lines(x: str) -> str:
    return f"string_split({x}, {NL})"


def trimmed_lines(x: str) -> str:
    return f"list_filter(list_transform({lines(x)}, lambda l: {js_trim('l')}), lambda l: length(l) > 0)"


def shape(x: str) -> str:
    return sub(x, r"\b[a-zA-Z_]\w*\b", "VAR")


def tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '\w+|[^\w{WS[1:-1]}]')"


def features(x: str) -> str:
    return (
        f"list_transform({trimmed_lines(x)}, lambda l: "
        f"{{'ws': {squeeze('l')}, 'shape': {shape('l')}, 'tokens': {tokens('l')}}})"
    )


def token_similarity(a: str, b: str) -> str:
    return (
        f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
        f"len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda j: {a}[j] = {b}[j]))::DOUBLE "
        f"/ greatest(len({a}), len({b})) END)"
    )


def fuzzy_score(a: str, b: str) -> str:
    sim = (
        f"({a}[i].ws = {b}[i].ws OR {a}[i].shape = {b}[i].shape OR "
        f"{token_similarity(f'{a}[i].tokens', f'{b}[i].tokens')} > 0.7)"
    )
    return (
        f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 100.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE "
        f"len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {sim}))::DOUBLE "
        f"/ greatest(len({a}), len({b})) * 100 END)"
    )


def share_of_lines_in(target: str, text: str) -> str:
    return (
        f"(len(list_filter({trimmed_lines(target)}, lambda w: list_contains("
        f"list_transform({lines(text)}, lambda l: {js_trim('l')}), w)))::DOUBLE / nullif(len({trimmed_lines(target)}), 0))"
    )


# Blocks derived from the conversations: see sources/tables.py.
BLOCKS = f"""blocks AS (
  SELECT conv_id, turn AS block, array_to_string(list_transform({lines('text')}, lambda x, i:
    CASE WHEN conv_id % 3 = 1 AND i % 3 = 0 THEN x || ' # edited'
         WHEN conv_id % 3 = 2 THEN x || ' # edited' ELSE x END), {NL}) AS content
  FROM conversations)"""

PROVENANCE = f"""{BLOCKS},
first_lines AS (
  SELECT conv_id, norm, min(turn) AS first_turn, arg_min(role, turn) AS first_role
  FROM (SELECT conv_id, turn, role, {norm_line('line')} AS norm
        FROM (SELECT conv_id, turn, role, unnest({lines('text')}) AS line FROM conversations))
  WHERE length(norm) >= 3 AND regexp_matches(norm, '[a-zA-Z0-9_]') GROUP BY ALL),
block_lines AS (
  SELECT conv_id, block, line_no, {norm_line('line')} AS norm
  FROM (SELECT conv_id, block, unnest({lines('content')}) AS line,
               unnest(range(1, len({lines('content')}) + 1)) AS line_no FROM blocks)
  WHERE length({norm_line('line')}) > 0 AND NOT regexp_matches(line, '(?i)(@Authorship:|\\[AUTHORSHIP:)')),
line_labels AS (
  SELECT l.conv_id, l.block, l.line_no, f.first_turn,
    CASE WHEN f.first_role = 'assistant' THEN 'LLM_GENERATED' WHEN f.first_role = 'user' THEN 'HUMAN_PROMPT_ORIGIN'
         ELSE 'HUMAN_WRITTEN' END AS label
  FROM block_lines l LEFT JOIN first_lines f ON l.conv_id = f.conv_id AND l.norm = f.norm),
block_line_label AS (
  SELECT conv_id, block, CASE
    WHEN bool_or(label = 'LLM_GENERATED') AND bool_or(label <> 'LLM_GENERATED') THEN 'MIXED'
    WHEN bool_or(label = 'LLM_GENERATED') THEN 'LLM_GENERATED'
    WHEN bool_or(label = 'HUMAN_PROMPT_ORIGIN') THEN 'HUMAN_PROMPT_ORIGIN' ELSE 'HUMAN_WRITTEN' END AS line_label
  FROM line_labels GROUP BY ALL)"""

MATCHES = f"""{PROVENANCE},
snips AS (SELECT conv_id, turn, role, {js_trim('text')} AS code FROM conversations),
keyed_b AS (SELECT *, {squeeze('content')} AS ws, {norm_syntax('content')} AS syn, {features('content')} AS f FROM blocks),
keyed_s AS (SELECT *, {squeeze('code')} AS ws, {norm_syntax('code')} AS syn, {features('code')} AS f FROM snips),
scored AS (
  SELECT b.conv_id, b.block, s.turn, s.role, CASE
      WHEN b.content = s.code THEN 100.0 WHEN b.ws = s.ws THEN 95.0 WHEN b.syn = s.syn THEN 85.0
      ELSE {fuzzy_score('b.f', 's.f')} END AS score,
    CASE WHEN b.content = s.code THEN 'exact' WHEN b.ws = s.ws THEN 'whitespace' WHEN b.syn = s.syn THEN 'normalized'
         ELSE 'fuzzy' END AS kind
  FROM keyed_b b JOIN keyed_s s ON b.conv_id = s.conv_id),
hits AS (SELECT * FROM scored WHERE score >= 70),
matched AS (
  SELECT conv_id, block, count(*) FILTER (WHERE kind = 'exact') AS n_exact,
    count(*) FILTER (WHERE kind = 'whitespace') AS n_whitespace,
    count(*) FILTER (WHERE kind = 'normalized') AS n_normalized,
    count(*) FILTER (WHERE kind = 'fuzzy') AS n_fuzzy, count(*) AS n_matches, max(score) AS best_score,
    min(turn) AS first_turn, arg_min(role, turn) AS first_role, arg_min(score, turn) AS first_score,
    arg_min(kind, turn) AS first_kind
  FROM hits GROUP BY ALL)"""


# Constants of the Mersenne twister.
MERSENNE = """init(i, v) AS (
    SELECT 0::BIGINT, 19650218::BIGINT UNION ALL SELECT i + 1, (1812433253 * xor(v, v >> 30) + i + 1) & 4294967295 FROM init WHERE i < 623
  ), start AS (SELECT list(v ORDER BY i) AS s FROM init),
  mix1(seed, k, v, v0) AS (
    SELECT seed, 0::BIGINT, x, x FROM (SELECT seed, (xor(s[2], xor(s[1], s[1] >> 30) * 1664525) + ('0x' || substr(seed, 9, 8))::BIGINT) & 4294967295 AS x FROM seeds, start)
    UNION ALL
    SELECT seed, k + 1, (xor(CASE WHEN k = 622 THEN v0 ELSE s[k + 3] END, xor(v, v >> 30) * 1664525)
      + CASE WHEN k % 2 = 0 THEN ('0x' || substr(seed, 1, 8))::BIGINT + 1 ELSE ('0x' || substr(seed, 9, 8))::BIGINT END) & 4294967295, v0
    FROM mix1, start WHERE k < 623
  ), half AS (SELECT seed, list(v ORDER BY k) AS s FROM mix1 GROUP BY seed),
  mix2(seed, k, v) AS (
    SELECT seed, 0::BIGINT, (xor(s[2], xor(s[624], s[624] >> 30) * 1566083941) - 2) & 4294967295 FROM half
    UNION ALL
    SELECT m.seed, k + 1, (xor(CASE WHEN k = 621 THEN s[624] ELSE s[k + 3] END, xor(v, v >> 30) * 1566083941) - CASE WHEN k = 621 THEN 1 ELSE k + 3 END) & 4294967295
    FROM mix2 m JOIN half h ON m.seed = h.seed WHERE k < 622
  ), state AS (SELECT seed, [2147483648, list_last(list(v ORDER BY k))] || list(v ORDER BY k)[1:622] AS s FROM mix2 GROUP BY seed),
  drawn AS (
    SELECT seed, t, xor(s[t + 397], ((s[t] & 2147483648) | (s[t + 1] & 2147483647)) >> 1) AS a, s[t + 1] & 1 AS odd FROM state, range(1, 60) AS r(t)
  ), b1 AS (SELECT seed, t, CASE WHEN odd = 1 THEN xor(a, 2567483615) ELSE a END AS x FROM drawn),
  b2 AS (SELECT seed, t, xor(x, x >> 11) AS x FROM b1), b3 AS (SELECT seed, t, xor(x, (x << 7) & 2636928640) AS x FROM b2),
  b4 AS (SELECT seed, t, xor(x, (x << 15) & 4022730752) AS x FROM b3), bits AS (SELECT seed, t, xor(x, x >> 18) AS x FROM b4),
  picks AS (SELECT seed, n, min_by(x >> (32 - len(bin(n))), t) AS pick FROM bits JOIN (SELECT DISTINCT seed, n FROM seeds) USING (seed) WHERE x >> (32 - len(bin(n))) < n GROUP BY ALL)"""
