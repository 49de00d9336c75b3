"""DuckDB SQL for those text queries that SQL can express."""

from __future__ import annotations

#: Bytes as hex digits, two each, so that a slice of bytes is a slice of text.
EXACT_REPEATS = """
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT r, unnest(range(1, (length(x) // 2 - 398)::BIGINT)) AS p FROM docs WHERE length(x) >= 800),
named AS (SELECT r, p, hash(substr(x, 2 * p - 1, 800)) AS k FROM starts JOIN docs USING (r)),
twice AS (SELECT k FROM named GROUP BY k HAVING count(*) > 1),
marked AS (SELECT r, p, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p) > 400, false) AS apart FROM named SEMI JOIN twice USING (k)),
run_of AS (SELECT r, p, count_if(apart) OVER (PARTITION BY r ORDER BY p) AS run FROM marked),
runs AS (SELECT r, min(p) AS s, max(p) + 400 AS e FROM run_of GROUP BY r, run),
gaps AS (
  SELECT r, s AS ending, coalesce(lag(e) OVER w, 1) AS kept_from, s AS kept_to FROM runs WINDOW w AS (PARTITION BY r ORDER BY s)
  UNION ALL SELECT r, length(x) // 2 + 1, coalesce((SELECT max(e) FROM runs WHERE runs.r = docs.r), 1), length(x) // 2 + 1 FROM docs),
kept AS (
  SELECT r, string_agg(substr(x, (2 * kept_from - 1)::BIGINT, (2 * (kept_to - kept_from))::BIGINT), '' ORDER BY ending, kept_to) AS y
  FROM gaps JOIN docs USING (r) GROUP BY r),
sums AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(y)) AS kept_sha256
FROM docs JOIN kept USING (r) LEFT JOIN sums USING (r)"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
items AS (SELECT item_id, {WORDS} AS w FROM benchmark),
asked AS (SELECT DISTINCT item_id, length(part) AS n, array_to_string(part, ' ') AS phrase FROM (
  SELECT item_id, unnest(list_transform(range(1, greatest(length(w) - 8, 2)), lambda i: w[i : i + 9])) AS part
  FROM items WHERE length(w) > 0)),
sizes AS (SELECT DISTINCT n FROM asked),
places AS (SELECT r, n, unnest(range(1, (length(w) - n + 2)::BIGINT)) AS p FROM docs, sizes WHERE length(w) >= n),
found AS (SELECT r, p, n, item_id FROM (
  SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS phrase FROM places JOIN docs USING (r)) JOIN asked USING (n, phrase)),
hits AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS place FROM (SELECT DISTINCT r, p, n FROM found)) GROUP BY r),
by_item AS (SELECT r, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, length(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN by_item USING (r)"""

_MARKS = r"\\|<turn>|</turn>|### User:|### Assistant:|### System:"


def _escaped(text: str) -> str:
    return f"(length({text}) + length(regexp_extract_all({text}, '{_MARKS}')))"


#: A turn is written as <turn>, its role, a newline, its text, </turn> and a newline.
CHAT_FORMAT = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS every,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
         sum(6 + {_escaped('role')} + length(role) - length(replace(role, chr(10), '')) + 1 + {_escaped('text')} + 8)::BIGINT AS formatted_chars,
         string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
                    ORDER BY turn NULLS FIRST, role, text) AS roles
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(every) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
       formatted_chars, regexp_full_match(roles, 's?(ua)+') AS valid FROM whole"""

#: The CRC-32 of a text, byte by byte; the table of the 256 byte values follows from the polynomial.
CRC_TABLE = "SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"


def _crc(text: str, table: str = "t") -> str:
    """SQL for the unsigned CRC-32 of ``text``, where ``table`` is the column of ``CRC_TABLE``."""
    code = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {code}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


#: Six equal words in a row lie one period apart in every run of twelve words and two periods.
PERIODIC_RUNS = f"""
WITH crc AS MATERIALIZED ({CRC_TABLE}),
said AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         {_crc("coalesce(doc_id::VARCHAR, '')")} AS h FROM documents, crc),
plan AS (SELECT *, length(w) AS n, CASE WHEN doc_id IS NOT NULL AND h % 10 = 0 AND length(w) > 0 THEN (h // 10) % length(w) END AS a FROM said),
docs AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w
         ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] END) END AS w
  FROM plan),
grams AS MATERIALIZED (SELECT r, i, array_to_string(w[i + 1 : i + 6], ' ') AS g FROM (SELECT r, w, unnest(range(0, n - 5)) AS i FROM docs WHERE n >= 12)),
same AS (SELECT x.r, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
rows_ AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same),
stretches AS (SELECT r, min(i) AS s, count(*) + 5 + q AS size, q FROM rows_ GROUP BY r, q, island),
runs AS (SELECT r, s, size, min(q) AS q FROM stretches WHERE size >= greatest(12, 2 * q) GROUP BY r, s, size),
best AS (
  SELECT r, count(*) AS n_runs, arg_min({{'s': s, 'size': size, 'q': q}}, (-size, s, q)) AS b,
         string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + size)) AS i FROM runs),
kept AS (SELECT r, string_agg(w[i + 1], ' ' ORDER BY i) AS y FROM (SELECT r, w, unnest(range(0, n)) AS i FROM docs) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.s::BIGINT AS start, b.size::BIGINT AS length, b.q::BIGINT AS period,
       (1000 * b.size // b.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(y, '')) AS collapsed_sha256
FROM docs LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""

#: Words one replacement apart are equal without the code point at that place; words one
#: insertion apart are equal once the longer has lost one.
SPELLING_VARIANTS = f"""
WITH RECURSIVE crc AS MATERIALIZED ({CRC_TABLE}),
said AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[a-z\\x{{C0}}-\\x{{FF}}]{{5,}}')) AS w FROM documents),
counted AS (SELECT d, w, count(*) AS c FROM said GROUP BY d, w),
marked AS (SELECT w, c, {_crc("d || ':' || w")} AS h FROM counted, crc),
made AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w) + 2)::BIGINT) ELSE w END AS w, c FROM marked),
words AS MATERIALIZED (SELECT w, sum(c)::BIGINT AS n FROM made WHERE length(w) >= 5 GROUP BY w HAVING sum(c) >= 3),
less AS MATERIALIZED (SELECT w, n, i, substr(w, 1, i - 1) || substr(w, i + 1) AS v FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words)),
pairs AS MATERIALIZED (
  SELECT DISTINCT x.w AS a, x.n AS a_n, y.w AS b, y.n AS b_n FROM less x JOIN less y ON x.i = y.i AND x.v = y.v AND x.w <> y.w
  UNION SELECT x.w, x.n, y.w, y.n FROM less x JOIN words y ON x.v = y.w
  UNION SELECT y.w, y.n, x.w, x.n FROM less x JOIN words y ON x.v = y.w),
best AS (SELECT a AS w, count(*) AS n_near, arg_min({{'w': b, 'n': b_n}}, (-b_n, b)) AS f FROM pairs GROUP BY a),
forms AS MATERIALIZED (
  SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN f.n >= 2 * n THEN f.w END AS form, CASE WHEN f.n >= 2 * n THEN f.n END AS form_n
  FROM words LEFT JOIN best USING (w)),
walk AS (SELECT w, w AS place, form AS onward FROM forms UNION ALL SELECT walk.w, forms.w, forms.form FROM walk JOIN forms ON forms.w = walk.onward)
SELECT forms.w AS word, form, place AS root, n, n_near, form_n FROM forms JOIN walk ON walk.w = forms.w AND walk.onward IS NULL"""


def _placed(kind: str, pattern: str) -> str:
    """SQL for (r, k, i, m, e): the matches of ``pattern`` and where they end, by the gaps between them."""
    return f"""SELECT r, {kind} AS k, i, m, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
      SELECT r, i, ms[i] AS m, gs[i] AS g FROM (
        SELECT *, unnest(range(1, length(ms) + 1)) AS i FROM (
          SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM docs)))"""


_ASSIGN = """(?i:(?:password|passwd|secret|token|api_?key))["'']?\\x20*[:=]\\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_WORDS = "(?i:example|placeholder|changeme|your_|xxxx|test|abcdefgh|012345|lorem)"

#: The value of an assignment is what its last separator and quote leave.
SECRET_SCAN = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
candidates AS ({_placed("3", "[A-Za-z0-9+/_=-]{20,}")}),
parts AS (SELECT r, i, part FROM (SELECT r, i, unnest(string_split_regex(m, '{_WORDS}')) AS part FROM candidates)
  WHERE length(part) >= 20 AND regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Za-z]')),
windows AS (SELECT r, i, part, unnest(range(1, (length(part) - 18)::BIGINT)) AS p FROM parts),
bits AS (SELECT r, i, max(list_entropy(string_split(substr(part, p, 20), ''))) >=
  CASE WHEN regexp_full_match(part, '[0-9a-fA-F]+') THEN 3.0 WHEN regexp_full_match(part, '[A-Za-z0-9]+') THEN 3.7 ELSE 3.9 END AS high
  FROM windows GROUP BY r, i, part),
found AS (
  SELECT * FROM ({_placed("0", _ASSIGN)}) WHERE length(regexp_extract(m, '(?i:password|passwd|secret|token|api_?key)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 8
  UNION ALL {_placed("1", "AKIA[A-Z0-9]{12,}")}
  UNION ALL {_placed("2", "[0-9a-f]{32,}")}
  UNION ALL SELECT * FROM candidates SEMI JOIN (SELECT r, i FROM bits WHERE high) USING (r, i)),
named AS (SELECT r, k, e - length(m) AS s, ['assign', 'access', 'hex', 'entropy'][k + 1] || ':' || (e - length(m))::BIGINT || ':' || e::BIGINT AS name FROM found),
sums AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(name, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg(name, ',' ORDER BY s, k) AS spans FROM named GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN sums USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_repeats": EXACT_REPEATS, "op4_decontamination": DECONTAMINATION, "op8_secret_scan": SECRET_SCAN, "op10_chat_format": CHAT_FORMAT, "op11_periodic_runs": PERIODIC_RUNS, "op13_spelling_variants": SPELLING_VARIANTS}
