"""DuckDB SQL of the operators that SQL can state."""

from __future__ import annotations

# What parts words: ASCII white space.
NOT_SPACE = r"[^\x20\x09-\x0D]"


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of a UTF-8 string: a byte is added, then eight shifts (marked by -1) divide by the polynomial."""
    steps = (f"flatten(list_transform(range(strlen({text})), lambda i: [CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT), "
             "-1, -1, -1, -1, -1, -1, -1, -1]))")
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, x: {step}), CAST(4294967295 AS BIGINT))"


# Inserting never pays at the given costs: its partner in the pair can be deleted for less, or with the pair a system row before it.
OP11 = f"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
picks AS MATERIALIZED (SELECT key, {crc32_sql('key')} % 20 AS pick FROM (SELECT DISTINCT key FROM raw)),
hit AS (SELECT conv_id, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN pick = 1 THEN '' WHEN pick = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN pick = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw JOIN picks USING (key) WHERE pick <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k,
  regexp_extract(text, '({NOT_SPACE})[\\x20\\x09-\\x0D]*$', 1) AS final FROM hit),
marked AS MATERIALIZED (SELECT *, CASE WHEN final = '' THEN 'blank'
  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
  WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  k > 1 AND lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal, max(k) AS n FROM marked GROUP BY conv_id),
moves(top, initial, next) AS (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')),
ways AS MATERIALIZED (SELECT conv_id, k, 'D' AS edit, NULL AS initial, 2 AS cost, NULL AS line FROM marked
  UNION ALL SELECT conv_id, k, 'K', role[1], CASE fault WHEN 'truncated' THEN 5 ELSE 0 END, role || ':' || text FROM marked WHERE fault IN ('', 'truncated')
  UNION ALL SELECT conv_id, k, 'R', g.role[1], CASE fault WHEN 'truncated' THEN 6 ELSE 1 END, g.role || ':' || text
    FROM marked, (VALUES ('user'), ('assistant')) g(role) WHERE fault IN ('', 'truncated')),
best(conv_id, k, top, cost, audit, given) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '', 0, '', CAST(NULL AS VARCHAR) FROM counts
  UNION ALL
  SELECT conv_id, k, top, cost, audit, given FROM (
    SELECT b.conv_id, b.k + 1 AS k, coalesce(m.next, b.top) AS top, b.cost + w.cost AS cost, b.audit || w.edit AS audit,
      CASE WHEN w.line IS NULL THEN b.given WHEN b.given IS NULL THEN w.line ELSE b.given || chr(10) || w.line END AS given
    FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.k = b.k + 1
      LEFT JOIN moves m ON m.top = b.top AND m.initial = w.initial
    WHERE w.edit = 'D' OR m.next IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY conv_id, top ORDER BY cost, audit) = 1),
final AS (SELECT c.*, b.cost, b.audit, sha256(coalesce(b.given, '')) AS repaired_sha256
  FROM counts c JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.k = c.n WHERE b.top IN ('', 'a')
  QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY b.cost, b.audit) = 1)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM a.conv_id"""

OP12 = f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 7),
seen AS (SELECT doc_id, run, count(*) AS n FROM low GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM seen),
damaged AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
  ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM cut a JOIN words w ON w.word = a.rest
  UNION SELECT w.word, a.word, a.n FROM cut a JOIN words w ON w.word = a.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form,
  CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, reached) AS (SELECT word, word FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.reached AS root, f.n, f.n_near, CAST(f.form_n AS DOUBLE) AS form_n FROM formed f
JOIN (SELECT chain.word, reached FROM chain JOIN formed g ON g.word = chain.reached AND g.form IS NULL) c ON c.word = f.word"""


def _spans_sql(kind: str, order: int, pattern: str, fits: str) -> str:
    """(doc_id, kind, k, first, stop) of the matches ``m`` that fit; places are running sums of the pieces between matches."""
    return f"""SELECT doc_id, '{kind}' AS kind, {order} AS k, first, first + length(m) AS stop FROM (
  SELECT doc_id, m, sum(length(p)) OVER w + sum(length(m)) OVER w - length(m) AS first FROM (
    SELECT doc_id, unnest(found) AS m, unnest(list_slice(parts, 1, len(found))) AS p, generate_subscripts(found, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS parts FROM documents))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)) WHERE {fits}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (f"list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse({_DIGITS})[i + 1] AS INT) "
         f"ELSE 2 * CAST(reverse({_DIGITS})[i + 1] AS INT) - CASE WHEN CAST(reverse({_DIGITS})[i + 1] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0")
_OCTETS = ("len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 "
           "OR CASE WHEN length(ltrim(x, '0')) BETWEEN 1 AND 3 THEN CAST(x AS HUGEINT) > 255 ELSE FALSE END)) = 0")
KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "TRUE"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _OCTETS),
         ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
         ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15")]
BASE_PII = f"""WITH spans AS ({' UNION ALL '.join(_spans_sql(kind, k, p.replace('(?:', '('), fits) for k, (kind, p, fits) in enumerate(KINDS))})
SELECT d.doc_id, {', '.join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in KINDS)}, coalesce(digest, sha256('')) AS base_sha256
FROM documents d LEFT JOIN (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind, _, _ in KINDS)},
  sha256(string_agg(kind || ':' || CAST(first AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY k, first)) AS digest FROM spans GROUP BY doc_id) USING (doc_id)"""

BASE_URL = """WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM cut),
named AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (SELECT n.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM named n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY n.page_id)
SELECT n.page_id, n.host, n.path, f.rule, f.verdict AS rule_verdict FROM named n LEFT JOIN fits f USING (page_id)"""

BASE_QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{NOT_SPACE}+') AS w FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{NOT_SPACE}') GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
grams AS (SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams WHERE gram IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM again, range(3) r(j) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)"""

_BITS = "list_reduce(list_transform(string_split(sha1(body), ''), lambda x: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * CAST('0x' || x AS INT) + 1, 4)), lambda a, b: a || b)"
_FIVE = " + ".join(f"{2 ** (4 - k)} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INT)" for k in range(5))
BASE_WARC = f"""WITH body AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
bits AS (SELECT page_id, strlen(body) AS payload_bytes, {_BITS} AS bits FROM body),
named AS (SELECT page_id, payload_bytes, list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), lambda a, b: a || b) AS payload_digest FROM bits)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CAST(CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS DOUBLE) AS refers_to FROM named WINDOW w AS (PARTITION BY payload_digest)"""
