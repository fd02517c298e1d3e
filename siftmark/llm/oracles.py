"""DuckDB statements for the operators that SQL can express, over the same tables."""

from __future__ import annotations

from . import chat, line_rules, url_rules

_BLANK = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_STOCK = " OR ".join(f"contains(lower(line), '{p}')" for p in line_rules.BOILERPLATE)

LINE_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS words FROM d),
windows AS (
  SELECT doc_id, i, list_slice(words, i, i + {line_rules.WINDOW - 1}) AS win
  FROM w, unnest(range(1, len(words) - {line_rules.WINDOW - 2})) t(i)),
again AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM again, unnest(range({line_rules.WINDOW})) t(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '{_WORD}') AS lw,
    length(regexp_replace(line, '{_BLANK}', '', 'g')) AS chars,
    length(line) - length(regexp_replace(line, '[#*$%&|<>!~^=]', '', 'g')) AS marks
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
judged AS (
  SELECT *, 100 * marks > {line_rules.MARKS_PERCENT} * chars
    OR (len(lw) < 3 AND right(lw[-1], 1) NOT IN ({_quoted(line_rules.END_MARKS)}))
    OR (seps >= {line_rules.NAVIGATION_LEAST}
        AND 100 * seps >= {line_rules.NAVIGATION_PERCENT} * len(lw))
    OR (len(lw) <= {line_rules.BOILERPLATE_WORDS} AND ({_STOCK})) AS fails
  FROM (SELECT *, len(list_filter(lw, lambda x: x IN ({_quoted(line_rules.NAVIGATION)}))) AS seps
        FROM lines WHERE len(lw) > 0)),
by_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (fails) AS n_failed_lines,
    coalesce(sum(chars) FILTER (fails), 0) AS lost_chars
  FROM judged GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '{_BLANK}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(b.n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(b.n_failed_lines, 0) AS BIGINT) AS n_failed_lines,
    CAST(coalesce(b.lost_chars, 0) AS BIGINT) AS lost_chars
  FROM w LEFT JOIN by_doc b USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
failed AS (
  SELECT *, n_words < {line_rules.MIN_WORDS}
    OR 100 * n_repeat_words > {line_rules.REPEAT_PERCENT} * n_words AS base_failed FROM base)
SELECT *, NOT base_failed AND 100 * lost_chars <= {line_rules.MOST_LOST} * word_chars AS kept
FROM failed
"""

_LIMITS = url_rules.Limits()
_FITS = " UNION ALL ".join(
    f"SELECT '{r.host}' AS rule_host, '{r.path}' AS rule_path, '{r.verdict}' AS verdict"
    for r in url_rules.POLICY
)
_PATH = "coalesce(regexp_extract({0}, '://[^/?#]*([^?#]*)', 1), '')"
_HOST = "coalesce(regexp_extract({0}, '://([^/?#]*)', 1), '')"


def _tagged(tag: str, parts: str) -> str:
    return f"list_transform(list_filter({parts}, lambda x: x <> ''), lambda x: '{tag}' || x)"


_TOKENS = f"""
  CASE WHEN contains(low, '://') THEN list_distinct(list_concat(
    {_tagged("s:", "[regexp_extract(low, '^([a-z][a-z0-9+.-]*)://', 1)]")},
    {_tagged("h:", "string_split(" + _HOST.format("low") + ", '.')")},
    {_tagged("p:", "list_transform(string_split_regex(" + _PATH.format("low") + ", '[/._~-]+'), lambda x: regexp_replace(x, '^[0-9]+$', '0'))")},
    {_tagged("q:", "list_transform(string_split_regex(regexp_extract(low, '://[^?#]*[?]([^#]*)', 1), '[&;]'), lambda x: regexp_extract(x, '^([^=]*)', 1))")},
    {_tagged("f:", "[regexp_extract(low, '#(.*)$', 1)]")}
  )) ELSE CAST([] AS VARCHAR[]) END"""

URL_RULES = f"""
WITH p AS (
  SELECT page_id, url, {_HOST.format("url")} AS raw_host, {_PATH.format("url")} AS path,
    lower(coalesce(url, '')) AS low FROM pages),
page AS (
  SELECT page_id, url, path, {_TOKENS} AS tokens,
    translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(?:[.][a-z]+)?/?$', 1) AS BIGINT) AS doc_id
  FROM p),
label AS (
  SELECT doc_id, bool_or(coalesce(quality = 0 OR toxic = 1, quality = 0, toxic = 1)) AS bad
  FROM labels GROUP BY doc_id),
known AS (
  SELECT row_number() OVER () AS rid, tokens, bad FROM page JOIN label USING (doc_id)
  WHERE bad IS NOT NULL AND len(tokens) > 0),
whole AS (SELECT ceil({_LIMITS.min_support} * count(*)) AS least, avg(CAST(bad AS DOUBLE)) AS base FROM known),
each AS (SELECT rid, bad, unnest(tokens) AS t FROM known),
sets AS (
  SELECT [t] AS tokens, bad FROM each
  UNION ALL
  SELECT [a.t, b.t], a.bad FROM each a JOIN each b ON a.rid = b.rid AND a.t < b.t
  UNION ALL
  SELECT [a.t, b.t, c.t], a.bad FROM each a JOIN each b ON a.rid = b.rid AND a.t < b.t
  JOIN each c ON b.rid = c.rid AND b.t < c.t),
counted AS (
  SELECT tokens, count(*) AS n, count(*) FILTER (bad) AS bad FROM sets GROUP BY tokens),
rules AS (
  SELECT tokens, CAST(bad AS DOUBLE) / n AS confidence FROM counted, whole
  WHERE bad >= least AND n >= {_LIMITS.min_count}
    AND CAST(bad AS DOUBLE) / n >= {_LIMITS.min_confidence}
    AND CAST(bad AS DOUBLE) / n >= {_LIMITS.min_lift} * base),
pruned AS (
  SELECT * FROM rules r WHERE NOT EXISTS (
    SELECT 1 FROM rules s WHERE len(s.tokens) < len(r.tokens)
      AND list_has_all(r.tokens, s.tokens) AND s.confidence >= r.confidence)),
best AS (
  SELECT url, arg_max(r, (confidence, len(r), rule)) AS tokens, max(confidence) AS confidence
  FROM (SELECT DISTINCT url, g.tokens AS r, confidence, array_to_string(g.tokens, ' ') AS rule
        FROM page JOIN pruned g ON list_has_all(page.tokens, g.tokens))
  GROUP BY url),
policy AS ({_FITS}),
fit AS (
  SELECT page_id, url, rule_host || rule_path AS rule, verdict FROM page JOIN policy
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY length(rule_host || rule_path) DESC) = 1)
SELECT page.page_id, host, path, fit.rule,
  coalesce(fit.verdict, CASE WHEN best.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(best.tokens, ' ') AS mined_rule, best.confidence AS mined_confidence
FROM page LEFT JOIN fit ON fit.page_id = page.page_id AND fit.url = page.url
LEFT JOIN best ON best.url = page.url
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, list_slice(words, i, i + 2) AS s
  FROM w, unnest(range(1, len(words) - 1)) t(i) WHERE len(words) >= 3
  UNION ALL SELECT doc_id, words FROM w WHERE len(words) BETWEEN 1 AND 2),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
steps AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS id, a AS low FROM steps
  UNION
  SELECT steps.b, reach.low FROM reach JOIN steps ON steps.a = reach.id WHERE reach.low < steps.b),
component AS (SELECT id, min(low) AS low FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, w.doc_id) AS component_id,
  coalesce(low, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN component ON component.id = w.doc_id
"""

RANKED_SEARCH = r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term, docs),
q AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf)
    // (1000 * tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), corpus
  GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY rank <= 10
"""



def _edit(state: str, cost: str, mark: str, line: str | None) -> str:
    """A way through the edits, one edit longer; null if there is no such way."""
    text = f"{state}.t" if line is None else f"{state}.t || chr(10) || {line}"
    return (
        f"CASE WHEN {state} IS NOT NULL THEN"
        f" {{'c': {state}.c + {cost}, 'a': {state}.a || '{mark}', 't': {text}}} END"
    )


def _cheapest(*ways: str) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _when(test: str, way: str) -> str:
    return f"CASE WHEN {test} THEN {way} END"


_KEEP = [_edit(f"r{i}", "late", "K", "role || ':' || text") for i in range(4)]
_USER = [_edit(f"r{i}", "1 + late", "R", "'user:' || text") for i in range(4)]
_DELETE = [_edit(f"r{i}", "2", "D", None) for i in range(4)]

CONVERSATION_REPAIR = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(
      list_concat([4294967295::BIGINT], flatten(list_transform(
        string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':'
          || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x)
        WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END),
      4294967295::BIGINT) % 20 AS how
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
    CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM given, unnest(CASE how WHEN 3 THEN [1, 2] ELSE [1] END) WHERE how <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM damaged),
faults AS (
  SELECT *, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || left(role, 1) AS pair
  FROM placed),
turns AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate'
      WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    CASE WHEN last NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS late,
    last <> '' AND NOT again AS stays, left(role, 1) AS initial
  FROM faults),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM turns GROUP BY conv_id),
ways AS (
  SELECT conv_id, 0::BIGINT AS pos, {{'c': 0, 'a': '', 't': ''}} AS s0,
    CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s1,
    CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s2,
    CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, t VARCHAR)) AS s3
  FROM counts
  UNION ALL
  SELECT conv_id, pos, {_DELETE[0]},
    {_cheapest(_DELETE[1], _when("stays AND initial = 's'", _KEEP[0]))},
    {_cheapest(_DELETE[2], *[_when("stays AND initial = 'u'", _KEEP[i]) for i in (0, 1, 3)],
               *[_when("stays", _USER[i]) for i in (0, 1, 3)])},
    {_cheapest(_DELETE[3], _when("stays AND initial = 'a'", _KEEP[2]),
               _when("stays", _edit("r2", "1 + late", "R", "'assistant:' || text")))}
  FROM (
    SELECT *, {_cheapest("s3", _edit("r2", "5", "I", "'assistant:'"))} AS r3
    FROM (
      SELECT t.*, s0 AS r0, s1 AS r1, s3,
        {_cheapest("s2", *[_edit(f"s{i}", "5", "I", "'user:'") for i in (0, 1, 3)])} AS r2
      FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1))),
ends AS (
  SELECT w.conv_id, {_cheapest(
      "s0", "s3", _edit("s2", "5", "I", "'assistant:'"),
      _edit("s1", "10", "II", "'user:' || chr(10) || 'assistant:'"))} AS way
  FROM ways w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.pos = c.n)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(way.c, 0) AS BIGINT) AS cost,
  coalesce(way.a, '') AS audit, sha256(coalesce(substr(way.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
"""

ORACLES = {
    "op1_chat_perspectives": chat.ORACLE,
    "op6_lsh_forest": NEAR_DUPLICATES,
    "op8_line_rules": LINE_RULES,
    "op10_url_rules": URL_RULES,
    "op11_geometric_search": RANKED_SEARCH,
    "op12_audit_repair": CONVERSATION_REPAIR,
}
