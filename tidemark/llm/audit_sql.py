"""SQL that states the results of the queries on secrets, spelling variants and divergence."""

from __future__ import annotations

from tidemark.llm.secrets import KINDS, LEAST, LIVE_CHARACTERS, LIVE_DIGITS, LIVE_LENGTH, MAX_OWNERS, MAX_REPOS, PATTERNS, WORDLIKE

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_FOUND = " UNION ALL ".join(
    f"SELECT row, {k} AS kind, regexp_extract_all(text, {_quoted(PATTERNS[kind])}, 0) AS whole, "
    f"regexp_extract_all(text, {_quoted(PATTERNS[kind])}, {2 if kind == 'assign' else 0}) AS value, "
    f"string_split_regex(text, {_quoted(PATTERNS[kind])}) AS gap FROM d"
    for k, kind in enumerate(KINDS)
)
_NAMES = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_LEAST = "[" + ", ".join(str(LEAST[k]) for k in KINDS) + "]"

SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS repo FROM documents),
each AS (SELECT row, kind, i, whole[i] AS whole, value[i] AS value, gap[i] AS gap FROM (
  SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM ({_FOUND}))),
placed AS (SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY row, kind ORDER BY i) AS stop FROM each),
kept AS (SELECT row, kind, stop - length(whole) AS start, stop, sha256(value) AS hash,
    length(value) >= {LIVE_LENGTH} AND regexp_matches(value, '{LIVE_DIGITS}') AND NOT regexp_matches(value, '{WORDLIKE}')
      AND len(list_distinct(string_split(value, ''))) >= {LIVE_CHARACTERS} AS live
  FROM placed WHERE length(value) >= ({_LEAST})[kind + 1]),
spans AS (SELECT * FROM kept WHERE kind < 3 UNION ALL
  SELECT * FROM kept b WHERE kind = 3 AND live AND NOT EXISTS (
    SELECT 1 FROM kept o WHERE o.row = b.row AND o.kind < 3 AND o.start < b.stop AND b.start < o.stop)),
owners AS (SELECT hash, count(DISTINCT repo) AS n_repos, count(DISTINCT split_part(repo, '/', 1)) AS n_owners
  FROM spans JOIN d USING (row) GROUP BY hash),
judged AS (SELECT *, CASE WHEN n_owners > {MAX_OWNERS} OR n_repos > {MAX_REPOS} THEN 'copied' WHEN live THEN 'live' ELSE 'plain' END AS verdict,
    ({_NAMES})[kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM spans JOIN owners USING (hash)),
per_row AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    count(*) FILTER (kind = 3) AS n_bare, count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied,
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans
  FROM judged WHERE kind < 3 OR verdict = 'live' GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_bare, 0) AS n_bare,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_row USING (row)"""

SPELLING_SQL = f"""
WITH RECURSIVE t AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hx FROM runs),
hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx), 2), lambda k:
    CAST('0x' || substr(hx, k, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS h FROM hexed, t),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cuts.word, words.word FROM cuts JOIN words ON cuts.rest = words.word
  UNION SELECT words.word, cuts.word FROM cuts JOIN words ON cuts.rest = words.word),
best AS (SELECT pairs.word, count(*) AS n_near, first(near ORDER BY words.n DESC, near) AS form, max(words.n) AS form_n
  FROM pairs JOIN words ON words.word = pairs.near GROUP BY pairs.word),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * words.n THEN form END AS form,
  CASE WHEN form_n >= 5 * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.at WHERE forms.form IS NOT NULL)
SELECT forms.word, forms.form, chain.at AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN chain ON chain.word = forms.word JOIN forms e ON e.word = chain.at AND e.form IS NULL"""

DIVERGENCE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all({LOWERED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT row) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, kept.n AS lang_n
  FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS total, count(*) AS v, sum(lang_n) AS lang_total FROM every GROUP BY ALL),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS BIGINT) AS q
  FROM every JOIN totals USING (lang, source)),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
