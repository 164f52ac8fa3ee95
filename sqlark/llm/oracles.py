"""The same as SQL, where SQL can express it."""

from __future__ import annotations

from sqlark.llm import quality_rules, secret_scan

_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_ASSIGN = "(" + "|".join(map(_EITHER, _KEYWORDS)) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS kind_no, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM docs"
    for i, p in enumerate((_ASSIGN, *secret_scan.PATTERNS[1:]))
)
_ALLOWED = " OR ".join(f"regexp_matches(s, '{p}')" for p in secret_scan.ALLOW)
_LIMITS = secret_scan.ENTROPY

OP3 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
placed AS (
  SELECT doc_id, kind_no, m[i] AS s, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM found)
),
candidates AS (
  SELECT DISTINCT s, CASE WHEN NOT regexp_matches(s, '[0-9]') THEN {_LIMITS["alpha"]} WHEN regexp_matches(s, '^[0-9a-fA-F]+$') THEN {_LIMITS["hex"]}
    WHEN regexp_matches(s, '^[0-9A-Za-z]+$') THEN {_LIMITS["alnum"]} ELSE {_LIMITS["base64"]} END AS least
  FROM placed WHERE kind_no = 3 AND regexp_matches(s, '[A-Za-z]') AND NOT ({_ALLOWED})
),
letters AS (
  SELECT s, least, i, c, count(*) AS n FROM (
    SELECT s, least, i, unnest(string_split(substring(s, i, {secret_scan.WINDOW}), '')) AS c
    FROM (SELECT s, least, unnest(generate_series(1, length(s) - {secret_scan.WINDOW - 1})) AS i FROM candidates))
  GROUP BY ALL
),
random AS (
  SELECT DISTINCT s FROM (SELECT s, least, i, sum(n * log2(n)) AS total FROM letters GROUP BY ALL)
  WHERE log2({secret_scan.WINDOW}) - total / {secret_scan.WINDOW} >= least
),
kept AS (
  SELECT doc_id, kind_no, start, (['assign', 'access', 'hex', 'entropy'])[kind_no + 1] || ':' || start || ':' || (start + length(s)) AS span
  FROM placed
  WHERE CASE kind_no WHEN 0 THEN length(regexp_extract(s, '{_ASSIGN}', 2)) >= {secret_scan.MIN_SECRET}
    WHEN 1 THEN length(s) >= {secret_scan.MIN_ACCESS} WHEN 2 THEN TRUE ELSE s IN (SELECT s FROM random) END
)
SELECT d.doc_id, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access,
  count(*) FILTER (kind_no = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no IS NOT NULL), '') AS spans,
  count(*) FILTER (kind_no = 3) AS n_entropy
FROM docs d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
"""

OP8 = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line, len(parts) AS n
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, max(n) AS n_lines, CAST(count(*) FILTER (s.key IS NOT NULL AND s.last <> k.doc_id) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (s.key IS NULL OR s.last = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN shared s USING (key) GROUP BY k.doc_id
"""

OP4 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS phrase, least(len(w), 13) AS size
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows
), found AS (
  SELECT doc_id, i, size, item_id FROM (
    SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS phrase
    FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM words, sizes WHERE len(w) >= size)
  ) JOIN windows USING (phrase, size)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS p FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM found GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_RULES = quality_rules
_BADNESS = {
    "symbols": "(1000 * n_symbols) // nullif(n_words, 0)",
    "repeated_lines": "(1000 * n_dup_lines) // nullif(n_lines, 0)",
    "repeated_words": "(1000 * n_repeat_words) // nullif(n_words, 0)",
    "long_words": "(100 * word_chars) // nullif(n_words, 0)",
    "short_words": "-((100 * word_chars) // nullif(n_words, 0))",
}
_STRATUM = f"CASE WHEN n_words <= {_RULES.STRATA[0]} THEN 0 WHEN n_words <= {_RULES.STRATA[1]} THEN 1 ELSE 2 END"
_SHARE = _RULES.RISK / len(_RULES.CUTOFFS)
_CUTOFFS = ", ".join(f"('{rule}', {i}, {c})" for rule, cutoffs in _RULES.CUTOFFS.items() for i, c in enumerate(cutoffs))
_JUDGED = " UNION ALL ".join(f"SELECT row_no, stratum, '{rule}' AS rule, {bad} AS bad FROM strata" for rule, bad in _BADNESS.items())

OP11 = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT row_no, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
placed AS (SELECT row_no, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
triples AS (
  SELECT row_no, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS triple
  FROM placed WINDOW o AS (PARTITION BY row_no ORDER BY i)
),
windows AS (SELECT row_no, i, count(*) OVER (PARTITION BY row_no, triple) AS n FROM triples WHERE triple IS NOT NULL),
repeated AS (SELECT row_no, count(DISTINCT p) AS n FROM (SELECT row_no, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY row_no),
lines AS (
  SELECT row_no, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row_no, unnest(string_split(t, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row_no
),
counts AS (
  SELECT d.row_no, d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.n_dup_lines, 0) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n_lines, 0) AS n_lines
  FROM docs d JOIN words USING (row_no) LEFT JOIN repeated r USING (row_no) LEFT JOIN lines l USING (row_no)
),
strata AS (
  SELECT *, {_STRATUM} AS stratum, n_words < {_RULES.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
),
cutoffs(rule, step, cutoff) AS (VALUES {_CUTOFFS}),
judged AS ({_JUDGED}),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
held AS (
  SELECT j.stratum, j.rule, j.bad, k.quality = 1 AS good
  FROM judged j JOIN strata s USING (row_no) JOIN known k ON s.doc_id = k.doc_id WHERE NOT s.base_failed
),
tested AS (
  SELECT stratum, rule, step, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (NOT good) AS n_bad,
    count(*) FILTER (good AND bad > cutoff) AS k, count(*) FILTER (NOT good AND bad > cutoff) AS k_bad
  FROM held JOIN cutoffs USING (rule) GROUP BY ALL
),
tails AS (
  SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE!r}) + (n - i) * ln(1 - {_SHARE!r})))
    FROM (SELECT unnest(generate_series(0, k)) AS i)) AS tail FROM tested WHERE n > 0
),
certified AS (
  SELECT * FROM (SELECT *, max(tail) OVER (PARTITION BY stratum, rule ORDER BY step) AS worst FROM tails)
  WHERE worst <= {_RULES.DELTA!r} / {len(_RULES.CUTOFFS) * (len(_RULES.STRATA) + 1)} AND k_bad * n > k * n_bad
),
chosen AS (
  SELECT stratum, rule, cutoff FROM certified
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY k_bad DESC, step) = 1
),
broken AS (SELECT DISTINCT row_no FROM judged JOIN chosen USING (stratum, rule) WHERE bad > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND row_no NOT IN (SELECT row_no FROM broken) AS kept
FROM strata
"""

OP13 = r"""
WITH terms AS (
  SELECT row_no, doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (
    SELECT row_number() OVER () AS row_no, doc_id,
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL)
), asked AS (
  SELECT item_no, item_id, term, count(*) AS repeats FROM (
    SELECT item_no, item_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (
      SELECT row_number() OVER () AS item_no, item_id,
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark WHERE text IS NOT NULL))
  GROUP BY ALL
), sizes AS (SELECT row_no, any_value(doc_id) AS doc_id, count(*) AS n FROM terms GROUP BY row_no
), totals AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS size FROM sizes
), counts AS (SELECT row_no, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, totals GROUP BY term, documents
), scored AS (
  SELECT item_no, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id, row_no,
    CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * documents) // size))))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN sizes USING (row_no), totals
  GROUP BY item_no, row_no
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
WHERE place <= 20
"""

ORACLES = {"op3_secret_scan": OP3, "op4_decontaminate": OP4, "op8_line_dedup": OP8, "op11_quality_rules": OP11, "op13_lexical_search": OP13}
