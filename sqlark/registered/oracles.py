"""The same results as plain SQL for DuckDB, on the same whole tables."""

from __future__ import annotations

import itertools

from sqlark.operators.integrity import SOCIAL_FOREIGN_KEYS
from sqlark.registered.queries import BUDGETED, CHOICES, CHUNK, DIM, NAME, PAIRS, ROW_IDS, STATEMENTS, TWEET

SOCIAL = """
users AS (SELECT c_custkey AS user_id, c_name AS username,
  concat(lower(replace(c_name, '#', '.')), '@example.com') AS email FROM customer),
tweets AS (SELECT o_orderkey AS tweet_id, o_custkey AS user_id,
  concat('order ', o_orderkey, ' ', o_orderstatus) AS content, o_orderdate AS created_at
  FROM orders),
follows AS (SELECT DISTINCT o_custkey AS follower_id, l_suppkey AS followee_id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey <> l_suppkey),
likes AS (SELECT l_orderkey * 10 + l_linenumber AS like_id, l_partkey AS user_id, l_orderkey AS tweet_id,
  l_shipdate AS liked_at FROM lineitem),
comments AS (SELECT event_id AS comment_id, CAST(props->>'k' AS BIGINT) AS tweet_id, user_id,
  event_type AS content, ts AS created_at FROM events)
"""

CHUNKS = f"""
chunks AS (SELECT doc_id, CAST(i AS INTEGER) AS entity_id, source AS database,
  substring(text, i * {CHUNK} + 1, {CHUNK}) AS text
  FROM (SELECT doc_id, source, text, unnest(generate_series(0, (length(text) - 1) // {CHUNK})) AS i
        FROM documents WHERE length(text) > 0))
"""

_SEPARATORS = r"[\x00-\x20!-/:-@\[-`{-~]+"


def hashed(source: str, keys: str, name: str) -> str:
    """CTEs ``<name>_sparse(keys, i, x)`` and ``<name>(keys, e)``: hashed vectors of ``source.text``."""
    return f"""
{name}_hash AS (SELECT {keys}, md5(t) AS h FROM (
  SELECT {keys}, unnest(regexp_split_to_array(lower(text), '{_SEPARATORS}')) AS t FROM {source}) WHERE t <> ''),
{name}_sum AS (SELECT {keys}, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % {DIM} AS i,
  CAST(sum(1 - 2 * (CAST(('0x' || substr(h, 9, 1)) AS BIGINT) % 2)) AS DOUBLE) AS x FROM {name}_hash GROUP BY ALL),
{name}_sparse AS (SELECT {keys}, i, CAST(x / sqrt(sum(x * x) OVER (PARTITION BY {keys})) AS FLOAT) AS x
  FROM {name}_sum WHERE x <> 0),
{name}_full AS (SELECT * FROM (SELECT {keys} FROM {source}) CROSS JOIN (SELECT unnest(range({DIM})) AS i)),
{name} AS (SELECT {keys}, list(CAST(coalesce(x, 0) AS DOUBLE) ORDER BY i) AS e
  FROM {name}_full LEFT JOIN {name}_sparse USING ({keys}, i) GROUP BY {keys})
"""


BENCHMARK_SEARCH = f"""
{CHUNKS},
asked AS (SELECT item_id AS query_id, text FROM benchmark),
{hashed("chunks", "doc_id, entity_id", "chunk_vectors")},
{hashed("asked", "query_id", "query_vectors")},
hits AS (SELECT query_id, doc_id, entity_id, d,
  row_number() OVER (PARTITION BY query_id ORDER BY CAST(d AS FLOAT), doc_id, entity_id) AS rank
  FROM (SELECT query_id, doc_id, entity_id, list_distance(q.e, c.e) AS d
        FROM query_vectors q CROSS JOIN chunk_vectors c) QUALIFY rank <= 3),
texts AS (SELECT query_id, rank, doc_id, entity_id, chunks.text, d FROM hits JOIN chunks USING (doc_id, entity_id))
"""

FIRST_VECTOR = """
asked AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE) + 0.01) AS q FROM embeddings WHERE vec_id = 7),
scored AS (SELECT vec_id, label, list_distance(CAST(embedding AS DOUBLE[]), q) AS d FROM embeddings CROSS JOIN asked)
"""

ANSWERS = """
answers AS (SELECT conv_id, turn, CASE turn % 4
  WHEN 0 THEN concat('Here:', chr(10), '```sql', chr(10), text, chr(10), '```', chr(10), 'TERMINATE')
  WHEN 1 THEN concat('```sql ', text, ' Terminate ', chr(10), '```')
  WHEN 2 THEN concat('Use `sql ', text, '` now') ELSE text END AS outputs FROM conversations)
"""

STOPPING = """
stopping AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN concat(text, ' TERMINATE')
  WHEN turn % 7 = 6 THEN '' ELSE text END AS text,
  CASE role WHEN 'system' THEN 'planner' WHEN 'assistant' THEN 'writer' ELSE role END AS speaker FROM conversations),
ruled AS (SELECT *, CASE WHEN speaker = 'user' THEN 'planner' WHEN speaker IN ('planner', 'reviewer') THEN 'writer'
  WHEN speaker = 'writer' AND contains(lower(text), 'terminate') THEN 'user'
  WHEN speaker = 'writer' THEN 'reviewer' ELSE 'auto' END AS next_speaker FROM stopping)
"""

_SPACE = r"[ \t\r\n\f]"
SENTENCES = rf"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS entity_id, s[i] AS text FROM (
  SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?]){_SPACE}+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: x <> '') AS s FROM documents))
"""
LINE_SENTENCES = rf"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS entity_id, s[i] AS text FROM (
  SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT doc_id, list_filter(list_transform(
      string_split(regexp_replace(regexp_replace(text, '\n+', chr(1), 'g'), '([.!?]){_SPACE}+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10) || chr(12))), lambda x: x <> '') AS s FROM documents))
"""

PAGED = "WITH paged AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"

LCS_ROW = """list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE
  WHEN b[j] = ch THEN prev[j] + 1 ELSE greatest(acc[len(acc)], prev[j + 1]) END), [0])"""


def _entries(vectors: str, keys: str, vector: str) -> str:
    return f"""SELECT {keys}, CAST(i - 1 AS BIGINT) AS i, round(CAST(v[i] AS DOUBLE), 5) AS x FROM (
      SELECT {keys}, {vector} AS v, unnest(range(1, len({vector}) + 1)) AS i FROM {vectors}) WHERE v[i] <> 0"""


_SHORT = """list_transform(embedding[1:16], lambda x: CAST(CAST(x AS DOUBLE)
  / sqrt(list_sum(list_transform(embedding[1:16], lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) AS FLOAT))"""


def _flags(tests: dict[str, str], name: str) -> str:
    rows = " UNION ALL ".join(f"SELECT '{item}' AS item, CAST({test} AS INTEGER) AS {name}" for item, test in tests.items())
    return f"WITH {SOCIAL} {rows}"


def _within(a: str, b: str) -> str:
    """1 when the rows of ``a`` are among those of ``b``, duplicates counted."""
    return f"(SELECT count(*) = 0 FROM ({a} EXCEPT ALL {b}))"


def _same_result() -> str:
    never = {"columns swapped", "extra column", "renamed and wider", "text for number"}
    always = {"both empty"}
    tests = {}
    for item, (expected, generated) in PAIRS.items():
        both = f"{_within(expected, generated)} AND {_within(generated, expected)}"
        tests[item] = "FALSE" if item in never else "TRUE" if item in always else both
    return _flags(tests, "coincidence")


def _contains_result() -> str:
    """Column matching written out by hand for each pair."""
    tests = {item: _within(*pair) for item, pair in PAIRS.items()}
    tests["columns swapped"] = _within("SELECT user_id, username FROM users", "SELECT user_id, username FROM users")
    tests["extra column"] = _within("SELECT username FROM users", "SELECT username FROM users")
    tests["renamed and wider"] = _within("SELECT user_id, email FROM users", "SELECT user_id, email FROM users")
    tests["text for number"] = "FALSE"
    tests["both empty"] = "TRUE"
    return _flags(tests, "contained")


def _run_sql() -> str:
    fails = {"unknown column", "insert", "several rows", "empty"}
    rows = " UNION ALL ".join(
        f"SELECT '{item}' AS item, "
        + ("'Error'" if item in fails else f"(SELECT CAST(count(*) AS VARCHAR) FROM ({sql.rstrip(';')}))")
        + " AS outcome"
        for item, sql in STATEMENTS.items()
    )
    return f"WITH {SOCIAL} {rows}"


_USER_ID = f"(SELECT user_id FROM users WHERE username = '{NAME}')"
_DOOMED = "(SELECT c_custkey FROM customer WHERE c_acctbal < 0)"
_DOOMED_TWEETS = f"(SELECT tweet_id FROM tweets WHERE user_id IN {_DOOMED})"

_SOCIAL_COLUMNS = {
    "users": ("user_id", "username", "email"),
    "tweets": ("tweet_id", "user_id", "content"),
    "follows": ("follower_id", "followee_id"),
    "likes": ("like_id", "user_id", "tweet_id"),
    "comments": ("comment_id", "tweet_id", "user_id", "content"),
}


def _social_rules() -> list[str]:
    """One SELECT for each declared rule whose columns the views have."""
    keys = {"users": ["user_id", "username", "email"], "follows": ["follower_id, followee_id"]}
    found = []
    for name, columns in _SOCIAL_COLUMNS.items():
        as_rule = f"SELECT '{name}' AS table_name, '{{}}' AS rule, count(*) AS n_rows FROM "
        for key in keys.get(name, [columns[0]]):
            present = " AND ".join(f"{c.strip()} IS NOT NULL" for c in key.split(","))
            found.append(
                as_rule.format(f"{key} unique") + f"(SELECT {key} FROM {name} WHERE {present} GROUP BY {key} HAVING count(*) > 1)"
            )
        found += [as_rule.format(f"{c} not null") + f"{name} WHERE {c} IS NULL" for c in columns]
    for column, most in (("username", 50), ("email", 100)):
        found.append(f"SELECT 'users', '{column} length {most}', count(*) FROM users WHERE length({column}) > {most}")
    return found


def _column_matching() -> str:
    """Every choice of columns, one after the other."""
    def one(item: str, expected: list[str], generated: list[str]) -> str:
        tests = [
            f"NOT EXISTS (SELECT {', '.join(expected)} FROM orders EXCEPT ALL SELECT {', '.join(chosen)} FROM orders)"
            for chosen in itertools.permutations(generated, len(expected))
        ]
        return f"SELECT '{item}' AS item, CAST({' OR '.join(tests)} AS INTEGER) AS contained"

    return " UNION ALL ".join(one(item, *columns) for item, columns in CHOICES.items())


ORACLES: dict[str, str] = {
    "s1_table_scan": f"WITH {SOCIAL} "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("users", "tweets", "follows", "likes", "comments")
    ),
    "s2_question_set": """SELECT concat_ws(' ', conv_id, turn, text) AS question,
      concat('SELECT text FROM conversations WHERE conv_id = ', conv_id, ' AND turn = ', turn) AS expected_sql
      FROM conversations""",
    "s3_document_source": "SELECT md5(text) AS text_md5, CAST(length(text) AS BIGINT) AS n_chars FROM documents",
    "s4_store_vectors": """SELECT CAST(label AS VARCHAR) AS database, 2 * count(*) AS n_rows,
      CAST(2 * sum(vec_id) AS BIGINT) AS sum_entity FROM embeddings GROUP BY label""",
    "s4_serial_ids": """SELECT vec_id AS id FROM embeddings UNION ALL
      SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id) FROM embeddings""",
    "s4_appends_at_once": """SELECT vec_id % 2 AS half, count(*) AS n_rows, count(*) AS n_ids, count(*) AS range_of_ids
      FROM embeddings GROUP BY vec_id % 2""",
    "s5_delete_vectors": "SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_after FROM embeddings",
    "s6_csv_round_trip": """SELECT conv_id, turn, concat('SELECT "', text, '",', chr(10), '1') AS generated_sql
      FROM conversations""",
    "s7_run_log": """SELECT concat(o_orderstatus, '/', o_orderpriority) AS run_id, o_orderstatus AS status,
      o_orderpriority AS priority, CAST(count(*) AS DOUBLE) AS n_orders FROM orders GROUP BY o_orderstatus, o_orderpriority""",
    "s8_insert_with_defaults": """SELECT (SELECT max(o_orderkey) FROM orders)
      + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS o_orderkey, o_orderkey AS old_key,
      CAST(1 AS INTEGER) AS has_time FROM orders""",
    "i1_unique_violations": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
      WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY ALL HAVING count(*) > 1""",
    "i2_social_rules": f"WITH {SOCIAL} " + " UNION ALL ".join(_social_rules()),
    "i2_value_violations": "WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) "
    + " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) AS n_rows FROM d WHERE {broken}"
        for rule, broken in (
            ("text not null", "text IS NULL"),
            ("lang not null", "lang IS NULL"),
            ("quality not null", "quality IS NULL"),
            ("text length 1536", "length(text) > 1536"),
            ("source length 5", "length(source) > 5"),
        )
    ),
    "i3_orphans": f"WITH {SOCIAL} " + " UNION ALL ".join(
        f"""SELECT '{k.child}' AS table_name, '{k.column}' AS broken_key, CAST({ROW_IDS[k.child]} AS BIGINT) AS row_id,
        CAST({k.column} AS BIGINT) AS missing FROM {k.child} c WHERE {k.column} IS NOT NULL
        AND NOT EXISTS (SELECT 1 FROM {k.parent} p WHERE p.{k.parent_column} = c.{k.column})"""
        for k in SOCIAL_FOREIGN_KEYS
    ),
    "i4_cascade_delete": f"""WITH {SOCIAL}
      SELECT 'users' AS table_name, count(*) AS n_rows FROM users WHERE user_id NOT IN {_DOOMED}
      UNION ALL SELECT 'tweets', count(*) FROM tweets WHERE user_id NOT IN {_DOOMED}
      UNION ALL SELECT 'follows', count(*) FROM follows WHERE follower_id NOT IN {_DOOMED} AND followee_id NOT IN {_DOOMED}
      UNION ALL SELECT 'likes', count(*) FROM likes WHERE user_id NOT IN {_DOOMED} AND tweet_id NOT IN {_DOOMED_TWEETS}
      UNION ALL SELECT 'comments', count(*) FROM comments
        WHERE user_id NOT IN {_DOOMED} AND tweet_id NOT IN {_DOOMED_TWEETS}""",
    "i5_vector_dimensions": """SELECT CAST(len(embedding) AS BIGINT) AS dimensions, count(*) AS n_rows FROM embeddings
      WHERE len(embedding) <> 16 GROUP BY 1""",
    "q1_users_with_email": f"WITH {SOCIAL} SELECT username, email FROM users",
    "q2_tweets_with_authors": f"WITH {SOCIAL} SELECT t.content, u.username FROM tweets t JOIN users u USING (user_id)",
    "q3_followed_by": f"""WITH {SOCIAL} SELECT u2.username FROM users u1 JOIN follows f ON u1.user_id = f.follower_id
      JOIN users u2 ON f.followee_id = u2.user_id WHERE u1.username = '{NAME}'""",
    "q4_followers_per_user": f"""WITH {SOCIAL} SELECT u.username, count(f.follower_id) AS followers_count
      FROM users u LEFT JOIN follows f ON u.user_id = f.followee_id GROUP BY u.user_id, u.username""",
    "q5_likes_per_tweet": f"""WITH {SOCIAL} SELECT t.content, count(l.like_id) AS like_count
      FROM tweets t LEFT JOIN likes l ON t.tweet_id = l.tweet_id GROUP BY t.tweet_id, t.content""",
    "q6_comments_of_tweet": f"""WITH {SOCIAL} SELECT c.content, u.username FROM comments c
      JOIN users u ON c.user_id = u.user_id WHERE c.tweet_id = {TWEET}""",
    "q7_likers_of_user": f"""WITH {SOCIAL} SELECT DISTINCT u.username FROM likes l JOIN tweets t ON l.tweet_id = t.tweet_id
      JOIN users u ON l.user_id = u.user_id WHERE t.user_id = {_USER_ID}""",
    "q8_most_commented_tweet": f"""WITH {SOCIAL} SELECT t.content, count(c.comment_id) AS comments_count
      FROM tweets t LEFT JOIN comments c ON t.tweet_id = c.tweet_id GROUP BY t.tweet_id, t.content
      ORDER BY comments_count DESC, t.tweet_id LIMIT 1""",
    "q9_users_without_tweets": f"""WITH {SOCIAL} SELECT u.username FROM users u
      WHERE u.user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
    "q10_liked_by_followers": f"""WITH {SOCIAL} SELECT DISTINCT t.content FROM tweets t JOIN likes l ON t.tweet_id = l.tweet_id
      JOIN follows f ON l.user_id = f.follower_id WHERE f.followee_id = {_USER_ID}""",
    "q11_scalar_lookup": f"""WITH {SOCIAL} SELECT count(*) FILTER (user_id = {_USER_ID}) AS n_found,
      count(*) FILTER (user_id = (SELECT user_id FROM users WHERE username = 'nobody')) AS n_missing FROM tweets""",
    "q12_choices_with_all": """SELECT CAST(0 AS INTEGER) AS place, 'All' AS choice UNION ALL
      SELECT DISTINCT CAST(1 AS INTEGER), event_type FROM events WHERE event_type IS NOT NULL""",
    "t1_concat_pages": """SELECT conv_id AS doc_id, CAST(0 AS BIGINT) AS part_no,
      string_agg(text || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
    "t1_concat_pages_plain": """SELECT conv_id AS doc_id, CAST(0 AS BIGINT) AS part_no,
      string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""",
    "t1_concat_numberless_pages": """WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id),
      pages AS (SELECT CASE WHEN conv_id % 11 <> 3 THEN conv_id END AS doc_id,
        CASE WHEN conv_id % 11 = 3 THEN conv_id * 100 + turn WHEN turn <> last THEN turn ELSE -1 END AS place, text
        FROM conversations JOIN last USING (conv_id)),
      whole AS (SELECT doc_id, string_agg(text || chr(10), '' ORDER BY place) AS text FROM pages GROUP BY doc_id)
      SELECT coalesce(CAST(doc_id AS VARCHAR), 'none') AS doc_id, CAST(0 AS BIGINT) AS part_no, text,
      CAST(length(text) AS BIGINT) AS n_chars FROM whole""",
    "t2_chunk_fixed": f"WITH {CHUNKS} SELECT doc_id, entity_id, text FROM chunks",
    "t2_chunk_pages": f"""WITH whole AS (SELECT conv_id AS doc_id, string_agg(text || chr(10), '' ORDER BY turn) AS text
      FROM conversations GROUP BY conv_id)
      SELECT doc_id, CAST(i AS INTEGER) AS entity_id, substring(text, i * {CHUNK} + 1, {CHUNK}) AS text FROM (
        SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // {CHUNK})) AS i FROM whole
        WHERE length(text) > 0)""",
    "t3_chunk_sentences": SENTENCES,
    "t3_chunk_page_sentences": PAGED + SENTENCES.replace("FROM documents", "FROM paged"),
    "t4_chunk_lines": LINE_SENTENCES,
    "t4_chunk_page_lines": PAGED + LINE_SENTENCES.replace("FROM documents", "FROM paged"),
    "t5_chunks_by_strategy": f"""WITH {CHUNKS} SELECT 'fixed' AS strategy, count(*) AS n_chunks FROM chunks
      UNION ALL SELECT 'nltk', count(*) FROM ({SENTENCES}) UNION ALL SELECT 'spacy', count(*) FROM ({LINE_SENTENCES})""",
    "t6_chunk_numbers": f"""SELECT doc_id, CAST(0 AS BIGINT) AS first_no,
      CAST((length(text) - 1) // {CHUNK} AS BIGINT) AS last_no, CAST((length(text) - 1) // {CHUNK} + 1 AS BIGINT) AS n_chunks
      FROM documents WHERE length(text) > 0""",
    "t7_embed_chunks": f"""WITH {CHUNKS}, {hashed("chunks", "doc_id, entity_id", "v")}
      SELECT doc_id, entity_id, i, round(CAST(x AS DOUBLE), 5) AS x FROM v_sparse""",
    "t7_embed_once": f"""WITH {CHUNKS} SELECT doc_id, count(*) AS n_chunks, count(*) AS n_vectors, CAST(0 AS BIGINT) AS n_changed
      FROM chunks GROUP BY doc_id""",
    "t8_cut_vectors": _entries("embeddings", "vec_id", "embedding[1:16]"),
    "t9_shorten_vectors": _entries("embeddings", "vec_id", _SHORT),
    "t10_model_registry": " UNION ALL ".join(
        f"""SELECT vec_id, '{model}' AS model, round(list_sum(list_transform({vector},
        lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS square FROM embeddings"""
        for model, vector in (
            ("text-embedding-3-small", "embedding[1:16]"),
            ("text-embedding-3-large", _SHORT),
        )
    ),
    "t11_compute_vectors": f"""WITH {CHUNKS}, {hashed("chunks", "doc_id, entity_id", "v")},
      head AS (SELECT *, sqrt(sum(CAST(x AS DOUBLE) * CAST(x AS DOUBLE)) OVER (PARTITION BY doc_id, entity_id)) AS norm
        FROM v_sparse WHERE i < 16)
      SELECT doc_id, entity_id, i, round(CAST(CAST(CAST(x AS DOUBLE) / norm AS FLOAT) AS DOUBLE), 5) AS x FROM head""",
    "t12_upload": f"WITH {CHUNKS} SELECT database, count(*) AS n_rows FROM chunks GROUP BY database",
    "t12_upload_pages": f"""SELECT 'chats' AS database, CAST(sum((n + {CHUNK} - 1) // {CHUNK}) AS BIGINT) AS n_rows
      FROM (SELECT sum(length(text)) AS n FROM conversations GROUP BY conv_id)""",
    "v1_distance": """SELECT a.vec_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)
      AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "v2_nearest": f"""WITH {FIRST_VECTOR} SELECT vec_id, label, round(d, 5) AS score FROM scored
      ORDER BY CAST(d AS FLOAT), vec_id LIMIT 10""",
    "v3_nearest_in_database": f"""WITH {FIRST_VECTOR} SELECT vec_id AS id, round(d, 5) AS score,
      CAST(label AS VARCHAR) AS database FROM scored WHERE label = 3 ORDER BY CAST(d AS FLOAT), vec_id LIMIT 5""",
    "v4_batch_nearest": f"""WITH {BENCHMARK_SEARCH}
      SELECT query_id, rank, doc_id, entity_id, round(d, 5) AS score FROM hits""",
    "v4_batch_nearest_by_database": f"""WITH {CHUNKS}, asked AS (SELECT item_id AS query_id, text FROM benchmark),
      {hashed("chunks", "doc_id, entity_id", "cv")}, {hashed("asked", "query_id", "qv")},
      hits AS (SELECT query_id, database, doc_id, entity_id, d, row_number() OVER (
        PARTITION BY query_id, database ORDER BY CAST(d AS FLOAT), doc_id, entity_id) AS rank
        FROM (SELECT query_id, database, doc_id, entity_id, list_distance(qv.e, cv.e) AS d
              FROM qv CROSS JOIN cv JOIN chunks USING (doc_id, entity_id)) QUALIFY rank <= 2)
      SELECT query_id, database, rank, doc_id, entity_id, round(d, 5) AS score FROM hits""",
    "v5_nested_results": f"""WITH {BENCHMARK_SEARCH}
      SELECT query_id, rank - 1 AS place, doc_id AS id, text AS content, round(d, 5) AS score FROM texts""",
    "v6_context": f"""WITH {BENCHMARK_SEARCH}
      SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS context FROM texts GROUP BY query_id""",
    "v7_prompt": f"""WITH {BENCHMARK_SEARCH},
      contexts AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS context FROM texts GROUP BY query_id)
      SELECT query_id, concat(chr(10), '            Based on the embeddings in vector_embeddings_256, ',
        'generate the SQL query to answer: ', asked.text, '.', chr(10),
        '            Please provide only the SQL code enclosed within ```sql...``` characters.', chr(10),
        '            Context: ', context, chr(10), '            ',
        CASE WHEN query_id > 10 THEN concat(chr(10), chr(10), 'The database is social_network') ELSE '' END) AS prompt
      FROM asked JOIN contexts USING (query_id)""",
    "e1_loose_sql": f"WITH {ANSWERS} SELECT conv_id, turn, regexp_extract(outputs, '(?s)`sql(.*?)`', 1) AS generated_sql FROM answers",
    "e2_strict_sql": rf"""WITH {ANSWERS} SELECT conv_id, turn, trim(regexp_replace(trim(
        regexp_extract(outputs, '(?s)```sql(.*?)```', 1), ' ' || chr(10)), '(?i)terminate', '', 'g'), ' ' || chr(10)) AS generated_sql
      FROM answers""",
    "e3_similarity": f"""WITH texts AS (SELECT DISTINCT p_name AS x, lower(p_type) AS y FROM part),
      chars AS (SELECT x, y, string_split(x, '') AS a, string_split(y, '') AS b FROM texts),
      scored AS (SELECT x, y, len(a) AS m, len(b) AS n, list_last(list_reduce(a, lambda prev, ch: {LCS_ROW},
        list_transform(range(len(b) + 1), lambda z: 0))) AS lcs FROM chars)
      SELECT p_partkey, CAST(CASE WHEN x = y THEN 100 ELSE round_even(100 * (2.0 * lcs / (m + n)), 0) END AS INTEGER) AS similarity
      FROM part JOIN scored ON x = p_name AND y = lower(p_type)""",
    "e4_run_sql": _run_sql(),
    "e4_statement_budget": " UNION ALL ".join(
        f"SELECT '{item}' AS item, " + ("'Error'" if item == "runaway" else f"CAST((SELECT count(*) FROM ({sql})) AS VARCHAR)") + " AS outcome"
        for item, sql in BUDGETED.items()
    ),
    "e7_column_matching": _column_matching(),
    "e5_column_names": f"""WITH {SOCIAL} SELECT tweet_id, count(*) AS "Column2", max(user_id) + 1 AS "Column3",
      min(like_id) AS first_like FROM likes GROUP BY tweet_id""",
    "e6_same_result": _same_result(),
    "e7_contains_result": _contains_result(),
    "e8_coincidence": """SELECT doc_id, CAST(CASE WHEN quality = 1 THEN 1 WHEN toxic IS NOT NULL THEN toxic
      WHEN lang = 'en' THEN 1 ELSE 0 END AS INTEGER) AS result_coincidence FROM documents LEFT JOIN labels USING (doc_id)""",
    "e10_run_metrics": """WITH runs AS (SELECT source AS run_id FROM documents UNION SELECT lang FROM documents),
      means AS (SELECT source AS run_id, avg(quality * 100) AS s, avg(toxic) AS a FROM documents JOIN labels USING (doc_id)
        GROUP BY source)
      SELECT run_id, round(coalesce(s, 0), 6) AS average_similarity, round(coalesce(a, 0), 6) AS average_accuracy
      FROM runs LEFT JOIN means USING (run_id)""",
    "e11_configuration_sweep": """SELECT item_id, CAST(chunk_size AS INTEGER) AS chunk_size, chunk_strategy, embedding_model,
      concat(chunk_size, '/', chunk_strategy, '/', embedding_model) AS run_id FROM benchmark
      CROSS JOIN (SELECT unnest([256, 512, 1536]) AS chunk_size)
      CROSS JOIN (SELECT unnest(['fixed', 'nltk', 'spacy']) AS chunk_strategy)
      CROSS JOIN (SELECT unnest(['text-embedding-3-small', 'text-embedding-3-large', 'text-embedding-ada-002'])
        AS embedding_model)""",
    "e12_best_configuration": """SELECT concat(c_mktsegment, '/', o_orderpriority) AS run_id,
      round(avg(floor(o_totalprice / 10000)), 6) AS average_similarity,
      round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS average_accuracy
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
      ORDER BY avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) DESC, avg(floor(o_totalprice / 10000)) DESC, 1 LIMIT 1""",
    "c1_final_messages": """SELECT conv_id, turn, role, text FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "c2_stop_flags": f"""WITH {STOPPING} SELECT conv_id, turn,
      CAST(coalesce(upper(right(text, 9)) = 'TERMINATE', FALSE) AS INTEGER) AS ends_with_stop,
      CAST(coalesce(contains(lower(text), 'terminate'), FALSE) AS INTEGER) AS mentions_stop FROM stopping""",
    "c3_shown_text": f"""WITH {STOPPING} SELECT conv_id, turn, CASE WHEN text = '' THEN 'Agents are working on the request...'
      ELSE replace(text, 'TERMINATE', '') END AS shown FROM stopping""",
    "c4_next_speaker": f"WITH {STOPPING} SELECT conv_id, turn, speaker, next_speaker FROM ruled",
    "c5_transition_audit": f"""WITH {STOPPING},
      linked AS (SELECT *, lead(speaker) OVER (PARTITION BY conv_id ORDER BY turn) AS observed FROM ruled)
      SELECT speaker, next_speaker AS expected, observed, count(*) AS n_transitions,
        CAST(next_speaker IN ('auto', observed) AS INTEGER) AS follows_rule, CAST(speaker = observed AS INTEGER) AS repeats
      FROM linked WHERE observed IS NOT NULL GROUP BY ALL""",
    "c6_first_rounds": """SELECT conv_id, turn, role, text FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 3""",
    "c7_rendered_transcripts": """SELECT conv_id, CAST(0 AS BIGINT) AS part_no, string_agg(
      concat('**', role, '** (', role, '): <span style=''color:blue''>', text, '</span>'), chr(10) || chr(10) ORDER BY turn)
      AS text FROM conversations GROUP BY conv_id""",
    "c8_message_json": """SELECT conv_id, turn, CAST(CASE WHEN role <> 'user'
      THEN to_json({'agents_chat': {'role': role, 'content': text}, 'user_chat': NULL})
      ELSE to_json({'agents_chat': NULL, 'user_chat': {'role': role, 'content': text}}) END AS VARCHAR) AS message
      FROM conversations""",
    "w1_stream_files": f"""WITH files AS (SELECT sum(length(text) + 1) AS n FROM documents WHERE text IS NOT NULL GROUP BY lang, source)
      SELECT 'files' AS database, count(*) AS n_files, CAST(sum((n + {CHUNK} - 1) // {CHUNK}) AS BIGINT) AS n_rows,
      CAST(sum((n + {CHUNK} - 1) // {CHUNK}) AS BIGINT) AS n_ids, CAST(sum(n) AS BIGINT) AS n_chars FROM files""",
    "w1_stream_upload": f"""WITH {CHUNKS} SELECT database, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars,
      CAST({DIM} * count(*) AS BIGINT) AS n_entries FROM chunks GROUP BY database""",
}
