"""The same queries as SQL text, written apart from the Spark code."""

from __future__ import annotations

_BASE = """
WITH wide AS (
    SELECT CAST(conv_id * 2 + turn // 4 AS VARCHAR) AS perm,
           max(CASE WHEN turn % 4 = 0 THEN text END) AS r1,
           max(CASE WHEN turn % 4 = 1 THEN text END) AS r2,
           max(CASE WHEN turn % 4 = 2 THEN text END) AS r3,
           max(CASE WHEN turn % 4 = 3 THEN text END) AS r4,
           'D' || CAST(conv_id % 5 AS VARCHAR) AS dept,
           CAST(conv_id % 2 AS INTEGER) AS first_gen
    FROM conversations GROUP BY conv_id, turn // 4
),
texts AS (
    SELECT perm AS student_id, question_id, text
    FROM wide UNPIVOT (text FOR question_id IN (r1, r2, r3, r4))
),
emb AS (
    SELECT coalesce(CAST(conv_id * 2 + turn // 4 AS VARCHAR), 'v' || vec_id) AS student_id,
           coalesce('r' || CAST(turn % 4 + 1 AS VARCHAR), 'r1') AS question_id,
           embedding
    FROM embeddings LEFT JOIN conversations ON vec_id = conv_id * 8 + turn
),
rounds AS (
    SELECT perm, r1, r2, r3, r4, 1 AS round FROM wide
    UNION ALL SELECT perm, r2, r3, r4, r1, 2 FROM wide
),
round_texts AS (
    SELECT perm AS student_id, question_id, text, round
    FROM rounds UNPIVOT (text FOR question_id IN (r1, r2, r3, r4))
),
round_first AS (
    SELECT student_id, question_id, text FROM (
        SELECT *, row_number() OVER (
            PARTITION BY student_id, question_id ORDER BY round, text) AS n
        FROM round_texts) WHERE n = 1
)
"""

# Fixed value: the instruction before a question.
_PREFIX = "Represent this sentence for searching relevant passages: "


def _counts(name: str, source: str, keys: str) -> str:
    """CTEs ``name``: word counts in 64 buckets for every row of ``source(keys, text)``."""
    return f"""
, {name}_words AS (
    SELECT {keys}, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS word FROM {source}
),
{name}_buckets AS (
    SELECT {keys}, CAST(('0x' || substr(md5(lower(word)), 1, 8)) AS BIGINT) % 64 AS pos,
           count(*) AS n
    FROM {name}_words GROUP BY ALL
),
{name}_cells AS (
    SELECT s.*, p.pos FROM (SELECT {keys} FROM {source}) s, range(64) p(pos)
),
{name}_elements AS (
    SELECT c.*, CAST(coalesce(b.n, 0) AS DOUBLE) AS element
    FROM {name}_cells c LEFT JOIN {name}_buckets b USING ({keys}, pos)
),
{name} AS (
    SELECT {keys}, list(element ORDER BY pos) AS embedding FROM {name}_elements GROUP BY ALL
)
"""


_QUESTIONS = f"""
, questions AS (SELECT item_id AS qid, text FROM benchmark),
asked AS (SELECT qid, '{_PREFIX}' || text AS text FROM questions)
"""

_WORDS = _counts("text_vec", "texts", "student_id, question_id")
_ASKED = _QUESTIONS + _counts("asked_vec", "asked", "qid")

_PICK = (
    "CASE question_id WHEN 'r1' THEN r1 WHEN 'r2' THEN r2 "
    "WHEN 'r3' THEN r3 WHEN 'r4' THEN r4 END"
)
_GIVEN = "(SELECT embedding FROM embeddings WHERE vec_id = 9)"
_DISTANCE = f"array_distance(CAST(embedding AS DOUBLE[64]), CAST({_GIVEN} AS DOUBLE[64]))"
_ORDER = (
    "d ASC NULLS LAST, CAST(perm AS VARCHAR) ASC NULLS LAST, question_id ASC NULLS LAST, "
    "r1 ASC NULLS LAST, r2 ASC NULLS LAST, r3 ASC NULLS LAST, r4 ASC NULLS LAST"
)


def _elements(source: str, keys: str, vector: str = "embedding") -> str:
    return f"""
SELECT {keys}, CAST(pos - 1 AS INTEGER) AS pos, round(CAST(element AS DOUBLE), 6) AS element
FROM (SELECT {keys}, unnest({vector}) AS element,
             unnest(range(1, len({vector}) + 1)) AS pos FROM {source})
"""


def _search(where: str = "true", limit: int = 0, extra: str = "") -> str:
    tail = f"LIMIT {limit}" if limit else ""
    return f"""
SELECT perm, r1, r2, r3, r4, dept, first_gen{extra}, question_id AS result_question_id,
       round(d, 6) AS result_distance, {_PICK} AS result_text
FROM (SELECT wide.*, embedding, question_id, {_DISTANCE} AS d
      FROM wide LEFT JOIN emb ON perm = student_id WHERE {where})
ORDER BY {_ORDER} {tail}
"""


def _by_routes(wide: str, emb: str, vector: str) -> str:
    """25 rows of a search over other tables, once for each route."""
    return f"""
, w2 AS ({wide}), e2 AS ({emb}),
top AS (
    SELECT *, {_PICK} AS result_text FROM (
        SELECT w2.*, question_id, array_distance(CAST(embedding AS DOUBLE[64]),
                                                 CAST({vector} AS DOUBLE[64])) AS d
        FROM w2 LEFT JOIN e2 ON CAST(perm AS VARCHAR) = student_id)
    ORDER BY {_ORDER} LIMIT 25
)
SELECT perm, r1, r2, r3, r4, dept, first_gen, question_id AS result_question_id,
       round(d, 6) AS result_distance, result_text, route
FROM top, (VALUES ('direct'), ('narrow'), ('batch')) routes(route)
"""


def _batch_of(limit: int) -> str:
    """All answers of all questions, and the students without one, ranked."""
    return f"""
, all_pairs AS (
    SELECT a.qid, w.*, t.question_id, array_distance(CAST(t.embedding AS DOUBLE[64]),
                                                     CAST(a.embedding AS DOUBLE[64])) AS d
    FROM asked_vec a, wide w LEFT JOIN text_vec t ON w.perm = t.student_id
)
SELECT qid, CAST(rk AS INTEGER) AS result_rank, perm, question_id AS result_question_id,
       round(d, 6) AS result_distance
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}) AS rk FROM all_pairs)
WHERE {f"rk <= {limit}" if limit else "true"}
"""


_FOUND = f"""
, pairs AS (
    SELECT a.qid, w.*, t.question_id,
           array_distance(CAST(t.embedding AS DOUBLE[64]),
                          CAST(a.embedding AS DOUBLE[64])) AS d
    FROM asked_vec a, text_vec t JOIN wide w ON w.perm = t.student_id
),
found AS (
    SELECT *, {_PICK} AS txt FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}) AS rk FROM pairs
    ) WHERE rk <= 5
),
contexts AS (
    SELECT qid, string_agg(txt, chr(10) || chr(10) ORDER BY rk) AS context,
           count(txt) AS n_texts, count(*) - count(txt) AS n_missing
    FROM found GROUP BY qid
)
"""

_PROMPTS = f"""
, prompts AS (
    SELECT qid, text AS question, context,
           'Q ' || text || chr(10) || context AS prompt
    FROM questions JOIN contexts USING (qid)
)
"""

_WIDE = "SELECT perm, r1, r2, r3, r4, dept, first_gen FROM wide"

ORACLE: dict[str, str] = {
    "survey_scan": _BASE + _WIDE,
    "csv_scan": _BASE + _WIDE,
    "csv_scan_split": _BASE + _WIDE,
    "csv_headers": _BASE + _WIDE,
    "unkeyed_texts": _BASE
    + """SELECT CAST(NULL AS VARCHAR) AS student_id, question_id, text
        FROM texts JOIN wide ON perm = student_id WHERE dept = 'D1'""",
    "build_pipeline": _BASE
    + _WORDS
    + """, numbered AS (
        SELECT row_number() OVER (ORDER BY first_gen, student_id, question_id) AS id,
               student_id, question_id, embedding
        FROM text_vec JOIN wide ON perm = student_id)"""
    + _elements("numbered", "id, student_id, question_id"),
    "embedding_scan": _BASE + _elements("emb", "student_id, question_id"),
    "materialize_if_absent": _BASE + _elements("emb", "student_id, question_id"),
    "vector_cast": _BASE + _elements("emb", "student_id, question_id"),
    "texts_scan": _BASE + "SELECT * FROM texts",
    "texts_long": _BASE + "SELECT * FROM texts",
    "dedup_first": _BASE + "SELECT * FROM round_first",
    "append_new": _BASE
    + """SELECT * FROM round_first f WHERE NOT EXISTS (
        SELECT 1 FROM texts t
        WHERE t.student_id = f.student_id AND t.question_id = f.question_id)""",
    "pk_audit": _BASE
    + """SELECT student_id, question_id, count(*) AS n_rows FROM (
        SELECT student_id, question_id FROM texts
        UNION ALL SELECT student_id, question_id FROM emb)
        GROUP BY ALL HAVING count(*) > 1""",
    "fk_audit": _BASE
    + """SELECT student_id, question_id, count(*) AS n_rows FROM round_texts r
        WHERE NOT EXISTS (SELECT 1 FROM emb e
            WHERE e.student_id = r.student_id AND e.question_id = r.question_id)
        GROUP BY ALL""",
    "assign_ids": _BASE
    + """SELECT row_number() OVER (ORDER BY student_id, question_id) AS id,
        student_id, question_id, text FROM texts""",
    "pending_texts": _BASE
    + """SELECT t.student_id, t.question_id, t.text
        FROM texts t LEFT JOIN emb e USING (student_id, question_id)
        WHERE e.embedding IS NULL""",
    "embed_pending": _BASE + _WORDS + _elements("text_vec", "student_id, question_id"),
    "embed_documents": _BASE + _counts("doc_vec", "documents", "doc_id")
    + _elements("doc_vec", "doc_id"),
    "embed_queries": _BASE + _ASKED + _elements("asked_vec", "qid"),
    "query_prefix": _BASE + _QUESTIONS + "SELECT qid, text AS asked FROM asked",
    "export_join": _BASE
    + """SELECT t.student_id, t.question_id, CAST(len(e.embedding) AS INTEGER) AS width
        FROM texts t LEFT JOIN emb e USING (student_id, question_id)""",
    "export_roundtrip": _BASE
    + """, export AS (
        SELECT t.student_id, t.question_id, coalesce(e.embedding, [NULL]) AS embedding
        FROM texts t LEFT JOIN emb e USING (student_id, question_id))"""
    + _elements("export", "student_id, question_id"),
    "l2_distance": """
        SELECT a.vec_id, round(array_distance(CAST(a.embedding AS DOUBLE[64]),
                                              CAST(b.embedding AS DOUBLE[64])), 6) AS distance
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "l2_normalize": _BASE
    + _WORDS
    + """, norms AS (
        SELECT student_id, question_id, sqrt(sum(element * element)) AS norm
        FROM text_vec_elements GROUP BY ALL)
        SELECT student_id, question_id, CAST(pos AS INTEGER) AS pos,
               round(CASE WHEN norm = 0 THEN element ELSE element / norm END, 6) AS element
        FROM text_vec_elements JOIN norms USING (student_id, question_id)""",
    "vector_length_audit": """
        SELECT CAST(vec_id AS VARCHAR) AS student_id, CAST(label AS VARCHAR) AS question_id,
               CAST(CASE label % 3 WHEN 0 THEN 63 ELSE 64 END AS INTEGER) AS length,
               label % 3 = 1 AS null_element
        FROM embeddings WHERE label % 3 IN (0, 1)""",
    "search_join": _BASE
    + """SELECT wide.*, question_id AS result_question_id,
        CAST(len(embedding) AS INTEGER) AS embedding
        FROM wide LEFT JOIN emb ON perm = student_id""",
    "search_topk": _BASE
    + ", top AS ("
    + _search(limit=25, extra=", embedding")
    + ")"
    + _elements("top", "perm, result_question_id, result_distance, result_text"),
    "search_big_limit": _BASE + _search(limit=20_000),
    "search_int_key": _BASE
    + _by_routes(
        "SELECT * REPLACE (CAST(perm AS INTEGER) AS perm) FROM wide",
        "SELECT student_id, question_id, list_transform(range(64), "
        "lambda i: CAST(substr(question_id, 2, 1) AS FLOAT)) AS embedding FROM emb",
        "list_transform(range(64), lambda i: 1.0)",
    ),
    "search_repeated_perm": _BASE
    + _by_routes(
        "SELECT * FROM wide UNION ALL SELECT perm, r2, r3, r4, NULL, dept, first_gen FROM wide",
        "SELECT * FROM emb",
        _GIVEN,
    ),
    "search_strangers": _BASE + _by_routes("SELECT * FROM wide", "SELECT * FROM emb", _GIVEN),
    "search_narrow": _BASE + _search(limit=25),
    "search_all": _BASE + _search(),
    "search_prefilter": _BASE + _search("dept = 'D1'", 10),
    "search_prefilter_and": _BASE + _search("dept = 'D1' AND first_gen = 1", 10),
    "search_normalized": _BASE
    + _WORDS
    + _ASKED
    + f"""
, unit AS (
    SELECT student_id, question_id,
           list_transform(embedding, lambda x: CAST(x / greatest(n, 1e-9) AS FLOAT)) AS u
    FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n
          FROM text_vec)
),
unit_asked AS (
    SELECT list_transform(embedding, lambda x: CAST(x / n AS FLOAT)) AS u
    FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS n
          FROM asked_vec WHERE qid = (SELECT min(qid) FROM questions))
)
SELECT perm, r1, r2, r3, r4, dept, first_gen, question_id AS result_question_id,
       round(d, 6) AS result_distance, {_PICK} AS result_text
FROM (SELECT wide.*, question_id,
             array_distance(CAST(unit.u AS DOUBLE[64]),
                            CAST((SELECT u FROM unit_asked) AS DOUBLE[64])) AS d
      FROM wide LEFT JOIN unit ON perm = student_id)
ORDER BY {_ORDER} LIMIT 10
""",
    "pick_answer": _BASE
    + f"""SELECT perm, question_id AS result_question_id, {_PICK} AS result_text
        FROM wide LEFT JOIN emb ON perm = student_id""",
    "display_lines": _BASE
    + f"""SELECT '(distance: ' || coalesce(substr(regexp_replace(printf('%.12f', d),
            '(\\.[0-9]+?)0+$', '\\1'), 1, 4), 'nan') || ', perm: ' || coalesce(perm, 'nan') || ') '
            || coalesce({_PICK}, '') AS line
        FROM (SELECT wide.*, question_id, {_DISTANCE} AS d
              FROM wide LEFT JOIN emb ON perm = student_id)
        ORDER BY {_ORDER} LIMIT 25""",
    "search_batch": _BASE
    + _WORDS
    + _ASKED
    + _FOUND
    + """SELECT qid, CAST(rk AS INTEGER) AS result_rank, perm, r1, r2, r3, r4, dept, first_gen,
        question_id AS result_question_id, round(d, 6) AS result_distance, txt AS result_text
        FROM found""",
    "search_batch_all": _BASE + _WORDS + _ASKED + _batch_of(0),
    "search_batch_big_limit": _BASE + _WORDS + _ASKED + _batch_of(1500),
    "search_batch_vectors": _BASE
    + f"""SELECT qid, CAST(rk AS INTEGER) AS result_rank, perm,
        question_id AS result_question_id, round(d, 6) AS result_distance
        FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {_ORDER}) AS rk
              FROM (SELECT q.vec_id AS qid, wide.*, question_id,
                           array_distance(CAST(emb.embedding AS DOUBLE[64]),
                                          CAST(q.embedding AS DOUBLE[64])) AS d
                    FROM embeddings q, emb JOIN wide ON perm = student_id))
        WHERE rk <= 3""",
    "search_documents": _BASE
    + _ASKED
    + _counts("doc_vec", "documents", "doc_id")
    + """SELECT qid, CAST(rk AS INTEGER) AS result_rank, perm, round(d, 6) AS result_distance
        FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, perm) AS rk
              FROM (SELECT a.qid, CAST(doc_id AS VARCHAR) AS perm,
                           array_distance(CAST(v.embedding AS DOUBLE[64]),
                                          CAST(a.embedding AS DOUBLE[64])) AS d
                    FROM asked_vec a, doc_vec v))
        WHERE rk <= 5""",
    "build_context": _BASE + _WORDS + _ASKED + _FOUND + "SELECT * FROM contexts",
    "render_prompt": _BASE + _WORDS + _ASKED + _FOUND + _PROMPTS + "SELECT * FROM prompts",
    "prompt_messages": _BASE
    + _WORDS
    + _ASKED
    + _FOUND
    + _PROMPTS
    + """SELECT qid, 0 AS pos, 'system' AS role, 'You are a helpful assistant.' AS content
        FROM prompts UNION ALL SELECT qid, 1, 'user', prompt FROM prompts""",
}

# A question as text against word vectors, the nearest ten answers.
_FIRST_ASKED = """
, first_asked AS (
    SELECT embedding FROM asked_vec WHERE qid = (SELECT min(qid) FROM questions)
),
nearest AS (
    SELECT wide.*, question_id,
           array_distance(CAST(embedding AS DOUBLE[64]),
                          CAST((SELECT embedding FROM first_asked) AS DOUBLE[64])) AS d
    FROM wide LEFT JOIN text_vec ON perm = student_id
)
"""

ORACLE |= {
    "tables_if_absent": ORACLE["texts_scan"],
    # The same rows by other ways to store the tables.
    "search_cells": ORACLE["search_topk"],
    "search_cells_batch": ORACLE["search_batch_vectors"],
    "search_quantised": ORACLE["search_topk"],
    "colocated_pending": ORACLE["pending_texts"],
    "colocated_export": ORACLE["export_join"],
    "colocated_search_join": ORACLE["search_join"],
    "embed_compact": ORACLE["embed_pending"],
    "embed_edited": _BASE
    + """, edited AS (
        SELECT student_id, question_id,
               CASE WHEN question_id = 'r2' THEN text || ' indeed' ELSE text END AS text
        FROM texts)"""
    + _counts("edited_vec", "edited", "student_id, question_id")
    + _elements("edited_vec", "student_id, question_id"),
    "search_question": _BASE
    + _WORDS
    + _ASKED
    + _FIRST_ASKED
    + f"""SELECT perm, r1, r2, r3, r4, dept, first_gen, question_id AS result_question_id,
        round(d, 6) AS result_distance, {_PICK} AS result_text
        FROM nearest ORDER BY {_ORDER} LIMIT 10""",
    "search_lines": _BASE
    + _WORDS
    + _ASKED
    + _FIRST_ASKED
    + f"""SELECT '(distance: ' || coalesce(substr(regexp_replace(printf('%.12f', d),
            '(\\.[0-9]+?)0+$', '\\1'), 1, 4), 'nan') || ', perm: ' || coalesce(perm, 'nan') || ') '
            || coalesce({_PICK}, '') AS line
        FROM nearest ORDER BY {_ORDER} LIMIT 10""",
}
