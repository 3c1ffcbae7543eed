"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from respondex.llm.quality import STOP_WORDS
from respondex.llm.url_filter import RULES

_HOST = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)"
_PATH = r"regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH u AS (
    SELECT page_id, {_LOWER.format(_HOST)} AS host, {_PATH} AS path FROM pages
), r (rule_host, rule_path, verdict) AS (
    VALUES {", ".join(str(r) for r in RULES)}
), hits AS (
    SELECT page_id, host, path,
           max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           max_by(verdict, length(rule_host || rule_path)) AS verdict
    FROM u JOIN r
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY ALL
)
SELECT u.page_id, u.host, u.path, hits.rule, coalesce(hits.verdict, 'allow') AS verdict
FROM u LEFT JOIN hits USING (page_id, host, path)
"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

OP8 = rf"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), w AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM t)
), twice AS (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS i
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM w) WHERE n > 1
), rep AS (
    SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM twice GROUP BY doc_id
), m AS (
    SELECT t.doc_id, len(words) AS n_words,
           coalesce(length(list_aggregate(words, 'string_agg', '')), 0) AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
           len(lines) AS n_lines,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words,
           len(list_filter(words, lambda x: rtrim(lower(x), '.,;:!?') IN ({_STOP}))) AS n_stop
    FROM t LEFT JOIN rep USING (doc_id)
), b AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 12 * n_words
            OR 4 * n_symbols > n_words OR 100 * n_stop < 4 * n_words
            OR 2 * n_dup_lines > n_lines) AS kept
FROM b
"""

OP6 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
    SELECT * FROM v
    WHERE label IS NOT NULL AND e IS NOT NULL
      AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM v
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a
), groups AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), counts AS (
    SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM groups LEFT JOIN counts USING (vec_id)
"""

_FIELDS = ("doc_id", "source", "lang", "n_chars", "{text}")
_VALUE = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    fields = (f.format(text=text) for f in _FIELDS)
    return "sha256(" + " || ".join(_VALUE.format(f) for f in fields) + ")"


#: crc32 of a short ASCII text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(
    list_transform(range(1, length({0}) + 1), lambda i: ascii({0}[i])::BIGINT),
    lambda c, b: list_reduce(range(0, 8),
        lambda v, _: CASE WHEN v % 2 = 1 THEN xor(3988292384, v // 2) ELSE v // 2 END,
        xor(c, b)),
    4294967295::BIGINT))"""

OP11 = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf,
           CASE WHEN {_CRC32.format("(doc_id::VARCHAR)")} % 5 = 0
                THEN {_leaf(_LOWER.format("text"))} END AS claim,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS n,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
    FROM documents
), inner_nodes(tree, level, idx, digest) AS (
    SELECT tree, 0, n, leaf FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT tree, level, idx // 16 AS idx, idx AS place, digest,
                 count(*) OVER (PARTITION BY tree) AS n
          FROM inner_nodes)
    WHERE n > 1
    GROUP BY tree, level, idx
), heights AS (
    SELECT tree, max(level) AS height FROM inner_nodes GROUP BY tree
), subroots AS (
    SELECT tree, digest AS subroot, height
    FROM inner_nodes JOIN heights USING (tree) WHERE level = height
), top_nodes(level, idx, digest) AS (
    SELECT 0, tree, subroot FROM subroots
    UNION ALL
    SELECT level + 1, idx, sha256(string_agg(digest, '' ORDER BY place))
    FROM (SELECT level, idx // 16 AS idx, idx AS place, digest, count(*) OVER () AS n
          FROM top_nodes)
    WHERE n > 1
    GROUP BY level, idx
), root AS (
    SELECT digest AS root FROM top_nodes ORDER BY level DESC LIMIT 1
), nodes AS (
    -- One ladder: the top tree's nodes of level l stand at 1000 + l.
    SELECT tree, level, idx, digest FROM inner_nodes
    UNION ALL
    SELECT -1, 1000 + level, idx, digest FROM top_nodes
), runs AS (
    SELECT tree, level, idx // 16 AS run, list(digest ORDER BY idx) AS kids
    FROM nodes GROUP BY tree, level, idx // 16
), tops AS (
    SELECT max(level) AS top FROM top_nodes
), climb(doc_id, key, home, tree, level, idx, folded, proof) AS (
    SELECT doc_id, row_number() OVER (), tree, tree, 0, n, coalesce(claim, leaf), ''
    FROM leaves
    UNION ALL
    SELECT doc_id, key, home,
           CASE WHEN tree >= 0 AND level = height THEN -1 ELSE tree END,
           CASE WHEN tree >= 0 AND level = height THEN 1000 ELSE level + 1 END,
           CASE WHEN tree >= 0 AND level = height THEN home ELSE idx // 16 END,
           CASE WHEN tree >= 0 AND level = height THEN folded
                ELSE sha256(list_aggregate(kids[:idx % 16] || [folded] || kids[idx % 16 + 2:],
                                           'string_agg', '')) END,
           CASE WHEN tree >= 0 AND level = height THEN proof
                ELSE proof || coalesce(list_aggregate(kids[:idx % 16] || kids[idx % 16 + 2:],
                                                      'string_agg', ''), '') END
    FROM (
        SELECT climb.*, height, top, kids
        FROM climb JOIN heights ON heights.tree = climb.home CROSS JOIN tops
        JOIN runs ON runs.tree = climb.tree AND runs.level = climb.level
                 AND runs.run = climb.idx // 16
    )
    WHERE NOT (tree = -1 AND level = 1000 + top)
)
SELECT leaves.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = root AS verified
FROM climb, tops, root, subroots, leaves
WHERE climb.tree = -1 AND climb.level = 1000 + top AND subroots.tree = climb.home
  AND leaves.doc_id IS NOT DISTINCT FROM climb.doc_id AND leaves.tree = climb.home
"""

OP13 = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
           list_dot_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER
           AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

ORACLE = {
    "op6_near_vectors": OP6,
    "op2_url_filters": OP2,
    "op8_quality_rules": OP8,
    "op11_merkle_manifest": OP11,
    "op13_hard_negatives": OP13,
}
