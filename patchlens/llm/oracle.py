"""The same results as DuckDB SQL, where SQL can express the operator."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SHINGLES = f"""
    SELECT DISTINCT {{key}}, array_to_string(w[i:i + 4], ' ') AS shingle
    FROM (SELECT {{key}}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
          FROM (SELECT {{key}}, regexp_extract_all({LOWER.format("text")}, '{WORD}') AS w
                FROM {{source}} WHERE text IS NOT NULL) WHERE len(w) > 0)"""

ORACLE: dict[str, str] = {}

ORACLE["op8_near_duplicates"] = f"""
WITH RECURSIVE s AS ({SHINGLES.format(key="doc_id", source="documents")}),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared
        FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
    WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id,
       d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) c USING (doc_id)
"""

# Containment uses the lower case of all letters.
_LOWERED = SHINGLES.replace(LOWER.format("text"), "lower(text)")

ORACLE["op3_benchmark_containment"] = f"""
WITH s AS ({_LOWERED.format(key="doc_id", source="documents")}),
b AS ({_LOWERED.format(key="item_id", source="benchmark")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, n_shingles, n_found
FROM (SELECT doc_id, item_id, count(*) AS n_found FROM s JOIN b USING (shingle) GROUP BY ALL)
JOIN n USING (item_id) WHERE 100 * n_found >= 75 * n_shingles
"""


def _limits(keys: str) -> str:
    """Thresholds of groups, from the quantiles of their bins."""
    by = f"{keys}, " if keys else ""
    at = {p: f"min(CASE WHEN seen * 100 >= {p} * total THEN low_of_bin END) AS q{p}"
          for p in (10, 25, 50, 75)}
    allowed = " ".join(f"WHEN '{m}' THEN {v}" for m, v in
                       (("symbols", 50), ("dup_lines", 400), ("repeats", 450)))
    return f"""
    SELECT {by}measure, total, CASE measure WHEN 'length' THEN q25 - 4 * (q75 - q25) - 100 END AS low,
        CASE measure WHEN 'length' THEN q75 + 4 * (q75 - q25) + 100
             ELSE q50 + 4 * (q50 - q10) + CASE measure {allowed} END END AS high
    FROM (
        SELECT {by}measure, total, {", ".join(at.values())}
        FROM (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bin) AS seen,
                     sum(n) OVER (PARTITION BY {by}measure) AS total,
                     (bin - 32 * greatest(bin // 32 - 1, 0)) << greatest(bin // 32 - 1, 0)::INT
                         AS low_of_bin
              FROM (SELECT {by}measure, bin, count(*) AS n FROM binned GROUP BY ALL))
        GROUP BY ALL)"""


ORACLE["op2_adaptive_quality"] = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
        FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
again AS (SELECT id, t FROM win GROUP BY ALL HAVING count(*) > 1),
covered AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words
            FROM win JOIN again USING (id, t), range(3) r(k) GROUP BY id),
lines AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '{WORD}') GROUP BY id),
m AS (SELECT id, doc_id, lang, source, len(w) AS n_words,
             length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN covered USING (id) LEFT JOIN lines USING (id)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             1000 * n_symbols // greatest(word_chars, 1) AS symbols,
             1000 * n_dup_lines // greatest(n_lines, 1) AS dup_lines,
             1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
             100 * word_chars // greatest(n_words, 1) AS length FROM m),
binned AS (SELECT lang, source, measure,
                  32 * greatest(length(bin(v)) - 6, 0) + (v >> greatest(length(bin(v)) - 6, 0)::INT)
                      AS bin
           FROM (UNPIVOT (SELECT lang, source, symbols::BIGINT AS symbols,
                     dup_lines::BIGINT AS dup_lines, repeats::BIGINT AS repeats,
                     length::BIGINT AS length FROM r WHERE NOT base_failed)
                 ON symbols, dup_lines, repeats, length INTO NAME measure VALUE v)),
own AS ({_limits("lang, source")}),
of_lang AS ({_limits("lang")}),
of_all AS ({_limits("")}),
limits AS (
    SELECT own.lang, own.source, measure,
           CASE WHEN own.total >= 50 THEN own.low WHEN l.total >= 50 THEN l.low ELSE a.low END AS low,
           CASE WHEN own.total >= 50 THEN own.high WHEN l.total >= 50 THEN l.high
                ELSE a.high END AS high
    FROM own JOIN of_lang l USING (lang, measure) JOIN of_all a USING (measure)),
outside AS (
    SELECT DISTINCT id FROM r JOIN limits ON r.lang IS NOT DISTINCT FROM limits.lang
        AND r.source IS NOT DISTINCT FROM limits.source
    WHERE CASE measure WHEN 'symbols' THEN symbols > high WHEN 'dup_lines' THEN dup_lines > high
          WHEN 'repeats' THEN repeats > high ELSE length > high OR length < low END)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND id NOT IN (SELECT id FROM outside) AS kept
FROM r
"""

ORACLE["op7_chat_template"] = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok'
              FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
           AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(14 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'),
                                       '</turn>', '\</turn>'), ':', '\:'))
           + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))
       )::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

ORACLE["op11_hard_negatives"] = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, x.vec_id, a.label = x.label AS same,
           list_inner_product(a.q, x.q)::BIGINT AS score
    FROM v a JOIN v x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id,
       positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
