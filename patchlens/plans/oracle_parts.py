"""SQL text (DuckDB) of the derived inputs and of shared expressions, for cross-checking.

Only the derivation of the inputs and the fixed values are shared with the Spark side; the
logic of each query is written anew in SQL.
"""

from __future__ import annotations

from ..functions.text import WHITE_SPACE
from ..functions.tokens import FACT_KEYWORDS, SILENT_KEYWORDS, token_pattern
from . import corpus as C


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def inl(items) -> str:
    return "(" + ", ".join(lit(x) for x in items) + ")"


WS = lit(WHITE_SPACE)


def trim(c: str) -> str:
    return f"trim({c}, {WS})"


def any_contains(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ")"


def comment(c: str) -> str:
    return f"(starts_with({trim(c)}, '//') OR starts_with({trim(c)}, '/*'))"


def is_go(p: str = "path") -> str:
    return f"ends_with({p}, '.go')"


PATH = (
    f"{lst(C.DIRECTORIES)}[(doc_id % 3) + 1] || source || '/f' || doc_id || "
    f"CASE WHEN doc_id % 41 = 0 THEN '.pb.go' ELSE {lst(C.ENDINGS)}[((doc_id // 20) % 8) + 1] END"
)

DOCS = f"""docs AS (
  SELECT doc_id, source AS task_id, {PATH} AS path,
         CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10))
              THEN string_split(text[:-2], chr(10)) ELSE string_split(text, chr(10)) END AS parts
  FROM documents)"""

RAW_LINES = f"""raw_lines AS (
  SELECT doc_id, task_id, path, line,
         replace(coalesce({lst(C.PLANTED)}[((doc_id * {C.STEP} + line - 1) % {C.CYCLE}) + 1], raw),
                 {lit(C.MARK)}, (doc_id % 5)::VARCHAR) AS content
  FROM (SELECT doc_id, task_id, path, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS line
        FROM docs))"""

GENERATED = f"""generated AS (
  SELECT DISTINCT path FROM (
    SELECT path, content, row_number() OVER (PARTITION BY path ORDER BY line) AS n
    FROM raw_lines WHERE {trim('content')} <> '')
  WHERE n <= 10 AND starts_with({trim('content')}, '//')
    AND contains(lower(content), 'code generated') AND contains(lower(content), 'do not edit')
  UNION SELECT path FROM docs WHERE regexp_matches(path, '(\\.pb|\\.pb\\.gw|_gen|\\.gen|\\.generated|_string)\\.go$'))"""

LINES = f"""lines AS (
  SELECT * FROM raw_lines WHERE path NOT IN (SELECT path FROM generated))"""

ALL = ",\n".join([DOCS, RAW_LINES, GENERATED, LINES])
RAW = ",\n".join([DOCS, RAW_LINES])

TOKEN_RE = lit(token_pattern(possessive=False))


def kind(t: str) -> str:
    return (
        f"CASE WHEN {t} IN ('=', ':=') THEN 'assignment' "
        f"WHEN {t}[1] IN ('\"', '`') THEN 'string_literal' "
        f"WHEN {t}[1] = '''' THEN NULL "
        f"WHEN starts_with({t}, '//') OR starts_with({t}, '/*') THEN 'comment' "
        f"WHEN {t} IN {inl(FACT_KEYWORDS)} THEN {t} "
        f"WHEN {t} IN {inl(SILENT_KEYWORDS)} THEN NULL "
        f"WHEN regexp_matches({t}, '^\\.?[0-9]') THEN "
        f"  CASE WHEN NOT ends_with({t}, 'i') THEN 'int_literal' END "
        f"WHEN regexp_matches({t}, '^[\\p{{L}}_]') THEN 'identifier' END"
    )


def facts(c: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({c}, {TOKEN_RE}), "
        f"lambda t: {{'kind': {kind('t')}, 'value': t}}), lambda f: f.kind IS NOT NULL)"
    )


def has_kind(f: str, k: str) -> str:
    return f"list_contains(list_transform({f}, lambda q: q.kind), {lit(k)})"


def idents(f: str) -> str:
    return f"list_transform(list_filter({f}, lambda q: q.kind = 'identifier'), lambda q: q.value)"


def literals(f: str) -> str:
    return f"list_transform(list_filter({f}, lambda q: q.kind = 'string_literal'), lambda q: q.value)"
