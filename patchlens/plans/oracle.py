"""DuckDB SQL for the queries of the catalogue, used to cross-check results."""

from __future__ import annotations

from ..functions.credentials import (
    BEARER_PLACEHOLDERS,
    CONFIG_LANGUAGES,
    CONFIG_PLACEHOLDERS,
    DATABASE_SCHEMES,
    DESCRIPTIVE_ENDINGS,
    FORMAT_VERBS,
    PLACEHOLDER_WORDS,
    TEMPLATE_PREFIXES,
)
from ..functions.masking import MASKS
from ..functions.paths import LANGUAGES
from ..functions.tokens import SENSITIVE_NAME_WORDS, SENSITIVE_WORDS, TYPE_NAMES
from ..operators.checks import CHECKS
from ..operators.commands import CHAINED, INJECTIONS, SafetyConfig
from ..operators.line_rules import SAFE_TO_IGNORE
from ..operators.pair_rules import EXIT_NAMES, NO_TEST_NEEDED, OPEN_CALLS
from . import oracle_parts as S
from .corpus import COMMANDS

ORACLE: dict[str, str] = {}
T = S.trim("content")


def q(name: str, body: str, prelude: str = S.ALL, more: str = "") -> None:
    extra = f",\n{more}" if more else ""
    ORACLE[name] = f"WITH {prelude}{extra}\n{body}"


# Lines ------------------------------------------------------------------------------

q("whole_file_lines", """
SELECT task_id, path AS file, count(*) AS lines, max(line) AS last_line,
       sum(strlen(content))::BIGINT AS bytes
FROM raw_lines GROUP BY ALL""", S.RAW)

PATCH = f"""marked AS (
  SELECT 'd' || doc_id AS task_id, path, line, content, (line - 1) % 4 AS k FROM raw_lines),
patch AS (
  SELECT task_id, path, line, content,
         CASE k WHEN 0 THEN 'context' WHEN 1 THEN 'deleted' ELSE 'added' END AS line_type,
         6 + sum(CASE WHEN k IN (0, 1) THEN 1 ELSE 0 END) OVER w AS o,
         8 + sum(CASE WHEN k <> 1 THEN 1 ELSE 0 END) OVER w AS n
  FROM marked WINDOW w AS (PARTITION BY path ORDER BY line))"""
q("patch_lines", """
SELECT task_id, path AS file, line_type, content,
       (CASE WHEN line_type = 'added' THEN 0 ELSE o END)::BIGINT AS old_line,
       (CASE WHEN line_type = 'deleted' THEN 0 ELSE n END)::BIGINT AS new_line
FROM patch""", S.RAW, PATCH)
q("patch_shape", """
SELECT task_id, 'part' AS hunk_context,
       count(*) FILTER (line_type = 'added') AS added,
       count(*) FILTER (line_type = 'deleted') AS deleted,
       count(*) FILTER (line_type = 'context') AS context,
       count(*) FILTER (line_type <> 'deleted') AS new_lines,
       count(*) FILTER (line_type <> 'added') AS old_lines
FROM patch GROUP BY ALL""", S.RAW, PATCH)
q("rejected_patches", """
SELECT task_id, 'no_added_lines' AS reason FROM patch GROUP BY task_id
HAVING count(*) FILTER (line_type = 'added') = 0""", S.RAW, PATCH)

EXT = r"regexp_extract(lower(path), '(\.[^./]*)$', 1)"
LANG = (
    f"CASE WHEN starts_with(regexp_extract(lower(path), '([^/]*)$', 1), '.env') OR {EXT} = '.env' "
    f"THEN 'dotenv' WHEN {EXT} = '' THEN 'text' ELSE coalesce(CASE {EXT} "
    + " ".join(f"WHEN {S.lit(k)} THEN {S.lit(v)}" for k, v in LANGUAGES.items())
    + f" END, {EXT}[2:]) END"
)
ROLE = r"""CASE WHEN regexp_matches('/' || lower(path) || '/', '/(tests|test|testdata|__tests__|spec)/')
      OR regexp_matches(lower(path), '(_test\.go|_test\.py|\.test\.js|\.spec\.js|\.test\.ts|\.spec\.ts|test\.java)$')
      OR regexp_matches(lower(path), '(^|/)test_[^/]*\.py$') THEN 'test'
    WHEN regexp_matches(lower(path), '\.(md|rst|txt)$')
      OR regexp_matches(lower(path), '(^|/)(readme|history|changelog|contributing)[^/]*$')
      OR regexp_matches('/' || lower(path) || '/', '/examples?/') THEN 'example'
    ELSE 'production' END"""
q("language_and_role", f"""
SELECT path AS file, {LANG} AS language, {ROLE} AS role,
       ({LANG}) IN {S.inl(CONFIG_LANGUAGES)} AS is_config,
       regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir
FROM docs""", S.DOCS)
q("package_names", f"""
SELECT task_id, path AS file, min_by(name, line) AS package
FROM (SELECT task_id, path, line,
             regexp_extract({T}, '^package\\s+([A-Za-z_][A-Za-z0-9_]*)$', 1) AS name FROM raw_lines)
WHERE name <> '' GROUP BY ALL""", S.RAW)
q("package_main_files", f"""
SELECT task_id, path AS file FROM raw_lines WHERE {S.is_go()} AND starts_with({T}, 'package ')
GROUP BY ALL HAVING min_by({T}, line) = 'package main'""", S.RAW)
q("generated_files", """
SELECT task_id, path AS file, count(*) AS lines FROM raw_lines
WHERE path IN (SELECT path FROM generated) GROUP BY ALL""")

# Lexical layer -----------------------------------------------------------------------

q("token_kinds", f"""
SELECT f.kind AS kind, count(*) AS n, sum(strlen(f.value))::BIGINT AS bytes
FROM (SELECT unnest({S.facts('content')}) AS f FROM raw_lines) GROUP BY ALL""", S.RAW)

BEFORE = "list_transform(list_filter(facts[1:p - 1], lambda z: z.kind = 'identifier'), lambda z: z.value)"
ASSIGNED = f"""assigned AS (
  SELECT task_id, path, line, content, facts, value,
         coalesce(list_filter(names, lambda v: v NOT IN {S.inl(TYPE_NAMES)})[-1], names[1]) AS name
  FROM (SELECT *, facts[p].value AS value, {BEFORE} AS names
        FROM (SELECT *, list_filter(range(2, len(facts) + 1), lambda i:
                facts[i].kind = 'string_literal' AND facts[i - 1].kind = 'assignment'
                AND len(list_filter(facts[1:i - 1], lambda z: z.kind = 'identifier')) > 0)[1] AS p
              FROM (SELECT *, {S.facts('content')} AS facts FROM lines_in))
        WHERE p IS NOT NULL))"""
q("assigned_values", """
SELECT task_id, path AS file, line, name, value FROM assigned""", S.RAW, f"""lines_in AS (
  SELECT * FROM raw_lines WHERE contains(content, '=')),
{ASSIGNED}""")

WORDS = "|".join(SENSITIVE_WORDS)
NAME_WORDS = "|".join(SENSITIVE_NAME_WORDS)
q("sensitive_identifiers", f"""
SELECT * FROM (SELECT task_id, path AS file, line,
  list_filter({S.idents(S.facts('content'))},
              lambda v: regexp_matches(lower(v), '{WORDS}'))[1] AS name
  FROM raw_lines WHERE regexp_matches(lower(content), '{NAME_WORDS}')) WHERE name IS NOT NULL""", S.RAW)

# Line rules ---------------------------------------------------------------------------

QUOTES = "'\"''`'"


def unq(c):
    return f"trim({c}, {QUOTES})"


def not_secret(v):
    u = unq(v)
    starts = " OR ".join(f"starts_with({u}, {S.lit(p)})" for p in TEMPLATE_PREFIXES)
    return (
        f"({starts} OR {S.any_contains(u, FORMAT_VERBS)} OR strlen({u}) < 8 "
        f"OR {S.trim(u)} = '' OR {S.any_contains(f'lower({u})', PLACEHOLDER_WORDS)})"
    )


CODE = f"""lines_in AS (
  SELECT * FROM lines WHERE NOT {S.comment('content')}
    AND (contains(content, '"') OR contains(content, '`')))"""
SECRETS = f"""hard AS (
  SELECT task_id, path, line, content, name, 'secret_assigned' AS "check" FROM assigned
  WHERE NOT {S.any_contains('content', ['os.Getenv(', 'os.LookupEnv(', 'secretmanager'])}
    AND {unq('value')} <> name AND regexp_matches(lower(name), '{NAME_WORDS}')
    AND NOT {not_secret('value')}),
soft AS (
  SELECT task_id, path, line, content, name, 'secret_passed' AS "check"
  FROM (SELECT *, list_filter({S.idents('facts')},
                 lambda v: regexp_matches(lower(v), '{WORDS}'))[1] AS name
        FROM (SELECT *, {S.facts('content')} AS facts FROM lines_in))
  WHERE name IS NOT NULL AND NOT {S.has_kind('facts', 'assignment')}
    AND NOT contains(content, '`') AND NOT contains(content, '==')
    AND len(list_filter({S.literals('facts')},
            lambda s: {unq('s')} <> name AND NOT {not_secret('s')})) > 0),
secrets AS (SELECT * FROM hard UNION ALL SELECT * FROM soft)"""
q("hardcoded_secrets", """
SELECT task_id, path AS file, line, "check", name AS detail FROM secrets""",
  more=f"{CODE},\n{ASSIGNED},\n{SECRETS}")
q("nolint_suppression", r"""
SELECT task_id, path AS file, line, "check" FROM secrets
WHERE NOT regexp_matches(content, '//\s*nolint(:|\s|$)')""", more=f"{CODE},\n{ASSIGNED},\n{SECRETS}")


def url_cred(s):
    return rf"regexp_matches(regexp_extract({s}, '://([^/?#]*)', 1), '^[^:]+:[^\n]+@[^@]*$')"


def shape(s):
    low = f"lower({s})"
    bearer = (
        f"regexp_extract(trim({S.trim(f'{s}[strpos({s}, {S.lit(chr(66) + 'earer')}) + 6:]')}, "
        f"'\"'''), '^[A-Za-z0-9._/+\\-]{{25,}}')"
    )
    schemes = " OR ".join(f"starts_with({low}, {S.lit(p)})" for p in DATABASE_SCHEMES)
    return f"""CASE
      WHEN strlen({s}) >= 20 AND regexp_matches({s}, '^AKIA[A-Z0-9]*$') THEN 'aws'
      WHEN starts_with({s}, 'ghp_') AND strlen({s}) >= 40 THEN 'github'
      WHEN starts_with({s}, 'gho_') AND strlen({s}) >= 40 THEN 'github_oauth'
      WHEN regexp_matches({s}, '^[sp]k_live_') AND strlen({s}) >= 20 THEN 'stripe'
      WHEN starts_with({s}, 'xox') AND strlen({s}) >= 15 THEN 'slack'
      WHEN contains({s}, 'BEGIN') AND contains({s}, 'PRIVATE KEY') THEN 'private_key'
      WHEN starts_with({s}, 'eyJ') AND strlen({s}) >= 20 AND len(string_split({s}, '.')) = 3 THEN 'jwt'
      WHEN ({schemes}) AND {url_cred(s)} THEN 'database'
      WHEN regexp_matches({s}, '^gh[usr]_') AND strlen({s}) >= 35 THEN 'github'
      WHEN starts_with({s}, 'glpat-') AND strlen({s}) >= 25 THEN 'gitlab'
      WHEN starts_with({s}, 'AIza') AND strlen({s}) >= 35 THEN 'google'
      WHEN starts_with({s}, 'npm_') AND strlen({s}) >= 35 THEN 'npm'
      WHEN starts_with({s}, 'SG.') AND len(string_split({s}, '.')) >= 3 AND strlen({s}) >= 40 THEN 'sendgrid'
      WHEN contains({s}, 'Bearer') AND {bearer} <> ''
        AND NOT {S.any_contains(f'lower({bearer})', BEARER_PLACEHOLDERS)} THEN 'bearer'
      WHEN (starts_with({low}, 'http://') OR starts_with({low}, 'https://')) AND {url_cred(s)} THEN 'url'
    END"""


q("credential_shapes", """
SELECT task_id, path AS file, line, 'leak_' || found AS "check" FROM leaks
WHERE found IS NOT NULL""", more=f"""{CODE},
leaks AS (
  SELECT task_id, path, line, list_filter(list_transform(list_filter(list_transform(
           {S.literals(S.facts('content'))}, lambda s: {unq('s')}), lambda s: strlen(s) >= 10),
           lambda s: {shape('s')}), lambda z: z IS NOT NULL)[1] AS found
  FROM lines_in)""")

PAIR = (
    r"(?i)^\s*([A-Za-z0-9_.-]*(?:password|passwd|secret|token|api[_-]?key|access[_-]?key"
    r"|credential)[A-Za-z0-9_.-]*)\s*[:=]\s*(\S.*)$"
)
q("config_credentials", f"""
SELECT task_id, path AS file, line, "check", detail FROM (
  SELECT task_id, path, line, key AS detail,
    CASE WHEN key <> '' THEN CASE WHEN NOT (strlen(value) < 6
           OR regexp_matches(value, '^(\\$\\{{|<|%%|\\{{\\{{)')
           OR {S.any_contains('lower(value)', CONFIG_PLACEHOLDERS)}
           OR (starts_with(value, '"') AND ends_with(value, '"'))
           OR (starts_with(value, '''') AND ends_with(value, ''''))
           OR {S.any_contains('value', ['(', ' | ', ' = '])}
           OR regexp_matches(value, '^[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)+$')
           OR {' OR '.join(f"ends_with(lower(key), {S.lit(e)})" for e in DESCRIPTIVE_ENDINGS)})
         THEN 'config_secret' END
      WHEN regexp_matches(content, '[A-Za-z][A-Za-z0-9+.~-]*://[^/\\s:@]+:[^/\\s@]+@') THEN 'config_url'
    END AS "check"
  FROM (SELECT *, regexp_extract(content, {S.lit(PAIR)}, 1) AS key,
               {S.trim(f"regexp_extract(content, {S.lit(PAIR)}, 2)")} AS value
        FROM lines WHERE NOT {S.is_go()} AND ({LANG}) IN {S.inl(CONFIG_LANGUAGES)}
          AND NOT {S.comment('content')} AND NOT starts_with({T}, '#')))
WHERE "check" IS NOT NULL""")


def after_last(c, mark):
    return f"regexp_extract({c}, '([^{mark}]*)$', 1)"


SAFE = S.any_contains("content", SAFE_TO_IGNORE)
DISCARD = f"""split AS (
  SELECT *, {S.facts('content')} AS facts,
         list_transform(string_split({S.trim("CASE WHEN contains(content, ':=') THEN string_split(content, ':=')[1] ELSE string_split(content, '=')[1] END")}, ','),
                        lambda z: {S.trim('z')}) AS names
  FROM lines WHERE {S.is_go()} AND content <> '' AND NOT starts_with({T}, '//')
    AND {S.any_contains('content', ['_', 'panic', 'Fatal'])}),
discards AS (
  SELECT *, len(list_filter(names, lambda z: z = '_')) AS blanks,
         starts_with({T}, 'var ') OR NOT contains({after_last('content', '=')}, '(') OR {SAFE} AS quiet,
         regexp_matches('=' || {after_last('content', '=')}, '=\\s*[A-Za-z_][A-Za-z0-9_.\\[\\]]*\\.\\(')
           AND contains(content, '=') AS asserted,
         list_contains({S.idents('facts')}, '_') AND {S.has_kind('facts', 'assignment')}
           AND contains(content, '=') AS assigned_blank
  FROM split)"""


def error_case(typed=""):
    return f"""CASE
  WHEN NOT ends_with(path, '_test.go') AND blanks > 0 AND blanks = len(names)
    THEN CASE WHEN NOT quiet THEN 'discard_all' END
  WHEN NOT ends_with(path, '_test.go') AND blanks > 0 AND asserted THEN NULL
  {typed}
  WHEN NOT ends_with(path, '_test.go') AND blanks > 0 AND assigned_blank AND NOT quiet
    THEN CASE WHEN names[-1] = '_' THEN 'discard_final' END
  WHEN list_contains({S.idents('facts')}, 'panic') AND NOT ends_with(path, '_test.go') THEN 'panic'
  WHEN list_contains({S.idents('facts')}, 'log') AND contains(content, '.Fatal')
    AND len(list_filter({S.idents('facts')}, lambda z: starts_with(z, 'Fatal'))) > 0
    AND NOT regexp_matches(path, '_test\\.go$|^main\\.go$|/main\\.go$|cmd/')
    AND path NOT IN (SELECT path FROM main_files) THEN 'log_fatal' END"""


MAIN = f"""main_files AS (
  SELECT path FROM raw_lines WHERE {S.is_go()} AND starts_with({T}, 'package ')
  GROUP BY path HAVING min_by({T}, line) = 'package main')"""
q("error_handling", f"""
SELECT * FROM (SELECT task_id, path AS file, line, {error_case()} AS "check" FROM discards)
WHERE "check" IS NOT NULL""", more=f"{DISCARD},\n{MAIN}")
KNOWN = "(line % 2 = 1 AND contains(content, '_'))"
TYPED = f"""WHEN NOT ends_with(path, '_test.go') AND blanks > 0 AND {KNOWN} AND names[2] = '_' AND line % 3 = 0
    THEN 'discard_typed'
  WHEN NOT ends_with(path, '_test.go') AND blanks > 0 AND {KNOWN}
    AND len(list_filter(range(1, len(names) + 1), lambda i: names[i] = '_' AND i <> 2)) = 0 THEN NULL"""
q("typed_discards", f"""
SELECT * FROM (SELECT task_id, path AS file, line, {error_case(TYPED)} AS "check" FROM discards)
WHERE "check" IS NOT NULL""", more=f"{DISCARD},\n{MAIN}")

SQL_RE = (
    r'(?i)(select\b[^"]{0,200}?\bfrom\b|insert\s+into\b|update\b\s+\S+\s+set\b|delete\s+from\b'
    r"|drop\s+(?:table|database)\b|truncate\s+table\b)"
)
GO_CODE = f"{S.is_go()} AND NOT {S.comment('content')}"
q("sql_concat", f"""
SELECT task_id, path AS file, line, 'sql_concat' AS "check" FROM lines
WHERE {GO_CODE} AND regexp_matches(content, '"\\s*\\+\\s*[A-Za-z_(]|[A-Za-z_)\\d]\\s*\\+\\s*"|fmt\\.Sprintf\\(')
  AND len(list_filter(regexp_extract_all(content, '"([^"]*)"', 1),
      lambda s: regexp_matches(s, {S.lit(SQL_RE)}) AND NOT regexp_matches(s, '\\?|\\$\\d'))) > 0""")
# Arguments of the sample calls hold no nested brackets, so a plain split on commas is enough.
q("command_injection", f"""
SELECT task_id, path AS file, line, 'command_injection' AS "check" FROM (
  SELECT *, list_transform(string_split(regexp_extract(content,
            '(?:exec\\.Command(?:Context)?|syscall\\.Exec)\\(([^)]*)', 1), ','), lambda a: {S.trim('a')}) AS args
  FROM lines WHERE {GO_CODE} AND regexp_matches(content, 'exec\\.Command(Context)?\\(|syscall\\.Exec\\('))
WHERE CASE WHEN contains(content, 'syscall.Exec(')
  THEN len(list_filter(args, lambda a: NOT starts_with(a, '"'))) > 0
  ELSE NOT starts_with(args[1], '"') OR (trim(args[1], '"') IN ('sh', 'bash')
    AND len(list_filter(args[2:], lambda a: NOT starts_with(a, '"') OR regexp_matches(a, '\\+\\s*[^"\\s]'))) > 0) END""")
q("tls_off", f"""
SELECT task_id, path AS file, line, 'tls_off' AS "check" FROM lines
WHERE {GO_CODE} AND contains(content, 'InsecureSkipVerify') AND contains(content, 'true')""")
q("time_tick", f"""
SELECT task_id, path AS file, line, 'time_tick' AS "check" FROM lines
WHERE {GO_CODE} AND contains(content, 'time.Tick(')""")
q("defer_in_loop", f"""
SELECT task_id, path AS file, line, 'defer_in_loop' AS "check" FROM fold WHERE hit""",
  more=f"""src AS (
  SELECT task_id, path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS n,
         len(content) - len(replace(content, '{{', '')) AS opens,
         len(content) - len(replace(content, '}}', '')) AS closes,
         NOT {S.comment('content')} AND starts_with({T}, 'for') AND contains(content, '{{') AS is_for,
         NOT {S.comment('content')} AND (starts_with({T}, 'go ') OR {T} = 'go') AND contains(content, '{{') AS is_go,
         NOT {S.comment('content')} AND contains({T}, 'defer') AS is_defer
  FROM lines WHERE {S.is_go()} AND {T} <> ''),
fold AS (
  WITH RECURSIVE f AS (
    SELECT path, 0::BIGINT AS n, 0::BIGINT AS depth, -1::BIGINT AS lp, -1::BIGINT AS go, false AS hit,
           NULL::VARCHAR AS task_id, 0::BIGINT AS line FROM src WHERE n = 1
    UNION ALL
    SELECT path, n, greatest(depth + opens - closes, 0),
           CASE WHEN NOT (inside AND ex) AND closes > 0 AND depth + opens - closes <= lp2 THEN -1 ELSE lp2 END,
           CASE WHEN inside AND ex AND closes > 0 AND depth + opens - closes <= go2 THEN -1 ELSE go2 END,
           inside AND NOT ex, task_id, line
    FROM (SELECT *, is_defer AND lp2 >= 0 AND depth > lp2 AS inside, go2 >= 0 AND depth > go2 AS ex
          FROM (SELECT s.*, f.depth, CASE WHEN s.is_for AND f.lp < 0 THEN f.depth ELSE f.lp END AS lp2,
                       CASE WHEN s.is_go AND f.go < 0 THEN f.depth ELSE f.go END AS go2
                FROM f JOIN src s ON s.path = f.path AND s.n = f.n + 1)))
  SELECT * FROM f)""")
q("cancel_discarded", f"""
SELECT task_id, path AS file, line, 'cancel_discarded' AS "check" FROM lines
WHERE {GO_CODE} AND regexp_matches(content, ',\\s*_\\s*:?=[^=]*context\\.With(Cancel|Timeout|Deadline|CancelCause)\\(')""")

MASKED = "content"
for _p, _r in MASKS:
    MASKED = f"regexp_replace({MASKED}, {S.lit(_p)}, {S.lit(_r.replace('$1', chr(92) + '1'))}, 'g')"
q("mask_text", f"""
SELECT * FROM (SELECT task_id, path AS file, line, {MASKED} AS masked, content FROM raw_lines)
WHERE masked <> content""".replace("SELECT *", "SELECT task_id, file, line, masked", 1), S.RAW)

# Pairing rules -------------------------------------------------------------------------

ADDED = f"SELECT * FROM lines WHERE {T} <> ''"
_by_length = sorted(OPEN_CALLS, key=lambda k: (-len(k), k))
CLOSE_OF = "CASE " + " ".join(
    f"WHEN contains(content, {S.lit(k)}) THEN {S.lit(OPEN_CALLS[k])}" for k in _by_length
) + " END"
q("unclosed_resources", f"""
SELECT task_id, path AS file, line, 'resource_open' AS "check", handle || "close" AS detail FROM sites s
WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.path = s.path AND contains(l.content, s.handle || s."close"))
  AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.path = s.path AND s.handle <> ''
      AND regexp_matches(replace(l.content, s.handle || '.', ''), '\\breturn\\b.*\\b' || s.handle || '\\b'))""",
  more=f"""sites AS (
  SELECT * FROM (SELECT task_id, path, line, {CLOSE_OF} AS "close",
         coalesce({S.idents(S.facts('content'))}[1], '') AS handle
  FROM lines WHERE {GO_CODE} AND {S.any_contains('content', OPEN_CALLS)}) WHERE "close" IS NOT NULL)""")
q("tx_unfinished", f"""
SELECT task_id, path AS file, line, 'transaction_open' AS "check" FROM lines s
WHERE {S.any_contains('content', ['.Begin(', '.BeginTx('])} AND NOT starts_with({T}, '//')
  AND path NOT IN (SELECT path FROM lines WHERE {S.any_contains('content', ['.Commit(', '.Rollback('])})""")
q("cancel_leak", f"""
SELECT task_id, path AS file, line, 'cancel_unused' AS "check", name AS detail FROM sites s
WHERE name NOT IN ('_', '') AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.path = s.path
  AND regexp_matches(l.content, '\\b' || replace(s.name, '.', '\\.') || '\\s*\\('))""",
  more=f"""sites AS (
  SELECT task_id, path, line, {S.trim("regexp_extract(content, ',([^,:=]*):?=[^=]*context[.]With(?:Cancel|Timeout|Deadline|CancelCause)[(]', 1)")} AS name
  FROM lines WHERE {GO_CODE} AND contains(content, 'context.With'))""")
q("mutex_pair", f"""
SELECT task_id, path AS file, line, 'mutex_pair' AS "check", r AS detail FROM (
  SELECT *, regexp_extract(content, '([A-Za-z_][A-Za-z0-9_.\\[\\]\\*]*?)\\.Lock\\(\\)', 1) AS r
  FROM lines WHERE {GO_CODE} AND contains(content, '.Lock()')) s
WHERE r <> '' AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.path = s.path
  AND contains(l.content, s.r || '.Unlock()'))""")
q("timer_leak", f"""
SELECT task_id, path AS file, line, 'timer_leak' AS "check", v AS detail FROM (
  SELECT *, regexp_extract(content, '([A-Za-z_][A-Za-z0-9_]*)\\s*(?::=|=)\\s*time\\.New(?:Timer|Ticker)\\(', 1) AS v
  FROM lines WHERE {GO_CODE} AND contains(content, 'time.New')) s
WHERE v NOT IN ('', '_') AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.path = s.path
  AND regexp_matches(l.content, '\\b' || s.v || '\\.Stop\\(\\)'))""")
q("rows_err", f"""
SELECT task_id, path AS file, line, 'rows_err' AS "check" FROM lines
WHERE {GO_CODE} AND regexp_matches(content, '\\brows\\s*,\\s*err\\s*(?::=|=)\\s*.*\\.Query(?:Context)?\\(')
  AND path NOT IN (SELECT path FROM lines WHERE contains(content, 'rows.Err()'))""")

q("goroutine_exit", f"""
SELECT task_id, path AS file, line,
  CASE WHEN regexp_matches(content, '^\\s*go\\s+[A-Za-z_][A-Za-z0-9_]*(\\.[A-Za-z_][A-Za-z0-9_]*)+\\s*\\(')
       THEN 'goroutine_qualified' ELSE 'goroutine_leak' END AS "check"
FROM f s WHERE {S.has_kind('facts', 'go')}
  AND path NOT IN (SELECT path FROM f WHERE {S.has_kind('facts', 'select')} OR {S.has_kind('facts', 'defer')}
    OR len(list_filter({S.idents('facts')}, lambda z: lower(z) IN {S.inl(EXIT_NAMES)})) > 0)
  AND NOT (regexp_matches({T}, '^(go )?func') AND NOT EXISTS (SELECT 1 FROM f l
    WHERE l.path = s.path AND l.line > s.line AND {S.has_kind('l.facts', 'for')}))""",
  more=f"f AS (SELECT *, {S.facts('content')} AS facts FROM lines WHERE {S.is_go()})")
q("swallowed_error", f"""
SELECT task_id, path AS file, min(line) AS line, 'error_swallowed' AS "check" FROM (
  SELECT s.task_id, s.path, s.line, min_by({S.trim('l.content')}, l.line) AS r
  FROM lines s JOIN lines l ON l.path = s.path AND l.line BETWEEN s.line + 1 AND s.line + 4
    AND starts_with({S.trim('l.content')}, 'return')
  WHERE ends_with(s.path, '.go') AND contains(s.content, 'if err != nil') GROUP BY ALL)
WHERE r IN ('return nil', 'return nil,') GROUP BY ALL""")
q("ctx_root", f"""
SELECT task_id, path AS file, line, 'context_root' AS "check" FROM (
  SELECT *, last_value(CASE WHEN func THEN contains(string_split(t, ')')[1], 'context.Context')
            AND contains(t, ')') AND NOT regexp_matches(t, '^func (main|init)\\(') END IGNORE NULLS)
         OVER (PARTITION BY path ORDER BY line) AS in_context
  FROM (SELECT *, {T} AS t, starts_with({T}, 'func ') OR starts_with({T}, 'func(') AS func
        FROM lines WHERE {S.is_go()} AND NOT ends_with(path, '_test.go')))
WHERE NOT func AND in_context AND NOT {S.comment('content')}
  AND regexp_matches(content, 'context\\.(?:Background|TODO)\\(')""")
q("untested_exports", f"""
SELECT task_id, path AS file, line, 'missing_test' AS "check", name AS detail FROM (
  SELECT *, regexp_extract({T}, '^func ([A-Z][A-Za-z0-9_]*)', 1) AS name FROM lines
  WHERE {S.is_go()} AND NOT ends_with(path, '_test.go') AND starts_with({T}, 'func ')) s
WHERE name <> '' AND name NOT IN {S.inl(NO_TEST_NEEDED)}
  AND NOT EXISTS (SELECT 1 FROM lines l
    WHERE l.task_id = s.task_id AND (l.path = s.path OR ends_with(l.path, '_test.go'))
      AND NOT starts_with({S.trim('l.content')}, '//')
      AND (contains(l.content, 'func Test' || s.name || '_')
           OR (NOT starts_with({S.trim('l.content')}, 'func ')
               AND regexp_matches(l.content, '\\b' || s.name || '\\b'))))""")
q("large_deletes", f"""
SELECT * FROM (
SELECT task_id, path AS file,
  coalesce(min(n) FILTER (line_type = 'added'), min(o) FILTER (line_type = 'deleted' AND {T} <> ''))::BIGINT AS line,
  'large_delete' AS "check", (count(*) FILTER (line_type = 'deleted' AND {T} <> ''))::VARCHAR AS detail
FROM patch WHERE path NOT IN (SELECT path FROM made) GROUP BY task_id, path)
WHERE detail::INT >= 5""", S.RAW, PATCH + f""",
made AS (
  SELECT path FROM (SELECT path, content, row_number() OVER (PARTITION BY path ORDER BY line) AS r
                    FROM patch WHERE {T} <> '')
  WHERE r <= 10 AND starts_with({T}, '//') AND contains(lower(content), 'code generated')
    AND contains(lower(content), 'do not edit')
  UNION SELECT path FROM docs WHERE ends_with(path, '.pb.go'))""")

# Findings ---------------------------------------------------------------------------


def sub(name: str) -> str:
    return f"({ORACLE[name]})"


LOW = "lower(content)"
q("yaml_rules", f"""
SELECT task_id, path AS file, line, 'TEAM-TODO' AS "check" FROM lines
WHERE {S.any_contains(LOW, ['todo', 'fixme'])} AND NOT contains({LOW}, 'nolint')
UNION ALL
SELECT task_id, path, line, 'TEAM-HTTP' FROM f
WHERE regexp_matches(path, '\\.(go|py)$') AND NOT contains({LOW}, 'localhost') AND NOT starts_with({T}, '//')
  AND len(list_filter({S.literals('facts')}, lambda s: contains(lower(s), 'http://'))) > 0
  AND path NOT IN (SELECT path FROM raw_lines WHERE contains({LOW}, 'tls.config{{insecureskipverify: false}}'))
UNION ALL
SELECT task_id, path, line, 'TEAM-PORT' FROM f
WHERE NOT {S.any_contains(LOW, ['localhost', '127.0.0.1'])}
  AND len(list_filter({S.idents('facts')}, lambda s: contains(lower(s), 'port') OR contains(lower(s), 'addr'))) > 0
  AND len(list_filter({S.literals('facts')}, lambda s: regexp_matches(s, '^"\\d{{4,5}}"$'))) > 0""",
  more=f"f AS (SELECT *, {S.facts('content')} AS facts FROM lines WHERE contains(content, '\"') OR contains(content, '`'))")


def check_case(field: str) -> str:
    def value(c):
        v = getattr(c, field)
        return str(v) if isinstance(v, float) else S.lit(v)

    return 'CASE "check" ' + " ".join(f"WHEN {S.lit(k)} THEN {value(c)}" for k, c in CHECKS.items()) + " END"


def with_role(source: str) -> str:
    """Findings of a hits query, lowered outside production code."""
    return f"""SELECT task_id, file, line, {check_case('rule_id')} AS rule_id, {check_case('category')} AS category,
  CASE WHEN low THEN 'low' ELSE {check_case('severity')} END AS severity,
  (CASE WHEN low THEN 0.65 ELSE {check_case('confidence')} END)::DOUBLE AS confidence
FROM (SELECT *, {ROLE} <> 'production' AND {check_case('confidence')} > 0.65 AS low
      FROM (SELECT *, file AS path FROM ({source})))"""


ORACLE["role_dampening"] = with_role(ORACLE["credential_shapes"])
EVIDENCE = "content"
q("masked_evidence", f"""
SELECT task_id, path AS file, line, rule_id, {MASKED.replace('content', 'shown', 1)} AS evidence,
       'hunk: ' || path || '@L' || line || '|fact: ' || fact || '|rule: ' || rule_id
         || '|confidence: ' || conf AS chain
FROM (
  SELECT task_id, path, line, 'SEC-AST-001' AS rule_id, "check",
         CASE WHEN strlen(secret) > 8 AND contains(content, secret)
              THEN content[:strpos(content, secret) - 1] || secret[:4] || '***REDACTED***'
                   || content[strpos(content, secret) + len(secret):] ELSE content END AS shown,
         {check_case('fact')} AS fact,
         CASE "check" WHEN 'secret_assigned' THEN '0.90' ELSE '0.70' END AS conf
  FROM (SELECT h.*, a.value AS secret FROM hard h JOIN assigned a USING (path, line)
        UNION ALL
        SELECT s.*, list_filter(list_transform({S.literals(S.facts('s.content'))}, lambda z: {unq('z')}),
                     lambda z: z <> s.name AND NOT {not_secret('z')})[1] AS secret FROM soft s)
  UNION ALL
  SELECT l.task_id, l.path, l.line, 'SEC-GEN-001', c."check", l.content,
         {check_case('fact').replace('CASE "check"', 'CASE c."check"')},
         CASE c."check" WHEN 'config_url' THEN '0.85' ELSE '0.80' END
  FROM {sub('config_credentials')} c JOIN lines l ON l.path = c.file AND l.line = c.line)""",
  more=f"{CODE},\n{ASSIGNED},\n{SECRETS}")

_RULE_QUERIES = [
    "hardcoded_secrets", "credential_shapes", "config_credentials", "error_handling", "sql_concat",
    "command_injection", "tls_off", "time_tick", "defer_in_loop", "cancel_discarded",
    "unclosed_resources", "tx_unfinished", "cancel_leak", "mutex_pair", "timer_leak", "rows_err",
    "goroutine_exit", "swallowed_error", "ctx_root", "untested_exports",
]
_UNION = "\nUNION ALL\n".join(
    f'SELECT task_id, file, line, "check" FROM {sub(n)}' for n in _RULE_QUERIES
)
REVIEWED = f"""found AS ({with_role(f'''
    SELECT * FROM ({_UNION}) h WHERE "check" = 'missing_test' OR NOT EXISTS (
      SELECT 1 FROM raw_lines n WHERE n.path = h.file AND n.line = h.line
        AND regexp_matches(n.content, '//\\s*nolint(:|\\s|$)'))''')}),
reviewed AS (
  SELECT task_id, file, line, rule_id, category, severity, confidence,
         CASE WHEN confidence >= 0.7 THEN 'finding' ELSE 'warning' END AS bucket, copies
  FROM (SELECT *, row_number() OVER (PARTITION BY task_id, file, line, category, rule_id
               ORDER BY confidence DESC, severity) AS r,
               count(*) OVER (PARTITION BY task_id, file, line, category, rule_id) AS copies FROM found)
  WHERE r = 1)"""
q("review_findings", "SELECT * FROM reviewed", S.RAW, REVIEWED)

_DIMENSIONS = {
    "security": 0.30, "sensitive_leak": 0.15, "resource": 0.20, "error_handling": 0.15,
    "testing": 0.15, "concurrency": 0.05,
}
_TENTHS = "CASE severity WHEN 'high' THEN 10 WHEN 'medium' THEN 6 WHEN 'low' THEN 3 WHEN 'info' THEN 1 ELSE 0 END"


def mean_of(category: str) -> str:
    here = f"FILTER (bucket = 'finding' AND category = '{category}')"
    return f"least(100, coalesce(sum({_TENTHS}) {here} * 10 / nullif(count(*) {here}, 0), 0))"


TOTAL = " + ".join(f"{mean_of(c)} * {w}" for c, w in _DIMENSIONS.items())
GRADE = "CASE WHEN score >= 80 THEN 'F' WHEN score >= 60 THEN 'D' WHEN score >= 40 THEN 'C' WHEN score >= 20 THEN 'B' ELSE 'A' END"
q("review_scores", f"""
SELECT task_id, score, {GRADE} AS grade, finding_count, warning_count FROM (
  SELECT t.task_id, round({TOTAL}, 2) AS score, count(*) FILTER (bucket = 'finding') AS finding_count,
         count(*) FILTER (bucket = 'warning') AS warning_count
  FROM (SELECT DISTINCT task_id FROM raw_lines) t LEFT JOIN reviewed r ON r.task_id = t.task_id
  GROUP BY t.task_id)""", S.RAW, REVIEWED)

# A large findings table ---------------------------------------------------------------

OFIND = """ofind AS (
  SELECT 't' || (o_custkey % 97) AS task_id,
         CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'N' THEN 'medium' WHEN 'R' THEN 'low' ELSE 'info' END AS severity,
         ['security', 'sensitive_leak', 'resource', 'error_handling', 'testing', 'concurrency',
          'quality'][(l_partkey % 7) + 1] AS category,
         'R-' || (l_suppkey % 17) AS rule_id,
         'dir' || (l_partkey % 29) || '/f' || l_partkey || '.go' AS file, l_linenumber::BIGINT AS line,
         'evidence ' || l_quantity::INT AS evidence, 0.5 + l_discount * 5 AS confidence,
         l_orderkey AS seq, year(o_orderdate) AS year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
DEDUP = """best AS (
  SELECT *, CASE WHEN confidence >= 0.7 THEN 'finding' ELSE 'warning' END AS bucket FROM (
    SELECT *, count(*) OVER (PARTITION BY task_id, file, line, category, rule_id) AS copies,
           row_number() OVER (PARTITION BY task_id, file, line, category, rule_id
                              ORDER BY confidence DESC, seq, severity, evidence) AS r FROM ofind)
  WHERE r = 1)"""
BEST = f"{OFIND},\n{DEDUP}"
q("dedup_findings", """
SELECT task_id, file, line, rule_id, category, severity, round(confidence, 4) AS confidence,
       bucket, copies, seq FROM best""", BEST)
q("false_positive_memory", """
SELECT rule_id, count(*) AS n, round(sum(c), 3) AS confidence, count(*) FILTER (c < 0.5) AS lowered FROM (
  SELECT o.rule_id, o.confidence * CASE
    WHEN EXISTS (SELECT 1 FROM marks m WHERE m.rule_id = o.rule_id AND m.file = o.file AND m.line = o.line AND m.line <> 0) THEN 0.5
    WHEN EXISTS (SELECT 1 FROM marks m WHERE m.rule_id = o.rule_id AND m.file = o.file) THEN 0.6 ELSE 1 END AS c
  FROM ofind o) GROUP BY ALL""", OFIND, """marks AS (
  SELECT 'R-' || (p_partkey % 17) AS rule_id,
         'dir' || (p_partkey % 29) || '/f' || p_partkey || '.go' AS file, p_partkey % 5 AS line FROM part)""")
q("run_comparison", """
SELECT task_id, year, status, count(*) AS n, sum(line)::BIGINT AS lines FROM (
  SELECT c.task_id, c.year, c.line,
         CASE WHEN (c.task_id, c.year - 1, c.rule_id, c.file, trim(c.evidence)) IN
           (SELECT (task_id, year, rule_id, file, trim(evidence)) FROM ofind)
         THEN 'recurred' ELSE 'new' END AS status FROM ofind c
  UNION ALL
  SELECT p.task_id, p.year + 1, p.line, 'gone' FROM ofind p
  WHERE (p.task_id, p.year + 1, p.rule_id, p.file, trim(p.evidence)) NOT IN
        (SELECT (task_id, year, rule_id, file, trim(evidence)) FROM ofind))
GROUP BY ALL""", OFIND)

TASKS = """tasks AS (
  SELECT event_id::VARCHAR AS task_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
         user_id::VARCHAR AS input_path, ts AS started_at, least(100.0, value) AS risk_score FROM events)"""
q("previous_task", """
SELECT task_id, input_path, last_value(CASE WHEN status = 'completed' THEN task_id END IGNORE NULLS) OVER (
  PARTITION BY input_path ORDER BY started_at, task_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS previous_task_id FROM tasks""", TASKS)

RANK = "CASE severity WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
NUMBERED = f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY task_id, batch
    ORDER BY {RANK} DESC, file, line, rule_id, category) AS ordinal
  FROM (SELECT *, (('0x' || md5(file || ':' || line || ':' || category || ':' || rule_id)[:8])::BIGINT
               % ceil(count(*) OVER (PARTITION BY task_id) / 500)::BIGINT)::BIGINT AS batch FROM best))"""
ANSWERS = """numbers AS (
  SELECT c_custkey AS k, unnest(list_concat(range(1, 41), [3, 5])) AS n, unnest(range(0, 42)) AS i FROM customer),
verdicts AS (
  SELECT 't' || (k % 97) AS task_id, k // 97 AS batch, n AS ordinal,
         arg_max(CASE WHEN (n * 7 + k + i) % 3 = 0 THEN 'DENY' ELSE 'CONFIRM' END, i) AS verdict
  FROM numbers GROUP BY ALL),
advice AS (
  SELECT 't' || (k % 97) AS task_id, k // 97 AS batch, n AS ordinal,
         arg_min('advice ' || ((k + i) % 9), i) AS suggestion FROM numbers GROUP BY ALL)"""
q("candidate_ordinals", """
SELECT task_id, batch, ordinal, file, line, rule_id, category FROM numbered""", BEST, NUMBERED)
q("candidate_prompts", """
SELECT task_id, batch, 'Review these candidate findings. Answer with ' || count(*) ||
  ' lines of the form ''number. CONFIRM: reason'' or ''number. DENY: reason''.' || chr(10) ||
  string_agg(ordinal || '. [' || rule_id || '][' || severity || '] ' || file || ':' || line || ' ' || rule_id
             || chr(10) || '   evidence: ' || evidence, chr(10) ORDER BY ordinal) AS prompt,
  count(*) AS candidates FROM numbered GROUP BY task_id, batch""", BEST, NUMBERED)
q("apply_verdicts", """
SELECT task_id, severity, count(*) AS kept FROM numbered n
WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.task_id = n.task_id AND v.batch = n.batch
                  AND v.ordinal = n.ordinal AND verdict = 'DENY') GROUP BY ALL""", BEST, f"{NUMBERED},\n{ANSWERS}")
q("verdict_stats", """
SELECT n.task_id, count(*) AS reviewed, count(*) FILTER (verdict = 'DENY') AS dropped
FROM numbered n LEFT JOIN verdicts v USING (task_id, batch, ordinal) GROUP BY ALL""",
  BEST, f"{NUMBERED},\n{ANSWERS}")
q("apply_suggestions", """
SELECT n.task_id, coalesce(suggestion, 'none') AS recommendation, count(*) AS n
FROM numbered n LEFT JOIN advice a USING (task_id, batch, ordinal) GROUP BY ALL""",
  BEST, f"{NUMBERED},\n{ANSWERS}")

# Reports ----------------------------------------------------------------------------

q("risk_score", f"""
SELECT task_id, score, {GRADE} AS grade, finding_count, warning_count, security_score, security_count FROM (
  SELECT task_id, round({TOTAL}, 2) AS score, count(*) FILTER (bucket = 'finding') AS finding_count,
         count(*) FILTER (bucket = 'warning') AS warning_count,
         round({mean_of('security')}, 4) AS security_score,
         count(*) FILTER (bucket = 'finding' AND category = 'security') AS security_count
  FROM best GROUP BY task_id)""", BEST)
_SEV = ", ".join(
    f"count(*) FILTER (bucket = 'finding' AND severity = '{s}') AS {s}" for s in ("high", "medium", "low", "info")
)
q("finding_summary", f"""
SELECT task_id, count(*) FILTER (bucket = 'finding') AS total_findings,
       count(*) FILTER (bucket = 'warning') AS total_warnings, sum(copies - 1)::BIGINT AS dedup_removed, {_SEV}
FROM best GROUP BY task_id""", BEST)
q("findings_by_category", """
SELECT task_id, category, count(*) AS n FROM best WHERE bucket = 'finding' GROUP BY ALL""", BEST)
q("severity_pivot", """
SELECT task_id, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
       count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'info') AS info, count(*) AS total
FROM ofind GROUP BY ALL""", OFIND)
q("finding_stats", """
SELECT 'total' AS kind, '' AS key, count(*) AS n FROM ofind
UNION ALL SELECT 'severity', severity, count(*) FROM ofind GROUP BY ALL
UNION ALL SELECT 'category', category, count(*) FROM ofind GROUP BY ALL
UNION ALL SELECT * FROM (SELECT 'rule', rule_id, count(*) AS n FROM ofind GROUP BY ALL
                         ORDER BY n DESC, rule_id LIMIT 10)""", OFIND)
q("directory_density", """
SELECT task_id, dir, files, findings, warnings, round((findings + warnings) / files, 6) AS density,
       round((findings + warnings) / greatest(max(findings + warnings) OVER (PARTITION BY task_id), 1) * 100, 4) AS bar
FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY findings + warnings DESC, dir) AS r
  FROM (SELECT task_id, dir, greatest(coalesce(files, 0), 1) AS files, coalesce(findings, 0) AS findings,
               coalesce(warnings, 0) AS warnings
        FROM (SELECT 't' || (p_partkey % 97) AS task_id, 'dir' || (p_partkey % 37) AS dir, count(*) AS files
              FROM part GROUP BY ALL)
        FULL JOIN (SELECT task_id, string_split(file, '/')[1] AS dir, count(*) FILTER (bucket = 'finding') AS findings,
                          count(*) FILTER (bucket = 'warning') AS warnings FROM best GROUP BY ALL)
        USING (task_id, dir)))
WHERE r <= 20""", BEST)
q("risky_files", """
SELECT task_id, file, findings, warnings, weight FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY weight DESC, file) AS r FROM (
    SELECT task_id, file, count(*) FILTER (bucket = 'finding') AS findings,
           count(*) FILTER (bucket = 'warning') AS warnings,
           sum(CASE WHEN bucket = 'warning' THEN 1 WHEN severity = 'high' THEN 5 WHEN severity = 'medium' THEN 3
                    WHEN severity = 'low' THEN 2 ELSE 1 END)::BIGINT AS weight
    FROM best GROUP BY ALL)) WHERE r <= 10""", BEST)
q("report_documents", f"""
SELECT task_id, {GRADE} AS grade, findings FROM (
  SELECT task_id, round({TOTAL}, 2) AS score, count(*) FILTER (bucket = 'finding') AS findings
  FROM best GROUP BY task_id)""", BEST)
q("task_totals", """
SELECT count(*) AS tasks, round(avg(risk_score), 6) AS avg_risk, max(risk_score) AS max_risk FROM tasks""", TASKS)
q("daily_trend", """
SELECT started_at::DATE AS day, count(*) AS tasks, round(avg(risk_score), 6) AS avg_risk FROM tasks
WHERE started_at::DATE >= DATE '2024-01-30' - 29 GROUP BY ALL""", TASKS)
q("recent_tasks", """
SELECT task_id, status, risk_score FROM tasks ORDER BY started_at DESC, task_id LIMIT 10""", TASKS)
q("task_state", """
SELECT task_id, status, CASE WHEN status IN ('completed', 'failed')
       THEN round((epoch_us(moment) - epoch_us(begun)) / 1000)::BIGINT END AS duration_ms, error_msg FROM (
  SELECT user_id::VARCHAR AS task_id, ts AS moment, CASE WHEN event_type = 'error' THEN props END AS error_msg,
         CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'running'
              WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS status,
         min(ts) OVER (PARTITION BY user_id) AS begun,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS r FROM events) WHERE r = 1""", "x AS (SELECT 1)")
q("run_summary", """
SELECT user_id::VARCHAR AS task_id, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS succeeded,
       count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 100) AS timed_out,
       sum(event_id % 1000)::BIGINT AS duration_ms FROM events GROUP BY ALL""", "x AS (SELECT 1)")

# Commands ---------------------------------------------------------------------------

CFG = SafetyConfig()
LOG = f"""log AS (
  SELECT event_id, user_id::VARCHAR AS task_id, {S.lst(COMMANDS)}[(event_id % {len(COMMANDS)}) + 1] AS command,
         event_id % 7 * 60000000000 AS timeout_ns, event_id % 11 * 600000 AS output_bytes FROM events)"""


def rx(words) -> str:
    special = set(".^$*+?{}[]\\|()/~")
    return "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words)


_EDGE = "[ \\t\\n|&;(){}\\[\\]<>\"''`$#]"
_DENIED = (
    f"(?:^|{_EDGE})(?:(?:{rx(c for c in CFG.denied_commands if not c.endswith(' '))})(?:{_EDGE}|$)"
    f"|(?:{rx(c for c in CFG.denied_commands if c.endswith(' '))}))"
)
HOST = (
    "regexp_replace(coalesce(" + ", ".join(
        f"CASE WHEN contains(lower(command), '{s}') THEN regexp_extract(command, '(?i){s}([^ /\"''\\n\\t]*)', 1) END"
        for s in ("http://", "https://", "ftp://")
    ) + ", ''), '^([^:]+):.*', '\\1')"
)
JUDGED = f"""judged AS (
  SELECT *, CASE
    WHEN command = '' THEN 'EMPTY_CMD'
    WHEN regexp_matches(lower(command), '{_DENIED}') THEN 'DENIED_CMD'
    WHEN regexp_matches(lower(command), '(?:^|[ \\t"''=:/])(?:{rx(CFG.denied_paths)})') THEN 'DENIED_PATH'
    WHEN {S.any_contains('command', [m for m, _ in INJECTIONS])}
      OR ({S.any_contains('command', ['||', '&&'])} AND {S.any_contains('lower(command)', CHAINED)}) THEN 'SHELL_INJECTION'
    WHEN {HOST} IN {S.inl(CFG.allowed_domains)} THEN 'NET_ALLOWED'
    WHEN {HOST} <> '' THEN 'NET_DENIED'
    WHEN regexp_matches(lower(command), '^(?:{rx(CFG.allowed_commands)})(?:[ \\t\\n|&;]|$)') THEN 'WHITELIST'
    ELSE 'DEFAULT' END AS rule_id FROM log),
decided AS (
  SELECT *, CASE WHEN rule_id IN ('EMPTY_CMD', 'DENIED_CMD', 'DENIED_PATH', 'NET_DENIED') THEN 'deny'
              WHEN rule_id = 'SHELL_INJECTION' THEN 'ask' ELSE 'allow' END AS action,
         CASE WHEN rule_id IN ('EMPTY_CMD', 'WHITELIST') THEN 'safe' WHEN rule_id = 'SHELL_INJECTION' THEN 'medium'
              WHEN rule_id IN ('NET_ALLOWED', 'DEFAULT') THEN 'low' ELSE 'high' END AS risk_level FROM judged)"""
q("command_decisions", "SELECT event_id, command, action, risk_level, rule_id FROM decided", LOG, JUDGED)
q("command_limits", """
SELECT rule_id, action, count(*) AS n FROM (
  SELECT CASE WHEN t OR o THEN 'deny' ELSE action END AS action,
         CASE WHEN t THEN 'TIMEOUT_EXCEEDED' WHEN o THEN 'OUTPUT_EXCEEDED' ELSE rule_id END AS rule_id
  FROM (SELECT *, action = 'allow' AND timeout_ns > 300000000000 AS t,
               action = 'allow' AND output_bytes > 5242880 AS o FROM decided)) GROUP BY ALL""", LOG, JUDGED)
q("command_hosts", f"""
SELECT event_id, host, host = 'github.com' OR ends_with(host, '.local') AS allowed
FROM (SELECT event_id, {HOST} AS host FROM log)""", LOG)
q("governance_summary", """
SELECT task_id, count(*) AS checks, count(*) FILTER (action = 'allow') AS allowed,
       count(*) FILTER (action = 'deny') AS denied, count(*) FILTER (action = 'ask') AS asked
FROM decided GROUP BY ALL""", LOG, JUDGED)
q("denied_commands", """
SELECT task_id, command, count(*) AS n FROM decided WHERE action = 'deny' GROUP BY ALL""", LOG, JUDGED)
ORACLE["env_filter"] = "SELECT event_id, 'Lang,PATH,home' AS names FROM events"
q("path_allow_list", """
SELECT '/srv/x/../' || path AS path FROM docs
WHERE starts_with(path, 'pkg/src1/') OR starts_with(path, 'examples/')""", S.DOCS)
_WHOLE = MASKED.replace("content", "whole", 1)
q("masked_outputs", f"""
SELECT doc_id, CASE WHEN strlen(m) > 400 THEN
         (SELECT max(p) FROM (SELECT m[:k] AS p FROM range(0, 401) t(k)) WHERE strlen(p) <= 400)
         || chr(10) || '[output truncated]' ELSE m END AS output, strlen(m) > 400 AS truncated
FROM (SELECT doc_id, {_WHOLE} AS m FROM (
  SELECT doc_id, string_agg(content, chr(10) ORDER BY line) AS whole FROM raw_lines GROUP BY doc_id))""", S.RAW)

# Sources ----------------------------------------------------------------------------

LINT = r"'^([^:\s]+):(\d+):(\d+):\s+(.+?)\s+\(([A-Z]+\d+)\)$'"
LINTS = f"""lints AS (
  SELECT task_id, regexp_extract({T}, {LINT}, 1) AS file, regexp_extract({T}, {LINT}, 2)::BIGINT AS line,
         regexp_extract({T}, {LINT}, 5) AS code, regexp_extract({T}, {LINT}, 4) AS evidence
  FROM raw_lines WHERE regexp_matches({T}, {LINT}))"""
q("linter_log", "SELECT task_id, file, line, 'STATICCHECK-' || code AS rule_id, evidence FROM lints", S.RAW, LINTS)
q("linter_summary", """
SELECT task_id, sum(n)::BIGINT || ' findings (' || string_agg(code || '×' || n, ', ' ORDER BY code) || ')' AS summary
FROM (SELECT task_id, code, count(*) AS n FROM lints GROUP BY ALL) GROUP BY task_id""", S.RAW, LINTS)
OSV = """osv AS (
  SELECT task_id, json_extract_string(content, '$.osv.id') AS id, json_extract_string(content, '$.osv.details') AS details,
         json_extract_string(content, '$.osv.aliases[0]') || ', ' || json_extract_string(content, '$.osv.aliases[1]') AS aliases
  FROM raw_lines WHERE starts_with(content, '{"osv"'))"""
q("vulnerability_log", """
SELECT task_id, 'go.mod' AS file, 'Vulnerable dependency: ' || details AS title,
       id || ' (' || aliases || ')' AS evidence, 0.9::DOUBLE AS confidence FROM osv""", S.RAW, OSV)
q("vulnerability_summary", f"""
SELECT task_id, count(*) FILTER ({T} <> '' AND NOT starts_with(content, '{{"osv"')) AS bad_lines,
       count(*) FILTER (starts_with(content, '{{"osv"')) AS vulnerabilities FROM raw_lines GROUP BY ALL""", S.RAW)
q("link_parse", r"""
SELECT page_id,
  CASE page_id % 6 WHEN 1 THEN 'owner' || page_id WHEN 4 THEN NULL END AS owner,
  CASE page_id % 6 WHEN 1 THEN 'repo' END AS repo,
  CASE page_id % 6 WHEN 2 THEN 'owner-' || page_id WHEN 3 THEN 'owner' END AS change_owner,
  CASE page_id % 6 WHEN 2 THEN page_id::VARCHAR WHEN 3 THEN page_id::VARCHAR END AS number,
  CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://github.com/owner' || page_id || '/repo'
    WHEN 2 THEN 'https://github.com/owner-' || page_id || '/repo#' || page_id
    WHEN 3 THEN 'https://github.com/www.github.com/owner/repo/pull/' || page_id || '/'
    WHEN 4 THEN '../local/' || page_id || '.git' ELSE 'https://github.com/owner/..x' || page_id END AS canonical,
  page_id % 6 IN (0, 4) AS local
FROM pages""", "x AS (SELECT 1)")
q("artifact_admission", """
SELECT task_id, seq, CASE WHEN r > 20 THEN 'count' WHEN seq % 6 IN (2, 4) THEN 'extension'
       WHEN bytes > 1048576 THEN 'size' END AS rejected
FROM (SELECT 'a' || (page_id % 7) AS task_id, page_id AS seq, strlen(html) AS bytes,
             row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) AS r FROM pages)""", "x AS (SELECT 1)")
q("import_list", f"""
SELECT task_id, path AS file, line, regexp_extract({T}, '"([^"]+)"', 1) AS path,
       nullif(regexp_extract({T}, '^import\\s+([A-Za-z_.][A-Za-z0-9_]*)\\s', 1), '') AS alias,
       regexp_extract(regexp_extract({T}, '"([^"]+)"', 1), '([^/]*)$', 1) AS name
FROM raw_lines WHERE {S.is_go()} AND regexp_matches({T}, '^import\\s+(?:([A-Za-z_.][A-Za-z0-9_]*)\\s+)?"([^"]+)"')""", S.RAW)
q("function_list", f"""
SELECT task_id, path AS file, line, name, receiver, regexp_matches(name, '^[A-Z]') AS is_exported FROM (
  SELECT task_id, path, line,
         regexp_extract(content, '^func\\s+(?:\\([^)]*\\)\\s*)?([A-Za-z_][A-Za-z0-9_]*)\\s*[(]', 1) AS name,
         nullif(regexp_extract(content, '^func\\s+\\([A-Za-z_]+\\s+(\\*?[A-Za-z_]+)\\)', 1), '') AS receiver
  FROM raw_lines WHERE {S.is_go()} AND starts_with(content, 'func')) WHERE name <> ''""", S.RAW)
q("global_list", f"""
SELECT task_id, path AS file, line, regexp_extract(content, '^(?:var|const)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS name
FROM raw_lines WHERE {S.is_go()} AND regexp_matches(content, '^(?:var|const)\\s+[A-Za-z_]')""", S.RAW)
q("task_names", f"""
SELECT conv_id, turn, substring(replace(replace({S.trim('text')}, chr(10), ' '), chr(13), ' '), 1, 80) AS name
FROM conversations""", "x AS (SELECT 1)")

# Quality ----------------------------------------------------------------------------

LABELLED = f"""want AS (SELECT task_id, path AS file, line FROM raw_lines WHERE contains(content, 'hunter-Winter')),
got AS (SELECT task_id, file, line FROM {sub('hardcoded_secrets')}),
kept AS (SELECT task_id, file, line FROM {sub('nolint_suppression')})"""


def tally(alias: str, source: str) -> str:
    return f"""{alias} AS (
  SELECT coalesce(w.task_id, g.task_id) AS case_id, count(*) FILTER (w.file IS NOT NULL AND g.file IS NOT NULL) AS tp,
         count(*) FILTER (g.file IS NULL) AS fn, count(*) FILTER (w.file IS NULL) AS fp
  FROM want w FULL JOIN {source} g ON w.file = g.file AND w.line = g.line GROUP BY ALL)"""


TALLY = f"{LABELLED},\n{tally('tally', 'got')},\n{tally('tally2', 'kept')}"
q("rule_quality", """
SELECT case_id, tp, fn, fp, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision FROM tally""", S.RAW, TALLY)
q("configuration_comparison", """
SELECT 'SEC-AST-001' AS rule_id, sum(a.tp)::BIGINT AS tp_first, sum(b.tp)::BIGINT AS tp_second,
       sum(a.fn)::BIGINT AS fn_first, sum(b.fn)::BIGINT AS fn_second, sum(a.fp)::BIGINT AS fp_first,
       sum(b.fp)::BIGINT AS fp_second
FROM tally a FULL JOIN tally2 b USING (case_id)""", S.RAW, TALLY)
q("leak_check", """
SELECT task_id AS case_id, 'RAW' AS rule_id, count(*) AS leaks FROM raw_lines
WHERE regexp_matches(content, 'hunter-Winter-[0-4]042') GROUP BY ALL""", S.RAW)
q("negative_rate", """
SELECT count(*) AS negatives, count(*) FILTER (coalesce(tp, 0) + coalesce(fp, 0) > 0) AS flagged,
       count(*) FILTER (coalesce(tp, 0) + coalesce(fp, 0) > 0) / count(*) AS negative_rate
FROM (SELECT DISTINCT task_id AS case_id FROM docs) LEFT JOIN tally USING (case_id)
WHERE regexp_extract(case_id, '(\\d+)', 1)::INT % 2 = 1""", S.RAW, TALLY)

# Streams ----------------------------------------------------------------------------

q("stream_trend", """
SELECT started_at::DATE AS day, count(*) AS tasks, round(avg(risk_score), 6) AS avg_risk FROM tasks
GROUP BY ALL""", TASKS)
ORACLE["stream_distinct"] = """
SELECT DISTINCT user_id::VARCHAR AS task_id, props AS file, event_type AS category FROM events"""
q("stream_audit", """
SELECT action AS decision, rule_id, count(*) AS n FROM decided GROUP BY ALL""", LOG, JUDGED)
_LATE = """
SELECT event_id::VARCHAR AS task_id, 'failed' AS status, ts + INTERVAL 10 MINUTE AS at FROM events
WHERE (event_type = 'error' OR event_id % 21 > 10)"""
ORACLE["watchdog"] = _LATE
ORACLE["stream_watchdog"] = _LATE

# The line rules over patches: only added lines count, numbered on the new side.
_PATCH_LINES = """patch_added AS (
  SELECT 'd' || doc_id AS task_id, path, content, (line - 1) % 4 AS k,
         8 + sum(CASE WHEN (line - 1) % 4 <> 1 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS n
  FROM raw_lines),
lines AS (
  SELECT task_id, path, n::BIGINT AS line, content FROM patch_added
  WHERE k >= 2 AND path NOT IN (SELECT path FROM generated))"""
_LINE_RULE_QUERIES = _RULE_QUERIES[:10]
_PATCH_UNION = "\nUNION ALL\n".join(
    f'SELECT task_id, file, line, "check" FROM ({ORACLE[n].replace(S.LINES, _PATCH_LINES)})'
    for n in _LINE_RULE_QUERIES
)
ORACLE["stream_line_findings"] = with_role(_PATCH_UNION).replace(
    f"{ROLE} <> 'production' AND", "false AND"
)
