"""DuckDB SQL for the queries of sources, stored tables, streams and SQL names."""

from __future__ import annotations

import os

from ..functions import paths as P
from ..operators.checks import CHECKS
from ..operators.scoring import DIMENSIONS
from ..operators.user_rules import load_rules
from . import oracle as O
from . import oracle_parts as S

STORED_ORACLE: dict[str, str] = {}


def q(name: str, body: str, *prelude: str) -> None:
    STORED_ORACLE[name] = ("WITH " + ",\n".join(prelude) + "\n" if prelude else "") + body


# Review -----------------------------------------------------------------------------

q("isolated_rules", """
SELECT task_id, file, line, rule_id, 'found' AS outcome FROM reviewed
UNION ALL
SELECT task_id, path, line, 'NUM-001', CASE line WHEN 1 THEN 'CAST_INVALID_INPUT' ELSE 'found' END
FROM raw_lines WHERE doc_id = 7 AND line IN (1, 2)""", S.RAW, O.REVIEWED)

_RULES = {c.rule_id: (c.severity, c.category, "builtin") for c in reversed(CHECKS.values())}
for _r in load_rules(os.path.join(os.path.dirname(os.path.dirname(__file__)), "sources", "sample_rules.yaml")):
    _RULES.setdefault(_r.id, (_r.severity, _r.category, "yaml"))
_VALUES = ", ".join("(" + ", ".join(map(S.lit, (k, *v))) + ")" for k, v in sorted(_RULES.items()))
q("rule_hits", f"""
SELECT c.rule_id, c.severity, c.category, c.origin, count(r.rule_id) AS findings
FROM (VALUES {_VALUES}) c(rule_id, severity, category, origin)
LEFT JOIN reviewed r ON r.rule_id = c.rule_id GROUP BY ALL""", S.RAW, O.REVIEWED)

_CLOSES = """RECURSIVE closes AS (
  SELECT doc_id, source FROM documents WHERE doc_id % 5 = 0
  UNION
  SELECT d.doc_id, d.source FROM documents d
  JOIN closes c ON c.doc_id = d.doc_id + 1 AND c.source = d.source WHERE d.doc_id % 3 <> 0)"""
_FILE = "'pkg/' || source || '/t' || doc_id || '.go'"
q("closer_facts", f"""
SELECT d.source AS task_id, {_FILE.replace('source', 'd.source').replace('doc_id', 'd.doc_id')} AS file,
       n::BIGINT AS line, c.doc_id IS NOT NULL AS implements_closer
FROM documents d CROSS JOIN (VALUES (8), (9)) t(n) LEFT JOIN closes c ON c.doc_id = d.doc_id""", _CLOSES)
q("unclosed_by_type", f"""
SELECT source AS task_id, {_FILE} AS file, n::BIGINT AS line, name || '.Close()' AS detail
FROM closes CROSS JOIN (VALUES (8, 'x'), (9, 'v')) t(n, name)""", _CLOSES)
STORED_ORACLE["large_deletes_30"] = O.ORACLE["large_deletes"].replace("detail::INT >= 5", "detail::INT >= 30")

# Snapshots --------------------------------------------------------------------------

_REASON = """CASE WHEN doc_id % 13 = 0 THEN 'symlink' WHEN doc_id % 17 = 0 THEN 'unreadable'
  WHEN doc_id % 19 = 0 THEN 'oversized' WHEN doc_id % 5 = 0 THEN 'binary' ELSE 'kept' END"""
q("snapshot_scan", f"""
SELECT reason, count(*) AS files,
       (sum(strlen(coalesce(text, ''))) FILTER (reason = 'kept'))::BIGINT AS bytes
FROM (SELECT {_REASON} AS reason, text FROM documents WHERE doc_id % 11 <> 0
      UNION ALL SELECT 'skipdir', NULL FROM (SELECT DISTINCT source FROM documents WHERE doc_id % 11 = 0))
GROUP BY reason""")
q("snapshot_files", f"""
SELECT source || '/f' || doc_id || '.txt' AS path, length(coalesce(text, '')) AS chars,
       md5(coalesce(text, '')) AS digest
FROM documents WHERE doc_id % 11 <> 0 AND {_REASON} = 'kept'""")

# Stored tables ----------------------------------------------------------------------

q("stored_status", """
SELECT event_id::VARCHAR AS task_id,
       CASE WHEN event_id % 3 <> 0 THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN event_id % 3 = 0 THEN (event_id % 50) * 1000 END::BIGINT AS duration_ms,
       CASE WHEN event_id % 3 = 0 AND event_type = 'error' THEN 'gave up' END AS error_msg
FROM events""")
_RUNS = """runs AS (
  SELECT 't' || (o_custkey % 97) AS task_id, year(o_orderdate) % 2 AS run
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT task_id, run, count(*) AS n FROM runs GROUP BY ALL)"""
q("stored_results", """
SELECT v AS version, task_id, sum(n)::BIGINT AS findings, max_by(n, run)::VARCHAR AS json_report,
       'run ' || max(run) AS status
FROM n JOIN (VALUES (1::BIGINT), (2)) t(v) ON run < v GROUP BY v, task_id""", _RUNS)
q("stored_marks", """
SELECT p_partkey AS id, 'R-' || (p_partkey % 17) AS rule_id, 'f' || p_partkey || '.go' AS file_path,
       CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE 3 END::BIGINT AS line
FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 8 = 0""")

# Streams ----------------------------------------------------------------------------

q("stream_review", """
SELECT 'd' || regexp_extract(file, '/f([0-9]+)[._]', 1) AS task_id, file, line, rule_id, category,
       severity, confidence, bucket
FROM reviewed WHERE rule_id <> 'TST-AST-001'""", S.RAW, O.REVIEWED)
_JOBS = """jobs AS (
  SELECT event_id::VARCHAR AS task_id, 'queued' AS status, ts::TIMESTAMP AS moment FROM events
  UNION ALL SELECT event_id::VARCHAR, 'running', ts::TIMESTAMP + INTERVAL 10 SECOND FROM events WHERE event_id % 13 <> 0
  UNION ALL SELECT event_id::VARCHAR, 'running', ts::TIMESTAMP + INTERVAL 20 SECOND FROM events WHERE event_id % 17 = 0
  UNION ALL SELECT event_id::VARCHAR, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'completed' END,
                   ts::TIMESTAMP + INTERVAL 60 SECOND FROM events
  UNION ALL SELECT event_id::VARCHAR, 'queued', ts::TIMESTAMP + INTERVAL 120 SECOND FROM events WHERE event_id % 19 = 0
  UNION ALL SELECT event_id::VARCHAR, 'queued', ts::TIMESTAMP + INTERVAL 9000 SECOND FROM events WHERE event_id % 23 = 0),
seen AS (
  SELECT *, lag(status) OVER w AS before, lag(moment) OVER w AS since FROM jobs WINDOW w AS (PARTITION BY task_id ORDER BY moment)),
judged AS (
  SELECT *, before IS NULL OR (before IN ('completed', 'failed') AND moment > since + INTERVAL 1 HOUR) AS fresh FROM seen)"""
_MOVES = """
SELECT task_id, CASE WHEN NOT fresh THEN before END AS from_status, status AS to_status, moment AS at,
       CASE WHEN NOT fresh THEN epoch_ms(moment) - epoch_ms(since) END AS held_ms,
       CASE WHEN fresh THEN status = 'queued' WHEN before = 'queued' THEN status = 'running'
            WHEN before = 'running' THEN status IN ('completed', 'failed') ELSE false END AS legal
FROM judged"""
q("job_moves", _MOVES, _JOBS)
q("stream_job_moves", _MOVES, _JOBS)
q("audit_entries_json", """
SELECT e.ts::TIMESTAMP AS "timestamp", d.command, d.action AS decision, d.risk_level, d.rule_id
FROM decided d JOIN events e USING (event_id)""", O.LOG, O.JUDGED)

# SQL names --------------------------------------------------------------------------

q("sql_paths", f"SELECT path AS file, {O.LANG} AS language, {O.ROLE} AS role FROM docs", S.DOCS)
STORED_ORACLE["sql_commands"] = O.ORACLE["command_decisions"]
q("sql_leaks", f"""
SELECT file, line, shape, count(*) AS n FROM (
  SELECT path AS file, line, {O.shape('word')} AS shape FROM (
    SELECT path, line, trim(unnest(regexp_split_to_array(content, '[ \\t,;()]+')), '"''`') AS word
    FROM raw_lines))
WHERE shape IS NOT NULL GROUP BY ALL""", S.RAW)

# Files, labels and settings -----------------------------------------------------------

q("patch_files", """
SELECT task_id, count(*) FILTER (line_type = 'added') AS added, count(*) FILTER (line_type = 'deleted') AS deleted
FROM patch GROUP BY task_id""", S.RAW, O.PATCH)
_CASES = f"""got AS (SELECT file, line FROM ({O.ORACLE['hardcoded_secrets']})),
want AS (SELECT path AS file, line FROM raw_lines WHERE contains(content, 'hunter-Winter')),
places AS (
  SELECT coalesce(w.file, g.file) AS file, count(*) FILTER (w.line IS NOT NULL AND g.line IS NOT NULL) AS tp,
         count(*) FILTER (g.line IS NULL) AS fn, count(*) FILTER (w.line IS NULL) AS fp
  FROM want w FULL JOIN got g ON w.file = g.file AND w.line = g.line GROUP BY 1),
cases AS (
  SELECT path AS file, regexp_extract(task_id, '(\\d+)', 1)::INT % 2 = 1 AS negative FROM docs WHERE len(parts) > 0),
negatives AS (
  SELECT count(*) AS n, count(*) FILTER (tp + fp > 0) AS flagged FROM cases LEFT JOIN places USING (file) WHERE negative),
totals AS (SELECT sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp FROM places)"""
q("labelled_cases", """
SELECT gate, "limit", value, CASE WHEN gate IN ('recall', 'precision') THEN value >= "limit" ELSE value <= "limit" END AS passed
FROM (
  SELECT 'recall' AS gate, 0.85::DOUBLE AS "limit",
         (CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END)::DOUBLE AS value FROM totals
  UNION ALL SELECT 'precision', 0.9, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END FROM totals
  UNION ALL SELECT 'negative_rate', 0.1, CASE WHEN n > 0 THEN flagged / n ELSE 0 END FROM negatives
  UNION ALL SELECT 'leaks', 0, 0)""", S.RAW, _CASES)
q("relative_paths", """
SELECT doc_id, CASE WHEN starts_with(path, 'pkg/') THEN path[5:] ELSE path END AS path FROM docs""", S.DOCS)


def _picked(labels: dict[str, str]) -> str:
    shown = [*labels.values(), "other"]
    return f"{S.lst(shown)}[(doc_id % {len(shown)}) + 1]"


q("labels_shown", f"""
SELECT doc_id, {_picked(P.INPUT_TYPE_LABELS)} AS input_type,
       CASE WHEN doc_id % 2 = 0 THEN 'web submission' ELSE path END AS input_path,
       {_picked(P.SKIP_LABELS)} AS reason, {_picked(P.SEVERITY_LABELS)} AS severity,
       CASE WHEN doc_id % 3 = 0 THEN '(root)' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS folder
FROM docs""", S.DOCS)
q("configured_commands", """
SELECT event_id, command, CASE rule_id WHEN 'DEFAULT' THEN 'deny' ELSE action END AS action, rule_id FROM (
  SELECT event_id, command,
         CASE WHEN rule_id IN ('NET_ALLOWED', 'NET_DENIED')
              THEN CASE WHEN contains(command, '//files.local') THEN 'NET_ALLOWED' ELSE 'NET_DENIED' END
              ELSE rule_id END AS rule_id,
         CASE WHEN rule_id IN ('NET_ALLOWED', 'NET_DENIED')
              THEN CASE WHEN contains(command, '//files.local') THEN 'allow' ELSE 'deny' END
              ELSE action END AS action FROM decided)""", O.LOG, O.JUDGED)
q("key_hints", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '••••'
       ELSE c_name[:4] || '••••' || c_name[-4:] END AS hint FROM customer""")

# Findings shown ------------------------------------------------------------------------

q("finding_lines", """
SELECT task_id, bucket, '[' || severity || '][' || category || '] ' || file || ':' || line || ' - ' || evidence AS text
FROM best WHERE bucket = 'warning' OR severity = 'high'""", O.BEST)
_WEIGHTS = ", ".join(f"({S.lit(c)}, {S.lit(n)}, {w}::DOUBLE)" for c, (n, w) in DIMENSIONS.items())
q("dimension_findings", f"""
SELECT d.category, d.name, d.weight, count(b.file) AS findings
FROM (VALUES {_WEIGHTS}) d(category, name, weight) LEFT JOIN best b USING (category) GROUP BY ALL""", O.BEST)
_FIRST = min(DIMENSIONS, key=lambda c: DIMENSIONS[c][0])
q("score_reports", f"""
SELECT task_id, {1 + len(DIMENSIONS)}::BIGINT AS lines,
       'Risk ' || printf('%.2f', score) || ' (' || {O.GRADE} || ')' AS headline,
       '  {DIMENSIONS[_FIRST][0]} [' || repeat('█', filled) || repeat('░', 10 - filled) || ']' AS first_bar
FROM (SELECT task_id, round({O.TOTAL}, 2) AS score, floor({O.mean_of(_FIRST)} / 10)::INT AS filled
      FROM best GROUP BY task_id)""", O.BEST)
q("task_details", """
SELECT 'task' AS section, '{"status":"running"}' AS body, count(*) AS n FROM events WHERE event_id = 7 GROUP BY ALL
UNION ALL SELECT 'report', '{"json_report":"{}"}', count(*) FROM events WHERE event_id = 7 GROUP BY ALL
UNION ALL SELECT 'run', '{"command":"' || event_type || '"}', count(*) FROM events WHERE event_id % 10 = 7 GROUP BY ALL
UNION ALL SELECT 'decision', '{"output_bytes":' || (event_id % 11 * 600000) || '}', count(*)
FROM events WHERE event_id % 20 = 7 GROUP BY ALL""")
q("review_counters", """
SELECT bucket, count(*) AS rows, (SELECT count(*) FROM best) AS findings,
       (SELECT count(*) FROM best WHERE severity = 'high') AS high
FROM best GROUP BY bucket""", O.BEST)

# Logs ------------------------------------------------------------------------------------

q("stored_logs", """
SELECT user_id::VARCHAR AS task_id, 'run' AS kind, event_type AS what,
       CASE WHEN event_id % 2 = 0 THEN '0' END AS how, count(*) AS n
FROM events GROUP BY ALL
UNION ALL SELECT task_id, 'decision', command, action, count(*) FROM decided GROUP BY ALL""", O.LOG, O.JUDGED)
