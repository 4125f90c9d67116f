"""The whole review: lines to deduplicated findings and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.checks import Check
from ..operators.events import Emitter, Events, event, is_added, isolated, of_line_rule
from ..operators.findings import (
    apply_marks,
    dampen_by_role,
    deduplicate,
    drop_marked,
    findings_of,
    has_nolint,
)
from ..operators.line_rules import HIT_COLUMNS, LINE_RULES, LineRule
from ..operators.pair_rules import (
    EMITTERS,
    NAME_KINDS,
    context_roots_of,
    goroutines_of,
    large_delete_hits,
    missing_tests_of,
    names_of,
    pairs_of,
    swallowed_errors_of,
    wanted_names,
)
from ..operators.scoring import risk_score
from ..operators.user_rules import UserRule, user_checks, user_hits
from .workspace import written

NOLINT = Emitter(
    "nolint", "nolint", lambda x: is_added() & x.content.contains("nolint"),
    lambda x: F.when(has_nolint(x.content), F.array(event("nolint"))))


#: The built-in line rules; the same objects each time, so their columns are built once.
OWN_RULES = [of_line_rule(r) for r in LINE_RULES]


def reviewed_hits(
    lines: DataFrame,
    user_rules: list[UserRule] | None = None,
    type_facts: DataFrame | None = None,
    line_rules: list[LineRule] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Hits of every rule, and the rules that failed with the lines they failed on.

    ``lines`` are read three times: once for the events of all rules, which are written as a
    narrow table; once for the names that sites in it ask for; once for the sizes of deletions.
    User rules add one pass. Only events are shuffled, never the lines.
    """
    more = [of_line_rule(r) for r in line_rules or []]
    chosen = [*OWN_RULES, *more, *EMITTERS, NOLINT]
    table, errors = isolated(
        lines, [e for e in chosen if e.kind not in NAME_KINDS],
        lambda df: written(df, "events"), type_facts)
    events = Events(lines, chosen, type_facts, table)
    wanted = written(wanted_names(events), "wanted-names")
    called = Events(lines, [e for e in EMITTERS if e.kind in NAME_KINDS])
    names = written(names_of(called, wanted), "names")
    parts = [
        events.of("hit").withColumn("detail", F.col("key")).select(*HIT_COLUMNS),
        pairs_of(events, names.filter(F.col("kind") == "call"), type_facts),
        goroutines_of(events),
        swallowed_errors_of(events),
        context_roots_of(events),
        missing_tests_of(events, names),
        large_delete_hits(lines),
    ]
    if user_rules:
        parts.append(user_hits(lines, user_rules))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return drop_marked(out, events.of("nolint")), errors


def all_hits(lines: DataFrame, user_rules: list[UserRule] | None = None,
             type_facts: DataFrame | None = None) -> DataFrame:
    return reviewed_hits(lines, user_rules, type_facts)[0]


def raw_findings(
    lines: DataFrame,
    user_rules: list[UserRule] | None = None,
    type_facts: DataFrame | None = None,
    found_at: Column | None = None,
) -> DataFrame:
    hits = all_hits(lines, user_rules, type_facts)
    return dampen_by_role(findings_of(hits, found_at, user_checks(user_rules or [])))


def review(
    lines: DataFrame,
    marks: DataFrame | None = None,
    user_rules: list[UserRule] | None = None,
    type_facts: DataFrame | None = None,
    found_at: Column | None = None,
) -> DataFrame:
    """Findings and warnings of all tasks: one row per file, line, category and rule.

    For a large corpus give a line table that was written once (``sources.tables.write_lines``)
    instead of the parsing plan itself. A rule that fails is logged and left out on that line.
    """
    return reviewed(lines, marks, user_rules, type_facts, found_at)[0]


def reviewed(
    lines: DataFrame,
    marks: DataFrame | None = None,
    user_rules: list[UserRule] | None = None,
    type_facts: DataFrame | None = None,
    found_at: Column | None = None,
    line_rules: list[LineRule] | None = None,
    checks: dict[str, Check] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The findings of ``review`` and the errors of rules (``events.ERRORS``).

    ``line_rules`` run beside the built-in ones and report by ``checks``.
    """
    hits, errors = reviewed_hits(lines, user_rules, type_facts, line_rules)
    known = user_checks(user_rules or []) | (checks or {})
    found = dampen_by_role(findings_of(hits, found_at, known))
    if marks is not None:
        found = apply_marks(found, marks)
    return deduplicate(found), errors


def review_scores(lines: DataFrame, **options) -> DataFrame:
    tasks = lines.select("task_id").distinct()
    return risk_score(review(lines, **options), tasks)
