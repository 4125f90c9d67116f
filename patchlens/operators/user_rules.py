"""Rules written in YAML: rows of an index (``rule_index``), or single line rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_of, contains_any, ends_any, starts_any, trimmed
from .checks import Check
from .line_rules import Line, LineRule, hit
from .rule_index import indexed_hits

# What a rule gets when it does not say.
DEFAULT_SEVERITY, DEFAULT_CATEGORY, DEFAULT_CONFIDENCE = "medium", "security", 0.80


@dataclass
class UserRule:
    id: str
    name: str
    severity: str = DEFAULT_SEVERITY
    category: str = DEFAULT_CATEGORY
    message: str = ""
    recommendation: str = ""
    confidence: float = DEFAULT_CONFIDENCE
    token_facts: list[dict] = field(default_factory=list)
    line_contains: list[str] = field(default_factory=list)
    line_not_contains: list[str] = field(default_factory=list)
    file_extension: list[str] = field(default_factory=list)
    exclude_line_contains: list[str] = field(default_factory=list)
    exclude_line_starts_with: list[str] = field(default_factory=list)
    exclude_file_contains: list[str] = field(default_factory=list)

    def check(self) -> Check:
        return Check(
            self.id, self.severity, self.category, self.confidence, self.message,
            self.recommendation, f"dsl:{self.id}", "",
        )


def parse_rules(text: str | bytes) -> list[UserRule]:
    """Rules of one YAML document; a rule without id or name, or with a bad pattern, is an error."""
    rules = []
    for raw in (yaml.safe_load(text) or {}).get("rules") or []:
        if not raw.get("id"):
            raise ValueError("rule without id")
        if not raw.get("name"):
            raise ValueError(f"rule {raw['id']} without name")
        match, exclude = raw.get("match") or {}, raw.get("exclude") or {}
        facts = match.get("token_facts") or []
        for fact in facts:
            try:
                re.compile(fact.get("value_pattern") or "")
            except re.error as error:
                raise ValueError(f"rule {raw['id']}: bad value_pattern: {error}") from error
        rules.append(
            UserRule(
                id=raw["id"],
                name=raw["name"],
                severity=raw.get("severity") or DEFAULT_SEVERITY,
                category=raw.get("category") or DEFAULT_CATEGORY,
                message=raw.get("message") or "",
                recommendation=raw.get("recommendation") or "",
                confidence=float(raw.get("confidence") or DEFAULT_CONFIDENCE),
                token_facts=facts,
                line_contains=match.get("line_contains") or [],
                line_not_contains=match.get("line_not_contains") or [],
                file_extension=match.get("file_extension") or [],
                exclude_line_contains=exclude.get("line_contains") or [],
                exclude_line_starts_with=exclude.get("line_starts_with") or [],
                exclude_file_contains=exclude.get("file_contains") or [],
            )
        )
    return rules


def load_rules(path: str) -> list[UserRule]:
    """Rules of a YAML file, or of all YAML files under a directory."""
    root = Path(path)
    if root.is_file():
        return parse_rules(root.read_bytes())
    files = sorted(p for p in root.rglob("*") if p.suffix in (".yaml", ".yml"))
    return [rule for p in files for rule in parse_rules(p.read_bytes())]


def _lowered(words: list[str]) -> list[str]:
    return [w.lower() for w in words]


def _fact_matches(facts: Column, want: dict) -> Column:
    def matches(f):
        value = f["value"]
        conditions = [f["kind"] == want.get("kind", "")]
        if want.get("value_exact"):
            conditions.append(value == want["value_exact"])
        if want.get("value_contains"):
            conditions.append(contains_any(F.lower(value), _lowered(want["value_contains"])))
        if want.get("value_pattern"):
            conditions.append(value.rlike(want["value_pattern"]))
        if want.get("value_not_prefix"):
            conditions.append(~value.startswith(want["value_not_prefix"]))
        return all_of(conditions)

    return F.exists(facts, matches)


def compile_rule(rule: UserRule) -> LineRule:
    """Path and text conditions form the gate, token conditions the hit."""

    def gate(x: Line) -> Column:
        low = F.lower(x.content)
        conditions = []
        if rule.file_extension:
            conditions.append(ends_any(x.path, rule.file_extension))
        if rule.line_contains:
            conditions.append(contains_any(low, _lowered(rule.line_contains)))
        unwanted = _lowered(rule.line_not_contains + rule.exclude_line_contains)
        if unwanted:
            conditions.append(~contains_any(low, unwanted))
        if rule.exclude_line_starts_with:
            conditions.append(~starts_any(trimmed(x.content), rule.exclude_line_starts_with))
        return all_of(conditions)

    def found(x: Line) -> Column:
        return F.when(
            all_of(_fact_matches(x.facts, want) for want in rule.token_facts),
            hit(rule.id, x.content),
        )

    return LineRule(
        rule.id, gate, found, uses_facts=bool(rule.token_facts), severity=rule.severity,
        category=rule.category,
    )


def user_hits(lines: DataFrame, rules: list[UserRule]) -> DataFrame:
    """Hits of all rules; the plan doesn't grow with their number."""
    return indexed_hits(lines, rules)


def user_checks(rules: list[UserRule]) -> dict[str, Check]:
    return {r.id: r.check() for r in rules}
