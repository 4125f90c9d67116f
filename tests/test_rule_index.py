"""Rules as data against rules compiled one by one."""

from __future__ import annotations

import random
import time

import pytest

from patchlens.operators import user_rules as U
from patchlens.operators.line_rules import line_hits
from patchlens.operators.rule_index import indexed_hits, piece_of, rule_rows

WORDS = ["todo", "Fix", "a", "é", "port", "http://", "x=", "  ", "Legacy", '"80"', "日本", "ab", "(", "%_"]


def some_rule(rng: random.Random, n: int) -> U.UserRule:
    pick = lambda p, k=2: rng.sample(WORDS, rng.randint(1, k)) if rng.random() < p else []
    facts = []
    if rng.random() < 0.4:
        facts = [{"kind": rng.choice(["identifier", "string_literal"]),
                  **rng.choice([{"value_exact": "port"}, {"value_contains": ["POR", "8"]},
                                {"value_pattern": '^"?[0-9a-p]+'}, {"value_not_prefix": "x"}])}
                 for _ in range(rng.randint(1, 2))]
    return U.UserRule(
        f"R{n}", f"r{n}", token_facts=facts, line_contains=pick(0.6, 3),
        line_not_contains=pick(0.2), file_extension=rng.choice([[], [".go"], [".go", "_test.go"], ["py"]]),
        exclude_line_contains=pick(0.1), exclude_line_starts_with=pick(0.2),
        exclude_file_contains=pick(0.1, 1))


def compiled(lines, rules: list[U.UserRule], texts: dict[str, str]) -> list[tuple]:
    """The same by one line rule each, and forbidden texts looked up in the whole files."""
    found = []
    for rule in rules:
        for r in line_hits(lines, rules=[U.compile_rule(rule)]).collect():
            low = [x.lower() for x in texts[r["new_path"]].split("\n")]
            if not any(w.lower() in x for w in rule.exclude_file_contains for x in low):
                found.append((r["check"], r["new_path"], r["line"], r["evidence"]))
    return sorted(found)


@pytest.mark.parametrize("seed", range(3))
def test_index_equals_compiled_rules(file_lines, seed):
    rng = random.Random(seed)
    texts = {}
    for name in ("a.go", "b_test.go", "c.py", "d.md"):
        lines = [" ".join(rng.choices([*WORDS, "port", "TODO", "plain", '"8080"'], k=rng.randint(0, 6)))
                 for _ in range(12)]
        texts[name] = "\n".join(lines)
    lines = file_lines(texts)
    rules = [some_rule(rng, n) for n in range(14)]
    got = sorted((r["check"], r["new_path"], r["line"], r["evidence"])
                 for r in indexed_hits(lines, rules).collect())
    assert got == compiled(lines, rules, texts) != []


def test_pieces_and_rows():
    assert piece_of("password") == "sswo" or len(piece_of("password")) == 4
    assert piece_of("ab") == "ab" and piece_of(" http://") in " http://"
    rules = [U.UserRule("A", "a", line_contains=["x", "todo"]), U.UserRule("B", "b"),
             U.UserRule("C", "c", file_extension=[".go", ".py"]),
             U.UserRule("D", "d", line_contains=[""]), U.UserRule("E", "e", line_not_contains=[""])]
    by_text, by_path = rule_rows(rules)
    assert [(r[0], r[1], r[3]) for r in by_text] == [("x", 0, "A"), ("todo", 1, "A")]
    assert [(r[0], r[3]) for r in by_path] == [("*", "B"), (".go", "C"), (".py", "C"), ("*", "D")]


def test_no_rules_and_long_lines(file_lines):
    long = "x" * 200_000 + " needle"
    lines = file_lines({"a.txt": long})
    assert indexed_hits(lines, []).count() == 0
    rules = [U.UserRule("A", "a", line_contains=["needle"]), U.UserRule("B", "b", line_contains=["pin"])]
    assert [r["check"] for r in indexed_hits(lines, rules).collect()] == ["A"]


def test_planning_does_not_grow_with_the_rules(file_lines):
    lines = file_lines({"a.go": "todo number 7 here\nnothing"})

    def planned(n: int) -> tuple[float, int]:
        rules = [U.UserRule(f"R{i}", "r", line_contains=[f"number {i} "]) for i in range(n)]
        start = time.perf_counter()
        hits = indexed_hits(lines, rules)
        plan = hits._jdf.queryExecution().optimizedPlan().toString()
        return time.perf_counter() - start, len(plan)

    planned(10)
    (short, few), (long, many) = planned(10), planned(1000)
    assert abs(few - many) < 200 and long < short + 2
    rules = [U.UserRule(f"R{i}", "r", line_contains=[f"number {i} "]) for i in range(1000)]
    assert [r["check"] for r in indexed_hits(lines, rules).collect()] == ["R7"]
