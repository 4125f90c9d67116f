"""The event pass of the review: one read of the lines, failing rules kept apart."""

from __future__ import annotations

import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from patchlens.operators import events as E
from patchlens.operators import line_rules as LR
from patchlens.operators import pair_rules as PR
from patchlens.operators.checks import Check
from patchlens.operators.line_rules import LineRule, hit
from patchlens.plans import review as RV
from patchlens.plans.workspace import written

FILES = {
    "a.go": "package a\nfunc Load(p string) error {\n\tf, err := os.Open(p)\n\tif err != nil {\n"
            "\t\treturn nil\n\t}\n\tgo worker(q)\n\tmu.Lock()\n\ttx, err := db.Begin()\n}\n"
            "func Run(ctx context.Context) {\n\tc := context.Background()\n\tn := 7\n"
            "\tctx, stop := context.WithCancel(ctx)\n\tv, _ := fetch(k) // nolint\n",
    "b_test.go": "func TestRun(t *testing.T) {\n\tRun(nil)\n\tn := 12x\n}",
    "c.env": "token=winter-Storm-88\nn := 9",
}
NUMBER = Check("NUM-001", "low", "quality", 0.9, "Number", "", "token:number", "a number")


def number_rule(rule_id: str = "NUM-001") -> LineRule:
    """Raises on a line whose number isn't one."""
    text = F.element_at(F.split(F.col("content"), " "), -1)
    return LineRule(rule_id, lambda x: x.content.contains("n := "),
                    lambda x: F.when(text.cast("int") > 8, hit("number", x.content)))


def keys(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("file", "line", "rule_id").collect())


def test_events_equal_the_single_rules(file_lines, found):
    lines = file_lines(FILES)
    hits, errors = RV.reviewed_hits(lines)
    parts = [LR.line_hits(lines), PR.pair_hits(lines), PR.goroutine_hits(lines),
             PR.swallowed_error_hits(lines), PR.context_root_hits(lines),
             PR.missing_test_hits(lines), PR.large_delete_hits(lines)]
    want = sorted(h for p in parts for h in found(p) if h[2] != 15 or h[1] != "a.go")
    assert found(hits) == want and len(want) >= 8 and errors.count() == 0


def test_a_failing_rule_leaves_the_others(file_lines):
    lines = file_lines(FILES)
    plain = keys(RV.review(lines))
    found, errors = RV.reviewed(lines, line_rules=[number_rule()], checks={"number": NUMBER})
    assert keys(found) == sorted([*plain, ("c.env", 2, "NUM-001")])
    rows = errors.collect()
    assert [(r["rule_id"], r["file"], r["line"], r["condition"]) for r in rows] == [
        ("NUM-001", "b_test.go", 3, "CAST_INVALID_INPUT")]
    assert "12x" in rows[0]["message"]


def test_a_rule_that_fails_everywhere_is_left_out(file_lines, monkeypatch):
    lines = file_lines({f"f{i}.go": "n := x\ntoken" for i in range(6)} | {"c.env": FILES["c.env"]})
    broken = LineRule("BAD", lambda x: F.raise_error(F.lit("gate")).cast("boolean"),
                      lambda x: hit("number", x.content))
    emitters = [E.of_line_rule(r) for r in [*LR.LINE_RULES, number_rule(), broken]]
    events, errors = E.isolated(lines, emitters, lambda df: written(df, "e"), most=2)
    assert [r["check"] for r in events.collect()] == ["config_secret"]
    assert sorted((r["rule_id"], r["file"]) for r in errors.collect()) == [
        ("BAD", None), ("NUM-001", None)]


def test_other_failures_are_raised(file_lines):
    with pytest.raises(PySparkException):
        E.isolated(file_lines(FILES), [], lambda df: df.select("no_such_column"))


def test_lines_are_read_three_times(spark, file_lines, tmp_path):
    """The written events, names and sizes of deletions; planning stays short."""
    lines = written(file_lines(FILES), "lines")
    path = lines.inputFiles()[0].rsplit("/", 1)[0]
    reads = []
    original = E.emitted

    def counted(*args, **kwargs):
        df = original(*args, **kwargs)
        reads.append(df)
        return df

    for module in (E, PR):
        if hasattr(module, "emitted"):
            module.emitted = counted
    try:
        start = time.perf_counter()
        found = RV.review(lines)
        found.write.format("noop").mode("overwrite").save()
        spent = time.perf_counter() - start
    finally:
        E.emitted = original
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # two passes are behind written tables, one is in the plan
    assert len(reads) == 2 and found._jdf.inputFiles() is not None
    own = [f for f in found.inputFiles() if f.startswith(path)]
    assert len(own) >= 1 and plan.count("new_path") > 0 and spent < 120
    start = time.perf_counter()
    found._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - start < 2
