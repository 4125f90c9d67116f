from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from patchlens.operators import outline as O
from patchlens.operators import user_rules as U
from patchlens.operators.findings import findings_of
from patchlens.operators.line_rules import line_hits
from patchlens.plans.review import raw_findings, review
from patchlens.sources import cases as CS
from patchlens.sources import snapshots as SN
from patchlens.sources import tables as TB
from patchlens.sources import tool_logs as TL


def test_snapshot(spark, tmp_path):
    root = tmp_path / "repo"
    for name, data in {
        "a.go": b"x", "vendor/b.go": b"x", "d/vendored.go": b"x", "c.bin": b"a\x00b", "big.txt": b"x" * (1 << 21)
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    scan = SN.scan_snapshot(spark, str(root))
    reasons = {r.path: r.reason for r in scan.collect()}
    assert reasons == {
        "a.go": None, "vendor/b.go": "skipdir", "d/vendored.go": None, "c.bin": "binary", "big.txt": "oversized"
    }
    assert {r.reason: r.files for r in SN.skip_reasons(scan).collect()} == {"skipdir": 1, "binary": 1, "oversized": 1}
    assert SN.snapshot_files(spark, str(root), "t", max_files=2).count() == 2
    with pytest.raises(ValueError):
        SN.snapshot_files(spark, str(root), "t", max_files=1)
    files = SN.read_files(spark, str(root / "d"), "t", str(root))
    assert [tuple(r) for r in files.collect()] == [("t", "d/vendored.go", "x")]


def test_snapshot_reads_no_large_contents_and_plain_paths(spark, tmp_path):
    for name in ("a b.go", "c#1.go", "p+q%41.go"):
        (tmp_path / name).write_text("x")
    files = SN.snapshot_files(spark, str(tmp_path), "t")
    assert "LessThanOrEqual(length," in files._jdf.queryExecution().executedPlan().toString()
    names = {"a b.go", "c#1.go", "p+q%41.go"}
    assert {r.path for r in files.collect()} == names
    assert {r.path for r in SN.read_files(spark, str(tmp_path), "t", str(tmp_path)).collect()} == names
    assert {r.path for r in SN.scan_snapshot(spark, str(tmp_path)).collect()} == names


def test_patch_files_and_cases(spark, tmp_path):
    case = {"id": "c1", "expected_findings": [{"rule_id": "RES-AST-001", "file": "a.go", "line": 1}],
            "expected_warnings": [], "sensitive_literals": []}
    (tmp_path / "positive").mkdir()
    (tmp_path / "positive" / "one.json").write_text(json.dumps(case, indent=1))
    (tmp_path / "positive" / "one.diff").write_text("--- a/a.go\n+++ b/a.go\n@@ -0,0 +1 @@\n+f := os.Open(p)\n")
    cases = CS.read_cases(spark, str(tmp_path))
    assert cases.first().case_id == "c1" and "os.Open" in cases.first().diff_text
    assert [tuple(r) for r in CS.expected(cases).collect()] == [("c1", "RES-AST-001", "a.go", 1)]
    assert SN.read_patches(spark, str(tmp_path / "positive" / "*.diff")).count() == 1


def test_linter_log(spark):
    text = ["a/b.go:10:5: value never used (SA4006)", "noise", "x.go:a:1: bad (SA1)", "c.go:2:1: m (ST1000)", "d.go:3:1: m (ST1000)"]
    log = spark.createDataFrame([("t", x) for x in text], "task_id string, text string")
    found = TL.linter_findings(log)
    assert sorted((r.file, r.line, r.rule_id) for r in found.collect()) == [
        ("a/b.go", 10, "STATICCHECK-SA4006"), ("c.go", 2, "STATICCHECK-ST1000"), ("d.go", 3, "STATICCHECK-ST1000")
    ]
    assert TL.linter_summary_text(TL.linter_summary(found)).first().summary == "3 findings (SA4006×1, ST1000×2)"


def test_vulnerability_log(spark):
    text = ['{"osv": {"id": "V1", "summary": " s ", "aliases": ["A", "B"]}}', '{"osv": {"id": "V2", "details": "' + "d" * 200 + '"}}',
            '{"finding": {}}', "broken {"]
    log = spark.createDataFrame([("t", x) for x in text], "task_id string, text string")
    got = sorted((r.evidence, r.title) for r in TL.vulnerability_findings(log).collect())
    assert got == [("V1 (A, B)", "Vulnerable dependency: s"), ("V2", "Vulnerable dependency: " + "d" * 120)]
    assert TL.bad_vulnerability_lines(log).first().bad_lines == 1


def test_tables(spark, tmp_path, file_lines):
    base = str(tmp_path / "store")
    at = F.lit("2024-01-05 10:00:00").cast("timestamp")
    found = review(file_lines({"a.go": "f := os.Open(p)\nt := time.Tick(d)"}), found_at=at)
    tasks = spark.createDataFrame([("t", "completed")], "task_id string, status string").withColumn("started_at", at)
    reports = spark.createDataFrame([("t", "{}", 1), ("t", '{"v": 2}', 2)], "task_id string, json_report string, d int")
    reports = reports.withColumn("saved_at", at + F.make_dt_interval(days=F.col("d"))).drop("d")
    TB.save_result(base, tasks, found, reports)
    rows = TB.task_rows(spark, base, "findings", "t").collect()
    assert [(r.severity, r.rule_id) for r in rows] == [("medium", "RES-AST-001"), ("low", "RES-AST-002")]
    assert TB.latest_reports(TB.read(spark, base, "reports")).first().json_report == '{"v": 2}'
    assert TB.read(spark, base, "tasks").first().risk_score is None
    old = TB.conform(tasks, "tasks", {"risk_grade": "A"}).first()
    assert old.risk_grade == "A"
    lines = file_lines({"a.go": "x", "b.md": "y"})
    TB.write_lines(lines, str(tmp_path / "lines"))
    stored = spark.read.parquet(str(tmp_path / "lines"))
    assert {r.language for r in stored.collect()} == {"go", "markdown"}


def test_outline(file_lines):
    text = 'package x\nimport "fmt"\nimport (\n\tj "encoding/json"\n\t_ "embed"\n)\nvar A = 1\nfunc (s *Store) Load(p string) {\n\tx := "no/import"\nfunc helper() {'
    lines = file_lines({"a.go": text})
    got = sorted((r.line, r.path, r.alias) for r in O.imports(lines).collect())
    assert got == [(2, "fmt", None), (4, "encoding/json", "j"), (5, "embed", "_")]
    got = sorted((r.line, r.name, r.receiver, r.is_exported) for r in O.functions(lines).collect())
    assert got == [(8, "Load", "*Store", True), (10, "helper", None, False)]
    assert [r.name for r in O.globals_of(lines).collect()] == ["A"]


RULES = """
rules:
  - id: A
    name: a
    match: {token_facts: [{kind: identifier, value_contains: [PORT]}, {kind: string_literal, value_pattern: '^"[0-9]+"$'}]}
  - id: B
    name: b
    severity: low
    message: m
    match: {line_contains: [todo], file_extension: [.go]}
    exclude: {line_starts_with: ["//"], file_contains: [Legacy]}
"""


def test_user_rules(file_lines, found, tmp_path):
    (tmp_path / "r.yaml").write_text(RULES)
    rules = U.load_rules(str(tmp_path))
    assert [(r.severity, r.category, r.confidence) for r in rules] == [("medium", "security", 0.8), ("low", "security", 0.8)]
    lines = file_lines({
        "a.go": 'port := "8080"\nport := "x1"\nname := "8080"\nx // TODO\n// todo', "b.go": "TODO\nlegacy", "c.py": "TODO"
    })
    hits = U.user_hits(lines, rules)
    assert found(hits) == [("A", "a.go", 1), ("B", "a.go", 4)]
    one = findings_of(hits, checks=U.user_checks(rules)).filter("rule_id = 'B'").first()
    assert (one.source, one.title, one.evidence_chain, one.severity) == ("dsl:B", "m", None, "low")
    assert raw_findings(lines, user_rules=rules).filter("source like 'dsl%'").count() == 2


@pytest.mark.parametrize("text", ["rules: [{name: x}]", "rules: [{id: x}]",
                                  "rules: [{id: x, name: y, match: {token_facts: [{kind: a, value_pattern: '('}]}}]"])
def test_bad_user_rules(text):
    with pytest.raises(ValueError):
        U.parse_rules(text)


def test_rule_subset_reads_lines_once(file_lines):
    plan = line_hits(file_lines({"a.go": "x"}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and "Exchange" not in plan


def test_tasks_list_case_and_patch_files(spark, tmp_path):
    """The driver lists no file; rows are those of Spark's own readers."""
    from patchlens.sources import cases as CS
    from patchlens.sources import snapshots as SN

    (tmp_path / "a" / "vendor").mkdir(parents=True)
    (tmp_path / "_hidden").mkdir()
    for name, key in (("a/x 1+", "1"), ("a/vendor/y", "2"), ("_hidden/z", "3")):
        (tmp_path / f"{name}.json").write_text('{"id": "c%s", "expected_findings": [{"line": 2}]}' % key)
        (tmp_path / f"{name}.diff").write_text(f"+\x00é{key}\n" + "x" * (1 << 20))
    (tmp_path / "a" / "bad.json").write_text("{")
    (tmp_path / "a" / "bad.diff").write_text("+bad\n")
    root = str(tmp_path)
    labels, patches = CS._cases(spark, root)
    want = labels.join(patches, "stem").drop("stem").withColumnRenamed("id", "case_id").collect()
    got = CS.read_cases(spark, root)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 3
    read = SN.read_patches(spark, f"{root}/a/*.diff")
    assert sorted((r.task_id, r.diff_text[:2]) for r in read.collect()) == [
        (f"{root}/a/bad.diff", "+b"), (f"{root}/a/x 1+.diff", "+\x00")]
    for df in (got, read):
        assert not df.inputFiles() and "FileScan" not in df._jdf.queryExecution().executedPlan().toString()
