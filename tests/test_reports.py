from __future__ import annotations

from pyspark.sql import functions as F

from patchlens.operators import artifacts as A
from patchlens.operators import commands as C
from patchlens.operators import quality as Q
from patchlens.operators import reports as R
from patchlens.operators import scoring as S

FOUND = "task_id string, category string, severity string, bucket string, file string, copies bigint, rule_id string"


def found(spark, rows):
    return spark.createDataFrame(rows, FOUND)


def test_risk_score(spark):
    rows = [
        ("t", "security", "high", "finding", "d/a", 2, "R"), ("t", "security", "low", "finding", "d/b", 1, "R"),
        ("t", "testing", "high", "warning", "d/a", 1, "S"), ("t", "quality", "high", "finding", "e", 1, "S"),
    ]
    tasks = spark.createDataFrame([("t",), ("none",)], "task_id string")
    got = {r.task_id: r for r in S.risk_score(found(spark, rows), tasks).collect()}
    assert (got["t"].score, got["t"].grade, got["t"].finding_count) == (19.5, "A", 3)
    assert got["t"].breakdown["security"]["count"] == 2
    assert (got["none"].score, got["none"].grade, got["none"].warning) == (0.0, "A", None)
    text = S.risk_score(found(spark, rows)).select(S.score_text().alias("s")).first().s
    assert "Risk 19.50 (A)" in text and "security [██████░░░░] 65.0" in text
    grades = spark.range(1).select(*[S.grade(F.lit(float(x))) for x in (80, 60, 40, 20, 19)]).first()
    assert "".join(grades) == "FDCBA"


def test_directories_and_files(spark):
    rows = [("t", "c", "high", "finding", "d/a", 1, "R"), ("t", "c", "low", "warning", "d/a", 1, "R"),
            ("t", "c", "info", "finding", "x", 1, "R")]
    files = spark.createDataFrame([("t", "d/a"), ("t", "d/b"), ("t", "e/c")], "task_id string, path string")
    got = {r.dir: (r.files, r.findings, r.warnings, r.density, r.bar)
           for r in R.directory_density(found(spark, rows), files).collect()}
    assert got == {"d": (2, 1, 1, 1.0, 100.0), ".": (1, 1, 0, 1.0, 50.0), "e": (1, 0, 0, 0.0, 0.0)}
    top = R.risky_files(found(spark, rows)).orderBy(F.col("weight").desc()).collect()
    assert [(r.file, r.weight) for r in top] == [("d/a", 6), ("x", 1)]


def test_tasks(spark):
    rows = [("a", "queued", "2024-01-01 00:00:00", None), ("a", "running", "2024-01-01 00:00:01", None),
            ("a", "failed", "2024-01-01 00:00:03.5", "boom"), ("b", "running", "2024-01-01 00:00:00", None)]
    events = spark.createDataFrame(rows, "task_id string, status string, s string, error_msg string")
    events = events.withColumn("at", F.col("s").cast("timestamp"))
    got = {r.task_id: (r.status, r.duration_ms, r.error_msg) for r in R.task_states(events).collect()}
    assert got == {"a": ("failed", 3500, "boom"), "b": ("running", None, None)}


def test_listing_and_counters(spark):
    rows = [("t", "c", "high", "finding", "a", 1, "R"), ("t", "c", "low", "warning", "b", 1, "R")]
    df = found(spark, rows)
    assert R.listed(df, "high").count() == 1 and R.listed(df, "low").count() == 0
    assert R.listed(df, warnings=True).count() == 1
    seen_df, seen = R.observed(df, "run")
    seen_df.collect()
    assert seen.get["findings"] == 2 and seen.get["high"] == 1


def test_task_detail(spark):
    tasks = spark.createDataFrame([("t", "done"), ("u", "x")], "task_id string, status string")
    other = spark.createDataFrame([("t", 1), ("t", 2), ("u", 3)], "task_id string, n int")
    got = R.task_detail(tasks, other.filter("n = 1"), other, other, "t").groupBy("section").count()
    assert {r[0]: r[1] for r in got.collect()} == {"task": 1, "report": 1, "run": 2, "decision": 2}


def test_commands(spark, tmp_path):
    want = {
        "": "EMPTY_CMD", "rm -rf /x": "DENIED_CMD", "pseudo x; sudo y": "DENIED_CMD", "pseudo x": "DEFAULT",
        "cat /etc/hosts": "DENIED_PATH", "cat x/etc/y": "WHITELIST", "cat a=/root/y": "DENIED_PATH",
        "echo $(x)": "SHELL_INJECTION", "a && chmod 1 x": "SHELL_INJECTION", "a && b": "DEFAULT",
        "x http://GitHub.com:80/a": "NET_ALLOWED", "x https://evil.io": "NET_DENIED", "go test ./...": "WHITELIST",
        "go testing": "DEFAULT", "LS -l": "WHITELIST", "curling x": "DEFAULT", "run curl x": "DENIED_CMD",
    }
    df = spark.createDataFrame([("t", c) for c in want], "task_id string, arguments string")
    got = {r.command: r.rule_id for r in C.decide_commands(df).collect()}
    got = {c: got.get(c, "DEFAULT") for c in want}
    assert got == want
    wrapped = spark.createDataFrame(
        [("t", '{"command": ""}'), ("t", '{"command": "ls"}'), ("t", '{"other": 1}')],
        "task_id string, arguments string",
    )
    assert sorted(r.command for r in C.decide_commands(wrapped).collect()) == ["", "ls", '{"other": 1}']
    C.write_audit(C.decide_commands(df), F.lit("2024-01-01T00:00:00Z"), str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == len(want)
    path = tmp_path / "c" / "config.json"
    C.save_config(C.SafetyConfig(default_policy="deny"), str(path))
    assert C.load_config(str(path)).default_policy == "deny"
    assert C.load_config(str(tmp_path / "none")).default_policy == "allow"
    path.write_text('{"allowed_env_vars": []}')
    env = spark.range(1).select(C.allowed_env(F.create_map(F.lit("x"), F.lit("y")), C.load_config(str(path))).alias("e"))
    assert env.first().e == {"x": "y"}


def test_artifacts(spark):
    rows = [("t", i, f"f{i}.log", "x") for i in range(25)] + [("t", 3, "bad.exe", "x"), ("u", 1, "big.md", "é" * 600_000)]
    df = spark.createDataFrame(rows, "task_id string, seq bigint, file_path string, content string")
    got = {(r.task_id, r.file_path): r.rejected for r in A.admit(df).collect()}
    assert len(got) == 27
    assert got[("t", "bad.exe")] == "extension" and got[("u", "big.md")] == "size"
    assert got[("t", "f18.log")] is None and got[("t", "f19.log")] == "count"


def test_quality(spark):
    place = "case_id string, rule_id string, file string, line int"
    want = spark.createDataFrame([("a", "R", "f", 1)] * 2 + [("a", "R", "f", 2)], place)
    made = spark.createDataFrame([("a", "R", "f", 1)] * 3 + [("neg_b", "R", "f", 9)], place)
    matched = Q.match_expected(want, made)
    total = Q.quality(matched).first()
    assert (total.tp, total.fn, total.fp, total.precision) == (2, 1, 2, 0.5)
    cases = spark.createDataFrame([("neg_b", ["zz"]), ("neg_c", []), ("a", ["s3"])], "case_id string, sensitive_literals array<string>")
    rate = Q.negative_rate(cases, made.filter("case_id = 'neg_b'"), matched.limit(0)).first()
    assert (rate.negatives, rate.flagged, rate.negative_rate) == (2, 1, 0.5)
    shown = made.withColumns({"evidence": F.lit("has s3"), "evidence_chain": F.array(F.lit("x"))})
    assert {r.case_id for r in Q.leaks(cases, shown).collect()} == {"a"}
