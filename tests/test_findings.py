from __future__ import annotations

from pyspark.sql import functions as F

from patchlens.operators import findings as FD
from patchlens.operators import verdicts as V
from patchlens.operators.line_rules import line_hits
from patchlens.plans.review import review

SECRET = "pass" + "word"
COLUMNS = "task_id string, file string, line int, category string, rule_id string, severity string, title string, evidence string, confidence double, seq int"


def table(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def row(file="a", line=1, rule="R", severity="high", evidence="e", confidence=0.8, seq=0, task="t"):
    return (task, file, line, "security", rule, severity, "T", evidence, confidence, seq)


def test_deduplicate(spark):
    df = table(spark, [
        row(confidence=0.6, seq=1), row(confidence=0.9, seq=3, evidence="late"),
        row(confidence=0.9, seq=2, evidence="first"), row(line=2, confidence=0.5),
    ])
    out = FD.deduplicate(df, F.col("seq"))
    got = sorted((r.line, r.evidence, r.confidence, r.bucket, r.copies) for r in out.collect())
    assert got == [(1, "first", 0.9, "finding", 3), (2, "e", 0.5, "warning", 1)]
    again = FD.deduplicate(out.drop("bucket", "copies"), F.col("seq"))
    assert sorted((r.line, r.evidence, r.confidence) for r in again.collect()) == [g[:3] for g in got]
    spread = FD.deduplicate(df.repartition(7, "confidence"), F.col("seq"))
    assert sorted((r.line, r.evidence) for r in spread.collect()) == [g[:2] for g in got]


def test_order(spark):
    df = table(spark, [row("b", severity="low"), row("b"), row("a", 3), row("a", 2, severity="info")])
    got = [(r.severity, r.file, r.line) for r in FD.ordered(df).collect()]
    assert got == [("high", "a", 3), ("high", "b", 1), ("low", "b", 1), ("info", "a", 2)]


def test_marks(spark):
    df = table(spark, [row(), row(line=2), row("b"), row("c")])
    marks = spark.createDataFrame(
        [("R", "a", 1), ("R", "a", 1), ("R", "b", 0), ("S", "c", 0)],
        "rule_id string, file_path string, line int",
    )
    got = {(r.file, r.line): round(r.confidence, 3) for r in FD.apply_marks(df, marks).collect()}
    assert got == {("a", 1): 0.4, ("a", 2): 0.48, ("b", 1): 0.48, ("c", 1): 0.8}


def test_compare_runs(spark):
    now = table(spark, [row(evidence=" same "), row(line=5, evidence="new")])
    then = table(spark, [row(line=9, evidence="same"), row(evidence="old")])
    got = sorted((r.status, r.line) for r in FD.compare_runs(now, then).collect())
    assert got == [("gone", 1), ("new", 5), ("recurred", 1)]


def test_previous_task(spark):
    rows = [
        ("1", "x", "completed", "2024-01-01 01:00:00"), ("2", "x", "failed", "2024-01-01 02:00:00"),
        ("3", "x", "completed", "2024-01-01 03:00:00"), ("4", "x", "failed", "2024-01-05 00:00:00"),
        ("5", "x", "completed", "2024-01-09 00:00:00"), ("6", "y", "completed", "2024-01-09 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "task_id string, input_path string, status string, s string")
    df = df.select("*", F.col("s").cast("timestamp").alias("started_at"))
    got = {r.task_id: r.previous_task_id for r in FD.previous_task(df).collect()}
    assert got == {"1": None, "2": "1", "3": "1", "4": "3", "5": "3", "6": None}


def test_nolint_role_and_masking(file_lines):
    line = f'{SECRET} := "Winter-Storm-1"'
    files = {
        "a.go": f"{line}\n{line} //nolint:gosec\n{line} // nolint",
        "tests/b.py": line, "examples/c.py": line, "docs.md": line,
    }
    lines = file_lines(files)
    hits = FD.drop_nolint(line_hits(lines, only={"SEC-AST-001"}), lines)
    found = FD.dampen_by_role(FD.findings_of(hits)).collect()
    got = sorted((r.file, r.line, r.severity, r.confidence) for r in found)
    assert got == [
        ("a.go", 1, "high", 0.9), ("docs.md", 1, "low", 0.65), ("examples/c.py", 1, "low", 0.65),
        ("tests/b.py", 1, "low", 0.65),
    ]
    assert all("Storm" not in r.evidence for r in found)
    assert found[0].evidence_chain[3].startswith("confidence: 0.90")


def test_review_is_independent_of_partitioning(file_lines):
    files = {f"d/f{i}.go": f'f := os.Open(p)\nx, _ = g(a)\n{SECRET} = "Winter-Storm-{i}"' for i in range(6)}
    lines = file_lines(files)
    columns = ["file", "line", "rule_id", "severity", "confidence", "bucket", "copies"]
    a = sorted(map(tuple, review(lines).select(*columns).collect()))
    b = sorted(map(tuple, review(lines.repartition(5, "pos")).select(*columns).collect()))
    assert a == b and len(a) == 18


def test_numbers_do_not_depend_on_the_size_of_a_task(spark):
    rows = [row(f"f{i:03}", task="big") for i in range(600)]
    one = {r.file: r.ordinal for r in V.number_candidates(table(spark, rows)).collect()}
    assert one == {f"f{i:03}": i + 1 for i in range(600)}
    less = {r.file: r.batch for r in V.number_candidates(table(spark, rows[:400]), 7).collect()}
    more = {r.file: r.batch for r in V.number_candidates(table(spark, rows), 7).collect()}
    assert all(more[f] == b for f, b in less.items())


def test_numbering_splits_large_tasks(spark):
    df = table(spark, [row(f"f{i}", task="big") for i in range(300)] + [row("g", task="small")])
    out = V.number_candidates(df, 15)
    sizes = out.groupBy("task_id", "batch").agg(F.count("*").alias("n"), F.max("ordinal").alias("top"))
    rows = sizes.collect()
    assert all(r.n == r.top for r in rows)
    assert sum(r.n for r in rows) == 301 and max(r.n for r in rows) < 60


def test_verdicts_and_suggestions(spark):
    df = V.number_candidates(
        table(spark, [row(line=i) for i in (1, 2, 3, 4)]).withColumn("recommendation", F.lit("old"))
    )
    answer = "1. DENY: no\n2. CONFIRM\n 2. DENY: later wins\n3. MAYBE\n1. CONFIRM: again\n99. DENY: x"
    responses = spark.createDataFrame([("t", 0, answer)], "task_id string, batch bigint, response string")
    kept = sorted(r.line for r in V.apply_verdicts(df, responses).collect())
    assert kept == [1, 3, 4]
    stats = V.verdict_stats(df, responses).first()
    assert (stats.reviewed, stats.dropped) == (4, 1)
    advice = f"1. use a vault\n1. other\n3. set {SECRET}=Winter-Storm\n4."
    responses = spark.createDataFrame([("t", 0, advice)], "task_id string, batch bigint, response string")
    got = {r.line: r.recommendation for r in V.apply_suggestions(df, responses).collect()}
    assert got[1] == "use a vault" and got[2] == got[4] == "old" and "Winter" not in got[3]


def test_prompts(spark):
    df = V.number_candidates(table(spark, [row(evidence="x" * 300), row(line=2, evidence=" ")]))
    prompt = V.prompts(df).first()
    assert prompt.candidates == 2
    assert prompt.prompt.count("evidence:") == 1 and "x" * 200 + "…" in prompt.prompt


def test_batches_keep_their_size_as_a_task_grows(spark):
    df = table(spark, [row(f"f{i}", task="big") for i in range(1200)] + [row("g", task="small")])
    out = V.number_candidates(V.with_batches(df, 100), F.col("batches"))
    sizes = {r.task_id: (r.n, r.top) for r in out.groupBy("task_id").agg(
        F.countDistinct("batch").alias("n"), F.max("ordinal").alias("top")).collect()}
    assert sizes["small"] == (1, 1) and sizes["big"][0] == 12 and sizes["big"][1] < 150
    assert out.count() == 1201
    unnamed = V.with_batches(table(spark, [row("f", task=None)]), 100).collect()
    assert [r.batches for r in unnamed] == [1]


def test_answers_are_not_broadcast(spark):
    """A short table of long responses has more answers than its size tells."""
    responses = spark.range(100).select(
        F.lit("t").alias("task_id"), F.col("id").alias("batch"),
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda n: F.concat(n, F.lit(". DENY: no"))), "\n")
        .alias("response"))
    df = V.number_candidates(table(spark, [row(line=i) for i in range(50)]).withColumn("recommendation", F.lit("old")))
    for out in (V.apply_verdicts(df, responses), V.verdict_stats(df, responses), V.apply_suggestions(df, responses)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert V.apply_verdicts(df, responses).count() == 10
