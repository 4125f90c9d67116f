from __future__ import annotations

from pyspark.sql import functions as F

from patchlens.operators.findings import findings_of
from patchlens.operators.line_rules import line_hits
from patchlens.plans.review import review
from patchlens.sources.lines import lines_of_patches, split_patches
from patchlens.streaming import streams as ST

PATCH = "--- a/{0}.go\n+++ b/{0}.go\n@@ -0,0 +1,2 @@\n+t := time.Tick(d)\n+f := os.Open(p)\n"


def patches(spark, tmp_path):
    rows = [(f"t{i}", PATCH.format(f"f{i}")) for i in range(5)]
    df = spark.createDataFrame(rows, "task_id string, diff_text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return df, stream


def places(df):
    return sorted((r.task_id, r.file, r.line, r.rule_id) for r in df.collect())


def test_line_rules_stream_equals_batch(spark, tmp_path):
    df, stream = patches(spark, tmp_path)
    ST.run_to_files(ST.line_findings(stream), str(tmp_path / "out"))
    batch = findings_of(line_hits(lines_of_patches(df)))
    assert places(spark.read.parquet(str(tmp_path / "out" / "rows"))) == places(batch)


def test_review_stream_equals_batch(spark, tmp_path):
    df, stream = patches(spark, tmp_path)
    ST.review_stream(stream, str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out" / "findings"))
    assert places(got) == places(review(lines_of_patches(df)))


def test_review_stream_keeps_rejected_patches(spark, tmp_path):
    rows = [("empty", ""), ("none", None), ("hunk", "--- a/x.go\n+++ b/x.go\n@@ -x +1 @@\n+a := 1\n"),
            ("deleted", "--- a/x.go\n+++ b/x.go\n@@ -1 +0,0 @@\n-a := 1\n"),
            ("good", "--- a/x.go\n+++ b/x.go\n@@ -0,0 +1 @@\n+a := 1\n")]
    df = spark.createDataFrame(rows, "task_id string, diff_text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    ST.review_stream(stream, str(tmp_path / "out"))
    got = {r.task_id: r.reason for r in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()}
    want = {r.task_id: r.reason for r in split_patches(df)[1].collect()}
    assert got == want and {"empty", "hunk", "deleted"} <= set(got) and "good" not in got


def test_watchdog_over_batches(spark, tmp_path):
    rows = [
        ("slow", "running", "2024-01-01 00:00:00"), ("fast", "running", "2024-01-01 00:00:00"),
        ("fast", "completed", "2024-01-01 00:05:00"), ("slow", "completed", "2024-01-01 00:20:00"),
        ("late", "running", "2024-01-01 01:00:00"), ("clock", "running", "2024-01-01 02:00:00"),
    ]
    df = spark.createDataFrame(rows, "task_id string, status string, s string").select(
        "task_id", "status", F.col("s").cast("timestamp").alias("at")
    )
    for i in range(6):
        df.filter(F.col("at") == F.lit(rows[i][2]).cast("timestamp")).filter(
            F.col("task_id") == rows[i][0]
        ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ST.use_state_store(spark)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ST.run_to_files(ST.watchdog_stream(stream, "1 hour"), str(tmp_path / "out"))
    got = {r.task_id: str(r.at) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()}
    assert got == {"slow": "2024-01-01 00:10:00"}
    every = {r.task_id for r in ST.watchdog(df).collect()}
    assert every == {"slow", "late", "clock"}


def test_states_trend_and_audit(spark, tmp_path):
    rows = [("a", "running", "2024-01-01 00:00:00", 10.0), ("a", "completed", "2024-01-01 01:00:00", 30.0),
            ("b", "running", "2024-01-03 00:00:00", 50.0)]
    df = spark.createDataFrame(rows, "task_id string, status string, s string, risk_score double").withColumn(
        "at", F.col("s").cast("timestamp")
    )
    df.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen = []
    ST.run_batches(ST.state_stream(source()), str(tmp_path / "s"), lambda b, _: seen.extend(b.collect()), "update")
    assert {r.task_id: r.status for r in seen} == {"a": "completed", "b": "running"}
    trend = ST.trend_stream(source().withColumnRenamed("at", "started_at"), "0 seconds")
    ST.run_to_files(trend, str(tmp_path / "t"))
    got = spark.read.parquet(str(tmp_path / "t" / "rows")).collect()
    assert [(str(r.day), r.tasks, r.avg_risk) for r in got] == [("2024-01-01", 2, 20.0)]


def test_tables_are_read_whatever_their_layout(spark, tmp_path):
    """A folder of part files and a single file give all rows."""
    from pyspark.sql import functions as F

    rows = spark.range(40).withColumn("at", F.timestamp_seconds(F.col("id") * 3600 * 30))
    folder = str(tmp_path / "events.parquet")
    rows.repartition(4).write.parquet(folder)
    single = next((tmp_path / "events.parquet").glob("part-*.parquet"))
    for path, n in ((folder, 40), (str(single), spark.read.parquet(str(single)).count())):
        stream = ST.table_stream(spark, path, rows.schema)
        out = str(tmp_path / f"out{n}")
        ST.run_to_files(stream, out)
        assert spark.read.parquet(f"{out}/rows").count() == n


def test_trend_counts_rows_of_all_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = spark.range(400).select(
        F.timestamp_seconds(F.col("id") * 7919 % 400 * 3600).alias("started_at"),
        F.col("id").cast("double").alias("risk_score"))
    folder = str(tmp_path / "in")
    rows.repartition(5).write.parquet(folder)
    stream = ST.stream_session(spark).readStream.schema(rows.schema).option(
        "maxFilesPerTrigger", 1).parquet(folder)
    ST.run_to_table(ST.trend_stream(stream), str(tmp_path / "out"))
    got = ST.newest_table(spark, str(tmp_path / "out"), spark.range(0).select(
        F.current_date().alias("day"), F.col("id").alias("tasks"), F.lit(0.5).alias("avg_risk")).schema)
    assert got.agg(F.sum("tasks")).first()[0] == 400
    kept = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out" / "rows").glob("batch=*"))
    assert len(kept) == 2 and kept[1] == kept[0] + 1


def test_repeated_audit_batches_add_nothing(spark, tmp_path):
    at = F.lit("2024-01-01 00:00:00.123456").cast("timestamp")
    df = spark.createDataFrame([("go test ./...",), ("rm -rf /",), ("",)], "arguments string").withColumn("decided_at", at)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(df.schema).parquet(folder)
    ST.audit_log(stream(), out)
    for commit in (tmp_path / "out" / "checkpoint" / "commits").iterdir():
        commit.unlink()  # as if the driver had died before the end of the batch
    ST.audit_log(stream(), out)
    rows = ST.read_audit(spark, out).collect()
    assert sorted(r["decision"] for r in rows) == ["allow", "deny", "deny"]
    assert {r["timestamp"].microsecond for r in rows} == {123456}


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    rows = [
        [("a", "queued", 0), ("b", "running", 0), ("c", "queued", 0)],
        [("a", "running", 10), ("c", "running", 5), ("c", "running", 6)],
        [("a", "completed", 30), ("c", "failed", 20), ("b", "queued", 9)],
        [("a", "queued", 40), ("c", "queued", 20 + 7200), ("a", "completed", 50)],
        [("c", "running", 20 + 7300)],
    ]
    schema = "task_id string, status string, s long"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in rows:
        spark.createDataFrame(part, schema).select(
            "task_id", "status", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at")
        ).coalesce(1).write.mode("append").parquet(folder)
        stream = ST.lifecycle_stream(ST.stream_session(spark).readStream.schema(
            "task_id string, status string, at timestamp").parquet(folder), "1 hour")
        ST.run_to_files(stream, out)
    got = spark.read.schema(stream.schema).parquet(f"{out}/rows").collect()
    want = ST.lifecycle(spark.read.parquet(folder)).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 13
    moves = {(r.task_id, r.from_status, r.to_status): (r.legal, r.held_ms) for r in want}
    assert moves["a", "queued", "running"] == (True, 10_000)
    assert moves["b", None, "running"] == (False, None)
    assert moves["c", "running", "running"] == (False, 1000)
    assert moves["a", "completed", "queued"] == (False, 10_000)  # not forgotten yet
    assert moves["c", None, "queued"] == (True, None)


def test_watchdog_keeps_an_end_that_comes_first(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    minute = datetime.timedelta(minutes=1)
    schema = "task_id string, status string, at timestamp"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [[("a", "completed", at + 5 * minute), ("b", "completed", at + 15 * minute)],
             [("a", "running", at), ("b", "running", at), ("c", "running", at)]]
    (tmp_path / "in").mkdir()
    stream = ST.watchdog_stream(
        ST.stream_session(spark).readStream.schema(schema).parquet(folder), "1 hour")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        ST.run_to_files(stream, out)
    ST.closing_row(spark.read.schema(schema).parquet(folder), "at").write.mode("append").parquet(folder)
    ST.run_to_files(stream, out)
    got = {r["task_id"] for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == {"b", "c"}


def test_a_call_of_a_processor_serves_many_jobs(spark):
    """Calls, timers and accesses to state are bounded by the buckets, not by the jobs."""
    events = spark.range(50_000).select(
        F.col("id").cast("string").alias("task_id"), F.lit("running").alias("status"),
        F.timestamp_seconds("id").alias("at"))
    assert events.select(ST._bucket()).distinct().count() == ST.BUCKETS
