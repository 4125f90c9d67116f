"""Which artifacts of a task may be stored, and the artifacts of a review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import extension

# Admission limits.
MAX_PER_TASK = 20
MAX_BYTES = 1 << 20
EXTENSIONS = [".json", ".md", ".html", ".log", ".txt"]


def admit(artifacts: DataFrame, limit: int = MAX_PER_TASK) -> DataFrame:
    """``artifacts(task_id, seq, file_path, content, ...)`` with ``rejected``, null when stored.

    The first ``limit`` positions of a task count, rejected ones included. Only the last
    admitted position is looked up per task, so a task with very many artifacts is never
    ordered as a whole.
    """
    w = W.partitionBy("task_id").orderBy("seq")
    last = (
        artifacts.select("task_id", "seq")
        .withColumn("n", F.row_number().over(w))
        .filter(F.col("n") <= limit)
        .groupBy("task_id")
        .agg(F.max("seq").alias("last_seq"))
    )
    size = F.octet_length("content")
    reason = (
        F.when(F.col("seq") > F.col("last_seq"), "count")
        .when(~F.lower(extension(F.col("file_path"))).isin(EXTENSIONS), "extension")
        .when(size > MAX_BYTES, "size")
    )
    return artifacts.join(last, "task_id").withColumn("rejected", reason).drop("last_seq")


def review_artifacts(reports: DataFrame, runs: DataFrame) -> DataFrame:
    """The JSON report of each task and one log part per run."""
    report = reports.select(
        "task_id", F.lit("report").alias("artifact_type"), F.lit(0).cast("bigint").alias("seq"),
        F.lit("review_report.json").alias("file_path"), F.col("json_report").alias("content"),
    )
    text = F.format_string(
        "$ %s [%s exit=%d %dms]\n%s\n", "command", "backend", "exit_code", "duration_ms", "output"
    )
    at = F.unix_millis("started_at")
    log = runs.select(
        "task_id", F.lit("sandbox_output").alias("artifact_type"), at.alias("seq"),
        F.concat("task_id", F.lit("-sandbox-"), at.cast("string"), F.lit(".log")).alias("file_path"),
        text.alias("content"),
    )
    return report.unionByName(log)
