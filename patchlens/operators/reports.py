"""Summaries of findings, tasks, command decisions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import lookup, record
from .findings import SEVERITY_RANK, severity_rank

SEVERITIES = list(SEVERITY_RANK)
# Weights of a file's findings, and the lengths of the lists.
FILE_WEIGHT = {"high": 5, "medium": 3, "low": 2}
TOP_DIRECTORIES, TOP_FILES, TOP_RULES, RECENT_TASKS = 20, 10, 10, 10
DEFAULT_LIST, MAX_LIST = 50, 500

FORMAL = "bucket = 'finding'"


def finding_summary(deduplicated: DataFrame) -> DataFrame:
    """Totals per task: findings, warnings, removed copies, findings by severity."""
    formal = F.expr(FORMAL)
    return deduplicated.groupBy("task_id").agg(
        F.count_if(formal).alias("total_findings"),
        F.count_if(~formal).alias("total_warnings"),
        F.sum(F.col("copies") - 1).alias("dedup_removed"),
        *[F.count_if(formal & (F.col("severity") == s)).alias(s) for s in SEVERITIES],
    )


def findings_by_category(deduplicated: DataFrame) -> DataFrame:
    return deduplicated.filter(FORMAL).groupBy("task_id", "category").agg(F.count("*").alias("n"))


def severity_pivot(findings: DataFrame) -> DataFrame:
    """Findings of each task by severity, one column each, and their total."""
    counted = findings.groupBy("task_id").pivot("severity", SEVERITIES).count().na.fill(0)
    total = sum((F.col(s) for s in SEVERITIES[1:]), F.col(SEVERITIES[0]))
    return counted.withColumn("total", total)


def finding_stats(findings: DataFrame) -> DataFrame:
    """(kind, key, n): total, by severity, by category and the ten most frequent rules.

    One aggregate over the findings; the grouping sets run on its few rows.
    """
    base = findings.groupBy("severity", "category", "rule_id").agg(F.count("*").alias("n"))
    keys = [F.col("severity"), F.col("category"), F.col("rule_id")]
    sets = base.groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.sum("n").alias("n"),
        F.grouping_id().alias("gid"),
    )
    kind = lookup({3: "severity", 5: "category", 6: "rule", 7: "total"}, F.col("gid").cast("int"))
    rows = sets.select(
        kind.alias("kind"), F.coalesce("severity", "category", "rule_id", F.lit("")).alias("key"), "n"
    )
    w = W.partitionBy("kind").orderBy(F.col("n").desc(), "key")
    ranked = rows.withColumn("rank", F.row_number().over(w))
    return ranked.filter((F.col("kind") != "rule") | (F.col("rank") <= TOP_RULES)).drop("rank")


def directory_density(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Per task the directories with most findings: files, findings, warnings, density, bar.

    ``files(task_id, path)``. Directories known from only one side count too; without files
    the density divides by one.
    """
    key = ["task_id", "dir"]
    per_dir = files.select("task_id", P.directory(F.col("path")).alias("dir")).groupBy(*key).agg(
        F.count("*").alias("files")
    )
    formal = F.expr(FORMAL)
    hits = (
        findings.groupBy("task_id", "file")
        .agg(F.count_if(formal).alias("f"), F.count_if(~formal).alias("w"))
        .groupBy("task_id", P.directory(F.col("file")).alias("dir"))
        .agg(F.sum("f").alias("findings"), F.sum("w").alias("warnings"))
    )
    joined = per_dir.join(hits, key, "full").select(
        *key,
        F.greatest(F.coalesce("files", F.lit(0)), F.lit(1)).alias("files"),
        F.coalesce("findings", F.lit(0)).alias("findings"),
        F.coalesce("warnings", F.lit(0)).alias("warnings"),
    )
    issues = F.col("findings") + F.col("warnings")
    w = W.partitionBy("task_id").orderBy(issues.desc(), "dir")
    top = joined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP_DIRECTORIES)
    most = F.greatest(F.max(issues).over(W.partitionBy("task_id")), F.lit(1))
    return top.select(
        *key, "files", "findings", "warnings",
        (issues / F.col("files")).alias("density"),
        (issues / most * 100).alias("bar"),
    )


def risky_files(findings: DataFrame) -> DataFrame:
    """Per task the ten files with the greatest weight of findings."""
    formal = F.expr(FORMAL)
    weight = F.when(
        formal, F.coalesce(lookup(FILE_WEIGHT, F.col("severity")), F.lit(1))
    ).otherwise(1)
    files = findings.groupBy("task_id", "file").agg(
        F.count_if(formal).alias("findings"),
        F.count_if(~formal).alias("warnings"),
        F.sum(weight).alias("weight"),
    )
    w = W.partitionBy("task_id").orderBy(F.col("weight").desc(), "file")
    return files.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= TOP_FILES).drop(
        "rank"
    )


def governance_summary(decisions: DataFrame) -> DataFrame:
    """Allowed, denied and asked commands per task. Denied commands are in their own table."""
    action = F.col("action")
    return decisions.groupBy("task_id").agg(
        F.count("*").alias("checks"),
        F.count_if(action == "allow").alias("allowed"),
        F.count_if(action == "deny").alias("denied"),
        F.count_if(action == "ask").alias("asked"),
    )


def denied_commands(decisions: DataFrame) -> DataFrame:
    """Distinct denied commands per task with their count: rows, not one list per task."""
    return decisions.filter(F.col("action") == "deny").groupBy("task_id", "command").agg(
        F.count("*").alias("n")
    )


def run_summary(runs: DataFrame) -> DataFrame:
    ok = F.col("exit_code") == 0
    return runs.groupBy("task_id").agg(
        F.count("*").alias("runs"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.count_if(F.col("timed_out")).alias("timed_out"),
        F.sum("duration_ms").alias("duration_ms"),
    )


# Tasks ------------------------------------------------------------------------------


def task_totals(tasks: DataFrame) -> DataFrame:
    return tasks.agg(
        F.count("*").alias("tasks"),
        F.avg("risk_score").alias("avg_risk"),
        F.max("risk_score").alias("max_risk"),
    )


def daily_trend(tasks: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """Tasks and mean risk per day of the session time zone, for the last ``days`` days."""
    since = F.date_sub(today, days - 1)
    return (
        tasks.filter(F.col("started_at") >= since.cast("timestamp"))
        .groupBy(F.to_date("started_at").alias("day"))
        .agg(F.count("*").alias("tasks"), F.avg("risk_score").alias("avg_risk"))
    )


def recent_tasks(tasks: DataFrame, limit: int = DEFAULT_LIST) -> DataFrame:
    """The latest tasks; limits outside 1 to 500 fall back to the default or the maximum."""
    n = DEFAULT_LIST if limit < 1 else min(limit, MAX_LIST)
    return tasks.orderBy(F.col("started_at").desc(), "task_id").limit(n)


def task_states(events: DataFrame) -> DataFrame:
    """Current state of each task from ``events(task_id, status, at, error_msg)``.

    Duration runs from the first event to the final one, in milliseconds.
    """
    final = F.col("status").isin("completed", "failed")
    latest = F.max(F.struct("at", final.alias("final"), "status", "error_msg"))
    state = events.groupBy("task_id").agg(
        latest.alias("last"), F.min("at").alias("started_at")
    )
    done = F.when(F.col("last.final"), F.col("last.at"))
    return state.select(
        "task_id",
        F.col("last.status").alias("status"),
        "started_at",
        done.alias("completed_at"),
        F.round((F.unix_micros(done) - F.unix_micros("started_at")) / 1000)
        .cast("bigint").alias("duration_ms"),
        F.col("last.error_msg").alias("error_msg"),
    )


def task_detail(
    tasks: DataFrame, reports: DataFrame, runs: DataFrame, decisions: DataFrame, task_id: str
) -> DataFrame:
    """Everything stored about one task as tagged rows (section, body).

    The filter reaches all four scans; nothing is collected into one row.
    """
    def section(df, name):
        body = F.to_json(F.struct(*[c for c in df.columns if c != "task_id"]))
        return df.filter(F.col("task_id") == task_id).select(
            "task_id", F.lit(name).alias("section"), body.alias("body")
        )

    out = section(tasks, "task")
    for df, name in ((reports, "report"), (runs, "run"), (decisions, "decision")):
        out = out.unionByName(section(df, name))
    return out


def listed(findings: DataFrame, severity: str | None = None, warnings: bool = False) -> DataFrame:
    """Findings of one severity, or the warnings."""
    if warnings:
        return findings.filter(F.col("bucket") == "warning")
    shown = findings.filter(FORMAL)
    return shown.filter(F.col("severity") == severity) if severity else shown


# Documents --------------------------------------------------------------------------


def report_documents(scores: DataFrame, summaries: DataFrame) -> DataFrame:
    """One JSON report per task from its score and its summary; findings stay a table."""
    joined = scores.join(summaries, "task_id", "left")
    summary = F.struct(*[c for c in summaries.columns if c != "task_id"])
    body = record(
        task_id=F.col("task_id"), score=F.col("score"), grade=F.col("grade"),
        breakdown=F.col("breakdown"), summary=summary,
    )
    return joined.select("task_id", F.to_json(body).alias("json_report"))


def observed(findings: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The same findings with counters that are filled when an action runs."""
    seen = Observation(name)
    return (
        findings.observe(
            seen,
            F.count(F.lit(1)).alias("findings"),
            F.count_if(severity_rank(F.col("severity")) == 4).alias("high"),
            F.approx_count_distinct("file").alias("files"),
        ),
        seen,
    )
