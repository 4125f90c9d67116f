"""Findings of other tools, read from their logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.masking import mask_sensitive
from ..functions.text import cut_bytes, trimmed
from ..operators.findings import evidence_chain

LINTER_LINE = r"^([^:\s]+):(\d+):(\d+):\s+([^\n]+?)\s+\(([A-Z]+\d+)\)\z"
VULNERABILITY = "osv STRUCT<id: STRING, summary: STRING, details: STRING, aliases: ARRAY<STRING>>"


def read_log(spark: SparkSession, path: str, task_id: str) -> DataFrame:
    return spark.read.text(path).select(F.lit(task_id).alias("task_id"), F.col("value").alias("text"))


def _finding(df: DataFrame, rule, title, file, line, evidence, advice, confidence, source, fact):
    conf = F.lit(confidence)
    return df.select(
        "task_id",
        F.lit("low").alias("severity"),
        F.lit("quality").alias("category"),
        rule.alias("rule_id"),
        title.alias("title"),
        file.alias("file"),
        line.alias("line"),
        mask_sensitive(evidence).alias("evidence"),
        mask_sensitive(advice).alias("recommendation"),
        evidence_chain(file, line, rule, fact, conf).alias("evidence_chain"),
        conf.alias("confidence"),
        F.lit(source).alias("source"),
        F.lit(None).cast("timestamp").alias("found_at"),
    )


def linter_findings(log: DataFrame) -> DataFrame:
    """``log(task_id, text)`` with lines ``path:line:col: message (CODE)``."""
    text = trimmed(F.col("text"))
    part = [F.regexp_extract(text, LINTER_LINE, i) for i in range(6)]
    named = log.filter(F.col("text").contains(":")).select(
        "task_id", part[1].alias("path"), part[2].try_cast("int").alias("no"),
        part[3].try_cast("int").alias("col"), part[4].alias("message"), part[5].alias("code"),
    ).filter((F.col("code") != "") & F.col("no").isNotNull() & F.col("col").isNotNull())
    code = F.col("code")
    return _finding(
        named, F.concat(F.lit("STATICCHECK-"), code), F.concat(F.lit("staticcheck: "), code),
        F.col("path"), F.col("no"), F.col("message"),
        F.concat(F.lit("See https://staticcheck.dev/docs/checks/#"), code), 0.95,
        "tool:staticcheck",
        F.concat(F.lit("tool output: "), code, F.lit(" (external static analysis)")),
    )


def linter_summary(findings: DataFrame) -> DataFrame:
    """Findings per code; ``linter_summary_text`` renders them on one line."""
    code = F.regexp_replace("rule_id", "^STATICCHECK-", "")
    return findings.groupBy("task_id", code.alias("code")).agg(F.count("*").alias("n"))


def linter_summary_text(summary: DataFrame) -> DataFrame:
    """One line per task; the codes of a linter are a small fixed set."""
    one = F.concat("code", F.lit("×"), F.col("n").cast("string"))
    return summary.groupBy("task_id").agg(
        F.concat(
            F.sum("n").cast("string"), F.lit(" findings ("),
            F.array_join(F.array_sort(F.collect_list(one)), ", "), F.lit(")"),
        ).alias("summary")
    )


def vulnerability_findings(log: DataFrame) -> DataFrame:
    """``log(task_id, text)`` with one JSON object per line; other lines are left out."""
    osv = F.col("osv")
    parsed = log.select(
        "task_id", F.from_json("text", VULNERABILITY)["osv"].alias("osv")
    ).filter(F.coalesce(osv["id"], F.lit("")) != "")

    def text(c):
        return F.nullif(trimmed(c), F.lit(""))

    title = cut_bytes(F.coalesce(text(osv["summary"]), text(osv["details"]), F.lit("")), 120)
    alias = F.when(
        F.size(osv["aliases"]) > 0,
        F.concat(F.lit(" ("), F.array_join(osv["aliases"], ", "), F.lit(")")),
    ).otherwise("")
    return _finding(
        parsed, F.lit("GOV-GEN-001"), F.concat(F.lit("Vulnerable dependency: "), title),
        F.lit("go.mod"), F.lit(1), F.concat(osv["id"], alias),
        F.concat(F.lit("Upgrade the affected module; see "), osv["id"]), 0.90,
        "tool:govulncheck", F.concat(F.lit("osv id="), osv["id"], F.lit(" detected by govulncheck")),
    )


def bad_vulnerability_lines(log: DataFrame) -> DataFrame:
    """Lines per task that are no JSON object."""
    text = trimmed(F.col("text"))
    parsed = text.startswith("{") & F.try_parse_json(text).isNotNull()
    bad = (text != "") & ~parsed
    return log.groupBy("task_id").agg(F.count_if(bad).alias("bad_lines"))


def vulnerability_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("task_id").agg(F.count("*").alias("vulnerabilities"))
