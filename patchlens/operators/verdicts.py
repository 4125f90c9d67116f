"""Prompts for a reviewing model and what its answers change.

The model itself is not part of this library: prompts go out as a table, answers come
back as ``responses(task_id, batch, response)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.masking import mask_sensitive
from ..functions.text import WORD_END, one_line, trimmed
from .findings import severity_rank

BATCH_KEY = ["task_id", "batch"]
VERDICT = r"^(\d+)\.\s*(CONFIRM|DENY)" + WORD_END + r"[:\s]*([^\n]*)"
SUGGESTION = r"^(\d+)\.\s*([^\n]+)"


def with_batches(findings: DataFrame, size: int) -> DataFrame:
    """Findings with ``batches``: how many batches of ``size`` their task fills."""
    sizes = findings.groupBy(F.col("task_id").alias("__task")).agg(
        F.ceil(F.count("*") / size).alias("batches"))
    return findings.join(sizes, F.col("task_id").eqNullSafe(F.col("__task"))).drop("__task")


def number_candidates(findings: DataFrame, batches: int | Column = 1) -> DataFrame:
    """Findings with ``batch`` and ``ordinal``, numbered by severity and place inside a batch.

    The caller says into how many batches each task's findings are dealt, by a hash of the
    finding's key: with one, the order of the whole task. A number holds for all sizes of a task;
    a column, as of ``with_batches``, keeps a batch, its window and its prompt at one size.
    """
    key = F.concat_ws(":", "file", "line", "category", "rule_id")
    digest = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    count = batches if isinstance(batches, Column) else F.lit(batches)
    w = W.partitionBy(*BATCH_KEY).orderBy(
        severity_rank(F.col("severity")).desc(), "file", "line", "rule_id", "category"
    )
    return findings.withColumn("batch", F.pmod(digest, count).cast("bigint")).withColumn(
        "ordinal", F.row_number().over(w)
    )


def prompts(numbered: DataFrame) -> DataFrame:
    """One prompt per batch; evidence on one line, cut at 200 bytes."""
    head = F.format_string(
        "%d. [%s][%s] %s:%d %s", "ordinal", "rule_id", "severity", "file", "line", "title"
    )
    evidence = F.when(
        trimmed(F.col("evidence")) != "",
        F.concat(F.lit("\n   evidence: "), one_line(trimmed(F.col("evidence")))),
    ).otherwise("")
    intro = F.format_string(
        "Review these candidate findings. Answer with %d lines of the form "
        "'number. CONFIRM: reason' or 'number. DENY: reason'.\n", F.count("*")
    )
    items = F.array_sort(F.collect_list(F.struct("ordinal", F.concat(head, evidence).alias("text"))))
    return numbered.groupBy(*BATCH_KEY).agg(
        F.concat(intro, F.array_join(F.transform(items, lambda i: i["text"]), "\n")).alias("prompt"),
        F.count("*").alias("candidates"),
    )


def _answers(responses: DataFrame, pattern: str) -> DataFrame:
    line = trimmed(F.col("line"))
    return (
        responses.select(*BATCH_KEY, F.posexplode(F.split("response", "\n")).alias("at", "line"))
        .select(
            *BATCH_KEY, "at",
            F.regexp_extract(line, pattern, 1).try_cast("int").alias("ordinal"),
            trimmed(F.regexp_extract(line, pattern, 2)).alias("answer"),
        )
        .filter(F.col("ordinal").isNotNull() & (F.col("answer") != ""))
    )


def verdicts(responses: DataFrame) -> DataFrame:
    """CONFIRM or DENY per ordinal; a later line overrides an earlier one."""
    denied = F.max_by(F.col("answer") == "DENY", "at")
    return _answers(responses, VERDICT).groupBy(*BATCH_KEY, "ordinal").agg(
        F.when(denied, "DENY").otherwise("CONFIRM").alias("verdict")
    )


def _join_answers(numbered: DataFrame, answers: DataFrame, how: str) -> DataFrame:
    """Candidates beside the answers with their number.

    A response is one row with many answers, which Spark's estimate of the answers' size doesn't
    know: it would broadcast millions of them. So both sides are shuffled.
    """
    return numbered.join(answers.hint("merge"), BATCH_KEY + ["ordinal"], how)


def apply_verdicts(numbered: DataFrame, responses: DataFrame) -> DataFrame:
    """Candidates without the denied ones; unanswered candidates stay."""
    denied = verdicts(responses).filter(F.col("verdict") == "DENY")
    return _join_answers(numbered, denied, "left_anti")


def verdict_stats(numbered: DataFrame, responses: DataFrame) -> DataFrame:
    judged = _join_answers(numbered, verdicts(responses), "left")
    return judged.groupBy("task_id").agg(
        F.count("*").alias("reviewed"), F.count_if(F.col("verdict") == "DENY").alias("dropped")
    )


def suggestions(responses: DataFrame) -> DataFrame:
    """One line of advice per ordinal; the first line wins."""
    return _answers(responses, SUGGESTION).groupBy(*BATCH_KEY, "ordinal").agg(
        one_line(F.min_by("answer", "at")).alias("suggestion")
    )


def apply_suggestions(numbered: DataFrame, responses: DataFrame) -> DataFrame:
    """Advice replaced by the model's where it gave one, masked again."""
    return (
        _join_answers(numbered, suggestions(responses), "left")
        .withColumn(
            "recommendation", F.coalesce(mask_sensitive(F.col("suggestion")), "recommendation")
        )
        .drop("suggestion")
    )
