"""From hits to findings, and the algebra on findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions.masking import mask_sensitive
from ..functions.text import lookup, trimmed
from ..sources.lines import FILE_KEY
from .checks import CHECKS, MULTI_FILE_RULES, Check

FINDING_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("line", T.IntegerType()),
        T.StructField("evidence", T.StringType()),
        T.StructField("recommendation", T.StringType()),
        T.StructField("evidence_chain", T.ArrayType(T.StringType())),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("source", T.StringType()),
        T.StructField("found_at", T.TimestampType()),
    ]
)
FINDING_COLUMNS = FINDING_SCHEMA.fieldNames()
KEY = ["task_id", "file", "line", "category", "rule_id"]

# Rank of the severities, cap for non-production code, confidence limit and
# the factors for marked false positives.
SEVERITY_RANK = {"high": 4, "medium": 3, "low": 2, "info": 1}
ROLE_CAP = 0.65
HIGH_CONFIDENCE = 0.7
EXACT_MARK, FILE_MARK = 0.5, 0.6
#: Up to so many marks Spark chooses the join.
FEW_MARKS = 10_000


def severity_rank(severity: Column) -> Column:
    return F.coalesce(lookup(SEVERITY_RANK, severity), F.lit(0))


def evidence_chain(file: Column, line: Column, rule: Column, fact: Column, conf: Column) -> Column:
    """Four steps that locate and explain a finding without quoting the code."""
    return F.array(
        F.format_string("hunk: %s@L%d", file, line),
        F.concat(F.lit("fact: "), fact),
        F.concat(F.lit("rule: "), rule),
        F.concat(F.lit("confidence: "), F.format_string("%.2f", conf)),
    )


def findings_of(
    hits: DataFrame, found_at: Column | None = None, checks: dict[str, Check] | None = None
) -> DataFrame:
    """Findings of rule hits: static texts by check, evidence and advice masked."""
    check, detail = F.col("check"), F.col("detail")
    known = CHECKS if checks is None else CHECKS | checks

    def static(field):
        return lookup({k: getattr(c, field) for k, c in known.items()}, check)

    def text(field):
        return F.replace(static(field), F.lit("{}"), detail)

    line = F.col("line").cast("int")
    return hits.select(
        "task_id",
        static("severity").alias("severity"),
        static("category").alias("category"),
        static("rule_id").alias("rule_id"),
        text("title").alias("title"),
        F.col("new_path").alias("file"),
        line.alias("line"),
        mask_sensitive(F.col("evidence")).alias("evidence"),
        mask_sensitive(text("recommendation")).alias("recommendation"),
        F.when(
            static("fact") != "",
            evidence_chain(
                F.col("new_path"), line, static("rule_id"), static("fact"), static("confidence")
            ),
        ).alias("evidence_chain"),
        static("confidence").alias("confidence"),
        static("source").alias("source"),
        (F.lit(None).cast("timestamp") if found_at is None else found_at).alias("found_at"),
    )


def has_nolint(content: Column) -> Column:
    return content.contains("nolint") & content.rlike(r"//\s*nolint(?::|\s|\z)")


def drop_nolint(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """Without hits on added lines that carry a ``//nolint`` mark (single-file rules only)."""
    marked = lines.filter((F.col("line_type") == "added") & has_nolint(F.col("content")))
    return drop_marked(hits, marked.select(*FILE_KEY, F.col("new_line").alias("line")))


def drop_marked(hits: DataFrame, marked: DataFrame) -> DataFrame:
    """The same for marked lines given by file and ``line``."""
    marked = marked.select(*FILE_KEY, F.col("line").alias("marked_line")).distinct()
    multi = [k for k, c in CHECKS.items() if c.rule_id in MULTI_FILE_RULES]
    asked = F.when(~F.col("check").isin(multi), F.col("line"))
    return hits.withColumn("marked_line", asked).join(
        marked, FILE_KEY + ["marked_line"], "left_anti"
    ).drop("marked_line").select(*hits.columns)


def dampen_by_role(findings: DataFrame) -> DataFrame:
    """Findings in test and example code become low-severity warnings."""
    role = P.code_role(F.col("file"))
    lowered = (role != "production") & (F.col("confidence") > ROLE_CAP)
    note = F.concat(
        F.col("title"), F.lit(" ("), role, F.lit(" code, lowered for manual review)")
    )
    return findings.withColumns(
        {
            "confidence": F.when(lowered, ROLE_CAP).otherwise(F.col("confidence")),
            "severity": F.when(lowered, "low").otherwise(F.col("severity")),
            "title": F.when(lowered, note).otherwise(F.col("title")),
        }
    )


def bucket(confidence: Column) -> Column:
    return F.when(confidence >= HIGH_CONFIDENCE, "finding").otherwise("warning")


def deduplicate(findings: DataFrame, first_by: Column | None = None) -> DataFrame:
    """The best finding per file, line, category and rule, with the number of ``copies``.

    An aggregate, not a window: copies of one key are combined before the shuffle. Ties in
    confidence go to the smallest ``first_by``, then to the smallest remaining columns.
    """
    rest = [c for c in findings.columns if c not in KEY + ["confidence"]]
    order = F.lit(0) if first_by is None else first_by
    best = F.min(
        F.struct((-F.col("confidence")).alias("worst"), order.alias("first"), *rest)
    )
    grouped = findings.groupBy(*KEY).agg(best.alias("best"), F.count("*").alias("copies"))
    return grouped.select(
        *[F.col(c) if c in KEY else
          (-F.col("best.worst")).alias(c) if c == "confidence" else F.col(f"best.{c}")
          for c in findings.columns],
        bucket(-F.col("best.worst")).alias("bucket"),
        "copies",
    )


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(
        "task_id", severity_rank(F.col("severity")).desc(), "file", "line", "rule_id"
    )


def summary_line() -> Column:
    return F.format_string(
        "[%s][%s] %s:%d - %s", F.col("severity"), F.col("category"), F.col("file"),
        F.col("line"), F.col("title"),
    )


# False-positive memory --------------------------------------------------------------


def apply_marks(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """Lower the confidence of findings that people marked as false positives.

    ``marks(rule_id, file_path, line)``; line 0 marks the whole file. Two left joins on distinct
    keys. Few marks are left to Spark, which broadcasts them; of many, each task hashes its part, so
    that the findings, which are many more, stream past and are never sorted.
    """
    keyed = marks.select("rule_id", F.col("file_path").alias("file"), F.col("line").cast("int"))
    exact = keyed.filter(F.col("line") != 0).distinct().withColumn("exact_mark", F.lit(True))
    whole = keyed.select("rule_id", "file").distinct().withColumn("file_mark", F.lit(True))
    if not marks.isStreaming and marks.limit(FEW_MARKS + 1).count() > FEW_MARKS:
        exact, whole = exact.hint("shuffle_hash"), whole.hint("shuffle_hash")
    factor = (
        F.when(F.col("exact_mark"), EXACT_MARK).when(F.col("file_mark"), FILE_MARK).otherwise(1.0)
    )
    return (
        findings.join(whole, ["rule_id", "file"], "left")
        .join(exact, ["rule_id", "file", "line"], "left")
        .withColumn("confidence", F.col("confidence") * factor)
        .select(*findings.columns)
    )


def list_marks(marks: DataFrame) -> DataFrame:
    return marks.orderBy(F.col("created_at").desc(), F.col("id").desc())


def delete_marks(marks: DataFrame, ids: DataFrame) -> DataFrame:
    return marks.join(ids, "id", "left_anti")


# Runs ---------------------------------------------------------------------------------


def compare_runs(
    current: DataFrame, previous: DataFrame, within: list[str] | None = None
) -> DataFrame:
    """Findings with ``status`` new, recurred or gone, by rule, file and trimmed evidence."""
    key = (within or []) + ["rule_id", "file", "__evidence"]
    shown = (within or []) + ["rule_id", "file", "line", "severity", "title"]

    def keyed(df):
        return df.withColumn("__evidence", trimmed(F.col("evidence")))

    now, then = keyed(current), keyed(previous)
    seen = then.select(*key).distinct().withColumn("__seen", F.lit(True))
    left = now.join(seen, key, "left").select(
        *shown, F.when(F.col("__seen"), "recurred").otherwise("new").alias("status")
    )
    gone = then.join(now.select(*key).distinct(), key, "left_anti").select(
        *shown, F.lit("gone").alias("status")
    )
    return left.unionByName(gone)


def previous_task(tasks: DataFrame) -> DataFrame:
    """For each task the last completed one of the same input that started before it.

    Ordered inside hours first and then over one row per hour, so an input with very many
    tasks is not ordered by a single worker.
    """
    order = ["started_at", "task_id"]
    done = F.when(F.col("status") == "completed", F.col("task_id"))
    timed = tasks.withColumn("__hour", F.date_trunc("hour", "started_at")).withColumn("__done", done)
    part = ["input_path", "__hour"]
    inside = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    near = timed.withColumn("__near", F.last("__done", ignorenulls=True).over(inside))
    ends = timed.groupBy(*part).agg(
        F.max_by("__done", F.when(F.col("__done").isNotNull(), F.struct(*order))).alias("__end")
    )
    hours = W.partitionBy("input_path").orderBy("__hour").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*part, F.last("__end", ignorenulls=True).over(hours).alias("__carry"))
    return near.join(carried, part, "left").select(
        *tasks.columns, F.coalesce("__near", "__carry").alias("previous_task_id")
    )
