"""Risk score of a task: mean severity per category, weighted and summed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lookup, record

# Dimensions (name, weight) by category, severity weights and grade limits.
DIMENSIONS = {
    "security": ("security", 0.30),
    "sensitive_leak": ("sensitive information", 0.15),
    "resource": ("resource leaks", 0.20),
    "error_handling": ("error handling", 0.15),
    "testing": ("test coverage", 0.15),
    "concurrency": ("concurrency", 0.05),
}
# Severity weights are in tenths: whole numbers add up alike in any order.
SEVERITY_TENTHS = {"high": 10, "medium": 6, "low": 3, "info": 1}
GRADES = [(80, "F"), (60, "D"), (40, "C"), (20, "B")]


def dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(c, n, w) for c, (n, w) in DIMENSIONS.items()], "category string, name string, weight double"
    )


def grade(score: Column) -> Column:
    out = F.when(score >= GRADES[0][0], GRADES[0][1])
    for limit, letter in GRADES[1:]:
        out = out.when(score >= limit, letter)
    return out.otherwise("A")


def risk_score(findings: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """One row per task from its bucketed findings; warnings are only counted.

    A single aggregate with conditional means; tasks without findings score 0 when the
    ``tasks`` table is given.
    """
    formal = F.col("bucket") == "finding"
    weight = F.coalesce(lookup(SEVERITY_TENTHS, F.col("severity")), F.lit(0))
    aggregates = [
        F.count_if(formal).alias("finding_count"),
        F.count_if(~formal).alias("warning_count"),
    ]
    for category in DIMENSIONS:
        here = formal & (F.col("category") == category)
        aggregates += [
            F.sum(F.when(here, weight)).alias(f"w_{category}"),
            F.count_if(here).alias(f"n_{category}"),
        ]
    scored = findings.groupBy("task_id").agg(*aggregates)
    if tasks is not None:
        scored = tasks.select("task_id").distinct().join(scored, "task_id", "left")
    parts, total = [], F.lit(0.0)
    for category, (name, share) in DIMENSIONS.items():
        n = F.coalesce(f"n_{category}", F.lit(0))
        # Not least(100, null): that is 100.
        mean = F.when(n > 0, F.least(F.lit(100.0), F.col(f"w_{category}") * 10 / n)).otherwise(0.0)
        total = total + mean * share
        parts += [F.lit(name), record(weight=share, score=mean, count=n, weighted=mean * share)]
    # Scaled before rounding: rounding to two places would go by the decimal text of the sum.
    score = F.round(total * 100) / 100
    warnings = F.coalesce("warning_count", F.lit(0))
    return scored.select(
        "task_id",
        score.alias("score"),
        grade(score).alias("grade"),
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        warnings.alias("warning_count"),
        F.when(
            warnings > 0, F.format_string("%d low-confidence warnings need manual review", warnings)
        ).alias("warning"),
        F.create_map(*parts).alias("breakdown"),
    )


def score_text() -> Column:
    """Score report of one row of ``risk_score``: headline and a bar per dimension."""
    def bar(entry):
        filled = F.floor(entry["value"]["score"] / 10).cast("int")
        return F.format_string(
            "  %s [%s%s] %.1f", entry["key"], F.repeat(F.lit("█"), filled),
            F.repeat(F.lit("░"), 10 - filled), entry["value"]["score"],
        )

    rows = F.transform(F.array_sort(F.map_entries("breakdown")), bar)
    head = F.format_string("Risk %.2f (%s)\n", F.col("score"), F.col("grade"))
    return F.concat(head, F.array_join(rows, "\n"))
