"""How well findings meet labels: recall, precision, leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACE = ["case_id", "rule_id", "file", "line"]
# Gates on recall, precision, false alarms on negative cases and leaks.
GATES = {"recall": 0.85, "precision": 0.90, "negative_rate": 0.10, "leaks": 0}


def match_expected(expected: DataFrame, produced: DataFrame) -> DataFrame:
    """True positives, misses and false alarms per place; each produced row counts once.

    Multisets are compared by their counts, so neither side is expanded into pairs.
    """
    e = expected.groupBy(*PLACE).agg(F.count("*").alias("expected"))
    p = produced.groupBy(*PLACE).agg(F.count("*").alias("produced"))
    both = e.join(p, PLACE, "full").na.fill(0, ["expected", "produced"])
    tp = F.least("expected", "produced")
    return both.select(
        *PLACE, tp.alias("tp"), (F.col("expected") - tp).alias("fn"),
        (F.col("produced") - tp).alias("fp"),
    )


def quality(matched: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Recall and precision, overall or per group; 0 when nothing was expected or produced."""
    tp, fn, fp = (F.sum(c) for c in ("tp", "fn", "fp"))
    totals = matched.groupBy(*(by or [])).agg(tp.alias("tp"), fn.alias("fn"), fp.alias("fp"))

    def share(part, whole):
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return totals.withColumns(
        {
            "recall": share(F.col("tp"), F.col("tp") + F.col("fn")),
            "precision": share(F.col("tp"), F.col("tp") + F.col("fp")),
        }
    )


def negative_rate(cases: DataFrame, found: DataFrame, warned: DataFrame) -> DataFrame:
    """Share of negative cases with any finding or any unexpected warning.

    ``found`` holds produced findings, ``warned`` the matched warnings with their ``fp``.
    """
    flagged = (
        found.select("case_id").unionByName(warned.filter("fp > 0").select("case_id")).distinct()
        .withColumn("flagged", F.lit(1))
    )
    negative = cases.filter(F.col("case_id").startswith("neg_")).select("case_id")
    counted = negative.join(flagged, "case_id", "left").agg(
        F.count("*").alias("negatives"), F.coalesce(F.sum("flagged"), F.lit(0)).alias("flagged")
    )
    rate = F.when(F.col("negatives") > 0, F.col("flagged") / F.col("negatives")).otherwise(0.0)
    return counted.withColumn("negative_rate", rate)


def leaks(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings whose evidence or chain shows a sensitive literal of their case."""
    labels = cases.filter(F.size("sensitive_literals") > 0).select("case_id", "sensitive_literals")
    shown = F.concat_ws("\n", F.col("evidence"), F.array_join("evidence_chain", "\n"))
    return (
        findings.join(labels, "case_id")
        .withColumn("shown", shown)
        .withColumn(
            "leaked", F.filter("sensitive_literals", lambda x: F.contains(F.col("shown"), x))
        )
        .filter(F.size("leaked") > 0)
        .select("case_id", "rule_id", "file", "line", F.size("leaked").alias("leaks"))
    )


def compare_configurations(
    expected: DataFrame, first: DataFrame, second: DataFrame
) -> DataFrame:
    """Metrics of two rule sets on the same labels, side by side per rule."""
    a = quality(match_expected(expected, first), ["rule_id"])
    b = quality(match_expected(expected, second), ["rule_id"])
    measures = ["tp", "fn", "fp", "recall", "precision"]
    for m in measures:
        a, b = a.withColumnRenamed(m, f"{m}_first"), b.withColumnRenamed(m, f"{m}_second")
    filled = [f"{m}_{side}" for m in measures for side in ("first", "second")]
    return a.join(b, "rule_id", "full").na.fill(0, filled)


def gate_report(cases: DataFrame, expected: DataFrame, found: DataFrame,
                gates: dict | None = None) -> DataFrame:
    """Each gate with its limit, the value reached over all cases and whether it passes.

    ``found(case_id, rule_id, file, line, evidence, evidence_chain)``. Recall and precision have
    lower limits, the share of negative cases with findings and the leaks upper ones.
    """
    limits = GATES if gates is None else gates
    matched = match_expected(expected, found)
    measured = [
        (quality(matched), ["recall", "precision"]),
        (negative_rate(cases, found, matched), ["negative_rate"]),
        (leaks(cases, found).agg(F.coalesce(F.sum("leaks"), F.lit(0)).alias("leaks")), ["leaks"]),
    ]
    out = None
    for values, names in measured:
        rows = F.array(*[
            F.struct(F.lit(g).alias("gate"), F.lit(float(limits[g])).alias("limit"),
                     F.coalesce(F.col(g).cast("double"), F.lit(0.0)).alias("value"))
            for g in names if g in limits])
        own = values.select(F.inline(rows))
        out = own if out is None else out.unionByName(own)
    at_least = F.col("gate").isin("recall", "precision")
    passed = F.when(at_least, F.col("value") >= F.col("limit")).otherwise(
        F.col("value") <= F.col("limit"))
    return out.select("gate", "limit", "value", passed.alias("passed"))
