"""Labelled cases: a patch and a JSON label of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .listing import all_files, mounted

PLACE = "ARRAY<STRUCT<rule_id: STRING, file: STRING, line: BIGINT>>"
CASE_SCHEMA = (
    "id STRING, description STRING, category STRING, difficulty STRING, "
    f"expected_findings {PLACE}, expected_warnings {PLACE}, sensitive_literals ARRAY<STRING>"
)


def read_cases(spark: SparkSession, root: str) -> DataFrame:
    """``cases(case_id, diff_text, ...)`` from ``*.json`` and ``*.diff`` below ``root``."""
    labels, patches = _mounted_cases(spark, path) if (path := mounted(root)) else _cases(spark, root)
    return labels.join(patches, "stem").drop("stem").withColumnRenamed("id", "case_id")


def _mounted_cases(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Labels and patches of a folder that tasks list themselves."""
    files = all_files(spark, root)
    stem = F.regexp_replace("path", r"\.[a-z]+\z", "").alias("stem")
    label = F.from_json("content", f"ARRAY<STRUCT<{CASE_SCHEMA}>>")
    unreadable = F.array(F.lit(None).cast(f"STRUCT<{CASE_SCHEMA}>"))  # a row without values
    labels = files.filter(F.col("path").endswith(".json") & (F.trim("content") != "")).select(
        stem, F.explode(F.coalesce(label, unreadable)).alias("l"))
    patches = files.filter(F.col("path").endswith(".diff"))
    return labels.select("stem", "l.*"), patches.select(stem, F.col("content").alias("diff_text"))


def _cases(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The same of other stores, listed by the driver."""
    stem = F.regexp_replace(F.input_file_name(), r"\.[a-z]+\z", "")
    labels = (
        spark.read.schema(CASE_SCHEMA).option("multiLine", True)
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)
        .withColumn("stem", stem)
    )
    patches = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.diff")
        .text(root, wholetext=True)
        .select(stem.alias("stem"), F.col("value").alias("diff_text"))
    )
    return labels, patches


def expected(cases: DataFrame, column: str = "expected_findings") -> DataFrame:
    """``expected(case_id, rule_id, file, line)`` from one of the two label lists."""
    return cases.select("case_id", F.explode(column).alias("e")).select(
        "case_id", "e.rule_id", "e.file", "e.line"
    )
