"""The stored tables: schemas, appends, reads and latest-wins reports.

Tables are Parquet directories partitioned by date, so reads of a period prune files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import language
from ..operators.findings import FINDING_SCHEMA, ordered

_S, _I, _L, _D, _B, _TS = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(),
    T.TimestampType(),
)


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCHEMAS: dict[str, T.StructType] = {
    "tasks": _schema(
        task_id=_S, status=_S, task_name=_S, input_type=_S, input_path=_S, files_count=_I,
        go_files_count=_I, started_at=_TS, completed_at=_TS, duration_ms=_L, error_msg=_S,
        risk_score=_D, risk_grade=_S,
    ),
    "findings": T.StructType(
        FINDING_SCHEMA.fields + [T.StructField("bucket", _S), T.StructField("copies", _L)]
    ),
    "runs": _schema(
        task_id=_S, command=_S, backend=_S, exit_code=_I, output=_S, truncated=_B, timed_out=_B,
        duration_ms=_L, started_at=_TS,
    ),
    "decisions": _schema(
        task_id=_S, tool_name=_S, command=_S, action=_S, reason=_S, decided_at=_TS
    ),
    "reports": _schema(task_id=_S, json_report=_S, saved_at=_TS),
    "marks": _schema(id=_L, rule_id=_S, file_path=_S, line=_I, task_id=_S, created_at=_TS),
    "artifacts": _schema(
        task_id=_S, artifact_type=_S, seq=_L, file_path=_S, content=_S, size=_L, created_at=_TS
    ),
}
DATE_OF = {
    "tasks": "started_at", "findings": "found_at", "runs": "started_at",
    "decisions": "decided_at", "reports": "saved_at", "artifacts": "created_at",
}
ORDER_OF = {"runs": "started_at", "decisions": "decided_at", "artifacts": "created_at"}


def conform(df: DataFrame, name: str, defaults: dict | None = None) -> DataFrame:
    """The columns of a table in order; missing ones get their default or null."""
    defaults = defaults or {}

    def column(f) -> Column:
        value = F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))
        return value.cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in SCHEMAS[name].fields])


def append(df: DataFrame, base: str, name: str) -> None:
    out = conform(df, name)
    at = DATE_OF.get(name)
    if at is None:
        out.write.mode("append").parquet(f"{base}/{name}")
    else:
        out.withColumn("on", F.to_date(at)).write.mode("append").partitionBy("on").parquet(
            f"{base}/{name}"
        )


def read(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A stored table; columns that old files lack are null."""
    extra = [T.StructField("on", T.DateType())] if name in DATE_OF else []
    schema = T.StructType(SCHEMAS[name].fields + extra)
    return spark.read.schema(schema).parquet(f"{base}/{name}")


def task_rows(spark: SparkSession, base: str, name: str, task_id: str) -> DataFrame:
    """Rows of one task in their display order."""
    rows = read(spark, base, name).filter(F.col("task_id") == task_id)
    if name == "findings":
        return ordered(rows)
    return rows.orderBy(ORDER_OF[name]) if name in ORDER_OF else rows


def latest_reports(reports: DataFrame) -> DataFrame:
    """One report per task: the last saved wins."""
    last = F.max_by("json_report", F.struct("saved_at", "json_report"))
    return reports.groupBy("task_id").agg(
        last.alias("json_report"), F.max("saved_at").alias("saved_at")
    )


def save_result(base: str, tasks: DataFrame, findings: DataFrame, reports: DataFrame) -> None:
    """Task, findings and report of a review in one call. Tasks come last: a task is listed
    only when everything else about it is stored."""
    append(findings, base, "findings")
    append(reports, base, "reports")
    append(tasks, base, "tasks")


def write_lines(lines: DataFrame, path: str) -> None:
    """The line table by language, so that language-specific rules read only their part."""
    lines.withColumn("language", language(F.col("new_path"))).write.mode("append").partitionBy(
        "language"
    ).parquet(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """JSON report documents, one object per line."""
    documents.select("json_report").write.mode("append").text(path)
