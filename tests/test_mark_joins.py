"""Many marks are hashed in parts, and no task sorts the findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from patchlens.operators import findings as FD
from patchlens.plans import corpus as C

SF_DIR = "/root/testdata/sf0.001"


def joined(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_many_marks_give_the_same_and_sort_nothing(spark, monkeypatch):
    found = spark.range(3000).select(
        F.concat(F.lit("R"), F.col("id") % 7).alias("rule_id"), F.concat(F.lit("f"), F.col("id") % 50).alias("file"),
        (F.col("id") % 11).cast("int").alias("line"), F.lit(1.0).alias("confidence"), "id")
    marks = spark.range(400).select(
        F.concat(F.lit("R"), F.col("id") % 6).alias("rule_id"), F.concat(F.lit("f"), F.col("id") % 45).alias("file_path"),
        (F.col("id") % 5).cast("int").alias("line"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = FD.apply_marks(found, marks)
        want = sorted(map(tuple, few.collect()))
        monkeypatch.setattr(FD, "FEW_MARKS", 399)
        many = FD.apply_marks(found, marks)
        assert sorted(map(tuple, many.collect())) == want and {r[3] for r in want} == {0.5, 0.6, 1.0}
        assert "SortMergeJoin" in joined(few)
        assert "SortMergeJoin" not in joined(many) and joined(many).count("ShuffledHashJoin") == 2
        assert "SortMergeJoin" not in joined(C.order_findings(spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
