from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))

from patchlens.sources import lines as L  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def file_lines(spark):
    """Line table of whole files given as {path: text}; all in task ``t``."""

    def build(files: dict[str, str]):
        rows = [("t", path, text) for path, text in files.items()]
        return L.lines_of_files(
            spark.createDataFrame(rows, "task_id string, path string, content string")
        )

    return build


@pytest.fixture(scope="session")
def patch_lines(spark):
    def build(text: str, strict: bool = False):
        df = spark.createDataFrame([("t", text)], "task_id string, diff_text string")
        return L.lines_of_patches(df, strict)

    return build


@pytest.fixture(scope="session")
def found():
    """(check, file, line) of a hits table, sorted."""

    def rows(hits):
        return sorted((r["check"], r["new_path"], r["line"]) for r in hits.collect())

    return rows
