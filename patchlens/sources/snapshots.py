"""Readers for patches and file snapshots, and what a scan leaves out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from .listing import all_files, mounted

SNIFF_BYTES = 8000


def _source_path() -> Column:
    """The path of the file a row was read from; Spark reports it as an encoded address."""
    plain = F.regexp_replace(F.input_file_name(), "^file:/*/", "/")
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


#: A path of plain folders, then patterns of names made of ``*`` and ``?`` only.
_PATTERN = re.compile(r"(/[^*?\[\]{}\\]+)((?:/[^/\[\]{}\\]*[*?][^/\[\]{}\\]*)+)")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Patch files, one row each: ``patches(task_id, diff_text)``, named by their path.

    Where tasks can list the files themselves, their number is no burden on the driver.
    """
    plain = _PATTERN.fullmatch(mounted(path) or "")
    if plain:
        root, names = plain[1].rstrip("/"), plain[2][1:]
        wanted = "".join({"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)) for c in names)
        return all_files(spark, root).filter(F.col("path").rlike(rf"\A(?s:{wanted})\z")).select(
            F.concat(F.lit(f"{root}/"), "path").alias("task_id"), F.col("content").alias("diff_text"))
    return spark.read.text(path, wholetext=True).select(
        _source_path().alias("task_id"), F.col("value").alias("diff_text")
    )


def read_files(spark: SparkSession, path: str, task_id: str, root: str | None = None) -> DataFrame:
    """Text files, one row each: ``files(task_id, path, content)``."""
    name = _source_path()
    return spark.read.text(path, wholetext=True).select(
        F.lit(task_id).alias("task_id"),
        (P.relative_to(name, root) if root else name).alias("path"),
        F.col("value").alias("content"),
    )


def in_skipped_directory(relative: Column) -> Column:
    parts = "|".join(d.replace(".", r"\.") for d in P.SKIPPED_DIRECTORIES)
    return relative.rlike(f"(?:^|/)(?:{parts})/")


def _binary_files(spark: SparkSession, root: str) -> tuple[DataFrame, Column]:
    """All files below ``root``, and their path inside it."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .load(root)
    )
    return raw, P.relative_to(F.regexp_replace("path", "^file:/*/", "/"), root)


def _small_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of files whose size and directory let them be read.

    Both filters are plain conjuncts, so the size reaches the source before any content is read.
    """
    raw, relative = _binary_files(spark, root)
    kept = raw.filter(F.col("length") <= P.MAX_FILE_BYTES).filter(~in_skipped_directory(relative))
    return kept.select(relative.alias("path"), "content")


def scan_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Every file under ``root``: ``(path, length, reason)``; reason is null for files to review.

    Paths and sizes come from the listing. Contents are read, and reduced to whether they are
    binary, only where path and size don't decide; a file that can't be read then is missing
    there and counts as ``unreadable``.
    """
    raw, relative = _binary_files(spark, root)
    head = F.substring("content", 1, SNIFF_BYTES)
    sniffed = _small_files(spark, root).select(
        "path", F.contains(head, F.lit(bytearray(b"\x00"))).alias("binary"))
    return raw.select(relative.alias("path"), "length").join(sniffed, "path", "left").select(
        "path",
        "length",
        F.when(in_skipped_directory(F.col("path")), "skipdir")
        .when(F.col("length") > P.MAX_FILE_BYTES, "oversized")
        .when(F.col("binary").isNull(), "unreadable")
        .when(F.col("binary"), "binary")
        .alias("reason"),
    )


def snapshot_files(
    spark: SparkSession, root: str, task_id: str, max_files: int | None = None
) -> DataFrame:
    """The reviewable text files of a snapshot: ``files(task_id, path, content)``.

    With ``max_files`` a larger snapshot is refused as a whole; nothing is cut off.
    """
    head = F.substring("content", 1, SNIFF_BYTES)
    kept = _small_files(spark, root).filter(~F.contains(head, F.lit(bytearray(b"\x00"))))
    if max_files is not None:
        found = kept.select("path").count()
        if found > max_files:
            raise ValueError(f"snapshot holds {found} files, more than the limit {max_files}")
    return kept.select(
        F.lit(task_id).alias("task_id"), "path", F.col("content").cast("string").alias("content")
    )


def skip_reasons(scan: DataFrame) -> DataFrame:
    return scan.filter(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count("*").alias("files")
    )
