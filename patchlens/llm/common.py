"""Helpers shared by the operators of this subpackage.

Nothing here brings rows to the driver; what is collected are totals of partitions, whose
number is a setting of the job and not of the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.plans.workspace import shared_folder, written

__all__ = ["bounded_sample", "byte_words", "crc_of_ids", "dropped", "fresh_name", "numbered", "part_offsets",
           "shared_folder", "slices", "table", "written"]

#: What a Python worker keeps from task to task, as long as it goes on with the same work.
CACHES: dict = {}
#: Texts of about this many characters are worked on together inside a task.
SLICE_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def byte_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8, with A-Z in lower case.

    Bytes split at exactly these six characters and lower-case exactly A-Z.
    """
    return (text or "").encode("utf-8", "replace").lower().split()


def crc_of_ids(ids) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(np.asarray(ids, dtype="<u4").tobytes())


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = SLICE_CHARS,
           keep_caches: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text length, so that memory stays bounded.

    Spark gives workers to one operator after another: caches of the one before are dropped
    unless the task says that it uses them.
    """
    if not keep_caches:
        CACHES.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0)
        cuts = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // chars
        starts = np.flatnonzero(np.diff(cuts, prepend=-1))
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores in front until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def part_offsets(spark: SparkSession, totals: DataFrame, part: str, **sums: str) -> DataFrame:
    """Running sums before each part, in part order: one short row a part.

    ``totals`` has a row a part; ``sums`` maps a new column to the summed one. Collects one
    row a partition of the job, which is a setting and doesn't grow with its rows.
    """
    rows, at = [], dict.fromkeys(sums, 0)
    for r in sorted(totals.collect(), key=lambda r: r[part]):
        rows.append((int(r[part]), *(at[k] for k in sums)))
        for k, source in sums.items():
            at[k] += int(r[source] or 0)
    schema = ", ".join([f"`{part}` long", *(f"`{k}` long" for k in sums)])
    return spark.createDataFrame(rows, schema)


def numbered(df: DataFrame, order: list, name: str = "row_number") -> DataFrame:
    """Rows with gapless numbers from 0 in the given order, without a global window.

    Range partitions are sorted and written once; a row's number is its place in its
    partition plus the sizes of the partitions before. Rows that are equal in every column of
    ``order`` are told apart by where they were read, so a hot key spreads over partitions.
    """
    spark = df.sparkSession
    tie, part, at = (fresh_name(df, n) for n in ("_tie", "_part", "_at"))
    keys = [*order, F.col(tie)]
    ranged = (
        df.withColumn(tie, F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(part, F.spark_partition_id().cast("long"))
        .withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(tie)
    )
    kept = written(ranged, "numbered")
    before = fresh_name(df, "_before")
    offsets = part_offsets(
        spark, kept.groupBy(part).agg(F.count("*").alias("n")), part, **{before: "n"})
    # one row a partition
    return (
        kept.join(F.broadcast(offsets), part)
        .withColumn(name, F.col(at) + F.col(before))
        .drop(part, at, before)
    )


def bounded_sample(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Texts of at most ``n`` different rows, the first by hashes of key and text.

    Only hashes are ordered; the chosen ones (``n`` short rows) are sent to where texts are read.
    """
    hashes = {"h": F.xxhash64(key), "t": F.xxhash64(text)}
    chosen = df.select(*(c.alias(k) for k, c in hashes.items())).orderBy("h", "t").limit(n)
    rows = df.select(text, *(c.alias(k) for k, c in hashes.items()))
    return rows.join(F.broadcast(chosen.distinct()), ["h", "t"], "left_semi").dropDuplicates(
        ["h", "t"]).orderBy("h", "t").select(text)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by this subpackage that no result reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
