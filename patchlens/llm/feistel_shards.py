"""A reproducible shuffle into shards: a keyed permutation of global row numbers.

A Feistel network permutes the smallest even power of two that covers the row numbers; a number
that leaves their range is permuted again until it comes back (cycle walking), which keeps it a
permutation. The new place of row ``r`` is ``p = permuted(r)``, its shard ``p mod shards`` and its
slot ``p div shards``; both can be computed from ``r`` alone, and ``r`` from them.

Law ``rows``: shard sizes differ by one row at most, for any number of rows.

Defined results: a null text has no bytes (size 16, crc 0); equal doc_ids are ordered by crc and
size, repeated rows stay apart and take neighbouring row numbers; no documents give no rows;
other columns aren't read by ``placed`` and kept by ``shuffled``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import fresh_name, numbered

ROUNDS = 6
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A round's function: the finisher of a public 64-bit generator."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of 0 to n - 1 and its inverse."""

    def __init__(self, n: int, seed: int) -> None:
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [(seed * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % 2**64
                     for k in range(1, ROUNDS + 1)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (_mixed(left, key) & self.mask), left
            else:
                left, right = right, left ^ (_mixed(right, key) & self.mask)
        return (left << self.half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, dtype=np.uint64), back)
        while (out := np.flatnonzero(x >= np.uint64(self.n))).size:
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def of(self, rows) -> np.ndarray:
        return self._walk(rows, False)

    def back(self, places) -> np.ndarray:
        return self._walk(places, True)


def shard_and_slot(rows, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Where rows of a table of ``n`` rows go."""
    place = Permutation(n, seed).of(rows)
    return place % shards, place // shards


def row_at(shard, slot, n: int, shards: int, seed: int) -> np.ndarray:
    """The row that lies there: the inverse of ``shard_and_slot``."""
    return Permutation(n, seed).back(np.asarray(slot) * shards + np.asarray(shard))


def shuffled(numbered_rows: DataFrame, n: int, shards: int, seed: int,
             number: str = "row_number") -> DataFrame:
    """The rows with ``shard`` and ``slot`` in place of their row number."""
    others = [c for c in numbered_rows.columns if c != number]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, slot = shard_and_slot(
                batch.column(batch.schema.get_field_index(number)).to_numpy(), n, shards, seed)
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != number]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(shard, pa.int32()), pa.array(slot, pa.int64())],
                names=[*others, "shard", "slot"])

    schema = numbered_rows.drop(number).schema.add("shard", "integer").add("slot", "long")
    return numbered_rows.mapInArrow(dealt, schema)


def placed(docs: DataFrame, shards: int, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; texts themselves don't move."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long")
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"),
                       crc.alias("text_crc32"))
    rows = numbered(keys, [F.col(c) for c in ("doc_id", "text_crc32", "size")])
    n = rows.count()
    return shuffled(rows, n, shards, seed)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 20) -> None:
    """All columns as a folder a shard, each row with its slot, sorted by it inside a file."""
    number = fresh_name(docs, "row_number")
    if clash := {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns are called like the placement: {sorted(clash)}")
    rows = numbered(docs, [F.col("doc_id"), F.xxhash64("text")], number)
    out = shuffled(rows, rows.count(), shards, seed, number)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard").parquet(path)
