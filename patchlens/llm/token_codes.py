"""Token ids as directly addressable codes (Brisaboa, Ladra and Navarro).

An id is split into chunks of bits, lowest first, and as many as it needs. Level ``k`` holds the
``k``-th chunks of those ids that have one, beside a bitmap that says which of them go on, and a
directory of ranks: the number of set bits before each block of 512. The id at any place is read
by following ranks from level to level; nothing before it is decoded.

A table of tokens is a folder of segments, written by Spark to any store it knows. A row is
one segment: its place in the order, the documents it holds and its codes as one binary value.

Defined results: a null text is an empty one, which has the end id alone; equal doc_ids are
ordered by a hash of their texts; repeated rows stay apart; no documents give no segments; columns other
than the two named ones aren't read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm.common import part_offsets, slices
from patchlens.llm.piece_cache import shared_cache, slice_chars

MAGIC = b"DAC1"
#: Bits of each level: ids of 32 bits at most.
WIDTHS = (8, 8, 16)
RANK_BLOCK = 512
#: Kept stretches of a worker: nothing else holds memory here.
CACHE_BYTES = 96_000_000
#: Tokens after which a segment ends with the document.
SEGMENT_TOKENS = 1 << 18
SEGMENTS = ("part long, segment long, first_token long, n_tokens long, doc_ids array<long>, "
            "doc_tokens array<long>, codes binary")


def _dtype(width: int) -> str:
    return "<u1" if width <= 8 else "<u2" if width <= 16 else "<u4"


def encoded(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """A segment: magic, number of levels, then each level's width, length, chunks, bitmap, ranks."""
    rest = np.asarray(ids, dtype=np.uint64)
    out = [MAGIC, struct.pack("<I", len(widths))]
    for k, width in enumerate(widths):
        chunk = (rest & np.uint64((1 << width) - 1)).astype(_dtype(width))
        rest = rest >> np.uint64(width)
        goes_on = rest > 0
        out += [struct.pack("<IQ", width, len(chunk)), chunk.tobytes()]
        if k == len(widths) - 1:
            if goes_on.any():
                raise ValueError("an id has more bits than the levels")
            break
        blocks = -(-len(chunk) // RANK_BLOCK)
        padded = np.zeros(blocks * RANK_BLOCK, dtype=bool)
        padded[: len(chunk)] = goes_on
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(blocks, RANK_BLOCK).sum(1))])
        out += [np.packbits(padded, bitorder="little").tobytes(), ranks.astype("<u4").tobytes()]
        rest = rest[goes_on]
    return b"".join(out)


class Codes:
    """Reads a segment in place: all ids, or those at given places."""

    def __init__(self, data: bytes) -> None:
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token codes")
        (levels,), at = struct.unpack_from("<I", data, 4), 8
        self.levels = []
        for k in range(levels):
            width, n = struct.unpack_from("<IQ", data, at)
            at += 12
            chunk = np.frombuffer(data, _dtype(width), n, at)
            at += chunk.nbytes
            bits = ranks = None
            if k < levels - 1:
                blocks = -(-n // RANK_BLOCK)
                bits = np.frombuffer(data, np.uint8, blocks * RANK_BLOCK // 8, at)
                at += bits.nbytes
                ranks = np.frombuffer(data, "<u4", blocks + 1, at)
                at += ranks.nbytes
            self.levels.append((width, chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][1])

    def all(self) -> np.ndarray:
        value = np.zeros(0, dtype=np.uint32)
        for width, chunk, bits, _ in reversed(self.levels):
            upper, value = value, chunk.astype(np.uint32)
            if bits is not None and len(upper):
                on = np.unpackbits(bits, bitorder="little")[: len(chunk)].astype(bool)
                value[on] |= upper << np.uint32(width)
        return value

    def at(self, places) -> np.ndarray:
        """The ids at these places, each by ranks alone."""
        places = np.asarray(places, dtype=np.int64)
        if len(places) and (places.min() < 0 or places.max() >= len(self)):
            raise IndexError("place outside the segment")
        value, shift, live = np.zeros(len(places), dtype=np.uint64), 0, np.arange(len(places))
        for width, chunk, bits, ranks in self.levels:
            value[live] |= chunk[places].astype(np.uint64) << np.uint64(shift)
            shift += width
            if bits is None or not len(live):
                break
            on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            live, places = live[on], places[on]
            block = places // RANK_BLOCK
            own = np.unpackbits(
                bits.reshape(-1, RANK_BLOCK // 8)[block], axis=1, bitorder="little")
            before = np.arange(RANK_BLOCK) < (places % RANK_BLOCK)[:, None]
            places = ranks[block].astype(np.int64) + (own & before).sum(1, dtype=np.int64)
        return value.astype(np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, keeps_space: bool = True,
                 end_id: int = 0, segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Ids of all whole texts, each with ``end_id``, in ascending doc_id order.

    Texts are dealt by ranges of doc_id and sorted inside a range; each range is a part.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared_cache(tokenizer, keeps_space, CACHE_BYTES)
        end = np.array([end_id], dtype="<u4").tobytes()
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        keys, held, sizes, n = [], [], [], 0

        def row() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int64()), pa.array([segment], pa.int64()),
                pa.array([first], pa.int64()), pa.array([n], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
                pa.array([encoded(ids)], pa.binary())], names=names)

        for batch in slices(batches, chars=slice_chars(CACHE_BYTES), keep_caches=True):
            texts = batch.column("text").to_pylist()
            for key, ids in zip(batch.column("doc_id").to_pylist(), cache.encode(texts),
                                strict=True):
                keys.append(key)
                held += [ids, end]
                sizes.append(len(ids) // 4 + 1)
                n += sizes[-1]
                if n >= segment_tokens:
                    yield row()
                    segment, first = segment + 1, first + n
                    keys, held, sizes, n = [], [], [], 0
        if keys:
            yield row()

    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        # range bounds come from a sample of keys on the driver: short ones, no texts
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(coded, SEGMENTS)
        .write.parquet(path)
    )


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The stored segments; ``first_token`` counts from the start of the whole table."""
    stored = spark.read.schema(SEGMENTS).parquet(path)
    parts = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a part
    offsets = F.broadcast(part_offsets(spark, parts, "part", _before="n"))
    return (
        stored.join(offsets, "part")
        .withColumn("first_token", F.col("first_token") + F.col("_before"))
        .drop("_before")
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit, end id last) of each document."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys = batch.column("doc_ids")[i].values
                sizes = batch.column("doc_tokens")[i].values.to_numpy()
                ids = Codes(batch.column("codes")[i].as_py()).all().astype("<u4")
                ends = np.cumsum(sizes)
                starts = batch.column("first_token")[i].as_py() + ends - sizes
                raw = [ids[e - s:e].tobytes() for s, e in zip(sizes, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(starts, pa.int64()), pa.array(raw, pa.binary())],
                    names=["doc_id", "start", "ids"])

    segments = read_segments(spark, path).select("first_token", "doc_ids", "doc_tokens", "codes")
    return segments.mapInArrow(decoded, "doc_id long, start long, ids binary")


def tokens_at(spark: SparkSession, path: str, places: DataFrame, place: str = "place") -> DataFrame:
    """The ids at places of the whole table, read by ranks; places outside it give no row.

    Places and segments meet on the stretches of ``SEGMENT_TOKENS`` that a segment touches.
    """
    import pandas as pd

    segments = read_segments(spark, path)
    last = F.col("first_token") + F.col("n_tokens")
    spans = segments.select(
        "first_token", last.alias("last"), F.explode(F.sequence(
            F.floor(F.col("first_token") / SEGMENT_TOKENS),
            F.floor((last - 1) / SEGMENT_TOKENS))).alias("stretch"))
    asked = places.select(F.col(place).cast("long").alias("place")).distinct()
    found = asked.withColumn("stretch", F.floor(F.col("place") / SEGMENT_TOKENS)).join(
        spans, "stretch").filter("place >= first_token and place < last")

    def read(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"place": [], "token": []})
        codes = Codes(right["codes"].iloc[0])
        at = left["place"].to_numpy() - right["begins"].iloc[0]
        return pd.DataFrame({"place": left["place"], "token": codes.at(at).astype("int64")})

    return (
        found.groupBy("first_token")
        .cogroup(segments.select(F.col("first_token").alias("begins"), "codes").groupBy("begins"))
        .applyInPandas(read, "place long, token long")
    )
