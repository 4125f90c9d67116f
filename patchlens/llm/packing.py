"""Documents into sequences of bounded length: dominance reduction, then best fit.

Lengths are whole numbers up to the bound, so an instance is its histogram. The reduction of
Martello and Toth fixes, for good, sets that dominate every other set with the same document;
what is left is packed by best fit in falling order. Both work on the histogram, in runs of
equal sequences, so the work depends on the bound and not on the number of documents. Spark
numbers the pieces of each length; a piece finds its sequence by its length and number.

Defined results: a null text is an empty one, whose only id is the end id; equal doc_ids are
ordered by crc and repeated rows stay apart; no documents give no rows; other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import numbered, slices, written
from patchlens.llm.piece_cache import CACHE_BYTES, shared_cache, slice_chars

PIECES = "doc_id long, piece int, start long, length long, ids binary"
Run = tuple[tuple[int, ...], int]  # lengths in a sequence, number of such sequences


def reduced(counts: dict[int, int], bound: int) -> tuple[list[Run], dict[int, int]]:
    """Sets fixed because they dominate all others of their largest piece, and what is left.

    For a piece j, taken in falling order, let k be the most other pieces that fit beside it and
    x the largest that fits. {j} alone is best if k is 0; {j, x} if k is 1 or they fill the
    sequence; if k is 2 and the best pair a >= b beside j isn't longer than x, {j, x} again; and
    {j, a, b} if x = a and at most one piece lies between a and b in size.
    """
    left, fixed = {s: c for s, c in counts.items() if c > 0}, []
    sizes = sorted(left)

    def take(lengths: tuple[int, ...], times: int) -> None:
        fixed.append((lengths, times))
        for s in lengths:
            left[s] -= times
            if not left[s]:
                del left[s]
                del sizes[bisect_left(sizes, s)]

    def most(lengths: tuple[int, ...]) -> int:
        return min(left.get(s, 0) // lengths.count(s) for s in lengths)

    for j in sorted(left, reverse=True):
        while left.get(j, 0):
            room = bound - j
            others = lambda s: left[s] - (s == j)
            fits = [s for s in sizes[: bisect_right(sizes, room)] if others(s)]
            if not fits:
                take((j,), left[j])
                continue
            x, small, k = fits[-1], 0, 0
            for s in fits:
                n = min(others(s), (room - small) // s)
                small, k = small + n * s, k + n
                if n < others(s) or k > 2:
                    break
            # a set that dominates goes on doing so while its pieces last
            if k == 1 or x == room:
                take((j, x), most((j, x)))
                continue
            if k > 2:
                break
            a, b = _best_pair(fits, others, room)
            if x >= a + b:
                take((j, x), most((j, x)))
            elif x == a and sum(others(s) for s in fits if b < s < a) <= 1:
                take((j, a, b), most((j, a, b)))
            else:
                break
    return fixed, left


def _best_pair(fits: list[int], others, room: int) -> tuple[int, int]:
    """The two pieces a >= b of largest sum that fit; of equal sums, the largest a."""
    best = (0, 0)
    for a in reversed(fits):
        at = bisect_right(fits, min(a, room - a)) - 1
        if at >= 0 and fits[at] == a and others(a) < 2:
            at -= 1
        if at >= 0 and a + fits[at] > sum(best):
            best = (a, fits[at])
    return best


def best_fit(counts: dict[int, int], bound: int) -> list[Run]:
    """Best fit in falling order, on runs of sequences with equal contents."""
    rooms: list[int] = []  # sorted rooms of open runs, once each
    runs: dict[int, list[list]] = {}  # room to runs [lengths, times]

    def put(lengths: tuple[int, ...], times: int, room: int) -> None:
        if room not in runs:
            insort(rooms, room)
            runs[room] = []
        runs[room].append([lengths, times])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                each = bound // size
                if n >= each:
                    put((size,) * each, n // each, bound - each * size)
                if n % each:
                    put((size,) * (n % each), 1, bound - n % each * size)
                break
            room = rooms[at]
            run = runs[room][-1]
            # the tightest run stays the tightest for this length: fill it before the next
            each = min(room // size, n)
            times = min(run[1], n // each)
            run[1] -= times
            if not run[1]:
                runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            put(run[0] + (size,) * each, times, room - each * size)
            n -= times * each
    return [(tuple(lengths), times) for own in runs.values() for lengths, times in own]


def planned(counts: dict[int, int], bound: int) -> list[Run]:
    """All runs of sequences for a histogram of lengths."""
    fixed, left = reduced(counts, bound)
    return fixed + best_fit(left, bound)


def slots(runs: list[Run]) -> dict[str, np.ndarray]:
    """Stretches of equal-length pieces: the piece numbered ``first + i`` of a length goes to
    sequence ``sequence + i`` at ``offset``. Sorted by length and first number."""
    rows, used, base = [], {}, 0
    for lengths, times in runs:
        offset = 0
        for s in lengths:
            rows.append((s, used.get(s, 0), base, offset))
            used[s] = used.get(s, 0) + times
            offset += s
        base += times
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T.copy(), strict=True))


def pieces(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, bound: int,
           cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Ids of each whole text and the end id, cut only where longer than the bound."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = shared_cache(tokenizer, keeps_space, cache_bytes)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in slices(batches, chars=slice_chars(cache_bytes), keep_caches=True):
            rows = []
            for key, ids in zip(batch.column("doc_id").to_pylist(),
                                cache.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * bound)):
                    own = ids[at: at + 4 * bound]
                    rows.append((key, k, at // 4, len(own) // 4, own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        cut, PIECES)


def packed(cut: DataFrame, bound: int) -> DataFrame:
    """Every row of ``cut`` (a length column and keys) with ``sequence_id`` and ``offset``.

    The histogram has ``bound`` rows at most. Numbers inside a length come from one sort over
    all rows, so a length that a third of all pieces have is spread like any other.
    """
    spark = cut.sparkSession
    order = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")]
    rows = numbered(cut, order, "_number")
    counts = {r["length"]: r["n"] for r in
              rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = slots(planned(counts, bound))
    lengths = np.array(sorted(counts), dtype=np.int64)
    before = np.concatenate([[0], np.cumsum([counts[s] for s in lengths])])[:-1].astype(np.int64)
    shared = spark.sparkContext.broadcast((lengths, before, plan))
    others = [c for c in rows.columns if c != "_number"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, before, plan = shared.value
        starts = np.searchsorted(plan["length"], lengths)
        # stretches sorted by global number: numbers of a length follow those of shorter ones
        at_length = np.searchsorted(lengths, plan["length"])
        absolute = before[at_length] + plan["first"] if len(starts) else plan["first"]
        for batch in batches:
            number = batch.column(batch.schema.get_field_index("_number")).to_numpy()
            at = np.searchsorted(absolute, number, side="right") - 1
            sequence = plan["sequence"][at] + number - absolute[at]
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_number"]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence, pa.int64()), pa.array(plan["offset"][at], pa.int64())],
                names=[*others, "sequence_id", "offset"])

    schema = rows.drop("_number").schema.add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(found, schema)


def pack(docs: DataFrame, tokenizer: str, keeps_space: bool = False, end_id: int = 1,
         bound: int = 4096, cache_bytes: int = CACHE_BYTES) -> tuple[DataFrame, DataFrame]:
    """The written pieces with their ids, and where each goes (keys and crc32 of the ids).

    A larger cache of ids (``cache_bytes``, per worker and kind) saves time and takes memory.
    """
    own = written(pieces(docs, tokenizer, keeps_space, end_id, bound, cache_bytes), "pieces")
    keys = own.select("doc_id", "piece", "start", "length",
                      F.crc32("ids").cast("long").alias("ids_crc32"))
    return own, packed(keys, bound)


def sequences(own: DataFrame, places: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, length and ids, one group a sequence of bounded length."""
    keyed = own.withColumn("ids_crc32", F.crc32("ids").cast("long")).dropDuplicates(
        ["doc_id", "piece", "start", "length", "ids_crc32"])
    joined = places.join(keyed.select("doc_id", "piece", "length", "ids_crc32", "ids"),
                         (places.doc_id.eqNullSafe(keyed.doc_id))
                         & (places.piece == keyed.piece) & (places.length == keyed.length)
                         & (places.ids_crc32 == keyed.ids_crc32))
    parts = F.array_sort(F.collect_list(F.struct(places["offset"], "ids")))
    return joined.groupBy("sequence_id").agg(
        F.sum(places["length"]).alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"])))
        .alias("hex")).select("sequence_id", "length", F.unhex("hex").alias("ids"))
