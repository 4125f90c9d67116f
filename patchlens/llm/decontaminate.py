"""Benchmark items inside documents: MinHash containment search, exactly verified.

An item is found in a document when the document has at least three quarters of the item's
distinct five-word shingles, in any order and place (lower-cased words ``[^\\x20\\x09-\\x0D]+``; a
shorter text is one shingle). Only DataFrame and SQL functions run on the main path.

Documents are partitioned by size: one of up to ``2^p`` shingles keeps the least hash of each of
``2^p / load`` ranges of hash values, so long texts keep proportionally more and a short item
is as likely to be met in them as in short ones. With n shingles shared, all are missed with
probability ``(1 - (1 - e^-load) / load)^n``; the load is the largest power of two for which
that stays below ``MISS`` for the smallest item, or none, where every hash is kept. A kept hash
that belongs to an item makes a candidate; candidates are verified on the shingles themselves.

Arrays are exploded with ``explode_outer``: for ``explode`` Spark adds a filter on the array, which
it moves below and there builds the array's expressions into one another.

Defined results: null or blank texts and items have no shingles and are never found; a null doc_id
is a document like others; of rows with the same doc_id the best counts; repeated items are found
each under its id; no items or no documents give no rows; other columns aren't read by ``found``
and kept by ``decontaminated``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import fresh_name, written

SHINGLE = 5
PERCENT = 75
#: Chance to miss an item that is just found.
MISS = 1e-6
#: Up to so many rows an index of items or a list of candidates is sent to all executors.
BROADCAST_ROWS = 500_000


def _bare(text: Column) -> Column:
    return F.trim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))


def _per_shingle(make) -> Column:
    """An array of ``make(i)`` for each place i of the column ``words``."""
    last = F.greatest(F.size("words") - SHINGLE, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), make)


def _hashes() -> Column:
    return _per_shingle(lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(SHINGLE))))


def _shingles() -> Column:
    return _per_shingle(lambda i: F.array_join(F.slice("words", i + 1, SHINGLE), " "))


def _texts(df: DataFrame, *keys: str) -> DataFrame:
    """Keys and words of the rows that have words."""
    bare = df.select(*keys, _bare(F.col("text").cast("string")).alias("bare"))
    return bare.filter("bare <> ''").select(
        *keys, F.split("bare", "[\\x20\\x09-\\x0D]+").alias("words"))


def _load(least_size: int) -> float | None:
    """The largest allowed load, or None when every hash has to be kept."""
    shared = math.ceil(PERCENT * least_size / 100)
    for power in range(3, -3, -1):
        load = 2.0 ** power
        if (1 - (1 - math.exp(-load)) / load) ** shared <= MISS:
            return load
    return None


def _minima(load: float | None) -> Column:
    """The least hash of each range of hash values; ranges follow from the text's size."""
    if load is None:
        return F.array_distinct("hashes")
    bits = F.length(F.bin(F.size("hashes").cast("long"))) - int(math.log2(load))
    shift = 64 - F.greatest(F.lit(1), F.least(F.lit(63), bits))

    def first_of_range(x: Column, i: Column) -> Column:
        before = F.get("sorted", i - 1)
        return (i == 0) | (F.call_function("shiftright", x, F.col("shift"))
                           != F.call_function("shiftright", before, F.col("shift")))

    return F.filter("sorted", first_of_range), shift


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(items: DataFrame) -> DataFrame:
    """Written (item_id, shingle, hash, n_shingles) of each distinct item and shingle."""
    rows = _texts(items, "item_id").select(
        "item_id", F.explode_outer(F.arrays_zip(_shingles().alias("shingle"), _hashes().alias("hash")))
        .alias("s")).select("item_id", "s.shingle", "s.hash").distinct()
    sizes = rows.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    return written(rows.join(sizes, "item_id"), "items")


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), item_id, n_shingles of the item, n_found."""
    index = item_shingles(items)
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    n_rows, least = index.agg(F.count("*"), F.min("n_shingles")).first()
    load = _load(least or 1)
    hashed = _texts(own, "doc_id", "text_key").select("doc_id", "text_key", _hashes().alias("hashes"))
    if load is None:
        kept = hashed.select("doc_id", "text_key", _minima(None).alias("minima"))
    else:
        minima, shift = _minima(load)
        kept = hashed.select("doc_id", "text_key", F.sort_array("hashes").alias("sorted"),
                             shift.alias("shift")).select(
            "doc_id", "text_key", minima.alias("minima"))
    met = kept.select("doc_id", "text_key", F.explode_outer("minima").alias("hash")).join(
        _small(index.select("hash", "item_id").distinct(), n_rows), "hash")
    candidates = written(met.select("doc_id", "text_key", "item_id").distinct(), "candidates")
    texts = candidates.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    asked = own.join(
        _small(texts, texts.count()),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_semi")
    inside = _texts(asked, "doc_id", "text_key").select(
        "doc_id", "text_key", F.explode_outer(F.array_distinct(_shingles())).alias("shingle"))
    counted = inside.join(
        _small(index.select("shingle", "item_id", "n_shingles"), n_rows), "shingle").groupBy(
        "doc_id", "text_key", "item_id").agg(
        F.count_distinct("shingle").alias("n_found"), F.first("n_shingles").alias("n_shingles"))
    # candidates come from the search; what is counted outside it isn't a result
    pairs = candidates.withColumnsRenamed({"doc_id": "id", "text_key": "key", "item_id": "item"})
    return counted.filter(F.col("n_found") * 100 >= F.col("n_shingles") * PERCENT).join(
        pairs, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
        & F.col("item_id").eqNullSafe(F.col("item")), "left_semi")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found: each item found in each document."""
    return found(docs, items).groupBy("doc_id", "item_id").agg(
        F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"))


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found, all columns as they are."""
    doc, key = fresh_name(docs, "_id"), fresh_name(docs, "_key")
    gone = written(found(docs, items).select(
        F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct(), "contaminated")
    return docs.join(
        _small(gone, gone.count()),
        F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left_anti")
