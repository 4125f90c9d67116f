"""Near-duplicate documents: hash minima in bands, verified links, connected components.

A document's set is its distinct five-word shingles (words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower
case), each as a 64-bit hash; a shorter text is one shingle. Two documents are linked when
100 * intersection >= 75 * union. The steps:

1. Equal sets make one class, whatever their number; all that follows is about classes.
2. 128 universal hash minima a class, in 32 bands of 4. A link at the threshold shares a band
   but for 5 in a million cases, above it almost always.
3. Each class of a bucket is compared with its leader, the class that meets most others:
   signatures first, then the full sets. Links make components by alternating large-star and small-star.
4. Where a bucket still holds several components, every class outside its leader's component
   is compared with all the others in it, signatures and full sets in blocks, so no pair of a
   bucket is left out and none is written down but links. These join the components.

Defined results: a null, empty or blank text has an empty set, is linked with nothing and kept;
a null doc_id belongs to its text's component but never names it; equal doc_ids with different
texts are different documents; repeated rows share a component; no rows give no rows; columns
other than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import byte_words, dropped, fresh_name, shared_folder, slices, written

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
#: Estimates from 128 minima stray by 0.04 (one deviation) at the threshold: five of them.
LEAST_ESTIMATE = PERCENT / 100 - 0.2
#: Classes compared with each other inside one block of a bucket.
BLOCK = 256
#: Up to so many keys (8 bytes each) a list of documents is sent to all executors.
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text."""
    from xxhash import xxh3_64_intdigest

    words = byte_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    span = min(SHINGLE, len(w))
    n = len(w) - span + 1
    with np.errstate(over="ignore"):
        h = np.full(n, span, dtype=np.uint64)
        for k in range(span):
            h = h * _P + w[k: k + n]
    return np.unique(_mix(h))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value under each universal hash function, upper 32 bits."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 512):
            least = np.minimum(least, (hashes[at: at + 512, None] * _A + _B).min(0))
    return (least >> np.uint64(32)).astype("<u4")


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key for each row and band; keys of different bands differ."""
    rows = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
        for k in range(ROWS):
            key = _mix(key * _P + rows[:, :, k])
    return key.view(np.int64)


def _digest(hashes: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(hashes.tobytes())


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, digest of the set and signature (null when empty)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, digests, marks = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text)
                sizes.append(len(hashes))
                digests.append(_digest(hashes) if len(hashes) else None)
                marks.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(marks, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "digest", "signature"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                      F.xxhash64("text").alias("text_key"))
    return own.mapInArrow(sketch, "doc_id long, text_key long, n_shingles long, digest binary, "
                                  "signature binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """(band, digest) of every class."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4")
            keys = band_keys(marks)
            at = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), batch.column("digest").take(pa.array(at))],
                names=["band", "digest"])

    return classes.select("digest", "signature").mapInArrow(keyed, "band long, digest binary")


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree in enough places."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(
                batch.num_rows, -1) for c in ("x", "y"))
            near = (x == y).mean(1) >= LEAST_ESTIMATE
            yield batch.select(["a", "b"]).filter(pa.array(near))

    joined = pairs.join(
        classes.select(F.col("digest").alias("a"), F.col("signature").alias("x")), "a").join(
        classes.select(F.col("digest").alias("b"), F.col("signature").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(close, "a binary, b binary")


def _needed(docs: DataFrame, classes: DataFrame, digests: DataFrame) -> DataFrame:
    """Written sets of these classes: digest, shingles."""
    wanted = written(
        classes.join(digests.distinct(), "digest").select("doc_id", "text_key"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                      F.xxhash64("text").alias("text_key"))
    own = own.join(
        wanted.withColumnsRenamed({"doc_id": "id", "text_key": "key"}),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingle_hashes(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(_digest, found), pa.binary()),
                 pa.array((h.tobytes() for h in found), pa.binary())],
                names=["digest", "shingles"])

    found = own.select("text").mapInArrow(sets, "digest binary, shingles binary")
    return written(found.dropDuplicates(["digest"]), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Written pairs (a, b), a < b, whose full sets are alike enough."""
    ends = pairs.select(F.col("a").alias("digest")).union(pairs.select("b"))
    sets = _needed(docs, classes, ends)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = pairs.join(
        sets.withColumnsRenamed({"digest": "a", "shingles": "x"}), "a").join(
        sets.withColumnsRenamed({"digest": "b", "shingles": "y"}), "b")
    return written(
        joined.select("a", "b", "x", "y").mapInArrow(exact, "a binary, b binary"), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b), by large-star and small-star in turn.

    A node's least neighbour is an aggregate, and joins carry it to the links, so the links of
    a node with very many never meet in one group. Ends when a round changes nothing.
    """
    spark = links.sparkSession

    def stored(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = shared_folder(spark, "stars")
        df.write.parquet(path)
        df = spark.read.schema(df.schema).parquet(path)
        mark = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return df, path, tuple(mark)

    # every link points from the greater to the smaller node
    now, path, mark = stored(links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        large, large_path, _ = stored(large.filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        new, new_path, new_mark = stored(small.distinct())
        dropped(spark, path, large_path)
        done, now, path, mark = new_mark == mark, new, new_path, new_mark
        if done:
            break
    return now.withColumnsRenamed({"a": "node", "b": "root"})


def _left_over(members: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates of buckets that still hold several components, found in blocks.

    Every class outside the component of the bucket's leader meets all others there that are in
    another component than its own. Rows: block (band, o, m), digest of a class that has a
    candidate, and the others it may be linked with; a pair is named once, in the first band that
    it shares.
    """
    placed = members.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn(
        "root", F.coalesce("root", "digest"))
    leaders = roots.withColumnsRenamed({"node": "leader", "root": "first"})
    placed = placed.join(leaders, "leader", "left").withColumn(
        "outside", F.col("root") != F.coalesce("first", "leader"))
    mixed = placed.groupBy("band").agg(
        F.count("*").alias("n"), F.sum(F.col("outside").cast("long")).alias("n_out")).filter(
        "n > 2 and n_out > 0").select(
        "band", F.ceil(F.col("n") / BLOCK).alias("m_blocks"),
        F.ceil(F.col("n_out") / BLOCK).alias("o_blocks"))
    rows = placed.join(mixed, "band").join(classes.select("digest", "signature"), "digest")
    hashed = F.abs(F.xxhash64("digest", F.lit(1)) % (1 << 40))
    columns = ("band", "digest", "root", "signature", "outside")
    every = rows.select(*columns, F.lit(False).alias("asks"), (hashed % F.col("m_blocks")).alias("m"),
                        F.explode(F.sequence(F.lit(0), F.col("o_blocks") - 1)).alias("o"))
    out = rows.filter("outside").select(
        *columns, F.lit(True).alias("asks"),
        F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("m"),
        (hashed % F.col("o_blocks")).alias("o"))

    def met(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        left, right = block[block["asks"]], block[~block["asks"]]
        found = []
        if len(left) and len(right):
            x, y = (np.frombuffer(b"".join(s["signature"]), "<u4").reshape(len(s), -1)
                    for s in (left, right))
            kx, ky = band_keys(x), band_keys(y)
            names = [bytes(d) for d in right["digest"]]
            roots, outside = [bytes(r) for r in right["root"]], right["outside"].tolist()
            named = set()
            for mark, keys, name, root in zip(x, kx, left["digest"], left["root"], strict=True):
                shared = ky == keys
                here = keys[shared.argmax(1)] == key[0]
                near = np.flatnonzero(here & ((y == mark).mean(1) >= LEAST_ESTIMATE))
                name, root = bytes(name), bytes(root)
                own = [names[i] for i in near
                       if roots[i] != root and not (outside[i] and names[i] < name)]
                if own:
                    found.append((*key, name, own))
                    named.update(own)
            found += [(*key, name, []) for name in named]
        return pd.DataFrame(found, columns=["band", "o", "m", "digest", "others"])

    return out.unionByName(every).groupBy("band", "o", "m").applyInPandas(
        met, "band long, o long, m long, digest binary, others array<binary>")


def _confirmed_blocks(lists: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Written links (a, b) that join the classes of each block which full sets confirm.

    Sets are compared inside the block, so pairs that aren't links are nowhere written down,
    and links inside a part that others already join aren't either.
    """
    key = ("band", "o", "m")
    inside = lists.select(*key, "digest").distinct()
    sets = _needed(docs, classes, inside.select("digest"))

    def confirm(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = {bytes(d): np.frombuffer(s, np.uint64)
               for d, s in zip(right["digest"], right["shingles"], strict=True)}
        above = {d: d for d in own}

        def top(d: bytes) -> bytes:
            while above[d] != d:
                above[d] = d = above[above[d]]
            return d

        links = []
        for a, others in zip(left["digest"], left["others"], strict=True):
            x = own[bytes(a)]
            for b in map(bytes, others):
                i, j = top(bytes(a)), top(b)
                if i == j:
                    continue
                y = own[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= PERCENT * (len(x) + len(y) - both):
                    above[i] = j
                    links.append((bytes(a), b))
        return pd.DataFrame(links, columns=["a", "b"])

    own_key = [f"own_{k}" for k in key]
    held = inside.join(sets, "digest").toDF("digest", *own_key, "shingles")
    return written(lists.groupBy(*key).cogroup(held.groupBy(*own_key)).applyInPandas(
        confirm, "a binary, b binary"), "more")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, component_id and kept of every row."""
    return _with_first(docs).drop("first")


def _with_first(docs: DataFrame) -> DataFrame:
    """The same, and whether a row is the first of its component by doc_id, nulls last, and text_key."""
    marks = written(sketches(docs), "sketches")
    full = marks.filter("n_shingles > 0")
    # copies of a text have one class; its document is the least of them
    classes = written(full.groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("least"),
        F.first("signature").alias("signature")).select(
        "digest", "least.doc_id", "least.text_key", "signature"), "classes")
    buckets = written(_buckets(classes), "buckets")
    several = buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(buckets.join(several, "band"), "members")
    # the class that meets most others leads: an original rather than one of its variants
    degrees = members.groupBy("digest").agg(F.sum("n").alias("degree"))
    leaders = members.join(degrees, "digest").groupBy("band").agg(
        F.max(F.struct("degree", "digest")).alias("top")).select(
        "band", F.col("top.digest").alias("leader"))
    members = written(members.drop("n").join(leaders, "band"), "led")
    stars = written(members.filter("digest <> leader").select(
        F.least("leader", "digest").alias("a"), F.greatest("leader", "digest").alias("b")).distinct(),
        "pairs")
    links = _confirmed(written(_alike(stars, classes), "alike"), docs, classes)
    roots = components(links)
    more = written(_left_over(members, roots, classes), "lists")
    if not more.isEmpty():
        roots = components(links.union(_confirmed_blocks(more, docs, classes)))
    named = classes.join(roots.withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", F.coalesce("root", "digest").alias("root"), F.col("doc_id").alias("own"),
        F.struct(F.col("doc_id").isNull(), "doc_id", "text_key").alias("name"))
    least = named.groupBy("root").agg(
        F.min("own").alias("component_id"), F.min("name").alias("top"))
    of_class = named.join(least, "root").select(
        "digest", "component_id", F.col("top.doc_id").alias("_top"), F.col("top.text_key").alias("_top_key"))
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return marks.drop("signature").join(of_class, "digest", "left").select(
        "doc_id", "text_key", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
        (F.col("doc_id").eqNullSafe(F.col("_top")) & (F.col("text_key") == F.col("_top_key"))).alias("first"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each component, all columns as they are.

    Of rows that are repeated with equal doc_id and text one stays.
    """
    found = written(_with_first(docs), "near").filter("n_shingles > 0")
    doc, key = fresh_name(docs, "_id"), fresh_name(docs, "_key")
    keys = written(found.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(
        F.max("first").alias("kept"), F.count("*").alias("n")).filter("n > 1 or not kept"),
        "changed")
    gone, again = keys.filter("not kept").select(doc, key), keys.filter("kept").select(doc, key)
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key))

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df

    left = docs.join(small(gone), same, "left_anti")
    if again.isEmpty():
        return left
    once = left.join(small(again), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(small(again), same, "left_anti").unionByName(once)
