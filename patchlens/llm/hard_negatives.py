"""Hard negatives of anchors, by bounds along a spanning tree of the anchors.

Rows are vectors of whole numbers with a label; a score is an inner product. An anchor's
positives are its best rows of the same label, and a positive's hard negatives the best rows of
other labels whose scores lie in a window below the positive's.

Anchors that lie close to each other (by the nearest of some pivots) are put into blocks of
``BLOCK``; each block has a minimum spanning tree. With the root a candidate is scored; from a
parent ``p`` to its child ``c`` the score moves by ``|c - p| * |x|`` at most, so a child's score
is known to lie in an interval. Only candidates whose interval meets the child's window are
scored again, which makes the interval a point for the children below. Windows are exact: for
positives all that may still be among the best, for negatives the stretch between the lowest and
the highest score wanted. So nothing is lost, whatever the bounds are worth.

Anchors are gone through in rounds of ``ROUND_BYTES`` of vectors, which are sent to all tasks;
every round reads the candidates once for positives and once for negatives, and a task keeps only
the best rows of each anchor. Nothing is shuffled but these.

Defined results: rows with a null vec_id, label or vector, or a null or non-finite component,
take no part; a shorter vector counts as one with zeros behind; rows of the anchor's own vec_id
aren't its positives; repeated rows stay apart; an anchor without positives, or a positive
without a row in its window, gives no rows; other columns aren't read. Scores beyond 64 bits are
an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.llm.common import numbered, written

#: Anchors of a tree, pivots that bring near ones together, candidates worked on at once.
BLOCK, PIVOTS, CANDIDATES = 1024, 64, 2048
#: Vectors of anchors sent out at once: the rounds grow in number, not in size.
ROUND_BYTES = 16_000_000
SCALE = 256
_TREE = ("block long, anchors array<long>, ids array<long>, labels array<long>, "
         "parents array<long>, edges array<double>, vectors binary")
_POSITIVES = "anchor long, anchor_id long, positive_id long, positive_score long"
_NEGATIVES = f"{_POSITIVES}, place long, negative_id long, negative_score long"


@dataclass(frozen=True)
class Limits:
    """How many rows are wanted, and a negative's score in percent of the positive's."""

    positives: int = 5
    negatives: int = 3
    least_percent: int = 50
    most_percent: int = 95


def quantized(rows: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label and ``q``, the whole numbers floor(scale * x), of rows that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return (
        rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.alias("x"))
        .filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()
                & ~F.exists("x", bad))
        .select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("q"))
    )


def matrix(lists: pa.Array, dims: int, kind: str) -> np.ndarray:
    """Rows of a list column, zeros behind shorter ones."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return values.reshape(-1, dims).astype(kind)
    out = np.zeros((len(sizes), dims), dtype=kind)
    out[np.arange(dims) < sizes[:, None]] = values
    return out


def spanning_tree(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order (parents first), parent of each in that order (-1: root) and length of its edge.

    Prim's algorithm from the row nearest the mean.
    """
    v = vectors.astype(np.float64)
    n = len(v)
    root = int(((v - v.mean(0)) ** 2).sum(1).argmin())
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near, distance = np.full(n, -1), np.full(n, np.inf)
    at = root
    place = np.full(n, -1)
    for k in range(n):
        order[k], place[at] = at, k
        if k:
            parent[k], edge[k] = place[near[at]], np.sqrt(distance[at])
        distance[at] = np.inf
        own = ((v - v[at]) ** 2).sum(1)
        closer = (own < distance) & (place < 0)
        closer |= (place < 0) & (near < 0)
        distance[closer], near[closer] = own[closer], at
        if k + 1 < n:
            at = int(np.where(place < 0, distance, np.inf).argmin())
            if place[at] >= 0:  # all distances left are infinite
                at = int(np.flatnonzero(place < 0)[0])
    return order, parent, edge


def trees(anchors: DataFrame, dims: int, kind: str) -> DataFrame:
    """One row a block of at most ``BLOCK`` neighbouring anchors, in the order of its tree."""
    spark = anchors.sparkSession
    pivots = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").select("q").limit(PIVOTS)
    pivots = matrix(pa.array([r["q"] for r in pivots.collect()], pa.list_(pa.int64())),
                    dims, "f8")
    shared = spark.sparkContext.broadcast(pivots)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = shared.value
        for batch in batches:
            v = matrix(batch.column(2), dims, "f8")
            away = (v ** 2).sum(1)[:, None] - 2 * v @ near.T + (near ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(away.argmin(1)), pa.array(away.min(1))],
                names=[*batch.schema.names, "pivot", "away"])

    near = anchors.mapInArrow(
        placed, "vec_id long, label long, q array<long>, pivot long, away double")
    ordered = numbered(near, [F.col(c) for c in ("pivot", "away", "vec_id")], "anchor")

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("anchor")
        v = matrix(pa.array(list(rows["q"]), pa.list_(pa.int64())), dims, kind)
        order, parent, edge = spanning_tree(v)
        listed = lambda c: rows[c].to_numpy()[order]
        return pd.DataFrame({
            "block": [rows["block"].iloc[0]], "anchors": [listed("anchor")],
            "ids": [listed("vec_id")], "labels": [listed("label")], "parents": [parent],
            "edges": [edge], "vectors": [np.ascontiguousarray(v[order]).tobytes()]})

    blocks = ordered.withColumn("block", F.floor(F.col("anchor") / BLOCK))
    return written(blocks.groupBy("block").applyInPandas(tree, _TREE), "anchor-trees")


class Tree:
    """A block of anchors; walks its tree for some candidates at a time."""

    def __init__(self, row, dims: int, kind: str) -> None:
        self.anchors, self.ids = np.array(row["anchors"]), np.array(row["ids"])
        self.labels, self.parents = np.array(row["labels"]), np.array(row["parents"])
        self.edges = np.array(row["edges"], dtype=np.float64)
        self.vectors = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, dims)
        self.norms = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(1))

    def __len__(self) -> int:
        return len(self.anchors)

    def walk(self, x: np.ndarray, lowest: np.ndarray, highest: np.ndarray, wanted):
        """For each anchor: its place, the candidates in its window and their scores.

        ``wanted(k)`` tells which candidates may be scored for anchor k at all; ``lowest`` and
        ``highest`` are its window at the time it is reached (an empty one asks for nothing).
        """
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        low, high = np.empty((len(self), len(x))), np.empty((len(self), len(x)))
        for k in range(len(self)):
            own = self.vectors[k]
            p = self.parents[k]
            if p < 0:
                low[k] = high[k] = x @ own
            elif not self.edges[k]:
                low[k], high[k] = low[p], high[p]
            else:
                # the last term is for rounding
                step = norms * (self.edges[k] * (1 + 1e-9) + 1e-12 * self.norms[k])
                np.subtract(low[p], step, out=low[k])
                np.add(high[p], step, out=high[k])
            if lowest[k] > highest[k]:
                continue
            open_ = np.flatnonzero((high[k] >= lowest[k]) & (low[k] <= highest[k]) & wanted(k))
            if not len(open_):
                continue
            known = low[k][open_] == high[k][open_]
            if known.all() and x.dtype.kind == "f":
                scores = low[k][open_]
            else:
                scores = x[open_] @ own
                low[k][open_] = high[k][open_] = scores
            inside = (scores >= lowest[k]) & (scores <= highest[k])
            if inside.any():
                yield k, open_[inside], scores[inside]


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n by falling score, then rising id."""
    if len(scores) > 8 * n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        kept = scores >= least
        scores, ids = scores[kept], ids[kept]
    order = np.lexsort((ids, -scores))[:n]
    return scores[order], ids[order]


def _blocks_of(batches: Iterator[pa.RecordBatch], dims: int, kind: str):
    """vec_ids, labels and vectors of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, CANDIDATES):
            own = batch.slice(at, CANDIDATES)
            yield (own.column(0).to_numpy(), own.column(1).to_numpy(),
                   matrix(own.column(2), dims, kind))


def _positives(batches, forest: list[Tree], dims: int, kind: str, limits: Limits):
    n, nothing = limits.positives, (np.empty(0, kind), np.empty(0, np.int64))
    best = [[nothing] * len(t) for t in forest]
    lowest = [np.full(len(t), -np.inf) for t in forest]
    for ids, labels, x in _blocks_of(batches, dims, kind):
        for tree, own, low in zip(forest, best, lowest, strict=True):
            every = np.full(len(tree), np.inf)

            def wanted(k: int, t: Tree = tree, labels=labels, ids=ids) -> np.ndarray:
                return (labels == t.labels[k]) & (ids != t.ids[k])

            for k, rows, scores in tree.walk(x, low, every, wanted):
                own[k] = _best(np.concatenate([own[k][0], scores]),
                               np.concatenate([own[k][1], ids[rows]]), n)
                if len(own[k][0]) == n:
                    low[k] = own[k][0][-1]
    for tree, own in zip(forest, best, strict=True):
        for k, (scores, found) in enumerate(own):
            for s, i in zip(scores.tolist(), found.tolist(), strict=True):
                yield int(tree.anchors[k]), int(tree.ids[k]), i, int(s)


def _negatives(batches, forest: list[Tree], windows: list[list], dims: int, kind: str,
               limits: Limits):
    """``windows``: for each tree and anchor (place, positive_id, score, least, most)."""
    n, nothing = limits.negatives, (np.empty(0, kind), np.empty(0, np.int64))
    best = [[[nothing] * len(w) for w in own] for own in windows]
    lowest = [np.array([min((x[3] for x in w), default=1.0) for w in own]) for own in windows]
    highest = [np.array([max((x[4] for x in w), default=0.0) for w in own]) for own in windows]
    for ids, labels, x in _blocks_of(batches, dims, kind):
        for tree, kept, own, low, high in zip(forest, windows, best, lowest, highest, strict=True):
            wanted = lambda k, t=tree, labels=labels: labels != t.labels[k]
            for k, rows, scores in tree.walk(x, low, high, wanted):
                order = np.lexsort((ids[rows], -scores))
                scores, found = scores[order], ids[rows][order]
                still = np.inf
                for at, (_, _, _, least, most) in enumerate(kept[k]):
                    a = np.searchsorted(-scores, -most)
                    b = min(np.searchsorted(-scores, -least, side="right"), a + n)
                    if b > a:
                        own[k][at] = _best(np.concatenate([own[k][at][0], scores[a:b]]),
                                           np.concatenate([own[k][at][1], found[a:b]]), n)
                    full = len(own[k][at][0]) == n
                    still = min(still, own[k][at][0][-1] if full else least)
                low[k] = still
    for tree, kept, own in zip(forest, windows, best, strict=True):
        for k, lists in enumerate(own):
            for (place, positive, score, *_), (scores, found) in zip(kept[k], lists, strict=True):
                for s, i in zip(scores.tolist(), found.tolist(), strict=True):
                    yield (int(tree.anchors[k]), int(tree.ids[k]), positive, score, place, i,
                           int(s))


def _table(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    names, held = [c.split()[0] for c in schema.split(", ")], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*held, strict=True)], names=names)

    for row in rows:
        held.append(row)
        if len(held) == 50_000:
            yield batch()
            held = []
    if held:
        yield batch()


def first_of(rows: DataFrame, n: int, by: list[str], score: str, key: str, rank: str) -> DataFrame:
    """The first n rows of each group by falling score and rising key, with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc(score), key)
    return rows.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)


def mined(vectors: DataFrame, is_anchor: Column, limits: Limits = Limits()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, label, q as from ``quantized``.
    """
    spark = vectors.sparkSession
    rows = written(vectors.select("vec_id", "label", "q"), "vectors")
    size = rows.agg(
        F.max(F.size("q")).alias("dims"),
        F.max(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))).alias("most")).first()
    dims, most = max(size["dims"] or 0, 1), size["most"] or 0
    if dims * most * most >= 1 << 63:
        raise ValueError("inner products of these vectors don't fit into 64 bits")
    # doubles are exact as long as no sum leaves 53 bits
    kind = "f8" if dims * most * most < 1 << 53 else "i8"
    blocks = trees(rows.filter(is_anchor), dims, kind)
    n_blocks = blocks.count()
    each = max(1, ROUND_BYTES // (BLOCK * dims * 8))
    found = [_round(spark, rows, blocks.filter(F.col("block").between(at, at + each - 1)),
                    dims, kind, limits) for at in range(0, n_blocks, each)]
    if not found:
        return spark.createDataFrame(
            [], "anchor_id long, positive_id long, rank int, negative_id long, "
                "positive_score long, negative_score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _round(spark, rows: DataFrame, blocks: DataFrame, dims: int, kind: str,
           limits: Limits) -> DataFrame:
    """The result for some blocks; what is collected has a bound: their anchors and positives."""
    chosen = blocks.orderBy("block").collect()
    shared = spark.sparkContext.broadcast(chosen)

    def positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = [Tree(r, dims, kind) for r in shared.value]
        return _table(_positives(batches, forest, dims, kind, limits), _POSITIVES)

    pairs = first_of(rows.mapInArrow(positives, _POSITIVES), limits.positives, ["anchor"],
                     "positive_score", "positive_id", "place").collect()
    wanted: dict[int, list[tuple]] = {}
    for r in sorted(pairs, key=lambda r: (r["anchor"], r["place"])):
        s = r["positive_score"]
        least, top = -(-limits.least_percent * s // 100), limits.most_percent * s // 100
        if least <= top:
            wanted.setdefault(r["anchor"], []).append((r["place"], r["positive_id"], s, least, top))
    windows = spark.sparkContext.broadcast(
        [[wanted.get(a, []) for a in r["anchors"]] for r in chosen])

    def negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = [Tree(r, dims, kind) for r in shared.value]
        return _table(
            _negatives(batches, forest, windows.value, dims, kind, limits), _NEGATIVES)

    best = first_of(rows.mapInArrow(negatives, _NEGATIVES), limits.negatives,
                    ["anchor", "place"], "negative_score", "negative_id", "rank")
    return written(best.select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score",
        "negative_score"), "hard-negatives")
