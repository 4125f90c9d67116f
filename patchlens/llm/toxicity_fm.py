"""Toxicity by a factorization machine over hashed terms (Rendle).

Words of a text are hashed to slots; a text's score is a logistic of a bias, a weight for each
slot and, for each pair of slots, the product of their factor vectors. Pairs such as an insult
with the mention of a group get a weight of their own although each may be harmless.

The machine is fitted on at most ``ROWS`` labelled rows, the first by a hash of doc_id. Document
frequencies of slots, by label, are counted over them by Spark; at most ``SLOTS`` slots are the
model's inputs: those that tell labels apart by themselves (chi square), those that do so beside
one of the former (chi square among the rows that hold it), and the most frequent ones. Only the
first two kinds have factors: factors of plain words would learn the few toxic rows by heart.

Defined results: a null or empty text has no terms and scores the bias alone; labels other than
0 and 1 and labels of unknown documents are left out; repeated rows are scored each; without
both labels every score is the share of label 1 (0.5 without any); other columns aren't read by
``scored``, where a requested one called ``score`` gives way to the score, and kept by ``clean``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import fresh_name, slices, written

BITS = 20
SLOTS = 1024
#: Labelled rows that the machine is fitted on, at most.
ROWS = 12_000
#: Least document frequency of a slot or pair, and chi square from which one tells labels apart:
#: weaker ones are chance among so many.
LEAST_DOCS, LEAST_CHI = 5, 30
#: Slots beside which others are looked at.
PARTNERS = 64
FACTORS = 4
EPOCHS = 20
#: Decay of weights and of factors, spread of the factors at the start, first and last step.
WEIGHT_DECAY, FACTOR_DECAY, START, STEPS = 1e-3, 1e-4, 0.1, (0.02, 0.002)
_TERM = re.compile(r"[^\W\d_]+")
_CACHE_TERMS = 200_000


def held_out(doc_id: Column) -> Column:
    """Rows kept for testing: crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Terms:
    """Slots of a text's words and how often each occurs, with a bounded cache of words."""

    def __init__(self, kept: np.ndarray | None = None) -> None:
        self.place = None if kept is None else {int(s): i for i, s in enumerate(kept)}
        self.known: dict[str, int] = {}

    def _slot(self, word: str) -> int:
        slot = zlib.crc32(word.encode("utf-8", "replace")) & ((1 << BITS) - 1)
        return slot if self.place is None else self.place.get(slot, -1)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        words = _TERM.findall((text or "").lower())
        new = set(words).difference(known)
        if new:
            if len(known) > _CACHE_TERMS:
                known.clear()
                new = set(words)
            known.update((w, self._slot(w)) for w in new)
        slots = np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))
        slots, n = np.unique(slots, return_counts=True)
        return (slots[1:], n[1:]) if len(slots) and slots[0] < 0 else (slots, n)


@dataclass(frozen=True)
class Machine:
    slots: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of inputs."""
        s = x @ self.factors
        pairs = 0.5 * ((s * s).sum(1) - (x * x) @ (self.factors ** 2).sum(1))
        return 1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights + pairs, -30, 30)))


def damped(n: np.ndarray) -> np.ndarray:
    return np.log2(1 + np.minimum(n, 15))


def inputs(counts: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Rows of log-damped counts; long texts don't outweigh short ones by their length."""
    x = np.zeros((len(counts), width), dtype=np.float32)
    for row, (slots, n) in zip(x, counts, strict=True):
        row[slots] = damped(n)
    return x


def loss(machine: Machine, x: np.ndarray, y: np.ndarray) -> float:
    """Mean logistic loss with the decay of weights and factors."""
    p = machine.scores(x)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
                 + 0.5 * WEIGHT_DECAY * (machine.weights ** 2).sum()
                 + 0.5 * FACTOR_DECAY * (machine.factors ** 2).sum())


def gradients(machine: Machine, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of that loss, by bias, weights and factors."""
    off = (machine.scores(x) - y) / len(y)
    sums = x @ machine.factors
    return {
        "bias": np.array([off.sum()]),
        "weights": x.T @ off + WEIGHT_DECAY * machine.weights,
        "factors": x.T @ (off[:, None] * sums)
        - ((x * x).T @ off)[:, None] * machine.factors + FACTOR_DECAY * machine.factors}


def fitted(x: np.ndarray, y: np.ndarray, slots: np.ndarray, paired: np.ndarray | None = None,
           seed: int = 9) -> Machine:
    """Adam on small batches with falling steps; ``paired`` marks the inputs with factors."""
    rng = np.random.default_rng(seed)
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    some = np.ones((x.shape[1], 1)) if paired is None else paired.astype(float)[:, None]
    p = {"bias": np.array([np.log(share / (1 - share))]), "weights": np.zeros(x.shape[1]),
         "factors": rng.normal(0, START, (x.shape[1], FACTORS)) * some}
    if len(set(y.tolist())) < 2:
        return Machine(slots, float(p["bias"][0]), p["weights"], np.zeros_like(p["factors"]))
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step, size = 0, 64
    steps = EPOCHS * -(-len(y) // size)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), size):
            own = order[at: at + size]
            grad = gradients(Machine(slots, p["bias"][0], p["weights"], p["factors"]),
                             x[own].astype(np.float64), y[own])
            grad["factors"] *= some
            step += 1
            pace = STEPS[0] + (STEPS[1] - STEPS[0]) * step / steps
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - pace * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
    return Machine(slots, float(p["bias"][0]), p["weights"], p["factors"])


def _chi_square(a: Column, n: Column, pos: Column, rows: Column) -> Column:
    """Of the two-by-two table of presence (n rows, a of label 1) and label (pos of all rows)."""
    a, n, pos, rows = (c.cast("double") for c in (a, n, pos, rows))
    b, c = n - a, pos - a
    d = rows - n - c
    return rows * (a * d - b * c) ** 2 / (pos * (rows - pos) * n * (rows - n) + 1e-9)


def chosen_slots(counted: DataFrame, n_slots: int) -> tuple[list[int], set[int]]:
    """The model's slots in order, and those among them that have factors.

    ``counted``: label and slots of a bounded sample; at most ``n_slots`` short rows of each
    kind come to the driver.
    """
    spark = counted.sparkSession
    total = counted.agg(F.count("*").alias("n"), F.sum("label").alias("a")).first()
    seen = counted.select("label", F.explode("slots").alias("slot")).groupBy("slot").agg(
        F.sum("label").alias("a"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    own = seen.withColumn("chi", _chi_square(
        F.col("a"), F.col("n"), F.lit(total["a"] or 0), F.lit(total["n"])))
    best = own.filter(F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "slot").limit(
        n_slots // 2).collect()
    beside: list[int] = []
    partners = best[:PARTNERS]
    if partners:
        alone = spark.createDataFrame(
            [(int(r["slot"]), int(r["a"]), int(r["n"])) for r in partners],
            "partner long, pos long, rows long")
        held = F.array_intersect("slots", F.array(*(F.lit(int(r["slot"])) for r in partners)))
        met = counted.select("label", "slots", F.explode(held).alias("partner")).select(
            "label", "partner", F.explode("slots").alias("slot")).filter(
            F.col("slot") != F.col("partner")).groupBy("partner", "slot").agg(
            F.sum("label").alias("a"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
        # among the rows that hold the partner
        gain = met.join(F.broadcast(alone), "partner").withColumn("chi", _chi_square(
            F.col("a"), F.col("n"), F.col("pos"), F.col("rows")))
        beside = [r["slot"] for r in gain.groupBy("slot").agg(F.max("chi").alias("chi")).filter(
            F.col("chi") >= LEAST_CHI).orderBy(F.desc("chi"), "slot").limit(n_slots // 4).collect()]
    paired = {int(r["slot"]) for r in best} | set(map(int, beside))
    frequent = [int(r["slot"]) for r in
                seen.orderBy(F.desc("n"), "slot").limit(n_slots).collect()]
    free = n_slots - len(paired)
    rest = [x for x in frequent if x not in paired][:free]
    return sorted(paired | set(rest)), paired


def _slot_counts(rows: DataFrame) -> DataFrame:
    """order, label, slots and counts of each labelled text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in slices(batches):
            found = [terms.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), batch.column("label"),
                 pa.array([f[0] for f in found], pa.list_(pa.int64())),
                 pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                names=["place", "label", "slots", "counts"])

    return rows.mapInArrow(count, "place long, label long, slots array<long>, counts array<long>")


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = ROWS,
            n_slots: int = SLOTS) -> Machine:
    """A machine from at most ``rows`` labelled rows that aren't held out."""
    known = labels.select("doc_id", F.col(label).cast("long").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
    # at most ``rows`` short rows are sent out; texts stay where they are read
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(known), "doc_id").select(F.xxhash64("doc_id").alias("place"), "label", "text")
    counted = written(
        _slot_counts(texts).withColumn("row", F.monotonically_increasing_id()), "terms")
    slots, paired = chosen_slots(counted, n_slots)
    kept = np.array(slots, dtype=np.int64)
    # only the chosen slots of the bounded sample come to the driver, as flat arrays
    wanted = docs.sparkSession.createDataFrame(
        [(x, i) for i, x in enumerate(slots)], "slot long, at int")
    terms = counted.select("row", F.explode(F.arrays_zip("slots", "counts")).alias("p")).select(
        "row", F.col("p.slots").alias("slot"), F.col("p.counts").alias("n")).join(
        F.broadcast(wanted), "slot")  # n_slots rows
    held = terms.groupBy("row").agg(F.collect_list(F.struct("at", "n")).alias("p"))
    own = counted.select("row", "place", "label").join(held, "row", "left").orderBy(
        "place", "label", "row").select(
        F.col("label").cast("double"), F.coalesce(F.size("p"), F.lit(0)).alias("size"),
        F.col("p.at").alias("at"), F.col("p.n").alias("n")).toArrow()
    sizes = np.maximum(own.column("size").to_numpy(), 0)
    flat = {c: own.column(c).combine_chunks().flatten().to_numpy() for c in ("at", "n")}
    x = np.zeros((len(sizes), len(kept)), dtype=np.float32)
    x[np.repeat(np.arange(len(sizes)), sizes), flat["at"]] = damped(flat["n"])
    return fitted(x, own.column("label").to_numpy(), kept, np.isin(kept, sorted(paired)))


def scored(docs: DataFrame, machine: Machine, *columns: str) -> DataFrame:
    """The named columns and the score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    columns = tuple(c for c in columns if c.lower() != "score")
    name = fresh_name(docs, "_text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        terms = Terms(machine.slots)
        for batch in slices(batches, name):
            counts = [terms.of(t) for t in batch.column(name).to_pylist()]
            found = np.concatenate([
                machine.scores(inputs(counts[at: at + 1000], len(machine.slots)))
                for at in range(0, len(counts), 1000)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(columns))] + [pa.array(found.astype(float))],
                names=[*columns, "score"])

    own = docs.select(*columns, F.col("text").cast("string").alias(name))
    return own.mapInArrow(score, own.drop(name).schema.add("score", "double"))


def clean(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        terms = Terms(machine.slots)
        for batch in slices(batches, "text"):
            counts = [terms.of(t) for t in batch.column(at).to_pylist()]
            found = np.concatenate([
                machine.scores(inputs(counts[i: i + 1000], len(machine.slots)))
                for i in range(0, len(counts), 1000)])
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(keep, docs.schema)
