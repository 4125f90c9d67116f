"""Quality rules whose thresholds come from mergeable quantile sketches.

Each document has whole-number measures. For each language and source a sketch of each
measure counts values in log-linear bins (32 bins an octave, so a value is known to 3 percent);
sketches of parts, sources and languages merge by adding counts. From a group's quantiles
follow its thresholds: a high value is far out when it lies above the median by ``SPREADS``
times the distance from the median down to the 10th percentile, plus an allowance. The lower
half is used because junk lies in the upper one: up to half of a group may be junk without
moving its threshold. Mean word length is bounded on both sides by the 25th and 75th percentile.
A group of fewer than ``LEAST`` documents takes its language's thresholds, or those of all.

Symbols, duplicate lines and repeats are zero in most documents; where at least half of a group
has none, the spread is 0 and the allowance alone is the threshold, a fixed cutoff. That is so in
all groups of the given tables. Upper quantiles and non-zero bins do worse (figures in the README).

Thresholds are joined to the documents on language and source; a document outside any of them
isn't kept. Documents that fail the fixed base rules are left out of the sketches.

Defined results: a null text has no words and fails the base; null languages and sources are
groups of their own; ties share a bin; repeated rows count each; no rows give no rows; other
columns aren't read by ``judged``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.llm.common import slices, written

LEAST = 50
SPREADS = 4
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Measure, and what is added to its threshold (per mille; hundredths of a letter for length).
UPPER = {"symbols": 50, "dup_lines": 400, "repeats": 450}
LENGTH = "length"
LENGTH_SPREADS, LENGTH_ALLOWANCE = 4, 100
_SPACE = b" \t\n\x0b\x0c\r"
_SIGNS = b"#*$%&|<>"


def _repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    from xxhash import xxh3_64_intdigest

    n = len(words) - 2
    if n < 2:
        return 0
    w = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        p = np.uint64(0x9E3779B97F4A7C15)
        windows = (w[:n] * p + w[1:-1]) * p + w[2:]
    order = np.argsort(windows)
    same = windows[order[1:]] == windows[order[:-1]]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n + 2, dtype=bool)
    for k in range(3):
        covered[k: n + k] |= again
    return int(covered.sum())


def measures_of(text: str | None) -> tuple[int, ...]:
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    spaces = len(raw) - len(raw.translate(None, _SPACE))
    signs = len(raw) - len(raw.translate(None, _SIGNS))
    lines = [line for line in raw.split(b"\n") if line.strip(_SPACE)]
    return (len(words), len(text or "") - spaces, signs, len(lines) - len(set(lines)),
            _repeat_words(words), len(lines))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the measures of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = np.array([measures_of(t) for t in batch.column("text").to_pylist()],
                            dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "lang", "source")]
                + [pa.array(rows[:, i]) for i in range(6)],
                names=["doc_id", "lang", "source", *(c.split()[0] for c in MEASURES.split(", "))])

    own = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"),
                      F.col("source").cast("string"), F.col("text").cast("string"))
    return own.mapInArrow(count, f"doc_id long, lang string, source string, {MEASURES}")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(part: str, whole: str, scale: int = 1000) -> Column:
    return F.expr(f"({scale} * {part}) div greatest({whole}, 1)")


def with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "symbols": _share("n_symbols", "word_chars"),
        "dup_lines": _share("n_dup_lines", "n_lines"),
        "repeats": _share("n_repeat_words", "n_words"),
        LENGTH: _share("word_chars", "n_words", 100),
        "base_failed": base_failed()})


def bin_of(value: Column) -> Column:
    """Whole values below 64 as they are, above in 32 bins an octave; order is kept."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return shift * 32 + F.call_function("shiftright", value, shift.cast("int"))


def least_of_bin(number: Column) -> Column:
    shift = F.greatest(F.floor(number / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", number - shift * 32, shift).cast("long")


def sketch(df: DataFrame) -> DataFrame:
    """Counts of bins: lang, source, measure, bin, n. Sketches merge by adding counts."""
    names = [*UPPER, LENGTH]
    pairs = F.explode(F.array(*(
        F.struct(F.lit(m).alias("measure"), bin_of(F.col(m)).cast("long").alias("bin"))
        for m in names))).alias("p")
    return df.select("lang", "source", pairs).groupBy(
        "lang", "source", "p.measure", "p.bin").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, *keys: str, at: tuple[int, ...] = (10, 25, 50, 75)) -> DataFrame:
    """A row a group and measure: n and q10, q25, ... (the least value of the quantile's bin).

    A group has a few hundred bins a measure, whatever its rows.
    """
    bins = F.array_sort(F.collect_list(F.struct("bin", "n")))
    groups = sketches.groupBy(*keys, "measure").agg(F.sum("n").alias("total"), bins.alias("bins"))

    def quantile(p: int) -> Column:
        step = F.aggregate(
            "bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bin")),
            lambda acc, b: F.struct(
                (acc["seen"] + b["n"]).alias("seen"),
                F.when(acc["bin"].isNull() & ((acc["seen"] + b["n"]) * 100 >= p * F.col("total")),
                       b["bin"]).otherwise(acc["bin"]).alias("bin")))
        return least_of_bin(step["bin"])

    return groups.select(*keys, "measure", "total", *(quantile(p).alias(f"q{p}") for p in at))


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source, and the least and greatest allowed value of each measure.

    One row a language and source that occurs.
    """
    names = [*UPPER, LENGTH]

    def bounds(df: DataFrame, tag: str, *keys: str) -> DataFrame:
        wide = [F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{tag}_{m}_{c}")
                for m in names for c in ("low", "high")]
        allowance = F.coalesce(*(F.when(F.col("measure") == m, F.lit(v)) for m, v in UPPER.items()))
        high = F.when(
            F.col("measure") == LENGTH,
            F.col("q75") + LENGTH_SPREADS * (F.col("q75") - F.col("q25")) + LENGTH_ALLOWANCE,
        ).otherwise(F.col("q50") + SPREADS * (F.col("q50") - F.col("q10")) + allowance)
        low = F.when(
            F.col("measure") == LENGTH,
            F.col("q25") - LENGTH_SPREADS * (F.col("q75") - F.col("q25")) - LENGTH_ALLOWANCE)
        sums = quantiles(df, *keys).withColumn("low", low).withColumn("high", high)
        return sums.groupBy(*keys).agg(F.max("total").alias(f"{tag}_n"), *wide)

    own = bounds(sketches, "own", "lang", "source")
    of_lang = bounds(merged(sketches, "lang"), "lang", "lang").withColumnRenamed("lang", "_lang")
    # the thresholds of all documents are one row of numbers
    of_all = bounds(merged(sketches), "all")
    numbers = of_all.first()
    joined = own.join(of_lang, F.col("lang").eqNullSafe(F.col("_lang"))).withColumns(
        {c: F.lit(numbers[c] if numbers else None).cast("long") for c in of_all.columns})
    pick = lambda m, c: F.when(F.col("own_n") >= LEAST, F.col(f"own_{m}_{c}")).when(
        F.col("lang_n") >= LEAST, F.col(f"lang_{m}_{c}")).otherwise(F.col(f"all_{m}_{c}"))
    return joined.select("lang", "source", *(
        pick(m, c).alias(f"{m}_{c}") for m in names for c in ("low", "high")))


def judged(docs: DataFrame) -> DataFrame:
    """Measures, base_failed and kept of every row."""
    rows = written(with_ratios(measured(docs)), "measures")
    # counted once; languages and the whole are merged from what is written
    sketches = written(sketch(rows.filter("not base_failed")), "sketches")
    limits = written(thresholds(sketches), "thresholds")
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rows.join(
        limits, F.col("lang").eqNullSafe(F.col("_lang"))
        & F.col("source").eqNullSafe(F.col("_source")), "left")
    fits = F.lit(True)
    for m in UPPER:
        fits = fits & (F.col(m) <= F.col(f"{m}_high"))
    fits = fits & F.col(LENGTH).between(F.col(f"{LENGTH}_low"), F.col(f"{LENGTH}_high"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False)))
