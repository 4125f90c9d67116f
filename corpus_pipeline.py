"""A cleaning pipeline for training text: five operators, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; its
result is written as Parquet and read again as the next one's input. All but the last return
the columns of ``documents``; the last returns where each piece of each document is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from patchlens.llm import decontaminate, near_dedup, packing, pii_spans, toxicity_fm
from patchlens.llm.common import shared_folder, table
from patchlens.llm.piece_cache import tokenizer_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine rejects go."""
    machine = toxicity_fm.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity_fm.clean(docs, machine)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by the name of their kind."""
    return pii_spans.redacted(docs, pii_spans.trained(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    # workers of the stages before still hold memory: a small cache of ids
    _, places = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), cache_bytes=32_000_000)
    return places


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing_stage),
]

#: Models are fitted on the way, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
