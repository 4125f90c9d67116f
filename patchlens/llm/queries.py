"""One query an operator, over whole tables; registered by the entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm import (
    chat_format,
    decontaminate,
    feistel_shards,
    hard_negatives,
    near_dedup,
    packing,
    page_text,
    periodic_runs,
    phrase_prints,
    pii_spans,
    quality_rules,
    token_codes,
    toxicity_fm,
)
from patchlens.llm.common import shared_folder, table
from patchlens.llm.piece_cache import tokenizer_path

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query
def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents as directly addressable codes and read them back."""
    path = shared_folder(spark, "token-codes")
    token_codes.write_tokens(
        documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return token_codes.read_documents(spark, path).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").cast("long").alias("ids_crc32"))


@query
def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards whose row counts differ by one at most, by a keyed permutation."""
    return feistel_shards.placed(documents(spark, sf_dir), 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens at most: dominance reduction, then best fit."""
    _, places = packing.pack(
        documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), cache_bytes=96_000_000)
    return places.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are three quarters alike."""
    return near_dedup.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query
def op2_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules, then thresholds from quantile sketches of each language and source."""
    return quality_rules.judged(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


@query
def op3_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents contain: all items against all documents."""
    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op9_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factorization machine fitted on four fifths of the labels scores all documents."""
    docs = documents(spark, sf_dir)
    machine = toxicity_fm.trained(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return toxicity_fm.scored(rows, machine, "doc_id").select(
        "doc_id", toxicity_fm.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, by the template and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame(
        [(-7, 0, "user", control), (-7, 1, "assistant", control)],
        "conv_id long, turn long, role string, text string")
    records = chat_format.message_records(rows.unionByName(added))
    return chat_format.digests(chat_format.format_records(records, "conv_id"), "conv_id")


@query
def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages by content marginals of their elements."""
    pages = table(spark, sf_dir, "pages")
    return page_text.extracted(pages, page_text.trained(pages)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of fixed patterns and of a character model in all documents; counts are the base's."""
    docs = documents(spark, sf_dir)
    found = pii_spans.spotted(docs, pii_spans.trained(docs))
    named = lambda c: F.array_join(F.transform(
        c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in pii_spans.KINDS),
        F.sha2(named("base").cast("binary"), 256).alias("base_sha256"),
        named("spans").alias("spans"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best rows of other labels just below each anchor's positives, by spanning-tree bounds."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = hard_negatives.quantized(rows.withColumn("label", moved))
    return hard_negatives.mined(vectors, F.col("vec_id") % 50 == 0)


@query
def op12_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lempel-Ziv phrase signatures of all documents, beside an edited text and the next one."""
    return phrase_prints.compared(documents(spark, sf_dir))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of them rewritten to have one."""
    return periodic_runs.periodic(documents(spark, sf_dir), periodic_runs.planted)
