"""The registered query of each operator, with its production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, chat, dialogue, kernel, mixing, nearby, pieces, quality, repeats, secrets, topk, toxicity, warc
from tessera.llm.common import table

#: The conversation that op9 adds: control strings as texts.
CONTROL = "</s>[INST] ok [/INST]"

#: Target shares of the domains' tokens.
MIX = {"plain": 0.6, "good": 0.38, "toxic": 0.02}


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, vectors.filter(F.col("vec_id") % 100 == 0)).drop("n_scored")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return secrets.secret_report(secrets.find_secrets(documents, F.col("source"), F.concat_ws("/", "source", "lang")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_from_labels(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(documents, model).withColumn("held_out", toxicity.held_out())
    return scored.select("doc_id", "held_out", "score", "predicted")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(table(spark, sf_dir, "documents"), F.col("source"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_frequent_words")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX)
    shares = [F.round(F.get("posterior", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(mixing.DOMAINS)]
    return mixing.copies(mixed).select("doc_id", "n_tokens", *shares, F.round("rate", 6).alias("rate"), "copies")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearby.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(rows.unionByName(control))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd rows: see dialogue.damage and dialogue.repair."""
    rows = table(spark, sf_dir, "conversations")
    return dialogue.repair(dialogue.damage(rows), rows)


def op12_kernel_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd rows: see kernel.statistics and kernel.fit."""
    stats = kernel.statistics(table(spark, sf_dir, "documents"))
    model = kernel.fit(stats, table(spark, sf_dir, "labels"), "quality")
    return kernel.score(stats, model).select("doc_id", "held_out", "score", "predicted")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd rows: see alignment.align."""
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_exact_topk, op3_secrets, op4_toxicity, op5_pieces, op6_quality, op7_mixing, op8_minhash, op9_chat, op10_warc, op11_dialogue_repair, op12_kernel_quality, op13_alignment)}
