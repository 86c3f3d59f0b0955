"""A corpus pipeline: toxic documents go, near duplicates go, live secrets are masked, sources are mixed, texts are encoded."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, nearby, pieces, secrets, toxicity
from tessera.llm.common import stored, table

#: Target shares of the mixture's plain and good tokens (toxic documents are gone: what their posteriors leave is free). Rates stay at FLOOR or
#: more, so no clean document is dropped; the mixture has the fewest tokens that leave each domain what came in, and mixing.MARGIN times that.
WEIGHTS, FLOOR = {"plain": 0.3, "good": 0.7}, 1.0


class MissedTargets(UserWarning):
    """The mixture's expected tokens lie off their targets."""


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels, doesn't call toxic, with their columns as they are.

    Null and empty texts are scored as empty; rows that repeat are judged alike; an empty table gives one.
    """
    model = toxicity.fit_from_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), "text")
    return toxicity.score_toxicity(rows, model).filter(F.col("predicted") == 0).select("row.*")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id. Sets are of five words, as is usual for stages (op8's contract asks for four).

    Null texts, texts without words and rows with a null doc_id stay; rows that repeat a doc_id stay or go together; an empty table gives one.
    """
    gone = nearby.near_duplicates(docs, k=5).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are masked; n_chars follows the text. All rows stay; null texts stay null; an empty table gives one."""
    masked = secrets.redact_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its rate says, once at least; a mixture off its targets is told by a warning.

    A null or empty text has no tokens and its posterior's rate; rows that repeat are copied alike; an empty table gives one.
    """
    mixed, fit = mixing.fitted_mix(docs, table(spark, sf_dir, "labels"), WEIGHTS, None, FLOOR)
    if not fit.met:
        warnings.warn(f"mixing misses its targets at rates of {FLOOR} or more: {fit}", MissedTargets, stacklevel=2)
    return mixing.mixed_documents(docs, mixed)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, round_trip and ids of each row; a null or empty text has no ids."""
    return pieces.encode(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("encoding", encode_pieces),
]

#: Learned scores and MinHash candidates are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, in order, over documents; each stage's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
