"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.storage import scratch, stored

__all__ = ["SPACE", "blocks_for", "let", "scratch", "stored", "table", "words"]

#: White space of the word contracts: space and the control characters tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark's own reader (so any store Spark reaches will do)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text, as an array; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """body of a value that is worked out once, though body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blocks_for(n: int, rows: int) -> int:
    """Number of blocks of at most about so many rows."""
    return max(1, -(-n // rows))
