"""Writers: partitioned Parquet tables, and upserts that leave other rows as they are."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import class_counts, union_all
from tessera.sources.storage import stored


def write_cells(cells: DataFrame, path: str) -> None:
    """Partitioned by slide. A null key or position raises: every column has a value for every cell."""
    need = ["wsi", "cell_id", "x_start", "y_start", "cell_type"]
    ok = F.col(need[0]).isNotNull()
    for c in need[1:]:
        ok &= F.col(c).isNotNull()
    checked = cells.withColumn("wsi", F.when(ok, F.col("wsi")).otherwise(F.raise_error(F.lit("a cell lacks a value")).cast("string")))
    checked.repartition("wsi").write.mode("overwrite").partitionBy("wsi").parquet(path)


def write_embeddings(df: DataFrame, path: str) -> None:
    """Only the partitions (model, correction, wsi) that df holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "correction", "wsi").parquet(path)


def dataset_stats(df: DataFrame, label: str = "cell_label") -> DataFrame:
    """wsi, label, n, proportion, n_cells, n_classes."""
    counts = class_counts(df.withColumnRenamed(label, "label"), df.select(F.col(label).alias("label")), ["wsi"])
    totals = df.groupBy("wsi").agg(F.count("*").alias("n_cells"), F.count_distinct(label).alias("n_classes"))
    return counts.join(totals, "wsi")


def write_matches(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").partitionBy("name").parquet(path)


def split_info(rows: DataFrame, label: str = "label") -> DataFrame:
    """split_idx, side, label, n."""
    return rows.groupBy("split_idx", "side", label).agg(F.count("*").alias("n"))


def append(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def write_summary(trials: DataFrame, path: str, keys: list[str], metric: str, *partitions: str) -> None:
    """Appends the best trial of each run (keys) by a metric, with all its settings and metrics, the smaller trial_idx where two are alike, and n_trials."""
    best = F.max_by(F.struct(*[c for c in trials.columns if c not in keys]), F.struct(F.col(metric), -F.col("trial_idx")))
    rows = trials.filter(F.col(metric).isNotNull()).groupBy(*keys).agg(best.alias("_b"), F.count("*").alias("n_trials"))
    append(rows.select(*keys, "_b.*", "n_trials"), path, *partitions)


def decoded_predictions(df: DataFrame, codes: DataFrame) -> DataFrame:
    """true_label and predicted_label by name (codes: label, code), and correct."""
    true, pred = codes.select(F.col("code").alias("true_code"), F.col("label").alias("true_label")), codes.select(F.col("code").alias("predicted_code"), F.col("label").alias("predicted_label"))
    out = df.join(F.broadcast(true), "true_code").join(F.broadcast(pred), "predicted_code")  # a mapping's classes
    return out.withColumn("correct", F.col("true_label") == F.col("predicted_label"))


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("split_idx").parquet(path)


def write_probe_results(val: DataFrame, test: DataFrame, path: str) -> None:
    union_all(val.withColumn("side", F.lit("val")), test.withColumn("side", F.lit("test"))).write.mode("overwrite").partitionBy("side").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones of other keys."""
    return union_all(old.join(new.select(*keys), keys, "left_anti"), new)


def upsert_summary(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """The merged table is written aside before it replaces the old one."""
    merged = stored(upserted(spark.read.parquet(path), new, keys), "upsert")
    merged.write.mode("overwrite").parquet(path)


def write_hvgs(df: DataFrame, path: str, provenance: dict[str, str]) -> None:
    df.withColumns({k: F.lit(v) for k, v in provenance.items()}).write.mode("overwrite").partitionBy("split_label").parquet(path)


def cache_with_meta(spark: SparkSession, path: str, parameters: dict, build) -> tuple[DataFrame, bool]:
    """(the table at path, whether it was stale): it is built anew where it is missing or its parameters differ."""
    record = json.dumps(parameters, sort_keys=True)
    meta = f"{path}-meta"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(meta)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    stale = there and spark.read.parquet(meta).first()["parameters"] != record
    if not there or stale:
        build().write.mode("overwrite").parquet(path)
        spark.createDataFrame([(record,)], "parameters string").write.mode("overwrite").parquet(meta)
    return spark.read.parquet(path), stale


def write_csv(df: DataFrame, path: str) -> None:
    """Small lists: manifests and bad cells."""
    df.write.mode("overwrite").csv(path, header=True)
