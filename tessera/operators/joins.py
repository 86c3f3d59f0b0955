"""Equi, semi and anti joins between the domain's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import barcode, quadrant
from tessera.functions.vectors import cosine_distance


def best_per_reference(matches: DataFrame) -> DataFrame:
    """One detected cell for each reference: the best score, then the smallest id."""
    best = matches.filter(F.col("other_id").isNotNull()).groupBy("wsi", "other_id").agg(F.max(F.struct("score")).alias("_s"), F.min_by("cell_id", F.struct(-F.col("score"), F.col("cell_id"))).alias("cell_id"))
    return best.select("wsi", "other_id", "cell_id", F.col("_s.score").alias("score"))


def attach_ground_truth(best: DataFrame, truth: DataFrame) -> DataFrame:
    return best.join(truth.select("wsi", F.col("native_cell_id").alias("other_id"), "cell_type"), ["wsi", "other_id"])


def unmatched_count(best: DataFrame, truth: DataFrame) -> DataFrame:
    return best.join(truth.select("wsi", F.col("native_cell_id").alias("other_id")), ["wsi", "other_id"], "left_anti").groupBy("wsi").agg(F.count("*").alias("n_unmatched"))


def resolve_positions(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """rows with x, y and valid (whether the cell is known)."""
    at = cells.select("wsi", "cell_id", "x", "y", F.lit(True).alias("_hit"))
    return rows.join(at, ["wsi", "cell_id"], "left").withColumn("valid", F.coalesce("_hit", F.lit(False))).drop("_hit")


def join_expression(cells: DataFrame, expression: DataFrame) -> DataFrame:
    """Counts of cells that both have, by (wsi, barcode)."""
    return cells.withColumn("barcode", barcode(F.col("cell_id"))).join(expression, ["wsi", "barcode"])


def positions_expression(cells: DataFrame, expression: DataFrame) -> DataFrame:
    """wsi, cell_id, x, y, gene, count of the cells with a position whose barcode has counts."""
    placed = cells.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).select("wsi", "cell_id", "x", "y")
    return join_expression(placed, expression).select("wsi", "cell_id", "x", "y", "gene", "count")


def attach_coords(predictions: DataFrame, cells: DataFrame) -> DataFrame:
    """predictions with x, y and located; a cell that stands in several rows of cells counts with its first position (by x, then y), so that no prediction is doubled."""
    at = cells.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("wsi", "cell_id").agg(F.min(F.struct("x", "y")).alias("_at"))
    rows = predictions.join(at, ["wsi", "cell_id"], "left")
    return rows.withColumns({"x": F.col("_at.x"), "y": F.col("_at.y"), "located": F.col("_at").isNotNull()}).drop("_at")


def availability_vs_score(scores: DataFrame, counts: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """scores (keys, label, value) with the rows n that training had of the class, 0 where it had none, and proportion of the run's rows; null without a run."""
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("_whole"))
    rows = scores.join(counts.select(*keys, label, F.col("n").alias("_n")), [*keys, label], "left").join(whole, keys, "left")
    n = F.when(F.col("_whole").isNotNull(), F.coalesce("_n", F.lit(0)))
    return rows.withColumn("n", n).withColumn("proportion", F.col("n") / F.nullif(F.col("_whole"), F.lit(0))).drop("_n", "_whole")


def drift(unmasked: DataFrame, masked: DataFrame, vector: str = "vector") -> DataFrame:
    """wsi, cell_id, drift: cosine distance of the same cell under two conditions."""
    other = masked.select("wsi", "cell_id", F.col(vector).alias("_m"))
    return unmasked.join(other, ["wsi", "cell_id"]).select("wsi", "cell_id", cosine_distance(F.col(vector), F.col("_m")).alias("drift"))


def align_predictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """wsi, cell_id, true_label, quadrant; raises where the two disagree on the truth."""
    other = b.select("wsi", "cell_id", F.col("true_label").alias("_t"), F.col("correct").alias("_c"))
    both = a.join(other, ["wsi", "cell_id"])
    true = F.when(F.col("true_label") == F.col("_t"), F.col("true_label")).otherwise(F.raise_error(F.lit("true labels differ between the conditions")).cast("string"))
    return both.select("wsi", "cell_id", true.alias("true_label"), quadrant(F.col("correct"), F.col("_c")).alias("quadrant"))


def left_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left")


def skip_finished(planned: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(finished.select(*keys), keys, "left_anti")


def masked_pairs(runs: DataFrame, keys: list[str], masked: str = "masked") -> DataFrame:
    """keys of the runs that have both forms."""
    return runs.groupBy(*keys).agg(F.count_if(F.col(masked)).alias("_m"), F.count_if(~F.col(masked)).alias("_u")).filter("_m > 0 AND _u > 0").select(*keys)


def in_every(df: DataFrame, item: str, of: str) -> DataFrame:
    """Items that every one of the groups has."""
    groups = df.agg(F.count_distinct(of).alias("_n"))
    held = df.groupBy(item).agg(F.count_distinct(of).alias("_h"))
    return held.crossJoin(F.broadcast(groups)).filter(F.col("_h") == F.col("_n")).select(item)  # one row


def gene_presence(genes: DataFrame, panel: DataFrame) -> DataFrame:
    """genes with present: whether every slide of the panel has it."""
    every = in_every(panel, "gene", "wsi").withColumn("_p", F.lit(True))
    return genes.join(every, "gene", "left").withColumn("present", F.coalesce("_p", F.lit(False))).drop("_p")


def restrict_to_train_classes(rows: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    return rows.join(train.select(label).distinct(), label, "left_semi")


def dropped_without_support(rows: DataFrame, train: DataFrame, label: str = "label") -> DataFrame:
    return rows.join(train.select(label).distinct(), label, "left_anti").groupBy(label).agg(F.count("*").alias("n_dropped"))


def validate_samples(wanted: DataFrame, manifest: DataFrame, key: str = "sample") -> DataFrame:
    return wanted.join(manifest.select(key), key, "left_anti")


def root_by_prefix(df: DataFrame, name: str, roots: list[tuple[str, str]]) -> DataFrame:
    """df with root: that of the first prefix in order that a name begins with."""
    out = None
    for prefix, root in roots:
        hit = F.col(name).startswith(prefix)
        out = F.when(hit, root) if out is None else out.when(hit, root)
    return df.withColumn("root", out)


def input_status(plan: DataFrame, inventory: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """plan with status: missing (no input), done, or to_run."""
    here, over = inventory.select(key, F.lit(True).alias("_i")).distinct(), done.select(key, F.lit(True).alias("_d")).distinct()
    rows = plan.join(here, key, "left").join(over, key, "left")
    return rows.withColumn("status", F.when(F.col("_i").isNull(), "missing").when(F.col("_d").isNotNull(), "done").otherwise("to_run")).drop("_i", "_d")


def attach_inventory(inventory: DataFrame, probes: DataFrame, key: str = "path") -> DataFrame:
    """All probe results, with what the inventory says of them."""
    return inventory.join(probes, key, "right")
