"""Read-outs of polygons' tokens, and the summaries and comparisons built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.rings import centroid, moments, nearest_token, token_overlap
from tessera.functions.scalars import ENCODERS, central_block
from tessera.operators.space import majority_labels, near_join
from tessera.operators.stats import cluster_bootstrap_median_diff
from tessera.operators.tables import cap_per_key, classification_report, confusion_matrix, mean_std_n, quantiles, union_all
from tessera.sources.storage import stored

#: Modes of a crop: a fixed square as it is, a square of another size scaled to the encoder's, and the tile that holds the cell.
MODES = ("native", "resized", "tile")


def pool_boundary_tokens(df: DataFrame, keys: list[str], token: float, side: int, dim: int, flat: str = "flat", ring: str = "ring", x0: str = "x0", y0: str = "y0") -> DataFrame:
    """keys, pooled, n_tokens, source of each row: the mean of the tokens that the polygon overlaps.

    flat holds the side x side tokens of the crop at (x0, y0), row by row. source is "overlap", "nearest" where the polygon meets no token (the one nearest to its centroid
    stands for it) or "missing" where there is no polygon (zeros). Keys name a row; the overlaps of a row are side x side at most.
    """
    some = df.filter(F.col(ring).isNotNull())
    met = token_overlap(some.select(*keys, ring, x0, y0), keys, token, side, ring, x0, y0)
    met = met.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("row") * side + F.col("col"))).alias("_met"))
    at = centroid(moments(F.col(ring)))
    near = nearest_token(at["x"], at["y"], F.col(x0), F.col(y0), token, side)
    rows = df.join(met, keys, "left")
    source = F.when(F.col(ring).isNull(), "missing").when(F.col("_met").isNull(), "nearest").otherwise("overlap")
    tokens = F.coalesce("_met", F.array(near["row"] * side + near["col"]))
    mean = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.aggregate("_tokens", F.lit(0.0), lambda a, t: a + F.get(F.col(flat), t * dim + d).cast("double")) / F.size("_tokens"))
    zeros = F.array_repeat(F.lit(0.0), dim)
    rows = rows.withColumn("source", source).withColumn("_tokens", F.when(F.col(ring).isNotNull(), tokens))
    return rows.select(*keys, F.when(F.col(ring).isNull(), zeros).otherwise(mean).alias("pooled"), F.coalesce(F.size("_met"), F.lit(0)).alias("n_tokens"), "source")


def token_overlap_summary(overlap: DataFrame, keys: list[str], first: int, grid: int) -> DataFrame:
    """n (polygons that meet a token), mean and median of their tokens, and the share whose tokens all lie in the central grid x grid block that begins at first."""
    inside = F.col("row").between(first, first + grid - 1) & F.col("col").between(first, first + grid - 1)
    each = overlap.groupBy(*keys).agg(F.count("*").alias("n_tokens"), F.min(inside).alias("central"))
    return each.agg(F.count("*").alias("n"), F.avg("n_tokens").alias("mean_tokens"), F.percentile("n_tokens", 0.5).alias("median_tokens"), F.avg(F.col("central").cast("double")).alias("central_share"))


def fallback_rate(pooled: DataFrame) -> DataFrame:
    """n, and the shares of rows without a polygon and of those that took the nearest token."""
    share = lambda s: F.avg((F.col("source") == s).cast("double"))
    return pooled.agg(F.count("*").alias("n"), share("missing").alias("missing_share"), share("nearest").alias("nearest_share"))


def neighbor_baseline(predictions: DataFrame, radii: list[float], labels: list[str], true: str = "true_label", predicted: str = "predicted_label") -> DataFrame:
    """name, coverage, accuracy, macro_f1, weighted_f1, balanced_accuracy: a cell is given its neighbours' commonest true label, for each radius; and the model's own row.

    Coverage is the share of cells with a neighbour; the metrics are of those.
    """

    columns = ["name", "coverage", "accuracy", "macro_f1", "weighted_f1", "balanced_accuracy"]

    def report(name: str, rows: DataFrame, guess: str, times: str | None = None) -> DataFrame:
        known, n = rows.filter(F.col(guess).isNotNull()), F.col(times) if times else F.lit(1)
        coverage = rows.agg((F.sum(F.when(F.col(guess).isNotNull(), n).otherwise(0)) / F.sum(n)).alias("coverage"))  # one row
        return classification_report(confusion_matrix(known, labels, true, guess, times=times)).crossJoin(F.broadcast(coverage)).withColumn("name", F.lit(name))

    if not radii:
        return report("model", predictions, predicted).select(*columns)
    single = majority_labels(predictions, radii, true).filter(F.col("wsi").isNotNull() & F.col("cell_id").isNotNull())
    guesses = [f"majority_{i}" for i in range(len(radii))]
    single = stored(single.groupBy(true, *guesses).agg(F.count("*").alias("_times")), "majorities")  # a row for labels that stand together
    near = [report(f"neighbours_{r:g}", single, g, "_times") for r, g in zip(radii, guesses, strict=True)]
    return union_all(report("model", predictions, predicted), *near).select(*columns)


def availability_summary(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, mean_n, mean_proportion, mean_f1, n_rows of each class. rows: label, n, proportion, f1, one for each class and fold."""
    return rows.groupBy(label).agg(F.avg("n").alias("mean_n"), F.avg("proportion").alias("mean_proportion"), F.avg("f1").alias("mean_f1"), F.count("*").alias("n_rows"))


def scaling_table(rows: DataFrame, model: str, size: str, metric: str) -> DataFrame:
    """Mean, standard deviation and number of a metric for each model and training size."""
    return mean_std_n(rows, [model, size], metric)


def folds_against_pooled(runs: DataFrame, keys: list[str], metric: str, split: str = "split_idx", pooled: int = -1) -> DataFrame:
    """keys, mean, std, n over the folds, and pooled: the value of the run whose split is the pooled one (null if there is none)."""
    folds = runs.filter(F.col(split) != pooled).groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))
    whole = runs.filter(F.col(split) == pooled).groupBy(*keys).agg(F.max(metric).alias("pooled"))
    return folds.join(whole, keys, "left")


def dapi_relative(cells: DataFrame, radius: float, k: int, seed: int = 0, value: str = "mean_intensity") -> DataFrame:
    """wsi, cell_id, n_used, relative (own mean less that of at most k neighbours within radius, chosen by a seeded hash), integrated (mean * area).

    cells: wsi, cell_id, x, y, the measured mean and area. A cell without a measured neighbour has a null relative value.
    """
    left = cells.select("wsi", "cell_id", F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = cells.filter(F.col(value).isNotNull()).select("wsi", F.col("cell_id").alias("other_id"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col(value).alias("other_value"))
    near = near_join(left, right, radius).filter((F.col("cell_id") != F.col("other_id")) & (F.hypot(F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")) <= radius))
    used = cap_per_key(near, ["wsi", "cell_id"], k, seed, "other_id").groupBy("wsi", "cell_id").agg(F.avg("other_value").alias("around"), F.count("*").alias("n_used"))
    rows = cells.join(used, ["wsi", "cell_id"], "left")
    return rows.select("wsi", "cell_id", F.coalesce("n_used", F.lit(0)).alias("n_used"), (F.col(value) - F.col("around")).alias("relative"), (F.col(value) * F.col("area")).alias("integrated"))


def masking_divergence(aligned: DataFrame, divergence: DataFrame, value: str = "divergence") -> DataFrame:
    """quadrant, n, mean, median of the divergence of cells that masking breaks (only_a) and of those that both get right. aligned: wsi, cell_id, quadrant."""
    rows = _compared(aligned, divergence, value)
    middle = quantiles(rows, value, [0.5], ["quadrant"]).select("quadrant", F.col("q")[0].alias("median"))
    return rows.groupBy("quadrant").agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(middle, "quadrant", "left")


def _compared(aligned: DataFrame, divergence: DataFrame, value: str) -> DataFrame:
    rows = aligned.filter(F.col("quadrant").isin("only_a", "both")).select("wsi", "cell_id", "quadrant")
    return rows.join(divergence.select("wsi", "cell_id", value), ["wsi", "cell_id"]).filter(F.col(value).isNotNull())


def masking_divergence_interval(aligned: DataFrame, divergence: DataFrame, draws: DataFrame, value: str = "divergence") -> DataFrame:
    """The difference of the two medians with its bootstrap interval over slides (draws: of bootstrap_draws)."""
    rows = _compared(aligned, divergence, value).withColumns({"broken": F.col("quadrant") == "only_a", "kept": F.col("quadrant") == "both"})
    return cluster_bootstrap_median_diff(rows, value, "broken", "kept", draws)


def first_n_boundary_cells(cells: DataFrame, shapes: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n cells in an order that have a polygon, with it."""
    return cells.join(shapes.select("wsi", "cell_id", "ring"), ["wsi", "cell_id"]).orderBy(*(order or ("wsi", "cell_id"))).limit(n)


def crop_specs(spark: SparkSession, modes: dict[str, dict] | None = None) -> DataFrame:
    """encoder, mode, crop_px (read from the slide), input_px (given to the encoder), scale, first_token, center_tokens, first_px of each encoder and mode.

    modes: settings of each mode: crop_px of resized and tile crops (native takes the encoder's own size).
    """
    modes = modes or {"native": {}, "resized": {"crop_px": 112}, "tile": {"crop_px": 224}}
    if unknown := set(modes) - set(MODES):
        raise ValueError(f"unknown modes: {sorted(unknown)}")
    rows = []
    for name, side, token, _, center, _ in ENCODERS:
        for mode, settings in modes.items():
            crop = side * token if mode == "native" else int(settings["crop_px"])
            first, first_px = central_block(side * token, token, center)
            rows.append((name, mode, crop, side * token, side * token / crop, first, center, first_px))
    return spark.createDataFrame(rows, "encoder string, mode string, crop_px int, input_px int, scale double, first_token int, center_tokens int, first_px int")
