"""Gene expression in long sparse form (wsi, barcode, gene, count): zeros are absent rows and count as zeros in every mean."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import stored, tasks_for

#: Cells whose profiles and neighbours' profiles meet in a task, about.
CELLS = 25_000


def select_genes(expression: DataFrame, genes: DataFrame) -> DataFrame:
    return expression.join(genes.select("gene").distinct(), "gene", "left_semi")


def normalize_log1p(expression: DataFrame, target_sum: float = 100.0) -> DataFrame:
    """expression with value: log1p(count / library * target_sum); the library is the sum over the genes given, 1 if it is zero."""
    library = F.sum("count").over(Window.partitionBy("wsi", "barcode"))
    return expression.withColumn("value", F.log1p(F.col("count") / F.when(library == 0, F.lit(1.0)).otherwise(library) * target_sum))


def gene_moments(expression: DataFrame, cells: DataFrame, value: str = "value") -> DataFrame:
    """wsi, gene, mean, std (population; 0 becomes 1) over all cells of a slide, zeros included."""
    n = cells.groupBy("wsi").agg(F.count("*").alias("_n"))
    sums = expression.groupBy("wsi", "gene").agg(F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q")).join(n, "wsi")
    var = F.greatest(F.col("_q") / F.col("_n") - F.pow(F.col("_s") / F.col("_n"), F.lit(2)), F.lit(0.0))
    return sums.select("wsi", "gene", (F.col("_s") / F.col("_n")).alias("mean"), F.when(var > 1e-18, F.sqrt(var)).otherwise(F.lit(1.0)).alias("std"))


def marker_score(expression: DataFrame, cells: DataFrame, markers: DataFrame, value: str = "value") -> DataFrame:
    """wsi, barcode, score: the mean z-score over the markers that the slide has; null if it has none.

    A cell's zeros give -mean / std, so its score is the sum over its rows of value / std, less the slide's sum of mean / std.
    """
    moments = gene_moments(expression, cells, value).join(markers.select("gene").distinct(), "gene", "left_semi")
    base = moments.groupBy("wsi").agg(F.sum(F.col("mean") / F.col("std")).alias("_base"), F.count("*").alias("_k"))
    own = expression.join(moments, ["wsi", "gene"]).groupBy("wsi", "barcode").agg(F.sum(F.col(value) / F.col("std")).alias("_own"))
    rows = cells.select("wsi", "barcode").join(base, "wsi", "left").join(own, ["wsi", "barcode"], "left")
    return rows.select("wsi", "barcode", ((F.coalesce("_own", F.lit(0.0)) - F.col("_base")) / F.col("_k")).alias("score"))


def expression_divergence(expression: DataFrame, pairs: DataFrame, n_genes: int, min_neighbours: int = 3, value: str = "value") -> DataFrame:
    """wsi, barcode, n, pearson, cosine of a cell's profile and the mean profile of its neighbours (pairs: wsi, barcode, other).

    Means divide by the number of neighbours, not of rows. Null with fewer neighbours than min_neighbours or without variance.
    """
    profiles = expression.groupBy("wsi", "barcode").agg(F.collect_list(F.struct("gene", F.col(value).alias("v"))).alias("_p"))
    profiles = stored(profiles, "profiles")
    tasks = tasks_for(expression.sparkSession, profiles.count(), CELLS)
    theirs = pairs.select("wsi", "barcode", "other").join(profiles.withColumnRenamed("barcode", "other"), ["wsi", "other"], "left").select("wsi", "barcode", F.lit(False).alias("_own"), "_p")
    both = profiles.select("wsi", "barcode", F.lit(True).alias("_own"), "_p").union(theirs).repartition(tasks, "wsi", "barcode")  # a row a pair is sent, not one a gene
    both = both.select("wsi", "barcode", "_own", F.posexplode_outer("_p").alias("_i", "_g"))
    of = lambda own: F.coalesce(F.sum(F.when(F.col("_own") == own, F.col("_g.v"))), F.lit(0.0))
    pair = (~F.col("_own") & (F.coalesce("_i", F.lit(0)) == 0)).cast("long")
    genes = both.groupBy("wsi", "barcode", F.col("_g.gene").alias("gene")).agg(of(True).alias("_a"), of(False).alias("_b"), F.sum(pair).alias("_n"), F.max(F.col("_i").isNotNull()).alias("_some"))
    s = {"a": F.sum("_a"), "b": F.sum("_b"), "aa": F.sum(F.col("_a") * F.col("_a")), "bb": F.sum(F.col("_b") * F.col("_b")), "ab": F.sum(F.col("_a") * F.col("_b")), "n": F.sum("_n"), "_some": F.max("_some")}
    rows = genes.groupBy("wsi", "barcode").agg(*[c.alias(k) for k, c in s.items()]).filter((F.col("n") > 0) & F.col("_some"))
    rows = rows.withColumns({"b": F.col("b") / F.col("n"), "bb": F.col("bb") / (F.col("n") * F.col("n")), "ab": F.col("ab") / F.col("n")})
    cov = lambda p, q, pq: F.col(pq) - F.col(p) * F.col(q) / n_genes
    root = lambda x: F.when(x > 1e-15, F.sqrt(x))
    enough = F.col("n") >= min_neighbours
    return rows.select("wsi", "barcode", "n", F.when(enough, cov("a", "b", "ab") / root(cov("a", "a", "aa") * cov("b", "b", "bb"))).alias("pearson"), F.when(enough, F.col("ab") / root(F.col("aa") * F.col("bb"))).alias("cosine"))


def per_gene_pearson(rows: DataFrame) -> DataFrame:
    """gene, n, pearson of true and predicted; null where either has no variance."""
    return rows.groupBy("gene").agg(F.count("*").alias("n"), F.when((F.stddev_pop("true") > 0) & (F.stddev_pop("predicted") > 0), F.corr("true", "predicted")).alias("pearson"))


def local_fit(x: np.ndarray, y: np.ndarray, at: float, k: int) -> tuple[float, float]:
    """(value, slope) at a place of the quadratic fitted to the k nearest of sorted x with tricube weights."""
    low, high = max(0, int(np.searchsorted(x, at)) - k), len(x) - k
    start = low
    stop = min(high, int(np.searchsorted(x, at)))
    while start < stop:  # the window moves right while its next point is nearer than its first
        middle = (start + stop) // 2
        if at - x[middle] > x[middle + k] - at:
            start = middle + 1
        else:
            stop = middle
    near, own = x[start : start + k], y[start : start + k]
    h = max(abs(at - near[0]), abs(near[-1] - at), 1e-12)
    w = np.sqrt((1 - (np.abs(near - at) / h) ** 3).clip(0) ** 3)
    a = np.vander(near - at, 3, increasing=True) * w[:, None]
    value, slope, _ = np.linalg.lstsq(a, own * w, rcond=None)[0]
    return float(value), float(slope)


def trend_vertices(x: np.ndarray, most: int) -> np.ndarray:
    """Borders of cells that hold at most so many of sorted x: a cell is cut at the middle of its points until it does, or has no width."""
    margin = 0.1 * (x[-1] - x[0]) + 1e-9
    done, cells = {x[0] - margin, x[-1] + margin}, [(0, len(x))]
    while cells:
        a, b = cells.pop()
        if b - a > most and x[a] < x[b - 1]:
            middle = (a + b) // 2
            cut = (x[middle - 1] + x[middle]) / 2
            middle = a + int(np.searchsorted(x[a:b], cut, side="right"))
            if a < middle < b:
                done.add(cut)
                cells += [(a, middle), (middle, b)]
    return np.array(sorted(done))


def trend(x: np.ndarray, y: np.ndarray, span: float = 0.3, cell: float = 0.2) -> np.ndarray:
    """Local quadratic fits over the nearest share span of the points, made at the borders of cells and blended between by cubics of the fits' values and slopes.

    Cells hold a share span * cell of the points, so the number of fits doesn't grow with them. Quadratics are kept exactly.
    """
    order = np.argsort(x, kind="stable")
    sx, sy, n = x[order], y[order], len(x)
    k = max(4, min(n, int(np.ceil(span * n))))
    knots = trend_vertices(sx, max(1, int(n * span * cell)))
    value, slope = np.array([local_fit(sx, sy, v, k) for v in knots]).T
    i = np.clip(np.searchsorted(knots, sx, side="right") - 1, 0, len(knots) - 2)
    width = knots[i + 1] - knots[i]
    t = (sx - knots[i]) / width
    h00, h10, h01, h11 = 2 * t**3 - 3 * t**2 + 1, t**3 - 2 * t**2 + t, 3 * t**2 - 2 * t**3, t**3 - t**2
    out = np.empty(n)
    out[order] = h00 * value[i] + h10 * width * slope[i] + h01 * value[i + 1] + h11 * width * slope[i + 1]
    return out


def rank_hvgs(expression: DataFrame, cells: DataFrame, n_top: int, batch: str = "wsi") -> DataFrame:
    """gene, n_batches, median_rank, highly_variable_rank: genes by the clipped variance of counts standardised with a fitted trend.

    For each batch: moments of counts over all its cells, a trend of log10 variance on log10 mean (over the genes of the batch's panel, in one task a batch), counts
    standardised and clipped at the root of the cells, their variance ranked. A gene's batches are those where it ranks below n_top; genes are ordered by
    median rank over these, more batches first on ties.
    """
    n = cells.groupBy(batch).agg(F.count("*").alias("_n"))
    sums = expression.groupBy(batch, "gene").agg(F.sum("count").cast("double").alias("_s"), F.sum(F.col("count").cast("double") * F.col("count")).alias("_q")).join(n, batch)
    mean = F.col("_s") / F.col("_n")
    var = (F.col("_q") - F.col("_n") * mean * mean) / F.greatest(F.col("_n") - 1, F.lit(1))
    moments = sums.select(batch, "gene", mean.alias("mean"), var.alias("var"), "_n")

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows, some = rows.assign(std=1.0), rows[rows["var"] > 0]
        if len(some) >= 4:
            fit = trend(np.log10(some["mean"].to_numpy()), np.log10(some["var"].to_numpy()))
            rows.loc[some.index, "std"] = np.sqrt(10**fit)
        elif len(some):
            rows.loc[some.index, "std"] = np.sqrt(some["var"])
        return rows[[batch, "gene", "mean", "std", "_n"]]

    kinds = {f.name: f.dataType.simpleString() for f in moments.schema.fields}
    fits = moments.groupBy(batch).applyInPandas(fitted, f"{batch} {kinds[batch]}, gene {kinds['gene']}, mean double, std double, _n long")
    return ranked_variances(expression, fits, n_top, batch)


def ranked_variances(expression: DataFrame, trend: DataFrame, n_top: int, batch: str = "wsi") -> DataFrame:
    """rank_hvgs, given the trend (batch, gene, mean, std, _n)."""
    clip = F.sqrt("_n") * F.col("std") + F.col("mean")
    clipped = expression.join(trend, [batch, "gene"]).withColumn("_c", F.least(F.col("count").cast("double"), clip))
    sums = clipped.groupBy(batch, "gene").agg(F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_q"), F.first("mean").alias("mean"), F.first("std").alias("std"), F.first("_n").alias("_n"))
    var = (F.col("_n") * F.col("mean") * F.col("mean") + F.col("_q") - 2 * F.col("_s") * F.col("mean")) / ((F.col("_n") - 1) * F.col("std") * F.col("std"))
    rank = F.row_number().over(Window.partitionBy(batch).orderBy(F.desc("_v"), "gene"))  # a row per gene
    ranked = sums.withColumn("_v", F.round(var, 9)).withColumn("_r", rank - 1)
    both = ranked.groupBy("gene").agg(F.count_if(F.col("_r") < n_top).alias("n_batches"), F.percentile(F.when(F.col("_r") < n_top, F.col("_r")), 0.5).alias("median_rank"))
    return both.withColumn("highly_variable_rank", F.row_number().over(Window.orderBy(F.desc("n_batches"), F.asc_nulls_last("median_rank"), "gene")) - 1)  # a row per gene
