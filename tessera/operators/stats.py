"""Statistical tests that respect slides as clusters."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.pvalues import EXACT, correlation_p, exact_rank_sum_tail, normal_tail, normal_upper
from tessera.operators.resampling import MAX_SLIDES, block_permutation_spearman, known, rhos_of_draws
from tessera.operators.tables import BLOCKS, average_rank, quantiles
from tessera.sources.storage import stored

#: Rows of draws that are broadcast at most (about 200 MB): 2,000 draws of 2,500 slides.
BROADCAST_DRAWS = 5_000_000


def two_sided_p(rho: Column, n: Column) -> Column:
    """A correlation's p value by Student's t with n - 2 degrees of freedom."""
    return correlation_p(rho, n)


def spearman(df: DataFrame, x: str, y: str, group: list[str] | None = None, min_n: int = 2) -> DataFrame:
    """n, rho (and the groups): the correlation of mid-ranks, pooled or by group."""
    rows = average_rank(average_rank(known(df, x, y), x, group, "_rx"), y, group, "_ry")
    return rows.groupBy(*(group or [])).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho")).filter(F.col("n") >= min_n)


def pearson_by_group(df: DataFrame, x: str, y: str, group: str = "wsi", min_n: int = 3) -> DataFrame:
    return known(df, x, y).groupBy(group).agg(F.count("*").alias("n"), F.corr(x, y).alias("r")).filter(F.col("n") >= min_n)


def correlations_by_group(df: DataFrame, x: str, y: str, group: str = "wsi", min_n: int = 3) -> DataFrame:
    """group, n, r, r_p, rho, rho_p: both correlations of each group with their p values."""
    rho = spearman(df, x, y, [group], min_n)
    both = pearson_by_group(df, x, y, group, min_n).join(rho.select(group, "rho"), group)
    return both.withColumns({"r_p": correlation_p(F.col("r"), F.col("n")), "rho_p": correlation_p(F.col("rho"), F.col("n"))})


def spread_over_groups(by_group: DataFrame, *values: str) -> DataFrame:
    """n_groups, and mean_<value> and std_<value> (of a sample) over groups."""
    return by_group.agg(F.count("*").alias("n_groups"), *[f(v).alias(f"{name}_{v}") for v in values for name, f in (("mean", F.avg), ("std", F.stddev_samp))])


def stouffer_signed(per_group: DataFrame, rho: str = "rho", p: str = "p_value") -> DataFrame:
    """z, p_value, n of signed two-sided p values combined."""

    clipped = F.greatest(F.lit(2e-300), F.least(F.col(p), F.lit(1.0)))
    z = normal_upper(clipped / 2) * F.signum(rho)
    out = per_group.withColumn("_z", z).agg((F.sum("_z") / F.sqrt(F.count("*"))).alias("z"), F.count("*").alias("n"))
    return out.withColumn("p_value", 2 * normal_tail(F.abs("z")))


def bootstrap_draws(spark: SparkSession, slides: list[str], n_boot: int, seed: int = 0) -> DataFrame:
    """multiset, times, wsi, multiplicity: draws of slides with replacement; equal multisets are kept once with the number of their draws."""
    rng = np.random.default_rng(seed)
    draws, counts = np.unique(np.sort(rng.integers(0, len(slides), (n_boot, len(slides))), axis=1), axis=0, return_counts=True)
    rows = [(m, int(t), slides[i], int(c)) for m, (d, t) in enumerate(zip(draws, counts, strict=True)) for i, c in zip(*np.unique(d, return_counts=True), strict=True)]
    return spark.createDataFrame(rows, "multiset int, times int, wsi string, multiplicity int")


def _interval(boot: DataFrame, value: str) -> DataFrame:
    """ci_lo, ci_hi of a value over draws, each counted as often as it was drawn."""
    at = lambda q: F.percentile(value, q, F.col("times"))
    return boot.agg(at(0.025).alias("ci_lo"), at(0.975).alias("ci_hi"), F.sum("times").alias("n_valid"), (F.sum(F.when(F.col(value) <= 0, F.col("times")).otherwise(0)) / F.sum("times")).alias("p_one_sided"))


def _spread(draws: DataFrame) -> DataFrame:
    """draws, broadcast unless they have more than BROADCAST_DRAWS rows (slides times draws)."""
    return F.broadcast(draws) if draws.count() <= BROADCAST_DRAWS else draws


def _drawn_medians(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """side, multiset, median of rows (side, wsi, _v) weighted by the multiplicity of their slide in each draw, as F.percentile with frequencies has it.

    The counts of the values are cut into BLOCKS of values; only the blocks' totals meet all draws, and rows meet a draw only in the one or two blocks that hold its median.
    """
    draws = draws.select("multiset", "wsi", "multiplicity")
    counts = rows.groupBy("side", "wsi", "_v").agg(F.count("*").alias("_c"))
    cuts = counts.groupBy("side").agg(F.percentile_approx("_v", [i / BLOCKS for i in range(1, BLOCKS)], 1000).alias("_e"))
    placed = counts.join(F.broadcast(cuts), "side").withColumn("_k", F.size(F.filter("_e", lambda e: e < F.col("_v")))).drop("_e")  # one row a side
    totals = placed.groupBy("side", "wsi", "_k").agg(F.sum("_c").alias("_t")).join(_spread(draws), "wsi")
    drawn = totals.groupBy("side", "multiset", "_k").agg(F.sum(F.col("_t") * F.col("multiplicity")).alias("_t"))
    own = Window.partitionBy("side", "multiset")  # at most BLOCKS rows
    drawn = drawn.withColumns({"_end": F.sum("_t").over(own.orderBy("_k")), "_n": F.sum("_t").over(own)})
    ends = drawn.select("side", "multiset", "_k", (F.col("_end") - F.col("_t")).alias("_begin"), "_end", F.floor((F.col("_n") - 1) / 2).alias("_low"), F.floor(F.col("_n") / 2).alias("_high"))
    wanted = ends.filter((F.col("_begin") <= F.col("_high")) & (F.col("_low") < F.col("_end"))).drop("_end")
    weights = stored(wanted.join(_spread(draws), "multiset"), "median-blocks")
    met = placed.join(_spread(weights), ["side", "_k", "wsi"])
    values = met.groupBy("side", "multiset", "_k", "_begin", "_low", "_high", "_v").agg(F.sum(F.col("_c") * F.col("multiplicity")).alias("_w"))
    before = F.coalesce(F.sum("_w").over(Window.partitionBy("side", "multiset", "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed_values = values.withColumn("_b", F.col("_begin") + before)
    at = lambda rank: F.max(F.when((F.col("_b") <= F.col(rank)) & (F.col(rank) < F.col("_b") + F.col("_w")), F.col("_v")))
    found = placed_values.groupBy("side", "multiset").agg(at("_low").alias("_l"), at("_high").alias("_h"))
    return found.select("side", "multiset", F.when(F.col("_l") == F.col("_h"), F.col("_l")).otherwise(F.col("_l") * 0.5 + F.col("_h") * 0.5).alias("median"))


def cluster_bootstrap_median_diff(df: DataFrame, value: str, in_a: str, in_b: str, draws: DataFrame) -> DataFrame:
    """n_a, n_b, median_diff, ci_lo, ci_hi, n_valid, p_one_sided: whole slides are drawn; draws without either group are not valid."""
    sides = F.array_compact(F.array(F.when(F.col(in_a), "a"), F.when(F.col(in_b), "b")))
    rows = known(df, value).select("wsi", F.col(value).cast("double").alias("_v"), F.explode(sides).alias("side"))
    median = lambda side: F.max(F.when(F.col("side") == side, F.col("q")[0]))
    sizes = rows.agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))
    observed = sizes.crossJoin(F.broadcast(quantiles(rows, "_v", [0.5], ["side"]).agg((median("a") - median("b")).alias("median_diff"))))  # one row each
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("median")))
    each = _drawn_medians(rows, draws).groupBy("multiset").agg((of("a") - of("b")).alias("_d")).filter(F.col("_d").isNotNull())
    each = each.join(draws.select("multiset", "times").distinct(), "multiset")
    return observed.crossJoin(F.broadcast(_interval(each, "_d")))  # one row each


def cluster_bootstrap_corr(df: DataFrame, x: str, y: str, draws: DataFrame) -> DataFrame:
    """r, ci_lo, ci_hi, n_valid of Pearson's correlation from sums for each slide, recombined for each draw."""
    rows = known(df, x, y).select("wsi", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    terms = {"n": F.lit(1.0), "x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") * F.col("_x"), "yy": F.col("_y") * F.col("_y"), "xy": F.col("_x") * F.col("_y")}
    sums = rows.groupBy("wsi").agg(*[F.sum(e).alias(k) for k, e in terms.items()])
    cov = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    corr = cov("x", "y", "xy") / F.nullif(F.sqrt(cov("x", "x", "xx") * cov("y", "y", "yy")), F.lit(0.0))
    each = sums.join(_spread(draws), "wsi").groupBy("multiset", "times").agg(*[F.sum(F.col(k) * F.col("multiplicity")).alias(k) for k in terms]).withColumn("_r", corr)
    return rows.agg(F.corr("_x", "_y").alias("r")).crossJoin(_interval(each.filter(F.col("_r").isNotNull()), "_r").drop("p_one_sided"))


def cluster_bootstrap_spearman(df: DataFrame, x: str, y: str, draws: DataFrame) -> DataFrame:
    """rho, ci_lo, ci_hi, n_valid: whole slides are drawn; ranks are those of the drawn rows.

    Up to MAX_SLIDES slides the draws are worked out from sums over slides (resampling.rank_moments), beyond that from the rows of each draw.
    """
    rows = known(df, x, y).select("wsi", F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter(F.col("wsi").isNotNull())
    slides = sorted(r["wsi"] for r in rows.select("wsi").distinct().limit(MAX_SLIDES + 1).collect())
    each = rhos_of_draws(rows, draws, slides) if len(slides) <= MAX_SLIDES else _rhos_by_rows(rows, draws)
    return spearman(rows, "_x", "_y").select("rho").crossJoin(_interval(each, "_r").drop("p_one_sided"))  # one row each


def _rhos_by_rows(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """multiset, times, _r: every row meets every draw of its slide."""
    drawn = rows.join(_spread(draws), "wsi").withColumnRenamed("multiplicity", "_w")

    def ranks(v: str, name: str) -> DataFrame:
        counts = drawn.groupBy("multiset", v).agg(F.sum("_w").alias("_c"))
        below = F.coalesce(F.sum("_c").over(Window.partitionBy("multiset").orderBy(v).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select("multiset", v, (below + (F.col("_c") + 1) / 2.0).alias(name))

    both = drawn.join(ranks("_x", "_rx"), ["multiset", "_x"]).join(ranks("_y", "_ry"), ["multiset", "_y"])
    w = F.col("_w")
    s = both.groupBy("multiset", "times").agg(F.sum(w).alias("n"), *[F.sum(w * e).alias(k) for k, e in {"x": F.col("_rx"), "y": F.col("_ry"), "xx": F.col("_rx") * F.col("_rx"), "yy": F.col("_ry") * F.col("_ry"), "xy": F.col("_rx") * F.col("_ry")}.items()])
    cov = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    each = s.withColumn("_r", cov("x", "y", "xy") / F.nullif(F.sqrt(cov("x", "x", "xx") * cov("y", "y", "yy")), F.lit(0.0)))
    return each.filter(F.col("_r").isNotNull()).select("multiset", "times", "_r")


def rank_sums(df: DataFrame, value: str, in_a: str, in_b: str, group: list[str] | None = None) -> DataFrame:
    """n_a, n_b, rank_sum of a, and ties (the sum of t^3 - t), over the rows of either group."""
    rows = known(df, value).filter(F.col(in_a) | F.col(in_b))
    ties = rows.groupBy(*(group or []), value).agg(F.count("*").alias("_t")).groupBy(*(group or [])).agg(F.sum(F.pow(F.col("_t").cast("double"), F.lit(3.0)) - F.col("_t")).alias("ties"))
    sums = average_rank(rows, value, group, "_r").groupBy(*(group or [])).agg(F.count_if(in_a).alias("n_a"), F.count_if(~F.col(in_a)).alias("n_b"), F.sum(F.when(F.col(in_a), F.col("_r"))).alias("rank_sum"))
    return sums.join(ties, group) if group else sums.crossJoin(ties)


def cliffs_delta(df: DataFrame, value: str, in_a: str, in_b: str, group: list[str] | None = None) -> DataFrame:
    """n_a, n_b, delta = P(a > b) - P(a < b), for each group that has both."""
    rows = rank_sums(df, value, in_a, in_b, group).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    auc = (F.col("rank_sum") - F.col("n_a") * (F.col("n_a") + 1) / 2) / (F.col("n_a") * F.col("n_b"))
    return rows.select(*(group or []), "n_a", "n_b", (2 * auc - 1).alias("delta"))


def mann_whitney(df: DataFrame, value: str, in_a: str, in_b: str, group: list[str] | None = None) -> DataFrame:
    """n_a, n_b, u, z, p_value (that a is greater), exact (and the groups, those that have both samples).

    Without ties, where the smaller sample has at most EXACT rows, p is exact; else it is the normal tail of z, with ties and continuity.
    """
    rows = rank_sums(df, value, in_a, in_b, group).filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
    a, b, n = F.col("n_a"), F.col("n_b"), F.col("n_a") + F.col("n_b")
    u = F.col("rank_sum") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * ((n + 1) - F.col("ties") / F.greatest(n * (n - 1), F.lit(1))))
    found = rows.withColumns({"u": u, "z": (u - a * b / 2 - 0.5) / F.nullif(sd, F.lit(0.0)), "exact": (F.col("ties") == 0) & (F.least("n_a", "n_b") <= EXACT)})
    tail = F.when(F.col("exact"), exact_rank_sum_tail(F.col("n_a"), F.col("n_b"), F.col("u"))).otherwise(normal_tail(F.col("z")))
    return found.select(*(group or []), "n_a", "n_b", "u", "z", tail.alias("p_value"), "exact")


def drift_vs_scores(df: DataFrame, drift: str, scores: dict[str, int], key: str, n_perm: int = 2000, min_n: int = 20) -> DataFrame:
    """score, n, rho, p_value, z, stouffer_p, n_same_sign, n_slides of drift against each score (times its sign): pooled with a p value by permutation, combined over slides,
    and the slides (of min_n rows and more) whose rho has the sign of the pooled one."""
    out = None
    for name, sign in scores.items():
        rows = df.withColumn("_s", F.col(name) * sign)
        pooled = stored(block_permutation_spearman(rows, drift, "_s", key, n_perm=n_perm), "pooled")
        slides = stored(spearman(rows, drift, "_s", ["wsi"], min_n).withColumn("p_value", two_sided_p(F.col("rho"), F.col("n"))), "slides")
        signs = slides.select(F.signum("rho").alias("_sign")).crossJoin(F.broadcast(pooled.select(F.signum("rho").alias("_pooled"))))  # one row
        same = signs.agg(F.count_if(F.col("_sign") == F.col("_pooled")).alias("n_same_sign"), F.count("*").alias("n_slides"))
        combined = stouffer_signed(slides).select("z", F.col("p_value").alias("stouffer_p"))
        one = pooled.crossJoin(combined).crossJoin(same).select(F.lit(name).alias("score"), "n", "rho", "p_value", "z", "stouffer_p", "n_same_sign", "n_slides")
        out = one if out is None else out.unionByName(one)
    return out
