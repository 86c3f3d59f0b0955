"""Aggregates, rankings and set operations of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import format_mean_std

#: Blocks that a column's distinct values are cut into.
BLOCKS = 64


def class_counts(df: DataFrame, classes: DataFrame, group: list[str], label: str = "label") -> DataFrame:
    """group, label, n, proportion of every class of classes (column label), zero where it has none."""
    counts = df.groupBy(*group, label).agg(F.count("*").alias("n"))
    every = df.select(*group).distinct().crossJoin(F.broadcast(classes.select(label).distinct()))  # a mapping's classes
    rows = every.join(counts, [*group, label], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.sum("n").over(Window.partitionBy(*group))
    return rows.withColumn("proportion", F.when(whole > 0, F.col("n") / whole).otherwise(F.lit(0.0)))


def mean_std_n(df: DataFrame, group: list[str], metric: str, skipped: str | None = None) -> DataFrame:
    """mean, std (sample; 0 for one row), n of a metric; nulls and skipped rows take no part."""
    rows = df.filter(~F.coalesce(F.col(skipped), F.lit(False))) if skipped else df
    out = rows.groupBy(*group).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("n"))
    return out.withColumn("std", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("std")))


def paired_diff(df: DataFrame, key: list[str], condition: str, a, b, metric: str) -> DataFrame:
    """mean, std, n of metric(a) - metric(b) over the keys that both conditions have: one aggregation, no self-join."""
    of = lambda c: F.max(F.when(F.col(condition) == c, F.col(metric)))
    both = df.filter(F.col(condition).isin(a, b)).groupBy(*key).agg((of(a) - of(b)).alias("diff")).filter(F.col("diff").isNotNull())
    return mean_std_n(both, [], "diff")


def compare(df: DataFrame, key: list[str], condition: str, baseline, metric: str) -> DataFrame:
    """condition, mean, std, n of each, and the paired difference to a baseline over the keys that both have."""
    raw = mean_std_n(df, [condition], metric)
    base = df.filter(F.col(condition) == baseline).select(*key, F.col(metric).alias("_base"))
    diff = df.join(base, key).withColumn("_d", F.col(metric) - F.col("_base"))
    d = mean_std_n(diff, [condition], "_d").select(condition, F.col("mean").alias("diff_mean"), F.col("std").alias("diff_std"), F.col("n").alias("diff_n"))
    return raw.join(d, condition, "left")


def pivot_metric(df: DataFrame, row: str, column: str, values: list, metric: str) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.avg(metric))


def _with_group(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of side, which has one row for each value of keys, nulls included; without keys side is one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(side))
    other = side.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    return rows.join(other, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])).drop(*[f"_of_{k}" for k in keys])


def running_counts(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """group, value, _c, _b, _n of each distinct value: its rows, the rows below it and the group's rows; null values take no part.

    No task holds all values of a group: they are cut into BLOCKS, and the blocks' totals are added.
    """
    group = group or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("_c"))
    cuts = counts.groupBy(*group).agg(F.percentile_approx(value, [i / BLOCKS for i in range(1, BLOCKS)], 1000).alias("_e"))
    placed = _with_group(counts, cuts, group).withColumn("_k", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")
    blocks = placed.groupBy(*group, "_k").agg(F.sum("_c").alias("_t"))  # at most BLOCKS rows a group
    own = Window.partitionBy(*(group or [F.lit(0)]))
    before = blocks.withColumns({"_before": F.coalesce(F.sum("_t").over(own.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_t").over(own)}).drop("_t")
    inside = F.coalesce(F.sum("_c").over(Window.partitionBy(*group, "_k").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = _with_group(placed, before if group else F.broadcast(before), [*group, "_k"])
    return joined.withColumn("_b", inside + F.col("_before")).select(*group, value, "_c", "_b", "_n")


def quantiles(df: DataFrame, value: str, points: list[float], group: list[str] | None = None) -> DataFrame:
    """group, q: the exact quantiles of a column at some points, interpolated as F.percentile does. A group without values has no row; without groups q holds nulls then.

    F.percentile keeps all distinct values of a group in one buffer; here only the values at the wanted ranks leave their blocks.
    """
    group = group or []
    at = lambda rank: F.max(F.when((F.col("_b") <= rank) & (rank < F.col("_b") + F.col("_c")), F.col(value).cast("double")))
    ranks = [(F.col("_n") - 1) * F.lit(float(p)) for p in points]
    ends = [at(end(r)).alias(f"_{name}{i}") for i, r in enumerate(ranks) for name, end in (("l", F.floor), ("h", F.ceil))]
    found = running_counts(df, value, group).groupBy(*group).agg(F.max("_n").alias("_n"), *ends)
    mixed = [F.when(F.col(f"_l{i}") == F.col(f"_h{i}"), F.col(f"_l{i}")).otherwise((F.ceil(r) - r) * F.col(f"_l{i}") + (r - F.floor(r)) * F.col(f"_h{i}")) for i, r in enumerate(ranks)]
    return found.select(*group, F.array(*mixed).alias("q"))


def describe_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    """mean, median, std, n, sem of a metric by group; a group without values has no median. A null group is a group."""
    out = df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    middle = quantiles(df, value, [0.5], [group]).select(F.col(group).alias("_g"), F.col("q")[0].alias("median"))
    out = out.join(middle, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "mean", "median", "std", "n")
    return out.withColumn("sem", F.col("std") / F.sqrt("n"))


def distribution_summary(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    whole = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count_if((F.col(value) < low) | (F.col(value) > high)).alias("n_clipped"))
    q = quantiles(df, value, [0.5, 0.05, 0.95]).select(*[F.col("q")[i].alias(name) for i, name in enumerate(("median", "p5", "p95"))])
    return whole.crossJoin(F.broadcast(q)).select("n", "mean", "median", "p5", "p95", "min", "max", "n_clipped")  # one row each


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, group: list[str] | None = None) -> DataFrame:
    """bin (from 0), n, density of values clipped to [low, high]; high falls in the last bin."""
    group, width = group or [], (high - low) / bins
    clipped = F.greatest(F.lit(low), F.least(F.lit(high), F.col(value)))
    rows = df.filter(F.col(value).isNotNull()).withColumn("bin", F.least(F.lit(bins - 1), F.floor((clipped - low) / width)).cast("int"))
    counts = rows.groupBy(*group, "bin").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0)))  # bins rows per group
    return counts.withColumn("density", F.col("n") / (whole * width))


def whisker_limits(df: DataFrame, group: str, value: str) -> DataFrame:
    """Tukey's limits: the extreme values within 1.5 quartile distances of the quartiles."""
    q = quantiles(df, value, [0.25, 0.75], [group]).select(group, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    step = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, group).filter((F.col(value) >= F.col("q1") - step) & (F.col(value) <= F.col("q3") + step))
    return inside.groupBy(group).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.first("q1").alias("q1"), F.first("q3").alias("q3"))


def quantile_bins(df: DataFrame, x: str, y: str, q: int) -> DataFrame:
    """bin, n, x_mean, y_mean, y_std, y_sem over q quantile bins of x, right-closed, the first closed; equal edges merge."""
    rows = df.filter(F.col(x).isNotNull())
    cuts = quantiles(rows, x, [i / q for i in range(q + 1)]).select(F.array_distinct("q").alias("_e"))
    placed = rows.crossJoin(F.broadcast(cuts)).withColumn("bin", F.greatest(F.size(F.filter("_e", lambda e: e < F.col(x))) - 1, F.lit(0)))  # one row of edges
    out = placed.groupBy("bin").agg(F.count("*").alias("n"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), F.stddev_samp(y).alias("y_std"))
    return out.withColumn("y_sem", F.col("y_std") / F.sqrt("n"))


def hexbin(df: DataFrame, x: str, y: str, size: float, group: list[str] | None = None) -> DataFrame:
    """q, r (axial hexagon coordinates), n, log_n."""
    qf, rf = (3**0.5 / 3 * F.col(x) - F.col(y) / 3) / size, (2 / 3 * F.col(y)) / size
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_q": qf, "_r": rf}).withColumn("_s", -F.col("_q") - F.col("_r"))
    rows = rows.withColumns({"_rq": F.bround("_q", 0), "_rr": F.bround("_r", 0), "_rs": F.bround("_s", 0)})
    dq, dr, ds = F.abs(F.col("_rq") - F.col("_q")), F.abs(F.col("_rr") - F.col("_r")), F.abs(F.col("_rs") - F.col("_s"))
    q = F.when((dq > dr) & (dq > ds), -F.col("_rr") - F.col("_rs")).otherwise(F.col("_rq"))
    r = F.when((dq > dr) & (dq > ds), F.col("_rr")).when(dr > ds, -F.col("_rq") - F.col("_rs")).otherwise(F.col("_rr"))
    return rows.groupBy(*(group or []), q.cast("int").alias("q"), r.cast("int").alias("r")).agg(F.count("*").alias("n")).withColumn("log_n", F.log10("n"))


def gaussian_kde(df: DataFrame, value: str, points: list[float]) -> DataFrame:
    """x, density at some points, Scott's bandwidth std * n^(-1/5): one pass over the rows for all points."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"))
    h = rows.agg((F.stddev_samp("_v") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("_h"), F.count("*").alias("_n"))
    both = rows.crossJoin(F.broadcast(h))  # one row
    at = lambda p: F.sum(F.exp(-F.pow((F.lit(p) - F.col("_v")) / F.col("_h"), F.lit(2.0)) / 2))
    sums = both.agg(*[at(p).alias(f"p{i}") for i, p in enumerate(points)], F.first("_h").alias("_h"), F.first("_n").alias("_n"))
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("x"), (F.col(f"p{i}") / (F.col("_n") * F.col("_h") * (2 * 3.141592653589793) ** 0.5)).alias("density")) for i, p in enumerate(points)])
    return sums.select(F.explode(pairs).alias("s")).select("s.*")


def confusion_matrix(df: DataFrame, labels: list, true: str = "true_label", predicted: str = "predicted_label", group: list[str] | None = None, times: str | None = None) -> DataFrame:
    """true, predicted, n over the complete grid of labels; times is the column that tells how often a row counts."""
    group = group or []
    spark, names = df.sparkSession, ", ".join(f"'{x}'" for x in labels)
    grid = spark.sql(f"SELECT t AS true_label, p AS predicted_label FROM (SELECT explode(array({names})) AS t) CROSS JOIN (SELECT explode(array({names})) AS p)")
    if group:
        grid = df.select(*group).distinct().crossJoin(F.broadcast(grid))
    counts = df.groupBy(*group, F.col(true).alias("true_label"), F.col(predicted).alias("predicted_label")).agg((F.sum(times) if times else F.count("*")).alias("n"))
    return grid.join(counts, [*group, "true_label", "predicted_label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class_f1(confusion: DataFrame, group: list[str] | None = None) -> DataFrame:
    """label, support, tp, predicted, precision, recall, f1 (zero where undefined)."""
    group = group or []
    rows = confusion.groupBy(*group, F.col("true_label").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("true_label") == F.col("predicted_label"), F.col("n")).otherwise(0)).alias("tp"))
    cols = confusion.groupBy(*group, F.col("predicted_label").alias("label")).agg(F.sum("n").alias("predicted"))
    both = rows.join(cols, [*group, "label"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    both = both.withColumns({"precision": ratio(F.col("tp"), F.col("predicted")), "recall": ratio(F.col("tp"), F.col("support"))})
    return both.withColumn("f1", ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted")))


def classification_report(confusion: DataFrame, group: list[str] | None = None) -> DataFrame:
    """accuracy, macro_f1 and weighted_f1 over all labels of the matrix, balanced_accuracy over those present in the truth."""
    f1, n = per_class_f1(confusion, group), F.sum("support")
    return f1.groupBy(*(group or [])).agg(
        (F.sum("tp") / n).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def r2_score(df: DataFrame, true: str, predicted: str, group: list[str] | None = None) -> DataFrame:
    """r2 of each group: a constant target gives 0 if it is met exactly and minus infinity otherwise. Sums of squares about the mean come from partial moments, so no row is sent."""
    rows = df.filter(F.col(true).isNotNull() & F.col(predicted).isNotNull())
    off = F.col(true) - F.col(predicted)
    sums = rows.groupBy(*(group or [])).agg(F.sum(off * off).alias("_res"), (F.var_pop(true) * F.count("*")).alias("_tot"), F.count("*").alias("n"))
    r2 = F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.col("_tot")).when(F.col("_res") == 0, F.lit(0.0)).otherwise(F.lit(float("-inf")))
    return sums.withColumn("r2", r2).drop("_res", "_tot")


def mean_finite(value: Column) -> Column:
    return F.avg(F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value))


def angular_error(df: DataFrame, true: str, predicted: str) -> DataFrame:
    d = F.pmod(F.abs(F.col(true) - F.col(predicted)), F.lit(180.0))
    return df.agg(F.avg(F.least(d, 180 - d)).alias("mean_error")).withColumn("selection", -F.col("mean_error"))


def sample_weights(df: DataFrame, n_classes: int, by_class: bool = True, by_wsi: bool = True, label: str = "label") -> DataFrame:
    """df with weight: inverse frequencies by class and by slide, multiplied, with mean 1. Counts come from small aggregates."""
    whole = df.agg(F.count("*").alias("_n"), F.count_distinct("wsi").alias("_k"))
    rows = df.crossJoin(F.broadcast(whole)).withColumn("weight", F.lit(1.0))
    if by_class:
        rows = rows.join(df.groupBy(label).agg(F.count("*").alias("_c")), label).withColumn("weight", F.col("weight") * F.col("_n") / (n_classes * F.col("_c"))).drop("_c")
    if by_wsi:
        rows = rows.join(df.groupBy("wsi").agg(F.count("*").alias("_w")), "wsi").withColumn("weight", F.col("weight") * F.col("_n") / (F.col("_k") * F.col("_w"))).drop("_w")
    mean = rows.agg(F.avg("weight").alias("_mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("_mean")).drop("_n", "_k", "_mean")


def status_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def match_report(matches: DataFrame, threshold: float) -> DataFrame:
    whole = matches.agg(F.count("*").alias("n"), F.avg(F.col("other_id").isNotNull().cast("double")).alias("matched_share"), F.count_if(F.col("score") > threshold).alias("n_above"))
    middle = quantiles(matches.select(F.hypot("dx", "dy").alias("_o")), "_o", [0.5]).select(F.col("q")[0].alias("median_offset"))
    return whole.crossJoin(F.broadcast(middle))  # one row each


def best_row(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def select_best_trial(trials: DataFrame, keys: list[str], metric: str) -> DataFrame:
    """The first best trial: the largest metric, then the smallest trial_idx."""
    return best_row(trials, keys, F.desc_nulls_last(metric), F.asc("trial_idx"))


def sequential_id(df: DataFrame, key: str, prefix: Column, *order: Column) -> DataFrame:
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("seq_id", F.concat(prefix, number.cast("string")))


def average_rank(df: DataFrame, value: str, group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """df with the mid-ranks of a value, pooled or by group; null where the value or a group is. A frequent value's rows are one key of the last join, which AQE splits."""
    group = group or []
    ranked = running_counts(df, value, group).select(*group, value, (F.col("_b") + (F.col("_c") + 1) / 2.0).alias(name))
    return df.join(ranked, [*group, value], "left")


def prefer_first(df: DataFrame, key: str, preference: str, order: list, *ties: str) -> DataFrame:
    """The row of each key whose preference comes first in order; ties: columns that decide among rows of one preference."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(preference))
    return best_row(df, [key], F.when(place > 0, place).otherwise(F.lit(len(order) + 1)), F.col(preference), *map(F.col, ties))


def cap_per_key(df: DataFrame, keys: list[str], k: int, seed: int, *ids: str) -> DataFrame:
    """At most k rows of a key, chosen by the md5 of a seed and their ids, which other engines have too."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order, *ids))).filter(F.col("_r") <= k).drop("_r")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("duplicate", F.count("*").over(Window.partitionBy(*keys)) > 1)


def top_k(df: DataFrame, metric: str, tie: str, k: int, largest: bool = True) -> DataFrame:
    return df.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric) if largest else F.asc(metric), F.asc(tie)).limit(k)


def quantile_masks(df: DataFrame, value: str, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """df with a flag for each band of pooled quantiles, both ends included."""
    edges = sorted({q for band in bands.values() for q in band})
    cuts = quantiles(df, value, edges).withColumnRenamed("q", "_e")
    at = lambda q: F.get("_e", F.lit(edges.index(q)))
    flags = {name: (F.col(value) >= at(a)) & (F.col(value) <= at(b)) for name, (a, b) in bands.items()}
    return df.crossJoin(F.broadcast(cuts)).withColumns(flags).drop("_e")  # one row of edges


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def intersection(keys: list[str], *parts: DataFrame) -> DataFrame:
    """The keys that every part has, once each; nulls are equal."""
    return reduce(DataFrame.intersect, [p.select(*keys) for p in parts])


def difference(keys: list[str], expected: DataFrame, present: DataFrame) -> DataFrame:
    """keys, side: what is expected and missing, and what is present and not expected, once each; nulls are equal."""
    a, b = expected.select(*keys), present.select(*keys)
    return a.subtract(b).withColumn("side", F.lit("missing")).unionByName(b.subtract(a).withColumn("side", F.lit("unexpected")))


def advantage(df: DataFrame, key: list[str], condition: str, baseline, metric: str) -> DataFrame:
    """condition, mean, base_mean, diff_mean, diff_std, diff_n and relative (the mean difference in shares of the baseline's mean) of each condition but the baseline, over the keys that both have."""
    base = df.filter(F.col(condition) == baseline).select(*key, F.col(metric).alias("_base"))
    both = df.filter(F.col(condition) != baseline).join(base, key).filter(F.col(metric).isNotNull() & F.col("_base").isNotNull()).withColumn("_d", F.col(metric) - F.col("_base"))
    out = both.groupBy(condition).agg(F.avg(metric).alias("mean"), F.avg("_base").alias("base_mean"), F.avg("_d").alias("diff_mean"), F.stddev_samp("_d").alias("diff_std"), F.count("*").alias("diff_n"))
    out = out.withColumn("diff_std", F.when(F.col("diff_n") == 1, F.lit(0.0)).otherwise(F.col("diff_std")))
    return out.withColumn("relative", F.col("diff_mean") / F.nullif(F.abs("base_mean"), F.lit(0.0)))


def layout(df: DataFrame, row: str, column: str, values: list, metric: str, expected: int) -> DataFrame:
    """row, and a text "mean +/- std" (with n of expected where some are missing, - without any) for each of the column's values."""
    stats = mean_std_n(df.filter(F.col(column).isin(values)), [row, column], metric)
    text = stats.withColumn("_t", format_mean_std(F.col("mean"), F.col("std"), F.col("n"), expected))
    return text.groupBy(row).pivot(column, values).agg(F.first("_t")).na.fill("-", [str(v) for v in values])


def ordered(df: DataFrame, *order: Column) -> DataFrame:
    """A report's rows with their position, from 1; reports are small, so one task numbers them."""
    return df.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def fold_change(df: DataFrame, key: list[str], condition: str, baseline, metric: str) -> DataFrame:
    """condition, mean, std, n of each fold's ratio to the baseline's; ratios that are infinite or null are left out, and where none is left the ratio of means stands."""
    base = df.filter(F.col(condition) == baseline).select(*key, F.col(metric).alias("_b"))
    rows = df.join(base, key).withColumn("_ratio", F.when(F.col("_b") != 0, F.col(metric) / F.col("_b")))
    out = rows.groupBy(condition).agg(F.avg("_ratio").alias("mean"), F.stddev_samp("_ratio").alias("std"), F.count("_ratio").alias("n"), (F.avg(metric) / F.nullif(F.avg("_b"), F.lit(0.0))).alias("_of_means"))
    return out.withColumn("mean", F.coalesce("mean", "_of_means")).withColumn("std", F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("std"))).drop("_of_means")


def gene_interval_stats(genes: DataFrame, tops: list[int]) -> DataFrame:
    """top_n, n, mean, median of pearson over the genes of rank up to n (clipped to their number); nulls take no part."""
    ranked = genes.withColumn("_r", F.row_number().over(Window.orderBy(F.asc_nulls_last("rank"), "gene")))  # one row per gene of a panel
    each = ranked.withColumn("top_n", F.explode(F.array(*map(F.lit, tops)))).filter(F.col("_r") <= F.col("top_n"))
    return each.groupBy("top_n").agg(F.count("pearson").alias("n"), F.avg("pearson").alias("mean"), F.percentile("pearson", 0.5).alias("median"))
